"""Column expressions (F-rows of the inventory).

All helpers return ``pyspark.sql.Column`` built from built-in functions, so
they stay inside whole-stage codegen.  Timestamps are ``TIMESTAMP_NTZ``
throughout; elapsed times use ``timestampdiff`` in microseconds and truncate
like the reference's ``total_seconds``/``total_days``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (natural order).
# ---------------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
# hour -> daytime; hours 0-7 and 23 have none
DAYTIME_BUCKETS = [(8, 11, "morning"), (12, 15, "noon"), (16, 19, "afternoon"), (20, 22, "evening")]
# customer feedback 1..10 -> category; null -> MISSING
FEEDBACK_BUCKETS = [(1, 3, "LOW"), (4, 6, "MIDDLE"), (7, 9, "HIGH"), (10, 10, "TOP")]
# city -> licence-plate code
CITY_CODES = {
    "Bielefeld": "BI",
    "Berlin": "B",
    "Bonn": "BN",
    "Chemnitz": "C",
    "Dortmund": "DO",
    "Düsseldorf": "D",
    "Heidelberg": "HD",
    "Karlsruhe": "KA",
    "Kassel": "KS",
    "Köln": "K",
    "Leipzig": "L",
    "München": "M",
    "Oberhausen": "OB",
    "Osnabrück": "OS",
    "Stuttgart": "S",
}
# category flag column -> German display name
CATEGORY_NAMES_DE = {
    "has_frozen_goods": "Tiefkühlkost",
    "has_beverages": "Getränke",
    "has_dairy": "Milchprodukte",
    "has_bakery": "Backwaren",
    "has_fruits_vegetables": "Obst/Gemüse",
    "has_personal_care": "Körperpflege",
    "has_household": "Haushalt",
    "has_tobacco": "Tabak",
    "has_long_shelf_life": "Lange Haltbar",
    "has_convenience": "Fertigprodukte",
    "has_snacks": "Snacks",
    "has_alcohol": "Alkohol",
    "has_fruits_vegetables_pieces": "Obst/Gemüse (Stück)",
}
# umlaut transliteration, applied in this order
UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")]
CAMERA_CERTAINTY_THRESHOLD = 0.8
MISSING = "MISSING"
# ---------------------------------------------------------------------------

US_PER_SECOND = 1_000_000
US_PER_DAY = 86_400 * US_PER_SECOND


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_name(ts: str | Column) -> Column:
    """English weekday name (Monday..Sunday)."""
    return F.date_format(_c(ts), "EEEE")


def weekday_from_number(n: str | Column) -> Column:
    """ISO weekday number 1..7 (Monday = 1) -> name, else null."""
    return F.try_element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), _c(n).cast("int"))


def month_name(ts: str | Column) -> Column:
    """English month name."""
    return F.date_format(_c(ts), "MMMM")


def month_from_number(n: str | Column) -> Column:
    """month number, also given as text ('3', '03'), -> name; else null."""
    num = _c(n).try_cast("int")
    return F.when(num.between(1, 12), F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]), num))


def daytime(hour: str | Column) -> Column:
    """8-11 morning, 12-15 noon, 16-19 afternoon, 20-22 evening, else null."""
    h = _c(hour)
    expr = None
    for lo, hi, name in DAYTIME_BUCKETS:
        expr = (F.when if expr is None else expr.when)(h.between(lo, hi), F.lit(name))
    return expr


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def whole_seconds(start: str | Column, end: str | Column) -> Column:
    """elapsed whole seconds, truncated toward zero."""
    return (micros_between(start, end) / F.lit(US_PER_SECOND)).cast("bigint")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """elapsed seconds as double."""
    return micros_between(start, end) / F.lit(float(US_PER_SECOND))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """elapsed whole days, truncated toward zero."""
    return (micros_between(start, end) / F.lit(US_PER_DAY)).cast("bigint")


def per_line(duration: str | Column, n_lines: str | Column) -> Column:
    """F8: duration per line, null when there are no lines."""
    return F.try_divide(_c(duration).cast("double"), F.when(_c(n_lines) != 0, _c(n_lines)))


def parse_date(text: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """date text -> TIMESTAMP_NTZ at midnight."""
    return F.to_timestamp_ntz(_c(text), F.lit(fmt))


def month_start(year: str | Column, month: str | Column) -> Column:
    """first day of a month."""
    return F.make_date(_c(year), _c(month), F.lit(1))


def iso(ts: str | Column) -> Column:
    """ISO-8601 text with seconds."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def recode(col: str | Column, mapping: Mapping[str, str]) -> Column:
    """dictionary recode, null for unmapped keys."""
    if not mapping:
        return F.lit(None).cast("string")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), _c(col))


def transliterate(col: str | Column) -> Column:
    """umlauts -> ASCII digraphs (nested replace, no UDF)."""
    out = _c(col)
    for src, dst in UMLAUTS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def has_value(col: str | Column) -> Column:
    """not-null flag."""
    return _c(col).isNotNull()


def feedback_category(fb: str | Column) -> Column:
    """LOW/MIDDLE/HIGH/TOP, null -> MISSING (values outside 1..10 too)."""
    f = _c(fb)
    expr = None
    for lo, hi, name in FEEDBACK_BUCKETS:
        expr = (F.when if expr is None else expr.when)(f.between(lo, hi), F.lit(name))
    return F.coalesce(expr, F.lit(MISSING))


def feedback_flag(fb: str | Column, bucket: str) -> Column:
    """F16: feedback in bucket, null -> false."""
    lo, hi = next((lo, hi) for lo, hi, name in FEEDBACK_BUCKETS if name == bucket)
    return F.coalesce(_c(fb).isin(list(range(lo, hi + 1))), F.lit(False))


def price_difference(price: str | Column, qty: str | Column, sales: str | Column) -> Column:
    """nominal price x quantity - sales price (null when product unknown)."""
    return _c(price) * _c(qty) - _c(sales)


def price_ratio(sales: str | Column, price: str | Column, qty: str | Column) -> Column:
    """sales / (price x quantity); null on zero denominators."""
    return F.try_divide(_c(sales), _c(price) * _c(qty))


def near(x: str | Column, y: str | Column, eps: float) -> Column:
    """abs(x - y) < eps."""
    return F.abs(_c(x) - _c(y)) < F.lit(eps)


def far(x: str | Column, y: str | Column, eps: float) -> Column:
    return F.abs(_c(x) - _c(y)) > F.lit(eps)


def is_fraud(label: str | Column) -> Column:
    """label -> 0/1 (null stays null)."""
    return (_c(label) == F.lit("FRAUD")).cast("int")


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """clip into [lo, hi]."""
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def offending_text(product_id: str | Column, category: str | Column) -> Column:
    """'id (CATEGORY)'."""
    return F.format_string("%s (%s)", _c(product_id).cast("string"), _c(category))


def reason_text(features: str | Column) -> Column:
    """model explanation text from array<struct<feature, value, contribution>>."""
    items = F.transform(
        _c(features),
        lambda s: F.format_string("Merkmal %s hat den Wert %.2f (%.2f Einfluss)", s["feature"], s["value"], s["contribution"]),
    )
    return F.concat(F.lit("Das Modell hat einen möglichen Betrugsfall erkannt: "), F.array_join(items, "\n - "))


def valid_version(version: str | Column) -> Column:
    """semantic version x.y.z."""
    return _c(version).rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")


def valid_probability(p: str | Column) -> Column:
    """probability null or in [0, 1]."""
    return _c(p).isNull() | _c(p).between(0.0, 1.0)


def significance(p: str | Column) -> Column:
    """p-value label with right-closed bins (-0.01,0.01], (0.01,0.05], (0.05,1]."""
    pv = _c(p)
    return (
        F.when((pv > -0.01) & (pv <= 0.01), F.lit("*** sehr signifikant"))
        .when((pv > 0.01) & (pv <= 0.05), F.lit("** signifikant"))
        .when((pv > 0.05) & (pv <= 1.0), F.lit("n.s."))
    )


def relevance(r2: str | Column, for_label: bool) -> Column:
    """model-fit relevance label; logit pseudo-R² for the label, R² otherwise."""
    hi, lo = (0.2, 0.05) if for_label else (0.1, 0.02)
    r = F.coalesce(_c(r2), F.lit(0.0))
    return F.when(r >= hi, F.lit("sehr relevant")).when(r >= lo, F.lit("weniger relevant")).otherwise(F.lit("nicht relevant"))


def category_column(category: str) -> str:
    """Dynamic one-hot name: has_<category> in lower case, non-alphanumerics -> '_'."""
    import re

    return "has_" + re.sub(r"[^0-9a-z]+", "_", category.lower()).strip("_")
