"""Nested request / response documents (S4, S5, ST2 schema).

A request is one JSON document per basket: a header struct and an array of
line structs.  Export (S5) nests lines per basket with ``collect_list`` —
bounded by the basket's own line count — and renders ISO timestamps; parsing
(S4) reads every field as text and casts it once, so ids may be any string and
a value of the wrong type is a reject of its document, not an error of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.functions import scalar as S

# field -> type; a request's text must cast to it
LINE_TYPES = {
    "id": "int", "product_id": "string", "timestamp": "timestamp_ntz", "pieces_or_weight": "double", "sales_price": "double",
    "was_voided": "boolean", "camera_product_similar": "boolean", "camera_certainty": "double",
}
HEADER_TYPES = {
    "store_id": "string", "cash_desk": "int", "transaction_start": "timestamp_ntz", "transaction_end": "timestamp_ntz",
    "total_amount": "double", "payment_medium": "string", "customer_feedback": "int",
}
REQUIRED_HEADER = ["store_id", "cash_desk", "transaction_start", "transaction_end", "total_amount", "payment_medium"]
REQUIRED_LINE = ["id", "timestamp", "pieces_or_weight", "sales_price", "was_voided"]


def _texts(fields) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


# every field is read as text first, so a value of the wrong type is seen and rejected instead of read as null
REQUEST_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("transaction_header", _texts(HEADER_TYPES)),
    T.StructField("transaction_lines", T.ArrayType(_texts(LINE_TYPES))),
])



def to_payload(tx: DataFrame, lines: DataFrame) -> DataFrame:
    """One JSON document per basket (lines sorted by id, ISO timestamps)."""
    line = F.struct(
        F.col("id").alias("id"),
        F.col("product_id").cast("string").alias("product_id"),
        S.iso("timestamp").alias("timestamp"),
        "pieces_or_weight", "sales_price", "was_voided", "camera_product_similar", "camera_certainty",
    )
    nested = lines.groupBy("transaction_id").agg(F.sort_array(F.collect_list(line)).alias("transaction_lines"))
    header = F.struct(
        F.col("store_id").cast("string").alias("store_id"), "cash_desk",
        S.iso("transaction_start").alias("transaction_start"), S.iso("transaction_end").alias("transaction_end"),
        "total_amount", "payment_medium", "customer_feedback",
    )
    t = tx.select(F.col("id").alias("transaction_id"), header.alias("transaction_header"))
    j = t.join(nested, "transaction_id", "left")
    doc = F.struct("transaction_id", "transaction_header",
                   F.coalesce(F.col("transaction_lines"), F.array()).alias("transaction_lines"))
    return j.select("transaction_id", F.to_json(doc).alias("payload"))


#: Documents of a file of requests: it is compressed, so one task reads all of it.
REQUESTS_PER_FILE = 50_000


def write_requests(payloads: DataFrame, path: str, per_file: int = REQUESTS_PER_FILE) -> None:
    """The ``payload`` texts as files of one document a line."""
    files = payloads.select(F.col("payload").alias("value")).write.mode("overwrite")
    files.option("maxRecordsPerFile", per_file).text(path, compression="gzip")


def _typed(struct: Column, types: dict[str, str]) -> Column:
    return F.struct(*[struct[f].try_cast(t).alias(f) for f, t in types.items()])


def _wrong(struct: Column, typed: Column, types: dict[str, str], required: list[str], name: str) -> list[Column]:
    """For each field null, or what is wrong with it: its type (``typed`` has it cast), or that it is missing."""
    out = []
    for f, t in types.items():
        bad = F.when(struct[f].isNotNull() & typed[f].isNull(), F.lit(f"{name}.{f}: not a {t}"))
        out.append(bad.when(struct[f].isNull(), F.lit(f"{name} field missing: {name}.{f}")) if f in required else bad)
    return out


def parse_requests(raw: DataFrame, text_col: str = "payload") -> DataFrame:
    """JSON text -> (request_id, request, raw, reject_reason).

    ``request_id`` is generated for every document, as a request carries no
    key of its own that could be relied on: two documents with one
    ``transaction_id`` (or none) stay two requests.  ``reject_reason`` (ST2) is
    null for a valid document.
    """
    doc = F.from_json(F.col(text_col), REQUEST_SCHEMA)
    parsed = raw.select(doc.alias("_doc"), F.col(text_col).alias("raw"))
    header, lines = F.col("_doc.transaction_header"), F.col("_doc.transaction_lines")
    parsed = parsed.select(
        "_doc", "raw", _typed(header, HEADER_TYPES).alias("_header"), F.transform(lines, lambda l: _typed(l, LINE_TYPES)).alias("_lines")
    )  # each field is cast once, for the check and the request
    # PERMISSIVE from_json yields a struct of nulls (not a null struct) for malformed text
    malformed = F.col("_doc").isNull() | (F.col("_doc.transaction_id").isNull() & header.isNull() & lines.isNull())
    of_lines = F.array_distinct(F.flatten(F.coalesce(F.zip_with(
        lines, "_lines", lambda l, typed: F.array_compact(F.array(*_wrong(l, typed, LINE_TYPES, REQUIRED_LINE, "line")))
    ), F.array())))
    found = F.concat(
        F.array_compact(F.array(
            *_wrong(header, F.col("_header"), HEADER_TYPES, REQUIRED_HEADER, "header"), F.when(lines.isNull(), F.lit("transaction_lines missing"))
        )),
        of_lines,
    )
    request = F.struct(
        F.col("_doc.transaction_id").alias("transaction_id"),
        F.col("_header").alias("transaction_header"),
        F.col("_lines").alias("transaction_lines"),
    )
    return parsed.select(
        F.concat_ws("-", F.substring(F.sha2("raw", 256), 1, 16), F.monotonically_increasing_id()).alias("request_id"),
        request.alias("request"),
        "raw",
        F.when(malformed, F.lit("malformed JSON")).when(F.size(found) > 0, F.array_join(found, ", ")).alias("reject_reason"),
    )


def _key(name: str) -> Column:
    return F.col("request.transaction_id") if name == "transaction_id" else F.col(name)


def header_rows(parsed: DataFrame, key: str = "request_id") -> DataFrame:
    """Request -> transactions-shaped rows (label UNKNOWN, damage 0, n_lines = request lines), named by ``key``."""
    h = F.col("request.transaction_header")
    return parsed.select(
        _key(key).alias("id"),
        *[h[f].alias(f) for f in HEADER_TYPES],
        F.lit(0.0).alias("damage"), F.lit("UNKNOWN").alias("label"),
        F.size(F.coalesce(F.col("request.transaction_lines"), F.array())).cast("bigint").alias("n_lines"),
    )


def line_rows(parsed: DataFrame, key: str = "request_id") -> DataFrame:
    """Request -> transaction_lines-shaped rows; a request without lines gives none."""
    ex = parsed.select(_key(key).alias("transaction_id"), F.explode("request.transaction_lines").alias("l"))
    return ex.select("l.id", "transaction_id", *[f"l.{f}" for f in LINE_TYPES if f != "id"])
