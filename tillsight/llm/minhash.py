"""Document fingerprints: one-permutation MinHash (operator 10, DataFrame functions only).

Each 5-word shingle (a text of fewer words: its whole word sequence) is hashed
once with XXH64 over its words' XXH64 values.  The top bits of the hash name
the bin, the smallest hash of a bin is its value.  An empty bin borrows from
another by independent pseudo-random probes of its own until one hits an
occupied bin (optimal densification), so similar texts borrow alike.  ``BITS`` low-order bits of each value are kept.  The likeness of
two fingerprints is the share of equal bins, corrected for the 1 / 2^BITS
that agree by chance.

Defined cases: null text counts as empty; a text without words has the empty
fingerprint, which is like another empty one (1.0) and unlike any other (0.0).
Null ids sort after all others; rows that share an id are ordered by the hash
of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BITS = 8
SHINGLE = 5
PROBES = 6


def fingerprint_values(text: str, bin_bits: int = BIN_BITS, bits: int = BITS, shingle: int = SHINGLE) -> str:
    """SQL expression over the string expression ``text``: the bins' packed low-order bits in bin order."""
    bins, low = 1 << bin_bits, (1 << bits) - 1
    word_hashes = f"transform(filter(split({text}, '[ \\\\t-\\\\r]+'), w -> w != ''), w -> xxhash64(w))"
    window = ", ".join(f"get(wh, i + {j})" for j in range(shingle))
    hashes = (
        f"transform(array({word_hashes}), wh -> if(size(wh) = 0, array(), "
        f"transform(sequence(0, greatest(size(wh) - {shingle}, 0)), i -> xxhash64({window}))))[0]"
    )
    bin_of = lambda x: f"shiftrightunsigned({x}, {64 - bin_bits})"
    # in signed order the hashes of a bin are neighbours, its smallest first
    occupied = (
        f"transform(array(sort_array({hashes})), s -> "
        f"filter(s, (x, i) -> i = 0 or {bin_of('x')} != {bin_of('s[greatest(i - 1, 0)]')}))[0]"
    )
    # one probe after the other until one hits an occupied bin; after PROBES misses, the first in an order of the bin's own
    probe = lambda a: f"get(o, cast(array_position(b, shiftrightunsigned(xxhash64(e, {a}), {64 - bin_bits})) as int) - 1)"
    first = f"array_min(transform(o, x -> (xxhash64(e, {bin_of('x')}) & ~{low}L) | (x & {low}L)))"
    borrowed = (
        f"transform(array(transform(o, x -> {bin_of('x')})), b -> transform(array_except(sequence(0L, {bins - 1}L), b), "
        f"e -> shiftleft(e, {bits}) | (coalesce({', '.join(map(probe, range(PROBES)))}, {first}) & {low}L)))[0]"
    )
    own = f"transform(o, x -> shiftleft({bin_of('x')}, {bits}) | (x & {low}L))"
    return (
        f"transform(array({occupied}), o -> if(size(o) = 0, cast(array() as array<smallint>), "
        f"transform(sort_array(concat({own}, if(size(o) = {bins}, cast(array() as array<bigint>), {borrowed}))), "
        f"v -> cast(v & {low}L as smallint))))[0]"
    )


def packed(values: Column, bits: int = BITS) -> Column:
    """Hexadecimal string of the values, ``bits`` / 4 digits each."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), bits // 4, "0")), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two texts from their bin values."""
    chance = 2.0**-bits
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.greatest(F.size(a), F.lit(1))
    both = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both)
    )


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of its text column as a hexadecimal string."""
    return df.withColumn(out, packed(F.expr(fingerprint_values(f"coalesce(`{text}`, '')"))))


def with_next(documents: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, text, own, next_text, next_own): each document and its fingerprint beside the next one's.

    The next one is taken in descending id order; after the last comes the first.

    Ids are cut into ``buckets`` ranges at approximate quantiles.  The first
    document of a range is also dealt to the range before it (the first of all
    to the last range), marked ``extra``, so a window in each range sees every
    neighbour and no window holds more than one range.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("pos", F.coalesce("doc_id", F.lit(-(1 << 63))))
    points = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = docs.agg(F.percentile_approx("pos", F.array(*map(F.lit, points)), F.lit(100 * len(points)))).first()[0] or []
    cuts = sorted(set(cuts))
    docs = docs.withColumn(
        "bucket",
        F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("pos"))) if cuts else F.lit(0),
    )
    # one row a range: at most ``buckets`` of them
    heads = sorted(docs.groupBy("bucket").agg(F.max("pos").alias("head")).collect())
    before = {row["head"]: heads[(i + 1) % len(heads)]["bucket"] for i, row in enumerate(heads)}
    own = F.struct(F.col("bucket"), F.lit(False).alias("extra"))
    if before:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        extra = F.struct(F.element_at(to, F.col("pos")).alias("bucket"), F.lit(True).alias("extra"))
        spots = F.when(F.col("pos").isin(list(before)), F.array(own, extra)).otherwise(F.array(own))
    else:
        spots = F.array(own)
    dealt = docs.select(
        "doc_id", "pos", "text", F.expr(fingerprint_values("text")).alias("own"), F.explode(spots).alias("spot")
    ).select("doc_id", "pos", "text", "own", "spot.bucket", "spot.extra")
    order = Window.partitionBy("bucket").orderBy(
        "extra", F.desc("pos"), F.desc(F.xxhash64("text")), F.desc("text")
    )
    return (
        dealt.withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)})
        .where("not extra")
        .select("doc_id", "text", "own", "next_text", "next_own")
    )


def edited_fingerprints(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses."""
    spark = documents.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    half = "cast(floor(char_length(text) / 2) as int)"
    rows = with_next(documents, buckets).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.expr(f"concat(left(text, char_length(text) - {half}), left(next_text, {half}))").alias("edited"),
        "own",
        "next_own",
    )
    rows = rows.withColumn("changed", F.expr(fingerprint_values("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
