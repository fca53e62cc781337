"""Request-stream screening (ST1) with a reject sink (ST2).

Requests arrive as JSON text files (one document per line).  Each
micro-batch is handed to ``foreachBatch`` as a static DataFrame and runs the
*batch* cascade (:func:`tillsight.operators.rules.screen`), so the stream
answers exactly like the batch job — no streaming state is involved, because
every basket is complete inside its own document.  Products / stores are
static DataFrames joined per micro-batch (AQE sizes the joins).

Sinks are idempotent per epoch (``epoch=<id>`` folders written with
overwrite), so a micro-batch replayed after a failure replaces its own output
instead of duplicating it; the checkpoint location must be on shared storage.
The parsed requests of a micro-batch are read several times, so they are held as
a compressed table below the shared checkpoint folder, which goes with the
micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillsight.operators.features import feature_matrix
from tillsight.operators.rules import screen
from tillsight.session import scratch_table
from tillsight.sources.files import remove
from tillsight.sources.requests import header_rows, line_rows, parse_requests


def screen_requests(parsed: DataFrame, products: DataFrame, stores: DataFrame, excluded: DataFrame,
                    categories: Sequence[str]) -> DataFrame:
    """Batch screening of parsed, valid requests (online semantics: no label-wise imputation).

    Baskets are told apart by ``request_id``; product ids are compared as
    text, as a request may name any.  ``transaction_id`` is what was sent.
    """
    tx = header_rows(parsed)
    lines = line_rows(parsed)
    products = products.withColumn("id", F.col("id").cast("string"))
    fm = feature_matrix(tx, lines, products, stores, categories=list(categories), impute=False)
    out = screen(tx, lines, products, fm, excluded).withColumnRenamed("transaction_id", "request_id")
    return out.join(parsed.select("request_id", F.col("request.transaction_id").alias("transaction_id")), "request_id")


def held_requests(parsed: DataFrame) -> DataFrame:
    """What a micro-batch keeps of its parsed requests: the text of the rejects only, that of the others is not read again."""
    return parsed.withColumn("raw", F.when(F.col("reject_reason").isNotNull(), F.col("raw")))


def start_request_stream(
    spark: SparkSession,
    source_dir: str,
    result_dir: str,
    reject_dir: str,
    checkpoint_dir: str,
    products: DataFrame,
    stores: DataFrame,
    excluded: DataFrame,
    categories: Sequence[str],
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """ST1 + ST2: JSON request files in, screening results and rejects out."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        parsed = held_requests(parse_requests(batch, "value"))
        held = scratch_table(spark, "stream-held")
        try:
            parsed.write.parquet(held, compression="zstd")
            batch = batch.sparkSession.read.schema(parsed.schema).parquet(held)
            rejects = batch.where(F.col("reject_reason").isNotNull()).select("raw", "reject_reason")
            rejects.write.mode("overwrite").parquet(f"{reject_dir}/epoch={epoch_id}")
            valid = batch.where(F.col("reject_reason").isNull())
            out = screen_requests(valid, products, stores, excluded, categories)
            out.write.mode("overwrite").parquet(f"{result_dir}/epoch={epoch_id}")
        finally:
            remove(spark, held)

    writer = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
