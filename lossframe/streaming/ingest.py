"""Incremental ingest of report files dropped into a folder.

Uploaded report files arrive over time. A Structured Streaming file source
picks up new files of one header layout, maps their headers onto the
standard fields (same alias rules as the batch sources), and appends them
to the raw report table in ``foreachBatch``. Each micro-batch is written
(overwrite) into its own ``_batch=<id>`` folder, so a batch replayed after
a failure replaces its own output instead of appending it twice; with the
stream's checkpoint every file lands exactly once. Input order is the struct
``_seq`` = (batch, path, block start, row id), without limits. A file whose
header is not the stream's layout is not mapped by position: its rows go, as
they are, to the table ``<table_path>_rejected``.

Cleaning is not streamed: per-type quartiles, the reported-metric set and
keep-first de-duplication depend on the whole table, so ``clean`` runs as a
batch job over the appended table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DEFAULT_CATALOG, Catalog
from ..operators.clean import to_standard
from ..session import materialize, scratch_path
from ..sources.delimited import input_order
from ..sources.headers import map_columns


def layout_mapping(spark: SparkSession, headers: list[str], catalog: Catalog = DEFAULT_CATALOG) -> dict[int, str]:
    """Column position → standard field for one header layout."""
    hd = spark.createDataFrame([("layout", i, h) for i, h in enumerate(headers)], "source string, pos int, header string")
    rows = map_columns(hd, catalog).where(F.col("status") == "matched").collect()  # one row per column
    return {r["pos"]: r["target"] for r in rows}


def ingest_stream(spark: SparkSession, source_dir: str, headers: list[str], table_path: str,
                  catalog: Catalog = DEFAULT_CATALOG, checkpoint: str | None = None,
                  available_now: bool = False, max_files_per_trigger: int | None = None, whole_files: bool = False):
    """Start the stream; returns the ``StreamingQuery``.

    ``headers`` is the layout of the files in ``source_dir`` (a streaming
    source needs a fixed schema). ``available_now=True`` processes what is
    there and stops (batch-like catch-up). ``whole_files=True`` reads each file
    as one piece, for files whose quoted cells hold line breaks.
    """
    mapping = layout_mapping(spark, headers, catalog)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
    reader = spark.readStream.schema(schema).option("header", False).option("quote", '"').option("escape", '"').option("multiLine", whole_files)
    reader = reader.option("maxFilesPerTrigger", max_files_per_trigger or 1000)
    fields = [f"c{i}" for i in range(len(headers))]
    stream = reader.csv(source_dir).select(*fields, "_metadata")

    def append(batch: DataFrame, batch_id: int) -> None:
        # the header line arrives as the first row of each file
        batch = materialize(batch.select(*fields, input_order().alias("_at"), F.col("_metadata.file_name").alias("_source_file")), "ingest-batch")
        is_header = (F.col("_at.block") == 0) & (F.col("_at.row") == F.col("first"))
        first = batch.where(F.col("_at.block") == 0).groupBy(F.col("_at.path").alias("_path")).agg(F.min("_at.row").alias("first"))
        rows = batch.withColumn("_path", F.col("_at.path")).join(first, "_path")
        same = F.lit(True)
        for c, h in zip(fields, headers):
            same = same & (F.regexp_replace(F.col(c), "^\ufeff", "") == F.lit(h))
        known = rows.where(is_header & same).select("_path")
        bad = rows.join(known, "_path", "left_anti").select(*fields, F.col("_at.path").alias("path"), F.col("_at.row").alias("row"))
        bad.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}_rejected/_batch={batch_id}")
        out = (rows.where(~F.coalesce(is_header, F.lit(False))).join(known, "_path", "left_semi")
               .select(*[F.col(f"c{i}").alias(t) for i, t in sorted(mapping.items())], "_source_file",
                       F.regexp_replace(F.col("_source_file"), r"\.[^.]*$", "").alias("_source_sheet"),
                       F.struct(F.lit(batch_id).cast("long").alias("batch"), "_at.*").alias("_seq")))
        # idempotent: a replayed batch overwrites its own folder
        to_standard(out, catalog, seq_col="_seq").write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/_batch={batch_id}")

    writer = stream.writeStream.foreachBatch(append).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "ingest-stream-ckpt"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
