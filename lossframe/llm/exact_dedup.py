"""Exact de-duplication with keyed streaming state.

Texts are equal when they are identical after each run of white space
``[\\x20\\x09-\\x0D]+`` became one space; a null text counts as empty.

1. The documents are written once as a content store: a row id (the content
   locator), a SHA-256 digest of the normalised text and all given columns.
2. A Structured Streaming query reads (digest, doc_id, row id) from the store.
   Its keyed state, kept on disk by RocksDB and without expiry, holds for
   each digest the stable identifier and locator of the row that stays and
   the number of rows seen. Each micro-batch appends the changed keys to a
   log, in a folder of its own that a repeated batch overwrites.
3. Each hit is checked on its full bytes against the row that stays, found
   by its locator. Rows that differ from it (digests that collide) are grouped
   by their texts instead.

Cases: a null doc_id counts as larger than any other; of repeated rows with
one doc_id the one with the smallest row id stays; an empty table gives no
rows; given columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lossframe.llm.common import scratch, small_side, written

#: Copies of one text that one task compares with the text that stays.
ROWS_PER_SALT = 2_000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk reserved ahead
}


def normalised(text: Column) -> Column:
    """Runs of white space as one space; only runs that change are replaced."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def content_store(docs: DataFrame, digest_chars: int = 64) -> DataFrame:
    """The written documents as (row_id, digest, key, doc): ``doc`` holds the given columns."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.sha2(normalised(F.col("text")), 256).alias("sha256"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    )
    return written(rows.withColumn("digest", F.substring("sha256", 1, digest_chars)), "dedup-store")


def keyed_state(store: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over the store: (digest, keep_id, keep_row, n), one row for each digest."""
    spark = store.sparkSession
    at = scratch(spark, "dedup-stream")
    index = f"{at}/index"
    store.select("digest", F.col("doc.doc_id").alias("doc_id"), "row_id").write.parquet(index)
    reader = spark.readStream.schema(spark.read.parquet(index).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    seen = reader.parquet(index).groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("keep"), F.count("*").alias("n"))

    def log(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{at}/log/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (seen.writeStream.outputMode("update").foreachBatch(log)
                 .option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = seen.schema.add("batch", "long")
    latest = (spark.read.schema(schema).parquet(f"{at}/log")
              .groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("s")))
    return written(latest.select("digest", F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.row_id").alias("keep_row"),
                                 F.col("s.n").alias("n")), "dedup-keys")


def assign(store: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """(row_id, doc_id, keep_id, keep_row, group_size, sha256) of every row, hits checked byte by byte."""
    keys = keyed_state(store, max_files_per_trigger)
    ids = store.select("row_id", F.col("doc.doc_id").alias("doc_id"), "digest", "sha256")
    found = written(ids.join(keys, "digest"), "dedup-found")
    hits = written(found.filter("n > 1").select(
        "row_id", "keep_row", F.expr(f"cast(ceil(n / {ROWS_PER_SALT}) as int)").alias("salts")), "dedup-hits")
    text = store.select("row_id", normalised(F.col("doc.text")).alias("text"))
    full = hits.join(text, "row_id") if (rows := hits.count()) > 1_000_000 else text.join(small_side(hits, rows), "row_id")
    first = full.filter("row_id = keep_row").select("keep_row", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                    F.col("text").alias("first_text"))
    rest = full.filter("row_id <> keep_row").withColumn("salt", F.pmod("row_id", F.col("salts")).cast("int"))
    other = written(rest.join(first, ["keep_row", "salt"]).filter("text <> first_text").select("row_id", "keep_row", "text"), "dedup-other")
    if other.isEmpty():
        return found.select("row_id", "doc_id", "keep_id", "keep_row", F.col("n").alias("group_size"), "sha256")
    # Digests that collide: these rows are grouped by their texts, and leave the group of their digest.
    own = other.join(ids, "row_id").groupBy("digest", "text").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("k"), F.count("*").alias("own_n"))
    own = other.join(ids.select("row_id", "digest"), "row_id").join(own, ["digest", "text"]).select(
        "row_id", F.col("k.doc_id").alias("own_id"), F.col("k.row_id").alias("own_row"), "own_n")
    left = other.groupBy("keep_row").agg(F.count("*").alias("gone"))
    return (found.join(written(own, "dedup-own"), "row_id", "left").join(left, "keep_row", "left").select(
        "row_id", "doc_id",
        F.when(F.col("own_row").isNull(), F.col("keep_id")).otherwise(F.col("own_id")).alias("keep_id"),
        F.coalesce("own_row", "keep_row").alias("keep_row"),
        F.when(F.col("own_row").isNull(), F.col("n") - F.coalesce("gone", F.lit(0))).otherwise(F.col("own_n")).alias("group_size"),
        "sha256"))


def duplicates(docs: DataFrame, max_files_per_trigger: int | None = None, digest_chars: int = 64) -> DataFrame:
    """One row for each given row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = assign(content_store(docs, digest_chars), max_files_per_trigger)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                       F.col("sha256").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The given rows without later copies, columns as given."""
    store = content_store(docs)
    gone = written(assign(store).filter("row_id <> keep_row").select("row_id"), "dedup-gone")
    left = store.join(small_side(gone, gone.count()), "row_id", "left_anti")
    return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
