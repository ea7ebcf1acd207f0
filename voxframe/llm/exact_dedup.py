"""Exact deduplication by a stateful streaming query.

A feed of (digest, size, stable identifier, content locator) goes through a Structured Streaming aggregation keyed
by digest. Its state lies on disk (RocksDB) and never expires: for each digest it retains the identifier and the
locator of the row to keep, and how many rows were seen. A digest seen more than once is a hit; for hits the full
contents are read again by locator and compared byte for byte, and rows whose digest collides with another content
are grouped by their content itself.

A locator is the file and row in which a content lies. Only what is read straight from files has one for each row, so
other frames (an explode repeats locators, a join has none) are written to the shared folder first; a caller that has
just read its files says stored=True. With `state` given, contents, feed and state stay in that folder, and a later
call continues from them: its answer covers all rows that were ever given.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal rows the one with the
most code points in its original text stays, then the smallest doc_id, then the first locator.

Defined cases: a null text counts as empty, and all empty texts are equal; a null doc_id ranks after every other;
rows repeated with one doc_id are separate rows of which one stays; an empty table gives an empty result; columns
other than doc_id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.shared import publish, remove, scratch

WHITE_SPACE = r"[\x20\x09-\x0D]"
LOCATOR = ("at_file", "at_row")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def rank(points: Column) -> Column:
    """The least is kept."""
    return F.struct((-points).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)


def located(docs: DataFrame) -> DataFrame:
    """Each row of docs as a struct, with the file and row in which it lies. docs is a scan of files."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, F.col("_metadata.file_path").alias(LOCATOR[0]), F.col("_metadata.row_index").alias(LOCATOR[1]))


def retained(spark: SparkSession, feed_path: str, state_path: str, bytes_per_trigger: int = 1 << 29) -> DataFrame:
    """Run the stream over all feed files that its checkpoint hasn't seen; one row per digest: digest, best, n_rows.

    Calling it again with the same state_path after more feed files were added continues from the kept state.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Each store would set aside some MB of disk for its logs, which counts where there are many small stores.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    schema = spark.read.parquet(feed_path).schema
    keyed = session.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(feed_path).groupBy("digest").agg(F.min(rank(F.col("n_points"))).alias("best"), F.count(F.lit(1)).alias("n_rows"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state_path}/updates/batch={number}")

    query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    kind = keyed.schema.add("batch", "integer")
    updates = spark.read.schema(kind).parquet(f"{state_path}/updates/batch=*")
    if query.lastProgress is not None and query.lastProgress["batchId"] == 0:
        return updates.drop("batch")
    return updates.groupBy("digest").agg(F.max_by(F.struct("best", "n_rows"), "batch").alias("last")).select("digest", "last.best", "last.n_rows")


def deduplicate(source: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """source: what located() gives. Per row: doc_id, keep_id, group_size, kept, sha and its locator.

    digest is a parameter so that tests can force collisions. state: a folder that keeps feed and state for later
    calls; then fresh holds the rows of source that it hasn't seen.
    """
    spark = source.sparkSession
    work, out_path = scratch(spark, "exact"), scratch(spark, "exact-out")
    held = state or work

    def opened(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("row.doc_id").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), *LOCATOR)

    source = opened(source)
    norm = normalised(F.col("text"))
    new = opened(fresh) if fresh is not None else source
    new = new.select(digest(norm).alias("digest"), sha256(norm).alias("sha"), F.length("text").alias("n_points"), "doc_id", *LOCATOR)
    new.write.mode("append").option("compression", "zstd").parquet(f"{held}/feed")
    feed = spark.read.schema(new.schema).parquet(f"{held}/feed")
    stays = (F.col("best.at_file") == F.col("at_file")) & (F.col("best.at_row") == F.col("at_row"))
    kept = retained(spark, f"{held}/feed", f"{held}/state")
    joined = publish(feed.join(kept, "digest").select("digest", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n_rows").alias("group_size"), stays.alias("kept"), "sha", *LOCATOR), f"{work}/joined")

    hits = joined.filter("group_size > 1").select("digest", *LOCATOR)
    contents = source.select("text", *LOCATOR).join(hits, list(LOCATOR)).select("digest", normalised(F.col("text")).alias("norm"))
    unlike = publish(contents.distinct().groupBy("digest").count().filter("count > 1").select("digest"), f"{work}/unlike")
    result = joined.drop("digest")
    if not unlike.isEmpty():
        rows = source.join(joined.join(unlike, "digest", "left_semi").select("sha", *LOCATOR), list(LOCATOR)).withColumn("norm", normalised(F.col("text")))
        groups = rows.groupBy("norm").agg(F.min(rank(F.length("text"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        again = rows.join(groups, "norm").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "sha", *LOCATOR)
        result = joined.join(unlike, "digest", "left_anti").drop("digest").unionByName(again)
    out = publish(result, out_path)
    remove(spark, work)
    return out


REPORT = ("doc_id", "keep_id", "group_size", "kept")


def report(docs: DataFrame, digest: Callable[[Column], Column] = sha256, stored: bool = False, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, or of all docs given with this state."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    if state:
        path = f"{state}/content/{uuid.uuid4().hex}"
        fresh = located(publish(docs, path))
        return deduplicate(located(spark.read.schema(docs.schema).parquet(f"{state}/content/*")), digest, state, fresh).select(*REPORT, sha)
    if stored:
        return deduplicate(located(docs), digest).select(*REPORT, sha)
    path = scratch(spark, "content")
    out = deduplicate(located(publish(docs, path)), digest).select(*REPORT, sha)
    remove(spark, path)
    return out


def survivors(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    source = located(docs if stored else publish(docs, scratch(docs.sparkSession, "content")))
    gone = deduplicate(source).filter("not kept").select(*LOCATOR)
    return source.join(gone, list(LOCATOR), "left_anti").select("row.*")
