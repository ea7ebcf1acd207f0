"""Operators on intervals [start_ms, end_ms) of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.timelines import WINDOWS, Windows

KEY = "recording_id"


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def by_time(*order: str, partition: tuple = (KEY,)) -> Window:
    return Window.partitionBy(*partition).orderBy(*(order or ("start_ms", "input_index")))


def with_islands(df: DataFrame, gap: int, order: tuple = ("start_ms", "input_index"), partition: tuple = (KEY,), inclusive: bool = False, by: Windows = WINDOWS) -> DataFrame:
    """Adds `reach` (the end reached before the row) and `island` (0-based): a new one starts where start exceeds reach + gap.

    inclusive: touching intervals are parted too. by: how running values are found; Blocks() for recordings of any length.
    """
    rows = by.running(by.deal(df, order, partition), "reach", F.col("end_ms"), "max", order, partition, before=True)
    over = F.col("start_ms") - F.col("reach")
    new = (over >= gap if inclusive else over > gap).cast("int")
    return by.running(rows, "island", F.coalesce(new, F.lit(0)), "sum", order, partition)


def union(df: DataFrame, partition: tuple = (KEY,), by: Windows = WINDOWS) -> DataFrame:
    """Touching or overlapping intervals merged: one row per stretch."""
    return with_islands(df, 0, ("start_ms", "end_ms"), partition, by=by).groupBy(*partition, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int = 60_000, how: str = "inner", key: str = KEY) -> DataFrame:
    """Pairs of overlapping intervals of one recording. Both sides are dealt to time buckets, which join the key, so that
    a long recording isn't one task; a pair is kept only in the bucket where its later start lies.

    left and right must have start_ms, end_ms; right's columns must be named unlike left's but for the key and these
    two, which come back as right_start_ms, right_end_ms. how: inner, left_semi or left_anti.
    """

    def dealt(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("start_ms"), F.col("end_ms") - 1)
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(last / bucket_ms))))

    r = dealt(right).withColumnRenamed("start_ms", "right_start_ms").withColumnRenamed("end_ms", "right_end_ms")
    meets = (F.col("right_start_ms") < F.col("end_ms")) & (F.col("right_end_ms") > F.col("start_ms"))
    l = dealt(left)
    pairs = l.join(r.withColumnRenamed(key, "right_key").withColumnRenamed("bucket", "right_bucket"), (F.col(key) == F.col("right_key")) & (F.col("bucket") == F.col("right_bucket")) & meets)
    if how == "inner":
        return pairs.filter(F.col("bucket") == F.floor(F.greatest("start_ms", "right_start_ms") / bucket_ms)).drop("bucket", "right_bucket", "right_key")
    marks = pairs.select(key, "start_ms", "end_ms").distinct()
    return left.join(marks, [key, "start_ms", "end_ms"], how)


#: Leaves in the largest node of scaled_join: 2 to this power.
TOP = 6


def scaled(df: DataFrame, leaf_ms: int, levels: list[int] | None = None) -> DataFrame:
    """Adds _level, _node and _own: an interval is dealt to the nodes that it meets at its own level, that of the smallest nodes of
    1, 2, 4, ... 2**TOP leaves as long as it is (so to two at most, unless it is longer than all nodes), and at those of the
    given levels that are higher."""
    first, last = F.floor(F.col("start_ms") / leaf_ms), F.floor(F.greatest(F.col("start_ms"), F.col("end_ms") - 1) / leaf_ms)
    own = F.least(F.lit(TOP), F.ceil(F.log2(F.greatest(F.lit(1), F.ceil((F.col("end_ms") - F.col("start_ms")) / leaf_ms))))).cast("int")
    rows = df.withColumns({"_first": first, "_last": last, "_mine": own})
    higher = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k > F.col("_mine")) if levels else F.array().cast("array<int>")
    rows = rows.withColumn("_level", F.explode(F.concat(F.array("_mine"), higher)))
    node = F.explode(F.sequence(F.expr("shiftright(_first, _level)"), F.expr("shiftright(_last, _level)")))
    return rows.withColumn("_node", node).withColumn("_own", F.col("_level") == F.col("_mine")).drop("_first", "_last", "_mine")


def _levels(df: DataFrame, leaf_ms: int) -> list[int]:
    return sorted(r[0] for r in scaled(df.select("start_ms", "end_ms"), leaf_ms).select("_level").distinct().collect())


def scaled_join(left: DataFrame, right: DataFrame, leaf_ms: int = 1000, how: str = "inner", key: str = KEY, levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """overlap_join for intervals of very unlike lengths: pairs meet at the level of the longer one, so intervals of days aren't
    dealt to the buckets of the milliseconds that they are joined with, nor those compared with each other.

    levels: those that occur on either side, where they are known; else they are looked up first.
    """
    mine, theirs = levels or (_levels(left, leaf_ms), _levels(right, leaf_ms))
    r = scaled(right, leaf_ms, mine).withColumnRenamed("start_ms", "right_start_ms").withColumnRenamed("end_ms", "right_end_ms").withColumnRenamed(key, "right_key")
    # Side 0: left at its own level, right at its own or a higher one; side 1: right at its own, left at a higher one.
    side = lambda own, raised: F.explode(F.array_compact(F.array(F.when(own, 0), F.when(raised, 1))))
    l = scaled(left, leaf_ms, theirs).withColumn("_side", side(F.col("_own"), ~F.col("_own"))).drop("_own")
    r = r.withColumn("_side", side(F.lit(True), F.col("_own"))).drop("_own").withColumnsRenamed({c: f"{c}_right" for c in ("_level", "_node", "_side")})
    meets = (F.col("right_start_ms") < F.col("end_ms")) & (F.col("right_end_ms") > F.col("start_ms"))
    same = (F.col(key) == F.col("right_key")) & (F.col("_level") == F.col("_level_right")) & (F.col("_node") == F.col("_node_right")) & (F.col("_side") == F.col("_side_right"))
    pairs = l.join(r, same & meets)
    if how == "inner":
        later = F.floor(F.greatest("start_ms", "right_start_ms") / leaf_ms)
        once = pairs.withColumn("_later", later).filter(F.expr("shiftright(_later, _level)") == F.col("_node"))
        return once.drop("_later", "_level", "_node", "_side", "_level_right", "_node_right", "_side_right", "right_key")
    return left.join(pairs.select(key, "start_ms", "end_ms").distinct(), [key, "start_ms", "end_ms"], how)


def framed(df: DataFrame, step: int, start: Column, end: Column) -> DataFrame:
    """A row per frame of `step` from start to end: frame_start, frame_center."""
    rows = df.filter(end > start).withColumn("frame_start", F.explode(F.sequence(start, end - 1, F.lit(step).cast("long"))))
    return rows.withColumn("frame_center", F.col("frame_start") + step // 2)


def sweep(df: DataFrame) -> DataFrame:
    """Per recording, whether two different speakers overlap: by start, end and speaker, a start before the latest end so far, whose speaker differs."""
    w = by_time("start_ms", "end_ms", "speaker").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("latest", F.max("end_ms").over(w)).withColumn("latest_speaker", F.max_by("speaker", "end_ms").over(w))
    hit = (F.col("start_ms") < F.col("latest")) & (F.col("speaker") != F.col("latest_speaker"))
    return rows.groupBy(KEY).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_overlap"))


def sliding(df: DataFrame, chunk: int, hop: int, duration: Column) -> DataFrame:
    """Inference windows over each interval: cores of `hop`, each read with half a hop before it and `chunk` long.

    The last reading moves left so as to end with the recording.
    """
    rows = df.filter("end_ms > start_ms").withColumn("core_start", F.explode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(hop).cast("long"))))
    rows = rows.withColumn("core_end", F.least(F.col("end_ms"), F.col("core_start") + hop))
    first = F.greatest(F.lit(0), F.col("core_start") - hop // 2)
    rows = rows.withColumn("read_end", F.least(duration, first + chunk))
    moved = F.when((F.col("read_end") - first < chunk) & (F.col("read_end") == duration), F.greatest(F.lit(0), F.col("read_end") - chunk)).otherwise(first)
    return rows.withColumn("read_start", moved)
