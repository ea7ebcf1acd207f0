"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its share of the target size over its present size. Each document is repeated as often
as a Poisson variable of that mean, found by inverting the distribution at a number drawn from a hash of seed and
doc_id; so counts need no state, are the same on every run, and differ between seeds. Copies are shuffled globally
by sorting on a hash of (seed, doc_id, copy). Everything is DataFrame functions.

Sizes are code points of texts. Without given weights a source weighs its size to the power TEMPERATURE. The target
size is `epochs` times the present size. Means above PIECE are drawn as a sum of equal parts, each with its own hash,
so that exp() can't underflow; the sum has the same distribution.

Defined cases: a null source is a source of its own; a source that weights don't name, or of weight 0, is left out; a
source without any text has rate `epochs`; a null text has size 0; a null doc_id is drawn by its text; rows repeated
with one doc_id get the same count; an empty table gives an empty result; no other column's name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.shared import publish, scratch

TEMPERATURE, SEED, PIECE = 0.7, "mix-1", 32.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose cumulative probability exceeds u, for a mean of at most PIECE."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.when(u < a["c"], a).otherwise(F.struct(p.alias("p"), (a["c"] + p).alias("c"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, size, n_docs, rate."""
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        sizes = sizes.withColumn("weight", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0))
    weight = F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)
    share = F.col("weight") / sizes.agg(F.sum(weight)).scalar()
    rate = F.when(F.col("size") > 0, F.lit(epochs) * sizes.agg(F.sum("size")).scalar() * share / F.col("size")).otherwise(F.lit(float(epochs)))
    return sizes.select("source", "size", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def shuffled(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """row (a struct of all columns of docs), copy, n_copies, shuffle_key: every document as often as drawn, shuffled."""
    spark = docs.sparkSession
    # Written first, so that the plan knows its size: Spark broadcasts it if it is small, and splits hot sources if not.
    table = publish(rates(docs.select("source", "text"), weights, epochs).select(F.col("source").alias("of_source"), "rate"), scratch(spark, "rates"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).join(table, F.col("row.source").eqNullSafe(F.col("of_source")))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit(""))))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE).cast("int"))
    one = poisson(uniform(F.lit(seed), name, F.lit("1")), F.col("rate"))
    many = F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda n, j: n + poisson(uniform(F.lit(seed), name, j.cast("string")), F.col("rate") / pieces))
    rows = rows.withColumn("n_copies", F.when(F.col("rate") <= PIECE, one).otherwise(many).cast("int")).filter("n_copies > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col("copy").cast("string"))), 1, 16)
    return copies.select("row", "copy", "n_copies", key.alias("shuffle_key")).orderBy("shuffle_key", "row.doc_id", "copy")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """shuffled() with the columns of docs apart; copy, n_copies and shuffle_key replace columns of such names."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    return shuffled(docs, weights, epochs, seed).select(*own, "copy", "n_copies", "shuffle_key")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """shuffled() with the columns of docs only."""
    return shuffled(docs, weights, epochs, seed).select("row.*")
