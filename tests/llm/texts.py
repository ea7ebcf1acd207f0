"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta " * 60_000 + "\n" + "x" * 70_000
BASE = " ".join(f"word{i}" for i in range(120))


def rows():
    near = BASE.replace("word60", "other")
    texts = [BASE, near, BASE.upper(), BASE + " ", None, "", " \t\n", "single", "Single", "one two", "two one", "one  two", LONG, "été à la plage \U0001f600", "a" * 50, near]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i != 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[0], out[4], (None, "no id here at all", "en", "src1", 17), (None, BASE, None, None, 0)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, KIND)


def clashing(spark):
    """Names that operators use inside, as extra columns."""
    df = frame(spark)
    for name in ("at_file", "row", "node", "digest", "copy", "rate", "score", "bucket", "shuffle_key", "component_id", "_metadata_", "batch"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df
