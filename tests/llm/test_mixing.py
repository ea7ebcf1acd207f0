import hashlib
import math
from collections import Counter

import pytest
from texts import clashing, frame, rows
from voxframe.llm import mixing


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def inverse(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while u >= c and k < 10_000:
        k += 1
        p *= mean / k
        c += p
    return k


def expected(data, weights=None, epochs=1.0, seed=mixing.SEED):
    size, rate = Counter(), {}
    for _, text, source in data:
        size[source] += len(text or "")
    w = {s: n**mixing.TEMPERATURE if weights is None else weights.get(s, 0.0) for s, n in size.items()}
    total = sum(w[s] for s in w if size[s])
    out = Counter()
    for doc_id, text, source in data:
        rate = epochs * sum(size.values()) * w[source] / total / size[source] if size[source] else epochs
        name = str(doc_id) if doc_id is not None else hashlib.md5((text or "").encode()).hexdigest()
        pieces = max(1, math.ceil(rate / mixing.PIECE))
        n = sum(inverse(uniform(seed, name, str(j)), rate / pieces) for j in range(1, pieces + 1))
        out[doc_id, text] += n
    return +out


@pytest.mark.parametrize(("weights", "epochs"), [(None, 1.0), ({"src0": 5.0, "src1": 1.0}, 3.0), (None, 90.0)])
def test_counts(spark, weights, epochs):
    out = mixing.mixed(clashing(spark), weights, epochs).collect()
    assert Counter((r.doc_id, r.text) for r in out) == expected([(r[0], r[1], r[3]) for r in rows()], weights, epochs)
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)


def test_columns_and_empty(spark):
    df = clashing(spark)
    assert mixing.mixed_documents(df).columns == df.columns
    assert mixing.mixed(frame(spark, [])).collect() == []


def test_shares_reach_their_targets(spark):
    data = [(i, "x" * 100, "big" if i % 10 else "small", "", 0) for i in range(20_000)]
    out = mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars int"), {"big": 0.5, "small": 0.5})
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for n in got.values():
        assert abs(n - 10_000) < 5 * math.sqrt(10_000 * 5)  # a Poisson sum


def test_native(spark):
    plan = mixing.mixed(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
