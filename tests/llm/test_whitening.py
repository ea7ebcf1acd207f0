import numpy as np
import pytest
from voxframe.llm import whitening as w

KIND = "vec_id long, embedding array<float>, label int"


def frame(spark, data):
    return spark.createDataFrame([(k, v, 0) for k, v in data], KIND)


def plainly(data, count=w.COMPONENTS):
    """x, and by row: deviation; per component: explained and whitened up to its sign, by a dense eigensolver."""
    good = [(k, v) for k, v in data if v and None not in v and np.isfinite(v).all()]
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in np.array(v, np.float32)] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, z = np.linalg.eigh(centred.T @ centred / n)
    values, z = values[::-1], z[:, ::-1]
    k = min(count, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    off = np.array(x, object) * n - sums
    return n, [k for k, _ in good], [int((o * o).sum()) for o in off], (off / n).astype(float) @ (z[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


def check(got, data, tolerance=1e-8):
    n, ids, deviation, y, explained = plainly(data)
    k = len(explained)
    assert len(got) == len(ids) * k and {r.n for r in got} <= {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error <= 1e-9
    by = {}
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
        by.setdefault(r.component, []).append((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened))
    for c in range(k):
        mine = sorted(by[c + 1])
        for sign in (1, -1):
            want = sorted((i is None, i or 0, d, sign * v) for i, d, v in zip(ids, deviation, y[:, c], strict=True))
            if all(a[:3] == b[:3] and abs(a[3] - b[3]) < tolerance for a, b in zip(mine, want, strict=True)):
                break
        else:
            raise AssertionError(c)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(w.report(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_hard_cases(spark):
    rng = np.random.default_rng(2)
    data = [(k, [float(np.float32(c)) for c in rng.standard_normal(5)]) for k in range(40)]
    data += [data[3], (None, data[4][1]), (90, data[4][1])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [float("nan")] * 5), (54, [1.0, 2.0, float("inf"), 0.0, 0.0]), (55, [1.0] * 4), (56, [1.0] * 6)]
    df = frame(spark, data + bad).selectExpr("*", "'a' as x", "1 as component", "2 as n", "3 as place", "'r' as part", "4 as deviation")
    check(w.report(df).collect(), data)


def test_nothing_to_fit(spark):
    for data in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        df = w.report(frame(spark, data))
        assert df.collect() == [] and [c for c, _ in df.dtypes] == [c.split()[0] for c in w.RESULT.split(", ")]


def test_fewer_vectors_than_dimensions_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    data = [(k, [*(float(np.float32(c)) for c in rng.standard_normal(6)), 7.0, 7.0]) for k in range(4)]
    got = w.report(frame(spark, data)).collect()
    check(got, data)
    assert {r.component for r in got} == {1, 2, 3}


def test_many_partitions_and_repeated_vectors(spark):
    rng = np.random.default_rng(6)
    data = [(k, [float(np.float32(c)) for c in rng.standard_normal(4) * (9, 5, 2, 1)]) for k in range(300)]
    data += [(1000 + k, data[0][1]) for k in range(200)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        got = w.report(frame(spark, data).repartition(40)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    check(got, data)


def test_large_entries_are_exact(spark):
    data = [(0, [2.0**50, 1.0]), (1, [2.0**51, 2.0]), (2, [3.0, 5.0]), (3, [2.0**60, 0.0])]
    got = w.whitened(frame(spark, data)).collect()
    n, ids, deviation, *_ = plainly(data[:3])
    assert {(r.vec_id, int(r.deviation)) for r in got} == set(zip(ids, deviation, strict=True)) and {r.n for r in got} == {n}


def test_memory_of_a_block(monkeypatch, spark):
    monkeypatch.setattr(w, "BLOCK", 7)
    rng = np.random.default_rng(8)
    data = [(k, [float(np.float32(c)) for c in rng.standard_normal(3)]) for k in range(100)]
    check(w.report(frame(spark, data)).collect(), data)


@pytest.mark.parametrize("name", ["normal", "wide", "zero column", "same columns", "multiples", "graded", "cluster", "one", "diagonal"])
def test_solver(name):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((90, 30))
    q, p = np.linalg.qr(rng.standard_normal((90, 30)))[0], np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = {
        "normal": a, "wide": a[:20], "zero column": a * (np.arange(30) != 4), "same columns": a[:, [*range(29), 0]], "multiples": q @ np.diag([5.0] * 10 + [1.0] * 20) @ p,
        "graded": q @ np.diag(10.0 ** -np.arange(30)), "cluster": q @ np.diag([1 + 1e-9 * k for k in range(30)]) @ p, "one": a[:, :1], "diagonal": np.diag(np.arange(1.0, 9)),
    }[name]
    r = np.linalg.qr(a, mode="r")
    z, squares, total = w.directions(r)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(squares / want[: len(squares)] - 1).max() < 1e-12 and abs(total / want.sum() - 1) < 1e-13
    assert len(squares) == min(16, (want > 1e-26 * want[0]).sum())
    assert np.abs(z.T @ z - np.eye(len(squares))).max() < 1e-11
    assert np.abs(a.T @ (a @ z) - z * squares).max() < 1e-13 * want[0] * 100


def test_small_values_keep_their_relative_accuracy():
    a, b = 10.0 ** -np.arange(12.0), 0.3 * 10.0 ** -np.arange(11.0)
    want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)
    got = np.sqrt(w.squared_values(a, b))
    assert np.abs(got[:8] / want[:8] - 1).max() < 1e-9
    assert np.prod(got) == pytest.approx(np.prod(a), rel=1e-12)
