"""k-means of all recordings at once against the one of a single task."""

import numpy as np
import pytest
from voxframe.operators import clusters, kmeans

KIND = "recording_id long, vec_id long, embedding array<double>, weight double"


def cost(x, w, labels):
    out = 0.0
    for c in set(labels.tolist()):
        v = (x[labels == c] * np.maximum(0.001, w[labels == c])[:, None]).sum(axis=0)
        out += ((1 - x[labels == c] @ (v / np.linalg.norm(v))) * w[labels == c]).sum()
    return out


def rows_of(rng, recordings):
    return [(r, 100_000 * r + i, (np.eye(16)[i % k * 3] + noise * rng.normal(size=16)).tolist(), float(rng.uniform(0.2, 1))) for r, n, k, noise in recordings for i in range(n)]


def test_same_clusters_as_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = rows_of(rng, [(1, 1, 1, 0.1), (2, 2, 2, 0.1), (3, 90, 3, 0.1), (4, 70, 2, 0.05), (5, 60, 4, 0.3), (6, 5, 1, 0.02)])
    rows += [(3, 900_000 + i, rows[5][2], 1.0) for i in range(9)] + [(4, 900_100, None, 1.0), (4, 900_101, [0.0] * 16, 1.0)]
    df = spark.createDataFrame(rows, KIND)
    want = clusters.speakers(df).toPandas().sort_values(["recording_id", "vec_id"]).reset_index(drop=True)
    got = kmeans.speakers(df.repartition(5)).toPandas().sort_values(["recording_id", "vec_id"]).reset_index(drop=True)
    assert got[["recording_id", "vec_id", "k_nme"]].values.tolist() == want[["recording_id", "vec_id", "k_nme"]].values.tolist()
    for r in (1, 2, 3, 4, 6):
        assert got[got.recording_id == r].values.tolist() == want[want.recording_id == r].values.tolist(), r
    # Where several groupings are all but as good, the cost is not above.
    x, w = {}, {}
    for r, i, e, weight in rows:
        if e and any(e):
            x[i], w[i] = np.array(e) / np.linalg.norm(e), weight
    for r in (3, 4, 5):
        a, b = (f[f.recording_id == r] for f in (got, want))
        if a["k"].iloc[0] == b["k"].iloc[0]:
            of = lambda f: cost(np.stack([x[i] for i in f["vec_id"]]), np.array([w[i] for i in f["vec_id"]]), f["label"].to_numpy())
            assert of(a) <= of(b) * 1.001


def test_empty(spark):
    assert kmeans.speakers(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("salt", [0, 3])
def test_draws_are_uniform(salt):
    u = kmeans._uniform(np.arange(20_000), salt)
    assert abs(u.mean() - 0.5) < 0.01 and 0 <= u.min() and u.max() < 1 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.03
