from collections import Counter

import numpy as np
import pytest
from texts import BASE, clashing, frame, rows
from voxframe.llm import near_dedup


def brute(data, width=2, percent=80):
    """doc_id -> (set size, component), by all pairs that share a shingle."""
    sets = {}
    for doc_id, text in data:
        w = (text or "").encode().translate(near_dedup.LOWER).split()
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = {}
    for i in sorted(sets):
        shared = Counter(k for s in sets[i] for k in having.get(s, ()))
        for k, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[k]) - n):
                a, b = top(i), top(k)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_hard_cases(spark):
    data = [(r[0], r[1]) for r in rows() if r[0] is not None]
    out = near_dedup.near_duplicates(clashing(spark), width=2).collect()
    assert len(out) == len(rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)


def test_empty(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_survivors_keep_columns(spark):
    df = clashing(spark)
    kept = near_dedup.survivors(df)
    assert kept.columns == df.columns
    assert {0, 4, 5, 6} <= {r.doc_id for r in kept.collect()} and 1 not in {r.doc_id for r in kept.collect()}


def test_chains_and_stars(spark):
    """Texts near the threshold: linked in chains, around centres, and not at all."""
    rng = np.random.default_rng(3)
    data, n = [], 0
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(60)]
        for k in range(12):
            words = list(base)
            for i in rng.choice(60, size=int(rng.integers(0, 6)), replace=False):
                words[i] = f"g{group}x{rng.integers(1000)}"
            if k % 4 == 0:
                base = words  # the chain drifts
            data.append((n, " ".join(words)))
            n += 1
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert answer(near_dedup.near_duplicates(df, width=2)) == brute(data)


@pytest.mark.parametrize("table", ["documents"])
def test_documents(spark, table):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    data = [(r.doc_id, r.text) for r in df.collect()]
    assert answer(near_dedup.near_duplicates(df, width=2)) == brute(data)


def template(n, own, sizes=(0,)):
    """Documents of one template with `own` words each (more by turns of `sizes`), and a few that are nearly alike."""
    shared = " ".join(f"t{i}" for i in range(170))
    data = [(k, shared + " " + " ".join(f"o{k}x{j}" for j in range(own + sizes[k % len(sizes)]))) for k in range(n)]
    return data + [(n + k, data[k][1] + f" more{k}") for k in range(0, n, 7)]


@pytest.mark.parametrize("own,sizes", [(24, (0,)), (23, (0, 9, 20, 31)), (12, (0, 12, 30))])
def test_templates_that_share_buckets(spark, own, sizes):
    """Too unlike to be linked, or just not: what no centre settles is joined exactly."""
    data = template(70, own, sizes)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for width in (1, 2):
        assert answer(near_dedup.near_duplicates(df, width=width)) == brute(data, width=width)


def test_exact_candidates_lose_no_link(spark, tmp_path, monkeypatch):
    """Every linked pair is a candidate, with hot shingles split; a template's documents are not."""
    monkeypatch.setattr(near_dedup, "HOT", 5)
    data = template(60, 22, (0, 2, 4, 8, 16, 32))
    made = spark.createDataFrame([(i, i, near_dedup.shingles(t, 1).tobytes()) for i, t in data], "node long, component long, members binary")
    got = {(r.u, r.v) for r in near_dedup.exact_candidates(made, 80, f"file://{tmp_path}").collect()}
    sets = {i: set(near_dedup.shingles(t, 1).tolist()) for i, t in data}
    linked = {(i, k) for i in sets for k in sets if i < k and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k])}
    assert linked <= got and len(got) < len(data) ** 2 / 2


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 120), (500, 501)]
    found = near_dedup.components(spark.createDataFrame(edges, "u long, v long"), f"file://{tmp_path}")
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 500 if i >= 500 else 1 for pair in edges for i in pair}


def test_width_five(spark):
    near = BASE.replace("word3 ", "changed ")
    df = spark.createDataFrame([(1, BASE), (2, near), (3, "a b c d e f g")], "doc_id long, text string")
    assert answer(near_dedup.near_duplicates(df, width=5)) == brute([(1, BASE), (2, near), (3, "a b c d e f g")], width=5)
