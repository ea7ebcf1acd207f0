import zlib

import numpy as np
import pyarrow as pa
import pytest
from texts import clashing, frame, rows
from voxframe.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = quality.scores(docs, labels).join(labels, "doc_id").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out["doc_id"]]).all()
    assert (out["predicted"] == (out["score"] >= 0.7)).all() and out["score"].between(0, 1).all()
    test = out[out["held_out"]]
    assert (test["predicted"] == test["quality"]).mean() > 0.97
    good, bad = test.loc[test["quality"] == 1, "score"].to_numpy(), test.loc[test["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.99  # area under the curve


def test_held_out_labels_are_never_learned(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_hard_cases(spark, tables):
    _, labels = tables
    out = quality.scores(clashing(spark), labels).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 for r in out)
    assert quality.scores(frame(spark, []), labels).collect() == []
    none = labels.filter("false")
    assert {r.score for r in quality.scores(frame(spark), none).collect()} == {0.5}
    kept = quality.accepted(clashing(spark), labels)
    assert kept.columns == clashing(spark).columns


def test_measures_of_whole_texts():
    """A text's passages don't depend on its neighbours, and a long one is measured to its end."""
    texts = ["One two three", None, "", "a b " * 300_000 + "END!!", "x" * 10]
    together = {}
    for x, bags in quality.passages(pa.array(texts, pa.string())):
        for i in set(bags.tolist()):
            together[i] = x[bags == i]
    assert sorted(together) == [0, 1, 2, 3, 4]
    for i, t in enumerate(texts):
        alone = np.concatenate([x for x, _ in quality.passages(pa.array([t], pa.string()))])
        assert np.array_equal(alone, together[i])
    assert len(together[3]) >= 600_001 // quality.WORDS


def plain_measures(passage):
    """A passage's measures, from its words alone."""
    kinds = ["".join(chr(c) for c in range(128) if quality.CLASS[c] == k) for k in range(8)]
    upper, lower, digit, symbol, bar, call, point = (kinds[k] for k in (quality.UPPER, quality.LOWER, quality.DIGIT, quality.SYMBOL, quality.BAR, quality.CALL, quality.POINT))
    n, raw = len(passage), "".join(passage)
    size = len(raw.encode())
    lengths = [len(w.encode()) for w in passage]
    mean = size / n
    share = lambda chars: sum(c in chars for c in raw) / size
    other = sum(b >= 128 for b in raw.encode()) / size
    each = lambda test: sum(map(test, passage)) / n
    return [
        np.log1p(n) / 5, mean / 10, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5 / 10, share(upper), share(digit), share(symbol), share(bar), share(call), share(point), other,
        sum(a == b for a, b in zip(passage, passage[1:])) / n, 1 - len(set(passage)) / n, each(lambda w: w[-1] in symbol), each(lambda w: w[-1] in call),
        each(lambda w: sum(c in upper for c in w) > 1 and not any(c in lower for c in w)), each(lambda w: w == "|"),
    ]


def test_measures_by_brute_force():
    text = "The QUICK brown fox!! | jumps jumps over 12 lazy dogs\n #$%& été naïve BUY! NOW!!! | a*b 3.14 end, of|it " * 7
    words = text.split()
    (x, _), = quality.passages(pa.array([text]))
    assert len(x) == -(-len(words) // quality.WORDS)
    for k, got in enumerate(x):
        passage = words[k * quality.WORDS : (k + 1) * quality.WORDS]
        want = plain_measures(passage)
        assert np.allclose(got[: quality.N_MEASURES], want, atol=1e-5)
        assert got[quality.N_MEASURES :].sum() == pytest.approx(1)


@pytest.mark.parametrize("text", ["x" * 5000 + " and then some words " * 400, "ab cd " * 4000, "y" * 9000, " " * 5000 + "z w"])
def test_passages_do_not_depend_on_the_part(monkeypatch, text):
    whole, _ = next(iter(quality.passages(pa.array([text]))))
    monkeypatch.setattr(quality, "PART", 700)
    parts, _ = next(iter(quality.passages(pa.array([text]))))
    assert np.array_equal(whole, parts)


def attention(model, passages):
    """The score of one document, passage by passage."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h = [np.maximum(0, np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["W"] + model["b"]) for x in passages]
    e = [float(model["w"] @ (np.tanh(k @ model["V"]) * sigmoid(k @ model["U"]))) for k in h]
    weights = np.exp(e) / sum(np.exp(e))
    return float(sigmoid(model["c"] @ sum(a * k for a, k in zip(weights, h)) + model["c0"][0]))


def test_attention_by_brute_force():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 7, 1]
    x, bags = rng.normal(size=(sum(sizes), 5)), np.repeat(np.arange(len(sizes)), sizes)
    model = quality.start(x)
    got = quality.forward(model, x, bags)["p"]
    assert np.allclose(got, [attention(model, x[bags == k]) for k in range(len(sizes))])


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    x, bags, y = rng.normal(size=(12, 4)), np.repeat(np.arange(4), 3), np.array([0.0, 1, 1, 0])
    model = quality.start(x)
    g = quality.gradients(model, x, bags, y)

    def loss(changed):
        p = quality.forward(changed, x, bags)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, grad in g.items():
        for at in np.ndindex(grad.shape):
            step = np.zeros(grad.shape)
            step[at] = 1e-6
            slope = (loss(model | {name: model[name] + step}) - loss(model | {name: model[name] - step})) / 2e-6
            assert grad[at] == pytest.approx(slope, abs=1e-6)


def test_fit_finds_the_passage_that_tells():
    rng = np.random.default_rng(0)
    bags = np.repeat(np.arange(200), 5)
    x, y = rng.normal(size=(1000, 4)), np.arange(200) % 2
    x[::5, 0] += np.where(y == 1, 4, -4)
    model = quality.fit(x, bags, y.astype(float))
    assert ((quality.forward(model, x, bags)["p"] > 0.5) == y).mean() > 0.97
