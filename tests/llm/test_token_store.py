import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import clashing, frame, rows
from tokenizers import Tokenizer
from voxframe.llm import token_store as ts

WHOLE = Tokenizer.from_file(ts.TOKENIZER)
ENCODER = ts.Encoder(ts.TOKENIZER, ts.END)


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, ts.END]


def expected(data):
    start, out = 0, []
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = np.array(ids(text), "<u4")
        out.append((doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    return out


def test_hard_cases(spark):
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.stored(clashing(spark)).collect()), key=lambda r: r[1])
    assert got == expected([(r[0], r[1]) for r in rows()])


def test_empty(spark):
    assert ts.stored(frame(spark, [])).collect() == []


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ts.stored(df).collect()), key=lambda r: r[1])
    assert got == expected([(r.doc_id, r.text) for r in df.collect()])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aA bB\n.,'!sStT|<>_1é́ΣσİßJ̌  \x1c\t日本", max_size=40), st.lists(st.sampled_from(["it's", "I'LL", "<|endoftext|>", "can't.", "x<|startoftext|>y", "U.S.A.", "ΑΣ", "don't''", "word,", "12,5"]), max_size=6).map(" ".join)))
def test_words_are_encoded_as_in_their_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=80), min_size=1, max_size=12), st.data())
def test_random_access(docs, data):
    file = ts.TokenFile(ts.build(list(range(len(docs))), [np.array(d, "<u4").tobytes() for d in docs]))
    flat = [i for d in docs for i in d]
    assert file.size == len(flat)
    for k, d in enumerate(docs):
        assert file.document(k).tolist() == d
    if flat:
        i = data.draw(st.integers(0, len(flat) - 1))
        j = data.draw(st.integers(i, len(flat)))
        assert file.token(i) == flat[i] and file.ids(i, j).tolist() == flat[i:j]


def test_rank_over_blocks():
    values = np.random.default_rng(1).integers(0, 70_000, 5000).astype("<u4")
    file = ts.TokenFile(ts.build([None], [values.tobytes()]))
    assert file.doc_ids == [None] and file.ids(0, 5000).tolist() == values.tolist()
    for i in range(0, 5000, 97):
        assert file.token(i) == values[i] and file.rank(0, i) == (values[:i] > 255).sum()
