import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import clashing, frame, rows
from voxframe.llm import fill_middle as fm


def plainly(doc_id, text):
    """A row of report(), by slices of the text."""
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(text)


def test_hard_cases(spark):
    got = sorted(map(tuple, fm.report(clashing(spark)).collect()), key=str)
    assert got == sorted((plainly(r[0], r[1]) for r in rows()), key=str)


def test_markers_and_all_forms(spark):
    texts = ["<P>", "a<S>b", "x<M>", "<P", "P>", "<<S<P<M>>", *["<" + "PSM>"[k % 4 :] + "<" * k for k in range(60)]]
    data = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    got = sorted(map(tuple, fm.report(frame(spark, data)).collect()))
    assert got == sorted(plainly(k, t) for k, t, *_ in data)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert fm.report(frame(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n😀é", max_size=3000), st.sampled_from([None, r"\s*\S+", r"(?s)..?", r"[^\n]*\n", "z"]))
def test_every_rank(text, unit):
    pattern = re.compile(unit) if unit else None
    units = fm.Units(text, pattern)
    if unit is None:
        ends = range(1, len(text) + 1)
    else:
        ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()]
        ends += [len(text)] if text and (not ends or ends[-1] < len(text)) else []
    places = [0, *ends]
    assert units.n == len(places) - 1
    assert [units.place(k) for k in range(units.n + 1)] == places
    for wrong in (-1, units.n + 1):
        with pytest.raises(IndexError):
            units.place(wrong)


def test_lanes_carry_both_widths_and_a_cut_takes_few_steps():
    text = "word " * 200_000
    units = fm.Units(text, re.compile(r"\S+\s"))
    assert len(units.lanes) > 5
    for lane in units.lanes:
        assert (lane[0].sum(), lane[1].sum()) == (200_000, 1_000_000)
    assert [units.place(k) for k in (0, 1, 77_777, 199_999, 200_000)] == [0, 5, 388_885, 999_995, 1_000_000]


def test_words_are_not_cut(spark):
    data = [(k, "eins zwei drei vier fünf", None, None, 0) for k in range(40)]
    for r in fm.transformed(frame(spark, data), unit=r"\S+\s*").collect():
        assert r.n == 5
        if r.form != "plain":
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, 5, 10, 15, 20, 24}
