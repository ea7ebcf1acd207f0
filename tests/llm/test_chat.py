import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from voxframe.llm import chat

KIND = "conv_id long, turn long, role string, text string, window string, n_context string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KIND)


def expected(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        talks[conv_id].append((turn, role or "", text or ""))
    out = {}
    for conv_id, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        target = "".join(t for _, r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    return out


def tokens(role, text):
    esc = lambda s: s.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")
    return -(-len(f"### {esc(role).replace(':', chr(92) + 'c')}: {esc(text)}</turn>\n") // 4)


def brute_windows(rows, budget, history):
    """Turn numbers (context, new) of each window, by the rule, one turn after the other."""
    cost = [tokens(r, t) for _, r, t in rows]
    first = 1 if rows[0][1] == "system" else 0
    room = max(1, budget - (cost[0] if first else 0))
    stride = max(1, room - history)
    spans, at = {}, 0
    for i in range(first, len(rows)):
        spans.setdefault(at // stride, []).append(i)
        at += cost[i]
    out = []
    for span in spans.values():
        over = sum(cost[i] for i in span) > room and len(span) > 1
        out += [span[:-1], span[-1:]] if over else [span]
    if first:
        out = [[0, *out[0]], *out[1:]] if out else [[0]]
    made = []
    for span in out:
        fixed = first and span[0] > 0
        left = min(history, budget - sum(cost[i] for i in span) - (cost[0] if fixed else 0))
        back = [k for k in range(first, span[0]) if sum(cost[k : span[0]]) <= left]
        made.append(([0] * bool(fixed) + back, span))
    return made


def answers(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(df).collect()}


def test_hard_cases(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be brief"), *[(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " * 40) for k in range(1, 12)]]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None), (2, 1, "a: b#<\\", "\\b\\l\\h\\c: ### x: y</turn>\n"), (None, None, "assistant", "x"), (3, 0, "assistant", "word " * 30_000), (3, 1, "user", ""), (4, 5, "", " \n ")]
    out = chat.windows(frame(spark, rows))
    assert answers(out) == expected(rows)
    assert answers(chat.windows(frame(spark, []))) == {}
    for r in out.filter("conv_id = 1").collect():
        assert len(r.text) <= 4 * chat.BUDGET
        assert r.text.startswith("### system: be brief</turn>")


def test_windows_by_the_rule(spark):
    rows = [(0, "system", "s" * 30)] + [(k, "assistant" if k % 3 else "user", "w" * ((k * 37) % 260)) for k in range(1, 60)]
    want = brute_windows(rows, 200, 60)
    out = sorted(chat.windows(frame(spark, [(9, *r) for r in rows]), 200, 60).collect(), key=lambda r: r.window)
    assert [(r.n_context, r.n_new) for r in out] == [(len(a), len(b)) for a, b in want]
    for r, (a, b) in zip(out, want):
        assert [x.split(": ", 1)[1] for x in r.text.split("</turn>\n")[:-1]] == [rows[i][2] for i in a + b]
        assert [r.text[s.start : s.end] for s in r.loss] == [rows[i][2] for i in b if rows[i][1] == "assistant"]


def check_budget(out, budget, history):
    """From the texts alone: what a window holds, its turns' tokens counted anew."""
    for r in out:
        pieces = [p[4:].split(": ", 1) for p in r.text.split("</turn>\n")[:-1]]
        cost = [-(-(len(p) + 8) // 4) for p in r.text.split("</turn>\n")[:-1]]
        system = int(r.n_context > 0 and pieces[0][0] == "system")
        repeated = sum(cost[system : r.n_context])
        assert repeated <= history
        if sum(cost) > budget:  # one turn, with nothing but the system turn before it
            assert r.n_context == system and (r.n_new == 1 or (r.window == 0 and pieces[0][0] == "system" and r.n_new == 2))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.integers(0, 700)), min_size=1, max_size=60), st.booleans(), st.integers(0, 300))
def test_no_window_exceeds_its_budget(spark, turns, system, said):
    rows = [(0, "system", "s" * said)] * system + [(k + 1, r, "w" * n) for k, (r, n) in enumerate(turns)]
    out = sorted(chat.windows(frame(spark, [(9, *r) for r in rows]), 120, 40).collect(), key=lambda r: r.window)
    check_budget(out, 120, 40)
    assert [(r.n_context, r.n_new) for r in out] == [(len(a), len(b)) for a, b in brute_windows(rows, 120, 40)]
    assert sum(r.n_new for r in out) == len(rows)


def test_two_turns_that_leave_no_room_for_history(spark):
    rows = [(1, 0, "user", "x" * 400), (1, 1, "assistant", "y" * (4 * 440 - 30)), (1, 2, "user", "z" * (4 * 470 - 30))]
    out = sorted(chat.windows(frame(spark, rows)).collect(), key=lambda r: r.window)
    check_budget(out, chat.BUDGET, chat.HISTORY)
    assert all(len(r.text) <= 4 * chat.BUDGET for r in out)


def test_one_long_conversation(spark):
    rows = spark.range(60_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('ab ', int(id % 60)) text")
    out = chat.windows(rows)
    r = out.selectExpr("sum(n_new) n", "max(length(text)) longest", "count(distinct window) = count(1) and max(window) = count(1) - 1 dense").first()
    assert (r.n, r.dense) == (60_000, True) and r.longest <= 4 * chat.BUDGET


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.sampled_from(["user", "assistant", "system", "x:y", ""]), st.text(alphabet="ab\\<#:/tern> \n😀é", max_size=300)), min_size=1, max_size=40))
def test_round_trip(spark, rows):
    assert answers(chat.windows(frame(spark, rows), 40, 15)) == expected(rows)


def test_conversations_and_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = chat.windows(df)
    assert answers(out) == expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    check_budget(out.collect(), chat.BUDGET, chat.HISTORY)
    plan = chat.read_back(out)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
