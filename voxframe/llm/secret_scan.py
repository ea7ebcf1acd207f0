"""Secret scans: patterns, and Shannon entropy in sliding windows, as DataFrame functions only.

Patterns, leftmost and non-overlapping per kind; a match that is too short is dropped but has used up its characters:
    assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), its group 2 of 8 or more;
            letters of the keyword in either case
    access  AKIA[A-Z0-9]+, 16 or more
    hex     [0-9a-f]+, 32 or more

Entropy adds spans. Candidates are runs of 20 or more of [A-Za-z0-9+/_=-]. Each is split into its longest parts of one
character class: `hex` (hexadecimal digits), `alnum` (letters and digits) and `base64` (all that a run may hold, so the
run itself). A window of fixed length slides over each part; the number of times that each character is in it, and the
sum of n * log2(n) over them, are changed by the character that comes in and the one that leaves. The entropy of a
window of length L is log2(L) - sum / L. Windows at or above the class's threshold that overlap or touch are one span,
of kind entropy_hex, entropy_alnum or entropy_base64. A run or a part that matches an allow-list pattern gives no entropy
spans; pattern matches are never suppressed.

Spans count code points and their ends are exclusive. There is no shuffle. Only texts that hold a match or a candidate
are taken apart. Places are running sums of lengths, taken in blocks of BLOCK, as arrays that grow match by match would
be copied each time; so work grows with the text's length.

Defined cases: a null text counts as empty; rows that repeat get equal answers; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, RUN = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{20,}"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy_hex", "entropy_alnum", "entropy_base64")
#: class: (window, threshold in bits, its longest parts of a run; shorter ones hold no window)
CLASSES = {"entropy_hex": (24, 3.2, "[0-9a-fA-F]{24,}"), "entropy_alnum": (20, 3.9, "[A-Za-z0-9]{20,}"), "entropy_base64": (20, 3.9, None)}
BLOCK = 128
#: Runs that look random but are not secret: one case of letters only, numbers, UUIDs, paths of words, documented example keys, the alphabet.
ALLOW = ("^[a-z]+$", "^[A-Z]+$", "^[A-Z]?[a-z]+$", "^[0-9-]+$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^/?([A-Za-z]{2,15}[/_=-])+[A-Za-z]{2,15}/?$", "(?i)example", "(?i)abcdefghij")

SPAN = "struct<start: int, kind: int, end: int>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _blocks(array: str) -> str:
    """SQL for an array cut into arrays of BLOCK elements."""
    return f"transform(sequence(0, greatest(0, cast(ceil(size({array}) / {BLOCK}D) as int) - 1)), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"


def _matches(text: str, pattern: str, group: int, least: int, kind: int) -> str:
    """SQL for the spans of a pattern. The gap before each match and the match come from one pattern each, whose last
    match reaches the end of the text, so that no place is tried twice."""
    p = _quoted(pattern)
    gaps = f"regexp_extract_all({text}, '(?s)(.*?)(?:{p}|\\\\z)', 1)"
    found = f"regexp_extract_all({text}, '{p}', 0)"
    size = "length(f)" if group == 0 else f"length(regexp_extract(f, '{p}', {group}))"
    # Lengths of the gap and the match, and whether the match counts; what follows the last match is left out.
    parts = f"filter(zip_with({gaps}, {found}, (g, f) -> named_struct('gap', length(g), 'len', length(f), 'ok', {size} >= {least})), x -> x.len is not null)"
    fold = f"""aggregate(block, named_struct('at', 0, 'spans', cast(array() as array<{SPAN}>)),
        (a, x) -> named_struct('at', a.at + x.gap + x.len, 'spans', if(x.ok,
            concat(a.spans, array(named_struct('start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + x.len))), a.spans)))"""
    return f"""flatten(aggregate(transform({_blocks(parts)}, block -> {fold}),
        named_struct('at', 0, 'all', cast(array() as array<array<{SPAN}>>)),
        (t, r) -> named_struct('at', t.at + r.at, 'all', concat(t.all, array(transform(r.spans, s -> named_struct('start', s.start + t.at, 'kind', s.kind, 'end', s.end + t.at))))),
        t -> t.all))"""


def _windows(kind: str) -> str:
    """SQL for the spans of a class's windows in the part r (its text `s`, its place `at`)."""
    window, threshold, _ = CLASSES[kind]
    # c: the part's characters; n: how often each of `letters` is in the window; s: the sum of n * log2(n). Windows that
    # reach the threshold join the open span, or close it and open another.
    gain = lambda v: f"if({v} > 0, {v} * log2({v}), 0D)"
    inc, out = "array_position(r.letters, r.c[i])", f"array_position(r.letters, r.c[i - {window}])"
    step = f"""(a, i) -> aggregate(array(named_struct('inc', {inc}, 'out', if(i >= {window}, {out}, 0L))),
        a, (b, m) -> if(m.inc = m.out, b, named_struct(
            'n', transform(b.n, (v, k) -> v + if(k + 1 = m.inc, 1D, 0D) - if(k + 1 = m.out, 1D, 0D)),
            'sum', b.sum + {gain("(b.n[int(m.inc) - 1] + 1D)")} - {gain("b.n[int(m.inc) - 1]")} + if(m.out > 0, {gain("(b.n[int(m.out) - 1] - 1D)")} - {gain("b.n[int(m.out) - 1]")}, 0D),
            'start', b.start, 'end', b.end, 'spans', b.spans)),
        b -> if(i + 1 < {window} or log2({window}D) - b.sum / {window} < {threshold}, b, if(b.end >= i + 1 - {window},
            named_struct('n', b.n, 'sum', b.sum, 'start', b.start, 'end', i + 1, 'spans', b.spans),
            named_struct('n', b.n, 'sum', b.sum, 'start', i + 1 - {window}, 'end', i + 1, 'spans', if(b.end < 0, b.spans, concat(b.spans, array({_span(kind, "b")})))))))"""
    zero = f"named_struct('n', transform(r.letters, x -> 0D), 'sum', 0D, 'start', -1, 'end', -1, 'spans', cast(array() as array<{SPAN}>))"
    return f"aggregate(sequence(0, size(r.c) - 1), {zero}, {step}, a -> if(a.end < 0, a.spans, concat(a.spans, array({_span(kind, 'a')}))))"


def _span(kind: str, of: str) -> str:
    return f"named_struct('start', r.at + {of}.start, 'kind', {KINDS.index(kind)}, 'end', r.at + {of}.end)"


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per row of docs: doc_id and its spans (start, kind as its index in KINDS, end), by start and kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = f"cast(array() as array<{SPAN}>)"
    for name, (pattern, group, least) in {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}.items():
        rows = rows.withColumn(name, F.when(F.col("text").rlike(pattern), F.expr(_matches("text", pattern, group, least, BASE.index(name)))).otherwise(F.expr(none)))
    runs = F.expr(_matches("text", RUN, 0, 20, 0))
    rows = rows.withColumn("runs", F.when(F.col("text").rlike(RUN), runs).otherwise(F.expr(none)))
    allowed = " or ".join(f"s rlike '{_quoted(p)}'" for p in allow) or "false"
    # Runs are cut out by one pattern, so that long texts aren't walked once per run.
    cut = f"zip_with(runs, regexp_extract_all(text, '{RUN}', 0), (a, s) -> named_struct('span', a, 's', s))"
    rows = rows.withColumn("runs", F.expr(f"if(size(runs) = 0, array(), filter(transform({cut}, x -> named_struct('at', x.span.start, 's', x.s)), r -> not exists(array(r.s), s -> {allowed})))"))
    taken = lambda runs: f"transform({runs}, r -> named_struct('at', r.at, 's', r.s, 'c', filter(split(r.s, ''), c -> c <> ''), 'letters', array_distinct(filter(split(r.s, ''), c -> c <> ''))))"
    found = []
    for kind, (window, _, part) in CLASSES.items():
        mine = "runs"
        if part:
            spots = _matches("r.s", part, 0, window, 0)
            cut = f"zip_with({spots}, regexp_extract_all(r.s, '{part}', 0), (a, s) -> named_struct('at', r.at + a.start, 's', s))"
            mine = f"filter(flatten(transform(filter(runs, r -> r.s rlike '{part}'), r -> {cut})), r -> not exists(array(r.s), s -> {allowed}))"
        rows = rows.withColumn(f"parts_{kind}", F.expr(taken(mine)))
        found.append(F.expr(f"flatten(transform(parts_{kind}, r -> {_windows(kind)}))"))
    return rows.select("doc_id", *BASE, F.array_sort(F.concat(*BASE, *found)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan(docs)
    base = listed(F.array_sort(F.concat(*BASE)))
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
