"""Secrets by patterns and by character Markov models, in DataFrame functions (operator 6).

Three patterns give the base spans. The method adds further spans: tokens that
a first-order Markov model of random strings explains better than one of
ordinary identifiers, by the mean log-likelihood ratio of their transitions.
Both models are counted from labelled samples: random strings are made from
digests and taken from base spans, ordinary ones are the tokens of a bounded
sample of documents that are no candidates, and the names of SQL functions.

Positions of matches: splitting at a pattern and extracting its matches give
the same leftmost, non-overlapping matches, so lengths add up to positions.
Sums are taken in blocks of matches and then over the blocks, and each match
is carried along, so no step looks at a text again from its start and the work
grows with the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of 24 or more, and a run that begins with AKIA and has 20 or more: as long
#: runs are maximal, asking for the length in the pattern drops just the shorter matches.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: A token that may be a secret: long enough, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_.=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_.=-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Documents and digests that the models are counted from, at most.
SAMPLE, DIGESTS = 2000, 2000
#: Weight of the single-character model in the transitions'.
BACKOFF = 5.0
#: Mean log-likelihood ratio a transition from which a token counts as a secret.
THRESHOLD = 1.0
SPAN = "array<struct<start:int,kind:int,end:int>>"
MATCHES = "cast(array() as array<struct<start:int,kind:int,end:int,t:string>>)"
#: Matches whose lengths are summed in one go.
BLOCK = 128
#: Characters of a text that are rewritten in one go.
SEGMENT = 4096


def bound(value: str, name: str, body: str) -> str:
    """SQL for body with value computed once and called name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def matches(text: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL for the matches of a pattern in a column: array<struct<start, kind, end, t>>, t the match itself.

    Matches whose group is shorter than least are dropped.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    lengths = f"transform(regexp_extract_all({text}, '{p}', {group}), g -> length(g))" if least else "transform(f, g -> 0)"
    parts = f"zip_with(zip_with(slice(split({text}, '{p}', -1), 1, size(f)), f, (p, m) -> struct(length(p) as p, length(m) as m, m as t)), {lengths}, (x, g) -> struct(x.p as p, x.m as m, x.t as t, g))"
    none = "cast(array() as array<struct<start:int,end:int,t:string,g:int>>)"
    step = "(a, x) -> struct(a.at + x.p + x.m as at, concat(a.out, array(struct(a.at + x.p as start, a.at + x.p + x.m as end, x.t as t, x.g as g))) as out)"
    number = f"cast(floor((size(f) - 1) / {BLOCK}) as int)"
    blocks = f"transform(sequence(0, {number}), b -> aggregate(slice(q, b * {BLOCK} + 1, {BLOCK}), struct(0 as at, {none} as out), {step}))"
    before = "aggregate(slice(w, 1, i), 0, (s, x) -> s + x.at)"
    placed = f"flatten(transform(w, (b, i) -> {bound(before, 'o', f'transform(b.out, s -> struct(s.start + o as start, {kind} as kind, s.end + o as end, s.t as t, s.g as g))')}))"
    chosen = f"filter({placed}, s -> s.g >= {least})" if least else placed
    found = bound(f"regexp_extract_all({text}, '{p}', 0)", "f", f"if(size(f) = 0, {MATCHES}, {bound(parts, 'q', bound(blocks, 'w', f'transform({chosen}, s -> struct(s.start as start, s.kind as kind, s.end as end, s.t as t))'))})")
    return found


def spans_of(found: str) -> str:
    return f"transform({found}, s -> struct(s.start as start, s.kind as kind, s.end as end))"


def base_spans(rows: DataFrame) -> DataFrame:
    """rows (…, text) with the spans of each pattern: s_assign, s_access, s_hex."""
    none = f"cast(array() as {SPAN})"
    return rows.withColumns({
        "s_assign": F.expr(f"if(rlike(text, '(?i)password|passwd|secret|token|api_?key'), {spans_of(matches('text', ASSIGN, 0, 2, 6))}, {none})"),
        "s_access": F.expr(f"if(contains(text, 'AKIA'), {spans_of(matches('text', ACCESS, 1))}, {none})"),
        "s_hex": F.expr(f"if(rlike(text, '{HEX}'), {spans_of(matches('text', HEX, 2))}, {none})"),
    })


def transitions(rows: DataFrame, token: str) -> dict[tuple[str, str], int]:
    """Counts of adjacent characters in a column of tokens; at most one row for each pair of the alphabet."""
    chars = f"filter(split({token}, ''), c -> c <> '')"
    pairs = rows.select(F.explode(F.expr(bound(chars, "c", "zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (x, y) -> concat(x, y))"))).alias("pair"))
    return {(r["pair"][0], r["pair"][1]): r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect() if len(r["pair"]) == 2 and {*r["pair"]} <= {*ALPHABET}}


def log_ratios(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """log P(next | char) under the model of random strings less that under ordinary ones, for each pair."""
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    held = some.select(F.explode(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)))).alias("t"))
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    made = spark.range(DIGESTS).select(F.explode(F.array(F.base64(digest), F.upper(F.substring(F.translate(F.base64(digest), "+/=", ""), 1, 20)), F.translate(F.base64(digest), "+/=", ""))).alias("t"))
    rest = some.select(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ").alias("text"))
    plain = rest.select(F.explode(F.expr(f"regexp_extract_all(text, '{ORDINARY}', 0)")).alias("t"))
    plain = plain.where("not (length(t) >= 16 and rlike(t, '[0-9]') and rlike(t, '[A-Za-z]'))")  # candidates are in question
    names = spark.sql("show system functions").select(F.col("function").alias("t")).where("length(t) > 1")
    counts = [transitions(held.union(made), "t"), transitions(plain.union(names), "t")]
    logs = []
    for c in counts:
        total = {a: sum(c.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        alone = {b: sum(c.get((a, b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
        every = sum(alone.values())
        # a rare first character leaves the next to its frequency alone
        logs.append([math.log((c.get((a, b), 0) + BACKOFF * alone[b] / every) / (total[a] + BACKOFF)) for a in ALPHABET for b in ALPHABET])
    return [r - o for r, o in zip(*logs)]


def secret_spans(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs (…, text not null) with s_assign, s_access, s_hex and s_markov, the spans that the method adds."""
    codes = f"transform(filter(split(s.t, ''), c -> c <> ''), c -> instr('{ALPHABET}', c) - 1)"
    size = "(size(c) - 1)"
    mean = bound(codes, "c", f"aggregate(zip_with(slice(c, 1, {size}), slice(c, 2, {size}), (x, y) -> get(llr, x * {len(ALPHABET)} + y)), 0D, (sum, x) -> sum + x) / {size}")
    outside = "not exists(concat(s_assign, s_access, s_hex), b -> b.start < s.end and s.start < b.end)"
    chosen = spans_of(f"filter({matches('text', TOKEN, 3)}, s -> rlike(s.t, '[0-9]') and rlike(s.t, '[A-Za-z]') and {mean} >= {threshold} and {outside})")
    found = base_spans(docs)
    literal = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    found = found.withColumn("llr", literal)
    guard = f"rlike(text, '{TOKEN}') and rlike(text, '[0-9]')"
    return found.withColumn("s_markov", F.expr(f"if({guard}, {chosen}, cast(array() as {SPAN}))")).drop("llr")


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs (doc_id, text).

    A null text is empty and has no span; positions are code points, the end
    exclusive. Repeated rows give repeated results, an empty table none, and
    other columns are ignored. The models are trained on docs themselves.
    """
    rows = pick(docs, doc_id="bigint", text="string")
    found = secret_spans(rows.withColumn("text", F.coalesce("text", F.lit(""))), log_ratios(rows))
    base = F.concat("s_assign", "s_access", "s_hex")
    counts = [F.size(f"s_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "s_markov")).alias("spans"), counts[3])


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by [secret]; n_chars, where there is one, follows the text. A null text stays null."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # the caller's names may be ours
    text = inner[names.index("text")]
    found = secret_spans(docs.toDF(*inner).withColumn("text", F.coalesce(text, F.lit(""))), log_ratios(pick(docs, doc_id="bigint", text="string")))
    found = found.withColumn("spans", F.array_sort(F.concat("s_assign", "s_access", "s_hex", "s_markov")))
    # spans that overlap or touch are one: first within blocks of them, then with what the blocks before reach over
    none = "cast(array() as array<struct<begin:int,stop:int>>)"
    step = """(a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).stop,
        concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).begin as begin, greatest(element_at(a, -1).stop, s.end) as stop))),
        concat(a, array(struct(s.start as begin, s.end as stop))))"""
    blocks = f"transform(sequence(0, cast(floor((size(spans) - 1) / {BLOCK}) as int)), b -> aggregate(slice(spans, b * {BLOCK} + 1, {BLOCK}), {none}, {step}))"
    reach = "aggregate(slice(w, 1, i), 0, (m, x) -> greatest(m, element_at(x, -1).stop))"
    trimmed = bound(reach, "m", "transform(b, s -> struct(greatest(s.begin, m) as begin, s.stop as stop))")
    merged = bound(blocks, "w", f"filter(flatten(transform(w, (b, i) -> {trimmed})), s -> s.begin < s.stop)")
    found = found.withColumn("gone", F.expr(f"if(size(spans) = 0, {none}, {merged})"))
    # in segments of the text, so that no piece is looked for from the text's start
    prev = "if(i = 0, 0, here[i - 1].stop - o)"
    pieces = f"transform(here, (s, i) -> concat(substring(g, {prev} + 1, greatest(s.begin - o, 0) - {prev}), if(s.begin >= o, '[secret]', '')))"
    rest = f"substring(g, if(size(here) = 0, 0, element_at(here, -1).stop - o) + 1)"
    segment = bound(f"filter(gone, s -> s.begin < o + {SEGMENT} and s.stop > o)", "here", f"concat(array_join({pieces}, ''), {rest})")
    whole = f"array_join(transform(regexp_extract_all(text, '(?s).{{1,{SEGMENT}}}', 0), (g, k) -> {bound(f'k * {SEGMENT}', 'o', segment)}), '')"
    clean = found.withColumn("clean", F.expr(f"if(size(gone) = 0, text, {whole})"))
    hit = F.size("gone") > 0
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return clean.select(*[(F.when(hit, new[n]).otherwise(F.col(c)) if n in new else F.col(c)).alias(n) for n, c in zip(names, inner)])


QUERIES = {"op6_markov_secrets": op6_markov_secrets}
ORACLES: dict[str, str] = {}
