"""Secret scans with DataFrame functions only: three fixed patterns, and tokens that look drawn at random.

Character Markov models of random strings and of ordinary identifiers are counted from labelled samples. A token is random
if the log-likelihood ratio of its characters, in bits per character, reaches a threshold. Where a whole run of characters
doesn't, or meets a fixed pattern, its stretches of the highest ratio are judged instead, so that a random string is found
after a name or in a path too. Spans come from splitting a text
by a pattern: what lies between and within the matches gives their places, without a function that reports positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions.literals import array_literal
from arbor.llm.common import quoted

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = "array<struct<start:int,kind:int,stop:int>>"
_MATCH = "array<struct<start:int,kind:int,stop:int,hit:string>>"


@dataclass(frozen=True)
class RandomTokens:
    """length: least characters of a token; ratio: least bits per character in favour of a random string; smoothing: added
    to every count of a pair of characters; drop: a stretch ends where its bits fall so far below their highest sum.
    Without a digit, as in prose and rulers, a stretch needs ``plain`` bits and any token ``distinct`` different characters."""

    length: int = 16
    ratio: float = 1.0
    smoothing: float = 0.5
    drop: float = 15.0
    plain: float = 26.0
    distinct: int = 8

    @property
    def pattern(self) -> str:
        return rf"[A-Za-z0-9+/_=-]{{{self.length},}}"


#: Common words of identifiers and prose, from which ordinary samples are put together.
_PARTS = (
    "get set user name account order item list file path data value count index time date session request response handler manager config option default image button "
    "window layout color width height background margin client server connection message queue worker thread process table column row key map cache buffer stream reader "
    "writer parser token string number integer boolean object array function method class module package version release build test result error warning status code "
    "address street city country phone email customer product invoice payment report summary total amount price service query filter search page link title header footer "
    "create update delete insert remove append start stop begin finish first second third before after under between within about above while every other house water "
    "people school family letter mother father morning evening summer winter government information international development environment management performance "
    "original document language history science nature animal garden kitchen picture question answer problem example different important possible national public "
    "private secret password access login profile network system control display monitor schedule transaction identifier reference parameter attribute"
).split()


#: What placeholders run through.
_SEQUENCE = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SAMPLES = 6000


def default_samples(spark: SparkSession) -> DataFrame:
    """``(text, random boolean)``: digests in hexadecimal, base64 and capitals against compounds of common words in usual spellings and
    runs of letters and digits in their order.

    Made by SQL from the digests of row numbers, SAMPLES rows of each kind.
    """
    w = F.array(*map(F.lit, _PARTS))
    i = F.col("id")
    drawn = lambda k, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", i.cast("string"), F.lit(str(k))).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    pick = [F.get(w, drawn(k, len(_PARTS))) for k in range(4)]
    style = drawn(9, 7)
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *pick))
        .when(style == 1, F.concat(pick[0], *map(F.initcap, pick[1:])))
        .when(style == 2, F.concat(*map(F.initcap, pick)))
        .when(style == 3, F.concat_ws("-", *pick[:3], (drawn(8, 30) + 2000).cast("string")))
        .when(style == 4, F.upper(F.concat_ws("_", *pick[:3])))
        .when(style == 5, F.concat(pick[0], F.substring(F.lit(_SEQUENCE), drawn(8, 30) + 1, F.lit(16))))
        .otherwise(F.concat_ws("/", *pick))
    )
    digest = F.sha2(i.cast("string").cast("binary"), 256)
    coded = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = F.when(i % 4 == 0, F.substring(digest, 1, 40)).when(i % 8 == 1, F.upper(coded)).otherwise(coded)
    ids = spark.range(SAMPLES)
    return ids.select(ordinary.alias("text"), F.lit(False).alias("random")).unionByName(ids.select(random.alias("text"), F.lit(True).alias("random")))


def train(samples: DataFrame, p: RandomTokens | None = None) -> list[float]:
    """Log-likelihood ratios in bits of every pair of characters, row by row of the first (the alphabet's size squared).

    Counted by one aggregation; a row per pair and label comes to the driver, as many as the alphabet allows at most. Samples
    with a null text or label are left out; without samples every ratio is 0.
    """
    p = p or RandomTokens()
    k = len(ALPHABET)
    runs = samples.where("length(text) > 1 and random is not null").select("random", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"), "text")
    pairs = runs.select("random", F.expr(f"instr('{ALPHABET}', substr(text, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substr(text, i + 1, 1))").alias("b"))
    counts = {(r["random"], r["a"] - 1, r["b"] - 1): r["n"] for r in pairs.where("a > 0 and b > 0").groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(k):
        rows = [[counts.get((label, a, b), 0) + p.smoothing for b in range(k)] for label in (True, False)]
        totals = [sum(r) for r in rows]
        out += [math.log2(rows[0][b] / totals[0]) - math.log2(rows[1][b] / totals[1]) for b in range(k)]
    return [round(x, 4) for x in out]


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once. Inside a lambda any other expression is made anew for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """``op`` over each element and those before it. In blocks, so that the cost is all but linear: a fold that appends would copy
    what it has for every element."""
    block = 64
    some = lambda v, lo, hi: F.aggregate(F.sequence(lo, hi), zero, lambda acc, j: op(acc, F.get(v, j)))  # noqa: E731  (a slice would copy all of them)

    def whole(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x["v"]) / block).cast("int") - 1), lambda b: some(x["v"], b * block, F.least(b * block + block, F.size(x["v"])) - 1))

    def before(y: Column) -> Column:
        step = lambda acc, w: F.struct(op(acc["sum"], w).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(y["whole"], F.struct(zero.alias("sum"), F.slice(y["whole"], 1, 0).alias("out")), step, lambda acc: acc["out"])

    def each(z: Column) -> Column:
        at = lambda i: F.shiftright(i, 6)
        return F.transform(z["v"], lambda _, i: op(F.get(z["before"], at(i)), some(z["v"], at(i) * block, i)))

    summed = lambda x: _once(F.struct(x["v"].alias("v"), whole(x).alias("whole")), lambda y: _once(F.struct(y["v"].alias("v"), before(y).alias("before")), each))
    return _once(F.struct(values.alias("v")), lambda x: F.when(F.size(x["v"]) > 0, summed(x)).otherwise(x["v"]))


def _matches(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Matches (start, kind, stop, hit) in code points; with ``least``, those whose group 2 has so many characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length) if least else F.array().cast("array<int>")
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.struct(hits.alias("hits"), second.alias("second"), gaps.alias("gaps"))

    def spans(x: Column) -> Column:
        stops = _running(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: g + F.length(h)), lambda a, b: a + b, F.lit(0))
        found = F.zip_with(x["hits"], stops, lambda h, stop: F.struct((stop - F.length(h)).alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), h.alias("hit")))
        return F.filter(found, lambda _, i: F.get(x["second"], i) >= least) if least else found

    return F.when(text.rlike(pattern), _once(parts, spans)).otherwise(F.array().cast(_MATCH))


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    return F.transform(_matches(text, pattern, kind, least), _span)


def _span(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))


def _free(spans_: Column, base: Column) -> Column:
    """For each of the spans, which come in order, whether it overlaps none of the base spans: one sorted walk over both."""
    mark = lambda own: lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(own).alias("own"))
    end = 2**31 - 1

    def walk(x: Column) -> Column:
        tops = _running(F.transform(x["all"], lambda s: F.when(s["own"], 0).otherwise(s["stop"])), lambda a, b: F.greatest(a, b), F.lit(0))
        nexts = F.reverse(_running(F.transform(F.reverse(x["all"]), lambda s: F.when(s["own"], end).otherwise(s["start"])), lambda a, b: F.least(a, b), F.lit(end)))
        return _once(F.struct(x["all"].alias("all"), tops.alias("tops"), nexts.alias("nexts")), judge)

    def judge(y: Column) -> Column:
        each = F.transform(y["all"], lambda s, i: F.struct(s["own"].alias("own"), ((F.get(y["tops"], i) <= s["start"]) & (F.get(y["nexts"], i) >= s["stop"])).alias("free")))
        return F.transform(F.filter(each, lambda s: s["own"]), lambda s: s["free"])

    both = F.array_sort(F.concat(F.transform(spans_, mark(True)), F.transform(base, mark(False))))
    return F.when((F.size(base) == 0) | (F.size(spans_) == 0), F.transform(spans_, lambda s: F.lit(True))).otherwise(_once(F.struct(both.alias("all")), walk))


def _ratio(token: Column, table: Column) -> Column:
    """Bits per pair of characters of a token in favour of a random string."""
    k = len(ALPHABET)
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda c: c > 0)
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("bits"), F.lit(0).alias("n"))  # one pass: the code before is carried along

    def step(acc: Column, c: Column) -> Column:
        first = acc["last"] == 0
        bits = F.when(first, F.lit(0.0)).otherwise(F.get(table, (acc["last"] - 1) * k + c - 1))
        return F.struct(c.alias("last"), (acc["bits"] + bits).alias("bits"), (acc["n"] + F.when(first, 0).otherwise(1)).alias("n"))

    return F.aggregate(codes, start, step, lambda acc: acc["bits"] / F.nullif(acc["n"], F.lit(0)))


def _stretches(token: Column, table: Column, p: RandomTokens) -> Column:
    """Stretches (start, stop, bits) of a token of ALPHABET that have as many bits as the shortest random token, and the ratio.

    The bits are summed up from left to right. A stretch ends at its highest sum, and the next one begins where the sum falls to
    0 or by ``drop``, so several random strings in a token are found one by one.
    """
    k = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)
    bits = F.zip_with(codes, F.slice(codes, 2, F.length(token)), lambda a, b: F.coalesce(F.get(table, (a - 1) * k + b - 1), F.lit(0.0)))  # 0 for the last, which has no successor
    found = "array<struct<start:int,stop:int,bits:double>>"
    names = ("at", "start", "stop", "sum", "best", "out")
    begin = F.struct(*(x.alias(n) for n, x in zip(names, (F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.array().cast(found)), strict=True)))

    def closed(acc: Column) -> Column:
        fits = (acc["best"] >= p.ratio * (p.length - 1)) & (acc["best"] >= p.ratio * (acc["stop"] - acc["start"] - 1))
        return F.when(fits, F.array_append(acc["out"], F.struct(acc["start"], acc["stop"], acc["best"].alias("bits")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        s, at = acc["sum"] + x, acc["at"] + 1
        state = lambda *v: F.struct(*(c.alias(n) for n, c in zip(names, v, strict=True)))
        anew = state(at, at, at, F.lit(0.0), F.lit(0.0), closed(acc))
        higher = s > acc["best"]
        on = state(at, acc["start"], F.when(higher, at + 1).otherwise(acc["stop"]), s, F.when(higher, s).otherwise(acc["best"]), acc["out"])
        return F.when((s <= 0) | (s < acc["best"] - p.drop), anew).otherwise(on)

    return F.aggregate(bits, begin, step, closed)


def _varied(token: Column, p: RandomTokens) -> Column:
    """Whether a token has enough different characters; rulers of hyphens and the like have not."""
    return F.size(F.array_distinct(F.split(token, ""))) >= p.distinct


def _parts(token: Column, table: Column, p: RandomTokens) -> Column:
    """Places (start, stop) in a token of its random stretches, each up to the separators around it; those that meet are one."""
    cut = lambda s: F.substring(token, s["start"] + 1, s["stop"] - s["start"])
    random = F.filter(_stretches(token, table, p), lambda s: cut(s).rlike("[0-9]") | ((s["bits"] >= p.plain) & _varied(cut(s), p)))
    before = lambda s: F.length(F.regexp_extract(F.substring(token, F.lit(1), s["start"]), "[A-Za-z0-9+]*$", 0))
    after = lambda s: F.length(F.regexp_extract(F.substring(token, s["stop"] + 1, F.length(token)), "^[A-Za-z0-9+]*", 0))
    wide = F.transform(random, lambda s: F.struct((s["start"] - before(s)).alias("start"), (s["stop"] + after(s)).alias("stop")))

    def join(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        one = F.struct(F.least(last["start"], s["start"]).alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(s["start"] <= last["stop"], F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), one)).otherwise(F.array_append(acc, s))

    return F.aggregate(wide, F.array().cast("array<struct<start:int,stop:int>>"), join)


def spans(text: Column, table: list[float], p: RandomTokens | None = None) -> tuple[Column, Column]:
    """(base spans, runs) of a text; none for null. Base spans are sorted (start, kind, stop).

    A run of token characters has its span, whether it is random as a whole, which it isn't with several random parts that
    ordinary ones separate, and the spans of its random parts.
    """
    p = p or RandomTokens()
    text = F.coalesce(text, F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 12), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    ratios = array_literal(table, "double")
    span = lambda at, s: F.struct((at + s["start"]).alias("start"), F.lit(3).alias("kind"), (at + s["stop"]).alias("stop"))
    parts = lambda s: F.transform(_parts(s["hit"], ratios, p), lambda x: span(s["start"], x))

    def random(s: Column) -> Column:
        least = F.when(s["hit"].rlike("[0-9]"), p.ratio).when(_varied(s["hit"], p), F.greatest(F.lit(p.ratio), p.plain / (F.length(s["hit"]) - 1)))
        return F.coalesce(_ratio(s["hit"], ratios) >= least, F.lit(False))

    return base, F.transform(_matches(text, p.pattern, 3), lambda s: F.struct(_span(s).alias("span"), (random(s) & (F.size(parts(s)) <= 1)).alias("whole"), parts(s).alias("parts")))


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", p: RandomTokens | None = None) -> DataFrame:
    """One row per row of ``docs``: id, base and all (arrays of (start, kind, stop), kind an index of KINDS).

    A random token is added only where it overlaps no base span: the whole run, or else its random parts.
    """
    base, runs = spans(quoted(text_col).cast("string"), table, p)
    rows = docs.select(quoted(id_col).alias(id_col), base.alias("base"), runs.alias("runs"))
    rows = rows.withColumn("free", _free(F.transform("runs", lambda r: r["span"]), F.col("base")))
    likely = F.flatten(F.zip_with("runs", "free", lambda r, free: F.when(r["whole"] & free, F.array(r["span"])).otherwise(r["parts"])))
    rows = rows.select(id_col, "base", likely.alias("likely")).withColumn("free", _free(F.col("likely"), F.col("base")))
    added = F.filter(F.zip_with("likely", "free", lambda s, free: F.struct(s.alias("span"), free.alias("free"))), lambda x: x["free"])
    return rows.select(id_col, "base", F.array_sort(F.concat("base", F.transform(added, lambda x: x["span"]))).alias("all"))


def rendered(spans_col: Column) -> Column:
    """``kind:start:stop`` of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans_col: Column, mark: str = "[secret]") -> Column:
    """A text with every span replaced by a mark; spans that overlap are replaced as one."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")).alias("out"),
        F.greatest(acc["at"], s["stop"]).alias("at"),
    )
    done = F.aggregate(spans_col, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def report(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", p: RandomTokens | None = None) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row of ``docs``."""
    rows = scan(docs, table, id_col, text_col, p)
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(id_col, *map(count, range(4)), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("all")).alias("spans"))


#: What the SQL judges: whole runs with a digit, of 20 characters or more.
_P = RandomTokens(length=20)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_pattern(pattern: str) -> str:
    """The pattern with classes of both cases instead of a flag, which SQL engines understand in more than ASCII."""
    head, found, rest = pattern.partition("(?i:")
    words, _, tail = rest.partition(")")
    return _quote(head + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + tail if found else pattern)


def _sql_spans(name: str, pattern: str, kind: int, group: int = 0) -> str:
    """CTE of the matches of a pattern: rid, kind, start and stop in characters, hit, and the length of a group."""
    p = _sql_pattern(pattern)
    return f"""{name}_m AS (SELECT rid, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS parts, list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS gaps FROM d WHERE regexp_matches(text, {p})),
{name} AS (SELECT rid, {kind} AS kind, stop - length(hit) AS start, stop, hit, part FROM (
  SELECT rid, hits[i] AS hit, length(parts[i]) AS part, CAST(list_sum(gaps[1:i]) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS BIGINT) AS stop FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m)))"""


_WORD = "w[1 + CAST('0x' || substr(md5(id || ':{k}'), 1, 8) AS BIGINT) % {n}]"
_PICK = [_WORD.format(k=k, n=len(_PARTS)) for k in range(4)]
_DRAW = "(CAST('0x' || substr(md5(id || ':{k}'), 1, 8) AS BIGINT) % {n})"
_TITLE = [f"upper(substr({x}, 1, 1)) || substr({x}, 2)" for x in _PICK]
_CODE = f"strpos('{ALPHABET}', substr(text, {{at}}, 1))"
#: DuckDB SQL of the query's columns, with the training of the Markov models.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ids AS (SELECT range AS id, [{", ".join(map(_quote, _PARTS))}] AS w FROM range({SAMPLES})),
samples AS (
  SELECT FALSE AS random, CASE {_DRAW.format(k=9, n=7)} WHEN 0 THEN {" || '_' || ".join(_PICK)} WHEN 1 THEN {_PICK[0]} || {" || ".join(_TITLE[1:])} WHEN 2 THEN {" || ".join(_TITLE)}
    WHEN 3 THEN {" || '-' || ".join(_PICK[:3])} || '-' || ({_DRAW.format(k=8, n=30)} + 2000) WHEN 4 THEN upper({" || '_' || ".join(_PICK[:3])})
    WHEN 5 THEN {_PICK[0]} || substr('{_SEQUENCE}', {_DRAW.format(k=8, n=30)} + 1, 16) ELSE {" || '/' || ".join(_PICK)} END AS text FROM ids
  UNION ALL SELECT TRUE, CASE WHEN id % 4 = 0 THEN substr(sha256(CAST(id AS VARCHAR)), 1, 40) WHEN id % 8 = 1 THEN upper(replace(base64(unhex(sha256(CAST(id AS VARCHAR)))), '=', '')) ELSE replace(base64(unhex(sha256(CAST(id AS VARCHAR)))), '=', '') END FROM ids),
seen AS (SELECT random, {_CODE.format(at="i")} AS a, {_CODE.format(at="i + 1")} AS b FROM (SELECT random, text, unnest(range(1, length(text))) AS i FROM samples)),
counts AS (SELECT random, a, b, count(*) AS n FROM seen WHERE a > 0 AND b > 0 GROUP BY ALL),
cells AS (SELECT * FROM (SELECT unnest([TRUE, FALSE]) AS random), (SELECT unnest(range(1, {len(ALPHABET) + 1})) AS a), (SELECT unnest(range(1, {len(ALPHABET) + 1})) AS b)),
smooth AS (SELECT random, a, b, coalesce(n, 0) + {_P.smoothing}::DOUBLE AS n FROM cells LEFT JOIN counts USING (random, a, b)),
share AS (SELECT random, a, b, log2(n / sum(n) OVER (PARTITION BY random, a)) AS bits FROM smooth),
ratio AS (SELECT a, b, round(sum(CASE WHEN random THEN bits ELSE -bits END), 4) AS r FROM share GROUP BY a, b),
{_sql_spans("m0", ASSIGN, 0, 2)},
{_sql_spans("m1", ACCESS, 1)},
{_sql_spans("m2", HEX, 2)},
{_sql_spans("m3", _P.pattern, 3)},
base AS (SELECT rid, kind, start, stop FROM m0 WHERE part >= 12 UNION ALL SELECT rid, kind, start, stop FROM m1 UNION ALL SELECT rid, kind, start, stop FROM m2),
token AS (SELECT rid, start, stop, hit AS text FROM m3 WHERE regexp_matches(hit, '[0-9]')),
step AS (SELECT rid, start, stop, {_CODE.format(at="i")} AS a, {_CODE.format(at="i + 1")} AS b FROM (SELECT *, unnest(range(1, length(text))) AS i FROM token)),
likely AS (SELECT rid, start, stop FROM step JOIN ratio USING (a, b) GROUP BY rid, start, stop HAVING avg(r) >= {_P.ratio}),
spans AS (SELECT * FROM base UNION ALL SELECT l.rid, 3, l.start, l.stop FROM likely l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = l.rid AND b.start < l.stop AND l.start < b.stop)),
line AS (SELECT rid, kind, start, [{", ".join(map(_quote, KINDS))}][kind + 1] || ':' || start || ':' || stop AS t FROM spans),
found AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))},
  string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans FROM line GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}" for name in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (rid)
"""
