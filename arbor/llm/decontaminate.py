"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items are hashed into a set that is broadcast, after its size has been checked; every window
position of the documents probes it inside one generated loop, and the few hits are verified word by word. One shuffle
brings the hits of a document together with its header row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm.common import each_copy, fresh, quoted, text_key

WINDOW = 8
#: Windows that may take more bytes than this in memory aren't broadcast but joined by a shuffle.
MOST_BROADCAST = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; the fast function does for ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hash(words: Column, at: Column | int, length: int) -> Column:
    return F.xxhash64(*(F.get(words, F.lit(i) + at) for i in range(length)))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(len, h, nth, win, items)``, one row for each window; nth counts windows of equal length and hash from 0.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Items of
    null id or without words have none; rows of one id add up.
    """
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), words_of(quoted(text_col).cast("string")).alias("w")).where("item is not null and size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    each = items.select("item", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("win"))
    wins = each.groupBy("len", "win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    h = F.lit(None).cast("long")
    for length in range(1, window + 1):
        h = F.when(F.col("len") == length, _hash(F.col("win"), 0, length)).otherwise(h)
    return wins.groupBy("len", h.alias("h")).agg(F.collect_list(F.struct("win", "items")).alias("wins")).select("len", "h", F.posexplode("wins").alias("nth", "w")).select("len", "h", "nth", "w.*")


def _probes(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for every position and window length that fits, and a header row (head) for every row of ``docs``."""
    each = docs.select("id", "key", "words", F.size("words").alias("n"), F.posexplode_outer("words").alias("pos", "word")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    probe = [F.struct(F.lit(k).alias("len"), F.when(F.col("pos") + k <= F.col("n"), _hash(F.col("words"), F.col("pos"), k)).alias("h")) for k in lengths]
    if len(probe) == 1:
        return each.select("id", "key", "words", "n", "pos", probe[0]["len"].alias("len"), probe[0]["h"].alias("h"), (F.col("pos") == 0).alias("head"))
    rows = each.select("id", "key", "words", "n", "pos", F.inline(F.array(*probe)).alias("len", "h"))
    return rows.withColumn("head", (F.col("pos") == 0) & (F.col("len") == lengths[0]))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs(id, text)`` to one row for each (id, text): ``(id, key, copies, n_words, positions, items)``.

    positions: the word positions that lie in an occurrence of a window, sorted; items: ids with occurring windows, sorted
    as strings; copies: how many rows agree in id and text.
    """
    wins = benchmark_windows(benchmark, window=window)
    # of a row: some 100 bytes, for each of its strings 24 and their bytes
    held = 100 + 24 * (F.size("win") + F.size("items")) + F.octet_length(F.array_join("win", "")) + F.octet_length(F.array_join("items", ""))
    sizes = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.sum(held.cast("long")).alias("n")).collect()}
    lengths = sorted(sizes) or [window]
    tokens = docs.select("id", F.coalesce(text_key(F.col("text")), F.lit(b"")).alias("key"), words_of(F.col("text")).alias("words"))
    probes = _probes(tokens, lengths)
    # compiled expressions only, so that no row with the words of its document leaves the generated loop
    own = F.slice("words", F.col("pos") + 1, F.col("len"))
    if sum(sizes.values()) <= most_broadcast:
        head = F.col("head") & (F.coalesce("nth", F.lit(0)) == 0)
        found = probes.join(F.broadcast(wins), ["len", "h"], "left").select("id", "key", "n", head.alias("head"), "pos", "len", F.when(F.col("win") == own, F.col("items")).alias("items"))
        found = found.where("head or items is not null")
    else:  # the words of a window travel with its hash, and header rows apart
        inner = probes.where("h is not null").withColumn("own", own).select("id", "key", "n", "len", "h", "pos", "own").join(wins, ["len", "h"]).where("own = win")
        inner = inner.select("id", "key", "n", F.lit(False).alias("head"), "pos", "len", "items")
        heads = tokens.select("id", "key", F.size("words").alias("n"), F.lit(True).alias("head"), F.lit(0).alias("pos"), F.lit(1).alias("len"), F.lit(None).cast("array<string>").alias("items"))
        found = heads.unionByName(inner)
    at = F.when(F.col("items").isNotNull(), F.struct("pos", "len", "items"))
    by_doc = found.groupBy("id", "key").agg(F.first("n").alias("n_words"), F.sum(F.col("head").cast("long")).alias("copies"), F.collect_set(at).alias("at"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: x["items"]))))
    return by_doc.select("id", "key", "copies", F.col("n_words").cast("long").alias("n_words"), positions.alias("positions"), items.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    A null or wordless text has no words and no hits. contaminated: windows of ``min_items`` items or more occur.
    """
    rows = hits(docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")), benchmark)
    out = rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        F.col("copies").alias("_copies"),
    )
    return each_copy(out, "_copies", "_copy").drop("_copies", "_copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2) -> DataFrame:
    """``docs``, all columns, without contaminated rows; from rows with windows of fewer items the hit words are cut.

    With a hit word goes what stands between it and the next word. Rows without hits, null texts included, stay as they are.
    """
    rows = hits(docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")), benchmark).where(F.size("positions") > 0)
    key, at, many, rid = (fresh(docs, x) for x in ("hit_key", "hit_at", "hit_many", "hit_id"))
    rows = rows.select(F.col("id").alias(rid), F.col("key").alias(key), F.col("positions").alias(at), (F.size("items") >= min_items).alias(many))
    text = quoted(text_col).cast("string")
    own = fresh(docs, "own_key")
    keyed = docs.withColumn(own, text_key(text))
    both = keyed.join(rows, quoted(id_col).eqNullSafe(F.col(rid)) & (F.col(own) == F.col(key)), "left").where(~F.coalesce(F.col(many), F.lit(False)))
    gaps, words = F.split(text, RAW_WORD, -1), F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))

    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["words"]) - 1), F.col(at))  # by hash: linear in the words
        return F.concat(F.get(x["gaps"], F.lit(0)), F.array_join(F.transform(stay, lambda i: F.concat(F.get(x["words"], i), F.get(x["gaps"], i + 1))), ""))

    # a lambda's variable is made once, while what stands inside the inner lambda is made for every word
    cut = F.get(F.transform(F.array(F.struct(gaps.alias("gaps"), words.alias("words"))), kept), F.lit(0))
    return both.select(*(F.when(F.col(at).isNotNull(), cut).otherwise(quoted(c)).alias(c) if c == text_col else quoted(c) for c in docs.columns))


#: DuckDB SQL of the query's columns.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, w[i : i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0 AND item IS NOT NULL)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, w[i : i + k - 1] AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, dw.k, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
