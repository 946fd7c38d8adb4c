"""TF-IDF with idf = ln(N / (df + 1)), without smoothing of the numerator, over pluggable tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.plans.storage import store

#: Bytes of terms and their figures that a join sends to all executors; terms beyond that are joined by a shuffle.
BROADCAST_BYTES = 48 << 20

#: Characters that mean something in a pattern, as themselves.
_ESCAPE = {c: f"\\{c}" for c in r".^$*+?()[]{}\|-/"}


def white_space(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def char_ngrams(n: int = 2) -> Callable[[Column], Column]:
    """Character n-grams of unspaced text: a stand-in where there is no word segmenter for a script."""

    def tokens(text: Column) -> Column:
        s = F.regexp_replace(text, r"\s+", "")
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.filter(F.array(s), lambda t: t != ""))

    return tokens


def longest_matches(lexicon: Iterable[str]) -> Callable[[Column], Column]:
    """Words of unspaced text by the caller's lexicon: at every place the longest word that fits, else a run of ASCII letters and
    digits, else a single character; white space separates.

    The lexicon becomes one pattern with a branch for each shared beginning, so that a place costs a walk down one branch and
    the text stays in compiled functions.
    """
    tree: dict = {}
    for word in lexicon:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        if word:
            at[""] = {}

    def pattern(node: dict) -> str:
        below = "|".join(_ESCAPE.get(c, c) + pattern(n) for c, n in sorted(node.items()) if c)
        return f"(?:{below})" + ("?" if "" in node else "") if below else ""

    word = pattern(tree)
    any_token = f"{word}|[A-Za-z0-9]+|\\S" if word else "[A-Za-z0-9]+|\\S"
    return lambda text: F.regexp_extract_all(text, F.lit(any_token), F.lit(0))


def terms(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space) -> DataFrame:
    """``(doc_id, pos, term)``; documents with a null text have none."""
    return docs.where("text is not null").select("doc_id", F.posexplode(tokenizer(F.col("text"))).alias("pos", "term"))


def rounded(value: Column, digits: int) -> Column:
    """``value`` to so many digits, halves away from 0, by arithmetic on doubles, as SQL engines round them; Spark's ``round`` prints
    and parses a decimal for each value.
    """
    unit = F.lit(10.0**digits)
    return F.signum(value) * F.floor(F.abs(value) * unit + 0.5) / unit


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value made once, however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def _runs(tokens: Column) -> Column:
    """``(doc_terms, of: [(term, count)])`` of a row's tokens, null without any: sorted, with a run of equal ones up to each end."""

    def counted(s: Column) -> Column:
        last = F.size(s) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ~s[i].eqNullSafe(F.get(s, i + 1)))
        return _let(ends, lambda e: F.transform(e, lambda i, k: F.struct(s[i].alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("long").alias("count"))))

    return _let(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, F.struct(F.size(s).cast("long").alias("doc_terms"), counted(s).alias("of"))))


def _by_row(docs: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, term, count, doc_terms)`` of each row for itself, without a shuffle. Rows without tokens leave after the outer
    generator: before an inner one Spark would place a filter that counts every row once more.
    """
    rows = docs.where("text is not null").select("doc_id", _runs(tokenizer(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.doc_terms").alias("doc_terms"), F.col("c.of").alias("of")).select("doc_id", "doc_terms", F.inline_outer("of")).where("count is not null").select("doc_id", "term", "count", "doc_terms")


def _apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose doc_id no other row has, and the rest, if any. Only the ids are read for that."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    if ids.isEmpty():
        return docs, None
    same = store(ids, "repeated")[0]
    on = F.col("doc_id").eqNullSafe(F.col("again"))
    return docs.join(same, on, "left_anti"), docs.join(same, on, "left_semi")


def term_counts(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space) -> DataFrame:
    """``(doc_id, term, count, doc_terms)``. A document is counted inside its row; only rows that share their doc_id are shuffled,
    by what each has counted.
    """
    once, again = _apart(docs)
    counts = _by_row(once, tokenizer)
    if again is None:
        return counts
    merged = _by_row(again, tokenizer).groupBy("doc_id", "term").agg(F.sum("count").alias("count"))
    total = merged.groupBy(F.col("doc_id").alias("of")).agg(F.sum("count").alias("doc_terms"))
    return counts.unionByName(merged.join(total, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "term", "count", "doc_terms"))


def _places(docs: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """``(doc_id, term, pos)``, one row for each document and term; ``pos`` orders the terms of a document by first occurrence."""
    once, again = _apart(docs)
    rows = once.where("text is not null").select("doc_id", F.posexplode(F.array_distinct(tokenizer(F.col("text")))).alias("pos", "term")).select("doc_id", "term", "pos")
    return rows if again is None else rows.unionByName(terms(again, tokenizer).groupBy("doc_id", "term").agg(F.min("pos").alias("pos")))


def document_frequency(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space) -> DataFrame:
    return _places(docs, tokenizer).groupBy("term").agg(F.count("*").alias("df"))


def _vocabulary(docs: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """``(term, df, doc, pos)``, stored: how many documents have a term, and its first occurrence. One combining aggregation whose
    buffers have a fixed width, so that it hashes instead of sorting all tokens; a null id comes last.
    """
    places = _places(docs, tokenizer).select("term", "pos", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"))
    return store(places.groupBy("term").agg(F.count("*").alias("df"), F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos")), "vocabulary")[0]


def _numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``term_id``, by range: counts of documents, of blocks of 2^16 ids and of blocks of 2^32 ids, with running sums
    inside each, so that no task holds the vocabulary or all documents.
    """
    levels = [words.groupBy(F.col("doc").alias("d")).agg(F.count("*").alias("n"))]
    for _ in range(2):
        levels.append(levels[-1].groupBy(F.shiftright("d", 16).alias("d")).agg(F.sum("n").alias("n")))
    start = levels[2].select("d", (F.sum("n").over(Window.orderBy("d")) - F.col("n")).alias("start"))
    for level in (levels[1], levels[0]):
        inside = level.select("d", (F.sum("n").over(Window.partitionBy(F.shiftright("d", 16)).orderBy("d")) - F.col("n")).alias("inside"))
        above = start.select(F.col("d").alias("up"), "start")
        start = inside.join(above, F.shiftright("d", 16) == F.col("up")).select("d", (F.col("start") + F.col("inside")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    return words.withColumn("rank", rank).join(start, F.col("doc") == F.col("d")).select("term", "df", (F.col("start") + F.col("rank") - 1).cast("long").alias("term_id"))


def dictionary(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space) -> DataFrame:
    """``(term, term_id)``: terms numbered from 0 in order of their first occurrence, by document id and position."""
    return _numbered(_vocabulary(docs, tokenizer)).select("term", "term_id")


def _looked_up(counts: DataFrame, words: DataFrame) -> DataFrame:
    """``counts`` with the columns of ``words``, a stored table with ``term`` and ``df`` that knows every term.

    Most rows are of terms in many documents. As many of those terms as BROADCAST_BYTES hold are broadcast, and only the rows of
    the rarer ones are shuffled.
    """
    level = F.floor(F.log2("df")).cast("int")
    sizes = words.groupBy(level.alias("level")).agg(F.sum(F.octet_length("term") + 64).alias("bytes")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["bytes"]
        if total > BROADCAST_BYTES:
            break
        least = r["level"]
    if least is None:
        return counts.join(words, "term")
    common = words.where(F.col("df") >= 1 << least)
    found = counts.join(F.broadcast(common), "term")
    if total <= BROADCAST_BYTES:
        return found
    rare = counts.join(F.broadcast(common.select("term")), "term", "left_anti").join(words.where(F.col("df") < 1 << least), "term")
    return found.unionByName(rare)


def _weighed(docs: DataFrame, counts: DataFrame, words: DataFrame) -> DataFrame:
    """``counts`` with tf, idf, tfidf and the columns of ``words``."""
    n = docs.count()
    found = _looked_up(counts, words).withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + 1)))
    return found.withColumn("tf", F.col("count") / F.col("doc_terms")).withColumn("tfidf", F.col("tf") * F.col("idf"))


def tfidf(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space) -> DataFrame:
    """``(doc_id, term, tf, idf, tfidf)``; N counts all rows of ``docs``, also those without terms.

    A term in every document has a negative idf. Counts are stored once, and so are frequencies, with a row for each term.
    """
    counts = store(term_counts(docs, tokenizer), "counts")[0]
    words = store(counts.groupBy("term").agg(F.count("*").alias("df")), "frequency")[0]
    return _weighed(docs, counts, words).select("doc_id", "term", "tf", "idf", "tfidf")


def _joined(weights: DataFrame, digits: int) -> DataFrame:
    """``(doc_id, vector)`` of ``(doc_id, term_id, tfidf)``. Weights are rounded before they are shuffled."""
    short = weights.select("doc_id", "term_id", rounded(F.col("tfidf"), digits).cast(f"decimal(18,{digits})").alias("w"))
    pairs = short.repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("p"))
    return pairs.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat(x["term_id"].cast("string"), F.lit(":"), x["w"].cast("string"))), " ").alias("vector"))


def vectors(weights: DataFrame, ids: DataFrame, digits: int = 6) -> DataFrame:
    """``(doc_id, vector)``: ``id:weight`` of a document's terms in order of id, weights of so many digits, joined by blanks."""
    return _joined(weights.join(ids, "term"), digits)


def document_vectors(docs: DataFrame, tokenizer: Callable[[Column], Column] = white_space, digits: int = 6) -> DataFrame:
    """``vectors`` of ``tfidf`` and ``dictionary``, with one vocabulary for both, looked up once for each row of a term."""
    words = store(_numbered(_vocabulary(docs, tokenizer)), "dictionary")[0]
    counts = store(term_counts(docs, tokenizer), "counts")[0]
    return _joined(_weighed(docs, counts, words), digits)
