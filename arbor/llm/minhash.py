"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, distributed components.

DartMinHash throws darts at the region above every weighted element: the number of darts in a cell of rank and weight is
a Poisson draw hashed from element and cell, so equal elements of different documents receive equal darts. A dart counts for
a document where its height lies below the element's weight. Every dart has a rank and one of ``k`` coordinates; each
coordinate keeps its earliest dart. Cells are opened in order of rank only until all coordinates are filled, which makes the
cost of a document proportional to its elements plus ``k log k``.

Weights are sums of layers, and a layer of an element is a 64-bit number whose lowest byte is the layer's weight in UNITS of
a whole one. So weighted Jaccard similarity is exact arithmetic on sets of such numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbor.llm import textbytes as tb
from arbor.llm.common import drop_shared, fresh, materialize, quoted, ship, text_key, write_shared

U64 = np.uint64
EMPTY = U64(2**64 - 1)
#: log2 of the widths of the first cells; the following cells are one wide.
_FIRST = 5


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands: at 0.8 all but 3e-5."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    #: Weight of a shingle that occurs c times: "log": 1 + ln c, rounded to 1 / UNITS; "count": c; "set": 1.
    weights: str = "log"
    #: Buckets of up to so many members are compared pair by pair; a shingle in up to so many texts is rare.
    small: int = 8
    rare: int = 8

    def __post_init__(self) -> None:
        if self.weights not in ("log", "count", "set"):
            raise ValueError(f"weights: {self.weights!r} is none of 'log', 'count', 'set'")


def _poisson_cdf(mean: float) -> np.ndarray:
    term, total, out = math.exp(-mean), 0.0, []
    for j in range(1, 18):
        total += term
        out.append(total)
        term *= mean / j
    return np.array(out)


#: Parts of a whole weight. A layer weighs from 1 to UNITS of them.
UNITS = 16
_LAYER = U64(0xD1342543DE82EF95)


def layers(most: int, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """For counts up to ``most``: the counts at which a weight grows, from 1, and by how many units."""
    if weights == "set":
        return np.ones(1, dtype=np.int64), np.full(1, UNITS)
    if weights == "count":
        return np.arange(1, most + 1), np.full(most, UNITS)
    top = math.floor(UNITS * (1 + math.log(max(1, most)))) + 1
    grows = np.ceil(np.exp((np.arange(UNITS, top + 1) - 0.5) / UNITS - 1)).astype(np.int64)
    grows = np.unique(np.clip(grows, 1, None))
    grows = grows[grows <= max(1, most)]
    return grows, np.diff(np.rint(UNITS * (1 + np.log(grows))).astype(np.int64), prepend=0)


def weighted(elements: np.ndarray, counts: np.ndarray, weights: str = "log") -> tuple[np.ndarray, np.ndarray]:
    """Layers of the different elements of every document, each a number with its weight in units as lowest byte, and how many
    a document has. ``elements``: hashes in order of documents, as often as they occur."""
    doc = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) <= 1 << 16 else np.int64), counts)
    order = np.argsort(elements)
    order = order[np.argsort(doc[order], kind="stable")]  # by counting where documents are few
    e, d = elements[order], doc[order]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(e)))
    grows, units = layers(int(times.max(initial=1)), weights)
    many = np.searchsorted(grows, times, side="right")
    first = np.repeat(at, many)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    out = e[first]
    more = nth > 0
    out[more] = tb.mix(out[more] + grows[nth[more]].astype(np.uint64) * _LAYER)
    return (out & ~U64(255)) | units[nth].astype(np.uint64), np.bincount(d[first], minlength=len(counts))


def dart_signatures(elements: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) identities of the earliest dart of each coordinate; a document without elements has EMPTY ones.

    ``elements``: layers as of :func:`weighted`; a repeated one adds nothing. A dart of a layer has a height, and is thrown
    away above the layer's weight.
    """
    docs = len(counts)
    sig = np.full(docs * k, EMPTY)
    doc = np.repeat(np.arange(docs, dtype=np.int64), counts)
    cell = 0
    while len(elements):
        width = 2.0 ** (max(cell, 1) - 1 - _FIRST) if cell <= _FIRST else 1.0
        cdf = _poisson_cdf(width)
        u = tb.mix(elements + tb.mix(np.array([cell * 2 + 1], dtype=np.uint64))[0])
        hit = np.flatnonzero(u > U64(int(cdf[0] * 2.0**64)))
        if len(hit):
            seed = u[hit]
            n = 1 + np.searchsorted(cdf[1:], seed.astype(np.float64) / 2.0**64, side="left")
            place = np.repeat(hit, n)
            nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            dart = tb.mix(elements[place] ^ tb.mix(np.repeat(seed, n) + (nth.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)))
            below = (tb.mix(dart ^ _LAYER) >> U64(60)) < (elements[place] & U64(255))  # UNITS heights
            dart, place = dart[below], place[below]
            at = doc[place] * k + (dart % U64(k)).astype(np.int64)
            free = sig[at] == EMPTY
            np.minimum.at(sig, at[free], tb.mix(dart[free] + U64(cell)))  # a bijection of the dart: its rank in the cell and its identity
        cell += 1
        if cell >= 3:
            done = ~(sig.reshape(docs, k) == EMPTY).any(axis=1)
            stay = ~done[doc]
            elements, doc = elements[stay], doc[stay]
    return sig.reshape(docs, k)


def band_keys(signatures: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) 64-bit keys; documents without elements get keys too, which the caller leaves out."""
    places = tb.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | U64(1)
    mixed = (signatures * places).reshape(len(counts), bands, rows).sum(axis=2, dtype=np.uint64)
    return tb.mix(mixed + np.arange(bands, dtype=np.uint64))


def _list_column(values: np.ndarray, lengths: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))
    return out if mask is None else pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([mask, [False]])), out.values)


def _elements(data: np.ndarray, offs: np.ndarray, p: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    words, n = tb.word_hashes(data, offs)
    return weighted(*tb.shingles(words, n, p.words), p.weights)


def _signing(p: NearDuplicates):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.buffers(batch.column(2))
            for lo, hi in tb.spans(offs, 8 * tb.BLOCK):
                e, counts = _elements(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], p)
                keys = band_keys(dart_signatures(e, counts, p.bands * p.rows), counts, p.bands, p.rows)
                has = counts > 0
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), _list_column(keys[has].ravel(), np.where(has, p.bands, 0))], names=["key", "id", "bands"])

    return sign


def _shingling(p: NearDuplicates):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.buffers(batch.column(1))
            for lo, hi in tb.spans(offs):
                e, counts = _elements(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], p)
                ends = np.concatenate([[0], np.cumsum((e & U64(255)).astype(np.int64))])[np.concatenate([[0], np.cumsum(counts)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _list_column(e, counts), pa.array(np.diff(ends))], names=["key", "set", "weight"])

    return shingle


def _meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join by sorting both sides, which holds at any size and which Spark splits where a key is hot and both are stored."""
    return left.join(right.hint("merge"), on, how)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, before: DataFrame | None = None, name: str = "components") -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)`` but the roots; a root is the smallest node that is reachable.

    before: an earlier result, to which the edges are added. Alternates large-star and small-star steps, each one aggregation
    and one join, until all edges are stars, and writes every round to the shared folder; no edge comes to the driver.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if before is not None:
        edges = edges.unionByName(before.select(F.col("node").alias("u"), F.col("root").alias("v")))
    edges = edges.distinct()
    kind = edges.schema
    path = write_shared(edges, name)
    while not _are_stars(e := spark.read.schema(kind).parquet(path)):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = _meet(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _meet(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = write_shared(small, name)
        drop_shared(spark, path)
        path = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _units(layers_: Column) -> Column:
    return F.aggregate(layers_, F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(F.lit(255)))


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """``(a, b, sim)`` of pairs of keys: weighted Jaccard similarity of all shingles, written to the shared folder."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"), F.col("weight").alias("weight_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"), F.col("weight").alias("weight_b"))
    both = _meet(_meet(pairs, left, "a"), right, "b").withColumn("both", _units(F.array_intersect("set_a", "set_b")))
    whole = F.col("weight_a") + F.col("weight_b") - F.col("both")
    return materialize(both.select("a", "b", (F.col("both") / F.greatest(whole, F.lit(1))).alias("sim")), name)


def _near(tested: DataFrame, p: NearDuplicates) -> DataFrame:
    return tested.where(F.col("sim") >= p.similarity).select("a", "b")


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _open_buckets(members: DataFrame, stars: DataFrame) -> DataFrame:
    """``members(h, key, m)`` of the buckets with more than one class, with the class (root) of each, and that of the bucket's
    smallest key (top), with which the others were compared first."""
    roots = stars.select(F.col("node").alias("key"), "root")
    labelled = materialize(_meet(members, roots, "key", "left").select("h", "key", "m", F.coalesce("root", "key").alias("root")), "labelled")
    tops = labelled.groupBy("h").agg(F.min(F.struct("key", "root")).alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return materialize(_meet(labelled, materialize(tops.select("h", F.col("first.root").alias("top")), "tops"), "h"), "open")


def _small_candidates(small: DataFrame) -> DataFrame:
    """Pairs of different classes in buckets of few members: each is compared with all others."""
    outside = small.where("root <> top").select("h", F.col("key").alias("x"), F.col("root").alias("root_x"))
    return _pair(_meet(outside, small, "h").where("root_x <> root"), "x", "key")


def _tokens(large: DataFrame, sets: DataFrame, p: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """For the texts of large buckets, ``(key, weight, token, n)`` of the layers that n of them have, n > 1, and by text
    ``(key, weight, common, shared)``: the units of all its layers, of the common ones (in more than ``p.rare`` texts) and of
    those in any other text. A text that shares nothing is left out, as nothing is similar to it.
    """
    each = _meet(sets, large.select("key").distinct(), "key", "left_semi").select("key", "weight", F.explode("set").alias("token"))
    spread = each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    tokens = materialize(_meet(each, materialize(spread, "spread"), "token"), "tokens")
    units = F.col("token").bitwiseAND(F.lit(255))
    common = F.sum(F.when(F.col("n") > p.rare, units).otherwise(0))
    return tokens, materialize(tokens.groupBy("key", "weight").agg(common.alias("common"), F.sum(units).alias("shared")), "counts")


def _consensus_candidates(large: DataFrame, counts: DataFrame) -> DataFrame:
    """Members of large buckets with the one that has most of what is common there and least else."""
    known = materialize(_meet(large, counts, "key").select("h", "key", "root", (2 * F.col("common") - F.col("weight")).alias("score")), "known")
    best = materialize(known.groupBy("h").agg(F.max(F.struct("score", "key", "root")).alias("best")).select("h", F.col("best.key").alias("center"), F.col("best.root").alias("center_root")), "best")
    return _pair(_meet(known, best, "h").where("root <> center_root"), "key", "center")


def _proof_candidates(large: DataFrame, tokens: DataFrame, counts: DataFrame, p: NearDuplicates) -> DataFrame:
    """Pairs of different classes in large buckets that can be similar; for all others their counts prove that they aren't.

    A similar pair has ``similarity`` of the heavier text in common, so a text that shares less with all others together has no
    partner. A pair that shares a rare layer (in at most ``p.rare`` texts, which bounds its pairs) is found by that; it stays if
    what they share so, and the common layers of the poorer one, suffice. Any other pair shares common layers alone, and both
    have enough of those. These have one order, those that fewest texts have first: without one in
    common among the first of both, up to where less than that share of a text is left, a pair can't be similar, nor if its
    common part there and the rest of the one that ends first are too little. Common layers that a single class has there make
    no pairs, and only texts outside the first class of a bucket ask, as every pair of different classes has one.
    """
    who = large.groupBy("key").agg(F.min("root").alias("root"), F.max((F.col("root") != F.col("top")).cast("int")).alias("asks"))
    room = F.col("weight") * (1 - p.similarity) + 1e-6
    units = F.col("token").bitwiseAND(F.lit(255))
    alive = _meet(who, counts, "key").where(F.col("weight") - F.col("shared") <= room).select("key", "root", "asks", "common")
    each = materialize(_meet(tokens, alive, "key"), "alive")
    need = F.lit(p.similarity / (1 + p.similarity)) * (F.col("weight_x") + F.col("weight")) - 1e-6

    def met(rows: DataFrame, more: list[str], able: Column) -> DataFrame:
        """Pairs of an asking row and another of a different class that are able, with what they share in units."""
        asking = rows.where("asks = 1").select("token", *(F.col(c).alias(f"{c}_x") for c in ("key", "root", "weight", *more)))
        fit = (F.col("weight") >= F.col("weight_x") * p.similarity - 1e-6) & (F.col("weight_x") >= F.col("weight") * p.similarity - 1e-6)
        pairs = _meet(asking, rows, "token").where((F.col("root_x") != F.col("root")) & fit & able)
        return pairs.groupBy("key_x", "key", "weight_x", "weight", *(x for c in more for x in (f"{c}_x", c))).agg(F.sum(units).alias("met"))

    rare = met(each.where(F.col("n") <= p.rare), ["common"], F.lit(True)).where(F.col("met") + F.least("common_x", "common") >= need)
    ahead = F.sum(units).over(Window.partitionBy("key").orderBy("n", "token")) - units + F.col("weight") - F.col("common")
    first = each.where((F.col("n") > p.rare) & (F.col("weight") - F.col("common") <= room)).withColumn("ahead", ahead).where(F.col("ahead") <= room)
    end = F.max(F.struct("n", "token", (F.col("weight") - F.col("ahead") - units).alias("rest"))).over(Window.partitionBy("key"))
    first = materialize(first.withColumn("end", end).select("token", "key", "root", "asks", "weight", "common", "end"), "prefixes")
    mixed = first.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("asks").alias("asked")).where("lo <> hi and asked = 1")
    first = materialize(_meet(first, materialize(mixed.select("token"), "mixed"), "token"), "mixed_prefixes")
    common = met(first, ["common", "end"], F.least("common_x", "common") >= need).where(F.col("met") + F.least("end_x", "end")["rest"] >= need)
    return _pair(rare, "key_x", "key").unionByName(_pair(common, "key_x", "key")).distinct()


def text_classes(unique: DataFrame, texts: DataFrame, p: NearDuplicates) -> DataFrame:
    """``(node, root)`` of the keys of all texts that a chain of links joins to another text, root being the least key.

    ``unique(key, id, bands)``: one row per text; ``texts(key, id, text)``: a row of that key and id at least. First the
    members of a bucket are compared with its least key, which joins most groups with one pair for each member. Two texts may
    be alike and yet unlike that one, so buckets that still hold more than one class are gone through: those of up to
    ``p.small`` members pair by pair; larger ones by a second center, the text nearest to what the bucket has in common, and
    then by :func:`_proof_candidates`. No bucket has a cap: every pair of a bucket is in one class, is compared, or can't be
    similar. Where no bucket is open any more, the later steps have nothing to do and are left out.
    """
    entry = unique.select("key", F.explode("bands").alias("h"))
    buckets = materialize(entry.groupBy("h").agg(F.min("key").alias("center"), F.count("*").alias("m")).where("m > 1"), "buckets")
    members = materialize(_meet(entry, buckets, "h"), "members")
    pairs = members.where("key <> center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()
    wanted = _meet(members.select("key").distinct(), unique.select("key", F.col("id").alias("first_id")), "key").withColumnRenamed("key", "first_key")
    # one row of every text, so that copies don't travel
    needed = _meet(texts, wanted, (F.col("key") == F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = needed.select("key", "text").mapInArrow(_shingling(p), "key binary, set array<bigint>, weight bigint")
    sets = materialize(sets.groupBy("key").agg(F.first("set").alias("set"), F.first("weight").alias("weight")), "sets")
    tested = _verified(pairs, sets, "tested")

    def test(candidates: DataFrame) -> DataFrame:
        return _verified(_meet(candidates, tested.select("a", "b"), ["a", "b"], "left_anti"), sets, "tested")

    stars = components(_near(tested, p))
    open_ = _open_buckets(members.select("h", "key", "m"), stars)
    if open_.isEmpty():
        return stars
    large = open_.where(F.col("m") > p.small)
    candidates, some = _small_candidates(open_.where(F.col("m") <= p.small)), not large.isEmpty()
    if some:
        tokens, counts = _tokens(large, sets, p)
        candidates = candidates.unionByName(_consensus_candidates(large, counts)).distinct()
    again = test(candidates)
    stars = components(_near(again, p), stars)
    if some:
        tested = tested.unionByName(again)
        large = _open_buckets(large.select("h", "key", "m"), stars)
        if not large.isEmpty():
            stars = components(_near(test(_proof_candidates(large, tokens, counts, p)), p), stars)
    return stars


def _signed(docs: DataFrame, id_col: str, text_col: str, p: NearDuplicates) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(key, id, bands)`` of every row (key null for a null text), ``unique(key, none, id, n, bands)`` of every text with
    its least id, nulls last, and how many rows have it, and ``(node, root)`` of :func:`text_classes`."""
    ship(docs.sparkSession)
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    texts = base.select("key", "id", "text")
    schema = type(texts.schema)([f for f in texts.schema if f.name != "text"]).add("bands", T.ArrayType(T.LongType()))
    rows = materialize(texts.mapInArrow(_signing(p), schema), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    unique = rows.where("key is not null").groupBy("key").agg(first, F.count("*").alias("n"), F.first("bands").alias("bands"))
    unique = materialize(unique.select("key", "first.none", "first.id", "n", "bands"), "unique")
    return rows, unique, text_classes(unique, texts.where("key is not null"), p)


def _classes(unique: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, root)`` of every text, and ``(root, first, class_size)`` of every class, first being its least (none, id, key)."""
    by_text = _meet(unique.select("key", "none", "id", "n"), stars, F.col("key") == F.col("node"), "left")
    by_text = materialize(by_text.select("key", "none", "id", "n", F.coalesce("root", "key").alias("root")), "texts")
    return by_text, by_text.groupBy("root").agg(F.min(F.struct("none", "id", "key")).alias("first"), F.sum("n").alias("class_size"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDuplicates | None = None) -> DataFrame:
    """One row per input row: ``(id, text_key, class_id, class_size, keep)``.

    class_id: the smallest id of the class; a class holds equal texts and texts that a chain of links joins.
    keep: true for rows with the smallest (id, text) of their class; repeated rows that agree in both keep together.
    A null text is in a class of its own row's id with size 1, text_key null and keep true. Equal texts without words are
    one class. Ids may be null or repeated: a null id is never chosen while another is there.
    """
    rows, unique, stars = _signed(docs, id_col, text_col, params or NearDuplicates())
    by_text, classes = _classes(unique, stars)
    # by text, by class: each is stored, so that joins back are between two plain shuffles, of which Spark splits a hot key
    classed = materialize(_meet(by_text.select("key", "root"), materialize(classes, "classes"), "root").drop("root"), "classed")
    known = _meet(rows.where("key is not null").select("id", "key"), classed, "key")
    keep = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    known = known.select("id", "key", F.col("first.id").alias("class_id"), "class_size", keep.alias("keep"))
    none = rows.where("key is null").select("id", "key", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep"))
    return known.unionByName(none).select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "class_id", "class_size", "keep")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDuplicates | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of every class; rows with a null text stay."""
    rows, unique, stars = _signed(docs, id_col, text_col, params or NearDuplicates())
    _, classes = _classes(unique, stars)
    key, own, cid = fresh(docs, "near_key"), fresh(docs, "near_own"), fresh(docs, "near_id")
    chosen = materialize(classes.select(F.col("first.id").alias(cid), F.col("first.key").alias(key)), "chosen")
    keyed = docs.withColumn(own, text_key(quoted(text_col).cast("string")))
    kept = _meet(keyed, chosen, (quoted(own) == F.col(key)) & quoted(id_col).eqNullSafe(F.col(cid)), "left_semi")
    same = rows.where("key is not null").groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if not _meet(same, chosen, (F.col("key") == F.col(key)) & F.col("id").eqNullSafe(F.col(cid)), "left_semi").isEmpty():
        kept = kept.dropDuplicates([id_col, own])  # the same id and text more than once: one of those rows
    return kept.select(*map(quoted, docs.columns)).unionByName(docs.where(quoted(text_col).isNull()))
