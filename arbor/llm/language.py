"""Language identification by prediction by partial matching.

Every language has a context tree over bytes of order 0 to 3 with frozen counts. A byte is coded in the longest context
that the tree has; a context in which it never followed is left by an escape (method C: the number of different followers
against the number of occurrences), and the bytes that followed there are ruled out in the shorter ones, down to a uniform
code over the bytes that the language never had. So the probabilities of all bytes after a context add up to 1. The code
length of a text under a language is the sum of these costs, rounded to 1/256 bit; the language of the shortest code is
predicted.

The trees of all languages are tables keyed by context or by context and byte. The costs of what any language has at order 3
are stored in full; the others are put together from the lower orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm import textbytes as tb
from arbor.llm.common import crc_of_id, fresh, quoted, ship

#: Bytes whose costs are put together in one step.
_PART = 1 << 16
UNKNOWN = "und"
SCALE = 256.0
START, UNSEEN = 0, 1


@dataclass(frozen=True)
class TrainingBounds:
    """Bounds of the labelled sample; scoring reads every byte of every text, and the trees hold whatever the sample has.

    per_language: about so many documents of each language are learned from, chosen by a hash of id and text; longest: those of
    more bytes aren't.
    """

    per_language: int = 400
    longest: int = 1 << 15
    seed: int = 17


class Places:
    """Distinct integer keys and the place of each among them, by a hash table of numpy arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.asarray(keys, dtype=np.int64)
        self.mask = (1 << (4 * len(self.keys) + 1).bit_length()) - 1
        self.table = np.full(self.mask + 1, -1, dtype=np.int32)
        left, slot = np.arange(len(self.keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several for one slot the last one stays
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) & self.mask

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        slot = self._slot(keys)
        found = self.table[slot]
        doubt = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(doubt):
            slot[doubt] = (slot[doubt] + 1) & self.mask
            found[doubt] = self.table[slot[doubt]]
            doubt = doubt[(found[doubt] >= 0) & (self.keys[found[doubt]] != keys[doubt])]
        return found


@dataclass
class ContextTrees:
    """languages: names in order; symbol: of every byte. Of a context there are two numbers for each language: what a symbol costs
    in bits that follows the next shorter one (``own``), besides its count there, and what one costs that doesn't (``out``).
    All are arrays with a row for each place and a column for each language.
    """

    languages: list[str]
    symbol: np.ndarray
    size: int
    own1: np.ndarray  # by symbol: order 0 after it
    out1: np.ndarray
    bare1: np.ndarray  # by symbol: order 1 without a longer context
    bare_out1: np.ndarray
    pair: np.ndarray  # by two symbols: less the log of the count, or the whole cost of lower orders
    has_pair: np.ndarray
    contexts2: Places
    own2: np.ndarray
    out2: np.ndarray
    bare2: np.ndarray
    bare_out2: np.ndarray
    triples: Places
    triple: np.ndarray
    has_triple: np.ndarray
    contexts3: Places
    own3: np.ndarray
    out3: np.ndarray
    grams: Places
    costs: np.ndarray  # in 1/256 bit

    def below2(self, c2: np.ndarray, c1: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Bits of symbols that order 2 doesn't have after its context: what orders 1, 0 and the rest make of them."""
        at, p = self.contexts2.of(c2 * self.size + c1), c1 * self.size + s
        known = (at >= 0)[:, None]
        own, out = np.where(known, self.own2[at], self.bare1[c1]), np.where(known, self.out2[at], self.bare_out1[c1])
        return np.where(self.has_pair[p], own, out) + self.pair[p]

    def below3(self, c3: np.ndarray, c2: np.ndarray, c1: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Bits of symbols that order 3 doesn't have after its context."""
        short = c2 * self.size + c1
        at, at2, t = self.contexts3.of(c3 * self.size**2 + short), self.contexts2.of(short), self.triples.of(short * self.size + s)
        known, known2, has = (at >= 0)[:, None], (at2 >= 0)[:, None], (t >= 0)[:, None]
        own = np.where(known, self.own3[at], np.where(known2, self.bare2[at2], 0.0))
        out = np.where(known, self.out3[at], np.where(known2, self.bare_out2[at2], 0.0))
        return np.where(has & self.has_triple[t], own, out) + np.where(has, self.triple[t], self.below2(c2, c1, s))


def _grams(texts: list[np.ndarray], symbol: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of four symbols in a row and how often they occur, counted in blocks of texts. START precedes every text."""
    kinds, counts, block, size = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [], 0
    for i, text in enumerate(texts):
        block.append(text)
        size += len(text) + 3
        if size < tb.BLOCK and i + 1 < len(texts):
            continue
        runs = [np.concatenate([np.zeros(3, dtype=np.int64), symbol[t].astype(np.int64)]) for t in block]
        s = np.concatenate(runs)
        g = ((s[:-3] * a + s[1:-2]) * a + s[2:-1]) * a + s[3:]
        keep = np.ones(len(g), dtype=bool)  # no gram reaches from one text into the next
        ends = np.cumsum([len(r) for r in runs])[:-1]
        for j in (1, 2, 3):
            keep[ends - j] = False
        found, n = np.unique(g[keep], return_counts=True)
        kinds.append(found.astype(np.int64))
        counts.append(n)
        block, size = [], 0
    return _summed(np.concatenate(kinds), np.concatenate(counts))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, weights=n, minlength=len(kinds))


class _Order:
    """Counts of one language at one order: of symbols after a context, and of contexts with what a longer one leaves of them."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, a: int, order: int) -> None:
        self.grams, self.n, self.a = grams, n, a
        self.place, (self.contexts, self.total) = Places(grams), _summed(grams // a, n)
        self.kinds = np.bincount(np.searchsorted(self.contexts, grams // a), minlength=len(self.contexts)).astype(np.float64)
        self.at, self.cut = Places(self.contexts), a**order

    def count(self, grams: np.ndarray) -> np.ndarray:
        at = self.place.of(grams)
        return np.where(at >= 0, self.n[at] if len(self.n) else 0.0, 0.0)

    def parts(self, contexts: np.ndarray, longer: _Order | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(own, out) in bits after contexts of this order, or of the longer one, whose symbols are then ruled out here. By
        method C a context is left with the number of its different symbols against that of all; without any it costs nothing.
        """
        at = self.at.of(contexts % self.cut)
        total, kinds = (np.where(at >= 0, x[at] if len(x) else 0.0, 0.0) for x in (self.total, self.kinds))
        if longer is not None and len(longer.contexts):
            known = longer.at.of(contexts)
            shared = np.bincount(np.searchsorted(longer.contexts, longer.grams // self.a), weights=self.count(longer.grams % (self.cut * self.a)), minlength=len(longer.contexts))
            total, kinds = total - np.where(known >= 0, shared[known], 0.0), kinds - np.where(known >= 0, longer.kinds[known], 0.0)
        own = np.log2(np.maximum(total + kinds, 1.0))
        return own, np.where(kinds > 0, own - np.log2(np.maximum(kinds, 1.0)), 0.0)


def fit(texts: list[str], langs: list[str]) -> ContextTrees:
    """Context trees of labelled texts. Without any text the model has no language and predicts ``und``."""
    languages = sorted(set(langs))
    data = [np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8) for t in texts]
    seen = np.flatnonzero(sum((np.bincount(d, minlength=256) for d in data), np.zeros(256, dtype=np.int64)))
    symbol = np.full(256, UNSEEN, dtype=np.int64)  # bytes that no text has cost the same after every context, so one symbol does for them
    symbol[seen] = np.arange(2, 2 + len(seen))
    a = 2 + len(seen)
    orders = []
    for lang in languages:
        g, n = _grams([d for d, x in zip(data, langs, strict=True) if x == lang], symbol, a)
        orders.append([_Order(*_summed(g % a ** (k + 1), n), a, k) for k in range(4)])
    wide = max(1, len(languages))
    stacked = lambda rows, parts: np.stack(parts, axis=1) if parts else np.zeros((rows, wide))
    union = lambda k, contexts: np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *((o[k].contexts if contexts else o[k].grams) for o in orders)]))

    def both(keys: np.ndarray, short: int, longer: int | None) -> tuple[np.ndarray, np.ndarray]:
        found = [o[short].parts(keys, None if longer is None else o[longer]) for o in orders]
        return stacked(len(keys), [f[0] for f in found]), stacked(len(keys), [f[1] for f in found])

    def counts(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Less the logs of counts, and where there are any."""
        n = stacked(len(keys), [o[k].count(keys) for o in orders])
        return -np.log2(np.maximum(n, 1.0)), n > 0

    one = np.arange(a, dtype=np.int64)
    own1, out1 = both(one, 0, 1)
    out1 = out1 + np.log2(np.maximum(256.0 - np.array([[len(o[0].grams) for o in orders] or [0]]), 1.0))
    bare1, bare_out1 = both(one, 1, None)
    two = np.arange(a * a, dtype=np.int64)
    log0, has0 = counts(one, 0)
    log1, has_pair = counts(two, 1)
    rest = np.where(has0[two % a], own1[two // a], out1[two // a]) + log0[two % a]
    pair = np.where(has_pair, log1, rest)
    keys2 = union(2, True)
    own2, out2 = both(keys2, 1, 2)
    bare2, bare_out2 = both(keys2, 2, None)
    keys3 = union(3, True)
    own3, out3 = both(keys3, 2, 3)
    leave3 = both(keys3, 3, None)
    triples, grams = union(2, False), union(3, False)
    none = Places(np.zeros(0, dtype=np.int64))
    pad = lambda x: x if len(x) else np.zeros((1, wide), dtype=x.dtype)
    model = ContextTrees(
        languages, symbol, a, own1, out1, bare1, bare_out1, pair, has_pair, Places(keys2), *map(pad, (own2, out2, bare2, bare_out2)), none, np.zeros((1, wide)), np.zeros((1, wide), dtype=bool),
        Places(keys3), pad(own3 + leave3[1]), pad(out3 + leave3[1]), none, np.zeros((1, wide), dtype=np.int32),
    )
    log2_, has = counts(triples, 2)
    lower = model.below2(triples // (a * a), triples // a % a, triples % a)
    model.triples, model.triple, model.has_triple = Places(triples), pad(np.where(has, log2_, lower)), pad(has)
    log3, has = counts(grams, 3)
    lower = model.below3(grams // a**3, grams // a**2 % a, grams // a % a, grams % a)
    here = leave3[0][np.searchsorted(keys3, grams // a)] if len(grams) else np.zeros((0, wide))
    model.grams, model.costs = Places(grams), pad(np.rint(np.where(has, here + log3, lower) * SCALE).astype(np.int32))
    return model


def code_lengths(model: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages) code lengths in 1/256 bit, as exact integers."""
    docs, a = len(offsets) - 1, model.size
    out = np.zeros((docs, model.costs.shape[1]), dtype=np.int64)
    n = len(data)
    for lo in range(0, n, tb.BLOCK):
        hi = min(lo + tb.BLOCK, n)
        back = min(lo, 3)
        s = np.zeros(hi - lo + 3, dtype=np.int64)
        s[3 - back :] = model.symbol[data[lo - back : hi]]
        c3, c2, c1 = s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy()
        i, j = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
        first = np.unique(offsets[max(0, np.searchsorted(offsets, lo - 2, side="left")) : j])
        for k, past in ((0, (c1, c2, c3)), (1, (c2, c3)), (2, (c3,))):  # what lies before the start of a text is START
            at = first + k
            limit = np.append(first[1:], n) if len(first) else first
            at = at[(at < limit) & (at >= lo) & (at < hi)] - lo
            for c in past:
                c[at] = START
        at = model.grams.of(((c3 * a + c2) * a + c1) * a + s[3:])
        cost = model.costs[at]
        new = np.flatnonzero(at < 0)
        for part in np.array_split(new, -(-len(new) // _PART) or 1):
            if len(part):
                cost[part] = np.rint(model.below3(c3[part], c2[part], c1[part], s[3:][part]) * SCALE)
        begins = np.concatenate([[lo], offsets[i + 1 : j]]) - lo
        has = np.flatnonzero(np.diff(np.append(begins, hi - lo)) > 0)
        out[i + has] += np.add.reduceat(cost, begins[has], axis=0, dtype=np.int64)
    return out


def posterior(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the shortest code (ties: the first language) and its share of the total probability."""
    best = bits.argmin(axis=1)
    gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) / SCALE, 1000.0)
    return best, 1.0 / np.exp2(-gap).sum(axis=1)


def _scoring(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ContextTrees = shared.value
        names = np.array(model.languages or [UNKNOWN], dtype=object)
        for batch in batches:
            data, offs = tb.buffers(batch.column(batch.num_columns - 1))
            best, share, rate = [], [], []
            for lo, hi in tb.spans(offs):
                bits = code_lengths(model, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                i, p = posterior(bits)
                best.append(names[i])
                share.append(p)
                rate.append(bits.min(axis=1) / SCALE / np.maximum(np.diff(offs[lo : hi + 1]), 1))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(cat(best).astype(object), pa.string()), pa.array(cat(share).astype(np.float64)), pa.array(cat(rate).astype(np.float64))],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"],
            )

    return score


def has_letter(text: Column) -> Column:
    """Whether a text has a Unicode letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, lang: Column, text: Column, id_col: Column, bounds: TrainingBounds) -> tuple[list[str], list[str]]:
    """The bounded sample that is learned from: counts by language first, then about ``per_language`` rows each by hash.

    Rows come in a fixed order, whatever the partitions; copies of one text may be taken more than once. Null and long texts
    (``longest``) aren't taken.
    """
    rows = docs.select(lang.alias("lang"), text.alias("text"), id_col.alias("id")).where(F.col("lang").isNotNull() & (F.octet_length("text") <= bounds.longest))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], []
    u = F.pmod(F.xxhash64("id", "text", F.lit(bounds.seed)), F.lit(1_000_000))
    rate = F.lit(0)
    for name, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == name, F.lit(min(1_000_000, -(-1_000_000 * bounds.per_language // n)))).otherwise(rate)
    hashed = rows.where(u < rate).withColumn("h", F.xxhash64("id", "text"))
    taken = hashed.orderBy("h", "lang", "text").limit(2 * bounds.per_language * len(sizes)).collect()
    return [r["text"] for r in taken], [r["lang"] for r in taken]


def identify(docs: DataFrame, model: ContextTrees, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with lang_pred, score and bits_per_byte (names that ``docs`` has are replaced).

    lang_pred is ``und`` (score 0) for a null text, one without a letter, or if the model has no language; score: the
    share of the predicted language in the total probability, 1 when the codes of the others are much longer.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "bits_per_byte")
    kept = [c for c in docs.columns if c.lower() not in new]
    text = fresh(docs, "ppm_text")
    letter = fresh(docs, "ppm_letter")
    inner = docs.select(*map(quoted, kept), has_letter(quoted(text_col).cast("string")).alias(letter), quoted(text_col).cast("string").alias(text))
    fields = inner.schema
    schema = type(fields)([f for f in fields if f.name != text]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    out = inner.mapInArrow(_scoring(shared), schema)
    known = quoted(letter) & F.lit(bool(model.languages))
    return out.select(
        *map(quoted, kept), F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), F.when(known, F.col("bits_per_byte")).alias("bits_per_byte")
    )


def train_on(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", held_out: Column | None = None, bounds: TrainingBounds | None = None) -> ContextTrees:
    """Trees learned from the labelled rows of ``docs`` that aren't held out (by default crc32(id) mod 3 = 1)."""
    b = bounds or TrainingBounds()
    out = held_out if held_out is not None else crc_of_id(quoted(id_col)) % 3 == 1
    texts, langs = training_rows(docs.where(~out), quoted(lang_col), quoted(text_col).cast("string"), quoted(id_col), b)
    return fit(texts, langs)
