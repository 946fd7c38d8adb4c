"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u hashed from the row's key and the
child's path, and the smallest draw wins, which picks children in proportion to their weights (a node weighs as much as its
shards). A changed weight alters the draws of the nodes above it alone, so rows move only into subtrees that gain weight and
out of those that lose it; a new region takes rows only into itself. The tree is a literal of the plan.

Slots are counted in two steps, in hash buckets of a shard and over the counts of the buckets, so that no task sorts a shard.
The counts of all buckets, max(BUCKETS, shards) rows at most whatever the input, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import each_copy, materialize, quoted

#: Hash buckets in which slots are counted, shared out among the shards (one at least to each). Their counts are broadcast.
BUCKETS = 98_304


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def grid(regions: int = 3, racks: int = 2, shards: int = 4) -> tuple[Shard, ...]:
    """Shards 0, 1, ... of equal weight, ``shards`` to a rack and ``racks`` to a region."""
    return tuple(Shard(f"region{r}", f"rack{k}", (r * racks + k) * shards + s) for r in range(regions) for k in range(racks) for s in range(shards))


def with_new_region(tree: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """``tree`` and one more shard in a region of its own."""
    n = max((s.shard for s in tree), default=-1) + 1
    return (*tree, Shard(f"added{n}", "rack0", n, weight))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / weight


def _descend(key: Column, path: str, children: list[tuple[str, float, object]]) -> Column:
    """Shard under a node; children: (name, weight, shard or its own children)."""
    children = [c for c in children if c[1] > 0]
    inner = [c[2] if isinstance(c[2], int) else None for c in children]
    results = [F.lit(leaf) if leaf is not None else _descend(key, f"{path}/{name}", sub) for leaf, (name, _, sub) in zip(inner, children, strict=True)]
    if len(children) == 1:
        return results[0]
    draws = F.array(*(F.struct(_draw(key, f"{path}/{name}", weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(children)))
    best = F.array_min(draws)["i"]
    out = results[-1]
    for i in range(len(children) - 2, -1, -1):
        out = F.when(best == i, results[i]).otherwise(out)
    return out


def shard_of(key: Column, tree: tuple[Shard, ...]) -> Column:
    """The shard of a key; shards of weight 0 take nothing. All null keys go to one shard."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    key = F.coalesce(key.cast("string"), F.lit(""))

    def nodes(level: int, of: list[Shard]) -> list[tuple[str, float, object]]:
        if level == 2:
            return [(str(s.shard), s.weight, s.shard) for s in sorted(of, key=lambda s: s.shard)]
        names = sorted({(s.region, s.rack)[level] for s in of})
        split = [(n, [s for s in of if (s.region, s.rack)[level] == n]) for n in names]
        return [(n, sum(s.weight for s in part), nodes(level + 1, part)) for n, part in split]

    return _descend(key, "", nodes(0, live))


def assign(docs: DataFrame, tree: tuple[Shard, ...] | None = None, grown: tuple[Shard, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) and 8 more; text_crc32: of the same bytes; slot: gapless from 0 in its shard,
    in an order of hash bucket, id, crc and size, null ids first; rows equal in all of these have slots in a row.
    grown_shard: the shard under ``grown``, by default ``tree`` and a new region of one shard.
    """
    tree = tree or grid()
    grown = grown or with_new_region(tree)
    text = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(quoted(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"))
    bucket = F.pmod(F.xxhash64("id", "crc", "size"), F.lit(max(1, BUCKETS // len(tree))))
    rows = rows.select("*", shard_of(F.col("id"), tree).alias("shard"), shard_of(F.col("id"), grown).alias("grown"), bucket.alias("bucket"))
    # stored, so that texts are read once: a few bytes a row
    rows = materialize(rows.groupBy("shard", "bucket", "id", "crc", "size", "grown").agg(F.count("*").alias("copies")), "sized")
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a shard's buckets at most
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slot0"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("slot1", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    placed = each_copy(placed, "copies", "i")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("slot0") + F.col("slot1") + F.col("i")).alias("slot"), F.col("grown").alias("grown_shard")
    )


def with_shards(docs: DataFrame, tree: tuple[Shard, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with ``shard`` (replaced if there is one), which needs no shuffle."""
    name = "shard"
    return docs.select(*(quoted(c) for c in docs.columns if c.lower() != name), shard_of(quoted(id_col), tree or grid()).alias(name))
