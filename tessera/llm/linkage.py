"""Connected parts of large groups, without comparing all pairs of a group and without losing a link.

Items of a group may be linked; which are, only a comparison of their contents tells.  A group that
is too large for one task is cut into chunks.

1. Each chunk is compared in itself and with a few pivots of its group, the same for all chunks.
2. Of groups that are still in several parts, the items with most links become the pivots and are
   compared with all chunks: a text that all others are copies of is found in this way.
3. What is then outside its group's largest part is compared with every chunk.  Two items in
   different chunks are either both in the largest part, and so need no link, or are compared here.

Texts move once for each of the steps that their group needs, and no more often than there are
chunks of items outside the largest part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import materialise, small, spread

#: Pivots of a group, about.
PIVOTS = 16
#: (block, grp, item, part, ask): items to be compared with the others of their block and group; edges (a, b) come back.
Compare = Callable[[DataFrame], DataFrame]


def linked(items: DataFrame, room: int, compare: Compare, known: DataFrame | None = None) -> DataFrame:
    """Items (grp, item, weight) -> (node, root), see components(); ``known`` are edges that are known already.

    Groups of up to ``room`` weight are compared in one task; an item may be in several groups.
    """
    sizes = items.groupBy("grp").agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("members"))
    sizes = materialise(sizes.select("grp", "size", F.ceil(F.col("size") / room).cast("int").alias("chunks"), F.ceil(F.col("members") / PIVOTS).alias("nth")))
    total = sizes.agg(F.sum("size"), F.max("chunks")).first()
    blocks = max(spread(items.sparkSession), 2 * int(total[0] or 0) // room)
    alone = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("grp"), F.lit(blocks)))
    if (total[1] or 1) <= 1:
        edges = compare(items.select(alone.alias("block"), "grp", "item", F.col("item").alias("part"), F.lit(True).alias("ask")))
        return components(edges if known is None else edges.unionAll(known))
    # derived keys: both sides are dealt out anew, so that a hot group can be split
    big = small(sizes.filter("chunks > 1").select(F.struct("grp").alias("_grp"), "chunks", "nth"))
    held = items.join(big, F.struct("grp") == F.col("_grp"), "left").drop("_grp")
    chunk = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit(1), "item"), F.col("nth")) == 0
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = held.withColumn("chunk", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(pivot, every).otherwise(F.array(chunk))))
    block = F.when(F.col("chunks").isNull(), alone).otherwise(F.xxhash64(F.lit(1), "grp", "chunk"))
    edges = materialise(compare(first.select(block.alias("block"), "grp", "item", F.col("item").alias("part"), F.lit(True).alias("ask"))))
    edges = edges if known is None else edges.unionAll(known)
    roots = components(edges)
    large = materialise(held.filter("chunks is not null").withColumn("chunk", chunk))
    for last in (False, True):
        parts, split = _parts(large, roots)
        if split is None:
            return roots
        parts = materialise(parts.join(small(split), F.struct("grp") == F.col("_grp")).drop("_grp"))
        if last:
            ask = parts.filter("part <> most").withColumn("turn", F.pmod(F.xxhash64(F.lit(2), "item"), F.col("turns")).cast("int"))
        else:
            degree = edges.select(F.col("a").alias("_n")).unionAll(edges.select(F.col("b").alias("_n"))).groupBy("_n").agg(F.count(F.lit(1)).alias("degree"))
            hubs = parts.join(degree, F.col("item") == F.col("_n")).groupBy("grp", F.pmod(F.xxhash64("item"), F.lit(PIVOTS)).alias("class"))
            hubs = hubs.agg(F.max_by(F.struct("item", "part", "chunk", "chunks"), F.struct("degree", "item")).alias("hub")).select("grp", "hub.*")
            ask = hubs.withColumns({"turn": F.lit(0), "turns": F.lit(1)})
        asked = ask.withColumn("to", F.explode(every)).select("grp", "item", "part", F.lit(True).alias("ask"), F.col("to").alias("chunk"), "turn")
        turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1)) if last else F.lit(0)
        others = parts.select("grp", "item", "part", F.lit(False).alias("ask"), "chunk", turn.alias("turn"))
        rows = asked.unionAll(others)
        more = materialise(compare(rows.select(F.xxhash64("grp", "chunk", "turn").alias("block"), "grp", "item", "part", "ask")))
        edges = edges.unionAll(more)
        roots = components(more.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def _parts(large: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The items of large groups with their parts; and (_grp, most, turns) of groups in several parts, None if there are none.

    ``most`` is the part with the largest weight, ``turns`` the chunks that the others make.
    """
    parts = large.join(roots, F.col("item") == F.col("node"), "left").withColumn("part", F.coalesce("root", "item")).drop("node", "root")
    shares = parts.groupBy("grp", "part", "chunks").agg(F.sum("weight").alias("share"))
    split = shares.groupBy("grp").agg(F.max_by("part", F.struct("share", "part")).alias("most"), F.max("share").alias("top"), F.sum("share").alias("size"), F.max("chunks").alias("_chunks"))
    split = split.filter("top < size").select(F.struct("grp").alias("_grp"), "most", F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("top")) * F.col("_chunks") / F.col("size"))).cast("int").alias("turns"))
    split = materialise(split)
    return parts, None if split.isEmpty() else split


def forest_by_pivots(k: int, neighbours, part: np.ndarray | None = None, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the parts of a graph on 0..k-1 given by ``neighbours(x, others)``.

    One node after another is compared with all nodes of other parts; those of the largest part
    come last and are left out once no other part has a node that was not compared.  With ``ask``,
    only the nodes that it marks are compared with the others.
    """
    part = np.arange(k) if part is None else np.unique(part, return_inverse=True)[1]
    done = np.zeros(k, dtype=bool) if ask is None else ~ask
    whole = ask is None or bool(ask.all())
    edges = []
    while True:
        if whole:
            size = np.bincount(part, minlength=k)
            rest = np.flatnonzero(~done & (part != int(size.argmax())))
        else:
            rest = np.flatnonzero(~done)
        if len(rest) == 0:
            return edges
        x = int(rest[0])
        done[x] = True
        others = np.flatnonzero(part != part[x])
        for y in neighbours(x, others).tolist() if len(others) else ():
            if part[y] != part[x]:
                edges.append((x, y))
                part[part == part[y]] = part[x]
