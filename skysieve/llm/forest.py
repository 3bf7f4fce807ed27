"""Spanning forests of link tables by contraction of minimum edges (after Boruvka), as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.session import cut, stored


def _jump(parents: DataFrame) -> DataFrame:
    """c, r: every pointer replaced by the pointer of its target."""
    a, b = parents.alias("a"), parents.alias("b")
    return a.join(b, F.col("a.r") == F.col("b.c"), "left").select("a.c", F.coalesce("b.r", "a.r").alias("r"))


def _roots(picked: DataFrame) -> DataFrame:
    """c, r: the root of each component's chain of picked edges. As edges are totally ordered, the only cycles are pairs that
    picked the same edge; the smaller of the two is the root. Pointers double until none moves."""
    a, b = picked.alias("a"), picked.alias("b")
    mutual = (F.col("b.n") == F.col("a.c")) & (F.col("a.c") < F.col("a.n"))
    now = cut(a.join(b, F.col("a.n") == F.col("b.c")).select("a.c", F.when(mutual, F.col("a.c")).otherwise(F.col("a.n")).alias("r")))
    while True:
        then = cut(_jump(_jump(now)))
        moved = then.alias("t").join(now.alias("n"), F.col("t.c") == F.col("n.c")).filter(F.col("t.r") != F.col("n.r"))
        if moved.isEmpty():
            return then
        now = then


def spanning_forest(edges: DataFrame, left: str, right: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, members) of an undirected link table.

    forest: u, v, the links kept, persisted as a Parquet table (at `path`, else in the shared folder). members: node, root for every node with
    a link; root is one node of the component. Repeated links, loops and links with a null end
    count for nothing. Each round every component picks its least link by an aggregation with map-side minima, picked
    links are contracted by pointer doubling, and links inside a component vanish, so at most half of the
    components remain. A component of any size is spread over tasks throughout; skewed join keys have one row on the
    other side, so adaptive execution may split them."""
    low, high = F.least(left, right), F.greatest(left, right)
    links = cut(
        edges.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(low.alias("u"), high.alias("v")).distinct()
        .select(F.col("u").alias("x"), F.col("v").alias("y"), F.struct("u", "v").alias("w"))
    )
    kept, maps = [], []
    while not links.isEmpty():
        both = links.select(F.col("x").alias("c"), F.col("y").alias("n"), "w").unionByName(links.select(F.col("y").alias("c"), F.col("x").alias("n"), "w"))
        picked = cut(both.groupBy("c").agg(F.min(F.struct("w", "n")).alias("p")).select("c", "p.n", "p.w"))
        kept.append(picked.select("w"))
        roots = _roots(picked)
        maps.append(roots)
        left_root, right_root = roots.select(F.col("c").alias("x"), F.col("r").alias("rx")), roots.select(F.col("c").alias("y"), F.col("r").alias("ry"))
        links = cut(
            links.join(left_root, "x").join(right_root, "y").filter("rx <> ry")
            .groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("w").alias("w"))
        )
    if not kept:
        nothing = links.select("w.u", "w.v")
        return nothing, links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    chosen = kept[0]
    for more in kept[1:]:
        chosen = chosen.unionByName(more)
    forest = stored(chosen.distinct().select("w.u", "w.v"), "forest", path=path)
    members = maps[0]
    for later in maps[1:]:
        members = _jump_into(members, later)
    return forest, members.select(F.col("c").alias("node"), F.col("r").alias("root"))


def _jump_into(members: DataFrame, later: DataFrame) -> DataFrame:
    a, b = members.alias("a"), later.alias("b")
    return a.join(b, F.col("a.r") == F.col("b.c"), "left").select("a.c", F.coalesce("b.r", "a.r").alias("r"))
