"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step only looks up the least neighbour of a node: a grouped minimum with
map-side combination, which goes back to the node's links with those of a frequent
node dealt out to several tasks, so a node with very many links is no bottleneck.
The tables of each round are written to the shared folder; nothing but counts and
checksums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt, saved


def _stamp(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component) of the nodes in ``edges`` (a, b: long); component is the smallest id reachable."""
    cur = saved(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), f"{folder}/links0")
    stamp, step = _stamp(cur), 0
    while stamp[0]:
        # large star: larger neighbours of a node are linked with its least neighbour
        both = cur.union(cur.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("rows"))
        rows, least = dealt(both.filter("b > a"), least, "a", 2 * stamp[0], "b")
        large = rows.join(least, ["a", "salt"]).selectExpr("b as a", "m as b").distinct()
        # small star: smaller neighbours and the node itself are linked with the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
        rows, own = dealt(large, least, "a", stamp[0], "b")
        small = rows.join(own, ["a", "salt"]).selectExpr("b as a", "m as b").union(least.selectExpr("a", "m as b")).filter("a <> b").distinct()
        step += 1
        new = saved(small, f"{folder}/links{step}")
        after = _stamp(new)
        cur = new
        if after == stamp:
            break
        stamp = after
    return cur.selectExpr("a as id", "b as component").union(cur.selectExpr("b as id", "b as component")).distinct()
