"""Connected components by alternating large and small stars, after each task has joined its own edges; state is one row an edge.

Defined results: loops and repeated edges count for nothing, an empty table gives an empty result; ids that are null have no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, skewed_join


def _star(edges: DataFrame, large: bool, tables: Tables, rows: int) -> DataFrame:
    """Links each node's neighbours to its least neighbour: all larger ones (large), or those up to itself (small)."""
    u, v = F.col("u"), F.col("v")
    both = edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = tables.cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), 2 * rows)
    linked = skewed_join(both, least, ["u"])  # a large star's centre is in as many rows as it has rays
    out = linked.where("v > u").select(v.alias("u"), F.col("m").alias("v")) if large else linked.select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    made = tables.cut(out.where("u != v").distinct(), 2 * rows)
    tables.drop(least)
    return made


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each batch of rows as stars around their least nodes: shorter paths for the rounds to come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
                x, y = root(u), root(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            stars = [(x, root(x)) for x in list(parent)]
            yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["u", "v"], dtype="int64")

    return edges.mapInPandas(run, "u long, v long")


def components(edges: DataFrame, tables: Tables | None = None, rows: int | None = None) -> DataFrame:
    """u, v for each node u of edges(u, v: long) that isn't the least of its component, which is v.

    Rounds grow with the logarithm of the longest path; only two numbers a round come to the driver. rows: a bound of the edges, if one is known.
    """
    tables = tables or Tables(edges.sparkSession)
    now = tables.cut(_contracted(edges.where("u != v").select("u", "v")).distinct(), rows)
    size = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = size(now)
    while seen[0]:
        large = _star(now, True, tables, seen[0])
        small = _star(large, False, tables, seen[0])
        tables.drop(now, large)
        now, last, seen = small, seen, size(small)
        if seen == last:
            break
    return now
