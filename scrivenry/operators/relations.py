"""Access by relation, ordered graphs, pages of lists, and tables made text."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivenry.sources import materialize


def visible(items: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, item_id): items a member may see: of their organization and open, their own, or granted.

    ``items``: (item_id, org_id, restricted, creator); ``members``: (user_id, org_id); ``grants``: (user_id, item_id).
    """
    inside = items.join(members, "org_id")
    granted = grants.select("user_id", "item_id", F.lit(True).alias("granted"))
    rows = inside.join(granted, ["user_id", "item_id"], "left")
    return rows.filter(~F.col("restricted") | (F.col("creator") == F.col("user_id")) | F.col("granted")).select("user_id", "item_id")


def linear_edges(steps: DataFrame, key: str, order: str) -> DataFrame:
    """(key, source, target): each step and the next one of its design."""
    following = F.lead(order).over(Window.partitionBy(key).orderBy(order))
    return steps.withColumn("target", following).filter("target is not null").select(key, F.col(order).alias("source"), "target")


def page(rows: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """Rows ``start`` (from 1) and on, at most 200, in order."""
    return rows.orderBy(*order).offset(max(0, start - 1)).limit(max(0, min(count, 200)))


def levels(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:  # noqa: ANN001
    """(node, level): how far each node of a tree is from its root.

    Each round's nodes are written, so a round costs what it finds. Nodes found before are not taken
    again, so a cycle ends; nodes that no root leads to are left out.
    """
    frontier = materialize(roots.select("node", F.lit(0).cast("long").alias("level")).dropDuplicates(["node"]), "level")
    found = frontier
    while True:
        following = edges.join(frontier.withColumnRenamed("node", "parent"), "parent").groupBy("node").agg((F.min("level") + 1).alias("level"))
        frontier = materialize(following.join(found.select("node"), "node", "left_anti"), "level")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def _ordered(nodes: list[dict], edges: list[dict]) -> tuple[list[str], str | None]:
    """Keys of the nodes of one graph in order: of those whose sources are done, the least (y, key) next; or what is wrong."""
    ids = {n["id"] for n in nodes}
    if len({n["key"] for n in nodes}) != len(nodes):
        return [], "duplicate key"
    if any(e["source"] not in ids or e["target"] not in ids for e in edges):
        return [], "missing dependency"
    if any(e["conditional"] for e in edges):
        return [], "condition"
    open_, after = dict.fromkeys(ids, 0), {}
    for e in edges:
        open_[e["target"]] += 1
        after.setdefault(e["source"], []).append(e["target"])
    rank = {n["id"]: (n["y"] or 0, n["key"], n["id"]) for n in nodes}
    ready = [rank[i] for i, k in open_.items() if k == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        _, key, i = heapq.heappop(ready)
        out.append(key)
        for j in after.get(i, ()):
            open_[j] -= 1
            if open_[j] == 0:
                heapq.heappush(ready, rank[j])
    return (out, None) if len(out) == len(nodes) else ([], "cycle")


def ordered_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, keys, error): the nodes of every graph in dependency order, or null keys and what is wrong with the graph.

    ``nodes``: (graph_id, id, key, y); ``edges``: (graph_id, source, target, conditional). A graph is
    one design with some tens of nodes; many graphs are ordered at once, in their tasks.
    """

    @F.pandas_udf("keys array<string>, error string")
    def order(nodes: pd.Series, edges: pd.Series) -> pd.DataFrame:
        rows = [_ordered(list(n), [] if e is None else list(e)) for n, e in zip(nodes, edges)]
        return pd.DataFrame({"keys": [None if error else keys for keys, error in rows], "error": [error for _, error in rows]})

    own = nodes.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.col("key").cast("string").alias("key"), F.col("y").cast("double").alias("y"))).alias("nodes"))
    links = edges.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "conditional")).alias("edges"))
    return own.join(links, "graph_id", "left").select("graph_id", order("nodes", "edges").alias("x")).select("graph_id", "x.keys", "x.error")


def table_text(cells: DataFrame, key: str, row: str, column: str, value: str) -> DataFrame:
    """(key, content): cells joined by tabs within a row, rows by line feeds, blank cells left out."""
    rows = cells.filter(F.trim(value) != "").groupBy(key, row).agg(F.array_sort(F.collect_list(F.struct(column, value))).alias("cells"))
    lines = rows.select(key, row, F.array_join(F.transform("cells", lambda c: c[value]), "\t").alias("line"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, "line"))), lambda x: x["line"]), "\n").alias("content"))


def newest(rows: DataFrame, key: str, order: str, keep: int = 3) -> DataFrame:
    """The ``keep`` newest generations of each key."""
    at = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(at).cast("long")).filter(F.col("age") <= keep)
