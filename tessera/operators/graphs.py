"""Address graphs of contracts: edges, degrees, strongly connected components, condensed targets, bounded paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import discard, materialise

#: Edges of a contract that one task may take; larger graphs go through the distributed method.
TASK_EDGES = 500_000
KEY = ["chain", "contract"]


def edges(events: DataFrame) -> DataFrame:
    """chain, contract, src, dst: distinct edges without loops and null ends."""
    return events.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select(*KEY, "src", "dst").distinct()


def degrees(graph: DataFrame) -> DataFrame:
    """chain, contract, address, indegree, outdegree (of distinct edges)."""
    ends = graph.select(*KEY, F.col("src").alias("address"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(graph.select(*KEY, F.col("dst").alias("address"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(*KEY, "address").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def _small_components(rows: pd.DataFrame) -> pd.DataFrame:
    """Components of one contract's graph, without recursion: finishing order, then the reversed graph."""
    nodes = sorted(set(rows["src"]) | set(rows["dst"]))
    number = {a: i for i, a in enumerate(nodes)}
    out: list[list[int]] = [[] for _ in nodes]
    back: list[list[int]] = [[] for _ in nodes]
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        out[number[a]].append(number[b])
        back[number[b]].append(number[a])
    seen, order = [False] * len(nodes), []
    for start in range(len(nodes)):
        if seen[start]:
            continue
        seen[start] = True
        stack = [(start, iter(out[start]))]
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if not seen[nxt]:
                    seen[nxt] = True
                    stack.append((nxt, iter(out[nxt])))
                    break
            else:
                order.append(node)
                stack.pop()
    least = [-1] * len(nodes)
    for start in reversed(order):
        if least[start] >= 0:
            continue
        group, stack = [], [start]
        least[start] = start
        while stack:
            node = stack.pop()
            group.append(node)
            for nxt in back[node]:
                if least[nxt] < 0:
                    least[nxt] = start
                    stack.append(nxt)
        smallest = min(group)
        for node in group:
            least[node] = smallest
    return pd.DataFrame({"chain": rows["chain"].iloc[0], "contract": rows["contract"].iloc[0], "address": nodes, "component": [nodes[i] for i in least]})


def _reach(graph: DataFrame, start: DataFrame, label: str) -> DataFrame:
    """chain, contract, address, mark: the largest mark that reaches each address along the edges."""
    now = materialise(start, label)
    while True:
        passed = graph.join(now.withColumnRenamed("address", "src"), [*KEY, "src"]).select(*KEY, F.col("dst").alias("address"), "mark")
        after = materialise(now.unionByName(passed).groupBy(*KEY, "address").agg(F.max("mark").alias("mark")), label)
        changed = after.join(now, [*KEY, "address", "mark"], "left_anti").limit(1).count()
        discard(now)
        if not changed:
            return after
        now = after


def _trimmed(left: DataFrame) -> DataFrame:
    """The edges between addresses that have edges both in and out, again and again: all others are components of their own."""
    while True:
        ends = left.select(*KEY, F.col("src").alias("address")).distinct().intersect(left.select(*KEY, F.col("dst").alias("address")).distinct())
        ends = materialise(ends, "scc-ends")
        kept = left.join(ends.withColumnRenamed("address", "src"), [*KEY, "src"], "left_semi").join(ends.withColumnRenamed("address", "dst"), [*KEY, "dst"], "left_semi").select(*KEY, "src", "dst")
        kept = materialise(kept, "scc-edges")
        done = kept.count() == left.count()
        discard(ends, left)
        if done:
            return kept
        left = kept


def _large_components(graph: DataFrame) -> DataFrame:
    """Components of graphs of any size by colouring: a colour is the largest address that reaches a node; what reaches that
    address back inside the colour is its component. Components leave the graph until none is left. What no cycle can go
    through is trimmed before each round, so that rounds follow the cycles and not the length of chains."""
    every = graph.select(*KEY, F.col("src").alias("address")).union(graph.select(*KEY, F.col("dst").alias("address"))).distinct()
    every = materialise(every, "scc-nodes")
    left = _trimmed(materialise(graph, "scc-edges"))
    done = None
    while left.limit(1).count():
        nodes = materialise(left.select(*KEY, F.col("src").alias("address")).distinct(), "scc-left")
        colour = _reach(left, nodes.withColumn("mark", F.col("address")), "scc-colour")
        inside = left.join(colour.select(*KEY, F.col("address").alias("src"), F.col("mark").alias("a")), [*KEY, "src"]).join(colour.select(*KEY, F.col("address").alias("dst"), F.col("mark").alias("b")), [*KEY, "dst"]).where("a = b")
        back = _reach(inside.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("address = mark"), "scc-back")
        group = back.groupBy(*KEY, "mark").agg(F.min("address").alias("component"))
        found = materialise(back.join(group, [*KEY, "mark"]).select(*KEY, "address", "component"), "scc-found")
        done = found if done is None else done.unionByName(found)
        rest = left.join(found.withColumnRenamed("address", "src"), [*KEY, "src"], "left_anti").join(found.withColumnRenamed("address", "dst"), [*KEY, "dst"], "left_anti").select(*KEY, "src", "dst")
        after = materialise(rest, "scc-edges")
        discard(nodes, colour, back, left)
        left = _trimmed(after)
    if done is None:
        return every.withColumn("component", F.col("address"))
    return every.join(done, [*KEY, "address"], "left").select(*KEY, "address", F.coalesce("component", "address").alias("component"))


def strong_components(graph: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """chain, contract, address, component (its smallest address) of distinct edges (chain, contract, src, dst).

    A contract's graph goes to one task while its size is under ``task_edges``; larger ones are coloured in rounds of joins.
    """
    size = graph.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    large = size.where(F.col("n") > task_edges).select(*KEY)
    kind = dict(graph.dtypes)["src"]
    schema = f"chain string, contract string, address {kind}, component {kind}"
    small = graph.join(size.where(F.col("n") <= task_edges).select(*KEY), KEY).groupBy(*KEY).applyInPandas(_small_components, schema)
    if not large.limit(1).count():
        return small
    return small.unionByName(_large_components(graph.join(large, KEY, "left_semi")).select(*KEY, "address", "component"))


def condensed(graph: DataFrame, components: DataFrame) -> DataFrame:
    """chain, contract, component, target: distinct edges between different components."""
    a, b = components.select(*KEY, F.col("address").alias("src"), "component"), components.select(*KEY, F.col("address").alias("dst"), F.col("component").alias("target"))
    return graph.join(a, [*KEY, "src"]).join(b, [*KEY, "dst"]).where("component != target").select(*KEY, "component", "target").distinct()


def layered_paths(moves: DataFrame, starts: DataFrame, addresses: int = 3) -> DataFrame:
    """chain, contract, token, start, path, path_length, low_value_hops: for each token and start the first simple path of rising
    time through so many addresses.

    First: by time and id of the first move, then of the second, and so on. A hop is of low value if it is a transfer, or a sale
    of at most one dollar. ``starts``: chain, contract, address. Paths with equal addresses and moves are one.
    """
    low = (~F.col("is_sale") | F.coalesce(F.col("usd").between(0, 1), F.lit(False))).cast("int")
    hop = moves.select(*KEY, "token", "src", "dst", F.struct("ts", "event_id").alias("at"), low.alias("low"))
    found = hop.join(starts.select(*KEY, F.col("address").alias("src")), [*KEY, "src"], "left_semi").where("src != dst")
    found = found.select(*KEY, "token", F.array("src", "dst").alias("path"), F.array("at").alias("order"), "low")
    for _ in range(addresses - 2):
        step = hop.select(*KEY, "token", F.col("src").alias("here"), F.col("dst").alias("next"), F.col("at").alias("then"), F.col("low").alias("more"))
        longer = found.withColumn("here", F.element_at("path", -1)).join(step, [*KEY, "token", "here"])
        longer = longer.where((F.col("then.ts") > F.element_at("order", -1)["ts"]) & ~F.array_contains("path", F.col("next")))
        found = longer.select(*KEY, "token", F.array_append("path", F.col("next")).alias("path"), F.array_append("order", F.col("then")).alias("order"), (F.col("low") + F.col("more")).alias("low"))
    one = found.groupBy(*KEY, "token", F.col("path")[0].alias("start")).agg(F.min(F.struct("order", "path", "low")).alias("p"))
    return one.select(*KEY, "token", "start", "p.path", F.size("p.path").cast("long").alias("path_length"), F.col("p.low").cast("long").alias("low_value_hops"))


def reciprocal_pairs(graph: DataFrame) -> DataFrame:
    """chain, contract, pairs: unordered pairs of addresses with edges both ways."""
    return graph.groupBy(*KEY, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").groupBy(*KEY).agg(F.count(F.lit(1)).alias("pairs"))
