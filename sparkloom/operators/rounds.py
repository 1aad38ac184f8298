"""Orders and closures that a single walk would find, in rounds of joins.

Each function repeats a few joins until nothing is left to do, and cuts the
lineage in every round. They run jobs while they are called.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Edges that one task settles by itself when strong components are sought, or pairs when they are walked; more go through rounds.
TOGETHER = 1 << 18


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """df with the place of each row, from 0, in its group. Rows are sorted by range, so that a group may be spread over many tasks; a row a task and group is what counts come from."""
    rows = cut(df.orderBy(*group, *order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)))
    parts = rows.groupBy(*group, "_part").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = rows.join(parts, [*group, "_part"])
    return joined.withColumn(name, F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_part", "_first", "_before")


def _state(df: DataFrame, *columns: str) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def _smallest_reaching(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest node from which edges (s, t) lead to a node, itself included.

    What is known of a node's label holds for the node as well, so that labels
    are followed and edges needn't be walked one by one.
    """
    ends = edges.select(F.col("s").alias("id")).union(edges.select(F.col("t").alias("id"))).distinct()
    labels = cut(ends.withColumn("label", F.col("id")))
    before = None
    while True:
        ahead = edges.join(labels, F.col("s") == F.col("id")).select(F.col("t").alias("id"), "label")
        low = labels.union(ahead).groupBy("id").agg(F.min("label").alias("label"))
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("_next"))
        labels = cut(low.join(further, "label").select("id", F.least("label", "_next").alias("label")))
        state = _state(labels, "id", "label")
        if state == before:
            return labels
        before = state


def _settle(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's strong component, for edges of nodes 0..n-1: the same rounds, on arrays."""
    out, left = np.arange(n), np.ones(n, bool)
    while len(s):
        labels = []
        for a, b in ((s, t), (t, s)):
            low = np.arange(n)
            while True:
                new = low.copy()
                np.minimum.at(new, b, low[a])
                new = new[new]
                if np.array_equal(new, low):
                    break
                low = new
            labels.append(low)
        first, back = labels
        done = left & (first == back)
        out[done] = first[done]
        left &= ~done
        keep = left[s] & left[t] & (first[s] == first[t]) & (back[s] == back[t])
        s, t = s[keep], t[keep]
    return out


def strong_components(edges: DataFrame, source: str = "source_id", target: str = "target_id", together: int = TOGETHER) -> DataFrame:
    """(id, component) of all ends of edges: the smallest node that a node both reaches and is reached from.

    Nodes that nothing leads to, or that lead nowhere, are trimmed. The others are
    labelled with the smallest node that reaches them and the smallest that they
    reach. Where both are the same, it is the component; elsewhere, edges between
    nodes of other labels can't lie in one component and go. Each round settles
    the component of the smallest node of every pair of labels. Up to together
    edges are settled by one task in the same way.
    """
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct()
    every = e.select(F.col("s").alias("id")).union(e.select(F.col("t").alias("id"))).distinct()
    e = e.where("s <> t")
    found = None
    while True:
        for _ in range(2):
            e = e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
        e = cut(e.select("s", "t"))
        n = e.count()
        if n <= together:
            break
        first, back = _smallest_reaching(e), _smallest_reaching(e.select(F.col("t").alias("s"), F.col("s").alias("t")))
        both = cut(first.join(back.withColumnRenamed("label", "back"), "id"))
        settled = both.where("label = back").select("id", F.col("label").alias("component"))
        found = settled if found is None else found.union(settled)
        open_ = both.where("label <> back")
        e = e.join(open_.selectExpr("id as s", "label as l1", "back as b1"), "s").join(open_.selectExpr("id as t", "label as l2", "back as b2"), "t").where("l1 = l2 and b1 = b2").select("s", "t")
    if n:
        kind = dict(e.dtypes)["s"]

        def settle(frames):
            rows = pd.concat(list(frames), ignore_index=True)
            if len(rows):
                codes, names = pd.factorize(pd.concat([rows["s"], rows["t"]]), sort=True)
                low = _settle(codes[: len(rows)], codes[len(rows) :], len(names))
                yield pd.DataFrame({"id": names, "component": names[low]})

        settled = e.coalesce(1).mapInPandas(settle, f"id {kind}, component {kind}")
        found = settled if found is None else found.union(settled)
    if found is None:
        return every.withColumn("component", F.col("id"))
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def first_in_first_out(nodes: DataFrame, edges: DataFrame, group: str = "project_name") -> DataFrame:
    """(group, id, position, ordered): callers before callees, first in, first out; nodes that cycles hold back follow with ordered false.

    A queue starts with the nodes that nothing calls, by ordinal and id, and gets
    a node when its last caller leaves it. So it is filled level by level: a level
    is what becomes free by the one before it, in the order of the last callers'
    places and, for one caller, of ordinal and id. Each level is a round, which
    touches the nodes that it frees or half frees; a sort by range gives places,
    and no project has to meet in one task. Rounds are as many as the longest
    chain of calls has nodes.
    """
    place = F.struct("ordinal", "id").alias("place")
    n = cut(nodes.select(group, "id", place))
    pairs = edges.select(group, F.col("source_id").alias("s"), F.col("target_id").alias("id")).distinct()
    inside = pairs.join(n.select(group, "id"), [group, "id"], "left_semi").join(n.select(group, F.col("id").alias("s")), [group, "s"], "left_semi")
    e = cut(inside.select(group, "s", "id"))
    calls = cut(e.groupBy(group, "id").agg(F.count("*").alias("calls")))
    by_rank = lambda df, *order: cut(df.orderBy(group, *order).select(group, "id", F.monotonically_increasing_id().alias("rank")))
    front = by_rank(n.join(calls, [group, "id"], "left_anti"), "place")
    out = front.withColumn("level", F.lit(0))
    touched, level = None, 0
    while True:
        level += 1
        hits = e.join(front.select(group, F.col("id").alias("s"), "rank"), [group, "s"]).select(group, "id", F.lit(1).cast("long").alias("n"), F.lit(level).alias("level"), "rank")
        all_hits = hits if touched is None else touched.unionByName(hits)
        last = F.max(F.struct("level", "rank"))
        state = cut(all_hits.groupBy(group, "id").agg(F.sum("n").alias("n"), last.alias("last")).join(calls, [group, "id"]).select(group, "id", "n", "calls", F.col("last.level").alias("level"), F.col("last.rank").alias("rank")))
        free = state.where("n = calls").select(group, "id", F.col("rank").alias("caller")).join(n, [group, "id"])
        front = by_rank(free, "caller", "place")
        if front.isEmpty():
            break
        touched = state.where("n < calls").select(group, "id", "n", "level", "rank")
        out = out.unionByName(front.withColumn("level", F.lit(level)))
    ordered = n.join(out, [group, "id"], "left").withColumn("_open", F.col("level").isNull())
    return numbered(ordered, [group], ["_open", "level", "rank", "place"]).select(group, "id", "position", (~F.col("_open")).alias("ordered"))


def _walked(pairs: DataFrame) -> DataFrame:
    """v, the nodes that go when one task walks the pairs by a and b."""

    def run(frames):
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["a", "b"])
        gone = set()
        for a, b, up in zip(rows["a"].tolist(), rows["b"].tolist(), rows["up"].tolist()):
            if a not in gone and b not in gone:
                gone.add(a if up else b)
        yield pd.DataFrame({"v": list(gone)})

    return cut(pairs.coalesce(1).mapInPandas(run, f"v {dict(pairs.dtypes)['a']}"))


def settle_pairs(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(removed: node; rounds) of pairs (a < b, up): each a in turn removes its b's, unless one with up, which stays and removes a; what was removed removes nothing.

    A node takes its turn as soon as no pair of a smaller node is left that
    touches it or one of its own pairs; many do so in each round. Pairs with a
    removed node, and those of nodes that had their turn, are gone. One task walks
    the last TOGETHER pairs. There are at most as many rounds as the longest chain
    of nodes that wait for each other.
    """
    left = cut(pairs.select("a", "b", "up").distinct())
    removed, rounds = None, 0
    while n := left.count():
        rounds += 1
        if n <= TOGETHER:
            gone = _walked(left)
            removed = gone if removed is None else removed.union(gone)
            break
        touching = left.select(F.col("a").alias("v"), "a").union(left.select(F.col("b").alias("v"), "a"))
        first = cut(touching.groupBy("v").agg(F.min("a").alias("first")))
        at_b = left.join(first.select(F.col("v").alias("b"), F.col("first").alias("first_b")), "b")
        free = at_b.groupBy("a").agg(F.min(F.col("first_b") == F.col("a")).alias("free"), F.min(F.when(F.col("up"), F.col("b"))).alias("stop")).where("free")
        turn = cut(free.join(first.where("v = first").select(F.col("v").alias("a")), "a", "left_semi").select("a", "stop"))
        own = left.join(turn, "a").where("stop is null or b < stop").select(F.col("b").alias("v"))
        gone = cut(own.union(turn.where("stop is not null").select(F.col("a").alias("v"))).distinct())
        removed = gone if removed is None else removed.union(gone)
        rest = left.join(turn.select("a"), "a", "left_anti")
        left = cut(rest.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b", "up"))
    if removed is None:
        removed = pairs.select(F.col("a").alias("v")).limit(0)
    return removed.select(F.col("v").alias("node")), rounds


def settle_apart(pairs: DataFrame) -> DataFrame:
    """node, as settle_pairs removes them, of distinct pairs of which no b is an a of others.

    An a stops at the latest at its first b with up that no smaller a touches, and
    touches nothing beyond. If smaller ones touch no b with up before that, it is
    settled: its b's end there, whatever happened to them earlier, and larger a's
    don't meet them. Each round settles the smallest a's at least, which wait for
    none; one task walks the last TOGETHER pairs.
    """
    left = cut(pairs.select("a", "b", "up"))
    removed = []
    while (n := left.count()) > TOGETHER:
        first = left.groupBy("b").agg(F.min("a").alias("first"))
        known = cut(left.join(first, "b"))
        stops = known.where("up and a = first").groupBy("a").agg(F.min("b").alias("stop"))
        reach = cut(known.join(stops, "a", "left").where("stop is null or b <= stop"))
        turn = cut(reach.groupBy("a").agg(F.max(F.expr("up and a <> first")).alias("waits"), F.max("stop").alias("stop")).where("not waits").select("a", "stop"))
        ends = cut(reach.where("not up").join(turn.select("a"), "a", "left_semi").groupBy("b").agg(F.min("a").alias("end")))
        removed += [ends.select(F.col("b").alias("v")), turn.where("stop is not null").select(F.col("a").alias("v"))]
        left = cut(reach.join(turn.select("a"), "a", "left_anti").join(ends, "b", "left").where("end is null or a < end").select("a", "b", "up"))
    if n:
        removed.append(_walked(left))
    if not removed:
        return left.select(F.col("a").alias("node"))
    return reduce(DataFrame.union, removed).distinct().select(F.col("v").alias("node"))
