"""Orders and closures in rounds against plain walks over the same rows."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import graph, rounds

PAIR = "source_id string, target_id string"


def _reach(edges):
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    nodes = {x for e in edges for x in e}
    found = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for t in out.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        found[n] = seen
    return found


def _components(edges):
    reach = _reach(edges)
    return {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in reach}


def _random_edges(seed, nodes, many):
    r = random.Random(seed)
    return [(f"n{r.randrange(nodes):02d}", f"n{r.randrange(nodes):02d}") for _ in range(many)]


def test_strong_components(spark):
    edges = [(f"{k}{s}", f"{k}{t}") for k, seed, many in (("a", 1, 30), ("b", 2, 45), ("c", 3, 70)) for s, t in _random_edges(seed, 30, many)]
    edges += [("x", "x"), ("y", "z"), ("y", "z"), *((f"r{i}", f"r{(i + 1) % 9}") for i in range(9))]
    df = spark.createDataFrame(edges, PAIR)
    expected = _components(edges)
    for together in (rounds.TOGETHER, 0):
        assert dict(map(tuple, rounds.strong_components(df, together=together).collect())) == expected
    assert rounds.strong_components(df.limit(0)).collect() == []


def test_walks_stay_in_components(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "d"), *((f"v{i}", f"v{(i + 1) % 5}") for i in range(5)), *((f"w{i}", f"w{(i + 1) % 6}") for i in range(6)), ("w0", "v0")]
    found = {r[0] for r in graph.on_cycles(spark.createDataFrame(edges, PAIR)).collect()}
    assert found == {"a", "b", "d", *(f"v{i}" for i in range(5))}


def _queue(ids, edges):
    """The walk itself: a queue and counters."""
    place = {x: n for n, x in enumerate(ids)}
    targets = {i: sorted({t for s, t in edges if s == i and t in place}, key=place.get) for i in ids}
    into = {i: sum(i in ts for ts in targets.values()) for i in ids}
    out = [i for i in ids if not into[i]]
    for i in out:
        for t in targets[i]:
            into[t] -= 1
            if not into[t]:
                out.append(t)
    return out, [i for i in ids if i not in set(out)]


def test_first_in_first_out(spark):
    nodes, edges, expected = [], [], {}
    for k in range(6):
        r = random.Random(k)
        names = [f"n{i:02d}" for i in range(14)]
        order = names[:]
        r.shuffle(order)
        links = [(order[min(a, b)], order[max(a, b)]) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(4 + 5 * k)) if a != b]
        if k % 2:
            links += [(order[5], order[2]), (order[2], order[5])]
        links.append((order[0], "elsewhere"))
        nodes += [(f"p{k}", n, i // 2) for i, n in enumerate(names)]
        edges += [(f"p{k}", s, t) for s, t in links]
        done, rest = _queue(names, links)
        expected |= {(f"p{k}", n): (i, i < len(done)) for i, n in enumerate(done + rest)}
    got = graph.call_order(spark.createDataFrame(nodes, "project_name string, id string, ordinal long"), spark.createDataFrame(edges, "project_name string, source_id string, target_id string"))
    assert {(r["project_name"], r["id"]): (r["position"], r["ordered"]) for r in got.collect()} == expected


def _walk(pairs):
    gone = set()
    for a, b, up in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(a if up else b)
    return gone


def test_settle_pairs(spark):
    for seed, nodes, many in ((1, 25, 40), (2, 60, 90), (3, 12, 60)):
        r = random.Random(seed)
        weight = [r.randrange(3) for _ in range(nodes)]
        pairs = {tuple(sorted((r.randrange(nodes), r.randrange(nodes)))) for _ in range(many)}
        rows = [(a, b, weight[a] < weight[b]) for a, b in pairs if a != b]
        removed, n = rounds.settle_pairs(spark.createDataFrame(rows, "a long, b long, up boolean"))
        assert sorted(x[0] for x in removed.collect()) == sorted(_walk(rows))
        assert n <= nodes
    clique = [(a, b, False) for b in range(30) for a in range(b)]
    removed, n = rounds.settle_pairs(spark.createDataFrame(clique, "a long, b long, up boolean"))
    assert n == 1 and removed.count() == 29
    removed, n = rounds.settle_pairs(spark.createDataFrame([], "a long, b long, up boolean"))
    assert n == 0 and removed.collect() == []


def test_settle_pairs_in_rounds_and_in_one_walk(spark, monkeypatch):
    r = random.Random(4)
    weight = [r.randrange(3) for _ in range(40)]
    rows = [(a, b, weight[a] < weight[b]) for a in range(40) for b in range(a + 1, 40) if r.random() < 0.1]
    for together in (0, 12, rounds.TOGETHER):
        monkeypatch.setattr(rounds, "TOGETHER", together)
        removed, n = rounds.settle_pairs(spark.createDataFrame(rows, "a long, b long, up boolean"))
        assert sorted(x[0] for x in removed.collect()) == sorted(_walk(rows))
    assert n == 1  # no chain of nodes that wait for each other


def test_settle_apart(spark, monkeypatch):
    for share, heavy, together in ((0.2, 0.3, 0), (0.5, 0.1, 30), (0.5, 0.8, 30), (0.5, 0.3, rounds.TOGETHER)):
        r = random.Random(together)
        rows = [(a, b, r.random() < heavy) for a in range(12) for b in range(12, 80) if r.random() < share]
        monkeypatch.setattr(rounds, "TOGETHER", together)
        got = [x[0] for x in rounds.settle_apart(spark.createDataFrame(rows, "a long, b long, up boolean")).collect()]
        assert sorted(got) == sorted(_walk(rows))
    assert rounds.settle_apart(spark.createDataFrame([], "a long, b long, up boolean")).collect() == []


def test_numbered(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), (50 - F.col("id")).alias("o"))
    got = rounds.numbered(df.repartition(4), ["g"], ["o"]).collect()
    for g in range(3):
        rows = sorted((r["o"], r["position"]) for r in got if r["g"] == g)
        assert [p for _, p in rows] == list(range(len(rows)))
