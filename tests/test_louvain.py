"""Multi-level communities against a plain Louvain."""

import random

import pytest

from phrasemine.functions import scratch
from phrasemine.operators import graph


def modularity_by_hand(edges, label):
    m = sum(w for *_, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        degree[label[a]] = degree.get(label[a], 0) + w
        degree[label[b]] = degree.get(label[b], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def louvain_by_hand(nodes, edges):
    """One node after the other, level by level."""
    of = {n: n for n in nodes}
    while True:
        near, degree, m = {}, {}, sum(w for *_, w in edges)
        for a, b, w in edges:
            degree[a] = degree.get(a, 0) + w
            degree[b] = degree.get(b, 0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
                near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
        label, total = {n: n for n in degree}, dict(degree)
        moved = True
        while moved:
            moved = False
            for n in sorted(degree):
                to = {}
                for x, w in near.get(n, {}).items():
                    to[label[x]] = to.get(label[x], 0) + w
                total[label[n]] -= degree[n]
                best = max({*to, label[n]}, key=lambda c: (to.get(c, 0) - total[c] * degree[n] / (2 * m), c == label[n], -c))
                total[best] += degree[n]
                moved |= best != label[n]
                label[n] = best
        if all(label[n] == n for n in label) or len(set(label.values())) == len(label):
            return of
        of = {n: label.get(c, c) for n, c in of.items()}
        merged = {}
        for a, b, w in edges:
            x, y = sorted((label[a], label[b]))
            merged[x, y] = merged.get((x, y), 0) + w
        edges = [(x, y, w) for (x, y), w in merged.items()]


def cliques(n, size):
    e = [(c * size + i, c * size + j, 1.0) for c in range(n) for i in range(size) for j in range(i + 1, size)]
    return e + [(c * size, ((c + 1) % n) * size + 1, 1.0) for c in range(n)]


def planted(seed, groups, size, inside, outside):
    r = random.Random(seed)
    n = groups * size
    return [(i, j, round(r.uniform(0.5, 1.5), 3)) for i in range(n) for j in range(i + 1, n) if r.random() < (inside if i // size == j // size else outside)]


@pytest.mark.parametrize("edges", [cliques(24, 5), planted(1, 6, 20, 0.5, 0.02), planted(2, 12, 8, 0.7, 0.05)], ids=["cliques", "planted", "small groups"])
def test_louvain_is_as_good_as_a_plain_one(spark, edges):
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    levels = graph.louvain_levels(spark.createDataFrame([(n,) for n in nodes], "node long"), df)
    quality = [q for _, q in levels]
    assert quality == sorted(quality)
    label = {r.node: r.community for r in levels[-1][0].collect()}
    assert set(label) == set(nodes) and abs(modularity_by_hand(edges, label) - quality[-1]) < 1e-9
    assert quality[-1] >= modularity_by_hand(edges, louvain_by_hand(nodes, edges)) - 0.02


def test_louvain_without_edges(spark):
    nodes = spark.range(3).withColumnRenamed("id", "node")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert sorted(tuple(r) for r in graph.louvain(nodes, none).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert graph.louvain(nodes.limit(0), none).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_roots_of_a_path_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(3)
    names = r.sample(range(1000), 300)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[150], names[i]) for i in range(151, 300)] + [(names[120], names[120])]
    got = {x.node: x.root for x in graph.roots(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(names[:100], min(names[:100])), **dict.fromkeys(names[150:], min(names[150:]))}
    assert graph.roots(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_levels_keep_only_their_labels(spark):
    """Graphs, degrees and labels of a level go with it, so that disk does not grow with the rounds."""
    nodes = spark.range(120).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in cliques(24, 5)], "src long, dst long, weight double")
    before = set(scratch._made)
    levels = graph.louvain_levels(nodes, edges)
    left = [p for p in scratch._made if p not in before]
    assert len(levels) > 1 and sum("-sym-" in p or "-degree-" in p for p in left) == 0 and sum("-graph-" in p for p in left) == 1
    assert levels[0][0].count() == levels[-1][0].count() == 120
