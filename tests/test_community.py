"""Communities by rounds against the sequential method."""

import random

import pytest

from lattica.operators import community


def louvain_labels(pairs: dict[tuple[int, int], float], rounds: int = 10) -> dict[int, int]:
    """Community of each node of an undirected weighted graph, as its least node.

    Nodes move, in order of id, to the neighbouring community of the best gain until
    none moves; communities become nodes, and again, until nothing changes.
    """
    weights: dict[int, dict[int, float]] = {}
    for (a, b), w in pairs.items():
        weights.setdefault(a, {})[b] = weights.setdefault(a, {}).get(b, 0) + w
        if a != b:
            weights.setdefault(b, {})[a] = weights.setdefault(b, {}).get(a, 0) + w
    member = {v: v for v in weights}
    total = sum(sum(x.values()) + x.get(v, 0) for v, x in weights.items())
    while total:
        own = {v: v for v in weights}
        degree = {v: sum(x.values()) + x.get(v, 0) for v, x in weights.items()}
        volume = dict(degree)
        moved_any = False
        for _ in range(rounds):
            moved = False
            for v in sorted(weights):
                volume[own[v]] -= degree[v]
                near: dict[int, float] = {own[v]: 0.0}
                for u, w in weights[v].items():
                    if u != v:
                        near[own[u]] = near.get(own[u], 0) + w
                best = max(sorted(near), key=lambda c: (near[c] - degree[v] * volume[c] / total, c == own[v]))
                volume[best] += degree[v]
                if best != own[v]:
                    own[v], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        name: dict[int, int] = {}
        for v, c in own.items():
            name[c] = min(name.get(c, v), v)
        own = {v: name[c] for v, c in own.items()}
        member = {v: own[c] for v, c in member.items()}
        merged: dict[int, dict[int, float]] = {}
        for v, x in weights.items():
            row = merged.setdefault(own[v], {})
            for u, w in x.items():
                if own[u] == own[v]:
                    row[own[v]] = row.get(own[v], 0) + (w if u == v else w / 2)
                else:
                    row[own[u]] = row.get(own[u], 0) + w
        weights = merged
    least: dict[int, int] = {}
    for v, c in member.items():
        least[c] = min(least.get(c, v), v)
    return {v: least[c] for v, c in member.items()}


def sequential_modularity(pairs, label):
    m = sum(pairs.values())
    volume, inside = {}, 0.0
    for (a, b), w in pairs.items():
        inside += w * (label[a] == label[b])
        for v in (a, b):
            volume[label[v]] = volume.get(label[v], 0) + w
    return inside / m - sum(v * v for v in volume.values()) / (4 * m * m)


def graph_of_pairs(spark, make_graph, pairs):
    ids = sorted({v for p in pairs for v in p})
    return make_graph([(v, "Function", f"f{v}", f"t.m.f{v}", "m.py", v, v, "{}") for v in ids], [(a, b, "CALLS", "{}") for (a, b), w in pairs.items() for _ in range(int(w))])


def planted(rng, groups, size, inside, outside):
    n = groups * size
    return {(i, j): 1.0 for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i // size == j // size else outside)}


def ring(cliques, size):
    pairs = {(c * size + i, c * size + j): 1.0 for c in range(cliques) for i in range(size) for j in range(i + 1, size)}
    return pairs | {tuple(sorted((c * size, ((c + 1) % cliques) * size + 1))): 1.0 for c in range(cliques)}


@pytest.mark.parametrize("name", ["planted", "ring", "sparse"])
def test_rounds_are_as_good_as_the_sequential_method(spark, make_graph, name):
    rng = random.Random(3)
    pairs = {"planted": planted(rng, 5, 16, 0.5, 0.03), "ring": ring(8, 5), "sparse": planted(rng, 1, 90, 0.04, 0.0)}[name]
    graph, ids = graph_of_pairs(spark, make_graph, pairs)
    found = community.louvain(graph, ("CALLS",), None)
    rows = {r["id"]: r["community"] for r in found.collect()}
    assert set(rows) == {ids[v] for p in pairs for v in p} and all(c in rows and rows[c] == c and c <= v for v, c in rows.items())
    mine = community.modularity(graph, found, ("CALLS",)).first()["modularity"]
    assert abs(mine - sequential_modularity({(ids[a], ids[b]): w for (a, b), w in pairs.items()}, rows)) < 1e-9
    assert mine > sequential_modularity(pairs, louvain_labels(pairs)) - 0.02


def test_projects_loops_and_single_edges(spark, make_graph):
    graph, ids = make_graph([(k, "Function", k, f"t.{k}", "m.py", 1, 1, "{}") for k in "abcdef"], [("a", "b", "CALLS", "{}"), ("b", "c", "CALLS", "{}"), ("c", "a", "CALLS", "{}"), ("d", "e", "CALLS", "{}"), ("f", "f", "CALLS", "{}")])
    rows = {r["id"]: r["community"] for r in community.louvain(graph, ("CALLS",)).collect()}
    assert rows == {ids[k]: ids[c] for k, c in zip("abcdef", "aaaddf")}
    assert {r["id"] for r in community.louvain(graph, ("CALLS",), drop_singletons=True).collect()} == {ids[k] for k in "abcde"}
