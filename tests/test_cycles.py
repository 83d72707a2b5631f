"""Strongly connected components and circuits against plain searches."""

import itertools
import random

from auditframe import session
from auditframe.operators import cycles, graph

LINK = "src string, dst string"


def reachable(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    far = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        far[a] = seen
    return far


def components(edges):
    far = reachable({e for e in edges if e[0] != e[1] and None not in e})
    groups = {a: min(b for b in far if b in far[a] and a in far[b]) for a in far if a in far[a]}
    return groups


def circuits(edges):
    links = {e for e in edges if e[0] != e[1] and None not in e}
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    found = set()

    def go(path):
        for b in out.get(path[-1], ()):
            if b == path[0]:
                found.add(tuple(path))
            elif b > path[0] and b not in path:
                go([*path, b])

    for a in out:
        go([a])
    return found


def ring(name, n):
    return [(f"{name}{i:05d}", f"{name}{(i + 1) % n:05d}") for i in range(n)]


def chain(name, n, *ends):
    nodes = [ends[0]] * bool(ends[0]) + [f"{name}{i:05d}" for i in range(n)] + [ends[1]] * bool(ends[1])
    return list(zip(nodes, nodes[1:]))


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return [(f"n{a:02d}", f"n{b:02d}") for a, b in (rng.choices(range(nodes), k=2) for _ in range(edges))]


GRAPHS = {
    "none": [],
    "loops and nulls": [("a", "a"), (None, "a"), ("a", None), ("a", "b"), ("a", "b")],
    "two": [("a", "b"), ("b", "a")],
    "ring": ring("r", 9),
    "rings joined": ring("r", 7) + ring("s", 5) + [("r00003", "s00002")],
    "tails": ring("r", 4) + chain("in", 40, None, "r00001") + chain("out", 50, "r00002", None) + chain("by", 12, "r00003", "r00000"),
    "chain back to itself": [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "a"), ("x", "a"), ("a", "y")],
    "ladder": [(f"{s}{i:02d}", f"{t}{i + (s == t):02d}") for i in range(12) for s in "ab" for t in "ab" if s != t or i < 11],
    **{f"random {k}": random_graph(k, 22, n) for k, n in ((1, 24), (2, 30), (3, 36), (4, 44))},
    "names that sort against the walk": [(chr(122 - i), chr(122 - (i + 1) % 6)) for i in range(6)] + [("w", "z"), ("v", "q"), ("q", "z")],
}


#: All graphs side by side, so that they are searched at once.
ALL = [tuple(None if n is None else f"{k:02d}{n}" for n in e) for k, g in enumerate(GRAPHS.values()) for e in g]


def test_components_and_circuits(rows):
    edges = rows(ALL, LINK)
    groups, want = components(ALL), circuits(ALL)
    assert {r["node"]: r["component"] for r in cycles.strong_components(edges).collect()} == groups
    found, report = cycles.cycle_search(edges)
    found = found.collect()
    assert len(found) == len({tuple(r["path"]) for r in found}) and {tuple(r["path"]) for r in found} == want
    assert all(r["length"] == len(r["path"]) and groups[r["path"][0]] == r["component"] for r in found)
    assert {r["component"]: (r["nodes"], r["circuits"], r["complete"]) for r in report.collect()} == {
        c: (sum(g == c for g in groups.values()), sum(groups[p[0]] == c for p in want), True) for c in set(groups.values())}


def test_no_edges(rows):
    edges = rows([], LINK)
    assert cycles.strong_components(edges).collect() == [] and [df.collect() for df in cycles.cycle_search(edges)] == [[], []]


def test_long_tails_and_rings_take_few_rounds(rows, monkeypatch):
    """Two thousand nodes in a row: pointers double, nodes are not peeled off one by one."""
    edges = ring("r", 2000) + chain("in", 1500, None, "r00001") + chain("out", 1500, "r00002", None) + [("r00005", "r00001")]
    rounds = []
    real = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, label="table": (rounds.append(label), real(df, label))[1])
    found, report = cycles.cycle_search(rows(edges, LINK))
    assert sorted(r["length"] for r in found.collect()) == [5, 2000]
    assert [tuple(r) for r in report.collect()] == [("r00000", 2000, 2001, 2, True)]
    assert len(rounds) < 80


def test_a_dense_component_is_given_up_alone(rows):
    dense = [(a, b) for a in "abcdefghij" for b in "abcdefghij"]
    edges = rows(dense + ring("r", 5), LINK)
    found, report = cycles.cycle_search(edges, max_paths=100)
    assert {r["component"]: r["complete"] for r in report.collect()} == {"a": False, "r00000": True}
    got = {tuple(r["path"]) for r in found.collect()}
    assert {p for p in got if len(p) == 2} == {(a, b) for a, b in itertools.combinations("abcdefghij", 2)}
    assert tuple(f"r{i:05d}" for i in range(5)) in got


def test_limited_length(rows):
    links = GRAPHS["random 4"] + [("zz", "zy"), ("zy", "zz")]
    edges = rows(links, LINK)
    found, report = cycles.cycle_search(edges, max_len=4)
    want = circuits(links)
    assert {tuple(r["path"]) for r in found.collect()} == {p for p in want if len(p) <= 4}
    complete = {r["component"]: r["complete"] for r in report.collect()}
    assert complete.pop("zy") and not any(complete.values())
    assert {tuple(r["path"]) for r in graph.simple_cycles(edges, max_len=4).collect()} == {p for p in want if len(p) <= 4}
