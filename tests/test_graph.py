import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from auditframe.operators import code, graph, risk

GRAPHS = {
    "path": [("a", "b"), ("b", "c"), ("c", "d")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")],
    "cycle with loop": [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b")],
    "two nodes": [("a", "b")],
    "random": sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in (random.Random(7).choices(range(18), k=2) for _ in range(45))}),
}


def shortest_path_shares(edges):
    """Betweenness by listing every shortest path."""
    nodes = sorted({n for e in edges for n in e})
    out = {n: sorted({d for s, d in edges if s == n and d != n}) for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)

        def paths(v, t):
            if v == t:
                return [[t]]
            return [[v, *p] for w in out[v] if dist.get(w) == dist[v] + 1 for p in paths(w, t)]

        for t in nodes:
            if t != s and t in dist:
                found = paths(s, t)
                for p in found:
                    for v in p[1:-1]:
                        score[v] += 1 / len(found)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in score.items()}


def with_trees(seed, core, links, hung):
    """A random digraph with trees hung on it, whose edges point up, down or both ways."""
    rng = random.Random(seed)
    names = [f"t{seed}n{i:02d}" for i in range(core + hung)]
    out = {(a, b) for a, b in (rng.choices(names[:core], k=2) for _ in range(links))}
    for i in range(core, core + hung):
        a, b = names[i], names[rng.randrange(i) if rng.random() < 0.5 else rng.randrange(min(core, i))]
        out |= {0: {(a, b)}, 1: {(b, a)}, 2: {(a, b), (b, a)}}[rng.randrange(3)]
    return sorted(out)


GRAPHS |= {f"trees {k}": with_trees(k, core, links, 14) for k, core, links in ((1, 6, 14), (2, 1, 0), (3, 9, 14), (4, 2, 2))}
GRAPHS["both ways"] = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d")]
GRAPHS["one leads, many follow"] = [("h", f"x{i}") for i in range(4)] + [(f"y{i}", "h") for i in range(4)] + [("y0", "y9"), ("y9", "y8"), ("z", "y8")]
#: All side by side, so that one search covers them.
SIDE_BY_SIDE = [(f"{k:02d}{a}", f"{k:02d}{b}") for k, g in enumerate(GRAPHS.values()) for a, b in g]


@pytest.mark.parametrize("settings", [{}, {"fold_rounds": 0}, {"fold_rounds": 1, "source_batches": 3}, {"max_state": 300}])
def test_betweenness_equals_path_enumeration(rows, settings):
    got = {r.id: r.betweenness_centrality for r in graph.betweenness(rows(SIDE_BY_SIDE, "src string, dst string"), **settings).collect()}
    assert got == pytest.approx(shortest_path_shares(SIDE_BY_SIDE), abs=1e-12)


def test_betweenness_of_tiny_graphs(rows):
    for name in ("two nodes", "path", "cycle with loop"):
        got = {r.id: r.betweenness_centrality for r in graph.betweenness(rows(GRAPHS[name], "src string, dst string")).collect()}
        assert got == pytest.approx(shortest_path_shares(GRAPHS[name]))
    none = rows([], "src string, dst string")
    assert [tuple(r) for r in graph.betweenness(none, rows([("x",)], "id string")).collect()] == [("x", 0.0)]


def test_state_of_a_portion_is_bounded(rows, monkeypatch):
    """Sources are split by counted work; trees take no state at all."""
    sizes, real = [], graph._dependencies

    def watched(links, sources):
        visited, flows = real(links, sources)
        sizes.append(visited.count())
        return visited, flows

    monkeypatch.setattr(graph, "_dependencies", watched)
    ring = [(f"r{i:02d}", f"r{(i + 1) % 8:02d}") for i in range(8)]
    got = graph.betweenness(rows(ring, "src string, dst string"), max_state=20).collect()
    assert len(sizes) == 4 and sum(sizes) == 8 * 8 and max(sizes) <= 2 * 20
    assert all(r.betweenness_centrality == pytest.approx(0.5) for r in got)
    sizes.clear()
    star = [(f"s{i}", "hub") for i in range(200)] + [("hub", f"t{i}") for i in range(200)] + [("t0", "end")]
    got = {r.id: r.betweenness_centrality for r in graph.betweenness(rows(star, "src string, dst string")).collect()}
    assert sizes == [] and got["hub"] == pytest.approx(200 * 201 / (401 * 400)) and got["t0"] == pytest.approx(201 / (401 * 400))


@pytest.fixture
def system(rows):
    files = rows(
        [("pkg/a.py", "import pkg.b\nimport os\nc.execute('SELECT * FROM Users')\nc.execute('DELETE FROM users')"),
         ("pkg/b.py", "q = 'SELECT 1 FROM missing'"), ("web/x.js", 'q("insert into orders values (1)")'), ("n.md", "x")],
        "path string, content string",
    )
    tables = rows([(0, "users", 2, 1), (1, "orders", 3, 0)], "seq bigint, table string, n_columns bigint, n_indexes bigint")
    columns = rows(
        [("orders", "user_id", "users", 0), ("orders", "buyer", "users", 1), ("orders", "item", "items", 2), ("users", "id", None, 0)],
        "table string, column string, fk_table string, seq bigint",
    )
    return graph.build_graph(files, tables, columns, code.code_sql(files), code.code_imports(files))


def test_built_graph(system):
    nodes, edges = system
    assert {(r.id, r.type) for r in nodes.collect()} == {
        ("module:pkg/a.py", "module"), ("module:pkg/b.py", "module"), ("module:web/x.js", "module"),
        ("table:users", "table"), ("table:orders", "table"), ("table:items", "unknown")}
    got = {(r.src, r.dst): (r.type, r.metadata) for r in edges.collect()}
    assert got == {
        ("module:pkg/a.py", "module:pkg/b.py"): ("imports", {"import": "pkg.b"}),
        ("module:pkg/a.py", "table:users"): ("uses", {"query_type": "DELETE", "line": "4"}),
        ("module:web/x.js", "table:orders"): ("uses", {"query_type": "INSERT", "line": "1"}),
        ("table:orders", "table:users"): ("references", {"column": "buyer"}),
        ("table:orders", "table:items"): ("references", {"column": "item"}),
    }


def test_metrics_spofs_and_their_risks(rows, system):
    nodes, edges = system
    central = graph.betweenness(edges, nodes)
    row = graph.graph_metrics(nodes, edges, central).collect()[0]
    assert (row.node_count, row.edge_count) == (6, 5)
    assert row.density == pytest.approx(5 / 30)
    assert row.max_degree_centrality == pytest.approx(3 / 5)
    assert row.max_betweenness_centrality == pytest.approx(2 / 20)
    found = graph.spofs(central, nodes, edges, 0.05)
    spof = found.collect()[0]
    assert (spof.node_name, spof.dependencies_count, spof.dependent_count, spof.risk_level) == ("orders", 3, 1, "medium")
    assert graph.spofs(central, nodes, edges).count() == 0  # the limit itself does not count
    stats = graph.topology_statistics(nodes, edges, found).collect()[0]
    assert stats.asDict() == {"total_nodes": 6, "modules": 3, "tables": 2, "total_edges": 5, "spof_count": 1}
    got = risk.spof_risks(found).collect()[0]
    assert (got.title, got.severity, got.attrs["dependent_count"]) == ("SPOF: orders", "MEDIUM", "1")
    assert "high centrality (0.100)" in got.description


def test_metrics_of_tiny_graphs(rows):
    lone = rows([("x",)], "id string")
    none = rows([], "src string, dst string")
    row = graph.graph_metrics(lone, none).collect()[0]
    assert (row.density, row.max_degree_centrality) == (0.0, 1.0)
    row = graph.graph_metrics(lone.where(F.lit(False)), none).collect()[0]
    assert (row.node_count, row.max_degree_centrality) == (0, 0.0)
