from auditframe.plans.audit import risk_analysis


def test_all_files_of_a_person_are_returned(rows):
    docs = rows([(f"d{i}.md", "Ask Ann about it. Then contact Ann.") for i in range(5)] + [("e.md", "Nothing.")], "path string, content string")
    files = rows([("a.py", "x = 1")], "path string, content string")
    tables = rows([(1, "users")], "seq bigint, table string")
    indexes = rows([], "table string, columns array<string>")
    spofs = rows([], "node_id string, node_name string, betweenness_centrality double, risk_level string")
    found = risk_analysis(files, docs, tables, indexes, spofs)["tribal_files"].collect()
    assert sorted(tuple(r) for r in found) == [("ann", f"d{i}.md") for i in range(5)]
