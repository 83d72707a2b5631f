"""The audit as a whole: costs, topology, risks and the roll-up.

Each step returns named tables. Results that feed several later steps are
written once to the scratch folder, so no source is scanned twice for them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators import code, cycles, documents, graph, query_log, report, risk, schema, security
from auditframe.session import materialize
from auditframe.sinks.artifacts import write_artifact
from auditframe.sources.files import redact_documents
from auditframe.sources.query_log import redact_query_log
from auditframe.sources.schema import schema_columns, schema_indexes, schema_tables

#: Parameter: open paths at which the search for circuits gives a component up; ``circular_components`` tells which are complete.
MAX_OPEN_PATHS = 100_000


def topology(files: DataFrame, dumps: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, single points of failure and figures of the system graph."""
    facts = materialize(code.code_facts(files), "facts")
    nodes, edges = graph.build_graph(
        files.select("path"), schema_tables(dumps), schema_columns(dumps), code.code_sql(facts), code.python_imports(facts)
    )
    nodes, edges = materialize(nodes, "nodes"), materialize(edges, "edges")
    centrality = materialize(graph.betweenness(edges, nodes), "centrality")
    spofs = materialize(graph.spofs(centrality, nodes, edges), "spofs")
    circuits, components = cycles.cycle_search(edges, max_paths=MAX_OPEN_PATHS)
    return {
        "circular_dependencies": circuits,
        "circular_components": components,
        "nodes": nodes,
        "edges": edges,
        "spofs": spofs,
        "topology_metrics": graph.graph_metrics(nodes, edges, centrality),
        "topology_statistics": graph.topology_statistics(nodes, edges, spofs),
    }


def cost_analysis(log: DataFrame, dumps: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Ranked cost drivers with index advice, their components and a summary; per database where the log names it."""
    stats = materialize(query_log.query_stats(log, [c for c in ("database",) if c in log.columns]), "stats")
    drivers = query_log.missing_indexes(query_log.cost_drivers(stats), schema_indexes(dumps), tables=schema_tables(dumps))
    top = materialize(query_log.top_cost_drivers(drivers), "drivers")
    return {
        "cost_drivers": top,
        "cost_components": query_log.affected_components(top.select("query_pattern", "table", *[c for c in ("database",) if c in top.columns]), edges),
        "cost_summary": query_log.cost_summary(stats, top),
        "cost_totals": query_log.cost_totals(query_log.cost_drivers(stats)),
    }


def risk_analysis(files: DataFrame, docs: DataFrame, tables: DataFrame, indexes: DataFrame, spofs: DataFrame) -> dict[str, DataFrame]:
    """The scored register with its counts, the ranked risks and the complete lists behind the index and person risks."""
    unindexed = materialize(schema.unindexed_tables(tables, indexes), "unindexed")
    mentions = materialize(documents.person_mentions(docs), "mentions")
    found = risk.risk_register(
        risk.spof_risks(spofs),
        documents.tribal_risks(mentions),
        documents.manual_operations(docs),
        security.security_issues(files),
        risk.documentation_gap(files, docs),
        schema.unindexed_risk(unindexed),
    )
    register = materialize(found, "register")
    ranked = materialize(risk.rank_risks(register), "ranked")
    return {
        "risk_register": register,
        "risks": ranked,
        "risk_summary": risk.risk_summary(register),
        "risks_by_category": risk.risks_by_category(register),
        "unindexed_tables": unindexed,
        "tribal_files": documents.tribal_files(mentions),
    }


def synthesis(costs: Mapping[str, DataFrame], system: Mapping[str, DataFrame],
              risks: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Key figures, findings, recommendations and the phased plan."""
    drivers, ranked, register = costs["cost_drivers"], risks["risks"], risks["risk_register"]
    advice = materialize(report.prioritize(drivers, ranked), "advice")
    return {
        "audit_metrics": report.audit_metrics(system["topology_statistics"], costs["cost_summary"], register),
        "top_findings": report.top_findings(drivers, ranked),
        "business_value": report.business_value(drivers, register),
        "recommendations": advice,
        "action_plan": report.action_plan(advice),
        "appendix_risks": report.appendix_risks(register),
    }


def ingestion(log: DataFrame, dumps: DataFrame, files: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Figures of the inputs."""
    return {
        "log_metrics": query_log.log_metrics(log),
        "workload_profile": query_log.workload_profile(log),
        "slowest_queries": query_log.slowest_queries(log),
        "repo_inventory": code.repo_inventory(files),
        "corpus_metrics": documents.corpus_metrics(docs),
        "schema_metrics": schema.schema_metrics(schema_tables(dumps), schema_columns(dumps), schema_indexes(dumps)),
    }


def input_sources(log: DataFrame, dumps: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """What was read: kind (log, dump, file, document) and path, each once."""
    def of(kind: str, paths: DataFrame) -> DataFrame:
        return paths.distinct().select(F.lit(kind).alias("kind"), F.col("path").cast("string").alias("path"))

    parts = [of("file", files.select("path")), of("document", docs.select("path")), of("dump", dumps.select(F.col("dump").alias("path")))]
    if dict(log.dtypes)["seq"].startswith("struct<path:"):
        parts.append(of("log", log.select("seq.path")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_audit(log: DataFrame, dumps: DataFrame, files: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """All tables of the audit by name. Texts are redacted first, so no result holds a secret."""
    log, docs = redact_query_log(log), redact_documents(docs)
    system = topology(files, dumps)
    costs = cost_analysis(log, dumps, system["edges"])
    risks = risk_analysis(files, docs, schema_tables(dumps), schema_indexes(dumps), system["spofs"])
    return {
        "sources": input_sources(log, dumps, files, docs),
        **ingestion(log, dumps, files, docs), **system, **costs, **risks, **synthesis(costs, system, risks),
    }


#: The main table of each analysis, the table of its figures and the kinds of sources it rests on.
ANALYSES = {
    "edges": ("topology_metrics", ("dump", "file")),
    "cost_drivers": ("cost_summary", ("log", "dump")),
    "risk_register": ("risk_summary", ("file", "document", "dump")),
}


def write_audit(results: Mapping[str, DataFrame], root: str, engagement_id: str, fmt: str = "parquet") -> None:
    """Write every table of the audit below ``root``, the main ones with their metrics and sources beside them."""
    for name, table in results.items():
        figures, kinds = ANALYSES.get(name, (None, ()))
        beside = {"metrics": results[figures], "sources": results["sources"].where(F.col("kind").isin(*kinds))} if figures else {}
        write_artifact(table, root, name, engagement_id, fmt=fmt, **beside)
