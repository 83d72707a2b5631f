"""Roll-ups over topology, costs and risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import fixed
from auditframe.functions.scoring import estimate_effort, priority, severity_order
from auditframe.operators.common import count_where, first_per_group, one_row


def business_value(top_drivers: DataFrame, risks: DataFrame) -> DataFrame:
    """Savings to expect from the HIGH drivers, and risks to mitigate, as one row."""
    high = F.col("impact") == "HIGH"
    savings = F.coalesce(F.sum(F.when(high, F.col("total_cost_ms"))), F.lit(0.0)) * vocab.SAVINGS_SHARE
    costs = top_drivers.agg(
        savings.alias("cost_savings_potential_ms"),
        (savings / 1000 / 60 / 60).alias("cost_savings_potential_hours_per_day"),
        count_where(high).alias("high_impact_cost_drivers"),
        F.count("*").alias("total_optimizable_queries"),
    )
    counted = risks.agg(
        count_where(F.col("severity") == "CRITICAL").alias("critical_risks_to_mitigate"),
        count_where(F.col("severity") == "HIGH").alias("high_risks_to_mitigate"),
    )
    return one_row(costs, counted)


def audit_metrics(topology: DataFrame, costs: DataFrame, risks: DataFrame) -> DataFrame:
    """Ten key figures from topology_statistics, cost_summary and the risk register."""
    system = topology.select(
        F.col("total_nodes").alias("total_components"),
        F.col("total_edges").alias("total_dependencies"),
        "spof_count",
    )
    cost = costs.select(
        "total_cost_ms",
        F.col("high_impact_count").alias("high_impact_costs"),
        F.col("total_queries_analyzed").alias("queries_analyzed"),
    )
    risk = risks.agg(
        F.count("*").alias("total_risks"),
        count_where(F.col("severity") == "CRITICAL").alias("critical_risks"),
        count_where(F.col("severity") == "HIGH").alias("high_risks"),
        count_where(F.col("category") == "security").alias("security_issues"),
    )
    return one_row(system, cost, risk)


def _ranked(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows with their place (from 1) in ``position``.

    Only ``k`` rows reach the single task that numbers them.
    """
    few = df.orderBy(*order).limit(k).withColumn("_all", F.lit(0))
    return first_per_group(few, ["_all"], list(order), k, "position").drop("_all")


def _cost_order():
    return (F.desc("total_cost_ms"), F.col("first_seq"))


def _risk_order():
    return (F.desc("risk_score"), severity_order(F.col("severity")), F.col("detector_ord"), F.col("item_key"))


def top_findings(drivers: DataFrame, risks: DataFrame, k_costs: int = 2, k_risks: int = 3) -> DataFrame:
    """The costliest drivers and the highest risks in one shape."""
    cost = _ranked(drivers, k_costs, *_cost_order()).select(
        F.lit("cost").alias("type"),
        "position",
        F.concat(F.lit("Cost Driver: "), F.coalesce("table", F.lit("None"))).alias("title"),
        F.format_string(
            "Query pattern executing %d times with total cost of %sms",
            F.col("execution_count"),
            fixed(F.col("total_cost_ms"), 0),
        ).alias("description"),
        "impact",
        "recommendations",
    )
    risk = _ranked(risks, k_risks, *_risk_order()).select(
        F.lit("risk").alias("type"),
        "position",
        "title",
        "description",
        F.col("severity").alias("impact"),
        F.array("mitigation").alias("recommendations"),
    )
    return cost.unionByName(risk)


def prioritize(drivers: DataFrame, risks: DataFrame, k: int = 10, k_each: int = 5) -> DataFrame:
    """Recommendations from the top drivers and risks, most urgent first.

    Columns: rank, priority, category, title, description, impact, effort, source.
    """
    advice = F.get("recommendations", F.lit(0))
    cost = (
        _ranked(drivers, k_each, *_cost_order())
        .where(advice.isNotNull())
        .select(
            F.lit(0).alias("source_ord"),
            "position",
            priority(F.lit("cost"), F.col("impact")).alias("priority"),
            F.lit("performance").alias("category"),
            F.concat(F.lit("Optimize "), F.coalesce("table", F.lit("None")), F.lit(" performance")).alias("title"),
            advice.alias("description"),
            "impact",
            F.when(F.contains(F.lower(advice), F.lit("index")), "LOW").otherwise("MEDIUM").alias("effort"),
            F.lit("cost_analysis").alias("source"),
        )
    )
    risk = (
        _ranked(risks, k_each, *_risk_order())
        .where(F.coalesce("mitigation", F.lit("")) != "")
        .select(
            F.lit(1).alias("source_ord"),
            "position",
            priority(F.lit("risk"), F.col("severity")).alias("priority"),
            "category",
            F.concat(F.lit("Mitigate: "), "title").alias("title"),
            F.col("mitigation").alias("description"),
            F.col("severity").alias("impact"),
            estimate_effort(F.col("category")).alias("effort"),
            F.lit("risk_analysis").alias("source"),
        )
    )
    ranked = _ranked(cost.unionByName(risk), k, F.desc("priority"), F.col("source_ord"), F.col("position"))
    return ranked.select(
        F.col("position").alias("rank"), "priority", "category", "title", "description", "impact", "effort", "source"
    )


def action_plan(recommendations: DataFrame) -> DataFrame:
    """Recommendations by phase: at most five LOW, five MEDIUM and three HIGH efforts."""
    phase = F.when(F.col("effort") == "LOW", 1).when(F.col("effort") == "MEDIUM", 2).when(F.col("effort") == "HIGH", 3)
    numbered = first_per_group(recommendations.withColumn("phase", phase), ["effort"], [F.col("rank")], 5, "item")
    room = F.when(F.col("effort") == "HIGH", 3).otherwise(5)
    return numbered.where(F.col("phase").isNotNull() & (F.col("item") <= room)).select(
        "phase", "item", "title", "impact", "category", "effort"
    )


def appendix_risks(risks: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` CRITICAL and HIGH risks of the ranked register."""
    serious = risks.where(F.col("severity").isin("CRITICAL", "HIGH"))
    return _ranked(serious, k, *_risk_order()).select(
        "position", "title", "severity", "category", "confidence", "description", "mitigation",
    )
