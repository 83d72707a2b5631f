"""Review logs and engagement histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import vocab


def latest_review_status(reviews: DataFrame) -> DataFrame:
    """The most recent decision per artifact; equal times go by log order."""
    return reviews.groupBy("artifact_id").agg(F.max_by("decision", F.struct("ts", "seq")).alias("decision"))


def pending_reviews(reviews: DataFrame) -> DataFrame:
    """Artifacts whose latest decision is ``pending``."""
    return latest_review_status(reviews).where(F.col("decision") == "pending").select("artifact_id")


def review_summary(reviews: DataFrame) -> DataFrame:
    """Number of artifacts per latest decision: decision, artifact_count.

    The four regular decisions always appear, any other one if it occurs.
    """
    spark = reviews.sparkSession
    regular = spark.createDataFrame([(s, 0) for s in vocab.REVIEW_STATUSES], "decision string, n bigint")
    seen = latest_review_status(reviews).select("decision", F.lit(1).cast("bigint").alias("n"))
    return seen.unionByName(regular).groupBy("decision").agg(F.sum("n").alias("artifact_count"))


def next_states(df: DataFrame, state: str = "state") -> DataFrame:
    """Add ``next_states``: the states reachable from ``state``."""
    table = {k: F.array(*[F.lit(s) for s in v]).cast("array<string>") for k, v in vocab.LIFECYCLE_NEXT.items()}
    pairs = [p for k, v in table.items() for p in (F.lit(k), v)]
    found = F.try_element_at(F.create_map(*pairs), F.col(state))
    return df.withColumn("next_states", F.coalesce(found, F.array().cast("array<string>")))


def required_artifacts(df: DataFrame, from_state: str = "from_state", to_state: str = "to_state") -> DataFrame:
    """Add ``required_artifacts`` of the transition."""
    pairs = [
        p
        for (a, b), names in vocab.TRANSITION_ARTIFACTS.items()
        for p in (F.lit(f"{a}>{b}"), F.array(*[F.lit(n) for n in names]))
    ]
    key = F.concat_ws(">", F.col(from_state), F.col(to_state))
    found = F.try_element_at(F.create_map(*pairs), key)
    return df.withColumn("required_artifacts", F.coalesce(found, F.array().cast("array<string>")))


def validate_transitions(history: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Check every step of engagement histories.

    Adds ``legal`` (the step is allowed), ``missing`` (required artifacts the
    engagement lacks) and ``valid``. ``artifacts`` holds engagement_id and
    artifact_type; without it artifacts are not checked. Only the few required
    types are gathered per engagement, so the gathered sets stay small.
    """
    steps = required_artifacts(next_states(history, "from_state"))
    legal = F.array_contains("next_states", F.col("to_state"))
    none = F.array().cast("array<string>")
    if artifacts is None:
        checked = steps.withColumn("missing", none)
    else:
        wanted = sorted({n for names in vocab.TRANSITION_ARTIFACTS.values() for n in names})
        held = (
            artifacts.where(F.col("artifact_type").isin(*wanted))
            .groupBy("engagement_id")
            .agg(F.collect_set("artifact_type").alias("held"))
        )
        lacking = F.array_except("required_artifacts", F.coalesce("held", none))
        checked = steps.join(held, "engagement_id", "left").withColumn(
            "missing", F.when(legal, lacking).otherwise(none)
        )
    return checked.select(
        *history.columns,
        legal.alias("legal"),
        "missing",
        (legal & (F.size("missing") == 0)).alias("valid"),
    )
