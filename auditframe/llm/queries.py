"""The operators applied to the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import ann_collisions, chat_grammar, language_id, line_rules, packing, piece_dropout, prefix_trie, quality_mil, simhash_anchor, structure_repair, substring_debruijn, toxicity_ordinal, url_equivalence
from auditframe.llm.columns import remainder
from auditframe.llm.fingerprints import as_hex
from auditframe.llm.ship import ship
from auditframe.session import materialize

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query and, if given, the SQL that must agree."""
    def register(build):
        LLM_QUERIES[name] = build
        if sql is not None:
            LLM_ORACLES[name] = sql
        return build

    return register


@query("op6_quality_rules", line_rules.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_rules.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def learned_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_mil.BagModel | None:
    """The classifier fitted on labelled rows outside the fold that is held out."""
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    return quality_mil.fit(docs, labels)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_mil.score(docs, learned_quality(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query("op4_simhash_anchor")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_substring_debruijn")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_debruijn.remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_toxicity_ordinal")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity_ordinal.score(docs, toxicity_ordinal.fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_severity", "severity", "score", "predicted")


#: The rules that the pages are judged by.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op8_url_equivalence", url_equivalence.oracle_sql(URL_RULES))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_equivalence.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_ann_collisions")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_collisions.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op2_piece_dropout")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


@query("op13_chat_grammar", chat_grammar.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    #: Fixed value of the contract: a conversation whose texts hold control strings.
    hard = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat_grammar.digests(chat_grammar.read_back(chat_grammar.render(given.unionByName(planted))))


@query("op12_structure_repair", structure_repair.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = structure_repair.damage(given)
    found = materialize(structure_repair.diagnose(damaged), "diagnosed")
    digests = structure_repair.digests(structure_repair.apply(damaged, found))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    rows = rows.join(digests, F.col("id").eqNullSafe(digests["conv_id"]), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op11_prefix_trie", prefix_trie.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
