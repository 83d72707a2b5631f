"""Document and text operators."""

from pyspark.sql import functions as F

from auditframe.functions import text
from auditframe.operators import common, documents
from auditframe.sources.files import redact_documents
from checks.registry import cte, check

# RE2 spellings of Unicode-aware \w and \s.
_W = r"[\p{L}\p{N}_]"
_S = r"[\s\v]"


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\w", _W).replace(r"\s", _S)


_TRIBAL = [
    r"contact\s+(\w+)", r"ask\s+(\w+)", r"only\s+(\w+)\s+knows",
    r"(\w+)\s+is\s+the\s+only\s+one", r"reach\s+out\s+to\s+(\w+)", r"see\s+(\w+)\s+for",
]
_MANUAL = [
    r"manually\s+(\w+)", r"run\s+this\s+command", r"execute\s+the\s+following", r"ssh\s+into", r"log\s+into",
]


def redacted(col: str) -> str:
    for p in (
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b[A-Za-z0-9]{32,}\b", r"AKIA[0-9A-Z]{16}",
        r'token["\s:=]+[A-Za-z0-9_\-]{20,}', r'password["\s:=]+\S+',
    ):
        col = f"regexp_replace({col}, '(?i){p}', '[REDACTED]', 'g')"
    return col


def _hits(patterns, group: int, width: int) -> str:
    """Every match of every pattern with its position and surrounding text."""
    half = width // 2
    parts = " UNION ALL ".join(
        f"SELECT doc_id, path, content, {i} AS ord, regexp_extract_all(content, '{_re2(p)}', 0) AS m, "
        f"regexp_extract_all(content, '{_re2(p)}', {group}) AS found, string_split_regex(content, '{_re2(p)}') AS g FROM v_docs"
        for i, p in enumerate(patterns)
    )
    return f"""
SELECT doc_id, path, ord, n - 1 AS n, found, pos,
       CASE WHEN pos > {half} THEN '...' ELSE '' END
       || trim(substr(content, greatest(pos - {half}, 0) + 1, least(length(content), pos + {half}) - greatest(pos - {half}, 0)), ' ' || chr(10) || chr(9) || chr(13))
       || CASE WHEN pos + {half} < length(content) THEN '...' ELSE '' END AS context
FROM (SELECT doc_id, path, content, ord, n, found[n] AS found,
             CAST(list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:n-1], lambda x: length(x))), 0) AS BIGINT) AS pos
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM ({parts}) p WHERE len(m) > 0) q) r"""


cte("o_mentions", "v_docs", sql=_hits(_TRIBAL, 1, 100))
cte("o_manual_hits", "v_docs", sql=_hits(_MANUAL, 0, 150))
cte("o_people", "o_mentions", sql="""
SELECT lower(found) AS person, count(*) AS mentions, count(DISTINCT path) AS files,
       arg_min(lpad(CAST(doc_id AS VARCHAR), 19, '0') || '/' || lpad(CAST(ord AS VARCHAR), 19, '0') || '/' || lpad(CAST(n AS VARCHAR), 19, '0'), (doc_id, ord, n)) AS item_key
FROM o_mentions GROUP BY 1 HAVING count(*) >= 2""")
cte("o_first3", "o_mentions", sql="""
SELECT person, rn, path, context FROM (
  SELECT lower(found) AS person, path, context, row_number() OVER (PARTITION BY lower(found) ORDER BY doc_id, ord, n) AS rn FROM o_mentions) t WHERE rn <= 3""")
cte("o_tribal", "o_people", "o_first3", sql="""
SELECT 1 AS detector_ord, p.item_key, 'Tribal Knowledge: ' || upper(left(p.person, 1)) || substr(p.person, 2) AS title,
       'Person "' || upper(left(p.person, 1)) || substr(p.person, 2) || '" is mentioned ' || p.mentions || ' times across ' || p.files || ' document(s) as a knowledge source. This indicates tribal knowledge dependency.' AS description,
       CASE WHEN p.mentions >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'tribal_knowledge' AS category, 'medium' AS confidence,
       'Document expertise of ' || upper(left(p.person, 1)) || substr(p.person, 2) || ' in formal documentation' AS mitigation,
       e.evidence AS evidence
FROM o_people p JOIN (SELECT person, string_agg('document|' || path || '|' || context, chr(10) ORDER BY rn) AS evidence FROM o_first3 GROUP BY 1) e ON p.person = e.person""")
cte("o_manual", "o_manual_hits", sql="""
SELECT 2 AS detector_ord, lpad(CAST(doc_id AS VARCHAR), 19, '0') AS item_key, 'Manual Operations in ' || regexp_extract(path, '[^/]*$') AS title,
       'Document contains ' || count(*) || ' manual operation(s). Manual processes are error-prone and not scalable.' AS description,
       'MEDIUM' AS severity, 'manual_ops' AS category, 'medium' AS confidence, 'Automate these operations with scripts or CI/CD' AS mitigation,
       array_to_string(list_transform(list(context ORDER BY ord, n)[1:3], lambda c: 'document|' || path || '|' || c), chr(10)) AS evidence
FROM o_manual_hits GROUP BY doc_id, path HAVING count(*) >= 2""")


def flat_risks(df, *extra):
    """A risk table with its evidence as text, for comparing."""
    shown = F.array_join(
        F.transform("evidence", lambda e: F.concat_ws("|", e["type"], e["path"], e["details"])), "\n"
    )
    return df.select(
        "detector_ord", "item_key", "title", "description", "severity", "category", "confidence", "mitigation",
        shown.alias("evidence"), *extra,
    )


@check("T1_redact_documents", sql=f"SELECT doc_id, {redacted('text')} AS content FROM documents")
def _(t):
    return redact_documents(t.base("documents").select("doc_id", F.col("text").alias("content")))


@check("T1_redact_custom_patterns", sql=r"""
SELECT page_id, regexp_replace(regexp_replace(url, '(?i)https?://[^/]+', '[REDACTED]', 'g'), '(?i)\d{2,}', '[REDACTED]', 'g') AS url FROM pages""")
def _(t):
    return t.base("pages").select("page_id", text.redact(F.col("url"), [r"https?://[^/]+", r"\d{2,}"]).alias("url"))


@check("T2_match_positions", "v_docs", sql=rf"""
SELECT doc_id, array_to_string(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)), ',') AS positions
FROM (SELECT doc_id, regexp_extract_all(content, '{_re2("only")}', 0) AS m, string_split_regex(content, '{_re2("only")}') AS g FROM v_docs) t""")
def _(t):
    return t.docs.select(
        "doc_id", F.array_join(text.match_positions(F.col("content"), text.WORDS + "only").cast("array<string>"), ",").alias("positions")
    )


@check("T2_match_contexts", "o_mentions", sql="SELECT doc_id, ord, CAST(n AS INTEGER) AS n, lower(found) AS person, context FROM o_mentions")
def _(t):
    found = documents.person_mentions(t.docs, "doc_id")
    return found.select(F.col("doc_key").cast("bigint").alias("doc_id"), "ord", "n", "person", "context")


_BULLET = r"^[\d\-\*•][\s\v]*\.?[\s\v]+"


@check("T3_extract_recommendations", sql=rf"""
SELECT conv_id, turn, array_to_string((CASE WHEN len(bullets) > 0 THEN bullets ELSE hinted END)[1:3], '|') AS recommendations
FROM (SELECT conv_id, turn,
        list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '{_BULLET}')), lambda x: regexp_replace(x, '{_BULLET}', '')), lambda x: length(x) > 10) AS bullets,
        list_filter(lines, lambda x: regexp_matches(lower(x), 'optimize|improve|add|remove|consider|recommend|suggest')) AS hinted
      FROM (SELECT conv_id, turn, list_transform(string_split(replace(text, '. ', chr(10) || CASE WHEN turn % 3 = 0 THEN '- ' WHEN turn % 3 = 1 THEN '1. ' ELSE '' END), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS lines FROM conversations) a) b""")
def _(t):
    listed = F.replace(
        F.col("text"),
        F.lit(". "),
        F.concat(F.lit("\n"), F.when(F.col("turn") % 3 == 0, "- ").when(F.col("turn") % 3 == 1, "1. ").otherwise("")),
    )
    return t.base("conversations").select(
        "conv_id", "turn", F.array_join(text.extract_recommendations(listed), "|").alias("recommendations")
    )


@check("T4_preview", sql="""
SELECT doc_id, '**' || source || '** (' || lang || '):' || chr(10) || left(text, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END || chr(10) AS preview FROM documents""")
def _(t):
    return t.base("documents").select(
        "doc_id", text.preview(F.col("source"), F.col("lang"), F.col("text")).alias("preview")
    )


@check("T5_fingerprint", sql="""
SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS fingerprint FROM customer""")
def _(t):
    return t.base("customer").select("c_custkey", text.fingerprint("c_name", "c_mktsegment", "c_custkey").alias("fingerprint"))


@check("T5_fingerprint_nulls", sql="""
SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS fingerprint FROM customer""")
def _(t):
    table = t.base("customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return table.select("c_custkey", text.fingerprint("c_mktsegment", "c_custkey").alias("fingerprint"))


@check("T1_redact_any_alternative", sql="SELECT doc_id, regexp_replace(text, '\\w+@[a-z]+|licensed', '[REDACTED]', 'gi') AS content FROM documents")
def _(t):
    return t.base("documents").select("doc_id", text.redact(F.col("text"), [r"\w+@[a-z]+|licensed"]).alias("content"))


@check("T6_dates_arrays_maps_json", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(year(ts) AS INTEGER) AS year, array_to_string(string_split(event_type || ',' || user_id, ',')[1:1], ',') AS head FROM events""")
def _(t):
    return t.base("events").select(
        "event_id",
        F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.year("ts").alias("year"),
        F.array_join(F.slice(F.split(F.concat_ws(",", "event_type", "user_id"), ","), 1, 1), ",").alias("head"),
    )


@check("A7_corpus_metrics", sql=f"SELECT count(*) AS total_documents, CAST(sum(length({redacted('text')})) AS BIGINT) AS total_chars FROM documents")
def _(t):
    return documents.corpus_metrics(redact_documents(t.base("documents").select(F.col("text").alias("content"))))


@check("A9_tribal_knowledge", "o_tribal", sql="SELECT * FROM o_tribal")
def _(t):
    return flat_risks(documents.tribal_knowledge(t.docs, "doc_id"))


@check("A9_tribal_files", "o_mentions", sql="SELECT DISTINCT lower(found) AS person, path FROM o_mentions")
def _(t):
    return documents.tribal_files(documents.person_mentions(t.docs, "doc_id"))


@check("A10_manual_operations", "o_manual", sql="SELECT * FROM o_manual")
def _(t):
    return flat_risks(documents.manual_operations(t.docs, "doc_id"))


@check("W2_first_k_evidence", "o_first3", sql="SELECT person, CAST(rn AS INTEGER) AS rank, path, context FROM o_first3")
def _(t):
    mentions = documents.person_mentions(t.docs, "doc_id")
    return common.first_per_group(mentions, ["person"], [F.col("doc_key"), F.col("ord"), F.col("n")], 3).select(
        "person", "rank", "path", "context"
    )
