"""Profile-shaped views of the given tables: the same definitions for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stages import spread

# name: body of a SELECT that both engines read.
VIEWS = {
    "people": """
        SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS segment, c_custkey AS ord
        FROM customer""",
    "abilities": """
        SELECT user_id AS person_id, event_type AS ability, event_id AS ord FROM events""",
    "education": """
        SELECT o_custkey AS person_id, o_orderpriority AS degree, o_orderstatus AS institution,
               o_orderkey AS ord
        FROM orders""",
    "experience": """
        SELECT o_custkey AS person_id,
               CASE WHEN l_returnflag = 'A' THEN concat('Senior ', p_name)
                    WHEN l_returnflag = 'R' THEN concat(p_name, '; ', p_type)
                    ELSE concat(' ', p_name, '  (', p_brand, ')!') END AS title,
               l_orderkey * 8 + l_linenumber AS ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "person_skills": """
        SELECT o_custkey AS person_id, concat('"', p_type, '" ', p_brand) AS skill,
               l_orderkey * 8 + l_linenumber AS ord
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "titles": """
        SELECT p_partkey AS person_id, p_partkey AS ord,
               CASE p_partkey % 14
                 WHEN 0 THEN concat('Senior ', p_name)
                 WHEN 1 THEN concat(p_name, ' (Remote)')
                 WHEN 2 THEN concat(p_name, ' & ', p_type)
                 WHEN 3 THEN concat(p_name, ', ', p_type)
                 WHEN 4 THEN concat(p_type, ' - ', p_name)
                 WHEN 5 THEN concat('Front-End ', p_name)
                 WHEN 6 THEN concat(p_name, '; ', p_brand)
                 WHEN 7 THEN concat('MySQL ', p_name, ' and MongoDB')
                 WHEN 8 THEN concat('Java-DevOps ', p_name)
                 WHEN 9 THEN concat('UI/UX ', p_name, ' ', CAST(p_size AS VARCHAR(20)))
                 WHEN 10 THEN concat('Lead my', 'FrontEnd ', p_name)
                 WHEN 11 THEN concat('Contract ', p_name, ' | ', p_brand)
                 WHEN 12 THEN concat(p_name, ' Jr. Leader')
                 ELSE concat('Internal ', p_name, ' to Dev-', p_type, '-Ops') END AS title
        FROM part""",
    "results": """
        SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS resume_id,
               concat('j', CAST(l_partkey % 50 AS VARCHAR(20))) AS job_id,
               row_number() OVER (PARTITION BY o_custkey
                 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT concat('d', CAST(doc_id AS VARCHAR(20))), source, 1 FROM documents""",
    "judgment_rows": """
        SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS resume_id,
               concat('j', CAST(o_orderkey % 50 AS VARCHAR(20))) AS job_id,
               CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2
                         WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS DOUBLE) AS relevance,
               o_orderkey AS ord
        FROM orders
        UNION ALL
        SELECT concat('d', CAST(labels.doc_id AS VARCHAR(20))), source, CAST(quality AS DOUBLE), labels.doc_id
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "corpus_documents": """
        SELECT doc_id AS person_id, title, text AS embedding_text
        FROM documents JOIN titles ON doc_id = titles.person_id""",
    "query_documents": """
        SELECT conv_id * 100 + turn AS query_id, text FROM conversations""",
}

DEPENDS = {"corpus_documents": ["titles"]}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


# Tables with text that is cleaned, tokenized or matched: heavy per row.
SPREAD_TABLES = ("documents", "conversations", "pages", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in SPREAD_TABLES else scan


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are bound by argument, so nothing is registered in the session."""
    body, sources = VIEWS[name], {}
    for t in TABLES:
        if f" {t} " in f"{' '.join(body.split())} ":
            sources[t] = table(spark, sf_dir, t)
    for v in DEPENDS.get(name, []):
        sources[v] = view(spark, sf_dir, v)
    for n in sources:
        for keyword in ("FROM", "JOIN"):
            body = body.replace(f"{keyword} {n}", f"{keyword} {{{n}}} AS {n}")
    return spark.sql(body, **sources)


def with_views(sql: str, *names: str) -> str:
    """SQL text with the named views as common table expressions in front."""
    wanted: list[str] = []
    for name in names:
        for v in [*DEPENDS.get(name, []), name]:
            if v not in wanted:
                wanted.append(v)
    head = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in wanted)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {head},\n{sql[5:]}"
    return f"WITH {head}\n{sql}"
