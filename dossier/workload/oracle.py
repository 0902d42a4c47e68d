"""SQL twins of the registered queries, for an engine that reads the same tables."""

from __future__ import annotations

from ..functions.terms import ENGLISH_STOP_WORDS
from ..functions.titles import (
    COMPARISON_STOP_WORDS,
    COMPARISON_WORDS,
    CONTRACT_PREFIXES,
    PRESERVED_TERMS,
    SENIORITY_TERMS,
    SPECIAL_TERMS,
)
from ..operators.ranking import K_VALUES, THRESHOLD_GRID
from .views import VIEWS, with_views


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def string_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def clean(c: str) -> str:
    return f"""trim(regexp_replace(translate(coalesce({c}, ''), '''"!', ''), '\\s+', ' ', 'g'))"""


def clean_title(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def case_map(value: str, entries: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in entries.items())


def standardized(source: str, column: str) -> str:
    """SELECT that replaces ``column`` of a relation by its standardized form."""
    seniority = "|".join(SENIORITY_TERMS)
    hits = ", ".join(
        f"CASE WHEN regexp_matches(lower(t7), '\\b{term}\\b') THEN {i} ELSE -1 END"
        for i, term in enumerate(PRESERVED_TERMS)
    )
    marked = "lower(t7)"
    for i, term in enumerate(PRESERVED_TERMS):
        marked = f"regexp_replace({marked}, '\\b{term}\\b', '__preserved_{i}__', 'g')"
    w = r"([\p{L}\p{N}_]+)"
    joined = "t8"
    for gap in ("-", " -", "- ", " - "):
        joined = f"regexp_replace({joined}, '{w}{gap}{w}', '\\1\\2', 'g')"
    united = "t10"
    for head, tail in (("front", "end"), ("back", "end"), ("full", "stack")):
        united = f"regexp_replace({united}, '\\b{head}[\\s-]*{tail}\\b', '{(head + tail).capitalize()}', 'gi')"
    compounds = "['frontend', 'backend', 'fullstack']"
    placeholders = {f"__PRESERVED_{i}__": v for i, v in enumerate(PRESERVED_TERMS.values())}
    # Every step is a subquery of its own, so that no expression is expanded into the next ones.
    steps = [
        ("t1", f"trim(regexp_replace({column}, '[;|(].*$', ''))"),
        ("t2", "replace(t1, '&', ' / ')"),
        ("t3", "regexp_replace(t2, '\\band\\b', ' / ', 'gi')"),
        ("t4", "regexp_replace(t3, '\\b[0-9]+\\b', '', 'g')"),
        ("t5", f"regexp_replace(t4, '^({'|'.join(CONTRACT_PREFIXES)})\\.?\\s+', '', 'i')"),
        ("t6", "CASE WHEN contains(t5, ',') THEN trim(split_part(t5, ',', 1)) ELSE t5 END"),
        ("t7", f"regexp_replace(t6, '^({seniority})\\.?\\s*', '', 'i')"),
        ("last_hit", f"greatest({hits})"),
        ("m0", marked),
        (
            "t8",
            "CASE WHEN last_hit < 0 THEN t7 ELSE replace(m0, "
            "'__preserved_' || last_hit || '__', '__PRESERVED_' || last_hit || '__') END",
        ),
        ("t9", joined),
        ("t10", "regexp_replace(t9, '\\s*/\\s*', ' / ', 'g')"),
        ("t12", f"regexp_replace({united}, '([a-z])([A-Z])', '\\1 \\2', 'g')"),
        ("w1", "list_filter(string_split_regex(t12, '\\s+'), lambda x: x <> '')"),
        (
            "w2",
            f"""list_transform(range(1, len(w1) + 1), lambda i:
            CASE WHEN list_contains({compounds}, lower(w1[i] || coalesce(w1[i + 1], ''))) AND i < len(w1)
                 THEN lower(w1[i] || w1[i + 1])
                 WHEN i > 1 AND list_contains({compounds}, lower(w1[i - 1] || w1[i])) THEN ''
                 ELSE w1[i] END)""",
        ),
        ("w3", f"list_filter(w2, lambda x: x <> '' AND NOT list_contains({string_list(SENIORITY_TERMS)}, lower(x)))"),
        (
            "w4",
            f"""list_transform(w3, lambda x: coalesce({case_map("lower(x)", SPECIAL_TERMS)} END,
            {case_map("x", placeholders)} END, upper(x[1]) || lower(x[2:])))""",
        ),
    ]
    inner = f"(SELECT DISTINCT {column} FROM {source})"
    for name, expression in steps:
        inner = f"(SELECT *, {expression} AS {name} FROM {inner})"
    return f"""
    SELECT s.* EXCLUDE ({column}), d.standardized AS {column}
    FROM {source} s JOIN (
      SELECT {column}, CASE WHEN {column} IS NULL OR {column} = '' THEN 'Unknown Title'
             ELSE trim(regexp_replace(array_to_string(w4, ' '), '\\s+', ' ', 'g')) END AS standardized
      FROM {inner}) d ON s.{column} IS NOT DISTINCT FROM d.{column}
    """


def comparison_keys(source: str, column: str, out: str) -> str:
    """SELECT that adds the comparison key of ``column``."""
    keyed = standardized(f"(SELECT *, {column} AS k0 FROM ({source}))", "k0")
    words = f"(SELECT *, regexp_replace(lower(k0), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS k1 FROM ({keyed}))"
    kept = f"""(SELECT *, list_filter(string_split_regex(trim(k1), '\\s+'),
        lambda x: x <> '' AND NOT list_contains({string_list(COMPARISON_STOP_WORDS)}, x)) AS k2 FROM {words})"""
    return f"""
    SELECT * EXCLUDE (k0, k1, k2),
           CASE WHEN {column} IS NULL OR {column} = '' THEN '' ELSE array_to_string(list_transform(k2, lambda x:
             {case_map("x", COMPARISON_WORDS)} ELSE x END), ' ') END AS {out}
    FROM {kept}
    """


def concatenated(source: str, column: str, out: str) -> str:
    return f"""
    SELECT person_id, coalesce(string_agg(value, '; ' ORDER BY o, value) FILTER (trim(value) <> ''), '') AS {out}
    FROM (SELECT person_id, {column} AS value, min(ord) AS o FROM {source} GROUP BY ALL) GROUP BY person_id
    """


PREPARED = f"""
    abilities_p AS (SELECT person_id, {clean("ability")} AS ability, ord FROM abilities),
    education_p AS (SELECT person_id, {clean("degree")} AS degree, ord FROM education),
    experience_p AS (SELECT person_id, trim(split_part({clean("title")}, ';', 1)) AS title, ord
                     FROM experience),
    skills_p AS (SELECT person_id, {clean("skill")} AS skill, ord FROM person_skills),
    people_p AS (SELECT person_id, {clean("segment")} AS segment, ord FROM people),
    profiles AS (
      SELECT * FROM people_p
      LEFT JOIN ({concatenated("abilities_p", "ability", "ability")}) USING (person_id)
      LEFT JOIN ({concatenated("education_p", "degree", "degree")}) USING (person_id)
      LEFT JOIN ({concatenated("experience_p", "title", "title")}) USING (person_id)
      LEFT JOIN ({concatenated("skills_p", "skill", "skill")}) USING (person_id))
"""
PROFILE_VIEWS = ("people", "abilities", "education", "experience", "person_skills")

CORPUS = f"""{PREPARED},
    first_rows AS (
      SELECT * EXCLUDE (n) FROM (
        SELECT *, row_number() OVER (PARTITION BY segment, ability, degree, title, skill ORDER BY ord) AS n,
               count(*) OVER (PARTITION BY segment, ability, degree, title, skill) AS n_copies FROM profiles)
      WHERE n = 1),
    corpus AS (
      SELECT person_id, segment, ord, coalesce(ability, 'Unknown ability') AS ability, degree, title,
             coalesce(skill, 'Unknown skill') AS skill, n_copies
      FROM ({standardized("first_rows", "title")}))
"""

EMBEDDING_TEXT = f"""concat_ws(' | ', {clean("ability")}, repeat({clean_title("title")}, 3), {clean("skill")})"""


def tokenized(source: str, id: str, column: str) -> str:
    """(id, term) of every term occurrence."""
    return f"""
    SELECT {id}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM (SELECT {id}, list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
            lambda x: NOT list_contains({string_list(ENGLISH_STOP_WORDS)}, x)) AS w FROM {source})
    """


def tfidf(source: str, id: str, column: str, limit: str = "LIMIT 10000") -> str:
    """CTEs: doc_counts, vocabulary, weights of the documents the vocabulary was fitted on."""
    return f"""
    doc_counts AS (SELECT {id}, term, count(*) AS tf FROM ({tokenized(source, id, column)}) GROUP BY ALL),
    vocabulary AS (
      SELECT term, tf, df, ln((1.0 + total) / (1.0 + df)) + 1.0 AS idf
      FROM (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM doc_counts GROUP BY term),
           (SELECT count(*) AS total FROM {source})
      WHERE df >= 5 AND df <= 0.85 * total ORDER BY tf DESC, term {limit}),
    weights AS ({weighted("doc_counts", id)})
    """


def weighted(counts: str, id: str) -> str:
    return f"""
    SELECT {id}, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {id})) AS weight
    FROM (SELECT {id}, term, c.tf, c.tf * idf AS raw FROM {counts} c JOIN vocabulary USING (term))
    """


VECTORS = """
    unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS person_id, round(list_cosine_similarity(q.v, c.v), 9) AS score
      FROM unit q, unit c),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM scored)
"""


def matched(candidates: str, n: int) -> str:
    """CTEs from ranked candidates (query_id, person_id, score, rank, title, ...) to matches."""
    return f"""
    cand AS MATERIALIZED (SELECT *, round_even(score * 100, 2) AS similarity_percentage FROM ({candidates})),
    once AS MATERIALIZED ({standardized("cand", "title")}),
    twice AS MATERIALIZED ({standardized("once", "title")}),
    keyed AS MATERIALIZED ({comparison_keys("SELECT * FROM twice", "title", "title_key")}),
    best AS (
      SELECT * EXCLUDE (title_key) FROM keyed
      QUALIFY row_number() OVER (PARTITION BY query_id, title_key ORDER BY similarity_percentage DESC, rank) = 1),
    matches AS (
      SELECT * EXCLUDE (rank, old_rank), rank FROM (
        SELECT * EXCLUDE (rank), rank AS old_rank,
               row_number() OVER (PARTITION BY query_id ORDER BY similarity_percentage DESC, rank) AS rank
        FROM best) WHERE rank <= {n})
    """


DENSE_MATCHES = (
    VECTORS
    + ", "
    + matched(
        """SELECT query_id, r.person_id, score, rank, title, title AS embedding_text
           FROM ranked r JOIN titles t ON r.person_id = t.person_id WHERE rank <= 15""",
        5,
    )
)

def fitted(queries: str, limit: str = "LIMIT 10000") -> str:
    """CTEs: corpus, cleaned query texts, vocabulary and the weights of both sides."""
    return f"""
    corpus AS (SELECT * FROM corpus_documents),
    {tfidf("corpus", "person_id", "embedding_text", limit)},
    cleaned AS (SELECT query_id, {clean("text")} AS text FROM {queries}),
    query_counts AS (SELECT query_id, term, count(*) AS tf FROM ({tokenized("cleaned", "query_id", "text")}) GROUP BY ALL),
    query_weights AS ({weighted("query_counts", "query_id")})
    """


def candidates(n: int) -> str:
    return f"""SELECT query_id, r.person_id, score, rank, title, embedding_text
    FROM ranked r JOIN corpus c USING (person_id) WHERE rank <= {3 * n}"""


def matched_exactly(n: int) -> str:
    """As ``matched``, from all corpus rows: the best row per title, whatever its rank."""
    return f"""
    once AS MATERIALIZED ({standardized("corpus", "title")}),
    twice AS MATERIALIZED ({standardized("once", "title")}),
    keyed AS MATERIALIZED ({comparison_keys("SELECT * FROM twice", "title", "title_key")}),
    best AS (
      SELECT query_id, person_id, title, embedding_text, r.rank AS place, round_even(score * 100, 2) AS similarity_percentage
      FROM ranked r JOIN keyed USING (person_id)
      QUALIFY row_number() OVER (PARTITION BY query_id, title_key ORDER BY r.rank) = 1),
    matches AS (
      SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank
      FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= {n})
    """


def sparse_matches(queries: str, n: int = 5, limit: str = "LIMIT 10000", exact: bool = False) -> str:
    """CTEs up to the ``n`` best ``matches`` of the query texts against the documents.

    ``exact`` collapses the titles of all documents, not of the first candidates only.
    """
    return f"""
    {fitted(queries, limit)},
    scored AS (
      SELECT q.query_id, c.person_id, round(coalesce(s, 0), 9) AS score
      FROM cleaned q CROSS JOIN corpus c LEFT JOIN (
        SELECT query_id, person_id, sum(a.weight * b.weight) AS s
        FROM query_weights a JOIN weights b USING (term) GROUP BY ALL) USING (query_id, person_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM scored),
    {matched_exactly(n) if exact else matched(candidates(n), n)}
    """


def visible_text(html: str) -> str:
    """Text of a page: no comments, scripts and styles; tags part words; entities are resolved."""
    out = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    out = f"regexp_replace({out}, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs')"
    out = f"regexp_replace({out}, '<!DOCTYPE[^>]*>', '', 'gi')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, character in (("quot;", '"'), ("copy;", "©"), ("middot;", "·"), ("amp;?", "&")):
        out = f"regexp_replace({out}, '&{entity}', {text(character)}, 'g')"
    return out


JUDGED = """
    judgments AS (
      SELECT resume_id, job_id, relevance FROM judgment_rows
      QUALIFY row_number() OVER (PARTITION BY resume_id, job_id ORDER BY ord DESC) = 1),
    judged_resumes AS (SELECT DISTINCT resume_id FROM judgments),
    judged AS (
      SELECT r.resume_id, r.rank, r.job_id, j.relevance FROM results r
      LEFT JOIN judgments j USING (resume_id, job_id)
      WHERE r.resume_id IN (SELECT resume_id FROM judged_resumes)),
    common AS (SELECT DISTINCT resume_id FROM judged)
"""
EVALUATION_VIEWS = ("results", "judgment_rows")


def _ndcg(k: int) -> str:
    return f"""
    SELECT resume_id, 'ndcg' AS metric, {k} AS k, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS score, idcg > 0 AS valid
    FROM (SELECT resume_id, sum(coalesce(relevance, 0) / log2(rank + 1)) FILTER (rank <= {k}) AS dcg
          FROM judged GROUP BY resume_id)
    JOIN (SELECT resume_id, sum(relevance / log2(n + 1)) AS idcg
          FROM (SELECT resume_id, relevance, row_number() OVER (PARTITION BY resume_id ORDER BY relevance DESC) AS n
                FROM judgments) WHERE n <= {k} GROUP BY resume_id) USING (resume_id)"""


def _precision(k: int) -> str:
    return f"""
    SELECT resume_id, 'precision', {k}, count(*) FILTER (relevance >= 1.0) / count(*), true
    FROM judged WHERE rank <= {k} GROUP BY resume_id"""


def _recall(k: int) -> str:
    return f"""
    SELECT resume_id, 'recall', {k},
           CASE WHEN n = 0 THEN 1.0 ELSE count(*) FILTER (relevance >= 1.0 AND rank <= {k}) / n END, true
    FROM judged JOIN relevant USING (resume_id) GROUP BY resume_id, n"""


_MRR = """
    SELECT resume_id, 'mrr', NULL, coalesce(1.0 / min(rank) FILTER (relevance >= 1.0), 0), true
    FROM judged GROUP BY resume_id"""

_MAP = """
    SELECT resume_id, 'map', NULL, CASE WHEN n = 0 THEN 1.0 ELSE coalesce(sum(hits / rank) FILTER (hit), 0) / n END, true
    FROM (SELECT resume_id, rank, coalesce(relevance >= 1.0, false) AS hit,
                 sum(CASE WHEN relevance >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY rank) AS hits
          FROM judged) JOIN relevant USING (resume_id) GROUP BY resume_id, n"""

_CLUSTERS = """
    relevant AS (SELECT resume_id, count(*) FILTER (relevance >= 1.0) AS n FROM judgments GROUP BY resume_id),
    labelled AS (
      SELECT resume_id, job_id, CASE WHEN max(relevance) >= 1.0 THEN floor(max(relevance))::INT ELSE 0 END AS label,
             (max(rank) - 1) // 5 + 1 AS bucket
      FROM judged WHERE relevance IS NOT NULL GROUP BY resume_id, job_id),
    cells AS (SELECT resume_id, label, bucket, count(*) AS n FROM labelled GROUP BY ALL),
    rows_ AS (SELECT resume_id, label, sum(n) AS n FROM cells GROUP BY ALL),
    cols_ AS (SELECT resume_id, bucket, sum(n) AS n FROM cells GROUP BY ALL),
    agreement AS (
      SELECT c.resume_id, t.n AS n,
             p, pa, pb, hc, ha, hb, na, nb
      FROM (SELECT resume_id FROM common) c
      LEFT JOIN (SELECT resume_id, sum(n) AS n FROM cells GROUP BY ALL) t USING (resume_id)
      LEFT JOIN (SELECT resume_id, sum(n * (n - 1) / 2) AS p FROM cells GROUP BY ALL) USING (resume_id)
      LEFT JOIN (SELECT resume_id, sum(n * (n - 1) / 2) AS pa, count(*) AS na FROM rows_ GROUP BY ALL) USING (resume_id)
      LEFT JOIN (SELECT resume_id, sum(n * (n - 1) / 2) AS pb, count(*) AS nb FROM cols_ GROUP BY ALL) USING (resume_id)
      LEFT JOIN (SELECT resume_id, -sum(x.n / y.n * ln(x.n / y.n)) AS hc FROM cells x
                 JOIN (SELECT resume_id, sum(n) AS n FROM cells GROUP BY ALL) y USING (resume_id) GROUP BY ALL) USING (resume_id)
      LEFT JOIN (SELECT resume_id, -sum(x.n / y.n * ln(x.n / y.n)) AS ha FROM rows_ x
                 JOIN (SELECT resume_id, sum(n) AS n FROM cells GROUP BY ALL) y USING (resume_id) GROUP BY ALL) USING (resume_id)
      LEFT JOIN (SELECT resume_id, -sum(x.n / y.n * ln(x.n / y.n)) AS hb FROM cols_ x
                 JOIN (SELECT resume_id, sum(n) AS n FROM cells GROUP BY ALL) y USING (resume_id) GROUP BY ALL) USING (resume_id))
"""

_ARI = """
    SELECT resume_id, 'ari', NULL,
           CASE WHEN n IS NULL OR n < 2 THEN 0
                WHEN abs((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) < 1e-12 THEN 1
                ELSE (p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) END, true
    FROM agreement"""

_NMI = """
    SELECT resume_id, 'nmi', NULL,
           CASE WHEN n IS NULL OR n < 2 THEN 0 WHEN na = 1 AND nb = 1 THEN 1
                WHEN ha + hb - hc < 1e-12 THEN 0 ELSE (ha + hb - hc) / ((ha + hb) / 2) END, true
    FROM agreement"""

_PURITY = """
    SELECT resume_id, 'purity', NULL, coalesce(sum(m) / sum(n), 0), true
    FROM common LEFT JOIN (
      SELECT resume_id, bucket, max(n) AS m, sum(n) AS n FROM (
        SELECT resume_id, (rank - 1) // 5 + 1 AS bucket,
               CASE WHEN relevance >= 1.0 THEN floor(relevance)::INT ELSE 0 END AS label, count(*) AS n
        FROM judged WHERE relevance IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (resume_id) GROUP BY resume_id"""

METRIC_SQL = {
    "ndcg": [_ndcg(k) for k in K_VALUES],
    "precision": [_precision(k) for k in K_VALUES],
    "recall": [_recall(k) for k in K_VALUES],
    "mrr": [_MRR],
    "map": [_MAP],
    "ari": [_ARI],
    "nmi": [_NMI],
    "purity": [_PURITY],
}


def scored(*metrics: str) -> str:
    """CTEs up to ``scores(resume_id, metric, k, score, valid)``."""
    parts = [sql for m in metrics for sql in METRIC_SQL[m]]
    return f"{JUDGED}, {_CLUSTERS}, scores(resume_id, metric, k, score, valid) AS ({' UNION ALL '.join(parts)})"


def _one_metric(metric: str) -> str:
    return with_views(
        f"WITH {scored(metric)} SELECT resume_id, metric, k::INT AS k, round(score, 6) AS score, valid FROM scores",
        *EVALUATION_VIEWS,
    )


_AVERAGED = f"""
    {_CLUSTERS},
    scores(resume_id, metric, k, score, valid) AS ({' UNION ALL '.join(sql for parts in METRIC_SQL.values() for sql in parts)}),
    averaged AS (
      SELECT metric, k, coalesce(sum(score) / nullif(count(*) FILTER (valid), 0), 0) AS average FROM scores GROUP BY ALL)
"""

_REPORT = """
    SELECT metric, k::INT AS k, round_even(average, 4) AS average,
           (SELECT count(DISTINCT resume_id) FROM results) AS resumes_evaluated,
           (SELECT count(DISTINCT resume_id) FROM judgments) AS resumes_judged
    FROM averaged
"""


def _averages() -> str:
    return f"WITH {JUDGED}, {_AVERAGED}"


def _threshold_grid() -> str:
    return f"WITH {JUDGED}, {_GRID}"


_GRID = f"""
    thresholds(threshold) AS (VALUES {", ".join(f"({t})" for t in THRESHOLD_GRID)}),
    needed AS (
      SELECT threshold, resume_id, count(*) FILTER (relevance >= threshold) AS total
      FROM judgments, thresholds GROUP BY ALL),
    lists AS (
      SELECT threshold, resume_id, count(*) FILTER (relevance >= threshold AND rank <= 5) AS hits,
             count(*) FILTER (rank <= 5) AS length
      FROM judged, thresholds GROUP BY ALL),
    pr AS (
      SELECT threshold, avg(hits / length) AS precision,
             avg(CASE WHEN total = 0 THEN 1.0 ELSE hits / total END) AS recall
      FROM lists JOIN needed USING (threshold, resume_id) GROUP BY threshold),
    grid AS (SELECT threshold::DOUBLE AS threshold, precision, recall, 2 * precision * recall / (precision + recall) AS f1 FROM pr)
"""


def _sample() -> str:
    return with_views(
        """
    WITH first_titles AS (SELECT title, min(ord) AS o FROM titles GROUP BY title ORDER BY o, title LIMIT 20),
    jobs AS (SELECT title AS job_title, row_number() OVER (ORDER BY o, title) - 1 AS n FROM first_titles),
    drawn AS (
      SELECT person_id::VARCHAR AS resume_id, n, job_title,
             ('0x' || md5('0|' || person_id || '|' || n)[1:8])::BIGINT % 10 AS draw
      FROM people, jobs)
    SELECT resume_id, 'job_' || n AS job_id, job_title,
           CASE WHEN draw < 4 THEN 0 WHEN draw < 7 THEN 1 WHEN draw < 9 THEN 2 ELSE 3 END::DOUBLE AS relevance,
           n::INT AS ord
    FROM drawn
    """,
        "titles",
        "people",
    )


WORDS = "list_distinct(list_filter(string_split_regex(trim(title), '\\s+'), lambda x: x <> ''))"


def _evaluation() -> str:
    """The whole evaluation: drawn judgments and texts, matches, links, best threshold, averages."""
    at_best = _AVERAGED.replace(">= 1.0", ">= (SELECT threshold FROM best_one)")
    drawn = "('0x' || md5({})[1:8])::BIGINT"
    return with_views(
        f"""
    WITH first_titles AS (SELECT title, min(person_id) AS o FROM corpus_documents GROUP BY title ORDER BY o, title LIMIT 20),
    titled AS (SELECT title, row_number() OVER (ORDER BY o, title) - 1 AS i, count(*) OVER () AS total FROM first_titles),
    jobs AS (SELECT 'job_' || n AS job_id, title AS job_title, n FROM range(20) r(n) JOIN titled ON n % total = i),
    judgment_rows AS (
      SELECT person_id::VARCHAR AS resume_id, job_id, n AS ord,
             CASE WHEN d < 4 THEN 0 WHEN d < 7 THEN 1 WHEN d < 9 THEN 2 ELSE 3 END::DOUBLE AS relevance
      FROM (SELECT *, {drawn.format("'0|' || person_id || '|' || n")} % 10 AS d FROM people, jobs)),
    numbered AS (
      SELECT embedding_text, count(*) OVER () AS total,
             row_number() OVER (ORDER BY {drawn.format("person_id::VARCHAR")} % 4096, person_id) - 1 AS i FROM corpus_documents),
    chosen AS (
      SELECT person_id::VARCHAR AS query_id, embedding_text AS text FROM people
      JOIN numbered ON {drawn.format("'0|' || person_id")} % total = i),
    {sparse_matches("chosen", 10)},
    mapping AS (SELECT lower(job_title) AS title, max_by(job_id, n) AS job_id, min(n) AS position FROM jobs GROUP BY 1),
    wanted AS (SELECT DISTINCT lower(title) AS title FROM matches),
    pairs AS (
      SELECT a.title, b.job_id, b.position, count(*) AS overlap
      FROM (SELECT title, unnest({WORDS}) AS word FROM wanted) a
      JOIN (SELECT job_id, position, unnest({WORDS}) AS word FROM mapping) b USING (word) GROUP BY ALL),
    linked AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY title ORDER BY overlap DESC, position) = 1),
    results AS MATERIALIZED (
      SELECT query_id AS resume_id, rank, coalesce(job_id, 'title_' || md5(lower(m.title))) AS job_id
      FROM matches m LEFT JOIN linked l ON lower(m.title) = l.title),
    {JUDGED}, {_GRID},
    best_one AS (SELECT threshold FROM grid ORDER BY f1 DESC, threshold LIMIT 1),
    {at_best}
    {_REPORT}
    """,
        "people",
        "corpus_documents",
    )


def _links() -> str:
    words = WORDS
    return with_views(
        f"""
    WITH mapping AS (
      SELECT lower(p_name || ' ' || p_type) AS title, max(p_partkey) AS job_id, min(p_partkey) AS position FROM part GROUP BY 1),
    wanted AS (SELECT DISTINCT lower(title) AS title FROM titles UNION SELECT lower(event_type) FROM events),
    pairs AS (
      SELECT a.title, b.job_id, b.position, count(*) AS overlap
      FROM (SELECT title, unnest({words}) AS word FROM wanted) a
      JOIN (SELECT job_id, position, unnest({words}) AS word FROM mapping) b USING (word) GROUP BY ALL),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY title ORDER BY overlap DESC, position) = 1)
    SELECT title, coalesce(job_id::VARCHAR, 'title_' || md5(title)) AS job_id,
           coalesce(overlap, 0) AS overlap
    FROM wanted LEFT JOIN best USING (title)
    """,
        "titles",
    )


CONVERSATIONS = """
    whole AS (SELECT conv_id AS query_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
"""

OVERALL = """
    SELECT count(*) AS total_cvs, round_even(avg(a), 2) AS average_similarity,
           round_even(max(a), 2) AS highest_avg_similarity, round_even(min(a), 2) AS lowest_avg_similarity,
           round_even(max(hi), 2) AS highest_individual_match, round_even(min(lo), 2) AS lowest_individual_match,
           round_even(stddev_pop(a), 2) AS standard_deviation
    FROM (SELECT query_id, avg(similarity_percentage) AS a, max(similarity_percentage) AS hi,
                 min(similarity_percentage) AS lo FROM matches GROUP BY query_id)
"""

def weighted_text(source: str, id: str, column: str, weights: str) -> str:
    """(id, weighted_text): texts with their heaviest terms appended."""
    return f"""
    SELECT {id}, {column} || coalesce(suffix, '') AS weighted_text FROM {source} LEFT JOIN (
      SELECT {id}, string_agg(
               ' ' || repeat(term, least(5, greatest(1, floor(weight * 10 + 1e-9)))::INT), ''
               ORDER BY CASE WHEN total > 20 THEN weight ELSE 0 END, term) AS suffix
      FROM (SELECT *, row_number() OVER (PARTITION BY {id} ORDER BY weight DESC, term DESC) AS n,
                   count(*) OVER (PARTITION BY {id}) AS total FROM {weights})
      WHERE n <= 20 GROUP BY {id}) USING ({id})
    """


WEIGHTED_TEXT = f"""
    WITH {tfidf("documents", "doc_id", "text")} {weighted_text("documents", "doc_id", "text", "weights")}
"""


def hashed(source: str, id: str, column: str, dim: int) -> str:
    """(id, place, value): entries of the hashed vectors, of unit length and single precision."""
    return f"""
    SELECT {id}, place::INT AS place, (n / sqrt(sum(n * n) OVER (PARTITION BY {id})))::FLOAT::DOUBLE AS value
    FROM (SELECT {id}, b % {dim} AS place, sum(CASE WHEN b < {dim} THEN 1 ELSE -1 END)::DOUBLE AS n
          FROM (SELECT {id}, ('0x' || md5(w)[1:8])::BIGINT % {2 * dim} AS b FROM (
            SELECT {id}, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM {source}))
          GROUP BY ALL) WHERE n <> 0
    """


def _dense(id: str, entries: str, source: str, dim: int) -> str:
    """(id, v): whole vectors from their entries, divided by their length."""
    return f"""
    SELECT {id}, list(coalesce(value / length, 0) ORDER BY place) AS v
    FROM (SELECT {id}, range::INT AS place FROM {source}, range({dim}))
    LEFT JOIN (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY {id})) AS length FROM ({entries})) USING ({id}, place)
    GROUP BY {id}
    """


def embedded_matches(queries: str, dim: int, n: int = 5) -> str:
    """As ``sparse_matches``, by hashed vectors of the weighted texts."""
    return f"""
    {fitted(queries)},
    corpus_texts AS MATERIALIZED ({weighted_text("corpus", "person_id", "embedding_text", "weights")}),
    query_texts AS MATERIALIZED ({weighted_text("cleaned", "query_id", "text", "query_weights")}),
    corpus_vectors AS MATERIALIZED ({_dense("person_id", hashed("corpus_texts", "person_id", "weighted_text", dim), "corpus", dim)}),
    query_vectors AS MATERIALIZED ({_dense("query_id", hashed("query_texts", "query_id", "weighted_text", dim), "cleaned", dim)}),
    scored AS (
      SELECT query_id, person_id, round(list_inner_product(q.v, c.v), 9) AS score FROM query_vectors q, corpus_vectors c),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM scored),
    {matched(candidates(n), n)}
    """


def in_file_order(sql: str) -> str:
    """SQL text over the profile views, of which each row's place in its sorted file is the ordinal."""
    sorted_views = {
        name: f"SELECT * EXCLUDE (ord), row_number() OVER (ORDER BY ord, {', '.join(columns)}) AS ord FROM ({VIEWS[name]})"
        for name, columns in PROFILE_ORDER.items()
    }
    head = ",\n".join(f"{name} AS ({body})" for name, body in sorted_views.items())
    return f"WITH {head},\n{sql.removeprefix('WITH ')}"


# Columns that settle equal ordinals, in the order of the views.
PROFILE_ORDER = {
    "people": ["person_id", "name", "segment"],
    "abilities": ["person_id", "ability"],
    "education": ["person_id", "degree", "institution"],
    "experience": ["person_id", "title"],
    "person_skills": ["person_id", "skill"],
}


def oracle_sql() -> dict[str, str]:
    sql = {
        "csv_profiles": "SELECT c_custkey AS person_id, c_name AS name, c_mktsegment AS segment FROM customer",
        "csv_multiline": "SELECT conv_id, turn::VARCHAR AS turn, role, text FROM conversations",
        "json_round_trip": "SELECT doc_id, text, lang FROM documents",
        "text_round_trip": "SELECT lang, count(*) AS n_texts, sum(length(t)) AS n_chars FROM (SELECT lang, "
        f"{clean('text')} AS t FROM documents) GROUP BY lang",
        "stage_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "corpus_round_trip": with_views("SELECT person_id::INT AS person_id, title, embedding_text FROM corpus_documents", "corpus_documents"),
        "text_audit": f"""SELECT doc_id, md5(t)[1:8] AS text_hash, trim(replace(substr(t, 1, 200), chr(10), ' ')) AS text_preview,
                                 length(t) AS n_chars FROM (SELECT doc_id, {clean("text")} AS t FROM documents)""",
        "extract_documents": f"SELECT 'doc-' || doc_id || '.txt' AS path, {clean('text')} AS text, NULL::VARCHAR AS error FROM documents",
        "extract_docx": f"SELECT 'doc-' || doc_id || '.docx' AS path, {clean('text')} AS text, NULL::VARCHAR AS error FROM documents",
        "extract_bounded": f"""SELECT 'doc-' || doc_id || '.txt' AS path, CASE WHEN strlen(text) <= 4000 THEN {clean('text')} END AS text,
                CASE WHEN strlen(text) > 4000 THEN 'file of ' || strlen(text) || ' bytes is larger than 4000' END AS error FROM documents""",
        "extract_pages": f"""SELECT 'page-' || page_id || '.html' AS path, t AS text, NULL::VARCHAR AS error, md5(t)[1:8] AS text_hash,
                                    trim(t[1:200]) AS text_preview, length(t) AS n_chars
                             FROM (SELECT page_id, {clean(visible_text("html"))} AS t FROM pages)""",
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "clean_all": f"SELECT conv_id, turn, {clean('role')} AS role, {clean('text')} AS text FROM conversations",
        "clean_title": with_views(f"SELECT person_id, {clean_title('title')} AS title, ord FROM experience", "experience"),
        "first_title": with_views("SELECT person_id, ord, trim(split_part(title, ';', 1)) AS title FROM experience", "experience"),
        "preview": """SELECT doc_id, substr(text, 1, 200) AS start, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...'
                      ELSE text END AS preview_100, CASE WHEN length(source) > 4 THEN substr(source, 1, 4) || '...' ELSE source END AS preview_4
                      FROM documents""",
        "standardize_titles": with_views(f"SELECT person_id, ord, title FROM ({standardized('titles', 'title')})", "titles"),
        "standardize_titles_thrice": with_views(
            f"""WITH once AS MATERIALIZED ({standardized("titles", "title")}),
                twice AS MATERIALIZED ({standardized("once", "title")})
                SELECT person_id, ord, title FROM ({standardized("twice", "title")})""",
            "titles",
        ),
        "comparison_key": with_views(
            f"SELECT person_id, title, title_key FROM ({comparison_keys('SELECT * FROM titles', 'title', 'title_key')})", "titles"
        ),
        "title_forms": with_views(
            f"""WITH several AS MATERIALIZED (SELECT title, title AS raw FROM experience GROUP BY title),
                once AS MATERIALIZED ({standardized("several", "title")}),
                twice AS MATERIALIZED ({standardized("once", "title")}),
                keyed AS MATERIALIZED ({comparison_keys("SELECT * FROM twice", "title", "title_key")})
                SELECT person_id, ord, keyed.title AS shown_title, title_key FROM experience JOIN keyed ON experience.title = raw""",
            "experience",
        ),
        "filter_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 54928",
        "concat_by_key": with_views(
            f"""SELECT person_id, title, skill FROM ({concatenated("experience", "title", "title")})
                JOIN ({concatenated("person_skills", "skill", "skill")}) USING (person_id)""",
            "experience",
            "person_skills",
        ),
        "join_profiles": with_views(f"WITH {PREPARED} SELECT person_id, segment, ord, ability, degree, title, skill FROM profiles", *PROFILE_VIEWS),
        "content_dedup": """SELECT doc_id, text, n_copies FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n,
                            count(*) OVER (PARTITION BY text) AS n_copies FROM documents) WHERE n = 1""",
        "dedup_statistics": """SELECT count(*) AS initial_rows, count(*) - count(DISTINCT text) AS removed_rows,
                               round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 2) AS removed_percent FROM documents""",
        "corpus_build": with_views(
            f"WITH {CORPUS} SELECT person_id, segment, ord, ability, degree, title, skill, n_copies, {EMBEDDING_TEXT} AS embedding_text FROM corpus",
            *PROFILE_VIEWS,
        ),
        "corpus_from_files": in_file_order(
            f"WITH {CORPUS} SELECT person_id, segment, ability, degree, title, skill, n_copies, {EMBEDDING_TEXT} AS embedding_text FROM corpus"
        ),
        "corpus_build_thin": with_views(
            f"""WITH {PREPARED}, thin AS (
                  SELECT * FROM (SELECT segment, ability, min_by(person_id, ord) AS person_id, min(ord) AS ord, count(*) AS n_copies
                                 FROM profiles GROUP BY segment, ability))
                SELECT person_id, segment, ord, coalesce(ability, 'Unknown ability') AS ability, n_copies,
                       'Unknown skill' AS skill, 'Unknown Title' AS title,
                       concat_ws(' | ', coalesce(ability, 'Unknown ability'), repeat('Unknown Title', 3), 'Unknown skill') AS embedding_text
                FROM thin""",
            *PROFILE_VIEWS,
        ),
        "distinct_titles": with_views("SELECT title, min(ord) AS first_ord FROM experience GROUP BY title", "experience"),
        "term_counts": f"""SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (
                             SELECT doc_id, term, count(*) AS tf FROM ({tokenized("documents", "doc_id", "text")}) GROUP BY ALL) GROUP BY term""",
        "tfidf_vocabulary": f"""WITH {tfidf("documents", "doc_id", "text")}
            SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS idx, tf, df, round(idf, 6) AS idf FROM vocabulary""",
        "tfidf_vocabulary_grown": f"""WITH {tfidf("documents", "doc_id", "text")}
            SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS idx, tf, df, round(idf, 6) AS idf FROM vocabulary""",
        "tfidf_vocabulary_uncapped": f"""WITH {tfidf("documents", "doc_id", "text", "")}
            SELECT term, tf, df, round(idf, 6) AS idf FROM vocabulary""",
        "tfidf_weights": f"""WITH {tfidf("documents", "doc_id", "text")} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weights""",
        "top_terms": f"""WITH {tfidf("documents", "doc_id", "text")}
            SELECT doc_id, term, place, round(weight, 6) AS weight FROM (
              SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term DESC) AS place FROM weights)
            WHERE place <= 20""",
        "weighted_text": WEIGHTED_TEXT,
        "embed_documents": f"SELECT doc_id, place, round(value, 6) AS value FROM ({hashed('documents', 'doc_id', 'text', 256)})",
        "embed_documents_once": f"SELECT doc_id, place, round(value, 6) AS value FROM ({hashed('documents', 'doc_id', 'text', 256)})",
        "vector_cosine": """SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE),
                              list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS similarity
                            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "dense_top_k_slabs": f"WITH {VECTORS} SELECT query_id, person_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 15",
        "dense_top_k_by_label": f"""WITH {VECTORS}, firsts AS (
              SELECT query_id, r.person_id, label, score, r.rank AS place FROM ranked r JOIN embeddings e ON e.vec_id = r.person_id
              QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY r.rank) = 1)
            SELECT query_id, person_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank
            FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 5""",
        "dense_top_k": f"WITH {VECTORS} SELECT query_id, person_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 15",
        "sparse_top_k": f"""WITH {tfidf("documents", "doc_id", "text")}, pairs AS (
              SELECT a.doc_id AS query_id, b.doc_id AS person_id, round(sum(a.weight * b.weight), 9) AS score
              FROM weights a JOIN weights b USING (term) GROUP BY ALL)
            SELECT query_id, person_id, round(score, 6) AS score, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS rank FROM pairs WHERE score > 0)
            WHERE rank <= 5""",
        "collapse_titles": with_views(
            f"WITH {DENSE_MATCHES} SELECT query_id, person_id, rank, title, similarity_percentage FROM matches", "titles"
        ),
        "query_summary": with_views(
            f"""WITH {DENSE_MATCHES} SELECT query_id, round(avg(similarity_percentage), 6) AS avg_similarity, count(*) AS n_matches
                FROM matches GROUP BY query_id""",
            "titles",
        ),
        "folder_summary": with_views(
            f"""WITH {DENSE_MATCHES} SELECT query_id::VARCHAR AS cv_file, title AS match_title, similarity_percentage AS similarity,
                substr(embedding_text, 1, 200) AS match_details FROM matches""",
            "titles",
        ),
        "overall_summary": with_views(f"WITH {DENSE_MATCHES} {OVERALL}", "titles"),
        "match_documents": with_views(
            f"""WITH {sparse_matches("query_documents")}
                SELECT query_id, rank, person_id, title, embedding_text, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_documents_stored": with_views(
            f"""WITH {sparse_matches("query_documents")}
                SELECT query_id, rank, person_id, title, embedding_text, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_documents_exact": with_views(
            f"""WITH {sparse_matches("query_documents", exact=True)}
                SELECT query_id, rank, person_id, title, embedding_text, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_documents_uncapped": with_views(
            f"""WITH {sparse_matches("query_documents", limit="")}
                SELECT query_id, rank, person_id, title, embedding_text, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_embedded": with_views(
            f"""WITH {embedded_matches("query_documents", 256)}
                SELECT query_id, rank, person_id, title, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_files": with_views(
            f"""WITH {sparse_matches("query_documents")}
                SELECT 'turn-' || query_id || '.txt' AS query_id, rank, person_id, title, similarity_percentage FROM matches""",
            "corpus_documents",
            "query_documents",
        ),
        "match_folder": with_views(f"WITH {CONVERSATIONS}, {sparse_matches('whole')} {OVERALL}", "corpus_documents"),
        "match_arriving_files": with_views(
            f"""WITH {CONVERSATIONS}, {sparse_matches("whole")}
                SELECT query_id AS conv_id, rank, person_id, title, similarity_percentage FROM matches""",
            "corpus_documents",
        ),
        "load_judgments": with_views(f"WITH {JUDGED} SELECT resume_id, job_id, relevance FROM judgments", *EVALUATION_VIEWS),
        "register_results": """SELECT o_custkey::VARCHAR AS resume_id, o_orderkey::VARCHAR AS job_id, o_orderdate AS batch
                               FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""",
        "judged_results": with_views(
            f"WITH {JUDGED} SELECT resume_id, rank, job_id, relevance FROM results LEFT JOIN judgments USING (resume_id, job_id)", *EVALUATION_VIEWS
        ),
        "evaluation_scores": with_views(
            f"WITH {scored(*METRIC_SQL)} SELECT resume_id, metric, k::INT AS k, round(score, 6) AS score, valid FROM scores", *EVALUATION_VIEWS
        ),
        "evaluation_averages": with_views(_averages() + " SELECT metric, k::INT AS k, round(average, 6) AS average FROM averaged", *EVALUATION_VIEWS),
        "evaluation_report": with_views(
            _averages() + _REPORT,
            *EVALUATION_VIEWS,
        ),
        "threshold_grid": with_views(
            _threshold_grid() + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM grid",
            *EVALUATION_VIEWS,
        ),
        "best_threshold": with_views(
            _threshold_grid() + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
            " FROM grid ORDER BY f1 DESC, threshold LIMIT 1", *EVALUATION_VIEWS
        ),
        "sample_judgments": _sample(),
        "evaluate_matcher": _evaluation(),
        "evaluation_outputs": _evaluation(),
        "link_titles": _links(),
        "number_rows": """SELECT k, row_number() OVER (ORDER BY ('0x' || md5(k)[1:8])::BIGINT % 4096, k) - 1 AS row_index
                          FROM (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)""",
    }
    for metric, name in METRIC_QUERIES.items():
        sql[name] = _one_metric(metric)
    return sql


METRIC_QUERIES = {
    "ndcg": "ndcg_at_k",
    "precision": "precision_at_k",
    "recall": "recall_at_k",
    "mrr": "mean_reciprocal_rank",
    "map": "mean_average_precision",
    "ari": "adjusted_rand_index",
    "nmi": "normalized_mutual_information",
    "purity": "purity",
}
