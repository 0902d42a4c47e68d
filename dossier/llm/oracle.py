"""SQL twins of the operators' queries, where SQL can express them on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The table of CRC-32 (polynomial EDB88320, reflected), from its rule.
CRC_TABLE = """crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM range(256) r(i)))"""


def lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes; ``t`` is the list of ``crc_table``."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


ORACLE: dict[str, str] = {
    "op11_spelling_variants": rf"""
        WITH {CRC_TABLE},
        runs AS (
            SELECT doc_id, {lower("run")} AS run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL),
        hashed AS (
            SELECT run, n, length(run) AS size, {crc32("x")} AS h
            FROM (SELECT *, concat(doc_id, ':', run) AS x FROM runs), crc_table),
        spelled AS (
            SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word
            FROM hashed),
        words AS (
            SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM pairs GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form,
                   CASE WHEN most >= 5 * n THEN most END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        chain AS (
            SELECT word, form AS reached, 1 AS step FROM forms WHERE form IS NOT NULL),
        walks AS (
            WITH RECURSIVE walk AS (
                SELECT * FROM chain
                UNION ALL SELECT k.word, f.form, k.step + 1 FROM walk k JOIN forms f ON k.reached = f.word WHERE f.form IS NOT NULL)
            SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word)
        SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n
        FROM forms f LEFT JOIN walks k ON f.word = k.word""",
    "op12_importance_resampling": rf"""
        WITH {CRC_TABLE},
        own AS (
            SELECT doc_id, unnest(regexp_extract_all({lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
        wanted AS (
            SELECT unnest(regexp_extract_all({lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        named AS (
            SELECT w, {crc32("w")} % 10000 AS bucket FROM (SELECT w FROM own UNION SELECT w FROM wanted), crc_table),
        s AS (SELECT bucket, count(*) AS n FROM own JOIN named USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM wanted JOIN named USING (w) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln(
                (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE
                / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket)),
        weights AS (
            SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM own JOIN named USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
        scores AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weights USING (doc_id)),
        placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER () * 10 // 100 AS most
            FROM scores WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
        FROM scores LEFT JOIN placed USING (doc_id)""",
    "op13_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
