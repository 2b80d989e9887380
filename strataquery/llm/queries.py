"""Queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from strataquery.llm import distinctive, encode, leak, names, residue, topn

QUERIES = {
    "p1_found": distinctive.p1_found,
    "p1_elite": distinctive.p1_elite,
    "p2_found": names.p2_found,
    "p2_entities": names.p2_entities,
    "p3_found": topn.p3_found,
    "p6_ids": encode.p6_ids,
    "p6_lengths": encode.p6_lengths,
    "p7_found": leak.p7_found,
    "p8_found": residue.p8_found,
}

SQL = {
    "p1_found": """
        WITH kept AS (SELECT DISTINCT lower(token) AS token, file_id, lines FROM postings WHERE token IS NOT NULL AND len(lines) > 0 AND file_id IN (SELECT file_id FROM file_stats)),
        counts AS (SELECT token, file_id, sum(len(lines)) AS tf FROM kept GROUP BY ALL),
        files AS (SELECT file_id, sum(tf) AS n FROM counts GROUP BY ALL),
        spread AS (SELECT token, count(*) AS df FROM counts GROUP BY ALL),
        ranked AS (
            SELECT file_id, token, row_number() OVER (PARTITION BY file_id ORDER BY round(tf / n * ln((SELECT count(*) FROM files) / df), 9) DESC, token) AS place
            FROM counts JOIN files USING (file_id) JOIN spread USING (token) WHERE df >= 2)
        SELECT file_id, token FROM ranked WHERE place <= 5""",
    "p3_found": """
        WITH latest AS (
            SELECT def_id, coalesce(cyclomatic_complexity, 0) AS cyclomatic, coalesce(cognitive_complexity, 0) AS cognitive,
                row_number() OVER (PARTITION BY def_id ORDER BY parsed_at DESC NULLS LAST, coalesce(cyclomatic_complexity, 0) DESC, coalesce(cognitive_complexity, 0) DESC) AS age
            FROM code_stats WHERE def_id IS NOT NULL),
        placed AS (SELECT def_id, min(file_id) AS file_id FROM definitions WHERE file_id IS NOT NULL AND def_id IS NOT NULL GROUP BY ALL),
        ranked AS (
            SELECT file_id, def_id, row_number() OVER (PARTITION BY file_id ORDER BY cyclomatic DESC, cognitive DESC, def_id) AS place
            FROM placed JOIN latest USING (def_id) WHERE age = 1)
        SELECT file_id, def_id FROM ranked WHERE place <= 3""",
}

#: The mixture of two Poisson laws, fitted in SQL: the same start, the same number of rounds.
SQL["p1_elite"] = f"""
        WITH RECURSIVE kept AS (SELECT DISTINCT lower(token) AS token, file_id, lines FROM postings WHERE token IS NOT NULL AND len(lines) > 0 AND file_id IN (SELECT file_id FROM file_stats)),
        counts AS MATERIALIZED (SELECT token, file_id, sum(len(lines))::DOUBLE AS tf FROM kept GROUP BY ALL),
        files AS MATERIALIZED (SELECT file_id, sum(tf) AS n_tokens FROM counts GROUP BY ALL), size AS (SELECT count(*)::DOUBLE AS n FROM files),
        hist AS MATERIALIZED (SELECT token, tf, count(*)::DOUBLE AS records FROM counts GROUP BY ALL),
        terms AS MATERIALIZED (SELECT token, n, sum(records) AS df, sum(records * tf) AS total FROM hist, size GROUP BY token, n),
        em AS (
            SELECT token, 0 AS round, least(greatest(df / (2 * n), 1e-9), 0.5) AS share, greatest(total / df, total / n * 1.5) + 0.5 AS elite, greatest(total / n * 0.5, 1e-9) AS base FROM terms
            UNION ALL
            SELECT token, round + 1, least(greatest(g / n, 1e-12), 1 - 1e-12), greatest(x / greatest(g, 1e-12), 1e-9), greatest((total - x) / greatest(n - g, 1e-12), 1e-9)
            FROM (SELECT token, round, n, total, sum(records * p * tf) AS x, sum(records * p) + greatest(n - df, 0) * any_value(p0) AS g
                FROM (SELECT e.token, round, n, df, total, tf, records, 1 / (1 + exp(-least(greatest(o + tf * ln(elite / base), -700), 700))) AS p, 1 / (1 + exp(-least(greatest(o, -700), 700))) AS p0
                    FROM (SELECT *, ln(share) - ln(1 - share) - elite + base AS o FROM em WHERE round < {distinctive.ROUNDS}) e JOIN hist h ON h.token = e.token JOIN terms t ON t.token = e.token)
                GROUP BY token, round, n, df, total)),
        fitted AS (SELECT token, CASE WHEN elite < base THEN 1 - share ELSE share END AS share, greatest(elite, base) AS elite, least(elite, base) AS base FROM em WHERE round = {distinctive.ROUNDS}),
        scored AS (SELECT file_id, tf, round(tf / n_tokens * ln(n / df), 9) AS tf_idf, 1 / (1 + exp(-(ln(share) - ln(1 - share) - elite + base + tf * ln(elite / base)))) AS p
            FROM counts JOIN files USING (file_id) JOIN terms USING (token) JOIN fitted USING (token))
        SELECT file_id, count(*) AS terms_matched, sum(tf)::BIGINT AS occurrences, round(sum(tf_idf), 6) AS tf_idf FROM scored WHERE p >= 0.5 GROUP BY file_id"""
