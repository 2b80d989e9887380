"""Queries of the general data-processing operators: incremental runs and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataquery.operators.hierarchy import hierarchy, related_pairs
from strataquery.operators.increment import changed_inputs
from strataquery.session import scratch
from strataquery.sources.tables import table

_DEFINITIONS = ("def_id", "file_id", "name", "kind", "parent")


def p4_found(spark, folder):
    fingerprints = table(spark, folder, "fingerprints", "obs_id", "run_id", "path", "content_hash", "seen_at")
    return changed_inputs(fingerprints, table(spark, folder, "index_runs", "run_id", "status"))


def p4_resumed(spark, folder):
    """The same from a store that was left after three successful runs and opened again."""
    fingerprints = table(spark, folder, "fingerprints", "obs_id", "run_id", "path", "content_hash", "seen_at")
    runs, kept = table(spark, folder, "index_runs", "run_id", "status"), scratch(spark, "resumed")
    changed_inputs(fingerprints, runs, kept, first=3)
    return changed_inputs(fingerprints, runs, kept)


def p5_found(spark, folder):
    return related_pairs(table(spark, folder, "definitions", *_DEFINITIONS))


def p5_hierarchy(spark, folder):
    return hierarchy(table(spark, folder, "definitions", *_DEFINITIONS))


def p5_depths(spark, folder):
    """Definitions per depth, with those on or below circles apart."""
    rows = hierarchy(table(spark, folder, "definitions", *_DEFINITIONS))
    return rows.groupBy("depth").agg(F.count("*").alias("n_definitions"), F.count_distinct("root_id").alias("n_roots"))


QUERIES = {"p4_found": p4_found, "p4_resumed": p4_resumed, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_depths": p5_depths}

_CLEAN = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '^(\./)+', '')"
_BARE = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(parent, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'),
    '<.*$', ''), '^.*(\.|::)', ''), '^\s+|\s+$', '', 'g')), '')"""
_CONTAINERS = "('class', 'interface', 'struct', 'enum', 'record', 'table', 'xmlElement')"

SQL = {
    "p4_found": f"""
        WITH states AS (
            SELECT run_id, {_CLEAN} AS path, arg_max(lower(content_hash), (seen_at, obs_id)) AS digest
            FROM fingerprints
            WHERE content_hash IS NOT NULL AND path IS NOT NULL AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok')
            GROUP BY ALL)
        SELECT run_id, path
        FROM (SELECT *, lag(digest) OVER (PARTITION BY path ORDER BY run_id) AS before FROM states)
        WHERE before IS DISTINCT FROM digest""",
    "p5_found": f"""
        WITH RECURSIVE d AS (SELECT DISTINCT def_id, file_id, name, kind, {_BARE} AS holder FROM definitions WHERE file_id IS NOT NULL),
        edge AS (SELECT d.def_id AS child, c.def_id AS parent FROM d JOIN d c ON c.file_id = d.file_id AND c.name = d.holder AND c.kind IN {_CONTAINERS}),
        reach AS (SELECT child, parent FROM edge UNION SELECT r.child, e.parent FROM reach r JOIN edge e ON e.child = r.parent)
        SELECT DISTINCT least(child, parent) AS def_id_a, greatest(child, parent) AS def_id_b FROM reach WHERE child <> parent""",
}
SQL["p4_resumed"] = SQL["p4_found"]

_TREE = f"""
        WITH RECURSIVE d AS (SELECT DISTINCT def_id, file_id, name, kind, {_BARE} AS holder FROM definitions WHERE file_id IS NOT NULL AND def_id IS NOT NULL),
        holds AS (SELECT * FROM d WHERE kind IN {_CONTAINERS} AND name IS NOT NULL),
        up AS (SELECT d.def_id AS child, min(c.def_id) AS parent FROM d JOIN holds c ON c.file_id = d.file_id AND c.name = d.holder GROUP BY ALL),
        inner_up AS (SELECT * FROM up WHERE child IN (SELECT def_id FROM holds)),
        reach AS (SELECT child, parent FROM inner_up UNION SELECT r.child, e.parent FROM reach r JOIN inner_up e ON e.child = r.parent),
        rings AS (SELECT child AS id FROM reach WHERE child = parent),
        circles AS (SELECT child AS id, least(child, min(parent)) AS circle FROM reach WHERE child IN (SELECT id FROM rings) GROUP BY child),
        walk AS (SELECT def_id AS id, def_id AS cur, 0 AS depth, coalesce(name, '') AS path FROM d
            UNION ALL SELECT w.id, u.parent, w.depth + 1, concat(h.name, '/', w.path) FROM walk w JOIN up u ON u.child = w.cur JOIN holds h ON h.def_id = u.parent WHERE w.cur NOT IN (SELECT id FROM rings)),
        tops AS (SELECT id, arg_max(cur, depth) AS top, max(depth) AS depth, arg_max(path, depth) AS path FROM walk GROUP BY id),
        below AS (SELECT parent AS id, count(*) AS n FROM reach WHERE child <> parent GROUP BY parent),
        tree AS (SELECT d.def_id, d.file_id, u.parent AS parent_id, coalesce(circle, top) AS root_id, t.depth, CASE WHEN t.depth = 0 THEN d.name ELSE path END AS path, d.def_id IN (SELECT id FROM rings) AS in_cycle, coalesce(n, 0) AS containers_below
            FROM d LEFT JOIN up u ON u.child = d.def_id JOIN tops t ON t.id = d.def_id LEFT JOIN circles c ON c.id = t.top LEFT JOIN below b ON b.id = d.def_id)"""
SQL["p5_hierarchy"] = f"{_TREE} SELECT * FROM tree"
SQL["p5_depths"] = f"{_TREE} SELECT depth, count(*) AS n_definitions, count(DISTINCT root_id) AS n_roots FROM tree GROUP BY ALL"
