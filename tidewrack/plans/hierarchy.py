"""Queries of the page hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import hierarchy
from tidewrack.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy.crawl_forest(table(spark, d, "fetch_info"))
    return hierarchy.roots_and_depths(forest).withColumnRenamed("id", "fetch_id")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy.crawl_forest(table(spark, d, "fetch_info"))
    return hierarchy.paths(forest).select(F.col("id").alias("fetch_id"), "root_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    forest = hierarchy.crawl_forest(table(spark, d, "fetch_info"))
    return hierarchy.descendant_intervals(forest).select(F.col("id").alias("fetch_id"), "root_id", "first", "last", (F.col("last") - F.col("first")).alias("descendants"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_paths, p1_descendants)}


_LINKS = r"""
    keys AS (SELECT fetch_id, regexp_replace(split_part(url, '#', 1), '/+$', '') AS k, regexp_replace(split_part(parent_url, '#', 1), '/+$', '') AS pk FROM fetch_info WHERE url IS NOT NULL),
    firsts AS (SELECT k, min(fetch_id) AS id, arg_min(struct_pack(p := pk), fetch_id).p AS pk FROM keys GROUP BY k),
    links AS (SELECT f.id, p.id AS parent FROM firsts f LEFT JOIN firsts p ON f.pk = p.k AND f.pk <> '')"""

_FOUND = f"""
    WITH RECURSIVE {_LINKS},
    down AS (SELECT id, id AS root_id, 0 AS depth FROM links WHERE parent IS NULL
      UNION ALL SELECT l.id, d.root_id, d.depth + 1 FROM links l JOIN down d ON l.parent = d.id),
    stuck AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM down)),
    walk AS (SELECT id AS start, id AS at FROM stuck UNION SELECT w.start, s.parent FROM walk w JOIN stuck s ON w.at = s.id),
    onloop AS (SELECT DISTINCT s.id FROM stuck s JOIN walk w ON w.start = s.parent AND w.at = s.id),
    stuck_root AS (SELECT w.start AS id, min(w.at) AS root_id FROM walk w JOIN onloop o ON w.at = o.id GROUP BY w.start)
    SELECT id AS fetch_id, root_id, depth::INT AS depth FROM down
    UNION ALL SELECT id, root_id, -1 FROM stuck_root"""


# Paths start at roots and at the lowest id of each loop, whose edge is cut.
_PATHS = f"""
    WITH RECURSIVE heads AS (SELECT DISTINCT root_id FROM ({_FOUND}) WHERE depth = -1), {_LINKS},
    cut AS (SELECT id, CASE WHEN id NOT IN (SELECT root_id FROM heads) THEN parent END AS parent FROM links),
    p AS (SELECT id, id AS root_id, id::VARCHAR AS path FROM cut WHERE parent IS NULL
      UNION ALL SELECT c.id, p.root_id, p.path || '/' || c.id FROM cut c JOIN p ON c.parent = p.id)
    SELECT id AS fetch_id, root_id, path FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _FOUND, "p1_paths": _PATHS}
