"""The catalogue of site items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog
from workload import inputs as I


def indexed_items(spark, sf_dir):
    return catalog.indexed(I.site_items(spark, sf_dir)).select("SK", "GSI1PK", "GSI1SK")


def newest_projects(spark, sf_dir):
    return catalog.partition_newest_first(I.site_items(spark, sf_dir)).select("SK", "GSI1SK")


def project_rows(spark, sf_dir):
    rows = catalog.projects(I.site_items(spark, sf_dir))
    return rows.select(
        "id", F.size("tags").alias("n_tags"), F.array_join("tags", ",").alias("tags"), "summary", "publishedAt"
    )


def project_listing(spark, sf_dir):
    return catalog.listing(catalog.projects(I.site_items(spark, sf_dir)))


QUERIES = {
    "indexed_items": indexed_items,
    "newest_projects": newest_projects,
    "project_rows": project_rows,
    "project_listing": project_listing,
}
_PROJECTS = f"FROM ({I.SQL_SITE_ITEMS}) WHERE GSI1PK = 'PROJECT' AND GSI1SK IS NOT NULL"
SQL = {
    "indexed_items": f"SELECT SK, GSI1PK, GSI1SK FROM ({I.SQL_SITE_ITEMS}) WHERE GSI1PK IS NOT NULL AND GSI1SK IS NOT NULL",
    "newest_projects": f"SELECT SK, GSI1SK {_PROJECTS} ORDER BY GSI1SK DESC, SK",
    "project_rows": f"""
SELECT SK AS id, coalesce(len(tags), 0)::INT AS n_tags, coalesce(array_to_string(tags, ','), '') AS tags,
       coalesce(summary, '') AS summary, GSI1SK AS publishedAt {_PROJECTS}""",
    "project_listing": f"""
SELECT SK AS id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ' · ') END AS tag_line,
       coalesce(summary, '') AS summary,
       month(GSI1SK::DATE) || '/' || day(GSI1SK::DATE) || '/' || year(GSI1SK::DATE) AS published {_PROJECTS}""",
}
