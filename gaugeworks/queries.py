"""Queries of the core; ``QUERIES`` maps names to callables, ``SQL`` to equal statements for a second engine."""

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.operators import nested, orphans
from gaugeworks.plans import nested_sql, planning, privacy, records, retrieval, review, streams, structure  # noqa: F401  (they register their queries)
from gaugeworks.plans.registry import QUERIES, SQL, query
from gaugeworks.sources import read_table

__all__ = ["QUERIES", "SQL"]


@query(nested_sql.children())
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.children(read_table(spark, d, "questions"), read_table(spark, d, "attempts"))


def _subtype(table: str, kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.subtype_table(read_table(spark, d, table), table, kind)

    return run


for _t, _k in (("questions", "option"), ("questions", "justification"), ("questions", "evidence"), ("attempts", "per_question"), ("attempts", "selected"), ("attempts", "per_focus")):
    query(nested_sql.SUBTYPES[_k](), name=f"p3_{_k}")(_subtype(_t, _k))


@query(nested_sql.shapes())
def p3_shapes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, column in nested.COLUMNS:
        part = nested.shape_report(read_table(spark, d, table), table, column)
        out = part if out is None else out.unionByName(part)
    return out


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(read_table(spark, d, t) for t in ("assessments", "attempts", "questions", "projects", "tombstones")))


@query(nested_sql.orphans())
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "target_key", "reason").distinct()


@query(nested_sql.orphans_by_month())
def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_month(_orphans(spark, d))
