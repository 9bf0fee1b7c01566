"""The catalog of what can be assessed, and the concept lexicon, as data.

Both are parameters; the ones here are our own and small. ``load_catalog`` reads another from a JSON file. Tables are
built from the rows below; matrices hold only their non-zero cells.
"""

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Concepts of a lexicon at most.
MOST_CONCEPTS = 1_000


@dataclass
class Catalog:
    """Focus areas (topics), points, templates and the two compatibility matrices."""

    topics: list[tuple[str, str]]
    #: (point_id, name, query, min difficulty, max difficulty, evidence types)
    points: list[tuple[str, str, str, int, int, list[str]]]
    #: (template_id, code_mode, required evidence types)
    templates: list[tuple[str, str, list[str]]]
    topic_point: list[tuple[str, str, float]]
    point_template: list[tuple[str, str, float]]
    lexicon: list[tuple[str, list[str], list[str]]] = field(default_factory=list)


DEFAULT = Catalog(
    topics=[("testing", "Testing"), ("data_flow", "Data flow"), ("structure", "Structure"), ("errors", "Error handling"), ("speed", "Performance")],
    points=[
        ("case_selection", "Choice of test cases", "test case expected result fixture boundary", 1, 4, ["test_discovery", "symbol_table"]),
        ("isolation", "Isolation of tests", "mock stub fixture dependency isolated test", 2, 5, ["test_discovery"]),
        ("pipeline_order", "Order of a pipeline", "stage step pipeline input output order queue", 1, 4, ["call_graph", "data_flow_graph"]),
        ("data_grain", "Grain of a table", "table column key row group report counter", 2, 4, ["sql_analysis", "data_flow_graph"]),
        ("module_roles", "Roles of modules", "module package class layer responsibility import", 1, 3, ["module_graph", "dependency_graph"]),
        ("call_paths", "Paths of calls", "call caller path flow function through", 2, 5, ["call_graph"]),
        ("guard_conditions", "Conditions of guards", "guard condition early return invalid pending check", 1, 4, ["control_flow_graph"]),
        ("failure_modes", "Modes of failure", "error exception raise retry fail dropped twice", 2, 5, ["control_flow_graph", "call_graph"]),
        ("growth", "Growth of cost", "loop index seconds slow memory cache lookup", 3, 5, ["complexity_analysis"]),
        ("access_path", "Access paths", "index lookup scan query cursor table takes", 2, 5, ["sql_analysis", "complexity_analysis"]),
    ],
    templates=[
        ("explain_code", "show", ["symbol_table"]),
        ("trace_flow", "show", ["call_graph"]),
        ("name_role", "none", ["module_graph"]),
        ("outcome_of_condition", "show", ["control_flow_graph"]),
        ("choose_cases", "none", ["test_discovery"]),
        ("grain_of_data", "none", ["sql_analysis"]),
    ],
    topic_point=[
        ("testing", "case_selection", 1.0), ("testing", "isolation", 0.9), ("testing", "failure_modes", 0.3),
        ("data_flow", "pipeline_order", 1.0), ("data_flow", "data_grain", 0.8), ("data_flow", "call_paths", 0.5),
        ("structure", "module_roles", 1.0), ("structure", "call_paths", 0.7),
        ("errors", "failure_modes", 1.0), ("errors", "guard_conditions", 0.8),
        ("speed", "growth", 1.0), ("speed", "access_path", 0.9), ("speed", "data_grain", 0.2),
    ],
    point_template=[
        ("case_selection", "choose_cases", 1.0), ("case_selection", "explain_code", 0.4), ("isolation", "choose_cases", 0.8),
        ("pipeline_order", "trace_flow", 1.0), ("pipeline_order", "explain_code", 0.5), ("data_grain", "grain_of_data", 1.0),
        ("module_roles", "name_role", 1.0), ("call_paths", "trace_flow", 0.9), ("call_paths", "name_role", 0.3),
        ("guard_conditions", "outcome_of_condition", 1.0), ("guard_conditions", "explain_code", 0.6),
        ("failure_modes", "outcome_of_condition", 0.9), ("growth", "explain_code", 0.7), ("access_path", "grain_of_data", 0.5), ("access_path", "explain_code", 0.6),
    ],
    lexicon=[
        ("ingestion", ["ingest", "upload", "extract"], ["fetch", "load", "read", "source"]),
        ("transformation", ["transform", "cleaning", "convert"], ["normalize", "merge", "group", "filter"]),
        ("validation", ["validat", "quality", "check whether"], ["assert", "schema", "null", "duplicate"]),
        ("pipeline", ["pipeline", "stage", "queue"], ["flow", "step", "order", "schedule"]),
        ("testing", ["test", "fixture"], ["assert", "mock", "expected", "case"]),
        ("database", ["database", "index", "table"], ["column", "key", "query", "cursor"]),
        ("failure", ["retries", "error", "rejected"], ["raise", "exception", "fail", "guard"]),
        ("performance", ["seconds", "runtime", "slow"], ["loop", "cache", "memory", "lookup"]),
        ("structure", ["module", "package", "import"], ["layer", "class", "dependency", "boundary"]),
    ],
)


def validate(catalog: Catalog) -> list[str]:
    """What is wrong with a catalog; matrices must name known ids and have weights in [0, 1]."""
    topics, points, templates = {t[0] for t in catalog.topics}, {p[0] for p in catalog.points}, {t[0] for t in catalog.templates}
    wrong = [f"point {p[0]}: difficulty {p[3]}-{p[4]}" for p in catalog.points if not 1 <= p[3] <= p[4] <= 5]
    for name, rows, left, right in (("topic_point", catalog.topic_point, topics, points), ("point_template", catalog.point_template, points, templates)):
        for a, b, w in rows:
            if a not in left or b not in right:
                wrong.append(f"{name}: unknown id in ({a}, {b})")
            if isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w <= 1:
                wrong.append(f"{name}: weight {w!r} of ({a}, {b})")
    return wrong


def load_catalog(path: str) -> Catalog:
    """A catalog from a JSON file with the fields of ``Catalog``; ValueError if it isn't valid."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    tuples = lambda k: [tuple(x) for x in raw.get(k, [])]
    catalog = Catalog(tuples("topics"), tuples("points"), tuples("templates"), tuples("topic_point"), tuples("point_template"), tuples("lexicon"))
    if wrong := validate(catalog):
        raise ValueError("; ".join(wrong))
    return catalog


def tables(spark: SparkSession, catalog: Catalog = DEFAULT) -> dict[str, DataFrame]:
    """The catalog as small tables."""
    make = spark.createDataFrame
    return {
        "topic": make(catalog.topics, "topic_id string, name string"),
        "point": make(catalog.points, "point_id string, name string, query string, low int, high int, evidence_types array<string>"),
        "template": make(catalog.templates, "template_id string, code_mode string, evidence_types array<string>"),
        "topic_point": make([(a, b, float(w)) for a, b, w in catalog.topic_point if w], "topic_id string, point_id string, fit double"),
        "point_template": make([(a, b, float(w)) for a, b, w in catalog.point_template if w], "point_id string, template_id string, fit double"),
        "lexicon": make([(i, *x) for i, x in enumerate(catalog.lexicon)], "ordinal int, concept string, triggers array<string>, aliases array<string>"),
    }


def _quote(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_quote, v)) + "]"
    return repr(v)


def values_sql(rows, columns: str) -> str:
    """Rows as an inline table of SQL."""
    return f"(values {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)}) as v({columns})"


def tables_sql(catalog: Catalog = DEFAULT) -> dict[str, str]:
    """The catalog as inline tables for the second engine."""
    return {
        "topic": values_sql(catalog.topics, "topic_id, name"),
        "point": values_sql(catalog.points, "point_id, name, query, low, high, evidence_types"),
        "template": values_sql(catalog.templates, "template_id, code_mode, evidence_types"),
        "topic_point": values_sql([x for x in catalog.topic_point if x[2]], "topic_id, point_id, fit"),
        "point_template": values_sql([x for x in catalog.point_template if x[2]], "point_id, template_id, fit"),
        "lexicon": values_sql([(i, *x) for i, x in enumerate(catalog.lexicon)], "ordinal, concept, triggers, aliases"),
    }


def catalog_hash(matrix: DataFrame) -> DataFrame:
    """One row: 16 hex digits that change with any cell of a matrix (columns a, b, w), whatever their order."""
    cell = F.concat_ws("|", "a", "b", F.format_string("%.4f", "w"))
    return matrix.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(cell)), ";"), 256), 1, 16).alias("catalog_hash"))


def expand_concepts(df: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(id, concept, ordinal, aliases): the concepts of which a trigger stands in the text's tokens.

    The lexicon is a table that people write, ``MOST_CONCEPTS`` rows at most: its triggers become expressions, so nothing
    is joined.
    """
    from gaugeworks.functions.text import tokens

    rows = lexicon.select("ordinal", "concept", "triggers", "aliases").limit(MOST_CONCEPTS + 1).collect()
    if len(rows) > MOST_CONCEPTS:
        raise ValueError("a lexicon that people write is smaller")
    joined = df.select(F.col(id_col).alias("id"), F.array_join(tokens(F.coalesce(F.col(text), F.lit(""))), " ").alias("joined"))
    hit = lambda r: F.col("joined").rlike("|".join(re.escape(t) for t in r.triggers)) if r.triggers else F.lit(False)
    one = lambda r: F.struct(F.lit(r.concept).alias("concept"), F.lit(r.ordinal).alias("ordinal"), F.array(*map(F.lit, r.aliases)).cast("array<string>").alias("aliases"))
    fired = F.array_compact(F.array(*[F.when(hit(r), one(r)) for r in rows])) if rows else F.array().cast("array<struct<concept:string,ordinal:int,aliases:array<string>>>")
    return joined.select("id", F.explode(fired).alias("x")).select("id", "x.concept", "x.ordinal", "x.aliases")
