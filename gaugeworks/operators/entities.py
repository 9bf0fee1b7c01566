"""Named things in evidence: candidates by kind, compact contexts, evidence bundles, rendered stems.

Defined results: a chunk without a name of a kind gives no candidate of it; of equal names (in any case) the best is
kept; a required group that can't be filled leaves the bundle empty and is named.
"""

import ast
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import tokens

# How the chunks of each kind introduce what they show.
NAMES = {
    "function": r"^(?:Async f|F)unction ([A-Za-z0-9_.]+) in ",
    "class": r"^Class ([A-Za-z0-9_.]+) in ",
    "constant": r"^Module-level constant[(]s[)] ([A-Za-z0-9_]+) in ",
    "table": r"(?:FROM|INTO|UPDATE|JOIN) ([A-Za-z_][A-Za-z0-9_]*)",
    "file": r"^[A-Za-z0-9_+#]+ file ([^ \n:]+)",
    "notebook": r"^Notebook ([^ \n:]+)",
    "route": r"@[A-Za-z_.]+[.](?:get|post|put|delete|route)[(]\"([^\"]+)\"",
}
RELATIONAL = ["callgraph", "flow", "import_graph", "imports"]


def relational(kind: Column, text: Column) -> Column:
    """Whether a chunk shows relations between parts of a project."""
    return kind.isin(RELATIONAL) | ((kind == "structure") & F.contains(text, F.lit("->")))


def candidates(chunks: DataFrame, group: str, contexts: DataFrame) -> DataFrame:
    """(group, rank, kind, value, score): named things of each group, those first that its context speaks of.

    ``chunks``: group, text, file; ``contexts``: group, context (one row a group).
    """
    each = chunks.select(
        group, "text", F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("values")) for i, (k, p) in enumerate(NAMES.items())])).alias("_x")
    ).select(group, "text", "_x.order", "_x.kind", F.explode("_x.values").alias("value"))
    with_context = each.join(contexts.select(group, F.array_distinct(tokens(F.coalesce("context", F.lit("")))).alias("_c")), group)
    shared = lambda c: F.size(F.array_intersect("_c", F.array_distinct(tokens(c))))
    scored = with_context.select(group, "order", "kind", "value", (3 * shared(F.col("text")) + shared(F.col("value"))).alias("score"))
    best = Window.partitionBy(group, "kind", F.lower("value")).orderBy(F.desc("score"), "value")
    one = scored.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    rank = Window.partitionBy(group).orderBy(F.desc("score"), "order", "value")
    return one.withColumn("rank", F.row_number().over(rank)).select(group, "rank", "kind", "value", "score")


def compact(c: Column, fallback: Column) -> Column:
    """A short name of a context: without marks and lead-in, or the fallback if it is long."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[*_`#>]", ""), r"(?i)^(explain|describe|identify|understand|show|discuss) (how |what |why )?", ""))
    words = F.size(F.split(plain, r"\s+"))
    return F.when((F.length(plain) > 64) | (words > 8) | (plain == ""), fallback).otherwise(plain)


def bundles(ranked: DataFrame, key: str, required: dict[str, int], optional: dict[str, int], most: int = 6, fill: str | None = None) -> DataFrame:
    """(key, position, doc_id, group, missing): evidence for each key, group by group without repeats.

    ``ranked``: key, group, doc_id, rank. Groups are taken in the given order, required ones first, each its number of
    documents that no earlier group took. If a required one falls short the key has one row that names the missing
    groups. Places up to ``most`` that are left go to the documents of the group ``fill``. A key's candidates are a ranked
    list, so they fit one task.
    """
    kind = ranked.schema[key].dataType.simpleString()

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        k, lists = pdf[key].iloc[0], {g: x.sort_values("rank").doc_id.tolist() for g, x in pdf.groupby("group")}
        taken: list[tuple] = []
        missing = []
        for need, groups in ((True, required), (False, optional)):
            for g, n in groups.items():
                fresh = [x for x in lists.get(g, []) if x not in {t[0] for t in taken}][:n]
                if need and len(fresh) < n:
                    missing.append(g)
                taken += [(x, g) for x in fresh]
            if need and missing:
                return pd.DataFrame({key: [k], "position": [0], "doc_id": [None], "group": [None], "missing": [",".join(missing)]}).astype({"doc_id": "Int64"})
        if fill:
            taken += [(x, fill) for x in lists.get(fill, []) if x not in {t[0] for t in taken}]
        taken = taken[:most]
        return pd.DataFrame({key: k, "position": range(1, len(taken) + 1), "doc_id": pd.array([t[0] for t in taken], "Int64"), "group": [t[1] for t in taken], "missing": None})

    return ranked.groupBy(key).applyInPandas(take, f"{key} {kind}, position int, doc_id bigint, group string, missing string")


def narrowed(types: Column, topic_types: Column) -> Column:
    """The evidence types of a group that its topic has too; all of the group's if they have none in common."""
    both = F.array_intersect(types, topic_types)
    return F.when(F.size(both) > 0, both).otherwise(types)


def assure_relational(taken: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """(key, position, chunk_id): ``taken`` with, for keys of which no chunk shows relations, the best of ``fallback`` behind.

    ``taken``: key, position, chunk_id, relational; ``fallback``: key, rank, chunk_id, of chunks that show relations.
    """
    state = taken.groupBy(key).agg(F.max("position").alias("_last"), F.bool_or("relational").alias("_has"))
    best = fallback.groupBy(key).agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
    more = state.where("not _has").join(best, key).select(key, (F.col("_last") + 1).alias("position"), "chunk_id")
    return taken.select(key, "position", "chunk_id").unionByName(more)


def render(frames: Column, variant: Column, slots: Column) -> Column:
    """The frame that ``variant`` picks, its ``{name}`` places filled from the map ``slots``; null if one stays open."""
    frame = F.element_at(frames, (F.pmod(variant, F.size(frames)) + 1).cast("int"))
    filled = F.aggregate(F.map_entries(slots), frame, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.when(~filled.rlike(r"[{][a-z_]+[}]"), filled)


def conditions_of(source: str) -> list[str]:
    """The conditions of the branches in Python source, in order."""
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = [(n.lineno, ast.unparse(n.test)) for n in ast.walk(tree) if isinstance(n, (ast.If, ast.While, ast.IfExp))]
    found += [(n.lineno, ast.unparse(n.subject)) for n in ast.walk(tree) if isinstance(n, ast.Match)]
    return [c for _, c in sorted(found)]


_BOUNDARY = {ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq}


def mutated(condition: str) -> str | None:
    """A condition with its first comparison moved by one step or turned round; None if it compares nothing."""
    try:
        e = ast.parse(condition, mode="eval").body
    except SyntaxError:
        return None
    for n in ast.walk(e):
        if isinstance(n, ast.Compare) and type(n.ops[0]) in _BOUNDARY:
            n.ops[0] = _BOUNDARY[type(n.ops[0])]()
            return ast.unparse(e)
    return None


def requirements_of(source: str) -> list[str]:
    """What a piece of Python demands of its callers: conditions that end in raise or an early return, asserted ones."""
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = [(n.lineno, ast.unparse(n.test)) for n in ast.walk(tree) if isinstance(n, ast.Assert)]
    found += [(n.lineno, negated(ast.unparse(n.test))) for n in ast.walk(tree) if isinstance(n, ast.If) and not n.orelse and isinstance(n.body[-1], (ast.Raise, ast.Return))]
    return list(dict.fromkeys(c for _, c in sorted(found)))


#: Lines of code that are shown at most.
SHOWN_LINES = 12


def snippets_of(source: str) -> list[dict]:
    """The functions and compound statements of a piece of Python that are short enough to be shown whole."""
    lines = (source or "").split("\n")
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.If, ast.For, ast.While, ast.With, ast.Try, ast.Match)) and n.end_lineno - n.lineno < SHOWN_LINES:
            inside = any(isinstance(x, (ast.If, ast.Match, ast.While, ast.IfExp)) for x in ast.walk(n))
            out.append({"start": n.lineno, "lines": n.end_lineno - n.lineno + 1, "condition": inside, "text": textwrap.dedent("\n".join(lines[n.lineno - 1 : n.end_lineno]))})
    return out


def display_pick(sources: DataFrame, contexts: DataFrame, group: str, with_condition: Column | None = None) -> DataFrame:
    """(group, chunk_id, start, lines, text): of each group the piece of code to show: one with a condition where that is
    asked for, then the one that shares most words with the context, the shorter one, the first.

    ``sources``: group, chunk_id, code; ``contexts``: group, context (one row a group).
    """
    kind = "array<struct<start:int,lines:int,condition:boolean,text:string>>"

    @F.pandas_udf(kind)
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(snippets_of)

    each = sources.select(group, "chunk_id", F.explode(pieces("code")).alias("_x")).select(group, "chunk_id", "_x.*")
    words = contexts.select(group, F.array_distinct(tokens(F.coalesce("context", F.lit("")))).alias("_c"))
    shared = F.size(F.array_intersect("_c", F.array_distinct(tokens(F.col("text")))))
    wanted = F.lit(True) if with_condition is None else with_condition
    order = F.struct((~(F.col("condition") == wanted)).alias("a"), (-shared).alias("b"), "lines", "chunk_id", "start")
    best = each.join(words, group).groupBy(group).agg(F.min_by(F.struct("chunk_id", "start", "lines", "text"), order).alias("_pick"))
    return best.select(group, "_pick.*")


def negated(condition: str) -> str:
    """A condition turned round, as a reader would write it."""
    try:
        e = ast.parse(condition, mode="eval").body
    except SyntaxError:
        return f"not ({condition})"
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        return ast.unparse(e.operand)
    turned = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.In: ast.NotIn, ast.NotIn: ast.In}
    if isinstance(e, ast.Compare) and len(e.ops) == 1:
        e.ops = [turned[type(e.ops[0])]()]
        return ast.unparse(e)
    return ast.unparse(ast.UnaryOp(ast.Not(), e))


def branch_conditions(sources: DataFrame, key: list[str], code: str) -> DataFrame:
    """(key, position, condition, negation, mutation) of the branches in each source."""

    @F.pandas_udf("array<struct<condition:string,negation:string,mutation:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"condition": c, "negation": negated(c), "mutation": mutated(c)} for c in conditions_of(t)])

    return sources.select(*key, F.posexplode(found(F.col(code))).alias("position", "_x")).select(*key, "position", "_x.*")


def requirements(sources: DataFrame, key: list[str], code: str) -> DataFrame:
    """(key, position, requirement) of the demands in each source."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(requirements_of)

    return sources.select(*key, F.posexplode(found(F.col(code))).alias("position", "requirement"))
