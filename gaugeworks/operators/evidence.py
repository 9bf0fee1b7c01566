"""Evidence from files: chunks read from projects, segments of source, counts of constructs.

Defined results: a project without readable chunks has none; blank lines belong to no segment; a file of more than
``SEGMENTS`` segments shows its first ones (that is what a segment list is).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES, SEGMENTS = 60, 4
CHUNK = "array<struct<id:string,kind:string,title:string,text:string,file:string,start_line:bigint,end_line:bigint,snapshot:string,evidence_types:array<string>>>"

# What counts as a construct.
CONSTRUCTS = {
    "loops": r"(^|[^A-Za-z0-9_])(for|while)([^A-Za-z0-9_]|$)",
    "branches": r"(^|[^A-Za-z0-9_])(if|elif|switch|case)([^A-Za-z0-9_]|$)",
    "calls": r"[A-Za-z_][A-Za-z0-9_]*[(]",
    "tests": r"(^|[^A-Za-z0-9_])(assert|pytest|unittest|expect)([^A-Za-z0-9_]|$)",
    "routes": r"@[A-Za-z_.]+[.](get|post|put|delete|route)[(]",
    "sql": r"(^|[^A-Za-z0-9_])(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER)([^A-Za-z0-9_]|$)",
}


def chunks(projects: DataFrame, fields: list[str]) -> DataFrame:
    """(project_id, <fields>) of the chunks of each project; only the asked fields are parsed; exact repeats are one."""
    kinds = dict(f.split(":", 1) for f in CHUNK[len("array<struct<") : -2].replace("array<string>", "array|string").split(","))
    want = ",".join(f"{f}:{kinds[f].replace('|', '<') + ('>' if '|' in kinds[f] else '')}" for f in fields)
    parsed = F.from_json(F.col("chunks_json").cast("string"), f"array<struct<{want}>>")
    return projects.select(F.col("id").alias("project_id"), F.explode(parsed).alias("c")).select("project_id", *[F.col(f"c.{f}").alias(f) for f in fields])


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, segment, start_line, end_line, n_lines, content): non-blank lines in groups of ``LINES``, the first groups.

    The lines of one text are numbered inside its row: nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")
    groups = F.sequence(F.lit(0), F.least(F.ceil(F.size("_l") / LINES).cast("int"), F.lit(SEGMENTS)) - 1)
    rows = df.where(F.col(text).isNotNull()).select(key, lines.alias("_l")).where(F.size("_l") > 0).select(key, "_l", F.explode(groups).alias("segment"))
    part = F.slice("_l", F.col("segment") * LINES + 1, LINES)
    out = rows.select(key, "segment", part.alias("_p"))
    return out.select(
        key, "segment", F.element_at("_p", 1)["no"].alias("start_line"), F.element_at("_p", -1)["no"].alias("end_line"), F.size("_p").alias("n_lines"),
        F.array_join(F.transform("_p", lambda s: s["line"]), "\n").alias("content"),
    )


def construct_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).alias(n) for n, p in CONSTRUCTS.items()]


def numbered(parts: list[tuple[str, DataFrame, int]], group: str, order: list[str], most: int = 800) -> DataFrame:
    """Chunks of several producers in one numbered list a group: each with its own limit, 'c0', 'c1', ... over all.

    ``parts``: (producer, rows with the same columns, limit). The limits are those of an evidence list.
    """
    out = None
    for i, (name, df, limit) in enumerate(parts):
        w = Window.partitionBy(group).orderBy(*order)
        one = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).withColumn("kind", F.lit(name)).withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(group).orderBy("_p", "_r")
    n = out.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") < most)
    return n.withColumn("chunk_id", F.concat(F.lit("c"), F.col("_n").cast("string"))).drop("_n", "_p", "_r")


def dependencies(text: Column) -> Column:
    """The names in a dependency listing, one a line after its heading."""
    lines = F.split(text, "\n")
    return F.array_distinct(F.filter(F.transform(F.slice(lines, F.lit(2), F.size(lines)), F.trim), lambda x: x != ""))
