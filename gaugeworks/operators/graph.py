"""Graphs as edge tables: arrows in text, call resolution, import resolution, entry points, bounded paths.

Defined results: edges are distinct; a call that could mean several functions stays unresolved; a path stops where it
would close a cycle.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise


def endpoint(c: Column) -> Column:
    """An end of an arrow without place, remarks and quotes, 100 characters at most."""
    c = F.split(c, ";")[0]
    c = F.regexp_replace(c, r" *[(]lines? [0-9, -]+[)] *$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[`'\"]", ""), r"^[ \t]+|[ \t]+$", ""), 1, 100)


def arrows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, src, dst): neighbours along the arrows of each line."""
    line = df.where(F.col(text).isNotNull()).select(*keys, F.explode(F.split(F.col(text), "\n")).alias("_line")).where(F.contains("_line", F.lit("->")) | F.contains("_line", F.lit("→")))
    parts = F.transform(F.split(F.regexp_replace("_line", "→", "->"), "->"), endpoint)
    pairs = F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("src"), F.slice("_p", 2, F.size("_p") - 1).alias("dst"))
    e = line.select(*keys, parts.alias("_p")).select(*keys, F.explode(pairs).alias("_e")).select(*keys, F.col("_e.src").alias("src"), F.col("_e.dst").alias("dst"))
    return e.where("src <> '' and dst <> ''").distinct()


def indented(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, src, dst): each line of an outline below its first and the nearest line above it that is less indented.

    Blank lines and remarks on recursion are no parts of an outline. The lines of one text stay in its row.
    """
    lines = F.slice(F.split(F.col(text), "\n"), 2, 1_000_000_000)
    kept = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.contains(F.lower(x), F.lit("recursion")))
    depth = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
    e = df.where(F.col(text).isNotNull()).select(*keys, F.transform(kept, lambda x: F.struct(depth(x).alias("d"), endpoint(F.trim(x)).alias("name"))).alias("_l"))
    pairs = F.transform("_l", lambda x, i: F.struct(F.when(i > 0, F.try_element_at(F.filter(F.slice("_l", F.lit(1), F.greatest(i, F.lit(1))), lambda y: y["d"] < x["d"]), F.lit(-1))["name"]).alias("src"), x["name"].alias("dst")))
    out = e.select(*keys, F.explode(pairs).alias("_e")).select(*keys, F.col("_e.src").alias("src"), F.col("_e.dst").alias("dst"))
    return out.where("src is not null and src <> '' and dst <> '' and src <> dst").distinct()


def relations(df: DataFrame, keys: list[str], kind: str, text: str) -> DataFrame:
    """(keys, src, dst): the arrows of all texts and the outlines of those of kind 'flow', one row for each in any case."""
    both = arrows(df, keys, text).unionByName(indented(df.where(F.col(kind) == "flow"), keys, text)).where("src <> dst")
    return both.groupBy(*keys, F.lower("src").alias("_s"), F.lower("dst").alias("_d")).agg(F.min(F.struct("src", "dst")).alias("x")).select(*keys, "x.src", "x.dst")


#: Nodes that a flow tree shows.
MOST_NODES = 60


def flow_lines(edges: list[tuple[str, str]], start: str, most: int = MOST_NODES) -> list[str]:
    """The tree of calls below ``start`` in pre-order, indented by depth; a node on its own path ends there, and after
    ``most`` nodes the tree says that it is cut off (a tree for reading)."""
    below: dict[str, list[str]] = {}
    for src, dst in dict.fromkeys(edges):
        below.setdefault(src, []).append(dst)
    out: list[str] = []
    waiting = [(start, (), 0)]
    while waiting:
        node, path, depth = waiting.pop()
        if len(out) >= most:
            out.append("  " * depth + "... (more)")
            break
        if node in path:
            out.append("  " * depth + f"{node} (recursion)")
            continue
        out.append("  " * depth + node)
        waiting += [(x, (*path, node), depth + 1) for x in reversed(below.get(node, []))]
    return out


def flow_trees(edges: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """(group, start, n_lines, tree): the flow tree of each start. ``edges``: group, src, dst; ``starts``: group, node.

    A group's edges are one listing, which a row holds.
    """
    listed = edges.groupBy(group).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("es"))

    @F.pandas_udf("array<string>")
    def tree(es, node):
        return pd.Series([flow_lines([(e["src"], e["dst"]) for e in x], n) for x, n in zip(es, node)])

    t = starts.join(listed, group).select(group, F.col("node").alias("start"), tree("es", "node").alias("t"))
    return t.select(group, "start", F.size("t").alias("n_lines"), F.array_join("t", "\n").alias("tree"))


def resolve_calls(edges: DataFrame, functions: DataFrame, group: str, imported: DataFrame | None = None) -> DataFrame:
    """(group, caller, callee_id): calls by bare name resolved in the caller's file, else through what the file imports,
    else anywhere; each if only one fits.

    ``edges``: group, caller ('file::name'), callee (bare name); ``functions``: group, file, name; ``imported``: group,
    file, name, source (the file that the name is imported from).
    """
    f = functions.select(group, "file", "name").distinct()
    e = edges.withColumn("file", F.split("caller", "::")[0])
    own = f.select(group, "file", F.col("name").alias("callee"), F.concat_ws("::", "file", "name").alias("own_id"))
    unique = f.groupBy(group, F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws("::", "file", "name")).alias("other_id")).where("n = 1").drop("n")
    joined = e.join(own, [group, "file", "callee"], "left").join(unique, [group, "callee"], "left")
    if imported is None:
        joined = joined.withColumn("named_id", F.lit(None).cast("string"))
    else:
        known = imported.select(group, "file", F.col("name").alias("callee"), "source").distinct().join(f.select(group, F.col("file").alias("source"), F.col("name").alias("callee")), [group, "source", "callee"])
        one = known.groupBy(group, "file", "callee").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws("::", "source", "callee")).alias("named_id")).where("n = 1").drop("n")
        joined = joined.join(one, [group, "file", "callee"], "left")
    return joined.select(group, "caller", F.coalesce("own_id", "named_id", "other_id").alias("callee_id")).where("callee_id is not null").distinct()


def entry_points(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node): nodes with edges out and none in."""
    return edges.select(*group, F.col("src").alias("node")).distinct().join(edges.select(*group, F.col("dst").alias("node")).distinct(), [*group, "node"], "left_anti")


def reach(edges: DataFrame, starts: DataFrame, group: list[str], depth: int = 4) -> DataFrame:
    """(group, start, node, depth): nodes within ``depth`` steps of a start and the fewest steps to them.

    One join a step on what the last step found; nodes that were found before aren't followed again.
    """
    e = materialise(edges.select(*group, "src", "dst").distinct())
    frontier = starts.select(*group, F.col("node").alias("start"), "node").withColumn("depth", F.lit(0))
    seen = frontier
    for step in range(1, depth + 1):
        step_ = frontier.join(e.withColumnRenamed("src", "node"), [*group, "node"]).select(*group, "start", F.col("dst").alias("node")).distinct()
        frontier = materialise(step_.join(seen.select(*group, "start", "node"), [*group, "start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def module_name(path: Column) -> Column:
    """The dotted name of a Python file; packages are named by their folder."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def resolve_imports(files: DataFrame, imports: DataFrame, group: str) -> DataFrame:
    """(group, src, dst): imports of modules of the same project.

    ``files``: group, path; ``imports``: group, path, module, name (may be null), level. A relative import climbs one
    folder a level beyond the first; ``from pkg import mod`` reaches the module if there is one; none leads to itself.
    """
    modules = files.select(group, F.col("path").alias("dst"), module_name(F.col("path")).alias("full")).where("full <> ''")
    folder = F.regexp_replace(F.regexp_replace(F.col("path"), r"[^/]+$", ""), "/$", "")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (F.col("level") - 1), F.lit(0)).cast("int")), ".")
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.when(up != "", up), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    wanted = imports.select(group, F.col("path").alias("src"), base.alias("base"), "name")
    both = wanted.select(group, "src", F.explode(F.array_compact(F.array("base", F.when(F.col("name").isNotNull(), F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), F.col("name")))))).alias("full"))
    return both.join(modules, [group, "full"]).where("src <> dst").select(group, "src", "dst").distinct()
