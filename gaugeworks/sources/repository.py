"""Source trees as DataFrames: folders, archives, notebooks, documents, dependency files.

Everything reads Spark's ``binaryFile`` rows (path, length, content), so a tree may lie on any file system that Spark
reads. Defined results: unreadable archives, notebooks and documents give no rows; entries that would leave their
archive are dropped; bytes that aren't UTF-8 are replaced.
"""

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What is not source, and what is.
SKIP_DIRS = ".git .hg .svn node_modules __pycache__ .venv venv env .idea .vscode dist build target .mypy_cache .pytest_cache .ipynb_checkpoints".split()
SUFFIXES = (
    "py ipynb js jsx mjs ts tsx vue java kt scala c h cc cpp hpp cs go rs rb php swift r sql sh bash ps1 html css scss json yml yaml toml ini cfg xml md rst txt"
).split()
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock cargo.lock go.sum composer.lock".split()
FILE_BYTES, NOTEBOOK_BYTES, DOCUMENT_BYTES = 1_000_000, 25_000_000, 12_000_000
CELL_CHARS, CELLS, DOCUMENT_CHARS, README_CHARS = 2_000, 200, 120_000, 12_000


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder, paths relative to it."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^\w+:/*", "", folder).strip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", ""), f"^{re.escape(root)}/", "")
    return df.select(rel.alias("path"), "length", "content")


# Fixed value: what a repository's address looks like.
REPOSITORY_URL = r"^https://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?(\.git)?/?$"


def repository_name(url: Column) -> Column:
    """'owner/name' of a repository's address, without '.git'; null for any other address."""
    name = F.regexp_replace(F.regexp_replace(url, r"^https://github\.com/", ""), r"(\.git)?/?$", "")
    return F.when(url.rlike(REPOSITORY_URL), name)


def checked_out(files: DataFrame) -> str | None:
    """The first 12 digits of the commit that a clone in the landing zone has checked out; None without one.

    ``files``: path, content of the tree, its '.git' folder included. Cloning itself is done before: executors have no
    need of the network.
    """
    few = files.where(F.col("path").rlike(r"(^|/)\.git/(HEAD|packed-refs|refs/heads/.+)$"))
    head = {re.sub(r"^.*?\.git/", "", r.path): bytes(r.content).decode("utf-8", "replace") for r in few.where(F.col("path").rlike(r"(HEAD|packed-refs)$")).limit(2).collect()}
    at = head.get("HEAD", "").strip()
    if at.startswith("ref: "):
        ref = at[5:]
        found = few.where(F.endswith("path", F.lit(".git/" + ref))).limit(1).collect()
        packed = re.search(rf"(?m)^([0-9a-f]{{40}}) {re.escape(ref)}$", head.get("packed-refs", ""))
        at = bytes(found[0].content).decode("utf-8", "replace").strip() if found else packed.group(1) if packed else ""
    return at[:12] if re.fullmatch(r"[0-9a-f]{40}", at) else None


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_state(files: DataFrame) -> DataFrame:
    """The files with ``state``: 'source', 'skipped' (too large), or why they are none."""
    parts = F.split(F.lower("path"), "/")
    name = F.element_at(parts, -1)
    large = F.col("length") > F.when(suffix(F.col("path")) == "ipynb", NOTEBOOK_BYTES).otherwise(FILE_BYTES)
    state = (
        F.when(F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRS))) & (F.size(parts) > 1), "folder")
        .when(name.isin(LOCK_FILES), "lock").when(F.contains(name, F.lit(".min.")), "minified")
        .when(~suffix(F.col("path")).isin(SUFFIXES), "suffix").when(large, "skipped").otherwise("source")
    )
    return files.withColumn("state", state)


def scan(files: DataFrame) -> DataFrame:
    """(path, length, text) of the source files, in path order within a file list."""
    return file_state(files).where("state = 'source'").select("path", "length", F.decode("content", "UTF-8").alias("text"))


def prune_report(files: DataFrame) -> DataFrame:
    """One row: files kept and removed, and MB of what is removed."""
    s = file_state(files)
    keep = F.col("state") == "source"
    return s.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"), F.round(F.sum(F.when(~keep, F.col("length")).otherwise(0)) / 1e6, 2).alias("removed_mb"))


def within_limit(files: DataFrame, limit_mb: float) -> DataFrame:
    """One row: total MB outside of skipped folders and whether it is within the limit."""
    s = file_state(files).where("state <> 'folder'")
    return s.agg(F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1e6, 3).alias("total_mb")).withColumn("accepted", F.col("total_mb") <= limit_mb)


def snapshot(content: Column) -> Column:
    """The short name of an upload's content."""
    return F.substring(F.sha2(content, 256), 1, 12)


def unzip(archives: DataFrame) -> DataFrame:
    """(archive, snapshot, path, length, content) of the files in zip archives; a single top folder is left out."""
    schema = pa.schema([("archive", pa.string()), ("snapshot", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for archive, snap, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith("/") and ".." not in n.replace("\\", "/").split("/") and not re.match(r"^[A-Za-z]:", n)]
                    tops = {n.split("/", 1)[0] for n in names if "/" in n}
                    cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                    for n in names:
                        data = z.read(n)
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((archive, snap, n[cut:], len(data), data), schema)], schema=schema)
                except (zipfile.BadZipFile, KeyError, RuntimeError, OSError, NotImplementedError):
                    continue

    return archives.select("path", snapshot(F.col("content")), "content").mapInArrow(run, "archive string, snapshot string, path string, length bigint, content binary")


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """(path, language, cell, type, source) of the non-empty code cells of notebooks (path, text), the first ``CELLS``."""
    schema = "metadata struct<kernelspec:struct<language:string>>, cells array<struct<cell_type:string,source:string>>"
    # a cell's source may be a list of lines: read as text, it is joined here
    n = notebooks.select("path", F.from_json("text", schema).alias("n")).where("n is not null")
    c = n.select("path", F.coalesce("n.metadata.kernelspec.language", F.lit("python")).alias("language"), F.posexplode("n.cells").alias("cell", "c"))
    lines = F.from_json("c.source", "array<string>")
    source = F.coalesce(F.when(F.col("c.source").startswith("["), F.array_join(lines, "")), F.col("c.source"))
    code = c.select("path", "language", "cell", F.col("c.cell_type").alias("type"), F.substring(source, 1, CELL_CHARS).alias("source")).where("type = 'code' and trim(source) <> ''")
    w = Window.partitionBy("path").orderBy("cell")
    return code.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= CELLS).drop("_r")


def document_text(name: str, content: bytes) -> str | None:
    """The text of a document by its suffix; None for kinds that can't be read here."""
    kind = name.rsplit(".", 1)[-1].lower()
    if len(content) > DOCUMENT_BYTES:
        return None
    if kind in ("txt", "md", "rst", "csv", "tsv", "json", "yml", "yaml", "xml", "html", "htm", "py", "tex"):
        text = content.decode("utf-8", "replace")
    elif kind in ("docx", "pptx"):
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            inside = sorted(n for n in z.namelist() if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml", n))
            paragraphs = []
            for n in inside:
                for p in ElementTree.fromstring(z.read(n)).iter():
                    if p.tag.endswith("}p"):
                        paragraphs.append("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")))
            text = "\n".join(paragraphs)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return None
    elif kind == "pdf":
        try:
            from pypdf import PdfReader  # not everywhere: without it PDFs can't be read here
        except ImportError:
            return None
        try:
            text = "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
        except Exception:  # noqa: BLE001  (damaged files raise anything)
            return None
    else:
        return None
    text = re.sub(r"[ \t]+", " ", text.replace("\0", " ").replace("\r\n", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()[:DOCUMENT_CHARS]


def documents(files: DataFrame) -> DataFrame:
    """(path, text) of the documents among files (path, length, content)."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [(p, t) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (t := document_text(p, c or b"")) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, text string")


def declared_dependencies(path: str, text: str) -> list[str]:
    """Names of the packages that a dependency file declares, sorted."""
    name = path.rsplit("/", 1)[-1].lower()
    found: set[str] = set()
    if re.fullmatch(r"requirements.*\.txt", name):
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if line and not line.startswith("-"):
                found.add(re.split(r"[\s<>=!~;\[@]", line, maxsplit=1)[0])
    elif name == "package.json":
        try:
            d = json.loads(text)
            found |= {k for s in ("dependencies", "devDependencies") if isinstance(d.get(s), dict) for k in d[s]}
        except (ValueError, AttributeError):
            pass
    elif name == "pyproject.toml":
        import tomllib

        try:
            d = tomllib.loads(text)
            found |= {re.split(r"[\s<>=!~;\[@]", x, maxsplit=1)[0] for x in d.get("project", {}).get("dependencies", [])}
            found |= {k for k in d.get("tool", {}).get("poetry", {}).get("dependencies", {}) if k != "python"}
        except (tomllib.TOMLDecodeError, AttributeError):
            pass
    elif name == "description":
        for m in re.finditer(r"(?m)^(?:Imports|Depends):((?:.*\n(?:\s+.*\n?)*))", text + "\n"):
            found |= {re.split(r"[\s(]", x.strip(), maxsplit=1)[0] for x in m.group(1).split(",") if x.strip()} - {"R"}
    return sorted(x for x in found if x)


def dependencies(files: DataFrame) -> DataFrame:
    """(path, dependency) of the dependency files among source files (path, text)."""

    @F.pandas_udf("array<string>")
    def declared(paths, texts):
        return paths.combine(texts, lambda p, t: declared_dependencies(p, t or ""))

    low = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = files.where(low.rlike(r"^requirements.*\.txt$") | low.isin("package.json", "pyproject.toml", "description"))
    return wanted.select("path", F.explode(declared("path", "text")).alias("dependency"))


def readme(files: DataFrame) -> DataFrame:
    """(path, text) of the README nearest to the root, in at most ``README_CHARS`` characters."""
    r = files.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^readme(\.(md|rst|txt))?$"))
    return r.orderBy(F.size(F.split("path", "/")), "path").limit(1).select("path", F.substring("text", 1, README_CHARS).alias("text"))


def select_within_budget(files: DataFrame, group: str, max_chars: int) -> DataFrame:
    """(group, path, position): files taken in order of priority and path while they fit a budget of characters.

    A file of more than half of the budget, or one that would exceed it, is passed over without counting. The fold is
    that of an ordered list inside one row a group (a project's files), in built-in functions.
    """
    low = F.lower("path")
    priority = F.when(low.rlike(r"(^|/)(readme|requirements|package\.json|pyproject)"), 0).when(low.rlike(r"(^|/)(tests?|spec)(/|_)|test_|_test\."), 2).otherwise(1)
    ordered = F.array_sort(F.collect_list(F.struct(priority.alias("p"), F.col("path").alias("path"), F.length("text").cast("bigint").alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("taken"))

    def take(acc, x):
        fits = (x["n"] <= max_chars // 2) & (acc["used"] + x["n"] <= max_chars)
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["path"]))).otherwise(acc["taken"]).alias("taken"))

    g = files.groupBy(group).agg(ordered.alias("files"))
    return g.select(group, F.posexplode(F.aggregate("files", start, take)["taken"]).alias("position", "path"))
