"""Files that no one wrote by hand: generated, minified, vendored, or data kept as code.

For every file a Re-Pair grammar is inferred over its lexical tokens, and its lines are compared with those of all others:

* a rule of the token grammar that is reused over nearly the whole file marks generated code (or, if most of what it
  covers are numbers, a data dump);
* literals that are long and that no grammar or compressor can shorten mark blobs;
* runs of lines that several repositories share, wherever they stand in a file, mark vendored copies. Every window of
  ``SHARED_LINES`` code lines is named by its content, as a rule of one grammar over all repositories would be; so copies
  with a patched line, another header or other chunks still share the windows that are left.

Marks that tools leave (a header, a name, a folder) are read as well; for files that were skipped for their size the
path is all there is.

Defined results: a file without text is judged by its path; a null or unreadable column gives no files; a project
without id is skipped; a file that shows in chunks and in skipped_files is listed once.
"""

import re
import zlib
from pathlib import PurePosixPath

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.jsonio import Unreadable, decode
from gaugeworks.functions.materialise import materialise
from gaugeworks.llm import grammar
from gaugeworks.llm.chunks import chunks_of, map_blocks, text_of

#: Share of a file's tokens below one reused rule from which it counts as generated.
COVER = 0.8
#: Tokens that such a rule stands for, and uses of it, at least.
RULE_TOKENS, RULE_USES = 7, 4
#: ... and how often it must be used: once in nearly every line, or many times over nearly all of the file.
LINE_SHARE, MANY_USES, FULL_COVER = 0.8, 8, 0.9
#: Tokens of a file from which its grammar says something about data dumps.
DATA_TOKENS = 120
#: Of blobs: characters in long literals at least, their share of the file, and their size after compression.
BLOB_CHARS, BLOB_SHARE, BLOB_RATIO = 300, 0.6, 0.6
#: Of minified files: characters a line on average, and share of blanks at most.
LONG_LINES, FEW_BLANKS = 250, 0.09
#: Of shared runs of lines: their least length, repositories they occur in, share of a file's lines they cover.
SHARED_LINES, REPOSITORIES, SHARED_COVER = 8, 3, 0.6
#: Different lines in a shared run at least: the same check written several times over is an idiom, not a copy.
DIFFERENT = 6

# Names of folders and files that tools and package managers give.
VENDOR_DIRS = frozenset(
    "vendor node_modules third_party thirdparty third-party 3rdparty bower_components site-packages dist-packages deps extern external externals jspm_packages pods vendored".split()
)
GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|d\.ts)|\.pb\.(?:go|cc|h|swift)|\.g\.(?:cs|dart|i\.cs)|\.gen\.(?:go|ts|js|py|rs)|\.generated\.\w+|\.designer\.cs|_generated\.\w+|_parsetab\.py|^parsetab\.py|_lextab\.py|\.freezed\.dart)$",
    re.I,
)
PACKED_NAME = re.compile(r"[.\-]min\.(?:js|mjs|css)$|\.bundle\.(?:js|mjs|css)$|[.\-](?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{8,32}\.(?:js|mjs|css)$|\.(?:js|css)\.map$", re.I)
VERSIONED_NAME = re.compile(r"^[A-Za-z][\w]*(?:[.\-_]\w+)*?[.\-_]v?\d+\.\d+(?:\.\d+)+(?:[.\-]\w+)?\.(?:js|mjs|ts|css|py|c|h|cc|cpp|java|cs|go|r|sql|sh)$", re.I)
CONFIG = frozenset(".toml .yml .yaml .properties .env .sample .ini .cfg .json .md .txt .ipynb".split())

GENERATOR_MARK = re.compile(
    r"(?i)@generated\b|<auto-?generated|auto-?generated (?:file|code|by|from|source)|(?:code|file|source|class|stub|this|is|was|been|automatically|^\W*)\s*generated (?:by|from|with|using|automatically|code)"
    r"|do not (?:edit|modify|change)|don't edit|edits (?:are|will be) (?:overwritten|lost)|changes (?:will be|are) (?:lost|overwritten)|machine[- ](?:written|generated)"
    r"|automatically (?:produced|generated|created|built)|(?:re)?generate(?:d)? with [`'\"]"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|(?:von hand )?ändern)|généré automatiquement|ne pas modifier|generado automáticamente|no (?:editar|modificar)|gerado automaticamente|não edite|wygenerowan\w* automatycznie|nie edytować"
)
OWNER = re.compile(r"(?i)copyright|\(c\)\s|©|licen[sc]e")
UPSTREAM = re.compile(r"(?i)\bv?\d+\.\d+\.\d+\b|upstream|@preserve|@license|contributors")
_HEAD = re.compile(r"^(?:[\w#+ ]+ file [^\n]*\n(?:Content \(lines[^\n]*\n)?|Notebook [^\n]*\n|Module-level constant[^\n]*\n(?:Code:\n)?|(?:Async f|F)unction [^\n]* in [^\n]*\n|Class [^\n]* in [^\n]*\n)")
_COMMENT_LINE = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|%|'|\"\"\")")
#: Comments that go on to a closing mark.
_BLOCKS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
_EDGE = re.compile(r"^[\s#/*;%!\-'\"=]+")
#: What may stand before a mark in the line that a tool writes, and what follows it in the text of a licence.
_SUBJECT = re.compile(r"(?i)(?:(?:note|warning|attention|caution)\b\W*)?(?:please\s+)?(?:(?:this|the)\s+)?(?:(?:source|code|file|class|stub|module|header|script|was|is|been|has|automatically)\s+)*")
_LEGAL = re.compile(r"(?i)\s+(?:(?:the|this|these|its|any)\s+)?(?:licen[sc]e|terms|notice|copyright)")
_RELEASE = re.compile(r"(?i)\bv?\d+\.\d+\.\d+\b(?!\.\d)|@preserve")
_LITERAL = re.compile(r"[\"'`]([A-Za-z0-9+/=_\-]{40,})[\"'`\\]")


def by_path(path: str) -> str | None:
    """What the path alone tells."""
    p = PurePosixPath(path.replace("\\", "/"))
    if VENDOR_DIRS & {x.lower() for x in p.parts[:-1]}:
        return "vendored"
    if GENERATED_NAME.search(p.name):
        return "generated"
    if PACKED_NAME.search(p.name) or "dist" in p.parts[:-1] and p.suffix in (".js", ".css"):
        return "minified"
    if VERSIONED_NAME.match(p.name):
        return "vendored"
    return None


def content_of(text: str) -> str:
    """The source in a chunk's text, without the lines that introduce it."""
    m = _HEAD.match(text)
    if not m:
        return text
    if text[m.start() : m.end()].startswith(("Function", "Async", "Class", "Module")):
        at = text.find("\nCode:\n")
        return text[at + 7 :] if at >= 0 else ""
    return text[m.end() :]


def _leading_comment(code: str) -> list[tuple[str, bool]]:
    """The lines of the comments that a file begins with, and whether each carries a comment mark of its own."""
    out, closing = [], ""
    for line in code.lstrip("\ufeff\n ").split("\n"):
        bare = line.strip()
        if closing:
            out.append((line, bool(_COMMENT_LINE.match(line))))
            if closing in bare:
                closing = ""
            continue
        if bare and not _COMMENT_LINE.match(line):
            break
        out.append((line, True))
        for opening, end in _BLOCKS:
            if bare.startswith(opening):
                closing = "" if end in bare[len(opening) :] else end
                break
    return out


def _tool_line(line: str) -> bool:
    """Whether a line is a tool's mark rather than a sentence that speaks of generated things."""
    bare = _EDGE.sub("", line)
    for m in GENERATOR_MARK.finditer(bare):
        if not _LEGAL.match(bare, m.end()) and (_SUBJECT.fullmatch(bare, 0, m.start()) or m.group().startswith(("@", "<")) or m.group().isupper()):
            return True
    return False


def by_header(code: str) -> str | None:
    """What the comments at the top of a file tell."""
    top = _leading_comment(code)
    # the first lines that carry comment marks themselves; below, a comment may speak of generated things
    first = next((i for i, (_, marked) in enumerate(top[:14]) if not marked), min(14, len(top)))
    if any(GENERATOR_MARK.search(x) for x, _ in top[: min(first, 6)]) or any(_tool_line(x) for x, _ in top[min(first, 6) :]):
        return "generated"
    head = "\n".join(x for x, _ in top[:first])
    owner = OWNER.search("\n".join(x for x, _ in top))
    # below, the text of a licence speaks of contributors and licences
    if owner and (UPSTREAM.search(head) or any(OWNER.search(x) and UPSTREAM.search(x) or _RELEASE.search(x) for x, _ in top[first:])):
        return "vendored"
    return None


def by_shape(code: str, suffix: str) -> str | None:
    """Minified code and blobs."""
    if suffix not in CONFIG and code:
        lines = code.count("\n") + 1
        if len(code) >= LONG_LINES * lines and len(code) >= 500:
            blanks = code.count(" ") + code.count("\t")
            if blanks <= FEW_BLANKS * len(code):
                return "minified"
    if len(code) >= BLOB_CHARS and suffix != ".ipynb":
        literals = "".join(_LITERAL.findall(code))
        if len(literals) >= BLOB_CHARS and len(literals) >= BLOB_SHARE * len(code) and len(zlib.compress(literals.encode(), 6)) >= BLOB_RATIO * len(literals):
            return "data"
    return None


def _files(rows: list[tuple]):
    """(project id, source, path, code) of the files of a block; code is None for skipped files."""
    for pid, source, chunks_json, stats_json in rows:
        if pid is None:
            continue
        parts: dict[str, list[tuple]] = {}
        for i, c in enumerate(chunks_of(chunks_json)):
            path = text_of(c.get("file"))
            if path:
                line = c.get("start_line")
                parts.setdefault(path, []).append((line if isinstance(line, int) else 0, i, content_of(text_of(c.get("text")))))
        for path, found in parts.items():
            found.sort()
            yield pid, source, path, "\n".join(x[2] for x in found)
        try:
            stats = decode(stats_json)
        except Unreadable:
            continue
        skipped = stats.get("skipped_files") if isinstance(stats, dict) else None
        for entry in skipped if isinstance(skipped, list) else ():
            if isinstance(entry, str):
                path = re.sub(r"\s*\([\d.]+\s*[KMGT]?B\)\s*$", "", entry).strip()
                if path:
                    yield pid, source, path, None


def _code_lines(code: str) -> list[str]:
    """Lines without blanks at their ends and without what is only comment."""
    return [x for x in (line.strip() for line in code.split("\n")) if x and not _COMMENT_LINE.match(x)]


def windows(code: str) -> list[int | None]:
    """Names, by their content, of all code lines together and of each run of ``SHARED_LINES`` (None: too much of one line)."""
    names = [hash64(x) for x in _code_lines(code)]
    n = len(names) - SHARED_LINES + 1
    if n < 1:
        return []
    lines = np.array(names, np.uint64)
    runs = np.zeros(n, np.uint64)
    for k in range(SHARED_LINES):
        runs = grammar.pair_name(runs, lines[k : k + n])
    whole = grammar.mix(lines + grammar.mix(np.arange(len(lines), dtype=np.uint64))).sum(dtype=np.uint64)
    named = [r if len(set(names[i : i + SHARED_LINES])) >= DIFFERENT else None for i, r in enumerate(runs.astype(np.int64).tolist())]
    return [int(whole.astype(np.int64)), *named]


def hash64(s: str) -> int:
    """The same on every executor, other than hash()."""
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace"))


def judge(rows: list[tuple]) -> list[list]:
    """Columns project_id, file, source, reason, windows: a file with its reason, or its runs of lines to be compared."""
    out: list[tuple] = []
    files: list[tuple] = []
    for pid, source, path, code in _files(rows):
        if code:
            files.append((pid, path, source, code))
        elif reason := by_path(path):
            out.append((pid, path, source, reason, None))
    if files:
        codes = [x[3] for x in files]
        symbols, owner = grammar.lexemes([c.encode("utf-8", "replace") for c in codes])
        g = grammar.infer(symbols, owner, len(codes))
        big = (g.rule_size >= RULE_TOKENS) & (g.rule_uses >= RULE_USES)
        cover = np.zeros(len(codes))
        uses = np.zeros(len(codes), np.int64)
        at = g.rule_text[big]
        share = g.rule_size[big] * g.rule_uses[big] / np.maximum(1, g.terminals[at])
        # of each file the rule that covers most comes last
        order = np.argsort(share, kind="stable")
        cover[at[order]], uses[at[order]] = share[order], g.rule_uses[big][order]
        numbers = np.bincount(owner[symbols == grammar.NUMBER], minlength=len(codes))
        for i, (pid, path, source, code) in enumerate(files):
            suffix = PurePosixPath(path).suffix.lower()
            shape = by_shape(code, suffix)
            reason = "minified" if shape == "minified" else None
            if not reason and cover[i] >= COVER and suffix not in CONFIG and not PurePosixPath(path).name.startswith(".env"):
                data = numbers[i] * 4 >= g.terminals[i] or code.lstrip()[:6].upper() == "INSERT"
                # code that repeats itself line by line, or very often: a hand-written file may repeat a block a few times
                lines = code.count("\n") + 1
                if g.terminals[i] >= DATA_TOKENS if data else uses[i] >= LINE_SHARE * lines or (uses[i] >= MANY_USES and cover[i] >= FULL_COVER):
                    reason = "data" if data else "generated"
            # code as varied as hand-written code is told by the marks that tools leave
            reason = reason or shape or by_path(path) or by_header(code)
            if reason:
                out.append((pid, path, source, reason, None))
            elif source and (runs := windows(code)):
                out.append((pid, path, source, None, runs))
    return [list(x) for x in zip(*out)] if out else []


def not_hand_written(projects: DataFrame) -> DataFrame:
    """(project_id, file, reason) of the files that are generated, minified, vendored or data."""
    source = F.lower(F.trim(F.col("source").cast("string"))).alias("source")
    df = projects.select(F.col("id").cast("bigint").alias("id"), source, F.col("chunks_json").cast("string").alias("chunks_json"), F.col("stats_json").cast("string").alias("stats_json"))
    judged = materialise(map_blocks(df, judge, "project_id bigint, file string, source string, reason string, windows array<bigint>"))
    own = judged.where("reason is not null").select("project_id", "file", "reason").distinct()
    files = judged.where("windows is not null").withColumn("n", F.monotonically_increasing_id())
    placed = files.select("n", "source", F.posexplode("windows").alias("at", "run")).where("run is not null")
    # repositories of each run, counted in two steps: a run that a third of all files share fits no single task
    shared = placed.select("run", "source").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") >= REPOSITORIES)
    hits = placed.join(shared, "run")
    # a repository is one of just enough through the fullest of its copies; a file that repeats a part of that is its own
    few = hits.where(F.col("sources") == REPOSITORIES).join(hits.groupBy("n").agg(F.count(F.lit(1)).alias("held")), "n")
    fullest = few.groupBy("run", "source").agg(F.max("held").alias("held"))
    counted = hits.where(F.col("sources") > REPOSITORIES).select("n", "at").unionByName(few.join(fullest, ["run", "source", "held"], "left_semi").select("n", "at"))
    # of each file the lines below shared runs, overlapping runs counted once; place 0 is the file as a whole
    gaps = f"zip_with(slice(ats, 2, size(ats)), slice(ats, 1, size(ats) - 1), (b, a) -> least(b - a, {SHARED_LINES}))"
    covered = (
        counted.groupBy("n").agg(F.sort_array(F.collect_set("at")).alias("ats"))
        .join(files.select("n", "project_id", "file", (F.size("windows") + SHARED_LINES - 2).alias("of")), "n")
        .withColumn("lines", F.expr(f"if(ats[0] = 0, of, aggregate({gaps}, {SHARED_LINES}, (s, x) -> s + x))"))
        .where(F.col("lines") >= SHARED_COVER * F.col("of")).select("project_id", "file", F.lit("vendored").alias("reason")).distinct()
    )
    return own.unionByName(covered)
