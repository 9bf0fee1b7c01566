"""Static analysis: Python syntax trees, declarations in other languages, comment stripping.

Each parser takes one source text and yields flat rows; ``register_parser`` adds one for a suffix. Defined results: text
that doesn't parse gives one row of kind 'error'; empty text gives none; names in strings and comments don't count.
"""

import ast
import functools
import io
import re
import textwrap
import tokenize
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kind, qualified name, first line, last line, arguments or names, documentation, callees)
Row = tuple[str, str, int, int, list[str], str | None, list[str]]
_PARSERS: dict[str, Callable[[str], Iterator[Row]]] = {}


def register_parser(suffix: str, parser: Callable[[str], Iterator[Row]]) -> None:
    """Files that end in ``suffix`` are read by ``parser``."""
    _PARSERS[suffix.lower()] = parser


class _Visitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.scope: list[str] = []

    def _function(self, node) -> None:
        name = ".".join([*self.scope, node.name])
        a = node.args
        args = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]
        calls = sorted({c for x in ast.walk(node) if isinstance(x, ast.Call) and (c := _callee(x.func))})
        self.rows.append(("async_function" if isinstance(node, ast.AsyncFunctionDef) else "function", name, node.lineno, node.end_lineno or node.lineno, args, ast.get_docstring(node), calls))
        self._inside(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        self.rows.append(("class", ".".join([*self.scope, node.name]), node.lineno, node.end_lineno or node.lineno, bases, ast.get_docstring(node), []))
        self._inside(node)

    def _inside(self, node) -> None:
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.rows.append(("import", a.name, node.lineno, node.end_lineno or node.lineno, [a.asname] if a.asname else [], None, []))

    def visit_ImportFrom(self, node) -> None:
        self.rows.append(("import_from", "." * node.level + (node.module or ""), node.lineno, node.end_lineno or node.lineno, [a.name for a in node.names], None, []))


def _callee(f) -> str | None:
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def parse_python(text: str) -> Iterator[Row]:
    """Functions, classes, imports and module-level variables."""
    text = re.sub(r"(?m)^(\s*)([%!].*)$", r"\1pass  # \2", text)  # lines of a notebook that aren't Python
    try:
        tree = ast.parse(textwrap.dedent(text))
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", type(e).__name__, getattr(e, "lineno", None) or 0, 0, [], None, []
        return
    v = _Visitor()
    v.visit(tree)
    yield from v.rows
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        names = [x.id for t in targets for x in ast.walk(t) if isinstance(x, ast.Name)]
        if names:
            yield "variable", names[0], node.lineno, node.end_lineno or node.lineno, names, None, []


_DECLARED = re.compile(
    r"(?m)^[ \t]*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+|default\s+)*(?:class|interface|struct|enum|trait|function|func|fn|def|sub|type)\s+([A-Za-z_$][\w$]*)"
    r"|^[ \t]*([A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\b|^[ \t]*(?i:create)\s+(?:(?i:or\s+replace)\s+)?(?i:table|view|function|procedure)\s+([\w.]+)"
)


def parse_declarations(text: str, language: str = "c", most: int = 30) -> Iterator[Row]:
    """Declared names of other languages, the first ``most`` (a listing), comments and strings aside."""
    plain = blank(text, language)
    for m in list(_DECLARED.finditer(plain))[:most]:
        line = plain.count("\n", 0, m.start()) + 1
        yield "declaration", next(g for g in m.groups() if g), line, line, [], None, []


_CLASS = re.compile(r"(?m)^[ \t]*(?:(?:export|public|private|protected|static|final|abstract|default|sealed|partial)\s+)*(?:class|interface|struct|enum|trait|record|union)\s+([A-Za-z_$][\w$]*)[^;{}()]*\{")
_FUNCTION = re.compile(
    r"(?m)^[ \t]*(?:(?:export|default|public|private|protected|static|final|abstract|async|virtual|inline|override|extern|const)\s+)*"
    r"(?:function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b[^(]*)?\(|(?:[\w$<>\[\],.?:*&]+[\s*&]+)*([A-Za-z_$~][\w$:]*)\s*\()"
)
_CALLED = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_WORDS = frozenset("if for while switch catch return function new throw sizeof typeof else do case delete await super this in of and or not".split())


def _close(plain: str, at: int, pair: str) -> int:
    """The place behind the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(plain, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.end()
    return len(plain)


def parse_braced(text: str) -> Iterator[Row]:
    """Classes and functions of languages with braces: name, lines, parameters, leading comment, called names.

    Brackets are matched on the text without strings and comments; the rows of ``parse_declarations`` come as well.
    """
    plain, found = blank(text, "c"), []
    lines = text.split("\n")
    number = lambda at: plain.count("\n", 0, at) + 1
    classes = []
    for m in _CLASS.finditer(plain):
        end = _close(plain, m.end() - 1, "{}")
        classes.append((m.start(1), end, m.group(1)))
        found.append(("class", m.group(1), number(m.start(1)), number(end - 1), [], _comment_above(lines, number(m.start(1))), []))
    for m in _FUNCTION.finditer(plain):
        name = next(g for g in m.groups() if g)
        if name in _WORDS:
            continue
        inner = _close(plain, m.end() - 1, "()")
        body = re.compile(r"[^;{}()=]*(?:=>\s*)?\{").match(plain, inner)
        if not body:
            continue
        end = _close(plain, body.end() - 1, "{}")
        names = [w[-1] for p in plain[m.end() : inner - 1].split(",") if (w := re.findall(r"[A-Za-z_$][\w$]*", re.split(r"[:=]", p)[0]))]
        calls = sorted({c for c in _CALLED.findall(plain[body.end() : end]) if c not in _WORDS})
        scope = [c for a, b, c in classes if a < m.start() < b]
        line = number(m.start() + len(m.group()) - len(m.group().lstrip()))
        found.append(("function", ".".join([*scope, name]), line, number(end - 1), names, _comment_above(lines, line), calls))
    # the listing of declared names comes first, as for all other languages
    yield from parse_declarations(text)
    yield from sorted(found, key=lambda r: (r[2], r[1]))


def _comment_above(lines: list[str], line: int) -> str | None:
    """The text of the comment that ends on the line before ``line``."""
    out: list[str] = []
    i = line - 2
    inside = i >= 0 and lines[i].strip().endswith("*/")
    while i >= 0:
        bare = lines[i].strip()
        if not (inside or bare.startswith("//")):
            break
        out.append(re.sub(r"^(?:/\*+|\*+/|\*|//+)\s?|\s*\*+/$", "", bare).strip())
        if inside and bare.startswith("/*"):
            break
        i -= 1
    return "\n".join(x for x in reversed(out) if x) or None


def _in_language(language: str) -> Callable[[str], Iterator[Row]]:
    return lambda text: parse_declarations(text, language)


for _s in (".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".cc", ".hpp", ".cs"):
    register_parser(_s, parse_braced)
for _s in (".go", ".rs", ".kt", ".php"):
    register_parser(_s, parse_declarations)
for _s, _l in ((".r", "hash"), (".sh", "hash"), (".rb", "hash"), (".sql", "sql")):
    register_parser(_s, _in_language(_l))
for _s in (".py", ".ipynb"):
    register_parser(_s, parse_python)


_MARKS = {"c": ("//", "/*"), "hash": ("#",), "sql": ("--", "/*")}
_LANGUAGE = {".py": "hash", ".r": "hash", ".sh": "hash", ".rb": "hash", ".yml": "hash", ".yaml": "hash", ".toml": "hash", ".sql": "sql"}


def strip_comments(text: str, language: str = "c") -> str:
    """The text without comments; strings and line ends stay as they are."""
    return _pattern(language).sub(lambda m: m.group(1) if m.group(1) is not None else "\n" * m.group(2).count("\n"), text)


def blank(text: str, language: str) -> str:
    """The text with its comments and the insides of its strings as blanks: every other character keeps its place."""
    hide = lambda x: re.sub(r"[^\n]", " ", x)
    return _pattern(language).sub(lambda m: m.group(1)[0] + hide(m.group(1)[1:-1]) + m.group(1)[-1] if m.group(1) is not None else hide(m.group(2)), text)


@functools.cache
def _pattern(language: str) -> re.Pattern:
    """Strings (first group) and comments (second group) of a language."""
    marks = _MARKS[language]
    line = [m for m in marks if m != "/*"]
    parts = [r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"]
    if language == "hash":
        parts = [r'"""(?:\\.|[^\\])*?"""', r"'''(?:\\.|[^\\])*?'''", *parts]
    comment = "|".join([*((r"(?<![^\s;])#" if m == "#" else re.escape(m)) + r"[^\n]*" for m in line), *([r"/\*.*?(?:\*/|\Z)"] if "/*" in marks else [])])
    return re.compile(f"({'|'.join(parts)})|({comment})", re.S)


def strip_python_comments(text: str) -> str:
    """Python without comments, by its own tokenizer; text that it can't read goes the general way."""
    try:
        lines = text.split("\n")
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                row, col = t.start
                lines[row - 1] = lines[row - 1][:col].rstrip()
        return "\n".join(lines)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return strip_comments(text, "hash")


def without_comments(text: Column, file: Column) -> Column:
    @F.pandas_udf("string")
    def strip(texts, files):
        out = []
        for t, f in zip(texts, files):
            suffix = PurePosixPath(f or "").suffix.lower()
            out.append(None if t is None else strip_python_comments(t) if suffix == ".py" else strip_comments(t, _LANGUAGE.get(suffix, "c")))
        return __import__("pandas").Series(out)

    return strip(text, file)


def symbols(sources: DataFrame, key: list[str], file: str, text: str) -> DataFrame:
    """(key, file, kind, name, start_line, end_line, names, documentation, calls) of the sources' declarations."""
    types = {f.name: f.dataType.simpleString() for f in sources.schema if f.name in key}
    ddl = ", ".join([*(f"{k} {types[k]}" for k in key), "file string", "kind string", "name string", "start_line int", "end_line int", "names array<string>", "documentation string", "calls array<string>"])
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema(
        [(k, arrow[types[k]]) for k in key]
        + [("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("names", pa.list_(pa.string())), ("documentation", pa.string()), ("calls", pa.list_(pa.string()))]
    )
    parsers = dict(_PARSERS)

    def run(batches):
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                path, source = row[-2], row[-1]
                parser = parsers.get(PurePosixPath(path or "").suffix.lower())
                if parser and source:
                    rows += [(*row[:-1], *r) for r in parser(source)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return sources.select(*key, F.col(file).alias("file"), F.col(text).alias("text")).mapInArrow(run, ddl)


def calls(symbols_: DataFrame, key: list[str]) -> DataFrame:
    """(key, caller, callee): edges 'file::name' -> bare name of every call."""
    f = symbols_.where(F.col("kind").isin("function", "async_function"))
    return f.select(*key, F.concat_ws("::", "file", "name").alias("caller"), F.explode("calls").alias("callee")).distinct()
