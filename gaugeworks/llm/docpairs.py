"""Functions paired with their documentation.

Recursive expressions of the ``regex`` library capture comment, annotations, signature and balanced body together;
strings and comments inside a body are skipped as units, so that braces in them don't count. A capture is kept if its
documentation has at least ``MIN_WORDS`` words of description besides tags and parameter lists.

Defined results: a body that is cut off by the end of the chunk ends there; a chunk without text or id gives nothing;
the same function name in a chunk is listed once per distinct definition; exact repeats of a project add nothing.
"""

import re
from pathlib import PurePosixPath

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.repeats import once_per_key
from gaugeworks.llm.chunks import chunks_of, map_blocks, text_of

MIN_WORDS = 6

# what a body skips as a unit; a quote that opens nothing is an ordinary character
_STRINGS = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)"""
_C_SKIP = rf"(?:{_STRINGS}|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)"
_HASH_SKIP = rf"(?:{_STRINGS}|(?<=[\s;])#[^\n]*+)"
_BRACES = r"(?P<body>\{(?:%s|[^{}\"'`/#]++|(?&body)|[\"'`/#])*+(?:\}|\Z))"
_PARENS = r"(?P<par>\((?:%s|[^()\"'`]++|(?&par)|[\"'`])*+\))"

_C_DOC = r"(?P<doc>(?:[ \t]*+//[^\n]*+\n)++|[ \t]*+/\*(?:[^*]|\*(?!/))*+\*/[ \t]*+\n)"
_C_NOTE = r"(?:[ \t]*+(?:@[\w.]+[^\n{;]*+|\[[A-Z][^\]\n]*+\])[ \t]*+\n)*+"
_NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|return|else|do|try|new|throw|case|using|lock|synchronized|function|sizeof|await|typeof|in|of)\b)"

_JS = regex.compile(
    rf"(?m)^{_C_DOC}{_C_NOTE}[ \t]*+(?P<sig>"
    rf"(?:export[ ]++)?(?:default[ ]++)?(?:async[ ]++)?function\b[ ]*+\*?[ ]*+(?P<n1>[A-Za-z_$][\w$]*+)[ ]*+(?:<[^>\n]*+>)?{_PARENS % _STRINGS}(?:[ ]*+:[^{{\n]*+)?"
    rf"|(?:export[ ]++)?(?:default[ ]++)?(?:const|let|var)[ ]++(?P<n2>[A-Za-z_$][\w$]*+)[ ]*+(?::[^=\n]*+)?=[ ]*+(?:async[ ]*+)?(?:function\b[ ]*+\*?[ ]*+[\w$]*+[ ]*+)?"
    rf"(?:<[^>\n]*+>)?(?:(?&par)|[A-Za-z_$][\w$]*+)(?:[ ]*+:[^={{\n]*+)?(?:[ ]*+=>)?"
    rf"|(?:(?:public|private|protected|static|async|override|readonly|get|set)[ ]++)*+{_NOT_A_NAME}(?P<n3>[A-Za-z_$#][\w$]*+)[ ]*+(?:[:=][ ]*+(?:async[ ]*+)?function\b[ ]*+)?(?:<[^>\n]*+>)?(?&par)(?:[ ]*+:[^{{\n;]*+)?"
    rf"|(?P<n4>[A-Za-z_$][\w$.]*+)[ ]*+=[ ]*+(?:async[ ]*+)?function\b[ ]*+[\w$]*+[ ]*+(?&par)"
    # a body in braces, or after an arrow an expression
    rf")\s*+(?:{_BRACES % _C_SKIP}|(?<==>|=>[ ])(?:{_STRINGS}|(?&par)|[^\s;(){{}}\"'`]++|[ ](?![ ]*+[{{]))++;?)"
)
_TYPED = regex.compile(
    rf"(?m)^{_C_DOC}{_C_NOTE}[ \t]*+(?P<sig>(?:[\w.<>\[\],?*&:]++[ \t*&]++)++{_NOT_A_NAME}\*?(?P<n1>[A-Za-z_~][\w:]*+)[ ]*+{_PARENS % _STRINGS}"
    rf"(?:[ ]*+(?:const|override|noexcept|final|throws[ ]++[\w.,\s]++|where[^{{]*+))*+)\s*+(?:=>[^;\n]*+;|{_BRACES % _C_SKIP})"
)
_GO = regex.compile(rf"(?m)^{_C_DOC}[ \t]*+(?P<sig>func[ ]++(?:\([^)\n]*+\)[ ]*+)?(?P<n1>\w++)(?:\[[^\]\n]*+\])?{_PARENS % _STRINGS}(?:[ ]*+(?&par))?[^{{\n]*+){_BRACES % _C_SKIP}")
_KT = regex.compile(
    rf"(?m)^{_C_DOC}{_C_NOTE}[ \t]*+(?P<sig>(?:(?:public|private|protected|internal|open|final|abstract|override|inline|suspend|tailrec|operator|infix|actual)[ ]++)*+fun[ ]++"
    rf"(?:<[^>\n]*+>[ ]*+)?(?:[\w<>?, ]++\.)*+(?P<n1>\w++|`[^`\n]++`)[ ]*+{_PARENS % _STRINGS}(?:[ ]*+:[^={{\n]++)?)\s*+(?:{_BRACES % _C_SKIP}|=[^\n]++)"
)
_RS = regex.compile(
    rf"(?m)^{_C_DOC}(?:[ \t]*+#\[[^\]\n]*+\][ \t]*+\n)*+[ \t]*+(?P<sig>(?:pub(?:\([^)\n]*+\))?[ ]++)?(?:(?:const|async|unsafe|extern[ ]++\"[^\"\n]*+\")[ ]++)*+fn[ ]++(?P<n1>\w++)[ ]*+"
    rf"(?:<[^(){{}}]*+>)?{_PARENS % '(?!)'}[^{{;]*+){_BRACES % _C_SKIP}"
)
_HASH_DOC = r"(?P<doc>(?:[ \t]*+#(?!!)[^\n]*+\n)++)"
_R = regex.compile(rf"(?m)^{_HASH_DOC}[ \t]*+(?P<sig>(?P<n1>`[^`\n]++`|[A-Za-z.][\w.]*+)[ ]*+(?:<<?-|=)[ ]*+function[ ]*+{_PARENS % _HASH_SKIP})\s*+(?:{_BRACES % _HASH_SKIP}|[^\n{{]++)")
_SH = regex.compile(rf"(?m)^{_HASH_DOC}[ \t]*+(?P<sig>(?:function[ ]++(?P<n1>[\w\-.:]++)[ ]*+(?:\([ ]*+\))?|(?P<n2>[\w\-.:]++)[ ]*+\([ ]*+\)))\s*+(?:{_BRACES % _HASH_SKIP}|{_PARENS % _HASH_SKIP})")
_SQL_SKIP = rf"(?:{_STRINGS}|--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)"
_SQL_ENDS = r"\bend[ ]++(?:if|loop|while|case|repeat|for)\b"
# statements between BEGIN and END, in which CASE has an END of its own
_SQL_BLOCK = (
    rf"(?P<block>\bbegin\b(?:{_SQL_SKIP}|(?&block)|(?P<case>\bcase\b(?:{_SQL_SKIP}|(?&case)|{_SQL_ENDS}|(?!\bend\b)(?:\w++|\W))*+\bend\b)"
    rf"|{_SQL_ENDS}|(?!\bend\b)(?:\w++|\W))*+(?:\bend\b|\Z))"
)
_SQL = regex.compile(
    r"(?mi)^(?P<doc>(?:[ \t]*+--[^\n]*+\n)++|[ \t]*+/\*(?:[^*]|\*(?!/))*+\*/[ \t]*+\n)[ \t]*+"
    r"(?P<sig>create[ ]++(?:or[ ]++(?:replace|alter)[ ]++)?(?:function|procedure)[ ]++(?:if[ ]++not[ ]++exists[ ]++)?(?:[\w\"]++\.)?\"?(?P<n1>\w++)\"?[ ]*+"
    rf"{_PARENS % _STRINGS})(?P<body>(?:\$(?P<tag>\w*+)\$.*?\$(?P=tag)\$|{_SQL_SKIP}|{_SQL_BLOCK}|\w++|[^;$\w])*+(?:;|\Z))",
    regex.S,
)
_PY_STRING = r"""[rRuUbB]{0,2}(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"|\Z)|'''(?:[^'\\]|\\.|'(?!''))*+(?:'''|\Z)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_PY = regex.compile(
    rf"(?m)^(?P<doc>(?:[ \t]*+#(?!!)[^\n]*+\n)*+)(?:[ \t]*+@[\w.]++[ ]*+(?:(?&par))?[^\n]*+\n)*+(?P<ind>[ \t]*+)(?P<sig>(?:async[ ]++)?def[ ]++(?P<n1>\w++)[ ]*+(?:\[[^\]\n]*+\])?"
    rf"(?P<par>\((?:{_PY_STRING}|\#[^\n]*+|[^()\"'\#]++|(?&par)|[\"'])*+\))(?:{_PY_STRING}|(?P<sq>[\[{{](?:{_PY_STRING}|[^\[\]{{}}\"']++|(?&sq))*+[\]}}])|(?&par)|[^:\n\[{{(\"'])*+):"
    # the body below, further in, or behind the colon
    rf"(?:[ \t]*+(?:\#[^\n]*+)?\n(?:[ \t]*+(?:\#[^\n]*+)?\n)*+(?P=ind)[ \t]++(?P<string>{_PY_STRING})?(?P<body>[^\n]*+(?:\n(?:(?P=ind)[ \t]++[^\n]*+|[ \t]*+(?=\n|\Z)))*+)"
    rf"|[ \t]*+(?P<string1>{_PY_STRING})[^\n]*+)",
    regex.S,
)

BY_SUFFIX = {
    ".js": _JS, ".jsx": _JS, ".mjs": _JS, ".cjs": _JS, ".ts": _JS, ".tsx": _JS, ".vue": _JS,
    ".java": _TYPED, ".cs": _TYPED, ".c": _TYPED, ".h": _TYPED, ".cc": _TYPED, ".cpp": _TYPED, ".hpp": _TYPED, ".kt": _KT, ".kts": _KT, ".rs": _RS,
    ".go": _GO, ".r": _R, ".sh": _SH, ".bash": _SH, ".sql": _SQL, ".py": _PY, ".ipynb": _PY,
}
#: What tells a language where the suffix doesn't.
_SIGNS = (
    (_PY, re.compile(r"(?m)^[ \t]*(?:async[ ]+)?def[ ]+\w+[ ]*(?:\[[^\]\n]*\])?\(")),
    (_GO, re.compile(r"(?m)^func[ ]+(?:\([^)\n]*\)[ ]*)?\w+(?:\[[^\]\n]*\])?\(")),
    (_KT, re.compile(r"(?m)^[ \t]*(?:[a-z]+[ ]+)*fun[ ]+(?:<[^>\n]*>[ ]*)?[\w.<>?`]+[ ]*\(")),
    (_RS, re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ ]+)?(?:(?:const|async|unsafe)[ ]+)*fn[ ]+\w+[ ]*[<(]")),
    (_R, re.compile(r"<<?-[ ]*function[ ]*\(")),
    (_SQL, re.compile(r"(?mi)^[ \t]*create[ ]+(?:or[ ]+(?:replace|alter)[ ]+)?(?:function|procedure)[ ]")),
    (_SH, re.compile(r"(?m)^[ \t]*(?:function[ ]+[\w\-.:]+[ ]*(?:\([ ]*\))?|[\w\-.:]+[ ]*\([ ]*\))\s*\{")),
    (_JS, re.compile(r"\bfunction\b|=>|\b(?:const|let)[ ]")),
    (_TYPED, re.compile(r"(?m)^[ \t]*(?:[\w.<>\[\],?*&:]+[ \t*&]+)+[A-Za-z_~][\w:]*[ ]*\([^;{}]*\)[^;{}()]*\{")),
)
#: What a chunk of a language must hold at least for a documented function.
_NEEDS = {_JS: ("//", "/*"), _TYPED: ("//", "/*"), _GO: ("//", "/*"), _KT: ("//", "/*"), _RS: ("//", "/*"), _R: ("#",), _SH: ("#",), _SQL: ("--", "/*")}

_HEAD = re.compile(r"^(?:Async f|F)unction ([\w.$]+) in [^\n]*\n(?:Parameters:[^\n]*\n)?Docstring: ?([^\n]*(?:\n(?!Code:)[^\n]*)*)\nCode:")
_EDGE = re.compile(r"^\s*(?:/\*[*!]?|\*+/|///?!?|\*(?!/)|#'|#+|--+|<!--)[ \t]?|\*+/\s*$|-->\s*$")
_TAG_LINE = re.compile(
    r"^\s*(?:[@\\](?!code|link)\w+|:\w+[^:\n]*:|</?(?:param|returns?|exception|typeparam|remarks|example|value)\b|[-*]?\s*\w+\s*(?:\([^)]*\))?\s*:\s|"
    r"(?:args?|arguments?|params?|parameters?|returns?|raises?|throws?|yields?|examples?|notes?|see also|attributes|keyword args?)\s*:?\s*$)",
    re.I,
)
_SECTION = re.compile(r"^\s*(?:args?|arguments?|params?|parameters?|returns?|raises?|throws?|yields?|examples?|attributes|keyword args?)\s*:?\s*$", re.I)
_WORD = re.compile(r"[^\W\d_](?:[\w'’\-.]*\w)?", re.U)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SAYS_NOTHING = re.compile(
    r"(?i)^\s*(?:todo|fixme|xxx|tbd|wip|hack|none|n/?a|\(none\)|see above|description here|docstring|pass|document me)\b|do not edit|auto-?generated|eslint|pylint|noqa|pragma|"
    r"@?copyright|licen[sc]ed? under|type: ignore|nolint|clang-format|prettier-ignore|automatisch erzeugt"
)
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|import|from|var|const|let|def|function|class)\b.*[({=:;]|^\s*[\w.\[\]]+\s*(?:=|\+=|<-|:=)\s*\S|^\s*[\w.]+\(.*\)\s*$|^\s*</?\w+")


def describe(doc: str) -> str:
    """The description in a comment or docstring: without comment marks, tags, parameter lists and rulers."""
    out, skipping = [], False
    for line in doc.split("\n"):
        for _ in range(2):
            line = _EDGE.sub("", line, count=1)
        line = re.sub(r"</?(?:summary|para|c|see|code|p|b|i|em|pre|br)\b[^>]*>", " ", line).strip()
        if not line or re.fullmatch(r"[\W_]+", line):
            skipping = skipping and bool(line)
            continue
        if _SECTION.match(line) or re.fullmatch(r"[-=~_*#\s]*[\w ]{1,40}[-=~_*#\s]{3,}", line):
            skipping = bool(_SECTION.match(line))
            continue
        if _TAG_LINE.match(line):
            skipping = True
            continue
        if skipping:
            continue
        out.append(line)
    return "\n".join(out)


def says_something(description: str, name: str) -> bool:
    """Whether a description has enough words that aren't code, a mark to do or the name again."""
    lines = [x for x in description.split("\n") if not _CODE_LINE.search(x)]
    text = " ".join(lines)
    if not text or _SAYS_NOTHING.search(text):
        return False
    words = _WORD.findall(_CJK.sub(" ", text))
    parts = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) | {name.lower()}
    return len(words) + len(_CJK.findall(text)) // 2 >= MIN_WORDS and any(w.lower() not in parts for w in words + _CJK.findall(text))


def _unquote(literal: str) -> str:
    body = re.sub(r"^[rRuUbB]{0,2}", "", literal)
    for q in ('"""', "'''", '"', "'"):
        if body.startswith(q):
            return body[len(q) : -len(q)] if body.endswith(q) and len(body) >= 2 * len(q) else body[len(q) :]
    return body


def _python_code(text: str, file: str) -> str:
    """The code of a chunk, without the lines that introduce it."""
    for mark in ("\nCode:\n", "):\n"):
        at = text.find(mark)
        if 0 <= at and (mark == "\nCode:\n" or text.startswith("Notebook ") or "Content (lines" in text[: at + 2]):
            return text[at + len(mark) :]
    return text


def pairs(text: str, file: str, kind: str = "") -> list[tuple[str, str, str, str]]:
    """(function name, description, signature, code) of the documented functions of a chunk."""
    out: list[tuple[str, str, str, str]] = []
    head = _HEAD.match(text)
    suffix = PurePosixPath(file).suffix.lower()
    pattern = BY_SUFFIX.get(suffix) or (_PY if text.startswith(("Function ", "Async function ")) else None)
    if pattern is None or suffix == ".ipynb" and not head:
        # languages by what the text holds; a chunk without a file is none of a source
        patterns = [p for p, sign in _SIGNS if sign.search(text)] if file else []
        if patterns and patterns != [_PY]:
            code = _python_code(text, file)
            found = [_python(code) if p is _PY else _braced(code, p) for p in patterns]
            return max(found, key=len)
        if pattern is None and not patterns:
            return out
        pattern = _PY
    if pattern is _PY:
        out = _python(_python_code(text, file)) if "def " in text else []
        # the chunk's own documentation line stands for a docstring that was cut off
        if head and (name := head.group(1).split(".")[-1]) not in {x[0] for x in out}:
            description = describe(head.group(2))
            if says_something(description, name):
                code = text[head.end() :].lstrip("\n")
                out.append((name, description, code.split("\n", 1)[0].strip(), code))
        return out
    return _braced(text, pattern)


def _braced(code: str, pattern) -> list[tuple[str, str, str, str]]:
    out: list[tuple[str, str, str, str]] = []
    if not any(x in code for x in _NEEDS[pattern]):
        return out
    at = 0
    while m := pattern.search(code, at):
        # functions nested in a body are looked at too
        at = max(m.end("sig"), m.start() + 1)
        groups = m.groupdict()
        name = next((groups[k] for k in ("n1", "n2", "n3", "n4") if groups.get(k)), "").strip("`").split(".")[-1].split("::")[-1]
        description = describe(m.group("doc"))
        if name and says_something(description, name):
            out.append((name, description, m.group("sig").strip(), code[m.start("sig") : m.end()]))
    return out


def _python(code: str) -> list[tuple[str, str, str, str]]:
    out = []
    at = 0
    while m := _PY.search(code, at):
        # functions nested in a body are looked at too
        at = max(m.end("sig"), m.start() + 1)
        name = m.group("n1")
        for doc in (_unquote(m.group("string") or m.group("string1") or ""), m.group("doc")):
            description = describe(doc)
            if says_something(description, name):
                out.append((name, description, m.group("sig").strip(), code[m.start("sig") : m.end()]))
                break
    return out


def _rows(rows: list[tuple]):
    for pid, chunks_json in rows:
        for c in chunks_of(chunks_json):
            text = text_of(c.get("text"))
            if text and isinstance(c.get("id"), str):
                file = text_of(c.get("file"))
                for name, description, sig, code in pairs(text, file, text_of(c.get("kind"))):
                    yield pid, c["id"], file, name, description, sig, code


def _found_rows(rows: list[tuple]) -> list[list]:
    out = dict.fromkeys((p, c, n) for p, c, _, n, _, _, _ in _rows(rows))
    return [list(x) for x in zip(*out)] if out else []


def _pair_rows(rows: list[tuple]) -> list[list]:
    out = dict.fromkeys(_rows(rows))
    return [list(x) for x in zip(*out)] if out else []


def _input(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").cast("bigint").alias("id"), F.col("chunks_json").cast("string").alias("chunks_json")).where("chunks_json is not null")


def documented_functions(projects: DataFrame) -> DataFrame:
    """(project_id, chunk_id, function_name) of the functions with non-trivial documentation."""
    return map_blocks(_input(projects), _found_rows, "project_id bigint, chunk_id string, function_name string").distinct()


def code_description_pairs(projects: DataFrame) -> DataFrame:
    """(project_id, chunk_id, file, function_name, description, signature, code), one row per documented function."""
    schema = "project_id bigint, chunk_id string, file string, function_name string, description string, signature string, code string"
    return once_per_key(_input(projects), "id", lambda df: map_blocks(df, _pair_rows, schema))
