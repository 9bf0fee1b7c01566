"""Deeply nested semi-structured columns as flat child tables.

A bottom-up tree automaton classifies every JSON value: leaves get a state by type, arrays by the set of their elements'
states, objects by their labels and the states below them (labels that are data, such as letters or numbers, count as
one). The state at the root decides once per shape which variant a value is; the variant's reader then routes its parts
to the typed subtype tables. All tables keep the keys of the common supertype (parent_table, parent_id, child_kind,
child_key, position, variant).

Defined results: null, blank and cut-off values give no rows; values encoded several times are decoded; a shape that is
no known variant gives no rows and is counted in ``shape_report``; a parent with a null id is skipped; a child that a
parent holds twice is listed once.
"""

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.jsonio import Unreadable, decode, plain_number
from gaugeworks.functions.repeats import once_per_key
from gaugeworks.functions.spread import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: States of the automaton after which it starts anew, so that a worker that lives long doesn't grow with what it has seen.
MOST_STATES = 200_000

#: Which column of which table holds which kinds of children.
COLUMNS = {
    ("questions", "options_json"): ("option",),
    ("questions", "justifications_json"): ("justification",),
    ("questions", "evidence_json"): ("evidence",),
    ("attempts", "score_json"): ("per_question", "selected", "per_focus"),
}
#: Typed columns of the subtype tables besides the supertype's keys.
SUBTYPES = {
    "option": "text string, html string, shuffled boolean",
    "justification": "text string",
    "evidence": "chunk_id string, title string, file string, start_line bigint, end_line bigint, snapshot string",
    "per_question": "correct boolean, answer string, explanation string",
    "selected": "letter string, question_id string",
    "per_focus": "correct bigint, total bigint",
}
KEYS = "parent_table string, parent_id bigint, child_kind string, child_key string, position bigint, variant string"


# --- the automaton -----------------------------------------------------------------------------------------------

_LEAF = {type(None): "0", bool: "b", int: "n", float: "n", str: "s"}
_DATA_LABEL = re.compile(r"\s*(?:[A-Za-z]|[A-Za-z_]{0,3}[\s:#_-]*\d+(?:\.0*)?)\s*", re.A)


class TreeAutomaton:
    """States of JSON values; equal shapes have the same state, whatever their data."""

    def __init__(self, labels: frozenset[str]) -> None:
        #: Labels that are structure; others are data and count as one.
        self.labels = labels
        self.delta: dict[tuple, int] = {}
        self.terms: list[tuple] = []
        self._label: dict[str, str] = {}
        self.leaf = {t: self._step(("leaf", n)) for t, n in _LEAF.items()}

    def _step(self, term: tuple) -> int:
        state = self.delta.get(term)
        if state is None:
            state = self.delta[term] = len(self.terms)
            self.terms.append(term)
        return state

    def label(self, key: str) -> str:
        known = self._label.get(key)
        if known is None:
            known = key if key in self.labels else "#" if _DATA_LABEL.fullmatch(key) else "*"
            if len(self._label) < 100_000:
                self._label[key] = known
        return known

    def run(self, value) -> int:
        """The state of a value, from its leaves upwards."""
        leaf = self.leaf.get(type(value))
        if leaf is not None:
            return leaf
        if isinstance(value, list):
            return self._step(("array", frozenset([self.run(x) for x in value])))
        return self._step(("object", frozenset([(self.label(k), self.run(x)) for k, x in value.items()])))

    def kind(self, state: int) -> str:
        return self.terms[state][0]

    def below(self, state: int) -> dict[str, set[int]]:
        """The states below each label of an object's state; an array's elements are below ''."""
        kind, parts = self.terms[state]
        out: dict[str, set[int]] = {}
        for p in parts if kind != "leaf" else ():
            label, s = p if kind == "object" else ("", p)
            out.setdefault(label, set()).add(s)
        return out


STRUCTURE = frozenset(
    "key text plain html options option meta shuffled chunk_id id title file lines start end snapshot why justification justifications evidence items chunks "
    "correct total percent per_question per_focus question_id selected answer area focus result score data explanation".split()
)
_automaton = TreeAutomaton(STRUCTURE)
_variants: dict[tuple[str, int], str | None] = {}

#: Labels under which a whole value may be wrapped.
WRAPPERS = {
    "option": ("options", "items", "data"),
    "justification": ("justifications", "items", "data"),
    "evidence": ("evidence", "items", "chunks", "data"),
    "score": ("result", "score", "data"),
}


def _classify(kind: str, state: int) -> str | None:
    """The variant of a root state: 'objects', 'texts', 'map', 'single', 'wrapped:<label>' or None."""
    a = _automaton
    form = a.kind(state)
    below = a.below(state)
    if form == "array":
        forms = {a.kind(s) for s in below.get("", ())}
        if kind == "score":
            return None
        if "array" in forms:
            return None
        return "objects" if "object" in forms else "texts" if forms else "empty"
    if form == "leaf":
        return "single" if kind == "evidence" and state in (a.leaf[str], a.leaf[int]) else None
    labels = set(below)
    if kind == "score":
        if labels & {"per_question", "per_focus"}:
            return "score"
    elif kind == "evidence" and labels & {"chunk_id", "title", "file"}:
        return "single"
    for w in WRAPPERS[kind]:
        if w in labels and any(a.kind(s) in ("array", "object") for s in below[w]):
            return f"wrapped:{w}"
    if kind == "score":
        return "empty" if labels <= {"correct", "total", "percent", "*"} else None
    if kind in ("option", "justification"):
        if labels & {"key"}:
            return "single"
        if labels <= {"#"}:
            return "map" if labels else "empty"
    return "empty" if not labels else None


def variant_of(kind: str, value) -> str | None:
    global _automaton
    if len(_automaton.terms) > MOST_STATES:
        _automaton = TreeAutomaton(STRUCTURE)
        _variants.clear()
    state = _automaton.run(value)
    at = (kind, state)
    if at not in _variants:
        _variants[at] = _classify(kind, state)
    return _variants[at]


# --- readers of the variants -------------------------------------------------------------------------------------


def _letter(v) -> str | None:
    return v.strip().upper() or None if isinstance(v, str) else None


def _by_place(i: int) -> str:
    """The letter of a place: A to Z, then AA, AB, ..."""
    out = ""
    while i >= 0:
        out, i = LETTERS[i % 26] + out, i // 26 - 1
    return out


def _text(v) -> str | None:
    """The text of a value that may be given plainly or as {plain, html}."""
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        for k in ("plain", "text", "html", "why"):
            if isinstance(v.get(k), str):
                return v[k]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(v)
    return None


def _unwrap(kind: str, value):
    """(variant path, the value inside its wrappers), or (None, None) for unknown shapes."""
    path = ""
    while True:
        v = variant_of(kind, value)
        if v is None:
            return None, None
        path += ("/" if path else "") + v
        if not v.startswith("wrapped:"):
            return path, value
        value = value[v[8:]]
        if isinstance(value, str):
            try:
                value = decode(value)
            except Unreadable:
                return None, None


def read_options(value) -> Iterator[tuple]:
    """(child_kind, key, position, variant, text, html, shuffled)"""
    variant, v = _unwrap("option", value)
    if variant is None:
        return
    if isinstance(v, dict) and variant.endswith("map"):
        items = [(k, x) for k, x in v.items()]
    elif isinstance(v, dict):
        items = [(None, v)] if v else []
    else:
        items = [(None, x) for x in v]
    for i, (key, x) in enumerate(items):
        if x is None and key is None:
            continue
        text, html, shuffled = _text(x), None, None
        if isinstance(x, dict):
            key = x.get("key") if key is None else key
            inner = x.get("text", x)
            text = _text(inner)
            if isinstance(inner, dict) and isinstance(inner.get("html"), str):
                html = inner["html"]
            meta = x.get("meta")
            if isinstance(meta, dict) and isinstance(meta.get("shuffled"), bool):
                shuffled = meta["shuffled"]
        letter = _letter(key) or _by_place(i)
        yield "option", letter, i, variant, text, html, shuffled


def read_justifications(value) -> Iterator[tuple]:
    """(child_kind, key, position, variant, text)"""
    variant, v = _unwrap("justification", value)
    if variant is None:
        return
    if isinstance(v, dict) and variant.endswith("map"):
        items = list(v.items())
    else:
        items = [(None, x) for x in (v if isinstance(v, list) else [v])]
    for i, (key, x) in enumerate(items):
        text = _text(x)
        if isinstance(x, dict):
            key = x.get("key") if key is None else key
            for k in ("why", "justification", "text"):
                if k in x:
                    text = _text(x[k])
                    break
        if text is None or not text.strip():
            continue
        letter = _letter(key) or _by_place(i)
        yield "justification", letter, i, variant, text


def _lines(v) -> tuple[int | None, int | None]:
    if isinstance(v, dict):
        return plain_number(v.get("start")), plain_number(v.get("end"))
    if isinstance(v, str) and (m := re.fullmatch(r"\s*(\d+)\s*(?:-|–|:)\s*(\d+)\s*", v)):
        return int(m.group(1)), int(m.group(2))
    return None, None


def read_evidence(value) -> Iterator[tuple]:
    """(child_kind, key, position, variant, chunk_id, title, file, start_line, end_line, snapshot)"""
    variant, v = _unwrap("evidence", value)
    if variant is None or variant.endswith("empty"):
        return
    for i, x in enumerate(v if isinstance(v, list) else [v]):
        if x is None:
            continue
        d = x if isinstance(x, dict) else {"chunk_id": x}
        n = plain_number(d.get("chunk_id", d.get("id")))
        string = lambda k: d[k] if isinstance(d.get(k), str) else None
        yield "evidence", str(i), i, variant, None if n is None else f"c{n}", string("title"), string("file"), *_lines(d.get("lines")), string("snapshot")


def _letters(v) -> list[str]:
    if isinstance(v, str):
        v = re.split(r"[,;/|\s]+", v)
    if not isinstance(v, list):
        return []
    return list(dict.fromkeys(x for x in map(_letter, v) if x))


def read_score(value) -> Iterator[tuple]:
    """(child_kind, key, position, variant, typed columns of per_question, selected or per_focus)"""
    variant, v = _unwrap("score", value)
    if variant is None or not variant.endswith("score"):
        return
    questions = v.get("per_question")
    if isinstance(questions, dict):
        pairs = list(questions.items())
    else:
        pairs = [(None, x) for x in questions] if isinstance(questions, list) else []
    for i, (key, x) in enumerate(pairs):
        if not isinstance(x, dict):
            continue
        raw = x.get("question_id") if key is None else key
        n = plain_number(raw)
        qid = str(n) if n is not None else raw.strip() if isinstance(raw, str) and raw.strip() else None
        if qid is None:
            continue
        correct = x.get("correct")
        explanation = x.get("explanation")
        yield "per_question", qid, i, variant, correct if isinstance(correct, bool) else None, ",".join(_letters(x.get("answer"))), explanation if isinstance(explanation, str) else None
        for letter in _letters(x.get("selected")):
            yield "selected", f"{qid}/{letter}", i, variant, letter, qid, None
    focus = v.get("per_focus")
    if isinstance(focus, dict):
        pairs = list(focus.items())
    else:
        pairs = [(x.get("area", x.get("focus")), x) for x in focus if isinstance(x, dict)] if isinstance(focus, list) else []
    for i, (area, x) in enumerate(pairs):
        if isinstance(area, str) and area.strip():
            x = x if isinstance(x, dict) else {}
            yield "per_focus", area.strip(), i, variant, plain_number(x.get("correct")), plain_number(x.get("total")), None


READERS = {"options_json": read_options, "justifications_json": read_justifications, "evidence_json": read_evidence, "score_json": read_score}

# --- DataFrame operators -----------------------------------------------------------------------------------------

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _parse(text):
    try:
        return decode(text)
    except Unreadable:
        return None


def _input(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("bigint")).where("id is not null")


def _child_keys(df: DataFrame, table: str, column: str) -> DataFrame:
    """(parent_table, parent_id, child_kind, child_key) of all children in a column: the supertype's keys."""
    reader = READERS[column]
    schema = pa.schema([("parent_id", pa.int64()), ("child_kind", pa.string()), ("child_key", pa.string())])

    def run(batches):
        for batch in batches:
            ids, kinds, keys = [], [], []
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = _parse(text.as_py())
                if value is not None:
                    for kind, key in dict.fromkeys((r[0], r[1]) for r in reader(value)):
                        ids.append(pid)
                        kinds.append(kind)
                        keys.append(key)
                if len(ids) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(keys)], schema=schema)
                    ids, kinds, keys = [], [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(keys)], schema=schema)

    values = df.select("id", F.col(column).cast("string").alias("j")).where("j is not null")
    out = spread(values).mapInArrow(run, "parent_id bigint, child_kind string, child_key string")
    return out.select(F.lit(table).alias("parent_table"), "parent_id", "child_kind", "child_key")


def subtype_table(df: DataFrame, table: str, child_kind: str) -> DataFrame:
    """The typed table of one kind of children, with the supertype's keys and the variant that each row came from."""
    column = next(c for (t, c), kinds in COLUMNS.items() if t == table and child_kind in kinds)
    reader = READERS[column]
    ddl = f"{KEYS}, {SUBTYPES[child_kind]}"
    schema = pa.schema([(n, _ARROW[k]) for n, k in (f.split() for f in ddl.split(", "))])

    def run(batches):
        for batch in batches:
            rows = []
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = _parse(text.as_py())
                if value is None:
                    continue
                seen = set()
                for r in reader(value):
                    if r[0] == child_kind and r[1] not in seen:
                        seen.add(r[1])
                        rows.append((table, pid, *r[: len(schema) - 2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def read(part: DataFrame) -> DataFrame:
        return spread(part.select("id", F.col(column).cast("string").alias("j")).where("j is not null")).mapInArrow(run, ddl)

    # a parent that comes more than once may hold a child in several rows; all other children are distinct as they are read
    return once_per_key(_input(df.select("id", column)), "id", read)


def children(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """(parent_table, parent_id, child_kind, child_key): one row per child of both tables."""
    out = None
    for table, df in (("questions", questions), ("attempts", attempts)):
        columns = [c for t, c in COLUMNS if t == table]

        def read(part: DataFrame) -> DataFrame:
            keys = [_child_keys(part, table, c) for c in columns]
            return reduce(DataFrame.unionByName, keys)

        # a parent that comes more than once may hold a child in several rows; all other children are distinct as they are read
        one = once_per_key(_input(df.select("id", *columns)), "id", read)
        out = one if out is None else out.unionByName(one)
    return out


def shape_report(df: DataFrame, table: str, column: str) -> DataFrame:
    """(parent_table, column_name, variant, n): how many values of a column are of which variant."""
    kind = "score" if column == "score_json" else COLUMNS[table, column][0]

    @F.pandas_udf("string")
    def variant(texts):
        def one(t):
            if t is None:
                return "null"
            try:
                value = decode(t)
            except Unreadable:
                return "unreadable" if t.strip() else "blank"
            if value is None:
                return "null"
            return _unwrap(kind, value)[0] or "unknown"

        return texts.map(one)

    v = df.select(variant(F.col(column).cast("string")).alias("variant"))
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("parent_table"), F.lit(column).alias("column_name"), "variant", "n")
