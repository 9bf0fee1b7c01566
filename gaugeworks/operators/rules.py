"""Rules on questions: those that make a question unusable ('h_') and those of style ('s_').

``structured`` reads the nested columns of a question once; the rules are columns over the result. Defined results: a
column that can't be read counts as empty; a question breaks a rule once, however often.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.jsonio import Unreadable, decode
from gaugeworks.functions.spread import spread
from gaugeworks.functions.text import strip
from gaugeworks.operators import nested

MIN_OPTIONS, MAX_OPTIONS = 2, 7


def _word(pattern: str) -> str:
    """A pattern between the ends of ASCII words, in any case, without look-around."""
    return rf"(?i)(^|[^A-Za-z0-9_])(?:{pattern})([^A-Za-z0-9_]|$)"


# Patterns of the rules on wording.
_NAME = r"`?[A-Za-z_][A-Za-z0-9_.]*"
EXPOSED = _word(r"(?:notebook\s+)?cell\s+#?[0-9]+|chunk\s+[a-z]?[0-9]+")
UNSEEN = _word(r"according to (?:the )?evidence")
SUBJECTIVE = _word(r"why|best|better|preferable|preferred|ideal|recommended|most\s+(?:appropriate|suitable|likely)|(?:main|primary)\s+reason")
VAGUE = _word(r"(?:core|main)\s+function(?:ality)?|appropriate ownership")
LOOKUP = _word(r"(?:which|what)(?:\s+of\s+the\s+following)?\s+(?:function|method|class|module|file|component)")
BARE_NAME = r"^\s*`?[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\))?`?\s*$"
BROAD = _word(
    rf"which[^?]{{1,80}}(?:behavior|purpose|responsibility|role)\s+of\s+(?:the\s+)?{_NAME}`?|what\s+does\s+{_NAME}`?\s+(?:do|handle|manage|update|create|load|save)"
    rf"|(?:which\s+observable\s+behavior\s+occurs|what\s+happens)\s+when\s+{_NAME}`?\s+is\s+called"
)
CONDITION = rf"(?i)(^|[^A-Za-z0-9_])(?:if|when)\s+{_NAME}(?:\(\))?`?\s+(?:is([^A-Za-z0-9_]|$)|equals?([^A-Za-z0-9_]|$)|==|!=)"
QUOTED_LINE = r"(?i)the relevant code states"
GIVEAWAY = _word(r"always|never|every\s+time|regardless\s+of|under\s+(?:all|any)\s+circumstances")
UNPROVEN = _word(r"not\s+(?:explicitly\s+)?(?:stated|mentioned|shown|provided|supported)|no\s+mention|not\s+necessarily|outside\s+(?:the\s+)?(?:evidence|provided\s+context)")
NAMED_ANSWER = r"(?i)(?:^|[^A-Za-z0-9_])(?:option|choice|answer)\s+([A-G])\s+(?:is|would be|remains)\s+(?:the\s+)?correct"
CODE_BLOCK = r"(?s)```[a-zA-Z0-9_+.#-]*\s*\n(.*?)```"
RETURNS = _word("returns?")
RETURN = _word("return")
RETURNS_NONE = _word(r"returns?\s+`?(?:none|null)")
RETURN_NONE = _word(r"return\s+(?:none|null)")

_ADDED = "options array<struct<key:string,text:string>>, answer array<string>, justifications map<string,string>, n_evidence int, chunks array<string>"


def _answer(text) -> list[str]:
    try:
        v = decode(text)
    except Unreadable:
        return []
    return [x.strip().upper() for x in v if isinstance(x, str) and x.strip()] if isinstance(v, list) else []


def _rows(text, read) -> list[tuple]:
    try:
        value = decode(text)
    except Unreadable:
        return []
    out: dict = {}
    for r in read(value) if value is not None else ():
        out.setdefault(r[1], r)
    return list(out.values())


def structured(questions: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep, options, answer, justifications, n_evidence, chunks) of the questions, their nested columns read."""
    nested_columns = ("options_json", "answer_json", "justifications_json", "evidence_json")
    df = questions.select(*keep, *[F.col(c).cast("string").alias(c) for c in nested_columns])
    n = len(keep)
    kinds = [pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())])), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.int32(), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for options, answer, why, evidence in zip(*(batch.column(n + i).to_pylist() for i in range(4))):
                found = _rows(evidence, nested.read_evidence)
                row = (
                    [{"key": r[1], "text": r[4]} for r in _rows(options, nested.read_options)], _answer(answer),
                    [(r[1], r[4]) for r in _rows(why, nested.read_justifications)], len(found), list(dict.fromkeys(r[4] for r in found if r[4])),
                )
                for c, v in zip(columns, row):
                    c.append(v)
            names = [*keep, "options", "answer", "justifications", "n_evidence", "chunks"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:n])
    return spread(df).mapInArrow(run, f"{kept}, {_ADDED}")


def flags(choice_count: int | None = None, correct_count: int | None = None) -> Column:
    """The sorted names of the rules that a structured question breaks; both counts only where they were asked for."""
    none = F.array().cast("array<string>")
    stem = F.coalesce(strip(F.col("stem")), F.lit(""))
    options, answer = F.col("options"), F.coalesce("answer", none)
    keys = F.transform(options, lambda o: o["key"])
    texts = F.transform(options, lambda o: F.coalesce(strip(o["text"]), F.lit("")))
    n, n_answer = F.size(options), F.size(answer)
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    wrong = F.filter(options, lambda o: ~F.array_contains(answer, o["key"]))
    code = F.lower(F.array_join(F.regexp_extract_all(stem, F.lit(CODE_BLOCK), F.lit(1)), "\n"))
    shown = stem.rlike(CODE_BLOCK)
    option_text = F.lower(F.array_join(texts, " "))
    named = F.transform(F.regexp_extract_all(F.coalesce("explanation", F.lit("")), F.lit(NAMED_ANSWER), F.lit(1)), F.upper)
    rules = {
        "h_short_stem": F.length(stem) < 10,
        "h_exposed_id": stem.rlike(EXPOSED),
        "h_unseen_evidence": stem.rlike(UNSEEN),
        "h_option_count": ~n.between(MIN_OPTIONS, MAX_OPTIONS),
        "h_asked_options": F.lit(choice_count is not None) & (n != F.lit(choice_count or 0)),
        "h_option_keys": keys != F.slice(letters, F.lit(1), n),
        "h_blank_option": F.array_contains(texts, ""),
        "h_same_options": F.size(F.array_distinct(F.transform(texts, F.lower))) < n,
        "h_no_answer": n_answer == 0,
        "h_unknown_answer": F.size(F.array_except(answer, F.slice(letters, F.lit(1), n))) > 0,
        "h_repeated_answer": F.size(F.array_distinct(answer)) < n_answer,
        "h_answer_count": (n > 0) & ~n_answer.between(1, n - 1),
        "h_asked_answers": F.lit(correct_count is not None) & (n_answer != F.lit(correct_count or 0)),
        "h_explanation": F.size(F.array_except(named, answer)) > 0,
        "h_difficulty": F.col("difficulty").isNull() | ~F.col("difficulty").between(1, 5),
        "h_no_evidence": F.col("n_evidence") == 0,
        "s_subjective": stem.rlike(SUBJECTIVE),
        "s_vague": F.exists(texts, lambda t: t.rlike(VAGUE)),
        "s_lookup": stem.rlike(LOOKUP) | (n >= 2) & F.forall(texts, lambda t: t.rlike(BARE_NAME)),
        "s_broad": stem.rlike(BROAD),
        "s_hidden_condition": stem.rlike(CONDITION) & ~shown,
        "s_quoted_line": stem.rlike(QUOTED_LINE),
        "s_return_unseen": shown & option_text.rlike(RETURNS) & ~code.rlike(RETURN),
        "s_return_none_unseen": shown & option_text.rlike(RETURNS_NONE) & ~code.rlike(RETURN_NONE),
        "s_giveaway": F.exists(wrong, lambda o: F.coalesce(o["text"], F.lit("")).rlike(GIVEAWAY)),
        "s_unproven": F.exists(wrong, lambda o: F.coalesce(F.element_at("justifications", o["key"]), F.lit("")).rlike(UNPROVEN)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))


def hard(found: Column) -> Column:
    return F.filter(found, lambda x: F.startswith(x, F.lit("h_")))


def merged(found: Column, semantic: Column) -> Column:
    """All rules that were broken, or the hard ones alone."""
    return F.when(semantic, found).otherwise(hard(found))


# Kinds of chunks that show an operation, and those that show a path through several parts.
OPERATIONS = ("function", "class", "source", "flow", "callgraph")
PATHS = ("flow", "callgraph", "import_graph", "api_discovery")


def evidence_problem(template: Column, code_mode: Column, stem: Column, kinds: Column, correct_text: Column) -> Column:
    """What of a template's own demands on evidence a question misses, the first one; null if it meets them.

    ``code_mode``: 'none', 'required' or 'insertion'; ``kinds``: of the cited chunks; ``correct_text``: of the right options.
    """
    shown = stem.rlike(CODE_BLOCK)
    has = lambda names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    idle = correct_text.rlike(_word("no action is taken|nothing happens|does nothing"))
    about = template.isin("contextual_use", "interaction_flow")
    return (
        F.when((code_mode == "none") & shown, "shows_code").when(code_mode.isin("required", "insertion") & ~shown, "no_code")
        .when((code_mode == "insertion") & ~F.contains(stem, F.lit("INSERT HERE")), "no_marker")
        .when((template == "condition_outcome") & code_mode.isin("required", "insertion") & idle, "says_nothing_happens")
        .when(about & ~F.coalesce(has(OPERATIONS), F.lit(False)), "no_operation")
        .when((template == "interaction_flow") & ~F.coalesce(has(PATHS), F.lit(False)), "no_path")
        .when((template == "interaction_flow") & stem.rlike(CONDITION), "one_condition")
    )
