import json

from hypothesis import given
from hypothesis import strategies as st

from gaugeworks.functions.jsonio import plain_number
from gaugeworks.operators import nested


def keys(column, value):
    text = value if isinstance(value, str) or value is None else json.dumps(value)
    v = nested._parse(text)
    return sorted({(r[0], r[1]) for r in nested.READERS[column](v)}) if v is not None else []


def test_option_shapes():
    want = [("option", "A"), ("option", "B")]
    shapes = [
        [{"key": "A", "text": "x"}, {"key": " b ", "text": "y"}],
        ["x", "y"],
        {"A": "x", "b": "y"},
        {"options": [{"key": "A", "text": "x", "meta": {"shuffled": True}}, {"text": "y"}]},
        [{"key": "A", "text": {"plain": "x", "html": "<p>x</p>"}}, {"key": None, "text": None}],
    ]
    for s in shapes:
        assert keys("options_json", s) == want, s
        assert keys("options_json", json.dumps(json.dumps(s))) == want
    for bad in (None, "", "  ", '[{"key": "A", "te', "null", "3", "[[1]]", '"text"'):
        assert keys("options_json", bad) == []


def test_justifications_without_text_give_no_row():
    assert keys("justifications_json", {"A": "x", "B": None, "C": " ", "d": {"text": "y", "refs": []}}) == [("justification", "A"), ("justification", "D")]
    assert keys("justifications_json", [{"key": "a", "why": "x"}, {"key": "B", "why": None}]) == [("justification", "A")]


def test_evidence_positions():
    assert keys("evidence_json", [None, {"chunk_id": "c1"}, "c2"]) == [("evidence", "1"), ("evidence", "2")]
    assert keys("evidence_json", {"chunk_id": "C3", "lines": "1-2"}) == [("evidence", "0")]
    assert keys("evidence_json", '"c4"') == []  # a bare text isn't JSON of a chunk list: it reads as text within text
    row = list(nested.read_evidence([{"chunk_id": " C07", "lines": {"start": 3, "end": 9}}]))[0]
    assert row[4:] == ("c7", None, None, 3, 9, None)


def test_score_variants():
    q = {"question_id": 3, "correct": True, "selected": ["a", "B"], "answer": ["A"]}
    want = [("per_focus", "naming"), ("per_question", "3"), ("selected", "3/A"), ("selected", "3/B")]
    assert keys("score_json", {"per_question": [q], "per_focus": {"naming": {"correct": 1, "total": 1}}}) == want
    assert keys("score_json", {"per_question": {"3": {"selected": "A,B"}}, "per_focus": [{"area": "naming"}]}) == want
    assert keys("score_json", {"result": {"per_question": [q], "per_focus": {"naming": {}}}, "version": 1}) == want
    assert keys("score_json", {"per_question": [{"question_id": 3, "selected": None}]}) == [("per_question", "3")]


def test_shapes_share_states():
    a = nested.TreeAutomaton(nested.STRUCTURE)
    assert a.run([{"key": "A", "text": "x"}]) == a.run([{"key": "B", "text": "y"}, {"key": "C", "text": ""}])
    assert a.run({"1": []}) == a.run({"77": []})
    assert a.run([1]) != a.run(["1"])


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_readers_survive_any_json(value):
    for column, reader in nested.READERS.items():
        list(reader(nested._parse(json.dumps(value))) if nested._parse(json.dumps(value)) is not None else [])


def test_plain_number():
    for v in (12, 12.0, "12", " 12", "12.0", "q12", "c12", "C12", "c012", "Q 12"):
        assert plain_number(v) == 12, v
    for v in (None, True, -1, 1.5, "", "x", "1-2", float("nan"), float("inf"), "9" * 25):
        assert plain_number(v) is None, v


def test_tables(spark):
    q = [(1, json.dumps(["x", "y"]), json.dumps({"A": "why"}), json.dumps([{"chunk_id": "c1", "title": "t"}]), "extra")] * 2 + [(2, None, "", '[{"chunk', "extra"), (None, '["z"]', None, None, "")]
    questions = spark.createDataFrame(q, "id bigint, options_json string, justifications_json string, evidence_json string, parent_id string")
    attempts = spark.createDataFrame([(7, json.dumps({"per_question": [{"question_id": 1, "selected": ["A"]}]}))], "id bigint, score_json string")
    got = {tuple(r) for r in nested.children(questions, attempts).collect()}
    assert got == {
        ("questions", 1, "option", "A"), ("questions", 1, "option", "B"), ("questions", 1, "justification", "A"), ("questions", 1, "evidence", "0"),
        ("attempts", 7, "per_question", "1"), ("attempts", 7, "selected", "1/A"),
    }
    assert nested.children(questions, attempts).count() == 6
    t = nested.subtype_table(questions, "questions", "evidence").collect()
    assert [(r.parent_id, r.chunk_id, r.title, r.variant) for r in t] == [(1, "c1", "t", "objects")]
    assert nested.children(questions.limit(0), attempts.limit(0)).count() == 0
    report = {(r.variant): r.n for r in nested.shape_report(questions, "questions", "options_json").collect()}
    assert report == {"texts": 3, "null": 1}
