import difflib
import itertools
import random

import numpy as np
import pytest

from gaugeworks.operators import graph, planner, privacy, quality, records, rules, vectors
from gaugeworks.operators.alignment import align_to_targets, rubric_rows, split_blocks
from gaugeworks.plans.steps import run_steps
from pyspark.sql import functions as F

STRUCTURED = "id bigint, stem string, difficulty int, explanation string, options array<struct<key:string,text:string>>, answer array<string>, justifications map<string,string>, n_evidence int, chunks array<string>"


def question(**change):
    q = {
        "id": 1, "stem": "What does `a_b` return after two calls?", "difficulty": 3, "explanation": "Option A is correct.", "options": [("A", "Nothing at all."), ("B", "It returns one.")],
        "answer": ["A"], "justifications": {"B": "It is contradicted."}, "n_evidence": 1, "chunks": ["c1"],
    }
    return tuple((q | change).values())


CODE = "What comes out of this?\n```python\nx = f(1)\n```"
BROKEN = {
    "h_short_stem": {"stem": "Why"}, "h_exposed_id": {"stem": "What does notebook cell 12 show about it?"}, "h_unseen_evidence": {"stem": "According to the evidence, name the value."},
    "h_option_count": {"options": [("A", "one")]}, "h_option_keys": {"options": [("A", "one"), ("C", "two")]}, "h_blank_option": {"options": [("A", "one"), ("B", " ")]},
    "h_same_options": {"options": [("A", "One"), ("B", "one")]}, "h_no_answer": {"answer": []}, "h_unknown_answer": {"answer": ["A", "F"]}, "h_repeated_answer": {"answer": ["A", "A"]},
    "h_answer_count": {"answer": ["A", "B"]}, "h_explanation": {"explanation": "So choice B is the correct one."}, "h_difficulty": {"difficulty": 6}, "h_no_evidence": {"n_evidence": 0},
    "s_subjective": {"stem": "Which is the most suitable order here?"}, "s_vague": {"options": [("A", "Its core functionality."), ("B", "It returns one.")]}, "s_lookup": {"stem": "Which of the following function names fit?"},
    "s_broad": {"stem": "What does load_all handle in this project?"}, "s_hidden_condition": {"stem": "What is printed if x_1 == 3 at the end?"}, "s_quoted_line": {"stem": "The relevant code states: x = 1. And then?"},
    "s_return_unseen": {"stem": CODE}, "s_return_none_unseen": {"stem": CODE, "options": [("A", "Nothing."), ("B", "It does return `None`.")]}, "s_giveaway": {"options": [("A", "One."), ("B", "It never ends.")]},
    "s_unproven": {"justifications": {"B": "This is not explicitly stated."}},
}


def test_each_rule_finds_its_fault(spark):
    rows = [question(id=i, **BROKEN[k]) for i, k in enumerate(BROKEN)] + [question(id=99)]
    df = spark.createDataFrame(rows, STRUCTURED)
    got = {r.id: r.f for r in df.select("id", rules.flags().alias("f")).collect()}
    for i, k in enumerate(BROKEN):
        assert k in got[i], (k, got[i])
    assert got[99] == []
    asked = df.where("id = 99").select(rules.flags(4, 2).alias("f")).first().f
    assert asked == ["h_asked_answers", "h_asked_options"]
    both = F.array(F.lit("h_x"), F.lit("s_y"))
    assert spark.range(1).select(rules.merged(both, F.lit(True)).alias("a"), rules.merged(both, F.lit(False)).alias("b")).first() == (["h_x", "s_y"], ["h_x"])


def test_structured_survives_any_column(spark):
    rows = [(1, "s", '[{"key":"a","text":"x"},{"key":"b"}]', '["a", 2, " B "]', "{}", "[null, 3]", 7), (2, None, None, None, None, None, None), (3, "s", '{"a', '"A"', "", "x", 1)]
    df = spark.createDataFrame(rows, "id bigint, stem string, options_json string, answer_json string, justifications_json string, evidence_json string, options int")
    got = {r.id: (r.options, r.answer, r.n_evidence, r.chunks) for r in rules.structured(df, ("id", "stem")).collect()}
    assert got[1] == ([("A", "x"), ("B", None)], ["A", "B"], 1, ["c3"]) and got[2] == ([], [], 0, []) and got[3] == ([], [], 0, [])
    assert rules.structured(df.limit(0), ("id",)).count() == 0


def test_template_demands(spark):
    def problem(template, mode, stem, kinds, text=""):
        c = lambda x: F.lit(x)
        return spark.range(1).select(rules.evidence_problem(c(template), c(mode), c(stem), F.array(*map(F.lit, kinds)).cast("array<string>"), c(text)).alias("p")).first().p

    assert problem("x", "none", CODE, []) == "shows_code" and problem("x", "required", "plain", []) == "no_code" and problem("x", "insertion", CODE, []) == "no_marker"
    assert problem("condition_outcome", "required", CODE, [], "Then nothing happens.") == "says_nothing_happens"
    assert problem("contextual_use", "none", "s", ["structure"]) == "no_operation" and problem("interaction_flow", "none", "s", ["function"]) == "no_path"
    assert problem("interaction_flow", "none", "What if x is 3?", ["flow"]) == "one_condition" and problem("interaction_flow", "none", "s", ["flow"]) is None


def test_normalised_questions_keep_their_meaning(spark):
    options = [("A", "one"), ("B", "two"), ("C", "three"), ("D", None)]
    df = spark.createDataFrame([(i, options, ["B", "C"], "Option B is right, choice d is not; answer A neither.") for i in range(8)], "id bigint, options array<struct<key:string,text:string>>, answer array<string>, explanation string")
    seen = set()
    for r in df.select("id", records.normalised(F.col("options"), F.col("answer"), F.col("id"), F.col("explanation")).alias("x")).collect():
        o, a, e = r.x
        new = {t: k for k, t in o}
        assert [k for k, _ in o] == list("ABCD") and {t for _, t in o} == {"one", "two", "three", None}
        assert a == sorted([new["two"], new["three"]])
        assert e == f"Option {new['two']} is right, choice {new[None]} is not; answer {new['one']} neither."
        seen.add(tuple(t for _, t in o))
    assert len(seen) > 1


def test_gate_lists_and_edits(spark):
    a = spark.createDataFrame([(1, 5, "[1, \"2\", 1]"), (2, 5, "[9]"), (3, 5, None), (4, 6, "[1]"), (None, 5, "[1]")], "id bigint, project_id bigint, question_ids_json string")
    q = spark.createDataFrame([(1, 5, "approved"), (2, 5, "approved")], "question_id bigint, project bigint, status string")
    lists = records.question_lists(a, ("project_id",))
    assert sorted(map(tuple, lists.collect())) == [(1, 5, 0, 1), (1, 5, 1, 2), (2, 5, 0, 9), (4, 6, 0, 1)]
    assert sorted(map(tuple, records.publish_gate(lists, q).collect())) == [(1, 2, True), (2, 1, False), (4, 1, False)]
    old = spark.createDataFrame([(1, "a", None, 5), (2, "a", "x", 5)], "id bigint, stem string, status string, confidence int")
    new = spark.createDataFrame([(1, "b", None, 5), (2, "a", "y", 5)], "id bigint, stem string, status string, confidence int")
    assert sorted(map(tuple, records.after_edit(old, new, "id", ["stem"], ["status"], ["confidence"]).collect())) == [(1, True, False, None), (2, False, True, 5)]
    v = spark.createDataFrame([(1, "1"), (2, "2"), (3, None)], "id bigint, v string")
    assert sorted(map(tuple, records.refresh(v, "v", 2, lambda d: d.withColumn("v", F.lit("new"))).collect())) == [(1, "new"), (2, "2"), (3, "new")]


def test_nearest_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5)).round(2)
    m[7] = m[8] = m[9]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, [1.0]), (102, [0.0] * 5), (103, [None] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = set()
    for i in range(0, 60, 10):
        s = [(-round(float(u[i] @ u[j]), 6), j) for j in range(60) if j != i]
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(sorted(s)[:4])}
    for limit in (vectors.PASS_NUMBERS, 10):
        monkeypatch.setattr(vectors, "PASS_NUMBERS", limit)
        got = vectors.nearest(df, df.where("vec_id % 10 = 0 and vec_id < 60"), 4)
        assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == want


def test_selection_against_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(3):
        for i in range(rnd.randrange(1, 25)):
            rows.append((g, f"k{g}_{i}", rnd.sample(["p", "q", "r"], rnd.randrange(1, 3)), rnd.choice("st"), rnd.choice(["", "One", "one", "two"]), rnd.sample(["1", "2", "3"], 2), rnd.random() < 0.5, rnd.randrange(10) / 10))
    df = spark.createDataFrame(rows, "g int, plan_key string, points array<string>, template string, subject string, evidence array<string>, shows_code boolean, relevance double")
    import hashlib

    def lost(a, b):
        shared, same = len(set(a[2]) & set(b[2])), a[3] == b[3]
        subject = b[4].casefold() != "" and a[4].casefold() == b[4].casefold()
        return round(0.35 * shared + 0.15 * same + 0.25 * (same and shared > 0) + 0.40 * subject + 0.10 * min(len(set(a[5]) & set(b[5])), 3), 4)

    want = []
    for g in range(3):
        rest, chosen = [r for r in rows if r[0] == g], []
        while rest and len(chosen) < 5:
            n = sum(c[6] for c in chosen)
            value = lambda r: round(r[7] - sum(lost(c, r) for c in chosen) - 0.55 * (n >= 2 if r[6] else len(chosen) - n >= 3), 6)  # noqa: B023, E731
            best = min(rest, key=lambda r: (-value(r), hashlib.md5(f"7:{r[1]}".encode()).hexdigest(), r[1]))
            want.append((g, len(chosen) + 1, best[1], value(best)))
            chosen.append(best)
            rest.remove(best)
    got = planner.select_plans(df, "g", 5, seed=7).collect()
    assert sorted((r.g, r.position, r.plan_key, round(r.score, 6)) for r in got) == sorted(want)
    assert planner.select_plans(df.limit(0), "g", 5).count() == 0


def test_similar_questions_against_all_pairs(spark):
    rnd = random.Random(9)
    vocabulary = "read write table queue sort merge first last index value returns stage row block guard".split()
    rows = []
    for i in range(40):
        base = rnd.choice(rows)[2].split() if rows and rnd.random() < 0.7 else [rnd.choice(vocabulary) for _ in range(9)]
        base[rnd.randrange(9)] = rnd.choice(vocabulary)
        rows.append((i, i % 2, " ".join(base), [("A", rnd.choice(vocabulary)), ("B", rnd.choice(vocabulary))], rnd.choice([[], ["c1"], ["c2"]])))
    rows.append((90, 0, rows[0][2].upper(), rows[0][3], rows[0][4]))
    df = spark.createDataFrame([*rows, (91, None, "x", [], []), (92, 0, None, [], [])], "id bigint, project_id bigint, stem string, options array<struct<key:string,text:string>>, chunks array<string>")
    j = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want: dict = {}
    for a, b in itertools.combinations(rows[:-1], 2):
        if a[1] != b[1] or (a[2], a[3], a[4]) == (b[2], b[3], b[4]):
            continue
        words = j(set(a[2].split()), set(b[2].split()))
        s = 0.65 * difflib.SequenceMatcher(None, a[2], b[2], autojunk=False).ratio() + 0.2 * words + 0.15 * j({t for _, t in a[3]}, {t for _, t in b[3]})
        s = round(s * (0.85 if a[4] and b[4] and a[4] != b[4] else 1.0), 4)
        if s >= 0.76 and words >= 0.25:
            want[b[0]] = max(want.get(b[0], (0, 0)), (s, -a[0]))
    pairs, members = quality.similar_questions(df)
    assert {r.later: (r.similarity, -r.earlier) for r in pairs.collect()} == want and len(want) > 5
    assert {r.id: r.class_id for r in members.collect()}[90] == 0


def test_outlines_flow_trees_and_imports(spark):
    text = "Flow of main\nmain\n  load\n    parse; lines\n  save\n\n  (recursion)\nother"
    df = spark.createDataFrame([(1, "flow", text), (1, "note", "A -> b -> c\na → B"), (2, "flow", None)], "g int, kind string, t string")
    assert {(r.src, r.dst) for r in graph.indented(df.where("kind = 'flow'"), ["g"], "t").collect()} == {("main", "load"), ("load", "parse"), ("main", "save")}
    got = {(r.src, r.dst) for r in graph.relations(df, ["g"], "kind", "t").collect()}
    assert len(got) == 5 and ("b", "c") in got and len([x for x in got if x[0].lower() == "a"]) == 1
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]
    assert graph.flow_lines(edges, "a") == ["a", "  b", "    c", "      a (recursion)", "  d"]
    wide = graph.flow_lines([("a", f"n{i:03}") for i in range(90)], "a")
    assert len(wide) == 61 and wide[-1].endswith("... (more)")
    e = spark.createDataFrame([(1, "a.py::f", "g"), (1, "a.py::f", "h"), (1, "a.py::f", "z")], "p int, caller string, callee string")
    f = spark.createDataFrame([(1, "b.py", "g"), (1, "c.py", "g"), (1, "a.py", "h"), (1, "d.py", "z"), (1, "e.py", "z")], "p int, file string, name string")
    imported = spark.createDataFrame([(1, "a.py", "g", "c.py")], "p int, file string, name string, source string")
    assert {r.callee_id for r in graph.resolve_calls(e, f, "p", imported).collect()} == {"c.py::g", "a.py::h"}
    assert {r.callee_id for r in graph.resolve_calls(e, f, "p").collect()} == {"a.py::h"}


def test_records_that_may_not_be_released(spark):
    import json

    def problem(**record):
        return spark.createDataFrame([(json.dumps(record),)], "j string").select(privacy.record_problem(F.col("j")).alias("p")).first().p

    assert problem(semester="S1", correct=True) is None
    assert problem(semester="S1", Repo_Id="x") == "forbidden_key" and problem(semester="S1", extra=1) == "unknown_key"
    assert problem(structure_counts={"deep": ["mail me at a@b.example"]}) == "gives_away" and problem(structure_counts={"a@b.example": 1}) == "gives_away"
    assert problem(study_record_id="sr_0123456789abcdef0123456789abcdef") is None
    df = spark.createDataFrame([("plain", 1), ("mail a@b.example", 2)], "t string, n int")
    assert privacy.assert_clean(spark.createDataFrame([("plain", 1), (None, 2)], "t string, n int"), ["t", "n"]).count() == 2
    with pytest.raises(Exception) as e:
        privacy.assert_clean(df, ["t"]).collect()
    assert "sensitive: email" in str(e.value) and "a@b.example" not in str(e.value).split("sensitive")[1][:40]


def test_rubrics_and_blocks():
    text = "Intro\nCriteria Ratings Points\nDesign of tests\n4/5 pts\nReport\n10/20 pts\nExcellent\nAll cases.\nTwo lines.\n5 pts\nGood\nSome.\n3 pts\nExcellent\nClear.\n20 pts\nCriteria Ratings Points\nNothing here"
    assert rubric_rows(text) == [("Design of tests", 5.0, "All cases. Two lines."), ("Report", 20.0, "Clear.")]
    long = " ".join(f"Sentence {i} is here." for i in range(80))
    parts = split_blocks(long)
    assert " ".join(parts) == long and all(len(p) <= 900 for p in parts) and len(parts) == -(-len(long) // 900)
    assert split_blocks("- one two three four\nmore of it\nLead in here:\nand what follows\n\nshort") == ["one two three four more of it", "Lead in here: and what follows"]


def test_alignment_prefers_scope_and_evidence(spark):
    q = spark.createDataFrame([(1, 7, "load the table", ["5"], 3), (1, 8, "nothing shared", [], 4), (2, 9, "alone", [], 0)], "group int, question_id bigint, text string, evidence array<string>, place bigint")
    t = spark.createDataFrame([(1, 1, "load the table", [], 9.0, False), (1, 2, "table", [], 1.0, True), (1, 3, "row", ["5"], 1.0, True)], "group int, target_id bigint, text string, evidence array<string>, weight double, scope boolean")
    assert sorted(map(tuple, align_to_targets(q, t).collect())) == [(7, 3, 4), (8, 2, 0)]


def test_steps_tell_how_far_they_are():
    seen = []

    def listen(*x):
        seen.append(x)
        raise RuntimeError

    assert run_steps([("a", lambda r: 1), ("b", lambda r: r["a"] + 1)], listen) == {"a": 1, "b": 2}
    assert seen == [("a", 1, 2, "started"), ("a", 1, 2, "done"), ("b", 2, 2, "started"), ("b", 2, 2, "done")]
