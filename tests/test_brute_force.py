"""Children and orphan references of the driver's tables against plain loops over their rows."""

import json
import re

import pandas as pd
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def decoded(v):
    for _ in range(5):
        if not isinstance(v, str):
            return v
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return None


def number(v):
    m = re.search(r"(\d+)(?:\.0)?\s*$", str(v)) if v is not None else None
    return int(m.group(1)) if m else None


@pytest.fixture(scope="module")
def tables(data):
    read = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pandas().drop_duplicates()
    return {t: read(t) for t in ("questions", "attempts", "assessments", "projects", "tombstones")}


def test_children(spark, data, tables):
    want = set()
    q, a = tables["questions"], tables["attempts"]
    for i, j in zip(q.id, q.options_json):
        v = decoded(j)
        v = v["options"] if isinstance(v, dict) and "options" in v else v
        v = [{"key": k} for k in v] if isinstance(v, dict) else v
        for n, x in enumerate(v or []):
            key = x.get("key") if isinstance(x, dict) else None
            want.add(("questions", i, "option", key.strip().upper() if key else "ABCDEFGH"[n]))
    for i, j in zip(q.id, q.justifications_json):
        v = decoded(j)
        v = {x["key"]: x.get("why") for x in v} if isinstance(v, list) else v
        for k, x in (v or {}).items():
            x = x.get("text") if isinstance(x, dict) else x
            if x and x.strip():
                want.add(("questions", i, "justification", k.strip().upper()))
    for i, j in zip(q.id, q.evidence_json):
        v = decoded(j)
        for n, x in enumerate([v] if isinstance(v, (dict, str)) else v or []):
            if x is not None:
                want.add(("questions", i, "evidence", str(n)))
    for i, j in zip(a.id, a.score_json):
        v = decoded(j)
        if v is None:
            continue
        v = v.get("result", v)
        per = v.get("per_question") or []
        for k, x in per.items() if isinstance(per, dict) else [(x["question_id"], x) for x in per]:
            want.add(("attempts", i, "per_question", str(k)))
            s = x.get("selected") or []
            want |= {("attempts", i, "selected", f"{k}/{c.strip().upper()}") for c in (s.split(",") if isinstance(s, str) else s)}
        f = v.get("per_focus") or {}
        want |= {("attempts", i, "per_focus", k) for k in (f if isinstance(f, dict) else [x["area"] for x in f])}
    got = [tuple(r) for r in entry.queries()["p3_found"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_orphans(spark, data, tables):
    q, p, t = tables["questions"], tables["projects"], tables["tombstones"]
    since = {n: d.groupby("id").created_at.min().to_dict() for n, d in (("q", q), ("p", p))}
    chunks = {i: {c["id"] for c in json.loads(j)} for i, j in zip(p.id, p.chunks_json)}
    gone = {n: set(t[t.record_table == n].record_id) for n in ("questions", "projects")}
    want = set()

    def question(table, i, at, n):
        if n is not None and n not in since["q"]:
            want.add((table, i, str(n), "deleted" if n in gone["questions"] else "missing"))
        elif n is not None and since["q"][n] > at:
            want.add((table, i, str(n), "late"))

    for i, j, at in zip(*(tables["assessments"][c] for c in ("id", "question_ids_json", "created_at"))):
        for x in decoded(j) or []:
            question("assessments", i, at, number(x))
    for i, j, at in zip(*(tables["attempts"][c] for c in ("id", "responses_json", "submitted_at"))):
        v = decoded(j)
        for x in v if isinstance(v, dict) else [e["question_id"] for e in v or []]:
            question("attempts", i, at, number(x))
    for i, j, at, pid in zip(q.id, q.evidence_json, q.created_at, q.project_id):
        v = decoded(j)
        for x in [v] if isinstance(v, (dict, str)) else v or []:
            n = number(x["chunk_id"] if isinstance(x, dict) else x) if x is not None else None
            if n is None:
                continue
            if pid not in since["p"]:
                want.add(("questions", i, f"c{n}", "deleted" if pid in gone["projects"] else "missing"))
            elif f"c{n}" not in chunks[pid]:
                want.add(("questions", i, f"c{n}", "missing"))
            elif since["p"][pid] > at:
                want.add(("questions", i, f"c{n}", "late"))
    got = [tuple(r) for r in entry.queries()["p4_found"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_months_add_up(spark, data):
    months = entry.queries()["p4_by_month"](spark, data).toPandas()
    assert isinstance(months, pd.DataFrame) and months.n_refs.sum() == entry.queries()["p4_found"](spark, data).count()
