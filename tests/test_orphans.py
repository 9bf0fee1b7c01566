import datetime as dt
import json
import random

from gaugeworks.functions import bloom
from gaugeworks.functions.bloom import bloom_filter
from gaugeworks.functions.skew import hot_keys, salted_join
from gaugeworks.operators import orphans

from pyspark.sql import functions as F


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def tables(spark, assessments, attempts, questions, projects, tombstones):
    make = spark.createDataFrame
    return (
        make(assessments, "id bigint, question_ids_json string, created_at timestamp, note string"),
        make(attempts, "id bigint, responses_json string, submitted_at timestamp"),
        make(questions, "id bigint, project_id bigint, evidence_json string, created_at timestamp"),
        make(projects, "id bigint, chunks_json string, created_at timestamp"),
        make(tombstones, "record_table string, record_id bigint, deleted_at timestamp"),
    )


def test_reasons(spark):
    chunks = json.dumps([{"id": "c0", "text": "x"}, {"id": "c1"}])
    t = tables(
        spark,
        [(1, '[1, "2", 9.0, null, "q8"]', day(5), ""), (2, '"[1]"', day(0), ""), (3, None, day(1), ""), (4, "[1, ", day(1), "")],
        [(1, '{"1": ["A"], "q7": [], " 9": []}', day(9)), (1, '{"1": ["A"], "q7": [], " 9": []}', day(9)), (2, '[{"question_id": 1}]', None), (None, '{"77": []}', day(1))],
        [(1, 10, '[{"chunk_id": "C1"}, "c5", 0, null]', day(3)), (2, 11, '{"chunk_id": "c0"}', day(3)), (5, 12, '["c0"]', day(3)), (6, None, '["c0"]', day(3)), (7, 13, '["c0"]', day(1))],
        [(10, chunks, day(1)), (13, chunks, day(2)), (14, None, day(2))],
        [("questions", 8, day(9)), ("questions", 1, day(9)), ("projects", 11, day(9)), ("questions", 11, day(9))],
    )
    got = {tuple(r) for r in orphans.orphan_references(*t).select("ref_table", "ref_id", "target_key", "reason").collect()}
    assert got == {
        ("assessments", 1, "9", "missing"), ("assessments", 1, "8", "deleted"), ("assessments", 2, "1", "late"),
        ("attempts", 1, "9", "missing"),
        ("questions", 1, "c5", "missing"), ("questions", 2, "c0", "deleted"), ("questions", 5, "c0", "missing"), ("questions", 6, "c0", "missing"), ("questions", 7, "c0", "late"),
    }
    months = orphans.by_month(orphans.orphan_references(*t)).collect()
    assert sum(r.n_refs for r in months) == len(got)
    empty = [x.limit(0) for x in t]
    assert orphans.orphan_references(*empty).count() == 0


def test_bloom_is_sized_by_its_keys():
    assert [bloom.log2_bits(n) for n in (0, 1, 6_553, 6_554, 30_000_000, 53_000_000, 54_000_000)] == [16, 16, 16, 17, 29, 29, None]
    # share of other keys that pass, of full filters
    assert all((1 - 2.718281828 ** (-bloom.HASHES * n / 2 ** bloom.log2_bits(n))) ** bloom.HASHES < 0.02 for n in (6_000, 30_000_000, 53_000_000))


def test_no_filter_beyond_the_largest(spark, monkeypatch):
    rows = ([(1, "[1, 2]", day(2), "n")], [(5, '{"1": "A", "3": "B"}', day(2))], [(1, 9, '[{"chunk_id": "c0"}, "c4"]', day(1))], [(9, json.dumps([{"id": "c0"}]), day(0))], [("questions", 2, day(1))])
    want = sorted(map(tuple, orphans.orphan_references(*tables(spark, *rows)).drop("ref_time").collect()))
    assert want == [("assessments", 1, "2", "deleted"), ("attempts", 5, "3", "missing"), ("questions", 1, "c4", "missing")]
    monkeypatch.setattr(bloom, "MOST_LOG2", 1)
    assert sorted(map(tuple, orphans.orphan_references(*tables(spark, *rows)).drop("ref_time").collect())) == want


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5_000).select((F.col("id") * 3).alias("k"))
    might = bloom_filter(keys, F.xxhash64("k"))
    assert keys.where(~might(F.xxhash64("k"))).count() == 0
    others = spark.range(5_000).select((F.col("id") * 3 + 1).alias("k"))
    assert others.where(might(F.xxhash64("k"))).count() < 50


def test_salted_join_is_a_join(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k bigint, v bigint")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k bigint, name string")
    hot = hot_keys(left, ["k"], least=500)
    assert [r.k for r in hot.where("k is not null").collect()] == [1]
    got = sorted((r.v, r.name or "") for r in salted_join(left, right, ["k"], F.xxhash64("v"), "left", hot).collect())
    names = {1: "a", 3: "c"}
    assert got == sorted((v, names.get(k, "")) for k, v in rows)
