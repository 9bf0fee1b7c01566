import os
import random

import pytest

from gaugeworks.llm import mixing as M

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def best(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_fit_is_optimal_for_small_budgets():
    rnd = random.Random(2)
    for _ in range(150):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randrange(1, 7)))
        counts = [rnd.randrange(1, 5) for _ in lengths]
        budget = rnd.randrange(0, 200)
        take = M.fit(lengths, counts, budget, 1)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(n * t for n, t in zip(lengths, take)) == best(lengths, counts, budget)


def test_fit_of_large_budgets_is_near():
    rnd = random.Random(3)
    lengths = sorted(rnd.sample(range(5, 5000), 800))
    counts = [rnd.randrange(1, 4000) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts))
    for part in (0.03, 0.5, 0.97):
        budget = int(total * part)
        take = M.fit(lengths, counts, budget, 9)
        got = sum(n * t for n, t in zip(lengths, take))
        assert budget - 5 <= got <= budget and all(0 <= t <= c for t, c in zip(take, counts))
    few = [rnd.randrange(1, 4) for _ in lengths]
    for budget in (500, 3_000, 20_000, 200_000, 500_000, 1_500_000):
        got = sum(n * t for n, t in zip(lengths, M.fit(lengths, few, budget, 9)))
        assert budget - 5 <= got <= budget, (budget, got)
    assert M.fit(lengths, counts, total + 1, 1) == counts and M.fit([], [], 5, 1) == []


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
class TestMix:
    def tables(self, spark):
        rnd = random.Random(4)
        rows = [(i, " ".join(rnd.choice(["load", "queue", "the", "fröhlich", "数据"]) for _ in range(rnd.randrange(1, 60))), rnd.choice(["A", " a ", "b_c", "B C"])) for i in range(600)]
        rows += [(1000, "same text again", "hot")] * 3 + [(1001 + i, "same text again", "hot") for i in range(300)]
        rows += [(5000, None, "A"), (5001, "", "A"), (5002, "x", None), (5003, "x", " "), (5004, "x", "other"), (None, "x", "A")]
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, n_tokens int, repeats int")
        targets = spark.createDataFrame([("a", 0.5, 1), ("b_c", 0.3, 2), ("Hot", 0.1, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
        return docs, targets

    def test_shares(self, spark):
        docs, targets = self.tables(spark)
        mixed = M.mix(docs, targets, TOKENIZER)
        rows = mixed.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats >= 1 for r in rows)
        assert {r.source for r in rows} == {"a", "b_c", "hot"}
        report = {r.source: r for r in M.shares(mixed, targets).collect()}
        for s, share in (("a", 0.5 / 0.9), ("b_c", 0.3 / 0.9), ("hot", 0.1 / 0.9)):
            assert abs(report[s].share - share) < 0.01, report[s]
        assert report["none"].tokens == 0 and report["none"].shortfall == 0.1
        assert report["a"].most_repeats == 1 and report["b_c"].most_repeats <= 2 and report["hot"].most_repeats <= 3
        again = M.mix(docs.repartition(7), targets, TOKENIZER).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
        other = M.mix(docs, targets, TOKENIZER, seed=5).collect()
        assert {r.doc_id for r in other} != {r.doc_id for r in rows}

    def test_repeats_are_capped(self, spark):
        docs, targets = self.tables(spark)
        rows = M.mix(docs, targets, TOKENIZER, total_tokens=10_000_000).collect()
        most = {s: max(r.repeats for r in rows if r.source == s) for s in ("a", "b_c", "hot")}
        assert most == {"a": 1, "b_c": 2, "hot": 3}
        assert min(r.repeats for r in rows if r.source == "hot") == 3

    def test_empty(self, spark):
        docs, targets = self.tables(spark)
        assert M.mix(docs.limit(0), targets, TOKENIZER).count() == 0 and M.mix(docs, targets.limit(0), TOKENIZER).count() == 0
        assert M.shares(M.mix(docs.limit(0), targets, TOKENIZER), targets).count() == 4

    def test_pieces_have_the_tokens_of_the_whole(self, monkeypatch):
        rnd = random.Random(6)
        text = "".join(rnd.choice(["word ", "\n", "\n\n", " 12", "é", "数据", "  ", "x\nY", "'s "]) for _ in range(4000))
        e = M.encoding(TOKENIZER)
        whole = e.encode_ordinary(text)
        monkeypatch.setattr(M, "PIECE", 300)
        parts = list(M._pieces(text))
        assert len(parts) > 5 and "".join(parts) == text
        assert [t for p in parts for t in e.encode_ordinary(p)] == whole
