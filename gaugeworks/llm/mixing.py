"""Mixing sources to target weights.

Documents are counted by exact token length. Of each source, whole passes over its documents are taken first; for the
rest of its budget a number of documents of each length is chosen (in proportion, then one by one, and the last part by
a bounded-knapsack table over the lengths that are left), and as many documents of that length are drawn by a seeded
hash. Only counts by length are gathered, never documents.

Defined results: a source is its name in lower case without outer blanks, with blanks as underscores; null or blank
names belong to none; sources without a target take no part; targets without documents get no tokens and their share
goes to the others in proportion; documents without tokens are left out; documents with the same doc_id are one; of
targets that are given twice the shares add up and the smaller number of repeats holds.
"""

import base64
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.spread import spread

# Fixed value: the split pattern that the byte-level vocabularies were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 20240901
#: Tokens of a budget that are left to the knapsack table at most.
TABLE_TOKENS = 1 << 19
#: The last part of a budget in times of the longest document.
FINISH_LENGTHS = 16
#: Parts that the documents of one source and length are split into by hash, so that no part is ordered as a whole.
BUCKETS = 4096

_encodings: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a vocabulary file, loaded once a process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("gaugeworks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def source_key(name):
    """The column of source names in the form in which they are compared."""
    key = F.regexp_replace(F.regexp_replace(F.lower(name.cast("string")), r"^[\s_]+|[\s_]+$", ""), r"[\s_]+", "_")
    return F.when(key != "", key)


#: Characters that the tokenizer is given at once.
PIECE = 200_000


def _pieces(text: str):
    """A long text in parts that have the same tokens as the whole: cut after a single line end before a letter or digit."""
    a = 0
    while len(text) - a > PIECE:
        b = a + PIECE
        while b < len(text) and not (text[b - 1] == "\n" and text[b].isalnum() and not text[b - 2].isspace()):
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


def count_tokens(documents: DataFrame, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have a source, whole texts under the given tokenizer."""

    def run(batches):
        e = encoding(tokenizer, pattern)
        for batch in batches:
            n = [sum(len(e.encode_ordinary(p)) for p in _pieces(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    df = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    return spread(df.where("doc_id is not null and source is not null and text is not null")).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def targets(mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per source."""
    return (
        mix_targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .where("source is not null").groupBy("source")
        .agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )


def fit(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take so that their tokens come as near to the budget as they can from below."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not lengths:
        return [0] * len(lengths)
    rng = random.Random(seed)
    # in proportion, leaving a part of the budget to finish with
    finish = min(budget, TABLE_TOKENS // 2, FINISH_LENGTHS * max(lengths))
    part = (budget - finish) / total
    take = [min(c, math.floor(c * part)) for c in counts]
    left = budget - sum(n * x for n, x in zip(lengths, take))
    # one by one in a seeded order, until the table can hold what is left
    order = [i for i in range(len(lengths)) if counts[i] > take[i]]
    rng.shuffle(order)
    for i in order:
        if left <= finish:
            break
        if take[i] < counts[i] and 0 < lengths[i] <= left:
            take[i] += 1
            left -= lengths[i]
    for i, x in _knapsack(lengths, [c - x for c, x in zip(counts, take)], left, rng).items():
        take[i] += x
    return take


def _knapsack(lengths: list[int], spare: list[int], budget: int, rng: random.Random) -> dict[int, int]:
    """Bounded subset sum: the fullest choice of spare documents within the budget, from a table of reachable sums.

    All lengths take part, drawn in a seeded order, until the budget itself can be reached; if it never can, the table
    knows the best sum below it.
    """
    usable = [i for i in range(len(lengths)) if spare[i] > 0 and 0 < lengths[i] <= budget]
    if not usable or budget <= 0:
        return {}
    rng.shuffle(usable)
    rest = sum(lengths[i] * spare[i] for i in usable)
    if rest <= budget:
        return {i: spare[i] for i in usable}
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i in usable:
        left, size = min(spare[i], budget // lengths[i]), 1
        while left > 0:
            k = min(size, left)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & mask
            left -= k
            size *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            out[i] = out.get(i, 0) + k
            at -= k * lengths[i]
    return out


def _budgets(totals: pd.DataFrame, total_tokens: int | None) -> pd.DataFrame:
    """The budget of each source; ``totals`` has one row per target."""
    t = totals.copy()
    has = (t.tokens > 0) & (t.target_share > 0) & (t.max_repeats > 0)
    share = t.target_share.where(has, 0.0)
    share = share / share.sum() if share.sum() else share
    most = t.tokens * t.max_repeats
    if total_tokens is None:
        # the largest mix in which no source has to be repeated beyond its cap
        total_tokens = int(math.floor(min((m / s for m, s in zip(most[has], share[has])), default=0)))
    t["budget"] = [int(min(round(s * total_tokens), m)) for s, m in zip(share, most)]
    t["passes"] = [int(b // n) if n else 0 for b, n in zip(t.budget, t.tokens)]
    t["rest"] = [int(b - p * n) for b, p, n in zip(t.budget, t.passes, t.tokens)]
    return t


def mix(documents: DataFrame, mix_targets: DataFrame, tokenizer: str, total_tokens: int | None = None, seed: int = SEED, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents of the mix; ``repeats`` times each of them is used.

    ``tokenizer``: the vocabulary file, readable for every executor. ``total_tokens``: size of the mix; by default the largest at which every target with documents can be met.
    """
    wanted = targets(mix_targets)
    # as many rows as there are targets: a table that people write
    names = F.broadcast(wanted.where("max_repeats > 0 and target_share > 0").select("source"))
    docs = documents.select("doc_id", "source", "text").join(names.withColumnRenamed("source", "_key"), source_key(F.col("source")) == F.col("_key"), "left_semi")
    counted = materialise(count_tokens(docs, tokenizer, pattern).where("n_tokens > 0"))
    unique = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.source", "x.n_tokens")
    by_length = unique.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    by_length = materialise(by_length)
    totals = wanted.join(by_length.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens")), "source", "left").na.fill({"tokens": 0})
    budgets = _budgets(totals.orderBy("source").toPandas(), total_tokens)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(r.source, r.passes, r.rest) for r in budgets.itertuples() if r.budget > 0] or [("", 0, 0)], "source string, passes bigint, rest bigint"
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        source = pdf.source.iloc[0]
        take = fit(pdf.n_tokens.tolist(), pdf.n.tolist(), int(pdf.rest.iloc[0]), seed ^ sum(source.encode()))
        return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "passes": pdf.passes, "take": np.array(take, np.int64)})

    chosen = by_length.join(F.broadcast(plan), "source").groupBy("source").applyInPandas(choose, "source string, n_tokens bigint, passes bigint, take bigint")
    chosen = chosen.where("passes > 0 or take > 0")
    drawn = unique.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("b", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int"))
    # per length the parts below the limit are taken whole; only the part with the limit in it is put in order
    part = Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    parts = drawn.groupBy("source", "n_tokens", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(part), F.lit(0)))
    limits = parts.join(chosen, ["source", "n_tokens"]).select("source", "n_tokens", "b", "passes", (F.col("take") - F.col("before")).alias("room"), "n")
    marked = drawn.join(limits, ["source", "n_tokens", "b"])
    whole = marked.where("room <= 0 or room >= n").select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("room") > 0).cast("int")).alias("repeats"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "b").orderBy("h", "doc_id"))
    edge = marked.where("room > 0 and room < n").withColumn("r", rank).select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("r") <= F.col("room")).cast("int")).alias("repeats"))
    return whole.unionByName(edge).where("repeats > 0").select("doc_id", "source", "n_tokens", F.col("repeats").cast("int").alias("repeats"))


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """The report of a mix: (source, target_share, max_repeats, n_docs, n_uses, most_repeats, tokens, share, shortfall)."""
    got = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("repeats").cast("bigint").alias("n_uses"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).cast("bigint").alias("tokens")
    )
    zero = {"n_docs": 0, "n_uses": 0, "most_repeats": 0, "tokens": 0}
    # one row per target: small enough for one task
    everything = Window.partitionBy()
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(everything).cast("double"))
    return (
        targets(mix_targets).join(got, "source", "left").na.fill(zero)
        .withColumn("share", F.coalesce(F.round(share, 6), F.lit(0.0)))
        .withColumn("shortfall", F.round(F.greatest(F.col("target_share") - F.col("share"), F.lit(0.0)), 6))
    )
