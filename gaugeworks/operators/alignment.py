"""Targets from text, and how well evidence covers them.

Defined results: blocks that say nothing assessable are dropped; of equal targets the first is kept; a target whose
words no document has is 'unmatched'.
"""

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import assessable, casefold, label, mark_weight, tokens

MAX_TARGETS = 48
STRONG_SCORE, STRONG_OVERLAP = 2.0, 3
FLUSH_CHARS, SPLIT_CHARS, LEAST_CHARS = 700, 900, 12
# What begins an item of a list, and where a sentence ends.
_BULLET = re.compile(r"[ \t]*(?:[-*•▪◦]|[0-9]+[.)]|[A-Za-z][.)])[ \t\f\v]+")
_SENTENCES = re.compile(r"(?<=[.!?])[ \t\f\v]+(?=[A-Z0-9])")
_EDGE = " \t\r\f\v"


def _packed(sentences: list[str], most: int):
    """Sentences joined as far as they fit into ``most`` characters."""
    part, size = [], 0
    for x in sentences:
        # what was joined so far, and the blank before the next one
        if part and size + len(x) > most:
            yield " ".join(part)
            part, size = [], 0
        part.append(x)
        size += len(x) + 1
    if part:
        yield " ".join(part)


def split_blocks(text: str) -> list[str]:
    """Paragraphs and bullets of a text; long ones are divided at sentences. Lines end at line feeds."""
    groups: list[list[str]] = [[]]
    full = False
    for line in (x.strip(_EDGE) for x in (text or "").split("\n")):
        bullet = _BULLET.match(line)
        lead_in = line.endswith(":") and len(line) < 100
        if not line or bullet or lead_in or full:
            groups.append([])
        if line:
            groups[-1].append(line[bullet.end() :] if bullet else line)
        # a list item or a lead-in is never too long to go on
        full = bool(line) and not bullet and not lead_in and sum(len(x) + 1 for x in groups[-1]) > FLUSH_CHARS
    whole = [" ".join(g).strip(_EDGE) for g in groups]
    return [part for b in whole if len(b) >= LEAST_CHARS for part in (_packed(_SENTENCES.split(b), SPLIT_CHARS) if len(b) > SPLIT_CHARS else [b])]


_RATING = re.compile(r"excellent|good|satisfactory|fail|not solved")


def rubric_rows(text: str) -> list[tuple[str, float, str]]:
    """(criterion, most points, what earns them all) of the tables in a text that begin 'Criteria Ratings Points'.

    A table first names its criteria, each up to a line that ends in its points ('4/5 pts', or the possible ones alone), and then
    gives their ratings in the same order; names and the descriptions below 'Excellent' are put together by their places.
    """
    lines = [x.strip() for x in (text or "").splitlines()]
    out = []
    heads = [i for i, x in enumerate(lines) if x.lower() == "criteria ratings points"]
    for start, end in zip(heads, [*heads[1:], len(lines)]):
        section = lines[start + 1 : end]
        ratings = next((i for i, x in enumerate(section) if _RATING.fullmatch(x.lower())), None)
        if ratings is None:
            continue
        names: list[tuple[str, float]] = []
        words: list[str] = []
        for x in section[:ratings]:
            m = re.fullmatch(r"(?i)(.*?)(?:[0-9]+(?:\.[0-9]+)?/)?([0-9]+(?:\.[0-9]+)?)\s*(?:pts?|points?|marks?)", x)
            words += [y for y in [m.group(1).strip() if m else x] if y]
            if m:
                if words:
                    names.append((" ".join(words), float(m.group(2))))
                words = []
        earned: list[str] = []
        inside: list[str] | None = None
        for x in [*section[ratings:], "0 pts"]:
            if inside is None:
                inside = [] if x.lower() == "excellent" else None
            elif re.fullmatch(r"(?i)[0-9]+(?:\.[0-9]+)?\s*pts?", x):
                earned += [" ".join(inside)] if inside else []
                inside = None
            elif x and not _RATING.fullmatch(x.lower()):
                inside.append(x)
        out += [(n, most, what) for (n, most), what in zip(names, earned)]
    return out


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, block)"""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_blocks)

    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(split(F.col(text))).alias("position", "block"))


def build_targets(rows: DataFrame, key: str, explicit: str, most: int = MAX_TARGETS) -> DataFrame:
    """(key, target_id, label, description, weight): at most ``most`` targets a key, inputs of the instructor first.

    ``rows``: key, position, block, base (weight), and the boolean column ``explicit``.
    """
    norm = F.regexp_replace(F.trim(casefold(F.col("block"))), r"\s+", " ")
    kept = rows.where(assessable(F.col("block"))).withColumn("_n", norm)
    first = kept.withColumn("_d", F.row_number().over(Window.partitionBy(key, "_n").orderBy("position"))).where("_d = 1")
    scored = first.withColumn("weight", mark_weight(F.col("block"), F.col("base")))
    order = Window.partitionBy(key).orderBy(F.desc(explicit), F.when(F.col(explicit), F.lit(0.0)).otherwise(-F.col("weight")), "position")
    ranked = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return ranked.select(key, F.concat(F.lit("t"), (F.col("_r") - 1).cast("string")).alias("target_id"), label(F.col("block")).alias("label"), F.col("block").alias("description"), "weight")


def topic_matches(targets: DataFrame, topics: DataFrame, key: str, text: str) -> DataFrame:
    """(key, topic_id, score): up to three topics with the most shared words, none far below the best.

    ``topics``: topic_id, words (text), weight; a table that people write, so it is broadcast.
    """
    t = targets.select(key, F.explode(F.array_distinct(F.filter(tokens(F.col(text)), lambda x: F.length(x) > 2))).alias("w"))
    words = topics.select("topic_id", F.explode(F.array_distinct(F.filter(tokens(F.col("words")), lambda x: F.length(x) > 2))).alias("w"))
    overlap = t.join(F.broadcast(words), "w").groupBy(key, "topic_id").agg(F.count(F.lit(1)).alias("overlap"))
    grid = targets.select(key).distinct().crossJoin(F.broadcast(topics.select("topic_id", "weight")))
    scored = grid.join(overlap, [key, "topic_id"], "left").withColumn("score", F.round(F.coalesce("overlap", F.lit(0)) + 0.15 * F.col("weight"), 3))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "topic_id")
    ranked = scored.withColumn("_r", F.row_number().over(w)).withColumn("_top", F.first("score").over(w))
    return ranked.where((F.col("_r") <= 3) & (F.col("score") >= F.greatest(F.lit(0.15), F.round(0.55 * F.col("_top"), 6)))).select(key, "topic_id", "score")


def coverage(best: DataFrame, key: str) -> DataFrame:
    """(key, coverage, best_score, best_overlap) of ranked evidence with its score and overlap of words."""
    g = best.groupBy(key).agg(F.max("score").alias("best_score"), F.max("overlap").alias("best_overlap"))
    strong = (F.col("best_score") >= STRONG_SCORE) | (F.col("best_overlap") >= STRONG_OVERLAP)
    some = (F.col("best_score") > 0) | (F.col("best_overlap") > 0)
    return g.select(key, F.when(strong, "strong").when(some, "partial").otherwise("unmatched").alias("coverage"), "best_score", "best_overlap")


#: What a piece of shared evidence counts for beside a shared word.
SHARED_EVIDENCE = 4


def align_to_targets(questions: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_id, target_id, overlap): of each question the target with the most shared words and evidence.

    ``questions``: question_id, group, text, evidence (array of text), place (a number); ``targets``: group, target_id,
    text, evidence, weight, scope. Targets of the project's own scope are taken before all others of their group; heavier
    ones win on ties. A question that shares nothing gets the target of its group at its place, counted round. Words and
    evidence meet as equal keys within a group, so only pairs with something in common arise.
    """
    first = targets.groupBy("group").agg(F.bool_or("scope").alias("_has"))
    kept = targets.join(first, "group").where(F.col("scope") | ~F.col("_has"))
    keys = lambda text, evidence: F.explode(
        F.concat(
            F.transform(F.array_distinct(tokens(F.coalesce(text, F.lit("")))), lambda w: F.struct(F.concat(F.lit("w:"), w).alias("k"), F.lit(1).alias("n"))),
            F.transform(F.array_distinct(F.coalesce(evidence, F.array().cast("array<string>"))), lambda e: F.struct(F.concat(F.lit("e:"), e).alias("k"), F.lit(SHARED_EVIDENCE).alias("n"))),
        )
    ).alias("x")
    q = questions.select("group", "question_id", keys(F.col("text"), F.col("evidence"))).select("group", "question_id", "x.k", "x.n")
    t = kept.select("group", "target_id", "weight", keys(F.col("text"), F.col("evidence"))).select("group", "target_id", "weight", F.col("x.k").alias("k"))
    hits = q.join(t, ["group", "k"]).groupBy("question_id", "target_id", "weight").agg(F.sum("n").alias("overlap"))
    best = hits.groupBy("question_id").agg(F.min_by(F.struct("target_id", "overlap"), F.struct((-F.col("overlap")).alias("o"), (-F.col("weight")).alias("w"), "target_id")).alias("b"))
    found = best.select("question_id", "b.target_id", F.col("b.overlap").cast("int").alias("overlap"))
    # a group's targets are a list that people write
    listed = kept.groupBy("group").agg(F.array_sort(F.collect_set("target_id")).alias("ids"))
    open_ = questions.select("group", "question_id", "place").join(found.select("question_id"), "question_id", "left_anti").join(listed, "group")
    rest = open_.select("question_id", F.get("ids", F.pmod(F.col("place"), F.size("ids")).cast("int")).alias("target_id"), F.lit(0).alias("overlap"))
    return found.unionByName(rest)
