"""Questions and answers: normal forms, exact-match scoring, rule flags, similarity.

Defined results: null answers and selections are empty sets; a question without focus areas counts as 'General'; percent
is 0 without questions.
"""

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.skew import SALTS, hot_keys, salted_join
from gaugeworks.functions.text import casefold, jaccard, strip, tokens

#: Similarity from which two questions count as near-duplicates.
NEAR = 0.76
#: Similarity from which the token sets of two stems are listed as alike.
ALIKE = 0.8


def normal_letters(letters: Column) -> Column:
    """Trimmed, upper-case, distinct, sorted, without blanks."""
    cleaned = F.transform(F.coalesce(letters, F.array().cast("array<string>")), lambda x: F.upper(strip(x)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull() & (x != ""))))


def confidence(c: Column) -> Column:
    """A whole number from 1 to 10, else null."""
    n = F.when(c.cast("string").rlike(r"^\s*[0-9]{1,2}\s*$"), F.trim(c.cast("string")).try_cast("int"))
    return F.when((n >= 1) & (n <= 10), n)


def band_midpoint(low: Column, high: Column) -> Column:
    return F.coalesce(F.least(F.greatest(F.floor((low + high) / 2).cast("int"), F.lit(1)), F.lit(5)), F.lit(3))


def score_answers(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """(attempt_id, n_correct, n_total, percent) of exact matches.

    ``answers``: attempt_id, question_id, selected; ``keys``: question_id, answer (one row a question). Answers to
    questions without a key don't count.
    """
    right = keys.select("question_id", normal_letters(F.col("answer")).alias("_key"))
    joined = salted_join(answers, right, ["question_id"], F.xxhash64("attempt_id"), "inner")
    hit = (normal_letters(F.col("selected")) == F.col("_key")).cast("int")
    g = joined.groupBy("attempt_id").agg(F.sum(hit).cast("bigint").alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("n_correct") * 100.0, F.col("n_total").cast("double")), 1), F.lit(0.0)))


def focus_breakdown(results: DataFrame, focus: str = "focus_areas", correct: str = "correct") -> DataFrame:
    """(focus, n_correct, n_total); a question counts in each of its areas."""
    areas = F.when(F.size(focus) > 0, F.col(focus)).otherwise(F.array(F.lit("General")))
    e = results.select(F.explode(areas).alias("focus"), F.col(correct).cast("int").alias("c"))
    return e.groupBy("focus").agg(F.sum("c").cast("bigint").alias("n_correct"), F.count(F.lit(1)).alias("n_total"))


def token_sets(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): the distinct token sets with a representative key each, and which key is in which class."""
    t = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("tokens")).distinct()
    classes = t.groupBy("tokens").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    digest = lambda c: F.sha2(F.array_join(c, " "), 256)
    members = t.withColumn("h", digest("tokens")).join(classes.select(digest("tokens").alias("h"), "class_id"), "h").select("key", "class_id")
    return classes.where(F.size("tokens") > 0), members


def alike(classes: DataFrame, least: float = ALIKE) -> DataFrame:
    """(a, b, similarity) of the classes whose token sets have a Jaccard similarity of ``least`` or more; a < b.

    Prefix filter: with tokens in order of rareness, two sets that are alike share one of the first
    n - ceil(least * n) + 1 of each, at places that leave enough tokens behind. The classes of a frequent token meet in
    parts, so it fits no single task; pairs are verified on the sets. No pair is lost, and equal sets are one class before.
    """
    df = classes.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = classes.select("class_id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(df, "t")
    order = F.array_sort(F.collect_list(F.struct("df", "t")))
    sets = ranked.groupBy("class_id", "n").agg(order.alias("o"))
    length = (F.col("n") - F.ceil(F.round(F.col("n") * least, 9)) + 1).cast("int")
    prefix = materialise(sets.select("class_id", "n", F.posexplode(F.slice("o", 1, length)).alias("i", "x")).select("class_id", "n", "i", F.col("x.t").alias("t")))
    # one side of a hot token is dealt out, the other repeated for every part
    hot = F.broadcast(materialise(hot_keys(prefix, ["t"])).withColumn("_hot", F.lit(True)))
    marked = prefix.join(hot, "t", "left")
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64("class_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    a = marked.withColumn("part", part).alias("a")
    b = marked.withColumn("part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("b")
    # lengths that can't be alike never meet, nor do places behind which too few tokens are left
    needed = F.ceil(F.round((F.col("a.n") + F.col("b.n")) * (least / (1 + least)), 9))
    meet = (
        (F.col("a.t") == F.col("b.t")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.class_id") < F.col("b.class_id")) & (F.col("b.n") >= F.col("a.n") * least)
        & (F.col("a.n") >= F.col("b.n") * least) & (F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= needed)
    )
    pairs = a.join(b, meet).select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b")).distinct()
    s = classes.select("class_id", "tokens")
    full = pairs.join(s.select(F.col("class_id").alias("a"), F.col("tokens").alias("ta")), "a").join(s.select(F.col("class_id").alias("b"), F.col("tokens").alias("tb")), "b")
    return full.select("a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity")).where(F.col("similarity") >= least)


#: Shares of a similarity: the order of the stems' characters, their words, the words of the options; and what is left of
#: it where both cite evidence and none is shared.
BY_ORDER, BY_WORDS, BY_OPTIONS, OTHER_EVIDENCE = 0.65, 0.20, 0.15, 0.85
#: Share of words that the stems of a candidate pair have in common at least. The formula itself asks for none: two stems
#: without it are similar only if their characters agree to 86 in 100 in order while three words in four differ.
SHARED_WORDS = 0.25


def similarity(stem_a: str, stem_b: str, words: float, options: float, disjoint: bool, least: float = 0.0) -> float:
    """The similarity of two questions; 0 without looking closer where cheap bounds of it stay below ``least``."""
    factor = OTHER_EVIDENCE if disjoint else 1.0
    m = difflib.SequenceMatcher(None, stem_a, stem_b, autojunk=False)
    rest = BY_WORDS * words + BY_OPTIONS * options
    for bound in (m.real_quick_ratio, m.quick_ratio):
        if factor * (BY_ORDER * bound() + rest) < least - 1e-9:
            return 0.0
    return round(factor * (BY_ORDER * m.ratio() + rest), 4)


def similar_questions(structured: DataFrame, least: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): of each question the most similar earlier one of its project, and which questions are alike in all.

    ``structured``: id, project_id, stem, options (array<struct<key,text>>), chunks. Questions that are equal in stem,
    words of options and evidence are one, named by their smallest id. Pairs (later, earlier, similarity) are of such
    representatives whose stems share a ``SHARED_WORDS``-th of their words or more.
    """
    words = lambda c: F.array_sort(F.array_distinct(tokens(F.coalesce(c, F.lit("")))))
    plain = F.array_join(F.regexp_extract_all(F.regexp_replace(casefold(F.coalesce("stem", F.lit(""))), r"(?s)```.*?```", " code "), F.lit(r"(?U)(\w+)"), F.lit(1)), " ")
    q = structured.where("id is not null and project_id is not null").select(
        "id", "project_id", plain.alias("stem"), words(F.array_join(F.transform("options", lambda o: F.coalesce(o["text"], F.lit(""))), " ")).alias("options"), F.array_sort("chunks").alias("chunks")
    )
    key = F.sha2(F.concat_ws("\u0001", F.col("project_id").cast("string"), "stem", F.array_join("options", " "), F.array_join("chunks", " ")), 256)
    keyed = materialise(q.withColumn("k", key))
    first = keyed.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    members = keyed.select("id", "k").join(first.select("k", "class_id"), "k").select("id", "class_id").distinct()
    one = materialise(keyed.join(first.select("k", F.col("class_id").alias("id")), ["k", "id"], "left_semi").dropDuplicates(["id"]).withColumn("words", words(F.col("stem"))))
    # words of a project meet those of the same project only
    of_project = F.transform("words", lambda w: F.concat_ws(":", F.col("project_id").cast("string"), w))
    near = alike(one.select(F.col("id").alias("class_id"), of_project.alias("tokens")), SHARED_WORDS)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series, w: pd.Series, o: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y, i, j, bool(k), least) for x, y, i, j, k in zip(a, b, w, o, d)])

    side = lambda n: one.select(*[F.col(c).alias(f"{c}_{n}") for c in ("id", "stem", "options", "chunks")])
    both = near.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("similarity").alias("w")).join(side("a"), "id_a").join(side("b"), "id_b")
    apart = (F.size("chunks_a") > 0) & (F.size("chunks_b") > 0) & ~F.arrays_overlap("chunks_a", "chunks_b")
    scored = both.select(F.col("id_b").alias("later"), F.col("id_a").alias("earlier"), ratio("stem_a", "stem_b", "w", jaccard(F.col("options_a"), F.col("options_b")), apart).alias("similarity"))
    return nearest_earlier(scored, least), members


def nearest_earlier(pairs: DataFrame, least: float = NEAR) -> DataFrame:
    """(later, earlier, similarity): of each later item the most similar earlier one, if it is similar enough."""
    w = Window.partitionBy("later").orderBy(F.desc("similarity"), "earlier")
    return pairs.where(F.col("similarity") >= least).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@F.pandas_udf(T.BooleanType())
def lines_in_order(shown: pd.Series, source: pd.Series) -> pd.Series:
    """Whether every line that is shown stands in the source, in that order."""

    def one(a, b):
        rest = iter([x.strip() for x in (b or "").split("\n")])
        return all(any(x == y for y in rest) for x in (x.strip() for x in (a or "").split("\n")) if x)

    return pd.Series([one(a, b) for a, b in zip(shown, source)])
