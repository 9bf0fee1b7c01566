"""Weighted planning over compatibility matrices: distributions, bands, gates, penalties, selection.

Matrices are long tables of their non-zero cells. Defined results: without targets a focus prior takes the place of the
point distribution; weights that sum to nothing give no rows; equal values are ordered by id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.text import casefold, tokens

MARK_CAP = 2.0
LEXICAL_FLOOR = 0.35
POINT_FLOOR = 0.08
SECONDARY = 0.5
#: Penalties of a plan beside plans that were chosen before.
SHARED_POINT, SAME_TEMPLATE, BOTH, SAME_SUBJECT, SHARED_EVIDENCE = 0.35, 0.15, 0.25, 0.40, 0.10
QUOTA_PENALTY = 0.55

_ALL = Window.partitionBy


def focus_weights(focus: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, weight): known topics, not negative, adding up to 1; of repeated ids the last one (``position``) holds."""
    last = focus.groupBy("topic_id").agg(F.max_by("weight", "position").alias("w")).join(F.broadcast(topics.select("topic_id")), "topic_id", "left_semi")
    kept = last.select("topic_id", F.greatest(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    # a focus has a handful of topics
    total = kept.agg(F.sum("w").alias("total"))
    return kept.join(F.broadcast(total)).where("total > 0").select("topic_id", (F.col("w") / F.col("total")).alias("weight"))


def point_support(focus: DataFrame, topic_point: DataFrame) -> DataFrame:
    """(point_id, support): sum over topics of weight times fit."""
    return topic_point.join(F.broadcast(focus), "topic_id").groupBy("point_id").agg(F.sum(F.col("weight") * F.col("fit")).alias("support"))


def _normalised(scores: DataFrame, key: str, floor: float) -> DataFrame:
    top = scores.agg(F.max("score").alias("top"))
    part = F.col("score") / F.col("top")
    return scores.join(F.broadcast(top)).where((F.col("top") > 0) & (F.round(part, 9) >= floor)).select(key, F.round(part, 4).alias("weight"))


def point_distribution(targets: DataFrame, points: DataFrame, support: DataFrame | None) -> DataFrame:
    """(point_id, weight): what targets (target_id, text, weight) imply, relative to the highest.

    The points are a table that people write: they are broadcast to the targets.
    """
    p = points.select("point_id", F.array_distinct(tokens(F.concat_ws(" ", "name", "query"))).alias("pt"))
    if support is None:
        p = p.withColumn("factor", F.lit(1.0))
    else:
        p = p.join(support, "point_id", "left").withColumn("factor", LEXICAL_FLOOR + (1 - LEXICAL_FLOOR) * F.coalesce("support", F.lit(0.0))).drop("support")
    t = targets.select("target_id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("tt"), F.least(F.coalesce("weight", F.lit(1.0)), F.lit(MARK_CAP)).alias("w"))
    # one row per token and target, met by the points' tokens: an equi-join with partial sums, no pairs of all
    words = p.select("point_id", "factor", F.explode("pt").alias("token"))
    hits = t.select(F.explode("tt").alias("token"), "w").groupBy("token").agg(F.sum("w").alias("w")).join(F.broadcast(words), "token")
    scores = hits.groupBy("point_id").agg(F.sum(F.col("w") * F.col("factor")).alias("score"))
    return _normalised(scores, "point_id", POINT_FLOOR)


def focus_prior(support: DataFrame) -> DataFrame:
    """(point_id, weight) from the focus alone."""
    return _normalised(support.select("point_id", F.col("support").alias("score")), "point_id", POINT_FLOOR)


def template_distribution(point_weights: DataFrame, point_template: DataFrame) -> DataFrame:
    scores = point_weights.join(F.broadcast(point_template), "point_id").groupBy("template_id").agg(F.sum(F.col("weight") * F.col("fit")).alias("score"))
    return _normalised(scores, "template_id", 0.0)


def focus_split(focus: DataFrame, topic_point: DataFrame) -> DataFrame:
    """(point_id, topic_id, contribution, role): the primary topic of each point and those with half of its share."""
    c = topic_point.join(F.broadcast(focus), "topic_id").select("point_id", "topic_id", F.round(F.col("weight") * F.col("fit"), 6).alias("contribution")).where("contribution > 0")
    w = Window.partitionBy("point_id").orderBy(F.desc("contribution"), "topic_id")
    ranked = c.withColumn("r", F.row_number().over(w)).withColumn("top", F.first("contribution").over(w))
    return ranked.where((F.col("r") == 1) | (F.col("contribution") >= SECONDARY * F.col("top"))).select("point_id", "topic_id", "contribution", F.when(F.col("r") == 1, "primary").otherwise("secondary").alias("role"))


def difficulty_band(low: Column, high: Column, specific: Column, n_kinds: Column, shows_code: Column, n_evidence: Column, asked_low: Column, asked_high: Column) -> Column:
    """struct<low, high> of a plan's expected difficulty within what was asked; null if they don't meet."""
    signal = (
        F.when(specific, 0.20).otherwise(0.0) + 0.25 * F.least(n_kinds, F.lit(4)) / 4 + F.when(shows_code, 0.20).otherwise(0.0) + 0.20 * F.least(n_evidence, F.lit(6)) / 6 + 0.15 / 3
    )
    span = F.greatest(high - low, F.lit(0))
    a = F.least(low + F.round(span * F.round(signal, 6)).cast("int"), high)
    b = F.least(high, a + F.when(span > 0, 1).otherwise(0))
    lo, hi = F.greatest(a, asked_low), F.least(b, asked_high)
    wide_lo, wide_hi = F.greatest(low, asked_low), F.least(high, asked_high)
    return F.when(lo <= hi, F.struct(lo.alias("low"), hi.alias("high"))).when(wide_lo <= wide_hi, F.struct(wide_lo.alias("low"), wide_hi.alias("high")))


def evidence_fit(types: Column, allowed: Column, n_evidence: Column, linked: Column) -> Column:
    """How well pieces of evidence of some types serve a point that allows others; 0.05 at least, 0 without evidence."""
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(types, allowed)).cast("double"), F.size(F.array_distinct(allowed)).cast("double")), F.lit(0.5))
    fit = 0.5 * share + 0.3 * F.least(n_evidence, F.lit(4)) / 4 + F.when(linked, 0.20).otherwise(0.14)
    return F.when(n_evidence > 0, F.round(F.greatest(fit, F.lit(0.05)), 4)).otherwise(0.0)


def plan_key(points: Column, template: Column, subject: Column, evidence: Column) -> Column:
    """16 hex digits that tell plans apart: points, template, subject without case, evidence in any order."""
    whole = F.concat_ws("|", F.array_join(points, ","), template, casefold(subject), F.array_join(F.array_sort(evidence), ","))
    return F.substring(F.sha2(whole, 256), 1, 16)


def best_targets(targets: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, target_id, overlap): of each point the target that shares most words with it, the first of equal ones.

    ``targets``: target_id, text, position. The points are a table that people write: they are broadcast to the targets.
    """
    p = points.select("point_id", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "name", "query")))).alias("w"))
    t = targets.select("target_id", "position", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("w"))
    n = t.join(F.broadcast(p), "w").groupBy("point_id", "target_id", "position").agg(F.count(F.lit(1)).alias("overlap"))
    # an aggregate and no window: a point that all targets share words with fits no single task
    best = n.groupBy("point_id").agg(F.min_by(F.struct("target_id", "overlap"), F.struct((-F.col("overlap")).alias("n"), "position", "target_id")).alias("b"))
    return best.select("point_id", "b.target_id", F.col("b.overlap").cast("int").alias("overlap"))


def point_groups(weights: DataFrame, primary: DataFrame, best: DataFrame) -> DataFrame:
    """(rank, points, topic_id, target_id): each point alone, and with the next one below it that has its target and topic.

    ``weights``: point_id, weight; ``primary``: point_id, topic_id; ``best``: point_id, target_id. Tables of the catalog's size.
    """
    ranked = weights.where("weight > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "point_id")))
    known = ranked.join(F.broadcast(primary.select("point_id", "topic_id")), "point_id", "left").join(F.broadcast(best.select("point_id", "target_id")), "point_id", "left")
    second = F.lead("point_id").over(Window.partitionBy("target_id", "topic_id").orderBy("rank"))
    paired = known.withColumn("second", F.when(F.col("target_id").isNotNull() & F.col("topic_id").isNotNull(), second))
    groups = F.array_compact(F.array(F.array("point_id"), F.when(F.col("second").isNotNull(), F.array("point_id", "second"))))
    return paired.select("rank", F.explode(groups).alias("points"), "topic_id", "target_id")


# The gates of a candidate in the order in which they are asked.
GATES = ("focus_point_incompatible", "point_template_incompatible", "required_evidence_missing", "evidence_type_mismatch", "variables_unresolved", "difficulty_out_of_range", "duplicate_plan_key")


def candidates(requests: DataFrame, groups: DataFrame, catalog: dict[str, DataFrame], weights: DataFrame, evidence: DataFrame, target_words: DataFrame, low: int, high: int) -> DataFrame:
    """All plans of all requests with ``reject_reason``, null for those that pass every gate.

    ``requests``: request_id; ``evidence``: request_id, template_id, ids, types, words, subject (one row a template that the
    request has evidence for); ``target_words``: target_id, words; ``low``, ``high``: the difficulty asked for. Columns:
    request_id, points, template_id, topic_id, target_id, evidence, subject, band, relevance, plan_key, shows_code,
    reject_reason. The grid of groups and templates has the catalog's size and is broadcast to the requests.
    """
    members = groups.select("rank", "points", "topic_id", F.explode("points").alias("point_id"))
    detail = (
        members.join(catalog["point"].select("point_id", "low", "high", "evidence_types"), "point_id").join(weights, "point_id")
        .join(catalog["topic_point"].withColumnRenamed("fit", "focus_fit"), ["topic_id", "point_id"], "left")
    )
    per_group = detail.groupBy("rank", "points").agg(
        F.avg("weight").alias("weight"), F.avg(F.coalesce("focus_fit", F.lit(0.0))).alias("focus_fit"), F.max("low").alias("low"), F.min("high").alias("high"),
        F.sort_array(F.collect_list(F.struct("point_id", "evidence_types"))).alias("allowed"),
    )
    template = catalog["template"].select("template_id", "code_mode")
    fits = members.crossJoin(template).join(catalog["point_template"], ["point_id", "template_id"], "left").groupBy("rank", "points", "template_id", "code_mode").agg(F.min(F.coalesce("fit", F.lit(0.0))).alias("fit"))
    grid = fits.join(per_group, ["rank", "points"]).join(groups, ["rank", "points"]).join(target_words, "target_id", "left")
    all_ = requests.crossJoin(F.broadcast(materialise(grid))).join(evidence, ["request_id", "template_id"], "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    kinds = F.coalesce("types", F.array().cast("array<string>"))
    linked = F.coalesce(F.arrays_overlap("target_words", "words"), F.lit(False))
    shows_code = F.col("code_mode") != "none"
    fit_of = F.transform("allowed", lambda a: evidence_fit(kinds, a["evidence_types"], n, linked))
    mean_fit = F.aggregate(fit_of, F.lit(0.0), lambda s, x: s + x) / F.size("allowed")
    band = difficulty_band(F.col("low"), F.col("high"), F.col("target_id").isNotNull(), F.size(kinds), shows_code, n, F.lit(low), F.lit(high))
    relevance = F.round(F.col("weight") * F.col("focus_fit") * F.col("fit") * mean_fit * F.when(F.col("target_id").isNotNull(), 1.0).otherwise(0.6), 6)
    made = all_.withColumn("band", band).withColumn("relevance", relevance).withColumn("shows_code", shows_code).withColumn("plan_key", plan_key(F.col("points"), F.col("template_id"), F.col("subject"), F.col("ids")))
    first = gate(made, list(zip(GATES, (
        F.col("topic_id").isNull(), F.col("fit") <= 0, n == 0, F.exists("allowed", lambda a: ~F.arrays_overlap(a["evidence_types"], kinds)), F.coalesce(F.col("subject"), F.lit("")) == "", F.col("band").isNull(),
    ))))
    # a claim on the same topic, template and subject that a plan before makes is no other plan
    claim = Window.partitionBy("request_id", "template_id", "topic_id", casefold(F.col("subject")), F.col("reject_reason").isNull()).orderBy("rank", F.size("points"))
    again = F.col("reject_reason").isNull() & (F.row_number().over(claim) > 1)
    named = first.withColumn("reject_reason", F.when(again, GATES[-1]).otherwise(F.col("reject_reason")))
    return named.select("request_id", "points", "template_id", "topic_id", "target_id", F.col("ids").alias("evidence"), "subject", "band", "relevance", "plan_key", "shows_code", "reject_reason")


def plot_series(plans: DataFrame, points: DataFrame) -> DataFrame:
    """(plan_key, x, y_low, y_high, colour): names of a plan's points, its band, its template."""
    each = plans.select("plan_key", "template_id", "band", F.posexplode("points").alias("i", "point_id")).join(F.broadcast(points.select("point_id", "name")), "point_id", "left")
    g = each.groupBy("plan_key", "template_id", "band").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", "point_id").alias("name")))).alias("ns"))
    return g.select("plan_key", F.array_join(F.transform("ns", lambda x: x["name"]), " + ").alias("x"), F.col("band.low").alias("y_low"), F.col("band.high").alias("y_high"), F.col("template_id").alias("colour"))


def gate(candidates: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """The candidates with ``reject_reason``: the first check that holds, null for those that pass all."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        reason = F.when(bad, name).otherwise(reason)
    return candidates.withColumn("reject_reason", reason)


def pair_penalty(a: str, b: str) -> Column:
    """What plan ``b`` loses beside plan ``a`` (columns points, template, subject, evidence of two aliases); subjects are
    compared without case, and empty ones are no subject."""
    subject = lambda x: casefold(F.col(f"{x}.subject").cast("string"))
    shared = F.size(F.array_intersect(f"{a}.points", f"{b}.points"))
    same = F.col(f"{a}.template") == F.col(f"{b}.template")
    evidence = F.size(F.array_intersect(f"{a}.evidence", f"{b}.evidence"))
    return F.round(
        SHARED_POINT * shared + F.when(same, SAME_TEMPLATE).otherwise(0.0) + F.when(same & (shared > 0), BOTH).otherwise(0.0)
        + F.when((subject(a) == subject(b)) & (subject(b) != ""), SAME_SUBJECT).otherwise(0.0) + SHARED_EVIDENCE * F.least(evidence, F.lit(3)), 4,
    )


def select_plans(candidates: DataFrame, group: str, count: int, code_share: float = 0.5, seed: int = 0) -> DataFrame:
    """(group, position, plan_key, score): greedy choice within each group, one plan after the other.

    Columns: plan_key, points, template, subject, evidence, shows_code, relevance. Either kind of plan, with code and
    without, loses ``QUOTA_PENALTY`` once it has had its share. Ties go to the smaller hash of the seed and the plan's key.

    A round takes the best plan of each group as an aggregate, so a group of any size is combined before it is shuffled
    and fits no single task; what was chosen, ``count`` rows a group at most, is joined back for the next round's penalties.
    """
    rest = candidates.select(group, "plan_key", "points", "template", "subject", "evidence", F.col("shows_code").alias("code"), "relevance")
    rest = materialise(rest.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "plan_key"))).withColumn("_lost", F.lit(0.0)))
    with_code = round(count * code_share)
    out = None
    taken = rest.select(group).where(F.lit(False)).withColumn("n_code", F.lit(0)).withColumn("n_plain", F.lit(0))
    for position in range(1, count + 1):
        scored = rest.join(taken, group, "left")
        full = F.when(F.col("code"), F.coalesce("n_code", F.lit(0)) >= with_code).otherwise(F.coalesce("n_plain", F.lit(0)) >= count - with_code)
        value = F.round(F.col("relevance") - F.col("_lost") - F.when(full, QUOTA_PENALTY).otherwise(0.0), 6)
        plan = F.struct("plan_key", "points", "template", "subject", "evidence", "code", value.alias("score"))
        best = scored.groupBy(group).agg(F.min_by(plan, F.struct((-value).alias("v"), "_h", "plan_key")).alias("_p"))
        best = materialise(best.select(group, F.lit(position).alias("position"), "_p"))
        out = best if out is None else out.unionByName(best)
        if position == count:
            break
        taken = out.groupBy(group).agg(F.count_if("_p.code").cast("int").alias("n_code"), F.count_if(~F.col("_p.code")).cast("int").alias("n_plain"))
        left = rest.join(best.select(group, F.col("_p").alias("_a")), group).where(F.col("plan_key") != F.col("_a.plan_key"))
        lost = left.withColumn("_b", F.struct("points", "template", "subject", "evidence")).withColumn("_lost", F.col("_lost") + pair_penalty("_a", "_b"))
        rest = materialise(lost.drop("_a", "_b"))
    return out.select(group, "position", F.col("_p.plan_key").alias("plan_key"), F.col("_p.score").alias("score"))


def interleave(df: DataFrame, group: list[str], kind: str, order: list[Column]) -> DataFrame:
    """``df`` with ``position``: the two kinds alternate, the larger one (on a tie the true one) first."""
    r = F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group, kind))
    sizes = df.withColumn("_r", r).withColumn("_n", n)
    first = Window.partitionBy(*group).orderBy("_r", F.desc("_n"), F.desc(kind))
    return sizes.withColumn("position", F.row_number().over(first)).drop("_r", "_n")


def uncovered(weights: DataFrame, covered: DataFrame, key: str, most: int = 8) -> DataFrame:
    """The heaviest entries that nothing covers: a report of ``most`` rows."""
    return weights.join(covered.select(key).distinct(), key, "left_anti").orderBy(F.desc("weight"), key).limit(most)
