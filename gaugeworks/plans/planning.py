"""Planning queries: the catalog's matrices over evaluation items and documents."""

from pyspark.sql import functions as F

from gaugeworks.functions.repeats import without_repeats
from gaugeworks.functions.text import TOKENS_SQL, tokens
from gaugeworks.operators import catalog, evidence, planner
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table

_T = catalog.tables_sql()
_FOCUS_ROWS = [("testing", 2.0, 0), ("data_flow", 3.0, 1), ("errors", 1.0, 2), ("testing", 4.0, 3), ("unknown", 5.0, 4)]
_FOCUS = f"""f0 as (select topic_id, arg_max(weight, position) as w from {catalog.values_sql(_FOCUS_ROWS, 'topic_id, weight, position')} group by 1),
focus as (select topic_id, greatest(w, 0)::double / sum(greatest(w, 0)) over () as weight from f0 where topic_id in (select topic_id from {_T['topic']})),
support as (select point_id, sum(weight * fit) as support from focus join {_T['topic_point']} using (topic_id) group by 1)"""
_POINTS = f"""hits as (select token, sum(w) as w from (select unnest(list_distinct({TOKENS_SQL.format("coalesce(text, '')")})) as token, least(1.0 + item_id % 3, 2.0)::double as w from eval_items) group by 1),
words as (select point_id, unnest(list_distinct({TOKENS_SQL.format("name || ' ' || query")})) as token from {_T['point']}),
scored as (select point_id, sum(w * (0.35 + 0.65 * coalesce(support, 0))) as score from hits join words using (token) left join support using (point_id) group by 1),
points as (select point_id, round(score / (select max(score) from scored), 4) as weight from scored where round(score / (select max(score) from scored), 9) >= {planner.POINT_FLOOR})"""


def _focus(spark):
    t = catalog.tables(spark)
    f = spark.createDataFrame(_FOCUS_ROWS, "topic_id string, weight double, position int")
    return planner.focus_weights(f, t["topic"]), t


def _points(spark, d):
    focus, t = _focus(spark)
    targets = read_table(spark, d, "eval_items").select(F.col("item_id").alias("target_id"), "text", (F.lit(1.0) + F.col("item_id") % 3).alias("weight"))
    return planner.point_distribution(targets, t["point"], planner.point_support(focus, t["topic_point"])), focus, t


@query(f"with {_FOCUS}, {_POINTS} select * from points")
def point_distribution(spark, d):
    return _points(spark, d)[0]


@query(f"with {_FOCUS} select point_id, round(support / (select max(support) from support), 4) as weight from support where support / (select max(support) from support) >= {planner.POINT_FLOOR}")
def focus_prior(spark, d):
    focus, t = _focus(spark)
    return planner.focus_prior(planner.point_support(focus, t["topic_point"]))


@query(
    f"""with {_FOCUS}, c as (select point_id, topic_id, round(weight * fit, 6) as contribution from focus join {_T['topic_point']} using (topic_id)),
r as (select *, row_number() over (partition by point_id order by contribution desc, topic_id) as r, max(contribution) over (partition by point_id) as top from c where contribution > 0)
select point_id, topic_id, contribution, case when r = 1 then 'primary' else 'secondary' end as role from r where r = 1 or contribution >= 0.5 * top"""
)
def focus_split(spark, d):
    focus, t = _focus(spark)
    return planner.focus_split(focus, t["topic_point"])


@query(
    f"with {_FOCUS}, {_POINTS}, s as (select template_id, sum(weight * fit) as score from points join {_T['point_template']} using (point_id) group by 1) select template_id, round(score / (select max(score) from s), 4) as weight from s"
)
def template_distribution(spark, d):
    points, _, t = _points(spark, d)
    return planner.template_distribution(points, t["point_template"])


@query(
    f"""with f as (select doc_id, 1 + doc_id % 3 as low, 3 + doc_id % 3 as high, lang = 'en' as specific, 1 + length(source) % 5 as kinds, contains(text, 'def ') as code, 1 + n_chars % 8 as n from documents where lang is not null and source is not null),
s as (select *, round((case when specific then 0.20 else 0.0 end)::double + 0.25::double * least(kinds, 4) / 4 + (case when code then 0.20 else 0.0 end)::double + 0.20::double * least(n, 6) / 6 + 0.15::double / 3, 6) as signal, greatest(high - low, 0) as span from f),
b as (select *, least(low + round(span * signal)::int, high) as a from s), c as (select *, least(high, a + case when span > 0 then 1 else 0 end) as b from b)
select doc_id, (case when greatest(a, 2) <= least(b, 4) then greatest(a, 2) when greatest(low, 2) <= least(high, 4) then greatest(low, 2) end)::int as low,
(case when greatest(a, 2) <= least(b, 4) then least(b, 4) when greatest(low, 2) <= least(high, 4) then least(high, 4) end)::int as high from c"""
)
def difficulty_band(spark, d):
    docs = read_table(spark, d, "documents").where("lang is not null and source is not null")
    low, high = (1 + F.col("doc_id") % 3).cast("int"), (3 + F.col("doc_id") % 3).cast("int")
    band = planner.difficulty_band(
        low, high, F.col("lang") == "en", 1 + F.length("source") % 5, F.contains(F.col("text"), F.lit("def ")), (1 + F.col("n_chars") % 8).cast("int"), F.lit(2), F.lit(4)
    )
    return docs.select("doc_id", band.alias("b")).select("doc_id", F.col("b.low").alias("low"), F.col("b.high").alias("high"))


@query(
    f"""with {_FOCUS}, {_POINTS}, pts as (select p.point_id, p.low, p.high, p.evidence_types as types, w.weight, s.support from {_T['point'].replace('as v(', 'as p(')} left join points w using (point_id) left join support s using (point_id)),
tpl as (select template_id, evidence_types as wanted from {_T['template']}),
c as (select pts.*, tpl.template_id, wanted, m.fit from pts cross join tpl left join {_T['point_template'].replace('as v(', 'as m(')} on m.point_id = pts.point_id and m.template_id = tpl.template_id)
select coalesce(case when support is null then 'focus' when fit is null then 'matrix' when weight is null then 'no_target' when len(list_intersect(types, wanted)) = 0 then 'evidence_type' when high < 3 then 'difficulty' end, 'passed') as reject_reason, count(*) as n from c group by 1"""
)
def gate_rejections(spark, d):
    points, focus, t = _points(spark, d)
    support = planner.point_support(focus, t["topic_point"])
    # points and templates are tables that people write; their grid is what the gates judge
    grid = (
        t["point"].join(points, "point_id", "left").join(support, "point_id", "left").crossJoin(F.broadcast(t["template"].select("template_id", F.col("evidence_types").alias("wanted"))))
        .join(F.broadcast(t["point_template"]), ["point_id", "template_id"], "left")
    )
    checks = [
        ("focus", F.col("support").isNull()), ("matrix", F.col("fit").isNull()), ("no_target", F.col("weight").isNull()),
        ("evidence_type", ~F.arrays_overlap("evidence_types", "wanted")), ("difficulty", F.col("high") < 3),
    ]
    return planner.gate(grid, checks).groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with k as (select doc_id, coalesce(repo_key, '') as repo_key, contains(text, 'def ') as code from documents where text is not null),
s as (select *, row_number() over (partition by repo_key, code order by doc_id) as r, count(*) over (partition by repo_key, code) as n from k)
select repo_key, doc_id, row_number() over (partition by repo_key order by r, n desc, code desc)::int as position from s"""
)
def interleave(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("repo_key", F.lit("")).alias("repo_key"), F.contains(F.col("text"), F.lit("def ")).alias("code"))
    return planner.interleave(docs, ["repo_key"], "code", [F.col("doc_id")]).select("repo_key", "doc_id", F.col("position").cast("int").alias("position"))


_PLANS = """cand as (select distinct project_id, id::varchar as plan_key, coalesce(regexp_extract_all(assessment_point_ids_json, '"([a-z_]+)"', 1), []) as points, coalesce(slot, '') as template, replace(lower(coalesce(stem, '')), 'ß', 'ss') as subject,
list_distinct(coalesce(regexp_extract_all(evidence_json, '"[cC]?([0-9]+)"', 1), [])) as evidence, coalesce(contains(stem, '_'), false) as code, coalesce(confidence, 5) / 10.0 as relevance, md5('0:' || id) as h from questions where project_id is not null)"""
_PENALTY = (
    "list_sum(list_transform(chosen, lambda c: round(0.35 * len(list_intersect(c.points, cand.points)) + (c.template = cand.template)::int * (0.15 + 0.25 * (len(list_intersect(c.points, cand.points)) > 0)::int) "
    "+ 0.40 * (c.subject = cand.subject and cand.subject <> '')::int + 0.10 * least(len(list_intersect(c.evidence, cand.evidence)), 3), 4)))"
)


@query(
    f"""with recursive {_PLANS},
g as (select project_id, 0 as position, []::struct(plan_key varchar, points varchar[], template varchar, subject varchar, evidence varchar[], code boolean)[] as chosen, null::varchar as plan_key, null::double as score from (select distinct project_id from cand)
union all select project_id, position + 1, list_append(chosen, {{'plan_key': k, 'points': points, 'template': template, 'subject': subject, 'evidence': evidence, 'code': code}}), k, score from (
select project_id, position, chosen, k, points, template, subject, evidence, code, score, row_number() over (partition by project_id order by score desc, h, k) as r from (
select g.project_id, g.position, g.chosen, cand.plan_key as k, cand.points, cand.template, cand.subject, cand.evidence, cand.code, cand.h,
round(cand.relevance::double - coalesce({_PENALTY}, 0) - 0.55 * (len(list_filter(chosen, lambda c: c.code = cand.code)) >= 2)::int, 6)::double as score
from g join cand on cand.project_id = g.project_id where g.position < 4 and not list_contains(list_transform(chosen, lambda c: c.plan_key), cand.plan_key))) where r = 1)
select project_id, position::int as position, plan_key, score from g where position > 0"""
)
def greedy_select(spark, d):
    """Of the questions of each project up to four that differ in points, template, subject and evidence."""
    columns = ("project_id", "id", "assessment_point_ids_json", "slot", "stem", "evidence_json", "confidence")
    q = without_repeats(read_table(spark, d, "questions").select(*columns), "id")
    ids = lambda c, p: F.coalesce(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(p), F.lit(1)), F.array())
    candidates = q.where("project_id is not null").select(
        "project_id", F.col("id").cast("string").alias("plan_key"), ids("assessment_point_ids_json", '"([a-z_]+)"').alias("points"), F.coalesce("slot", F.lit("")).alias("template"),
        F.coalesce("stem", F.lit("")).alias("subject"), F.array_distinct(ids("evidence_json", '"[cC]?([0-9]+)"')).alias("evidence"), F.coalesce(F.contains(F.col("stem"), F.lit("_")), F.lit(False)).alias("shows_code"),
        (F.coalesce(F.col("confidence"), F.lit(5)) / 10.0).alias("relevance"),
    )
    return planner.select_plans(candidates, "project_id", 4)


@query(
    """with o as (select o_orderkey, o_custkey, list_sort(list_distinct([o_orderpriority])) as points, o_orderstatus as template, year(o_orderdate) as subject, lag(o_orderpriority) over w as p1, lag(o_orderstatus) over w as t1, lag(year(o_orderdate)) over w as s1 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, round(0.35 * (o_p = p1)::int + 0.15 * (template = t1)::int + 0.25 * (o_p = p1 and template = t1)::int + 0.40 * (subject = s1)::int, 4) as penalty from (select *, points[1] as o_p from o) where p1 is not null"""
)
def repetition_penalty(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    plan = F.struct(F.array("o_orderpriority").alias("points"), F.col("o_orderstatus").alias("template"), F.year("o_orderdate").alias("subject"), F.array().cast("array<string>").alias("evidence"))
    o = read_table(spark, d, "orders").select("o_orderkey", plan.alias("b"), F.lag(plan).over(w).alias("a")).where("a is not null")
    return o.select("o_orderkey", planner.pair_penalty("a", "b").alias("penalty"))


@query(
    f"with {_FOCUS}, {_POINTS} select point_id, weight from points where point_id not in (select point_id from {_T['point_template']} where fit >= 0.9) order by weight desc, point_id limit 8"
)
def unsupported_points(spark, d):
    points, _, t = _points(spark, d)
    return planner.uncovered(points, t["point_template"].where("fit >= 0.9"), "point_id")


@query(
    f"select substr(sha256(string_agg(c, ';' order by c)), 1, 16) as catalog_hash from (select topic_id || '|' || point_id || '|' || printf('%.4f', fit) as c from {_T['topic_point']})"
)
def catalog_hash(spark, d):
    t = catalog.tables(spark)["topic_point"]
    return catalog.catalog_hash(t.select(F.col("topic_id").alias("a"), F.col("point_id").alias("b"), F.col("fit").alias("w")))


# targets of the whole corpus of plans: evaluation items; requests: projects, with the chunks they have as evidence
_BEST = f"""best as (select point_id, target_id, overlap from (select point_id, item_id as target_id, count(*)::int as overlap, row_number() over (partition by point_id order by count(*) desc, item_id) as r
from (select item_id, unnest(list_distinct({TOKENS_SQL.format("coalesce(text, '')")})) as token from eval_items) join words using (token) group by 1, 2) where r = 1)"""


@query(f"with {_FOCUS}, {_POINTS}, {_BEST} select * from best")
def best_targets(spark, d):
    """Of each point the evaluation item that shares most words with it."""
    return planner.best_targets(_targets(spark, d), catalog.tables(spark)["point"])


def _targets(spark, d):
    return read_table(spark, d, "eval_items").select(F.col("item_id").alias("target_id"), "text", F.col("item_id").alias("position"))


_PRIMARY = f"""prim as (select point_id, topic_id, fit as focus_fit from (select point_id, topic_id, fit, row_number() over (partition by point_id order by round(weight * fit, 6) desc, topic_id) as r from focus join {_T['topic_point']} using (topic_id) where round(weight * fit, 6) > 0) where r = 1)"""
_GROUPS = f"""known as (select p.point_id, p.weight, prim.topic_id, best.target_id, row_number() over (order by p.weight desc, p.point_id) as rank from points p left join prim using (point_id) left join best using (point_id) where p.weight > 0),
paired as (select *, case when target_id is not null and topic_id is not null then lead(point_id) over (partition by target_id, topic_id order by rank) end as second from known),
groups as (select rank, [point_id] as points, topic_id, target_id from paired union all select rank, [point_id, second], topic_id, target_id from paired where second is not null)"""


def _point_groups(spark, d):
    points, focus, t = _points(spark, d)
    primary = planner.focus_split(focus, t["topic_point"]).where("role = 'primary'")
    best = planner.best_targets(_targets(spark, d), t["point"])
    return planner.point_groups(points, primary, best), points, t


@query(f"with {_FOCUS}, {_POINTS}, {_BEST}, {_PRIMARY}, {_GROUPS} select array_to_string(points, ',') as points, topic_id, target_id from groups")
def point_groups(spark, d):
    """Points alone and in pairs that share a target and a primary topic."""
    return _point_groups(spark, d)[0].select(F.array_join("points", ",").alias("points"), "topic_id", "target_id")


_EVIDENCE = f"""chunk as (select project_id, c.id as id, c.title as title, c.evidence_types as types from (select id as project_id, unnest(from_json(chunks_json, '[{{"id":"VARCHAR","title":"VARCHAR","evidence_types":["VARCHAR"]}}]')) as c from (select distinct id, chunks_json from projects where json_valid(chunks_json))) where c.id is not null),
fits as (select project_id, template_id, chunk.id, title, types, row_number() over (partition by project_id, template_id order by length(chunk.id), chunk.id) as r from chunk, (select template_id, unnest(evidence_types) as wanted from {_T['template']}) t where list_contains(types, wanted)),
evid as (select project_id as request_id, template_id, list(id order by r) as ids, list_distinct(flatten(list(types))) as types, list_distinct(flatten(list({TOKENS_SQL.format("coalesce(title, '')")}))) as words, max(case when r = 1 then title end) as subject from fits where r <= 4 group by 1, 2)"""
_CANDIDATES = f"""with {_FOCUS}, {_POINTS}, {_BEST}, {_PRIMARY}, {_GROUPS}, {_EVIDENCE},
member as (select rank, points as ps, topic_id, target_id, unnest(points) as point_id from groups),
per as (select rank, ps, avg(weight) as weight, avg(coalesce(tp.fit, 0))::double as focus_fit, max(p.low) as low, min(p.high) as high, list({{'p': m.point_id, 'types': p.evidence_types}} order by m.point_id) as allowed
from member m join {_T['point'].replace('as v(', 'as p(')} on p.point_id = m.point_id join points w on w.point_id = m.point_id left join {_T['topic_point'].replace('as v(', 'as tp(')} on tp.topic_id = m.topic_id and tp.point_id = m.point_id group by 1, 2),
tf as (select m.rank, m.ps, t.template_id, t.code_mode, min(coalesce(f.fit, 0))::double as fit from member m cross join (select template_id, code_mode from {_T['template'].replace('evidence_types)', 'evidence_types)')}) t left join {_T['point_template'].replace('as v(', 'as f(')} on f.point_id = m.point_id and f.template_id = t.template_id group by all),
grid as (select tf.*, per.* exclude (rank, ps), g.topic_id, g.target_id, tw.words as target_words from tf join per using (rank, ps) join groups g on g.rank = tf.rank and g.points = tf.ps left join (select item_id, list_distinct({TOKENS_SQL.format("coalesce(text, '')")}) as words from eval_items) tw on tw.item_id = g.target_id),
every as (select r.request_id, grid.*, e.ids, coalesce(e.types, []) as types, e.words, e.subject, coalesce(len(e.ids), 0) as n_ids from (select distinct id as request_id from projects) r cross join grid left join evid e on e.request_id = r.request_id and e.template_id = grid.template_id),
fitted as (select *, list_transform(allowed, lambda a: case when n_ids > 0 then round(greatest(0.5::double * len(list_intersect(types, a.types)) / len(list_distinct(a.types)) + 0.3::double * least(n_ids, 4) / 4 + (case when coalesce(list_has_any(target_words, words), false) then 0.20 else 0.14 end)::double, 0.05), 4) else 0 end) as efs,
round((case when target_id is not null then 0.20 else 0.0 end)::double + 0.25::double * least(len(types), 4) / 4 + (case when code_mode <> 'none' then 0.20 else 0.0 end)::double + 0.20::double * least(n_ids, 6) / 6 + 0.15::double / 3, 6) as signal from every),
b1 as (select *, least(low + round(greatest(high - low, 0) * signal)::int, high) as a, greatest(high - low, 0) as span from fitted),
b2 as (select *, least(high, a + case when span > 0 then 1 else 0 end) as b from b1),
b3 as (select *, case when greatest(a, 1) <= least(b, 3) then greatest(a, 1) when greatest(low, 1) <= least(high, 3) then greatest(low, 1) end as y_low, case when greatest(a, 1) <= least(b, 3) then least(b, 3) when greatest(low, 1) <= least(high, 3) then least(high, 3) end as y_high from b2),
gated as (select *, case when topic_id is null then 'focus_point_incompatible' when fit <= 0 then 'point_template_incompatible' when n_ids = 0 then 'required_evidence_missing'
when len(list_filter(allowed, lambda x: not list_has_any(x.types, types))) > 0 then 'evidence_type_mismatch' when coalesce(subject, '') = '' then 'variables_unresolved' when y_low is null then 'difficulty_out_of_range' end as why from b3),
named as (select *, case when why is null and row_number() over (partition by request_id, template_id, topic_id, replace(lower(subject), 'ß', 'ss'), why is null order by rank, len(ps)) > 1 then 'duplicate_plan_key' else why end as reject_reason from gated),
plans as (select request_id, ps as points, template_id, topic_id, target_id, ids, subject, y_low, y_high, round(weight * focus_fit * fit * list_sum(efs) / len(allowed) * (case when target_id is not null then 1.0 else 0.6 end)::double, 6) as relevance,
substr(sha256(array_to_string(ps, ',') || '|' || template_id || '|' || replace(lower(subject), 'ß', 'ss') || '|' || array_to_string(list_sort(ids), ',')), 1, 16) as plan_key, reject_reason from named)"""


def _candidates(spark, d):
    groups, points, t = _point_groups(spark, d)
    chunks = evidence.chunks(without_repeats(read_table(spark, d, "projects").select("id", "chunks_json"), "id"), ["id", "title", "evidence_types"])
    wanted = F.broadcast(t["template"].select("template_id", F.explode("evidence_types").alias("wanted")))
    kept = chunks.where("id is not null").withColumn("wanted", F.explode(F.array_distinct("evidence_types"))).join(wanted, "wanted")
    # the first four of each template, as an aggregate of bounded size
    first = F.slice(F.sort_array(F.collect_list(F.struct(F.length("id").alias("n"), "id", "title", "evidence_types"))), 1, 4)
    per = kept.groupBy(F.col("project_id").alias("request_id"), "template_id").agg(first.alias("cs"))
    have = per.select(
        "request_id", "template_id", F.transform("cs", lambda c: c["id"]).alias("ids"), F.array_distinct(F.flatten(F.transform("cs", lambda c: c["evidence_types"]))).alias("types"),
        F.array_distinct(tokens(F.array_join(F.transform("cs", lambda c: F.coalesce(c["title"], F.lit(""))), " \n "))).alias("words"), F.col("cs")[0]["title"].alias("subject"),
    )
    words = read_table(spark, d, "eval_items").select(F.col("item_id").alias("target_id"), F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("target_words"))
    requests = read_table(spark, d, "projects").where("id is not null").select(F.col("id").alias("request_id")).distinct()
    return planner.candidates(requests, groups, t, points, have, words, 1, 3), t


@query(f"{_CANDIDATES} select request_id, array_to_string(points, ',') as points, template_id, topic_id, target_id, array_to_string(ids, ',') as evidence, relevance, plan_key from plans where reject_reason is null")
def plan_candidates(spark, d):
    """The plans of each project that pass every gate, with their relevance."""
    c = _candidates(spark, d)[0].where("reject_reason is null")
    return c.select("request_id", F.array_join("points", ",").alias("points"), "template_id", "topic_id", "target_id", F.array_join("evidence", ",").alias("evidence"), "relevance", "plan_key")


@query(f"{_CANDIDATES} select coalesce(reject_reason, 'passed') as reject_reason, count(*) as n from plans group by 1")
def plan_rejections(spark, d):
    """How many plans each gate turned away."""
    return _candidates(spark, d)[0].groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{_CANDIDATES}, one as (select distinct plan_key, points, template_id, y_low, y_high from plans where reject_reason is null), e as (select plan_key, template_id, y_low, y_high, unnest(points) as p, generate_subscripts(points, 1) as i from one)
select plan_key, string_agg(coalesce(name, p), ' + ' order by i) as x, y_low::int as y_low, y_high::int as y_high, template_id as colour from e left join {_T['point'].replace('as v(', 'as n(')} on n.point_id = e.p group by plan_key, template_id, y_low, y_high"""
)
def plot_series(spark, d):
    c, t = _candidates(spark, d)
    return planner.plot_series(c.where("reject_reason is null").select("plan_key", "points", "template_id", "band").distinct(), t["point"])
