"""Queries over records: publication, projections, merges, edits, lists, neighbours, groupings."""

from pyspark.sql import functions as F

from gaugeworks.functions.repeats import without_repeats
from gaugeworks.functions.text import TOKENS_SQL, clean_text
from gaugeworks.operators import alignment, catalog, evidence, privacy, records, review, rules, vectors
from gaugeworks.plans import nested_sql
from gaugeworks.plans.registry import query
from gaugeworks.plans.review import _questions_sql, _structured
from gaugeworks.plans.structure import _CHUNKS, _chunks
from gaugeworks.sources import read_table

_LISTED = "(case when json_type(v) = 'OBJECT' then coalesce(json_extract(v, '$.question_ids'), json_extract(v, '$.ids')) else v end)"
_LISTS = f"lists as (select distinct ref_id as id, project_id, key as question_id from ({nested_sql._ids('assessments', 'question_ids_json', 'created_at', nested_sql._each(_LISTED, 'question_id', 'id'), ', project_id')}) where key is not null)"


@query(
    f"""with {_LISTS}, q as (select id as question_id, min(project_id) as project, min(status) as status from questions group by id)
select id, count(*) as n_listed, bool_and(coalesce(project = project_id and status = 'approved', false)) as passes from lists left join q using (question_id) group by id"""
)
def assessment_gate(spark, d):
    """Whether each assessment's questions exist, belong to its project and are approved."""
    lists = records.question_lists(read_table(spark, d, "assessments"), ("project_id",))
    q = read_table(spark, d, "questions").groupBy(F.col("id").alias("question_id")).agg(F.min("project_id").alias("project"), F.min("status").alias("status"))
    return records.publish_gate(lists, q)


@query(
    f"""with {_LISTS}, r as (select row_number() over () as rid, id, v from ({nested_sql.decoded('assessments', 'question_ids_json')})),
e as (select rid, id, unnest(xs) as x, unnest(range(len(xs))) as position from (select *, {nested_sql._each(_LISTED, 'question_id', 'id')} as xs from r)),
n as (select rid, id, {nested_sql.number('x')} as question_id, min(position) as p from e group by all having question_id is not null),
o as (select id, question_id, (row_number() over (partition by rid order by p) - 1)::int as position from n)
select distinct id, position, question_id, stem from o join (select id as question_id, min(stem) as stem from questions group by 1) using (question_id)"""
)
def question_order(spark, d):
    """The questions of each assessment in its order, with their stems; missing ones leave gaps."""
    lists = records.question_lists(read_table(spark, d, "assessments")).distinct()
    q = read_table(spark, d, "questions").groupBy(F.col("id").alias("question_id")).agg(F.min("stem").alias("stem"))
    return lists.join(q, "question_id").select("id", "position", "question_id", "stem")


@query(
    f"""with {_questions_sql()} select id, stem, array_to_string(list_transform(options, lambda o: o.key || ') ' || coalesce(o.text, '')), chr(10)) as shown, len(list_distinct(answer)) = 1 as single,
case when id % 2 = 0 then len(list_distinct(answer))::int end as n_correct from (select q.* exclude (stem), s.stem from q join (select distinct id, stem from questions) s using (id))"""
)
def taker_view(spark, d):
    """What takers see of a question; the number of right options for even ids, as if their assessment showed it."""
    v = records.taker_view(_structured(spark, d), F.col("id") % 2 == 0)
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(") "), F.coalesce(o["text"], F.lit("")))), "\n")
    return v.select("id", "stem", shown.alias("shown"), "single", "n_correct")


@query(
    """with last as (select user_id, arg_max(event_type, (ts, event_id)) as e from events group by 1), s as (select case e when 'click' then 'queued' when 'view' then 'running' when 'signup' then 'awaiting_client' else 'complete' end as state from last)
select state as before, case when state in ('queued', 'running') then 'failed' else state end as after, count(*) as n from s group by all"""
)
def stale_runs(spark, d):
    """States of runs before and after a restart; a user's last event stands for the state of a run."""
    e = read_table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    state = F.when(F.col("e") == "click", "queued").when(F.col("e") == "view", "running").when(F.col("e") == "signup", "awaiting_client").otherwise("complete")
    return e.select(state.alias("before")).groupBy("before").agg(F.count(F.lit(1)).alias("n")).select("before", records.fail_stale(F.col("before")).alias("after"), "n")


@query(
    """with a as (select distinct id, config_json from assessments), k as (select id, unnest(['show_correct_count', 'adaptive', 'shuffle']) as key, unnest(['false', 'false', 'true']) as dflt, config_json as j from a)
select id, key, coalesce(case when json_valid(j) then json_extract_string(j, '$.' || key) end, dflt) as value from k"""
)
def merged_config(spark, d):
    """Each assessment's switches, its own over the defaults."""
    a = read_table(spark, d, "assessments").select("id", "config_json").distinct()
    own = F.from_json("config_json", "show_correct_count string, adaptive string, shuffle string")
    given = F.map_filter(F.create_map(*[x for k in ("show_correct_count", "adaptive", "shuffle") for x in (F.lit(k), own[k])]), lambda k, v: v.isNotNull())
    default = F.create_map(F.lit("show_correct_count"), F.lit("false"), F.lit("adaptive"), F.lit("false"), F.lit("shuffle"), F.lit("true"))
    return a.select("id", F.explode(review.merge_payload(default, F.coalesce(given, F.create_map().cast("map<string,string>")))).alias("key", "value"))


@query(
    """with q as (select id, min(stem) as stem, min(explanation) as explanation, min(status) as status, min(difficulty) as difficulty, min(confidence) as confidence from questions group by id),
o as (select id, case when id % 3 = 0 then coalesce(stem, '') || ' (draft)' else stem end as stem, explanation, case when id % 5 = 0 then null else status end as status, difficulty from q)
select q.id, (q.stem is distinct from o.stem) or (q.explanation is distinct from o.explanation) as content_changed, (q.status is distinct from o.status) or (q.difficulty is distinct from o.difficulty) as other_changed,
case when not ((q.stem is distinct from o.stem) or (q.explanation is distinct from o.explanation)) then confidence end as confidence from q join o using (id)"""
)
def edited_questions(spark, d):
    """What changed between a draft of each question and its present state, and the confidence that is left."""
    c = ("stem", "explanation", "status", "difficulty", "confidence")
    q = read_table(spark, d, "questions").groupBy("id").agg(*[F.min(x).alias(x) for x in c])
    old = q.withColumn("stem", F.when(F.col("id") % 3 == 0, F.concat(F.coalesce("stem", F.lit("")), F.lit(" (draft)"))).otherwise(F.col("stem"))).withColumn("status", F.when(F.col("id") % 5 != 0, F.col("status")))
    return records.after_edit(old, q, "id", ["stem", "explanation"], ["status", "difficulty"], ["confidence"])


@query(
    f"""with {_questions_sql()} select id, array_to_string(list_sort(list_filter(map_keys(why), lambda k: list_contains(answer, k) or k = 'A')), ',') as letters,
coalesce(sum_len, 0)::bigint as chars from (select *, list_sum(list_transform(list_filter(map_keys(why), lambda k: list_contains(answer, k) or k = 'A'), lambda k: length(why[k]))) as sum_len from q)"""
)
def relevant_reasons(spark, d):
    """The reasons that a taker who chose A is shown: those of the right options and of A."""
    why = review.relevant_justifications(F.col("justifications"), F.col("answer"), F.array(F.lit("A")))
    s = _structured(spark, d).select("id", why.alias("w"))
    chars = F.aggregate(F.map_values("w"), F.lit(0), lambda n, t: n + F.length(t))
    return s.select("id", F.array_join(F.array_sort(F.map_keys("w")), ",").alias("letters"), chars.cast("bigint").alias("chars"))


@query(
    f"""with {_questions_sql()}, w as (select id, difficulty, answer, n, ('0x' || substr(md5(id::varchar), 1, 8))::bigint as h, list_sort(list_transform(options, lambda o: {{'h': md5(id || ':' || coalesce(o.text, '')), 'old': o.key, 'text': o.text}})) as o from q)
select id, case when id % 2 = 0 then least(greatest(difficulty, 1), greatest(n - 1, 1)) else h % greatest(n - 1, 1) + 1 end::int as n_correct, array_to_string(list_transform(o, lambda x: x.old), ',') as old_letters,
array_to_string(list_sort(list_distinct(list_filter(list_transform(o, lambda x, i: case when list_contains(answer, x.old) then chr(64 + i::int) end), lambda x: x is not null))), ',') as answer from w"""
)
def normalised_questions(spark, d):
    """Options in a hashed order with new letters, the answer in those, and how many options were to be correct."""
    s = _structured(spark, d).where("id is not null")
    mode = F.when(F.col("id") % 2 == 0, "exact").otherwise("dynamic")
    new = records.normalised(F.col("options"), F.col("answer"), F.col("id"), F.coalesce("explanation", F.lit("")))
    n = records.correct_count(mode, F.col("difficulty"), F.size("options"), F.col("id"))
    r = s.select("id", n.alias("n_correct"), new.alias("x"), "options")
    old = F.transform("x.options", lambda o: F.filter(F.col("options"), lambda p: p["text"].eqNullSafe(o["text"]))[0]["key"])
    return r.select("id", "n_correct", F.array_join(old, ",").alias("old_letters"), F.array_join("x.answer", ",").alias("answer"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as clean_md5 from documents where text is not null")
def clean_texts(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(clean_text(F.col("text"))).alias("clean_md5"))


_TOPICS = f"""(select topic_id, name || ' ' || qs as words, 2.0::double as weight from (select t.topic_id, t.name, string_agg(p.query, ' ' order by p.point_id) as qs from {catalog.tables_sql()['topic'].replace('as v(', 'as t(')}
join {catalog.tables_sql()['topic_point'].replace('as v(', 'as tp(')} on tp.topic_id = t.topic_id join {catalog.tables_sql()['point'].replace('as v(', 'as p(')} on p.point_id = tp.point_id group by 1, 2))"""


@query(
    f"""with topics as {_TOPICS}, tw as (select topic_id, unnest(list_filter(list_distinct({TOKENS_SQL.format('words')}), lambda x: length(x) > 2)) as w from topics),
it as (select item_id, unnest(list_filter(list_distinct({TOKENS_SQL.format("coalesce(text, '')")}), lambda x: length(x) > 2)) as w from eval_items),
o as (select item_id, topic_id, count(*) as overlap from it join tw using (w) group by all),
s as (select item_id, topic_id, round(coalesce(overlap, 0) + 0.15 * weight, 3) as score from (select distinct item_id from eval_items) cross join topics left join o using (item_id, topic_id)),
r as (select *, row_number() over (partition by item_id order by score desc, topic_id) as r, max(score) over (partition by item_id) as top from s)
select item_id, topic_id, score from r where r <= 3 and score >= greatest(0.15, round(0.55 * top, 6))"""
)
def topic_matches(spark, d):
    t = catalog.tables(spark)
    queries = t["topic_point"].join(t["point"], "point_id").groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point_id", "query"))), lambda x: x["query"]), " ").alias("qs"))
    topics = t["topic"].join(queries, "topic_id").select("topic_id", F.concat_ws(" ", "name", "qs").alias("words"), F.lit(2.0).alias("weight"))
    items = read_table(spark, d, "eval_items").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return alignment.topic_matches(items, topics, "item_id", "text")


@query(
    "select project_id, string_agg(title, '; ' order by id, title) as summary from (select *, row_number() over (partition by project_id order by id, title) as r from (select distinct id, project_id, title from assessments) where title is not null) where r <= 8 group by 1"
)
def context_summary(spark, d):
    """The first eight titles of each project's assessments in one line."""
    a = read_table(spark, d, "assessments").select("id", "project_id", "title").distinct()
    return records.first_of(a, ["project_id"], F.col("id"), "title", 8)


_KINDS = ["README", "readme", "structure", "dependencies", "function", "class", "module_var", "source", "notebook_cell", "imports", "import_graph", "callgraph", "flow"]
_CAPS = {"function": 400, "class": 200, "module_var": 200, "imports": 150, "import_graph": 200, "callgraph": 400}


@query(
    f"""with {_CHUNKS}, o as (select project_id, chunk_id, kind, list_position({_KINDS!r}, kind) as p, row_number() over (partition by project_id, kind order by length(chunk_id), chunk_id) as r from (select distinct project_id, chunk_id, kind from chunks) where chunk_id is not null and kind in ({', '.join(map(repr, _KINDS))})),
k as (select * from o where r <= case kind {' '.join(f"when '{k}' then {n}" for k, n in _CAPS.items())} else 300 end)
select project_id, 'c' || (row_number() over (partition by project_id order by p, r) - 1) as chunk_id, kind, chunk_id as old_id from k qualify row_number() over (partition by project_id order by p, r) <= 800"""
)
def evidence_list(spark, d):
    """The chunks of each project numbered anew, producer by producer, each with its limit (that is what the list is)."""
    c = _chunks(spark, d, ["id", "kind"]).where("id is not null").distinct()
    parts = [(k, c.where(F.col("kind") == k).select("project_id", F.col("id").alias("old_id"), F.length("id").alias("n")), _CAPS.get(k, 300)) for k in _KINDS]
    return evidence.numbered(parts, "project_id", ["n", "old_id"], 800).select("project_id", "chunk_id", "kind", "old_id")


@query(
    f"with {_CHUNKS} select project_id, count(*) as n_chunks, count(*) filter (kind in ('callgraph', 'flow', 'import_graph', 'imports') or (kind = 'structure' and contains(text, '->'))) as n_relational from chunks where kind is not null and text is not null group by 1"
)
def relational_chunks(spark, d):
    """How many chunks of each project show relations between its parts."""
    from gaugeworks.operators.entities import relational

    c = _chunks(spark, d, ["kind", "text"]).where("kind is not null and text is not null")
    return c.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(relational(F.col("kind"), F.col("text"))).alias("n_relational"))


@query(
    f"""with {_CHUNKS}, f as (select project_id, file, regexp_extract(lower(file), '(\\.[a-z0-9]+)$', 1) as suffix, sum(len(string_split(text, chr(10)))) as lines, count(*) filter (kind = 'function') as functions, count(*) filter (kind = 'class') as classes from chunks where file <> '' and text is not null group by 1, 2)
select project_id, suffix, count(*) as n_files, sum(lines)::bigint as n_lines, sum(functions)::bigint as n_functions, sum(classes)::bigint as n_classes from f group by 1, 2"""
)
def project_stats(spark, d):
    """Files, lines, functions and classes of each project by suffix, counted in its chunks."""
    c = _chunks(spark, d, ["kind", "text", "file"]).where("file <> '' and text is not null")
    lines = F.regexp_count("text", F.lit("\n")) + 1
    f = c.groupBy("project_id", "file").agg(F.sum(lines).alias("l"), F.count_if(F.col("kind") == "function").alias("fn"), F.count_if(F.col("kind") == "class").alias("cl"))
    suffix = F.regexp_extract(F.lower("file"), r"(\.[a-z0-9]+)$", 1)
    return f.groupBy("project_id", suffix.alias("suffix")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("l").cast("bigint").alias("n_lines"), F.sum("fn").cast("bigint").alias("n_functions"), F.sum("cl").cast("bigint").alias("n_classes")
    )


@query(
    f"""with v as (select distinct id, case when json_valid(stats_json) then try_cast(json_extract_string(stats_json, '$.analysis_version') as int) end as version, case when json_valid(stats_json) then try_cast(json_extract_string(stats_json, '$.source_files') as bigint) end as stored from projects),
{_CHUNKS}, n as (select project_id as id, count(distinct file) as files from chunks where file <> '' group by 1)
select id, case when coalesce(version, 0) < 2 then 2 else version end as version, case when coalesce(version, 0) < 2 then coalesce(files, 0) else stored end as source_files from v left join n using (id)"""
)
def refreshed_stats(spark, d):
    """The number of source files of each project: as stored, or counted anew where the analysis is older than version 2."""
    p = without_repeats(read_table(spark, d, "projects").select("id", "stats_json"), "id")
    s = p.select("id", F.get_json_object("stats_json", "$.analysis_version").try_cast("int").alias("version"), F.get_json_object("stats_json", "$.source_files").try_cast("bigint").alias("source_files"))
    counted = _chunks(spark, d, ["file"]).where("file <> ''").distinct().groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return records.refresh(s, "version", 2, lambda old: old.join(counted, "id", "left").select("id", F.lit(2).alias("version"), F.coalesce("n", F.lit(0)).cast("bigint").alias("source_files")))


@query(
    "with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 100 = 0), s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as similarity from q, embeddings e where e.vec_id <> q.vec_id) "
    "select query_id, (row_number() over (partition by query_id order by similarity desc, vec_id))::int as rank, vec_id, similarity from s qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 10"
)
def nearest_vectors(spark, d):
    """Of each vector whose id 100 divides the ten most alike ones of all."""
    e = read_table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), 10)


@query(
    "select o_orderstatus as status, o_orderpriority as priority, grouping(o_orderstatus)::int as all_status, grouping(o_orderpriority)::int as all_priorities, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)"
)
def cube_orders(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    g = o.cube("status", "priority").agg(F.grouping("status").cast("int").alias("all_status"), F.grouping("priority").cast("int").alias("all_priorities"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g


@query(
    "select event_type, count(distinct user_id) as n_users, true as users_close, true as median_close from events group by 1"
)
def approximate_counts(spark, d):
    """Whether sketches of distinct users and of the median come within five percent of the exact figures."""
    e = read_table(spark, d, "events")
    exact = e.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))
    g = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("a"), F.percentile_approx("value", F.lit(0.5), F.lit(10_000)).alias("m"), F.count_if(F.col("value").isNotNull()).alias("n"))
    below = e.join(F.broadcast(g.select("event_type", "m")), "event_type").groupBy("event_type").agg(F.count_if(F.col("value") <= F.col("m")).alias("below"))
    joined = exact.join(g, "event_type").join(below, "event_type")
    close = F.abs(F.col("a") - F.col("n_users")) <= 0.05 * F.col("n_users") + 1
    return joined.select("event_type", "n_users", close.alias("users_close"), (F.abs(F.col("below") / F.col("n") - 0.5) <= 0.05).alias("median_close"))


@query(
    r"""with e as (select trim(unnest(regexp_split_to_array(taker_name || ',' || coalesce(repo_id, ''), '[\r\n,]+'))) as e from attempts where not research_opt_in and taker_name is not null),
v as (select distinct e as rid from e where regexp_matches(e, '^[A-Za-z0-9_-]{1,32}$') and not regexp_matches(e, '^[0-9]{7,}$'))
select assessment_id, count(*) as n from attempts where repo_id is null or repo_id not in (select rid from v) group by 1"""
)
def attempts_left(spark, d):
    """Attempts of each assessment that are left once those of ids that were handed in for exclusion are withdrawn."""
    a = read_table(spark, d, "attempts")
    entries = a.where("not research_opt_in and taker_name is not null").select(F.concat(F.col("taker_name"), F.lit(","), F.coalesce("repo_id", F.lit(""))).alias("entry"))
    return privacy.exclude(a, entries).groupBy("assessment_id").agg(F.count(F.lit(1)).alias("n"))


_SAFE = "case when json_valid(j) then list_sort(json_keys(j)) end"


@query(
    f"""with r as (select id, j, list_sort(list_filter(list_transform(json_keys(j), lambda x: lower(x)), lambda x: list_contains({privacy.FORBIDDEN_KEYS!r}, x))) as bad, list_filter(json_keys(j), lambda x: not list_contains({privacy.ALLOWED_KEYS!r}, x)) as unk from (select distinct id, score_json as j from attempts where json_valid(score_json)) where json_type(j) = 'OBJECT' and json_type(json(j)) = 'OBJECT')
select case when len(bad) > 0 then 'forbidden_key' when len(unk) > 0 then 'unknown_key' when {' or '.join("regexp_matches(j, '" + p.replace("'", "''") + "')" for p in privacy.DETECTORS.values())} then 'gives_away' else 'clean' end as problem, count(*) as n from r group by 1"""
)
def record_problems(spark, d):
    """Scores of attempts as research records: a forbidden key, an unknown one, or a value that gives something away."""
    a = without_repeats(read_table(spark, d, "attempts").select("id", F.col("score_json").alias("j")), "id").where("j is not null and ltrim(j) like '{%'")
    p = privacy.record_problem(F.col("j"))
    return a.where(F.expr("json_object_keys(j)").isNotNull()).groupBy(F.coalesce(p, F.lit("clean")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_CHUNKS}, ev as (select parent_id as id, chunk_id from ({nested_sql.evidence()}) where chunk_id is not null), q as (select id, min(project_id) as project_id, min(slot) as slot, min(stem) as stem from questions group by id),
k as (select q.id, list_sort(list_distinct(list(c.kind))) as kinds from q join ev using (id) left join (select distinct project_id, chunk_id, kind from chunks) c on c.project_id = q.project_id and c.chunk_id = ev.chunk_id group by 1),
t as (select id, stem, coalesce(list_filter(kinds, lambda x: x is not null), []) as kinds, case id % 3 when 0 then 'interaction_flow' when 1 then 'contextual_use' else 'condition_outcome' end as template from q left join k using (id) where stem is not null)
select coalesce(case when regexp_matches(stem, '{rules.CODE_BLOCK}') then 'shows_code' when template <> 'condition_outcome' and not list_has_any(kinds, {list(rules.OPERATIONS)!r}) then 'no_operation'
when template = 'interaction_flow' and not list_has_any(kinds, {list(rules.PATHS)!r}) then 'no_path' when template = 'interaction_flow' and regexp_matches(stem, '{rules.CONDITION}') then 'one_condition' end, 'meets') as problem, count(*) as n from t group by 1"""
)
def evidence_problems(spark, d):
    """What templates ask of the kinds of evidence, held against the chunks that questions cite; a question's id picks its template."""
    s = _structured(spark, d, "project_id").where("stem is not null").groupBy("id").agg(F.min("project_id").alias("project_id"), F.min("stem").alias("stem"), F.min("chunks").alias("chunks"))
    kinds = _chunks(spark, d, ["id", "kind"]).where("id is not null").select("project_id", F.col("id").alias("chunk_id"), "kind").distinct()
    cited = s.select("id", "project_id", F.explode("chunks").alias("chunk_id")).join(kinds, ["project_id", "chunk_id"]).groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    template = F.when(F.col("id") % 3 == 0, "interaction_flow").when(F.col("id") % 3 == 1, "contextual_use").otherwise("condition_outcome")
    problem = rules.evidence_problem(template, F.lit("none"), F.col("stem"), F.coalesce("kinds", F.array().cast("array<string>")), F.lit(""))
    return s.select("id", "stem").join(cited, "id", "left").groupBy(F.coalesce(problem, F.lit("meets")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(*) as n_distinct, count(*) as n_well_formed from (select distinct id from attempts where id is not null)")
def record_ids(spark, d):
    """Random ids for released records: each its own, all of one form."""
    a = read_table(spark, d, "attempts").where("id is not null").select("id").distinct().select(privacy.random_record_id().alias("rid"))
    per = a.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.when(F.col("rid").rlike("^sr_[0-9a-f]{32}$"), F.col("n")).otherwise(0)).alias("n_well_formed"))


_TYPES_OF_TOPIC = f"(select topic_id, list_sort(list_distinct(flatten(list(p.evidence_types)))) as topic_types from {catalog.tables_sql()['topic_point'].replace('as v(', 'as tp(')} join {catalog.tables_sql()['point'].replace('as v(', 'as p(')} on p.point_id = tp.point_id group by 1)"


@query(
    f"""select template_id, topic_id, array_to_string(case when len(list_intersect(evidence_types, topic_types)) > 0 then list_filter(evidence_types, lambda x: list_contains(topic_types, x)) else evidence_types end, ',') as types
from {catalog.tables_sql()['template']} cross join {_TYPES_OF_TOPIC} t"""
)
def narrowed_types(spark, d):
    """The evidence types that each template asks for under each topic; both are tables that people write."""
    from gaugeworks.operators.entities import narrowed

    t = catalog.tables(spark)
    topics = t["topic_point"].join(t["point"], "point_id").groupBy("topic_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence_types"))).alias("topic_types"))
    grid = t["template"].crossJoin(F.broadcast(topics))
    return grid.select("template_id", "topic_id", F.array_join(narrowed(F.col("evidence_types"), F.col("topic_types")), ",").alias("types"))


@query(
    f"""with {_CHUNKS}, c as (select distinct project_id, chunk_id, kind in ('callgraph', 'flow', 'import_graph', 'imports') or (kind = 'structure' and contains(text, '->')) as relational from chunks where chunk_id is not null and kind is not null and text is not null),
r as (select *, row_number() over (partition by project_id order by length(chunk_id), chunk_id, relational) as position from c), t as (select * from r where position <= 3),
s as (select project_id, max(position) as last, bool_or(relational) as has from t group by 1), b as (select project_id, arg_min(chunk_id, (position, chunk_id)) as chunk_id from r where relational group by 1)
select project_id, position::int as position, chunk_id from t union all select project_id, (last + 1)::int, chunk_id from s join b using (project_id) where not has"""
)
def relational_bundles(spark, d):
    """The first three chunks of each project, and one that shows relations if none of them does."""
    from pyspark.sql import Window

    from gaugeworks.operators.entities import assure_relational, relational

    c = _chunks(spark, d, ["id", "kind", "text"]).where("id is not null and kind is not null and text is not null")
    c = c.select("project_id", F.col("id").alias("chunk_id"), relational(F.col("kind"), F.col("text")).alias("relational")).distinct()
    placed = c.withColumn("position", F.row_number().over(Window.partitionBy("project_id").orderBy(F.length("chunk_id"), "chunk_id", "relational")))
    fallback = placed.where("relational").select("project_id", F.col("position").alias("rank"), "chunk_id")
    out = assure_relational(placed.where("position <= 3"), fallback, "project_id")
    return out.select("project_id", F.col("position").cast("int").alias("position"), "chunk_id")
