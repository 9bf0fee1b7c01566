"""Scoring, review and retention queries."""

from pyspark.sql import functions as F

from gaugeworks.functions.repeats import without_repeats
from gaugeworks.operators import quality, review, rules
from gaugeworks.plans import nested_sql
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table

# Two engines agree on half-way cases if the value is an exact ratio; a tiny lift makes both round it up.


@query(
    """with k as (select p_partkey, list_sort(list_distinct([substr(p_brand, -2, 1), substr(p_brand, -1, 1)])) as key from part),
a as (select l_orderkey, l_partkey, list_sort(list_distinct([l_returnflag, l_linestatus])) as sel from lineitem),
s as (select l_orderkey as attempt_id, sum((sel = key)::int)::bigint as n_correct, count(*) as n_total from a join k on l_partkey = p_partkey group by 1)
select attempt_id, n_correct, n_total, round(n_correct * 100.0 / n_total, 1)::double as percent from s"""
)
def score_attempts(spark, d):
    line, part = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    answers = line.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id"), F.array("l_returnflag", "l_linestatus").alias("selected"))
    brand = F.col("p_brand")
    keys = part.select(F.col("p_partkey").alias("question_id"), F.array(F.substring(brand, -2, 1), F.substring(brand, -1, 1)).alias("answer"))
    return quality.score_answers(answers, keys)


def _score_json_sql() -> str:
    given = f"select row_number() over () as rid, id, v from ({nested_sql.decoded('attempts', 'responses_json')})"
    letters, once = nested_sql._letters, nested_sql._once
    keys = "case when json_type(x) = 'OBJECT' then json_extract(x, '$.keys') else x end"
    return f"""with given as ({given}),
picked as (select rid, id, to_json(entry) as q, json_extract(v, '$."' || entry || '"') as x from (select *, unnest(json_keys(v)) as entry from given where json_type(v) = 'OBJECT')
union all select rid, id, json_extract(e, '$.question_id'), json_extract(e, '$.selected') from (select *, unnest(json_extract(v, '$[*]')) as e from given where json_type(v) = 'ARRAY') where json_type(e) = 'OBJECT'),
answered as (select distinct id as attempt_id, n as question_id, {once('ls')} as selected from (select id, {nested_sql.number('q')} as n, coalesce({letters('y')}, []) as ls from (select id, q, {keys} as y from picked)) where n is not null),
keys as (select id as question_id, min({once('ls')}) as answer from (select id, coalesce({letters('v')}, []) as ls from ({nested_sql.decoded('questions', 'answer_json')}) where json_type(v) in ('ARRAY', 'VARCHAR')) group by id),
g as (select attempt_id, sum((list_sort(selected) = list_sort(answer))::int)::bigint as n_correct, count(*) as n_total from answered join keys using (question_id) group by 1)
select attempt_id, n_correct, n_total, round(n_correct * 100.0 / n_total, 1)::double as percent from g"""


@query(_score_json_sql())
def score_attempts_json(spark, d):
    """Attempts scored from their responses against the answers of their questions."""
    from gaugeworks.operators.scoring import responses, answer_keys

    return quality.score_answers(responses(read_table(spark, d, "attempts")), answer_keys(read_table(spark, d, "questions")))


@query(
    "select p_brand as focus, sum((l_returnflag = 'R')::int)::bigint as n_correct, count(*) as n_total from lineitem join part on l_partkey = p_partkey group by 1"
)
def focus_breakdown(spark, d):
    line, part = read_table(spark, d, "lineitem"), read_table(spark, d, "part")
    joined = line.join(part, line.l_partkey == part.p_partkey).select(F.array("p_brand").alias("focus_areas"), (F.col("l_returnflag") == "R").alias("correct"))
    return quality.focus_breakdown(joined)


@query(
    """with g as (select user_id, count(*) as n, count(*) filter (event_type = 'purchase') as approved, count(*) filter (event_type = 'error') as rejected, count(*) filter (event_type = 'click') as edited from events group by 1)
select *, case when approved + rejected > 0 then round(approved::double / (approved + rejected), 3) end as approval_rate, round(edited::double / n, 3) as edit_rate from g"""
)
def review_metrics(spark, d):
    return review.review_metrics(read_table(spark, d, "events"), "user_id", "event_type", "purchase", "error", "click")


@query(
    """with q as (select distinct project_id, id, status, generator, confidence from questions)
select project_id, count(*) as n, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'rejected') as rejected,
case when count(*) filter (status in ('approved', 'rejected')) > 0 then round(count(*) filter (status = 'approved')::double / count(*) filter (status in ('approved', 'rejected')), 3) end as approval_rate,
round(avg(case when confidence between 1 and 10 then confidence end), 3) as mean_confidence from q group by 1"""
)
def question_review(spark, d):
    q = read_table(spark, d, "questions").select("project_id", "id", "status", "generator", "confidence").distinct()
    done = F.count_if(F.col("status").isin("approved", "rejected"))
    g = q.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        review.rate(F.count_if(F.col("status") == "approved"), done).alias("approval_rate"), F.round(F.avg(quality.confidence(F.col("confidence"))), 3).alias("mean_confidence"),
    )
    return g


@query("select a.id, coalesce(n, 0) as n from (select distinct id from assessments) a left join (select assessment_id, count(*) as n from attempts group by 1) b on a.id = b.assessment_id")
def parent_child_counts(spark, d):
    return review.counts_with_zeros(read_table(spark, d, "assessments"), read_table(spark, d, "attempts"), "id", "assessment_id")


@query(
    """with l as (select o_orderkey as list_id, list(l_partkey order by l_linenumber, l_partkey) as ids from orders join lineitem on l_orderkey = o_orderkey group by 1),
e as (select list_id, unnest(ids) as p_partkey, generate_subscripts(ids, 1) - 1 as position from l)
select list_id, position::int as position, p_partkey, p_name from e join part using (p_partkey)"""
)
def ordered_lookup(spark, d):
    line = read_table(spark, d, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = line.groupBy(F.col("l_orderkey").alias("list_id")).agg(F.transform(rows, lambda x: x["l_partkey"]).alias("ids"))
    return review.ordered_lookup(lists, "list_id", "ids", read_table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@query("select p_partkey, case when exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A' and l_quantity > 49) then 'archived' else 'removed' end as outcome from part")
def archive_or_delete(spark, d):
    used = read_table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("u", F.lit(True))
    return read_table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.when(F.col("u"), "archived").otherwise("removed").alias("outcome"))


@query(
    """select c_custkey, count(o_orderkey) as n_orders, count(o_orderkey) > 0 and bool_and(coalesce(o_orderstatus, '') <> 'P') as passes from customer left join orders on o_custkey = c_custkey group by 1"""
)
def publish_gate(spark, d):
    orders = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.bool_and(F.coalesce("o_orderstatus", F.lit("")) != "P").alias("ok"))
    return read_table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("ok", F.lit(False)).alias("passes"))


@query(
    """with e as (select user_id, event_id % 200 + 1 as item, row_number() over (partition by user_id order by ts desc, event_id desc) as r, (value > 50) as good, event_id % 5 + 1 as diff from events),
w as (select user_id, max(case when r = 1 then case when good then least(diff + 1, 5) else greatest(diff - 1, 1) end end) as target, list_distinct(list(item)) as done from e group by 1),
c as (select user_id, target, p_partkey, row_number() over (partition by user_id order by abs(p_size % 5 + 1 - target), p_partkey) as k from w, part where not list_contains(done, p_partkey))
select user_id, target::int as target, p_partkey from c where k = 1"""
)
def adaptive_next(spark, d):
    from pyspark.sql import Window

    e = read_table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct((F.col("event_id") % 5 + 1).cast("int").alias("d"), (F.col("value") > 50).alias("g")), F.struct("ts", "event_id")).alias("x"))
    answered = e.select("user_id", (F.col("event_id") % 200 + 1).alias("p_partkey")).join(last, "user_id").select("user_id", "p_partkey", F.col("x.d").alias("last"), F.col("x.g").alias("good"))
    items = read_table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("difficulty"))
    return review.adaptive_next(items, answered, "p_partkey", "difficulty", "user_id", "last", "good")


@query("select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) where r <= 100")
def retention_100(spark, d):
    e = read_table(spark, d, "events").select("event_type", "event_id", "ts")
    return review.newest(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 100).select("event_type", "event_id")


@query("select o_custkey, o_orderkey, case when r = 1 then 'confirmed' else 'replaced' end as status from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)")
def latest_preview(spark, d):
    o = read_table(spark, d, "orders")
    top = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("latest"))
    return o.join(top, "o_custkey").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") == F.col("latest"), "confirmed").otherwise("replaced").alias("status"))


@query("select coalesce(repo_id, '') as repo_id, count(*) as n_withdrawn, count(*) filter (research_opt_in) as n_research from attempts group by 1")
def withdraw_counts(spark, d):
    a = read_table(spark, d, "attempts")
    return a.groupBy(F.coalesce("repo_id", F.lit("")).alias("repo_id")).agg(F.count(F.lit(1)).alias("n_withdrawn"), F.count_if("research_opt_in").alias("n_research"))


@query(
    "select id, case when confidence between 1 and 10 then confidence::int end as confidence, case when difficulty is null then 3 else least(greatest(floor((difficulty + coalesce(confidence, difficulty)) / 2)::int, 1), 5) end as midpoint from (select distinct id, confidence, difficulty from questions)"
)
def confidence_clean(spark, d):
    q = read_table(spark, d, "questions").select("id", "confidence", "difficulty").distinct()
    return q.select("id", quality.confidence(F.col("confidence")).alias("confidence"), quality.band_midpoint(F.col("difficulty"), F.coalesce("confidence", "difficulty")).alias("midpoint"))


def _questions_sql(more: str = "") -> str:
    """The structured questions in SQL: options in order, answers, justifications, number of pieces of evidence."""
    letters = nested_sql._letters("v")
    return f"""o as (select parent_id as id, list({{'key': child_key, 'text': text}} order by position) as options from ({nested_sql.option()}) group by 1),
a as (select id, coalesce({letters}, []) as answer from ({nested_sql.decoded('questions', 'answer_json')}) where json_type(v) = 'ARRAY'),
j as (select parent_id as id, map(list(child_key order by position), list(text order by position)) as why from ({nested_sql.justification()}) group by 1),
e as (select parent_id as id, count(*) as n_evidence from ({nested_sql.evidence()}) group by 1),
b as (select distinct id, regexp_replace(coalesce(stem, ''), '^\\s+|\\s+$', '', 'g') as stem, difficulty, coalesce(explanation, '') as explanation{more} from questions),
q as (select b.*, coalesce(options, []) as options, coalesce(answer, []) as answer, coalesce(why, map()) as why, coalesce(n_evidence, 0) as n_evidence, list_transform(coalesce(options, []), lambda o: regexp_replace(coalesce(o.text, ''), '^\\s+|\\s+$', '', 'g')) as texts,
len(coalesce(options, [])) as n, [chr(x::int) for x in range(65, 65 + least(len(coalesce(options, [])), 26)::int)] as letters from b left join o using (id) left join a using (id) left join j using (id) left join e using (id))"""


def _rules_sql() -> str:
    p = lambda x, r: f"regexp_matches({x}, '{getattr(rules, r)}')"
    wrong = "list_filter(options, lambda o: not list_contains(answer, o.key))"
    any_ = lambda xs, e: f"len(list_filter({xs}, lambda t: {e})) > 0"
    code = f"lower(array_to_string(regexp_extract_all(stem, '{rules.CODE_BLOCK}', 1), chr(10)))"
    text = "lower(array_to_string(texts, ' '))"
    named = f"list_transform(regexp_extract_all(explanation, '{rules.NAMED_ANSWER}', 1), lambda x: upper(x))"
    cases = {
        "h_short_stem": "length(stem) < 10", "h_exposed_id": p("stem", "EXPOSED"), "h_unseen_evidence": p("stem", "UNSEEN"), "h_option_count": "n not between 2 and 7",
        "h_option_keys": "list_transform(options, lambda o: o.key) <> letters", "h_blank_option": "list_contains(texts, '')", "h_same_options": "len(list_distinct(list_transform(texts, lambda t: lower(t)))) < n",
        "h_no_answer": "len(answer) = 0", "h_unknown_answer": any_("answer", "not list_contains(letters, t)"), "h_repeated_answer": "len(list_distinct(answer)) < len(answer)",
        "h_answer_count": "n > 0 and len(answer) not between 1 and n - 1", "h_explanation": any_(named, "not list_contains(answer, t)"), "h_difficulty": "difficulty is null or difficulty not between 1 and 5",
        "h_no_evidence": "n_evidence = 0", "s_subjective": p("stem", "SUBJECTIVE"), "s_vague": any_("texts", p("t", "VAGUE")),
        "s_lookup": f"{p('stem', 'LOOKUP')} or n >= 2 and not {any_('texts', 'not ' + p('t', 'BARE_NAME'))}", "s_broad": p("stem", "BROAD"), "s_hidden_condition": f"{p('stem', 'CONDITION')} and not {p('stem', 'CODE_BLOCK')}",
        "s_quoted_line": p("stem", "QUOTED_LINE"), "s_return_unseen": f"{p('stem', 'CODE_BLOCK')} and {p(text, 'RETURNS')} and not {p(code, 'RETURN')}",
        "s_return_none_unseen": f"{p('stem', 'CODE_BLOCK')} and {p(text, 'RETURNS_NONE')} and not {p(code, 'RETURN_NONE')}", "s_giveaway": any_(wrong, p("coalesce(t.text, '')", "GIVEAWAY")),
        "s_unproven": any_(wrong, p("coalesce(why[t.key], '')", "UNPROVEN")),
    }
    found = ", ".join(f"case when {c} then '{k}' end" for k, c in cases.items())
    return f"""with {_questions_sql()}, f as (select id, list_sort(list_filter([{found}], lambda x: x is not null)) as fs from q)
select id, array_to_string(list_filter(fs, lambda x: x[1] = 'h'), ',') as hard, array_to_string(list_filter(fs, lambda x: x[1] = 's'), ',') as soft, len(list_filter(fs, lambda x: x[1] = 'h')) = 0 as usable from f"""


_NESTED = ("options_json", "answer_json", "justifications_json", "evidence_json")


def _structured(spark, d, *more):
    keep = ("id", "stem", "difficulty", "explanation", *more)
    return rules.structured(without_repeats(read_table(spark, d, "questions").select(*keep, *_NESTED), "id"), keep)


@query(_rules_sql())
def rule_flags(spark, d):
    """The rules that each question breaks, by its own options, answers, justifications and evidence."""
    f = _structured(spark, d).select("id", rules.flags().alias("f"))
    soft = F.filter("f", lambda x: F.startswith(x, F.lit("s_")))
    hard = rules.hard(F.col("f"))
    return f.select("id", F.array_join(hard, ",").alias("hard"), F.array_join(soft, ",").alias("soft"), (F.size(hard) == 0).alias("usable"))


def _stems(spark, d):
    return read_table(spark, d, "questions").select("id", "stem").distinct()


_SETS = "with t as (select id as key, list_sort(list_distinct({0})) as tokens from (select distinct id, stem from questions)), c as (select tokens, min(key) as class_id, count(*) as n from t group by tokens)"


def _sets_sql() -> str:
    from gaugeworks.functions.text import TOKENS_SQL

    return _SETS.format(TOKENS_SQL.format("coalesce(stem, '')"))


@query(
    _sets_sql() + f", s as (select a.class_id as a, b.class_id as b, round(len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(list_concat(a.tokens, b.tokens))), 6) as similarity from c a join c b on a.class_id < b.class_id where len(a.tokens) > 0 and len(b.tokens) > 0 and len(b.tokens) >= len(a.tokens) * {quality.ALIKE} and len(a.tokens) >= len(b.tokens) * {quality.ALIKE}) select * from s where similarity >= {quality.ALIKE}"
)
def similar_pairs_jaccard(spark, d):
    classes, _ = quality.token_sets(_stems(spark, d), "id", "stem")
    return quality.alike(classes)


@query(_sets_sql() + " select key, class_id from t join c using (tokens)")
def similar_members(spark, d):
    return quality.token_sets(_stems(spark, d), "id", "stem")[1]


@query()
def similar_pairs_full(spark, d):
    """Of each question the most similar earlier one of its project, by order, words, options and evidence."""
    return quality.similar_questions(_structured(spark, d, "project_id"))[0]
