"""Privacy queries over documents, questions, attempts, events and customers."""

from pyspark.sql import functions as F

from gaugeworks.functions.repeats import without_repeats
from gaugeworks.operators import privacy
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ENTROPY = (
    "list_sum(list_transform(list_distinct(string_split(t, '')), lambda x: -(len(list_filter(string_split(t, ''), lambda y: y = x))::double / length(t)) * log2(len(list_filter(string_split(t, ''), lambda y: y = x))::double / length(t))))"
)
_TOKENS = f"list_filter(regexp_extract_all({{0}}, '{privacy.TOKEN}'), lambda t: regexp_matches(t, '[0-9]') and regexp_matches(t, '[A-Za-z]'))"


def _categories(c: str) -> str:
    c = f"coalesce({c}, '')"
    hits = [f"case when regexp_matches({c}, {_q(p)}) then '{n}' end" for n, p in privacy.DETECTORS.items()]
    hits.append(f"case when len(list_filter({_TOKENS.replace('{0}', c)}, lambda t: round({_ENTROPY}, 6) >= {privacy.ENTROPY_BITS})) > 0 then 'high_entropy' end")
    return f"list_sort(list_filter([{', '.join(hits)}], lambda x: x is not null))"


@query(f"select doc_id, array_to_string(c, ',') as categories from (select doc_id, {_categories('text')} as c from documents) where len(c) > 0")
def privacy_scan_docs(spark, d):
    return privacy.scan(read_table(spark, d, "documents"), "doc_id", ["text"]).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query(
    f"select id, array_to_string(list_sort(list_distinct(flatten([a, b]))), ',') as categories from (select id, {_categories('source')} as a, {_categories('chunks_json')} as b from (select distinct id, source, chunks_json from projects)) where len(a) + len(b) > 0"
)
def privacy_scan_projects(spark, d):
    rows = without_repeats(read_table(spark, d, "projects").select("id", "source", "chunks_json"), "id")
    return privacy.scan(rows, "id", ["source", "chunks_json"]).select("id", F.array_join("categories", ",").alias("categories"))


@query(f"select doc_id, t as token, round({_ENTROPY}, 4) as bits from (select doc_id, unnest({_TOKENS.replace('{0}', 'text')}) as t from documents where text is not null)")
def entropy_tokens(spark, d):
    from gaugeworks.functions.text import entropy_bits

    found = F.regexp_extract_all("text", F.lit(f"({privacy.TOKEN})"), F.lit(1))
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(found).alias("token"))
    return t.where(F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")).select("doc_id", "token", F.round(entropy_bits(F.col("token")), 4).alias("bits"))


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


@query(
    f"""with k as (select id, list_sort(json_keys(stats_json)) as ks from (select distinct id, stats_json from projects) where stats_json is not null and json_valid(stats_json)),
m as (select ks, list_sort(list_intersect(list_transform(ks, lambda x: lower(x)), {_list(privacy.FORBIDDEN_KEYS)})) as bad, list_sort(list_filter(ks, lambda x: not list_contains({_list(privacy.ALLOWED_KEYS)}, x))) as unk from k)
select case when len(bad) > 0 then 'forbidden:' || array_to_string(bad, ',') when len(unk) > 0 then 'unknown:' || array_to_string(unk, ',') else 'clean' end as problem, count(*) as n from m group by all"""
)
def payload_key_check(spark, d):
    rows = read_table(spark, d, "projects").select("id", "stats_json").distinct().where("stats_json is not null")
    keys = rows.select(F.expr("json_object_keys(stats_json)").alias("ks")).where("ks is not null")
    return keys.select(F.coalesce(privacy.key_problem(F.col("ks")), F.lit("clean")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with g as (select epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as s from events),
b as (select case when s is null or s < 0 then 'unknown' when s < 30 then 'under_30s' when s < 90 then '30_90s' when s < 180 then '90_180s' when s < 300 then '180_300s' else 'over_300s' end as band from g)
select band, count(*) as n from b group by band"""
)
def duration_bands(spark, d):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    lag = (micros(F.col("ts")) - micros(before)).cast("double") / 1_000_000
    return read_table(spark, d, "events").select(privacy.duration_band(lag).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with w as (select user_id, epoch_us(ts) as t, min(epoch_us(ts)) over (partition by user_id) as a, max(epoch_us(ts)) over (partition by user_id) as b from events),
p as (select case when b = a then null else (t - a)::double / (b - a)::double end as part from w)
select case when part is null or part < 0 or part > 1 then 'unknown' when part <= 1.0/3 then 'early' when part <= 2.0/3 then 'middle' else 'late' end as period, count(*) as n from p group by 1"""
)
def completion_period(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    # the window of each user is an aggregate, joined back: no user's events have to be sorted
    span = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    period = privacy.completion_period(F.col("t"), F.col("a"), F.col("b"))
    return e.join(span, "user_id").select(period.alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with c as (select n_name as nation, c_mktsegment as segment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all),
g as (select nation, segment from (select distinct n_name as nation from nation), (select distinct c_mktsegment as segment from customer)),
f as (select nation, segment, coalesce(n, 0) as n, coalesce(n, 0) < 5 as small from g left join c using (nation, segment)),
r as (select *, sum(small::int) over (partition by nation) as smalls, sum((not small)::int) over (partition by nation) as rel, row_number() over (partition by nation, small order by n, segment) as rk, sum(n) over (partition by nation) as total from f),
h as (select *, small or (smalls = 1 and rel > 0 and not small and rk = 1) as hidden from r)
select nation, segment, case when not hidden and total >= 5 then n end as n, hidden as suppressed, total >= 5 as reportable from h"""
)
def suppressed_cells(spark, d):
    customer, nation = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    counts = customer.join(nation, customer.c_nationkey == nation.n_nationkey).groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    full = privacy.dense(counts, nation.select(F.col("n_name").alias("nation")), customer.select(F.col("c_mktsegment").alias("segment")), "nation", "segment", "n")
    return privacy.suppressed_cells(full, "nation", "segment", "n")


@query(
    r"""with e as (select trim(unnest(regexp_split_to_array(taker_name || ',' || coalesce(repo_id, ''), '[\r\n,]+'))) as e from attempts where not research_opt_in and taker_name is not null),
p as (select e, case when regexp_matches(e, '^[A-Za-z0-9_-]{1,32}$') and not regexp_matches(e, '^[0-9]{7,}$') then e end as rid from e),
v as (select distinct rid from p where rid is not null),
a as (select repo_id as rid, count(*) as n from attempts where coalesce(repo_id, '') <> '' group by 1)
select (select coalesce(sum(n), 0) from v left join a using (rid))::bigint as excluded_attempts, (select count(*) from v left join a using (rid) where n is null) as unmatched_ids, (select count(*) from p where rid is null and e <> '') as invalid_entries"""
)
def optout_audit(spark, d):
    attempts = read_table(spark, d, "attempts")
    # those who didn't opt in hand in their name and id
    entries = attempts.where("not research_opt_in and taker_name is not null").select(F.concat(F.col("taker_name"), F.lit(","), F.coalesce("repo_id", F.lit(""))).alias("entry"))
    return privacy.exclusion_audit(entries, attempts)


@query(
    " union all ".join(
        f"select '{t}' as file, count(*) as n_rows, coalesce(sum(('0x' || substr(sha256(coalesce({c}::varchar, '')), 1, 12))::bigint % 1000000007), 0)::bigint as checksum, '1' as schema_version, '1' as deid_rule_version, '1' as suppression_rule_version from {t}"
        for t, c in (("attempts", "responses_json"), ("questions", "stem"), ("documents", "text"))
    )
)
def export_manifest(spark, d):
    checked = {"attempts": "responses_json", "questions": "stem", "documents": "text"}
    return privacy.manifest({t: read_table(spark, d, t) for t in checked}, checked)


@query("select strftime(submitted_at, '%Y-%m-%d %H') as hour, count(*) as n from attempts where submitted_at is not null and coalesce(trim(repo_id), '') <> '' group by 1")
def hour_completions(spark, d):
    a = read_table(spark, d, "attempts").where("submitted_at is not null and coalesce(trim(repo_id), '') <> ''")
    return a.groupBy(F.date_format("submitted_at", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select repo_id, case when regexp_matches(s, '^[0-9]{7,}$') then '' else s end as cleaned, count(*) as n from (select repo_id, substr(regexp_replace(coalesce(repo_id, ''), '[^A-Za-z0-9_-]', '', 'g'), 1, 32) as s from attempts) group by all"
)
def repo_id_sanitised(spark, d):
    a = read_table(spark, d, "attempts")
    return a.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n")).select("repo_id", privacy.sanitised_repo_id(F.col("repo_id")).alias("cleaned"), "n")


_TERMS = ["payout", "scan_token", "rubric"]


@query(
    f"select doc_id, term from (select doc_id, regexp_split_to_array(' ' || lower(coalesce(text, '')) || ' ', '[^A-Za-z0-9_]+') as w from documents), (values {', '.join(f'({_q(t)})' for t in _TERMS)}) v(term) where list_contains(w, term)"
)
def forbidden_terms(spark, d):
    return privacy.with_forbidden_terms(read_table(spark, d, "documents"), "doc_id", "text", _TERMS)
