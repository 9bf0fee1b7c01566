"""Queries over the structure of projects and documents: chunks, graphs, segments, targets."""

from pyspark.sql import functions as F

from gaugeworks.functions.repeats import without_repeats
from gaugeworks.functions.text import TOKENS_SQL, tokens
from gaugeworks.operators import alignment, bm25, entities, evidence, graph, quality, records
from gaugeworks.plans import nested_sql
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table

_CHUNKS = """chunks as (select project_id, c.id as chunk_id, c.kind as kind, c.text as text, c.file as file from (select id as project_id, unnest(from_json(chunks_json, '[{"id":"VARCHAR","kind":"VARCHAR","text":"VARCHAR","file":"VARCHAR"}]')) as c from (select distinct id, chunks_json from projects)))"""
_EDGES = """lines as (select project_id, unnest(string_split(text, chr(10))) as line from chunks where kind = 'callgraph'),
edges as (select distinct project_id, trim(string_split(line, '->')[1]) as src, trim(string_split(line, '->')[2]) as dst from lines where contains(line, '->') and not contains(line, '(caller')),
funcs as (select distinct project_id, string_split(src, '::')[1] as file, string_split(src, '::')[2] as name from edges),
own as (select e.project_id, e.src, f.file || '::' || f.name as own_id, e.dst from edges e left join funcs f on f.project_id = e.project_id and f.file = string_split(e.src, '::')[1] and f.name = e.dst),
uniq as (select project_id, name, min(file || '::' || name) as other_id from funcs group by 1, 2 having count(*) = 1),
calls as (select distinct o.project_id, o.src, coalesce(own_id, other_id) as dst from own o left join uniq u on u.project_id = o.project_id and u.name = o.dst where coalesce(own_id, other_id) is not null),
bare as (select distinct project_id, string_split(src, '::')[2] as src, dst from edges where contains(src, '::'))"""


def _chunks(spark, d, fields):
    return evidence.chunks(without_repeats(read_table(spark, d, "projects").select("id", "chunks_json"), "id"), fields)


def _listed(spark, d):
    """The edges of the listings: (project_id, src, dst)."""
    text = _chunks(spark, d, ["kind", "text"]).where("kind = 'callgraph'")
    body = text.withColumn("text", F.regexp_replace("text", r"^[^\n]*\(caller[^\n]*\n?", ""))
    return graph.arrows(body, ["project_id"], "text")


def _calls(spark, d):
    edges = _listed(spark, d)
    part = F.split("src", "::")
    functions = edges.select("project_id", part[0].alias("file"), F.try_element_at(part, F.lit(2)).alias("name")).where("name is not null")
    return graph.resolve_calls(edges.select("project_id", F.col("src").alias("caller"), F.col("dst").alias("callee")), functions, "project_id").select("project_id", F.col("caller").alias("src"), F.col("callee_id").alias("dst"))


@query(f"with {_CHUNKS}, {_EDGES} select * from calls")
def call_edges(spark, d):
    return _calls(spark, d)


def _names(spark, d):
    """Edges between bare names, as a reader of the listing sees them."""
    return _listed(spark, d).select("project_id", F.try_element_at(F.split("src", "::"), F.lit(2)).alias("src"), "dst").where("src is not null").distinct()


@query(f"with {_CHUNKS}, {_EDGES} select distinct project_id, src as node from bare c where not exists (select 1 from bare x where x.project_id = c.project_id and x.dst = c.src)")
def entry_points(spark, d):
    return graph.entry_points(_names(spark, d), ["project_id"])


@query(
    f"with recursive {_CHUNKS}, {_EDGES}, r as (select project_id, src as start, src as node, 0 as depth from (select distinct project_id, src from bare) c where not exists (select 1 from bare x where x.project_id = c.project_id and x.dst = c.src) "
    "union select r.project_id, r.start, c.dst, r.depth + 1 from r join bare c on c.project_id = r.project_id and c.src = r.node where r.depth < 4) "
    "select project_id, start, node, min(depth)::int as depth from r group by all"
)
def reach_depth(spark, d):
    from gaugeworks.functions.materialise import materialise

    names = materialise(_names(spark, d))
    return graph.reach(names, graph.entry_points(names, ["project_id"]), ["project_id"]).select("project_id", "start", "node", F.col("depth").cast("int").alias("depth"))


@query(
    f"with {_CHUNKS} select dependency, count(*) as n_projects from (select distinct project_id, trim(unnest(string_split(text, chr(10))[2:])) as dependency from chunks where kind = 'dependencies') where dependency <> '' group by 1"
)
def dependency_usage(spark, d):
    c = _chunks(spark, d, ["kind", "text"]).where("kind = 'dependencies'")
    each = c.select("project_id", F.explode(evidence.dependencies(F.col("text"))).alias("dependency")).distinct()
    return each.groupBy("dependency").agg(F.count(F.lit(1)).alias("n_projects"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


@query(
    f"with {_CHUNKS} select kind, count(*) as n_chunks, {', '.join(f'sum({_count(p)})::bigint as {n}' for n, p in evidence.CONSTRUCTS.items())} from chunks where file <> '' group by kind"
)
def construct_counts(spark, d):
    c = _chunks(spark, d, ["kind", "text", "file"]).where("file <> ''")
    counts = c.select("kind", *evidence.construct_counts(F.col("text")))
    return counts.groupBy("kind").agg(F.count(F.lit(1)).alias("n_chunks"), *[F.sum(n).cast("bigint").alias(n) for n in evidence.CONSTRUCTS])


@query(
    "with p as (select distinct id, stats_json from projects where json_valid(stats_json)), l as (select id, unnest(json_keys(stats_json, '$.files_by_language')) as language, stats_json from p) "
    "select language, count(*) as n_projects, sum(coalesce(try_cast(json_extract_string(stats_json, '$.files_by_language.\"' || language || '\"') as bigint), 0))::bigint as n_files from l group by 1"
)
def language_histogram(spark, d):
    p = read_table(spark, d, "projects").select("id", "stats_json").distinct()
    m = F.from_json("stats_json", "files_by_language map<string,bigint>")["files_by_language"]
    return p.select(F.explode(m).alias("language", "n")).groupBy("language").agg(F.count(F.lit(1)).alias("n_projects"), F.sum("n").cast("bigint").alias("n_files"))


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents where text is not null),
n as (select *, row_number() over (partition by doc_id order by no) - 1 as r from l where trim(line) <> '')
select doc_id, (r // 60)::int as segment, min(no)::int as start_line, max(no)::int as end_line, count(*)::int as n_lines, md5(string_agg(line, chr(10) order by no)) as content_md5 from n where r < 240 group by doc_id, r // 60"""
)
def segment_lines(spark, d):
    s = evidence.segments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return s.select("doc_id", "segment", "start_line", "end_line", "n_lines", F.md5("content").alias("content_md5"))


@query(
    r"""with b as (select doc_id, unnest(string_split(text, chr(10))) as block, generate_subscripts(string_split(text, chr(10)), 1) - 1 as position from documents where text is not null),
s as (select *, regexp_replace(block, '^\s+|\s+$', '', 'g') as st from b),
k as (select *, regexp_replace(trim(replace(lower(block), 'ß', 'ss')), '\s+', ' ', 'g') as norm from s
 where not regexp_matches(st, '^#{1,6} ') and not (regexp_matches(st, ':$') and length(st) < 60) and not regexp_matches(lower(st), '^(total|sum|overall)([^a-z0-9_]|$)') and regexp_matches(st, '[A-Za-zÀ-ÿ\x{4E00}-\x{9FFF}]')),
f as (select *, row_number() over (partition by doc_id, norm order by position) as dd from k),
m as (select *, list_max(list_transform(regexp_extract_all(lower(block), '([0-9]+(?:\.[0-9]+)?) ?(?:marks?|points?|pts|%)', 1), lambda x: x::double)) as top from f where dd = 1),
w as (select *, round(1.0 + case when top is not null then least(top / 3, 3.85) else 0.0 end, 2)::double as weight, regexp_replace(regexp_replace(block, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as flat from m),
r as (select *, row_number() over (partition by doc_id order by -weight, position) as r, coalesce(nullif(regexp_extract(flat, '^(.*?[.!?])( |$)', 1), ''), flat) as line from w)
select doc_id, 't' || (r - 1) as target_id, case when length(line) <= 110 then line else substr(line, 1, 107) || '...' end as label, md5(block) as description_md5, weight from r where r <= 48"""
)
def target_extract(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "block")).withColumn("base", F.lit(1.0)).withColumn("explicit", F.lit(False))
    t = alignment.build_targets(lines, "doc_id", "explicit")
    return t.select("doc_id", "target_id", "label", F.md5("description").alias("description_md5"), "weight")


def _blocks_sql() -> str:
    strip = lambda x: f"regexp_replace({x}, '^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$', '', 'g')"
    last = lambda x: f"string_split({x}, chr(2))[-1]"
    bullet = "'^[ \\t]*([-*•▪◦]|[0-9]+[.)]|[A-Za-z][.)])[ \\t\\f\\v]+'"
    grown = f"case when acc = '' or right(acc, 1) = chr(2) then acc || x when regexp_matches(x, '^$') then acc else acc || ' ' || x end"
    fold = (
        f"case when x = '' then acc || chr(2) when regexp_matches(x, {bullet}) then acc || chr(2) || regexp_replace(x, {bullet}, '') when right(x, 1) = ':' and length(x) < 100 then acc || chr(2) || x "
        f"else {grown} || case when length({last('(' + grown + ')')}) >= {alignment.FLUSH_CHARS} then chr(2) else '' end end"
    )
    pack = f"case when length({last('acc')}) + 1 + length(x) > {alignment.SPLIT_CHARS} then acc || chr(2) || x else acc || ' ' || x end"
    sentences = "string_split(regexp_replace(b, '([.!?])[ \\t\\f\\v]+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"""with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) as ls from documents where text is not null),
g as (select doc_id, list_filter(list_transform(string_split(list_reduce(list_prepend('', ls), lambda acc, x: {fold}), chr(2)), lambda x: {strip('x')}), lambda x: length(x) >= {alignment.LEAST_CHARS}) as bs from l),
p as (select doc_id, flatten(list_transform(bs, lambda b: case when length(b) > {alignment.SPLIT_CHARS} then string_split(list_reduce({sentences}, lambda acc, x: {pack}), chr(2)) else [b] end)) as ps from g)
select doc_id, (generate_subscripts(ps, 1) - 1)::int as position, unnest(ps) as block from p"""


@query(_blocks_sql())
def target_blocks(spark, d):
    """Paragraphs and bullets of the documents, as a reader would take them."""
    return alignment.blocks(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


_CORPUS = "select doc_id, coalesce(text, '') as text from documents"
_ITEMS = "select item_id as query_id, coalesce(text, '') as text from eval_items"


@query(
    bm25.score_sql(_CORPUS, _ITEMS)
    + f""", ranked as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from scored),
top as (select * from ranked where rank <= 4), it as (select query_id, list_distinct({TOKENS_SQL.format('text')}) as q from ({_ITEMS})), dt as (select doc_id, list_distinct(toks) as t from corpus),
o as (select query_id, score, len(list_intersect(q, t)) as overlap from top join it using (query_id) join dt using (doc_id))
select query_id, case when max(score) >= 2.0 or max(overlap) >= 3 then 'strong' when max(score) > 0 or max(overlap) > 0 then 'partial' else 'unmatched' end as coverage, max(score) as best_score, max(overlap)::int as best_overlap from o group by 1"""
)
def target_coverage(spark, d):
    corpus = bm25.documents_as_corpus(read_table(spark, d, "documents"))
    items = read_table(spark, d, "eval_items")
    top = bm25.search(corpus, bm25.query_terms(items, "item_id", "text"), 4)
    q = items.select(F.col("item_id").alias("query_id"), F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("q"))
    both = top.join(q, "query_id").join(corpus.select("doc_id", F.array_distinct("tokens").alias("t")), "doc_id")
    scored = both.select("query_id", "score", F.size(F.array_intersect("q", "t")).alias("overlap"))
    return alignment.coverage(scored, "query_id")


_ALIGNED = f"""with q as (select id, min(project_id) as g, min(stem) as stem from questions group by id), a as (select id, min(project_id) as g, min(title) as title, min(status) as status, 1.0 + id % 3 as weight from assessments group by id),
listed as (select distinct id, key from ({nested_sql._ids('assessments', 'question_ids_json', 'created_at', nested_sql._each("(case when json_type(v) = 'OBJECT' then coalesce(json_extract(v, '$.question_ids'), json_extract(v, '$.ids')) else v end)", 'question_id', 'id')).replace('id as ref_id', 'id')}) where key is not null),
has as (select g, bool_or(status = 'published') as scoped from a group by g), kept as (select a.* from a join has using (g) where coalesce(status = 'published', false) or not coalesce(scoped, false)),
qk as (select g, id as question_id, 'w:' || unnest(list_distinct({TOKENS_SQL.format("coalesce(stem, '')")})) as k, 1 as n from q union all select g, id, 'e:' || id, 4 from q),
tk as (select g, id as target_id, weight, 'w:' || unnest(list_distinct({TOKENS_SQL.format("coalesce(title, '')")})) as k from kept union all select g, kept.id, weight, 'e:' || key from kept join listed using (id)),
h as (select question_id, target_id, weight, sum(n) as overlap from qk join tk using (g, k) group by all),
f as (select question_id, target_id, overlap::int as overlap from h qualify row_number() over (partition by question_id order by overlap desc, weight desc, target_id) = 1),
ids as (select g, list_sort(list_distinct(list(id))) as ids from kept group by g)
select * from f union all select q.id, ids[q.id % len(ids) + 1], 0 from q join ids using (g) where q.id not in (select question_id from f)"""


@query(_ALIGNED)
def question_alignment(spark, d):
    """Each question's assessment in its project, by words and by its own id among the listed ones; published ones first."""
    q = read_table(spark, d, "questions").where("id is not null").groupBy(F.col("id").alias("question_id")).agg(F.min("project_id").alias("group"), F.min("stem").alias("text"))
    q = q.select("*", F.array(F.col("question_id").cast("string")).alias("evidence"), F.col("question_id").alias("place"))
    table = read_table(spark, d, "assessments")
    lists = records.question_lists(table).groupBy("id").agg(F.collect_set(F.col("question_id").cast("string")).alias("evidence"))
    a = table.groupBy("id").agg(F.min("project_id").alias("group"), F.min("title").alias("text"), F.min("status").alias("status")).join(lists, "id", "left")
    targets = a.select("group", F.col("id").alias("target_id"), "text", "evidence", (F.lit(1.0) + F.col("id") % 3).alias("weight"), F.coalesce(F.col("status") == "published", F.lit(False)).alias("scope"))
    return alignment.align_to_targets(q, targets)


_NAMES = " union all ".join(f"select project_id, text, {i} as ord, '{k}' as kind, unnest(list_distinct(regexp_extract_all(text, '{p}', 1))) as value from chunks" for i, (k, p) in enumerate(entities.NAMES.items()))


@query(
    f"""with {_CHUNKS}, v as ({_NAMES}), c as (select id as project_id, list_distinct({TOKENS_SQL.format("coalesce(min(name), '')")}) as c from projects group by id),
s as (select v.project_id, ord, kind, value, 3 * len(list_intersect(c, {TOKENS_SQL.format('text')})) + len(list_intersect(c, {TOKENS_SQL.format('value')})) as score from v join c using (project_id)),
b as (select *, row_number() over (partition by project_id, kind, lower(value) order by score desc, value) as b from s),
r as (select *, row_number() over (partition by project_id order by score desc, ord, value) as rank from b where b = 1)
select project_id, rank::int as rank, kind, value, score::int as score from r"""
)
def entity_candidates(spark, d):
    names = read_table(spark, d, "projects").groupBy(F.col("id").alias("project_id")).agg(F.min("name").alias("context"))
    return entities.candidates(_chunks(spark, d, ["text"]).where("text is not null"), "project_id", names)


#: Groups of a bundle: the words added to a query, its documents' sources, how many of them, and whether they are required.
_GROUPS = [
    ("talk", "function call code", ("code_explanation", "review_comments", "forum"), 2, True),
    ("notes", "requirement stage task", ("lecture_notes", "assignment_spec"), 1, True),
    ("other", "report", (), 2, False),
]
_SOURCES = [x for g in _GROUPS for x in g[2]]
_MOST = 6


def _group_sql(name: str, words: str, sources: tuple, count: int) -> str:
    member = f"coalesce(source, '') in ({', '.join(repr(x) for x in sources)})" if sources else f"coalesce(source, '') not in ({', '.join(repr(x) for x in _SOURCES)})"
    score = bm25.score_sql("select doc_id, coalesce(text, '') as text, source from documents", f"select item_id as query_id, coalesce(text, '') || ' {words}' as text from eval_items", keep="source")
    return f"""select query_id, doc_id, '{name}' as grp, (((rank - 1 - query_id % 3) % n + n) % n + 1)::bigint as place from (select *, count(*) over (partition by query_id) as n from (
{score} select query_id, s.doc_id, row_number() over (partition by query_id order by round(score, 6) desc, s.doc_id) as rank from scored s join lengths l using (doc_id) where {member}) where rank <= {max(8, 4 * count)})"""


def _bundles_sql() -> str:
    order = " ".join(f"when '{g[0]}' then {i}" for i, g in enumerate(_GROUPS))
    counts = " ".join(f"when '{g[0]}' then {g[3]}" for g in _GROUPS)
    short = ", ".join(f"case when count(*) filter (grp = '{g[0]}') < {g[3]} then '{g[0]}' end" for g in _GROUPS if g[4])
    any_ = f"{bm25.score_sql(_CORPUS, _ITEMS)} select query_id, doc_id, 'fill' as grp, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as place from scored qualify place <= {4 * _MOST}"
    return f"""with listed as ({' union all '.join(f'select * from ({_group_sql(g[0], g[1], g[2], g[3])})' for g in _GROUPS)}),
taken as (select *, case grp {order} end as o from listed where place <= case grp {counts} end),
state as (select query_id, array_to_string(list_filter([{short}], lambda x: x is not null), ',') as missing from taken group by 1),
rest as (select query_id, doc_id, grp, place, 9 as o from ({any_}) a where not exists (select 1 from taken t where t.query_id = a.query_id and t.doc_id = a.doc_id)),
whole as (select query_id, row_number() over (partition by query_id order by o, place)::int as position, doc_id, grp from (select query_id, doc_id, grp, place, o from taken union all select * from rest))
select query_id, position, doc_id, grp as "group", null::varchar as missing from whole join state using (query_id) where missing = '' and position <= {_MOST}
union all select query_id, 0, null, null, missing from state where missing <> ''"""


@query(_bundles_sql())
def evidence_bundles(spark, d):
    """For each evaluation item two documents of code talk, one of notes, and further ones; candidates rotate by item."""
    corpus = bm25.documents_as_corpus(read_table(spark, d, "documents"), keep=("source",))
    items = read_table(spark, d, "eval_items").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    listed, known = None, bm25.vocabulary(corpus)
    for name, words, sources, count, _ in _GROUPS:
        of = F.coalesce("source", F.lit("")).isin(*(sources or _SOURCES))
        terms = bm25.query_terms(items.withColumn("text", F.concat("text", F.lit(f" {words}"))), "item_id", "text")
        k = max(8, 4 * count)
        ranked = bm25.rotate(bm25.search(corpus, terms, k, where=of if sources else ~of, known=known), F.col("query_id").cast("int") % 3, k)
        one = ranked.select("query_id", "doc_id", F.col("place").alias("rank"), F.lit(name).alias("group"))
        listed = one if listed is None else listed.unionByName(one)
    fill = bm25.search(corpus, bm25.query_terms(items, "item_id", "text"), 4 * _MOST, known=known).select("query_id", "doc_id", "rank", F.lit("fill").alias("group"))
    required, optional = ({g[0]: g[3] for g in _GROUPS if g[4] is want} for want in (True, False))
    return entities.bundles(listed.unionByName(fill), "query_id", required, optional, _MOST, fill="fill")


def _functions(spark, d):
    """(project_id, chunk_id, code) of the chunks that show a Python function."""
    c = _chunks(spark, d, ["id", "kind", "text", "file"]).where("kind = 'function'")
    return c.select("project_id", F.col("id").alias("chunk_id"), F.regexp_replace("text", r"(?s)^.*?\nCode:\n", "").alias("code"))


@query()
def branch_conditions(spark, d):
    """Conditions of the branches in Python functions, their negations and mutations."""
    return entities.branch_conditions(_functions(spark, d), ["project_id", "chunk_id"], "code")


@query()
def code_requirements(spark, d):
    """What Python functions demand of their callers."""
    return entities.requirements(_functions(spark, d), ["project_id", "chunk_id"], "code")


@query()
def display_code(spark, d):
    """Of each project the piece of code with a condition that fits its name best."""
    names = read_table(spark, d, "projects").groupBy(F.col("id").alias("project_id")).agg(F.min("name").alias("context"))
    return entities.display_pick(_functions(spark, d), names, "project_id")


@query()
def code_grounding(spark, d):
    """How many of the pieces to be shown stand line by line in the chunk they come from: all of them should."""
    code = _functions(spark, d)
    shown = display_code(spark, d).select("project_id", "chunk_id", F.col("text").alias("shown"))
    both = shown.join(code, ["project_id", "chunk_id"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(quality.lines_in_order("shown", "code")).alias("n_grounded"))


@query(
    r"""with a as (select id, min(title) as title from assessments group by id), p as (select id, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[*_`#>]', '', 'g'), '(?i)^(explain|describe|identify|understand|show|discuss) (how |what |why )?', '')) as plain from a)
select id, case when length(plain) > 64 or len(regexp_split_to_array(plain, '\s+')) > 8 or plain = '' then 'the project' else plain end as context from p"""
)
def compact_contexts(spark, d):
    """A short name of each assessment."""
    a = read_table(spark, d, "assessments").groupBy("id").agg(F.min("title").alias("title"))
    return a.select("id", entities.compact(F.coalesce("title", F.lit("")), F.lit("the project")).alias("context"))


_FRAMES = ["What does {subject} hand to {object}?", "Which rows reach {object} after {subject} ran?", "When does {subject} skip {detail}?"]


@query(
    f"""with c as (select id, project_id, min(title) as title from assessments group by all), s as (select id, map(['subject', 'object'], ['assessment ' || id, coalesce(title, 'nothing')]) as m, {_FRAMES!r}[(id % 3 + 1)::int] as frame from c),
r as (select id, replace(replace(frame, '{{subject}}', m['subject']), '{{object}}', m['object']) as stem from s)
select id, case when not regexp_matches(stem, '[{{][a-z_]+[}}]') then stem end as stem from r"""
)
def rendered_stems(spark, d):
    """Frames by turns, filled with what each assessment has; a frame with a place left open gives none."""
    a = read_table(spark, d, "assessments").groupBy("id", "project_id").agg(F.min("title").alias("title"))
    slots = F.create_map(F.lit("subject"), F.concat(F.lit("assessment "), F.col("id").cast("string")), F.lit("object"), F.coalesce("title", F.lit("nothing")))
    return a.select("id", entities.render(F.array(*map(F.lit, _FRAMES)), F.col("id"), slots).alias("stem"))


@query()
def flow_trees(spark, d):
    """The tree of calls below each entry point of a project, as a reader sees it."""
    names = _names(spark, d)
    return graph.flow_trees(names, graph.entry_points(names, ["project_id"]), "project_id")


@query(
    f"""with {_CHUNKS}, l as (select project_id, kind, unnest(string_split(text, chr(10))) as line from chunks where text is not null and kind is not null),
p as (select project_id, list_transform(string_split(replace(line, '→', '->'), '->'), lambda x: substr(regexp_replace(regexp_replace(regexp_replace(string_split(x, ';')[1], ' *[(]lines? [0-9, -]+[)] *$', ''), '[`''"]', '', 'g'), '^[ \\t]+|[ \\t]+$', '', 'g'), 1, 100)) as ps from l where contains(line, '->') or contains(line, '→')),
e as (select project_id, unnest(range(1, len(ps))) as i, ps from p), r as (select distinct project_id, ps[i] as src, ps[i + 1] as dst from e where ps[i] <> '' and ps[i + 1] <> '' and ps[i] <> ps[i + 1])
select project_id, (min((src, dst))).a as src, (min((src, dst))).b as dst from (select project_id, struct_pack(a := src, b := dst) as x, src, dst from r) group by project_id, lower(src), lower(dst)"""
    .replace("(min((src, dst))).a", "min(x).a").replace("(min((src, dst))).b", "min(x).b")
)
def chunk_relations(spark, d):
    """Relations that the chunks of a project state by arrows or outlines, one for each in any case."""
    c = _chunks(spark, d, ["kind", "text"]).where("text is not null and kind is not null")
    return graph.relations(c, ["project_id"], "kind", "text")
