"""Retrieval and text queries over documents and evaluation items."""

from pyspark.sql import functions as F

from gaugeworks.functions.spread import spread
from gaugeworks.functions.text import TOKENS_SQL, identifiers, with_parts
from gaugeworks.operators import bm25, catalog
from gaugeworks.plans.registry import query
from gaugeworks.sources import read_table

_CORPUS = "select doc_id, coalesce(text, '') as text from documents"
_ITEMS = "select item_id as query_id, coalesce(text, '') as text from eval_items"
_TOP = "select query_id, rank::int as rank, doc_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from scored) where rank <= {k}"


def _corpus(spark, d, keep=()):
    return bm25.documents_as_corpus(read_table(spark, d, "documents"), keep=keep)


def _items(spark, d):
    return read_table(spark, d, "eval_items")


@query(bm25.score_sql(_CORPUS, _ITEMS) + _TOP.format(k=6))
def bm25_topk(spark, d):
    return bm25.search(_corpus(spark, d), bm25.query_terms(_items(spark, d), "item_id", "text"), 6)


_LEX = catalog.tables_sql()["lexicon"]
_FIRED = (
    f"select q.query_id, concept, ordinal, aliases from (select item_id as query_id, array_to_string({TOKENS_SQL.format('text')}, ' ') as joined from eval_items) q, "
    f"{_LEX} where len(list_filter(triggers, lambda t: contains(joined, t))) > 0"
)


@query(
    bm25.score_sql(_CORPUS, _ITEMS, f"select query_id, term, 1.0 as weight from (select distinct query_id, unnest(aliases) as term from ({_FIRED}))") + _TOP.format(k=6)
)
def bm25_expanded(spark, d):
    items = _items(spark, d)
    fired = catalog.expand_concepts(items, "item_id", "text", catalog.tables(spark)["lexicon"])
    alias = fired.select(F.col("id").alias("query_id"), F.explode("aliases").alias("term")).distinct().withColumn("weight", F.lit(1.0))
    terms = bm25.with_expansion(bm25.query_terms(items, "item_id", "text"), alias)
    return bm25.search(_corpus(spark, d), terms, 6)


@query(
    bm25.score_sql("select doc_id, coalesce(text, '') as text, lang, source from documents", _ITEMS, keep="lang, source")
    + "select query_id, rank::int as rank, doc_id, lang, score from (select query_id, s.doc_id, l.lang, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, s.doc_id) as rank "
    "from scored s join lengths l using (doc_id) where l.lang in ('en', 'de') and coalesce(l.source, '') <> 'forum' and s.doc_id % 97 <> 0) where rank <= 6"
)
def bm25_filtered(spark, d):
    """Kinds, and documents that were excluded: here every one whose id 97 divides."""
    allowed = F.col("lang").isin("en", "de") & (F.coalesce("source", F.lit("")) != "forum") & (F.col("doc_id") % 97 != 0)
    terms = bm25.query_terms(_items(spark, d), "item_id", "text")
    return bm25.search(_corpus(spark, d, ("lang", "source")), terms, 6, where=allowed, keep=("lang",))


@query(
    bm25.score_sql(_CORPUS, _ITEMS) + ", ranked as (" + _TOP.format(k=12) + "), placed as (select *, ((rank - 1 - query_id % 5) % n + n) % n + 1 as place from (select *, count(*) over (partition by query_id) as n from ranked)) "
    "select query_id, rank, doc_id, score, place::int as place from placed where place <= 2"
)
def bm25_bundle_rotate(spark, d):
    ranked = bm25.search(_corpus(spark, d), bm25.query_terms(_items(spark, d), "item_id", "text"), 12)
    return bm25.rotate(ranked, F.col("query_id").cast("int") % 5, 2)


@query(
    f"with t as (select doc_id, unnest({TOKENS_SQL.format('text')}) as token from documents where text is not null) "
    "select token, count(distinct doc_id) as df, count(*) as cf from t group by token order by cf desc, token limit 100"
)
def token_stats(spark, d):
    docs = spread(read_table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", identifiers(F.col("text")).alias("f")).select("doc_id", with_parts(F.col("f")).alias("t"))
    # one count per document and token first: the second step needs no distinct
    per = docs.select("doc_id", F.explode("t").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")).orderBy(F.desc("cf"), "token").limit(100)


@query(
    f"select doc_id, concept, ordinal, array_to_string(aliases, ',') as aliases from (select doc_id, array_to_string({TOKENS_SQL.format('text')}, ' ') as joined from documents where text is not null), "
    f"{_LEX} where len(list_filter(triggers, lambda t: contains(joined, t))) > 0"
)
def concept_expansion(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    fired = catalog.expand_concepts(docs, "doc_id", "text", catalog.tables(spark)["lexicon"])
    return fired.select(F.col("id").alias("doc_id"), "concept", "ordinal", F.array_join("aliases", ",").alias("aliases"))


@query(
    bm25.score_sql(_CORPUS, _ITEMS) + ", ranked as (" + _TOP.format(k=4) + "), rare as (select * from ranked where query_id % 5 > 0 or rank <= 1), rest as (select q.query_id, 1000000 as rank, c.doc_id, 0.0::double as score "
    "from (select distinct query_id from rare) q, (select doc_id from documents order by doc_id limit 8) c where not exists (select 1 from rare r where r.query_id = q.query_id and r.doc_id = c.doc_id)) "
    "select query_id, r::int as rank, doc_id, score from (select *, row_number() over (partition by query_id order by rank, doc_id) as r from (select * from rare union all select * from rest)) where r <= 4"
)
def bm25_fill(spark, d):
    """Ranked documents, of every fifth query the first alone, filled up to four with unscored ones."""
    corpus, items = _corpus(spark, d), _items(spark, d)
    ranked = bm25.search(corpus, bm25.query_terms(items, "item_id", "text"), 4)
    few = ranked.where((F.col("query_id") % 5 > 0) | (F.col("rank") <= 1))
    return bm25.fill(few, few.select("query_id"), corpus, 4)
