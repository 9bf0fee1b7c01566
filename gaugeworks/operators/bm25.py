"""BM25 retrieval.

The statistics are those of the whole corpus; filters come after. A document is one row, so it is scored where it stands:
the terms of the queries are broadcast as postings, an Arrow batch of documents is multiplied with them, and each
partition keeps only the best k of each query. No document and no score is exchanged but those. Scores are rounded
before they are ranked, so that ties between equal texts fall to the smaller id and not to the order of a sum.

Defined results: documents without a term of the query aren't ranked (``fill`` adds them after all others); null texts
count as empty; an empty corpus gives no rows; queries without terms give none.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.spread import spread
from gaugeworks.functions.text import identifiers, tokens, with_parts

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Weight of the terms that a query is expanded by.
EXPANSION = 0.35
#: Rows of a query table up to which it may be broadcast.
BROADCAST_TERMS = 200_000


def documents_as_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tokens, n_tokens, *keep)"""
    texts = spread(documents.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("_text")))
    # in two steps, so that the identifiers of a text are looked for once and not again for their parts
    found = texts.select("doc_id", *keep, identifiers(F.col("_text")).alias("_found"))
    return found.select("doc_id", *keep, with_parts(F.col("_found")).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, weight): how often each query has each term."""
    t = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(term, df, total): documents with each term, in one pass; the row of the null term has their number and length.

    Combined within a partition before anything is shuffled, and kept: it is as large as the vocabulary.
    """
    each = corpus.select("n_tokens", F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    total = F.sum(F.when(F.col("term").isNull(), F.col("n_tokens")))
    return materialise(each.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), total.alias("total")))


def statistics(vocabulary_: DataFrame) -> tuple[float, float]:
    """Number of documents and their mean length."""
    row = vocabulary_.where("term is null").first()
    return (row.df, row.total / row.df) if row else (0.0, 0.0)


def inverse_frequencies(vocabulary_: DataFrame, n_docs: float) -> DataFrame:
    """(term, idf); negative ones are lifted to a part of the mean over the whole vocabulary."""
    raw = vocabulary_.where("term is not null").select("term", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))


class _Postings:
    """The weighted terms of some queries as arrays, ready to be multiplied with documents."""

    def __init__(self, query: np.ndarray, term: list[str], weight: np.ndarray) -> None:
        self.ids, q = np.unique(query, return_inverse=True)
        self.number = {t: i for i, t in enumerate(dict.fromkeys(term))}
        t = np.fromiter((self.number[x] for x in term), np.int64, len(term))
        order = np.argsort(t, kind="stable")
        self.query, self.weight = q[order], weight[order]
        self.start = np.searchsorted(t[order], np.arange(len(self.number) + 1))

    def best(self, ids: np.ndarray, tokens: pa.ListArray, n_tokens: np.ndarray, k: int, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, doc_id, score) of the best k documents of each query."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        words = tokens.flatten().dictionary_encode()
        known = np.fromiter((self.number.get(w, -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if not len(known):
            return self.ids[:0], ids[:0], np.zeros(0)
        term = known[words.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(tokens.offsets.to_numpy())
        row = np.repeat(place, sizes)
        row, term = row[term >= 0], term[term >= 0]
        # how often each document has each term, then its part in the score of each query that asks for the term
        pair, count = np.unique(row * len(self.number) + term, return_counts=True)
        row, term = np.divmod(pair, len(self.number))
        length = K1 * (1 - B + B * n_tokens[order][row] / mean)
        part = count * (K1 + 1) / (count + length)
        uses = (self.start[1:] - self.start[:-1])[term]
        each = np.repeat(np.arange(len(term)), uses)
        at = np.arange(len(each)) - np.repeat(np.cumsum(uses) - uses, uses) + self.start[term][each]
        shape = len(self.ids), len(ids)
        cell = self.query[at] * len(ids) + row[each]
        score = np.bincount(cell, part[each] * self.weight[at], shape[0] * shape[1]).round(6)
        score[np.bincount(cell, minlength=len(score)) == 0] = -np.inf
        score = score.reshape(shape)
        # documents stand in the order of their ids, and equal scores keep it
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, top, 1)
        found = np.isfinite(value)
        return np.broadcast_to(self.ids[:, None], top.shape)[found], ids[order][top[found]], value[found]


def first_of_each(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k rows of each query; ties by the document's id."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return query[kept], doc[kept], score[kept]


#: Cells of documents and queries that are worked on at once.
MOST_CELLS = 4_000_000


def search(corpus: DataFrame, terms: DataFrame, k: int = 6, where: Column | None = None, keep: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, *keep, score): the best k documents of each query that share a term with it; ties by id.

    ``where``: which documents may be ranked; the statistics are those of all. Queries beyond ``BROADCAST_TERMS`` rows are
    searched in blocks of that size. ``known``: the corpus' vocabulary, if several searches share it.
    """
    known = vocabulary(corpus) if known is None else known
    n_docs, mean = statistics(known)
    weighted = terms.join(inverse_frequencies(known, n_docs), "term").select(F.col("query_id").cast("bigint").alias("query_id"), "term", (F.col("weight") * F.col("idf")).alias("w"))
    docs = corpus if where is None else corpus.where(where)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "tokens", "n_tokens").where("doc_id is not null")
    found = None
    for block in _blocks(materialise(weighted)):
        one = _best_of_partitions(docs, block, k, mean or 1.0)
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    if not keep:
        return ranked
    return ranked.join(corpus.select("doc_id", *keep), "doc_id").select("query_id", "rank", "doc_id", *keep, "score")


def _blocks(weighted: DataFrame):
    """The weighted terms of the queries as Arrow tables that are safe to broadcast; a query's terms stay together."""
    n = weighted.count()
    if n <= BROADCAST_TERMS:
        yield weighted.toArrow()
        return
    parts = -(-n // (BROADCAST_TERMS // 2))
    for i in range(parts):
        yield weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow()


def _best_of_partitions(docs: DataFrame, block: pa.Table, k: int, mean: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        table = sent.value
        postings = _Postings(table["query_id"].to_numpy(), table["term"].to_pylist(), table["w"].to_numpy())
        step = max(1, MOST_CELLS // max(1, len(postings.ids)))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                more = postings.best(part.column(0).to_numpy(zero_copy_only=False), part.column(1), part.column(2).to_numpy(zero_copy_only=False), k, mean)
                best = first_of_each(*(np.concatenate(x) for x in zip(best, more)), k)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=schema)

    return docs.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def with_expansion(terms: DataFrame, expansion: DataFrame, weight: float = EXPANSION) -> DataFrame:
    """The terms of queries with those of their expansion, at a lower weight; both add up."""
    both = terms.unionByName(expansion.select("query_id", "term", (F.col("weight") * weight).alias("weight")))
    return both.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))


def rotate(ranked: DataFrame, variant: Column, count: int) -> DataFrame:
    """Of each query's ranked candidates ``count`` ones, beginning ``variant`` places further on."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    place = F.pmod(F.col("rank") - 1 - variant, n.cast("int"))
    return ranked.withColumn("place", place.cast("int") + 1).where(F.col("place") <= count)


def fill(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``ranked`` filled up to k with unscored documents in id order; a document list of k a query is enough to fill from."""
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    # the first k documents that a query hasn't ranked are among the first 2k of the corpus
    first = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = queries.select("query_id").distinct().join(F.broadcast(first)).join(ranked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = ranked.select("query_id", "rank", "doc_id", "score").unionByName(rest.select("query_id", F.lit(1_000_000).alias("rank"), "doc_id", F.lit(0.0).alias("score")))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: The three steps as SQL of the second engine; ``{corpus}``, ``{queries}`` are statements with doc_id/query_id and text.
def score_sql(corpus: str, queries: str, expansion: str | None = None, keep: str = "") -> str:
    from gaugeworks.functions.text import TOKENS_SQL

    t = TOKENS_SQL.format("text")
    grow = f" union all select query_id, term, {EXPANSION} * weight from ({expansion})" if expansion else ""
    also = f", {keep}" if keep else ""
    return f"""
with corpus as (select doc_id{also}, {t} as toks from ({corpus})),
lengths as (select doc_id{also}, len(toks) as n_tokens from corpus),
stats as (select count(*)::double as n_docs, avg(n_tokens) as avg_tokens from lengths),
postings as (select doc_id, term, count(*)::double as f from (select doc_id, unnest(toks) as term from corpus) group by all),
dfs as (select term, count(*)::double as df from postings group by term),
raw as (select term, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw from dfs, stats),
idf as (select term, case when raw < 0 then {EPSILON} * (select avg(raw) from raw) else raw end as idf from raw),
base as (select query_id, term, count(*)::double as weight from (select query_id, unnest({t}) as term from ({queries})) group by all),
terms as (select query_id, term, sum(weight) as weight from (select * from base{grow}) group by all),
scored as (
  select query_id, doc_id, sum(weight * idf * f * {K1 + 1} / (f + {K1} * (1 - {B} + {B} * n_tokens / avg_tokens))) as score
  from terms join idf using (term) join postings using (term) join lengths using (doc_id), stats group by all)
"""
