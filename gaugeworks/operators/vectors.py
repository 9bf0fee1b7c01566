"""Exact nearest neighbours by cosine.

Queries are broadcast in blocks, Arrow batches of vectors are multiplied with them, and each partition keeps the best k of
each query. Defined results: vectors without a length, with nulls or of another size than the queries have no similarity
to any; a query is no neighbour of itself; ties go to the smaller id.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.materialise import materialise
from gaugeworks.functions.spread import spread
from gaugeworks.operators.bm25 import first_of_each

#: Numbers of query vectors that one pass broadcasts (8 bytes each), and cells of vectors and queries worked on at once.
PASS_NUMBERS, MOST_CELLS = 4_000_000, 4_000_000


def _matrix(vectors: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the vectors of the given size."""
    rows, out = [], []
    for i, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) == size and None not in v:
            rows.append(i)
            out.append(v)
    m = np.array(out, np.float64).reshape(len(out), size)
    length = np.sqrt((m * m).sum(axis=1))
    ok = (length > 0) & np.isfinite(length)
    return np.array(rows, np.int64)[ok], m[ok] / length[ok, None]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, similarity): the k rows of ``vectors`` most alike to each of ``queries``, rounded to six places."""
    named = queries.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where("query_id is not null and size(q) > 0")
    asked = materialise(named)
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("size")).first()
    df = vectors.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    schema = pa.schema([("query_id", pa.int64()), (key, pa.int64()), ("similarity", pa.float64())])
    ddl = f"query_id bigint, {key} bigint, similarity double"
    parts = max(1, -(-shape.n * (shape["size"] or 1) // PASS_NUMBERS))
    found = None
    for i in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow() if parts > 1 else asked.toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent, size=shape["size"] or 1):
            table = sent.value.combine_chunks()
            rows, unit = _matrix(table["q"], size)
            ids = table["query_id"].to_numpy()[rows]
            step = max(1, MOST_CELLS // max(1, len(ids)))
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    at, m = _matrix(part.column(1), size)
                    if not len(at) or not len(ids):
                        continue
                    own = part.column(0).to_numpy(zero_copy_only=False)[at]
                    s = (m @ unit.T).round(6)
                    # of each query the k best rows, ids in order first so that ties keep it
                    order = np.argsort(own, kind="stable")
                    s, own = s[order], own[order]
                    s[own[:, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-s, axis=0, kind="stable")[:k]
                    q = np.broadcast_to(ids, top.shape)
                    more = (q.ravel(), own[top].ravel(), np.take_along_axis(s, top, 0).ravel())
                    ok = np.isfinite(more[2])
                    best = first_of_each(*(np.concatenate([x, y[ok]]) for x, y in zip(best, more)), k)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=schema)

        one = spread(df).mapInArrow(run, ddl).distinct()
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", key, "similarity")
