"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows (term -> weight). Candidates are dealt into blocks by a hash of their
id, queries into blocks likewise; every query block meets every candidate block once, as an equi-join
on the pair of block numbers, so a task holds one block of each and the stated query set is compared
with all rows without a row-by-row product. Inside a pair of blocks the postings of one term after
the other are scattered, weighted by the query's weight of that term, into a dense array of scores; a
partition selection then keeps each query's k best. A last ranking merges the k rows per block.

Defined cases: a vector that is null, or holds null or non-finite components, takes no part; components
beyond the shorter vector count as zero; a query never meets a row of its own id; rows that repeat a
query's id give one query (the smallest vector); ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.llm.shared import kept

BLOCK_ROWS = 8192
QUERY_ROWS = 512


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, terms, weights) of (id, vector) rows in id order: the non-zero entries."""
    table = table.combine_chunks()
    ids = table["id"].to_numpy()
    lists = table["v"].chunk(0) if table["v"].num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    weights = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    rows = np.repeat(place, sizes)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = weights != 0
    return ids[order], rows[some], terms[some], weights[some]


def accumulate(queries: tuple, candidates: tuple) -> np.ndarray:
    """Dense scores (query, candidate), term at a time: postings of a term scattered by each query's weight."""
    q_ids, q_rows, q_terms, q_weights = queries
    c_ids, c_rows, c_terms, c_weights = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    by_term = np.argsort(c_terms, kind="stable")
    c_rows, c_terms, c_weights = c_rows[by_term], c_terms[by_term], c_weights[by_term]
    q_by_term = np.argsort(q_terms, kind="stable")
    q_rows, q_terms, q_weights = q_rows[q_by_term], q_terms[q_by_term], q_weights[q_by_term]
    for term in np.unique(q_terms):
        a, b = np.searchsorted(c_terms, [term, term + 1])
        c, d = np.searchsorted(q_terms, [term, term + 1])
        posting, weights = c_rows[a:b], c_weights[a:b]
        for row, weight in zip(q_rows[c:d], q_weights[c:d]):
            scores[row, posting] += weight * weights
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position, by partition selection."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        return np.concatenate([above, np.flatnonzero(scores == edge)[:k - len(above)]])
    return np.arange(len(scores))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score) for tables (id long, v array<long>): each query's k best candidates of another id."""
    queries = kept(queries.where("v is not null and id is not null").groupBy("id").agg(F.min("v").alias("v"))).df
    candidates = kept(candidates.where("v is not null and id is not null").select("id", "v")).df
    n_q, n_c = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_rows)), max(1, -(-n_c // block_rows))
    # hashing the whole row spreads repeated ids as well

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    c = candidates.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(c_blocks)).alias("cb"), each(q_blocks).alias("qb"))
    q = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).alias("qb"), each(c_blocks).alias("cb"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = flat(left), flat(right)
        q_out, c_out, s_out = [], [], []
        if len(mine[0]) and len(theirs[0]):
            scores = accumulate(mine, theirs)
            for i, qid in enumerate(mine[0]):
                other = np.flatnonzero(theirs[0] != qid)
                at = other[best(scores[i, other], k)]
                q_out.append(np.full(len(at), qid))
                c_out.append(theirs[0][at])
                s_out.append(scores[i, at])
        cat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (q_out, c_out, s_out)]
        return pa.table(dict(zip(("query_id", "id", "score"), cat)))

    pairs = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInArrow(score, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
