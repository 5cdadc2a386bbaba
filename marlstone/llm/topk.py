"""Exact top-k search by inner product, with the three phases of the uniform-threshold method.

The dimensions are cut into SLICES, so that a score is a sum of SLICES local scores, and candidates are dealt over partitions.
1. Partitions gather, for each query and slice, the K best local scores among a share of the candidates (1 in PROBE, by the hash of the
   vector) and total these entries. The K-th best total over all partitions is a cutoff that the true K-th best score can't be below,
   whichever candidates it comes from.
2. The cutoff is sent to all partitions, which go through all candidates. One whose score reaches the cutoff has a local score of at least
   cutoff / SLICES; each slice's list of local scores is cut there, and only the entries above are collected.
3. For the collected entries alone, the scores in the other slices are resolved; totals that reach the cutoff are ranked exactly.

Queries are dealt by hash into blocks of at most about BLOCK_BYTES, so the driver and each task hold one block at a time, however many
queries there are. Each block's answers are written before the next one is read; candidates stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read_written, written

K = 5
#: Few slices: the more there are, the more entries reach an equal share of the cutoff.
SLICES = 2
PROBE = 16
BLOCK_BYTES = 16 << 20
_ROWS, _QUERIES = 2048, 512
_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
_TOP = (1 << 63) - 1


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def _whole(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All scores by Python's integers, held to the range of a long: for components so large that doubles would round."""
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    return np.clip(exact, -_TOP - 1, _TOP).astype(np.int64)


def _totals(q: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray, known: np.ndarray, missing: list[np.ndarray]) -> np.ndarray:
    """Scores of the pairs (r, c) of which `known` is settled and the slices `missing` are not, some pairs at a time."""
    out = known.copy()
    for lo in range(0, len(r), 1 << 15):
        at = slice(lo, lo + (1 << 15))
        for s in missing:
            out[at] += np.einsum("ij,ij->i", q[r[at]][:, s], v[c[at]][:, s])
    return out


def local_entries(q: np.ndarray, v: np.ndarray, own: np.ndarray, slices: list[np.ndarray], k: int, cutoff: np.ndarray | None):
    """Rows, columns and scores of the entries of each slice's list: its k best, or those of at least an equal share of the cutoff."""
    rows, cols, scores = [], [], []
    for s, dims in enumerate(slices):
        local = q[:, dims] @ v[:, dims].T
        local[own] = -np.inf
        if cutoff is None:
            n = local.shape[1]
            edge = np.partition(local, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(q), 1), -np.inf)
            r, c = np.nonzero((local >= edge) & ~own)
        else:
            r, c = np.nonzero((local >= cutoff[:, None] / len(slices)) & ~own)
        rows.append(r)
        cols.append(c)
        scores.append(_totals(q, v, r, c, local[r, c], [d for i, d in enumerate(slices) if i != s]))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _scan(q_ids: np.ndarray, queries: np.ndarray, k: int, cutoff: np.ndarray | None):
    width = queries.shape[1]
    slices = [s for s in np.array_split(np.arange(width), SLICES) if len(s)]

    def blocks(batches):
        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            flat, begins = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            good = np.flatnonzero(np.diff(begins) == width)  # vectors of other lengths take no part
            for lo in range(0, len(good), _ROWS):
                g = good[lo : lo + _ROWS]
                yield ids[g].astype(np.int64), flat[begins[g][:, None] + np.arange(width)].astype(np.float64) if width else np.zeros((len(g), 0))

    def run(batches) -> Iterator:
        import pyarrow as pa

        hits = np.zeros((0, 3), np.int64)
        largest = np.abs(queries).max(initial=0) * max(1, width)
        for ids, m in blocks(batches):
            more = [hits]
            safe = largest * np.abs(m).max(initial=0) < 2.0**53
            for lo in range(0, len(q_ids), _QUERIES):
                at = slice(lo, lo + _QUERIES)
                q, who = queries[at], q_ids[at]
                own = who[:, None] == ids[None, :]
                if safe and slices:
                    r, c, score = local_entries(q, m, own, slices, k, None if cutoff is None else cutoff[at])
                else:
                    r, c = np.nonzero(~own)
                    score = _whole(q, m)[r, c]
                if cutoff is not None:
                    reach = score >= cutoff[at][r]
                    r, c, score = r[reach], c[reach], score[reach]
                more.append(np.stack([who[r], ids[c], score.astype(np.int64)], 1))
            # of each query, the k best ids of this partition so far, each with its best score, stay
            found = np.unique(np.concatenate(more), axis=0)
            found = found[np.append((found[1:, :2] != found[:-1, :2]).any(1), True)] if len(found) else found
            found = found[np.lexsort((found[:, 1], ~found[:, 2], found[:, 0]))]
            hits = found[np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0]) < k]
        if len(hits):
            yield pa.RecordBatch.from_arrays([pa.array(hits[:, i]) for i in range(3)], names=_HITS.names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of vectors by integer inner product for each row of queries, ties to
    the smaller vec_id; fewer if there are fewer.

    Components are floor(256 * x). Vectors that are null or hold null or non-finite components, and null ids, take no part; a query meets
    the vectors of its own length. Rows that repeat an id and vector count once (with different vectors, the id's best counts). Scores
    beyond the range of a long are held to it. Extra columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    form = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    candidates, asked = form(vectors), written(form(queries).dropDuplicates(["vec_id", "v"]), "queries")
    spark = vectors.sparkSession
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    probe = F.pmod(F.xxhash64("v", "vec_id"), F.lit(PROBE)) == 0
    answers = []
    for n, total in sorted(asked.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("total")).collect()):
        blocks = -(-total * max(1, n) * 8 // BLOCK_BYTES)
        for b in range(blocks):
            rows = asked.where((F.size("v") == n) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)).toArrow()  # about BLOCK_BYTES
            if not rows.num_rows:
                continue
            q_ids = rows.column("vec_id").to_numpy()
            q = np.concatenate([c.flatten().to_numpy() for c in rows.column("v").chunks]).reshape(len(q_ids), n).astype(np.float64)
            found = ranked(candidates.where(probe & (F.size("v") == n)).mapInArrow(_scan(q_ids, q, k, None), _HITS))
            edge = {r.query_id: r.score for r in found.where(F.col("rank") == k).select("query_id", "score").collect()}  # a number for each query of the block
            cutoff = np.array([edge.get(i, -_TOP) for i in q_ids.tolist()], np.float64)
            hits = ranked(candidates.where(F.size("v") == n).mapInArrow(_scan(q_ids, q, k, cutoff), _HITS))
            answers.append(written(hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "answers"))
    return read_written(answers) if answers else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
