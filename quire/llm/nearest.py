"""Nearest neighbours by a block matrix join.

Rows are packed into blocks where they are read; query blocks and row blocks meet on a grid, each cell a bounded number
of rows on either side. In a cell, int8 copies of the vectors give all distances by one matrix product with a bound on
the quantisation error; pairs whose lower bound can still reach a query's k-th best are computed again in double
precision on the original vectors and merged by heaps, and a second merge joins the cells of a query. The bounds make
the search exact. Vectors of doubles stay doubles; other numbers than floats become doubles.

A query's answers of a cell are its k best there, and Spark limits ranks before it shuffles them, so what meets in the last merge
are k rows of each task that has cells of the query.

Error bound: x = s*q + r with r the rounding remainder, so | |x - y| - |s_x q_x - s_y q_y| | <= |r_x| + |r_y|.

Defined results: a vector that is null, all zero, or holds a null or non-finite component takes no part, nor does a row
with a null id; only vectors of one length are compared; a query never meets a row with its own id; rows that repeat an
id are separate candidates, and a query id that repeats is searched once, with its smallest vector; ties go to the
smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import ship

#: Rows of a block as packed, and of a grid cell's sides.
PACK, QUERY_SIDE, ROW_SIDE = 1024, 8192, 16384
#: Rows of a product tile.
TILE_Q, TILE_R = 512, 4096

_BLOCKS = "query boolean, dim int, n int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def pack(rows: DataFrame, query: bool, kind: str) -> DataFrame:
    """Blocks of up to PACK vectors of one length, made where the rows are; ``kind`` is numpy's name of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype="<i8")
            column = batch.column(1)
            at = np.asarray(column.offsets, dtype=np.int64)
            values = np.asarray(column.values, dtype=kind)
            dims = np.diff(at)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for k in range(0, len(own), PACK):
                    part = own[k : k + PACK]
                    matrix = values[at[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_pydict(
                        {"query": [query], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(part)], pa.int32()), "ids": [ids[part].tobytes()], "vectors": [matrix.tobytes()]}
                    )

    return rows.mapInArrow(run, _BLOCKS)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 copy (as floats, for the product), scale, squared length of the copy, length of the remainder."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # of a vector whose components are next to nothing
    q = np.rint(x / scale[:, None])
    # sums of up to 1,000 products of two int8 values are exact in single precision
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return q.astype(np.int8).astype(kind), scale, scale**2 * (q**2).sum(1), np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed component by component in double precision."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        step = x[:, d].astype(np.float64) - y[:, d]
        total += step * step
    return np.sqrt(total)


def search(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest rows as (distance, id), nearest first."""
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for a in range(0, len(q), TILE_Q):
        ids, own = q_ids[a : a + TILE_Q], q[a : a + TILE_Q]
        q8, qs, qn, qe = quantised(own)
        reach = np.full(len(own), np.inf)  # the k-th best so far, exactly
        for b in range(0, len(r), TILE_R):
            there, rows = r_ids[b : b + TILE_R], r[b : b + TILE_R]
            r8, rs, rn, re = quantised(rows)
            near = np.sqrt(np.maximum(qn[:, None] + rn - 2 * qs[:, None] * rs * (q8 @ r8.T), 0))
            slack = (qe[:, None] + re) * (1 + 1e-9) + 1e-6 * (np.sqrt(qn)[:, None] + np.sqrt(rn))
            # beyond the range of doubles the bounds say nothing, so such pairs are computed
            lost = ~np.isfinite(near) | ~np.isfinite(slack)
            near[lost], slack[lost] = 0, np.inf
            same = ids[:, None] == there
            near[same], slack[same] = np.inf, 0
            if near.shape[1] > k:
                upper = np.partition(near + slack, k - 1, axis=1)[:, k - 1]
                bound = np.minimum(reach, upper)
            else:
                bound = reach
            i, j = np.nonzero((near - slack <= bound[:, None]) & ~same)
            exact = distances(own[i], rows[j])
            cuts = np.searchsorted(i, np.arange(len(own) + 1))
            for n in np.unique(i):
                part = slice(cuts[n], cuts[n + 1])
                best[a + n] = heapq.nsmallest(k, heapq.merge(best[a + n], sorted(zip(exact[part].tolist(), there[j[part]].tolist(), strict=True))))
                if len(best[a + n]) == k:
                    reach[n] = best[a + n][-1][0]
    return best


def nearest(vectors: DataFrame, queries: Column, k: int = 10, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which ``queries`` holds its k nearest other rows."""
    spark = vectors.sparkSession
    ship(spark)
    single = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kind, parts = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(parts).alias("v"), queries.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if("q")).first()
    row_cells, query_cells = max(1, -(-n_rows // ROW_SIDE)), max(1, -(-n_asked // QUERY_SIDE))
    spread = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_rows = pack(rows.select("id", "v"), False, kind).withColumn("rc", spread(row_cells)).withColumn("qc", copies(query_cells))
    of_asked = pack(asked, True, kind).withColumn("qc", spread(query_cells)).withColumn("rc", copies(row_cells))

    def cell(table: pa.Table) -> pa.Table:
        sides: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        dim = table.column("dim")[0].as_py()
        for query, ids, raw in zip(*(table.column(c).to_pylist() for c in ("query", "ids", "vectors")), strict=True):
            sides[query][0].append(np.frombuffer(ids, "<i8"))
            sides[query][1].append(np.frombuffer(raw, kind).reshape(-1, dim))
        out: list[tuple[int, int, float]] = []
        if sides[True][0] and sides[False][0]:
            (q_ids, q), (r_ids, r) = ((np.concatenate(x), np.concatenate(y)) for x, y in (sides[True], sides[False]))
            out = [(i, j, d) for i, found in zip(q_ids.tolist(), search(q_ids, q, r_ids, r, k), strict=True) for d, j in found]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    cells = of_rows.unionByName(of_asked).groupBy("qc", "rc", "dim").applyInArrow(cell, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
