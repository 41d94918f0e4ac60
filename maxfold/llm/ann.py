"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Rows to a cell on average; sqrt(rows / CELL_ROWS) centroids of each half, and a fortieth of the sample at most.
CELL_ROWS = 128
#: Rows that the codebooks are fitted on, taken in hash order (64-d: 10 MB on the driver).
SAMPLE = 20_000
#: A query's cells hold as many rows as give this recall for TUNING rows of the sample, and MIN_CANDIDATES at least.
RECALL, MIN_CANDIDATES, TUNING = 0.96, 400, 300
#: Rows of a cell, and queries that visit it, that one task compares at once.
ROWS, QUERIES = 2048, 4096


def kmeans(x: np.ndarray, k: int, *, iters: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iters):
        d = (c**2).sum(1) - 2 * x @ c.T
        nearest = d.argmin(1)
        far = np.argsort(-d[np.arange(len(x)), nearest], kind="stable")
        for j in range(len(c)):
            mine = x[nearest == j]
            c[j] = mine.mean(0) if len(mine) else x[far[j % len(far)]]
    return c


def cell_order(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in ascending order of d1[i] + d2[j], by the multi-sequence heap, until they hold ``enough`` rows."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, k2 = d1[o1], d2[o2], len(d2)
    heap, out, have = [(s1[0] + s2[0], 0, 0)], [], 0
    pushed = {(0, 0)}
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k2 + int(o2[j])
        if sizes[cell]:
            out.append(cell)
            have += int(sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < k2 and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return out


def rows_before(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many rows a query visits before it reaches each of ``cells``, going by summed half distances."""
    order = np.argsort((d1[:, None] + d2[None, :]).ravel(), kind="stable")
    before = np.empty(len(order))
    before[order] = np.cumsum(sizes[order]) - sizes[order]
    return before[cells]


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows of one matrix, cut or filled with zeros to ``width``."""
    if vectors and all(len(v) == width for v in vectors):
        return np.stack(vectors).astype(np.float64, copy=False)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:width]
    return out


def norms(vectors: list[np.ndarray]) -> np.ndarray:
    """Lengths; those of vectors of one dimension are summed alike wherever they are."""
    dims = np.array([len(v) for v in vectors])
    out = np.zeros(len(vectors))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out[at] = np.sqrt((np.stack([vectors[i] for i in at]).astype(np.float64) ** 2).sum(1))
    return out


def _units(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows over their length, cut or filled to ``width``."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    v = [values[a:b] for a, b in zip(at, at[1:], strict=False)]
    return padded(v, width) / norms(v)[:, None] if v else np.zeros((0, width))


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows, double components; see nearest() for what takes no part."""
    v = F.col("embedding").cast("array<double>")
    clean = embeddings.where("vec_id is not null").select("vec_id", v.alias("v")).where(F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = clean.where(finite & F.exists("v", lambda x: x != 0))
    return clean.distinct()


def nearest(
    embeddings: DataFrame,
    *,
    k: int = 5,
    query_every: int = 50,
    cell_rows: int = CELL_ROWS,
    sample: int = SAMPLE,
    recall: float = RECALL,
    min_candidates: int = MIN_CANDIDATES,
) -> DataFrame:
    """The k nearest rows by cosine of each row whose vec_id is divisible by ``query_every``: (query_id, rank, vec_id, score, compared).

    Both halves of the unit vectors are quantised by their own codebook, fitted on a bounded sample; every row is
    indexed in the cell of its centroid pair, cells growing in number with the rows. A query visits cells in the order
    of summed half distances, by a heap, until they hold enough rows, and its candidates there (``compared`` of them) are
    ranked by the exact cosine of the original vectors in double precision; ties go to the smaller vec_id. Enough is what
    TUNING queries needed, whose nearest rows were found by brute force among all rows, for ``recall`` of these to lie in
    the cells; and min_candidates at least.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor rows without a vec_id. A vector
    shorter than another counts as filled with zeros (cells are chosen by the commonest length). Equal rows are one; of
    different vectors under one vec_id, as query or candidate, the nearest pair counts. A query with fewer than k other
    ids gets them all. An empty table gives no rows; other columns are ignored.

    Cells that follow each other are put on shelves of about ROWS rows, which are compared with QUERIES queries at a time; a
    cell that holds a third of all rows is many such blocks. A query is sent to a shelf once, with the cells that it visits
    there, and of each block only k rows per query are shuffled. Cell sizes and visits (at most (sample / 40) ** 2 numbers)
    are the only things collected.
    """
    schema = "query_id long, rank int, vec_id long, score double, compared long"
    spark = embeddings.sparkSession
    rows = materialize(usable_vectors(embeddings), "ann-rows")
    lengths = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = max(lengths, key=lambda d: (lengths[d], d)), sum(lengths.values())
    half = max(1, dim // 2)
    some = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()]
    fit = padded(some, dim) / norms(some)[:, None]
    centroids = int(np.clip(np.sqrt(n / cell_rows), 2, max(2, sample // 40)))
    c1 = kmeans(fit[:, :half], centroids)
    c2 = kmeans(fit[:, half:], centroids) if dim > half else np.zeros((1, 0))

    def distances(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = ((u[:, :half], c1), (u[:, half:], c2))
        return tuple(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0) for x, c in parts)

    def cells_of(u: np.ndarray) -> np.ndarray:
        d1, d2 = distances(u)
        return d1.argmin(1) * len(c2) + d2.argmin(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells_of(_units(b.column(1), dim)).astype(np.int32))], names=["vec_id", "v", "cell"])

    index = materialize(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, cell int"), "ann-index")
    held = np.zeros(len(c1) * len(c2), np.int64)
    for r in index.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    enough = max(_needed(index, fit[:TUNING], held, distances, dim, k, recall), min_candidates, k + 1)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2 = distances(_units(b.column(1), dim))
            cells = [cell_order(x, y, held, enough) for x, y in zip(d1, d2, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "q", "cells"])

    queries = rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "v").mapInArrow(traverse, "query_id long, q array<double>, cells array<int>")
    queries = materialize(queries, "ann-queries")
    visits = np.zeros_like(held)
    for r in queries.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():
        visits[r["cell"]] = r["count"]
    grid, shelf, have = [], -1, ROWS  # cells in order on shelves of about ROWS rows; a larger cell has a shelf of nr blocks
    for i in np.flatnonzero((held > 0) & (visits > 0)).tolist():
        if have + held[i] > ROWS:
            shelf, have = shelf + 1, 0
        have += int(held[i])
        grid.append((i, shelf, int(-(-held[i] // ROWS)), int(max(1, -(-visits[i] // QUERIES)))))
    wide: dict[int, int] = {}
    for _, s, _, q in grid:
        wide[s] = max(q, wide.get(s, 1))
    grid = F.broadcast(spark.createDataFrame([(c, s, r, wide[s]) for c, s, r, _ in grid], "cell int, shelf int, nr int, nq int"))  # at most (sample / 40) ** 2 rows
    blocks = index.join(grid, "cell").select("shelf", F.pmod(F.xxhash64("vec_id", "v"), "nr").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), "vec_id", "v", "cell")
    asked = queries.select("query_id", F.col("q").alias("v"), F.explode("cells").alias("cell")).join(grid, "cell")
    asked = asked.groupBy("query_id", "v", "shelf").agg(F.collect_list("cell").alias("cells"), F.max("nr").alias("nr"), F.max("nq").alias("nq"))
    asked = asked.select("shelf", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("r"), F.pmod(F.xxhash64("query_id", "v"), "nq").cast("int").alias("q"), "query_id", "v", "cells").toDF("to_shelf", "to_r", "to_q", "query_id", "v", "cells")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "compared": []}
        if len(x) and len(y):
            ids, vs, qs = x["vec_id"].to_numpy(), list(x["v"]), list(y["v"])
            width = max(map(len, qs))
            v, nv, nq = padded(vs, width), norms(vs), norms(qs)
            near = (padded(qs, width) / nq[:, None]) @ (v / nv[:, None]).T
            names, place = np.unique(x["cell"].to_numpy(), return_inverse=True)
            for i, (query, cells) in enumerate(zip(y["query_id"].to_numpy(), y["cells"], strict=True)):
                q, s = qs[i], np.where((ids == query) | ~np.isin(names, cells)[place], -np.inf, near[i])
                picked, wanted = np.flatnonzero(np.isfinite(s)), k
                compared = len(picked)
                while True:  # more rows, where ids of several vectors fill the first places
                    if compared > wanted:
                        picked = np.flatnonzero(s >= np.partition(s, -wanted)[-wanted] - 1e-9)
                        picked = picked[np.isfinite(s[picked])]
                    if compared <= wanted or len(set(ids[picked].tolist())) >= k:
                        break
                    picked, wanted = np.flatnonzero(np.isfinite(s)), 4 * wanted
                exact = (v[picked][:, : len(q)] * q).sum(1) / (nv[picked] * nq[i])  # the same sum in every block: equal vectors tie
                best, seen = [], set()
                for j in np.lexsort((ids[picked], -exact)).tolist():
                    if ids[picked[j]] not in seen:
                        seen.add(ids[picked[j]])
                        best.append(j)
                        if len(best) == k:
                            break
                out["query_id"] += [query] * max(1, len(best))
                out["vec_id"] += [*ids[picked[best]].tolist()] or [-1]
                out["score"] += [*exact[best].tolist()] or [-np.inf]
                out["compared"] += [compared] + [0] * (max(1, len(best)) - 1)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "compared": "int64"})

    found = blocks.groupBy("shelf", "r", "q").cogroup(asked.groupBy("to_shelf", "to_r", "to_q")).applyInPandas(compare, "query_id long, vec_id long, score double, compared long")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("compared").alias("_c"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("compared", F.sum("_c").over(Window.partitionBy("query_id"))).where(F.col("score") > float("-inf"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def _needed(index: DataFrame, units: np.ndarray, held: np.ndarray, distances, dim: int, k: int, recall: float) -> int:
    """Rows that a query must visit: the ``recall`` quantile over the true k nearest of ``units`` among all rows.

    One pass over the index; each batch passes on its k nearest to each unit vector, with their cells.
    """
    near = index.sparkSession.sparkContext.broadcast(units)  # TUNING rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cells = np.full((len(units), 0), 0.0), np.zeros((len(units), 0), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            s = near.value @ _units(b.column(0), dim).T
            scores = np.concatenate([scores, s], 1)
            cells = np.concatenate([cells, np.broadcast_to(b.column(1).to_numpy(), s.shape)], 1)
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            scores, cells = np.take_along_axis(scores, top, 1), np.take_along_axis(cells, top, 1)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(scores.ravel()), pa.array(cells.ravel(), pa.int32())], names=["unit", "score", "cell"])

    w = Window.partitionBy("unit").orderBy(F.desc("score"), "cell")
    top = index.select("v", "cell").mapInArrow(best, "unit int, score double, cell int").withColumn("_r", F.row_number().over(w))
    truth: dict[int, list[int]] = {}
    for r in top.where((F.col("_r") > 1) & (F.col("_r") <= k + 1)).collect():  # the first is the vector itself
        truth.setdefault(r["unit"], []).append(r["cell"])
    d1, d2 = distances(units)
    needs = [x for i, cells in truth.items() for x in rows_before(d1[i], d2[i], held, np.array(cells)).tolist()]
    return int(np.quantile(needs, recall)) + 1 if needs else 0
