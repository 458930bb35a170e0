"""Exact nearest vectors by distributed selection on score histograms.

All queries are scored against all rows, several times instead of once: each pass scores
anew and counts, per query, the scores inside the bracket that still holds the k-th
highest one, in ``BINS`` equal bins. The counts are added up over all tasks; the bin in
which the k-th score lies is the next bracket, until it is one score wide. Where more
rows tie at that score than are wanted, the same selection goes on over their ids. A last
pass keeps what reaches the thresholds, which is k rows a query, and orders them.

A task does not count scores below the k-th highest of its own rows, which cannot be the
k-th of all: what is shuffled is at most k scores a query and task in each pass, whatever
the number of rows, and no score is ever stored. Queries come in blocks of bounded size,
which are broadcast one after another; every block meets every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordinals import with_ordinals

SCALE = 1024
BINS = 4096
BLOCK_QUERIES, BLOCK_BYTES = 8192, 16 << 20
CELLS = 1 << 21  # scores worked on at a time
EXACT = 2**53  # sums of products below this are exact in doubles, in any order
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch (id, array), one pair for each length, ids ascending.

    Components are floor(SCALE * x). Left out: null ids, null vectors and vectors that
    hold a null, NaN or infinite component.
    """
    ids, lists = batch.column(0), batch.column(1)
    there = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    batch = batch.filter(pa.array(there))
    ids, lists = batch.column(0).cast(pa.int64()).to_numpy(), batch.column(1)
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    odd = np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]
    fine = np.bincount(odd, minlength=len(sizes)) == 0
    for size in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == size))
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], np.floor(SCALE * flat[first[rows, None] + np.arange(size)])


@dataclass
class Block:
    """A block of queries and how far their thresholds are known.

    ``groups`` has the places and vectors of the queries of each length. The k-th score
    lies in the bracket of ``bins * width`` from ``low`` on, and is the ``need``-th highest
    in it. Once ``low`` is that score, ``ties`` says which queries have more rows with it
    than ``need``, and ``oldest`` is the last id that they take.
    """

    ids: np.ndarray
    groups: dict[int, tuple[np.ndarray, np.ndarray]]
    k: int
    bound: int
    bins: int = BINS
    cells: int = CELLS
    low: np.ndarray = field(default=None)
    need: np.ndarray = field(default=None)
    ties: np.ndarray = field(default=None)
    oldest: np.ndarray = field(default=None)

    @property
    def kind(self):
        return np.float64 if self.bound < EXACT else np.int64

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, ids of rows, scores), a bounded number of scores at a time.

        A query's own id scores less than any score can be.
        """
        for ids, vectors in integer_vectors(batch):
            if vectors.shape[1] not in self.groups:
                continue
            places, queries = self.groups[vectors.shape[1]]
            queries = queries.astype(self.kind)
            step = max(1, self.cells // len(places))
            for begin in range(0, len(ids), step):
                some = ids[begin : begin + step]
                found = queries @ vectors[begin : begin + step].astype(self.kind).T
                own = np.flatnonzero(np.isin(some, self.ids[places]))
                for row in own:
                    found[self.ids[places] == some[row], row] = -self.bound - 1
                yield places, some, found


def _counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, back = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(back, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _histograms(batches, block: Block, keys: Callable, low: np.ndarray, need: np.ndarray, width: int):
    """Rows (place, need, bin, rows) of a task, from the (places, unsigned keys) that ``keys`` yields."""
    codes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for batch in batches:
        for places, key in keys(batch):
            inside = key >= low[places]
            places, key = places[inside], (key[inside] - low[places[inside]]) // np.uint64(width)
            inside = key < block.bins
            code, count = np.unique(places[inside] * block.bins + key[inside].astype(np.int64), return_counts=True)
            codes.append(code)
            counts.append(count)
            held += len(code)
            if held > block.cells:
                code, count = _counted(codes, counts)
                codes, counts, held = [code], [count], 0
    code, count = _counted(codes, counts)
    for begin in range(0, len(code), 1 << 16):
        some = code[begin : begin + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some // block.bins), pa.array(need[some // block.bins]), pa.array(some % block.bins),
             pa.array(count[begin : begin + (1 << 16)])],
            ["place", "need", "bin", "rows"],
        )


def _select(vectors: DataFrame, block: Block, keys: Callable, need: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """(key, need, rows): for each query its ``need``-th highest key (the lowest if it has fewer),
    the place among equal keys, and their number; keys are from 0 to ``top``."""
    context = vectors.sparkSession.sparkContext
    low, rows = np.zeros(len(need), np.uint64), np.zeros(len(need), np.int64)
    width = 1
    while width * block.bins <= top:
        width *= block.bins
    while True:
        state = context.broadcast((block, low, need, width))

        def count(batches, state=state):
            block, low, need, width = state.value
            return _histograms(batches, block, lambda batch: keys(block, batch), low, need, width)

        counted = vectors.mapInArrow(count, "place long, need long, bin long, rows long")
        summed = counted.groupBy("place", "need", "bin").agg(F.sum("rows").alias("rows"))
        # At most ``bins`` rows a query.
        down = Window.partitionBy("place").orderBy(F.desc("bin"))
        running = summed.withColumn("upto", F.sum("rows").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        reached = F.struct(F.col("upto") >= F.col("need"), F.when(F.col("upto") >= F.col("need"), F.col("bin")).otherwise(-F.col("bin")))
        chosen = running.groupBy("place").agg(F.max_by(F.struct("bin", "upto", "rows"), reached).alias("c"))
        found = chosen.select("place", "c.*").toPandas()  # a row for each query of the block
        state.unpersist()
        at = found["place"].to_numpy()
        low[at] += found["bin"].to_numpy().astype(np.uint64) * np.uint64(width)
        rows[at] = found["rows"].to_numpy()
        need = need.copy()
        need[at] -= (found["upto"] - found["rows"]).to_numpy()
        if width == 1:
            return low, need, rows
        width //= block.bins


def _score_keys(block: Block, batch: pa.RecordBatch):
    """(places, scores from 0 on) without those below a query's k-th highest in the same piece."""
    for places, _, scores in block.scores(batch):
        least = np.full(len(places), -block.bound, dtype=scores.dtype)
        if scores.shape[1] > block.k:
            least = np.maximum(least, np.partition(scores, -block.k, axis=1)[:, -block.k])
        q, row = np.nonzero(scores >= least[:, None])
        yield places[q], (scores[q, row].astype(np.int64) + block.bound).astype(np.uint64)


def _first_ties(block: Block, places: np.ndarray, scores: np.ndarray, which: np.ndarray):
    """(query, row) of the rows at the k-th score, of each query the first k, as ids ascend."""
    chosen = np.flatnonzero(which[places])
    q, row = np.nonzero(scores[chosen] == block.low[places[chosen], None])
    early = np.arange(len(q)) - np.searchsorted(q, q) < block.k
    return chosen[q[early]], row[early]


def _id_keys(last: int) -> Callable:
    def keys(block: Block, batch: pa.RecordBatch):
        """(places, distance from the largest id) of the rows at the k-th score, where they are too many."""
        for places, ids, scores in block.scores(batch):
            q, row = _first_ties(block, places, scores, block.ties)
            yield places[q], np.subtract(last, ids[row], dtype=np.int64).view(np.uint64)

    return keys


def _reached(block: Block, batches):
    """Rows (place, query_id, vec_id, score) over the k-th score, and at it up to the last id."""
    for batch in batches:
        for places, ids, scores in block.scores(batch):
            q, row = np.nonzero(scores > block.low[places, None])
            tied, at = _first_ties(block, places, scores, np.ones(len(block.ids), bool))
            early = ~block.ties[places[tied]] | (ids[at] <= block.oldest[places[tied]])
            q, row = np.concatenate([q, tied[early]]), np.concatenate([row, at[early]])
            columns = [places[q], block.ids[places[q]], ids[row], scores[q, row].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "query_id", "vec_id", "score"])


def _extent(batches):
    """One row (norm, least, last, size): largest squared norm, ids from and to, longest vector."""
    norm, least, last, size = -1.0, 2**63 - 1, -(2**63), 0
    for batch in batches:
        for ids, vectors in integer_vectors(batch):
            norm = max(norm, float((vectors * vectors).sum(axis=1).max()))
            least, last, size = min(least, int(ids[0])), max(last, int(ids[-1])), max(size, vectors.shape[1])
    yield pa.RecordBatch.from_pydict({"norm": [norm], "least": [least], "last": [last], "size": [size]})


def _block_of(rows: list, **state) -> Block:
    """Queries as collected, in order of their places."""
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    sizes = np.array([len(r["vector"]) // 8 for r in rows])
    groups = {}
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        flat = b"".join(bytes(rows[p]["vector"]) for p in places)
        groups[int(size)] = (places, np.frombuffer(flat, dtype=np.float64).reshape(len(places), size))
    return Block(ids, groups, **state)


def _queries(batches):
    for batch in batches:
        for ids, vectors in integer_vectors(batch.filter(batch.column(2).fill_null(False))):
            packed = [v.tobytes() for v in np.ascontiguousarray(vectors)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(packed, pa.binary())], ["vec_id", "vector"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    block_queries: int = BLOCK_QUERIES,
    bins: int = BINS,
    cells: int = CELLS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of highest inner product, of every query.

    Components count as floor(1024 * x). Candidates are all rows with another id than the
    query's; equal scores go to the smaller id. Rows with a null id take no part, nor do
    null vectors and those with a null, NaN or infinite component. Vectors of different
    length have no product; those without a component score 0 among each other. A row
    that occurs several times is a candidate each time, a query that does has a list each
    time. With fewer than k candidates all are returned, without any none; an empty table
    gives an empty result. Further columns are ignored. Squared norms of 2**62 and more
    (beyond long scores) are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    extent = rows.mapInArrow(_extent, "norm double, least long, last long, size long").agg(
        F.max("norm").alias("norm"), F.min("least").alias("least"), F.max("last").alias("last"), F.max("size").alias("size")
    ).first()
    if extent["norm"] is None or extent["norm"] < 0:
        return spark.createDataFrame([], RESULT)
    if extent["norm"] >= 2.0**62:
        raise ValueError("vectors are too long for scores of 64 bits")
    bound = int(extent["norm"] * (1 + 1e-9)) + 1
    asked = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asked")
    )
    asked = asked.where("asked").mapInArrow(_queries, "vec_id long, vector binary")
    queries = materialise(with_ordinals(asked.withColumn("all", F.lit(0)), "all", ["vec_id"]))
    total = queries.count()
    step = max(1, min(block_queries, BLOCK_BYTES // (8 * max(1, extent["size"]))))
    parts = []
    for begin in range(0, total, step):
        held = queries.where((F.col("at") >= begin) & (F.col("at") < begin + step)).orderBy("at").collect()
        block = _block_of(held, k=k, bound=bound, bins=bins, cells=cells)
        wanted = np.full(len(block.ids), k, dtype=np.int64)
        key, block.need, found = _select(rows, block, _score_keys, wanted, 2 * bound)
        block.low = key.astype(np.int64) - bound
        block.ties = found > block.need
        block.oldest = np.zeros(len(block.ids), np.int64)
        if block.ties.any():
            key, _, _ = _select(rows, block, _id_keys(extent["last"]), block.need, extent["last"] - extent["least"])
            block.oldest = np.subtract(extent["last"], key.view(np.int64), dtype=np.int64)
        state = spark.sparkContext.broadcast(block)
        reached = rows.mapInArrow(
            lambda batches, state=state: _reached(state.value, batches), "place long, query_id long, vec_id long, score long"
        )
        order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
        ranked = reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(materialise(ranked.select("query_id", "rank", "vec_id", "score")))
        state.unpersist()
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], RESULT)
