"""Exact top-k search by distributed histogram selection.

Vectors are put into blocks and every query block meets every candidate block. Each round
scores everything and sums a histogram of scores per query over the cluster; the bin in
which the k-th highest score lies is cut into finer bins until it is one whole number.
The last round keeps scores above that number and, of those equal to it, each task the
smallest ids that could still be needed; a window over these few rows ranks them.

Defined results: a vector that is null, empty or holds a null or non-finite component
takes no part; vectors of another length than the query's are no candidates for it; rows
with the query's vec_id are the query's own; repeated rows are candidates of their own,
but one query (rows of one id with different vectors are queries of their own, told apart
by `query_no`); a null vec_id is a candidate that comes last among ties and no query; with
fewer than k candidates all are returned; an empty table gives an empty result. Scaled
components are whole numbers; products are summed as doubles where exact (below 2**53)
and as 64-bit integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.shared import stored

BINS = 512
BLOCK = 1024
QUERY_BLOCK = 512
_NULL_ID = np.iinfo(np.int64).max
_EXACT = 1 << 53


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, of rows that take part."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    fine = (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull()).where(fine)
    return df.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length, in blocks of at most `size` rows."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            yield part, flat[starts[part][:, None] + np.arange(dim)]


def _candidate_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        for rows, m in _matrices(b, 1, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([ids[rows].astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary())], ["dim", "ids", "m"])


def _query_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query block carries its queries' numbers, ids and the state of the selection."""
    for b in batches:
        state = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4, 5)]) if b.num_rows else np.zeros((0, 5), np.int64)
        for rows, m in _matrices(b, 2, QUERY_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([state[rows].astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary())], ["qdim", "q", "qm"])


def _scores(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query state (no, id, low, width, need), candidate ids, and scores with own rows masked out."""
    dim = b.column("dim")[i].as_py()
    q = np.frombuffer(b.column("q")[i].as_buffer(), "<i8").reshape(-1, 5)
    qm = np.frombuffer(b.column("qm")[i].as_buffer(), "<i8").reshape(-1, dim)
    ids = np.frombuffer(b.column("ids")[i].as_buffer(), "<i8")
    m = np.frombuffer(b.column("m")[i].as_buffer(), "<i8").reshape(-1, dim)
    top = float(np.abs(qm).max(initial=0)) * float(np.abs(m).max(initial=0)) * dim
    scores = (qm.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64) if top < _EXACT else qm @ m.T
    return q, ids, scores


def _histograms(bins: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, ids, scores = _scores(b, i)
                # Scores above the range were counted by an earlier round, those below can't win.
                place = (scores - q[:, 2:3]) // q[:, 3:4]
                place[(place < 0) | (place >= bins) | (q[:, 1:2] == ids[None, :])] = -1
                place += (np.arange(len(q)) * (bins + 1) + 1)[:, None]
                counts = np.bincount(place.ravel(), minlength=len(q) * (bins + 1)).reshape(len(q), -1)[:, 1:]
                r, c = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(q[r, 0]), pa.array(c.astype(np.int64)), pa.array(counts[r, c].astype(np.int64))], ["query_no", "bin", "n"])

    return run


def _winners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["query_no", "vec_id", "score"]
    for b in batches:
        for i in range(b.num_rows):
            q, ids, scores = _scores(b, i)
            own = q[:, 1:2] == ids[None, :]
            above = (scores > q[:, 2:3]) & ~own
            r, c = np.nonzero(above)
            ties = [(k, np.flatnonzero((scores[k] == q[k, 2]) & ~own[k])) for k in range(len(q))]
            # Of a block's ties only the smallest ids can be among the `need` still wanted.
            ties = [(k, t if len(t) <= q[k, 4] else t[np.argsort(ids[t], kind="stable")[: q[k, 4]]]) for k, t in ties if len(t)]
            r = np.concatenate([r, *[np.full(len(t), k) for k, t in ties]]).astype(np.int64)
            c = np.concatenate([c, *[t for _, t in ties]]).astype(np.int64)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(q[r, 0]), pa.array(ids[c]), pa.array(scores[r, c])], names)


def _met(candidates: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Every query block beside every candidate block of its dimension.

    Candidate blocks are dealt into parts by their content, and query blocks, which are
    fewer, go to each part: an equi-join, neither side of which is broadcast.
    """
    q = queries.mapInArrow(_query_blocks, "qdim int, q binary, qm binary").withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = candidates.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    return c.join(q.hint("shuffle_hash"), (F.col("part") == F.col("qpart")) & (F.col("dim") == F.col("qdim"))).select("dim", "ids", "m", "q", "qm")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, parts: int | None = None, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score and query_no; queries has the columns of vectors."""
    spark = vectors.sparkSession
    parts = parts or max(24, 4 * spark.sparkContext.defaultParallelism)
    candidates = stored(scaled(vectors, scale).mapInArrow(_candidate_blocks, "dim int, ids binary, m binary"), "topk-candidates")
    asked = scaled(queries, scale).where(F.col("vec_id").isNotNull()).distinct().withColumn("query_no", F.monotonically_increasing_id())
    asked = stored(asked.select("query_no", F.col("vec_id").alias("query_id"), "v"), "topk-queries")
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    norms = [df.agg(largest).first()[0] or 0.0 for df in (scaled(vectors, scale), asked)]
    # By Cauchy and Schwarz no score lies outside; beyond 62 bits integers would wrap.
    bound = int(norms[0] ** 0.5 * norms[1] ** 0.5) + 2
    if bound > 1 << 61:
        raise ValueError(f"scores may reach {bound}, beyond what 64-bit integers add exactly; take a smaller scale")
    width = 1
    while width * bins < 2 * bound + 1:
        width *= bins
    state = asked.withColumns({"low": F.lit(-bound).cast("long"), "width": F.lit(width).cast("long"), "need": F.lit(k).cast("long")})
    while True:
        counts = _met(candidates, state, parts).mapInArrow(_histograms(bins), "query_no long, bin long, n long").groupBy("query_no", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_no").orderBy(F.col("bin").desc())
        # `need` scores are wanted from bins at or below; the bin that reaches them holds the k-th.
        counts = counts.withColumn("through", F.sum("n").over(down)).join(state.select("query_no", F.col("need").alias("wanted")), "query_no")
        last = (F.col("through") >= F.col("wanted")) & (F.col("through") - F.col("n") < F.col("wanted"))
        found = counts.where(last).select("query_no", "bin", (F.col("wanted") - (F.col("through") - F.col("n"))).alias("left"))
        # Queries with fewer candidates than k have no such bin: they take all.
        state = state.join(found, "query_no", "left").select(
            "query_no", "query_id", "v",
            F.coalesce(F.col("low") + F.col("bin") * F.col("width"), F.lit(-(1 << 62))).alias("low"),
            F.lit(max(1, width // bins)).cast("long").alias("width"),
            F.coalesce("left", "need").alias("need"),
        )
        state = stored(state, "topk-state")
        if width == 1:
            break
        width //= bins
    winners = _met(candidates, state, parts).mapInArrow(_winners, "query_no long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_id"))
    ranked = winners.withColumn("rank", rank).where(F.col("rank") <= k)
    ranked = ranked.withColumn("vec_id", F.when(F.col("vec_id") != _NULL_ID, F.col("vec_id")))
    return ranked.join(asked.select("query_no", "query_id"), "query_no").select("query_id", "rank", "vec_id", "score", "query_no")


def report(vectors: DataFrame, every: int = 20) -> DataFrame:
    """The 20 best of each query; queries are the rows whose vec_id is divisible by `every`."""
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0)).drop("query_no")
