"""Exact top-k search through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the vectors of a pivot, sorted by that distance
and cut into slices, form annuli. A vector's distance to a query is at least the difference of both
distances to the pivot. A query visits annuli in the order of that bound, which expands outwards from its own distance
around every pivot at once: one in the first round, STEP times as many in each further one. After a round its k-th hit so far tightens how
far a hit can be; it stops at the first annulus whose bound is beyond that.

The driver holds the pivots, their sample and the listing of slices, all of bounded size. Slices meet queries in a
product of both tables' files, so vectors are neither broadcast nor shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.llm.shared import delete, read, saved, small, table_path
from driftframe.llm.vectors import batch_arrays, best, usable

#: Pivots, chosen from a sample of at most so many vectors (those of least hash); vectors of a slice, or more so that
#: there are about SLICES slices at most, whose bounds every task knows.
PIVOTS, SAMPLE, SLICE, SLICES = 32, 4096, 1024, 1 << 18
#: Components of all vectors of that sample; tasks of a round.
SAMPLE_VALUES, TASKS = 1 << 22, 4096
#: Queries that go through the rounds together; growth of the number of slices that each visits in a round.
ASKED, STEP = 1024, 4
#: A chunk of queries between rounds: for each its hits so far, its distances to all pivots (a row for each pivot), the places in its order of slices
#: up to which it visited them and to which it does next, and the marks of both; for all, the slices that any of them visits next.
_STATE = "chunk long, ids binary, vs binary, hits binary, scores binary, apart binary, done binary, end binary, marks binary, wanted array<long>, open long"


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors x, each far from those before it, then moved to the mean of what is nearest to it."""
    chosen, apart = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < n and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, np.linalg.norm(x - x[chosen[-1]], axis=1))
    pivots = x[chosen].copy()
    for _ in range(5):
        own = ((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)).argmin(axis=1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = x[own == p].mean(axis=0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0))


def quantised(x: np.ndarray) -> np.ndarray:
    return np.floor(256 * x)


def _lengthened(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], axis=1)


def _packed(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _kind(most: float) -> str:
    """The smallest type that holds the whole components of all vectors of at most that squared length."""
    return "<i2" if most < 2.0**30 else "<i4" if most < 2.0**62 else "<f8"


def sampled(found: DataFrame, n: int, sample: int, width: int) -> np.ndarray:
    """The vectors of those sample of the n rows (id, v) of least hash. Executors drop all but about twice as many before any are gathered."""
    sample = min(sample, max(PIVOTS, SAMPLE_VALUES // width))
    marked = found.withColumn("mark", F.xxhash64("id", F.monotonically_increasing_id()))  # rows of one id are told apart
    share = (2 * sample + 64) / n
    if share < 1:
        marked = marked.where(F.col("mark") < int(2.0**64 * share) - 2**63)
    picked = marked.orderBy("mark").limit(sample).select("id", "v").toArrow().combine_chunks()
    return batch_arrays(picked.to_batches()[0], width)[1]


def _one_row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _sorted_slices(found: DataFrame, pivots: np.ndarray, width: int, most: float, slice_size: int) -> tuple[DataFrame, DataFrame]:
    """The keyed vectors, and one row for each slice: slice, pivot, low, high, ids, vs."""
    kind = _kind(most)

    def keyed(batches):
        for b in batches:
            ids, v = batch_arrays(b, width)
            v = quantised(v)
            apart = _distances(_lengthened(v, most), pivots)
            own = apart.argmin(axis=1)
            cols = [pa.array(ids), pa.array(own.astype(np.int32)), pa.array(apart[np.arange(len(own)), own]), pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "pivot", "apart", "v", "salt"])

    # rows equal in all are told apart by where they were read: any slice may hold them
    index = saved(found.withColumn("salt", F.spark_partition_id()).mapInArrow(keyed, "id long, pivot int, apart double, v binary, salt int"), "keyed")
    # rings of a pivot: cuts at even ranks of its distances, from a histogram; equal distances are told apart by a hash
    rings = index.groupBy("pivot").agg(F.min("apart").alias("low"), F.max("apart").alias("high"))
    placed = index.join(F.broadcast(rings), "pivot")  # at most PIVOTS rows
    coarse = F.least(F.lit(4095), F.floor(4096 * (F.col("apart") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)))).cast("int")
    placed = placed.withColumn("coarse", coarse).drop("low", "high")
    heights = placed.groupBy("pivot", "coarse").agg(F.count("*").alias("h"))  # at most 4096 rows for each pivot
    before = F.coalesce(F.sum("h").over(Window.partitionBy("pivot").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heights = heights.withColumn("ring", F.floor(before / slice_size)).withColumn("parts", F.ceil(F.col("h") / slice_size)).select("pivot", "coarse", "ring", "parts")
    placed = placed.join(F.broadcast(heights), ["pivot", "coarse"])  # at most 4096 * PIVOTS rows
    placed = placed.withColumn("slice", F.xxhash64("pivot", "ring", F.pmod(F.xxhash64("id", "v", "salt"), F.col("parts"))))
    schema = pa.schema([("slice", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("vs", pa.binary())])

    def pack(rows: pa.Table) -> pa.Table:
        ids, apart = rows["id"].to_numpy(), rows["apart"].to_numpy()
        vs = b"".join(rows["v"].to_pylist())
        return pa.Table.from_batches([_one_row([rows["slice"][0].as_py(), rows["pivot"][0].as_py(), apart.min(), apart.max(), _packed(ids, "<i8"), vs], schema)])

    made = placed.select("slice", "pivot", "apart", "id", "v").groupBy("slice").applyInArrow(pack, "slice long, pivot int, low double, high double, ids binary, vs binary")
    return index, saved(made, "slices")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, sample: int = SAMPLE, slice_size: int = SLICE, visits: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id is divisible by every, the k rows of largest
    integer inner product of floor(256 * component), the query's own vec_id left out; ties to smaller vec_id.

    rows (vec_id, embedding, ...): null vec_ids and vectors that are null or hold null or non-finite
    components take no part. Rows that share a vec_id are all candidates of other queries; as a query,
    the vector of least hash stands for them. Components are taken up to 2**20 in size
    (2**53 for all products together), beyond which scores are rounded. With visits, the columns visited and slices say
    how many slices the query visited of how many. Other columns are not looked at.
    """
    spark = rows.sparkSession
    found = usable(rows)
    schema = "query_id long, rank int, vec_id long, score long" + (", visited long, slices long" if visits else "")
    square = F.expr("aggregate(v, 0D, (s, x) -> s + floor(256 * x) * floor(256 * x))")
    shape = found.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("most"), F.count("*").alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    width, most = max(1, shape["width"]), float(shape["most"])
    pivots = farthest_first(_lengthened(quantised(sampled(found, shape["n"], sample, width)), most), PIVOTS)  # PIVOTS vectors: a fixed size
    index, made = _sorted_slices(small(found), pivots, width, most, max(slice_size, shape["n"] // SLICES))
    listing = made.select("slice", "pivot", "low", "high").orderBy("pivot", "low", "slice").toArrow()  # about SLICES rows at most
    numbers, pivot, low, high = (c.to_numpy() for c in listing.columns)
    by_number = np.argsort(numbers)
    kind = _kind(most)

    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = queries.count()
    names = ("ids", "vs", "hits", "scores", "apart", "done", "end", "marks")
    state_schema = pa.schema([("chunk", pa.int64()), *((n, pa.binary()) for n in names), ("wanted", pa.list_(pa.int64())), ("open", pa.int64())])

    def state_row(chunk, ids, vs, hits, scores, apart, done, live, step) -> pa.Table:
        """A chunk whose queries visited so many slices, with those that each live one visits next: of the step slices that follow in its order, those a hit can be in."""
        v = np.frombuffer(vs, kind).reshape(-1, width).astype(np.float64)
        kth, own = scores[:, -1], (v * v).sum(1)
        # how far a hit can be, with room for rounding
        reach = np.sqrt(np.maximum(own + most - 2 * np.maximum(kth, -4 * (own + most + 1)), 0)) + 1e-6 * np.sqrt(own + most + 1)
        reach[np.isinf(kth)] = np.inf
        end, marks, wanted = done.copy(), np.full((len(v), 6), np.inf), np.zeros(len(numbers), bool)
        for q in np.flatnonzero(live).tolist():
            d = apart[pivot, q]
            bound = np.maximum(0, np.maximum(low - d, d - high))
            order = np.lexsort((d, bound))
            end[q] = max(done[q], min(done[q] + step, np.searchsorted(bound[order], reach[q], "right")))
            wanted[order[done[q] : end[q]]] = True
            for i, at in enumerate((done[q], end[q])):
                if at < len(order):
                    marks[q, 3 * i : 3 * i + 3] = bound[order[at]], d[order[at]], order[at]
        values = [chunk, ids, vs, _packed(hits, "<i8"), _packed(scores, "<f8"), _packed(apart, "<f8"), _packed(done, "<i8"), _packed(end, "<i8"), _packed(marks.T, "<f8")]
        return pa.Table.from_batches([_one_row([*values, numbers[wanted], int((end > done).sum())], state_schema)])

    def begin(rows: pa.Table) -> pa.Table:
        n, ids, vs = rows.num_rows, _packed(rows["id"].to_numpy(), "<i8"), b"".join(rows["v"].to_pylist())
        v = np.frombuffer(vs, kind).reshape(-1, width).astype(np.float64)
        apart = np.ascontiguousarray(_distances(np.concatenate([v, np.zeros((n, 1))], axis=1), pivots).T)
        return state_row(rows["chunk"][0].as_py(), ids, vs, np.full((n, k), -1, np.int64), np.full((n, k), -np.inf), apart, np.zeros(n, np.int64), np.full(n, True), 1)

    def read_state() -> DataFrame:
        return small(spark.read.schema(_STATE).parquet(path))

    chunks = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-asked // ASKED)))))
    path = table_path(spark, "state")
    chunks.select("chunk", "id", "v").groupBy("chunk").applyInArrow(begin, _STATE).write.parquet(path)
    state = read_state()

    hit_schema = pa.schema([("chunk", pa.int64()), ("qs", pa.binary()), ("hits", pa.binary()), ("scores", pa.binary())])

    def search(batches):
        """One matrix product of a slice and those of a chunk's queries that visit it; of each query up to k hits that reach its k-th so far."""
        for b in batches:
            for chunk, qids, qvs, kth, d, marks, number, low, high, ids, vs in zip(*(c.to_pylist() for c in b.columns)):
                qids, kth, d, ids = np.frombuffer(qids, "<i8"), np.frombuffer(kth).reshape(-1, k)[:, -1], np.frombuffer(d), np.frombuffer(ids, "<i8")
                bound, at = np.maximum(0, np.maximum(low - d, d - high)), by_number[np.searchsorted(numbers, number, sorter=by_number)]

                def before(mark, bound=bound, d=d, at=at):  # the slice in each query's order
                    return (bound < mark[0]) | (bound == mark[0]) & ((d < mark[1]) | (d == mark[1]) & (at < mark[2]))

                marks = np.frombuffer(marks).reshape(6, -1)
                q = np.flatnonzero(before(marks[3:]) & ~before(marks[:3]))
                if not len(q):
                    continue
                scores = np.frombuffer(qvs, kind).reshape(-1, width)[q].astype(np.float64) @ np.frombuffer(vs, kind).reshape(-1, width).astype(np.float64).T
                found = (scores >= kth[q][:, None]) & (ids != qids[q][:, None])
                out = []
                for i in np.flatnonzero(found.any(axis=1)).tolist():
                    other = np.flatnonzero(found[i])
                    one = other[best(scores[i][other], ids[other], k)]
                    out.append((np.full(len(one), q[i]), ids[one], scores[i][one]))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out)]
                    yield _one_row([chunk, _packed(cols[0], "<i4"), _packed(cols[1], "<i8"), _packed(cols[2], "<f8")], hit_schema)

    def merge(step: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk, ids, vs, hits, scores, apart, done, end = (c[0].as_py() for c in left.columns[:8])
            done, end = np.frombuffer(done, "<i8"), np.frombuffer(end, "<i8")
            n = len(end)
            q = np.concatenate([np.repeat(np.arange(n), k), *(np.frombuffer(x, "<i4") for x in right["qs"].to_pylist())])
            h = np.concatenate([np.frombuffer(x, "<i8") for x in (hits, *right["hits"].to_pylist())])
            s = np.concatenate([np.frombuffer(x) for x in (scores, *right["scores"].to_pylist())])
            order = np.lexsort((h, -s, q))
            q, h, s = q[order], h[order], s[order]
            first = np.searchsorted(q, np.arange(n))[:, None] + np.arange(k)  # each query has k places already
            return state_row(chunk, ids, vs, h[first], s[first], np.frombuffer(apart).reshape(len(pivots), n), end, end > done, step)  # who visited nothing stops

        return run

    step = 1
    while not state.where("open > 0").isEmpty():
        step *= STEP
        slices = made.coalesce(max(1, TASKS // max(1, state.rdd.getNumPartitions())))
        asking = state.where("open > 0").select("chunk", F.col("ids").alias("qids"), F.col("vs").alias("qvs"), "scores", "apart", "marks", "wanted")
        both = slices.join(asking.hint("shuffle_replicate_nl"), F.expr("array_contains(wanted, slice)"))
        own = F.expr("substring(apart, pivot * length(qids) + 1, length(qids))")  # distances to the slice's pivot
        hits = both.select("chunk", "qids", "qvs", "scores", own, "marks", "slice", "low", "high", "ids", "vs").mapInArrow(search, "chunk long, qs binary, hits binary, scores binary")
        old, path = path, table_path(spark, "state")
        state.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(merge(step), _STATE).write.parquet(path)
        state = read_state()
        delete(spark, old)

    def rows_of(batches):
        for b in batches:
            for ids, hits, scores, visited in zip(*(c.to_pylist() for c in b.columns)):
                ids, hits, scores = np.frombuffer(ids, "<i8"), np.frombuffer(hits, "<i8"), np.frombuffer(scores)
                kept = np.flatnonzero(np.isfinite(scores))
                cols = [pa.array(ids[kept // k]), pa.array((kept % k + 1).astype(np.int32)), pa.array(hits[kept]), pa.array(scores[kept].astype(np.int64))]
                names = ["query_id", "rank", "vec_id", "score"]
                if visits:
                    cols, names = [*cols, pa.array(np.frombuffer(visited, "<i8")[kept // k]), pa.array(np.full(len(kept), len(numbers)))], [*names, "visited", "slices"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return state.select("ids", "hits", "scores", "done").mapInArrow(rows_of, schema)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query its exact best, from the pivot-distance index."""
    return top_k(read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
) WHERE rank <= 5
"""
