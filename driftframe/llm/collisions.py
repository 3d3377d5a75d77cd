"""Approximate nearest neighbours by collision counting.

Each of many single projections keeps the vectors of a block in a sorted array. Around a query's own
projection a window grows by virtual rehashing; a vector collides with the query in each projection whose window
holds it. Vectors whose collisions reach a threshold are verified by the whole inner product. The window grows until it is as wide
as vectors at the distance of the k-th hit ask for: nothing but the threshold decides who is verified.

Projections come in whole orthogonal frames, so that a difference of length d has a component of d / sqrt(dimensions)
in each on average: a window of half-width WIDTH times that holds it in a known share of projections.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import read, saved, small
from driftframe.llm.vectors import batch_arrays, usable

#: Frames of projections; half-width of a window for components of unit spread; by how many standard deviations the threshold
#: is below the collisions to expect; growth of a window; vectors of a block; queries that meet a block together.
FRAMES, WIDTH, BELOW, GROWTH, BLOCK, ASKED = 2, 1.5, 0.5, 1.05, 16384, 1024
SEED = 42


def projections(width: int, frames: int = FRAMES, seed: int = SEED) -> np.ndarray:
    """Unit directions, as columns: frames of orthogonal ones."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(frames)], axis=1)


def threshold(m: int) -> int:
    """In how many of m projections a candidate collides at least."""
    p = erf(WIDTH / sqrt(2))
    return int(m * (p - BELOW * sqrt(p * (1 - p) / m)))


class Block:
    """Sorted projections of one block of vectors, lengthened so that the least distance is the largest inner product."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, directions: np.ndarray):
        self.ids, self.x, self.most, self.directions = ids, x, most, directions
        long = np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], axis=1)
        p = long @ directions
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(p.T), self.order, axis=1)
        # windows begin at a distance that few pairs are below
        some = long[:: max(1, len(long) // 128)][:128]
        apart = np.sqrt(np.maximum((some * some).sum(1)[:, None] + (some * some).sum(1) - 2 * some @ some.T, 0))
        pairs = apart[np.triu_indices(len(some), 1)]
        self.start = max(float(np.quantile(pairs, 0.01)) if len(pairs) else 0.0, 1e-6 * sqrt(most))

    def search(self, one: int, query: np.ndarray, k: int, kth: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best of what is verified for a query, those of its own id left out, and how many were verified.

        kth: a score that k others are known to have, as far as that stops the search earlier.
        """
        m, n = self.order.shape
        at, least, own = np.concatenate([query, [0.0]]) @ self.directions, threshold(m), float(query @ query)
        scores, seen, n_others = np.full(n, -np.inf), np.zeros(n, bool), int((self.ids != one).sum())
        reach = lambda score: sqrt(max(own + self.most - 2 * score, 0)) if np.isfinite(score) else np.inf
        radius = 0.97 * reach(kth) if np.isfinite(kth) else self.start  # what the bound still tightens by is little
        while True:
            wide = WIDTH * radius / sqrt(len(self.directions))
            lo = [s.searchsorted(a - wide, side="left") for s, a in zip(self.sorted, at)]
            hi = [s.searchsorted(a + wide, side="right") for s, a in zip(self.sorted, at)]
            # a window holds most of its array by now: what stays outside is the shorter list
            outside = [o[:i] for o, i in zip(self.order, lo)] + [o[i:] for o, i in zip(self.order, hi)]
            fresh = np.flatnonzero((m - np.bincount(np.concatenate(outside), minlength=n) >= least) & ~seen)
            seen[fresh] = True
            if len(fresh):
                # summed from the first component to the last, as a plain loop would
                scores[fresh] = np.where(self.ids[fresh] == one, -np.inf, np.cumsum(self.x[fresh] * query, axis=1)[:, -1])
            best = max(kth, float(np.partition(scores, n - k)[n - k]) if n > k else -np.inf)
            if radius >= reach(best) or np.isfinite(scores).sum() >= n_others:
                break
            radius = min(radius * GROWTH, max(reach(best), 1.001 * radius))
        found = np.flatnonzero(np.isfinite(scores))
        found = found[np.lexsort((self.ids[found], -scores[found]))[:k]]
        return found, scores[found], int(seen.sum())


_ASKED = pa.schema([("chunk", pa.int64()), ("home", pa.int64()), ("ids", pa.binary()), ("vs", pa.binary()), ("kth", pa.binary())])
_FOUND = pa.schema([*_ASKED, ("qs", pa.binary()), ("hits", pa.binary()), ("scores", pa.binary())])


def nearest(rows: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, up to k rows of about
    the largest inner products in double precision, the query's own vec_id left out; ties to smaller vec_id.

    rows (vec_id, embedding, ...): null vec_ids and vectors that are null, zero or hold null or non-finite components
    take no part. Every other row is indexed, in blocks of about block rows. Queries go in chunks: a chunk searches one block,
    whose k-th hits bound the windows in all others. All rows are returned if there are no more than k. Rows that share a vec_id are all candidates;
    as a query, the vector of least hash stands for them. Other columns are not looked at.
    """
    spark = rows.sparkSession
    found = usable(rows).where("exists(v, x -> x <> 0)")
    shape = found.agg(F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")), F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    if not shape[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, most, n = shape[0], float(shape[1]), shape[2]
    blocks, chunks = -(-n // block), max(1, -(-shape[3] // ASKED))
    directions = projections(width + 1)

    def packed(rows: pa.Table) -> pa.Table:
        ids, x = batch_arrays(rows.select(["id", "v"]).combine_chunks().to_batches()[0], width)
        order = np.argsort(ids, kind="stable")
        return pa.table({"block": rows["block"][:1], "bids": pa.array([ids[order].tobytes()], pa.binary()), "bvs": pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary())})

    def begin(rows: pa.Table) -> pa.Table:
        ids, x = batch_arrays(rows.select(["id", "v"]).combine_chunks().to_batches()[0], width)
        chunk = rows["chunk"][0].as_py()
        values = [chunk, chunk % blocks, ids.tobytes(), np.ascontiguousarray(x).tobytes(), np.full(len(ids), -np.inf).tobytes()]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(values, _ASKED.types)], schema=_ASKED)

    # rows equal in all are told apart by where they were read, so that no block gets many more than others
    dealt = found.withColumn("block", F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(blocks)))
    index = saved(dealt.groupBy("block").applyInArrow(packed, "block long, bids binary, bvs binary"), "blocks")
    asked = found.where(F.col("id") % every == 0).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    asked = asked.groupBy("chunk").applyInArrow(begin, "chunk long, home long, ids binary, vs binary, kth binary")

    def search(batches):
        """rows (chunk, home, ids, vs, kth, bids, bvs): a chunk's queries in a block, with the k-th scores known after it."""
        last, of = None, None
        for b in batches:
            for chunk, home, ids, vs, kth, bids, bvs in zip(*(c.to_pylist() for c in b.columns)):
                if bids != last:
                    own = np.frombuffer(bids, "<i8")
                    last, of = bids, Block(own, np.frombuffer(bvs).reshape(len(own), -1), most, directions)
                ones, queries, bound = np.frombuffer(ids, "<i8"), np.frombuffer(vs).reshape(-1, width), np.frombuffer(kth).copy()
                out = []
                for i, (one, q) in enumerate(zip(ones.tolist(), queries)):
                    at, scores, _ = of.search(one, q, k, bound[i])
                    out.append((np.full(len(at), i, np.int32), of.ids[at], scores))
                    if len(at) == k:
                        bound[i] = max(bound[i], scores[-1])
                qs, hits, scores = (np.concatenate(c) for c in zip(*out))
                values = [chunk, home, ids, vs, bound.tobytes(), qs.tobytes(), hits.astype("<i8").tobytes(), scores.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _FOUND.types)], schema=_FOUND)

    schema = "chunk long, home long, ids binary, vs binary, kth binary, qs binary, hits binary, scores binary"
    cols = ["chunk", "home", "ids", "vs", "kth"]
    first = saved(small(asked.join(index, F.col("home") == F.col("block")).select(*cols, "bids", "bvs")).mapInArrow(search, schema), "first")
    hits = first.select("chunk", "ids", "qs", "hits", "scores")
    if blocks > 1:
        # one row for each chunk and block, not for each query
        rest = first.select(*cols, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("to")).where("to <> home")
        both = small(rest.join(index, F.col("to") == F.col("block")).select(*cols, "bids", "bvs").sortWithinPartitions("block"))
        hits = hits.unionAll(both.mapInArrow(search, schema).select("chunk", "ids", "qs", "hits", "scores"))

    def ranked(rows: pa.Table) -> pa.Table:
        ids = np.frombuffer(rows["ids"][0].as_py(), "<i8")
        q = np.concatenate([np.frombuffer(x, "<i4") for x in rows["qs"].to_pylist()])
        h, s = (np.concatenate([np.frombuffer(x, t) for x in rows[c].to_pylist()]) for c, t in (("hits", "<i8"), ("scores", "<f8")))
        order = np.lexsort((h, -s, q))
        q, h, s = q[order], h[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
        kept = rank <= k
        return pa.table({"query_id": ids[q[kept]], "rank": rank[kept].astype(np.int32), "vec_id": h[kept], "score": s[kept]})

    return hits.groupBy("chunk").applyInArrow(ranked, "query_id long, rank int, vec_id long, score double")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query its nearest vectors that collision counting finds."""
    return nearest(read(spark, sf_dir, "embeddings"))
