"""SimHash near-duplicates, found by deletion-variant signatures.

Fingerprints that differ in at most 2 bits, cut into 2 segments, differ in at most
1 bit of one segment. Each fingerprint is indexed under every segment with one bit
wiped out; an equality join of these variants and a comparison of whole fingerprints
give exactly the pairs sought. A variant that many fingerprints share is indexed
again on the other segment in the same way: its rest of 32 bits is cut in 2, then
that rest of 16, after which at most 2**11 fingerprints can share a variant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.llm.shared import bounded, components, dealt, forest, gathered, looked_up, mix64, partitions, read, saved, trimmed

#: Variants that more fingerprints share are indexed again, not compared pairwise.
CROWD = 256


def shingle_slices(text: str, words: int) -> list[bytes]:
    """The shingles of text: A-Z lower-cased, words divided by ASCII white space; fewer words give the whole sequence."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-words].tolist()]
    return [joined[s:e] for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """Which of the 64 bits are set in over half of the hashes, as one unsigned number."""
    counts = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, words: int = 3) -> int:
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingle_slices(text or "", words)], dtype=np.uint64)
    return int(bits_set(h)) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row: fp the 64 bits of the fingerprint as a signed long; 0 for null or empty texts."""

    @trimmed
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, fp long")


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """rows (key, fp, rest), rest of width bits, once for each one-wildcard variant of each half of rest."""
    half = width // 2
    full = (1 << half) - 1
    return (
        rows.withColumn("v", F.explode(F.expr(f"sequence(0, {width - 1})")))
        .select(
            F.expr(f"xxhash64(key, v, shiftrightunsigned(rest, (v div {half}) * {half}) & ({full}L ^ shiftleft(1L, v % {half})))").alias("key"),
            "fp",
            F.expr(f"shiftrightunsigned(rest, (1 - v div {half}) * {half}) & {full}L").alias("rest"),
        )
        .select("key", "fp", "rest")
    )


def _close_in_group(bits: int):
    """Links of at most so many differing bits within each key's rows; keys here have a bounded number of rows."""

    @trimmed
    def run(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not rows:
            return
        key, fp = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        a, b, d = [], [], 1
        at = np.arange(len(key))
        while len(at := at[at + d < len(key)][key[at[at + d < len(key)]] == key[at[at + d < len(key)] + d]]):
            near = at[np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= bits]
            a.append(fp[near])
            b.append(fp[near + d])
            d += 1
        kept = forest(np.concatenate(a), np.concatenate(b)) if a else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect just what fingerprints at 2 or fewer differing bits connect; fps: distinct (fp)."""
    links, width = None, 64
    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest"))
    while True:
        # counted in the one exchange by key; a hot key's rows spill, none are held in memory together
        made = _variants(rows, width).withColumn("n", F.count("*").over(Window.partitionBy("key")))
        shared = saved(made.where("n > 1"), "variants")
        width //= 2
        last = width <= 8
        small = shared if last else shared.where(F.col("n") <= crowd)
        found = small.select("key", "fp").repartition(partitions(fps.sparkSession), "key").mapInArrow(_close_in_group(2), "a long, b long")
        links = found if links is None else links.unionAll(found)
        rows = shared.where(F.col("n") > crowd).select("key", "fp", "rest")
        if last or rows.isEmpty():
            return links


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text, ...).

    Fingerprints of words-word shingles link at 2 or fewer differing bits; component_id
    is the smallest doc_id of all rows reachable over links, the row's own included.
    Null and empty texts have fingerprint 0 and link like any other. Rows repeat as in the
    input. A null doc_id is never a component_id unless its whole component has none.
    Other columns are not looked at.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = saved(components(fingerprint_links(distinct.select("fp"))), "components")
    named = found.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    least = saved(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "least")
    of = looked_up(found, least, ["component"]).select(F.col("node").alias("fp"), "component_id")
    own = saved(distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "own")
    return looked_up(rows, own, ["fp"]).select("doc_id", "fp", "component_id")


# Near-duplicates by similarity: a wider fingerprint, in more segments.
#
# Texts of Jaccard similarity 0.8 differ in about 15 % of their fingerprints' bits: of 8 segments
# of 16 bits, one then differs in at most 1 bit with a chance of 0.93 (0.85: 0.97; 0.9: 0.996). What shares
# a one-wildcard variant of a segment is compared by the whole fingerprint; what is near
# enough there is verified by the shingles themselves.
#
# In the first round a fingerprint is verified with KEPT candidates over all its variants: the closest ones and the
# one of least number, so that large groups of copies mostly hang together after a few pairs for each.
# Fingerprints with more candidates meet again in the next rounds, where candidates
# that links already connect don't count and MORE times as many of each variant are sent, until none has more. So
# no candidate is left out but between texts already connected.
#
# From the second round on, candidates are verified in cells: fingerprints that the first round's candidates
# connect are divided into blocks, a cell holds the candidates between two blocks, and a set of shingles is
# sent once to each cell that needs it, not once for each of its candidates.
#
# A variant of more than HOT fingerprints is divided: in the first round into blocks of about HOT, of which each looks at
# itself alone (all of it may have more); later into one run for each two blocks, which together hold all pairs.
SEGMENTS, SEGMENT_BITS, NEAR_BITS, SAME_BITS, MORE, KEPT = 8, 16, 28, 16, 16, 4
#: A variant of more fingerprints is hot; a task counts only variants that it holds so many of itself.
HOT, SEEN = 4096, 64
#: A block has about so many fingerprints, or so many bytes of shingles, at most.
BLOCK_NODES, BLOCK_BYTES = 512, 4 << 20
#: Variants of more fingerprints are compared by way of heads, each for all fingerprints nearly equal to it.
LARGE = 512
#: Variants are numbered below this; runs of a divided one from here on.
VARIANTS = SEGMENTS * SEGMENT_BITS << SEGMENT_BITS
_FIRST = np.dtype([("k", "<u4"), ("f", "<u8", 2), ("s", "<i8")])  # with the hash of the set of shingles
_NAMED = np.dtype([("k", "<u4"), ("f", "<u8", 2), ("s", "<i8"), ("c", "<i8"), ("block", "<i8")])  # with what the fingerprint is connected to, and its block
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_APART = np.dtype([("a", "<i8"), ("b", "<i8"), ("d", "u1")])
_IN_CELL = np.dtype([("cell", "<i8"), ("a", "<i8"), ("b", "<i8")])


def _digests(shingles: list[bytes]) -> np.ndarray:
    """Of the distinct shingles: the distance of fingerprints then follows the similarity of sets, whatever repeats."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(s) for s in set(shingles)]), np.uint64).reshape(-1, 2)


def _majority(raw: np.ndarray) -> tuple[int, int]:
    return (int(bits_set(raw[:, 0])), int(bits_set(raw[:, 1]))) if len(raw) else (0, 0)


def _wide(shingles: list[bytes]) -> tuple[int, int]:
    return _majority(_digests(shingles))


def _set_hash(raw: np.ndarray) -> int:
    """Of the set of shingles, whatever their order."""
    return xxhash.xxh3_64_intdigest(np.sort(raw[:, 0]).tobytes())


def _nodes(f: np.ndarray, s: np.ndarray | int = 0) -> np.ndarray:
    """One long for each fingerprint of two uint64 and hash of a set."""
    return mix64(f[:, 0] ^ mix64(f[:, 1])).view(np.int64) ^ s


def _wide_fingerprints(words: int):
    """(doc_id, node, f0, f1, s, hash, set) of each text; set: 32 bits of each distinct shingle's hash, in order."""

    @trimmed
    def run(batches):
        for b in batches:
            raws = [_digests(shingle_slices(t or "", words)) for t in b.column(1).to_pylist()]
            f = np.array([_majority(r) for r in raws], np.uint64).reshape(-1, 2)
            s = np.array([_set_hash(r) for r in raws], np.uint64).view(np.int64)
            sets = pa.array([np.unique((r[:, 0] >> np.uint64(32)).astype("<u4")).tobytes() for r in raws], pa.binary())
            cols = [b.column(0), pa.array(_nodes(f, s)), *(pa.array(f[:, i].copy().view(np.int64)) for i in (0, 1)), pa.array(s), b.column(2), sets]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "f0", "f1", "s", "hash", "set"])

    return run


def _variant_keys(f: np.ndarray, s: int) -> np.ndarray:
    """The SEGMENT_BITS one-wildcard variants of segment s of each fingerprint: variants by fingerprints."""
    bits = (f[:, s // 4] >> np.uint64(SEGMENT_BITS * (s % 4))) & np.uint64(0xFFFF)
    p = np.arange(SEGMENT_BITS, dtype=np.uint64)[:, None]
    return (bits[None] & (np.uint64(0xFFFF) ^ (np.uint64(1) << p)) | ((np.uint64(s * SEGMENT_BITS) + p) << np.uint64(SEGMENT_BITS))).astype(np.uint32)


def _variant_counts(least: int):
    """(k, n) of the variants that this task holds so many of."""

    @trimmed
    def run(batches):
        counts = np.zeros(VARIANTS, np.int32)
        for b in batches:
            f = np.stack([b.column(i).to_numpy().view(np.uint64) for i in (0, 1)], axis=1)
            for s in range(SEGMENTS):
                k, n = np.unique(_variant_keys(f, s), return_counts=True)
                counts[k] += n.astype(np.int32)
        k = np.flatnonzero(counts >= least)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k].astype(np.int64))], ["k", "n"])

    return run


def _hot_blocks(classes: DataFrame) -> np.ndarray | None:
    """Into how many blocks each variant is divided (VARIANTS numbers: a fixed size), or None if all are whole."""
    counts = classes.select("f0", "f1").mapInArrow(_variant_counts(SEEN), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > HOT).toArrow()  # one row for each variant at most
    if not found.num_rows:
        return None
    blocks = np.ones(VARIANTS, np.uint16)
    blocks[found["k"].to_numpy()] = np.minimum(-(-found["n"].to_numpy() // HOT), 65535)
    return blocks


def _segment_variants(targets: int, entry: np.dtype, blocks):
    """rows (f0, f1, s, what else entry has) once for each variant, dealt by it; blocks: None or a broadcast of _hot_blocks."""
    whole = entry is _FIRST

    def run_of(k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # two runs that get one number are compared together: more work, not other results
        h = mix64(mix64(k.astype(np.uint64) << np.uint64(16) | i.astype(np.uint64)) + j.astype(np.uint64))
        return (np.uint64(VARIANTS) + h % np.uint64((1 << 32) - VARIANTS)).astype(np.uint32)

    @trimmed
    def run(batches):
        for b in batches:
            f = np.stack([b.column(i).to_numpy().view(np.uint64) for i in (0, 1)], axis=1)
            rows = np.zeros((SEGMENTS * SEGMENT_BITS, len(f)), entry)  # a bounded batch, sent as one row for each target
            rows["k"], rows["f"] = np.concatenate([_variant_keys(f, s) for s in range(SEGMENTS)]), f
            for i, name in enumerate(entry.names[2:]):  # s and what follows
                rows[name] = b.column(2 + i).to_numpy()
            rows = rows.ravel()
            if blocks is not None and (hot := blocks.value[rows["k"]] > 1).any():
                cut = rows[hot]
                n = blocks.value[cut["k"]].astype(np.int64)
                own = np.tile(_nodes(f, b.column(2).to_numpy()).view(np.uint64), SEGMENTS * SEGMENT_BITS)[hot]
                i = (own % n.astype(np.uint64)).astype(np.int64)
                j = i if whole else np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if not whole:
                    cut, i = np.repeat(cut, n), np.repeat(i, n)
                cut["k"] = run_of(cut["k"], np.minimum(i, j), np.maximum(i, j))
                rows = np.concatenate([rows[~hot], cut])
            if out := dealt((mix64(rows["k"].astype(np.uint64)) % np.uint64(targets)).astype(np.int64), rows):
                yield out

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _to_heads(f: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For a large run: arrays (i, j, distance) of each fingerprint's closest and first near head, and which may have more.

    What is near to a fingerprint is at most NEAR_BITS + SAME_BITS from the head of that one.
    """
    rest, more = np.arange(len(f)), np.zeros(len(f), bool)
    best, best_d, first = np.full(len(f), -1), np.full(len(f), NEAR_BITS + 1), np.full(len(f), -1)
    while len(rest):
        head, apart = rest[0], _distance(f, f[rest[0]])
        reach = apart <= NEAR_BITS + SAME_BITS
        more |= reach & (reach.sum() > 1)
        apart[head] = NEAR_BITS + 1
        first[(apart <= NEAR_BITS) & (first < 0)] = head
        closer = apart < best_d
        best[closer], best_d[closer] = head, apart[closer]
        rest = rest[1:][apart[rest[1:]] > SAME_BITS]
    i = np.concatenate([np.flatnonzero(best >= 0), np.flatnonzero(first >= 0)])
    j = np.concatenate([best[best >= 0], first[first >= 0]])
    return [i, j, _distance(f[i], f[j])], more


def _to_members(f: np.ndarray, c: np.ndarray, each: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For a large run: (i, j, distance) of at least each fingerprint's closest and first near ones not connected to it,
    and which have more. What is connected to most of the run is never compared with itself."""
    found, n = [np.zeros((3, 0), np.int64)], np.zeros(len(f), np.int64)
    names, many = np.unique(c, return_counts=True)
    rest, body = np.flatnonzero(c != names[many.argmax()]), np.flatnonzero(c == names[many.argmax()])
    for left, right in ((rest, np.arange(len(f))), (body, rest)):
        if not len(right):
            continue
        for at in np.split(left, range(rows := max(1, (1 << 20) // len(right)), len(left), rows)):
            d = _distance(f[at][:, None], f[right][None])
            near = (d <= NEAR_BITS) & (c[at][:, None] != c[right][None])
            n[at] += near.sum(axis=1)
            d[~near] = NEAR_BITS + 1
            closest = np.argsort(d, axis=1, kind="stable")[:, :each]
            some = near.any(axis=1)
            x = np.concatenate([np.repeat(np.arange(len(at)), closest.shape[1]), np.flatnonzero(some)])
            y = np.concatenate([closest.ravel(), near.argmax(axis=1)[some]])
            x, y = x[near[x, y]], y[near[x, y]]
            found.append(np.stack([at[x], right[y], d[x, y]]))
    return list(np.concatenate(found, axis=1)), n > each


def _near(rows: np.ndarray, each: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, near node, distance): in each run, of each fingerprint its closest near ones, as many as each, and the first.

    Near ones connected already don't count. The second result has the nodes that may have more.
    """
    s = rows["s"] if "s" in rows.dtype.names else np.zeros(len(rows), np.int64)
    order = np.lexsort((s, rows["f"][:, 1], rows["f"][:, 0], rows["k"]))  # whatever order they came in
    rows, s = rows[order], s[order]
    k, f, node = rows["k"], rows["f"], _nodes(rows["f"], s)
    c, found, more = rows["c"] if "c" in rows.dtype.names else None, [np.zeros((3, 0), np.int64)], np.zeros(len(rows), bool)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
    size = np.diff(begin)
    for r in np.flatnonzero(size > large):
        own = slice(begin[r], begin[r + 1])
        (i, j, d), more[own] = _to_heads(f[own]) if c is None else _to_members(f[own], c[own], each)
        found.append(np.stack([i + begin[r], j + begin[r], d]))
    at = np.flatnonzero(np.repeat(size, size) <= large)
    step = 1
    while len(at):
        at = at[at + step < len(k)]
        at = at[k[at] == k[at + step]]
        d = _distance(f[at], f[at + step])
        near = d <= NEAR_BITS
        if c is not None:
            near &= c[at] != c[at + step]
        a, b, d = at[near], at[near] + step, d[near]
        found += [np.stack([a, b, d]), np.stack([b, a, d])]
        step += 1
    i, j, d = np.concatenate(found, axis=1)
    _, one = np.unique(i * len(rows) + j, return_index=True)  # in the order of i, then j
    i, j, d = i[one], j[one], d[one]
    chosen = np.zeros(len(i), bool)
    chosen[np.flatnonzero(np.diff(i, prepend=-1))] = True
    order = np.lexsort((j, d, i))
    starts = np.flatnonzero(np.diff(i, prepend=-1))  # i is sorted in both orders
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    chosen[order[rank < each]] = True
    more[i[~chosen]] = True
    if c is None:
        more |= k >= VARIANTS  # a part of a run: the other parts were not looked at
    out = np.empty(chosen.sum(), _APART)
    out["a"], out["b"], out["d"] = node[i[chosen]], node[j[chosen]], d[chosen]
    return np.unique(out[out["a"] != out["b"]]), np.unique(node[more])


def _near_pairs(rows: np.ndarray, each: int, large: int = LARGE) -> np.ndarray:
    """The same as distinct pairs a < b; a pair of a node with itself says that it may have more."""
    found, more = _near(rows, each, large)
    out = np.empty(len(found) + len(more), _PAIR)
    out["a"], out["b"] = np.concatenate([np.minimum(found["a"], found["b"]), more]), np.concatenate([np.maximum(found["a"], found["b"]), more])
    return np.unique(out)


def _packed_first(targets: int, large: int):
    @trimmed
    def run(batches):
        rows = gathered(batches, _FIRST)
        if len(rows):
            found, more = _near(rows, 1, large)
            same = np.empty(len(more), _APART)
            same["a"], same["b"], same["d"] = more, more, 255
            found = np.concatenate([found, same])
            if out := dealt((mix64(found["a"].view(np.uint64)) % np.uint64(targets)).astype(np.int64), found):
                yield out

    return run


def _chosen(found: np.ndarray) -> np.ndarray:
    """Pairs a < b: of all that a node's variants found its KEPT - 1 closest and the least; (a, a) if there may be more."""
    found = np.unique(found)
    same, found = found["a"][found["a"] == found["b"]], found[found["a"] != found["b"]]
    first = np.diff(found["a"], prepend=found["a"][:1] - 1) != 0  # in the order of a, then b
    order = np.lexsort((found["b"], found["d"], found["a"]))
    starts = np.flatnonzero(first)
    kept = first.copy()
    kept[order[np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found)))) < KEPT - 1]] = True
    more = np.unique(np.concatenate([same, found["a"][~kept]]))
    found = found[kept]
    out = np.empty(len(found) + len(more), _PAIR)
    out["a"], out["b"] = np.concatenate([np.minimum(found["a"], found["b"]), more]), np.concatenate([np.maximum(found["a"], found["b"]), more])
    return np.unique(out)


def _first_pairs(batches):
    pairs = _chosen(gathered(batches, _APART))
    yield pa.RecordBatch.from_arrays([pa.array(pairs["a"].copy()), pa.array(pairs["b"].copy())], ["a", "b"])


def _packed_cells(targets: int, each: int, large: int):
    @trimmed
    def run(batches):
        rows = gathered(batches, _NAMED)
        if len(rows):
            pairs = _near_pairs(rows, each, large)
            node, one = np.unique(_nodes(rows["f"], rows["s"]), return_index=True)
            low, high = np.sort([rows["block"][one][np.searchsorted(node, pairs[x])] for x in "ab"], axis=0).view(np.uint64)
            out = np.empty(len(pairs), _IN_CELL)
            out["a"], out["b"] = pairs["a"], pairs["b"]
            out["cell"] = np.where(pairs["a"] == pairs["b"], pairs["a"], mix64(mix64(low) + high).view(np.int64))
            if found := dealt((mix64(out["cell"].view(np.uint64)) % np.uint64(targets)).astype(np.int64), out):
                yield found

    return run


def _cell_rows(batches):
    """For each cell, its pairs as one row and each of its nodes as one; nodes that may have more without a cell."""
    found = np.unique(gathered(batches, _IN_CELL))
    same = found["a"] == found["b"]
    more, found = found["a"][same], found[~same]
    cuts = np.flatnonzero(np.diff(found["cell"])) + 1
    for own in np.split(found, cuts) if len(found) else []:
        nodes = np.unique([own["a"], own["b"]])
        pairs = np.empty(len(own), _PAIR)
        pairs["a"], pairs["b"] = own["a"], own["b"]
        cell = pa.array(np.full(1 + len(nodes), own["cell"][0]))
        yield pa.RecordBatch.from_arrays([cell, pa.array([None, *nodes.tolist()], pa.int64()), pa.array([pairs.tobytes()] + [None] * len(nodes), pa.binary())], ["cell", "node", "pairs"])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.array(more.copy()), pa.nulls(len(more), pa.binary())], ["cell", "node", "pairs"])


def _alike(x: bytes, y: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _similar(similarity: float):
    @trimmed
    def run(batches):
        for b in batches:
            keep = pa.array([_alike(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def _links_of_cell(pairs: bytes, sets: dict[int, bytes], similarity: float) -> list[tuple[int, int]]:
    """Those similar pairs that join what was apart; pairs that these connect are not compared."""
    root = {x: x for x in sets}

    def find(x: int) -> int:
        while (y := root[x]) != x:
            root[x] = root[y]
            x = y
        return x

    kept = []
    for a, b in np.frombuffer(pairs, _PAIR).tolist():
        p, q = find(a), find(b)
        if p != q and _alike(sets[a], sets[b], similarity):
            root[max(p, q)] = min(p, q)
            kept.append((a, b))
    return kept


def _similar_in_cells(similarity: float):
    """rows (cell, node, set, pairs) in the order of cell, that of its pairs first."""

    @trimmed
    def run(batches):
        cell, pairs, sets = None, None, {}

        def links():
            kept = _links_of_cell(pairs, sets, similarity) if sets else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for c, node, shingles, own in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    yield links()
                    cell, pairs, sets = c, own, {}
                else:
                    sets[node] = shingles
        yield links()

    return run


def _first_candidates(rows: DataFrame, n: int, blocks) -> DataFrame:
    """The first round's distinct pairs (a, b) of nodes, a < b, and (a, a) for nodes that may have more; rows: f0, f1, s."""
    packed = "target int, blob binary"
    pairs = rows.mapInArrow(_segment_variants(n, _FIRST, blocks), packed).repartition(n, "target").mapInArrow(_packed_first(n, LARGE), packed)
    return saved(pairs.repartition(n, "target").mapInArrow(_first_pairs, "a long, b long").distinct(), "pairs")


def _blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, block) of the nodes that may have more: blocks divide what the first round's candidates connect."""
    clusters = saved(components(pairs), "clusters").withColumnRenamed("component", "cluster")
    own = pairs.where("a = b").select(F.col("a").alias("node")).join(sets.select("node", F.length("set").alias("bytes")), "node")
    own = saved(own.join(clusters, "node", "left").select("node", "bytes", F.coalesce("cluster", "node").alias("cluster")), "clustered")
    count = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    sizes = own.groupBy("cluster").agg(count.alias("blocks"))
    return saved(own.join(sizes, "cluster").select("node", F.expr("xxhash64(cluster, pmod(xxhash64(node), blocks))").alias("block")), "blocks")


def _cells(rows: DataFrame, each: int, n: int, blocks) -> DataFrame:
    """A later round's candidates as _cell_rows says; rows: f0, f1, s, component, block."""
    packed = "target int, blob binary"
    pairs = rows.mapInArrow(_segment_variants(n, _NAMED, blocks), packed).repartition(n, "target").mapInArrow(_packed_cells(n, each, LARGE), packed)
    return saved(pairs.repartition(n, "target").mapInArrow(_cell_rows, "cell long, node long, pairs binary"), "cells")


def _cell_links(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    inside = cells.where("cell is not null and node is not null").join(sets, "node").select("cell", "node", "set", F.lit(None).cast("binary").alias("pairs"))
    whole = cells.where("pairs is not null").select("cell", "node", F.lit(None).cast("binary").alias("set"), "pairs")
    rows = inside.unionAll(whole).repartition(partitions(cells.sparkSession), "cell").sortWithinPartitions("cell", "node")
    return saved(rows.mapInArrow(_similar_in_cells(similarity), "a long, b long"), "links")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, first) for each row of docs (doc_id, text, ...): first is the smallest doc_id of the row's group.

    Groups connect texts whose sets of words-word shingles have a Jaccard similarity of similarity or more
    and that signatures find (see above); equal texts, but for white space and the case of A-Z, always
    share one, null and empty texts another. Texts of equal sets of shingles count as equal; those of equal
    fingerprints are verified like other candidates. A null doc_id is first only in a group without others. Other columns are not looked at.
    """
    return _groups(docs, words, similarity).select("doc_id", "first")


def _groups(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, hash, first, first_hash) for each row: hash that of the text, first and first_hash those of one row of the group, of the smallest doc_id."""
    spark = docs.sparkSession
    texts = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("hash")))
    rows = saved(texts.mapInArrow(_wide_fingerprints(words), "doc_id long, node long, f0 long, f1 long, s long, hash long, set binary"), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    classes = saved(rows.groupBy("node", "f0", "f1", "s").agg(least, F.count("*").alias("n")), "classes")
    n = partitions(spark, classes.count() * SEGMENTS * SEGMENT_BITS * _FIRST.itemsize)
    blocks = None if (cut := _hot_blocks(classes)) is None else spark.sparkContext.broadcast(cut)
    pairs, each = _first_candidates(classes.select("f0", "f1", "s"), n, blocks), 1
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.where("a < b").select(F.col("b").alias("node"))).distinct()
    wanted = ends.join(classes, "node").select(F.col("node").alias("of"), "least.doc_id", "least.hash")
    own = rows.select("doc_id", "hash", "node", "set").join(wanted.toDF("of", "by", "is"), F.expr("node = of and doc_id <=> by and hash = is"), "left_semi")
    sets = saved(own.groupBy("node").agg(F.first("set").alias("set")), "sets")
    with_a = pairs.where("a < b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    links = saved(with_both.mapInArrow(_similar(similarity), "a long, b long"), "links")
    found, more = saved(components(links), "components"), pairs.where("a = b").select(F.col("a").alias("node"))
    parts = None if more.isEmpty() else _blocks(pairs, sets)
    while not more.isEmpty():
        each *= MORE
        again = classes.join(parts, "node").join(more, "node", "left_semi").join(found, "node", "left")
        cells = _cells(again.select("f0", "f1", "s", F.coalesce("component", "node").alias("component"), "block"), each, n, blocks)
        links = _cell_links(cells, sets, similarity).unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found, more = saved(components(links), "components"), cells.where("cell is null").select("node")
    named = saved(classes.join(found, "node", "left").select("node", "least", F.col("n").alias("texts"), F.coalesce("component", "node").alias("component")), "named")
    firsts = saved(named.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n")), "firsts")
    of = looked_up(named, firsts, ["component"]).select("node", F.col("first.doc_id").alias("first"), F.col("first.hash").alias("first_hash"), F.col("texts").alias("n"))
    return looked_up(rows, saved(of, "groups"), ["node"]).select("doc_id", "hash", "first", "first_hash")


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs, all columns, for each group of near_duplicates: one of the smallest doc_id.

    Rows go by doc_id and text, so others of the same doc_id, null or not, stay if their own group keeps them.
    Of rows in a group that share its smallest doc_id, one stays.
    """
    near = _groups(docs, words, similarity)
    stays = F.expr("doc_id <=> first and hash = first_hash")
    gone = near.where(~stays).select(F.col("doc_id").alias("__gone"), F.col("hash").alias("__hash")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (_text_hash() == F.col("__hash")), "left_anti")
    if near.where(stays).groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": _text_hash()}).dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
