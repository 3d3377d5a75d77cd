"""Substring dedup by level-wise doubling.

Level 1 looks at windows of LEAST words or a little more: only those of locally least hash
(every window of twice the length holds one) are counted, over all documents. Windows that occur once are
dropped; around the others, windows of twice the length are looked at in the same way, and so on up to the
wanted length, where all windows left are compared. For removal no longer level is needed: a longer
repeat is a union of repeats of the wanted length. longest_repeats() goes on doubling until no window survives.

Before a shuffle each task compares what it holds itself and sends one row of any
window, so that no key gets more rows than there are blocks of input.

Windows are equal if 96 bits of hash are: with 10**13 windows some two share them by chance in one of 1000 corpora.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import bounded, dealt, gathered, mix64, partitions, read, saved, trimmed

#: Windows compared at once in a task; the first level's windows have from so many words to twice as many.
BLOCK_WORDS, LEAST = 1 << 18, 10
_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_SEEN = np.dtype([("h", "<u8"), ("did", "<i8"), ("th", "<i8"), ("many", "<i4")])
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u4"), ("did", "<i8"), ("th", "<i8"), ("at", "<i4")])
_HASH_OF = np.dtype([("did", "<i8"), ("th", "<i8"), ("h", "<u8")])
_SPAN_OF = np.dtype([("did", "<i8"), ("th", "<i8"), ("begin", "<i4"), ("end", "<i4")])
_NULL_ID = (1 << 63) - 1


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of word hashes, one for each start; the last length - 1 starts have none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_B, len(words)))])
    return mix64((sums[length:] - sums[:-length]) * _powers(_B_INVERSE, n))


def anchors(half: np.ndarray, span: int) -> np.ndarray:
    """For each run of span starts, the start of the least hash in it."""
    if len(half) < span:
        return np.zeros(0, np.int64)
    return np.arange(len(half) - span + 1) + np.lib.stride_tricks.sliding_window_view(half, span).argmin(axis=1)


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """Rows of texts in blocks of about BLOCK_WORDS words; a longer text is a block of its own."""
    block, n = [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            block.append(row)
            n += 1 + len(row[2] or "") // 6
            if n >= BLOCK_WORDS:
                yield block
                block, n = [], 0
    if block:
        yield block


def _word_hashes(text: str | None) -> np.ndarray:
    """Two hashes of each word, as two rows."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in split_words(text)]), np.uint64).reshape(-1, 2).T


def levels(length: int) -> list[int]:
    """The lengths of windows up to length: each twice the one before, or one more."""
    out = [length]
    while out[0] >= 2 * LEAST:
        out.insert(0, out[0] // 2)
    return out if len(out) > 1 else [max(1, length // 2), length]


def _starts(words: np.ndarray, low: int, high: int, wanted: np.ndarray, sampled: bool) -> np.ndarray:
    """Where windows of high words may repeat, wanted being the hashes of repeated ones of low words: all, or sampled ones."""
    h = window_hashes(words, low)
    known = np.isin(h, wanted)
    if sampled:
        return np.flatnonzero(known[anchors(h, high - low + 1)])
    return np.flatnonzero(known[: max(0, len(h) - (high - low))] & known[high - low :])


def _first_windows(low: int, high: int):
    def windows(words, blob):
        h = window_hashes(words, low)
        return h[np.unique(anchors(h, high - low + 1))]

    return windows


def _next_windows(before: int, low: int, high: int | None, sampled: bool):
    """Windows of low words that hold a repeated one of before words; with high, only those of locally least hash."""

    def windows(words, blob):
        if not blob:
            return np.zeros(0, np.uint64)
        at, h = _starts(words, before, low, np.frombuffer(blob, "<u8"), sampled), window_hashes(words, low)
        return h[at if high is None else np.intersect1d(at, anchors(h, high - low + 1))]

    return windows


def _counted(windows, columns: int, targets: int):
    """What windows(words, blob) gives of each document, one row of any hash from a block, packed as _SEEN."""

    @trimmed
    def run(batches):
        for block in _blocks(batches, columns):
            parts = []
            for did, th, text, *blob in block:
                own, n = np.unique(windows(_word_hashes(text)[0], *blob or (None,)), return_counts=True)
                if len(own):
                    seen = np.zeros(len(own), _SEEN)
                    seen["h"], seen["did"], seen["th"], seen["many"] = own, did, th, n > 1  # twice in one document is a repeat too
                    parts.append(seen)
            if not parts:
                continue
            seen = np.concatenate(parts)
            seen = seen[np.argsort(seen["h"], kind="stable")]
            first = np.concatenate([[True], np.diff(seen["h"]) != 0])
            run_of = np.cumsum(first) - 1
            seen["many"] |= np.bincount(run_of)[run_of] > 1
            # of a repeated hash, one row also goes to be compared; the other rows are known to be repeats
            known = seen[(seen["many"] == 1) & ~first]
            open_ = seen[first]
            for rows, target in ((open_, open_["h"] % np.uint64(targets)), (known, mix64(known["did"].view(np.uint64)) % np.uint64(targets))):
                if out := dealt(target.astype(np.int64), rows):
                    yield out

    return run


def _to_documents(rows: np.ndarray, targets: int) -> pa.RecordBatch | None:
    return dealt((mix64(rows["did"].view(np.uint64)) % np.uint64(targets)).astype(np.int64), rows)


def _by_document(dtype: np.dtype):
    """One row for each document of packed records: its records without did and th."""
    values = [n for n in dtype.names if n not in ("did", "th")]
    packed = np.dtype([(n, dtype[n]) for n in values])

    @trimmed
    def run(batches):
        rows = gathered(batches, dtype)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["th"], rows["did"]))]
        cuts = np.flatnonzero((np.diff(rows["did"]) != 0) | (np.diff(rows["th"]) != 0)) + 1
        starts, own = np.concatenate([[0], cuts]), np.empty(len(rows), packed)
        for n in values:
            own[n] = rows[n]
        blobs = pa.array([x.tobytes() for x in np.split(own, cuts)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(rows["did"][starts].copy()), pa.array(rows["th"][starts].copy()), blobs], ["__did", "__th", "__blob"])

    return run


def _repeated(targets: int):
    """Hashes of the first level that occur more than once, with the documents that have them."""

    @trimmed
    def run(batches):
        seen = gathered(batches, _SEEN)
        if not len(seen):
            return
        seen = seen[np.argsort(seen["h"], kind="stable")]
        run_of = np.cumsum(np.concatenate([[True], np.diff(seen["h"]) != 0])) - 1
        seen = seen[(np.bincount(run_of)[run_of] > 1) | (seen["many"] == 1)]
        found = np.empty(len(seen), _HASH_OF)
        for n in _HASH_OF.names:
            found[n] = seen[n]
        if out := _to_documents(found, targets):
            yield out

    return run


def _later(rows: np.ndarray) -> np.ndarray:
    """Which of rows, ordered by (h, g, did, th, at), have the same h and g as the row before."""
    return np.concatenate([[False], (np.diff(rows["h"]) == 0) & (np.diff(rows["g"]) == 0)]) if len(rows) else np.zeros(0, bool)


def _ordered(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["at"], rows["th"], rows["did"], rows["g"], rows["h"]))]


def _last_level(low: int, length: int, targets: int):
    @trimmed
    def run(batches):
        for block in _blocks(batches, 4):
            parts = []
            for did, th, text, blob in block:
                if not blob:
                    continue
                words = _word_hashes(text)
                starts = _starts(words[0], low, length, np.frombuffer(blob, "<u8"), True)
                rows = np.zeros(len(starts), _WINDOW)
                rows["h"], rows["g"] = window_hashes(words[0], length)[starts], window_hashes(words[1], length)[starts] >> np.uint64(32)
                rows["did"], rows["th"], rows["at"] = did, th, starts
                parts.append(rows)
            if not parts:
                continue
            rows = _ordered(np.concatenate(parts))
            later = _later(rows)
            removed, rows = rows[later], rows[~later]
            if out := dealt((rows["h"] % np.uint64(targets)).astype(np.int64), rows):
                yield out
            # what this block already decides goes along, marked by the hash 0 of its own document
            if len(removed):
                removed = removed[np.lexsort((removed["at"], removed["th"], removed["did"]))]
                removed["h"] = 0
                if out := dealt((mix64(removed["did"].view(np.uint64)) % np.uint64(targets)).astype(np.int64), removed):
                    yield out

    return run


def _verdicts(length: int, targets: int):
    """Spans of words that go, windows of one document that touch being one span."""

    @trimmed
    def run(batches):
        rows = gathered(batches, _WINDOW)
        known = rows["h"] == 0
        rest = _ordered(rows[~known])
        gone = np.concatenate([rows[known], rest[_later(rest)]])
        if not len(gone):
            return
        gone = gone[np.lexsort((gone["at"], gone["th"], gone["did"]))]
        cut = np.flatnonzero((np.diff(gone["did"]) != 0) | (np.diff(gone["th"]) != 0) | (np.diff(gone["at"]) > length)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(gone)]]) - 1
        spans = np.empty(len(first), _SPAN_OF)
        spans["did"], spans["th"], spans["begin"], spans["end"] = gone["did"][first], gone["th"][first], gone["at"][first], gone["at"][last] + length
        if out := _to_documents(spans, targets):
            yield out

    return run


def _removal(words: list, blob: bytes | None) -> np.ndarray:
    """Which words go."""
    change = np.zeros(len(words) + 1, np.int32)
    if blob:
        spans = np.frombuffer(blob, "<i4").reshape(-1, 2)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs as __did (the doc_id, the largest long for null), __th, __text and the columns keep."""
    # only where a doc_id is null or repeated does the text's hash tell documents apart
    clash = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    th = F.coalesce(F.xxhash64("text"), F.lit(0)) if clash else F.lit(0).cast("long")
    return bounded(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("__did"), th.alias("__th"), F.col("text").cast("string").alias("__text"), *keep))


_PACKED, _PER_DOCUMENT = "target int, blob binary", "__did long, __th long, __blob binary"


def _survivors(rows: DataFrame, windows, n: int) -> DataFrame:
    """(__did, __th, __blob): of each document the hashes of its windows that occur more than once; rows: __did, __th, __text and maybe __blob."""
    seen = rows.mapInArrow(_counted(windows, len(rows.columns), n), _PACKED).repartition(n, "target").mapInArrow(_repeated(n), _PACKED)
    return seen.repartition(n, "target").mapInArrow(_by_document(_HASH_OF), _PER_DOCUMENT)


def _below(keyed: DataFrame, length: int, n: int) -> tuple[int, DataFrame]:
    """The last level below length, and what survives it."""
    lengths, found = levels(length), None
    for i, (low, high) in enumerate(zip(lengths, lengths[1:])):
        texts = keyed.select("__did", "__th", "__text")
        if found is None:
            found = _survivors(texts, _first_windows(low, high), n)
        else:
            found = _survivors(texts.join(found, ["__did", "__th"]), _next_windows(lengths[i - 1], low, high, True), n)
    return lengths[-2], found


def repeated_spans(docs: DataFrame, length: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns keep of docs (doc_id, text, ...) with __did (the doc_id, the largest long for null), __text and __blob:
    spans of words that a window of length words, whose words also start earlier, covers.

    Earlier: in a document of smaller doc_id (null last; equal doc_ids by the text's hash) or further up
    in the same document; rows equal in doc_id and text count as one document. length is at least 2.
    """
    n, keyed = partitions(docs.sparkSession), _keyed(docs, keep)
    low, found = _below(keyed, length, n)
    # the columns kept go along, so that both joins on (__did, __th) read one exchange of the texts
    windows = keyed.join(found, ["__did", "__th"], "left").select("__did", "__th", "__text", "__blob", *keep).mapInArrow(_last_level(low, length, n), _PACKED)
    spans = windows.repartition(n, "target").mapInArrow(_verdicts(length, n), _PACKED).repartition(n, "target").mapInArrow(_by_document(_SPAN_OF), _PER_DOCUMENT)
    return keyed.join(spans, ["__did", "__th"], "left")


def longest_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, longest) of the documents (doc_id, text, ...) with a window of length words that occurs more than once, anywhere.

    longest is the largest of length, 2 * length, 4 * length, ... of which it has such a window. Windows that repeat at one length alone
    are looked at at twice the length, until none is left; each level reads only the documents of those before it.
    Equal by 64 bits of hash. Rows equal in doc_id and text count as one document; null and empty texts have none.
    """
    keyed = saved(_keyed(docs).dropDuplicates(["__did", "__th"]), "texts")
    n, out = partitions(docs.sparkSession), None
    before, found = _below(keyed, length, n)
    sampled, now = True, length
    while True:
        found = saved(_survivors(keyed.join(found, ["__did", "__th"]), _next_windows(before, now, None, sampled), n), "level")
        if found.isEmpty():
            break
        own = found.select("__did", "__th", F.lit(now).cast("long").alias("longest"))
        out = own if out is None else out.unionAll(own)
        before, now, sampled = now, 2 * now, False
    if out is None:
        out = found.select("__did", "__th", F.lit(None).cast("long").alias("longest"))
    best = out.groupBy("__did", "__th").agg(F.max("longest").alias("longest"))
    return best.select(F.when(F.col("__did") != _NULL_ID, F.col("__did")).alias("doc_id"), "longest")


def remove_repeats(docs: DataFrame, length: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(__did, __text, __n_words, __n_removed, __kept) and the columns keep, for each row of docs (doc_id, text, ...).

    __kept is the text without repeated words. Words are divided by ASCII white space and kept ones joined
    by one space. A text of fewer than length words, an empty or a null one loses nothing; null
    becomes empty. Rows repeat as in the input; other columns are not looked at.
    """
    rows = repeated_spans(docs, length, keep).select("__did", "__text", "__blob", *keep)
    schema = rows.drop("__blob").schema.add("__n_words", "long").add("__n_removed", "long").add("__kept", "string")
    others = [f.name for f in rows.drop("__blob").schema]

    @trimmed
    def run(batches):
        for b in batches:
            n_words, n_removed, texts = [], [], []
            for text, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = split_words(text)
                gone = _removal(words, blob)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words))
            own = [b.column(0), b.column(1), *(b.column(i) for i in range(3, b.num_columns))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], [*others, "__n_words", "__n_removed", "__kept"])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """docs, all columns, with repeated words gone from the text; a text that loses none stays as it is, and n_chars follows the text."""
    keep = tuple(c for c in docs.columns if c != "text")
    rows = remove_repeats(docs, length, keep)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("__text"))
    changed = {"text": text.alias("text")} | ({"n_chars": F.when(F.col("__n_removed") > 0, F.char_length("__kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")} if "n_chars" in keep else {})
    return rows.select(*(changed.get(c, F.col(c)) for c in docs.columns))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, how many words it has and loses, and the hash of what is left."""
    found = remove_repeats(read(spark, sf_dir, "documents"))
    doc_id = F.when(F.col("__did") != _NULL_ID, F.col("__did"))
    return found.select(doc_id.alias("doc_id"), F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS g FROM later GROUP BY doc_id
)
SELECT w.doc_id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(g.g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g.g IS NULL THEN w.w ELSE list_filter(list_transform(w.w, lambda x, i: CASE WHEN list_contains(g.g, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id)
"""
