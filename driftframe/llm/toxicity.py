"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of a sum of word
weights; a document's is the noisy-or of its sentences. The weights are fitted to document
labels alone; the fitted sentence scores then tell where in a text the offence lies.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import bounded, read, trimmed

#: Word features are hashed to so many weights.
FEATURES = 1 << 18
#: At most so many labelled documents are learnt from, and so many words of them in all, which
#: the driver holds: both those of least hash.
SAMPLE, SAMPLE_WORDS = 8000, 8_000_000
#: A word has a weight if its share of toxic documents differs from that of others by so many
#: standard errors, and if so many documents have it.
SCREEN, LEAST_DOCUMENTS = 5.0, 3
EPOCHS, RATE, DECAY, BIAS = 100, 1.0, 1e-5, -7.0
_SENTENCE = re.compile(r"[^.!?\n]+")
_STRIP = ".,;:!?\"'()[]{}*#%&$|-_"


def sentence_words(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(begin, end, lower-case words) of each sentence that has words."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        if words := [w for x in m[0].lower().split() if (w := x.strip(_STRIP))]:
            out.append((m.start(), m.end(), words))
    return out


def feature(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES


def _sample(docs: DataFrame, labels: DataFrame, sample: int):
    """Bags of feature numbers, the label and the hash, of at most sample labelled documents, in no order."""
    named = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    named = named.groupBy("id").agg(F.max("toxic").alias("toxic")).where("pmod(crc32(cast(id as string)), 5) <> 0")
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)

    def bags(batches):
        for b in batches:
            rows = [sentence_words(t) for t in b.column(2).to_pylist()]
            words = [np.array([feature(w) for s in x for w in s[2]], "<i4").tobytes() for x in rows]
            lengths = [np.array([len(s[2]) for s in x], "<i4").tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary()), pa.array(lengths, pa.binary()), b.column(3)], ["id", "toxic", "words", "lengths", "hash"])

    # chosen has at most sample rows of two numbers: small enough to broadcast at any size
    rows = bounded(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))).join(F.broadcast(chosen), "id")
    return rows.select("id", "toxic", "text", F.xxhash64("id").alias("hash")).mapInArrow(bags, "id long, toxic int, words binary, lengths binary, hash long").toLocalIterator()


def _within(rows, words: int) -> list[tuple]:
    """Bags (hash, id, words, label, lengths) in order up to the first that exceeds so many words in all, whatever order rows
    come in; a document of more words by itself is passed over."""
    held, total, cut = [], 0, None
    for r in rows:
        bag = (r["hash"], r["id"], bytes(r["words"]), r["toxic"], bytes(r["lengths"]))
        if not bag[4] or len(bag[2]) > 4 * words or (cut and bag > cut):
            continue
        insort(held, bag)
        total += len(bag[2])
        while total > 4 * words:
            cut = held.pop()
            total -= len(cut[2])
    return held


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by Adagrad on the documents' noisy-or log loss.

    Learns from labels (doc_id, toxic) of documents whose crc32(doc_id) mod 5 is not 0; a
    doc_id labelled twice is toxic if any label says so. Without labels every weight is 0.
    In the order of the doc_id's hash, at most sample labelled doc_ids are taken, and of their
    documents those up to words words in all; how files and partitions divide them doesn't matter.
    """
    bags = [(i, y, np.frombuffer(w, "<i4"), np.frombuffer(n, "<i4")) for _, i, w, y, n in _within(_sample(docs, labels, sample), words)]
    weights, bias = np.zeros(FEATURES), BIAS
    if not bags:
        return weights, bias
    bags.sort(key=lambda x: (x[0], x[2].tobytes()))
    y = np.array([b[1] for b in bags], float)
    flat, lengths = np.concatenate([b[2] for b in bags]), np.concatenate([b[3] for b in bags])
    d_of_s = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b[3]) for b in bags])
    s_of_word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    of, toxic = np.zeros(FEATURES, np.int64), np.zeros(FEATURES)
    for _, label, own, _ in bags:  # a word counts once for a document
        own = np.unique(own)
        of[own] += 1
        toxic[own] += label
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    pooled = (of + 1) / (len(y) + 2)
    z = (toxic / n1 - (of - toxic) / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    used = np.flatnonzero((np.abs(z) >= SCREEN) & (of >= LEAST_DOCUMENTS))
    kept = np.isin(flat, used)
    flat, s_of_word = np.searchsorted(used, flat[kept]), s_of_word[kept]
    w, g2, gb2 = np.zeros(len(used)), np.full(len(used), 1e-8), 1e-8
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(s_of_word, w[flat], len(lengths)) + bias, -30, 30)))
        none = np.exp(np.bincount(d_of_s, np.log1p(-p), len(bags)))  # that no sentence offends
        # d loss / d z of a sentence: p for label 0, -p * none / (1 - none) for label 1
        gz = np.where(y == 1, -none / np.maximum(1 - none, 1e-12), 1.0)[d_of_s] * p
        g, gb = np.bincount(flat, gz[s_of_word], len(used)) / len(bags) + DECAY * w, gz.sum() / len(bags)
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w, bias = w - RATE * g / np.sqrt(g2), bias - 0.1 * gb / np.sqrt(gb2)
    weights[used] = w
    return weights, float(bias)


def _scorer(spark: SparkSession, model: tuple[np.ndarray, float]):
    kept = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # FEATURES numbers: a fixed size

    def scorer():
        weights, bias = kept.value
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if (x := known.get(word)) is None:
                if len(known) > 500_000:
                    known.clear()
                x = known[word] = float(weights[feature(word)])
            return x

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            spans = [(a, b, sum(map(weight, words)) + bias) for a, b, words in sentence_words(text)]
            if not spans:
                return 0.0, []
            p = 1 / (1 + np.exp(-np.clip(np.array([s[2] for s in spans]), -30, 30)))
            return float(1 - np.exp(np.log1p(-p).sum())), [(a, b, float(x)) for (a, b, _), x in zip(spans, p) if x >= 0.5]

        return score

    return scorer


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, score, offending) for each row of docs (doc_id, text, ...).

    score, 0 to 1, is the noisy-or of the text's sentences; 0 for null and empty texts or
    texts without words. offending lists (begin, end, score) of the sentences at 0.5 or more, in
    characters of the text. Rows repeat as in the input; other columns are not looked at.
    """
    make = _scorer(docs.sparkSession, train(docs, labels, sample))
    schema = "doc_id long, text string, score double, offending array<struct<begin:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @trimmed
    def run(batches):
        score = make()
        for b in batches:
            found = [score(t) for t in b.column(1).to_pylist()]
            spans = pa.array([[{"begin": x, "end": y, "score": z} for x, y, z in f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.float64()), spans], ["doc_id", "text", "score", "offending"])

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below least."""
    make = _scorer(docs.sparkSession, train(docs, labels))
    kept = docs.schema

    @trimmed
    def run(batches):
        score = make()
        for b in batches:
            yield b.filter(pa.array([score(t)[0] < least for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, kept)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labels outside the held-out fold, and where its offending sentences are."""
    found = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null doc_id has no label
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
