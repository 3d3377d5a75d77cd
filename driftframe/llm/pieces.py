"""SentencePiece encoding and decoding with sampled segmentations.

A text's segmentations into vocabulary pieces form a lattice, each piece weighted by its
probability. Forward filtering sums the weights of all ways to reach each position; backward
sampling then draws, from the end, the piece by which the position was reached. The draws
come from a counter hashed with the row's key, so any run gives the same pieces.

No piece holds a space after another character, nor crosses a character that stands in
no longer piece, so the lattice falls apart at those places: each chunk is filtered
once a batch and drawn from as often as it occurs, with the same joint distribution.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import bounded, mix64, read, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, TEMPERATURE = 42, 0.5
#: Longer chunks are filtered one by one; so many words of a batch go through the lattice at once.
LONG, BATCH_CHUNKS = 48, 200_000
#: Lattices of so many characters are kept for later batches, then begun anew; results are the same.
KEPT_CHARS, LATTICE_CHARS = 2_000_000, 300_000
_SPACE, _LITERAL = "▁", "\udc00"  # a text's own U+2581 is no space: it takes its bytes
_P1, _P2 = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a SentencePiece model file, with a lattice over it."""

    def __init__(self, model: str | bytes = MODEL, temperature: float = TEMPERATURE):
        sp = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {names[i].replace(_SPACE, " "): i for i in usable}
        if bad := [p for p in self.ids if " " in p.lstrip(" ")]:
            raise ValueError(f"a piece with a space inside, {bad[0]!r}: texts of this model do not divide before spaces")
        # The file ranks its pieces; probabilities follow Zipf's law over that rank, flattened by the temperature.
        # A constant factor for each character changes no relative weight of segmentations and keeps sums in range.
        rank = {i: k for k, i in enumerate(sorted(usable, key=lambda i: -sp.get_score(i)))}
        self.weight = {i: (1000.0 / (rank[i] + 2.7)) ** temperature * 4.0 ** (len(p) - 1) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        lone = "\n" if "\n" not in inner else ""
        self.chunks = re.compile(rf" *[^ {lone}]+| +" + (f"|{lone}" if lone else ""))
        self.decoded = [b""] * (n + 1)
        for p, i in self.ids.items():
            self.decoded[i] = p.encode()
        for v, i in self.bytes.items():
            self.decoded[i] = bytes([v])
        # pieces and their beginnings by a rolling hash of their characters
        parts = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.keys = np.array([self._hash(p) for p in parts], np.uint64)
        self.key_ids = np.array(list(parts.values()), np.int64)
        assert len(np.unique(self.keys)) == len(parts)
        self.tables, rest = [], np.arange(len(parts))
        for shift in (44, 24, 4):
            slots, table = self._slots(self.keys[rest], shift), np.full(1 << 20, -1, np.int32)
            table[slots] = rest  # where slots clash the last one stays
            rest = rest[table[slots] != rest]
            self.tables.append((shift, table))
        assert not len(rest)
        self.number: dict[str, int] = {}
        self.nodes = self.ways = 0
        self.last, self.first = np.zeros(KEPT_CHARS // 8, np.int32), np.zeros(KEPT_CHARS, np.int32)
        self.chance, self.piece, self.origin = np.zeros(3 * KEPT_CHARS, np.float32), np.zeros(3 * KEPT_CHARS, np.int32), np.zeros(3 * KEPT_CHARS, np.int32)
        self.weights = np.zeros(n)
        self.weights[list(self.weight)] = list(self.weight.values())

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P1) + ord(c) + 1) % (1 << 64)
        return h * int(_P2) % (1 << 64)

    @staticmethod
    def _slots(hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes >> np.uint64(shift)) & np.uint64(0xFFFFF)).astype(np.int64)

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash among keys, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for shift, table in self.tables:
            e = table[self._slots(hashes[open_], shift)]
            ok = (e >= 0) & (self.keys[e] == hashes[open_])
            found[open_[ok]] = e[ok]
            open_ = open_[~ok & (e >= 0)]
            if not len(open_):
                break
        return found

    def edges(self, chars: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For k from 0: where in chars, and within one chunk, pieces of k + 1 characters begin, and which. Characters in no piece are -2."""
        out, at, h = [], np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for k in range(self.longest):
            if k:
                inside = at + k < len(chars)
                inside[inside] = word[at[inside]] == word[at[inside] + k]
                at, h = at[inside], h[inside]
            h = h * _P1 + chars[at + k].astype(np.uint64) + np.uint64(1)
            e = self._lookup(h * _P2)
            ids = np.where(e >= 0, self.key_ids[e], -1)
            if not k:
                ids = np.where(ids < 0, -2, ids)
            out.append((at[ids != -1], ids[ids != -1]))
            at, h = at[e >= 0], h[e >= 0]
            if not len(at):
                break
        return out

    def lattice(self, chunks: list[str]) -> list[np.ndarray]:
        """Nodes are end positions in chunks, numbered by position first: node base[t] + c for chunk c, chunks longest first.

        Returns the last node of each chunk; where each node's ways in begin; and of each way in the
        cumulative chance, the piece and the node it comes from (-1: the chunk's begin).
        """
        lengths = np.array([len(c) for c in chunks])
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        word = np.repeat(np.arange(len(chunks)), lengths)
        t = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        base = np.concatenate([[0], np.cumsum(np.bincount(t))])
        found = self.edges(chars, word)
        ends = [base[t[at] + k] + word[at] for k, (at, _) in enumerate(found)]
        first = np.concatenate([[0], np.cumsum(sum(np.bincount(e, minlength=len(chars)) for e in ends))])
        free = first[:-1].copy()
        n = int(first[-1])
        piece, origin = np.empty(n, np.int32), np.empty(n, np.int32)
        for k in reversed(range(len(found))):  # longer pieces first: they are the likelier ones
            at, ids = found[k]
            e = free[ends[k]]
            free[ends[k]] += 1
            lone = ids < 0
            piece[e] = np.where(lone, -2 - chars[at].astype(np.int64), ids)
            origin[e] = np.where(t[at] > 0, base[np.maximum(t[at] - 1, 0)] + word[at], -1)
        weight = np.where(piece < 0, 1e-3, self.weights[np.maximum(piece, 0)])
        alpha, chance = np.ones(len(chars) + 1), np.empty(n)  # alpha[-1] is a chunk's begin
        for i, j in zip(base[:-1].tolist(), base[1:].tolist()):
            a, b = int(first[i]), int(first[j])
            ways = weight[a:b] * alpha[origin[a:b]]
            alpha[i:j] = np.add.reduceat(ways, first[i:j] - a)
            node = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
            chance[a:b] = np.cumsum(ways / alpha[i:j][node]) - node
        chance[first[1:] - 1] = 2.0  # the last way in takes what is left
        return [base[lengths - 1] + np.arange(len(chunks)), first[:-1], chance, piece, origin]

    def _keep(self, every: list[str]) -> None:
        """Numbers the chunks not yet known and keeps their lattices, in arrays of a fixed size."""
        new = [c for c in dict.fromkeys(every) if c not in self.number and len(c) <= LONG]
        if not new:
            return
        if self.nodes + sum(map(len, new)) > len(self.first):
            self.number.clear()
            self.nodes = self.ways = 0
            new = [c for c in dict.fromkeys(every) if len(c) <= LONG]
        new.sort(key=len, reverse=True)
        begin = 0
        while begin < len(new):
            end = min(len(new), begin + max(1, LATTICE_CHARS // len(new[begin])))
            part = new[begin:end]
            n, last, first, chance, piece, origin = len(self.number), *self.lattice(part)
            self.number.update(zip(part, range(n, n + len(part))))
            for name, values, at in (("last", last + self.nodes, n), ("first", first + self.ways, self.nodes), ("chance", chance, self.ways), ("piece", piece, self.ways), ("origin", np.where(origin >= 0, origin + self.nodes, -1), self.ways)):
                kept = getattr(self, name)
                if at + len(values) > len(kept):
                    kept = np.concatenate([kept, np.zeros(max(len(kept) // 4, at + len(values) - len(kept)), kept.dtype)])
                    setattr(self, name, kept)
                kept[at : at + len(values)] = values
            self.nodes, self.ways, begin = self.nodes + len(first), self.ways + len(chance), end

    def _long(self, chunk: str, key: int) -> list[int]:
        """A long chunk by itself, scaled at every position so that no sum runs out of range."""
        logs, ways = [0.0], []
        for t in range(len(chunk)):
            found = []
            for k in range(min(t + 1, self.longest)):
                i = self.ids.get(chunk[t - k : t + 1])
                if i is None and k == 0:
                    i, w = -2, 1e-3
                elif i is None:
                    continue
                else:
                    w = self.weight[i]
                found.append((np.log(w) + logs[t - k], k, i))
            top = max(f[0] for f in found)
            p = np.exp(np.array([f[0] for f in found]) - top)
            logs.append(top + float(np.log(p.sum())))
            ways.append((np.cumsum(p) / p.sum(), found))
        out, t, u = [], len(chunk) - 1, uniforms(np.full(len(chunk), key, np.uint64), np.arange(len(chunk)))
        while t >= 0:
            p, found = ways[t]
            _, k, i = found[min(int(np.searchsorted(p, u[t], side="right")), len(found) - 1)]
            out.append(i if i >= 0 else -2 - ord(chunk[t]))
            t -= k + 1
        return out[::-1]

    def encode(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """One sampled segmentation of each text, as ids; keys: a uint64 for each. Null and empty texts have none."""
        out: list[np.ndarray] = []
        group, n = [], 0
        for i, t in enumerate(texts):
            found = self.chunks.findall(" " + t.replace(_SPACE, _LITERAL)) if t else []
            group.append(found)
            n += len(found)
            if n >= BATCH_CHUNKS or i == len(texts) - 1:
                out += self._encode(group, keys[i + 1 - len(group) : i + 1])
                group, n = [], 0
        return out

    def _encode(self, texts: list[list[str]], keys: np.ndarray) -> list[np.ndarray]:
        counts = np.array([len(t) for t in texts])
        every = [c for t in texts for c in t]
        self._keep(every)
        last, first_way, chance, piece, origin = self.last, self.first, self.chance, self.piece, self.origin
        get = self.number.get
        flat = np.array([get(c, -1) for c in every], np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        ordinal = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = mix64(keys[row] + mix64(ordinal.astype(np.uint64)))
        step_of, id_of, at = [], [], np.flatnonzero(flat >= 0)
        node, n_pieces, step = last[flat[at]], np.zeros(len(flat), np.int64), 0
        while len(at):
            u, way = uniforms(key[at], np.uint64(step)), first_way[node]
            open_ = np.flatnonzero(u >= chance[way])
            while len(open_):
                way[open_] += 1
                open_ = open_[u[open_] >= chance[way[open_]]]
            step_of.append(at)
            id_of.append(piece[way])
            n_pieces[at] += 1
            node, step = origin[way], step + 1
            at, node = at[node >= 0], node[node >= 0]
        long_at = np.flatnonzero(flat < 0)
        long_ids = [self._long(every[i], int(key[i])) for i in long_at.tolist()]
        n_pieces[long_at] = [len(x) for x in long_ids]
        offset = np.cumsum(n_pieces) - n_pieces
        ids = np.empty(int(n_pieces.sum()), np.int64)
        for step, (a, x) in enumerate(zip(step_of, id_of)):
            ids[offset[a] + n_pieces[a] - 1 - step] = x  # drawn from the end
        for i, x in zip(long_at.tolist(), long_ids):
            ids[offset[i] : offset[i] + len(x)] = x
        per_text = np.bincount(row, n_pieces, len(texts)).astype(np.int64)
        return self._with_bytes(ids, per_text)

    def _with_bytes(self, ids: np.ndarray, per_text: np.ndarray) -> list[np.ndarray]:
        """Characters in no piece, as -2 minus their code, become their UTF-8 bytes' pieces."""
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            codes, which = np.unique(-2 - ids[lone], return_inverse=True)
            raw = [(_SPACE if chr(c) == _LITERAL else chr(c)).encode("utf-8", "surrogatepass") for c in codes.tolist()]
            wide = np.zeros((len(raw), 4), np.int64)
            for i, b in enumerate(raw):
                wide[i, : len(b)] = [self.bytes[x] for x in b]
            times = np.ones(len(ids), np.int64)
            times[lone] = np.array([len(b) for b in raw])[which]
            start = np.cumsum(times) - times
            out = np.repeat(ids, times)
            for j in range(4):
                has = times[lone] > j
                out[start[lone[has]] + j] = wide[which[has], j]
            per_text = np.add.reduceat(np.concatenate([times, [0]]), np.minimum(np.cumsum(per_text) - per_text, len(times))) * (per_text > 0)
            ids = out
        return np.split(ids.astype(np.int32), np.cumsum(per_text)[:-1])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text itself, whatever segmentation its ids come from."""
        table = self.decoded
        raw = b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return raw[1:].decode("utf-8", "surrogatepass")


def uniforms(keys: np.ndarray, counters: np.ndarray | np.uint64) -> np.ndarray:
    """Numbers in [0, 1), one for each key and counter."""
    return (mix64(keys + np.atleast_1d(counters).astype(np.uint64) * _P2) >> np.uint64(11)) * 2.0**-53


def row_keys(ids: list, texts: list[str | None], seed: int) -> np.ndarray:
    """A key for each row: its doc_id, or for a null doc_id its text."""
    own = [i if i is not None else int.from_bytes(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:8], "little") for i, t in zip(ids, texts)]
    return mix64(np.array([(x + seed * int(_P2)) % (1 << 64) for x in own], np.uint64))


def encoded(docs: DataFrame, model: str = MODEL, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_pieces, decoded_sha256) for each row of docs (doc_id, text, ...).

    Pieces weigh by Zipf's law over their rank in the model file, which states no probabilities. ids is a segmentation drawn by doc_id and seed; decoded_sha256, of the text that decoding the ids gives,
    shows that nothing is lost. Null and empty texts have no pieces. Rows equal in doc_id and text get equal
    ids; a null doc_id draws by the text. Other columns are not looked at. The model file is read once on
    the driver and goes along with the tasks (half a megabyte).
    """
    with open(model, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    @trimmed
    def run(batches):
        pieces = _loaded(proto.value, temperature)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids = pieces.encode(texts, row_keys(doc_ids, texts, seed)) if texts else []
            sums = [hashlib.sha256(pieces.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes), pa.array(sums, pa.string())], ["doc_id", "ids", "n_pieces", "decoded_sha256"])

    return bounded(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, decoded_sha256 string")


_LOADED: dict = {}


def _loaded(proto: bytes, temperature: float) -> Pieces:
    """Kept for the worker's next tasks; one model at a time."""
    key = (hashlib.sha256(proto).digest(), temperature, os.getpid())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(proto, temperature)
    return _LOADED[key]


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids, ...); null ids give a null text."""
    with open(model, "rb") as f:
        proto = rows.sparkSession.sparkContext.broadcast(f.read())

    @trimmed
    def run(batches):
        pieces = _loaded(proto.value, TEMPERATURE)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bounded(rows.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled piece ids of every whole text, with the hash of what they decode to."""
    return encoded(read(spark, sf_dir, "documents"))
