"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut where a run of blanks starts; distinct chunks are encoded once
(see ``chunks``). Chunks of equal length advance together, one code point at a
time: for every end position and piece length the substring's rolling hash
probes the sorted hashes of all pieces, and vectorised maxima over the
candidates store backpointers.

Two kinds of model file exist, and both are read from the file itself:

* unigram models: a path's value is the sum of its pieces' scores;
* BPE models: the best path by scores is *not* what BPE merging gives. But
  merging has this property: a sequence of pieces is the result of merging if
  and only if each piece merges to itself and each neighbouring pair merges to
  just that pair. So the same recursion runs with value 0 for pieces that can
  follow the piece the path so far ends in, and minus infinity for others;
  exactly one path is left at each position, the one BPE takes. Whether a pair
  stands is worked out once per distinct pair, by merging its few characters.

Long chunks without blanks are cut wherever two code points stand side by side
in no piece, since no piece can reach across; chunks that stay long and have too
few companions of their length for numpy run the same recursion one by one.

Code points that no piece covers stand alone; with byte fallback they become
their UTF-8 bytes' ids. Decoding gathers the pieces' bytes with numpy.

Edge cases: null texts count as empty; empty texts have no ids and decode to
"". Long texts are encoded alone, in linear time (a few seconds for a megabyte
without a single cut). Texts that already hold the blank marker U+2581 decode with a blank there;
``round_trip`` compares with that form. Repeated rows repeat their result, and
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.chunks import ChunkCache, _mixed, _powers, by_bytes, ragged

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Added to the lowest score for a code point no piece covers.
UNKNOWN_PENALTY = 10.0
_BASE = 0xD6E8FEB86659FD93
PAIR_SLOTS = 1 << 21
#: Chunks of more code points are cut where no piece can reach across, and those that stay as long run alone if under ``FEW`` share their length.
LONG, FEW = 32, 16


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[i : i + n]
            i += n


def _codes(texts: list[str], n: int) -> np.ndarray:
    """Code points of texts of length n, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)


class PieceModel:
    """Pieces, scores and settings of a model file."""

    def __init__(self, raw: bytes, kind: int | None = None):
        pieces, trainer, norm = [], {}, {}
        for f, v in _fields(raw):
            if f == 1:
                pieces.append(dict(_fields(v)))
            elif f == 2:
                trainer = dict(_fields(v))
            elif f == 3:
                norm = dict(_fields(v))
        if norm.get(2):
            raise ValueError("models with a character map are not supported")
        self.kind = kind or trainer.get(3, UNIGRAM)
        self.dummy_prefix = bool(norm.get(3, 1))
        if norm.get(4, 1):
            raise ValueError("models that remove extra blanks are not supported")
        self.names = [p[1].decode() for p in pieces]
        self.scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        types = [p.get(3, 1) for p in pieces]
        self.unknown = types.index(2)
        self.bytes = np.full(256, self.unknown, np.int32)
        for k, (name, t) in enumerate(zip(self.names, types, strict=True)):
            if t == 6:
                self.bytes[int(name[3:5], 16)] = k
        self.fallback = bool(trainer.get(35, 0))
        normal = [k for k, t in enumerate(types) if t == 1]
        self.by_name = {self.names[k]: k for k in normal}
        self.rank = {self.names[k]: float(self.scores[k]) for k in normal}
        self.longest = max(map(len, self.by_name))
        self.sides = np.unique(np.array([ord(x) << 32 | ord(y) for name in self.by_name for x, y in zip(name, name[1:], strict=False)] or [0], np.uint64))
        self.stands: dict[int, bool] = {}
        self.lengths = np.array([len(x) for x in self.names])
        keys, of = np.zeros(len(normal), np.uint64), self.lengths[normal]
        for n in np.unique(of).tolist():
            same = np.flatnonzero(of == n)
            keys[same] = self._prefix(_codes([self.names[normal[k]] for k in same.tolist()], n))[:, -1]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("pieces' hashes collide")
        if any(MARK in x.lstrip(MARK) for x in self.by_name):
            raise ValueError("models whose pieces span words are not supported")
        #: Line ends can be cut off where no longer piece holds one.
        self.cut_lines = not any("\n" in x and len(x) > 1 for x in self.by_name)
        self.floor = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        self.powers = _powers(_BASE, self.longest + 1)
        # Direct-mapped cache of pairs: a slot holds the pair met last, whose verdict is recomputed if it was displaced.
        self.pair_key, self.pair_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        plain = [b"" if t in (2, 3) else bytes([int(x[3:5], 16)]) if t == 6 else x.replace(MARK, " ").encode() for x, t in zip(self.names, types, strict=True)]
        plain[self.unknown] = " ⁇ ".encode()
        self.plain_len = np.array([len(x) for x in plain])
        self.plain_start = np.cumsum(self.plain_len) - self.plain_len
        self.plain = np.frombuffer(b"".join(plain), np.uint8)

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        """Rolling hashes of all prefixes of each row, that of the empty one first."""
        h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        values = _mixed(codes + np.uint64(1))
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * np.uint64(_BASE) + values[:, j]
        return h

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short string: merge the pair with the best score, leftmost first, until none merges."""
        parts, rank, none = list(text), self.rank, -np.inf
        gain = [rank.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while gain and (best := max(gain)) > none:
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = rank.get(parts[i - 1] + parts[i], none)
            if i < len(gain):
                gain[i] = rank.get(parts[i] + parts[i + 1], none)
        return parts

    def _stands(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """BPE: whether each piece can follow the one before it (-1: a code point without piece, -2: the chunk's start)."""
        keys = (before + 2) * len(self.names) + piece
        slot = (_mixed(keys) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != keys)
        ok = self.pair_ok[slot]
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            verdict = np.fromiter(map(self._pair_stands, fresh.tolist()), bool, len(fresh))
            ok[new] = verdict[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = keys[new], ok[new]
        return ok

    def _pair_stands(self, key: int) -> bool:
        a, b = key // len(self.names) - 2, self.names[key % len(self.names)]
        return self.merged(b) == [b] if a < 0 else self.merged(self.names[a] + b) == [self.names[a], b]

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all rows one after the other, number of each row), for rows of code points of one length.

        Where no piece is, the entry is -1 - code point.
        """
        rows, n = codes.shape
        h = self._prefix(codes)
        value = np.full((rows, n + 1), -np.inf)
        value[:, 0] = 0
        last, step = np.full((rows, n + 1), -2, np.int64), np.zeros((rows, n + 1), np.int64)
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                i = j - size
                key = h[:, j] - h[:, i] * self.powers[size]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[at] == key) & (self.lengths[self.ids[at]] == size) & (value[:, i] > -np.inf))
                piece = self.ids[at[hit]]
                if self.kind == BPE:
                    if len(hit):
                        stands = self._stands(last[hit, i], piece)
                        hit, piece = hit[stands], piece[stands]
                    gain = np.zeros(len(hit))
                else:
                    gain = self.scores[piece]
                if size == 1:
                    alone = np.flatnonzero((self.keys[at] != key) & (value[:, i] > -np.inf))
                    hit, piece = np.concatenate([hit, alone]), np.concatenate([piece, np.full(len(alone), -1)])
                    gain = np.concatenate([gain, np.full(len(alone), 0.0 if self.kind == BPE else self.floor)])
                total = value[hit, i] + gain
                better = total > value[hit, j]
                hit = hit[better]
                value[hit, j], last[hit, j], step[hit, j] = total[better], piece[better], size
        out = np.zeros((rows, n), np.int64)
        pos, count = np.full(rows, n), np.zeros(rows, np.int64)
        live = np.arange(rows)
        while len(live):
            p = pos[live]
            piece = last[live, p]
            out[live, count[live]] = np.where(piece >= 0, piece, -1 - codes[live, p - 1].astype(np.int64))
            count[live] += 1
            pos[live] = p - step[live, p]
            live = live[pos[live] > 0]
        backwards = count[:, None] - 1 - np.arange(n)[None, :]
        out = np.take_along_axis(out, np.maximum(backwards, 0), axis=1)
        return out[backwards >= 0], count

    def viterbi_alone(self, text: str) -> list[int]:
        """``viterbi`` for one text, without numpy."""
        n, bpe, names = len(text), self.kind == BPE, len(self.names)
        value, last, step = [0.0] + [-np.inf] * n, [-2] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                i = j - size
                if value[i] == -np.inf:
                    continue
                piece = self.by_name.get(text[i:j], -1)
                if piece >= 0 and bpe:
                    key = (last[i] + 2) * names + piece
                    if key not in self.stands:
                        if len(self.stands) >= PAIR_SLOTS:
                            self.stands.clear()
                        self.stands[key] = self._pair_stands(key)
                    if not self.stands[key]:
                        continue
                elif piece < 0 and size > 1:
                    continue
                total = value[i] + (0.0 if bpe else self.scores[piece] if piece >= 0 else self.floor)
                if total > value[j]:
                    value[j], last[j], step[j] = total, piece, size
        out, j = [], n
        while j:
            out.append(last[j] if last[j] >= 0 else -1 - ord(text[j - 1]))
            j -= step[j]
        return out[::-1]

    def parts(self, text: str) -> list[str]:
        """A text cut wherever no piece holds the two code points side by side."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        keys = codes[:-1] << np.uint64(32) | codes[1:]
        cuts = np.flatnonzero(self.sides[np.minimum(np.searchsorted(self.sides, keys), len(self.sides) - 1)] != keys) + 1
        ends = [0, *cuts.tolist(), len(text)]
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [c.decode("utf-8", "surrogatepass").replace(" ", MARK) for c in chunks]
        texts, of = [], []
        for k, t in enumerate(whole):
            parts = self.parts(t) if len(t) > LONG else [t]
            texts += parts
            of += [k] * len(parts)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(length, kind="stable")
        flats, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        for n, rows in zip(*np.unique(length, return_counts=True), strict=True):
            same = order[at : at + rows].tolist()
            block = max(1, 500_000 // (int(n) + 1))
            if n > LONG and rows < FEW:
                alone = [self.viterbi_alone(texts[k]) for k in same]
                flats += [np.array(x, np.int64) for x in alone]
                counts.append(np.array([len(x) for x in alone], np.int64))
            else:
                for s in range(0, rows, block):
                    flat, count = self.viterbi(_codes([texts[k] for k in same[s : s + block]], int(n)))
                    flats.append(flat)
                    counts.append(count)
            at += rows
        flat, count = np.concatenate(flats), np.concatenate(counts)
        back = np.argsort(order, kind="stable")
        start = np.cumsum(count) - count
        flat, count = flat[ragged(start[back], count[back])], np.bincount(of, count[back], len(whole)).astype(np.int64)
        return self._finished(flat, count) if len(flat) and flat.min() < 0 else (flat, count)

    def _finished(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without piece as byte ids, or as the unknown id; runs of unknowns are one."""
        if not self.fallback:
            lost = flat < 0
            flat = np.where(lost, self.unknown, flat)
            first = np.zeros(len(flat), bool)
            first[(np.cumsum(count) - count)[count > 0]] = True
            stays = ~(lost & np.append(False, lost[:-1]) & ~first)
            ends = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(count)])]
            return flat[stays], np.diff(ends)
        codes, which = np.unique(flat[flat < 0], return_inverse=True)
        ids = [self.bytes[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in codes.tolist()]
        size = np.array([len(x) for x in ids])
        start, n = np.arange(len(flat)), np.ones(len(flat), np.int64)
        start[flat < 0], n[flat < 0] = (len(flat) + np.cumsum(size) - size)[which], size[which]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        return np.concatenate([flat, *ids])[ragged(start, n)], np.diff(ends)

    def encode(self, texts: list[str], cache: ChunkCache) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        prefix = " " if self.dummy_prefix else ""
        raw = [(prefix + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        blank = data == 32
        cut = np.zeros(len(data), bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        if self.cut_lines:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        starts = np.cumsum(size) - size
        cut[starts[size > 0]] = True
        where = np.flatnonzero(cut)
        ids, n = cache(data, where)
        ends = np.concatenate([[0], np.cumsum(n)])
        bounds = np.searchsorted(where, np.append(starts, len(data)))
        return ids, np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        n = self.plain_len[ids]
        data = self.plain[ragged(self.plain_start[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text[:1] == " " else text)
        return out


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file: a driver's local path, or a URL of any store that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _ready(model: bytes, kind: int | None) -> tuple[PieceModel, ChunkCache]:
    """Built once per Python worker, whose tasks share the chunks already encoded."""
    pieces = PieceModel(model, kind)
    return pieces, ChunkCache(pieces.encode_chunks, limit=1_000_000)


#: Bytes of text handled at once; a longer text is handled alone.
BYTES_AT_ONCE = 1 << 20


def encode(df: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", kind: int | None = None) -> DataFrame:
    """One row per document: doc_id, ids, n_tokens, decoded_crc32, round_trip (decoding gives the text back)."""
    import zlib

    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = _ready(model, kind)
        for batch in batches:
            for s, rows in by_bytes(batch.column(1), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids, n = pieces.encode(texts, cache)
                back = pieces.decode(ids, n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                same = [x == t.replace(MARK, " ") for x, t in zip(back, texts, strict=True)]
                crc = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in back]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), lists, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "decoded_crc32", "round_trip"],
                )
        pa.default_memory_pool().release_unused()

    schema = f"doc_id {id_type}, ids array<int>, n_tokens long, decoded_crc32 long, round_trip boolean"
    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids; a null list counts as empty."""
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _ready(model, None)
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pieces.decode(flat, n), pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{ids}`")).mapInArrow(run, f"doc_id {id_type}, text string")
