"""Token ids in files: canonical length-limited Huffman coding.

Four passes, each reading what the one before wrote in the shared folder:

1. encode texts to ids (each distinct chunk of a task once, see ``chunks``) and
   keep them as a table;
2. count ids globally, find optimal code lengths of at most ``MAX_BITS`` bits by
   package-merge, and assign canonical codes: lengths alone say all;
3. range-sort documents by doc_id, and code their ids in blocks of about
   ``BLOCK_IDS``: doc ids, id counts, and the bit offset of every ``SEGMENT``-th
   id of a document as a checkpoint;
4. reading back, all segments of a block are decoded side by side with one
   table lookup per id, so blocks and segments need nothing from each other.

The file format is a Parquet table of blocks (binary payload, big endian bits)
plus a small table of code lengths, so it lives in any store that Spark writes.
Only id counts and one number per file go to the driver; both are bounded by
the vocabulary and the number of files.

Edge cases: null texts count as empty and give only the end id. Text that spells
an added token is that token's id, as in the library. A long text is encoded
alone, piece by piece; one of over 2 GB of ids raises an error, and so does a
vocabulary of more than 2 ** ``MAX_BITS`` ids in use. Rows that
repeat a doc_id keep their own entries, side by side. Null ids sort first. An
empty table gives no blocks and no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.chunks import ChunkCache, by_bytes, ragged
from pagelake.llm.common import stored

MAX_BITS = 18
SEGMENT = 512
BLOCK_IDS = 1 << 18
#: Bytes of text that are encoded at once; a longer text is encoded alone.
BYTES_AT_ONCE = 1 << 21
END_ID = 2
#: Classes of bytes: letters 0, digits 1, blanks 2, apostrophe 3, other ASCII 4, parts of other characters 5.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:128] = 4
for _k, _chars in ((0, range(65, 91)), (0, range(97, 123)), (1, range(48, 58)), (2, (*range(9, 14), 32)), (3, (39,))):
    _CLASS[list(_chars)] = _k
#: Whether a text may be cut between a byte of the first class and one of the second: always before a run of blanks ...
_BLANK_CUTS = np.zeros((6, 6), bool)
_BLANK_CUTS[[0, 1, 3, 4, 5], 2] = True
#: ... and, where runs of letters, digits and signs are tokens apart, at their ends. An apostrophe may belong to the letters after it.
_CLASS_CUTS = _BLANK_CUTS.copy()
_CLASS_CUTS[0, [1, 3, 4]] = _CLASS_CUTS[1, [0, 3, 4]] = _CLASS_CUTS[4, [0, 1]] = _CLASS_CUTS[3, 1] = True


def rare_blanks(data: np.ndarray) -> np.ndarray:
    """Places of the UTF-8 blanks other than the six of ASCII, where a run of blanks may not be cut."""
    one = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b, c = data[lead], padded[lead + 1], padded[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    marks = ((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (((b == 0x80) & marks) | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return np.concatenate([one, lead[two | three]])


class TextEncoder:
    """ids of texts by a byte-level BPE of the tokenizers library."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        first = json.loads(definition).get("pre_tokenizer") or {}
        self.cuts = (_CLASS_CUTS if first.get("type") == "ByteLevel" and first.get("use_regex", True) else _BLANK_CUTS).ravel()
        added = self.library.get_added_tokens_decoder()
        self.mark, self.mark_id = next(((t.content, k) for k, t in added.items() if t.special), (None, None))
        self.added = [t.content for t in added.values()]
        self.cache = ChunkCache(self._new, limit=1_000_000)

    def _new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks joined by a special token, which no merge crosses, are encoded in one call."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        if self.mark is None or any(self.mark[:2] in t for t in texts):
            ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
        out, step = [np.zeros(0, np.int32)], 4096
        for s in range(0, len(texts), step):
            joined = self.mark.join(texts[s : s + step]) + self.mark
            out.append(np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32))
        ids = np.concatenate(out)
        ends = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(np.append(-1, ends)) - 1

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).

        Texts with an added token's own text or a rare blank are encoded whole.
        """
        raw = [t.encode("utf-8", "replace") for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        kind = _CLASS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = self.cuts[kind[:-1] * np.uint8(6) + kind[1:]]
        ends = np.cumsum(size)
        starts = ends - size
        whole = np.array([any(x in t for x in self.added) for t in texts], bool)
        whole[np.searchsorted(ends, rare_blanks(data), side="right")] = True
        for k in np.flatnonzero(whole & (size > 0)):
            cut[starts[k] : starts[k] + size[k]] = False
        cut[starts[size > 0]] = True
        where = np.flatnonzero(cut)
        ids, n = self.cache(data, where)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.searchsorted(where, np.append(starts, len(data)))])


@functools.lru_cache(maxsize=2)
def _encoder(definition: str) -> TextEncoder:
    return TextEncoder(definition)


def token_ids(df: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids) with the end id appended; ids are packed little-endian, ``id_type`` says how."""
    id_type = df.schema[doc_id].dataType.simpleString()
    packed = id_format(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for batch in batches:
            for s, rows in by_bytes(batch.column(1), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                ids, n = encoder([t or "" for t in b.column(1).to_pylist()])
                ends = np.cumsum(n)
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(n) + 1)
                yield pa.RecordBatch.from_arrays([b.column(0), _blobs(ids.astype(packed).tobytes(), ends * packed.itemsize)], names=["doc_id", "ids"])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {id_type}, ids binary")


def id_format(definition: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it, four else."""
    parts = json.loads(definition)
    most = max([*parts["model"]["vocab"].values(), *(t["id"] for t in parts.get("added_tokens", []))], default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _blobs(raw: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column from its bytes and the end of each value."""
    if len(raw) >= 1 << 31:
        raise ValueError("a batch of more than 2 GB of ids")
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(column: pa.Array, packed: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after the other, number of ids of each row)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], packed, count=(offsets[-1] - offsets[0]) // packed.itemsize, offset=int(offsets[0])) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, packed)
    return ids, np.diff(offsets).astype(np.int64) // packed.itemsize


def id_counts(ids: DataFrame, packed: np.dtype) -> np.ndarray:
    """How often each id occurs, over all documents; the tables are as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(_unpacked(b.column(0), packed)[0])
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((max(rows["id"].to_pylist(), default=-1)) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``max_bits`` by package-merge; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    flags, row = [], leaves
    for level in range(max_bits):
        if level:
            even = row[: len(row) // 2 * 2]
            packages = even[0::2] + even[1::2]
            both = np.concatenate([leaves, packages])
            at = np.argsort(both, kind="stable")
            row, leaf = both[at], at < len(leaves)
        else:
            leaf = np.ones(len(leaves), bool)
        flags.append(leaf)
    take, found = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(flags):
        m = int(leaf[:take].sum())
        found[:m] += 1
        take = 2 * (take - m)
    lengths[order] = found
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    space = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
    start = np.cumsum(space) - space
    codes[order] = (start >> (np.uint64(32) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def pack(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code documents' ids, each from a new 32-bit word on.

    (words of all documents, words of each, bit offset of each id from its document's start)
    """
    size = lengths[ids].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    bounds = np.concatenate([[0], np.cumsum(n)])
    bits = ends[bounds[1:]] - ends[bounds[:-1]]
    count = (bits + 31) // 32
    first = np.cumsum(count) - count
    own = ends[:-1] - np.repeat(ends[bounds[:-1]], n)
    at = np.repeat(first * 32, n) + own
    word, used = at >> 5, (at & 31).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << (np.uint64(64) - size.astype(np.uint64) - used)
    out = np.zeros(int(count.sum()) + 1, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] = np.add.reduceat(value >> np.uint64(32), heads)
        tails = np.append(heads[1:] - 1, len(ids) - 1)
        spill = value[tails] & np.uint64(0xFFFFFFFF)
        out[word[tails] + 1] += spill
    return out[:-1].astype(np.uint32), count, own


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for every ``max_bits``-bit prefix."""
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    ids, bits = np.zeros(1 << max_bits, np.int32), np.ones(1 << max_bits, np.uint8)
    span = 1 << (max_bits - lengths[used].astype(np.int64))
    at = ragged(codes[used].astype(np.int64) * span, span)
    ids[at], bits[at] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, bits


def unpack(words: np.ndarray, start_bit: np.ndarray, n: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS) -> np.ndarray:
    """ids of segments that start at the given bits and hold ``n`` ids each, one after the other."""
    ids, bits = table
    w = np.append(words.astype(np.uint64), np.zeros(2, np.uint64))
    window = (w[:-1] << np.uint64(32)) | w[1:]
    out = np.zeros(int(n.sum()), np.int32)
    order = np.argsort(-n, kind="stable")
    at, left, to = start_bit[order].astype(np.int64), n[order], (np.cumsum(n) - n)[order]
    mask = np.uint64((1 << max_bits) - 1)
    live = len(left)
    for k in range(int(n.max()) if len(n) else 0):
        live = int(np.searchsorted(-left[:live], -k, side="left"))
        a = at[:live]
        peek = (window[a >> 5] >> (np.uint64(64 - max_bits) - (a & 31).astype(np.uint64))) & mask
        out[to[:live] + k] = ids[peek]
        at[:live] = a + bits[peek]
    return out


def blocks(ids: DataFrame, lengths: np.ndarray, packed: np.dtype) -> DataFrame:
    """(part, block, start, doc_ids, counts, marks, payload) in ascending doc_id order; start counts ids within the part.

    Ids are sorted as they are and coded where they arrive, so that the range
    sort's sampling reads doc_ids without coding anything.
    """
    id_type = ids.schema["doc_id"].dataType.simpleString()
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, size
            docs, flat, n = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            words, count, own = pack(flat, n, lengths, codes)
            marks_of = (n + SEGMENT - 1) // SEGMENT
            at = np.repeat(np.cumsum(n) - n, marks_of) + SEGMENT * ragged(np.zeros(len(n), np.int64), marks_of)
            marks = own[at] + np.repeat((np.cumsum(count) - count) * 32, marks_of)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), one(docs), one(pa.array(n)), one(pa.array(marks)), pa.array([words.astype(">u4").tobytes()], pa.binary())]
            block, start, held, size = block + 1, start + int(n.sum()), [], 0
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "start", "doc_ids", "counts", "marks", "payload"])

        for b in batches:
            flat, n = _unpacked(b.column(1), packed)
            ends, at = np.cumsum(n), 0
            while at < len(n):
                done = int(ends[at] - n[at])
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_IDS - size, side="right")))
                held.append((b.column(0).slice(at, to - at), flat[done : ends[to - 1]], n[at:to]))
                size += int(ends[to - 1]) - done
                at = to
                if size >= BLOCK_IDS or at < len(n):
                    yield flush()
        if held:
            yield flush()

    ordered = ids.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(run, f"part int, block int, start long, doc_ids array<{id_type}>, counts array<bigint>, marks array<bigint>, payload binary")


def write(df: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Write the ids of all documents; gives (the table of blocks, the code lengths)."""
    ids = token_ids(df, definition, doc_id, text, end_id)
    kept, packed = stored(ids, "token-ids", compression="zstd"), id_format(definition)
    lengths = code_lengths(id_counts(kept, packed))
    return stored(blocks(kept, lengths, packed), "token-blocks"), lengths


def read(table: DataFrame, lengths: np.ndarray, each: Callable[[np.ndarray, np.ndarray], list[pa.Array]] | None = None, columns: str = "ids array<int>") -> DataFrame:
    """(doc_id, start, n_tokens, ...) of every document in the files.

    ``each`` turns (ids, counts) of a block into further columns, the ids themselves by default.
    """
    id_type = table.schema["doc_ids"].dataType.elementType.simpleString()
    sums = table.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before, total = [], 0
    for part, n in sorted((r.part, r.n) for r in sums.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before.append((part, total))
        total += n
    offsets = dict(before)  # one number per file
    lookup = decode_table(lengths)

    def lists(ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", *[c.strip().split(" ")[0] for c in columns.split(",")]]
        for b in batches:
            for part, _, start, doc_ids, counts, marks, payload in zip(*b.columns, strict=True):
                n = np.array(counts.values, np.int64)
                segments = (n + SEGMENT - 1) // SEGMENT
                nth = ragged(np.zeros(len(n), np.int64), segments)
                size = np.minimum(np.repeat(n, segments) - nth * SEGMENT, SEGMENT)
                words = np.frombuffer(payload.as_py(), ">u4").astype(np.uint32)
                ids = unpack(words, np.array(marks.values, np.int64), size, lookup)
                first = offsets[part.as_py()] + start.as_py() + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first), pa.array(n), *(each or lists)(ids, n)], names=names)

    cols = ["part", "block", "start", "doc_ids", "counts", "marks", "payload"]
    return table.select(*cols).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, {columns}")


def crc_of_ids(ids: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Unsigned crc32 of each document's ids as little-endian 32-bit integers."""
    import zlib

    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.append(0, np.cumsum(n)) * 4
    return [pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())]
