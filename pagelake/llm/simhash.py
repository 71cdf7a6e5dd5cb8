"""SimHash near-dedup by meet-in-the-middle ball hashing.

A 64-bit fingerprint has bit k set if more than half of the text's shingle
hashes have it. Two fingerprints link if they differ in at most three bits.

Finding links. Half of the radius three is one bit from either side, which
meets at distance two; the third bit is absorbed by erasing a block. If two
fingerprints differ at all, they differ in one of four 16-bit blocks; erase
that block, and at most two bits of the other 48 differ. So every distinct
fingerprint emits, for each erased block, all variants of the other 48 bits
within one bit (4 * 49 keys), the keys are shuffled, and every linked pair
meets under some key. Work per fingerprint is constant at any table size, and
48-bit keys keep chance meetings rare even for 10^11 fingerprints.

Verifying without emitting all pairs. Under a key each fingerprint is one of
two kinds: its 48 bits equal the key (centre), or differ in one bit (side). Two
sides with the same erased block are at most two bits apart, so all of them
link to the first; sides with blocks one bit apart link; a centre links to
sides up to two block bits away, and to centres up to three. Probing these
flips finds every link, and its output is linear in the members of the key.
A key has at most 49 * 2^16 members, however large the table.

Fingerprints are deduplicated before anything is emitted, so exact copies cost
nothing, and components are found over fingerprints (see ``components``).

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any others; texts with fewer words than a shingle have one, the whole
sequence. Component ids are the smallest doc_id reachable; null ids are ignored
there, and a component of only null ids has a null id. Repeated rows give
repeated results. Long texts are hashed whole, some ten thousand shingles at a
time. An empty table gives an empty result. Other columns are not read, and
:func:`keep_one` passes them on, so their names cannot clash.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import checkpointed, stored
from pagelake.llm.components import components

RADIUS = 3
BLOCK = 16
BLOCKS = 64 // BLOCK


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    ones, n, slab = np.zeros(64, np.int64), 0, []
    for g in grams:
        slab.append(xxh64_intdigest(g, seed))
        if len(slab) == 1 << 15:
            ones, n, slab = ones + _ones(slab), n + len(slab), []
    if slab:
        ones, n = ones + _ones(slab), n + len(slab)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit, highest bit first."""
    bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _masks() -> list[tuple[int, int]]:
    """(bits to keep, bits to flip or set) of every key of a fingerprint."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for j in range(BLOCKS):
        keep = ((1 << 64) - 1) ^ (((1 << BLOCK) - 1) << (j * BLOCK))
        tag = j << (j * BLOCK)
        flips = [0] + [1 << k for k in range(64) if keep >> k & 1]
        out += [(signed(keep), signed(tag ^ f)) for f in flips]
    return out


def ball(fps: DataFrame) -> DataFrame:
    """(key, fp): every fingerprint under each of its keys; the key holds the erased block's number in its place."""
    masks = F.array(*[F.struct(F.lit(a).cast("long").alias("keep"), F.lit(b).cast("long").alias("flip")) for a, b in _masks()])
    rows = fps.select("fp", F.explode(masks).alias("m"))
    return rows.select(F.col("fp").bitwiseAND(F.col("m.keep")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")


@functools.cache
def _near(n: int) -> np.ndarray:
    """All block values with one to n bits set."""
    v = np.arange(1, 1 << BLOCK, dtype=np.uint64)
    return v[np.bitwise_count(v) <= n]


def _probe(own: np.ndarray, own_fp: np.ndarray, other: np.ndarray, other_fp: np.ndarray, bits: int, same: bool) -> list[np.ndarray]:
    """Edges from each block value to the values of ``other`` up to so many bits away; ``other`` is sorted."""
    flips = _near(bits) if same else np.concatenate([np.zeros(1, np.uint64), _near(bits)])
    out, step = [], max(1, 2_000_000 // len(flips))
    for s in range(0, len(own), step):
        if len(other) < len(flips):
            far = np.bitwise_count(own[s : s + step, None] ^ other[None, :])
            a, at = np.nonzero((far <= bits) & ((own[s : s + step, None] < other[None, :]) | (not same)))
        else:
            want = own[s : s + step, None] ^ flips[None, :]
            at = np.minimum(np.searchsorted(other, want), len(other) - 1)
            a, b = np.nonzero((other[at] == want) & ((own[s : s + step, None] < want) | (not same)))
            at = at[a, b]
        out.append(np.stack([own_fp[s : s + step][a], other_fp[at]]))
    return out


def links_of_key(key: int, fps: np.ndarray) -> np.ndarray:
    """2 x n array of linked fingerprints (uint64) that meet under this key.

    Blocks are told by the tag in the key; should keys of two blocks coincide,
    each block takes the members that are its own.
    """
    u = np.uint64
    out: list[np.ndarray] = [np.zeros((2, 0), u)]
    for j in range(BLOCKS):
        if key >> (j * BLOCK) & ((1 << BLOCK) - 1) != j:
            continue
        kept = u(((1 << 64) - 1) ^ (((1 << BLOCK) - 1) << (j * BLOCK)))
        far = np.bitwise_count((fps ^ u(key)) & kept)
        v = (fps >> u(j * BLOCK)) & u((1 << BLOCK) - 1)
        side_fp, side_v = _by_value(fps[far == 1], v[far == 1])
        mid_fp, mid_v = _by_value(fps[far == 0], v[far == 0])
        if len(side_v):
            first_v, first, back = np.unique(side_v, return_index=True, return_inverse=True)
            lead = side_fp[first]
            star = np.stack([side_fp, lead[back]])
            out.append(star[:, star[0] != star[1]])
            out += _probe(first_v, lead, first_v, lead, 1, True)
            if len(mid_v):
                out += _probe(mid_v, mid_fp, first_v, lead, 2, False)
        if len(mid_v) > 1:
            out += _probe(mid_v, mid_fp, mid_v, mid_fp, 3, True)
    return np.concatenate(out, axis=1)


def _by_value(fps: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((fps, v))
    return fps[order], v[order]


def links(keyed: DataFrame) -> DataFrame:
    """(a, b) signed fingerprints that link; keys are sorted within tasks, and one key's members are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def solve(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
            size = np.diff(np.append(start, len(k)))
            f = f.view(np.uint64)
            two = start[size == 2]
            two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= RADIUS] if len(two) else two
            out = [np.stack([f[two], f[two + 1]])] if len(two) else []
            for s, n in zip(start[size > 2], size[size > 2], strict=True):
                out.append(links_of_key(int(k[s : s + 1].view(np.uint64)[0]), f[s : s + n]))
            e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)
            e = np.unique(np.sort(e, axis=0), axis=1) if e.shape[1] else e
            return pa.RecordBatch.from_arrays([pa.array(e[0].view(np.int64)), pa.array(e[1].view(np.int64))], names=["a", "b"])

        for b in batches:
            k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield solve(k[:cut], f[:cut])
        yield solve(held_k, held_f)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def annotate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp (signed), component_id."""
    docs = stored(fingerprints(df, doc_id, text, shingle, seed), "simhash-docs")
    distinct = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(ball(distinct.select("fp"))))
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("root"))
    member = checkpointed(member)
    least = member.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "r")
    classes = checkpointed(member.join(least, member.root == least.r).select(F.col("fp").alias("f"), "component_id"))
    return docs.join(classes, docs.fp == classes.f).select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows that stay, whole: of each component the document with the smallest doc_id.

    A doc_id that several rows share goes only if none of them is the one that stays.
    """
    found = annotate(df, doc_id, text, shingle, seed)
    out = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("out")).where("out")
    gone = checkpointed(out.select(F.col("doc_id").alias(f"gone_{uuid.uuid4().hex}")))
    return df.join(gone, df[doc_id] == gone[gone.columns[0]], "left_anti")
