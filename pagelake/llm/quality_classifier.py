"""Quality classifier: supervised subword embeddings.

Words and their character 3- and 4-grams (blanks count as word ends) are hashed
into one table of learned vectors; a document's vectors are averaged and a
softmax layer gives its classes' probabilities. Training is stochastic gradient
descent in numpy, one document at a time, on a bounded sample of labelled
documents: ``per_class`` of each class, those with the smallest hashes of their
doc_id. Everything else covers all rows.

Averaging and the softmax layer's input are linear, so once trained each bucket
has one number (its vector times the difference of the two output rows), and
scoring a text is the mean of its features' numbers through a sigmoid. Features
of a batch of texts are hashed with numpy, without a loop over words.

Edge cases: null, empty and blank texts have no features and get the score of
the bias alone; without labels every score is 0.5. Documents whose labels
disagree are not trained on. Repeated rows are scored alike; an empty table
gives an empty result. Long texts are scored whole, a million characters at a
time. Only doc_id and text are read from the documents, so other columns' names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 17
DIM = 8
GRAMS = (3, 4)
#: Passes over the sample; small samples are passed over until MIN_STEPS documents were seen.
EPOCHS = 4
MIN_STEPS = 12_000
RATE = 0.4
#: Bound of the training sample, per class.
PER_CLASS = 1000
#: Code points hashed at once.
PIECE = 1 << 20


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of a batch: (bucket, document index) of every feature; documents may span pieces."""
    where, held, size = [], [], 0
    for k, t in enumerate(texts):
        for s in range(0, len(t), PIECE):
            # a blank before each document and each later part marks the word end
            part = " " + t[s : s + PIECE]
            where.append((k, len(part)))
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield _hashed("".join(held), where)
                where, held, size = [], [], 0
    if held:
        yield _hashed("".join(held), where)


def _hashed(text: str, where: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer((text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(blank, np.uint32(32), codes)
    doc = np.repeat(np.array([k for k, _ in where], np.int32), [n for _, n in where])
    n_all = len(doc)
    k = np.uint32(0x01000193)
    shift = np.uint32(32 - BUCKET_BITS)
    spread = np.uint32(0x9E3779B1)
    found, docs = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        h = np.full(m, 2166136261 + n, np.uint32)
        ok = np.ones(m, bool)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * k
            if 0 < i < n - 1:
                ok &= ~blank[i : i + m]
        m = min(m, n_all)
        at = np.flatnonzero(ok[:m])
        found.append(((h[at] ^ (h[at] >> np.uint32(15))) * spread) >> shift)
        docs.append(doc[at])
    # words: sums of code points times powers of an odd base, freed of their position
    base = 0x5851F42D4C957F2D
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, base, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, pow(base, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(blank, np.uint64(0), codes * power))])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    w = (sums[ends] - sums[starts]) * back[starts] * np.uint64(0x9E3779B97F4A7C15)
    found.append((w >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
    docs.append(doc[starts])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs)


def mean_of(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean table entry over each text's features; 0 for a text without any."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, doc in _buckets(texts):
        total += np.bincount(doc, weights=table[bucket], minlength=len(texts))
        count += np.bincount(doc, minlength=len(texts))
    return total / np.maximum(count, 1)


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their counts."""
    count = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, _ in _buckets([text]):
        count += np.bincount(bucket, minlength=len(count))
    at = np.flatnonzero(count)
    return at, count[at]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias) from (buckets, counts, class 0 or 1)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(examples))))
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, n, y = examples[k]
            now = rate * (1 - step / steps)
            step += 1
            share = (n / max(1, n.sum())).astype(np.float32)
            hidden = share @ vectors[at]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out.T @ p
            out -= now * np.outer(p, hidden)
            bias -= now * p
            # averaging divides the gradient by the document's length; undo that so that long texts train too
            vectors[at] -= now * np.sqrt(len(at)) * share[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on at most ``per_class`` documents of each class that are not held out."""
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).select("id", "y")
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sparse(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))],
                names=["id", "y", "at", "n"],
            )

    # at most 2 * per_class ids, so the broadcast is bounded
    slim = docs.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{text}`").alias("t"))
    sample = slim.join(F.broadcast(picked), F.col("of") == F.col("id")).select("id", F.col("y").cast("int").alias("y"), "t")
    id_type = sample.schema["id"].dataType.simpleString()
    rows = sample.dropDuplicates(["id"]).mapInArrow(run, f"id {id_type}, y int, at array<int>, n array<int>").toArrow().sort_by("id")
    examples = [
        (np.array(a.values, np.int64), np.array(n.values, np.int64), y.as_py())
        for y, a, n in zip(rows["y"], rows["at"], rows["n"], strict=True)
        if len(a)
    ]
    return train(examples)


def score(docs: DataFrame, table: np.ndarray, bias: float, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = mean_of([t or "" for t in b.column(1).to_pylist()], table) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    found = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {id_type}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
