"""Substring dedup: verbatim passages by shared units of words, near copies by MinHash banding of lines.

Both kinds of paragraph are found by keys, joined, and verified.

Verbatim passages ignore lines. A window is ``MIN_WORDS`` words in a row, across
line breaks too; one that two documents share is part of a passage, and a
passage is a maximal run of shared windows, so it starts and ends at its true
first and last word. A window's anchor is the least hash of its runs of ``RUN``
words; neighbours mostly share one, and those that do make a unit, a paragraph
that the content cuts, wherever it stands in its line. Documents that share a
window share its anchor. Where all units of an anchor have the same words, they
are copies as a whole; only where they differ, at the ends of passages, are
windows compared one by one, and only once for each different unit.

Near copies are found by line. Each distinct line's five-word shingles give a
MinHash signature of ``BANDS`` bands of ``ROWS`` values, tuned for recall: a pair
of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998.
Lines that share a band key are verified by the exact Jaccard similarity of
their shingle sets (0.8 or more), and components over the links are the classes.
In a run of neighbouring lines that each occur in another document too, with
``MIN_WORDS`` words or more together, each line is a row of its own class, but
those without near copies that verbatim passages cover.

Of each class the first occurrence (smallest doc_id, then position) stays.
Verbatim passages with one first occurrence have one component: the run of
first occurrences in the keeping document that they are copies of.

Scale: shuffled are units (one for some twelve words), keys as two longs, and
the texts of documents that hold something to compare, three times. Copies of a
line are collapsed before banding. A key with many members is split into parts
(see :func:`verified`), so a large group of near copies costs a comparison or
two a member, in many tasks. Tables that nothing reads any more are deleted.

Words are told apart by their bytes (up to 15) or a 120-bit digest; runs of words
by two 64-bit hashes, lines by one: among 10^10 distinct lines about three pairs
would coincide, and a coincidence matters only inside a passage that otherwise
repeats.

Edge cases: null, empty and blank texts have no paragraphs; nor have long texts
without blanks, which are one word. Long texts are looked at alone, whole.
Lines of fewer than five words only match exactly. Rows that repeat doc_id and
text count once; null doc_ids are left out. An empty table gives no rows. Other
columns are not read, so their names cannot clash; :func:`without` passes them on.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.llm.chunks import _mixed, _powers, by_bytes, ragged, span_hashes
from pagelake.llm.common import BLANKS, checkpointed, dropped, stored
from pagelake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
MIN_WORDS = 50
#: Members of a band key that are compared in one task; larger keys are split.
PART = 256
RUN = 20
#: Bytes of text that are looked at together; a longer text is looked at alone.
BYTES_AT_ONCE = 1 << 20
UNIT_BASE, WINDOW_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (paragraphs x BANDS) from the shingle hashes of paragraphs, which start at ``starts``."""
    keys = np.zeros((len(starts), BANDS), np.uint64)
    salts = _mixed(np.arange(2 * BANDS * ROWS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    for p in range(BANDS * ROWS):
        least = np.minimum.reduceat(shingles * salts[2 * p] + salts[2 * p + 1], starts)
        keys[:, p // ROWS] = _mixed(keys[:, p // ROWS] + least + np.uint64(p))
    return keys


def _paragraphs(texts: list[str]) -> dict[str, np.ndarray]:
    """Of every paragraph of a batch: doc, line, nth, start, end, words, h, bands (0 where too short)."""
    raw = b"\n".join(t.encode("utf-8", "replace") for t in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.append(True, blank[:-1])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    if not len(starts):
        return {}
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.append(0, line_ends[:-1] + 1)
    sizes = np.array([len(t.encode("utf-8", "replace")) + 1 for t in texts])
    doc_starts = np.cumsum(sizes) - sizes
    line_of = np.searchsorted(line_ends, starts)
    lines, first, count = np.unique(line_of, return_index=True, return_counts=True)
    w = span_hashes(data, starts, ends)
    place = np.arange(len(w)) - np.repeat(first, count)
    h = _mixed(np.add.reduceat(_mixed(w + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) + count.astype(np.uint64))
    doc = np.searchsorted(doc_starts, line_starts[lines], side="right") - 1
    first_line = np.searchsorted(line_starts, doc_starts)
    nth = np.arange(len(lines)) - np.searchsorted(doc, doc)
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    base = chars[doc_starts[doc]]
    long = count >= SHINGLE
    bands = np.zeros((len(lines), BANDS), np.uint64)
    if long.any():
        at = ragged(first[long], count[long] - SHINGLE + 1)
        grams = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            grams = _mixed(grams + w[at + k])
        n = count[long] - SHINGLE + 1
        bands[long] = _signatures(grams, np.cumsum(n) - n)
    return {
        "doc": doc, "line": lines - first_line[doc], "nth": nth, "start": chars[line_starts[lines]] - base, "end": chars[line_ends[lines]] - base,
        "words": count, "h": h.view(np.int64), "long": long, "bands": bands.view(np.int64),
    }


def paragraphs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_hash, line, nth, start, end, words, h, bands) of every paragraph."""
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in by_bytes(batch.column(2), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                got = _paragraphs([t or "" for t in b.column(2).to_pylist()])
                if not got:
                    continue
                n = np.where(got["long"], BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(got["bands"][got["long"]].ravel()))
                at = pa.array(got["doc"])
                cols = [b.column(0).take(at), b.column(1).take(at), *[pa.array(got[c].astype(np.int64)) for c in ("line", "nth", "start", "end", "words", "h")], bands]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_hash", "line", "nth", "start", "end", "words", "h", "bands"])

    docs = df.select(F.col(f"`{doc_id}`"), F.xxhash64(f"`{text}`").alias("doc_hash"), F.col(f"`{text}`")).where(F.col(f"`{doc_id}`").isNotNull())
    schema = f"doc_id {id_type}, doc_hash long, line long, nth long, start long, end long, words long, h long, bands array<bigint>"
    return docs.mapInArrow(run, schema)


def colliding(unique: DataFrame) -> DataFrame:
    """(key, h) of the band keys that more than one distinct paragraph has; rows stream by, whatever a key's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, h, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for b in batches:
            if not b.num_rows:
                continue
            k, h = np.append(k[-1:], b.column(0).to_numpy()), np.append(h[-1:], b.column(1).to_numpy())
            same = k[1:] == k[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep[0] |= met
            met = bool(keep[-1])
            keep[-1] = False  # it waits for the row after it
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(h[keep])], names=["key", "h"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(k[-1:]), pa.array(h[-1:])], names=["key", "h"])

    keyed = unique.select(F.explode("bands").alias("key"), "h")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, h long")


def line_texts(df: DataFrame) -> DataFrame:
    """(h, t) of the lines in ``todo``, from (doc_id, doc_hash, text, todo) rows; a text is split once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, todo = _fields(b.column(3))
            lines, out = None, []
            for k, line in zip(of.tolist(), todo["line"].to_pylist(), strict=True):
                if lines is None or lines[0] != k:
                    lines = (k, b.column(2)[k].as_py().split("\n"))
                out.append(lines[1][line])
            yield pa.RecordBatch.from_arrays([todo["h"], pa.array(out, pa.string())], names=["h", "t"])

    return df.mapInArrow(run, "h long, t string")


def shingle_set(text: str, size: int = SHINGLE) -> frozenset:
    w = text.encode("utf-8", "replace").split()
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)])


def similar(a: frozenset, b: frozenset, least: float = SIMILARITY) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def _linked(members: Iterable[tuple[int, str]]) -> tuple[list[tuple[int, int]], list[list[tuple[int, frozenset]]]]:
    """(a spanning set of the links among (h, text) members, their clusters)."""
    clusters: list[list[tuple[int, frozenset]]] = []
    out = []
    for h, t in members:
        mine, joined = shingle_set(t), []
        for c in clusters:
            hit = next((g for g, s in c if similar(mine, s)), None)
            if hit is not None:
                out.append((min(h, hit), max(h, hit)))
                joined.append(c)
        if joined:
            for c in joined[1:]:
                joined[0].extend(c)
            clusters = [c for c in clusters if not any(c is j for j in joined[1:])]
            joined[0].append((h, mine))
        else:
            clusters.append([(h, mine)])
    return out, clusters


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows with the same first two columns, as they stream by."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, operator.itemgetter(0, 1))


def _pairs(found: Iterable[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(columns.values())], names=list(columns))


LINK = {"a": pa.int64(), "b": pa.int64()}
MEMBER = {"key": pa.int64(), "part": pa.int64(), "h": pa.int64(), "cluster": pa.int64(), "base": pa.bool_()}


def _links_in_parts(rows: DataFrame) -> DataFrame:
    """(a, b) links among the members of each part, from (key, part, h, t) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()
        for _, group in _by_part(batches):
            found.update(_linked(row[2:] for row in group)[0])
            if len(found) > 10_000:
                yield _pairs(found, LINK)
                found = set()
        yield _pairs(found, LINK)

    return rows.select("key", "part", "h", "t").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def _clusters_in_parts(rows: DataFrame) -> DataFrame:
    """(key, part, h, cluster, base): a cluster is known by its first member; the part's largest is its base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), group in _by_part(batches):
            clusters = _linked(row[2:] for row in group)[1]
            largest = max(clusters, key=len)
            yield _pairs(((key, part, h, c[0][0], c is largest) for c in clusters for h, _ in c), MEMBER)

    return rows.select("key", "part", "h", "t").repartition("key", "part").sortWithinPartitions("key", "part", "h").mapInArrow(run, "key long, part long, h long, cluster long, base boolean")


def _links_of_visitors(rows: DataFrame) -> DataFrame:
    """(a, b) links of visitors to the members of a part, from (key, part, visits, home, cluster, h, t) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_part(batches):
            here: dict[int, list[tuple[int, frozenset]]] = {}
            found = []
            for _, part, visits, home, cluster, h, t in group:  # members come before visitors
                mine = shingle_set(t)
                if not visits:
                    here.setdefault(cluster, []).append((h, mine))
                    continue
                for c, members in here.items():
                    if (home, cluster) != (part, c) and (hit := next((g for g, s in members if similar(mine, s)), None)) is not None:
                        found.append((min(h, hit), max(h, hit)))
            yield _pairs(found, LINK)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "visits").mapInArrow(run, "a long, b long")


def verified(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) links between the paragraphs of each key, from (key, h) and (h, t) rows.

    The members of a large key are dealt over parts of about ``PART`` members.
    Each part finds its own clusters, and the parts' largest clusters are linked
    by their first members. Members outside the largest class that this gives
    then visit every part of their key, so that no link between parts is lost
    and a large group of near copies still costs a comparison or two a member.
    """
    large = checkpointed(buckets.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART))
    sized = buckets.join(large, F.col("key") == F.col("of"), "left")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / PART)
    sized = sized.select("key", F.pmod(F.xxhash64("h"), parts).alias("part"), parts.alias("parts"), F.col("h").alias("g"))
    rows = sized.join(texts, F.col("g") == F.col("h")).select("key", "part", "parts", "h", "t")
    links = _links_in_parts(rows)
    if not large.take(1):
        return links
    rows = stored(rows.where("parts > 1"), "paragraphs-of-large-keys")
    members = stored(_clusters_in_parts(rows), "clusters-of-large-keys")
    heads = members.where("base AND h = cluster").select(F.col("key").alias("k"), F.col("h").alias("g"))
    heads = rows.join(heads, (F.col("key") == F.col("k")) & (F.col("h") == F.col("g"))).withColumn("part", F.lit(0))
    classes = stored(_clusters_in_parts(heads), "classes-of-large-keys")  # a row for each part of a large key
    main = classes.where("base").select(F.col("key").alias("k"), F.col("h").alias("head"))
    members = members.join(main, (F.col("key") == F.col("k")) & (F.col("cluster") == F.col("head")), "left")
    members = members.select(F.col("key").alias("mk"), F.col("h").alias("mh"), "cluster", F.col("head").isNull().alias("out"))
    rows = rows.join(members, (F.col("key") == F.col("mk")) & (F.col("h") == F.col("mh"))).select("key", "part", "parts", "cluster", "h", "t", "out")
    visits = rows.where("out").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"), "part", "cluster", "h", "t")
    visits = visits.select("key", F.col("at").alias("part"), F.lit(True).alias("visits"), F.col("part").alias("home"), "cluster", "h", "t")
    rows = rows.select("key", "part", F.lit(False).alias("visits"), F.col("part").alias("home"), "cluster", "h", "t")
    of_heads = _links_in_parts(heads)
    return links.unionByName(of_heads).unionByName(_links_of_visitors(rows.unionByName(visits)))


def _words(texts: list[str]) -> dict[str, np.ndarray] | None:
    """Of every word of a batch: hash w, doc, start and end (code points), nth (of the lines with words); None without words."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.append(True, blank[:-1])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    if not len(starts):
        return None
    sizes = np.array([len(c) + 1 for c in coded])
    doc_starts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    base = chars[doc_starts[doc]]
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    rank = np.cumsum(np.append(True, line[1:] != line[:-1]))
    return {"w": span_hashes(data, starts, ends), "doc": doc, "start": chars[starts] - base, "end": chars[ends] - base, "nth": rank - rank[np.searchsorted(doc, doc)]}


def _rolling(w: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes, by prefix sums of values times powers of an odd base."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(w * _powers(base, len(w))))
    return _mixed((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), len(w) - size + 1))


def _units(words: dict[str, np.ndarray], size: int) -> dict[str, np.ndarray]:
    """Runs of windows of ``size`` words with one anchor: first window, number of windows, anchor a, hash h of all the run's words.

    A word that goes on and on has one anchor throughout; its run is cut at the length that others can't exceed.
    """
    doc, run = words["doc"], min(RUN, size)
    at = np.flatnonzero(doc[size - 1 :] == doc[: max(0, len(doc) - size + 1)])
    if not len(at):
        return {}
    least, span, wanted = _rolling(words["w"], run, 0x9E3779B97F4A7C15), 1, size - run + 1
    while span < wanted:
        step = min(span, wanted - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    least, of = least[at], doc[at]
    new = np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1]))
    new |= ragged(np.zeros(int(new.sum()), np.int64), np.diff(np.append(np.flatnonzero(new), len(at)))) % wanted == 0
    first = np.flatnonzero(new)
    n, lo = np.diff(np.append(first, len(at))), at[first]
    sums = np.append(np.uint64(0), np.cumsum(words["w"] * _powers(UNIT_BASE, len(doc))))
    whole = (sums[lo + n + size - 1] - sums[lo]) * _powers(pow(UNIT_BASE, -1, 1 << 64), len(doc))[lo]
    return {"at": lo, "n": n, "a": least[first].view(np.int64), "h": _mixed(whole + _mixed(n)).view(np.int64)}


def units(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, doc_hash, a, h, lo, n) of the units of every document, from (doc_id, doc_hash, text) rows; lo is the first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in by_bytes(batch.column(2), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                words = _words([t or "" for t in b.column(2).to_pylist()])
                got = _units(words, size) if words else {}
                if not got:
                    continue
                doc = words["doc"][got["at"]]
                lo, of = got["at"] - np.searchsorted(words["doc"], doc), pa.array(doc)
                cols = [b.column(0).take(of), b.column(1).take(of), pa.array(got["a"]), pa.array(got["h"]), pa.array(lo.astype(np.int32)), pa.array(got["n"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_hash", "a", "h", "lo", "n"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, doc_hash long, a long, h long, lo int, n int")


def _fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """Row number and fields of every struct in a column of arrays of structs."""
    flat = column.flatten()
    of = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return of, {f.name: flat.field(k) for k, f in enumerate(flat.type)}


def _first_word(words: dict[str, np.ndarray], texts: int) -> np.ndarray:
    """Number, in the batch, of the first word of each text."""
    return np.searchsorted(words["doc"], np.arange(texts))


def windows(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, doc_hash, a, h, g, j, pos, top) of every window of the units in ``todo``, from (doc_id, doc_hash, text, todo) rows."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in by_bytes(batch.column(2), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                words = _words(b.column(2).to_pylist())
                of, todo = _fields(b.column(3))
                lo, n = todo["lo"].to_numpy().astype(np.int64), todo["n"].to_numpy().astype(np.int64)
                at = ragged(_first_word(words, rows)[of] + lo, n)
                j, unit = ragged(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
                doc, of_unit = pa.array(of[unit]), pa.array(unit)
                g = _rolling(words["w"], size, WINDOW_BASE)[at].view(np.int64)
                cols = [b.column(0).take(doc), b.column(1).take(doc), todo["a"].take(of_unit), todo["h"].take(of_unit), pa.array(g), pa.array(j.astype(np.int32)), pa.array((lo[unit] + j).astype(np.int32)), todo["top"].take(of_unit)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_hash", "a", "h", "g", "j", "pos", "top"])

    return df.mapInArrow(run, f"doc_id {id_type}, doc_hash long, a long, h long, g long, j int, pos int, top {id_type}")


def spans(df: DataFrame, size: int) -> DataFrame:
    """Passages of each text from its runs of shared windows, in (doc_id, doc_hash, text, runs) rows: runs that touch and agree are one."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in by_bytes(batch.column(2), BYTES_AT_ONCE):
                b = batch.slice(s, rows)
                words = _words(b.column(2).to_pylist())
                of, runs = _fields(b.column(3))
                lo, hi, own, component = (runs[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi", "own", "component_id"))
                order = np.lexsort((lo, of))
                of, lo, hi, own, component = of[order], lo[order], hi[order], own[order], component[order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (lo[1:] != hi[:-1] + 1) | (own[1:] != own[:-1]) | (component[1:] != component[:-1])))
                last = np.append(new[1:], len(lo)) - 1
                base = _first_word(words, rows)[of[new]]
                a, z = base + lo[new], base + hi[last] + size - 1
                lines = words["nth"][z] - words["nth"][a] + 1
                doc = pa.array(of[new])
                numbers = [words["start"][a], words["end"][z], z - a + 1, lines, np.where(own[new] == 1, 0, lines)]
                cols = [b.column(0).take(doc), b.column(1).take(doc), *[pa.array(x.astype(np.int64)) for x in numbers], runs["keep_doc_id"].take(pa.array(order[new])), pa.array(component[new])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_hash", "start", "end", "n_words", "n_lines", "removed_lines", "keep_doc_id", "component_id"])

    return df.mapInArrow(run, f"doc_id {id_type}, doc_hash long, start long, end long, n_words long, n_lines long, removed_lines long, keep_doc_id {id_type}, component_id long")


def _with_texts(docs: DataFrame, todo: DataFrame, column: str) -> DataFrame:
    """Each document's text beside its own ``todo``; rows that repeat doc_id and text give several."""
    todo = todo.withColumnsRenamed({"doc_id": "_id", "doc_hash": "_hash"})
    return docs.join(todo, (F.col("doc_id") == F.col("_id")) & (F.col("doc_hash") == F.col("_hash"))).select("doc_id", "doc_hash", "text", column)


def shared_runs(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(a, h, j1, j2, f_id, f_hash, f_pos): the runs of windows of each kind of unit that two documents share, and their first occurrence.

    A kind of unit is all that have the anchor ``a`` and the words ``h``. Where an
    anchor has one kind, all its windows are shared or none. Only where it has
    several, at the ends of passages, are windows looked at one by one, once a kind.
    """
    kinds = wanted.groupBy("a", "h").agg(F.min(F.struct("doc_id", "doc_hash", "lo")).alias("first"), F.max("doc_id").alias("top"), F.first("n").alias("n"))
    kinds = stored(kinds, "unit-kinds", compression="zstd")
    several = kinds.groupBy(F.col("a").alias("several")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("several")
    several = checkpointed(several)
    kinds = kinds.join(several, F.col("a") == F.col("several"), "left")
    whole = kinds.where("several IS NULL AND first.doc_id <> top").select("a", "h", F.lit(0).alias("j1"), (F.col("n") - 1).alias("j2"), F.col("first.doc_id").alias("f_id"), F.col("first.doc_hash").alias("f_hash"), F.col("first.lo").alias("f_pos"))
    todo = kinds.where("several IS NOT NULL").groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.doc_hash").alias("doc_hash")).agg(F.collect_list(F.struct("a", "h", F.col("first.lo").alias("lo"), "n", "top")).alias("todo"))
    rows = stored(windows(_with_texts(docs, todo, "todo"), size), "windows", compression="zstd")
    first = rows.groupBy("a", "g").agg(F.min(F.struct("doc_id", "doc_hash", "pos")).alias("first"), F.max("top").alias("top")).where("first.doc_id <> top")
    first = stored(first.select(F.col("a").alias("b"), F.col("g").alias("of"), "first"), "windows-first", compression="zstd")
    hits = rows.select("a", "h", "g", "j").join(first, (F.col("a") == F.col("b")) & (F.col("g") == F.col("of")))
    hits = hits.groupBy("a", "h", F.col("first.doc_id").alias("f_id"), F.col("first.doc_hash").alias("f_hash"), (F.col("first.pos") - F.col("j")).alias("shift")).agg(F.sort_array(F.collect_set("j")).alias("js"))
    # a kind has no more windows than an anchor reaches, so the arrays are short
    edge = lambda by: F.filter("js", lambda x: ~F.array_contains("js", x + by))
    ends = hits.select("a", "h", "f_id", "f_hash", "shift", F.explode(F.arrays_zip(edge(-1).alias("j1"), edge(1).alias("j2"))).alias("e"))
    part = ends.select("a", "h", "e.j1", "e.j2", "f_id", "f_hash", (F.col("shift") + F.col("e.j1")).alias("f_pos"))
    out = stored(whole.unionByName(part), "unit-runs", compression="zstd")
    dropped(rows, first)
    return out


def _with_components(runs: DataFrame) -> DataFrame:
    """Add component_id: the run of first occurrences in the keeping text that the first occurrences belong to."""
    lengths = runs.select("f_id", "f_hash", "f_pos", (F.col("f_pos") + F.col("j2") - F.col("j1")).alias("f_end")).distinct()
    along = Window.partitionBy("f_id", "f_hash").orderBy("f_pos", "f_end")
    reach = F.max("f_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = lengths.withColumn("new", F.coalesce(F.col("f_pos") > reach + 1, F.lit(True)))
    start = F.max(F.when(F.col("new"), F.col("f_pos"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    islands = islands.select(F.col("f_id").alias("i_id"), F.col("f_hash").alias("i_hash"), F.col("f_pos").alias("i_pos"), F.col("f_end").alias("i_end"), F.xxhash64("f_hash", "f_id", start).alias("component_id"))
    same = (F.col("f_id") == F.col("i_id")) & (F.col("f_hash") == F.col("i_hash")) & (F.col("f_pos") == F.col("i_pos")) & (F.col("f_pos") + F.col("j2") - F.col("j1") == F.col("i_end"))
    islands = checkpointed(islands)
    return runs.join(islands, same).select(F.col("a").alias("ra"), F.col("h").alias("rh"), "j1", "j2", "f_id", "f_hash", "f_pos", "component_id")


def verbatim(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``passages`` for exact copies of ``min_words`` words or more, and doc_hash; every such word is in one."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("doc_hash"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = stored(units(docs, min_words), "units", compression="zstd")
    shared = found.groupBy(F.col("a").alias("b")).agg(F.min("doc_id").alias("lo_id"), F.max("doc_id").alias("hi_id")).where("lo_id <> hi_id").select("b")
    shared = stored(shared, "anchors-shared", compression="zstd")  # read from a table, so that the join can be split where an anchor is hot
    wanted = stored(found.join(shared, F.col("a") == F.col("b")).drop("b"), "units-shared", compression="zstd")
    dropped(found, shared)
    runs = stored(_with_components(shared_runs(docs, wanted, min_words)), "unit-components", compression="zstd")
    hits = wanted.join(runs, (F.col("a") == F.col("ra")) & (F.col("h") == F.col("rh")))
    own = (F.col("doc_id") == F.col("f_id")) & (F.col("doc_hash") == F.col("f_hash")) & (F.col("lo") + F.col("j1") == F.col("f_pos"))
    hits = hits.select("doc_id", "doc_hash", (F.col("lo") + F.col("j1")).alias("lo"), (F.col("lo") + F.col("j2")).alias("hi"), own.alias("own"), F.col("f_id").alias("keep_doc_id"), "component_id")
    todo = hits.groupBy("doc_id", "doc_hash").agg(F.collect_set(F.struct("lo", "hi", "own", "keep_doc_id", "component_id")).alias("runs"))
    out = stored(spans(_with_texts(docs, todo, "runs"), min_words).distinct(), "verbatim")
    dropped(wanted, runs)
    return out


def _covers(found: DataFrame) -> DataFrame:
    """(cover_id, cover_hash, from, to): the stretches of each document that verbatim passages cover together."""
    along = Window.partitionBy("doc_id", "doc_hash").orderBy("start")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.select("doc_id", "doc_hash", "start", "end", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("long").alias("new"))
    parts = parts.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(F.col("doc_id").alias("cover_id"), F.col("doc_hash").alias("cover_hash"), "part").agg(F.min("start").alias("from"), F.max("end").alias("to")).drop("part")


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a document.

    Each row has one component_id and one verdict: doc_id, start, end (code
    points), n_words, n_lines (that it touches), removed_lines (all of them if it
    occurs earlier, else 0), keep_doc_id (of the first occurrence), component_id.
    A whole line has fewer than ``min_words`` words if only its run has as many.
    """
    exact = verbatim(df, doc_id, text, min_words)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("doc_hash"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    paras = stored(paragraphs(docs), "paragraphs", compression="zstd")
    unique = paras.where(F.size("bands") > 0).groupBy("h").agg(F.first("bands").alias("bands"))
    buckets = stored(colliding(unique), "paragraph-buckets")
    need = checkpointed(buckets.select(F.col("h").alias("g")).distinct())
    # grouped before the join, so that a line that is everywhere is collapsed where it is read; all its rows hold the same text
    at = paras.where(F.size("bands") > 0).groupBy("h").agg(*[F.first(c).alias(c) for c in ("doc_id", "doc_hash", "line")])
    todo = at.join(need, F.col("h") == F.col("g")).groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("h", "line")).alias("todo"))
    texts = stored(line_texts(_with_texts(docs, todo, "todo")), "paragraph-texts")
    found = checkpointed(components(verified(buckets, texts)))
    dropped(buckets, texts)
    lines = paras.drop("bands").join(found, F.col("h") == F.col("node"), "left").select("*", F.coalesce("component", "h").alias("class"), F.col("component").isNotNull().alias("near")).drop("node", "component")
    lines = stored(lines, "paragraph-lines")
    dropped(paras)
    first = F.min(F.struct("doc_id", "doc_hash", "nth"))
    repeated = lines.groupBy("class").agg(first.alias("first"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    repeated = checkpointed(repeated.select(F.col("class").alias("c"), "first"))
    hits = lines.join(repeated, F.col("class") == F.col("c"))
    hits = hits.groupBy("doc_id", "doc_hash", "nth").agg(*[F.first(c).alias(c) for c in ("start", "end", "words", "class", "near")], F.first("first.doc_id").alias("keep"), F.first((F.col("first") != F.struct("doc_id", "doc_hash", "nth"))).alias("later"))
    along = Window.partitionBy("doc_id", "doc_hash").orderBy("nth")
    runs = hits.withColumn("run", F.col("nth") - F.row_number().over(along))
    runs = runs.withColumn("total", F.sum("words").over(Window.partitionBy("doc_id", "doc_hash", "run"))).where(F.col("total") >= min_words)
    out = runs.select(
        "doc_id", "doc_hash", "start", "end", F.col("words").alias("n_words"), F.lit(1).cast("long").alias("n_lines"),
        F.col("later").cast("long").alias("removed_lines"), F.col("keep").alias("keep_doc_id"), F.col("class").alias("component_id"), "near",
    )
    inside = (F.col("doc_id") == F.col("cover_id")) & (F.col("doc_hash") == F.col("cover_hash")) & ~F.col("near") & (F.col("from") <= F.col("start")) & (F.col("end") <= F.col("to"))
    return exact.unionByName(out.join(_covers(exact), inside, "left_anti").drop("near")).drop("doc_hash")


def without(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the passages that occur earlier; passages may overlap; doc_id must be unique."""
    cut = found.where("removed_lines = n_lines").groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.join(cut, F.col("row")[doc_id] == F.col("of"), "left").select("row", F.col("row")[text].alias("t"), "cut")
    blank = F.lit(f"[{BLANKS}]+$")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    before = lambda acc, c: F.concat(acc["out"], F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int")))
    # a cut that leaves nothing of its line takes the line's end too
    whole = lambda acc, c: F.rlike(before(acc, c), F.lit(r"(^|\n)\z")) & (F.substring(F.col("t"), (c["end"] + 1).cast("int"), F.lit(1)) == "\n")
    step = lambda acc, c: F.struct(before(acc, c).alias("out"), F.greatest(acc["at"], c["end"] + whole(acc, c).cast("long")).alias("at"))
    end = lambda acc: F.regexp_replace(F.concat(acc["out"], F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))), blank, F.lit(""))
    new = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.aggregate("cut", begin, step, end))
    rows = rows.select("row", new.alias("new"))
    return rows.select(*[(F.col("new") if c == text else F.col("row")[c]).alias(c) for c in df.columns])
