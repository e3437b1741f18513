"""Substring dedup: a count-min prefilter over word windows, then exact groups of the windows that may be repeated."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_buffer
from .kernels import NOT_SPACE, U64, covered, mix, runs_at, window_hashes, window_starts, word_hashes, words

#: Text of a group of documents, which a task holds as a whole.
GROUP_BYTES = 8 << 20
#: Words of the anchors, by which the sketch counts windows.
ANCHOR = 10
#: Windows, or cells of a row of the sketch, of a shard, on average.
SHARD_WINDOWS = 1 << 20
#: Cells of a sketch row for each anchor of the corpus, and rows.
CELLS_PER_ANCHOR = 4
DEPTH = 3
#: A cell counts up to this.
MOST = 255

NO_ID = np.iinfo(np.int64).max
_ROW_SEEDS = [U64(0), *(mix(np.arange(1, 9, dtype=U64) * U64(0x9E3779B97F4A7C15)))]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte integers as compressed byte planes; small numbers cost few bytes."""
    codec = pa.Codec("zstd", 1)
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes()
        z = codec.compress(raw, asbytes=True)
        parts.append(struct.pack("<qq", len(a), len(z)) + z)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd"), 0, []
    while at < len(data):
        n, size = struct.unpack_from("<qq", data, at)
        raw = codec.decompress(data[at + 16 : at + 16 + size], decompressed_size=8 * n, asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(U64).ravel())
        at += 16 + size
    return out


def bits(flags: np.ndarray) -> bytes:
    return struct.pack("<q", len(flags)) + np.packbits(flags, bitorder="little").tobytes()


def unbits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=struct.unpack_from("<q", data)[0], bitorder="little").astype(bool)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest (best: np.minimum or np.maximum) of each `width` consecutive values."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have < width:
        by = min(have, width - have)
        out = best(out[: len(out) - by], out[by:])
        have += by
    return out


class Group:
    """The words and windows of some documents, in ascending order of their ids; a null id counts as larger than any."""

    def __init__(self, table: pa.Table, k: int) -> None:
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order))
        self.ids = ids[order]
        texts = self.table["text"].cast(pa.large_string()).combine_chunks()
        self.buf, offsets = text_buffer(texts if isinstance(texts, pa.Array) else texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string()))
        self.starts, self.ends, self.row = words(self.buf, offsets, NOT_SPACE)
        self.k = k
        self.hashes = word_hashes(self.buf, self.starts, self.ends, 1)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.row))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the places that anchor a window, and per window the hash of its anchor.

        A window's anchor is the run of ANCHOR words in it with the least hash, so that equal windows have equal anchors, and
        windows of different documents have anchors at different places. Neighbouring windows mostly share theirs.
        """
        words_ = min(ANCHOR, self.k)
        g, at = window_hashes(self.hashes, self.row, words_)
        n, span = len(self.hashes), self.k - words_ + 1
        values = np.full(n, np.iinfo(np.uint64).max, U64)
        values[at] = g
        starts = window_starts(self.row, self.k)
        least = np.zeros(n, U64)
        if len(starts):
            least[starts] = sliding(values, span, np.minimum)[starts]
        # a place is an anchor if it is the least of a window over it: the greatest of the windows' least values is its own
        reach = sliding(np.concatenate([np.zeros(span - 1, U64), least]), span, np.maximum)
        return g[reach[at] == g] if n else g, least[starts]

    def windows(self, flagged: np.ndarray) -> None:
        """Hashes of those windows that are flagged: `h`, the different ones ascending, `first`, the first place of each, and
        `which`, each place's; places are `at`."""
        self.at = window_starts(self.row, self.k)[flagged]
        h = runs_at(self.hashes, self.at, self.k)
        self.h, self.first, self.which = np.unique(h, return_index=True, return_inverse=True)

    def doc_of(self, windows: np.ndarray) -> np.ndarray:
        """The smallest document index of each given window: documents are in order, so that of its first place."""
        return self.owner[self.at[self.first[windows]]]

    def second(self) -> np.ndarray:
        """Another hash of the different windows, by other hashes of the words."""
        return runs_at(word_hashes(self.buf, self.starts, self.ends, 2), self.at[self.first], self.k)


class Sketch:
    """A count-min sketch of DEPTH rows, cut into shards by the leading bits of a cell's number."""

    def __init__(self, windows: int, depth: int) -> None:
        self.depth = depth
        anchors = max(windows, 1) / 16  # about two in 41 places; the sketch need not be exact about it
        self.cell_bits = max(8, int(np.ceil(np.log2(anchors * CELLS_PER_ANCHOR))))
        self.sketch_bits = max(0, int(np.ceil(np.log2(anchors / SHARD_WINDOWS))))
        self.shard_bits = max(0, int(np.ceil(np.log2(max(windows, 1) / SHARD_WINDOWS))))

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The row's cell of each hash."""
        return (mix(h ^ _ROW_SEEDS[row]) if row else h) >> U64(64 - self.cell_bits)

    def shards(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs (shard, from, to) of ascending cells."""
        s = (cells >> U64(self.cell_bits - self.sketch_bits)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else np.zeros(1, np.int64)
        return [(int(s[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


MESSAGE = "to long, g long, data binary"


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    to, g, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"to": pa.array(to, pa.int64()), "g": pa.array(g, pa.int64()), "data": pa.array(data, pa.binary())})


def repeated_windows(docs: DataFrame, k: int = 50, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_words, n_removed, removed (borders of removed stretches of words) and kept for every document.

    A word is removed if a window of k words that covers it also starts in a document with a smaller id; kept are the other
    words, joined by one space. Documents are dealt once into groups of about GROUP_BYTES; all that moves afterwards are
    compressed messages between groups and shards, each shard with a bounded share of all windows:

    1. A group counts its windows' anchors in its own sketch of `depth` rows; the counts of its cells go to the shards of the
       sketch. A shard adds up all groups' counts and tells each group which of its cells count two or more.
    2. A window whose anchor counts two or more in every row may be repeated. The sketch only overestimates, and a window that
       two documents hold has an anchor in each, so no repeated window is missed. Such windows go, once a group, with 128 bits
       of two hashes and their smallest document, to shards of windows. Such a shard groups equal windows and answers which of
       a group's have a smaller document elsewhere.
    3. A group marks the words.

    The sketch grows with the corpus and is never whole anywhere. A window that very many documents share is one entry per
    group, so no task gets its copies. Nothing is collected, and each step is a shuffle of one query, so a lost executor
    costs its own tasks. Null or empty texts have no words; a null id counts as larger than all others; rows with one id
    don't repeat each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    total, chars = docs.agg(F.sum(F.octet_length("text")), F.sum(F.length("text"))).first()
    sketch = Sketch((chars or 0) // 5, depth)  # words are five letters or so; the sketch need not be exact about it
    n = max(1, -(-(total or 0) // GROUP_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = docs.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "g")

    def count(table: pa.Table) -> pa.Table:
        g, anchors = table["g"][0].as_py(), Group(table, k).anchors()[0]
        rows = []
        for r in range(depth):
            cells, n = np.unique(sketch.cells(anchors, r), return_counts=True)
            for s, a, b in sketch.shards(cells):
                rows.append((r << 40 | s, g, pack(np.diff(cells[a:b], prepend=U64(0)), np.minimum(n[a:b], MOST).astype(U64))))
        return messages(rows)

    def merge(table: pa.Table) -> pa.Table:
        to, parts = table["to"][0].as_py(), []
        for data in table["data"].to_pylist():
            cells, n = unpack(data)
            parts.append((np.cumsum(cells, dtype=U64), n))
        known, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        several = np.bincount(which, np.concatenate([n for _, n in parts]).astype(float)) >= 2
        cuts = np.cumsum([len(c) for c, _ in parts])[:-1]
        return messages([(to, g, bits(f)) for g, f in zip(table["g"].to_pylist(), np.split(several[which], cuts), strict=True)])

    def suspects(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        g, group = left["g"][0].as_py(), Group(left, k)
        answers = dict(zip(right["to"].to_pylist(), right["data"].to_pylist(), strict=True))
        anchors, own = group.anchors()
        flagged = np.ones(len(own), bool)
        for r in range(depth):
            cells = np.unique(sketch.cells(anchors, r))
            several = np.concatenate([np.zeros(0, bool), *(unbits(answers[r << 40 | s]) for s, _, _ in sketch.shards(cells))])
            flagged &= several[np.searchsorted(cells, sketch.cells(own, r))] if len(cells) else False
        group.windows(flagged)
        rows = [(-1 - g, g, bits(flagged))]
        if len(group.h):
            h, other, ids = group.h, group.second(), group.ids[group.doc_of(np.arange(len(group.h)))]
            shift = U64(64 - sketch.shard_bits)
            s = (h >> shift).astype(np.int64) if sketch.shard_bits else np.zeros(len(h), np.int64)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                rows.append((int(s[a]), g, pack(np.diff(h[a:b], prepend=U64(0)), other[a:b], ids[a:b].view(U64))))
        return messages(rows)

    def exact(table: pa.Table) -> pa.Table:
        to = table["to"][0].as_py()
        if to < 0:  # a group's note to itself
            return table.select(["to", "g", "data"])
        parts = [unpack(d) for d in table["data"].to_pylist()]
        h = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        other = np.concatenate([p[1] for p in parts])
        ids = np.concatenate([p[2] for p in parts]).view(np.int64)
        order = np.lexsort((ids, other, h))
        h, other, least = h[order], other[order], ids[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])])
        least = least[np.flatnonzero(new)][np.cumsum(new) - 1]
        smaller = np.empty(len(ids), bool)
        smaller[order] = least < ids[order]
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return messages([(to, g, bits(f)) for g, f in zip(table["g"].to_pylist(), np.split(smaller, cuts), strict=True)])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.int32())), "kept": pa.array([], pa.string())})
        group = Group(left, k)
        answers = dict(zip(right["to"].to_pylist(), right["data"].to_pylist(), strict=True))
        group.windows(unbits(answers.pop(-1 - left["g"][0].as_py())))
        elsewhere = np.concatenate([np.zeros(0, bool), *(unbits(answers[s]) for s in sorted(answers))])
        # per window, the smallest id known here, or less than any
        earlier = np.where(elsewhere, np.iinfo(np.int64).min, group.ids[group.doc_of(np.arange(len(group.h)))])
        own = group.ids[group.owner[group.at]]
        gone = covered(earlier[group.which] < own, group.at, k, len(group.starts))
        return kept_words(group, gone)

    first = grouped.groupBy("g").applyInArrow(count, MESSAGE)
    answers = first.groupBy("to").applyInArrow(merge, MESSAGE)
    found = grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(suspects, MESSAGE)
    verdicts = found.groupBy("to").applyInArrow(exact, MESSAGE)
    return grouped.groupBy("g").cogroup(verdicts.groupBy("g")).applyInArrow(mark, "doc_id long, n_words long, n_removed long, removed array<int>, kept string")


def kept_words(group: Group, gone: np.ndarray) -> pa.Table:
    """The result's rows: what is left of each document, its words joined by one space."""
    keep = np.flatnonzero(~gone)
    lens = (group.ends - group.starts)[keep]
    size = lens + 1
    at = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 0x20, np.uint8)
    inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    flat[inner + np.repeat(at, lens)] = group.buf[inner + np.repeat(group.starts[keep], lens)]
    total = np.concatenate([[0], np.cumsum(~gone)])
    left = total[group.row]
    ends = np.append(at, size.sum())
    data = flat.tobytes()
    texts = [data[a : max(a, b - 1)] for a, b in zip(ends[left[:-1]].tolist(), ends[left[1:]].tolist(), strict=True)]
    borders = []
    for a, b, n, m in zip(group.row[:-1].tolist(), group.row[1:].tolist(), left[:-1].tolist(), left[1:].tolist(), strict=True):
        borders.append(np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).tolist() if m - n < b - a else [])
    counts = np.diff(group.row)
    return pa.table({"doc_id": group.table["doc_id"], "n_words": pa.array(counts), "n_removed": pa.array(counts - np.diff(left)), "removed": pa.array(borders, pa.list_(pa.int32())), "kept": pa.array(texts, pa.binary()).cast(pa.string())})


#: The query's rows in DuckDB's SQL, for windows of 50 words and unique ids.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50),
k as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) as k from s),
f as (select k, min(doc_id) as least from k group by k),
g as (select distinct k.doc_id, unnest(range(k.s, k.s + 50)) as p from k join f on k.k = f.k where f.least < k.doc_id),
t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d),
r as (select t.doc_id, count(*) as n_words, count(g.p) as n_removed, string_agg(t.word, ' ' order by t.p) filter (where g.p is null) as kept from t left join g on t.doc_id = g.doc_id and t.p = g.p group by t.doc_id)
select d.doc_id, coalesce(r.n_words, 0) as n_words, coalesce(r.n_removed, 0) as n_removed, sha256(coalesce(r.kept, '')) as kept_sha256 from d left join r on d.doc_id = r.doc_id
"""
