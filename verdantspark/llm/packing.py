"""Hierarchical multi-length packing of tokenised documents into training sequences."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, slices
from .tokens import WordEncoder

#: Context sizes, all powers of two, longest first. A sequence of exactly one of these sizes needs no padding.
TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens a task holds before it packs them.
BUFFER_TOKENS = 4 << 20
#: Padded tokens that a step group should have.
STEP_TOKENS = 1 << 17
#: Tasks whose last, unfilled sequences are packed together.
MERGED_TASKS = 64

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("padded_length", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Piece:
    """A run of one document's ids: which document, how many of its ids lie before, how many it has, and the ids."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)

    def __len__(self) -> int:
        return len(self.ids)


class Shelf:
    """The pieces of one tier that wait, by length."""

    def __init__(self) -> None:
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.n = 0

    def add(self, p: Piece) -> None:
        insort(self.keys, (len(p), self.n))
        self.pieces[self.n] = p
        self.n += 1

    def fitting(self, room: int) -> Piece | None:
        """The longest piece of at most `room` ids."""
        i = bisect_right(self.keys, (room, self.n))
        return self.pieces.pop(self.keys.pop(i - 1)[1]) if i else None

    def longest(self) -> Piece | None:
        return self.pieces.pop(self.keys.pop()[1]) if self.keys else None


def pack(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (context size, pieces), all exactly full; and the pieces left over.

    Longest tier first, each piece of a tier opens a window of that size. The gap takes the longest waiting piece of a
    shorter tier that fits, again and again, and at last the head of a piece that doesn't, so that the window is full.
    Without `last`, what can't fill a window is left over; with it, the rest is cut into full windows of ever shorter
    tiers, and fewer ids than the shortest tier are left over.
    """
    shelves = {t: Shelf() for t in tiers}
    tier_of = lambda n: next(t for t in reversed(tiers) if n <= t)
    done: list[tuple[int, list[Piece]]] = []
    waiting = 0
    for p in pieces:
        while len(p) > tiers[0]:
            head, p = p.split(tiers[0])
            done.append((tiers[0], [head]))
        if len(p):
            shelves[tier_of(len(p))].add(p)
            waiting += len(p)
    rest: list[Piece] = []
    for k, tier in enumerate(tiers):
        while (p := shelves[tier].longest()) is not None:
            if waiting < tier:  # no longer enough for a window of this size
                rest.append(p)
                waiting -= len(p)
                continue
            window, room = [p], tier - len(p)
            waiting -= len(p)
            while room:
                lower = tiers[k + 1 :] or tiers[k:]
                q = next((q for t in lower if t < 2 * room and (q := shelves[t].fitting(room)) is not None), None)
                if q is None and (q := next((q for t in reversed(tiers[k:]) if (q := shelves[t].longest()) is not None), None)) is not None and len(q) > room:
                    q, tail = q.split(room)
                    shelves[tier_of(len(tail))].add(tail)
                waiting -= len(q)
                window.append(q)
                room -= len(q)
            done.append((tier, window))
    if last:
        for tier in tiers:
            while sum(map(len, rest)) >= tier:
                window, room = [], tier
                while room:
                    p = rest.pop()
                    if len(p) > room:
                        p, tail = p.split(room)
                        rest.append(tail)
                    window.append(p)
                    room -= len(p)
                done.append((tier, window))
    return done, rest


def steps(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence: longest first, to the group with the fewest ids so far."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        total, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (total + sizes[i], g))
    return out


class Writer:
    """Numbers sequences and step groups within a task and makes the result's batches."""

    def __init__(self, space: int, keep_ids: bool, step_tokens: int) -> None:
        self.next_sequence = self.next_group = (space << 48) | (TaskContext.get().partitionId() << 26)
        self.keep_ids, self.step_tokens = keep_ids, step_tokens

    def batch(self, sequences: list[tuple[int, list[Piece]]], padded: int | None = None) -> pa.RecordBatch:
        rows: list[tuple] = []
        groups = steps([t for t, _ in sequences], self.step_tokens)
        for (tier, pieces), g in zip(sequences, groups, strict=True):
            offset = 0
            for p in pieces:
                ids = p.ids.astype("<u4").tobytes()
                rows.append((p.doc, p.start, len(p), zlib.crc32(ids), p.total, self.next_sequence, offset, tier, padded or tier, self.next_group + g, ids if self.keep_ids else None))
                offset += len(p)
            self.next_sequence += 1
        self.next_group += max(groups, default=-1) + 1
        return self.rows(rows)

    def left(self, rest: list[Piece]) -> pa.RecordBatch:
        """Rows without a sequence, for the second round."""
        return self.rows([(p.doc, p.start, len(p), None, p.total, None, None, None, None, None, p.ids.astype("<u4").tobytes()) for p in rest])

    @staticmethod
    def rows(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PIECES)
        cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most tiers[0] ids.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (unsigned, of the ids as
    little-endian 32-bit integers), doc_tokens (with the end id), sequence_id, offset (in the sequence), tier,
    padded_length, step_group, and ids (binary, little-endian 32-bit) with keep_ids.

    Each task routes its documents to the tiers, packs them (see pack) and groups sequences into steps of near equal
    size; nothing is shuffled but fewer than tiers[-1] ids a task, which a second round packs for MERGED_TASKS tasks at a
    time. There, each last sequence alone is padded, to tiers[0]. A null or empty text is its end id; repeated rows and
    null ids are packed as rows of their own; an empty table gives no rows.
    """

    def flow(space: int, source):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, held, size = Writer(space, keep_ids, step_tokens), [], 0
            for found in source(batches):
                held += found
                size += sum(map(len, found))
                if size >= BUFFER_TOKENS:
                    done, held = pack(held, tiers, False)
                    size = sum(map(len, held))
                    yield w.batch(done)
            done, rest = pack(held, tiers, True)
            yield w.batch(done)
            if rest and space:
                yield w.batch([(tiers[0], rest)])
            elif rest:
                yield w.left(rest)

        return run

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
        encoder = WordEncoder.of(tokenizer)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(x + end, encoder.dtype) for x in encoder.encode(part.column("text").to_pylist())]
                yield [Piece(d, 0, x, len(x)) for d, x in zip(part.column("doc_id").to_pylist(), ids, strict=True)]

    def lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
        for b in batches:
            yield [Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in b.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist()]

    first = cut(documents(docs).mapInArrow(flow(0, texts), PIECES).withColumn("task", F.spark_partition_id()), "pieces", narrow=True)
    full = first.filter("sequence_id is not null").drop("task")
    groups = max(1, (first.select(F.max("task")).first()[0] or 0) // MERGED_TASKS)
    rest = first.filter("sequence_id is null").withColumn("task", F.col("task") % groups).repartition(groups, "task").sortWithinPartitions("doc_id", "start", "ids").drop("task")
    return full.unionByName(rest.mapInArrow(flow(1, lefts), PIECES))
