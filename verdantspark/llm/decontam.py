"""Benchmark decontamination by a positional inverted index of the training documents, stored in shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, cut, documents, free, slices, text_buffer
from .kernels import LOWER, WORDISH, gathered, word_hashes, words

#: Words of a window.
WINDOW = 10
#: Words that may stand between those of a window in a proximity match of the query.
SLOP = 2
#: Items whose windows are searched at a time, and their bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Text of a shard of the index.
SHARD_BYTES = 512 << 10


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, each row's first word, and 64-bit term ids."""
    buf, offsets = text_buffer(texts)
    buf = LOWER[buf]
    starts, ends, row = words(buf, offsets, WORDISH)
    return buf, starts, ends, row, word_hashes(buf, starts, ends)


@dataclass
class Tests:
    """Windows of test items: the different terms, ascending by id, and per window its terms' numbers (-1 after the last), its
    size, and the items that contain it."""

    ids: np.ndarray
    texts: pa.Array
    grid: np.ndarray
    size: np.ndarray
    items: list[list]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], window: int = WINDOW) -> Tests:
        buf, starts, ends, row, h = terms(pa.array(texts, pa.string()))
        known, first, number = np.unique(h, return_index=True, return_inverse=True)
        found: dict[tuple, list] = {}
        for i, a, b in zip(ids, row[:-1].tolist(), row[1:].tolist(), strict=True):
            for s in range(a, max(a, b - window) + 1) if b > a else ():
                own = found.setdefault(tuple(number[s : min(b, s + window)].tolist()), [])
                if not own or own[-1] != i:
                    own.append(i)
        size = np.array([len(w) for w in found], np.int64)
        grid = np.full((len(found), int(size.max(initial=1))), -1, np.int64)
        for w, t in enumerate(found):
            grid[w, : len(t)] = t
        return cls(known, gathered(buf, starts[first], ends[first]), grid, size, list(found.values()))


@dataclass
class Shard:
    """A positional inverted index: per term, ascending by id, its text and the ascending numbers of its words in the shard.

    `row` has the first word of each document, and at the end the number of words.
    """

    row: np.ndarray
    texts: pa.Array
    first: np.ndarray
    places: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Shard:
        buf, starts, ends, row, h = terms(texts)
        order = np.argsort(h, kind="stable")
        known, first = np.unique(h[order], return_index=True)
        some = order[first]
        return cls(row, gathered(buf, starts[some], ends[some]), np.append(first, len(order)), order, known)

    @classmethod
    def stored(cls, row: pa.Array, texts: pa.Array, first: pa.Array, places: pa.Array) -> Shard:
        buf, offsets = text_buffer(texts)
        return cls(row.to_numpy().astype(np.int64), texts, first.to_numpy().astype(np.int64), places.to_numpy().astype(np.int64), word_hashes(buf, offsets[:-1], offsets[1:]))

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))

    def search(self, tests: Tests, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact matches (window, first word), and with `slop` near ones (window, word): a stretch of `slop` more words than the
        window has holds all its terms, in any order; the word is one of its rarest term here. What is near depends on the
        document alone, not on which term is the rarest in the shard.

        Lists of all windows whose terms all occur here are intersected side by side, each window's from its rarest term on:
        what is left of a list, shifted by the terms' offsets, is looked up in the next. Terms are compared by text, too.
        """
        none = np.zeros(0, np.int64)
        if not len(tests.size) or not len(self.terms):
            return none, none, none, none
        number = np.minimum(np.searchsorted(self.terms, tests.ids), len(self.terms) - 1)
        same = self.terms[number] == tests.ids
        same[same] = pc.equal(self.texts.take(pa.array(number[same])), tests.texts.filter(pa.array(same))).to_numpy(zero_copy_only=False)
        length = np.where(same, np.diff(self.first)[number], 0)
        counts = np.where(tests.grid >= 0, length[tests.grid], np.iinfo(np.int64).max)
        alive = np.flatnonzero(counts.min(1) > 0)
        if not len(alive):
            return none, none, none, none
        order = np.argsort(counts[alive], axis=1, kind="stable")
        width = tests.grid.shape[1] + slop + 1  # a gap between documents that no window crosses
        owner = self.owner()
        places = self.places + owner[self.places] * width
        reach = int(places.max()) + 2 * width + 1
        lists = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * reach + places  # all lists as one ascending list
        rare = tests.grid[alive, order[:, 0]]
        n = length[rare]
        w = np.repeat(np.arange(len(alive)), n)
        at = places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[number[rare]], n)]

        def next_in_list(w: np.ndarray, j: int, place: np.ndarray) -> np.ndarray:
            """The first place from `place` on in the list of a window's j-th rarest term; far away if there is none."""
            t = number[tests.grid[alive[w], order[w, j]]] * reach
            k = np.searchsorted(lists, t + place)
            got = lists[np.minimum(k, len(lists) - 1)] - t
            return np.where((k < len(lists)) & (got < reach), got, 4 * reach)

        def matched(w: np.ndarray, at: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
            for j in range(1, tests.grid.shape[1]):
                more = tests.size[alive[w]] > j
                ok = ~more
                ok[more] = keep(w[more], j, at[more])
                w, at = w[ok], at[ok]
                if not len(w):
                    break
            return w, at

        def adjacent(w, j, at):
            want = at + order[w, j]
            return next_in_list(w, j, want) == want

        def around(w, j, at):
            far = tests.size[alive[w]] + slop - 1
            return next_in_list(w, j, np.maximum(at - far, 0)) <= at + far

        def together(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of places around which all terms occur, those that share one stretch with all of them."""
            far = tests.size[alive[w]] + slop - 1
            hold = np.zeros(len(w), bool)
            for back in range(int(far.max(initial=-1)) + 1):
                open_ = np.flatnonzero(~hold & (far >= back))
                start, last = at[open_] - back, at[open_] - back + far[open_]
                fits = np.ones(len(open_), bool)
                for j in range(1, tests.grid.shape[1]):
                    left = np.flatnonzero(fits & (tests.size[alive[w[open_]]] > j))
                    fits[left] = next_in_list(w[open_[left]], j, start[left]) <= last[left]
                hold[open_[fits]] = True
            return w[hold], at[hold]

        to_word = lambda p: p - width * np.searchsorted(self.row[1:] - 1 + np.arange(len(self.row) - 1) * width, p)
        x, begin = matched(w, at - order[w, 0], adjacent)
        y, near = together(*matched(w, at, around)) if slop else (none, none)
        return alive[x], to_word(begin), alive[y], to_word(near)


def judged(shard: Shard, tests: list[Tests], slop: int) -> list[pa.Array]:
    """Per document of a shard: words, words inside an occurrence of a window, the borders of such stretches of words, the items
    that occur and those that occur nearby."""
    n, rows = int(shard.row[-1]), len(shard.row) - 1
    step, owner = np.zeros(n + 1, np.int64), shard.owner()
    exact: list[set] = [set() for _ in range(rows)]
    close: list[set] = [set() for _ in range(rows)]
    for block in tests:
        w, begin, v, near = shard.search(block, slop)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + block.size[w], -1)
        for sets, which, words_ in ((exact, w, begin), (close, v, near)):
            for r, x in sorted(set(zip(owner[words_].tolist(), which.tolist(), strict=True))):
                sets[r].update(block.items[x])
    inside = np.cumsum(step[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    spans: list[list[int]] = [[] for _ in range(rows)]
    for r in np.unique(owner[inside]).tolist():
        own = np.concatenate([[0], inside[shard.row[r] : shard.row[r + 1]].astype(np.int8), [0]])
        spans[r] = np.flatnonzero(np.diff(own)).tolist()
    lists = [pa.array(spans, pa.list_(pa.int32())), *(pa.array([sorted(map(str, x)) for x in found], pa.list_(pa.string())) for found in (exact, close))]
    return [pa.array(np.diff(shard.row)), pa.array(total[shard.row[1:]] - total[shard.row[:-1]]), *lists]


def blocks(items: DataFrame, window: int, size: int = BLOCK_ITEMS) -> Iterator[Tests]:
    """Test items in blocks of bounded size; items without words, and null ids, have no windows."""
    ids, texts, held = [], [], 0
    for r in items.select(F.col("item_id").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null and t is not null").toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        held += len(r.t)
        if len(ids) == size or held >= BLOCK_BYTES:
            yield Tests.of(ids, texts, window)
            ids, texts, held = [], [], 0
    if ids:
        yield Tests.of(ids, texts, window)


#: What is found of each document: words, words that are hit, borders of hit stretches of words, items, items nearby.
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("near_items", T.ArrayType(T.StringType())),
]
#: A shard of the stored index: its documents' ids and first words, the terms, and each one's part of the places.
INDEX = "shard long, doc_ids array<long>, row array<int>, terms array<string>, first array<int>, places array<int>"


def positional_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of all words of docs as a table, a row for each shard of about SHARD_BYTES of text. Each
    task indexes its own documents, so nothing is shuffled, and a term that very many documents share is one list a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=SHARD_BYTES):
                shard = Shard.of(part.column("text"))
                ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([pa.array([k]), one(part.column("doc_id")), ints(shard.row), one(shard.texts), ints(shard.first), ints(shard.places)], names=["shard", "doc_ids", "row", "terms", "first", "places"])
                k += 1

    return documents(docs).mapInArrow(run, INDEX)


def search_index(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id and the columns FOUND of every document of a positional_index."""
    sc = index.sparkSession.sparkContext
    sent = [sc.broadcast(t) for t in blocks(items, window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [s.value for s in sent]
        for b in batches:
            for r in range(b.num_rows):
                shard = Shard.stored(*(b[c][r].values for c in ("row", "terms", "first", "places")))
                yield pa.RecordBatch.from_arrays([b["doc_ids"][r].values, *judged(shard, tests, slop)], names=["doc_id", *(f.name for f in FOUND)])

    return index.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *FOUND]))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and near_items of every document.

    The index of docs is written to the shared folder and searched shard by shard; windows come in blocks of bounded size, and
    what a task holds grows with the items, never with the documents. Null and empty texts have no words; repeated rows are
    judged each, as are rows without an id; no items leave all documents clean; an empty table gives no rows.
    """
    return search_index(cut(positional_index(docs), "positional-index"), items, window, slop)


def with_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """docs with the columns FOUND, with underscores in front of names that docs has: rows stay where they are, and the shards
    of the index live as long as their search."""
    sent = [docs.sparkSession.sparkContext.broadcast(t) for t in blocks(items, window)]
    names = free(docs.columns, *(f.name for f in FOUND))

    def setup():
        tests = [s.value for s in sent]
        return lambda part: judged(Shard.of(part.column("text")), tests, slop)

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return append_arrow(typed, None, [T.StructField(n, f.dataType) for n, f in zip(names, FOUND, strict=True)], setup, SHARD_BYTES)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns and rows of docs without those in which a window of an item occurs."""
    hit = free(docs.columns, *(f.name for f in FOUND))[1]
    return with_contamination(docs, items, window).filter(F.col(hit) == 0).select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The query's rows in DuckDB's SQL, for unique ids.
ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bs as (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as s from b where len(w) > 0),
bw as (select distinct item_id, len(list_slice(w, s, s + {WINDOW - 1})) as n, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') as k from bs),
ds as (select doc_id, w, z.n, unnest(range(1, len(w) - z.n + 2)) as s from d, (select distinct n from bw) z where len(w) >= z.n),
h as (select ds.doc_id, ds.s, ds.n, bw.item_id from ds join bw on ds.n = bw.n and array_to_string(list_slice(ds.w, ds.s, ds.s + ds.n - 1), ' ') = bw.k),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from h) group by doc_id),
bt as (select distinct item_id, n + {SLOP} as reach, list_sort(list_distinct(string_split(k, ' '))) as terms from bw),
dt as (select doc_id, w, unnest(range(1, len(w) + 1)) as p, unnest(w) as t from d),
f as (select t, count(*) as n from dt group by t),
a as (select item_id, reach, terms, arg_min(x.t, coalesce(f.n, 0)) as rare from (select *, unnest(terms) as t from bt) x left join f on x.t = f.t group by item_id, reach, terms),
c as (select doc_id, item_id, w, p, reach, terms from dt join a on dt.t = a.rare where list_has_all(list_slice(w, greatest(p - reach + 1, 1), p + reach - 1), terms)),
r as (select doc_id, string_agg(i, ',' order by i) as near_items from (select distinct doc_id, cast(item_id as varchar) as i from (select *, unnest(range(greatest(p - reach + 1, 1), p + 1)) as s from c) where list_has_all(list_slice(w, s, s + reach - 1), terms)) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(p.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.items, '')) as items_sha256, p.n_hit is not null as contaminated, coalesce(r.near_items, '') as near_items
from d left join p on d.doc_id = p.doc_id left join i on d.doc_id = i.doc_id left join r on d.doc_id = r.doc_id
"""
