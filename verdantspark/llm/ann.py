"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors on which centroids and codebooks are fitted, at most; every vector is indexed.
SAMPLE = 16_384
#: Coarse lists, at most; otherwise the square root of the number of vectors.
LISTS = 4_096
#: Share of the true neighbours in the sample that must lie in the lists that a query probes; how many lists that takes is
#: measured on so many of the sample's vectors.
REACH, TRIED = 0.97, 256
#: Candidates a query's exact ranking gets.
KEEP = 300
#: Rows that one task compares at most; longer lists are cut into blocks.
BLOCK = 100_000
#: Queries that one task holds at a time.
QUERY_BLOCK = 50_000
CODEWORDS = 256
#: Components beyond this are scaled down for the index, vector by vector, so that squares stay finite; scores aren't.
LARGEST = 1e100


def valid(vector: str = "embedding"):
    """Vectors without null or non-finite components that aren't zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as the index sees them, in double precision."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    top = np.abs(x).max(1, initial=0)
    return x / np.maximum(top / LARGEST, 1)[:, None]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q; where squares would leave the range of doubles, differences are scaled first."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        rest = x - q
        d = np.sqrt((rest**2).sum(1))
        top = np.abs(rest).max(1, initial=0)
        odd = (top > 1e150) | ((top < 1e-150) & (top > 0))
        if odd.any():
            half = np.where(np.isfinite(top[odd]), 1.0, 0.5)[:, None]  # a difference of two finite values may not be finite
            near = x[odd] * half - q * half
            most = np.abs(near).max(1)
            d[odd] = most * np.sqrt(((near / most[:, None]) ** 2).sum(1)) / half[:, 0]
    return d


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * (x @ centers.T), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k different rows; a centre without rows stays."""
    rows = np.unique(x, axis=0)
    centers = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        counts = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(counts)
        centers[some] = np.add.reduceat(x[order], np.cumsum(counts[some]) - counts[some], axis=0) / counts[some, None]
    return centers


@dataclass
class Model:
    """Coarse centroids, and per part of the dimensions a codebook of residuals."""

    centers: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int) -> Model:
        centers = kmeans(x, lists)
        rest = x - centers[nearest(x, centers)]
        edges = [round(x.shape[1] * i / parts) for i in range(parts + 1)]
        return cls(centers, [kmeans(rest[:, a:b], CODEWORDS) for a, b in zip(edges, edges[1:], strict=False)], edges)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centers)
        rest = x - self.centers[own]
        return own, np.column_stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]).astype(np.uint8)

    def tables(self, q: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of the queries' residuals to every codeword: queries x parts x codewords."""
        rest = q - self.centers[which]
        out = np.full((len(q), len(self.books), CODEWORDS), np.inf)
        for m, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            part = rest[:, a:b]
            out[:, m, : len(book)] = np.maximum((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1), 0)
        return out


def lists_needed(model: Model, x: np.ndarray, k: int) -> int:
    """Lists in order of nearness that hold the share REACH of the k true neighbours, among the sample x, of TRIED of its rows."""
    own = nearest(x, model.centers)
    pick = np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int))
    ranks = []
    for i in pick.tolist():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        order = np.argsort((model.centers**2).sum(1) - 2 * (model.centers @ x[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks += place[own[near]].tolist()
    return int(np.quantile(ranks, REACH, method="higher")) + 1 if ranks else len(model.centers)


def bins_of(size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per list its first bin and its number of bins, for about n bins of like size: short lists share one, in order; a list of
    more than BLOCK rows is cut over bins of its own."""
    most = max(1, min(BLOCK, -(-int(size.sum()) // max(n, 1))))
    first, count, now, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for i, rows in enumerate(size.tolist()):
        if held and held + rows > most:
            now, held = now + 1, 0
        first[i] = now
        if rows > BLOCK:
            count[i] = -(-rows // BLOCK)
            now, held = now + int(count[i]), 0
        else:
            held += rows
    return first, count


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, parts: int | None = None, probe: float | None = None, keep: int = KEEP) -> DataFrame:
    """query_id, rank, vec_id and score: for each query (vec_id, embedding) its k nearest found of vectors, by Euclidean
    distance in double precision, nearest first, ties to the smaller vec_id; never the row with the query's own id.

    Centroids and codebooks are fitted on at most SAMPLE vectors, taken by the hash of their id; all vectors are indexed. A
    query probes the nearest lists, as many as the sample says hold the share REACH of true neighbours (or the share `probe` of
    the lists), and more until they hold 10 k vectors. Lists are gathered into bins of like size; one with very many rows is
    cut over several. A query's vector goes once to each bin that it probes. Per bin and query, asymmetric table distances pick
    `keep` candidates; the best `keep` of a query are ranked on the original vectors.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids, nor vectors of another
    length than most have (of two lengths equally frequent, the smaller). Components of any finite size have finite scores as
    long as the distance is a double. Rows that repeat an id are candidates each; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & valid())
    most = known.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = most["count"]
    known = known.filter(F.size("embedding") == most.n)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("query_id").isNotNull() & valid() & (F.size("embedding") == most.n))
    x = matrix(known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks())
    lists = lists or int(min(LISTS, len(x), max(1, round(total**0.5))))
    model = Model.fit(x, lists, parts or max(1, x.shape[1] // 2))
    least = int(np.ceil(probe * len(model.centers))) if probe else lists_needed(model, x, k)
    sent = spark.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, codes = sent.value.encode(matrix(b["embedding"]))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b["vec_id"], pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "vec_id", "code"])

    coded = cut(known.mapInArrow(code, "list int, vec_id long, code binary"), "codes", narrow=True)
    sizes = coded.groupBy("list").count().toArrow()  # one row a list, LISTS at most
    size = np.zeros(len(model.centers), np.int64)
    size[sizes["list"].to_numpy()] = sizes["count"].to_numpy()
    first, count = bins_of(size, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = sent.value.centers
        for b in batches:
            if b.num_rows:
                q = matrix(b["embedding"])
                order = np.argsort((centers**2).sum(1) - 2 * (q @ centers.T), axis=1)
                take = np.cumsum(size[order], axis=1) - size[order] < 10 * k + 1
                take |= np.arange(len(centers)) < least
                take &= size[order] > 0
                to, row, which = [], [], []
                for i in range(len(q)):
                    own = order[i, take[i]]
                    bins = np.repeat(first[own], count[own]) + np.concatenate([np.arange(n) for n in count[own].tolist()] or [np.zeros(0, np.int64)])
                    own = np.repeat(own, count[own])
                    by = np.argsort(bins, kind="stable")
                    edge = np.flatnonzero(np.append(True, np.diff(bins[by]) != 0)) if len(by) else by
                    to += bins[by][edge].tolist()
                    row += [i] * len(edge)
                    which += np.split(own[by].astype(np.int32), edge[1:]) if len(by) else []
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b["query_id"].take(pa.array(row, pa.int64())), b["embedding"].take(pa.array(row, pa.int64())), pa.array(which, pa.list_(pa.int32()))], names=["bin", "query_id", "embedding", "lists"])

    firsts, counts = F.lit(first.tolist()), F.lit(count.tolist())
    of_list = lambda a: F.element_at(a, F.col("list") + 1)
    left = coded.withColumn("bin", of_list(firsts) + F.pmod(F.xxhash64("vec_id"), of_list(counts))).withColumn("part", F.lit(0).cast("long"))
    probed = asked.mapInArrow(probes, "bin long, query_id long, embedding array<double>, lists array<int>")
    n_parts = -(-max(1, asked.count()) // QUERY_BLOCK)  # so many queries that a bin may get are dealt in parts
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    right = probed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_parts)))

    def compare(codes: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[int, tuple[list, list]] = {}
        if codes.num_rows and asks.num_rows:
            at, ids = codes["list"].to_numpy(), codes["vec_id"].to_numpy()
            order = np.lexsort((ids, at))
            at, ids = at[order], ids[order]
            c = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order].T.copy()
            q, wanted = matrix(asks["embedding"].combine_chunks()), asks["lists"].to_pylist()
            row = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
            which = np.array([x for w in wanted for x in w], np.int64)
            for x in np.unique(which).tolist():
                a, b = np.searchsorted(at, (x, x + 1))
                if a == b:
                    continue
                rows = row[which == x]
                for i in range(0, len(rows), 64):
                    some = rows[i : i + 64]
                    for table, r in zip(sent.value.tables(q[some], x), some.tolist(), strict=True):
                        d = np.zeros(b - a)
                        for m in range(len(c)):
                            d += table[m][c[m, a:b]]
                        held = out.setdefault(r, ([], []))
                        held[0].append(ids[a:b])
                        held[1].append(d)
        found_v, found_d = [], []
        for v, d in out.values():
            v, d = np.concatenate(v), np.concatenate(d)
            pick = np.lexsort((v, d))[:keep] if len(d) <= keep else np.argpartition(d, keep - 1)[:keep]
            if len(d) > keep:  # ties with the last to the smaller id
                limit = d[pick].max()
                under = np.flatnonzero(d < limit)
                tied = np.flatnonzero(d == limit)
                pick = np.append(under, tied[np.argsort(v[tied], kind="stable")][: keep - len(under)])
            found_v.append(v[pick])
            found_d.append(d[pick])
        q_ids = asks["query_id"].to_pylist()
        return pa.table({"query_id": pa.array([q_ids[r] for r in out], pa.int64()), "vec_ids": pa.array(found_v, pa.list_(pa.int64())), "near": pa.array(found_d, pa.list_(pa.float64()))})

    found = left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part")).applyInArrow(compare, "query_id long, vec_ids array<long>, near array<double>")

    def best(table: pa.Table) -> pa.Table:
        d, v = (table[c].combine_chunks().flatten().to_numpy() for c in ("near", "vec_ids"))
        q = table["query_id"][0].as_py()
        d, v = d[v != q], v[v != q]
        v = np.unique(v[np.lexsort((v, d))[:keep]])
        return pa.table({"query_id": pa.array([q] * len(v), pa.int64()), "vec_id": pa.array(v)})

    picked = found.groupBy("query_id").applyInArrow(best, "query_id long, vec_id long")
    vectors_of = picked.join(known, "vec_id").select("query_id", "vec_id", "embedding", F.lit(False).alias("own"))
    both = vectors_of.unionByName(asked.select("query_id", F.col("query_id").alias("vec_id"), "embedding", F.lit(True).alias("own")))

    def rank(table: pa.Table) -> pa.Table:
        own = table["own"].combine_chunks().to_numpy(zero_copy_only=False)
        v = table["embedding"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        ids = table["vec_id"].to_numpy()
        q = min(x[own].tolist())
        d = distances(x[~own], np.array(q))
        order = np.lexsort((ids[~own], d))[:k]
        n = len(order)
        return pa.table({"query_id": pa.array([table["query_id"][0].as_py()] * n, pa.int64()), "rank": pa.array(np.arange(1, n + 1, dtype=np.int32)), "vec_id": pa.array(ids[~own][order]), "score": pa.array(d[order])})

    return both.groupBy("query_id").applyInArrow(rank, "query_id long, rank int, vec_id long, score double")
