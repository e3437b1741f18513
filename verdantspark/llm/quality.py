"""Document quality by hierarchical empirical Bayes: a classifier's evidence with posteriors of hosts and their paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, slices, small_batches, text_buffer
from .kernels import NOT_SPACE, U64, mix, word_hashes, words

#: Labelled rows of each class that the classifier is fitted on, at most; those with the smallest hashes of their ids.
LABELLED = 20_000
#: Least posterior probability of good quality that a document is kept with.
KEEP = 0.5
#: Pseudo-documents that a prior counts for at most, where sites hardly differ.
STRONGEST = 1_000.0
FEATURES = ("log_words", "upper", "symbol", "pipe", "exclaim", "digit", "other", "punctuation", "word_length", "distinct", "repeated", "line_ends")

_KIND = np.full(256, 7, np.int64)  # by byte: lower, upper, digit, white space, symbol, pipe, exclamation mark, punctuation, other
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[[0x20, 0x09, 0x0D]] = 0, 1, 2, 3
_KIND[[ord(c) for c in "#$%&*+=<>@^_~`{}[]\\/"]], _KIND[ord("|")], _KIND[ord("!")], _KIND[0x80:], _KIND[0x0A] = 4, 5, 6, 8, 9


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; a null text is as an empty one."""
    buf, offsets = text_buffer(texts)
    rows = len(texts)
    size = np.diff(offsets)
    n = np.bincount(np.repeat(np.arange(rows), size) * 10 + _KIND[buf], minlength=10 * rows).reshape(rows, 10).astype(float)
    starts, ends, row = words(buf, offsets, NOT_SPACE)
    h = word_hashes(buf, starts, ends)
    count = np.diff(row)
    owner = np.repeat(np.arange(rows), count)
    _, first = np.unique(h ^ mix(owner.astype(U64) + U64(1)), return_index=True)
    distinct = np.bincount(owner[first], minlength=rows)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    letters = np.maximum(n[:, 0] + n[:, 1], 1)
    chars = np.maximum(size, 1)
    some = np.maximum(count, 1)
    return np.column_stack([
        np.log1p(count), n[:, 1] / letters, n[:, 4] / chars, n[:, 5] / chars, n[:, 6] / chars, n[:, 2] / chars, n[:, 8] / chars, n[:, 7] / chars,
        np.minimum(np.bincount(owner, ends - starts, rows) / some, 30), distinct / some, np.bincount(owner, again, rows) / some, n[:, 9] / some,
    ])


class Logistic:
    """Ridge-penalised logistic regression on standardised features and their square roots, fitted by Newton's method."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Logistic:
        z = self._wide(x)
        self.mean, self.scale = z.mean(0), z.std(0) + 1e-9
        z = np.column_stack([np.ones(len(z)), (z - self.mean) / self.scale])
        beta = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            v = weight * np.maximum(p * (1 - p), 1e-9)
            move = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * beta)
            move *= min(1.0, 3.0 / max(np.abs(move).max(), 1e-12))
            beta += move
            if np.abs(move).max() < 1e-6:
                break
        self.beta = beta
        return self

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(x)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.beta[0] + ((self._wide(x) - self.mean) / self.scale) @ self.beta[1:], -12, 12)


def fit_classifier(docs: DataFrame, labels: DataFrame) -> tuple[Logistic | None, float]:
    """The classifier and the share of good labels. Labels are taken by their ids' hashes, LABELLED of each class at most, so
    that they can be sent to all tasks; without both classes there is no classifier."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED) for c in (0, 1)]
    labelled = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part["text"])
                yield pa.RecordBatch.from_arrays([part["quality"], pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])

    got = labelled.mapInArrow(measure, "quality int, x array<double>").toArrow()
    y = got["quality"].to_numpy()
    good = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if len(set(y.tolist())) < 2:
        return None, good
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    share = {c: sizes[c] / sum(sizes.values()) / np.mean(y == c) for c in (0, 1)}
    return Logistic().fit(x, y, np.where(y == 1, share[1], share[0])), good


def strength(means: str, counts: str, prior: float | str):
    """An aggregate: pseudo-documents of a Beta prior that fit how groups' means vary around it (method of moments)."""
    n, m, p = F.col(counts), F.col(means), F.col(prior) if isinstance(prior, str) else F.lit(prior)
    within = F.sum(p * (1 - p))
    between = F.sum(n * (m - p) * (m - p))
    size, groups = F.sum(n), F.count("*")
    excess = F.greatest((between - within) / F.greatest(size - groups, F.lit(1.0)), F.lit(1e-9))  # variance of true means
    return F.least(F.greatest(within / F.greatest(groups, F.lit(1)) / excess - 1, F.lit(1.0)), F.lit(STRONGEST))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP) -> DataFrame:
    """doc_id, evidence (the classifier's log-odds of good quality), host_posterior, path_posterior (expected quality of the
    document's host, and path in it, without the document's own share), posterior and keep, for every document.

    Sites are summed up in two grouped aggregations: paths, and hosts from their paths. A host's mean is shrunk toward the
    global one, a path's toward its host's, by Beta priors as strong as the sites' spread says, so that sparse sites have the
    prior and rich ones their own mean. The document's likelihood ratio times its path's odds gives the posterior. Sums are
    combined before the shuffle; only (doc_id, site, evidence) meets them, in an equi-join that adaptive execution splits for
    a hot host. Null hosts and paths are a site of their own; null or empty texts are judged by their features; repeated rows
    are judged each; without labels of both classes the evidence is the share of good labels; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = documents(docs, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    model, good = fit_classifier(rows, labels)
    base = float(np.log(good / (1 - good)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                e = sent.value.logit(features(part["text"])) if sent.value is not None else np.full(part.num_rows, base)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["host"], part["path"], pa.array(e)], names=["doc_id", "host", "path", "evidence"])

    judged = cut(rows.mapInArrow(judge, "doc_id long, host string, path string, evidence double"), "quality", narrow=True).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = judged.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mean = min(max((total[0] or 0) / max(total[1] or 0, 1), 1e-4), 1 - 1e-4)
    k_host = hosts.withColumn("m", F.col("hs") / F.col("hn")).agg(strength("m", "hn", mean)).first()[0] or STRONGEST
    sited = paths.join(hosts, "host").withColumn("host_mean", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    k_path = sited.withColumn("m", F.col("s") / F.col("n")).agg(strength("m", "n", "host_mean")).first()[0] or STRONGEST
    joined = judged.join(sited.select("host", "path", "s", "n", "hs", "hn"), ["host", "path"])
    host_posterior = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    path_posterior = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    out = joined.withColumn("host_posterior", F.least(F.greatest(host_posterior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    out = out.withColumn("path_posterior", F.least(F.greatest(path_posterior, F.lit(1e-6)), F.lit(1 - 1e-6)))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") - base + odds("path_posterior")))))
    return out.select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= keep).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: float = KEEP) -> DataFrame:
    """The columns and rows of docs without the rejected; rows without a doc_id stay."""
    gone = quality_scores(docs, labels, host, path, keep).filter(~F.col("keep")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
