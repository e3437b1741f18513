"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, calibrated votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, slices

#: Labelled rows of each class that are learnt from, at most; those with the smallest hashes of their ids.
LABELLED = 30_000
#: Of these, examples of each class in the index, at most.
EXAMPLES = 800
#: Least chi-square statistic of a term that goes with the label, least ratio of its shares in the classes, and the weight of all
#: other terms beside these.
CHI_SQUARE, RATIO, OTHERS = 20.0, 2.0, 0.05
#: Examples of a block of the index; neighbours that vote; weight of the prior among them; rows that calibrate.
BLOCK, NEIGHBOURS, PRIOR, CALIBRATED = 64, 25, 0.5, 1_000

WORD = re.compile(r"[^\W_]+")


def word_terms(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and its first four and five letters, which words of one stem share."""
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) > 5 else (word, f"{word[:4]}*") if len(word) > 4 else (word,)


class TermsOf(dict):
    """The terms of each word, kept for the words seen first."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        got = word_terms(word)
        if len(self) < 200_000:
            self[word] = got
        return got


class Vocabulary:
    """Numbers of the known terms of a text; most words have none, so words and stems are looked up as they are, and stems only
    where the vocabulary has some."""

    def __init__(self, terms: list[str]) -> None:
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*")}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a whole text, ascending, and how often each occurs. They are those of word_terms."""
        bag = Counter(WORD.findall((text or "").lower()))
        word, stem = self.words.get, self.stems.get
        terms = [word(w, -1) for w in bag]
        times = list(bag.values())
        if self.stems:
            long = [(w, n) for w, n in bag.items() if len(w) > 4]
            terms += [stem(w[:4], -1) for w, _ in long]
            times += [n for _, n in long]
            long = [(w, n) for w, n in long if len(w) > 5]
            terms += [stem(w[:5], -1) for w, _ in long]
            times += [n for _, n in long]
        at, n = np.array(terms, np.int64), np.array(times, np.int64)
        some = at >= 0
        known, which = np.unique(at[some], return_inverse=True)
        return known, np.bincount(which, n[some], len(known))


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range of each."""
    n = end - begin
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + (begin - np.cumsum(n) + n)[owner], owner


class Index:
    """Examples as unit TF-IDF vectors: per term, its postings in order of example, and per block of examples the largest
    weight, so that a block's best possible cosine is known before its postings are read."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list) -> None:
        self.idf, self.labels, self.ids = idf, labels, ids
        vectors = [self.vector(t, n) for t, n in rows]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        example = np.repeat(np.arange(len(rows)), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        self.blocks = -(-len(rows) // BLOCK)
        # postings are cut by term and block: per cut, its block, where it begins, and its largest weight; per term, its cuts
        key = term[order] * max(self.blocks, 1) + self.example // BLOCK
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        self.block = (key[begin] % max(self.blocks, 1)).astype(np.int32)
        self.begin = np.append(begin, len(key))
        self.most = np.maximum.reduceat(self.weight, begin) if len(key) else self.weight
        self.first = np.searchsorted(key[begin] // max(self.blocks, 1), np.arange(len(idf) + 1))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        size = np.sqrt((w * w).sum())
        return (terms, w / size) if size else (terms[:0], w[:0])

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine, and the cosines; ties to the earlier example. Blocks with the largest bounds are read
        first, then those whose bound isn't under the k-th cosine found."""
        terms, w = self.vector(terms, counts)
        if not len(terms) or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        cuts, owner = ranges(self.first[terms], self.first[terms + 1])
        if not len(cuts):
            return np.zeros(0, np.int64), np.zeros(0)
        share, block = w[owner], self.block[cuts]
        bound = np.bincount(block, share * self.most[cuts], self.blocks)
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        read, todo = np.zeros(self.blocks, bool), order[:4]
        while len(todo):
            now = np.zeros(self.blocks, bool)
            now[todo] = True
            some = now[block]
            at, of = ranges(self.begin[cuts[some]], self.begin[cuts[some] + 1])
            score = np.bincount(self.example[at], share[some][of] * self.weight[at], len(self.labels))
            new = np.flatnonzero(score)
            new = new[new != but]
            ids, scores = np.concatenate([ids, new]), np.concatenate([scores, score[new]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            read |= now
            least = scores[k - 1] if len(ids) >= k else 0.0
            todo = np.flatnonzero(~read & (bound > 0) & (bound + 1e-12 >= least))
        return ids, scores


class Votes:
    """Distance-weighted votes of the nearest examples, and Platt's calibration of them."""

    def __init__(self, index: Index, weights: tuple[float, float], none: float, prior: float) -> None:
        self.index, self.weights, self.none, self.prior = index, weights, none, prior
        self.slope, self.shift = 1.0, 0.0

    def share(self, terms: np.ndarray, counts: np.ndarray, but: int = -1) -> tuple[float, np.ndarray]:
        near, cosine = self.index.nearest(terms, counts, NEIGHBOURS, but)
        if not len(near):
            return self.none, near
        w = cosine / (1.05 - np.minimum(cosine, 1)) * np.where(self.index.labels[near] == 1, self.weights[1], self.weights[0])
        w /= max(self.weights)
        return float((w[self.index.labels[near] == 1].sum() + PRIOR * self.prior) / (w.sum() + PRIOR)), near

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> None:
        """Platt's logistic curve over the votes' log-odds, by Newton's method, classes in their true proportion."""
        x = logit(shares)
        w = np.where(labels == 1, self.weights[1], self.weights[0])
        w = w / w.sum() * len(w)
        up, down = w[labels == 1].sum(), w[labels == 0].sum()
        target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(w * (p - target) * x).sum() + 1e-3 * a, (w * (p - target)).sum()])
            v = w * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
            move = np.linalg.solve(h, g)
            size = np.abs(move).max()
            move *= min(1, 1 / max(size, 1e-12))
            a, b = a - move[0], b - move[1]
            if size < 1e-6:
                break
        self.slope, self.shift = max(float(a), 1e-3), float(b)

    def score(self, share: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * logit(share) + self.shift))))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def arrays(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    items = sorted(counts.items())
    return np.array([i for i, _ in items], np.int64), np.array([n for _, n in items], float)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never seen: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (labelled doc_ids, nearest first) and terms that go with the label, for
    every document.

    Learns from labels.toxic of rows that aren't held out: up to LABELLED of each class, the bound that lets them be sent to
    all tasks, and of these up to EXAMPLES in the index. Terms are all words of the examples, and those words and stems whose
    presence goes with the label; document frequencies are counted over all documents. Weights are TF-IDF, times OTHERS for
    terms that don't go with the label. Each document's whole text is searched, by exact cosine over all terms, for its
    NEIGHBOURS nearest, whose votes count by cosine and by the true share of their class, and are calibrated on examples judged
    without themselves. A text without known terms, such as a null or empty one, gets the share of toxic labels. Repeated ids
    have their largest label; repeated rows are scored each, alike; without labels of both classes every score is the share of
    toxic labels; an empty table gives no rows. Counting and searching take time in proportion to a text's different words.
    """
    docs = documents(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED) for c in (0, 1)]
    labelled = docs.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known = (Counter(), Counter()), TermsOf()

        def out():
            terms = list(n[0] | n[1])
            return pa.RecordBatch.from_pydict({"term": terms, "clean": pa.array([n[0][t] for t in terms], pa.int64()), "toxic": pa.array([n[1][t] for t in terms], pa.int64())})

        for batch in batches:
            for text, c in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                n[c].update(set().union(*map(known.__getitem__, set(WORD.findall((text or "").lower())))))
            if len(n[0]) + len(n[1]) > 300_000:
                yield out()
                n[0].clear()
                n[1].clear()
        if n[0] or n[1]:
            yield out()

    counted = labelled.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c0"), F.sum("toxic").alias("c1"))
    classes = labelled.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    n0, n1 = int(classes[0] or 0), int(classes[1] or 0)
    c0, c1 = F.col("c0").cast("double"), F.col("c1").cast("double")
    strong, chosen, rows = set(), [], []
    if n0 and n1:
        chi = (n0 + n1) * F.pow(c1 * (n0 - c0) - c0 * (n1 - c1), 2) / (F.lit(float(n0)) * n1 * (c0 + c1) * (n0 + n1 - c0 - c1))
        ratio = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))
        near = counted.filter((c0 + c1 >= 3) & (c0 + c1 < n0 + n1)).filter((chi >= CHI_SQUARE) & ((ratio >= RATIO) | (ratio <= 1 / RATIO)))
        strong = {r.term for r in near.select("term").collect()}

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = []
                for text in batch["text"].to_pylist():
                    bag: Counter = Counter()
                    for w, n in Counter(WORD.findall((text or "").lower())).items():
                        for t in word_terms(w):
                            if t == w or t in strong:
                                bag[t] += n
                    got.append(bag)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array([list(b) for b in got], pa.list_(pa.string())), pa.array([list(b.values()) for b in got], pa.list_(pa.float64()))], names=["doc_id", "toxic", "terms", "counts"])

        # ids are picked without their texts, which would meet in one task
        ids = [labelled.filter(F.col("toxic") == c).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for c in (0, 1)]
        rows = [r for r in labelled.join(F.broadcast(ids[0].union(ids[1])), "doc_id", "left_semi").mapInArrow(bags, "doc_id long, toxic int, terms array<string>, counts array<double>").collect() if r.terms]
        chosen = sorted(strong.union(*(r.terms for r in rows)))

    def count_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(chosen)
        for batch in batches:
            for part in slices(batch):
                got = [vocabulary.counts(text) for text in part["text"].to_pylist()]
                at = pa.array(np.cumsum([0, *(len(t) for t, _ in got)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *lists], names=["doc_id", "terms", "counts"])

    # texts are read once: the document frequencies and the search both need the counts of their terms
    bags_of = cut(docs.mapInArrow(count_known, "doc_id long, terms array<int>, counts array<int>"), "bags")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(chosen) + 1, np.int64)
        for batch in batches:
            n[:-1] += np.bincount(batch["terms"].flatten().to_numpy(), minlength=len(chosen))
            n[-1] += batch.num_rows
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some), "n": pa.array(n[some])})

    found = bags_of.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow() if chosen else None
    df = np.zeros(len(chosen) + 1)
    if found is not None:
        df[found["term"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    model = None
    labels_of = np.array([r.toxic for r in rows], np.int64)
    if len(set(labels_of.tolist())) == 2:
        number = {t: i for i, t in enumerate(chosen)}
        idf = idf * np.array([1.0 if t in strong else OTHERS for t in chosen])
        found = [arrays(Counter({number[t]: n for t, n in zip(r.terms, r.counts, strict=True)})) for r in rows]
        heaviest = [int(t[np.argmax(idf[t])]) for t, _ in found]
        order = sorted(range(len(rows)), key=lambda i: (heaviest[i], len(found[i][0]), rows[i].doc_id))  # alike examples share blocks
        found, labels_of = [found[i] for i in order], labels_of[order]
        own = [sizes[c] / int((labels_of == c).sum()) for c in (0, 1)]
        model = Votes(Index(idf, found, labels_of, [rows[i].doc_id for i in order]), tuple(own), prior, prior)
        pick = np.unique(np.linspace(0, len(rows) - 1, min(CALIBRATED, len(rows))).astype(int))
        shares = np.array([model.share(*found[i], i)[0] for i in pick.tolist()])
        if len(set(labels_of[pick].tolist())) == 2:
            model.calibrate(shares, labels_of[pick])
    is_strong = np.array([t in strong for t in chosen], bool)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = sent.value
        done: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            if votes is None:
                scores, near, terms = [prior] * batch.num_rows, [[]] * batch.num_rows, [[]] * batch.num_rows
            else:
                scores, near, terms = [], [], []
                at = batch["terms"].offsets.to_numpy()
                flat = [batch[c].flatten().to_numpy() for c in ("terms", "counts")]
                for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
                    t, n = flat[0][a:b], flat[1][a:b]
                    key = t.tobytes() + n.tobytes()
                    if key not in done:
                        if len(done) > 50_000:
                            done.clear()
                        share, found = votes.share(t, n)
                        done[key] = votes.score(share), [votes.index.ids[i] for i in found.tolist()]
                    scores.append(done[key][0])
                    near.append(done[key][1])
                    terms.append([chosen[i] for i in t[is_strong[t]].tolist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "neighbours", "terms"])

    judged = bags_of.mapInArrow(judge, "doc_id long, score double, predicted int, neighbours array<long>, terms array<string>")
    return judged.select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours", "terms")
