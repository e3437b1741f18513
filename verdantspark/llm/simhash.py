"""SimHash near-duplicates: fingerprints, a pigeonring join of fingerprints, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, slices, text_buffer
from .components import connected_components
from .kernels import LOWER, NOT_SPACE, U64, mix, words

BITS = 64
#: Rows of a key that one task compares; a longer key is cut into blocks, which meet pair by pair.
BLOCK_ROWS = 50_000
#: What the rows that one task compares have in common.
KEYED = ("start", "key", "pair")
_LANES = U64(0x0101010101010101)


def bit_majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per run of 64-bit values (run r begins at first[r], every run has some): the bits set in over half of them.

    Bits are counted in byte lanes, eight at a time, over pieces of at most 255 values, so that no lane overflows.
    """
    n = len(h)
    lens = np.diff(np.append(first, n))
    pieces = -(-lens // 255)
    owner = np.concatenate([[0], np.cumsum(pieces)])
    at = (np.arange(owner[-1]) - np.repeat(owner[:-1], pieces)) * 255 + np.repeat(first, pieces)
    out = np.zeros(len(first), U64)
    for b in range(8):
        lanes = np.add.reduceat((h >> U64(b)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner[:-1], axis=0)
        set_ = (2 * counts > lens[:, None]).astype(U64)
        for byte in range(8):
            out |= set_[:, byte] << U64(8 * byte + b)
    return out


def hashed_shingles(texts: pa.Array, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of each run of k words joined by one space, text by text, repeats included; the texts that have some; and where
    each of these begins. Words are runs of other bytes than ASCII white space, A-Z lower-cased. Fewer words: the whole
    sequence; none (or null): no shingle."""
    from xxhash import xxh64_intdigest

    buf, offsets = text_buffer(texts)
    starts, ends, row = words(buf, offsets, NOT_SPACE)
    counts = np.diff(row)
    some = np.flatnonzero(counts)
    if not len(some):
        return np.zeros(0, U64), some, some
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.full(at[-1], 0x20, np.uint8)
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    flat[place + np.repeat(at[:-1], lens)] = LOWER[buf[place + np.repeat(starts, lens)]]
    n = np.maximum(counts[some] - k + 1, 1)
    first = np.cumsum(n) - n
    w = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(row[:-1][some], n)
    last = np.minimum(w + k, np.repeat(row[1:][some], n))
    data = memoryview(flat.tobytes())
    h = np.fromiter((xxh64_intdigest(data[a:b], seed) for a, b in zip(at[w].tolist(), (at[last] - 1).tolist(), strict=True)), U64, len(w))
    return h, some, first


def shingle_fingerprints(texts: pa.Array, k: int, seed: int = 42) -> np.ndarray:
    """The SimHash of each text, from its hashed_shingles; zero for a text without any."""
    h, some, first = hashed_shingles(texts, k, seed)
    out = np.zeros(len(texts), U64)
    if len(some):
        out[some] = bit_majority(h, first)
    return out


def shingle_hashes(texts: pa.Array, k: int, seed: int = 42) -> list[np.ndarray]:
    """The hashed_shingles of each text, sorted, without repeats."""
    h, some, first = hashed_shingles(texts, k, seed)
    out = [h[:0]] * len(texts)
    for i, part in zip(some.tolist(), np.split(h, first[1:]) if len(some) else [], strict=True):
        out[i] = np.unique(part)
    return out


def set_fingerprints(texts: pa.Array, k: int, parts: int, seed: int = 42) -> np.ndarray:
    """Per text, `parts` columns of 64 bits, SimHashes of its set of shingles, each from hashes that are mixed anew, and the set's
    own hash. Repeats don't count; without shingles, the bits are zero."""
    from xxhash import xxh64_intdigest

    sets = shingle_hashes(texts, k, seed)
    out = np.zeros((parts + 1, len(sets)), U64)
    size = np.array([len(x) for x in sets], np.int64)
    some = np.flatnonzero(size)
    if len(some):
        h, first = np.concatenate(sets), np.cumsum(size[some]) - size[some]
        for part in range(parts):
            out[part, some] = bit_majority(mix(h ^ U64(part * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if part else h, first)
    out[parts] = [xxh64_intdigest(x.tobytes(), seed) for x in sets]
    return out.T


def fingerprints(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), in the partitions of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = shingle_fingerprints(part.column("text"), k, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def segments(parts: int) -> list[tuple[int, int]]:
    """Offset and width of `parts` consecutive runs of the 64 bits, as even as possible."""
    edges = [round(BITS * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rotated(fp, at: int):
    """The bits from `at` on, then those before."""
    return F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, BITS - at)) if at else fp


def chain_links(key: np.ndarray, turned: np.ndarray, budget: list[tuple[np.uint64, int]], distance: int, dense: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with one key whose values link: rows are sorted by key; `turned` are fingerprints, each turned so
    that its chain begins at bit 0; budget has, per chain length, the mask of the chain and the differing bits it may have.

    Runs of up to `dense` rows are compared in full, all runs at a time. In a longer run, a search from each row in turn
    compares, by the same budgets, what has been reached with what has not, so that it gives a spanning forest and stops as
    soon as all hangs together; it never holds all pairs.
    """
    n = len(key)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    run = np.cumsum(new) - 1
    left, right = [], []
    short = size[run] <= dense
    for lag in range(1, min(dense, int(size.max())) if n else 1):
        i = np.flatnonzero(short[:-lag] & (run[:-lag] == run[lag:]))
        if not len(i):
            break
        x = turned[i] ^ turned[i + lag]
        for mask, most in budget:
            keep = np.bitwise_count(x & mask) <= most
            i, x = i[keep], x[keep]
        keep = np.bitwise_count(x) <= distance
        left.append(i[keep])
        right.append(i[keep] + lag)
    for r in np.flatnonzero(size > dense):
        rows = np.arange(first[r], first[r] + size[r])
        while len(rows) > 1:
            todo, rows = [rows[0]], rows[1:]
            while todo and len(rows):
                at = todo.pop()
                x = turned[rows] ^ turned[at]
                near = np.bitwise_count(x) <= distance
                for mask, most in budget:
                    near &= np.bitwise_count(x & mask) <= most
                if near.any():
                    got = rows[near]
                    rows = rows[~near]
                    left.append(np.full(len(got), at))
                    right.append(got)
                    todo += got.tolist()
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def by_key(links, names: tuple[str, ...]):
    """A function of batches sorted by the columns `names` that calls `links` with whole keys only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # the last key of a batch may go on in the next
            if batch.num_rows:
                before, last = last, tuple(batch[c][-1].as_py() for c in names)
                first_of_last = int(np.argmax(np.logical_and.reduce([batch[c].to_numpy() == x for c, x in zip(names, last, strict=True)])))
                if first_of_last or last != before:
                    held.append(batch.slice(0, first_of_last))
                    yield from links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(first_of_last))
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def in_blocks(rows: DataFrame, ident: str) -> DataFrame:
    """rows (start, key, ident, ...) with a column `pair`: zero, or, for a key of more than BLOCK_ROWS rows, each pair of the
    key's blocks that the row takes part in. Any two rows of a key meet in a pair, which has two blocks at most.

    Keys are counted on a 64th of the idents, picked by hash; where a key is cut changes the tasks, not which rows meet.
    """
    sampled = rows.filter(F.pmod(F.xxhash64(ident), F.lit(64)) == 0).groupBy("start", "key").count().filter(F.col("count") * 64 > BLOCK_ROWS)
    hot = cut(sampled.select("start", "key", F.ceil(F.col("count") * 64 / BLOCK_ROWS).alias("n")), "hot-keys")
    own = F.pmod(F.xxhash64(ident, F.lit(1)), F.col("n"))
    meets = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: F.least(x, own) * (1 << 31) + F.greatest(x, own)))
    return rows.join(hot, ["start", "key"], "left").withColumn("pair", F.explode(meets)).drop("n")


def fingerprint_links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between different fingerprints, enough to connect every two that differ in at most `distance` bits.

    The pigeonring: of distance + 1 segments on a ring, there is one from which every chain of l segments differs in at
    most l * distance / (distance + 1) bits, rounded down. So the first segment is equal, and the second differs in one bit
    at most, hence is equal in its lower or upper half. Each fingerprint goes to one key per start and half: the equal
    segment with the equal half. Rows of a key are checked along the chain, then in full. A key has 19 bits or more, and
    fingerprints here are distinct, so copies of one document don't add up in it; a key that has very many rows all the same is
    cut into blocks that meet pair by pair (see in_blocks).
    """
    ring = segments(distance + 1)
    fp = F.col("fp")
    keys = []
    for s, (at, width) in enumerate(ring):
        turned = rotated(fp, at)
        after = ring[(s + 1) % len(ring)][1]
        low = after // 2
        for half, (a, w) in enumerate(((width, low), (width + low, after - low))):
            exact = turned.bitwiseAND(F.lit((1 << width) - 1))
            part = F.shiftrightunsigned(turned, a).bitwiseAND(F.lit((1 << w) - 1))
            keys.append(F.struct(F.lit(2 * s + half).cast("long").alias("start"), F.shiftleft(exact, 32).bitwiseOR(part).alias("key")))
    chains = []
    for s in range(len(ring)):
        total, budget = 0, []
        for length in range(1, len(ring)):
            total += ring[(s + length - 1) % len(ring)][1]
            budget.append((U64((1 << total) - 1), length * distance // (distance + 1)))
        chains.append(budget)

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        start, key, pair, values = (table[c].to_numpy() for c in ("start", "key", "pair", "fp"))
        run = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])) if len(key) else key
        for k in np.unique(start).tolist():
            rows = np.flatnonzero(start == k)
            at = ring[k // 2][0]
            u = values[rows].view(U64)
            turned = (u >> U64(at)) | (u << U64(BITS - at)) if at else u
            a, b = chain_links(run[rows], turned, chains[k // 2], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(values[rows[a]]), pa.array(values[rows[b]])], names=["a", "b"])

    rows = in_blocks(classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.start", "k.key", "fp"), "fp")
    return rows.repartition(*KEYED).sortWithinPartitions(*KEYED, "fp").mapInArrow(by_key(links, KEYED), "a long, b long").distinct()


def simhash_components(docs: DataFrame, k: int = 5, distance: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every document.

    Fingerprints link at `distance` or fewer differing bits. Copies meet in one class per fingerprint before anything is
    compared. Null or wordless texts have fingerprint zero and link like any other; a null doc_id takes part, but is never a
    component_id unless a component has no other; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, k, seed), "fingerprints", narrow=True)
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comps = connected_components(fingerprint_links(classes.select("fp"), distance))
    linked = cut(classes.join(comps.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    of = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Segments of a chain that are checked one by one.
CHAIN = 8
#: Segments of a 64-bit part of a wide fingerprint. 16 bits: a key has a 65,536th of the documents by chance.
SEGMENTS = 4
#: Share of pairs at the threshold that may have no equal segment.
MISSED = 0.003
#: Rows of a key that are compared all with all; more are searched, with the same pairs in the end. See chain_groups.
COMPARED = 4096
#: Texts of a block of a candidate group.
BLOCK_TEXTS = 512


def differing(similarity: float) -> float:
    """Share of bits in which SimHashes of a pair differ. Jaccard similarity s of sets of one size is the cosine 2 s / (1 + s); each
    bit differs with the angle's share of a half turn."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def ring_of(similarity: float) -> tuple[int, int]:
    """Segments of a 64-bit part, and parts of a wide fingerprint: as many as it takes that a pair of the similarity has an equal
    segment but for MISSED of all pairs. They don't depend on the number of documents, so that the same pairs are candidates
    in tables of every size; keys that get long are cut into blocks (see in_blocks)."""
    equal = (1 - differing(similarity)) ** (BITS // SEGMENTS)
    return SEGMENTS, 8 if equal == 1 else max(8, int(np.ceil(np.log(MISSED) / np.log1p(-equal) / SEGMENTS)))


def bits_for(similarity: float, bits: int, deviations: float = 3.0) -> int:
    """Differing bits of wide fingerprints beyond which a pair is not a candidate: so many standard deviations above the expected
    number."""
    share = differing(similarity)
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position connected with each of n positions by edges (a, b)."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        np.minimum.at(least, root, least)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def chain_groups(group: np.ndarray, v: np.ndarray, chain: list[tuple[int, np.uint64, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that connect all those pairs of one run of `group` whose chains keep within their budgets.

    v has the words that a chain reads, a row each; chain has, per segment, its word, its mask and the bits that may differ so
    far. Short runs are compared in full, all runs at a time. A long one is searched from row to row: what has been reached
    hangs together already and isn't compared again. Which rows hang together is the same either way.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    left_in_run = np.repeat(first + size, size) - np.arange(len(group))
    compared = np.repeat(size <= COMPARED, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def within(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(len(i), np.int64)
        for word, mask, most in chain:
            total += np.bitwise_count((v[i, word] ^ v[j, word]) & mask)
            ok = total <= most
            i, j, total = i[ok], j[ok], total[ok]
            if not len(i):
                break
        return i, j

    for lag in range(1, int(size[size <= COMPARED].max(initial=0))):
        i = np.flatnonzero((left_in_run > lag) & compared)
        if not len(i):
            break
        i, j = within(i, i + lag)
        left.append(i)
        right.append(j)
    for r in np.flatnonzero(size > COMPARED):
        rest = np.arange(first[r], first[r] + size[r])
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                at = todo.pop()
                near, _ = within(rest, np.full(len(rest), at))
                if len(near):
                    left.append(np.full(len(near), at))
                    right.append(near)
                    todo += near.tolist()
                    rest = np.setdiff1d(rest, near, assume_unique=True)
    return np.concatenate(left), np.concatenate(right)


def wide_links(classes: DataFrame, per: int, parts: int, at_most: int) -> DataFrame:
    """Edges (a, b) between ids of wide fingerprints (id, f0, f1, ...), enough to connect all candidate pairs.

    Candidates share one of the ring's segments exactly, and from it on chains of up to CHAIN segments keep within their share
    of at_most differing bits: the pigeonring's condition, with the equal segment as the chain's start. A pair is missed only
    if this fails for each of its equal segments, of which near copies have several; README has the measured recall. Rows carry
    only the words that their chain reads. A key of very many rows is cut into blocks (see in_blocks). Candidates only say what
    similar_groups compares.
    """
    ring = [(p, at, width) for p in range(parts) for at, width in segments(per)]
    span = 1 + -(-(CHAIN - 1) // per)
    words = [f"w{i}" for i in range(span)]
    keys, chains = [], []
    for s, (p, at, width) in enumerate(ring):
        own = [F.col(f"f{(p + i) % parts}").alias(w) for i, w in enumerate(words)]
        keys.append(F.struct(F.lit(s).cast("long").alias("start"), F.shiftrightunsigned(F.col(f"f{p}"), at).bitwiseAND(F.lit((1 << width) - 1)).alias("key"), *own))
        chain = []
        for step in range(1, CHAIN):
            q, b, w = ring[(s + step) % len(ring)]
            chain.append(((q - p) % parts, U64(((1 << w) - 1) << b), (step + 1) * at_most // len(ring)))
        chains.append(chain)
    rows = classes.select("id", F.explode(F.array(*keys)).alias("k")).select("k.*", "id")
    rows = in_blocks(rows, "id")

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        start, key, ids, pair = (table[c].to_numpy() for c in ("start", "key", "id", "pair"))
        if not len(ids):
            return
        values = np.column_stack([table[c].to_numpy().view(U64) for c in words])
        run = np.cumsum(np.concatenate([[0], (start[1:] != start[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
        left, right = [], []
        for s in np.unique(start).tolist():
            at = np.flatnonzero(start == s)
            a, b = chain_groups(run[at], values[at], chains[s])
            left.append(at[a])
            right.append(at[b])
        root = roots(len(ids), np.concatenate(left), np.concatenate(right))
        x, y = ids, ids[root]
        apart = x != y
        if apart.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[apart]), pa.array(np.maximum(x, y)[apart])], names=["a", "b"])

    return rows.repartition(*KEYED).sortWithinPartitions(*KEYED, "id").mapInArrow(by_key(links, KEYED), "a long, b long").distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets without repeats; empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def block_links(ids: np.ndarray, sets: list[np.ndarray], linked: np.ndarray, asks: np.ndarray, first: int, similarity: float) -> list[tuple[int, int]]:
    """Edges between ids that connect all pairs, of a row that asks and one that doesn't, whose sets have the similarity.

    Rows that are linked hang on `first` already; the others occur on both sides, and the smaller id asks. Each asking row is
    compared, by exact counts, with the rows of fitting size that don't hang together with it yet.
    """
    names, node = np.unique(np.append(np.where(linked, first, ids), first), return_inverse=True)
    node = node[:-1]
    group = np.arange(len(names))
    size = np.array([len(x) for x in sets], np.int64)
    others = np.flatnonzero(~asks)
    others = others[np.argsort(size[others], kind="stable")]
    n = size[others]
    flat = np.concatenate([np.zeros(0, U64), *(sets[i] for i in others)])
    known, flat = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    mark, out = np.zeros(len(known), bool), []
    for i in np.flatnonzero(asks).tolist():
        low, high = np.searchsorted(n, (np.ceil(similarity * size[i] - 1e-9), np.floor(size[i] / similarity + 1e-9) + 0.5))
        some = np.arange(low, high)
        some = some[(group[node[others[some]]] != group[node[i]]) & (linked[others[some]] | (ids[others[some]] > ids[i]))]
        if not len(some) or not len(known):
            continue
        place = np.searchsorted(known, sets[i])
        own = place[known[np.minimum(place, len(known) - 1)] == sets[i]]
        mark[own] = True
        m = n[some]
        ends = np.cumsum(m)
        hits = np.concatenate([[0], np.cumsum(mark[flat[np.arange(m.sum()) + np.repeat(at[some] - (ends - m), m)]])])
        mark[own] = False
        shared = hits[ends] - hits[ends - m]
        for j in others[some[shared >= similarity * (m + size[i] - shared)]].tolist():
            if group[node[i]] != group[node[j]]:
                out.append((int(names[node[i]]), int(names[node[j]])))
                group[group == group[node[j]]] = group[node[i]]
    return out


def similar_groups(candidates: DataFrame, docs: DataFrame, k: int, similarity: float, seed: int = 42) -> DataFrame:
    """node and component, the smallest id connected with it by pairs whose sets of k-word shingles have a Jaccard similarity of
    at least `similarity`, for candidates (node, component). Every pair of a candidate component counts.

    First each set is compared with that of its component's first document, by an equi-join. Rows that aren't as similar are
    then compared with all rows of their component, in blocks of BLOCK_TEXTS rows that meet pair by pair in a task each, so
    that no task holds a component. Only enough edges to connect what is similar leave a task.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [h.tobytes() for h in shingle_hashes(part.column("text"), k, seed)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(out, pa.binary())], names=["key", "id", "shingles"])

    def values(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        return [np.frombuffer(x, U64) if x else np.zeros(0, U64) for x in column.to_pylist()]

    def against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(x, y) >= similarity for x, y in zip(values(b["shingles"]), values(b["other"]), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["id"], pa.array(near, pa.bool_())], names=["key", "id", "linked"])

    def check(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, pair, ids = (table[c].to_numpy() for c in ("key", "pair", "id"))
        linked, asks = (np.array(table[c].to_pylist(), bool) for c in ("linked", "asks"))
        found, out = values(table["shingles"]), []
        edges = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))), len(key)) if len(key) else []
        for a, b in zip(edges, edges[1:], strict=False):
            out += block_links(ids[a:b], found[a:b], linked[a:b], asks[a:b], int(key[a]), similarity)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    of = candidates.select(F.col("node").alias("doc_id"), F.col("component").alias("key"))
    known = documents(docs).join(of, "doc_id").select("key", "doc_id", "text")
    sets = cut(known.mapInArrow(sets_of, "key long, id long, shingles binary"), "sets")
    first = sets.filter("id = key").select("key", F.col("shingles").alias("other"))
    near = sets.join(first, "key").mapInArrow(against_first, "key long, id long, linked boolean")
    judged = cut(near.groupBy("key", "id").agg(F.max("linked").alias("linked")), "judged")
    counts = judged.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("loose")).filter("loose > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_TEXTS)
    open_ = judged.join(counts.select("key", blocks("n").alias("nr"), blocks("loose").alias("nl")), "key")
    rows = sets.join(open_, ["key", "id"])
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = rows.filter(~F.col("linked")).withColumn("l", own("nl")).withColumn("r", up_to("nr")).withColumn("asks", F.lit(True))
    right = rows.withColumn("r", own("nr")).withColumn("l", up_to("nl")).withColumn("asks", F.lit(False))
    met = left.unionByName(right).select("key", (F.col("l") * (1 << 31) + F.col("r")).alias("pair"), "id", "linked", "asks", "shingles")
    more = met.repartition("key", "pair").sortWithinPartitions("key", "pair", "id").mapInArrow(by_key(check, ("key", "pair")), "a long, b long")
    return connected_components(judged.filter("linked and id > key").select(F.col("id").alias("a"), F.col("key").alias("b")).union(more))


def near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id and component_id (its group's smallest) of documents that aren't the first of their group of near copies.

    Wide fingerprints are SimHashes of the sets of shingles, as long as the similarity takes (see ring_of); documents with one
    set meet before anything is compared. Fingerprints, also equal ones, only say which documents are candidates;
    those link whose exact similarity is enough (see similar_groups). Texts without a word are alike. Rows without an id take
    no part; rows that repeat an id are one document; an empty table gives no rows.
    """
    docs = docs.filter("doc_id is not null")
    per, parts = ring_of(similarity)
    columns = [f"f{p}" for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = set_fingerprints(part.column("text"), k, parts, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in fp.T)], names=["doc_id", *columns, "shingles"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*columns, "shingles"))
    same_set = ["shingles", *columns[:2]]  # 192 bits
    prints = cut(documents(docs).mapInArrow(run, schema), "fingerprints", narrow=True)
    texts = cut(prints.groupBy(*same_set).agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in columns[2:])), "texts")
    classes = cut(texts.groupBy(*columns).agg(F.min("id").alias("id")), "classes")
    found = wide_links(classes, per, parts, bits_for(similarity, BITS * parts))
    same = texts.join(classes.withColumnRenamed("id", "b"), columns).select(F.col("id").alias("a"), "b").filter("a > b")
    candidates = cut(connected_components(found.union(same)), "candidates")
    comps = similar_groups(candidates, docs, k, similarity, seed).withColumnRenamed("node", "id")
    of = texts.select("id", *same_set).join(comps, "id", "left").select(*same_set, F.coalesce("component", "id").alias("component_id"))
    return prints.select("doc_id", *same_set).join(of, same_set).filter("component_id < doc_id").select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The columns and rows of docs without those that near_copies finds. Rows that repeat a doc_id stay or go together; rows
    without one stay. Which go is a written table of ids, so that Spark knows its size before it plans the join."""
    gone = cut(near_copies(docs, k, similarity).select("doc_id").distinct(), "near-copies", narrow=True)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
