"""Each corpus operator against a plain version, on texts with every odd case; and on empty tables."""

import hashlib
import random
import zlib

import plain_versions as brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdantspark.llm import ann, decontam, linededup, packing, quality, secrets, simhash, substring, token_files, toxicity
from verdantspark.llm.queries import tokenizer_path
from verdantspark.llm.tokens import WordEncoder


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


def test_encoder_is_the_library(encoder, rows):
    texts = [t for _, t in rows] + ["İstanbul ŉ²½x_y, don't <|endoftext|> 12.5%\x1c\x85a", "DON'T I'LL We'Re x²y ¼ª", "Ã©Ä --,,.. 'S", "é", "a" * 5000]
    assert encoder.encode(texts) == [encoder.whole(t or "") for t in texts]
    encoder.by_word = False
    assert encoder.encode(texts[:3]) == [encoder.whole(t or "") for t in texts[:3]]
    encoder.by_word = True


def test_packing(docs, rows, encoder):
    got = packing.pack_documents(docs, tokenizer_path(), keep_ids=True).toPandas()
    ids = {i: np.append(np.frombuffer(encoder.whole(t or ""), encoder.dtype), 2).astype("<u4") for i, t in rows}
    for i, own in got.sort_values("start").groupby("doc_id"):
        assert b"".join(bytes(x) for x in own.ids) == ids[i].tobytes()
        assert (own.doc_tokens == len(ids[i])).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert all(zlib.crc32(bytes(x)) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
    assert got.doc_id.nunique() == len(rows)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (seq.length.cumsum() - seq.length).tolist()
        total = seq.length.sum()
        assert total <= 4096 and (seq.padded_length == (total if total in packing.TIERS else 4096)).all()
    assert (got.groupby("sequence_id").length.sum() != got.groupby("sequence_id").padded_length.first()).sum() <= 1


def test_pack_keeps_all():
    rng = np.random.default_rng(5)
    for last in (False, True):
        pieces = [packing.Piece(i, 0, np.full(n, i, "<u2"), n) for i, n in enumerate(rng.integers(1, 9000, 60).tolist())]
        done, rest = packing.pack(pieces, packing.TIERS, last)
        assert all(sum(map(len, p)) == t for t, p in done)
        assert sum(map(len, pieces)) == sum(t for t, _ in done) + sum(map(len, rest))
        if last:
            assert sum(map(len, rest)) < packing.TIERS[-1]


def test_steps_balance():
    sizes = [4096] * 40 + [512] * 100 + [2048] * 7
    groups = packing.steps(sizes, 1 << 15)
    totals = [sum(s for s, g in zip(sizes, groups, strict=True) if g == k) for k in set(groups)]
    assert max(totals) - min(totals) <= 4096


def test_toxicity(spark, docs, labels, rows):
    bad = spark.createDataFrame([(1000 + i, f"you {'idiot' if i % 2 else 'kind person'} of number {i} stone river") for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(1000 + i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.toxicity(bad, marks).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.doc_id % 2).all() and got.score.between(0, 1).all()
    odd = toxicity.toxicity(docs, labels).toPandas()
    assert sorted(odd.doc_id) == [i for i, _ in rows] and odd.score.between(0, 1).all()
    none = toxicity.toxicity(docs, labels.filter("toxic = 0")).toPandas()
    assert (none.score == 0).all()


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    idf = rng.random(80) + 0.5
    sets = [np.unique(rng.integers(0, 80, rng.integers(1, 12))) for _ in range(700)]
    found = [(t, rng.integers(1, 4, len(t)).astype(float)) for t in sets]
    index = toxicity.Index(idf, found, np.zeros(700, int), list(range(700)))
    full = np.zeros((700, 80))
    for i, (t, n) in enumerate(found):
        a, w = index.vector(t, n)
        full[i, a] = w
    for t, n in found[:80]:
        a, w = index.vector(t, n)
        got, cosine = index.nearest(t, n, 20)
        assert np.allclose(cosine, np.sort(full[:, a] @ w)[::-1][: len(cosine)]) and np.allclose((full[:, a] @ w)[got], cosine)


def plain_lines(rows, m):
    lines = {i: (t or "").split("\n") for i, t in rows}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for k in range(len(lines[i]) - m + 1):
            run = tuple(lines[i][k : k + m])
            if run in seen:
                gone[i].update(range(k, k + m))
            seen.add(run)
    return {i: (len(v), len(gone[i]), "\n".join(x for k, x in enumerate(v) if k not in gone[i])) for i, v in lines.items()}


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(docs, rows, m):
    got = {r.doc_id: (r.kept_lines + r.gone_lines, r.gone_lines, r.kept_text) for r in linededup.without_copies(docs, m).collect()}
    assert got == plain_lines(rows, m)


def copied_runs(rows, m):
    """{(doc, line): (source doc, source line, lines)} of maximal copied runs."""
    lines = {i: (t or "").split("\n") for i, t in rows}
    first, source = {}, {}
    for i in sorted(lines):
        for k in range(len(lines[i]) - m + 1):
            run = tuple(lines[i][k : k + m])
            if first.setdefault(run, (i, k)) != (i, k):
                source[i, k] = first[run]
    out = {}
    for (i, k), (a, b) in source.items():
        if source.get((i, k - 1)) != (a, b - 1):
            n = 0
            while k + n < len(lines[i]) and b + n < len(lines[a]) and lines[i][k + n] == lines[a][b + n]:
                n += 1
            out[i, k] = (a, b, n)
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_copied_runs(docs, rows, m):
    got = {(r.d, r.i): (r.fd, r.fi, r.lines) for r in linededup.Suffixes(docs).copied_runs(m).collect()}
    assert got == copied_runs(rows, m) and len(got) > 2


def test_a_run_of_five_is_one_interval(spark):
    texts = ["a\nb\nc\nd\ne\nf", "x\nb\nc\nd\ne\nf\ny", "q\nq\nq", "u\nv"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.d, r.i): (r.fd, r.fi, r.lines) for r in linededup.Suffixes(df).copied_runs().collect()}
    assert got == {(1, 1): (0, 1, 5), (2, 1): (2, 0, 2)}
    assert {r.doc_id: r.lines for r in linededup.longest_repeats(df).collect()} == {1: 5, 2: 2}


def test_line_dedup_carries_any_column(spark):
    names = ["d", "t", "i", "r", "gone", "_gone", "kept_text", "Kept_Lines", "gone_lines", "n", "first"]
    df = spark.createDataFrame([(1, "a\nb", *range(11)), (2, "a\nb\nc", *range(11)), (2, "a\nb\nc", *range(11)), (None, None, *range(11))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = linededup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 9, r.text or "", r.gone) for r in out.collect()) == [(1, "a\nb", 4), (2, "c", 4), (2, "c", 4), (9, "", 4)]


def test_line_dedup_stage(docs, rows):
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    want = {i for i, (n, gone, _) in plain_lines(rows, 2).items() if n > gone}
    assert {r.doc_id for r in out.collect()} == want


def test_contamination(spark, docs, rows, monkeypatch):
    texts = dict(rows)
    items = [(1, " ".join(texts[10].split()[:30]).upper()), (2, "alpha beta"), (3, ""), (4, None), (5, "zzz yyy"), (6, texts[12]), (6, texts[13]), (None, "river stone")]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, [i for i in items if i[0] is not None])
    for block in (decontam.BLOCK_ITEMS, 2):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
        monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
        got = decontam.contamination(docs, df)
        got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got.collect()}
        assert got == want
    assert decontam.contamination(docs, df.filter("false")).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three"), (2, "three two one"), (3, "one a b c d e f two three"), (4, "two three")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "one two three")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontam.contamination(docs, items, slop=2).collect()}
    assert got == {1: ([], ["9"]), 2: ([], ["9"]), 3: ([], []), 4: ([], [])}


@pytest.mark.parametrize("shard_bytes", [50, 1 << 20])
def test_proximity_of_plain(spark, monkeypatch, shard_bytes):
    """Near items are those of the plain version, however the documents are dealt to shards."""
    rng = random.Random(11)
    words = "a b c d e f".split()
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for i in range(60)} | {60: None}
    items = {i: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for i in range(8)} | {8: None, 9: "", 10: "a nowhere b"}
    monkeypatch.setattr(decontam, "SHARD_BYTES", shard_bytes)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for slop in (1, 2, 4):
        want = {d: sorted(str(i) for i, t in items.items() if brute.near(text, t, 4, slop)) for d, text in texts.items()}
        got = {r.doc_id: r.near_items for r in decontam.contamination(docs, tests, window=4, slop=slop).collect()}
        assert got == want


def test_positional_index(docs, rows):
    index = decontam.positional_index(docs).collect()
    got = {}
    for r in index:
        for t, a, b in zip(r.terms, r.first, r.first[1:], strict=False):
            for p in r.places[a:b]:
                d = int(np.searchsorted(r.row, p, side="right")) - 1
                got.setdefault(r.doc_ids[d], {})[p - r.row[d]] = t.encode()
    assert sum(len(r.doc_ids) for r in index) == len(rows)
    for i, t in rows:
        own = got.get(i, {})
        assert [own[k] for k in sorted(own)] == brute.benchmark_words(t)


def test_contamination_carries_any_column(spark):
    names = [f.name for f in decontam.FOUND] + ["found_hit", "found_words", "found_spans", "shard", "row", "N_Hit"][:5]
    df = spark.createDataFrame([(1, "one two three four", *range(10)), (2, "five", *range(10)), (None, "one two three", *range(10))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    out = decontam.drop_contaminated(df, items)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]


def test_token_files(docs, rows, encoder, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, tokenizer_path(), folder, length=64)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()}
    want = brute.token_digest(rows, lambda t: np.frombuffer(encoder.whole(t), encoder.dtype).tolist())
    assert got == want
    first = manifest.orderBy("part").first()
    data = token_files.SequenceFile(f"{first.path}.arrows")
    ids, mask = data[len(data) - 1]
    assert len(ids) == 64 and len(mask) == 8 and not ids.flags.owndata
    assert sum(int(np.unpackbits(data[i][1]).sum()) for i in range(len(data))) == first.n_tokens


def test_substring(docs, rows, monkeypatch):
    want = brute.repeated_words(rows)
    for depth, shard in ((1, 1 << 20), (2, 64)):
        monkeypatch.setattr(substring, "SHARD_WINDOWS", shard)
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.repeated_windows(docs, 50, depth).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_substring_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring.repeated_windows(df).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (False, 5, 60), (True, 0, 60)]


def test_simhash(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, k=4).collect()}
    assert got == brute.components(rows)


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 20])
def test_pigeonring_finds_all_links(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(120):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 8)).tolist():
                x ^= 1 << b
            prints.add(x)
    u = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long")
    parent = {int(x): int(x) for x in u.view(np.int64)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.fingerprint_links(df, 4).collect():
        assert int(np.bitwise_count(np.int64(r.a ^ r.b).view(np.uint64))) <= 4
        parent[root(r.a)] = root(r.b)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 4):
            assert root(int(u.view(np.int64)[i])) == root(int(u.view(np.int64)[j]))


def test_near_copies(spark, rows):
    import random

    rng = random.Random(6)
    texts = [f"{' '.join(str(rng.randint(0, 9999)) for _ in range(300))}" for _ in range(30)]
    near = []
    for t in texts:
        w = t.split()
        for k in rng.sample(range(300), 4):  # about 20 of 296 shingles change
            w[k] = "x"
        near.append(" ".join(w))
    far = [" ".join(t.split()[:150] + [str(rng.randint(0, 9999)) for _ in range(150)]) for t in texts]
    df = spark.createDataFrame([*enumerate(texts + near + far), (None, texts[0])], "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()}
    assert found <= {(30 + i, i) for i in range(30)} and len(found) >= 27  # a similarity of 0.87 is found in 98 % of cases or so
    kept = simhash.drop_near_duplicates(df)
    assert kept.count() == 91 - len(found) and kept.filter("doc_id is null").count() == 1


def test_near_copies_of_hot_keys(spark, monkeypatch):
    """The search of long keys finds the groups that comparing all finds."""
    base = [str(i) for i in range(200)]
    texts = [" ".join([*base[:i], "y", *base[i + 1 :]]) for i in range(0, 200, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id for r in simhash.near_copies(df).collect()}
    monkeypatch.setattr(simhash, "COMPARED", 3)
    assert {r.doc_id for r in simhash.near_copies(df).collect()} == want and len(want) > 90


def test_components(spark):
    from verdantspark.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(docs, rows):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_spans(docs).collect()}
    assert got == brute.secrets(rows)


def test_secret_fuzz():
    import random

    rng = random.Random(5)
    parts = ["token", "secret", "AKIA", "api_key", "apikey", "Password", "=", ":", " ", '"', "'", "a", "b", "deadbeef", "0123", "XYZ", "é", ".", "\n", ",", "-", "passwd", "ghp_", "Z9", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["f" * 70000 + " AKIA" + "A" * 16]
    scanner = secrets.SecretScanner.of((*secrets.BASE, *secrets.MORE))
    want = brute.secrets(list(enumerate(texts)))
    for i, spans in enumerate(scanner.scan(pa.array(texts))):
        base = [s for s in spans if s[1] < 3]
        sha = hashlib.sha256(",".join(f"{secrets.BASE[r].kind}:{a}:{b}" for a, r, b in base).encode()).hexdigest()
        assert (*(sum(s[1] == k for s in base) for k in range(3)), sha) == want[i]


def test_secret_offsets_take_linear_time():
    import time

    scanner = secrets.SecretScanner.of((*secrets.BASE, *secrets.MORE))
    took = []
    for n in (1, 8):
        text = pa.array(["é" + "token=abcdef\u00e9," * (600 * n)])
        scanner.scan(text)
        began = time.process_time()
        assert len(scanner.scan(text)[0]) == 600 * n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2


def test_anchors_miss_no_window():
    rng = np.random.default_rng(4)
    for k in (12, 50):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 140))) for _ in range(30)] + ["", None]
        group = substring.Group(pa.table({"doc_id": pa.array(range(len(texts))), "text": texts}), k)
        anchors, own = group.anchors()
        plain = []
        for a, b in zip(group.row[:-1], group.row[1:], strict=True):
            for i in range(a, b - k + 1):
                plain.append(min(substring.window_hashes(group.hashes[i : i + k], np.array([0, k]), 10)[0]))
        assert own.tolist() == plain and set(plain) <= set(anchors.tolist()) and len(anchors) < 0.75 * len(group.hashes)


def test_ann(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    vectors = {i: (centers[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(1500)}
    vectors |= {2000 + i: vectors[0] for i in range(300)}  # one very common vector
    vectors |= {3000: None, 3001: [0.0] * 16, 3002: [float("nan")] * 16, 3003: [None] + [1.0] * 15, 3100: [float("inf")] * 16}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    want = brute.nearest(vectors)
    for block in (100_000, 64):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "QUERY_BLOCK", block // 20)
        got = {}
        for r in ann.search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert set(got) == set(want)
        hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
        assert hits / sum(map(len, want.values())) >= 0.9
        true = {q: dict((v, s) for s, v in want[q]) for q in want}
        assert all(abs(s - true[q][v]) < 1e-12 for q in got for s, v in got[q] if v in true[q])
    few = df.filter("vec_id < 5")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 4


def test_ann_of_huge_tiny_and_ragged_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).tolist() for i in range(400)}
    vectors |= {500: [1e300] * 8, 501: [-1.5e308] + [0.0] * 7, 502: [1e-200] * 8, 600: [1.5e308] * 8, 503: [1.0] * 5, 504: [2.0], 700: [], 701: [1e-310] * 8}
    df = spark.createDataFrame(list(vectors.items()) + [(1, vectors[1])], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 500, 600} and all(len(v) == 10 for v in got.values())
    assert all(v not in (503, 504, 700) for rows in got.values() for v, _ in rows)
    assert abs(got[500][0][1] / (1e300 * 8**0.5) - 1) < 1e-12
    full = np.array([vectors[i] for i in range(400)])
    for q in (0, 100, 200, 300):
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        assert {v for v, _ in got[q]} <= {*range(400), 502, 701} and len({v for v, _ in got[q]} & set(np.argsort(d, kind="stable")[1:11].tolist())) >= 7


def test_quality(spark, docs, labels, rows):
    rng = np.random.default_rng(2)
    good = [(i, "The river runs past the old stone house. " * int(rng.integers(2, 9)), "a", "x") for i in range(300)]
    bad = [(1000 + i, "BUY!! NOW!! $$$ ### " * int(rng.integers(2, 9)), "b", "y") for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in good[::2] + bad[::2]], "doc_id long, quality int")
    got = quality.quality_scores(df, marks).toPandas()
    assert (got.keep == (got.doc_id < 1000)).all()
    odd = quality.quality_scores(docs, labels).toPandas()
    assert sorted(odd.doc_id) == [i for i, _ in rows] and odd.posterior.between(0, 1).all()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_scores(docs, labels.filter("quality = 1")).toPandas().posterior.between(0, 1).all()


def test_quality_posteriors_are_the_plain_ones(spark, docs, labels):
    """The query's host, path and document posteriors against sums made one document at a time."""
    got = quality.quality_scores(docs.unionByName(docs.filter("doc_id < 9")), labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    good = [r.quality for r in labels.join(docs, "doc_id").collect() if r.quality in (0, 1)]
    base = np.log((sum(good) + 1) / (len(good) + 2)) - np.log(1 - (sum(good) + 1) / (len(good) + 2))
    p = [1 / (1 + np.exp(-r.evidence)) for r in got]
    site = [((r.source or ""), (r.lang or "")) for r in got]
    paths, hosts = {}, {}
    for x, (h, q) in zip(p, site, strict=True):
        for d, key in ((paths, (h, q)), (hosts, h)):
            s, n = d.get(key, (0.0, 0))
            d[key] = (s + x, n + 1)
    mean = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)

    def strength(groups):
        within = sum(m0 * (1 - m0) for _, _, m0 in groups)
        between = sum(n * (m - m0) ** 2 for n, m, m0 in groups)
        size = sum(n for n, _, _ in groups)
        excess = max((between - within) / max(size - len(groups), 1.0), 1e-9)
        return min(max(within / max(len(groups), 1) / excess - 1, 1.0), quality.STRONGEST)

    k_host = strength([(n, s / n, mean) for s, n in hosts.values()])
    of_host = {h: (s + k_host * mean) / (n + k_host) for h, (s, n) in hosts.items()}
    k_path = strength([(n, s / n, of_host[h]) for (h, _), (s, n) in paths.items()])
    clip = lambda v: min(max(v, 1e-6), 1 - 1e-6)
    for r, x, (h, q) in zip(got, p, site, strict=True):
        host = clip((hosts[h][0] - x + k_host * mean) / (hosts[h][1] - 1 + k_host))
        path = clip((paths[h, q][0] - x + k_path * host) / (paths[h, q][1] - 1 + k_path))
        posterior = 1 / (1 + np.exp(-(r.evidence - base + np.log(path / (1 - path)))))
        assert np.allclose([r.host_posterior, r.path_posterior, r.posterior], [host, path, posterior], rtol=1e-7)
        assert r.keep == (r.posterior >= quality.KEEP)


def test_toxicity_is_the_plain_search(spark, monkeypatch):
    """The query's neighbours against all cosines over all terms; repeated rows score alike."""
    import random

    rng = random.Random(3)
    words_ = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words_) for _ in range(12)) + (" nasty vile" if i % 3 == 0 else "") for i in range(240)]
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (900, ""), (901, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    learnt = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]
    bags = [toxicity.Counter(t.split()) for t in texts]
    strong = {t for r in got for t in r.terms}
    assert {"nasty", "vile"} <= strong
    for b in bags:
        for w, c in list(b.items()):
            for t in toxicity.word_terms(w):
                if t != w and t in strong:
                    b[t] += c
    terms = {t for i in learnt for t in bags[i]}
    n = len(texts) + 3
    seen = toxicity.Counter(t for b in [*bags, bags[5]] for t in b)
    weight = {t: (np.log((1 + n) / (1 + seen[t])) + 1) * (1 if t in strong else toxicity.OTHERS) for t in terms}

    def vector(b):
        v = {t: (1 + np.log(c)) * weight[t] for t, c in b.items() if t in terms}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = {i: vector(bags[i]) for i in learnt}
    for r in got:
        if r.doc_id < 900:
            own = vector(bags[r.doc_id])
            cosine = {i: sum(x * v.get(t, 0) for t, x in own.items()) for i, v in known.items()}
            want = sorted(cosine.values(), reverse=True)[: toxicity.NEIGHBOURS]
            assert np.allclose([cosine[i] for i in r.neighbours], [c for c in want if c > 0], atol=1e-9)
    score = {}
    for r in got:
        assert score.setdefault(r.doc_id, r.score) == r.score
    assert score[900] == score[901]


def test_sparse_sites_shrink(spark):
    """A site of one bad document is nearer to the global mean than a site of many."""
    text = {1: "The river runs past the old stone house. " * 4, 0: "BUY!! NOW!! $$$ ### " * 4}
    rows = [(i, text[1], "good", "p") for i in range(300)] + [(1000 + i, text[0], "many", "p") for i in range(200)] + [(2000 + i, text[0], "few", "p") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = df.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    got = {r.source: r.h for r in quality.quality_scores(df, marks).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("host_posterior").alias("h")).collect()}
    assert got["many"] < got["few"] < got["good"]


def test_empty_tables(spark, empty, labels):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    frames = [
        quality.quality_scores(empty, labels), quality.keep_good(empty, labels), packing.pack_documents(empty, tokenizer_path()), toxicity.toxicity(empty, labels), toxicity.toxicity(empty, labels.filter("false")),
        linededup.without_copies(empty), linededup.longest_repeats(empty), decontam.contamination(empty, items), token_files.token_file_digest(empty, tokenizer_path()), substring.repeated_windows(empty),
        simhash.simhash_components(empty), simhash.drop_near_duplicates(empty), secrets.secret_spans(empty), ann.search(vectors, vectors),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (None, None), (4, "alpha beta gamma delta epsilon")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    assert secrets.secret_spans(df).count() == 3 and packing.pack_documents(df, tokenizer_path()).count() == 3
    assert token_files.token_file_digest(df, tokenizer_path()).count() == 3 and linededup.without_copies(df).count() == 3
