import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

VOCABULARY = "alpha beta gamma delta omega sigma kappa lambda zeta theta river stone cloud forest meadow harbour lantern copper silver winter".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with every odd case: null, empty, blank, very long, copies, near copies, shared passages, odd bytes."""
    import random

    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    passage = prose(rng, 70)
    texts = [None, "", "   \n\t ", "\n\n\n", "Ünïcödé 名前 ok x\x1cy", "word " * 3000, prose(rng, 20000)]
    texts += base + base[:15] + [passage + "\n" + b for b in base[15:25]] + [b.replace("river", "stone", 1) for b in base[25:35]]
    texts += ["line one\nline two\nline three\n" + b for b in base[35:40]] + ["PASSWORD = 'abcdefgh1' and AKIA" + "A1" * 9, "f" * 30 + " token: short", passage, passage]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, spread over partitions, with columns whose names clash with those of results and of inner steps."""
    more = [(i, t, "en" if i % 3 else None, None if i % 11 == 0 else f"src{i % 2}", i, "a", 0, 0.5, "g", 1) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id int, score double, g string, start int"
    return spark.createDataFrame(more, names).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i, _ in rows if i % 2] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
