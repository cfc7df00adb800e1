import random

import pytest

import tempfile

WORDS = [f"w{i}" for i in range(400)] + ["Über", "naïve", "日本", "ÉTÉ"]


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls in any column, empty, blank and very long texts, repeated rows, clashing names."""
    rng = random.Random(7)
    base = " ".join(words(rng, 120))
    long = " ".join(words(rng, 60_000))
    rows = [(1, base), (2, base.upper()), (3, base.replace(" ", "\n\t ")), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "One  two\tTHREE"), (9, long), (10, long + " end"), (11, base), (11, base),
            (None, base), (None, None), (12, "a"), (13, "a"), (14, "Ünïcödé 😀 text here with spaces and more words"), (15, base + " tail")]
    rows += [(20 + i, " ".join(words(rng, rng.randint(1, 300)))) for i in range(60)]
    rows = [(i, t, rng.choice(["a", "b", None]), rng.choice(["s1", "s2", "é", None]), len(t or ""), 1, "x", 0.5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, size string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
