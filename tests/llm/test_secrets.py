"""Spans against Python's own matching; random tokens among words."""

import random
import re
import string

from pyspark.sql import functions as F

from statloom.llm.secrets import find_secrets, joined, redacted

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RULES = [("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def base(text):
    got = sorted((m.start(), i, m.end()) for i, (_, rx, g, n) in enumerate(RULES) for m in rx.finditer(text or "") if len(m.group(g)) >= n)
    return ",".join(f"{RULES[i][0]}:{s}:{e}" for s, i, e in got)


TEXTS = [None, "", "nothing here", "token=secret:abcdefghij", "PassWord = 'hunter2hunter2' and api_key:\"x\"", "😀é password=abcd.efgh-ijkl 😀", "AKIAABCDEFGHIJKL", "AKIASHORT AKIA1234567890AB", "deadbeef" * 4, "deadbeef" * 4 + "g" + "0123456789abcdef" * 3,
         "secret: " + "ab12" * 8, "token=password=abcdefgh1", "apikey=" + "0" * 31, "x" * 100_000 + " secret=abcdefgh12 ", "secret=abcdefgh1 " * 500, "passwd : 'short' passwd:\tlonglonglong", "ſecret=abcdefgh token=ABCDEFGH", "password=abc"]


def test_base_spans(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, ""), (None, TEXTS[4])], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit("x"))
    got = find_secrets(d).select("doc_id", joined("base").alias("b"), "n_assign", "n_access", "n_hex").collect()
    want = sorted(((i, base(t)) for i, t in [*enumerate(TEXTS), (1, ""), (None, TEXTS[4])]), key=str)
    assert sorted(((r["doc_id"], r["b"]) for r in got), key=str) == want
    for r in got:
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [r["b"].count(k) for k in ("assign", "access", "hex")]


def test_empty(none):
    assert find_secrets(none).collect() == []


def test_oddities(odd):
    assert find_secrets(odd).count() == odd.count()


def test_random_tokens(spark):
    rng = random.Random(5)
    syllables = ["tion", "er", "ing", "the", "and", "ver", "ent", "al", "men", "ra", "ke", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(5, 9)))
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(300)]
    key = {1000 + i: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for i in range(60)}
    rows += [(i, f"see {k} there") for i, k in key.items()]
    rows += [(2000 + i, f"{word()}_{word()}-{word()}") for i in range(60)]
    got = {r["doc_id"]: r["s"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("spans").alias("s")).collect()}
    assert sum(got[i] == "random:4:44" for i in key) >= 55
    assert sum(bool(s) for i, s in got.items() if i not in key) <= 6


def test_redaction(spark):
    t = "a password=hunter2hunter2 b"
    d = spark.createDataFrame([(1, t), (2, "plain"), (3, "")], "doc_id long, text string")
    spans = find_secrets(d).select("doc_id", "spans")
    got = {r["doc_id"]: r["t"] for r in d.join(spans, "doc_id").select("doc_id", redacted("text", "spans").alias("t")).collect()}
    assert got == {1: "a [SECRET] b", 2: "plain", 3: ""}


def test_small_corpora(spark):
    """Three lines with one key among them: the battery decides without any word to compare with."""
    rng = random.Random(9)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [(1, "the first line"), (2, f"key {key} here"), (3, "andanotherratherlongwordinlowercase and_an_identifier_like_this")]
    got = {r["doc_id"]: r["s"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("spans").alias("s")).collect()}
    assert got == {1: "", 2: "random:4:44", 3: ""}


def test_letters_in_one_case(spark):
    """Random letters of one case are tested like all tokens; long words are not taken for them."""
    rng = random.Random(6)
    syllables = ["tion", "er", "ing", "the", "and", "ver", "ent", "al", "men", "ra", "ke", "lo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(6, 12)))
    rows = [(i, " ".join(word() for _ in range(20))) for i in range(200)]
    key = {1000 + i: "".join(rng.choice(string.ascii_uppercase) for _ in range(64)) for i in range(40)}
    rows += [(i, f"see {k} there") for i, k in key.items()]
    got = {r["doc_id"]: r["n_random"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == 1 for i in key) >= 30
    assert sum(n for i, n in got.items() if i not in key) <= 4
