"""Secrets in texts, by patterns and by a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans. Beside them every run of `TOKEN` characters is tested. Its encoding is inferred from
its characters, and three tests ask how well it agrees with uniform draws from that alphabet: chi-squared over the
letters, runs above and below the middle of the alphabet, and serial correlation of neighbours. Fisher's statistic
combines their p-values: small for random strings, large for words.

How small counts as random follows from words. For words the statistic grows with the length, so the mean and the spread
of log(statistic / length) over words give every token a p-value against "a word of this length", the smaller the longer
a random token is. The words are the corpus's tokens of letters in one case, together with `PRIOR`, a fixed baseline
that counts as so many words; so a corpus of three lines is judged like any other, and a large one by its own words.
Benjamini-Hochberg bounds the false discoveries by `RATE` in each length class, by itself over tokens of letters in one
case (which are words in the main, but are tested like all others) and over the rest. Only two moments and a histogram
over fixed bins reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.frames import cut_lineage, need

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LENGTHS = (16, 20, 24, 32, 48, 64)          # lower ends of the length classes
RATE = 0.05
PRIOR = (20, 0.2, 0.55)                      # number, mean and spread of log(statistic / length) of words, as measured on prose
BINS = 151                                  # tenths of -log10 of a p-value
ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
FITS = {"hex": "^[0-9a-f]+$", "HEX": "^[0-9A-F]+$", "base32": "^[A-Z2-7]+$", "base36": "^[0-9a-z]+$", "base64": "^[A-Za-z0-9+/]+$", "base64url": "^[A-Za-z0-9_-]+$"}


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def matches(pattern: str, kind: str, group: int | None = None, least: int = 1) -> str:
    """SQL: the leftmost non-overlapping matches in `text` as structs (s, e, k), code points from 0, end exclusive.

    Of a match, `group` (or all of it) must have `least` characters. What lies between matches comes from a split.
    """
    p = _quoted(pattern)
    got = f"array(regexp_extract_all(text, {p}, 0), split(text, {p}, -1)" + (f", regexp_extract_all(text, {p}, {group})" if group else "") + ")"
    step = ("named_struct('at', a.at + length(z.gap) + length(z.m), 'out', if(z.n >= {least}, concat(a.out, array(named_struct('s', a.at + length(z.gap), 'e', a.at + length(z.gap) + length(z.m), 'k', {k}))), a.out))"
            .format(least=least, k=KINDS.index(kind)))
    zipped = f"transform(x[0], (m, i) -> named_struct('m', m, 'gap', x[1][i], 'n', length({'x[2][i]' if group else 'm'})))"
    run = f"aggregate({zipped}, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,k:int>>)), (a, z) -> {step}, a -> a.out)"
    return f"flatten(transform(array({got}), x -> {run}))"


NONE = "cast(array() as array<struct<s:int,e:int,k:int>>)"


def base_spans() -> Column:
    """All base spans of `text`, sorted by start, then kind. Cheap searches spare most texts the patterns."""
    low = "lower(text)"
    assign = f"if({' or '.join(f"contains({low}, '{w}')" for w in ASSIGN_WORDS)}, {matches(ASSIGN, 'assign', 2, 8)}, {NONE})"
    access = f"if(contains(text, 'AKIA'), {matches(ACCESS, 'access', None, 16)}, {NONE})"
    # Runs below 32 are dropped in the pattern itself: a run is maximal either way.
    hexes = f"if(text rlike '[0-9a-f]{{32}}', {matches('[0-9a-f]{32,}', 'hex', None, 32)}, {NONE})"
    return F.expr(f"array_sort(concat({assign}, {access}, {hexes}), (x, y) -> if(x.s <> y.s, x.s - y.s, x.k - y.k))")


def _upper_tail(z: Column) -> Column:
    """About the upper tail of the normal distribution."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def tested(tokens: DataFrame) -> DataFrame:
    """Adds to tokens (…, t) the length n, the encoding, the statistic and whether the token is a word."""
    enc = F.coalesce(*[F.when(F.col("t0").rlike(p), F.lit(k)) for k, p in FITS.items()], F.lit("base64"))
    d = tokens.withColumn("t0", F.regexp_replace("t", "=+$", "")).withColumn("n", F.length("t0")).withColumn("enc", enc)
    d = d.withColumn("abc", F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("enc"))).withColumn("size", F.length("abc").cast("double"))
    d = d.withColumn("x", F.expr("transform(split(t0, ''), c -> cast(instr(abc, c) - 1 as double))"))
    d = d.withColumn("half", F.expr("transform(x, v -> v >= size / 2)"))
    total = lambda arr: f"aggregate({arr}, 0D, (a, v) -> a + v)"
    d = d.select("*", F.expr("aggregate(array_distinct(split(t0, '')), 0D, (a, c) -> a + power(n - length(replace(t0, c, '')), 2))").alias("squares"),
                 F.expr(total("x")).alias("s1"), F.expr(total("transform(x, v -> v * v)")).alias("s2"),
                 F.expr(total("zip_with(slice(x, 1, n - 1), slice(x, 2, n - 1), (v, w) -> v * w)")).alias("s12"),
                 F.expr("cast(size(filter(half, h -> h)) as double)").alias("up"),
                 F.expr("1D + size(filter(zip_with(slice(half, 1, n - 1), slice(half, 2, n - 1), (v, w) -> v <> w), h -> h))").alias("runs"))
    n, df = F.col("n").cast("double"), F.col("size") - 1
    chi = F.col("size") / n * F.col("squares") - n
    p_chi = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    mean = 2 * F.col("up") * (n - F.col("up")) / n + 1
    p_runs = F.when(mean <= 2, F.lit(1e-12)).otherwise(2 * _upper_tail(F.abs(F.col("runs") - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))))
    m = F.col("s1") / n
    var = F.col("s2") - n * m * m
    first, last = F.element_at("x", 1), F.element_at("x", -1)
    r = (F.col("s12") - m * (2 * F.col("s1") - first - last) + (n - 1) * m * m) / var
    p_serial = F.when(var <= 0, F.lit(1e-12)).otherwise(2 * _upper_tail(F.abs(r + 1 / n) * F.sqrt(n)))
    stat = sum((-2 * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in (p_chi, p_runs, p_serial)), F.lit(0.0))
    level = sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))
    word = F.col("t").rlike("^([a-z]+|[A-Z][a-z]*|[A-Z]+)$")
    return d.select(*[c for c in tokens.columns if c != "t"], F.log(F.greatest(stat, F.lit(0.01)) / n).alias("stat"), (level + F.when(word, len(LENGTHS)).otherwise(0)).cast("int").alias("level"), word.alias("word"))


def against_words(scored: DataFrame) -> DataFrame:
    """Adds `bin`: tenths of -log10 of the p-value against a word of the token's length."""
    r = scored.where("word").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.mean("stat"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("stat"), F.lit(0.0)).alias("var")).collect()[0]
    n0, m0, s0 = PRIOR
    n = n0 + r["n"]
    mean = (n0 * m0 + r["n"] * r["mean"]) / n
    sd = math.sqrt((n0 * (s0 * s0 + (m0 - mean) ** 2) + r["n"] * (r["var"] + (r["mean"] - mean) ** 2)) / n)
    p = _upper_tail((F.lit(mean) - F.col("stat")) / sd)
    return scored.withColumn("bin", F.least(F.floor(-10 * F.log10(p)), F.lit(BINS - 1)).cast("int"))


def thresholds(scored: DataFrame, rate: float = RATE) -> list[int]:
    """By class (those of one-case tokens come second), the lowest bin of the p-value that counts as random; BINS for none."""
    tokens = [[0] * BINS for _ in range(2 * len(LENGTHS))]
    for r in scored.groupBy("level", "bin").count().collect():      # at most classes x bins rows
        tokens[r["level"]][r["bin"]] += r["count"]
    out = []
    for bins in tokens:
        best, found = BINS, 0
        for b in range(BINS - 1, 0, -1):
            found += bins[b]
            if found and 10 ** (-b / 10) * sum(bins) <= rate * found:
                best = b
        out.append(best)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Every document with its spans: doc_id, n_assign, n_access, n_hex, n_random, base and spans (arrays of s, e, k).

    k numbers the kinds of KINDS; s and e are code points, e exclusive. `spans` holds the base ones and the random
    tokens that touch none of them, by start, then kind. A null or empty text has none. Rows that repeat a doc_id are
    rows of their own. Other columns are ignored. An empty table gives no rows. Texts may be of any length.
    """
    need(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    token = matches(TOKEN, "random")
    cut = d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", base_spans().alias("base"),
                   F.expr(f"if(text rlike {_quoted(TOKEN)}, zip_with({token}, regexp_extract_all(text, {_quoted(TOKEN)}, 0), (a, b) -> named_struct('at', a, 't', b)), cast(array() as array<struct<at:struct<s:int,e:int,k:int>,t:string>>))").alias("tokens"))
    cut = cut_lineage(cut)
    tokens = cut.select("rid", F.explode("tokens").alias("t")).select("rid", F.col("t.at").alias("at"), F.col("t.t").alias("t")).where(F.col("t").rlike("[A-Za-z]"))
    scored = against_words(cut_lineage(tested(tokens)))
    limit = F.array(*[F.lit(x) for x in thresholds(scored, rate)])
    found = scored.where(F.col("bin") >= limit[F.col("level")]).groupBy("rid").agg(F.collect_list("at").alias("random"))
    both = cut.select("rid", "doc_id", "base").join(found, "rid", "left")
    apart = F.expr(f"filter(coalesce(random, {NONE}), r -> not exists(base, b -> b.s < r.e and r.s < b.e))")
    spans = F.expr("array_sort(concat(base, random), (x, y) -> if(x.s <> y.s, x.s - y.s, x.k - y.k))")
    n = [F.expr(f"cast(size(filter(spans, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return both.select("doc_id", "base", apart.alias("random")).select("doc_id", "base", spans.alias("spans")).select("doc_id", *n, "base", "spans")


def joined(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    step = (f"named_struct('at', greatest(a.at, x.e), 'out', if(x.s >= a.at, concat(a.out, substring({text}, a.at + 1, x.s - a.at), '{mark}'), a.out))")
    return F.expr(f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))")
