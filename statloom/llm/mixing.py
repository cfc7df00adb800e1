"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are summed by membership pattern (the set of sources they belong to). The driver holds one number per pattern
and per source: words flow from patterns to the quotas of their sources, and the e-th repetition of a pattern costs e a
word, so nothing is repeated before all that can serve the quota was used once. The words routed from a pattern make
whole passes over its documents and a remainder, which goes to its documents in a seeded order, the last one in part.
The order is by a digest of seed and doc_id; the place where the remainder ends is found in sums over digest prefixes,
so no pattern is sorted in one task, however large.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.frames import collect_bounded, cut_lineage, need, rows_frame
from .text import bounded, word_counts

WEIGHTS = (1, 2, 3)     # by source in code point order, repeating
MOST = 3                # passes over a document
PREFIX = 3              # hex digits of the digest that a level of sums looks at


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Targets by source: all words shared by weight, none above `most` times its source, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * rest > most * sizes[s] * share}
        if not over:
            return {s: float(most * sizes[s]) if s in full else weight[s] * rest / share for s in names}
        full |= over


def routes(patterns: dict[str, int], quotas: dict[str | None, int], most: int = MOST) -> dict[tuple[str, str | None], int]:
    """Words from each pattern (JSON list of sources) to each source: the cheapest flow that fills most of the quotas.

    Augments along cheapest paths, in each group of connected patterns and sources by itself.
    """
    members = {p: [s for s in json.loads(p) if s in quotas] for p in patterns}
    of = defaultdict(list)
    for p, ss in members.items():
        for s in ss:
            of[s].append(p)
    flow: dict[tuple[str, str | None], int] = defaultdict(int)
    used: dict[str, int] = defaultdict(int)
    missing = dict(quotas)
    seen: set = set()
    for start in quotas:
        if start in seen:
            continue
        group, stack = [], [start]
        seen.add(start)
        while stack:
            group.append(s := stack.pop())
            for t in {t for p in of[s] for t in members[p]} - seen:
                seen.add(t)
                stack.append(t)
        while True:
            # From every source with a quota left, back over patterns that may give more, or that give to another source.
            frontier = [s for s in group if missing[s] > 0]
            came: dict = {s: None for s in frontier}
            best = None
            while frontier:
                nxt = []
                for s in frontier:
                    for p in of[s]:
                        cost = used[p] // patterns[p] if patterns[p] else most
                        if cost < most and (best is None or cost < best[0]):
                            best = (cost, p, s)
                        for t in members[p]:
                            if t not in came and flow[p, t] > 0:
                                came[t] = (p, s)
                                nxt.append(t)
                frontier = nxt
            if best is None:
                break
            _, p, s = best
            path, at = [], s
            while came[at] is not None:
                path.append((at, *came[at]))
                at = came[at][1]
            n = min([patterns[p] - used[p] % patterns[p], missing[at], *[flow[q, a] for a, q, _ in path]])
            used[p] += n
            flow[p, s] += n
            for a, q, b in path:
                flow[q, a] -= n
                flow[q, b] += n
            missing[at] -= n
    return {k: v for k, v in flow.items() if v}


def _pattern(docs: DataFrame, sources: str | Column) -> Column:
    """A document's sources as a JSON list; null is a source of its own."""
    col = F.col(sources) if isinstance(sources, str) else sources
    array = col if docs.select(col.alias("s")).schema["s"].dataType.typeName() == "array" else F.array(col)
    return F.to_json(F.coalesce(F.sort_array(F.array_distinct(array)), F.array(F.lit(None).cast("string"))))


def _given(sized: DataFrame, weights: Sequence[int], most: int) -> tuple[dict[str, int], dict[str | None, float], dict[str, int]]:
    """Words by pattern, targets by source, and words that each pattern gives, from (pattern, size)."""
    size = {r["pattern"]: int(r["n"]) for r in collect_bounded(sized.groupBy("pattern").agg(F.sum("size").alias("n")), "source combinations")}
    by_source: dict = defaultdict(int)
    for p, n in size.items():
        for s in json.loads(p):
            by_source[s] += n if len(json.loads(p)) == 1 else n // len(json.loads(p))
    target = targets(by_source, weights, most) if by_source else {}
    given: dict[str, int] = defaultdict(int)
    for (p, _), n in routes(size, {s: int(t + 0.5) for s, t in target.items()}, most).items():
        given[p] += n
    return size, target, given


def mix(docs: DataFrame, sources: str | Column = "source", seed: int = 42, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its pattern, its size in words and the words the mix takes of it.

    `sources` is a text column, or an array of texts where documents belong to several sources; null is a source of its
    own (the last). Returns doc_id, pattern (JSON list of its sources), size, pattern_size, target (summed over its
    sources), taken (passes * size + extra), passes and extra (words of one more, partial pass), one row per input row.
    Null and empty texts have size 0 and give nothing. A source without words has the target 0. The number of patterns
    is that of source combinations and must fit the driver. Rows that repeat a doc_id each count; which of them has the
    remainder's end depends on their size alone. Other columns are ignored.
    """
    need(docs, id_col, text_col, *([sources] if isinstance(sources, str) else []))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _pattern(docs, sources).alias("pattern"),
                        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(word_counts(b.column(1)))], ["doc_id", "pattern", "h", "size"])

    sized = cut_lineage(keyed.mapInArrow(count, f"doc_id {docs.schema[id_col].dataType.simpleString()}, pattern string, h string, size bigint"))
    size, target, given = _given(sized, weights, most)
    spark = docs.sparkSession
    # One row per pattern: its passes, and of the remainder the digest prefix where it ends and what comes before that.
    ends = {p: ("", given[p] - given[p] // n * n if n else 0) for p, n in size.items()}
    for _ in range(2):
        at = rows_frame(spark, "pattern string, prefix string, rest bigint", [(p, *e) for p, e in ends.items()])
        inside = sized.join(at, "pattern").where("rest > 0 and startswith(h, prefix)")
        sums = inside.groupBy("pattern", F.expr(f"left(h, length(prefix) + {PREFIX})").alias("p")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        before = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern").orderBy("p")))
        hit = before.where("upto >= rest").groupBy("pattern").agg(F.min(F.struct("p", F.expr("rest - (upto - n)").alias("rest"))).alias("e")).collect()
        ends |= {r["pattern"]: (r["e"]["p"], r["e"]["rest"]) for r in hit}
    info = rows_frame(spark, "pattern string, pattern_size bigint, target double, passes int, prefix string, rest bigint",
                      [(p, n, float(sum(target[s] for s in json.loads(p))), given[p] // n if n else 0, *ends[p]) for p, n in size.items()])
    joined = sized.join(info, "pattern")
    last = (F.col("rest") > 0) & F.expr("startswith(h, prefix)")
    plain = joined.where(~last).withColumn("extra", F.when((F.col("rest") > 0) & (F.col("h") < F.col("prefix")), F.col("size")).otherwise(F.lit(0)))
    w = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ended = joined.where(last).withColumn("extra", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.coalesce(F.sum("size").over(w), F.lit(0)))))
    return plain.unionByName(ended).select("doc_id", "pattern", "size", "pattern_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"), "passes", F.col("extra").cast("bigint").alias("extra"))


def mixed(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is passed over, and the first `extra` words of one more pass.

    `taken` is the result of `mix` over the same documents, whose ids must not be null or repeat. A partial copy has its
    words joined by single spaces. Documents of which nothing is taken go.
    """
    t = cut_lineage(taken.where("taken > 0").select(F.col("doc_id").alias(id_col), "passes", "extra", "size"))
    white = r"[\x20\x09-\x0D]+"
    part = F.array_join(F.slice(F.split(F.regexp_replace(text_col, "^" + white, ""), white), 1, F.col("extra").cast("int")), " ")
    copies = F.flatten(F.array(F.array_repeat(F.col(text_col), F.col("passes")), F.when(F.col("extra") == 0, F.array().cast("array<string>")).when(F.col("extra") == F.col("size"), F.array(text_col)).otherwise(F.array(part))))
    return docs.join(t, id_col).withColumn(text_col, F.explode(copies)).select(*docs.columns)


def mixture(docs: DataFrame, sources: str | Column = "source", seed: int = 42, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix of whole documents: each row of docs, with all its columns, as often as the mix takes it.

    Targets and passes are those of `mix`. The remainder of a pattern goes to its rows in the order of a digest of seed,
    id and text; the row at its end is taken if at least half of it is wanted, so a source misses its target by half a
    document at most. Rows that agree in id and text are taken together. Null and repeated ids are rows like any other.
    Null, empty and blank texts have no words: they are taken as often as the passes and the order say. A pattern
    without words gives one pass, so its rows are kept. An empty table gives no rows. Extra columns are kept as they are.

    Every row decides by itself from one line per pattern, so texts are read in place and not shuffled.
    """
    need(docs, id_col, text_col, *([sources] if isinstance(sources, str) else []))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(word_counts(b.column(0)))], ["pattern", "h", "size"])

    keyed = docs.select(F.col(text_col).alias("text"), _pattern(docs, sources).alias("pattern"), order.alias("h"))
    sized = cut_lineage(keyed.mapInArrow(count, "pattern string, h string, size bigint"))
    size, _, given = _given(sized, weights, most)
    spark = docs.sparkSession
    schema = "pattern string, prefix string, rest bigint"
    ends = {p: ("", given[p] % n if n else 0) for p, n in size.items()}
    todo, whole = {p for p, (_, rest) in ends.items() if rest}, {}
    while todo:                 # a level of digits at a time, until one document (or rows that agree in all) is left
        at = rows_frame(spark, schema, [(p, *ends[p]) for p in todo])
        inside = sized.join(at, "pattern").where("startswith(h, prefix)")
        sums = inside.groupBy("pattern", F.expr(f"left(h, length(prefix) + {PREFIX})").alias("p")).agg(F.sum("size").alias("n"), F.max("h").alias("hi"), F.min("h").alias("lo"), F.first("rest").alias("rest"))
        before = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pattern").orderBy("p")))
        hit = before.where("upto >= rest").groupBy("pattern").agg(F.min(F.struct("p", F.expr("rest - (upto - n)").alias("rest"), "n", "lo", "hi")).alias("e"))
        for r in collect_bounded(hit, "source combinations"):
            ends[r["pattern"]] = (r["e"]["p"], r["e"]["rest"])
            if r["e"]["lo"] == r["e"]["hi"]:
                todo.discard(r["pattern"])
                ends[r["pattern"]] = (r["e"]["lo"], r["e"]["rest"])
                whole[r["pattern"]] = 2 * r["e"]["rest"] >= r["e"]["n"]
    info = rows_frame(spark, "__pattern string, __passes int, __end string, __whole boolean", [(p, given[p] // n if n else 1, ends[p][0], whole.get(p, False)) for p, n in size.items()])
    times = F.col("__passes") + F.when((F.col("__end") != "") & ((F.col("__order") < F.col("__end")) | ((F.col("__order") == F.col("__end")) & F.col("__whole"))), 1).otherwise(0)
    marked = docs.withColumns({"__pattern": _pattern(docs, sources), "__order": order}).join(F.broadcast(info), "__pattern").withColumn("__times", times)      # one line per source combination, which are bounded
    marked = marked.where("__times > 0")
    return marked.withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))).select(*docs.columns)
