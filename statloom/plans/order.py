"""Running sums, ranks and order statistics over a whole table without a one-task window.

A window with no (or a very frequent) partition key puts a whole table in one task. Here the ordered
values are first collapsed to distinct values, then dealt to tasks by ranges of key and value and written in order.
One pass over the files carries sums along, and the totals of the tasks (two rows each) give every task its offset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .frames import collect_bounded, cut_lineage, fetch, num, refuse

RANGES = 256               # ranges of a histogram whose cut points reach the driver


def range_bounds(df: DataFrame, order: str, ranges: int = RANGES) -> list:
    """Ascending cut points of a numeric column (one aggregate job, at most `ranges` values)."""
    probs = ",".join(str(i / ranges) for i in range(1, ranges))
    got = df.agg(F.expr(f"percentile_approx(cast(`{order}` as double), array({probs}), 10000)")).collect()[0][0]
    return sorted(set(got or []))


def range_id(order: str, bounds: Sequence[float]) -> Column:
    """Number of bounds below the value, by a binary decision tree of comparisons; -1 for a null, which sorts first."""
    c = F.col(order).cast("double")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c <= F.lit(float(bounds[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(c.isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def in_order(df: DataFrame, order: str, keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """The table written in the order of keys and `order`, each row with its place `__id`: what `running` reads.

    Ranges are cut by Spark over keys and order together, so a frequent key is dealt to many tasks, and their number
    follows the data.
    """
    o = [*[F.col(k).asc() for k in keys], F.col(order).desc() if descending else F.col(order).asc()]
    return cut_lineage(df.repartitionByRange(*o).sortWithinPartitions(*o).withColumn("__id", F.monotonically_increasing_id()))


def running(table: DataFrame, sums: Sequence[str], keys: Sequence[str] = (), extremes: Sequence[str] = ()) -> DataFrame:
    """Adds `<s>_before` and `<m>_maxbefore` to a table of `in_order` (or to a result of this function), in its order.

    One pass over the files: a task carries the sums along the rows of each key, and where a key goes on in another
    task, the totals of the tasks before are added. Those totals are two rows for each stretch that a task reads, which
    are written beside the rows. Rows keep their order and `__id`, so passes over values derived from one another need
    no further sort.
    """
    keys, kinds = list(keys), {f.name: f.dataType for f in table.schema.fields}
    whole = {s: isinstance(kinds[s], T.IntegralType) or isinstance(kinds[s], T.BooleanType) for s in [*sums, *extremes]}
    casts = {s: F.col(s).cast("bigint" if whole[s] else "double") for s in dict.fromkeys([*sums, *extremes])}
    names = table.columns
    fed = table.select("*", *[c.alias(f"__v_{s}") for s, c in casts.items()],
                       (F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]) if keys else F.lit(0).cast("bigint")).alias("__key"))
    outs = [*[(f"{s}_before", whole[s]) for s in sums], *[(f"{m}_maxbefore", whole[m]) for m in extremes]]
    kept = T.StructType([f for f in fed.schema.fields if not f.name.startswith("__v_") and f.name != "__key"])
    schema = T.StructType([*kept.fields, *[T.StructField(o, T.LongType() if w else T.DoubleType()) for o, w in outs], T.StructField("__piece", T.LongType()), T.StructField("__total", T.BooleanType())])
    sums, extremes = list(sums), list(extremes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_key, piece, read, row = None, None, None, None, None
        carry: dict[str, float | int | None] = {}

        def total(at: pa.RecordBatch, of: int, values: list) -> pa.RecordBatch:
            made = [pa.array([v], pa.int64() if w else pa.float64()) for v, (_, w) in zip(values, outs)]
            return pa.RecordBatch.from_arrays([*at.columns, *made, pa.array([of], pa.int64()), pa.array([True])], names=[*names, *[o for o, _ in outs], "__piece", "__total"])

        for b in batches:
            n = len(b)
            if not n:
                continue
            ids, key = b.column(b.schema.get_field_index("__id")).to_numpy(), b.column(b.schema.get_field_index("__key")).to_numpy()
            fresh = np.empty(n, bool)
            fresh[0], fresh[1:] = last_id is None or ids[0] != last_id + 1, ids[1:] != ids[:-1] + 1
            starts = fresh.copy()
            starts[1:] |= key[1:] != key[:-1]
            starts[0] |= key[0] != last_key
            s, f = np.flatnonzero(starts), np.flatnonzero(fresh)
            pieces, reads = np.full(n, -1 if piece is None else piece), np.full(n, -1 if read is None else read)
            if len(s):
                pieces[s[0]:] = np.repeat(ids[s], np.diff([*s, n]))
            if len(f):
                reads[f[0]:] = np.repeat(ids[f], np.diff([*f, n]))
            cuts = [0, *[int(i) for i in s if i], n]
            before, after = [], []
            for c in sums:
                col = b.column(b.schema.get_field_index(f"__v_{c}"))
                x = col.fill_null(0).to_numpy(zero_copy_only=False)
                start = 0 if starts[0] else carry[f"+{c}"]
                if whole[c]:
                    run = np.cumsum(x)
                    base = np.zeros(n, np.int64)
                    if len(s):
                        base[s[0]:] = np.repeat(run[s] - x[s], np.diff([*s, n]))
                    base[:s[0] if len(s) else n] = -start
                    run -= base
                else:
                    run = np.empty(n)
                    for lo, hi in zip(cuts, cuts[1:]):
                        run[lo:hi] = np.cumsum(x[lo:hi]) + (start if lo == 0 else 0)
                out = run - x if whole[c] else np.concatenate([[start], run[:-1]])
                if not whole[c]:
                    out[s] = 0
                before.append(pa.array(out))
                after.append(run)
            for c in extremes:
                col = b.column(b.schema.get_field_index(f"__v_{c}"))
                low = np.iinfo(np.int64).min if whole[c] else -np.inf
                x = col.fill_null(low).to_numpy(zero_copy_only=False)
                start = low if starts[0] else carry[f"^{c}"]
                run = np.empty(n, x.dtype)
                for lo, hi in zip(cuts, cuts[1:]):
                    run[lo:hi] = np.maximum.accumulate(x[lo:hi])
                    if lo == 0 and not starts[0]:
                        run[:hi] = np.maximum(run[:hi], start)
                out = np.concatenate([[start], run[:-1]])
                out[s] = low
                before.append(pa.array(out, mask=out == low))
                after.append(run)
            plain = b.select(names)
            values = lambda i: [a[i].item() for a in after] if i >= 0 else [carry[k] for k in carry]      # noqa: E731
            for i in s:                         # a piece that begins or ends a stretch leaves its totals
                p, r = (pieces[i - 1], reads[i - 1]) if i else (piece, read)
                if p is not None and (p == r or fresh[i]):
                    yield total(plain.slice(i - 1, 1) if i else row, int(p), _nulls(values(int(i) - 1), len(sums), outs))
            yield pa.RecordBatch.from_arrays([*plain.columns, *before, pa.array(pieces), pa.array(np.zeros(n, bool))], names=[*names, *[o for o, _ in outs], "__piece", "__total"])
            last_id, last_key, piece, read, row = int(ids[-1]), key[-1], int(pieces[-1]), int(reads[-1]), plain.slice(n - 1, 1)
            carry = {**{f"+{c}": after[j][-1].item() for j, c in enumerate(sums)}, **{f"^{c}": after[len(sums) + j][-1].item() for j, c in enumerate(extremes)}}
        if piece is not None:
            yield total(row, piece, _nulls(list(carry.values()), len(sums), outs))

    seen = cut_lineage(fed.mapInArrow(scan, schema))
    w = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = seen.where("__total").select(F.col("__piece").alias("__of"), *[F.coalesce(F.sum(f"{s}_before").over(w), F.lit(0)).alias(f"__o_{s}") for s in sums],
                                        *[F.max(f"{m}_maxbefore").over(w).alias(f"__p_{m}") for m in extremes])
    joined = seen.where("not __total").join(F.broadcast(ends), F.col("__piece") == F.col("__of"), "left")      # two rows for each task of the scan
    return joined.select(*names, *[(F.col(f"{s}_before") + F.coalesce(F.col(f"__o_{s}"), F.lit(0))).alias(f"{s}_before") for s in sums],
                         *[F.greatest(f"{m}_maxbefore", f"__p_{m}").alias(f"{m}_maxbefore") for m in extremes])


def _nulls(values: list, sums: int, outs: Sequence[tuple[str, bool]]) -> list:
    """Totals with the lowest value, which stands for no maximum, as null."""
    return [None if i >= sums and v == (np.iinfo(np.int64).min if w else -np.inf) else v for i, (v, (_, w)) in enumerate(zip(values, outs))]


def cumulate(df: DataFrame, order: str, sums: Sequence[str], keys: Sequence[str] = (), extremes: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds `<s>_before`: the sum of `s` over rows of the same key that come strictly earlier.

    `order` must be numeric and unique within a key (collapse ties first). `extremes` adds `<m>_maxbefore`, the running
    maximum of earlier rows (null on the first row). The input is evaluated once, when this is called.
    """
    return running(in_order(df, order, keys, descending), sums, keys, extremes).drop("__id")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by keys, a null key being equal to a null one."""
    r = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return left.join(r, same).drop(*[f"__j{i}" for i in range(len(keys))])


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), **conditional: Column) -> DataFrame:
    """Collapse to distinct values with `n` (and named conditional counts)."""
    return (df.groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(F.when(c, 1).otherwise(0)).alias(a) for a, c in conditional.items()]))


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (),
                  **conditional: Column) -> DataFrame:
    """Distinct values with `n`, `n_before` and the tie-averaged rank `avg_rank`."""
    vc = value_counts(df, value, keys, **conditional)
    return cumulate(vc, value, ["n", *conditional], keys).withColumn(
        "avg_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def with_average_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every row of the table with the tie-averaged rank of its value; a null has none and counts for none."""
    ranks = average_ranks(df.where(F.col(value).isNotNull()), value, keys).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), F.col("avg_rank").alias(out))
    # Salt-free: the rank side is one row per distinct value, so AQE splits a hot value's rows.
    same = F.col(value) == F.col("__v")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, same, "left").select(*[c for c in df.columns if c != out], out)


def sorted_position(df: DataFrame, value: str, tiebreak: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """1-based position of every row in a total order (value, then the tie-break columns, of any types).

    Rows are sorted by ranges of the whole order, so a value that many rows share is cut among tasks by its tie-break
    columns. Nulls come first (last if descending). The sorted table is written, which fixes what the positions refer to.
    """
    o = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in tiebreak]]
    at = cut_lineage(df.repartitionByRange(*o).sortWithinPartitions(*o).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("__id"), 33)
    counts = at.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)      # one row per task of the sort
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    joined = at.withColumn("__p", part).join(offsets, "__p")
    return joined.select(*[c for c in df.columns if c != out], (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__off") + 1).cast("bigint").alias(out))


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact linearly interpolated quantiles of a numeric column as driver values."""
    got = group_quantiles(df, value, probs, ())
    return got.get((), [None] * len(probs))


def group_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """The same per group (key tuple -> quantiles); groups must be few.

    The order statistics are picked out of distributed cumulative counts.
    """
    keys = list(keys)
    d = df.select(*keys, num(value).alias("__v")).where(F.col("__v").isNotNull())
    probs = [float(p) for p in probs]
    c = cumulate(value_counts(d, "__v", keys), "__v", ["n"], keys)
    size = c.groupBy(*keys).agg(F.sum("n").alias("__total"))
    t = same_keys(c, size, keys) if keys else c.crossJoin(F.broadcast(size))      # one row
    hits = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("__total") - 1)
        for side, rank in (("f", F.floor(h)), ("c", F.ceil(h))):
            hit = (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))
            hits.append(F.when(hit, F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"))))
    picked = t.select(*keys, "__v", "__total", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    vals: dict = {}
    for r in collect_bounded(picked, "quantiles"):
        k = tuple(r[x] for x in keys)
        vals.setdefault(k, {"total": r["__total"]})[(r["hit"]["i"], r["hit"]["side"])] = r["__v"]
    out = {}
    for k, v in vals.items():
        out[k] = []
        for i, p in enumerate(probs):
            h = p * (v["total"] - 1)
            lo, hi = v[(i, "f")], v[(i, "c")]
            out[k].append(lo + (h - int(h)) * (hi - lo))
    return out


def near_quantile(df: DataFrame, value: Column, prob: float, guess: float | None = None, cells: int = 512, few: int = 4096) -> float:
    """Exact linearly interpolated quantile of non-negative values, by counting in cells around a guess.

    Each pass counts the values below, inside and beyond a bracket in one aggregate and narrows it to the cells that hold
    the wanted ranks; when few distinct values are left they are fetched. No row moves, so it suits loops whose quantile
    changes little from round to round.
    """
    d = df.select(value.alias("__a")).where(F.col("__a").isNotNull())
    all_of = fetch(d, n=F.count(F.lit(1)), lo=F.min("__a"), hi=F.max("__a"))
    n = all_of["n"]
    refuse(not n, "no values to take a quantile of")
    h = prob * (n - 1)
    want = (math.floor(h) + 1, math.ceil(h) + 1)
    lo, hi = (all_of["lo"], all_of["hi"]) if not guess else (max(all_of["lo"], guess * 0.95), min(all_of["hi"], guess * 1.05))
    while True:
        if not lo <= hi:
            lo, hi = all_of["lo"], all_of["hi"]
        width = (hi - lo) / cells
        inside = (F.col("__a") >= F.lit(lo)) & (F.col("__a") <= F.lit(hi))
        cell = F.when(F.col("__a") < F.lit(lo), -1).when(~inside, cells).otherwise(F.least(F.floor((F.col("__a") - F.lit(lo)) / F.lit(width)), F.lit(cells - 1)) if width > 0 else F.lit(0))
        got = sorted((r["c"], r["k"], r["lo"], r["hi"]) for r in d.groupBy(cell.cast("int").alias("c")).agg(F.count(F.lit(1)).alias("k"), F.min("__a").alias("lo"), F.max("__a").alias("hi")).collect())
        at, hit = 0, []
        for c, k, a, b in got:
            if at < want[1] and at + k >= want[0]:
                hit.append((c, at, k, a, b))
            at += k
        if any(c in (-1, cells) for c, *_ in hit):
            lo, hi = (all_of["lo"], all_of["hi"]) if (lo, hi) != (all_of["lo"], all_of["hi"]) else (hit[0][3], hit[-1][4])
            continue
        before, lo, hi = hit[0][1], hit[0][3], hit[-1][4]
        if sum(k for _, _, k, _, _ in hit) <= few or lo == hi or hi - lo <= 1e-15 * abs(hi):
            break
    vals, at = {}, before
    for r in sorted(collect_bounded(d.where((F.col("__a") >= F.lit(lo)) & (F.col("__a") <= F.lit(hi))).groupBy("__a").agg(F.count(F.lit(1)).alias("k")), "values")):
        for w in want:
            if at < w <= at + r["k"]:
                vals[w] = r["__a"]
        at += r["k"]
    a, b = vals[want[0]], vals[want[1]]
    return a + (h - math.floor(h)) * (b - a)


def dense_rank(points: DataFrame, x: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every row with the number of distinct smaller values of `x` in its key."""
    keys = list(keys)
    one = cumulate(points.select(*keys, x).distinct().withColumn("one", F.lit(1).cast("bigint")), x, ["one"], keys)
    return same_keys(points, one.select(*keys, x, F.col("one_before").alias(out)), [*keys, x])


def concordance(points: DataFrame, ranked: str, along: str, weight: str, keys: Sequence[str] = (), bits: int | None = None) -> DataFrame:
    """Concordant and discordant pairs of (ranked, along), exactly and without forming pairs.

    `points` holds distinct pairs of values with a count; `ranked` is ranked densely (or is such a rank
    already when `bits` is given). For every bit of the rank, rows that share the higher bits form a
    block, where the pairs that differ first in this bit are counted by a running sum along the other
    column. Cost: rows x bits and one shuffle; ties count as neither.
    """
    keys = list(keys)
    if bits is None:
        points = dense_rank(points, ranked, "__rk", keys)
        bits = rank_bits(points, "__rk")
    else:
        points = points.withColumn("__rk", F.col(ranked))
    ex = points.select(*keys, F.col(along).alias("__al"), F.col("__rk"), F.col(weight).alias("__wt"),
                       F.explode(F.array(*[F.lit(i) for i in range(bits)])).alias("__bit"))
    ex = ex.select(*keys, "__al", "__bit", F.expr("shiftright(__rk, __bit + 1)").alias("__blk"),
                   F.expr("shiftright(__rk, __bit) % 2").alias("side"), "__wt")
    cell = ex.groupBy(*keys, "__bit", "__blk", "__al").agg(
        F.sum(F.when(F.col("side") == 0, F.col("__wt")).otherwise(0)).alias("lo"),
        F.sum(F.when(F.col("side") == 1, F.col("__wt")).otherwise(0)).alias("hi"))
    run = cumulate(cell, "__al", ["lo", "hi"], [*keys, "__bit", "__blk"])
    return run.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("hi") * F.col("lo_before")), F.lit(0)).cast("double").alias("concordant"),
        F.coalesce(F.sum(F.col("lo") * F.col("hi_before")), F.lit(0)).cast("double").alias("discordant"))


def rank_bits(points: DataFrame, rank: str) -> int:
    return max(1, int(points.agg(F.max(rank)).collect()[0][0] or 0).bit_length())


def select_ranks(count_at_most, ranks: Sequence[int], lo: float, hi: float, fan: int = 24, rtol: float = 1e-12, ends: tuple[float, float] | None = None) -> dict[int, float]:
    """Order statistics of a multiset known only through counts: rank -> smallest t with count(<= t) >= rank.

    `count_at_most(ts)` returns {t: count}; all ranks share the passes, and every pass cuts each bracket by `fan`. Where
    the counts at the ends of a bracket are known (`ends` are those of lo and hi), some of the cuts lie close around the
    place that a straight line between the counts gives, so brackets shrink faster where slopes are dense.
    """
    br = {r: (lo, hi) for r in ranks}
    known: dict[float, float] = dict(zip((lo, hi), ends)) if ends else {}
    while True:
        ts: set[float] = set()
        for r in ranks:
            a, b = br[r]
            if b - a <= rtol * max(1.0, abs(a), abs(b)):
                continue
            even = fan
            if a in known and b in known and known[b] - known[a] > 8:
                even = max(2, fan // 3)
                c = a + (b - a) * (r - known[a]) / (known[b] - known[a])
                w = (b - a) / 8
                for _ in range((fan - even + 1) // 2):
                    ts |= {t for t in (c - w, c + w) if a < t < b}
                    w /= 32
            ts |= {t for i in range(1, even + 1) if a < (t := a + (b - a) * i / (even + 1)) < b}
        if not ts:
            return {r: b for r, (_, b) in br.items()}
        known |= count_at_most(sorted(ts))
        for r, (a, b) in br.items():
            for t in sorted(ts):
                if a < t < b:
                    if known.get(t, 0) >= r:
                        b = t
                        break
                    a = t
            br[r] = (a, b)
