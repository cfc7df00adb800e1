"""A Merkle tree over the rows of a dataset, and the versions of it that altered rows make.

Each row is a leaf, each group (source) has a tree of runs of `fan` nodes, and the groups' roots have one more such tree
above them. A tree is built in aligned blocks of fan ** height nodes: a task reduces a block to its root, and the roots
are the nodes of the next round, so every round has fan ** height times fewer. An altered leaf makes a version of the
tree that shares every node but its ancestors (path copying): those inside its block are copied where the block's nodes
are, those above go on along the path of the block's root, which all leaves of the block share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.frames import cut_lineage, need, refuse
from ..plans.order import sorted_position

HEIGHT = 6                 # usual number of levels of a block: 729 nodes where a run has 3
PACK = 64                  # groups of at most one block that share a task's call
HEX = 64                   # characters of a digest

_STEP = "gid bigint, idx bigint, blk bigint, total bigint, proof string, places string, root string"


def leaf_digest(*fields: str | Column) -> Column:
    """Digest of a row: each field as `-` if null, else its UTF-8 byte count, `:` and its value, one after another."""
    def part(f):
        v = (F.col(f) if isinstance(f, str) else f).cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def _h(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def _reduce(nodes: list[bytes], total: int, fan: int, height: int) -> list[list[bytes]]:
    """All levels of a block, its own nodes first: `height` more levels where the tree has other blocks, else up to one node."""
    levels = [nodes]
    while (len(levels) <= height) if total > fan ** height else (len(levels[-1]) > 1):
        low = levels[-1]
        levels.append([_h(b"".join(low[i:i + fan])) for i in range(0, len(low), fan)])
    return levels


def _path(levels: list[list[bytes]], i: int, fan: int) -> tuple[bytes, str]:
    """Siblings of node i up to the block's root, and place and run size of each step, as digits."""
    sib, places = [], []
    for low in levels[:-1]:
        first = i - i % fan
        run = low[first:first + fan]
        places.append(f"{i - first}{len(run)}")
        sib += run[:i - first] + run[i - first + 1:]
        i //= fan
    return b"".join(sib), "".join(places)


def copied_path(node: str | bytes, proof: str | bytes, places: str) -> list[bytes]:
    """The ancestors of a leaf, lowest first, that a version of the tree with this leaf holds as its own."""
    node, proof = (x.encode() if isinstance(x, str) else x for x in (node, proof))
    out, at = [], 0
    for k in range(0, len(places), 2):
        left, others = int(places[k]), int(places[k + 1]) - 1
        sib = proof[at:at + HEX * others]
        at += HEX * others
        node = _h(sib[:HEX * left] + node + sib[HEX * left:])
        out.append(node)
    return out


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes with their block and the key of the call that has it: groups of at most one block are packed together."""
    d = nodes.withColumn("blk", F.expr(f"idx div {size}"))
    return d.withColumn("k", F.when(F.col("total") > size, F.col("gid")).otherwise(-1 - F.expr(f"gid div {PACK}"))).withColumn("kb", F.col("blk"))


def _blocks(t: pa.Table) -> Iterator[pa.Table]:
    """The blocks of a call's rows, each in order."""
    t = t.sort_by([("gid", "ascending"), ("idx", "ascending")])
    gid = t.column("gid").to_pylist()
    cuts = [0, *[i for i in range(1, len(gid)) if gid[i] != gid[i - 1]], len(gid)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield t.slice(lo, hi - lo)


def _round(nodes: DataFrame, fan: int, height: int, paths: bool) -> DataFrame:
    """One round over (gid, idx, digest, total): a row for each node with its path to the block's root, or one for each block."""
    def run(t: pa.Table) -> pa.Table:
        rows = []
        for b in _blocks(t):
            gid, total, blk = b["gid"][0].as_py(), b["total"][0].as_py(), b["blk"][0].as_py()
            levels = _reduce([d.encode() for d in b["digest"].to_pylist()], total, fan, height)
            root = levels[-1][0].decode()
            for i, idx in enumerate(b["idx"].to_pylist() if paths else [blk]):
                proof, places = _path(levels, i, fan) if paths else (b"", "")
                rows.append((gid, idx, blk, total, proof.decode(), places, root))
        names = ["gid", "idx", "blk", "total", "proof", "places", "root"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return _blocked(nodes, fan ** height).groupBy("k", "kb").applyInArrow(run, _STEP)


def _above(done: DataFrame, size: int) -> DataFrame:
    """The nodes of the next round: the roots of the blocks."""
    return done.select("gid", F.col("blk").alias("idx"), F.col("root").alias("digest"), F.expr(f"cast(ceil(total / {size}) as bigint)").alias("total")).distinct()


def _climb(nodes: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds until every group has one node: the steps, and (gid, digest) of the roots."""
    steps = []
    while not nodes.where("total > 1").isEmpty():
        steps.append(cut_lineage(_round(nodes, fan, height, True)))
        nodes = cut_lineage(_above(steps[-1], fan ** height))
    return steps, nodes.select("gid", F.col("digest").alias("root"))


def _ordered(leaves: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves with gid, idx (place in the group's order) and total, by a range sort numbered per task."""
    o = [F.col(k).asc() for k in keys]
    at = cut_lineage(leaves.repartitionByRange(*o).sortWithinPartitions(*o).withColumn("__id", F.monotonically_increasing_id()))
    at = at.withColumn("__p", F.shiftright(F.col("__id"), 33))
    # A group's rows in one task are consecutive: one row for each such piece.
    pieces = at.groupBy("__p", "grp").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    w = Window.partitionBy("grp").orderBy("__p")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("__off", before - F.col("__first"))
    g = groups.select(F.col("grp").alias("__g"), "gid", "total")
    pieces = pieces.join(g, F.col("grp").eqNullSafe(F.col("__g"))).select(F.col("__p").alias("__q"), "__g", "__off", "gid", "total")
    return (at.join(pieces, (F.col("__p") == F.col("__q")) & F.col("grp").eqNullSafe(F.col("__g")))
            .withColumn("idx", F.col("__id") + F.col("__off")).drop("__id", "__p", "__q", "__g", "__off"))


def prove(docs: DataFrame, leaf: Column, altered: Column, id_col: str = "doc_id", group_col: str = "source", fan: int = 3, height: int = HEIGHT) -> DataFrame:
    """Every row's leaf, roots and inclusion proof, and the root of the version that its altered leaf makes.

    `leaf` and `altered` are digests (hex text); a null `altered` leaves the row as it is. Per group, leaves ascend by
    id; while more than one node remains, each `fan` consecutive ones (the last run may have fewer, even one) are
    replaced by the digest of their concatenation. The groups' roots, ordered by group, have a tree of the same kind.
    `height` levels are built in one call; it changes the cost and no result.

    Returns id, leaf, subroot, root, proof (the siblings' digests, level by level up to the root, left to right), places
    (for each level the leaf's place in its run and the run's size, as digits), folded_root (the root that the altered
    leaf, else the leaf itself, gives with the siblings: every row's proof is folded), verified (folded_root = root) and copied (number of nodes the version does not share; 0 for an unaltered row), one
    row per input row. A null group comes first and is a group of its own; null ids come first in it. Rows that repeat
    an id are leaves of their own, ordered by digest; equal rows get the places of their digest in any order. Texts may
    be of any length. Other columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    need(docs, id_col, group_col)
    refuse(not 2 <= fan <= 9, "fan must be 2 to 9")
    kind, size = docs.schema[id_col].dataType.simpleString(), fan ** height
    leaves = cut_lineage(docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"), altered.alias("changed")))
    groups = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    groups = cut_lineage(sorted_position(groups, "grp", [], "gid").withColumn("gid", F.col("gid") - 1))
    nodes = cut_lineage(_ordered(leaves, groups, ["grp", "id", "digest"]))

    first = cut_lineage(_round(nodes.select("gid", "idx", "digest", "total"), fan, height, False))
    steps, subroots = _climb(_above(first, size), fan, height)
    top = subroots.select(F.lit(0).cast("bigint").alias("gid"), F.col("gid").alias("idx"), F.col("root").alias("digest"), F.lit(groups.count()).cast("bigint").alias("total"))
    over, roots = _climb(top, fan, height)

    # Paths of the blocks' roots, from the top down: those of the subroots first, then round by round.
    up = roots.select("root", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("proof"), F.lit("").alias("places"))
    for step in reversed(over):
        s = step.select("idx", "blk", F.col("proof").alias("p"), F.col("places").alias("l"))
        up = s.join(up, s["blk"] == up["at"]).select("root", F.col("idx").alias("at"), F.concat("p", "proof").alias("proof"), F.concat("l", "places").alias("places"))
    sub = subroots.withColumnRenamed("root", "subroot")
    up = sub.join(up, sub["gid"] == up["at"]).select("gid", F.lit(0).cast("bigint").alias("at"), "subroot", "root", "proof", "places")
    for step in reversed(steps):
        s = step.select(F.col("gid").alias("g"), "idx", "blk", F.col("proof").alias("p"), F.col("places").alias("l"))
        up = (s.join(up, (s["g"] == up["gid"]) & (s["blk"] == up["at"]))
              .select("gid", F.col("idx").alias("at"), "subroot", "root", F.concat("p", "proof").alias("proof"), F.concat("l", "places").alias("places")))
    up = cut_lineage(up.join(groups.select(F.col("gid").alias("g"), "total"), F.col("g") == F.col("gid"))
                     .select("gid", (F.col("at") * size).alias("idx"), "total", "subroot", "root", "proof", "places"))

    def run(t: pa.Table, u: pa.Table) -> pa.Table:
        way = {r["gid"]: r for r in u.to_pylist()}
        cols: list[list] = [[] for _ in range(7)]
        done = []
        for b in _blocks(t):
            done.append(b.select(["id", "digest"]))
            w = way[b["gid"][0].as_py()]
            root, higher = w["root"], w["proof"].encode()
            digests = [d.encode() for d in b["digest"].to_pylist()]
            levels = _reduce(digests, b["total"][0].as_py(), fan, height)
            for i, new in enumerate(b["changed"].to_pylist()):
                proof, places = _path(levels, i, fan)
                proof, places = proof + higher, places + w["places"]
                start = digests[i] if new is None else new.encode()
                path = copied_path(start, proof, places)
                folded = (path[-1] if path else start).decode()
                for c, v in zip(cols, (w["subroot"], root, proof.decode(), places, folded, folded == root, 0 if new is None else len(path) + 1)):
                    c.append(v)
        if not done:
            return schema.empty_table()
        kept = pa.concat_tables(done)
        return pa.table([*kept.columns, *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:])]], schema=schema)

    kinds = [to_arrow_type(docs.schema[id_col].dataType), *[pa.string()] * 6, pa.bool_(), pa.int64()]
    names = ["id", "leaf", "subroot", "root", "proof", "places", "folded_root", "verified", "copied"]
    schema = pa.schema(list(zip(names, kinds)))
    left, right = _blocked(nodes, size).drop("grp").groupBy("k", "kb"), _blocked(up, size).groupBy("k", "kb")
    out = left.cogroup(right).applyInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof string, places string, folded_root string, verified boolean, copied bigint")
    return out.withColumnRenamed("id", id_col)
