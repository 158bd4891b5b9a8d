"""Operator 11: a Merkle manifest of a dataset, its trees kept in van Emde Boas order.

Every row is a leaf; the leaves of a source, in the order of their keys, make a
16-ary tree, and the roots of the sources, in the order of their names, make
one more.  A tree is stored as aligned subtrees (blocks) of HEIGHT levels: one
row each, its digests laid out by halving the height again and again, so a run
of siblings and its parent lie together at every scale.  Address arithmetic
finds any node of a block from its level and number.  The roots of the blocks
are the leaves of the blocks above, and so on until one node is left.

Ranks come from one range-partitioned sort of key and digest, so neither a
source nor a key with very many rows is ever one task; texts are read once and
never shuffled.  A task holds one block and the digests of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.common import materialize, shuffle_partitions

ARITY = 16
HEIGHT = 3  # hashing levels of a block: at most 4096 leaves, 4369 nodes
LEAVES = ARITY**HEIGHT


def size(leaves, height: int):
    """Nodes of a left-packed subtree of so many leaves and so many levels above them."""
    return sum(-(-leaves // ARITY**k) for k in range(height + 1))


def address(level: int, index, leaves, height: int):
    """Place of the nodes `index` of a level (0: leaves) in the van Emde Boas layout of their subtree.

    The upper half of the levels is stored first, then each subtree of the
    lower half, all in the same way.  All subtrees but the last are full, so a
    place is a sum of known sizes.  index and leaves: numbers or arrays.
    """
    if height == 0:
        return index * 0
    low = (height + 1) // 2  # levels of the lower half
    tops = -(-leaves // ARITY**low)
    if level >= low:
        return address(level - low, index, tops, height - low)
    full = ARITY ** (low - 1)
    below = ARITY ** (low - 1 - level)  # nodes of this level in a full lower subtree
    which = index // below
    own = np.minimum(full, leaves - which * full)
    return size(tops, height - low) + which * size(full, low - 1) + address(level, index % below, own, low - 1)


def levels_for(n: int, most: int = HEIGHT) -> int:
    """Hashing levels that bring n nodes down to one; `most` at the most."""
    k = 0
    while k < most and ARITY**k < n:
        k += 1
    return k


def lay_out(digests: bytes, height: int) -> bytes:
    """The nodes of a block, 32 bytes each in van Emde Boas order, from its leaves in their order."""
    leaves = len(digests) // 32
    nodes = np.empty(size(leaves, height), dtype="V32")
    now = digests
    for level in range(height + 1):
        count = len(now) // 32
        nodes[address(level, np.arange(count), leaves, height)] = np.frombuffer(now, dtype="V32")
        text = now.hex().encode()
        run = 64 * ARITY
        if level < height:
            now = b"".join(hashlib.sha256(text[at : at + run]).digest() for at in range(0, len(text), run))
    return nodes.tobytes()


def level_text(nodes: bytes, level: int, leaves: int, height: int) -> bytes:
    """The digests of one level of a block, in order, as hex text."""
    places = address(level, np.arange(-(-leaves // ARITY**level)), leaves, height)
    return np.frombuffer(nodes, dtype="V32")[places].tobytes().hex().encode()


def sides(texts: list[bytes], index: int) -> tuple[list[bytes], list[bytes]]:
    """Digests left and right of a leaf's path in its runs, level by level, below the root of the block."""
    left, right = [], []
    for text in texts:
        own, begin = index * 64, index // ARITY * ARITY * 64
        left.append(text[begin:own])
        right.append(text[own + 64 : begin + ARITY * 64])
        index //= ARITY
    return left, right


def fold(digest: bytes, left: list[bytes], right: list[bytes]) -> bytes:
    """The root (hex text) that a leaf (hex text) and its siblings lead to."""
    for a, b in zip(left, right):
        digest = hashlib.sha256(a + digest + b).hexdigest().encode()
    return digest


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 (32 bytes) of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    told = []
    for c in columns:
        s = c.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*told), 256))


@dataclass
class Manifest:
    """rows: key, tree, rank, block, leaf, presented; levels: blocks of each height of the sources' trees;
    tops: those of the tree over the sources; sources: tree, rank, subroot."""

    rows: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]
    sources: DataFrame
    key: str


def _tree(group: Column) -> Column:
    """A name that isn't null and sorts like the group: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` with rank (from 0, within `tree`) and n (nodes of the tree).

    One sort by range over all trees at once; each part numbers its own rows,
    and the counts of the parts give where its numbers begin.
    """
    spark = nodes.sparkSession
    by = ["tree", *order]
    dealt = nodes.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    schema = T.StructType([*nodes.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    at = nodes.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            runs = batch.column(at).dictionary_encode()
            code = runs.indices.to_numpy()
            begin = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1] if len(code) else np.empty(0, dtype=int)
            length = np.diff(np.r_[begin, len(code)])
            first = np.zeros(len(begin), dtype=np.int64)
            if len(begin) and runs.dictionary[code[0]].as_py() == last:
                first[0] = seen
            local = np.arange(len(code)) - np.repeat(begin - first, length)
            if len(begin):
                last, seen = runs.dictionary[code[-1]].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(code), part, dtype=np.int32)), pa.array(local, pa.int64())],
                schema.names,
            )

    numbered = materialize(dealt.mapInArrow(number, schema))
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))  # a tree's parts, or a part's trees
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        counts.select(
            "tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(whole).alias("n")
        )
    )
    return numbered.join(starts, ["tree", "part"]).select(
        *nodes.columns, (F.col("first") + F.col("local")).alias("rank"), "n"
    )


_BLOCK = "tree string, n long, block long, leaves int, height int, nodes binary"


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of `nodes` (tree, n, rank, digest)."""

    def build(key: tuple, t: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        n = t.column("n")[0].as_py()
        t = t.sort_by("rank")
        leaves, height = b"".join(t.column("digest").to_pylist()), levels_for(n)
        row = {"tree": [tree], "n": [n], "block": [block], "leaves": pa.array([t.num_rows], pa.int32())}
        return pa.table(row | {"height": pa.array([height], pa.int32()), "nodes": [lay_out(leaves, height)]})

    cut = nodes.select("tree", F.floor(F.col("rank") / LEAVES).cast("long").alias("block"), "rank", "n", "digest")
    return cut.groupBy("tree", "block").applyInArrow(build, _BLOCK)


def _root() -> Column:
    """The digest of a block's root: the first node of the layout."""
    return F.substring("nodes", 1, 32)


def _build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each height, (tree, digest) of the roots) for `nodes` (tree, n, rank, digest)."""
    levels, roots = [], None
    while True:
        blocks = materialize(_blocks(nodes))
        levels.append(blocks)
        done = blocks.where(F.col("n") <= LEAVES).select("tree", _root().alias("digest"))
        roots = done if roots is None else roots.union(done)
        most = blocks.agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= LEAVES:
            return levels, roots
        nodes = blocks.where(F.col("n") > LEAVES).select(
            "tree", F.ceil(F.col("n") / LEAVES).alias("n"), F.col("block").alias("rank"), _root().alias("digest")
        )


_PATH = "tree string, rank long, left array<binary>, right array<binary>, subroot binary, root binary"


def _with_paths(blocks: DataFrame, above: DataFrame | None, ends: DataFrame) -> DataFrame:
    """Blocks with the path of their root: from the blocks above, or from `ends` where the root is the tree's."""
    paths = ends.select("tree", F.lit(0).cast("long").alias("block"), "left", "right", "subroot", "root", F.lit(True).alias("end"))
    if above is not None:
        paths = paths.union(
            above.select("tree", F.col("rank").alias("block"), "left", "right", "subroot", "root", F.lit(False))
        )
    # block 0 of a high tree has a row in `ends` as well, which is the path of its tree's root
    end = (F.col("n") <= LEAVES).alias("end")
    return blocks.withColumn("end", end).join(paths, ["tree", "block", "end"]).drop("end")


def _paths(levels: list[DataFrame], ends: DataFrame, down_to: int) -> DataFrame:
    """(tree, rank, left, right, subroot, root) of the leaves of the blocks of height `down_to`, top down."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                texts = [level_text(r["nodes"], k, r["leaves"], r["height"]) for k in range(r["height"])]
                for lo in range(0, r["leaves"], 256):
                    some = range(lo, min(lo + 256, r["leaves"]))
                    own = [sides(texts, i) for i in some]
                    k = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["tree"]] * k, pa.string()),
                            pa.array([r["block"] * LEAVES + i for i in some], pa.int64()),
                            pa.array([a + r["left"] for a, _ in own], pa.list_(pa.binary())),
                            pa.array([b + r["right"] for _, b in own], pa.list_(pa.binary())),
                            pa.array([r["subroot"]] * k, pa.binary()),
                            pa.array([r["root"]] * k, pa.binary()),
                        ],
                        ["tree", "rank", "left", "right", "subroot", "root"],
                    )

    above = None
    for blocks in reversed(levels[down_to:]):
        above = materialize(_with_paths(blocks, above, ends).mapInArrow(walk, _PATH))
    return above


def build_manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    presented: Column | None = None,
) -> Manifest:
    """The manifest of `docs`: a leaf for every row, of its `fields`.

    presented: a digest (32 bytes) to be folded in place of a row's leaf where
    it isn't null, as `leaf_digest` gives for other values.  A null key goes
    first in its source, rows with the same key are ordered by digest; a null
    source is a tree of its own and goes first.  Repeated rows are leaves of
    their own.  An empty table has no tree.  Other columns are not read.
    """
    leaf = leaf_digest([docs[f] for f in fields])
    other = F.lit(None).cast("binary") if presented is None else presented
    narrow = docs.select(
        _tree(docs[group]).alias("tree"),
        docs[key].alias("key"),
        leaf.alias("digest"),
        other.alias("presented"),
        F.monotonically_increasing_id().alias("id"),  # rows that are alike in all else still spread
    )
    rows = _ranked(materialize(narrow), ["key", "digest", "id"])
    rows = materialize(rows.select("tree", "key", "digest", "presented", "rank", "n"))
    levels, roots = _build(rows)
    sources = _ranked(materialize(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")), ["name"])
    sources = materialize(sources)
    tops, _ = _build(sources.select("tree", "n", "rank", "digest"))
    return Manifest(rows, levels, tops, sources.select(F.col("name").alias("tree"), "rank", F.col("digest").alias("subroot")), key)


def prove(manifest: Manifest) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is the digests of the path's siblings, level by level from the
    leaf to the root, left to right; its sha256 is given.  folded_root is what
    the presented digest (or else the leaf) and these siblings lead to, and
    verified tells whether that is the root.
    """
    root = manifest.tops[-1].where(F.col("n") <= LEAVES).select("tree", _root().alias("root"))
    none = F.array().cast("array<binary>")
    whole = root.select("tree", none.alias("left"), none.alias("right"), F.col("root").alias("subroot"), "root")
    over = _paths(manifest.tops, whole, 0)  # of the sources' roots
    ends = materialize(manifest.sources.join(over.select("rank", "left", "right", "root"), "rank").drop("rank"))
    above = _paths(manifest.levels, ends, 1) if len(manifest.levels) > 1 else None
    blocks = _with_paths(manifest.levels[0], above, ends)
    rows = manifest.rows.select(
        "tree", F.floor(F.col("rank") / LEAVES).cast("long").alias("block"), "rank", "key", "presented"
    )
    key = T.StructField(manifest.key, manifest.rows.schema["key"].dataType)
    told = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([key, *[T.StructField(c, T.StringType()) for c in told], T.StructField("verified", T.BooleanType())])

    def check(_: tuple, here: pa.Table, block: pa.Table) -> pa.Table:
        b = block.to_pylist()[0]
        here = here.sort_by("rank")
        texts = [level_text(b["nodes"], k, b["leaves"], b["height"]) for k in range(b["height"])]
        leaves = level_text(b["nodes"], 0, b["leaves"], b["height"])
        first = b["block"] * LEAVES
        sub, top = b["subroot"].hex(), b["root"].hex()
        rest = b"".join(x + y for x, y in zip(b["left"], b["right"]))
        out: list[list] = [[], [], []]
        for rank, shown in zip(here.column("rank").to_pylist(), here.column("presented").to_pylist()):
            i = rank - first
            left, right = sides(texts, i)
            proof = hashlib.sha256(b"".join(x + y for x, y in zip(left, right)) + rest).hexdigest()
            leaf = leaves[64 * i : 64 * i + 64]
            begin = leaf if shown is None else shown.hex().encode()
            out[0].append(leaf.decode())
            out[1].append(proof)
            out[2].append(fold(begin, left + b["left"], right + b["right"]).decode())
        n = here.num_rows
        cols = [out[0], [sub] * n, [top] * n, out[1], out[2], [x == top for x in out[2]]]
        return pa.table(dict(zip(schema.names, [here.column("key"), *cols])))

    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(check, schema)
