"""Operator 5: near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis it then lies closest to, with its sign.
Several such hashes make a bucket of a table; a vector also goes to the
buckets of its next-best axes (multiprobe).  Pairs that meet in a bucket are
verified by their cosine in double precision.

Equal vectors are one class first, so copies are never paired.  Where few
classes meet, their pairs are decided from 8-bit vectors with a bound on their
error; what the bound leaves open is decided from the vectors.

A class in a large bucket belongs to the group of its least large bucket; a
group is cut into chunks, and two groups are compared, chunk against chunk, if
members of them meet in a large bucket.  So a pair is compared once, however
many buckets it shares, and a chunk of vectors goes to each comparison once,
where one matrix product gives the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.common import materialize, shuffle_partitions
from costlens.llm.components import components

TABLES = 12  # at least
PROBES = 3
RECALL = 0.995  # of pairs at the threshold, by which the tables are counted
SMALL = 64  # classes of a bucket whose pairs are looked at one by one
CHUNK = 2048  # classes of a group that are compared at a time


def _sylvester(n: int) -> np.ndarray:
    out = np.ones((1, 1))
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two.

    The butterflies are done eight at a time, as products with the transform of that width.
    """
    n, d = x.shape
    step = 1
    while step < d:
        wide = min(8, d // step)
        h = _sylvester(wide)
        if step == 1:
            x = x.reshape(-1, wide) @ h
        else:
            x = np.matmul(h, x.reshape(-1, wide, step))
        step *= wide
    return x.reshape(n, d) / math.sqrt(d)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 5) -> np.ndarray:
    """(rows, tables, probes) bucket numbers, the best bucket first.

    The other probes replace, one at a time, the axis that is closest to its
    runner-up by the runner-up.
    """
    n, d = x.shape
    width = 1 << max(0, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), dtype=np.int64)
    for t in range(tables):
        first = np.empty((n, hashes), dtype=np.int64)
        second = np.empty((n, hashes), dtype=np.int64)
        gap = np.empty((n, hashes))
        for h in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
            size = np.abs(y)
            rows = np.arange(n)
            a = size.argmax(axis=1)
            first[:, h] = 2 * a + (y[rows, a] < 0)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(axis=1)
            second[:, h] = 2 * b + (y[rows, b] < 0)
            gap[:, h] = top - size[rows, b]
        base = (2 * width) ** np.arange(hashes, dtype=np.int64)
        out[:, t, 0] = first @ base
        by = np.argsort(gap, axis=1)
        for p in range(1, probes):
            turn = by[:, (p - 1) % hashes]
            if p - 1 < hashes:
                new = first.copy()
                new[np.arange(n), turn] = second[np.arange(n), turn]
            else:  # two axes at once
                new = first.copy()
                for k in (by[:, 0], by[:, (p - hashes) % hashes]):
                    new[np.arange(n), k] = second[np.arange(n), k]
            out[:, t, p] = new @ base
    return out


def tables_for(hashes: int, d: int, threshold: float, probes: int = PROBES, recall: float = RECALL) -> int:
    """How many tables find `recall` of the pairs of `d` components at a cosine of `threshold`.

    The share that one table finds is counted on random pairs at that cosine,
    less two standard errors.
    """
    if d < 2:
        return TABLES  # cosines are 1 and -1 only
    c, n = min(max(threshold, -1.0), 1.0), max(128, min(2000, 200_000 // d))
    rng = np.random.default_rng(17)
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (bucket_codes(v, TABLES, hashes, probes) for v in (a, c * a + math.sqrt(1 - c * c) * b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3))
    share = met.mean() - 2 * math.sqrt(met.mean() * (1 - met.mean()) / met.size)
    if share >= recall:
        return TABLES
    if share <= 0:
        raise ValueError("too few pairs at this threshold share a bucket")
    return max(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _unit(values: list) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    tables: int | None = None,
    probes: int = PROBES,
) -> DataFrame:
    """`key`, n_links, component_id, kept of every row of `vectors`.

    Links: pairs found with cosine >= `threshold`, never one below it.  Vectors
    that are null, empty or zero, or hold a null or non-finite component, link
    with nothing; vectors of different lengths don't link.  Without `tables`,
    as many are used as find RECALL of the pairs at the threshold.  Equal vectors link
    whatever the tables.  Repeated rows count as vectors of their own; rows
    that share a key get the same component's name.  A null key gets a row; a
    component of null keys has a null name and keeps its rows.  An empty table
    gives an empty result; other columns are not read.
    """
    v = F.col("v")
    rows = vectors.select(vectors[key].alias("key"), vectors[vector].cast("array<double>").alias("v"))
    fine = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0),
        F.lit(False),
    )
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("v", F.when(fine, F.transform(v, lambda c: c + F.lit(0.0))))
    rows = materialize(rows.withColumn("c", F.when(v.isNotNull(), F.xxhash64(v))))
    classes = rows.where("v is not null").groupBy("c", "v").agg(
        F.count(F.lit(1)).alias("weight"), F.min("key").alias("least")
    )
    # Hashes of different vectors may meet; a class is named by a number of its own.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    shapes = classes.select(F.size("v").alias("d")).agg(F.max("d").alias("d")).first()["d"] or 1
    width = 1 << max(0, (int(shapes) - 1).bit_length())
    # At least as many buckets in a table as entries.
    hashes = max(3, math.ceil(math.log(max(n, 2) * probes) / math.log(2 * width)))
    if tables is None:
        tables = tables_for(hashes, int(shapes), threshold, probes)

    spread = materialize(_spread(classes, tables, hashes, probes))
    entries = spread.select("node", "d", F.explode(F.array_distinct("buckets")).alias("bucket"))
    sizes = entries.groupBy("d", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # only what shares a bucket is compared
    shared = materialize(entries.join(sizes, ["d", "bucket"]))
    leaders, meeting = _groups(shared.where(F.col("size") > SMALL))
    many = materialize(_between_chunks(spread, leaders, meeting, threshold))
    few = materialize(_unless_grouped(_within_buckets(spread, shared.where(F.col("size") <= SMALL), threshold), leaders, meeting))
    links = many.select("node", "links").union(few.select("a", "wb")).union(few.select("b", "wa"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    edges = many.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(few.select("a", "b"))
    roots = components(edges)
    named = materialize(
        classes.select("node", "c", "v", "weight", "least")
        .join(counted, "node", "left")
        .join(roots, "node", "left")
        .select("c", "v", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = materialize(named.join(least, "root").select("c", "v", "weight", "links", "component_id"))
    linked = rows.where("v is not null").join(named, ["c", "v"]).select(
        "key", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    alone = rows.where("v is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(
        F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _spread(classes: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """(node, weight, d, v, small, scale, error, buckets) of `classes` (node, weight, v).

    v: the unit vector; small x scale: its 8-bit form, `error` away from it.
    """
    slots = tables * probes
    schema = T.StructType(
        [
            T.StructField("node", T.LongType()),
            T.StructField("weight", T.LongType()),
            T.StructField("d", T.IntegerType()),
            T.StructField("v", T.ArrayType(T.DoubleType())),
            T.StructField("small", T.BinaryType()),
            T.StructField("scale", T.DoubleType()),
            T.StructField("error", T.DoubleType()),
            T.StructField("buckets", T.ArrayType(T.LongType())),
        ]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            lengths = np.array([len(x) for x in values], dtype=np.int32)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = _unit([values[i] for i in at])
                codes = bucket_codes(x, tables, hashes, probes).reshape(len(at), slots)
                table = np.arange(slots) // probes
                with np.errstate(over="ignore"):  # one number: table, bucket
                    mixed = (codes * max(64, tables) + table) * np.int64(0x9E3779B97F4A7C15 - (1 << 64))
                scale = np.abs(x).max(axis=1) / 127
                small = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.sqrt(((x - small * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)),
                        batch.column(1).take(pa.array(at)),
                        pa.array(lengths[at]),
                        pa.array(list(x), pa.list_(pa.float64())),
                        pa.array([r.tobytes() for r in small], pa.binary()),
                        pa.array(scale),
                        pa.array(error),
                        pa.array(list(mixed), pa.list_(pa.int64())),
                    ],
                    schema.names,
                )

    return classes.select("node", "weight", "v").mapInArrow(place, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are ordered by `by`, about `rows` rows each or one larger group."""
    held: list[pa.RecordBatch] = []
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            held.append(batch.slice(at, 4096))
            seen += held[-1].num_rows
            if seen >= rows:
                whole = pa.Table.from_batches(held)
                end = int(np.flatnonzero(_starts(whole, by))[-1])
                if end:
                    yield whole.slice(0, end)
                held = whole.slice(end).to_batches()
                seen = whole.num_rows - end
    if seen:
        yield pa.Table.from_batches(held)


def _starts(cells: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(cells.num_rows, dtype=bool)
    new[:1] = True
    for c in by:
        k = cells.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    return new


def _within_buckets(spread: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """(a, b, wa, wb): linked pairs a < b with their weights, each once, of the classes that meet in small buckets."""
    by = ["d", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, by, 16_384):
            length = whole.column("d").to_numpy()
            for d in np.unique(length):
                yield from pairs(whole.filter(pa.array(length == d)), int(d))

    def pairs(one: pa.Table, d: int) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(one.column("small").to_pylist()), dtype=np.int8).reshape(-1, d).astype(np.float32)
        node, weight, scale, error = (one.column(c).to_numpy() for c in ("node", "weight", "scale", "error"))
        begin = np.flatnonzero(_starts(one, by))
        size = np.diff(np.r_[begin, one.num_rows])
        rest = np.repeat(size, size) - (np.arange(one.num_rows) - np.repeat(begin, size))
        at, step = np.arange(one.num_rows), 1
        while True:
            at = at[rest[at] > step]
            if not len(at):
                return
            i, j = at, at + step
            near = np.einsum("ij,ij->i", x[i], x[j]).astype(np.float64) * scale[i] * scale[j]
            bound = error[i] + (1 + error[i]) * error[j] + 1e-6 * d  # and what 32-bit sums may lose
            some = near + bound >= threshold
            i, j, sure = i[some], j[some], (near - bound >= threshold)[some]
            turn = node[i] > node[j]
            a, b = np.where(turn, j, i), np.where(turn, i, j)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v) for v in (node[a], node[b], weight[a], weight[b], sure))], ["a", "b", "wa", "wb", "sure"]
            )
            step += 1

    parts = shuffle_partitions(spread.sparkSession)
    met = shared.select("node", "d", "bucket").join(spread.select("node", "weight", "small", "scale", "error"), "node")
    dealt = met.repartition(parts, *by).sortWithinPartitions(*by)
    found = dealt.mapInArrow(run, "a long, b long, wa long, wb long, sure boolean")
    found = materialize(found.groupBy("a", "b").agg(F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.first("sure").alias("sure")))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [
                float((np.asarray(x.values) * np.asarray(y.values)).sum()) >= threshold
                for x, y in zip(batch.column(4), batch.column(5))
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "wa", "wb"]).filter(pa.array(fine, pa.bool_()))

    vectors = spread.select("node", "v")
    left = vectors.select(F.col("node").alias("a"), F.col("v").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("v").alias("y"))
    open_ = found.where("not sure").join(left, "a").join(right, "b").select("a", "b", "wa", "wb", "x", "y")
    return found.where("sure").select("a", "b", "wa", "wb").union(open_.mapInArrow(exact, "a long, b long, wa long, wb long"))


def _groups(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, d, leader) of the classes in large buckets, and (d, p, q) of the groups p <= q that meet in one.

    From keys alone.  A class's leader is its least large bucket, so the
    classes of a large bucket belong to few groups.
    """
    leaders = materialize(shared.groupBy("node", "d").agg(F.min("bucket").alias("leader")))
    there = shared.join(leaders, ["node", "d"]).select("d", "bucket", "leader").distinct()
    one, two = there.withColumnRenamed("leader", "p"), there.withColumnRenamed("leader", "q")
    meeting = one.join(two, ["d", "bucket"]).where("p <= q").select("d", "p", "q").distinct()
    return leaders, materialize(meeting)


def _unless_grouped(pairs: DataFrame, leaders: DataFrame, meeting: DataFrame) -> DataFrame:
    """`pairs` without those whose groups are compared anyhow."""
    one = leaders.select(F.col("node").alias("a"), F.col("d"), F.col("leader").alias("la"))
    two = leaders.select(F.col("node").alias("b"), F.col("leader").alias("lb"))
    told = pairs.join(one, "a", "left").join(two, "b", "left")
    told = told.withColumn("p", F.when(F.col("lb").isNotNull(), F.least("la", "lb")))
    told = told.withColumn("q", F.when(F.col("la").isNotNull(), F.greatest("la", "lb")))
    return told.join(meeting, ["d", "p", "q"], "left_anti").select("a", "b", "wa", "wb")


def _between_chunks(spread: DataFrame, leaders: DataFrame, meeting: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) from the pairs of the groups that meet: counts, and a link that joins each linked class.

    A cell is two chunks (or one with itself), compared by one matrix product in a task's memory.
    """
    sizes = leaders.groupBy("d", "leader").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    sizes = materialize(sizes)
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    members = leaders.join(sizes, ["d", "leader"]).select("node", "d", "leader", chunk)
    of = lambda c, n: sizes.select("d", F.col("leader").alias(c), F.col("chunks").alias(n))
    cells = meeting.join(of("p", "np"), ["d", "p"]).join(of("q", "nq"), ["d", "q"])
    cells = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).where("p < q or i <= j")
    cells = cells.select("d", "p", "q", "i", "j")
    first = cells.select("*", F.col("p").alias("leader"), F.col("i").alias("chunk"), F.lit(0).alias("side"))
    second = cells.where("p < q or i < j").select("*", F.col("q").alias("leader"), F.col("j").alias("chunk"), F.lit(1).alias("side"))
    by = ["d", "p", "q", "i", "j"]
    dealt = first.union(second).join(members, ["d", "leader", "chunk"]).join(spread.select("node", "weight", "v"), "node")
    dealt = dealt.select(*by, "side", "node", "weight", "v")
    dealt = dealt.repartition(shuffle_partitions(spread.sparkSession), *by).sortWithinPartitions(*by, "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, by, 2 * CHUNK):
            begin = np.flatnonzero(_starts(whole, by))
            for lo, hi in zip(begin, np.r_[begin[1:], whole.num_rows]):
                yield compare(whole.slice(lo, hi - lo))

    def compare(cell: pa.Table) -> pa.RecordBatch:
        node, weight, side = (cell.column(c).to_numpy() for c in ("node", "weight", "side"))
        x = cell.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        n = int((side == 0).sum())
        if n == len(node):  # a chunk with itself
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            links, root = linked @ weight, _least_reached(linked, True)
        else:
            linked = x[:n] @ x[n:].T >= threshold
            links = np.r_[linked @ weight[n:], linked.T @ weight[:n]]
            root = _least_reached(linked, False)
        some = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["node", "links", "root"]
        )

    return dealt.mapInArrow(run, "node long, links long, root long")


def _least_reached(linked: np.ndarray, same: bool) -> np.ndarray:
    """The least place that each place reaches by links; `same`: rows and columns are the same places, else columns follow the rows."""
    n = linked.shape[0]
    most = np.iinfo(np.int64).max
    root = np.arange(n if same else n + linked.shape[1])
    while True:
        left, right = (root, root) if same else (root[:n], root[n:])
        now = np.minimum(left, np.where(linked, right, most).min(axis=1, initial=most))
        if not same:
            now = np.r_[now, np.minimum(right, np.where(linked, now[:, None], most).min(axis=0, initial=most))]
        np.minimum.at(now, root, now.copy())  # what a place's root is reached by
        now = np.minimum(now, now[now])
        if (now == root).all():
            return root
        root = now
