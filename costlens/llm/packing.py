"""Operator 1: packing documents into sequences by length patterns and non-negative least squares.

Only the histogram of lengths (as many numbers as a sequence is long) comes to
the driver.  Patterns of few documents that fill a sequence are enumerated
over length bins, non-negative least squares fits how often each is repeated,
the counts are rounded down, and what is left is packed best fit, longest
first, into the patterns' gaps and new sequences.  All of that works on counts:
a row of the plan stands for a block of equal sequences, so its size depends on
the sequence length, not on the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.bpe import codec_of, read_tokenizer
from costlens.llm.common import materialize, shuffle_partitions

#: (length bins, most documents in a pattern): each is fitted, and the plan with the fewest sequences is taken.
GRIDS = ((128, 3), (32, 4), (256, 2), (64, 2))


def patterns(bins: int, most: int) -> list[tuple[int, ...]]:
    """All multisets of up to `most` bins that add up to `bins`, largest bin first."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, top: int) -> None:
        if rest == 0:
            out.append(head)
        elif len(head) < most:
            for b in range(min(top, rest), 0, -1):
                grow((*head, b), rest - b, b)

    grow((), bins, bins)
    return out


def fit_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that makes |a x - b| least: the active-set method, on the normal equations."""
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    used: list[int] = []
    slack = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        pull = target - gram @ x
        pull[used] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= slack:
            break
        used.append(best)
        while used:
            z = np.linalg.lstsq(gram[np.ix_(used, used)], target[used], rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[used] = z
                break
            now = x[used]
            bad = z <= 0
            step = min(1.0, float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min()))
            now = now + step * (z - now)
            now[bad & (now <= 1e-12)] = 0
            if not (now == 0).any():
                now[np.argmin(np.where(bad, now, np.inf))] = 0
            x[used] = now
            used = [u for u in used if x[u] > 0]
    return x


def plan(counts: np.ndarray, capacity: int, grids=GRIDS) -> tuple[np.ndarray, int]:
    """The plan of the grid with the fewest sequences; see `fitted`."""
    return min((fitted(counts, capacity, *g) for g in grids), key=lambda p: p[1])


def fitted(counts: np.ndarray, capacity: int, bins: int, most: int) -> tuple[np.ndarray, int]:
    """(rows, number of sequences).  counts[n]: pieces of length n, from 0 to `capacity`.

    A row (length, first, count, each, sequence, offset) places the pieces of a
    length with the ranks first to first + count - 1: `each` of them side by
    side from `offset` in every one of the sequences from `sequence` on.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, dtype=np.int64)  # ranks given out by length
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, copies: int, each: int, sequence: int, offset: int) -> None:
        rows.append((length, int(used[length]), copies * each, each, sequence, offset))
        used[length] += copies * each
        left[length] -= copies * each

    if left[capacity]:
        n = int(left[capacity])
        put(capacity, n, 1, 0, 0)
        sequences = n

    # blocks of equal sequences by the space left in each: space -> [(first sequence, copies)]
    open_by: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []

    def leave(space: int, sequence: int, copies: int) -> None:
        if space and copies:
            if space not in open_by:
                open_by[space] = []
                insort(spaces, space)
            open_by[space].append((sequence, copies))

    width = -(-capacity // bins)
    bins = capacity // width
    bin_of = np.minimum(-(-np.arange(capacity + 1) // width), bins)
    by_bin = np.bincount(bin_of, weights=left, minlength=bins + 1)[1:]
    if by_bin.sum():
        found = patterns(bins, most)
        a = np.zeros((bins, len(found)))
        for k, p in enumerate(found):
            for b in p:
                a[b - 1, k] += 1
        # what is left of long pieces costs most, as short ones fill any gap
        weight = np.sqrt(np.arange(1, bins + 1) / bins)
        x = fit_counts(a * weight[:, None], by_bin * weight)
        for k in np.argsort(-x, kind="stable"):
            slots = found[k]
            have = np.bincount(bin_of, weights=left, minlength=bins + 1).astype(np.int64)
            copies = min(int(x[k]), *(int(have[b]) // slots.count(b) for b in slots))
            while copies > 0:
                # Each slot takes its bin's longest piece; the last takes the longest that
                # fits beside them, as bins are rounded up and leave a little more room.
                chosen: list[int] = []
                n = copies
                for place, b in enumerate(slots):
                    last = place == len(slots) - 1
                    top = min(capacity - sum(chosen) if last else b * width, capacity - 1)
                    while left[top] <= chosen.count(top):
                        top -= 1
                    chosen.append(top)
                for c in set(chosen):
                    n = min(n, int(left[c]) // chosen.count(c))
                offset = 0
                for c in chosen:
                    put(c, n, 1, sequences, offset)
                    offset += c
                leave(capacity - offset, sequences, n)
                sequences += n
                copies -= n

    for length in range(capacity - 1, 0, -1):
        while left[length]:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, copies = open_by[space].pop()
                if not open_by[space]:
                    del open_by[space], spaces[at]
            else:
                space = capacity
                copies = -(-int(left[length]) // (capacity // length))
                first = sequences
                sequences += copies
            each = min(space // length, int(left[length]))
            full = min(copies, int(left[length]) // each)
            put(length, full, each, first, capacity - space)
            leave(space - length * each, first, full)
            first, copies = first + full, copies - full
            rest = int(left[length])
            if copies and rest and rest < each:
                put(length, 1, rest, first, capacity - space)
                leave(space - length * rest, first, 1)
                first, copies = first + 1, copies - 1
            leave(space, first, copies)
    return np.array(rows, dtype=np.int64).reshape(-1, 6), sequences


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key`, piece, start, length, ids_crc32, turn of every piece; only documents over `capacity` ids are cut.

    A document is its text's ids, then `end_id`; a null or empty text is
    `end_id` alone.  turn: a running number within the input partition.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("turn", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        last = np.array([end_id], dtype="<u4").tobytes()
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for k, ids in enumerate(codec.encode_all([t or "" for t in part.column(1).to_pylist()])):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        rows.append((k, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
                of, *cols = (np.array(c, dtype=np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(of)),
                        pa.array(cols[0].astype(np.int32)),
                        *(pa.array(c) for c in cols[1:]),
                        pa.array(turn + np.arange(len(of))),
                    ],
                    schema.names,
                )
                turn += len(of)

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """`pieces` (with length from 1 to `capacity`, and turn) with sequence_id and offset.

    Every piece gets a place; sequences are gapless from 0 and no longer than
    `capacity`.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    # One number per length: at most `capacity` rows.
    histogram = pieces.groupBy("length").count().limit(capacity + 1).toArrow()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    lengths = histogram.column("length").to_numpy()
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts[lengths] = histogram.column("count").to_numpy()
    rows, _ = plan(counts, capacity)

    # Ranks within a length: frequent lengths are dealt into several groups by the running number,
    # so that no group is larger than a fraction of a task's share.
    share = max(1, int(counts.sum()) // (4 * shuffle_partitions(spark)))
    groups = np.maximum(1, -(-counts // share))
    per = spark.createDataFrame(
        pa.table({"length": pa.array(lengths), "groups": pa.array(groups[lengths])}).to_pandas(),
        "length long, groups long",
    )
    dealt = pieces.join(F.broadcast(per), "length").withColumn("deal", F.pmod("turn", "groups"))
    sizes = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))  # at most capacity + 4 x partitions rows
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "deal").orderBy("turn", "key", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(
        F.broadcast(firsts), ["length", "deal"]
    )

    # The plan's rows, sorted by length and rank, as one sorted number each.
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else rows
    sent = spark.sparkContext.broadcast(rows)
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, each, sequence, offset = sent.value.T
        edges = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("global_rank")).to_numpy()
            k = np.empty(len(n), dtype=np.int64)
            order = np.argsort(n, kind="stable")
            cut = np.flatnonzero(np.diff(n[order], prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(n)]):
                one = order[lo:hi]
                a, b = edges[n[one[0]]], edges[n[one[0]] + 1]
                k[one] = a + np.searchsorted(first[a:b], rank[one], side="right") - 1
            turn = rank - first[k]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in names),
                    pa.array(sequence[k] + turn // each[k]),
                    pa.array(offset[k] + turn % each[k] * n),
                ],
                schema.names,
            )

    return ranked.select(*names, (F.col("first") + F.col("rank")).alias("global_rank")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key`, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null or empty texts hold the end id alone; null keys and repeated rows are
    documents of their own; an empty table gives an empty result; other columns
    are not read.
    """
    packed = pack(token_pieces(docs, tokenizer, capacity, end_id, key, text), capacity)
    return packed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequence_fill(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """sequences, tokens and the share of `capacity` that they fill."""
    total = F.sum("length")
    n = F.max("sequence_id") + 1
    return packed.agg(n.alias("sequences"), total.alias("tokens"), F.try_divide(total, n * capacity).alias("fill"))
