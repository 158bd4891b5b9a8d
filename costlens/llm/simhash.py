"""Operator 9: near duplicates by SimHash, through an inverted index of byte positions with count filtering.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at
most three bits share at least five of them, so of either half's four bytes
three at least.  A posting is therefore one half without one position: eight
postings a fingerprint, and every pair to be found meets in one.  Where
fingerprints meet, the bytes they share are tallied, pairs with fewer than
five are dropped, and the rest are verified by their distance.

Postings with very many fingerprints are cut by two more of the five other
positions (five equal bytes in all); in what is then still large, neighbours
are looked up by flipping the few bits that differ at all.  So nothing is
capped, and no group sends more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.common import materialize, free_name, shuffle_partitions
from costlens.llm.components import components

BYTES = 8
LARGE = 1024  # a posting with more fingerprints than that is cut further


def simhash(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint (signed) of a text's shingles of `words` words; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: A-Z only; blanks 0x20 and 0x09 to 0x0D
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        h = [xxh64_intdigest(line, 42)]
        count, ones = 1, _ones(h)
    else:
        size = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
        end = np.cumsum(size)
        first, last = end - size, end - 1
        count = len(w) - words + 1
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, count, 1 << 16):
            to = min(count, at + (1 << 16))
            spans = zip(first[at:to].tolist(), last[at + words - 1 : to + words - 1].tolist())
            ones += _ones([xxh64_intdigest(line[a:b], 42) for a, b in spans])
    return int(np.packbits(2 * ones > count).view(">i8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit, the highest first."""
    h = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) of every row; a null or empty text has fingerprint 0."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(t.as_py() or b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], schema.names)

    return docs.select(docs[key].alias("key"), docs[text].cast("string").cast("binary").alias("text")).mapInArrow(
        run, schema
    )


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - position)).bitwiseAND(F.lit(255).cast("long"))


def _number(parts: list[Column], head: int) -> Column:
    """`head` and then the bytes of `parts`, as one number."""
    out = F.lit(head).cast("long")
    for p in parts:
        out = out * 256 + p
    return out


def _postings(classes: DataFrame) -> DataFrame:
    """(fp, posting): for either half, the half without one position."""
    fp = F.col("fp")
    posts = []
    for half in (range(4), range(4, 8)):
        for left_out in half:
            posts.append(_number([_byte(fp, p) for p in half if p != left_out], 1 + left_out))
    return classes.select("fp", F.explode(F.array(*posts)).alias("posting"))


def _finer(postings: DataFrame) -> DataFrame:
    """(fp, posting, more): each posting cut by every two of the five positions that it doesn't hold."""
    fp = F.col("fp")
    cases = F.lit(None).cast("array<long>")
    for left_out in range(BYTES):
        other = [left_out, *([4, 5, 6, 7] if left_out < 4 else [0, 1, 2, 3])]
        pairs = [_number([_byte(fp, p) for p in two], k + 1) for k, two in enumerate(combinations(other, 2))]
        cases = F.when(F.shiftrightunsigned("posting", 24) == left_out + 1, F.array(*pairs)).otherwise(cases)
    return postings.select("fp", "posting", F.explode(cases).alias("more"))


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; `root` leads to the least member of each set."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _link_groups(fp: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect the same fingerprints as all pairs of a group within `bits` do.

    `group` is sorted; a group shares at least three bytes.
    """
    values, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(values))
    least = BYTES - bits
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(group)])
    rest = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(begin, size))  # members from here on
    small = np.repeat(size <= 4 * LARGE, size)
    step, at = 1, np.flatnonzero(small)
    while True:
        at = at[rest[at] > step]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        some = tally >= least
        some[some] = np.bitwise_count(x[some]) <= bits
        _join_roots(root, node[at[some]], node[at[some] + step])
        step += 1
    for k in np.flatnonzero(size > 4 * LARGE):  # few bits differ at all: look neighbours up
        one = np.unique(fp[begin[k] : begin[k] + size[k]])
        place = np.searchsorted(values, one)
        differ = int(np.bitwise_or.reduce(one ^ one[0]))
        free = [1 << i for i in range(64) if differ >> i & 1]
        for n in range(1, bits + 1):
            for some in combinations(free, n):
                near = one ^ np.uint64(sum(some))
                j = np.minimum(np.searchsorted(one, near), len(one) - 1)
                hit = one[j] == near
                _join_roots(root, place[hit], place[j[hit]])
    loose = np.flatnonzero(root != np.arange(len(values)))
    return values[loose], values[root[loose]]


def _linked(postings: DataFrame, by: list[str], bits: int) -> DataFrame:
    """(a, b) links of all groups of `by`, taken from sorted partitions, whole groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def links(upto: int | None):
            fp, *keys = (np.concatenate(c) for c in zip(*held))
            new = np.zeros(len(fp), dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            end = len(fp) if upto is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
            held[:] = [(fp[end:], *(k[end:] for k in keys))] if end < len(fp) else []
            if not end:
                return None
            a, b = _link_groups(fp[:end].view(np.uint64), np.cumsum(new[:end]), bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        limit = 200_000
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            rows += batch.num_rows
            if rows >= limit:
                if (out := links(limit)) is not None:
                    yield out
                rows = sum(len(h[0]) for h in held)
                limit = max(200_000, 2 * rows)
        if held and (out := links(None)) is not None:
            yield out

    parts = shuffle_partitions(postings.sparkSession)
    return (
        postings.repartition(parts, *by).sortWithinPartitions(*by).select("fp", *by).mapInArrow(run, "a long, b long")
    )


def near_classes(found: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of `found` (key, fp); component_id: the least key."""
    if not 0 <= bits <= 3:
        raise ValueError("this index finds distances from 0 to 3")
    classes = materialize(found.groupBy("fp").agg(F.min("key").alias("least")))
    postings = _postings(classes)
    heavy = postings.groupBy("posting").count().where(F.col("count") > LARGE).select("posting")
    heavy = materialize(heavy)
    links = None
    if heavy.isEmpty():
        links = _linked(postings, ["posting"], bits)
    else:
        light = _linked(postings.join(heavy, "posting", "left_anti"), ["posting"], bits)
        cut = _finer(postings.join(heavy, "posting", "left_semi"))
        links = light.union(_linked(cut, ["posting", "more"], bits))
    roots = components(links)
    rooted = materialize(
        classes.join(roots, classes["fp"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "least"
        )
    )
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return materialize(rooted.join(names, "root").select("fp", "root", "component_id"))


def simhash_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """`key`, fingerprint, component_id of every row of `docs`.

    Texts link if their fingerprints differ in at most `bits` bits; component_id
    is the least key reachable by links.  Null and empty texts have fingerprint
    zero and link like any other.  Repeated rows and keys each get a row; null
    keys do too, and a component of null keys only has a null id.  An empty
    table gives an empty result; other columns are not read.
    """
    found = materialize(fingerprints(docs, key, text, words))
    classes = near_classes(found, bits).select("fp", "component_id")
    return found.join(classes, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3
) -> DataFrame:
    """One row of `docs` for each component: that with the least key; same columns.

    A key that repeats names every component it is the least of; of the rows
    that repeat it within one component any one stays.  Rows with a null key
    stay only where their component has no other key, one for each component.
    """
    found = materialize(fingerprints(docs, key, text, words))
    classes = near_classes(found, bits)
    named = found.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key stays if it names its component; with several rows, if one of them does.
    ids = found.join(classes.where("component_id is not null"), "fp").where("key = component_id").select("key").distinct()
    kept = materialize(ids.join(named.select("key", "n"), "key"))
    mark = free_name(docs, set(), "_kept")
    one = kept.where("n = 1").select(F.col("key").alias(mark))
    out = docs.join(one, docs[key] == one[mark], "left_semi")
    several = kept.where("n > 1").select(F.col("key").alias(mark))
    if not several.isEmpty():
        fp, root, name = (free_name(docs, {mark}, stem) for stem in ("_fp", "_root", "_name"))
        rows = docs.join(several, docs[key] == several[mark], "left_semi")
        least = classes.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(name))
        rows = _with_fingerprint(rows, text, fp, words).join(least, fp).where(F.col(key) == F.col(name))
        out = out.union(_one_each(rows, F.col(root), docs.columns))
    unnamed = classes.where("component_id is null").select("fp", "root")
    if not unnamed.isEmpty():
        root = free_name(docs, {mark}, "_root")
        rows = _with_fingerprint(docs.where(F.col(key).isNull()), text, mark, words)
        rows = rows.join(unnamed.select(F.col("fp").alias(mark), F.col("root").alias(root)), mark)
        out = out.union(_one_each(rows, F.col(root), docs.columns))
    return out


def _one_each(rows: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    kept = rows.groupBy(by.alias("by")).agg(F.first(whole).alias("row"))
    return kept.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)])


def _with_fingerprint(docs: DataFrame, text: str, name: str, words: int) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash((t.as_py() or "").encode(), words) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)
