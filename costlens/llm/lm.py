"""Operator 4: Brown class-based n-grams.

Exchange clustering assigns every training word to a class so that the class
bigrams explain the training text best; a text's probability is the product of
class transitions and of word emissions.

* The TYPES most frequent words are exchanged one by one, on their bigrams.
* The other words of the FREQUENT most frequent ones start in a class of
  unassigned words; in each of ROUNDS rounds Spark sums every word's own
  neighbours by class, and the word moves to the class that raises the
  likelihood most, the class bigrams being broadcast.
* Each rarer word moves out of the unassigned class in the same way, by its own
  neighbours, where its occurrences are gathered.

A neighbour counts by its class if it is a type or was seen SEEN times, else as
unassigned: classes of rarer words were fitted to the very pairs that they would
then explain, and held-out text gets less likely (README has figures).

Only words that training text doesn't hold have no neighbours: their class is
the one that most once-seen words of their shape (last letters) have.  The
corpus is encoded once (numbers of the frequent words, the rare words as they
are); what follows reads that.  Numbers and counts of the FREQUENT words, of
bounded size, are broadcast; rare words meet their counts in one shuffle.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from costlens.llm.common import materialize, shuffle_partitions, worker_cache
from costlens.session import scratch_table

END = b"\n"  # the end token; no word holds white space
TYPES = 1000  # most frequent words, exchanged one by one
FREQUENT = 60_000  # words with a number, broadcast; fewer than 65,534
LONGEST = 64  # bytes of these words,
LONG = 500  # but for so many more of at most
LONGEST_LONG = 4096  # bytes each
ROUNDS = 2  # of the frequent words
SEEN = 200  # times that a word must be seen for its neighbours to go by its class
SHAPES = 255  # of words unseen in training
FLUSH = 250_000  # words that a task counts before it sends them on
SALT = 7  # held-out: crc32 of the key as text, mod 7
HELD = 2
RARE, NONE = 0xFFFF, 0xFFFE  # numbers of any rare word, and of what is before or after a text
PLACE = np.dtype([("id", "<i8"), ("pos", "<i4"), ("l", "<u2"), ("r", "<u2")])  # id: of the text, twice, plus held
MOST = 1 << 21  # tokens that a task looks at at a time


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % SALT == HELD


def words_of(text: bytes) -> list[bytes]:
    """Words (A-Z lower-cased) and one end token."""
    w = text.lower().split()
    w.append(END)
    return w


def shape(word: bytes) -> int:
    """The shape of a word: a hash of its last three bytes."""
    return crc32(word[-3:]) % SHAPES


def classes_for(v: int) -> int:
    """Classes for a vocabulary of v words: its cube root, from 32 to 256."""
    return max(32, min(256, round(v ** (1 / 3))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("id"), "key", held_out(F.col("key")).alias("held"), "text"
    )


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) over the texts that aren't held out, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                seen.update(words_of(t.as_py() or b""))
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    train = texts.where(~F.col("held")).select(F.col("text").cast("binary"))
    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words with a number, most frequent first, and their counts: at most FREQUENT x LONGEST + LONG x LONGEST_LONG bytes."""
    order = [F.col("n").desc(), F.col("word")]
    size = F.octet_length("word")
    got = []
    for some, most in ((size <= LONGEST, FREQUENT - LONG), (size.between(LONGEST + 1, LONGEST_LONG), LONG)):
        top = counts.where(some).orderBy(*order).limit(most).toArrow()
        got += zip(top.column("n").to_pylist(), top.column("word").to_pylist())
    got.sort(key=lambda x: (-x[0], x[1]))
    return [w for _, w in got], np.array([n for n, _ in got], dtype=np.int64)


def encode(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """(id, key, held, ids, rare) of every text: 16-bit numbers of its tokens, and its rare words with a blank between.

    id: twice a number of the row, plus 1 if held out.  The rows are stored, so
    each later step sees the same ones.
    """
    sent = texts.sparkSession.sparkContext.broadcast(words)
    name = uuid.uuid4().hex
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("key", texts.schema["key"].dataType),
            T.StructField("held", T.BooleanType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("rare", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = worker_cache("lm", name, lambda: {w: i for i, w in enumerate(sent.value)}).get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                told, rare = [], []
                for t in part.column(3):
                    w = words_of(t.as_py() or b"")
                    ids = np.fromiter((number(x, RARE) for x in w), dtype=np.uint16, count=len(w))
                    told.append(ids.tobytes())
                    rare.append(b" ".join([w[j] for j in np.flatnonzero(ids == RARE)]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(told, pa.binary()), pa.array(rare, pa.binary())], schema.names
                )

    rows = texts.select((F.col("id") * 2 + F.col("held").cast("long")).alias("id"), "key", "held", F.col("text").cast("binary"))
    return scratch_table(rows.mapInArrow(run, schema), "lm-encoded")


def _flat(blobs: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all blobs of a binary array one after the other, where each begins and the last ends)."""
    offsets = np.frombuffer(blobs.buffers()[1], dtype=np.int32, count=len(blobs) + 1, offset=4 * blobs.offset)
    size = np.dtype(kind).itemsize
    raw = blobs.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=kind), np.zeros(len(blobs) + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]).astype(np.int64) // size


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The binary array whose rows begin at `starts` (the end included) of `values`."""
    ends = pa.py_buffer((starts * values.dtype.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, ends, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that each holds about MOST tokens at most (or one text)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 2)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + MOST, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _neighbours(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers left and right of each token within its text."""
    left, right = np.empty_like(ids), np.empty_like(ids)
    left[1:], right[:-1] = ids[:-1], ids[1:]
    left[starts[:-1]] = NONE  # no text is without its end token
    right[starts[1:] - 1] = NONE
    return left, right


def _table(class_of: np.ndarray, k: int) -> np.ndarray:
    """Class by number: k for words without one, k + 1 for what is outside the text."""
    out = np.full(1 << 16, k, dtype=np.int64)
    out[: len(class_of)] = class_of
    out[NONE] = k + 1
    return out


def class_bigrams(encoded: DataFrame, table: np.ndarray, k: int, rare: bool = True) -> np.ndarray:
    """(k + 2, k + 2) counts of neighbours by class in training text; the last row is what begins a text.

    k is the class of words without one; without `rare`, pairs with a rare word are left out.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(table)
    side = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, dtype=np.int64)
        for batch in _runs(batches):
            ids, starts = _flat(batch.column(1), np.uint16)
            left, _ = _neighbours(ids, starts)
            pair = sent.value[left] * side + sent.value[ids]
            if not rare:
                pair = pair[(left != RARE) & (ids != RARE)]
            total += np.bincount(pair, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    train = encoded.where(~F.col("held")).select("id", "ids")
    got = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(side, side)


def h(x):
    """x log x, 0 at 0."""
    x = np.maximum(x, 0.0)
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Classes of types by exchange clustering on their bigram counts.

    bigrams: the last row and column stand for all other words, which stay in
    a class of their own.  Starting from a deal by frequency rank, each type in
    turn moves to the class that raises the sum of n log n over class bigrams
    less that over class counts (left and right) most, until a round moves
    nothing.
    """
    size = len(bigrams) - 1
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    by = np.argsort(-(left + right)[:size], kind="stable")
    of = np.empty(size + 1, dtype=np.int64)
    of[by] = np.arange(size) % classes
    of[size] = classes
    pick = np.zeros((size + 1, classes + 1))
    pick[np.arange(size + 1), of] = 1
    pair = pick.T @ bigrams @ pick
    n_left, n_right = pick.T @ left, pick.T @ right
    held, h_left, h_right = h(pair), h(n_left), h(n_right)
    for _ in range(rounds):
        moved = 0
        for w in by:
            if not left[w] and not right[w]:
                continue
            out = np.bincount(of, weights=bigrams[w], minlength=classes + 1)  # to classes
            into = np.bincount(of, weights=bigrams[:, w], minlength=classes + 1)
            own = bigrams[w, w]
            c = of[w]
            out[c] -= own
            into[c] -= own

            def put(c: int, sign: int) -> None:
                pair[c] += sign * out  # noqa: B023
                pair[:, c] += sign * into  # noqa: B023
                pair[c, c] += sign * own  # noqa: B023
                n_left[c] += sign * left[w]  # noqa: B023
                n_right[c] += sign * right[w]  # noqa: B023
                held[c], held[:, c] = h(pair[c]), h(pair[:, c])
                h_left[c], h_right[c] = h(n_left[c]), h(n_right[c])

            put(c, -1)
            o, i = np.flatnonzero(out), np.flatnonzero(into)  # the other cells don't change
            gain = (h(pair[:, o] + out[o]) - held[:, o]).sum(axis=1)
            gain += (h(pair[i] + into[i, None]) - held[i]).sum(axis=0)
            d = np.diag(pair)
            gain -= (h(d + out) - h(d)) + (h(d + into) - h(d))
            gain += h(d + out + into + own) - h(d)
            gain -= h(n_left + left[w]) - h_left + h(n_right + right[w]) - h_right
            gain = gain[:classes]
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            of[w] = best
            put(best, 1)
            moved += best != c
        if not moved:
            break
    return of[:size]


class Gains:
    """What a word's move to each of k classes adds, from the class bigrams.

    A word's neighbours are cells: the class on its left, or side + the class
    on its right.  A move of a word with n tokens and m neighbours in a cell
    adds h(x + m) - h(x) for each cell, x being the class's count there, less
    the growth of the class's own totals.
    """

    def __init__(self, pairs: np.ndarray, k: int):
        self.k, self.side = k, len(pairs)
        self.cells = np.vstack([pairs[:, :k], pairs[:k].T])  # (2 x side, k)
        self.totals = (pairs[:, :k].sum(axis=0), pairs[:k].sum(axis=1))
        self.held = h(self.cells)
        self.small = [None] + [(h(self.cells + m) - self.held).astype(np.float32) for m in range(1, 9)]

    def best(self, word: np.ndarray, cell: np.ndarray, m: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best class of each word.

        (word, cell, m): entries ordered by word, each word with one at least;
        n: tokens of each word; own: its class (k: none), from whose counts it
        is taken out to weigh staying there.
        """
        out = np.empty(len(n), dtype=np.int64)
        begin = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)]
        step = max(1, 4_000_000 // self.k)
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + step, side="right")) - 1)
            lo, hi = begin[at], begin[end]
            c, x = cell[lo:hi], m[lo:hi]
            made = np.empty((hi - lo, self.k), dtype=np.float32)
            for one in range(1, 9):
                some = x == one
                if some.any():
                    made[some] = self.small[one][c[some]]
            for some in np.array_split(np.flatnonzero(x > 8), 1 + (x > 8).sum() // 20_000):
                made[some] = h(self.cells[c[some]] + x[some, None]) - self.held[c[some]]
            gain = np.add.reduceat(made, begin[at:end] - lo, axis=0).astype(np.float64)
            for total in self.totals:
                gain -= h(total + n[at:end, None]) - h(total)
            mine = own[at:end]
            if (mine < self.k).any():
                where = mine[word[lo:hi] - at]
                fine = where < self.k
                here = np.zeros(hi - lo)
                here[fine] = self.held[c[fine], where[fine]] - h(self.cells[c[fine], where[fine]] - x[fine])
                stay = np.add.reduceat(here, begin[at:end] - lo)
                rows = np.flatnonzero(mine < self.k)
                for total in self.totals:
                    t = total[mine[rows]]
                    stay[rows] -= h(t) - h(t - n[at:end][rows])
                gain[rows, mine[rows]] = stay[rows] + 1e-6
            out[at:end] = gain.argmax(axis=1)
            at = end
        return out


def _regroup(encoded: DataFrame, near: np.ndarray, k: int, types: int) -> np.ndarray:
    """One round: the classes of the frequent words beyond `types`, each by its own neighbours.

    near: the classes that words go by as neighbours, k for none.  Every task sums (word, cell) in its part of the text, so what is sent on
    for a word is bounded by its cells and the number of tasks.
    """
    spark = encoded.sparkSession
    table = _table(near, k)
    # arrays only: broadcasts name classes by their module, which the workers may not have
    sent = spark.sparkContext.broadcast((table, near, class_bigrams(encoded, table, k)))
    side, count = k + 2, len(near)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value[0]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([b for _, b in held])).astype(np.int64)

        def flush() -> pa.RecordBatch:
            keys, sums = merged()
            held.clear()
            word, cell = np.divmod(keys, 2 * side)
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            starts = np.r_[begin, len(word)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(word[begin].astype(np.int32)),
                    _blobs(cell.astype(np.uint16), starts),
                    _blobs(sums.astype(np.uint32), starts),
                ],
                ["word", "cells", "counts"],
            )

        for batch in _runs(batches):
            ids, starts = _flat(batch.column(1), np.uint16)
            left, right = _neighbours(ids, starts)
            some = np.flatnonzero((ids >= types) & (ids < count))
            if not len(some):
                continue
            base = ids[some].astype(np.int64) * (2 * side)
            key = np.r_[base + table[left[some]], (base + side + table[right[some]])[right[some] != NONE]]
            held.append(np.unique(key, return_counts=True))
            rows += len(held[-1][0])
            if rows > 2 * MOST:
                held[:] = [merged()]
                rows = len(held[0][0])
                if rows > MOST:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of, pairs = sent.value
        # the cells of this part's words, summed as they come: bounded by words x cells
        keys, sums = np.empty(0, dtype=np.int64), np.empty(0)
        for batch in batches:
            cell, starts = _flat(batch.column(1), np.uint16)
            n, _ = _flat(batch.column(2), np.uint32)
            word = np.repeat(batch.column(0).to_numpy(), np.diff(starts)).astype(np.int64)
            keys, place = np.unique(np.r_[keys, word * (2 * side) + cell], return_inverse=True)
            sums = np.bincount(place, weights=np.r_[sums, n])
        if len(keys):
            word, cell = np.divmod(keys, 2 * side)
            names, at = np.unique(word, return_inverse=True)
            tokens = np.bincount(at, weights=sums * (cell < side))  # each token has a left neighbour
            best = Gains(pairs, k).best(at, cell, sums, tokens, of[names])
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(best.astype(np.int32))], ["word", "class"])

    summed = encoded.where(~F.col("held")).select("id", "ids").mapInArrow(neighbours, "word int, cells binary, counts binary")
    dealt = summed.repartition(shuffle_partitions(spark), "word")
    got = dealt.mapInArrow(move, "word int, class int").toArrow()  # a row for each frequent word
    out = near.copy()
    out[got.column("word").to_numpy()] = got.column("class").to_numpy()
    return out


def rare_words(encoded: DataFrame, near: np.ndarray, k: int) -> DataFrame:
    """(word, n, class, places) of every word without a number.

    n: its tokens in training text; class: by exchange out of the unassigned
    class, or k plus its shape if n is 0; places: its occurrences (PLACE) in
    all texts.  A task holds the places of one word at a time, or of many
    small ones: a word that isn't among the FREQUENT ones has at most one in
    FREQUENT of the tokens.
    """
    spark = encoded.sparkSession
    table = _table(near, k)
    sent = spark.sparkContext.broadcast((table, class_bigrams(encoded, table, k)))
    side = k + 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            which, at = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(which, kind="stable")
            starts = np.r_[0, np.cumsum(np.bincount(which, minlength=len(number)))]
            out = pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()), _blobs(at[by], starts)], ["word", "places"])
            number.clear()
            held.clear()
            return out

        for batch in _runs(batches):
            ids, starts = _flat(batch.column(1), np.uint16)
            some = np.flatnonzero(ids == RARE)
            if not len(some):
                continue
            words = [w for t in batch.column(2).to_pylist() if t for w in t.split(b" ")]
            left, right = _neighbours(ids, starts)
            text = np.searchsorted(starts, some, side="right") - 1
            at = np.empty(len(some), dtype=PLACE)
            at["id"], at["pos"] = batch.column(0).to_numpy()[text], some - starts[text]
            at["l"], at["r"] = left[some], right[some]
            held.append((np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)), at))
            rows += len(some)
            if rows > MOST:
                yield flush()
                rows = 0
        if held:
            yield flush()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs = sent.value
        gains = Gains(pairs, k)

        def done(words: pa.Array, blobs: pa.Array) -> pa.RecordBatch:
            """Rows that are whole words, ordered by word."""
            at, starts = _flat(blobs, PLACE)
            new = np.ones(len(words), dtype=bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            starts = np.r_[starts[first], starts[-1]]
            names = words.take(pa.array(first))
            which = np.repeat(np.arange(len(first)), np.diff(starts))
            train = (at["id"] & 1) == 0
            n = np.bincount(which[train], minlength=len(first))
            base = which[train] * (2 * side)
            l, r = at["l"][train], at["r"][train]  # noqa: E741
            key, m = np.unique(np.r_[base + table[l], (base + side + table[r])[r != NONE]], return_counts=True)
            word, cell = np.divmod(key, 2 * side)
            known = np.flatnonzero(n)
            found = np.empty(len(first), dtype=np.int64)
            if len(known):
                found[known] = gains.best(np.searchsorted(known, word), cell, m, n[known], np.full(len(known), k))
            for i in np.flatnonzero(n == 0):
                found[i] = k + shape(names[int(i)].as_py())
            return pa.RecordBatch.from_arrays(
                [names, pa.array(n.astype(np.int64)), pa.array(found.astype(np.int32)), _blobs(at, starts)],
                ["word", "n", "class", "places"],
            )

        words, blobs = pa.array([], pa.binary()), pa.array([], pa.binary())
        for batch in batches:
            words = pa.concat_arrays([words, batch.column(0)])
            blobs = pa.concat_arrays([blobs, batch.column(1)])
            if len(words) >= 20_000 or blobs.nbytes > 1 << 25:
                last = words[-1]
                end = int(np.searchsorted(pc.equal(words, last).to_numpy(zero_copy_only=False), True))
                if end:  # the last word may go on
                    yield done(words[:end], blobs[:end])
                    words, blobs = pa.concat_arrays([words[end:]]), pa.concat_arrays([blobs[end:]])
        if len(words):
            yield done(words, blobs)

    found = encoded.select("id", "ids", "rare").mapInArrow(places, "word binary, places binary")
    dealt = found.repartition(shuffle_partitions(spark), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(assign, "word binary, n long, class int, places binary")


def _by_text(rare: DataFrame, k: int) -> DataFrame:
    """(id, places, n, classes) of the texts with rare words, their places in order; and, with ids below 0, sums.

    A sum has no places but words and tokens: for class c under -1 - c, and
    over once-seen words of class c and shape s under -1 - k - (s x k + c).
    Stored, as it is read twice.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens = np.zeros(k + SHAPES * k, dtype=np.int64), np.zeros(k + SHAPES * k, dtype=np.int64)
        for batch in batches:
            at, starts = _flat(batch.column(3), PLACE)
            n, c = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            known = n > 0
            words += np.bincount(c[known], minlength=len(words))
            tokens += np.bincount(c[known], weights=n[known], minlength=len(words)).astype(np.int64)
            once = np.flatnonzero(n == 1)
            shapes = np.fromiter((shape(w.as_py()) for w in batch.column(0).take(pa.array(once))), dtype=np.int64, count=len(once))
            words += np.bincount(k + shapes * k + c[once], minlength=len(words))
            of = np.repeat(np.arange(len(n)), np.diff(starts))
            for lo in range(0, len(at), 1 << 17):
                some, w = at[lo : lo + (1 << 17)], of[lo : lo + (1 << 17)]
                where = some["pos"].astype(np.int64) << 32 | some["l"].astype(np.int64) << 16 | some["r"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some["id"]), pa.array(where), pa.array(n[w]), pa.array(c[w].astype(np.int32))], ["id", "at", "n", "c"]
                )
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(-1 - some), pa.array(words[some]), pa.array(tokens[some]), pa.array(np.zeros(len(some), dtype=np.int32))],
            ["id", "at", "n", "c"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            ids, at, n, c = (t.column(x).to_numpy() for x in ("id", "at", "n", "c"))
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            starts = np.r_[first, len(ids)]
            whole = ids[first] < 0
            sums = [pa.array(np.add.reduceat(x, first), mask=~whole) for x in (at, n)]
            row = np.repeat(~whole, np.diff(starts))
            length = np.where(whole, 0, np.diff(starts))
            starts = np.r_[0, np.cumsum(length)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[first]), *(_blobs(x[row], starts) for x in (at, n, c)), *sums],
                ["id", "at", "n", "c", "words", "tokens"],
            )

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            ids = held.column("id").to_numpy()
            end = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            if end and held.num_rows > 50_000:  # the last text may go on
                yield done(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield done(held)

    rows = rare.mapInArrow(spread, "id long, at long, n long, c int")
    dealt = rows.repartition(shuffle_partitions(rare.sparkSession), "id").sortWithinPartitions("id", "at")
    packed = dealt.mapInArrow(pack, "id long, at binary, n binary, c binary, words long, tokens long")
    return scratch_table(packed, "lm-rare")


def _rare_moves(batch: pa.RecordBatch, table: np.ndarray, k: int, guess: np.ndarray) -> tuple:
    """(text, from, to, n, class): class pairs with a rare word in them (text by number in the batch), and the words.

    columns of the batch: id, at, n, c.  from is k + 1 for what is before a text.
    """
    at, starts = _flat(batch.column(1), np.int64)
    n, _ = _flat(batch.column(2), np.int64)
    c, _ = _flat(batch.column(3), np.int32)
    c = np.where(c < k, c, guess[np.maximum(c - k, 0)]).astype(np.int64)
    text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
    l, r = at >> 16 & 0xFFFF, at & 0xFFFF  # noqa: E741
    last = np.zeros_like(c)
    last[1:] = c[:-1]
    before = np.where(l == RARE, last, table[l])  # of two rare words in a row, the first is the place before
    after = (r != RARE) & (r != NONE)
    return (
        text,
        np.r_[before, c[after]],
        np.r_[c, table[r[after]]],
        np.r_[text, text[after]],
        n,
        c,
    )


class Model:
    """Transitions and emissions, from counts of class pairs and of the words and tokens of each class."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        """pairs: counts of class pairs, the last row for the start of a text."""
        k = pairs.shape[1]
        weight = pairs.sum(axis=1, keepdims=True)
        overall = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + k)
        # transitions: interpolated with the classes' own shares (Witten-Bell weights)
        followers = np.maximum(1, (pairs > 0).sum(axis=1, keepdims=True))
        self.move = np.log10((pairs + followers * overall) / (weight + followers))
        self.words, self.tokens = words, tokens
        self.emit = np.log10(tokens + words + 1.0)  # add-one within the class, one more for unknown words


class Trained:
    """What scoring reads: the encoded texts, their rare words by text, and the bounded rest."""

    def __init__(self, texts: DataFrame):
        self.counts = materialize(count_words(texts))
        total = self.counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total["n"] or 0), int(total["v"])
        self.words, self.count = frequent_words(self.counts)
        self.encoded = encode(texts, self.words)
        types = min(TYPES, len(self.words))
        self.k = k = classes_for(self.v)
        of_type = np.full(1 << 16, types)
        of_type[:types] = np.arange(types)
        of_type[NONE] = types + 1
        bigrams = class_bigrams(self.encoded, of_type, types)[: types + 1, : types + 1]
        self.class_of = np.full(len(self.words), k, dtype=np.int64)
        self.class_of[:types] = exchange(bigrams, k)
        known = (np.arange(len(self.words)) < types) | (self.count >= SEEN)
        for _ in range(ROUNDS if types < len(self.words) else 0):
            self.class_of = _regroup(self.encoded, np.where(known, self.class_of, k), k, types)
        self.near = np.where(known, self.class_of, k)
        self.rare = rare_words(self.encoded, self.near, k)
        self.by_text = _by_text(self.rare, k)
        sums = self.by_text.where("id < 0").select("id", "words", "tokens").toArrow()  # k + SHAPES x k rows at most
        cell = -1 - sums.column("id").to_numpy()
        words = np.bincount(cell, weights=sums.column("words").to_numpy(), minlength=k + SHAPES * k)
        tokens = np.bincount(cell, weights=sums.column("tokens").to_numpy(), minlength=k + SHAPES * k)[:k]
        once = words[k:].reshape(SHAPES, k)
        known = words[:k] + np.bincount(self.class_of, minlength=k)
        usual = int((once.sum(axis=0) if once.any() else known).argmax())
        self.guess = np.where(once.any(axis=1), once.argmax(axis=1), usual)
        tokens = tokens + np.bincount(self.class_of, weights=self.count, minlength=k)
        self.table = _table(self.class_of, k)
        self.model = Model(self._pairs(), known, tokens)

    def _pairs(self) -> np.ndarray:
        """Counts of class pairs in training text, the last row for the start."""
        k, side = self.k, self.k + 2
        sent = self.encoded.sparkSession.sparkContext.broadcast((self.table, self.guess))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, guess = sent.value
            total = np.zeros(side * side, dtype=np.int64)
            for batch in batches:
                _, a, b, _, _, _ = _rare_moves(batch, table, k, guess)
                total += np.bincount(a * side + b, minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

        train = self.by_text.where("id >= 0 and id % 2 = 0").select("id", "at", "n", "c")
        got = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        out = class_bigrams(self.encoded, self.table, k, rare=False).reshape(-1)
        out[got.column("pair").to_numpy()] += got.column("n").to_numpy()
        out = out.reshape(side, side)
        return np.vstack([out[:k, :k], out[k + 1, :k]])

    def classes(self) -> DataFrame:
        """(word, n, class) of every training word."""
        rows = [(bytes(w), int(n), int(c)) for w, n, c in zip(self.words, self.count, self.class_of)]
        known = self.encoded.sparkSession.createDataFrame(rows, "word binary, n long, class int")
        return known.union(self.rare.where("n > 0").select("word", "n", "class"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    base_score: the add-one unigram log10 probability; score: the class
    model's.  A null or empty text is its end token alone.  A null key counts
    as the empty string for the hold-out rule.  Repeated rows count and are
    scored one by one.  With no training text, N and V are 0.  An empty table
    gives an empty result; other columns are not read.
    """
    texts = _texts(docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")))
    t = Trained(texts)
    k = t.k
    base = np.log10(t.n + 1.0 * (t.v + 1))
    logs = np.zeros(1 << 16)
    logs[: len(t.count)] = np.log10(t.count + 1.0)
    sent = docs.sparkSession.sparkContext.broadcast((t.table, t.guess, t.model.move, t.model.emit, logs))
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("logs", T.DoubleType()),
            T.StructField("moves", T.DoubleType()),
        ]
    )

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of each text, and the sums over its frequent words and their pairs."""
        table, _, move, emit, logs = sent.value
        # rare words add nothing here: a row and a column of zeros
        grid = np.zeros((k + 2, k + 1))
        grid[:k, :k], grid[k + 1, :k] = move[:k], move[k]
        drop = np.r_[emit, 0.0]
        for batch in _runs(batches):
            ids, starts = _flat(batch.column(1), np.uint16)
            left, _ = _neighbours(ids, starts)
            c = table[ids]
            parts = [(ids != RARE).astype(np.int64), logs[ids], grid[table[left], c] - drop[c]]
            sums = [pa.array(np.add.reduceat(x, starts[:-1])) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(starts)), *sums], schema.names)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over a text's rare words and the pairs with one in them."""
        table, guess, move, emit, _ = sent.value
        grid = np.zeros((k + 2, k))
        grid[:k], grid[k + 1] = move[:k], move[k]
        for batch in batches:
            of, a, b, pair_of, n, c = _rare_moves(batch, table, k, guess)
            rows = batch.num_rows
            moves = np.bincount(pair_of, weights=grid[a, b], minlength=rows) - np.bincount(of, weights=emit[c], minlength=rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.nulls(rows, schema_key),
                    pa.array(np.zeros(rows, dtype=np.int64)),
                    pa.array(np.bincount(of[n > 0], minlength=rows).astype(np.int64)),
                    pa.array(np.bincount(of, weights=np.log10(n + 1.0), minlength=rows)),
                    pa.array(moves),
                ],
                schema.names,
            )

    schema_key = to_arrow_type(docs.schema[key].dataType)
    rows = t.encoded.select("id", "ids", "key").mapInArrow(frequent, schema)
    rows = rows.union(t.by_text.where("id >= 0").select("id", "at", "n", "c").mapInArrow(rare, schema))
    summed = rows.groupBy("id").agg(
        F.first("key", ignorenulls=True).alias("key"),
        *[F.sum(c).alias(c) for c in ("tokens", "known", "logs", "moves")],
    )
    return summed.select(
        F.col("key").alias(key),
        (F.col("id") % 2 == 1).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(t.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("logs") + F.col("moves")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Per held_out: tokens and the perplexity of both models."""
    per = lambda c: F.pow(F.lit(10.0), -F.try_divide(F.sum(c), F.sum("n_tokens")))
    return scored.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity")
    )
