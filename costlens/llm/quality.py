"""Operator 6: quality rules by line labelling.

A linear-chain conditional random field marks each line with a word as content
or boilerplate; Viterbi decoding gives the best marks of a whole text, and the
share of words in content lines decides whether the text is kept.  The field
is fitted on a bounded sample of labelled documents (their label marks all
their lines); everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
SAMPLE = 2000  # labelled documents that the field is fitted on, at most
SAMPLE_CHARS = 16_384  # documents longer than that are not drawn for the sample
MIN_SHARE = 0.5  # of words in content lines
LEAN = 0.5  # log-odds by which a text must look worse than content to begin as boilerplate

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))

#: Values of each line feature; a line's code is a number with these digits.
SIZES = (5, 4, 3, 3, 2, 2, 3, 3)


def line_code(line: bytes, n_words: int, repeated: bool) -> int:
    """The features of a line as one number: words, symbols, capitals, digits, end mark, repeat, word length, bars."""
    size = max(1, len(line))
    symbols = size - len(line.translate(None, SYMBOLS))
    upper = len(line) - len(line.translate(None, _UPPER))
    lower = len(line) - len(line.translate(None, _LOWER))
    digits = len(line) - len(line.translate(None, _DIGIT))
    bars = line.count(b"|")
    last = line.rstrip()[-1:]
    per_word = size / max(1, n_words)
    values = (
        0 if n_words < 3 else 1 if n_words < 6 else 2 if n_words < 12 else 3 if n_words < 40 else 4,
        0 if not symbols else 1 if symbols < 0.02 * size else 2 if symbols < 0.1 * size else 3,
        0 if 4 * upper < upper + lower else 1 if 2 * upper < upper + lower else 2,
        0 if not digits else 1 if 10 * digits < size else 2,
        int(last in b".!?:;" and last != b""),
        int(repeated),
        0 if per_word < 4 else 1 if per_word < 10 else 2,
        0 if not bars else 1 if bars < 0.2 * n_words else 2,
    )
    code = 0
    for v, n in zip(values, SIZES):
        code = code * n + v
    return code


def _one_hot(codes: np.ndarray) -> np.ndarray:
    """Positions of the feature values of each code in the weight vector."""
    out = np.empty((len(SIZES), *codes.shape), dtype=np.int64)
    rest = codes.copy()
    first = np.cumsum([0, *SIZES[:-1]])
    for k in range(len(SIZES) - 1, -1, -1):
        out[k] = first[k] + rest % SIZES[k]
        rest = rest // SIZES[k]
    return out


class Field:
    """Weights of the field: per feature value and label, label changes, first labels.  Label 1 is content."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.move, self.start = move.tolist(), start.tolist()
        self.emit = emit
        self.known: dict[int, tuple[float, float]] = {}

    def scores(self, code: int) -> tuple[float, float]:
        got = self.known.get(code)
        if got is None:
            s = self.emit[_one_hot(np.array([code]))[:, 0]].sum(axis=0)
            got = self.known[code] = (float(s[0]), float(s[1]))
        return got

    def decode(self, codes: list[int]) -> list[int]:
        """The best labels of a text's lines (Viterbi); a tie goes to content."""
        if not codes:
            return []
        (m00, m01), (m10, m11) = self.move
        e0, e1 = self.scores(codes[0])
        a, b = self.start[0] + e0, self.start[1] + e1 + LEAN
        back = []
        for code in codes[1:]:
            e0, e1 = self.scores(code)
            from0, from1 = a + m00 <= b + m10, a + m01 <= b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + e0, (b + m11 if from1 else a + m01) + e1
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_field(lines: list[list[int]], labels: list[int], rounds: int = 60, ridge: float = 0.02) -> Field:
    """The field of most penalised conditional likelihood, each text's lines having the text's label.

    Gradients come from the forward-backward sums over all texts at once.
    Without texts of both labels the weights stay zero, and every line is content.
    """
    width = int(sum(SIZES))
    emit, move, start = np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)
    rows = [(x, y) for x, y in zip(lines, labels) if x]
    if len({y for _, y in rows}) < 2:
        return Field(emit, move, start)
    rows.sort(key=lambda r: -len(r[0]))
    n, most = len(rows), len(rows[0][0])
    size = np.array([len(x) for x, _ in rows])
    codes = np.zeros((n, most), dtype=np.int64)
    for i, (x, _) in enumerate(rows):
        codes[i, : len(x)] = x
    hot = _one_hot(codes)
    there = np.arange(most) < size[:, None]
    y = np.array([v for _, v in rows])
    live = [int((size > t).sum()) for t in range(most)]  # texts are sorted: the first ones reach line t
    weight = 1.0 / n
    seen = np.zeros((width, 2))
    for f in hot:
        for label in (0, 1):
            np.add.at(seen[:, label], f[(y == label)[:, None] & there], weight)
    seen_move = np.zeros((2, 2))
    seen_start = np.zeros(2)
    for label in (0, 1):
        seen_move[label, label] = weight * (size[y == label] - 1).sum()
        seen_start[label] = weight * (y == label).sum()

    params = [emit, move, start]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        score = emit[hot].sum(axis=0)  # text, line, label
        ahead = np.zeros((n, most, 2))
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, most):
            k = live[t]
            ahead[:k, t] = np.logaddexp(*(ahead[:k, t - 1, j, None] + move[j] for j in (0, 1))) + score[:k, t]
        behind = np.zeros((n, most, 2))
        pairs = np.zeros((2, 2))
        total = np.logaddexp(ahead[np.arange(n), size - 1, 0], ahead[np.arange(n), size - 1, 1])
        for t in range(most - 1, 0, -1):
            k = live[t]
            onward = behind[:k, t] + score[:k, t]
            joint = ahead[:k, t - 1, :, None] + move + onward[:, None, :] - total[:k, None, None]
            pairs += weight * np.exp(joint).sum(axis=0)
            behind[:k, t - 1] = np.logaddexp(onward[:, 0, None] + move[:, 0], onward[:, 1, None] + move[:, 1])
        share = weight * np.exp(np.where(there[:, :, None], ahead + behind - total[:, None, None], -np.inf))
        model = np.zeros((width, 2))
        for f in hot:
            for label in (0, 1):
                model[:, label] += np.bincount(f.ravel(), weights=share[:, :, label].ravel(), minlength=width)
        slopes = [seen - model, seen_move - pairs, seen_start - share[:, 0].sum(axis=0)]
        for p, g, m, v in zip(params, slopes, first, second):
            g = g - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(emit, move, start)


def _lines(text: bytes) -> tuple[list[int], list[int], int]:
    """(codes, words, repeats) of a text's lines with a word; a line equal to an earlier one is a repeat."""
    seen: set[bytes] = set()
    codes, words, repeats = [], [], 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            again = line in seen
            repeats += again
            seen.add(line)
            codes.append(line_code(line, n, again))
            words.append(n)
    return codes, words, repeats


_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.int64) | 1


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of 8 words that occur twice or more, the first time included.

    Windows are compared by a 64-bit sum of their words' 64-bit hashes.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    with np.errstate(over="ignore"):
        total = sum(h[k : k + n] * _FACTORS[k] for k in range(WINDOW))
    by = np.argsort(total, kind="stable")
    same = total[by][1:] == total[by][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str, field: Field, min_share: float = MIN_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)."""
    raw = text.encode()
    words = raw.split()
    codes, sizes, repeats = _lines(raw)
    again = repeat_words(words)
    marks = field.decode(codes)
    share = sum(n for n, m in zip(sizes, marks) if m) / len(words) if words else 0.0
    failed = len(words) < 20 or 100 * again > 30 * len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeats, again, failed, not failed and share >= min_share, share


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """The field fitted on the documents of at most `sample` labels 0 or 1, drawn by a hash of the key.

    Labels keep their natural shares, so the field leans to content as the corpus does.  Only the codes of their lines come to the driver.  Rows without a label,
    text or key, and texts over SAMPLE_CHARS, are not drawn.
    """
    marked = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("label"))
    # At most `sample` ids are broadcast; texts are neither shuffled nor sorted but for the drawn ones.
    marked = marked.where("key is not null").orderBy(F.xxhash64("key"), "key").limit(sample)
    known = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    known = known.where(F.octet_length("text").between(1, SAMPLE_CHARS)).join(F.broadcast(marked), "key")
    drawn = known.orderBy(F.xxhash64("key"), "key", "text").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_lines(t.encode())[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.list_(pa.int64())), batch.column(1)], ["codes", "label"])

    lines = drawn.select("text", F.col("label").cast("int")).mapInArrow(run, "codes array<long>, label int")
    got = lines.toArrow()
    return fit_field(got.column("codes").to_pylist(), got.column("label").to_pylist())


def quality_report(
    docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE
) -> DataFrame:
    """`key`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    A null or empty text has no words: counts 0, base_failed, not kept, share 0.
    Null keys and repeated rows give a row each; an empty table an empty
    result; other columns are not read.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            *[T.StructField(c, T.LongType()) for c in counts],
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("content_share", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        for batch in batches:
            cols = list(zip(*[judge(t.as_py() or "", field, min_share) for t in batch.column(1)])) or [()] * 8
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, field: Field, text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of `docs` that the rules keep; same columns, whatever their names."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(t.as_py() or "", field, min_share)[6] for t in batch.column(at)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
