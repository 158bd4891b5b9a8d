"""Operator 12: language identification by a byte convolutional network.

Filters of several widths run over the embedded bytes of a window; each
filter's maximum over the window goes into one softmax layer.  The network is
trained in numpy on labelled windows.  A text is cut into windows of one
length that cover all of it, and its probabilities are the windows' means,
weighted by their bytes.

The first layer is linear in a byte's embedding, so a trained filter is a table
of sums by byte (here by pairs of bytes), and a window costs two look-ups a
byte instead of a product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.llm.common import worker_cache

LENGTH = 256  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
DEPTH = 8  # of a byte's embedding
PAD = 256  # the byte after the text's end
PER_LANGUAGE = 400  # labelled keys of a language that the network is trained on, at most
PER_TEXT = 8  # windows of each
STEPS = 500
BATCH = 64
FOLDS = 5  # held out: crc32 of the key as text, mod 5, is 0


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


class Network:
    """Weights of the byte convolutional network; `labels` are its classes."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(size=s).astype(np.float32)
        most = max(WIDTHS)
        self.labels = labels
        self.embed = normal(257, DEPTH) * 0.5
        self.conv = normal(most * DEPTH, len(WIDTHS) * FILTERS) / 4
        # a narrower filter has no weights beyond its width
        self.used = np.repeat(np.arange(most)[:, None] < np.array(WIDTHS), FILTERS, axis=1).repeat(DEPTH, axis=0)
        self.conv *= self.used
        self.shift = np.zeros(self.conv.shape[1], dtype=np.float32)
        self.out = normal(self.conv.shape[1], len(labels)) / 8
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("embed", "conv", "shift", "out", "bias")}

    def forward(self, ids: np.ndarray) -> tuple:
        """Log probabilities of windows of byte ids, and what the gradient needs: patches at the maxima."""
        n, length = ids.shape
        most = max(WIDTHS)
        wide = np.pad(ids, ((0, 0), (0, most - 1)), constant_values=PAD)
        patch = np.concatenate([self.embed[wide[:, k : k + length]] for k in range(most)], axis=2)
        made = patch.reshape(n * length, -1) @ self.conv
        at = made.reshape(n, length, -1).argmax(axis=1)
        rows = np.arange(n)[:, None]
        top = made.reshape(n, length, -1)[rows, at, np.arange(made.shape[1])]
        act = np.maximum(top + self.shift, 0)
        seen = np.stack([wide[rows, at + k] for k in range(most)], axis=2)  # byte ids at the maxima
        return log_softmax(act @ self.out + self.bias), act, patch[rows, at], seen

    def gradient(self, ids: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        logp, act, patch, seen = self.forward(ids)
        n = len(ids)
        d = np.exp(logp)
        d[np.arange(n), target] -= 1
        d /= n
        back = (d @ self.out.T) * (act > 0)
        grown = back[:, :, None] * self.conv.T[None]  # to the patches
        by, sums = seen.reshape(-1), grown.reshape(-1, DEPTH)
        embed = np.stack([np.bincount(by, weights=sums[:, k], minlength=257) for k in range(DEPTH)], axis=1)
        conv = np.einsum("nfk,nf->kf", patch, back, optimize=True) * self.used
        return {"embed": embed, "conv": conv, "shift": back.sum(axis=0), "out": act.T @ d, "bias": d.sum(axis=0)}


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def fit(windows: list[tuple[str, bytes]], steps: int = STEPS, rate: float = 0.01, seed: int = 13) -> Network:
    """Trains by Adam on (label, window); each step draws labels evenly and cuts half of the windows short."""
    labels = sorted({w[0] for w in windows})
    net = Network(labels)
    if len(labels) < 2:
        return net
    rng = np.random.default_rng(seed)
    by = [[np.frombuffer(w.lower(), dtype=np.uint8) for lab, w in windows if lab == x] for x in labels]
    parts = net.parts()
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for step in range(1, steps + 1):
        target = rng.integers(0, len(labels), BATCH)
        ids = np.full((BATCH, LENGTH), PAD, dtype=np.int64)
        for i, t in enumerate(target):
            w = by[t][rng.integers(0, len(by[t]))]
            if i % 2 and len(w) > 16:
                begin = rng.integers(0, len(w) - 15)
                w = w[begin : begin + rng.integers(16, LENGTH + 1)]
            ids[i, : len(w)] = w
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradient(ids, target).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            parts[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Tables:
    """A trained network's filters as sums by pairs of bytes, to score windows of a flat byte buffer.

    Filters are ordered by width; `front` has the sums of the first two bytes
    of all filters, `rest` those of the next two of the wider ones.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        side = 257
        by = np.stack([parts["embed"] @ parts["conv"][k * DEPTH : (k + 1) * DEPTH] for k in range(max(WIDTHS))])
        wide = parts["conv"].shape[1]
        self.front = (by[0][:, None] + by[1][None]).reshape(side * side, wide)
        self.rest = np.ascontiguousarray((by[2][:, None] + by[3][None])[:, :, FILTERS:]).reshape(side * side, wide - FILTERS)
        self.shift, self.out, self.bias = parts["shift"], parts["out"], parts["bias"]

    def score(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities of the windows data[begin:end], each of LENGTH bytes at most."""
        made = []
        steps = np.arange(LENGTH + 3)
        for lo in range(0, len(begin), 64):
            at = begin[lo : lo + 64, None] + steps
            ids = np.where(at < end[lo : lo + 64, None], data[np.minimum(at, len(data) - 1)], PAD)
            pair = ids[:, :-1] * 257 + ids[:, 1:]
            sums = self.front[pair[:, :LENGTH]]
            sums[:, :, FILTERS:] += self.rest[pair[:, 2:]]
            act = np.maximum(sums.max(axis=1) + self.shift, 0)
            made.append(np.exp(log_softmax(act @ self.out + self.bias)))
        return np.concatenate(made)


def text_probabilities(tables: Tables, texts: pa.Array) -> np.ndarray:
    """(texts, languages): means over the windows that cover each (binary, not null) text, weighted by bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and len(raw) else np.zeros(1, dtype=np.uint8)
    data = LOWER[data[offsets[0] : max(offsets[-1], offsets[0] + 1)]]
    start, stop = (offsets[:-1] - offsets[0]).astype(np.int64), (offsets[1:] - offsets[0]).astype(np.int64)
    count = np.maximum(1, -(-(stop - start) // LENGTH))
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[owner] + nth * LENGTH
    end = np.minimum(begin + LENGTH, stop[owner])
    made = tables.score(data, begin, end)
    weight = np.maximum(end - begin, 1).astype(np.float64)
    out = np.zeros((len(texts), made.shape[1]))
    for k in range(made.shape[1]):
        out[:, k] = np.bincount(owner, weights=made[:, k] * weight, minlength=len(texts))
    return out / np.bincount(owner, weights=weight, minlength=len(texts))[:, None]


LOWER = np.arange(256, dtype=np.int32)
LOWER[65:91] += 32  # A-Z


def _cut(text: bytes) -> list[bytes]:
    """Up to PER_TEXT windows spread over the whole text; all of them where there are no more."""
    count = max(1, -(-len(text) // LENGTH))
    some = range(count) if count <= PER_TEXT else [k * count // PER_TEXT for k in range(PER_TEXT)]
    return [text[i * LENGTH : (i + 1) * LENGTH] for i in some]


def sample(docs: DataFrame, key: str, text: str, label: str, held: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(label, windows) of at most `per_language` keys of each language, drawn by a hash of the key.

    A key counts once per language, however many rows have it.  Languages are
    counted first; keys beyond about twice the bound fall out by their hash, so
    a language with most rows sends no more on than one with few.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"), docs[label].cast("string").alias("y"), held.alias("h"))
    rows = rows.where(F.col("y").isNotNull() & ~F.col("h") & _letters(F.col("t")))
    keys = rows.groupBy("y", "k").agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("k", "y"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = keys.groupBy("y").agg(F.count(F.lit(1)).alias("keys"))
    few = keys.join(whole, "y").where(share * F.col("keys") <= 2 * per_language + 40)
    place = Window.partitionBy("y").orderBy(F.xxhash64("k", "y"), "k")
    drawn = few.withColumn("r", F.row_number().over(place)).where(F.col("r") <= per_language).select("y", "k")
    fine = drawn.select(F.col("y").alias("y_"), F.col("k").alias("k_"))
    chosen = rows.join(F.broadcast(fine), (F.col("y") == F.col("y_")) & F.col("k").eqNullSafe(F.col("k_")))  # bounded above

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_cut(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.binary()))], ["y", "k", "w"]
            )

    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField("y", T.StringType()), T.StructField("k", kind), T.StructField("w", T.ArrayType(T.BinaryType()))]
    )
    made = chosen.select("y", "k", F.col("t").cast("binary")).mapInArrow(cut, schema)
    return made.groupBy("y", "k").agg(F.min("w").alias("w")).select(F.col("y").alias("label"), F.col("w").alias("windows"))


def _letters(t: Column) -> Column:
    return F.coalesce(t.rlike(r"\p{L}"), F.lit(False))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", held: Column | None = None
) -> Network:
    """A network for the languages of `docs`, from the bounded sample; `held`: rows never learned from."""
    drawn = sample(docs, key, text, label, held_out(docs[key]) if held is None else held)
    got = drawn.toArrow()  # PER_LANGUAGE x PER_TEXT windows of LENGTH bytes a language at most
    pairs = zip(got.column("label").to_pylist(), got.column("windows").to_pylist())
    return fit(sorted((y, w) for y, ws in pairs for w in ws))


def identify(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, lang_pred, score, probabilities (in the order of `net.labels`) of every row of `docs`.

    `und` with score 0 for a null text and one without a letter (or if nothing
    was learned).  The whole text is read.  One learned language takes all
    other texts, with score 1.  Rows are handled one by one: repeated rows give
    repeated results, a null key stays, an empty table gives an empty result;
    other columns are not read.  One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net.parts() | {"labels": net.labels, "id": uuid.uuid4().hex})
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("probabilities", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        labels = parts["labels"]
        tables = worker_cache("langid", parts["id"], lambda: Tables(parts)) if labels else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                some = part.column(2)
                made: list = [None] * part.num_rows
                rows = np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False))
                if labels and len(rows):
                    for i, p in zip(rows, text_probabilities(tables, some.drop_null())):
                        made[i] = p
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(["und" if p is None else labels[int(p.argmax())] for p in made], pa.string()),
                        pa.array([0.0 if p is None else min(1.0, float(p.max())) for p in made], pa.float64()),
                        pa.array(made, pa.list_(pa.float64())),
                    ],
                    schema.names,
                )

    t = docs[text].cast("string")
    rows = docs.select(docs[key], F.lit(0).alias("_"), F.when(_letters(t), t).cast("binary").alias("_text"))
    return rows.mapInArrow(run, schema)


def accuracy(predicted: DataFrame, docs: DataFrame, key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Per held_out: labelled rows and the share predicted right; keys must be unique."""
    known = docs.where(docs[label].isNotNull()).select(docs[key].alias(key), docs[label].alias("_told"))
    right = F.avg((F.col("lang_pred") == F.col("_told")).cast("double"))
    return predicted.join(known, key).groupBy(held_out(F.col(key)).alias("held_out")).agg(
        F.count(F.lit(1)).alias("rows"), right.alias("accuracy")
    )
