"""Operator 13: fill-in-middle transformation over an indexable skip list.

A text's lines are the nodes of a skip list whose lanes carry two widths per
step: how many units (lines) and how many code points it passes.  A cut rank is
reached from the head by the longest steps that don't overshoot, lane by lane;
the units passed add up to the rank exactly and the code points passed are the
place to cut.  Prefix, middle and suffix are then put in the order of the form.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7


class SkipList:
    """An indexable skip list over the code-point widths of units.

    Lane 0 links each node to the next one; one in four nodes of a lane is in
    the lane above as well, as a fixed mix of its number tells.  A lane holds,
    for each of its nodes (the head first), the units and the code points up to
    the next one, and the node's place in the lane below.
    """

    def __init__(self, widths: list[int]):
        self.units = len(widths)
        nodes, ends = array("q", range(len(widths) + 1)), array("q", accumulate(widths, initial=0))
        self.lanes: list[tuple[array, array, array]] = []
        down = nodes  # places of a lane's nodes in the lane below; node i ends where unit i does, the head is node 0
        while True:
            units = array("q", map(sub, nodes[1:], nodes))
            points = array("q", map(sub, ends[1:], ends))
            self.lanes.append((units, points, down))
            shift = 32 - 2 * len(self.lanes)
            down = array("q", (k for k, i in enumerate(nodes) if (i * 0x9E3779B1 & 0xFFFFFFFF) >> shift == 0))
            if len(down) == 1:
                break
            nodes, ends = array("q", (nodes[k] for k in down)), array("q", (ends[k] for k in down))

    def locate(self, rank: int) -> int:
        """Code points before unit `rank` (as many units are passed)."""
        at = passed = gone = 0
        for units, points, down in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, gone, at = passed + units[at], gone + points[at], at + 1
            at = down[at]
        return gone


def unit_widths(text: str) -> list[int]:
    """Code points of each line with its line end; what follows the last line end is a unit if it isn't empty."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def draws(key, seed: int = SEED) -> list[int]:
    """h1 to h4 of a key: the first four 8-digit groups of the hex sha256 of `seed:key`."""
    told = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, key, seed: int = SEED, fim_percent: int = 100, spm_percent: int = 50) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    widths = unit_widths(text)
    n = len(widths)
    h = draws(key, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = (units.locate(r) for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that `transform` gave this output and form for."""
    if form == "plain":
        return output
    first, rest = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    body, middle = output.removeprefix(first).split(MIDDLE)
    a, b = body.split(rest)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    fim_percent: int = 100,
    spm_percent: int = 50,
) -> DataFrame:
    """`key`, n, form, prefix_chars, middle_chars, output, restored of every row of `docs`.

    A null text is an empty one, which stays plain, as do texts that hold a
    sentinel; prefix_chars and middle_chars are null there.  A null key draws
    like the empty string.  Rows are handled one by one, so repeated rows give
    repeated results and an empty table an empty one; other columns are not
    read.  One pass, no shuffle; a task holds a text at a time.
    """
    k = docs.schema[key]
    schema = T.StructType(
        [
            T.StructField(key, k.dataType),
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
            T.StructField("restored", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for name, told in zip(part.column(1).to_pylist(), part.column(2)):
                    n, form, a, b, out = transform(told.as_py() or "", name, seed, fim_percent, spm_percent)
                    rows.append((n, form, a, b, out, restore(out, form)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], schema.names
                )

    rows = docs.select(docs[key], docs[key].cast("string").alias("_told"), docs[text].cast("string").alias("_text"))
    return rows.mapInArrow(run, schema)


def hashed(text: str) -> Column:
    """Lowercase hex sha256 of a text column in UTF-8."""
    return F.sha2(F.col(text).cast("binary"), 256)
