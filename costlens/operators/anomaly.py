"""Anomaly detection per service.

ANO-1/2 is an isolation forest (Liu, Ting, Zhou, ICDM 2008) on one column,
fitted and scored per group (service) entirely inside Spark:

* fit: rows are hash-sampled to (group, tree) pairs so each tree sees at most
  `psi` rows; `groupBy(group).applyInPandas` builds a group's trees from its
  sample (<= trees x psi rows, never a whole service);
* score: a group's trees are merged into one step function of the value, which
  two binary searches in DataFrame functions look up — rows are neither
  shuffled nor sent to Python, and nothing passes through the driver.

ANO-3..6 (offset, labels, threshold search) are plain aggregates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.session import materialize as _write_once

# Threshold search start per service, the target hit ratio, the
# step and the step limit used by the reference.
THRESHOLD_STARTS = {
    "AmazonCloudWatch": 0.0005,
    "AmazonEC2": 0.3,
    "AmazonEKS": 1.5,
    "AmazonS3": 0.00001,
    "AmazonVPC": 0.1,
    "AWSConfig": 0.5,
    "AWSKMS": 0.05,
    "ComputeEngine": 14.0,
    "KubernetesEngine": 5.35,
    "Networking": 1.4,
}
TARGET_ACCURACY = 95.0
MAX_ITERATIONS = 100
STEP = 0.0001

EULER = 0.5772156649


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n > 2:
        return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    if n == 2:
        return 1.0
    return 0.0


MAX_BROADCAST_GROUPS = 100_000


def per_group(df: DataFrame) -> DataFrame:
    """A table of one row per group, written once and broadcast if it is small (a checked count)."""
    df = _write_once(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_GROUPS else df


# ------------------------------------------------------------------ ANO-3..6
def contamination_offset(scores: DataFrame, group: str, raw: str = "raw", q: float = 0.2,
                         exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """ANO-3: per group, the `q` quantile of raw scores (linear interpolation,
    as numpy).  `exact=False` uses the mergeable `percentile_approx` sketch."""
    if exact:
        return exact_quantile(scores, group, raw, q, accuracy)
    p = F.percentile_approx(raw, q, accuracy)
    return scores.groupBy(group).agg(p.cast("double").alias("offset"))


def exact_quantile(scores: DataFrame, group: str, raw: str, q: float, accuracy: int = 100000) -> DataFrame:
    """(group, offset): the interpolated `q` quantile, exact, without holding a group's distinct values.

    A mergeable sketch brackets the two order statistics that are needed (its
    rank error is at most n / accuracy); values below the bracket are counted,
    and only those inside it, a few n / accuracy rows, are ranked."""
    s = scores.select(F.col(group).alias("g"), F.col(raw).cast("double").alias("v")).where("v is not null")
    e = 3.0 / accuracy
    ends = per_group(
        s.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("v", max(0.0, q - e), accuracy).alias("lo"),
            F.percentile_approx("v", min(1.0, q + e), accuracy).alias("hi"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
        )
        # room for the neighbours of a rank where there are few rows
        .withColumn("lo", F.when(F.col("n") < accuracy, F.col("least")).otherwise(F.col("lo")))
        .withColumn("hi", F.when(F.col("n") < accuracy, F.col("most")).otherwise(F.col("hi")))
    )
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    j = s.join(ends, "g")
    below = j.groupBy("g").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.first("n").alias("n"))
    values = j.where(inside).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    to_here = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("c").over(to_here)).join(per_group(below), "g")
    h = (F.col("n") - 1).cast("double") * F.lit(float(q))
    at = lambda k: F.min(F.when(F.col("below") + F.col("upto") > k, F.col("v")))
    got = ranked.groupBy("g").agg(
        at(F.floor(h)).alias("a"), at(F.least(F.floor(h) + 1, F.col("n") - 1)).alias("b"), F.first(h - F.floor(h)).alias("w")
    )
    return got.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("offset"))


def anomaly_label(decision) -> Column:
    """ANO-4: -1 when the decision value is negative, else 1."""
    d = F.col(decision) if isinstance(decision, str) else decision
    return F.when(d < 0, F.lit(-1)).otherwise(F.lit(1))


def with_decision(scores: DataFrame, group: str, raw: str = "raw", q: float = 0.2, exact: bool = True) -> DataFrame:
    """ANO-2/3/4: decision = raw − offset(group), anomaly label from its sign."""
    return _decided(scores, per_group(contamination_offset(scores, group, raw, q, exact)), group, raw)


def _decided(scores: DataFrame, off: DataFrame, group: str, raw: str) -> DataFrame:
    return (
        scores.join(off, group)
        .withColumn("score", F.col(raw) - F.col("offset"))
        .withColumn("anomaly", anomaly_label("score"))
    )


def _ratio(hits: Column, labelled: Column) -> Column:
    return F.when(hits == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(100.0) * hits.cast("double"), labelled.cast("double"))
    )


def threshold_accuracy(labelled_scores: DataFrame, group: str, t) -> DataFrame:
    """ANO-5: 100 × count(score < t) / count(anomaly = −1) per group (0 when no hit)."""
    tcol = F.col(t) if isinstance(t, str) else F.lit(float(t))
    g = labelled_scores.groupBy(group).agg(
        F.count_if(F.col("score") < tcol).alias("hits"), F.count_if(F.col("anomaly") == -1).alias("labelled")
    )
    return g.withColumn("accuracy", _ratio(F.col("hits"), F.col("labelled")))


def lowered(start: Column, max_iter: int = MAX_ITERATIONS, step: float = STEP) -> Column:
    """`start` lowered `max_iter` times by `step`, by repeated subtraction (the
    same double the reference's loop reaches)."""
    if max_iter <= 0:
        return start
    return F.aggregate(F.sequence(F.lit(1), F.lit(int(max_iter))), start, lambda acc, _: acc - F.lit(step))


def calibrate_threshold(
    labelled_scores: DataFrame,
    group: str,
    starts: Mapping[str, float] | DataFrame = THRESHOLD_STARTS,
    target: float = TARGET_ACCURACY,
    max_iter: int = MAX_ITERATIONS,
    step: float = STEP,
    default_start: float | None = None,
) -> DataFrame:
    """ANO-6 in closed form (D5).

    Lowering t can only remove hits, so the ratio never rises while the loop
    runs: if ratio(start) reaches `target` the start is returned, otherwise
    the loop runs all `max_iter` steps.  Two conditional counts in one
    aggregate replace up to `max_iter` scans.  Groups without a start use
    `default_start`; without that too they stay, with a null threshold and a
    null accuracy.  Returns (group, threshold, accuracy, labelled)."""
    if not isinstance(starts, DataFrame):
        spark = labelled_scores.sparkSession
        starts = spark.createDataFrame([(k, float(v)) for k, v in starts.items()], f"{group} string, start double")
        starts = F.broadcast(starts)  # a row per configured service
    j = labelled_scores.join(starts, group, "left")
    if default_start is not None:
        j = j.withColumn("start", F.coalesce(F.col("start"), F.lit(float(default_start))))
    j = j.withColumn("low", lowered(F.col("start"), max_iter, step))
    g = j.groupBy(group, "start", "low").agg(
        F.count_if(F.col("score") < F.col("start")).alias("h0"),
        F.count_if(F.col("score") < F.col("low")).alias("h1"),
        F.count_if(F.col("anomaly") == -1).alias("labelled"),
    )
    r0, r1 = _ratio(F.col("h0"), F.col("labelled")), _ratio(F.col("h1"), F.col("labelled"))
    keep = r0.isNull() | (r0 >= F.lit(float(target)))
    return g.select(
        group,
        F.when(keep, F.col("start")).otherwise(F.col("low")).alias("threshold"),
        F.when(F.col("start").isNotNull(), F.when(keep, r0).otherwise(r1)).alias("accuracy"),
        "labelled",
    )


# ------------------------------------------------------------------ ANO-1 fit
MODEL_SCHEMA = "g string, tree int, psi int, splits array<double>, depths array<double>"


def _tree_seed(seed: int, g: str, tree: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{g}|{tree}".encode(), digest_size=8).digest(), "big")


def _build_tree(values: np.ndarray, rng: np.random.Generator, height: int):
    """One 1-D isolation tree as sorted split points and the path length of
    each leaf interval (depth + c(leaf size))."""
    splits: list[float] = []
    depths: list[float] = []

    def grow(x: np.ndarray, d: int):
        if d >= height or len(x) <= 1 or x.min() == x.max():
            depths.append(d + c_factor(len(x)))
            return
        s = float(rng.uniform(x.min(), x.max()))
        grow(x[x < s], d + 1)
        splits.append(s)
        grow(x[x >= s], d + 1)

    grow(values, 0)
    return splits, depths


def _fit_group(seed: int):
    """All trees of one group in one call: the input is that group's sample,
    at most trees x psi rows whatever the group's size."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = str(pdf["g"].iloc[0])
        out = {"g": [], "tree": [], "psi": [], "splits": [], "depths": []}
        for tree, part in pdf.groupby("tree", sort=True):
            vals = part["v"].to_numpy(dtype=float)
            n = len(vals)
            height = int(math.ceil(math.log2(max(n, 2))))
            rng = np.random.default_rng(_tree_seed(seed, g, int(tree)))
            splits, depths = _build_tree(vals, rng, height)
            for k, v in (("g", g), ("tree", int(tree)), ("psi", n), ("splits", splits), ("depths", depths)):
                out[k].append(v)
        return pd.DataFrame(out)

    return fit


def iforest_fit(df: DataFrame, group: str, value: str, row_id: str, trees: int = 100, psi: int = 256,
                seed: int = 42) -> DataFrame:
    """ANO-1: one isolation forest per group -> model rows (g, tree, psi, splits, depths).

    Sampling without replacement per tree at rate = min(1, 2·psi/n_group),
    then the psi lowest hashes per (group, tree) are kept, so only ~2·psi
    candidate rows per tree are ever materialised, however large the group.

    One rule for groups of every size: a row joins m = rate·trees trees on
    average, that is floor(m + u) of them with u in [0, 1) from a 53-bit hash:
    a first tree and then every `stride`-th one, both from hashes, the stride
    without a divisor in common with the number of trees.  So each tree draws
    each row with probability `rate`, and a row of a large group costs three
    hashes and no array.

    The per-group row counts (one row per group) are broadcast behind a
    checked count, so the rows themselves aren't shuffled for them."""
    d = df.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"),
                  F.col(row_id).alias("rid")).filter(F.col("v").isNotNull())
    n = per_group(d.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    rate = F.least(F.lit(1.0), F.lit(2.0 * psi) / F.col("n"))
    u = F.shiftrightunsigned(F.xxhash64(F.col("rid"), F.lit(seed)), 11).cast("double") / F.lit(2.0**53)
    joins = F.floor(rate * F.lit(float(trees)) + u).cast("int")
    strides = [s for s in range(1, trees + 1) if math.gcd(s, trees) == 1]
    start = F.pmod(F.xxhash64(F.col("rid"), F.lit(seed + 2)), F.lit(trees)).cast("int")
    stride = F.element_at(
        F.array(*[F.lit(s) for s in strides]),
        (F.pmod(F.xxhash64(F.col("rid"), F.lit(seed + 3)), F.lit(len(strides))) + 1).cast("int"),
    )
    drawn = (
        d.join(n, "g")
        .select("g", "v", "rid", joins.alias("joins"))
        .filter(F.col("joins") > 0)
        .select("g", "v", "rid", "joins", start.alias("start"), stride.alias("stride"))
    )
    turn = F.explode(F.sequence(F.lit(0), F.col("joins") - 1)).alias("turn")
    cand = drawn.select("g", "v", "rid", "start", "stride", turn).select(
        "g", "v", "rid", F.pmod(F.col("start") + F.col("turn") * F.col("stride"), F.lit(trees)).alias("tree")
    )
    h = F.xxhash64(F.col("rid"), F.col("tree"), F.lit(seed + 1))
    w = Window.partitionBy("g", "tree").orderBy(h, F.col("rid"))
    sample = cand.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= psi).select("g", "tree", "v")
    return sample.groupBy("g").applyInPandas(_fit_group(seed), MODEL_SCHEMA)


# ------------------------------------------------------------------ ANO-2 score
BLOCK = 256  # steps of a group's score function that are looked up together
STEP_SCHEMA = "g string, block int, begins double, breaks array<double>, raws array<double>"


def _merge(model: pd.DataFrame) -> pd.DataFrame:
    """The trees of a group as one step function of the value, in blocks of BLOCK steps.

    A step begins where a split of any tree is; its score is -2^(-E[h]/c(psi)),
    E[h] being the mean path length of the trees there.  At most trees x psi
    steps, whatever the group's size."""
    splits = [np.asarray(s, dtype=float) for s in model["splits"]]
    breaks = np.unique(np.concatenate(splits))
    at = np.r_[-np.inf, breaks]
    total = np.zeros(len(at))
    for s, depths in zip(splits, model["depths"]):
        total += np.asarray(depths, dtype=float)[np.searchsorted(s, at, side="right")]
    cn = c_factor(float(model["psi"].max()))
    raw = -np.power(2.0, -(total / len(model)) / cn) if cn > 0 else np.full(len(at), -1.0)
    rows = []
    for k, lo in enumerate(range(0, len(raw), BLOCK)):
        own = breaks[lo : lo + BLOCK - 1]
        part = raw[lo : lo + BLOCK]
        pad = BLOCK - 1 - len(own)  # steps that are never reached, but by infinity and NaN, which are in the last one
        rows.append((str(model["g"].iloc[0]), k, at[lo], np.r_[own, np.full(pad, np.inf)], np.r_[part, np.full(BLOCK - len(part), part[-1])]))
    return pd.DataFrame(rows, columns=["g", "block", "begins", "breaks", "raws"])


def step_function(model: DataFrame) -> DataFrame:
    """(g, block, begins, breaks, raws): each group's score by value, from its trees."""
    return model.groupBy("g").applyInPandas(_merge, STEP_SCHEMA)


def _count_not_above(df: DataFrame, array: str, value: str, size: int, out: str) -> DataFrame:
    """`df` with `out`: how many of the first size - 1 entries of a sorted array aren't above `value`.

    A binary search in as many projections as it has steps; `size` is a power of two."""
    df = df.withColumn(out, F.lit(0))
    step = size // 2
    while step:
        here = F.get(array, F.col(out) + F.lit(step - 1)) <= F.col(value)
        df = df.withColumn(out, F.when(here, F.col(out) + F.lit(step)).otherwise(F.col(out)))
        step //= 2
    return df


def iforest_score(df: DataFrame, model: DataFrame, group: str, value: str, row_id: str, trees: int = 100, psi: int = 256) -> DataFrame:
    """ANO-2: raw score (−2^(−E[h]/c(psi)), sklearn's `score_samples`) of every row.

    The group's trees are one step function, looked up by two binary searches:
    the block of steps, then the step.  Both tables are bounded by trees x psi
    numbers a group and are broadcast behind a checked count of groups, so no
    row is shuffled and none goes through Python."""
    d = df.select(F.col(group).cast("string").alias("g"), F.col(row_id).cast("long").alias("rid"),
                  F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    steps = _write_once(step_function(model))
    size = 1 << max(1, math.ceil(trees * psi / BLOCK)).bit_length()
    begins = F.sort_array(F.collect_list(F.when(F.col("block") > 0, F.col("begins"))))
    pad = F.array_repeat(F.lit(float("inf")), F.lit(size))
    blocks = steps.groupBy("g").agg(F.concat(begins, pad).alias("begins"), (F.count(F.lit(1)) - 1).cast("int").alias("last"))
    blocks = _write_once(blocks)
    few = blocks.count() <= MAX_BROADCAST_GROUPS // 100  # a group's blocks are some hundred kB at most
    told = F.broadcast if few else (lambda x: x)
    rows = _count_not_above(d.join(told(blocks), "g"), "begins", "v", size, "block")
    rows = rows.withColumn("block", F.least("block", "last")).drop("begins", "last")
    found = _count_not_above(rows.join(told(steps.drop("begins")), ["g", "block"]), "breaks", "v", BLOCK, "step")
    return found.select("g", "rid", "v", F.get("raws", F.col("step")).alias("raw"))


def step_quantile(scores: DataFrame, group: str, raw: str, q: float) -> DataFrame:
    """(group, offset): the interpolated `q` quantile of scores that take few values, from the count of each.

    The scores of a forest are steps, at most trees x psi a group: counted
    before the shuffle, and ranked by running totals."""
    counts = scores.where(F.col(raw).isNotNull()).groupBy(F.col(group).alias("g"), F.col(raw).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    each = Window.partitionBy("g")
    upto = F.sum("c").over(each.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("g", "v", upto.alias("upto"), F.sum("c").over(each).alias("n"))
    h = (F.col("n") - 1).cast("double") * F.lit(float(q))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    got = ranked.groupBy("g").agg(
        at(F.floor(h)).alias("a"), at(F.least(F.floor(h) + 1, F.col("n") - 1)).alias("b"), F.first(h - F.floor(h)).alias("w")
    )
    return got.select(F.col("g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("offset"))


def isolation_forest(df: DataFrame, group: str, value: str, row_id: str, contamination: float = 0.2,
                     trees: int = 100, psi: int = 256, seed: int = 42, materialize: bool = True) -> DataFrame:
    """ANO-1..4: fit, score, offset and label -> (group, row_id, value, raw, score, anomaly).

    `score` is the decision value (raw − offset) the reference stores in its
    `scores` column; `anomaly` is −1 / 1.

    The input is read by the group counts, the sampling and the scoring, and
    the raw scores by the offset and the labelling.  With `materialize`, the
    three input columns and the raw scores are each written once to the
    checkpoint folder, so the upstream plan (e.g. billing cleaning) and the
    scoring run once, not once per consumer."""
    df = df.select(group, value, row_id)
    if materialize:
        df = _write_once(df)
    model = iforest_fit(df, group, value, row_id, trees, psi, seed)
    raw = iforest_score(df, model, group, value, row_id, trees, psi)
    if materialize:
        raw = _write_once(raw)
    out = _decided(raw, per_group(step_quantile(raw, "g", "raw", contamination)), "g", "raw")
    return out.select(
        F.col("g").alias(group), F.col("rid").alias(row_id), F.col("v").alias(value), "raw", "score", "anomaly"
    )

