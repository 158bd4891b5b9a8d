"""Operator 8: URL filters.

Host rules decide where they fit (the longest wins).  For the other URLs two
variable-order character models, one of accepted and one of rejected URLs,
give a length-normalised log-likelihood difference; a threshold calibrated on
labelled URLs that the models didn't see turns it into a verdict.

Every URL that a rule judges is learned from: one in FOLDS, by a hash of the
URL, calibrates, the others are counted.  A gram is a character with ORDER
characters before it; Spark counts the grams and works out their weights (the
logarithms of both models' ratio) from the shortest context up.  Weights of
frequent grams are broadcast, the other grams of a URL are joined with theirs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.session import scratch_table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4  # characters of context at most
FOLDS = 5  # one in so many of the URLs that a rule judges calibrates the threshold
FREQUENT = 100_000  # a gram is broadcast if it is one in so many of those asked for: never more grams than that
FLUSH = 250_000  # grams that a task holds before it sends them on
ONE = 1 << 32  # weights are whole numbers of this part, so that sums don't depend on their order
BINS = 1000  # of a unit of score, in the search for the threshold
END = "\n"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, the longer, go first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Character model of orders 0 to ORDER, each interpolated with the next shorter one (Witten-Bell).

    In memory, for few texts; `weights` is the same for a table of counts."""

    def __init__(self, follow: dict[str, Counter[str]]):
        self.follow = follow

    @classmethod
    def of(cls, texts: list[str]) -> Markov:
        follow: dict[str, Counter[str]] = defaultdict(Counter)
        for t in texts:
            t = END * ORDER + t + END
            for i in range(ORDER, len(t)):
                for k in range(ORDER + 1):
                    follow[t[i - k : i]][t[i]] += 1
        return cls(dict(follow))

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / 65536  # any character at all
        for k in range(len(context) + 1):
            seen = self.follow.get(context[len(context) - k :])
            if seen is None:
                break
            total, kinds = seen.total(), len(seen)
            p = (seen[char] + kinds * p) / (total + kinds)
        return p


def calibrate(good: list[float], bad: list[float]) -> float:
    """The threshold with the best mean of both recalls: midway between neighbouring scores; 0 without scores of both.

    In memory; `threshold` is the same for a table of scores."""
    if not good or not bad:
        return 0.0
    marks = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
    below_good = below_bad = 0
    best, at = 1.0 / 2, marks[0][0]  # all allowed
    for k, (s, g) in enumerate(marks):
        below_good += g
        below_bad += 1 - g
        nxt = marks[k + 1][0] if k + 1 < len(marks) else s + 1.0
        value = ((len(good) - below_good) / len(good) + below_bad / len(bad)) / 2
        if nxt > s and value > best:
            best, at = value, (s + nxt) / 2
    return at


def _grams(url: str) -> Iterator[str]:
    t = END * ORDER + url + END
    return (t[i : i + ORDER + 1] for i in range(len(url) + 1))


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, good, bad, asked) of `rows` (url, good, bad, asked): how often URLs with either flag hold a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], ...] = (Counter(), Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                n, none = pa.array(list(c.values()), pa.int64()), pa.array([0] * len(c), pa.int64())
                counts = [n if j == k else none for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *counts], ["gram", "good", "bad", "asked"])
                c.clear()

        for batch in batches:
            flags = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            for url, told in zip(batch.column(0), flags):
                for c, flag in zip(seen, told):
                    if flag:
                        c.update(_grams(url.as_py()))
                if sum(map(len, seen)) > FLUSH:
                    yield from flush()
        yield from flush()

    found = rows.select("url", "good", "bad", "asked").mapInArrow(run, "gram string, good long, bad long, asked long")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "asked")])


def weights(counts: DataFrame) -> DataFrame:
    """(gram, asked, weight long) of the grams that are asked for: the logarithm of both models' ratio, times ONE.

    Each order is interpolated with the next shorter one, as in `Markov`.  A
    window holds what follows one context: no more rows than there are
    characters.
    """
    levels = [counts]
    for k in range(ORDER, 0, -1):  # the first character goes
        shorter = levels[-1].groupBy(F.substring("gram", 2, k).alias("gram"))
        levels.append(shorter.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "asked")]))
    told = None
    for k, level in enumerate(reversed(levels)):  # k characters of context
        same = Window.partitionBy(F.substring("gram", 1, k))
        level = level.select(
            "*",
            *[F.sum(c).over(same).alias(f"{c}_total") for c in ("good", "bad")],
            *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(same).alias(f"{c}_kinds") for c in ("good", "bad")],
        )
        if told is None:  # any character at all
            level = level.select("*", *[F.lit(1.0 / 65536).alias(f"{c}_less") for c in ("good", "bad")])
        else:
            less = told.select(F.col("gram").alias("less"), *[F.col(f"{c}_p").alias(f"{c}_less") for c in ("good", "bad")])
            level = level.join(less, F.substring("gram", 2, k) == F.col("less"))
        p = {
            c: F.when(
                F.col(f"{c}_total") > 0,
                (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_less")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds")),
            ).otherwise(F.col(f"{c}_less"))
            for c in ("good", "bad")
        }
        told = level.select("gram", "asked", *[v.alias(f"{c}_p") for c, v in p.items()])
    ratio = F.log(F.col("good_p") / F.col("bad_p"))
    return told.where("asked > 0").select("gram", "asked", F.round(ratio * ONE).cast("long").alias("weight"))


def add_weights(rows: DataFrame, weighed: DataFrame) -> DataFrame:
    """(id, total) of `rows` (id, url): the sum of the weights of a URL's grams, of which `weighed` has every one."""
    asked = weighed.agg(F.sum("asked").alias("n")).first()["n"] or 0
    often = weighed.where(F.col("asked") * FREQUENT >= asked).select("gram", "weight").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in often.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        ids: list[int] = []
        grams: list[str | None] = []
        ns: list[int] = []  # times of a gram; without a gram, the sum of the known ones

        def flush() -> pa.RecordBatch:
            out = [pa.array(ids, pa.int64()), pa.array(grams, pa.string()), pa.array(ns, pa.int64())]
            for x in (ids, grams, ns):
                x.clear()
            return pa.RecordBatch.from_arrays(out, ["id", "gram", "n"])

        for batch in batches:
            for i, url in zip(batch.column(0).to_pylist(), batch.column(1)):
                total, rest = 0, Counter()
                for g in _grams(url.as_py()):
                    w = known.get(g)
                    if w is None:
                        rest[g] += 1
                    else:
                        total += w
                ids += [i] * (len(rest) + 1)
                grams += [None, *rest]
                ns += [total, *rest.values()]
                if len(ids) > FLUSH:
                    yield flush()
        yield flush()

    parts = scratch_table(rows.select("id", "url").mapInArrow(run, "id long, gram string, n long"), "url-grams")
    rest = parts.join(weighed, "gram").select("id", (F.col("n") * F.col("weight")).alias("n"))
    return parts.where("gram is null").select("id", "n").unionAll(rest).groupBy("id").agg(F.sum("n").alias("total"))


def threshold(scored: DataFrame) -> float:
    """`calibrate` for a table (score, allowed boolean) of any size: bins are summed up, then the scores of each bin."""
    ok = F.col("allowed").cast("long")
    marks = scored.groupBy("score").agg(F.sum(ok).alias("good"), F.sum(1 - ok).alias("bad"))
    marks = scratch_table(marks.withColumn("bin", F.floor(F.col("score") * BINS)), "url-scores")
    sums = [F.sum(c).alias(c) for c in ("good", "bad")]
    n = marks.agg(*sums, F.min("score").alias("least")).first()
    if not n.good or not n.bad:
        return 0.0
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
    bins = marks.groupBy("bin").agg(*sums)
    bins = bins.select("bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("good", "bad")])
    upto = Window.partitionBy("bin").orderBy("score")
    below = {c: F.col(f"{c}_before") + F.sum(c).over(upto) for c in ("good", "bad")}
    value = ((n.good - below["good"]) / n.good + below["bad"] / n.bad) / 2
    best = marks.join(bins, "bin").select("score", value.alias("value")).orderBy(F.desc("value"), "score").first()
    if best.value <= 1 / 2:  # all allowed
        return n.least
    above = marks.where(F.col("score") > best.score).agg(F.min("score").alias("next")).first()["next"]
    return (best.score + (best.score + 1.0 if above is None else above)) / 2


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """`key`, host, path, rule, verdict, score of every row of `pages`.

    Where no rule fits, rule is null and the models decide; score is their
    difference there (null where a rule fits).  Null URLs are judged as empty
    ones.  Without labelled URLs of both verdicts every other URL is allowed.
    Repeated rows and null keys get a row each, and repeated URLs count each
    time; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(pages[key].alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "key", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = scratch_table(rows.select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    known = F.col("verdict").isNotNull()
    held = known & (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0)
    result = ("host", "path", "rule")
    ruled = judged.where(known).select(F.col("key").alias(key), *result, "verdict", F.lit(None).cast("double").alias("score"))
    told = judged.where(known).groupBy("verdict").agg(F.min(held.cast("int")).alias("all_held")).toArrow().to_pylist()
    all_held = {r["verdict"]: r["all_held"] == 1 for r in told}  # a verdict all of whose URLs are held learns from these
    if len(all_held) < 2:
        rest = judged.where(~known).select("key", *result, F.lit("allow"), F.lit(None).cast("double"))
        return ruled.unionAll(rest)

    def fits(v: str) -> Column:
        return F.coalesce(F.col("verdict") == v, F.lit(False)) & (F.lit(all_held[v]) | ~held)

    flagged = judged.select("url", fits("allow").alias("good"), fits("block").alias("bad"), (~known | held).alias("asked"))
    weighed = scratch_table(weights(scratch_table(count_grams(flagged), "url-counts")), "url-weights")
    asked = judged.where(~known | held)
    totals = scratch_table(add_weights(asked, weighed), "url-totals")
    score = F.col("total") / ONE / (F.char_length("url") + 1)
    scored = asked.join(totals, "id").withColumn("score", score)
    least = threshold(scored.where(known).select("score", (F.col("verdict") == "allow").alias("allowed")))
    said = F.when(F.col("score") >= least, "allow").otherwise("block")
    return ruled.unionAll(scored.where(~known).select("key", *result, said, "score"))
