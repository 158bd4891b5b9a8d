import math
import re

import costlens.llm.urls as U


def parts(u):
    i = (u or "").find("://")
    if i < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u[i + 3 :], re.S)
    return "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]


def rule(h, p):
    fit = [(hh + pp, v) for v, hh, pp in U.RULES if (h == hh or h.endswith("." + hh)) and p.startswith(pp)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "nothing", "http://", "http://COM/", "http://com", "https://www.example.com/en/1", "http://Example.com/en/x",
    "http://a.example.com/en/?q", "http://example.com/enx", "http://x.net/es/1#a", "http://x.net/de/", "http://xnet/es/",
    "ftp://É.net/fr/", "http://a.com?x=/y", "http://a.com#/y", "a://b.com://c.net/es/", "http://notcom/", "http://b.com/\n/",
    "//x.com/", "http://cheap-pills.org/" + "a" * 50_000,
]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 as host", "2 as key")
    got = {r.page_id: r for r in U.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        h, p = parts(u)
        name, verdict = rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, name), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
        assert (got[i].score is None) == (verdict is not None)


def test_models_learn_from_the_rules(spark):
    rows = [(i, f"http://good{i % 7}.com/page/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://spam{i % 5}.net/es/{i}") for i in range(400)]
    rows += [(2000 + i, f"http://good{i % 7}.org/page/{i}") for i in range(100)]
    rows += [(3000 + i, f"http://spam{i % 5}.org/es/{i}") for i in range(100)]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[i] == "allow" for i in range(2000, 2100)) >= 95
    assert sum(got[i] == "block" for i in range(3000, 3100)) >= 95


def test_model_is_a_distribution():
    m = U.Markov.of(["abab", "abc", "é"])
    alphabet = {c for f in m.follow.values() for c in f}
    for context in ("", "a", "ab", "zzzz", U.END * 4):
        rest = (65536 - len(alphabet)) * m.probability(context, "\u4e00")
        assert math.isclose(sum(m.probability(context, c) for c in alphabet) + rest, 1.0, rel_tol=1e-9)


def test_threshold():
    assert U.calibrate([3, 4, 5], [0, 1]) == 2.0
    assert U.calibrate([], [1.0]) == 0.0


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_scores(urls, held):
    """Scores of `urls` and the threshold, by models in memory of all URLs that a rule judges."""
    known = {"allow": [], "block": []}
    for u in urls:
        verdict = rule(*parts(u))[1]
        if verdict:
            known[verdict].append(u or "")
    fit = {v: [u for u in us if u not in held] or us for v, us in known.items()}
    good, bad = U.Markov.of(fit["allow"]), U.Markov.of(fit["block"])

    def score(u):
        t = U.END * U.ORDER + u + U.END
        logs = [math.log(m.probability(t[i : i + U.ORDER], t[i + U.ORDER]) ** s) for i in range(len(u) + 1) for m, s in ((good, 1), (bad, -1))]
        return sum(logs) / (len(u) + 1)

    at = U.calibrate(*([score(u) for u in known[v] if u in held] for v in ("allow", "block")))
    return score, at


def judged(spark, urls):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    fold = df.select(F.coalesce("url", F.lit("")).alias("u"), F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(U.FOLDS)).alias("f"))
    return {r.page_id: r for r in U.judge_urls(df).collect()}, {r.u for r in fold.collect() if r.f == 0}


def check_scores(spark, urls):
    got, held = judged(spark, urls)
    score, at = brute_scores(urls, held)
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        verdict = rule(*parts(u))[1]
        if verdict:
            assert (got[i].verdict, got[i].score) == (verdict, None)
        else:
            s = score(u or "")
            assert math.isclose(got[i].score, s, abs_tol=1e-8), u
            assert abs(s - at) < 1e-7 or got[i].verdict == ("allow" if s >= at else "block"), u


def test_learns_from_every_judged_url(spark, monkeypatch):
    """More of either verdict than the 4,000 that were drawn before; frequent and rare grams."""
    urls = [f"http://shop{i % 11}.com/page/{i * 7919 % 10007:x}" for i in range(4300)]
    urls += [f"http://spam{i % 5}.net/es/{i * 104729 % 10007:x}" for i in range(4200)]
    urls += [f"http://shop{i}.org/page/{i:x}" for i in range(60)] + ["http://é😀.org/😀es/"] * 2
    monkeypatch.setattr(U, "FREQUENT", 500)  # some grams are broadcast, the others joined
    monkeypatch.setattr(U, "FLUSH", 1000)
    check_scores(spark, urls)


def test_learns_from_long_urls(spark):
    """URLs of over 256 characters weren't drawn."""
    urls = [f"http://a{i}.com/" + "good" * 80 for i in range(30)] + [f"http://b{i}.net/es/" + "bad" * 100 for i in range(30)]
    check_scores(spark, [*urls, *urls[:7], "http://x.org/goodgood", "http://x.org/badbad", None, ""])


def test_few_judged_urls(spark):
    check_scores(spark, ["http://a.com/x", "http://b.net/es/", "http://c.org/x", "http://c.org/es/"])
    only = judged(spark, ["http://a.com/x", "http://c.org/x"])[0]
    assert [(r.verdict, r.score) for r in only.values()] == [("allow", None)] * 2


def test_threshold_of_a_table(spark):
    import random

    draw = random.Random(5)
    for n, step, low in ((0, 1, 0), (40, 10, 1), (40, 10, -1), (500, 100_000, 1)):
        g = [draw.randint(-step, 2 * step) / step for _ in range(n)]
        b = [draw.randint(-2 * step, step) / step * low for _ in range(n)]
        df = spark.createDataFrame([(s, True) for s in g] + [(s, False) for s in b], "score double, allowed boolean")
        assert math.isclose(U.threshold(df), U.calibrate(g, b), abs_tol=1e-12), (n, step)
