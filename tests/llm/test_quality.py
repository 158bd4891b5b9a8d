import itertools
import random
import re
from collections import Counter

import numpy as np

import costlens.llm.quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def base(t):
    t = t or ""
    w = re.findall(WORD, t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    seen, repeats = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            repeats += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(again), failed


def corpus():
    random.seed(6)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(240):
        lines = [" ".join(random.choices(words, k=15)).capitalize() + "." for _ in range(8)]
        if i % 4 == 0:
            lines = [" | ".join(random.choices(words, k=9)) + " ###" for _ in range(8)]
        elif i % 4 == 1:
            lines.insert(3, "home | about | contact")
        rows.append((i, "\n".join(lines), int(i % 4 != 0)))
    return rows


def test_fit_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:160]], "doc_id long, quality int, toxic int")
    field = Q.train(docs, labels)
    got = {r.doc_id: r for r in Q.quality_report(docs, field).collect()}
    for i, t, good in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
        assert r.kept == bool(good), i
    kept = Q.keep_good(docs, field)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, good in rows if good} and kept.columns == docs.columns


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(2)
    field = Q.Field(rng.normal(size=(sum(Q.SIZES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for _ in range(50):
        codes = rng.integers(0, int(np.prod(Q.SIZES)), 6).tolist()

        def total(marks):
            s = field.start[marks[0]] + Q.LEAN * marks[0] + sum(field.scores(c)[m] for c, m in zip(codes, marks))
            return s + sum(field.move[a][b] for a, b in zip(marks, marks[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=total)
        assert tuple(field.decode(codes)) == best


def test_repeats_in_long_texts():
    random.seed(1)
    t = " ".join(random.choice("ab") for _ in range(400)) + " " + " ".join(map(str, range(30_000)))
    field = Q.fit_field([], [])
    assert Q.judge(t, field)[:6] == base(t)


def test_rows(odd_rows, no_rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = Q.train(odd_rows, labels)  # no label at all: every line is content
    got = Q.quality_report(odd_rows, field)
    want = sorted((r.doc_id or 0, *base(r.text)) for r in odd_rows.collect())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id or 0, *(r[c] for c in counts)) for r in got.collect()) == want
    assert Q.keep_good(odd_rows, field).columns == odd_rows.columns
    assert Q.quality_report(no_rows, field).count() == 0 and Q.keep_good(no_rows, field).count() == 0
