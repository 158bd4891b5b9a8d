import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import costlens.llm.lm as M


def corpus(n=300, rare=0.15):
    random.seed(4)
    tongues = [[f"{c}{i}" for i in range(80)] for c in "abc"]

    def words(i):
        return [f"{'xyz'[i % 3]}{random.randrange(400)}" if random.random() < rare else random.choice(tongues[i % 3]) for _ in range(30)]

    return [(i, " ".join(words(i))) for i in range(n)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def base_scores(rows):
    tok = [(i, tokens(t)) for i, t in rows]
    c = Counter(w for i, x in tok if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    return n, sorted(
        (i or 0, len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6))
        for i, x in tok
    )


@pytest.fixture
def small(monkeypatch):
    """A vocabulary of which most words are neither types nor frequent."""
    monkeypatch.setattr(M, "FREQUENT", 200)
    monkeypatch.setattr(M, "LONG", 5)
    monkeypatch.setattr(M, "TYPES", 60)
    monkeypatch.setattr(M, "classes_for", lambda v: 9)
    monkeypatch.setattr(M, "MOST", 500)
    monkeypatch.setattr(M, "SEEN", 18)


def test_base_and_gain(spark, small):
    rows = corpus()
    got = M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, want = base_scores(rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_score_equals_the_model_by_hand(spark, small):
    """Given the words' classes, the score is the sum of transitions and emissions, one token at a time."""
    rows = [*corpus(), (500, None), (501, "a1 unseen words a2"), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    t = M.Trained(M._texts(df.withColumnRenamed("doc_id", "key")))
    told = {bytes(r.word): (r.n, r["class"]) for r in t.classes().collect()}
    train = [tokens(x) for i, x in rows if not held(i)]
    count = Counter(w for x in train for w in x)
    assert {w: n for w, (n, _) in told.items()} == dict(count) and len(told) == len(count)
    k = 9
    # unseen words: the class of most once-seen rare words of their shape
    numbered = set(t.words)
    once = Counter((M.shape(w), c) for w, (n, c) in told.items() if n == 1 and w not in numbered)
    usual = max(range(k), key=lambda c: (sum(x for (_, d), x in once.items() if d == c), -c))

    def class_of(w):
        if w in told:
            return told[w][1]
        some = [(x, -c) for (s, c), x in once.items() if s == M.shape(w)]
        return -max(some)[1] if some else usual

    pair, size, kinds = Counter(), Counter(), Counter(c for _, c in told.values())
    for x in train:
        for a, b in zip([None, *x], x):
            pair[None if a is None else class_of(a), class_of(b)] += 1
            size[class_of(b)] += 1
    total = sum(pair.values())
    left = Counter()
    for (a, _), n in pair.items():
        left[a] += n

    def move(a, b):
        share = (sum(n for (_, d), n in pair.items() if d == b) + 1) / (total + k)
        after = max(1, len([1 for (c, _) in pair if c == a]))
        return math.log10((pair[a, b] + after * share) / (left[a] + after))

    moves = {(a, b): move(a, b) for a in [None, *range(k)] for b in range(k)}
    got = {r.doc_id: r.score for r in M.score_documents(df).collect()}
    for i, text in rows:
        w = tokens(text)
        c = [class_of(x) for x in w]
        want = sum(moves[a, b] for a, b in zip([None, *c], c))
        want += sum(math.log10((count[x] + 1) / (size[y] + kinds[y] + 1)) for x, y in zip(w, c))
        assert abs(got[i] - want) < 1e-6


def test_every_training_word_moves_by_its_own_neighbours(spark, small):
    """A rare word's class raises the likelihood most, counted out by hand."""
    rows = corpus(120)
    t = M.Trained(M._texts(spark.createDataFrame(rows, "key long, text string")))
    k, number = 9, {w: i for i, w in enumerate(t.words)}
    of = lambda w: int(t.near[number[w]]) if w in number else k
    pair, near = Counter(), {}
    for i, x in rows:
        if held(i):
            continue
        w = tokens(x)
        for j, b in enumerate(w):
            a = of(w[j - 1]) if j else k + 1
            pair[a, of(b)] += 1
            if b not in number:
                near.setdefault(b, Counter())["l", a] += 1
                if j + 1 < len(w):
                    near[b]["r", of(w[j + 1])] += 1
    grow = lambda x, m: (x + m) * math.log(max(1, x + m)) - x * math.log(max(1, x))
    got = {bytes(r.word): r for r in t.rare.collect()}
    seen = {w: r for w, r in got.items() if r.n}
    assert set(seen) == set(near) and len(near) > 300
    assert (t.class_of < k).all() and (t.near == k).any()

    def gain(w, c):
        cells = near[w]
        n = sum(m for (s, _), m in cells.items() if s == "l")
        out = sum(grow(pair[b, c] if s == "l" else pair[c, b], m) for (s, b), m in cells.items())
        for total in (sum(pair[a, c] for a in range(k + 2)), sum(pair[c, b] for b in range(k + 2))):
            out -= grow(total, n)
        return out

    for w, r in seen.items():
        assert 0 <= r["class"] < k
        gains = [gain(w, c) for c in range(k)]
        assert gains[r["class"]] > max(gains) - 1e-3
    for w, r in got.items():
        assert r.n or r["class"] == k + M.shape(w)


def test_probabilities_sum_to_one(spark, small):
    """After any class, the classes' transitions and each class's words (with one unknown) add up to one."""
    t = M.Trained(M._texts(spark.createDataFrame(corpus(60), "key long, text string")))
    assert np.allclose((10**t.model.move).sum(axis=1), 1)
    words = t.classes().collect()
    for c in range(t.k):
        some = [r.n for r in words if r["class"] == c]
        assert (len(some), sum(some)) == (t.model.words[c], t.model.tokens[c])
        assert math.isclose(sum(n + 1 for n in some) + 1, 10 ** t.model.emit[c])


def test_exchange_finds_word_classes():
    rng = np.random.default_rng(0)
    big = np.zeros((31, 31))  # the last one: all other words, of which there are none
    for _ in range(20_000):  # x-words and y-words take turns
        a, b = rng.integers(0, 15), rng.integers(15, 30)
        big[a, b] += 1
        big[b, rng.integers(0, 15)] += 1
    of = M.exchange(big, 2)
    assert len(set(of[:15])) == 1 and len(set(of[15:])) == 1 and of[0] != of[15]


def test_frequent_words_beyond_the_types_find_their_tongue(spark, small):
    """The rounds put words of one tongue together: hardly a class holds two tongues' frequent words."""
    t = M.Trained(M._texts(spark.createDataFrame(corpus(rare=0.05), "key long, text string")))
    by = {}
    for w, c in zip(t.words, t.class_of):
        if w != b"\n":
            by.setdefault(int(c), Counter())[w[:1]] += 1
    right = sum(max(x.values()) for x in by.values())
    assert right > 0.9 * sum(sum(x.values()) for x in by.values())


def test_held_out_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.held_out: r for r in M.perplexity(M.score_documents(docs)).collect()}
    assert got[True].perplexity < 7478 < got[True].base_perplexity


def test_rows(odd_rows, no_rows):
    got = M.score_documents(odd_rows).collect()
    n, want = base_scores([(r.doc_id, r.text) for r in odd_rows.collect()])
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert M.score_documents(no_rows).count() == 0


def test_no_training_text(spark):
    got = M.score_documents(spark.createDataFrame([(i, "a b") for i in range(99) if held(i)], "doc_id long, text string"))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got.collect())
