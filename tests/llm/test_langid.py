import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import costlens.llm.langid as M

TONGUES = {"xa": "tha ond ing er", "yb": "über dié lauf nich", "zc": "où él très jà"}


def corpus(n=240):
    random.seed(3)
    rows = []
    for i in range(n):
        lang = list(TONGUES)[i % 3]
        rows.append((i, " ".join(random.choices(TONGUES[lang].split(), k=5 + i % 60)), lang))
    return rows


@pytest.fixture(scope="module")
def net():
    return M.fit([(lang, w) for _, t, lang in corpus() for w in M._cut(t.encode())], steps=120)


def by_hand(net, text: bytes):
    """Probabilities of a text: each window through the convolution as written down, one place at a time."""
    text = text.lower()
    total, weight = 0.0, 0
    for at in range(0, max(1, len(text)), M.LENGTH):
        w = list(text[at : at + M.LENGTH])
        ids = w + [M.PAD] * (M.LENGTH + 3 - len(w))
        best = np.full(net.conv.shape[1], -np.inf)
        for p in range(M.LENGTH):
            best = np.maximum(best, np.concatenate([net.embed[i] for i in ids[p : p + 4]]) @ net.conv)
        z = np.maximum(best + net.shift, 0) @ net.out + net.bias
        e = np.exp(z - z.max())
        total, weight = total + max(1, len(w)) * e / e.sum(), weight + max(1, len(w))
    return total / weight


def test_tables_equal_the_convolution(net):
    texts = [b"", b"a", b"Tha OND ing", "über dié ".encode() * 80, b"x" * 256, b"y" * 257]
    got = M.text_probabilities(M.Tables(net.parts()), pa.array([b"before", *texts], pa.binary())[1:])
    for t, p in zip(texts, got):
        assert np.allclose(p, by_hand(net, t), atol=1e-5)
    ids = np.full((1, M.LENGTH), M.PAD)
    ids[0, :11] = list(b"tha ond ing")
    assert np.allclose(np.exp(net.forward(ids)[0][0]), by_hand(net, b"tha ond ing"), atol=1e-5)


def test_gradient_equals_differences(net):
    rng = np.random.default_rng(1)
    ids, target = rng.integers(97, 120, (4, M.LENGTH)), np.array([0, 1, 2, 0])
    loss = lambda: -net.forward(ids)[0][np.arange(4), target].mean()
    grad = net.gradient(ids, target)
    for name, part in net.parts().items():
        flat, g = part.reshape(-1), np.asarray(grad[name]).reshape(-1)
        for k in np.argsort(-np.abs(g))[:3]:
            old, step = flat[k], np.float32(2e-3)
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - g[k]) < 0.05 * max(0.02, abs(g[k]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = M.identify(docs, M.train(docs))
    share = {r.held_out: r.accuracy for r in M.accuracy(found, docs).collect()}
    assert share[True] > 0.98 and share[False] > 0.98


def test_only_training_rows_are_learned(spark):
    rows = [(i, t, lang if zlib.crc32(str(i).encode()) % 5 else "held") for i, t, lang in corpus(90)]
    rows += [(1000, "", "none"), (1001, "123", "none"), (1002, None, "none"), (1003, "tha", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert M.train(docs).labels == sorted(TONGUES)


def test_sample_is_bounded_for_hot_keys_and_languages(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'some text here' as text", "if(id % 2 = 0 or id % 3 = 0, 'xa', 'yb') as lang")
    got = M.sample(docs, "doc_id", "text", "lang", M.held_out(docs.doc_id), per_language=50).collect()
    per = {lab: [w for r in got if r.label == lab for w in r.windows] for lab in ("xa", "yb")}
    assert {k: len(v) for k, v in per.items()} == {"xa": 50, "yb": 50}


def test_rows(spark, odd_rows, no_rows, net):
    rows = odd_rows.collect()
    got = M.identify(odd_rows, net).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [x.text for x in rows if x.doc_id == r.doc_id]
        if not any(any(c.isalpha() for c in t or "") for t in want):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    long = next(r for r in got if r.doc_id == 4)
    p = by_hand(net, b"x" * 70_000 + b" end")
    assert long.lang_pred == net.labels[int(p.argmax())] and abs(long.score - p.max()) < 1e-4
    assert all(0 <= r.score <= 1 for r in got)
    assert M.identify(no_rows, net).count() == 0
    assert M.train(no_rows).labels == []
    assert {r.lang_pred for r in M.identify(odd_rows, M.train(no_rows)).collect()} == {"und"}


def test_one_language_takes_all(spark):
    docs = spark.createDataFrame([(i, "words here", "xa") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in M.identify(docs, M.train(docs)).collect()} == {("xa", 1.0)}
