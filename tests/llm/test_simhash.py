import random

import numpy as np
import pytest
import xxhash

import costlens.llm.simhash as S
from costlens.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def named(fps, bits):
    """Least index reachable over pairs within `bits`, by brute force."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def around(n, centres, seed):
    """Fingerprints close to a few centres, so that postings are shared."""
    random.seed(seed)
    out = [random.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = random.choice(out)
        for _ in range(random.choice([1, 2, 3, 4, 5])):
            x ^= 1 << random.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("large", [1024, 2])
def test_links_match_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE", large)
    fps = around(700, 40, 5)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(signed)), "key long, fp long")
    got = {r.fp: r.component_id for r in S.near_classes(df).collect()}
    assert [got[x] for x in signed] == named(fps, 3)


def test_texts(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    docs = [" ".join(random.choices(words, k=120)) for _ in range(60)]
    for k in range(60):
        w = docs[k].split()
        w[random.randrange(120)] = "changed"
        docs += [" ".join(w), docs[k].upper().replace(" ", "\t\n")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.simhash_duplicates(df).collect()}
    fps = [plain(t) for t in docs]
    assert [got[i].fingerprint for i in range(len(docs))] == [f"{x:016x}" for x in fps]
    want = named(fps, 3)
    assert [got[i].component_id for i in range(len(docs))] == want
    kept = S.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns


def test_long_text_is_read_whole():
    text = " ".join(f"a{i}" for i in range(70_000))
    assert S.simhash(text.encode()) == np.array([plain(text)], dtype=np.uint64).view(np.int64)[0]


def test_rows(odd_rows, no_rows):
    got = S.simhash_duplicates(odd_rows).collect()
    assert len(got) == odd_rows.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {1, 2, None} and {r.component_id for r in zero} == {1}
    kept = S.drop_near_duplicates(odd_rows)
    # 2 and one null key go with 1; a repeated row goes; the other null key names no one else and stays
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5]
    assert kept.columns == odd_rows.columns
    assert S.simhash_duplicates(no_rows).count() == 0 and S.drop_near_duplicates(no_rows).count() == 0


def test_repeated_key_keeps_every_component(spark):
    random.seed(4)
    texts = [" ".join(random.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(6)]
    # key 1 is the least of texts 0 to 3, and repeats there; text 4 is also under 0, which names it
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (1, texts[2]), (5, texts[2]), (1, texts[3]), (1, texts[4])]
    rows += [(0, texts[4]), (7, texts[5])]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in kept.collect()) == sorted(
        [(1, texts[0]), (1, texts[1]), (1, texts[2]), (1, texts[3]), (0, texts[4]), (7, texts[5])]
    )


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (41, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(42)} | {100 + i: 100 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
