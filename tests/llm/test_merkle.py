import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import costlens.llm.merkle as M
from costlens.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = []
    for f in FIELDS:
        v = row[f]
        told.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*told)


def climb(nodes):
    """(root, for each node: digests left and right at each level) by the rule, level by level."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for n, i in enumerate(where):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[n].append((run[: i % 16], run[i % 16 + 1 :]))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        where = [i // 16 for i in where]
    return (nodes[0] if nodes else None), paths


def brute(rows, tampered):
    """Sorted (key, leaf, subroot, root, proof, folded, verified) of rows (dicts)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r["source"]].append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in names:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made.append(climb([leaf(r) for r in trees[s]]))
    root, over = climb([m[0] for m in made])
    out = []
    for s, (sub, paths), top in zip(names, made, over):
        for r, path in zip(trees[s], paths):
            path = path + top
            proof = h(*(d for left, right in path for d in left + right))
            now = leaf(r)
            if tampered(r) and r["text"] is not None:
                now = leaf(r | {"text": r["text"].translate({c: c + 32 for c in range(65, 91)})})
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r["doc_id"] or 0, leaf(r), sub, root, proof, now, now == root))
    return sorted(out)


def is_tampered(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def run(docs):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = M.leaf_digest([docs[c] for c in FIELDS[:-1]] + [lower])
    bad = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    got = M.prove(M.build_manifest(docs, presented=F.when(bad, changed))).collect()
    return sorted(
        (r.doc_id or 0, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got
    )


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_layout_is_a_permutation_and_halves_the_height(leaves):
    for height in range(M.levels_for(leaves), M.HEIGHT + 1):
        place = [M.address(k, np.arange(-(-leaves // 16**k)), leaves, height) for k in range(height + 1)]
        assert sorted(np.concatenate(place)) == list(range(M.size(leaves, height)))
        assert place[height][0] == 0
    if leaves >= 16:  # a full run lies right behind its parent
        low = M.address(0, np.arange(16), leaves, M.HEIGHT)
        assert list(low) == list(M.address(1, np.array([0]), leaves, M.HEIGHT)[0] + 1 + np.arange(16))


def test_nodes_of_a_block():
    digests = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(300)]
    nodes = M.lay_out(b"".join(digests), 3)
    root, paths = climb([d.hex() for d in digests])
    assert nodes[:32].hex() == root
    texts = [M.level_text(nodes, k, 300, 3) for k in range(3)]
    for i in (0, 15, 16, 255, 299):
        left, right = M.sides(texts, i)
        assert [("".join(a), "".join(b)) for a, b in paths[i]] == [(a.decode(), b.decode()) for a, b in zip(left, right)]
        assert M.fold(digests[i].hex().encode(), left, right).decode() == root


@pytest.mark.parametrize("height", [1, 3])
def test_trees_of_many_sizes(spark, monkeypatch, height):
    """Blocks of 16 leaves need several heights of blocks; those of 4096 need one."""
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "LEAVES", 16**height)
    monkeypatch.setattr(M, "levels_for", lambda n, most=height, f=M.levels_for: f(n, most))
    sizes = [1, 2, 16, 17, 33, 256, 257, *[1] * 30, 700]
    rows, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            rows.append((k * 7919 % 100_003, f"Text {k} Ünï", "en", None if s == 0 else f"s{s:02}", k))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute([r.asDict() for r in df.collect()], is_tampered)
    assert run(df) == want
    assert run(df.repartition(5)) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_rows(spark, odd_rows, no_rows):
    got = run(odd_rows)
    want = brute([{f: r[f] for f in FIELDS} for r in odd_rows.collect()], is_tampered)
    assert got == want
    assert run(no_rows) == []


def test_one_key_holds_most_rows(spark):
    df = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 5, id) as doc_id", "'same' as text", "'en' as lang", "'s' as source", "4L as n_chars"
    )
    got = run(df)
    assert got == brute([r.asDict() for r in df.collect()], is_tampered)


def test_query_is_one_read_and_no_text_is_shuffled(spark):
    got = QUERIES["op11_merkle"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute([r.asDict() for r in rows], is_tampered)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "text" not in got._jdf.queryExecution().toString()
