import struct
import zlib

import xxhash

from costlens.llm.sharding import jump_shards, moved_share, shard_documents
from pyspark.sql import functions as F


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def hashed(i):
    return xxhash.xxh64_intdigest(struct.pack("<q", i), 42)


def test_matches_the_published_loop(spark):
    ids = spark.range(0, 4000).select("id", jump_shards(F.xxhash64("id"), [1, 2, 24, 25, 300]).alias("s"))
    for r in ids.collect():
        assert r.s == [jump(hashed(r.id), n) for n in (1, 2, 24, 25, 300)]


def test_rows(spark, odd_rows):
    got = shard_documents(odd_rows, 5).collect()
    assert len(got) == odd_rows.count()
    text = {r.doc_id: r.text for r in odd_rows.collect()}
    for r in got:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
            assert (r.shard, r.grown_shard) == (jump(hashed(r.doc_id), 5), jump(hashed(r.doc_id), 6))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_growing_moves_only_into_the_new_shard(spark):
    got = shard_documents(spark.range(20_000).selectExpr("id as doc_id", "'t' as text"), 24)
    assert got.where("shard != grown_shard and grown_shard != 24").count() == 0
    share = moved_share(got).first().share
    assert 0.03 < share < 0.05


def test_empty(no_rows):
    assert shard_documents(no_rows).count() == 0
