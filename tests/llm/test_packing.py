import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from costlens.llm.packing import fit_counts, pack_documents, patterns, plan
from costlens.llm.queries import tokenizer_path


def best_fit(counts, capacity):
    from bisect import bisect_left, insort

    spaces, n = [], 0
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            at = bisect_left(spaces, length)
            space = spaces.pop(at) if at < len(spaces) else capacity
            n += at == len(spaces) and space == capacity
            if space > length:
                insort(spaces, space - length)
    return n


def check(rows, n, counts, capacity):
    placed = np.zeros(capacity + 1, dtype=int)
    spans = []
    for length, first, count, each, sequence, offset in rows:
        assert first == placed[length] and count % each == 0
        placed[length] += count
        spans += [(sequence + j // each, offset + j % each * length, length) for j in range(count)]
    assert (placed == counts).all()
    spans.sort()
    end = {}
    for s, o, length in spans:
        assert o == end.get(s, 0)
        end[s] = o + length
    assert sorted(end) == list(range(n)) and all(e <= capacity for e in end.values())


def test_patterns():
    assert patterns(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)]


def test_fit_counts_is_the_nonnegative_least_squares_solution():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = fit_counts(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope @ x) < 1e-6


@pytest.mark.parametrize("kind", ["logn", "big", "tiny", "half", "mid", "one", "none"])
def test_plan(kind):
    rng = np.random.default_rng(1)
    length = {
        "logn": np.minimum(4096, np.exp(rng.normal(6.5, 1, 20_000))),
        "big": rng.integers(1000, 4097, 4000),
        "tiny": rng.integers(1, 30, 5000),
        "half": np.r_[np.full(500, 2049), np.full(700, 100)],
        "mid": rng.integers(500, 1500, 8000),
        "one": np.array([5]),
        "none": np.array([], dtype=int),
    }[kind].astype(int)
    counts = np.bincount(length[length > 0], minlength=4097)
    rows, n = plan(counts, 4096)
    check(rows, n, counts, 4096)
    assert n <= best_fit(counts, 4096) + 1


def test_rows(odd_rows):
    library = Tokenizer.from_file(tokenizer_path())
    got = pack_documents(odd_rows, tokenizer_path(), capacity=64).collect()
    want = []
    for r in odd_rows.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 64)):
            cut = ids[start : start + 64]
            want.append((r.doc_id or 0, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    end = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 64


def test_empty(no_rows):
    assert pack_documents(no_rows, tokenizer_path()).count() == 0
