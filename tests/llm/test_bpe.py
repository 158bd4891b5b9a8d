import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from costlens.llm.bpe import Codec, decode_documents, encode_documents, read_tokenizer
from costlens.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def codec():
    return Codec(read_tokenizer(tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_random_texts(codec, library):
    random.seed(1)
    alphabets = [
        "abc", "aab", "the in an re", "éèüßÀİΣσς ", "<|endoftext|>", "0123 456", "日本語한국é ", "🎉👍‍",
        "'s're'LL \n\t\x0b\x1c\x85\xa0", "!!??.,--", "áë ", "\x00\x01\x7f",
    ]
    texts = []
    for k in range(3000):
        t = "".join(random.choice(random.choice(alphabets)) for _ in range(random.choice([1, 5, 20, 60])))
        texts.append(t + "<|startoftext|>" * (k % 7 == 0))
    for t, got in zip(texts, codec.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, t), repr(t)


@pytest.mark.parametrize("text", ["", "ab" * 20_000, "aaaa" * 3000 + " " + "é" * 9001, "thththeinin" * 2000])
def test_long_words(codec, library, text):
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert ids.tolist() == ids_of(library, text)
    assert codec.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_one_word_at_a_time_gives_the_same(codec):
    words = ["the", "thtionsh", "ééqu", "x", "reenininin", "ÿ", "123"]
    assert codec.encode_words(words) == [codec.encode_word(w) for w in words]


def test_rows(odd_rows, library):
    enc = encode_documents(odd_rows, tokenizer_path())
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in enc.collect())
    want = []
    for r in odd_rows.collect():
        ids = ids_of(library, r.text)
        told = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append((r.doc_id or 0, len(ids), told, back))
    assert got == sorted(want)
    for r in decode_documents(enc, tokenizer_path()).collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_empty(no_rows):
    assert encode_documents(no_rows, tokenizer_path()).count() == 0
