"""Operator 3: BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word's tokens are found left to right: at each place the longest vocabulary
match that is compatible with the token before it is taken; where none is
left, the last token is given up for its next shorter match and the place is
marked dead.  Two neighbours are compatible if no merge across their border
would have come before the merges that built them.  As the encoding of every
prefix is unique, a dead place stays dead, so the work is linear in the word.

The model is a word-level BPE file of the `tokenizers` library (byte alphabet,
word-end suffix, no decoder).
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from costlens.llm.common import worker_cache

END = "\n"  # stands for the word-end suffix inside the encoder; no word holds white space
BLOCK = 4096  # a word's matches are listed for so many places at a time
MEMO = 300_000  # words whose ids a worker keeps at once
MEMO_WORD = 48  # longer words are encoded anew each time

# The letters and digits among the first 256 code points, lower case,
# as the tokenizer file's pattern (contractions, letter runs, single digits, other runs) sees them.
_L1 = "a-zªµºß-öø-ÿ"
_N1 = "0-9²³¹¼½¾"
_WORDS1 = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L1}]+|[{_N1}]|[^\t-\r \x85\xa0{_L1}{_N1}]+")
_WIDE = re.compile("([^ ]*[^\x00-\xff ][^ ]*)")  # runs between spaces with a code point above 255


def byte_letters() -> list[str]:
    """The printable letter that byte-level models write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Table:
    """Byte strings of all ids end to end, with their offsets; `join` writes many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.at = np.zeros(len(strings) + 1, dtype=np.int64)
        np.cumsum([len(s) for s in strings], out=self.at[1:])

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        first = self.at[ids]
        length = self.at[ids + 1] - first
        end = np.cumsum(length)
        place = np.repeat(first - (end - length), length)
        place += np.arange(end[-1])
        return self.blob[place].tobytes()


class Codec:
    """Encoder and decoder of one tokenizer file, given as bytes."""

    def __init__(self, file: bytes):
        import ahocorasick

        self.file, self._library = file, None
        d = json.loads(file)
        model = d["model"]
        suffix = model["end_of_word_suffix"]
        inner = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.letters = byte_letters()
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        vocab = model["vocab"]
        self.pair: dict[tuple[int, int], int] = {}  # two ids -> rank of their merge
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> left id, right id, rank
        made = []
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((left, right), rank)
            if whole not in self.parts:
                self.parts[whole] = (left, right, rank)
                made.append(whole)
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        # A token that merging its own letters doesn't give can't occur in an encoding.
        lost: set[int] = set()
        for t in made:
            left, right, rank = self.parts[t]
            if left in lost or right in lost or self._crossed(left, right, rank):
                lost.add(t)
        self.find = ahocorasick.Automaton()
        self.longest = 1
        for t, i in self.ids.items():
            if i not in lost and t != END:
                self.find.add_word(t, i << 10 | len(t))
                self.longest = max(self.longest, len(t))
        self.find.make_automaton()

        strings = dict.fromkeys(range(max([*vocab.values(), *self.special.values()]) + 1), "")
        strings |= {i: t for t, i in (vocab | self.special).items()}
        self.texts = Table([f"{strings[i]} ".encode() for i in range(len(strings))])
        self.numbers = Table([b"%d " % i for i in range(len(strings))])
        self.memo: dict[str, bytes] = {}
        self.at_pair = np.full(1 << 20, -1, dtype=np.int64)  # pairs met before, by a hash of the two ids
        self.fit_pair = np.zeros(1 << 20, dtype=bool)

    @property
    def library(self):
        """The library's tokenizer, loaded when a text needs its normalizer."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.file.decode())
        return self._library

    # -- pair compatibility

    def _border(self, token: int, side: int, top: int) -> list[tuple[int, int]]:
        """The tokens at one edge of `token` while it was built, each with the rank at which it went into the next."""
        out, gone = [(token, top)], top
        while token in self.parts:
            gone = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, gone))
        return out

    def _crossed(self, a: int, b: int, top: int | None = None) -> bool:
        """Whether some merge over the border of `a` and `b` comes before the merges that built them.

        Equal ranks run left to right, so at a tie the border's merge loses to
        one on its left and wins against one on its right.
        """
        never = 1 << 60
        if top is None:
            if a not in self._right:
                self._right[a] = self._border(a, 1, never)
            if b not in self._left:
                self._left[b] = self._border(b, 0, never)
            left, right = self._right[a], self._left[b]
        else:
            left, right = self._border(a, 1, top), self._border(b, 0, top)
        for x, x_gone in left:
            for y, y_gone in right:
                rank = self.pair.get((x, y))
                if rank is not None and rank < x_gone and rank <= y_gone:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            got = self._fits[a, b] = not self._crossed(a, b)
        return got

    # -- encoding

    def _matches(self, s: str, block: int) -> list[list[tuple[int, int]]]:
        """For each place of a block of `s`: (end, id) of the vocabulary matches there, shortest first."""
        base = block * BLOCK
        size = min(BLOCK, len(s) - base)
        at: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, code in self.find.iter(s[base : base + size + self.longest]):
            start = end + 1 - (code & 1023)
            if start < size:
                at[start].append((base + end + 1, code >> 10))
        return at

    def encode_letters(self, s: str) -> list[int]:
        """Ids of one word, given in the byte alphabet with the word end."""
        whole = self.ids.get(s)
        n = len(s)
        blocks = {0: self._matches(s, 0)}
        if whole is not None and blocks[0][0] and blocks[0][0][-1][0] == n:
            return [whole]
        out: list[int] = []
        starts: list[int] = []
        tried: list[int] = []  # by token: how many shorter matches are left at its start
        dead: set[int] = set()
        pos, left = 0, None
        while pos < n:
            block = pos // BLOCK
            if block not in blocks:
                if len(blocks) > 3:
                    blocks.pop(min(blocks) if min(blocks) < block else max(blocks))
                blocks[block] = self._matches(s, block)
            here = blocks[block][pos - block * BLOCK]
            k = len(here) if left is None else left
            while k:
                k -= 1
                end, i = here[k]
                if end not in dead and (not out or self.fits(out[-1], i)):
                    out.append(i)
                    starts.append(pos)
                    tried.append(k)
                    pos, left = end, None
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary can't spell this word")
                dead.add(pos)
                out.pop()
                pos, left = starts.pop(), tried.pop()
        return out

    def spell(self, word: str) -> str:
        """A word in the byte alphabet, with its end."""
        if not (word.isascii() and word.isprintable()):
            letters = self.letters
            word = "".join([letters[b] for b in word.encode()])
        return word + END

    def encode_word(self, word: str) -> bytes:
        """Ids (little-endian unsigned 32 bits) of one lower-case word as the pattern cuts it."""
        return np.array(self.encode_letters(self.spell(word)), dtype="<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """`encode_word` of many short words: the same steps, one word a lane of the arrays."""
        spelt = [self.spell(w) for w in words]
        size = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
        limit = np.cumsum(size)
        found = np.fromiter(chain.from_iterable(self.find.iter("".join(spelt))), dtype=np.int64).reshape(-1, 2)
        stop, n, token = found[:, 0] + 1, found[:, 1] & 1023, found[:, 1] >> 10
        start = stop - n
        by = np.argsort(start, kind="stable")  # ends came in order, so a place's matches are shortest first
        stop, token, start = stop[by], token[by], start[by]
        low = np.zeros(limit[-1] + 2, dtype=np.int64)  # matches at a place: low[place] to low[place + 1]
        np.cumsum(np.bincount(start, minlength=limit[-1] + 1), out=low[1:])

        dead = np.zeros(limit[-1] + 1, dtype=bool)
        chosen = np.zeros((len(words), int(size.max()) + 1), dtype=np.int64)  # matches taken so far
        depth = np.zeros(len(words), dtype=np.int64)
        place = limit - size
        last = low[place + 1]  # candidates from here down are still to try
        live = np.arange(len(words))
        while len(live):
            at, k, d = place[live], last[live] - 1, depth[live]
            some = k >= low[at]
            word, m, d1 = live[some], k[some], d[some]
            good = ~dead[stop[m]]
            inner = good & (d1 > 0)
            before = token[chosen[word[inner], d1[inner] - 1]]
            good[inner] = self.fit_many(before, token[m[inner]])
            last[word[~good]] = m[~good]
            word, m = word[good], m[good]
            chosen[word, depth[word]] = m
            depth[word] += 1
            place[word] = stop[m]
            inside = word[place[word] < limit[word]]
            last[inside] = low[place[inside] + 1]

            word = live[~some]  # nothing left here: the last token is given up
            if len(word):
                if (depth[word] == 0).any():
                    raise ValueError("the vocabulary can't spell a word")
                dead[place[word]] = True
                depth[word] -= 1
                m = chosen[word, depth[word]]
                last[word] = m
                place[word] = start[m]
            live = live[place[live] < limit[live]]
        taken = np.arange(chosen.shape[1]) < depth[:, None]
        ids = token[chosen[taken]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(depth)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def fit_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`fits` of many pairs, through a table of the pairs met before."""
        code = (a << 20) | b
        slot = ((code * 0x9E3779B1) >> 16) & (len(self.at_pair) - 1)
        out = self.fit_pair[slot]
        new = np.flatnonzero(self.at_pair[slot] != code)
        if len(new):
            pairs, back = np.unique(code[new], return_inverse=True)
            fresh = np.array([not self._crossed(c >> 20, c & 0xFFFFF) for c in pairs.tolist()])
            out[new] = fresh[back]
            slot = ((pairs * 0x9E3779B1) >> 16) & (len(self.at_pair) - 1)
            slot, one = np.unique(slot, return_index=True)  # of pairs that share a slot one is kept
            self.at_pair[slot], self.fit_pair[slot] = pairs[one], fresh[one]
        return out

    def _wide(self, chunk: str) -> bytes:
        """A run without spaces that holds letters beyond Latin-1: the library's own normalizer and cutting."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return b"".join([np.array(self.encode_letters(p + END), dtype="<u4").tobytes() for p, _ in pieces])

    def _cut(self, text: str) -> list[list[str] | bytes]:
        """Word lists of the plain parts of a text, between the ids of the other parts."""
        parts = [text] if self.split_special is None or "<" not in text else self.split_special.split(text)
        out: list[list[str] | bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            try:
                part.encode("latin-1")
                out.append(_WORDS1.findall(part.lower()))
            except UnicodeEncodeError:
                runs = _WIDE.split(part)
                out += [self._wide(r) if j % 2 else _WORDS1.findall(r.lower()) for j, r in enumerate(runs)]
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit numbers."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= 500_000):
                size += len(texts[end])
                end += 1
            if len(self.memo) > MEMO:
                self.memo.clear()
            cut = [self._cut(t) for t in texts[at:end]]
            new = [w for w in set().union(*[p for c in cut for p in c if isinstance(p, list)]) if w not in self.memo]
            short = [w for w in new if len(w) <= MEMO_WORD]
            for k in range(0, len(short), 4096):
                self.memo.update(zip(short[k : k + 4096], self.encode_words(short[k : k + 4096])))
            long = [w for w in new if len(w) > MEMO_WORD]
            self.memo.update((w, self.encode_word(w)) for w in long)
            get = self.memo.__getitem__
            done = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in c]) for c in cut]
            for w in long:
                del self.memo[w]
            yield from done
            at = end

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    # -- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of `ids`: the tokens' own strings, one space between."""
        return self.texts.join(ids)[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.numbers.join(ids)[:-1]


def codec_of(file: bytes) -> Codec:
    return worker_cache("bpe", zlib.crc32(file), lambda: Codec(file))


def read_tokenizer(path: str) -> bytes:
    """The tokenizer file, read on the driver (a few MB at most) and sent to the tasks as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """`key`, ids array<int> (if `with_ids`), n_tokens, ids_sha256, decoded_sha256 for every row.

    ids_sha256: lowercase hex of the decimal ids joined by one space.
    decoded_sha256: of the UTF-8 text that decoding the ids gives.  A null or
    empty text has no ids; both hashes are then those of nothing.  Null keys
    and repeated rows give a row each; an empty table gives an empty result;
    other columns are not read.
    """
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    fields = [
        T.StructField(key, docs.schema[key].dataType),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, n, told, back = [], [], [], []
                for e in codec.encode_all([t or "" for t in part.column(1).to_pylist()]):
                    x = np.frombuffer(e, dtype="<u4")
                    if with_ids:
                        ids.append(x.astype(np.int32))
                    n.append(len(x))
                    told.append(hashlib.sha256(codec.decimal(x)).hexdigest())
                    back.append(hashlib.sha256(codec.decode(x)).hexdigest())
                cols = [part.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])]
                cols += [pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.select(key, docs[text].cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the text of its `ids` in a new column `out`; null ids give null."""
    file = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(file.value)
        for batch in batches:
            texts = [
                None if x.as_py() is None else codec.decode(np.array(x.as_py(), dtype=np.int64)).decode()
                for x in batch.column(batch.schema.get_field_index(ids))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)
