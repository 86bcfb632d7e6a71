"""Token ids of whole texts by the tokenizers library, with words met lately encoded once.

The vocabulary drops white space and never merges across it, so the ids of a text are those of its words
in turn. A worker process keeps the ids of the words it has met, up to a bound, and asks the library only for the
others. Texts of the Latin-1 alphabet are cut as the tokenizer cuts them, so that a word has one entry whatever its case and the
punctuation about it: those of a batch all at once, as one array of bytes, and each different piece is looked up once a batch.
"""

from __future__ import annotations

import os
import re
from itertools import pairwise
from struct import Struct

import numpy as np
import pyarrow as pa

from postmill.llm.hashing import Known, kept

HELD = 300_000  # words whose ids a worker process keeps, half of them in each of two generations
# White space for Python but not for the tokenizer: texts with these are split at spaces and line feeds only.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
# Words of this alphabet are cut as the tokenizer cuts them; it has one lower-case form per letter and no marks to compose.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]+")
# fixed value: the tokenizer's own pattern, over the lower-case letters of that alphabet
_CUT = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-z0-9ß-öø-ÿ]+")
# The same pattern for arrays of bytes: the lower-case form of each, and what it is.
_LOWER = np.frombuffer("".join(chr(b).lower() if b != 0xB5 else chr(b) for b in range(256)).encode("latin-1"), np.uint8)
_SIGN, _LETTER, _DIGIT = 1, 2, 3
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[*range(9, 14), 32]] = 0
_KIND[[*range(97, 123), *range(223, 247), *range(248, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
# Byte-level models name bytes by characters: printable ones by their own, the others by those from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}


def cut(texts: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray]:
    """Texts in the bytes of `_PLAIN_TEXT`, cut as `_CUT` cuts their lower-case forms: the number of pieces of each, and all pieces in order."""
    # white space stands between texts, and behind the last one as far as the look ahead goes
    data = _LOWER[np.frombuffer(b" ".join([*texts, b"  "]), np.uint8)]
    kind = _KIND[data]
    begin = kind > 0
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # 's, 't, 'm, 'd, 're, 've and 'll are pieces where the quote begins a run of signs
    quote = np.flatnonzero(begin & (data == ord("'")))
    after, second = data[quote + 1], data[quote + 2]
    one = np.isin(after, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(after, np.frombuffer(b"rv", np.uint8)) & (second == ord("e")) | (after == ord("l")) & (second == ord("l"))
    begin[quote[one | two] + 1] = False
    for which, size in ((one, 2), (two, 3)):
        rest = quote[which] + size
        begin[rest] = kind[rest] > 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.flatnonzero(begin), ends), prepend=0)
    inside = kind > 0
    held = data[inside]
    offsets = np.append(np.flatnonzero(begin[inside]), len(held)).astype(np.int32)
    return counts, pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held)])


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.formats = {}
        self.parts = Known(self._part)
        self.words = Known(self._word)

    def _part(self, part: str) -> bytes:
        """Ids of one piece that the tokenizer's pattern cuts out, from the model itself."""
        named = part if part.isascii() else part.encode().decode("latin-1").translate(_NAMES)
        ids = [t.id for t in self.model.tokenize(named)]
        if len(ids) not in self.formats:
            self.formats[len(ids)] = Struct(f"<{len(ids)}{self.dtype.char}").pack
        return self.formats[len(ids)](*ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _CUT.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, all in the bytes of `_PLAIN_TEXT`."""
        if not texts:
            return []
        counts, pieces = cut(texts)
        coded = pieces.dictionary_encode()
        at = coded.indices.to_numpy()
        _, edges, spelled = coded.dictionary.buffers()
        edges, spelled = np.frombuffer(edges, np.int32)[: len(coded.dictionary) + 1].tolist(), str(spelled, "latin-1") if spelled else ""
        known = [self.parts[spelled[a:b]] for a, b in pairwise(edges)]
        size = np.array([len(k) for k in known], np.int64) // self.dtype.itemsize
        first, n = np.cumsum(size) - size, size[at]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), self.dtype)[np.arange(n.sum()) + np.repeat(first[at] - (end - n), n)]
        ends = np.append(0, end)[np.cumsum(counts)]
        return [part.tobytes() for part in np.split(ids, ends[:-1])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian and `dtype` wide. Null: none."""
        for held in (self.words, self.parts):
            held.age(HELD // 2)
        plain = [i for i, t in enumerate(texts) if t and _PLAIN_TEXT.fullmatch(t) and "<|" not in t]
        found = dict(zip(plain, self._plain([texts[i].encode("latin-1") for i in plain]), strict=True))
        word, out = self.words.__getitem__, []
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif i in found:
                out.append(found[i])
            else:
                out.append(b"".join(map(word, re.split("[ \n]+", text) if _NOT_SPACE.search(text) else text.split())))
        return out


def word_encoder(path: str) -> WordEncoder:
    return kept(f"words {path}", lambda: WordEncoder(path))
