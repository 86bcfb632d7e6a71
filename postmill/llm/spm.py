"""SentencePiece encoding of merge-type models by backtracking, and decoding.

The library joins the best-scored adjacent pair again and again. The same result is found from left to right: at each
place the longest piece is tried first (an Aho-Corasick automaton finds all pieces of a chunk), then shorter ones. A piece may follow
another if merging the two pieces' text anew gives just these two. A place from which nothing goes on is marked
in a bitfield and not tried again.

Texts are cut where no piece contains the two characters that meet, so chunks are encoded independently and each
distinct one once per worker process while it is met again and again.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

from postmill.llm.hashing import Known, kept
from postmill.llm.rows import bounded_batches, computed

SPACE = "▁"
_OTHER = "!"
HELD = 300_000  # words, chunks and pairs of pieces kept by a worker process, half of them in each of two generations


class Pieces:
    """A model's vocabulary and the two directions of coding."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  x") != f"{SPACE}ﬁ{SPACE}{SPACE}x":
            raise ValueError("only models that leave texts as they are, with a space in front, are supported")
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.byte = {i: int(self.text[i][3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.hidden = {i for i in ids if model.is_control(i)}
        special = self.hidden | self.byte.keys() | {model.unk_id()}
        self.unknown = model.unk_id()
        self.id = {self.text[i]: i for i in ids if i not in special}
        self.score = {t: model.get_score(i) for t, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for t in self.id:
            if len(t) > 1:  # one character may always stand alone
                self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.pairs = {t[i : i + 2] for t in self.id for i in range(len(t) - 1)}
        self.by_word = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        self.fits: Known = Known(self._fit)
        self.words: Known = Known(self._word)
        self.chunks: Known = Known(self._chunk)

    def merged(self, text: str) -> list[str]:
        """Best-scored pair first, the leftmost of equal ones, until no two neighbours form a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, key: tuple[str | None, str]) -> bool:
        """Whether the second piece may follow the first one, or begin a chunk."""
        pieces = list(key) if key[0] is not None else [key[1]]
        return self.merged("".join(pieces)) == pieces

    def split(self, chunk: str) -> list[str]:
        """Pieces of a chunk; characters without a piece stand for themselves."""
        n = len(chunk)
        longest = [1] * n
        if n > 1:
            for end, size in self.automaton.iter(chunk):  # by ascending end, so the longest piece from a place comes last
                longest[end - size + 1] = size
        fits, known = self.fits, self.id
        failed, at, out, size, before = 0, 0, [], longest[0] if chunk else 0, None  # failed: bit i is set if nothing goes on from place i
        while at < n:
            while size:
                piece = chunk[at : at + size]
                if (size == 1 or piece in known) and not failed >> (at + size) & 1 and fits[before, piece]:
                    break
                size -= 1
            if size:
                out.append(piece)
                before = piece
                at += size
                if at < n:
                    size = longest[at]
            else:
                failed |= 1 << at
                if not out:
                    return self.merged(chunk)  # a vocabulary with pieces that no merges reach
                size = len(out.pop())
                at -= size
                size -= 1
                before = out[-1] if out else None
        return out

    def _chunk(self, chunk: str) -> str:
        """Ids of a chunk in decimal, with a mark in front if the text decoded from them is another one."""
        ids = []
        for piece in self.split(chunk):
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                raw = piece.encode("utf-8", "replace")
                ids += [self.byte_id[b] for b in raw] if self.byte_id else [self.unknown]
        return ("" if self.decode(ids, first=False) == chunk.replace(SPACE, " ") else _OTHER) + ",".join(map(str, ids))

    def _word(self, word: str) -> str:
        """The same of a word behind a space, cut where no piece can cross; whole characters are in one chunk, so chunks decode one by one."""
        word = SPACE + word
        pairs = self.pairs
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        if not cuts:
            return self.chunks[word]
        return ",".join([self.chunks[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; `first`: they begin a text, whose first space was put there by the encoder."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        if first and ids and text[:1] == SPACE:
            text = text[1:]
        return text.replace(SPACE, " ")

    def encode(self, text: str | None) -> list[int]:
        csv = self._csv(self._cut(text)).replace(_OTHER, "")
        return [int(i) for i in csv.split(",")] if csv else []

    def _cut(self, text: str | None) -> list[str]:
        """Words, each with the spaces before it but the first of these; joined by that one they are the text."""
        if not text:
            return []
        if not self.by_word:
            return [text.replace(" ", SPACE)]
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def _csv(self, parts: list[str]) -> str:
        for held in (self.words, self.chunks, self.fits):
            held.age(HELD // 2)
        return ",".join(map(self.words.__getitem__, parts))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, and of the text decoded from them."""
        parts = self._cut(text)
        csv = self._csv(parts)
        if _OTHER in csv:
            csv = csv.replace(_OTHER, "")
            back = self.decode([int(i) for i in csv.split(",")])
        else:
            back = " ".join(parts).replace(SPACE, " ")
        n = csv.count(",") + 1 if csv else 0
        return n, hashlib.sha256(csv.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def pieces(path: str) -> Pieces:
    return kept(f"pieces {path}", lambda: Pieces(path))


def _digests(path: str):
    def make():
        model = pieces(path)
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        return lambda frame: pd.DataFrame([model.digest(t) for t in frame["text"]], columns=names)

    return make


def _coded(path: str):
    def make():
        model = pieces(path)

        def compute(frame: pd.DataFrame) -> pd.DataFrame:
            ids = [model.encode(t) for t in frame["text"]]
            return pd.DataFrame({"ids": ids, "decoded": [model.decode(i) for i in ids]})

        return compute

    return make


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, row by row. Null texts count as empty: no ids."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return computed(ids, ["doc_id"], ["text"], _coded(model), "ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, row by row, without shipping the ids."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return computed(ids, ["doc_id"], ["text"], _digests(model), "n_tokens long, ids_sha256 string, decoded_sha256 string")
