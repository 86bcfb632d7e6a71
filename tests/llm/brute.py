"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def shingles(text: str | None, n: int) -> frozenset:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*(w[i:] for i in range(n)), strict=False))


def groups(rows: list[tuple[int, str | None]], n: int, threshold: int = 80) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable."""
    sets = {i: shingles(t, n) for i, t in rows}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def repeats(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(window)
        rest = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        runs = sum(1 for p, c in enumerate(cover) if c and (p == 0 or not cover[p - 1]))
        out[i] = (len(raw), sum(cover), runs, hashlib.sha256(rest).hexdigest())
    return out


def word_ids(rows: list[tuple[int, str | None]]) -> dict[int, np.ndarray]:
    """Ids by the library itself, with the end id."""
    t = Tokenizer.from_file(WORDS)
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in rows}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def check_packed(pieces: list, ids: dict[int, np.ndarray], window: int = 2048) -> None:
    """Each id lies in exactly one piece, sequences are gapless and at most `window` long, and hardly padded."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == crc(ids[i][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
