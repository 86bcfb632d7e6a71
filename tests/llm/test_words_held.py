"""What worker processes keep of the words they meet."""

from __future__ import annotations

import random
import types
from types import SimpleNamespace

import brute
import numpy as np
import sentencepiece

from postmill.llm import hashing, spm, words


def test_pieces_of_words_in_steady_use_stay(monkeypatch):
    monkeypatch.setattr(spm, "HELD", 40)
    model = spm.Pieces(brute.PIECES)
    split, asked = model.split, []
    monkeypatch.setattr(model, "split", lambda chunk: asked.append(chunk) or split(chunk))
    for i in range(200):
        model.digest(f"steady w{chr(97 + i % 26)}x{chr(97 + i // 26)}q")
    assert asked.count(f"{spm.SPACE}steady") == 1
    assert len(model.words) + len(model.words.before) <= 50


def test_pieces_of_odd_texts_after_ageing(monkeypatch):
    monkeypatch.setattr(spm, "HELD", 6)
    model, library = spm.Pieces(brute.PIECES), sentencepiece.SentencePieceProcessor(model_file=brute.PIECES)
    texts = ["a  b ", " ", "  lead", f"{spm.SPACE}a {spm.SPACE}{spm.SPACE}b", "日本 語\n", "𝔘 ⁇ x", "x.,!?y", "ab ab ab", "\x00 \x01"]
    for text in texts * 2:
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
        assert model.digest(text)[0] == len(ids) and model.digest(text)[2] == spm.hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_ids_of_words_in_steady_use_stay(monkeypatch):
    monkeypatch.setattr(words, "HELD", 40)
    encoder = words.WordEncoder(brute.WORDS)
    part, asked = encoder.parts.learn, []
    encoder.parts.learn = lambda p: asked.append(p) or part(p)
    texts = [f"Steady, steady w{chr(97 + i % 26)}x{chr(97 + i // 26)}q STEADY." for i in range(200)]
    got = [encoder.encode([t])[0] for t in texts]
    assert asked.count("steady") == 1
    assert got == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]


def test_pieces_are_cut_as_the_tokenizer_cuts_them():
    rng = random.Random(4)
    plain = [c for c in map(chr, range(256)) if words._PLAIN_TEXT.fullmatch(c)]
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 30))) for _ in range(500) for chars in (plain, 3 * "'" + " strevelmd LSDT .,19é\n\tÀÿß")]
    texts += ["'", " ", "a'", "'s", "'r", "e", "''s", "'s's", "I'LL'd", "\t", "x" * 5000]
    want = [words._CUT.findall(t.lower()) for t in texts]
    counts, pieces = words.cut([t.encode("latin-1") for t in texts])
    assert counts.tolist() == list(map(len, want))
    assert [p.decode("latin-1") for p in pieces.to_pylist()] == [p for w in want for p in w]
    encoder = words.WordEncoder(brute.WORDS)
    texts += ["", None, "日本 x", "<|end|> a", "\x1c b"]
    got = encoder.encode(texts)
    assert got == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]


def test_pieces_are_looked_up_once_a_batch():
    class Counted(hashing.Known):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    encoder = words.WordEncoder(brute.WORDS)
    encoder.parts = Counted(encoder._part)
    assert len(encoder.encode(["one two, one " * 50, "Two ONE"] * 20)) == 40
    assert Counted.asked == 3


def test_workers_let_go_of_what_a_later_stage_does_not_ask_for(monkeypatch):
    stage = SimpleNamespace(stageId=lambda: 1)
    monkeypatch.setattr(hashing, "TaskContext", SimpleNamespace(get=lambda: stage))
    monkeypatch.setitem(hashing.sys.modules, "_postmill_kept", types.ModuleType("_postmill_kept"))
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [hashing.kept(x, make(x)) for x in "abab"] == list("abab") and made == list("ab")
    stage.stageId = lambda: 2
    assert [hashing.kept(x, make(x)) for x in "aca"] == list("aca") and made == list("abc")
    assert hashing.kept("b", make("b")) == "b" and made == list("abcb")
