"""Words in context are shuffled in turns."""

import pandas as pd

from postmill.llm import toxicity


def test_turns_share_out_the_pairs(monkeypatch):
    frame = pd.DataFrame({"text": ["one two three four five one two", "", "six seven one two", "ünd eight"], "tag": [0, 1, 4, 5]})
    rows = lambda: [{tuple(r) for f in toxicity._contexts([frame], t) for r in f.to_numpy().tolist()} for t in range(toxicity.TURNS)]
    shared = rows()
    assert sum(map(len, shared)) == len(set.union(*shared)) and len([s for s in shared if s]) > 1
    pairs = [{first for first, _ in s} for s in shared]
    assert sum(map(len, pairs)) == len(set.union(*pairs))
    monkeypatch.setattr(toxicity, "TURNS", 1)
    assert rows() == [set.union(*shared)]
