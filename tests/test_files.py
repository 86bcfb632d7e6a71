"""Files read as tables."""

import hashlib

from postmill.operators import feed as FD
from postmill.sources import files as SF


def test_assets_of_files(spark, tmp_path):
    texts = {"a.css": "body {}\n", "b.js": "  let x = 'é'\n\n", "empty.txt": ""}
    (tmp_path / "deep").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r["name"]: r["link"] for r in FD.asset_manifest(SF.file_texts(spark, str(tmp_path / "*.*"))).collect()}
    want = {n: f"{n}?checksum={hashlib.sha1(t.strip().encode()).hexdigest()}" for n, t in texts.items()}
    assert got == {n: w for n, w in want.items() if n != "empty.txt"}
