"""Remembered matches of the byte-level encoder."""

import public_tokenizers

from testpulse.llm import bpe


def test_remembered_matches_hold_what_their_ids_decode_to(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    coder = bpe.Codec(public_tokenizers.path(bpe.RANKS_FILE))
    for text in ("one two  two\n\none one's", "", "Caf\xe9 ✓ 12345 two " + "x" * 200, "\x00퟿"):
        parts = coder.parts(text)
        assert b"".join(p[2] for p in parts) == coder.decode(coder.encode(text)) == text.encode()
        assert [p[3] for p in parts] == [len(p[0]) for p in parts]
        assert [p[1] for p in parts] == [" ".join(map(str, p[0])) for p in parts]
