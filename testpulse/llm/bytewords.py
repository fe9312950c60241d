"""Words of UTF-8 texts with A-Z lower-cased: runs of digits, a-z and non-ASCII characters."""

from __future__ import annotations

from zlib import crc32

#: Every other ASCII character becomes a blank; bytes of non-ASCII characters stay.
_KEPT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text; none for null."""
    return text.translate(_KEPT).split() if text else []


def runs_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a blank."""
    if longest == 1:
        return words
    return [
        b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]


class Buckets(dict):
    """Feature to bucket, by CRC-32; remembers a bounded number of short features."""

    def __init__(self, buckets: int, limit: int = 200_000, longest: int = 64) -> None:
        super().__init__()
        self.buckets, self.limit, self.longest = buckets, limit, longest

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(feature) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[feature] = bucket
        return bucket
