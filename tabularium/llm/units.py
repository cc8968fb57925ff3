"""Texts cut where byte-level tokenizers cannot join: before a space that stands between two solid characters.

Ids of a unit do not depend on its neighbours, so a bounded memo of units serves whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_CROWDED = re.compile(r" \s|\s ")  # a space beside white space belongs to what the pattern makes of both
SEGMENT = 1 << 20  # characters of one text handled at once


def segments(text: str) -> Iterator[str]:
    """The text in stretches of about SEGMENT characters; each but the first begins with a space between solid characters."""
    start = 0
    while len(text) - start > SEGMENT:
        at = text.find(" ", start + SEGMENT)
        while at >= 0 and (text[at - 1].isspace() or text[at + 1:at + 2].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


class Memo(dict):
    """Values of short strings, made when they are first asked for: the latest up to ``limit`` of them or ``most`` bytes, twice. Long ones are not kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int, most: int = 24 << 20):
        super().__init__()
        self.make, self.limit, self.most, self.held = make, limit, most, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 48:
            if len(self) >= self.limit or self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += len(key) + len(value)
        return value


class UnitEncoder:
    """``encode_all(list of str) -> list of bytes`` for whole texts, with a memo of units."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], limit: int = 200_000):
        self.encode_all = encode_all
        self.first = Memo(lambda unit: encode_all([unit])[0], limit // 8)  # opens a stretch, without a space
        self.memo = Memo(lambda unit: encode_all([" " + unit])[0], limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Encoded bytes of each text."""
        known = self.memo.__getitem__
        out = []
        for text in texts:
            steps: list[bytes] = []
            for part in segments(text):
                if _CROWDED.search(part):
                    steps += self.encode_all([part])
                    continue
                units = part.split(" ")
                steps.append(self.first[units[0]])
                steps += map(known, units[1:])
            out.append(b"".join(steps))
        return out
