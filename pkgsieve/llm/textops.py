"""Words of a text, in bounded pieces (used inside tasks)."""
from __future__ import annotations

import re
from collections.abc import Iterator

PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, as lists of the words of about ``size``
    bytes each, so that a very long text never becomes one list."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size:
            space = _SPACE.search(text, at + size)
            end = space.start() if space else end
        words = text[at:end].split()  # bytes.split: space and U+0009..U+000D
        if words:
            yield words
        at = end
