"""Letter sequences of many texts at once, for character models.

Texts are lower-cased; whatever is no letter or mark becomes one space, and
each text begins and ends with one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

SPACE = 32
#: Bytes of text taken together; a longer text is taken alone.
CHUNK = 1 << 19

_fold: np.ndarray | None = None
_letter: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to itself where it is a letter or a mark, to a space elsewhere."""
    global _fold
    if _fold is None:
        _fold = np.full(0x110000, SPACE, dtype=np.uint32)
        # Planes 4 to 13 hold no characters.
        for c in (*range(0x40000), *range(0xE0000, 0xF0000)):
            if unicodedata.category(chr(c))[0] in "LM":
                _fold[c] = c
    return _fold


def letter_table() -> np.ndarray:
    """True for code points that are letters, marks not counted."""
    global _letter
    if _letter is None:
        _letter = np.zeros(0x110000, dtype=bool)
        _letter[[c for c in np.flatnonzero(fold_table() != SPACE).tolist() if unicodedata.category(chr(c))[0] == "L"]] = True
    return _letter


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``CHUNK`` bytes of text each."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHUNK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the folded texts one after another, and the row of each.

    The first space belongs to the first text; the space between two texts to
    the earlier one.
    """
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])
    codes, rows = fold_table()[codes], np.concatenate([[0], rows]).astype(np.int32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return codes[keep], rows[keep]
