"""Surface features of a text for the quality model."""

from __future__ import annotations

import zlib

import numpy as np

NAMES = (
    "log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "punctuation", "symbols", "shouts", "bars",
    "log_lines", "line_length", "repeated_lines", "stops", "symbol_ends", "repeated_next", "repeated_triples", "compressed",
)

_KIND = np.zeros(256, np.uint8)
for _k, _letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"#$%&*@~^<>=_+\\/{}[]`", b"!", b"|"), 1):
    _KIND[list(_letters)] = _k


def features(text: str) -> list[float]:
    """One number for each of NAMES, over the whole text in time linear in its length; an empty text has defined ones."""
    data = text.encode()
    words = data.split()
    n = len(words)
    size = max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = data.replace(b"\n", b" ")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else max(n - 2, 0)
    most = max(1, n)
    return [
        np.log1p(n), sum(map(len, words)) / most, len(counts) / most, max(counts.values(), default=0) / most,
        *kinds[1:7], np.log1p(len(lines)), min(2000.0, len(data) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        (ends.count(b". ") + ends.endswith(b".")) / most, sum(ends.count(bytes([c]) * 3) for c in b"*#%&$!") / most, runs / most,
        1 - triples / max(1, n - 2), len(zlib.compress(data, 1)) / size,
    ]
