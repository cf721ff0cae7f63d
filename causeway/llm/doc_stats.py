"""Document statistics for the quality classifier, a batch of texts at a time."""

from __future__ import annotations

import zlib

import numpy as np

#: Byte classes whose shares are features (fixed values).
CLASSES = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "*", "#", "$", "%", "&",
    "<>", "\"'`", "-_", "/\\", "()[]{}", ":;", "@+=~^",
)
NAMES = (
    *(f"share_{c[:3]!r}" for c in CLASSES), "share_above_ascii", "log_chars", "log_words", "word_chars", "distinct_words", "top_word", "same_as_last",
    "log_lines", "duplicate_lines", "line_words", "capital_words", "upper_words", "compression",
)
_TABLE = np.full(256, len(CLASSES) + 1, dtype=np.int64)  # the rest of ASCII
_TABLE[128:] = len(CLASSES)
for _i, _c in enumerate(CLASSES):
    _TABLE[list(_c.encode())] = _i


def document_stats(text: str) -> list[float]:
    """All statistics of one whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 2)[: len(CLASSES) + 1] / max(1, len(raw))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        *shares, np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), sum(c for w, c in counts.items() if w[0].isupper()) / n, sum(c for w, c in counts.items() if w.isupper()) / n,
        len(zlib.compress(raw, 1)) / max(20, len(raw)),
    ]


def stats_matrix(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text; null counts as empty."""
    return np.array([document_stats(t or "") for t in texts], dtype=np.float64).reshape(-1, len(NAMES))
