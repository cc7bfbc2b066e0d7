"""Statistics of whole texts, for the quality rules and the quality classifier.

Words are runs of anything but ASCII white space. A null text counts as empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SENTENCE_MARKS = b".!?"
INNER_MARKS = b",;:-'\"()"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios a model reads; all are finite, 0 for a text with no word.
FEATURES = ("log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "digit_share", "mark_share", "inner_mark_share", "bang_share", "bytes_per_char",
            "log_line_words", "top_word_share")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the list."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = np.zeros(len(words) + 2, dtype=bool)
    at = np.flatnonzero(np.fromiter((w in often for w in windows), dtype=bool, count=len(windows)))
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The values of BASE and of FEATURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, _without(raw, SYMBOLS), 0, 0], [0.0] * len(FEATURES)
    spaces = _without(raw, SPACES)
    symbols = _without(raw, SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    chars = len(text) - spaces
    upper, lower = _without(raw, UPPER), _without(raw, LOWER)
    counts = Counter(words)
    return [n, chars, symbols, dup, repeats], [
        float(np.log1p(n)), min(chars / n, 50.0), symbols / n, dup / len(lines), repeats / n, len(counts) / n,
        upper / max(upper + lower, 1), _without(raw, DIGITS) / chars, _without(raw, SENTENCE_MARKS) / n,
        _without(raw, INNER_MARKS) / n, raw.count(b"!") / n, len(raw) / len(text),
        float(np.log1p(n / len(lines))), max(counts.values()) / n]
