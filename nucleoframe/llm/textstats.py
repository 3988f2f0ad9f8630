"""Dense statistics of whole texts, shared by the classifiers.

Ratios of an empty or null text are 0."""

from __future__ import annotations

import re
from collections import Counter

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
#: ASCII punctuation that prose uses, and the symbols that it seldom does.
PROSE, SYMBOLS = b".,;:'\"()-?", b"#$%&*+/<=>@[\\]^_`{|}~"
LETTER = re.compile(r"[^\W\d_]")

STATISTICS = (
    "log_words", "mean_word_length", "upper_share", "digit_share", "prose_mark_share", "exclamation_share", "symbol_share",
    "pipe_share", "letter_share", "unique_word_share", "top_word_share", "same_neighbour_share", "repeated_line_share",
    "log_lines", "words_per_line", "upper_word_share", "capital_word_share", "mark_end_share", "stop_end_share", "short_word_share", "long_word_share", "non_ascii_share", "bracket_share",
)


def statistics(text: str | None) -> list[float]:
    """Values of STATISTICS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    words = raw.split()
    w = len(words) or 1
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = len(lines) or 1
    lengths = list(map(len, words))
    ends = b"".join([x[-1:] for x in words])
    marks = len(ends) - len(ends.translate(None, b"!#$%&*+/<=>@\\^_`|~"))
    stops = len(ends) - len(ends.translate(None, b".!?"))
    starts = b"".join([x[:1] for x in words])
    capitals = len(starts) - len(starts.translate(None, UPPER))
    spaces = n - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    digits, prose, symbols = without(DIGITS), without(PROSE), without(SYMBOLS)
    exclamations, upper = without(b"!"), without(UPPER)
    return [
        len(words).bit_length() + len(words) / (1 << len(words).bit_length()), sum(lengths) / w, upper / n, digits / n, prose / n, exclamations / n, symbols / n,
        without(b"|") / n, (n - spaces - digits - prose - symbols - exclamations) / n, len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, 1 - len(set(lines)) / k if lines else 0.0,
        float(len(lines).bit_length()), len(words) / k, sum(1 for x in counts if x.isupper() and len(x) > 1) / (len(counts) or 1), capitals / w, marks / w, stops / w,
        sum(1 for x in lengths if x < 4) / w, sum(1 for x in lengths if x > 12) / w, 1 - len(text) / n if text else 0.0, without(b"()[]{}") / n,
    ]
