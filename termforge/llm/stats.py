"""Surface statistics of whole texts, computed over Arrow batches with numpy."""

from __future__ import annotations

import numpy as np

from termforge.llm.common import slices, word_hashes

NAMES = [
    "log_words", "word_len", "distinct_words", "top_word", "upper", "symbols",
    "exclaims", "pipes", "digits", "repeated_lines",
]

_CLASSES = np.zeros((6, 256), dtype=np.int64)
_CLASSES[0, 65:91] = 1
_CLASSES[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASSES[2, [ord(c) for c in "#$%&*+<=>@^_`{}~\\/[]"]] = 1
_CLASSES[3, ord("!")] = 1
_CLASSES[4, ord("|")] = 1
_CLASSES[5, 48:58] = 1


def _part(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    words, stops = word_hashes(texts)
    out = np.zeros((len(texts), len(NAMES)))
    distinct = []
    begin = 0
    for k, (text, stop) in enumerate(zip(texts, stops)):
        own = np.sort(words[begin:stop])
        begin = stop
        n = len(own)
        edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), n) if n else np.zeros(1, np.int64)
        distinct.append(own[edges[:-1]])
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        upper, letters, symbols, exclaims, pipes, digits = _CLASSES @ raw
        size, per = max(1, int(raw.sum())), max(1, n)
        lines = [x for x in text.split("\n") if x]
        out[k] = (
            np.log1p(n), (letters + digits) / per, len(distinct[-1]) / per, np.diff(edges).max(initial=0) / per,
            upper / max(1, letters), symbols / size, exclaims / per, pipes / per, digits / size,
            1 - len(set(lines)) / len(lines) if lines else 0.0,
        )
    return out, distinct


def text_stats(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of ``NAMES`` for each text, and the sorted hashes of its distinct words.

    A null text counts as empty; an empty text has zeros only.
    """
    rows, distinct = [], []
    texts = [t or "" for t in texts]
    for part in slices(texts):
        a, b = _part(texts[part])
        rows.append(a)
        distinct += b
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES))), distinct
