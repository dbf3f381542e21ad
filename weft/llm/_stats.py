"""Statistics of whole documents, computed for many documents at once."""

from __future__ import annotations

import numpy as np

from weft.llm import _batch as B

WINDOW = 5
#: Fixed value: the symbol characters of the contract.
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_same_next", "n_shouts", "n_long_words", "n_wordy_chars"]
COLUMNS = BASE + EXTRA


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_PUNCT = _table(b"!?.,;:'\"()-")
_FIRST = _table(bytes([*range(0x80), *range(0xC0, 0x100)]))


def _repeats(key: np.ndarray) -> np.ndarray:
    """Flags of values that occur twice or more."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def document_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """One int64 array per name of COLUMNS; words are runs without ASCII white space.

    Lines and windows are told apart by 64-bit hashes seeded with the document.
    """
    n_docs, n = len(off) - 1, len(data)
    word, first = B.is_word_bytes(data), _FIRST[data]
    start, end, woff = B.words(data, off, word)
    n_words = np.diff(woff)
    out = {"n_words": n_words, "word_chars": B.per_doc(word & first, off), "n_symbols": B.per_doc(_SYMBOL[data], off), "n_chars": B.per_doc(first, off)}
    out["n_upper"], out["n_digits"], out["n_punct"] = (B.per_doc(t[data], off) for t in (_UPPER, _DIGIT, _PUNCT))
    wh = B.segment_hash(data, start, end)
    doc_of_word = np.repeat(np.arange(n_docs), n_words)
    same = np.zeros(len(wh), bool)
    if len(wh) > 1:
        same[1:] = (wh[1:] == wh[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    out["n_same_next"] = B.per_doc(same, woff)
    out["n_long_words"] = B.per_doc(end - start > 20, woff)
    shout = np.zeros(len(wh), bool)
    shout[:] = _table(b"!?|%*$#&")[data[end - 1]] if len(end) else False
    out["n_shouts"] = B.per_doc(shout, woff)
    up = np.concatenate([[0], np.cumsum(_UPPER[data])])
    out["n_wordy_chars"] = B.per_doc((up[end] - up[start]) * 2 > end - start, woff)
    # Lines: from each document's start and from behind each line feed, to the next such place.
    feed = np.flatnonzero(data == 10)
    n_lines = B.per_doc(data == 10, off) + 1
    ls = np.sort(np.concatenate([off[:-1], feed + 1])) if n_docs else np.zeros(0, np.int64)
    le = np.sort(np.concatenate([off[1:], feed])) if n_docs else ls
    line_doc = np.repeat(np.arange(n_docs), n_lines)
    has = np.searchsorted(start, le) > np.searchsorted(start, ls)
    out["n_lines"] = np.bincount(line_doc[has], minlength=n_docs).astype(np.int64)
    key = B.mix(B.segment_hash(data, ls[has], le[has]) ^ B.mix(line_doc[has].astype(np.uint64) + np.uint64(1)))
    _, firsts = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[has][firsts], minlength=n_docs)
    # Windows found twice or more, and the words inside any of them.
    win, win_doc = B.window_owner(woff, WINDOW)
    wkey = B.mix(B.window_hash(wh, WINDOW)[win] ^ B.mix(win_doc.astype(np.uint64) + np.uint64(1)))
    hit = win[_repeats(wkey)]
    delta = np.zeros(len(wh) + 1, np.int64)
    np.add.at(delta, hit, 1)
    np.add.at(delta, np.minimum(hit + WINDOW, len(wh)), -1)
    out["n_repeat_words"] = B.per_doc(np.cumsum(delta[:-1]) > 0, woff)
    return out


def ratios(s: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(names, matrix) of scale-free features; empty documents give zeros."""
    f = {k: v.astype(np.float64) for k, v in s.items()}
    w, c, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_chars"], 1), np.maximum(f["n_lines"], 1)
    cols = {
        "log_words": np.log1p(f["n_words"]), "word_length": f["word_chars"] / w, "symbol_rate": f["n_symbols"] / c, "dup_line_rate": f["n_dup_lines"] / lines,
        "repeat_rate": f["n_repeat_words"] / w, "upper_rate": f["n_upper"] / c, "digit_rate": f["n_digits"] / c, "punct_rate": f["n_punct"] / c,
        "same_next_rate": f["n_same_next"] / w, "shout_rate": f["n_shouts"] / w, "long_word_rate": f["n_long_words"] / w, "caps_word_rate": f["n_wordy_chars"] / w, "words_per_line": np.log1p(f["n_words"] / lines),
    }
    return list(cols), np.column_stack(list(cols.values())) if len(w) else np.zeros((0, len(cols)))
