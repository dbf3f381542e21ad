"""Exact encoding of whole texts with a worker-long cache of encoded words.

The tokenizer splits at white space before it merges, so a text's ids are those of its
white-space-separated words in order. Each distinct word is encoded once per worker by the library
itself; texts are then put together from the cache. ``word_wise`` checks that a tokenizer file
has this property; any other file is encoded text by text.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
os.environ.setdefault("RAYON_NUM_THREADS", "2")

CACHE_WORDS = 250_000
LONG_WORD = 64
CHUNK_TEXTS = 256
MARK = "\x01"
#: ASCII punctuation that always stands apart from letters and digits; the apostrophe, which joins
#: contractions, and what added tokens are written with (``<``, ``>``) are not among it.
PUNCTUATION = b".,!?$%&*#|;:"


def word_wise(spec: dict) -> bool:
    """Whether encoding splits at every ASCII white space and drops it."""
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    split = parts[0] if parts else {}
    # Fixed value: the word pattern whose matches alone are kept, none of which holds white space.
    kept = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    norms = spec.get("normalizer") or {}
    norms = norms.get("normalizers", [norms])
    return (
        split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split.get("pattern", {}).get("Regex") == kept
        and all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
        and all(x.get("type") in ("NFC", "Lowercase", "Replace") for x in norms)
        and all(x.get("pattern", {}).get("Regex") == "\\s+" and x.get("content") == " " for x in norms if x.get("type") == "Replace")
        and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
        and spec.get("truncation") is None and spec.get("padding") is None
    )


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes."""

    kept: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: A control character that is a word of its own and a single token; it stands between
        #: words when hundreds are encoded in one call.
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.by_word = word_wise(spec) and len(mark) == 1
        self.mark_id = mark[0] if mark else -1
        vocabulary = self.tokenizer.get_vocab()
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.is_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.is_end[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        norms = (spec.get("normalizer") or {}).get("normalizers", [])
        self.folds = self.by_word and bool(suffix) and any(x.get("type") == "Lowercase" for x in norms)
        #: The same pipeline without its normaliser, for lower-case ASCII letters, which that leaves alone.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        #: Two generations: words not met for a generation are forgotten.
        self.cache = Words()

    @classmethod
    def get(cls, path: str) -> "WordEncoder":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of any words, hundreds to a call, told apart by the mark between them."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        out: list[bytes] = []
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)):
            raw = np.array(e.ids, "<u4")
            at = np.flatnonzero(raw == self.mark_id)
            if len(at) != len(some) - 1:  # a word holds the mark itself
                out += self._encode(some)
                continue
            data = raw.tobytes()
            out += [data[a:b] for a, b in zip([0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(data)])]
        return out

    def _letters(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of words of letters alone: each ends at its one token with the word-end suffix."""
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        out: list[bytes] = []
        for some, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            raw = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.is_end[raw])
            if len(at) != len(some) or at[-1] != len(raw) - 1:
                out += self._marked(some)
                continue
            data = raw.tobytes()
            out += [data[a:b] for a, b in zip([0, *((at[:-1] + 1) * 4).tolist()], ((at + 1) * 4).tolist())]
        return out

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of single words."""
        plain = [w for w in words if w.isalpha() and w.islower()] if self.folds else []
        rest = [w.decode() for w in (set(words).difference(plain) if plain else words)]
        letters = [w for w in rest if w.isalpha()] if self.folds else []
        other = [w for w in rest if not w.isalpha()] if self.folds else rest
        known = dict(zip(plain, self._letters([w.decode() for w in plain], self.bare)))
        known.update(zip(map(str.encode, letters), self._letters(letters, self.tokenizer)))
        known.update(zip(map(str.encode, other), self._marked(other)))
        return known

    def _spaced(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower case, and a space wherever an ASCII letter or digit meets ASCII punctuation.

        The tokenizer folds case and never merges across such a place; doing both first leaves
        far fewer distinct words.
        """
        kind = _KIND[data]
        at = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
        return np.insert(_FOLD[data], at, 32), off + np.searchsorted(at, off, "left")

    def encode_slice(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of the texts that lie between the offsets."""
        texts = _cut(data, off)
        if self.folds and len(data):
            folded = _cut(*self._spaced(data, off))
            # Texts that may hold an added token, which is matched before folding, stay as they are.
            texts = [t if b"<|" in t else f for t, f in zip(texts, folded)]
        return self._encode_texts(texts)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), CHUNK_TEXTS):
            some = texts[i : i + CHUNK_TEXTS]
            out += self.encode_slice(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        return out

    def _encode_texts(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._encode([t.decode() for t in texts])
        if len(self.cache) > CACHE_WORDS:
            self.cache = Words(self.cache)
        out, cache = [], self.cache
        for i in range(0, len(texts), CHUNK_TEXTS):
            # One look-up for each word; a new one gives an empty place, filled below.
            parts = [list(map(cache.__getitem__, t.split())) for t in texts[i : i + CHUNK_TEXTS]]
            new, cache.new = cache.new, []
            for word, ids in self._words(new).items():
                cache[word] += ids
            out += [b"".join(p) for p in parts]
            for word in new:
                if len(word) > LONG_WORD:
                    del cache[word]
                else:
                    cache[word] = bytes(cache[word])
        return out


class Words(dict):
    """Ids of words met; those of the generation before are taken over when they are met again."""

    def __init__(self, older: dict | None = None):
        super().__init__()
        self.older = dict(older or {})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes):
        ids = self.older.get(word)
        if ids is None:
            ids = bytearray()
            self.new.append(word)
        self[word] = ids
        return ids


def _cut(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


#: 1 for ASCII letters and digits, 2 for PUNCTUATION, 4 for all else; and lower case.
_KIND = np.full(256, 4, np.uint8)
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[list(PUNCTUATION)] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
