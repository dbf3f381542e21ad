"""SentencePiece models on the tokenizers library: encode and decode whole texts.

The model protobuf is parsed here (wire format, no generated classes); the normaliser, the
metaspace marker, merges or unigram scores and byte fallback are rebuilt as a tokenizers
pipeline, whose multithreaded batches give the ids. Where no piece holds the marker behind another
character, a text splits before each run of spaces and at each line break, so distinct units are
encoded once per worker. Everything encoded is encoded by the reference library too, and each row
says whether its ids agree. For unigram models they may not where two cuts of a text have the same
score (``%`` ``%%`` and ``%%`` ``%``) or scores nearer than single precision tells apart.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import _batch as B
from weft.llm._shared import id_text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
os.environ.setdefault("RAYON_NUM_THREADS", "2")

MARK = "▁"
MARK_BYTES = MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_UNITS = 150_000
LONG_UNIT = 64
CHUNK_TEXTS = 256
#: Units that go into one string, and strings (or whole texts) in one batch.
JOINED_UNITS, BATCH = 256, 32
_RUNS = re.compile(rb" +[^ ]*|^[^ ]+")


def _fields(data: bytes):
    """(field number, value) pairs of a protobuf message; length-delimited values stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            value = data[at : at + n]
            at += n
        yield key >> 3, value


class Model:
    """Pieces and settings of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.byte_fallback, self.suffix = False, False, False
        self.charsmap, self.dummy, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(_fields(value))
                self.bpe, self.byte_fallback, self.suffix = spec.get(3, 1) == 2, bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                self.charsmap, self.dummy, self.squeeze, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if not self.escape or self.suffix:
            raise ValueError("models without the space marker, or with it as a suffix, are not supported")

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def splits_at_marks(self) -> bool:
        inner = any(MARK in p.lstrip(MARK) or "\n" in p for p, _, k in self.pieces if k in (NORMAL, USER))
        return self.bpe and not inner and self.byte_fallback and not self.charsmap and not self.squeeze and self.dummy and not any(k == USER for _, _, k in self.pieces)


def build(model: Model):
    """A tokenizers pipeline equal to the model; expects marked text (no normaliser of its own)."""
    from tokenizers import AddedToken, Tokenizer, models

    if model.bpe:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        normal = {p for p, _, k in model.pieces if k in (NORMAL, USER)}
        ranked = sorted((p for p in normal if len(p) > 1), key=lambda p: (-model.pieces[vocab[p]][1], vocab[p]))
        merges = [(p[:i], p[i:]) for p in ranked for i in range(1, len(p)) if p[:i] in normal and p[i:] in normal]
        core = models.BPE(vocab=vocab, merges=merges, unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        # Only normal pieces match text; the others keep their places under names no text holds.
        # Bytes of what no piece covers are put in by Codec: the library's own fallback would also
        # read a literal ``<0x41>`` in a text as a byte.
        core = models.Unigram(
            [(p, s) if k in (NORMAL, USER) else (f"\ufdd0{i}\ufdd1", 0.0) for i, (p, s, k) in enumerate(model.pieces)], unk_id=model.unk,
            byte_fallback=False
        )
    tok = Tokenizer(core)
    user = [AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER]
    if user:
        tok.add_tokens(user)
    return tok


def normaliser(model: Model):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    return normalizers.Sequence(steps) if steps else None


class Codec:
    kept: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer = build(self.model)
        self.normaliser = normaliser(self.model)
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_unit, self.unk = self.model.splits_at_marks(), self.model.unk
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.model.pieces) if k == BYTE}
        #: Two generations: units not met for a generation are forgotten.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Units met whose ids the reference library makes otherwise, and how many were compared.
        self.differing: set[bytes] = set()
        self.verified = 0
        self.break_id = self._batch(["\n"])[0][-1] if self.by_unit else -1
        self.surface: list[bytes] = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == UNKNOWN:
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())

    @classmethod
    def get(cls, path: str) -> "Codec":
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts from the rebuilt pipeline, in multithreaded batches."""
        if self.normaliser is not None:
            texts = [self.normaliser.normalize_str(t) for t in texts]
        mark = MARK if self.model.dummy else ""
        out: list[list[int]] = []
        for i in range(0, len(texts), BATCH):
            marked = [mark + t.replace(" ", MARK) if t else "" for t in texts[i : i + BATCH]]
            if self.model.bpe:
                out += [x.ids for x in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
            else:
                out += [self._with_bytes(x.ids, x.tokens) for x in self.tokenizer.encode_batch(marked, add_special_tokens=False)]
        return out

    def _with_bytes(self, ids: list[int], tokens: list[str]) -> list[int]:
        """Unknown stretches as the ids of their bytes, where the model has those."""
        if not self.model.byte_fallback or self.unk not in ids:
            return ids
        return [x for i, t in zip(ids, tokens) for x in ([self.byte_id[b] for b in t.encode()] if i == self.unk else [i])]

    def _whole(self, texts: list[bytes]) -> list[tuple[bytes, bool]]:
        """(ids, whether the reference library agrees) of whole texts."""
        plain = [t.decode() for t in texts]
        self.verified += len(texts)
        return [(array("I", got).tobytes(), got == want) for got, want in zip(self._batch(plain), self.check.encode(plain, num_threads=1))]

    def _units(self, keys: list[bytes]) -> list[bytes]:
        """Ids of units: ``b"\\n" + x`` is x without a marker, `` x`` has more than one, x alone has one.

        Hundreds of units make a string, with line breaks between them. Where the two libraries
        disagree over a string, its units are compared one by one.
        """
        texts, groups = [], [keys[i : i + JOINED_UNITS] for i in range(0, len(keys), JOINED_UNITS)]
        for some in groups:
            text = b"\n" + b"\n".join([b"" if k == b"\n" else k[1:] if k[:1] == b"\n" else k if k[:1] == b" " else b" " + k for k in some])
            texts.append(text.decode())
        out: list[bytes] = []
        for some, got, want in zip(groups, self._batch(texts), self.check.encode(texts, num_threads=1)):
            ids = self._parted(got)
            if len(ids) != len(some):
                raise ValueError("line breaks are no tokens of their own in this model")
            self.verified += len(some)
            if got != want:
                theirs = self._parted(want)
                self.differing.update(k for n, k in enumerate(some) if len(theirs) != len(some) or ids[n] != theirs[n])
            out += ids
        one = array("I", [self.break_id]).tobytes()
        return [one if k == b"\n" else x for k, x in zip(keys, out)]

    def _parted(self, ids: list[int]) -> list[bytes]:
        raw = np.array(ids, "<u4")
        at = np.flatnonzero(raw == self.break_id) * 4
        data = raw.tobytes()
        return [data[a + 4 : b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(data)])]

    def _keys(self, text: bytes) -> list[bytes]:
        keys: list[bytes] = []
        for n, line in enumerate((b" " + text).split(b"\n")):
            if n:
                keys.append(b"\n")
            if b"  " in line or line.endswith(b" "):
                for u in _RUNS.findall(line):
                    keys.append(b"\n" + u if u[:1] != b" " else u[1:] if len(u) > 1 and u[1:2] != b" " else u)
                continue
            parts = line.split(b" ")
            if parts[0]:
                parts[0] = b"\n" + parts[0]
                keys += parts
            else:
                keys += parts[1:]
        return keys

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bool]]:
        """(ids, parity) of whole texts; ids are little-endian uint32 bytes, an empty text has none."""
        out: list[tuple[bytes, bool]] = []
        if len(self.cache) > CACHE_UNITS:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        for i in range(0, len(texts), CHUNK_TEXTS):
            chunk = texts[i : i + CHUNK_TEXTS]
            plain = [self.by_unit and t != b"" and MARK_BYTES not in t for t in chunk]
            split = [self._keys(t) if ok else [] for t, ok in zip(chunk, plain)]
            missing = []
            for key in set().union(*split).difference(cache):
                if key in older:
                    cache[key] = older[key]
                else:
                    missing.append(key)
            extra = {}
            for key, ids in zip(missing, self._units(missing) if missing else []):
                (cache if len(key) <= LONG_UNIT else extra)[key] = ids
            find = (lambda k: cache[k] if k in cache else extra[k]) if extra else cache.__getitem__
            rest = iter(self._whole([t for t, ok in zip(chunk, plain) if t and not ok]))
            for t, ok, keys in zip(chunk, plain, split):
                if ok:
                    out.append((b"".join(map(find, keys)), not self.differing or self.differing.isdisjoint(keys)))
                else:
                    out.append(next(rest) if t else (b"", True))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids as UTF-8; bytes that form no character become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.model.dummy and raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, ids_crc32, round_trip (the decoded ids give the text again),
    parity (the reference library makes the same ids of all the text's units).

    Null texts count as empty (no ids); repeated rows are each reported; an empty table gives an
    empty table; other columns are not read.
    """

    def run(batches):
        codec = Codec.get(model_path)
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(1)):
                texts = list(B.doc_bytes(data, off))
                got = codec.encode(texts)
                ids = [x for x, _ in got]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(np.diff(ends)), arrays, pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([codec.decode(x) == t for x, t in zip(ids, texts)]), pa.array([ok for _, ok in got]),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "ids", "ids_crc32", "round_trip", "parity"],
                )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, round_trip boolean, parity boolean"
    return id_text(docs, id_col, text_col).mapInArrow(B.tidy(run), schema)
