"""Conversations as training text, by a compiled template, in pieces that no long conversation outgrows.

Turns are dealt over range partitions of (conversation, turn), so a conversation of any length spreads over tasks. Two
rows without text per conversation, one before its first turn and one after its last, carry its ends: every
row renders by itself. What a task holds of a conversation is a piece, cut at ``PIECE_CHARS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._batch import tidy
from weft.llm._shared import by_name
from weft.llm.chat_template import Template

#: Role, text and the loss mask on what assistants say.
CHAT = (
    "{% control '<s>' '</s>' '[INST]' '[/INST]' '[REPLY]' '[ROLE]' '[/ROLE]' %}<s>{% for message in messages %}"
    "{% if message.role == 'user' %}[INST] {{ message.text }} [/INST]"
    "{% elif message.role == 'assistant' %}[REPLY]{% generation %}{{ message.text }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role }}[/ROLE]{{ message.text }}</s>{% endif %}{% endfor %}"
)
#: Code points after which a piece ends, with the turn that reaches them.
PIECE_CHARS = 1 << 20
#: Code points of the pieces in one Arrow batch, about.
BATCH_CHARS = 1 << 21

PIECES = "conv_id long, piece long, opened boolean, closed boolean, formatted string, loss array<struct<begin:int,stop:int>>"
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("opened", pa.bool_()), ("closed", pa.bool_()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))
])
_OPEN, _TURN, _CLOSE = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text under fixed names; null roles and texts are empty, nulls in the other two stay."""
    col = lambda name: by_name(conversations, name)
    return conversations.select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
        *(F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )


def format_conversations(conversations: DataFrame, source: str = CHAT, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, piece, opened, closed, formatted, loss: the pieces of each conversation, in order of ``piece``.

    ``formatted`` of all pieces in order is the conversation; ``opened`` and ``closed`` tell which pieces hold its
    ends (most conversations are one piece with both); ``loss`` has the spans under the mask in code points of the piece.

    Turns go by ``turn``, null first; rows of one turn by the MD5 of role, line feed and text; repeated rows are
    turns like others. Rows without conv_id are one conversation, with a null id. An empty table has no pieces. More
    columns, whatever their names, are not read. A turn is never cut: a piece is as long as its longest turn needs.
    """
    Template(source)  # errors of the template come here, not in tasks
    rows = turns(conversations)
    # The last key spreads repeated rows; any order of theirs is the same.
    keyed = rows.select(
        "conv_id", F.lit(_TURN).cast("byte").alias("kind"), "turn", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")).alias("tie"),
        F.rand(7).cast("float").alias("spread"), "role", "text"
    )
    none = lambda kind: F.lit(None).cast(kind)
    ends = rows.select("conv_id").distinct().select(
        "conv_id", F.explode(F.array(F.lit(_OPEN).cast("byte"), F.lit(_CLOSE).cast("byte"))).alias("kind"), none("long").alias("turn"),
        none("string").alias("tie"), none("float").alias("spread"), none("string").alias("role"), none("string").alias("text")
    )
    order = ["conv_id", "kind", "turn", "tie", "spread"]
    dealt = keyed.unionByName(ends).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        template, number = Template(source), count(TaskContext.get().partitionId() << 33)
        made, held, page, now, opened, closed = [], 0, None, None, False, False

        def end() -> None:
            nonlocal page, held
            if page is not None:
                made.append((now, next(number), opened, closed, "".join(page.parts), [{"begin": a, "stop": b} for a, b in page.spans]))
                held, page = held + page.size, None

        for b in batches:
            for conv, kind, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if page is not None and (conv != now or page.size >= piece_chars and kind == _TURN):
                    end()
                    if held >= BATCH_CHARS:
                        yield _batch(made, _PIECES)
                        made, held = [], 0
                if page is None:
                    page, now, opened, closed = template.page(), conv, False, False
                if kind == _OPEN:
                    page.put(template.opening)
                    opened = True
                elif kind == _TURN:
                    template.write(page, role, text)
                else:
                    page.put(template.closing)
                    closed = True
        end()
        if made:
            yield _batch(made, _PIECES)

    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(tidy(run), PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_READ = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64()),
    ("turns_sha256", pa.string()), ("loss_sha256", pa.string()), ("turns_text", pa.string()), ("loss_text", pa.string())
])
READ = "conv_id long, piece long, whole boolean, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string, turns_text string, loss_text string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())
])


def read_pieces(pieces: DataFrame, source: str = CHAT) -> DataFrame:
    """What each piece says when it is read back: its turns, and what is under the mask, unescaped.

    A piece that is a whole conversation gets the digests; others keep the texts, for ``digests`` to join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            made = []
            for conv, piece, opened, closed, formatted, spans in zip(*(b.column(k).to_pylist() for k in range(6))):
                found = template.read(formatted, opened, closed)
                said = "".join(f"{role}\n{text}\n" for role, text in found)
                loss = "".join(template.unescape(formatted[x["begin"] : x["stop"]]) for x in spans)
                whole = opened and closed
                made.append((conv, piece, whole, len(found), len(loss), len(formatted), *((sha(said), sha(loss), None, None) if whole else (None, None, said, loss))))
            if made:
                yield _batch(made, _READ)

    return pieces.select("conv_id", "piece", "opened", "closed", "formatted", "loss").mapInArrow(tidy(run), READ)


def digests(pieces: DataFrame, source: str = CHAT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its pieces.

    Nearly all conversations are digested where they were read. A SHA-256 is a chain by its definition, so the texts of
    one that is in several pieces pass through one task in their order; that task holds a batch of them, no more.
    """
    read = read_pieces(pieces, source).repartition("conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, chains = None, None, None
        for b in batches:
            made = []
            for conv, whole, n, loss_chars, chars, turns_sha, loss_sha, said, loss in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6, 7, 8, 9))):
                if sums is not None and (whole or conv != now):
                    made.append((now, sums[0], chains[0].hexdigest(), sums[1], chains[1].hexdigest(), sums[2]))
                    sums = None
                if whole:
                    made.append((conv, n, turns_sha, loss_chars, loss_sha, chars))
                    continue
                if sums is None:
                    now, sums, chains = conv, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                sums = [a + x for a, x in zip(sums, (n, loss_chars, chars))]
                chains[0].update(said.encode())
                chains[1].update(loss.encode())
            if made:
                yield _batch(made, _DIGESTS)
        if sums is not None:
            yield _batch([(now, sums[0], chains[0].hexdigest(), sums[1], chains[1].hexdigest(), sums[2])], _DIGESTS)

    return read.mapInArrow(tidy(run), DIGESTS)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The turns, and conversation -1: a user and an assistant who say control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns(conversations).unionByName(probe)
