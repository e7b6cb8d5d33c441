"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order
into text and placeholders and records, per attachment, its reference, its place and the tokens it
expands to. The template marks turns with control strings; control strings inside texts are escaped
by an escape character after their first character (and the escape character by doubling), which can
be undone exactly. Loss falls on assistants' texts alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOS, EOS, INST, END_INST, SYS, END_SYS, NAME, END_NAME = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[NAME]", "[/NAME]"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = (BOS, EOS, INST, END_INST, SYS, END_SYS, NAME, END_NAME, *PLACEHOLDERS.values())
ESCAPE = "␛"

_first = "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))
_TO = re.compile(f"{ESCAPE}|{_first}")
_FROM = re.compile(f"{ESCAPE}{ESCAPE}|" + "|".join(re.escape(c[0] + ESCAPE + c[1:]) for c in sorted(CONTROL, key=len, reverse=True)))
_TOKENS = re.compile(_first)


def escape(text: str) -> str:
    return _TO.sub(lambda m: m[0] + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _FROM.sub(lambda m: ESCAPE if m[0][0] == ESCAPE else m[0][0] + m[0][2:], text)


@dataclass
class Text:
    text: str

    def accept(self, visitor: Flatten) -> None:
        visitor.text(self)


@dataclass
class Attachment:
    """kind: image, audio or document; size: pixels (w, h), seconds or pages, by kind."""

    kind: str
    ref: str
    size: tuple[float, ...] = ()

    def accept(self, visitor: Flatten) -> None:
        visitor.attachment(self)


@dataclass
class Costs:
    """Tokens that attachments expand to: per image tile, second of audio and page of a document."""

    tile_pixels: int = 512
    tokens_per_tile: int = 64
    tokens_per_second: int = 25
    tokens_per_page: int = 256

    def of(self, a: Attachment) -> int:
        if a.kind == "image":
            w, h = (*a.size, 1, 1)[:2]
            return self.tokens_per_tile * int(-(-w // self.tile_pixels)) * int(-(-h // self.tile_pixels))
        amount = (*a.size, 1)[0]
        return int(-(-amount // 1)) * (self.tokens_per_second if a.kind == "audio" else self.tokens_per_page)


@dataclass
class Flatten:
    """The visitor: ordered output and attachment records (ref, kind, place in the output, tokens)."""

    costs: Costs = field(default_factory=Costs)
    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)

    def text(self, part: Text) -> None:
        self._put(escape(part.text))

    def attachment(self, part: Attachment) -> None:
        self.attachments.append((part.ref, part.kind, self.length, self.costs.of(part)))
        self._put(PLACEHOLDERS[part.kind])

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.length += len(piece)


def parts_of(content: str | list | None) -> list[Text | Attachment]:
    """Typed parts of plain text, null, or a list of {"type": ..., ...} objects; unknown types are errors."""
    if content is None:
        return [Text("")]
    if isinstance(content, str):
        return [Text(content)]
    out: list[Text | Attachment] = []
    for p in content:
        if p["type"] == "text":
            out.append(Text(p.get("text") or ""))
        elif p["type"] in PLACEHOLDERS:
            out.append(Attachment(p["type"], str(p.get("ref") or ""), tuple(p.get("size") or ())))
        else:
            raise ValueError(f"unknown part type {p['type']!r}")
    return out


#: What stands before and after a turn's content; other roles are named.
FRAMES = {"user": (f"{INST} ", f" {END_INST}"), "assistant": (" ", f" {EOS}"), "system": (f"{SYS}\n", f"\n{END_SYS}")}


def frame(role: str) -> tuple[str, str]:
    return FRAMES.get(role) or (f"{NAME}{escape(role)}{END_NAME} ", f" {EOS}")


def format_turn(role: str, content: str | list | None, costs: Costs | None = None) -> tuple[str, tuple[int, int] | None, list[tuple[str, str, int, int]]]:
    """(piece, loss span inside it or None, attachments placed inside it)."""
    v = Flatten(costs or Costs())
    for part in parts_of(content):
        part.accept(v)
    before, after = frame(role)
    n = len(before)
    loss = (n, n + v.length) if role == "assistant" else None
    return before + "".join(v.out) + after, loss, [(r, k, at + n, t) for r, k, at, t in v.attachments]


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a piece: control strings tell the role, unescaping gives the text back."""
    if piece.startswith(NAME):
        end = piece.index(END_NAME)
        return unescape(piece[len(NAME) : end]), unescape(piece[end + len(END_NAME) + 1 : -len(EOS) - 1])
    for role, (before, after) in FRAMES.items():
        if piece.startswith(before) and piece.endswith(after):
            return role, unescape(piece[len(before) : len(piece) - len(after)])
    raise ValueError("not a turn")


def split_turns(text: str) -> Iterator[str]:
    """Pieces of a formatted conversation, found by its control strings alone."""
    at, close = 0, None
    closers = {INST: END_INST, SYS: END_SYS, NAME: EOS}
    for m in _TOKENS.finditer(text):
        if m[0] in PLACEHOLDERS.values():
            continue
        if close is None and m.start() == at and m[0] in closers:
            close = closers[m[0]]
        elif m[0] == (close or EOS):
            yield text[at : m.end()]
            at, close = m.end(), None


TURNS = "conv_id long, n long, role string, piece string, start long, loss_from long, loss_to long, attachments array<struct<ref:string,kind:string,at:long,tokens:long>>"


def format_conversations(rows: DataFrame, *, parts_json: bool = False, costs: Costs | None = None) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its piece of the formatted conversation.

    A conversation's text is its pieces one after another (turn 0 begins with ``<s>``): n counts turns
    from 0, start is the piece's place in code points, loss_from and loss_to the loss span (null without
    one) and attachments the parts' references, places and expanded token counts, all from the
    conversation's start. With ``parts_json`` texts are JSON lists of typed parts.

    Rows are dealt by conversation, sorted by (turn, role, text) with nulls first and streamed, so a
    conversation of any length takes the memory of a batch. Null texts are empty; a null role is the
    empty role; rows of null conv_id form one conversation; repeated rows are turns of their own; an empty
    table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, at = object(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    now, n, at = conv, 0, 0
                content = json.loads(text) if parts_json and text else text
                piece, loss, attached = format_turn(role or "", content, costs)
                head = len(BOS) if n == 0 else 0
                base = at + head
                out.append((conv, n, role, (BOS if n == 0 else "") + piece, at, loss and base + loss[0], loss and base + loss[1], [{"ref": r, "kind": k, "at": base + p, "tokens": t} for r, k, p, t in attached]))
                n, at = n + 1, base + len(piece)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("ref", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])))
            names = ["conv_id", "n", "role", "piece", "start", "loss_from", "loss_to", "attachments"]
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, TURNS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read from their text and loss mask.

    ``pieces`` come from ``format_conversations``, in any order: they are dealt by conversation and sorted by
    their places, so they may have been written, read or shuffled meanwhile. A conversation is streamed;
    pieces that don't follow one another are an error. What is hashed is parsed and unescaped from the
    pieces; nothing comes from the input rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        turns = loss = None
        n = chars = total = 0
        done: list[tuple] = []

        def close() -> None:
            if started:
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, piece, start, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not started or conv != now:
                    close()
                    now, started, n, chars, total = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if start != total:
                    raise ValueError("a conversation's pieces don't follow one another")
                body = piece[len(BOS) :] if start == 0 else piece
                for turn in split_turns(body):
                    role, text = read_turn(turn)
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if a is not None:
                    masked = unescape(piece[a - start : b - start])
                    loss.update(masked.encode())
                    chars += len(masked)
                total += len(piece)
            if len(done) >= 1000:
                yield _digests(done)
                done.clear()
        close()
        yield _digests(done)

    rows = pieces.select("conv_id", "piece", "start", "loss_from", "loss_to")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(run, DIGEST)


def conversations(pieces: DataFrame, most_chars: int = 1 << 24) -> DataFrame:
    """(conv_id, text, loss_spans, attachments): one row per formatted conversation, for those of at most
    ``most_chars`` code points; longer ones stay in pieces and are an error here."""
    size = pieces.groupBy("conv_id").agg(F.max(F.col("start") + F.length("piece")).alias("size"))
    if not size.filter(F.col("size") > most_chars).isEmpty():
        raise ValueError(f"a conversation has more than {most_chars} code points")
    turns = F.array_sort(F.collect_list(F.struct("start", "piece", "loss_from", "loss_to", "attachments")))
    rows = pieces.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss_from"].isNotNull()), lambda t: F.struct(t["loss_from"].alias("from"), t["loss_to"].alias("to")))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"), spans.alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
