"""Chat formatting on token level.

Every segment (a role, a text) is encoded on its own; reserved ids above the vocabulary are spliced
in between, so no text can ever become a marker. Where the markers' own strings occur inside a
text they are escaped with a backslash (as are backslashes), so the rendered text can be read back too.
Rows of `formatted` hold whole turns of one conversation: token ids, and a loss mask that is the
prefix sum of +1 where an assistant text begins and -1 where it ends.

Turns are encoded where they lie, before any shuffle. A conversation is then put together by a walk over
its sorted turns, which holds one part (`part_tokens`, at least one turn) at a time; a conversation of
any length is a row of parts, each with the position it starts at.

Nulls: a null text or role is empty. A null conversation id is a conversation, a null turn comes first.
Repeated turns are turns; equal turn numbers go by role, then by a hash of the text. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

#: Markers; marker i has the id `vocabulary size + i`.
MARKERS = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ANSWER]", "[ROLE]", "[/ROLE]")
BEGIN, END, SYS, SYS_END, INST, INST_END, ANSWER, ROLE, ROLE_END = range(len(MARKERS))
#: Roles with markers of their own: what opens and what ends the text.
FRAMES = {"system": (SYS, SYS_END), "user": (INST, INST_END), "assistant": (ANSWER, END)}
OPENS = {first: role for role, (first, _) in FRAMES.items()}
PART_TOKENS = 1 << 16

_ANY = "|".join(re.escape(m) for m in MARKERS)
_ESCAPE, _UNESCAPE = re.compile(rf"(\\|{_ANY})"), re.compile(rf"\\(\\|{_ANY})")

FORMATTED = "conv_id string, part int, start bigint, input_ids array<int>, loss_mask array<tinyint>"
READ = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Codec:
    """A byte-level tokenizer: what it encodes decodes to the same text."""

    _made: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _segments(roles: pd.Series, texts: pd.Series, codec: Codec) -> list[dict]:
    """Ids of each turn, and where its text lies in them."""
    m = codec.first
    bodies = codec.encode([escape(t or "") for t in texts])
    names = codec.encode([escape(r or "") if r not in FRAMES else "" for r in roles])
    out = []
    for role, name, body in zip(roles, names, bodies, strict=True):
        first, last = FRAMES.get(role, (None, END))
        head = [m + first] if first is not None else [m + ROLE, *name, m + ROLE_END]
        ids = np.array([*head, *body, m + last], "<i4")
        out.append({"ids": ids.tobytes(), "begin": len(head), "learn": role == "assistant"})
    return out


def formatted(turns: DataFrame, tokenizer: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """conv_id, part, start, input_ids, loss_mask; turns has conv_id, turn, role and text."""

    @F.pandas_udf("struct<ids: binary, begin: int, learn: boolean>")
    def segment(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_segments(roles, texts, Codec.of(tokenizer)), columns=["ids", "begin", "learn"])

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = Codec.of(tokenizer).first
        now, part, start, ids, deltas = None, 0, 0, [], []

        def closed():
            joined = np.concatenate(ids)
            mask = np.cumsum(np.concatenate(deltas)).astype(np.int8)
            return pd.DataFrame({"conv_id": [now], "part": [part], "start": [start], "input_ids": [joined], "loss_mask": [mask]})

        for batch in batches:
            for conv, turn_ids, begin, learn in zip(batch.conv_id, batch.ids, batch.begin, batch.learn, strict=True):
                new = np.frombuffer(turn_ids, "<i4")
                if conv != now or now is None and not ids:
                    if ids:
                        yield closed()
                    now, part, start = conv, 0, 0
                    ids, deltas = [np.array([first + BEGIN], "<i4")], [np.zeros(1, np.int64)]
                elif sum(map(len, ids)) >= part_tokens:
                    yield closed()
                    part, start, ids, deltas = part + 1, start + sum(map(len, ids)), [], []
                delta = np.zeros(len(new), np.int64)
                if learn and len(new) - 1 > begin:
                    delta[begin] += 1
                    delta[len(new) - 1] -= 1
                ids.append(new)
                deltas.append(delta)
        if ids:
            yield closed()

    arrow_rows(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"), segment("role", "text").alias("s"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")
    return rows.select("conv_id", "s.ids", "s.begin", "s.learn").mapInPandas(put_together, FORMATTED)


def read_back(parts: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted rows say: turns and the text under the loss mask, as counts and digests."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, done, now = Codec.of(tokenizer), [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if now is None or row.conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(row.conv_id, codec)
                now.part(np.asarray(row.input_ids), np.asarray(row.loss_mask))
            if done:
                yield pd.DataFrame(done)
                done = []
        if now is not None:
            yield pd.DataFrame([now.row()])

    arrow_rows(parts.sparkSession)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "input_ids", "loss_mask").mapInPandas(walk, READ)


class _Reader:
    """Reads the parts of one conversation in order."""

    def __init__(self, conv_id, codec: Codec):
        self.conv_id, self.codec, self.turns, self.loss_chars, self.chars = conv_id, codec, 0, 0, 0
        self.said, self.learned, self.role = hashlib.sha256(), hashlib.sha256(), None

    def part(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= self.codec.first).tolist()
        for at, following in zip(marks, [*marks[1:], len(ids)], strict=True):
            marker = int(ids[at]) - self.codec.first
            inner = ids[at + 1 : following].tolist()
            raw = self.codec.decode(inner) if inner else ""
            self.chars += len(MARKERS[marker]) + len(raw)
            if marker == ROLE:
                self.role = unescape(raw)
            elif marker in OPENS or marker == ROLE_END:
                role = OPENS.get(marker, self.role)
                text = unescape(raw)
                self.turns += 1
                self.said.update(f"{role}\n{text}\n".encode())
                learned = mask[at + 1 : following]
                if learned.any():
                    text = unescape(self.codec.decode([i for i, m in zip(inner, learned.tolist(), strict=True) if m]))
                    self.loss_chars += len(text)
                    self.learned.update(text.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.said.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.learned.hexdigest(), "formatted_chars": self.chars}
