"""Repair of conversation structure by cheapest edits.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by a hash of the text, so only equal
rows are interchangeable). Each row's first fault counts: blank, duplicate (its role and text came before), truncated
(it does not end in . ! or ?). Edits make the roles read `(s?(ua)+)?`: Keep, Rerole, Delete (a must for blank and duplicate rows),
Insert. A dynamic program over four states (nothing yet, after s, u, a) keeps the least cost of each and, of equal
costs, the least string of edit initials. These strings are shared linked nodes (`audit_paths`).

Four steps: faults are marked from the first turn of each repeated (conversation, role, text), an aggregate with map-side minima.
Slim rows are dealt by range and sorted, so a long conversation lies in many tasks, each of which packs its rows into one byte each.
The program walks the packed bytes of a conversation. Last, texts follow their conversation's audit in one sorted
stream, which hashes the repaired rows; a SHA-256 is sequential, so a conversation is one stream there, never held whole.

Nulls: a null role or text is one space (so such a text is blank); a null conversation id is a conversation; null turns come
first and count for no gap. Repeated rows are duplicates. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .audit_paths import ROOT, Paths
from .common import parts_of

#: Characters that are no space, \t … \r, at the end of a text and anywhere.
LAST, SEEN = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", r"[^\x20\x09-\x0D]"
#: A packed row is role + 4 * fault.
ROLES, FAULTS = {"s": 1, "u": 2, "a": 3}, ("", "blank", "duplicate", "truncated")
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT = 2, 3, 2
#: States of the program, and what a kept role makes of each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {1: {NOTHING: SYSTEM}, 2: {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, 3: {USER: ASSISTANT}, 0: {}}
NEXT = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(1, 2), (2, 3), (3, 2)}

PACKED = "conv string, at bigint, codes binary, first bigint, last bigint, turns bigint"
REPAIR = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
CHUNK_ROWS, RANGE_ROWS = 1 << 16, 1 << 14


class Audit:
    """The cheapest edits of rows that come one by one."""

    def __init__(self):
        self.paths = Paths()
        self.best: list[tuple[int, int] | None] = [(0, ROOT), None, None, None]

    def _take(self, new: list, state: int, cost: int, parent: int, char: str) -> None:
        old = new[state]
        if old is None or cost < old[0] or cost == old[0] and self.paths.less(parent, char, old[1], old[2]):
            new[state] = (cost, parent, char)

    def _close(self, new: list) -> list:
        return [None if n is None else (n[0], self.paths.add(n[1], n[2]) if n[2] else n[1]) for n in new]

    def insert(self) -> None:
        new = [None if b is None else (*b, "") for b in self.best]
        for state in (NOTHING, SYSTEM, ASSISTANT):
            if self.best[state]:
                self._take(new, USER, self.best[state][0] + INSERT, self.best[state][1], "I")
        self.best = self._close(new)
        if self.best[USER]:
            new = [None if b is None else (*b, "") for b in self.best]
            self._take(new, ASSISTANT, self.best[USER][0] + INSERT, self.best[USER][1], "I")
            self.best = self._close(new)

    def row(self, code: int) -> None:
        self.insert()
        role, fault = code & 3, code >> 2
        extra, new = int(fault == TRUNCATED), [None] * 4
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self._take(new, state, cost + DELETE, node, "D")
            if fault not in (BLANK, DUPLICATE):
                if state in KEPT[role]:
                    self._take(new, KEPT[role][state], cost + extra, node, "K")
                self._take(new, NEXT[state], cost + REROLE + extra, node, "R")
        new = self._close(new)
        nodes = self.paths.settle([b and b[1] for b in new])
        self.best = [b and (b[0], n) for b, n in zip(new, nodes, strict=True)]

    def result(self) -> tuple[int, str]:
        self.insert()
        a, b = self.best[NOTHING], self.best[ASSISTANT]
        if b[0] < a[0] or b[0] == a[0] and self.paths.less(b[1], "", a[1], ""):
            a = b
        return a[0], self.paths.whole(a[1])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of one conversation's consecutive rows; equal rows but the first are duplicates."""
    part, now, held, last, out = 0, None, [], None, []

    def closed() -> tuple:
        turns = [t for _, t in held if t is not None]
        return now, held_at, bytes(c for c, _ in held), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns))

    def frame() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["conv", "at", "codes", "first", "last", "turns"], dtype=object)
        return rows.astype({"at": "int64", "first": "Int64", "last": "Int64", "turns": "int64"})

    for batch in batches:
        for conv, place, turn, row, role, fault, repeat in zip(batch.conv, batch.place, batch.turn, batch.h, batch.role, batch.fault, batch.repeat, strict=True):
            if held and (conv != now or len(held) >= CHUNK_ROWS):
                out.append(closed())
                held, part = [], part + 1
            if not held:
                held_at = (int(place) << 32) + part
            turn, same = None if turn is None else int(turn), (conv, turn, row)
            fault = DUPLICATE if fault != BLANK and (repeat or same == last) else int(fault)
            held.append((ROLES.get(role[:1], 0) + 4 * fault, turn))
            now, last = conv, same
        if out:
            yield frame()
            out = []
    if held:
        out.append(closed())
        yield frame()


def _audits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, out = None, []

    def closed() -> dict:
        cost, edits = audit.result()
        gaps = last - first + 1 - turns if first is not None else 0
        return {"conv": now, "gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED],
                "illegal": illegal, "cost": cost, "audit": edits}

    for batch in batches:
        for conv, codes, a, b, n in zip(batch.conv, batch.codes, batch["first"], batch["last"], batch.turns, strict=True):
            if conv != now:
                if now is not None:
                    out.append(closed())
                now, audit, faults, illegal, before, first, last, turns = conv, Audit(), [0] * 4, 0, None, None, None, 0
            if not pd.isna(a):
                turns += int(n) - (last is not None and last == int(a))
                first, last = int(a) if first is None else first, int(b)
            for code in codes:
                faults[code >> 2] += 1
                illegal += before is not None and (before, code & 3) not in LEGAL
                before = code & 3
                audit.row(code)
        if out:
            yield pd.DataFrame(out)
            out = []
    if now is not None:
        yield pd.DataFrame([closed()])


class _Repaired:
    """The repaired rows of one conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.n, self.hash = audit, 0, NOTHING, 0, hashlib.sha256()

    def _say(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.n else b"") + f"{role}:{text}".encode())
        self.n += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            self._say(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[ROLES[role[0]]][self.state]
            self._say(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._say(NAMES[self.state], text)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, reader, out = None, None, []

    def closed() -> dict:
        reader.inserts()
        return {"conv": now, "audit": reader.audit, "repaired": reader.n, "repaired_sha256": reader.hash.hexdigest()}

    for batch in batches:
        for conv, audit, role, text in zip(batch.conv, batch.audit, batch.role, batch.text, strict=True):
            if conv != now:
                if reader:
                    out.append(closed())
                now, reader = conv, _Repaired(audit)
            else:
                reader.row(role, text)
        if out:
            yield pd.DataFrame(out)
            out = []
    if reader:
        yield pd.DataFrame([closed()])


def repair(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, the counts of faults and gaps, cost, audit, repaired (rows) and repaired_sha256; turns has conv_id, turn, role, text."""
    kind = turns.schema[conv_col].dataType
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("h", F.sha2("text", 256))
    end = F.regexp_extract("text", LAST, 1)
    fault = F.when(~F.col("text").rlike(SEEN), BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    slim = rows.select("conv", "turn", "role", "h", fault.alias("fault"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = slim.where(F.col("fault") != BLANK).groupBy("conv", "role", "h").agg(F.min(order).alias("begin"), F.max(order).alias("end"))
    firsts = firsts.where(F.col("begin") != F.col("end")).drop("end")
    slim = staged(slim.join(firsts, ["conv", "role", "h"], "left").withColumn("repeat", F.coalesce(order > F.col("begin"), F.lit(False))).drop("begin"), "repair-rows")
    line = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    dealt = slim.repartitionByRange(parts_of(slim.count(), RANGE_ROWS), *line).sortWithinPartitions(*line)
    # Turns may be null: as text they keep all their digits in pandas.
    dealt = dealt.select("conv", F.spark_partition_id().alias("place"), F.col("turn").cast("string").alias("turn"), F.concat_ws(":", "role", "h").alias("h"), "role", "fault", "repeat")
    packed = staged(dealt.mapInPandas(_pack, PACKED), "repair-packed")
    audits = staged(packed.repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(_audits, REPAIR), "repair-audits")
    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("h"), "audit", F.lit("").alias("text"))
    bodies = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "h", F.lit("").alias("audit"), "text")
    stream = heads.unionByName(bodies).repartition("conv").sortWithinPartitions("conv", "kind", *line[1:])
    done = stream.select("conv", "audit", "role", "text").mapInPandas(_digests, "conv string, audit string, repaired bigint, repaired_sha256 string")
    out = audits.drop("audit").join(done, "conv")
    return out.withColumn(conv_col, F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)).drop("conv")
