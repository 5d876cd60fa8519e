"""Repair of the turn structure of conversations, streamed in turn order.

A conversation should read: a system turn or none, then user and assistant in turn. The cheapest edits come from
dynamic programming over four states (nothing yet, after system, after user, after assistant). It runs from the last
turn to the first, so that of equally cheap edits the one whose letters come first is known by its first letter. Rows are
partitioned by conversation and sorted by turn, descending; the costs of the four states go on from Arrow batch to
Arrow batch, and each row leaves one byte: the first letter of the best edits for each state. These bytes are written
out block by block as a table. A second stream, ascending, has each block just before the rows it is about and walks
through them: it holds the blocks still ahead (a byte a row), never the texts.

The digest of a conversation's repaired text is one running hash, so one task has to read a conversation's rows in
turn; a conversation of any size takes the memory of a batch and a byte a row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.llm.common import arrow_type
from mailsift.session import scratch_path

START, SYSTEM, USER, ASSISTANT = range(4)
#: What the letters are called, in the order that decides ties, and the state each state must be followed by.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of edits; a truncated row that stays costs one more.
DELETED, INSERTED, REROLED, CUT_OFF = 3, 2, 2, 1
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Rows of a block of the byte table.
BLOCK = 1 << 16
#: No row of the conversation is left here.
GONE = 16
#: States from which a conversation may end as it is; others need their missing turns.
_AFTER = (0, 4, 2, 0)

SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) after damage, with ``gone`` for those dropped.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes the ``.!?`` out of it, 3 repeats
    it, 4 makes its role user. Nulls read as one space, in the key, the role and the text.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
                       (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return made.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "times")).alias("time"))


def _code() -> Column:
    """Initial of the role and first fault of a row as one number; ``GONE`` for a dropped row."""
    initial = F.substring("role", 1, 1)
    by_initial = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    seen = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(seen, BLANK).when(F.col("copy") > 1, DUPLICATE).when(~ended, TRUNCATED).otherwise(SOUND)
    return F.when(F.col("gone"), GONE).otherwise(by_initial + 4 * fault)


def step(ahead: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """From the costs of the states after a row to those before it, and the byte of first letters (two bits a state)."""
    role, fault = code & 3, code >> 2
    stays = fault not in (BLANK, DUPLICATE)
    more = CUT_OFF if fault == TRUNCATED else 0
    best, letters = [], []
    for state in range(4):
        options = [(DELETED + ahead[state], DELETE)]
        if stays:
            to = NEXT[state]
            if role == to or role == SYSTEM and state == START:
                options.append((more + ahead[role], KEEP))
            options.append((REROLED + more + ahead[to], REROLE))
        cost, letter = min(options)
        best.append(cost)
        letters.append(letter)
    for _ in range(2):  # at most two turns are put in before a row: a third would be back where the first was
        for state in range(4):
            through = INSERTED + best[NEXT[state]]
            if (through, INSERT) < (best[state], letters[state]):
                best[state], letters[state] = through, INSERT
    return tuple(best), sum(letter << 2 * state for state, letter in enumerate(letters))


class _Backwards:
    """One conversation read from its last turn to its first."""

    def __init__(self, conv):
        self.conv, self.base, self.ahead = conv, 0, _AFTER
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.high = self.low = self.later = self.first = None
        self.distinct, self.block, self.blocks = 0, bytearray(), 0

    def row(self, turn, code, moves):
        if code == GONE:
            return None
        out = None
        if len(self.block) == BLOCK:
            out = self.flush(False)
        move = moves.get((self.ahead, code))
        if move is None:
            costs, letters = step(self.ahead, code)
            least = min(costs)
            move = moves[self.ahead, code] = tuple(c - least for c in costs), least, letters
        self.ahead, more, letters = move
        self.base += more
        self.block.append(letters)
        role, fault = code & 3, code >> 2
        self.counts[fault] += 1
        if self.later is not None and (role, self.later) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            self.illegal += 1
        self.later = role
        if turn is not None:
            if self.high is None:
                self.high = turn
            if turn != self.low:
                self.distinct += 1
            self.low = turn
        self.first = turn
        return out

    def flush(self, last: bool) -> tuple:
        self.blocks += 1
        block, self.block = bytes(reversed(self.block)), bytearray()
        turn = self.first if block else None
        if not last:
            return (self.conv, turn, -self.blocks, block, *[None] * 6)
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        cost = self.base + self.ahead[START] if block else 0
        return (self.conv, turn, -self.blocks, block, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED],
                self.illegal, cost)


def _backwards(schema: pa.Schema):
    """Blocks of letters of every conversation, the last block with its figures; rows come by conversation, turn
    descending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, now = {}, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            out = []
            for conv, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.flush(True))
                    now = _Backwards(conv)
                if (block := now.row(turn, code, moves)) is not None:
                    out.append(block)
            if out:
                yield table(out)
        if now is not None:
            yield table([now.flush(True)])

    return run


class _Forwards:
    """The walk through one conversation's rows, by the letters of its blocks."""

    def __init__(self, conv, emit):
        self.conv, self.state, self.figures, self.emit = conv, START, None, emit
        self.ahead, self.at = deque(), 0

    def block(self, letters, figures):
        self.ahead.append(letters)
        if figures[0] is not None:
            self.figures = figures

    def row(self, role, text):
        while self.at == len(self.ahead[0]):
            self.ahead.popleft()
            self.at = 0
        letters = self.ahead[0][self.at]
        self.at += 1
        while (letter := letters >> 2 * self.state & 3) == INSERT:
            self.insert()
        if letter == KEEP:
            initial = role[:1]
            self.state = SYSTEM if initial == "s" else USER if initial == "u" else ASSISTANT
        elif letter == REROLE:
            self.state = NEXT[self.state]
            role = ROLES[self.state]
        self.emit(self.conv, letter, role, text)

    def insert(self):
        self.state = NEXT[self.state]
        self.emit(self.conv, INSERT, ROLES[self.state], "")

    def end(self):
        while self.state in (SYSTEM, USER):
            self.insert()


def _walk(batches: Iterator[pa.RecordBatch], emit, done) -> Iterator[None]:
    """Feeds blocks and rows to the walks; yields after every batch and at the end."""
    now = None
    names = ("conv_id", "letters", "role", "text", *(f.split()[0] for f in SUMMARY.split(", ")))
    for batch in batches:
        for conv, letters, role, text, *figures in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    now.end()
                    done(now)
                now = _Forwards(conv, emit)
            if letters is not None:
                now.block(letters, figures)
            else:
                now.row(role, text)
        yield
    if now is not None:
        now.end()
        done(now)
    yield


def _digests(schema: pa.Schema):
    """(conv_id, figures, audit, repaired_sha256) of every conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, text_hash, lines = [], bytearray(), hashlib.sha256(), 0

        def emit(conv, letter, role, text):
            nonlocal lines
            audit.append(ord(LETTERS[letter]))
            if letter != DELETE:
                text_hash.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "replace"))
                lines += 1

        def done(walk):
            nonlocal text_hash, lines
            out.append((walk.conv, *walk.figures, audit.decode(), text_hash.hexdigest()))
            audit.clear()
            text_hash, lines = hashlib.sha256(), 0

        for _ in _walk(batches, emit, done):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()

    return run


def _rows(schema: pa.Schema):
    """(conv_id, place, edit, role, text) of every row of the edits, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0

        def emit(conv, letter, role, text):
            nonlocal place
            out.append((conv, place, LETTERS[letter], role, text))
            place += 1

        def done(walk):
            nonlocal place
            place = 0

        for _ in _walk(batches, emit, done):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema])


def _planned(rows: DataFrame) -> DataFrame:
    """Rows and, before each block of them, its letters; by conversation, in turn order."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    ids = rows.repartition("conv_id")
    copies = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first(), "time")
    coded = ids.withColumn("copy", F.row_number().over(copies)).withColumn("code", _code().cast("int"))
    ordered = coded.sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(),
                                         F.col("copy").desc()).select("conv_id", "turn", "code")
    blocks = T.StructType.fromDDL(f"conv_id {kind}, turn {turn}, place int, letters binary, {SUMMARY}")
    at = scratch_path(spark, "letters")
    ordered.mapInArrow(_backwards(_arrow(blocks)), blocks).write.parquet(at)
    both = spark.read.parquet(at).unionByName(rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), F.col("letters").isNull(), "place", "role", "text")


def _named(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def _sound(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       F.lit(False).alias("gone"), F.lit(1).alias("time"))


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           damage: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    Rows are read by turn, nulls first, those of one turn by role and text. ``gaps``: whole turn numbers missing between the
    least and the greatest. A row's first fault counts: blank (white space only), duplicate (role and text stood
    earlier), truncated (its last visible character is none of ``.!?``). ``illegal``: neighbours whose role initials
    are none of su, ua, au. ``audit``: the letters of the cheapest edits (Delete, Insert, Keep, Rerole), the
    first in ASCII order of equal ones. Null roles and texts read as one space; null conversation ids are one
    conversation; an empty table gives no rows. Other columns are not read, whatever their names. ``damage`` applies
    ``damaged`` first; a conversation of which no row is left has zeros, no letters and the hash of no text.
    """
    rows = _named(conversations, conv, turn, role, text)
    rows = damaged(rows) if damage else _sound(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, {SUMMARY}, audit string, repaired_sha256 string")
    return _planned(rows).mapInArrow(_digests(_arrow(schema)), schema)


def repaired_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  damage: bool = False) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of every conversation's edits in order, deleted ones (D) included, with
    the roles they get. The repaired conversation is the rest. See ``repair``."""
    rows = _named(conversations, conv, turn, role, text)
    rows = damaged(rows) if damage else _sound(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, place bigint, edit string, role string, text string")
    return _planned(rows).mapInArrow(_rows(_arrow(schema)), schema)
