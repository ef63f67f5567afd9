"""Repair of conversations: turns aligned to the alternating grammar ``(s?(ua)+)?`` of role initials.

``damaged`` spoils conversations in a reproducible way, ``repaired`` mends any table of
(conv_id, turn, role, text).  Each turn gets its first fault (blank, duplicate,
truncated); edits keep (0), rerole (3) or delete (4) a turn or insert an empty one (3),
and a truncated turn that stays costs 3 more.  Blank and duplicate turns must go.

Turns are cut into blocks of ``BLOCK``.  A Wagner-Fischer matrix aligns a block to every
feasible length of the grammar string at once: its column c stands for the last c
letters, so all lengths share it.  Ukkonen bands leave out cells whose offset from the
diagonal alone costs more than the incumbent, which is the cost found in a narrower
band; a second pass with that cost as bound is exact.  A block's least costs between the
places in the grammar where it can be entered and left form a small table.  Walking those
tables backwards gives what the rest of a conversation costs at every border, and walking
forwards traces, letter by letter, the audit that is ASCII-least among the cheapest.  So
a conversation of any length streams through a task in order, block by block: only its
audit, a letter a turn, is ever held as a whole, and texts are only hashed in passing (the
digest of a conversation runs over its text from start to end).

Defined cases: a null role or text is one space; null turns come first; turns of equal
number stand in the order of role and text, so equal rows are duplicates whatever their
order; a role without letters cannot be kept, as it has no initial.  A null conv_id is a
conversation of its own.  Other columns are ignored, whatever their names.  Empty tables
give no rows; a conversation without turns has zeros, an empty audit and the digest of
an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import stored
from clipsight.operators.skew import positions

#: Turns of a block, and the costs of edits.
BLOCK, RENAME, DELETE, INSERT, CUT = 256, 3, 4, 3, 3
#: Blanks, and the ends of a whole text.
BLANK_TEXT, WHOLE_END = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"
#: Faults as they are written into a block's codes.
SOUND, BLANK, DUPLICATE, TRUNCATED = "0123"
#: Places in the grammar: nothing yet, after s (a pair must follow), a expected, pair complete.
START, SYSTEM, HALF, WHOLE = range(4)
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}

RESULT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string, n_rows long, n_kept long, n_inserted long"
)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, cut, repeated or given to the user by their checksum."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(mark == 1, F.lit("")).when(mark == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(mark == 4, F.lit("user")).otherwise(said("role"))
    times = F.when(mark == 0, F.array().cast("array<int>")).when(mark == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _key(column: str) -> Column:
    """A conversation's name that is never null, so that plain joins find it."""
    return F.coalesce(F.concat(F.lit("c"), F.col(column).cast("string")), F.lit(""))


def coded(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, pos, code): turns in order with initial and first fault.

    Whether role and text were seen earlier is the least position of their digest, an
    aggregate that combines before it shuffles.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(_key("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    plain = plain.withColumn("body", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    placed = stored(positions(plain, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")], "pos"))
    first = placed.groupBy("conv", "body").agg(F.min("pos").alias("first")).withColumnsRenamed({"conv": "f_conv", "body": "f_body"})
    known = placed.join(first, (F.col("conv") == F.col("f_conv")) & (F.col("body") == F.col("f_body")))
    fault = (
        F.when(F.col("text").rlike(BLANK_TEXT), F.lit(BLANK))
        .when(F.col("pos") > F.col("first"), F.lit(DUPLICATE))
        .when(~F.col("text").rlike(WHOLE_END), F.lit(TRUNCATED))
        .otherwise(F.lit(SOUND))
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return known.select("conv", "conv_id", "turn", "role", "text", "pos", F.concat(letter, fault).alias("code"))


def _turns(codes: str) -> list[tuple[str, str]]:
    return [(codes[i], codes[i + 1]) for i in range(0, len(codes), 2)]


def _aligned(turns: list[tuple[str, str]], last: str, bound: int) -> tuple[list[int], list[int]]:
    """Least cost of turns i.. against strings of one letter or more that end in ``last``, by first letter u and a.

    Column c is the string's last c letters.  Cells that lie so far off the diagonal
    that insertions or deletions alone cost more than ``bound`` are left out.
    """
    n = len(turns)
    more, less = bound // INSERT + 1, bound // DELETE + 1
    letters = last + ("u" if last == "a" else "a")  # letter of column c: letters[(c - 1) % 2]
    by_u, by_a = [FAR] * (n + 1), [FAR] * (n + 1)
    below: list[int] = []
    below_from = 0
    for i in range(n, -1, -1):
        left, right = max(0, n - i - less), n - i + more
        row = [FAR] * (right - left + 1)
        if i < n:
            role, fault = turns[i]
            gone, stays = fault in (BLANK, DUPLICATE), CUT if fault == TRUNCATED else 0
        for c in range(left, right + 1):
            best = 0 if i == n and c == 0 else FAR
            if i < n:
                k = c - below_from
                if 0 <= k < len(below):
                    best = below[k] + DELETE
                if c and not gone and 0 <= k - 1 < len(below):
                    best = min(best, below[k - 1] + stays + (0 if role == letters[(c - 1) % 2] else RENAME))
            if c > left:
                best = min(best, row[c - 1 - left] + INSERT)
            row[c - left] = best
            if c and best < FAR:
                side = by_u if letters[(c - 1) % 2] == "u" else by_a
                if best < side[i]:
                    side[i] = best
        below, below_from = row, left
    return by_u, by_a


@lru_cache(maxsize=512)
def matrices(codes: str) -> dict[int, tuple[list[int], list[int]]]:
    """For strings that end in u (HALF) and in a (WHOLE): exact least costs of every suffix of the block."""
    turns, out = _turns(codes), {}
    for place, last in ((HALF, "u"), (WHOLE, "a")):
        bound, found = 4 * INSERT, _aligned(turns, last, 4 * INSERT)
        if (incumbent := max(max(x) for x in found)) > bound:
            found = _aligned(turns, last, incumbent)
        out[place] = found
    return out


def _system(turns: list[tuple[str, str]], i: int) -> int | None:
    """Cost of keeping turn i as the system turn, if it can be."""
    role, fault = turns[i]
    return None if role != "s" or fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0


def _onward(codes: str, leave: list[int]) -> list[list[int]]:
    """What the block from turn i and all that follows costs at every place, given the costs of leaving it."""
    turns, aligned = _turns(codes), matrices(codes)
    n = len(turns)
    out = [[FAR] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        u = min(aligned[y][0][i] + leave[y] for y in (HALF, WHOLE))
        a = min(aligned[y][1][i] + leave[y] for y in (HALF, WHOLE))
        for place in range(4):
            out[i][place] = min((n - i) * DELETE + leave[place], a if place == HALF else u, FAR)
        if i < n:
            out[i][START] = min(out[i][START], out[i + 1][START] + DELETE)
            if (kept := _system(turns, i)) is not None:
                out[i][START] = min(out[i][START], kept + out[i + 1][SYSTEM])
    return out


def transfer(codes: str) -> list[int]:
    """The block's least cost from every place to every place, row by row."""
    rows = []
    for place in range(4):
        leave = [FAR] * 4
        leave[place] = 0
        rows.append(_onward(codes, leave)[0])
    return [rows[left][entered] for entered in range(4) for left in range(4)]


def traced(codes: str, leave: list[int], place: int) -> tuple[str, str, int]:
    """(letters of the audit, letters put out, place left at): cheapest, of those ASCII-least.

    Put out are one character per audit letter: s, u, a of a kept turn in lower case,
    U and A for a new role or an inserted turn, and - for a deleted one.
    """
    turns, cost = _turns(codes), _onward(codes, leave)
    n, i, audit, put = len(turns), 0, [], []
    while True:
        now = cost[i][place]
        if i == n and leave[place] == now:
            return "".join(audit), "".join(put), place
        if i < n and cost[i + 1][place] + DELETE == now:
            audit.append("D")
            put.append("-")
            i += 1
            continue
        letter, then = ("a", WHOLE) if place == HALF else ("u", HALF)
        if cost[i][then] + INSERT == now:
            audit.append("I")
            put.append(letter.upper())
            place = then
            continue
        role, fault = turns[i]
        stays = CUT if fault == TRUNCATED else 0
        kept = _system(turns, i) if place == START else None
        if kept is not None and cost[i + 1][SYSTEM] + kept == now:
            audit.append("K")
            put.append("s")
            place = SYSTEM
        elif role == letter and cost[i + 1][then] + stays == now:
            audit.append("K")
            put.append(letter)
            place = then
        else:
            audit.append("R")
            put.append(letter.upper())
            place = then
        i += 1


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from last to first: what follows each costs at every place."""
    conv, ahead = None, []
    for batch in batches:
        names, numbers, tables = (batch.column(c).to_pylist() for c in ("conv", "block", "costs"))
        out = []
        for name, table in zip(names, tables):
            if name != conv:
                conv, ahead = name, [0, FAR, FAR, 0]
            out.append(ahead)
            ahead = [min(min(table[4 * p + q] + ahead[q] for q in range(4)), FAR) for p in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), batch.column("codes"), pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "codes", "ahead"])


class _Report:
    """What is carried along one conversation."""

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id, self.place, self.cost, self.audit = conv, conv_id, START, 0, []
        self.digest, self.first, self.block = hashlib.sha256(), True, -1
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}
        self.turns, self.low, self.high, self.before, self.illegal = 0, None, None, None, 0
        self.kept = self.inserted = self.rows = 0
        self.steps: Iterator[tuple[str, str]] = iter(())

    def write(self, role: str, text: str) -> None:
        self.digest.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def enter(self, block: int, codes: str, ahead: list[int]) -> None:
        self.flush()
        audit, put, place = traced(codes, ahead, self.place)
        if block == 0:
            self.cost = _onward(codes, ahead)[0][START]
        self.audit.append(audit)
        self.steps, self.block, self.place = iter(zip(audit, put)), block, place

    def flush(self) -> None:
        """Turns inserted behind the last of a block."""
        for _, put in self.steps:
            self.inserted += 1
            self.write(ROLES[put.lower()], "")

    def turn(self, number, role: str, text: str, code: str) -> None:
        self.rows += 1
        self.counts[code[1]] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if number is not None:
            if self.high is None or number != self.high:
                self.turns += 1
            self.low, self.high = number if self.low is None else self.low, number
        for did, put in self.steps:
            if did == "I":
                self.inserted += 1
                self.write(ROLES[put.lower()], "")
                continue
            if did != "D":
                self.kept += 1
                self.write(role if did == "K" else ROLES[put.lower()], text)
            return

    def row(self) -> tuple:
        self.flush()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost,
                "".join(self.audit), self.digest.hexdigest(), self.rows, self.kept, self.inserted)


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a conversation in order, with their block's codes: one report each."""
    report, names, kind = None, [f.split()[0] for f in RESULT.split(", ")], None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        convs, ids, turns, roles, texts, codes, blocks, wholes, aheads = (
            batch.column(c).to_pylist() for c in ("conv", "conv_id", "turn", "role", "text", "code", "block", "codes", "ahead"))
        done = []
        for k, conv in enumerate(convs):
            if report is None or report.conv != conv:
                if report is not None:
                    done.append(report.row())
                report = _Report(conv, ids[k])
            if blocks[k] != report.block:
                report.enter(blocks[k], wholes[k], aheads[k])
            report.turn(turns[k], roles[k], texts[k], codes[k])
        if done:
            yield _batch(done, names, kind)
    if report is not None:
        yield _batch([report.row()], names, kind)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def repaired(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest of the cheapest repair.

    ``conversations`` (conv_id) names those to be listed even if no turn is left of them.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = coded(rows).withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    # At most BLOCK codes of two letters meet in a group.
    in_order = F.array_sort(F.collect_list(F.struct("pos", "code")))
    blocks = turns.groupBy("conv", "block").agg(F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes"))

    @F.pandas_udf("array<long>")
    def costs(codes: pd.Series) -> pd.Series:
        known: dict[str, list[int]] = {}  # of this batch: short conversations are often alike
        return codes.map(lambda c: known.get(c) or known.setdefault(c, transfer(c)))

    tables = blocks.withColumn("costs", costs("codes"))
    later = tables.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    ahead = stored(later.mapInArrow(_backwards, "conv string, block long, codes string, ahead array<long>"))
    ahead = ahead.withColumnsRenamed({"conv": "a_conv", "block": "a_block"})
    planned = turns.join(ahead, (F.col("conv") == F.col("a_conv")) & (F.col("block") == F.col("a_block")))
    planned = planned.select("conv", "conv_id", "turn", "role", "text", "code", "pos", "block", "codes", "ahead")
    streamed = planned.repartition("conv").sortWithinPartitions("conv", "pos")
    reports = streamed.mapInArrow(_forwards, RESULT.format(id=kind))
    if conversations is None:
        return reports
    asked = conversations.select("conv_id", _key("conv_id").alias("conv")).dropDuplicates(["conv"])
    found = reports.withColumn("r_conv", _key("conv_id")).drop("conv_id")
    joined = asked.join(found, F.col("conv") == F.col("r_conv"), "left")
    numbers = [n for n in reports.columns if n not in ("conv_id", "audit", "repaired_sha256")]
    return joined.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers[:6]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers[6:]],
    )
