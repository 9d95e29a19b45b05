"""Conversation structure repair (op11): survivor-coalescence Viterbi per conversation.

Turns are dealt by conversation, sorted by turn and streamed through
``survivors.Repair``, which hands out an edit as soon as all survivors share it,
so a task holds the unresolved turns of one conversation and never all of it.
A turn's first fault counts: ``blank`` (no character but ASCII white space),
``duplicate`` (role and text seen earlier in the conversation) or ``truncated``
(the last such character is not ``.``, ``!`` or ``?``). Earlier equal turns are
found by a window over (conversation, role, text), which spreads a large
conversation over all tasks; only its sequence of edits is one task's work,
since each depends on the one before. A run of turns that every survivor edits
alike is one node; their texts wait only if they may stay.

Cases: a null role or text is one space (a blank turn); a null conv_id is a
conversation of its own; null turns come first; equal turn numbers are ordered by
role and text, and repeated rows are duplicates; an empty role is no role; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimhound.llm.staging import table
from claimhound.llm.survivors import Repair

EDITS = (
    "conv_id long, step long, edit string, role string, text string, turn long,"
    " initial string, fault string, cost long"
)
DIGESTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long,"
    " cost long, audit string, repaired_sha256 string"
)
LEGAL = frozenset({"su", "ua", "au"})
#: Edits that are handed to Spark at a time.
ROWS_A_BATCH = 2048


def _clean(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with a fault each, told by a hash of conv_id and turn."""
    rows = _clean(conversations)
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.otherwise(F.col("text")).alias("text"), times.alias("times"))
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, times)"))).drop("times", "copy")


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, null-free texts) with the fault of each, or null."""
    solid = F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    fault: Column = (
        F.when(solid == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return turns.withColumn("fault", fault)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EDITS in order, from sorted rows of conv_id, turn, role, text, fault."""
    schema = pa.schema(
        [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in EDITS.split(",")]
    )
    out: list[tuple] = []
    repair, conv, step, begun = Repair(), None, 0, False

    def took(found: Iterator[tuple]) -> None:
        nonlocal step
        for edit, role, row in found:
            turn, initial, fault, text = row or (None, None, None, "")
            out.append((conv, step, edit, role, None if role is None else text, turn, initial, fault, None))
            step += 1

    def ended() -> None:
        took(repair.finish())
        out[-1] = (*out[-1][:-1], repair.cost)  # the whole cost is on the last edit

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            conv_id, turn, role, text, fault = r
            if not begun or conv_id != conv:
                if begun:
                    ended()
                repair, conv, step, begun = Repair(), conv_id, 0, True
            forced = fault in ("blank", "duplicate")
            row = (turn, role[:1], fault, None if forced else text)
            took(repair.add(role[:1], forced, fault == "truncated", role, row))
            if len(out) >= ROWS_A_BATCH:
                last = out.pop()
                if out:
                    yield flushed()
                out.append(last)  # finish() writes the cost on it
    if begun:
        ended()
        yield flushed()


def repair_edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text).

    One row per edit, in order of ``step`` within a conversation: edit (K, R, D
    or I), the repaired role and text (null where the turn is deleted), the
    turn's number, its role's initial and its fault before (null for an
    inserted turn), and the conversation's whole cost on its last row.
    """
    rows = faults(_clean(turns)).select("conv_id", "turn", "role", "text", "fault")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_edits, EDITS)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (its place, from 0), role, text."""
    kept = repair_edits(turns).where("edit <> 'D'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("step")) - 1
    return kept.select("conv_id", place.cast("long").alias("turn"), "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of DIGESTS per conversation, folded from its edits in order."""
    names = [c.split()[0] for c in DIGESTS.split(",")]
    columns = ("conv_id", "edit", "role", "text", "turn", "initial", "fault", "cost")
    now: dict | None = None

    def row() -> list:
        gaps = now["turns"][1] - now["turns"][0] + 1 - now["distinct"] if now["turns"] else 0
        faults = [now[f] for f in ("blank", "duplicate", "truncated")]
        return [now["conv_id"], gaps, *faults, now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()]

    for batch in batches:
        out = []
        for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            conv_id, edit, role, text, turn, initial, fault, cost = r
            if now is None or conv_id != now["conv_id"]:
                if now is not None:
                    out.append(row())
                now = {"conv_id": conv_id, "turns": None, "distinct": 0, "last": None, "audit": [], "sha": hashlib.sha256()}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "kept"), 0)
            now["audit"].append(edit)
            if edit != "I":
                if fault:
                    now[fault] += 1
                if now["last"] is not None and now["last"] + initial not in LEGAL:
                    now["illegal"] += 1
                now["last"] = initial
                if turn is not None:
                    lo, hi = now["turns"] or (turn, None)
                    now["distinct"] += turn != hi
                    now["turns"] = (lo, turn)
            if role is not None:
                now["sha"].update(f"{chr(10) if now['kept'] else ''}{role}:{text}".encode())
                now["kept"] += 1
            if cost is not None:
                now["cost"] = cost
        if out:
            yield _as_batch(out, names)
    if now is not None:
        yield _as_batch([row()], names)


def _as_batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def op11_survivors(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair_edits(damage(conversations)).mapInArrow(_digests, DIGESTS)
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    found = ids.join(found.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    names = [c.split()[0] for c in DIGESTS.split(",")]
    return found.select(
        "conv_id", *(F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:])
    )
