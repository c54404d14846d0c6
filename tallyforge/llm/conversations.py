"""Repair of the structure of conversations by a backward cost-to-go and a greedy walk forward.

Role initials of a repaired conversation are `(s?(ua)+)?`. Over turns and the four states of that grammar the least cost
to the end is computed backward; the walk forward then takes, among the edits that keep to the least cost, the one whose
initial comes first in ASCII. Conversations of up to SHORT rows are repaired whole within a task. Longer ones are cut into
segments: each gives the least costs between its states as a matrix, the products of the matrices from the end give each
segment its cost-to-go, and a second pass the state in which each is entered. So no task walks a long conversation; only
the digest over its repaired text, which has one order, streams through one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table

#: Rows up to which a conversation is repaired whole, and rows of a segment of a longer one.
SHORT = 4096
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
STATES = range(4)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or renamed turn takes in a state, and the state after it.
ROLE, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


class Turn(NamedTuple):
    initial: str
    gone: bool  # blank or a duplicate: it has to be deleted
    cost: int  # of leaving it in
    times: int = 1
    role: str = ""
    text: str = ""


def _closed(v: list[int]) -> list[int]:
    """Least costs once turns may be inserted first."""
    two, three = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + two), min(v[1], INSERT + two), two, three]


#: Cost-to-go after the last turn: nothing where the grammar accepts.
END = _closed([0, FAR, FAR, 0])


def cost_to_go(turns: list[Turn], last: list[int]) -> list[list[int]]:
    """For each place before, between and after the turns the least cost to the end from each state."""
    values = [last]
    for turn in reversed(turns):
        v = values[-1]
        if turn.gone:  # deleting what has to go never waits for an insertion
            values.append([x + DELETE * turn.times for x in v])
            continue
        now = []
        for q in STATES:
            kept = KEPT[q].get(turn.initial)
            best = min(DELETE + v[q], REROLE + turn.cost + v[AFTER[q]])
            now.append(best if kept is None else min(best, turn.cost + v[kept]))
        values.append(_closed(now))
    return values[::-1]


def walk(turns: list[Turn], values: list[list[int]], state: int, final: bool) -> tuple[str, list[tuple[str, str]], int]:
    """(initials of the edits, repaired (role, text), last state): of the cheapest edits those whose initials are least in ASCII."""
    letters: list[str] = []
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(turns) or (final and values[at][state]):
        left = values[at][state]
        turn = turns[at] if at < len(turns) else None
        if turn and turn.gone:
            letters.append("D" * turn.times)
            at += 1
        elif turn and left == DELETE + values[at + 1][state]:
            letters.append("D")
            at += 1
        elif left == INSERT + values[at][AFTER[state]]:
            letters.append("I")
            out.append((ROLE[state], ""))
            state = AFTER[state]
        else:
            kept = KEPT[state].get(turn.initial)
            if kept is not None and left == turn.cost + values[at + 1][kept]:
                letters.append("K")
                out.append((turn.role, turn.text))
                state = kept
            else:
                letters.append("R")
                out.append((ROLE[state], turn.text))
                state = AFTER[state]
            at += 1
    return "".join(letters), out, state


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with the column times: crc32 of conv_id:turn decides what is dropped (times 0), emptied, repeated (times 2) or changed.

    A null conv_id, turn, role or text reads as one space; conv_id and turn stay null in the result.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), "text", fate.alias("fate"))
    return out.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("times"),
    )


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _ended(text: Column) -> Column:
    return text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


PARTS = "conv_id long, segment long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>"
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
HANDED = 1 << 22


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _named(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _illegal(initials: Iterable[str]) -> int:
    before, n = None, 0
    for x in initials:
        n += before is not None and before + x not in LEGAL
        before = x
    return n


def repaired(rows: Iterable[tuple]) -> tuple:
    """Rows (turn, role, text, times, blank, ended) of a conversation in order -> the columns of PARTS after segment."""
    seen, known, turns = set(), set(), []
    blank = duplicate = truncated = 0
    for turn, role, text, times, is_blank, is_ended in rows:
        if times and turn is not None:
            known.add(turn)
        for _ in range(times):
            again = (role, text) in seen
            cut_off = not is_blank and not again and not is_ended
            blank, duplicate, truncated = blank + is_blank, duplicate + (not is_blank and again), truncated + cut_off
            seen.add((role, text))
            turns.append(Turn(role[:1], is_blank or again, TRUNCATED * cut_off, 1, role, text))
    values = cost_to_go(turns, END)
    audit, out, _ = walk(turns, values, 0, True)
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, blank, duplicate, truncated, _illegal(t.initial for t in turns), values[0][0], audit, _named(out)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in PARTS.split(",")[:9]] + ["turns"]
    types = [pa.int64()] * 8 + [pa.string(), TURNS]
    held, size = [], 0
    for key, group in groupby(_rows(batches), lambda r: r[0]):
        held.append((key, 0, *repaired(r[1:] for r in group)))
        size += sum(len(t["text"]) for t in held[-1][-1]) + 64
        if size > HANDED:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


SEGMENT = ["missing", "conv", "segment"]
MATRIX = [f"m{a}{b}" for a in STATES for b in STATES]
LASTS, EXITS = [f"e{q}" for q in STATES], [f"x{q}" for q in STATES]


def _segment_turns(group: Iterable[tuple]) -> list[Turn]:
    """Collapsed rows (initial, gone, cost, more, role, text): what `more` counts are copies right behind, which have to go."""
    turns = []
    for initial, gone, cost, more, role, text in group:
        if gone:
            turns.append(Turn(initial, True, 0, more + 1))
            continue
        turns.append(Turn(initial, False, cost, 1, role, text))
        if more:
            turns.append(Turn(initial, True, 0, more))
    return turns


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment: least costs between states, and what its initials say."""
    names = [*SEGMENT, *MATRIX, "first", "last", "illegal"]
    types = [pa.bool_(), pa.int64(), pa.int64(), *[pa.int64()] * 16, pa.string(), pa.string(), pa.int64()]
    held = []
    for key, group in groupby(_rows(batches), lambda r: r[:3]):
        turns = _segment_turns((*r[3:], "", "") for r in group)
        columns = [cost_to_go(turns, [0 if q == b else FAR for q in STATES])[0] for b in STATES]
        # a run of one row is illegal within itself: no legal pair has equal initials
        illegal = _illegal(t.initial for t in turns) + sum(t.times - 1 for t in turns)
        held.append((*key, *[columns[b][a] for a in STATES for b in STATES], turns[0].initial, turns[-1].initial, illegal))
        if len(held) >= SHORT:
            yield _batch(held, names, types)
            held = []
    if held:
        yield _batch(held, names, types)


def _backward(segments: pa.Table) -> pa.Table:
    """The segments of one conversation, a row for SHORT of its own -> the cost-to-go behind each of them."""
    rows = sorted(zip(*[segments.column(c).to_pylist() for c in (*SEGMENT, *MATRIX, "first", "last", "illegal")]), key=lambda r: r[2])
    v, out = END, []
    for i in range(len(rows) - 1, -1, -1):
        r, last = rows[i], v
        v = [min(r[3 + 4 * a + b] + last[b] for b in STATES) for a in STATES]
        joint = i + 1 < len(rows) and r[20] + rows[i + 1][19] not in LEGAL
        out.append((*r[:3], *last, i + 1 == len(rows), v[0], r[21] + joint))
    names = [*SEGMENT, *LASTS, "final", "cost", "illegal"]
    return pa.Table.from_batches([_batch(out, names, [pa.bool_(), *[pa.int64()] * 6, pa.bool_(), pa.int64(), pa.int64()])])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment the state in which the walk leaves it, for each in which it may enter."""
    for key, group in groupby(_rows(batches), lambda r: r[:8]):
        turns = _segment_turns((*r[8:], "", "") for r in group)
        values = cost_to_go(turns, list(key[3:7]))
        ends = [walk(turns, values, q, False)[2] if values[0][q] < FAR else q for q in STATES]
        yield _batch([(*key[:3], *ends)], [*SEGMENT, *EXITS], [pa.bool_(), *[pa.int64()] * 6])


def _forward(segments: pa.Table) -> pa.Table:
    rows = sorted(zip(*[segments.column(c).to_pylist() for c in (*SEGMENT, *EXITS)]), key=lambda r: r[2])
    state, out = 0, []
    for r in rows:
        out.append((*r[:3], state))
        state = r[3 + state]
    return pa.Table.from_batches([_batch(out, [*SEGMENT, "entered"], [pa.bool_(), *[pa.int64()] * 3])])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, group in groupby(_rows(batches), lambda r: r[:9]):
        turns = _segment_turns(r[9:] for r in group)
        audit, out, _ = walk(turns, cost_to_go(turns, list(key[3:7])), key[8], key[7])
        yield _batch([(*key[:3], audit, _named(out))], [*SEGMENT, "audit", "turns"], [pa.bool_(), pa.int64(), pa.int64(), pa.string(), TURNS])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order -> audit and digest of each conversation; one fragment's text is held at a time."""
    for key, group in groupby(_rows(batches), lambda r: r[:2]):
        digest, letters, any_before = hashlib.sha256(), [], False
        for _, _, _, audit, text, some in group:
            letters.append(audit)
            if some:
                digest.update((("\n" if any_before else "") + text).encode("utf-8", "surrogatepass"))
                any_before = True
        yield _batch([(*key, "".join(letters), digest.hexdigest())], ["missing", "conv", "audit", "sha"], [pa.bool_(), pa.int64(), pa.string(), pa.string()])


def _joined(turns: Column) -> Column:
    return F.concat_ws("\n", F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])))


def _by_segment(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """The segments' rows in order to run(); only these columns travel."""
    dealt = df.select(*SEGMENT, *columns, "place").repartition(*SEGMENT).sortWithinPartitions(*SEGMENT, "place")
    return dealt.select(*SEGMENT, *columns).mapInArrow(run, schema)


def _long_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of long conversations -> fragments (SEGMENT, audit, turns) and figures of each conversation (missing, conv, ...)."""
    key = ["missing", "conv"]
    marked = rows.where("times > 0").select(F.col("conv_id").isNull().alias("missing"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", "text", "times")
    same = cut(marked.groupBy(*key, "turn", "role", "text").agg(F.sum("times").alias("n")), "collapsed-turns")
    first = same.groupBy(*key, "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn"))["turn"].alias("earliest"))
    same = same.join(first, [*key, "role", "text"])
    is_first = F.col("turn").eqNullSafe(F.col("earliest"))
    same = same.withColumns({"blank": _blank(F.col("text")), "first": is_first}).withColumn("cost", (~F.col("blank") & is_first & ~_ended(F.col("text"))).cast("long"))
    order = [*key, "turn", "role", "text"]
    same = same.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids follow the order, without gaps within a partition, so each segment is a run of at most SHORT rows
    same = same.withColumn("place", F.monotonically_increasing_id()).withColumn("segment", F.expr(f"place div {SHORT}"))
    same = same.withColumns({"initial": F.substring("role", 1, 1), "gone": F.col("blank") | ~F.col("first"), "more": F.col("n") - 1})
    same = cut(same, "ordered-turns")

    turns = same.groupBy(*key, "turn").agg(F.count("*")).groupBy(*key)
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = same.groupBy(*key).agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
        F.sum("cost").alias("truncated"),
    )
    small = ["initial", "gone", "cost", "more"]
    ends = "missing boolean, conv long, segment long"
    matrices = _by_segment(same, small, _matrices, f"{ends}, {', '.join(f'{m} long' for m in MATRIX)}, first string, last string, illegal long")
    lasts = cut(matrices.groupBy(*key).applyInArrow(_backward, f"{ends}, {', '.join(f'{e} long' for e in LASTS)}, final boolean, cost long, illegal long"), "segment-ends")
    known = same.join(lasts.drop("illegal").withColumnRenamed("cost", "whole"), SEGMENT)
    exits = _by_segment(known, [*LASTS, "final", *small], _exits, f"{ends}, {', '.join(f'{x} long' for x in EXITS)}")
    entered = cut(exits.groupBy(*key).applyInArrow(_forward, f"{ends}, entered long"), "segment-entries")
    fragments = _by_segment(known.join(entered, SEGMENT), [*LASTS, "final", "entered", *small, "role", "text"], _fragments, f"{ends}, audit string, turns array<struct<role: string, text: string>>")
    costs = lasts.groupBy(*key).agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "segment").alias("cost"))
    return cut(fragments, "fragments"), gaps.join(counts, key).join(costs, key)


def _by_length(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Ids of conversations of more than SHORT rows, and the condition that joins rows to them."""
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("times", F.lit(1))).alias("n")).where(F.col("n") > SHORT)
    long = cut(sizes.select(F.col("conv_id").alias("long_id")), "long-conversations")
    return long, F.col("conv_id").eqNullSafe(F.col("long_id"))


def _short_parts(rows: DataFrame) -> DataFrame:
    own = rows.withColumns({"blank": _blank(F.col("text")), "ended": _ended(F.col("text"))})
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_short, PARTS)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, audit, turns array<struct<role, text>>): the repaired turns, in the order of segments.

    rows are (conv_id, turn, role, text, times): a row counts `times` times in a row.
    """
    long, same = _by_length(rows)
    short = _short_parts(rows.join(long, same, "left_anti")).select("conv_id", "segment", "audit", "turns")
    if long.isEmpty():
        return short
    fragments, _ = _long_parts(rows.join(long, same, "left_semi"))
    return short.unionAll(fragments.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), "segment", "audit", "turns"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows are (conv_id, turn, role, text, times), without nulls in role and text; a row of times 0 only says that its
    conversation exists. Rows are taken by turn, nulls first; of one turn by role and text, so that repeated rows are adjacent.
    A conversation without rows gets zeros, an empty audit and the digest of nothing. An empty role has no initial and cannot be
    kept. conv_id may be null, which is a conversation of its own.
    """
    long, same = _by_length(rows)
    whole = _short_parts(rows.join(long, same, "left_anti"))
    out = whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(_joined(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    if long.isEmpty():
        return out
    fragments, figures = _long_parts(rows.join(long, same, "left_semi"))
    texts = fragments.select(*SEGMENT, "audit", _joined(F.col("turns")).alias("text"), (F.size("turns") > 0).alias("some"))
    texts = texts.repartition("missing", "conv").sortWithinPartitions(*SEGMENT).mapInArrow(_digests, "missing boolean, conv long, audit string, sha string")
    figures = figures.join(texts, ["missing", "conv"])
    key = (F.col("long_id").isNull() == F.col("missing")) & (F.coalesce("long_id", F.lit(0)) == F.col("conv"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    far = long.join(figures, key, "left").select(
        F.col("long_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
    return out.unionAll(far)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair, a row for each conv_id.

    Null columns read as one space, a null conv_id is a conversation of its own; empty and very long texts, repeated rows and
    ties are as in repair(). An empty table gives no rows; other columns are not read.
    """
    return repair(damaged(table(spark, sf_dir, "conversations")))
