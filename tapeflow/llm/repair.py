"""Repair of turn order as a lightest derivation.

Items (i, state) say: the first i rows are edited and leave the role machine in ``state``.
Deductions have two premises, an item and the edits of row i (or of a block of rows), and one
conclusion; an insertion has one premise. Values are (cost, audit), where the audit is the edits'
initials. Every deduction adds to the cost and lengthens the audit, so its value is above its
premises', and of two audits for one item neither begins with the other at an equal cost, so
what is lesser stays lesser. An agenda pops the least value first and each item is final when
it is popped (Knuth's rule for superior functions), up to the goal.

Rows are reduced to one letter each and derived in blocks of bounded size, from every state to
every state; the blocks' results are edits of a whole block and are derived again, sixteen at a
time. So a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.plans.tables import keep

#: Characters `[\x20\x09-\x0D]`.
_BLANKS = " \t\n\x0b\x0c\r"
#: Rows in a block: 2 to the power.
BLOCK_BITS = 8
FAN_IN = 16
#: monotonically_increasing_id counts rows in these bits and partitions above them.
ROW_BITS = 33

START, ASKED, USER, PAIR = range(4)
#: Role initials the machine takes in each state; the pattern is (s?(ua)+)?.
STEPS = {START: {"s": ASKED, "u": USER}, ASKED: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
#: The step of each state that an inserted or renamed row makes, and that row's role.
NEXT = {q: next((r, c) for c, r in s.items() if c != "s") for q, s in STEPS.items()}
ROLES = {"u": "user", "a": "assistant"}
GOALS = (START, PAIR)
KEEP, RENAME, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5


@functools.lru_cache(maxsize=16)
def row_edits(letter: str) -> dict[int, list[tuple[int, str, int]]]:
    """Edits of a row: state -> (cost, audit, next state).

    The letter is the role's initial (``o`` for any but s, u, a), upper case where the text is cut short; ``x``
    must be deleted.
    """
    out = {}
    for q in STEPS:
        edits = out[q] = [(DELETE, "D", q)]
        if letter != "x":
            more = CUT_SHORT * letter.isupper()
            if letter.lower() in STEPS[q]:
                edits.append((KEEP + more, "K", STEPS[q][letter.lower()]))
            edits.append((RENAME + more, "R", NEXT[q][0]))
    return out


def lightest(steps, start: int, goals=()) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of each end state, or of the first of ``goals`` to become final.

    ``steps``: for each row or block a map from state to (cost, audit, next state).
    """
    agenda, final, out, n = [(0, "", 0, start)], set(), {}, len(steps)
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            out[q] = cost, audit
            if q in goals:
                return {q: out[q]}
        else:
            for more, edit, r in steps[i].get(q, ()):
                if (i + 1, r) not in final:
                    heapq.heappush(agenda, (cost + more, audit + edit, i + 1, r))
        r = NEXT[q][0]
        if (i, r) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, r))
    return out


def goal_of(steps) -> tuple[int, str]:
    return next(iter(lightest(steps, START, GOALS).values()))


def spans_of(steps) -> list[dict]:
    """Best edits of all the steps together, from each state to each state that can be reached."""
    return [{"q": q, "r": r, "cost": c, "audit": a} for q in STEPS for r, (c, a) in lightest(steps, q).items()]


def step_of(spans) -> dict[int, list[tuple[int, str, int]]]:
    out = {}
    for s in spans:
        out.setdefault(s["q"], []).append((s["cost"], s["audit"], s["r"]))
    return out


def _blank(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS)) == ""


def _cut_short(text: Column) -> Column:
    return ~F.substring(F.rtrim(text, F.lit(_BLANKS)), -1, 1).isin(".", "!", "?")


def number_faults(conversations: DataFrame) -> DataFrame:
    """Rows in order with their first fault: conv_id, pos, turn, role, text, fault, letter.

    ``pos`` grows by turn within a conversation. A repeated (role, text) is found by a
    pre-aggregated minimum of the turn, not by a window over a conversation.
    """
    rows = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    )
    # The least struct holds the earliest turn, a missing one first.
    first = rows.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(*(F.col(c).alias(f"f_{c}") for c in first.columns))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id")) & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text"))
    rows = rows.join(first, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    again = (F.col("copy") > 1) | ~F.col("turn").eqNullSafe(F.col("f_first.turn"))
    fault = (F.when(_blank(F.col("text")), "blank").when(again, "duplicate")
             .when(_cut_short(F.col("text")), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    order = ["conv_id", "turn", "role", "text", "copy"]
    return keep(
        rows.withColumn("fault", fault)
        .withColumn("letter", F.when(F.col("fault").isin("blank", "duplicate"), "x")
                    .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter))
        .select(*order, "fault", "letter").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("pos", F.monotonically_increasing_id()).drop("copy")
    )


_SPANS = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SPANS_SQL = "array<struct<q:int,r:int,cost:bigint,audit:string>>"


def _derive_rows(batches):
    """conv_id, block, letters to spans. Conversations are short and much alike: letters repeat."""
    spans = functools.lru_cache(maxsize=20_000)(lambda letters: spans_of([row_edits(c) for c in letters]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([spans(t) for t in batch.column(2).to_pylist()], _SPANS)],
            names=["conv_id", "block", "spans"])


def _derive_goals(batches):
    goal = functools.lru_cache(maxsize=50_000)(lambda letters: goal_of([row_edits(c) for c in letters]))
    for batch in batches:
        best = [goal(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.int64()),
                                          pa.array([b[1] for b in best], pa.string())], names=["conv_id", "cost", "audit"])


def _derive_blocks(batches):
    """conv_id, block, array of spans to spans of all of them together."""
    for batch in batches:
        out = [spans_of([step_of(s) for s in group]) for group in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], names=["conv_id", "block", "spans"])


def _goal_of_block(batches):
    for batch in batches:
        best = [goal_of([step_of(s)]) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0] for b in best], pa.int64()),
                                          pa.array([b[1] for b in best], pa.string())], names=["conv_id", "cost", "audit"])


def best_edits(numbered: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, cost, audit) of the lightest derivation of each conversation of ``number_faults``."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    blocks = keep(
        numbered.withColumn("block", F.shiftright("pos", block_bits)).groupBy("conv_id", "block")
        .agg(F.array_join(F.transform(in_order, lambda x: x["letter"]), "").alias("letters"))
    )
    counted = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("letters").alias("letters"))
    short = counted.where("n = 1").select("conv_id", "letters").mapInArrow(_derive_goals, "conv_id long, cost long, audit string")
    # Conversations over several blocks: the blocks of all partitions are numbered through, then meet sixteen at a time.
    long = counted.where("n > 1").select(F.col("conv_id").alias("l_conv_id"))
    own = blocks.join(long, F.col("conv_id").eqNullSafe(F.col("l_conv_id"))).drop("l_conv_id")
    bits = ROW_BITS - block_bits
    in_part = F.col("block").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    most = 1 + (blocks.agg(F.max(in_part)).first()[0] or 0)
    own = own.withColumn("block", F.shiftright("block", bits) * F.lit(most) + in_part)
    spans = keep(own.mapInArrow(_derive_rows, f"conv_id long, block long, spans {_SPANS_SQL}"))
    while spans.groupBy("conv_id").count().where("count > 1").head(1):
        groups = spans.groupBy("conv_id", F.expr(f"block div {FAN_IN}").alias("group")).agg(
            F.array_sort(F.collect_list(F.struct("block", "spans"))).alias("parts"))
        groups = groups.select("conv_id", F.col("group").alias("block"), F.transform("parts", lambda p: p["spans"]).alias("parts"))
        spans = keep(groups.mapInArrow(_derive_blocks, f"conv_id long, block long, spans {_SPANS_SQL}"))
    return short.union(spans.select("conv_id", "spans").mapInArrow(_goal_of_block, "conv_id long, cost long, audit string"))


_ROWS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                   ("text", pa.string()), ("was", pa.string()), ("fault", pa.string())])


def _apply(batches):
    """The audit of a conversation comes first (pos -1), then its rows; one row is held at a time."""
    conv, audit, at, q, seq, open_ = None, "", 0, START, 0, False

    for batch in batches:
        out = []

        def put(turn, edit, role, text, was, fault):
            nonlocal seq
            out.append((conv, seq, turn, edit, role, text, was, fault))
            seq += 1

        def insertions():
            nonlocal at, q
            while at < len(audit) and audit[at] == "I":
                q, c = NEXT[q]
                put(None, "I", ROLES[c], "", None, None)
                at += 1

        for own, pos, edits, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:
                conv, audit, at, q, seq, open_ = own, edits or "", 0, START, 0, edits is not None
                if not open_:
                    put(None, "", None, None, None, None)
                insertions()
                continue
            edit, new = audit[at], role
            at += 1
            if edit == "K":
                q = STEPS[q][role[0]]
            elif edit == "R":
                q, c = NEXT[q]
                new = ROLES[c]
            put(turn, edit, new, text, role, fault)
            insertions()
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True) if out else [()] * len(_ROWS), _ROWS, strict=True)], schema=_ROWS)


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Rows of every conversation after its cheapest edits, in order within partitions.

    conv_id, seq, turn, edit (K kept, R renamed to user or assistant, D deleted, I inserted), role and text
    after the edit, was (the role before), fault (blank, duplicate, truncated, or null). The kept, renamed and
    inserted rows have the role initials ``(s?(ua)+)?``; of equally cheap edits those with the
    least initials win. Rows go by turn, a missing turn first, equal turns by role and text; null role and text
    count as one space; each repeated row is a row; a null conv_id is a conversation of its own; extra columns
    are ignored. An empty table gives no row.
    """
    numbered = number_faults(conversations)
    edits = best_edits(numbered, block_bits)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))]
    heads = edits.select("conv_id", F.lit(-1).cast("long").alias("pos"), "audit", *empty)
    rows = numbered.select("conv_id", "pos", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "fault")
    ordered = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(_apply, "conv_id long, seq long, turn long, edit string, role string, text string, was string, fault string")


_SUMS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])
_PRICE = {"K": KEEP, "R": RENAME, "D": DELETE, "I": INSERT}
_LEGAL = {"su", "ua", "au"}


def _summarise(batches):
    now = None

    def row():
        faults = now["faults"]
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
        return (now["conv"], gaps, faults["blank"], faults["duplicate"], faults["truncated"], now["illegal"], now["cost"],
                "".join(now["audit"]), now["digest"].hexdigest())

    for batch in batches:
        done = []
        for conv, _, turn, edit, role, text, was, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv != now["conv"]:
                if now is not None:
                    done.append(row())
                now = {"conv": conv, "first": None, "last": None, "turns": 0, "faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0),
                       "illegal": 0, "cost": 0, "audit": [], "digest": hashlib.sha256(), "was": None, "out": 0}
            now["cost"] += _PRICE[edit] + (CUT_SHORT if fault == "truncated" and edit != "D" else 0)
            now["audit"].append(edit)
            if was is not None:
                if turn is not None and turn != now["last"]:
                    now["first"], now["last"], now["turns"] = turn if now["first"] is None else now["first"], turn, now["turns"] + 1
                if fault:
                    now["faults"][fault] += 1
                if now["was"] is not None and now["was"] + was[:1] not in _LEGAL:
                    now["illegal"] += 1
                now["was"] = was[:1]
            if edit in "KRI":
                now["digest"].update(("\n" * (now["out"] > 0) + f"{role}:{text}").encode())
                now["out"] += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), _SUMS, strict=True)], schema=_SUMS)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), _SUMS, strict=True)], schema=_SUMS)


def summary(repaired: DataFrame, original: DataFrame) -> DataFrame:
    """One row per conversation of ``original``: faults before the repair, its cost and audit, a digest.

    conv_id, gaps (missing numbers between the first and the last turn), blank, duplicate, truncated, illegal
    (neighbouring role initials other than su, ua, au), cost, audit (the edits' initials), repaired_sha256 (rows
    ``role:text`` joined by line feeds). Reads ``repair``'s rows as they are partitioned, one at a time; a
    conversation of which no row is left has zeros, an empty audit and the digest of an empty text.
    """
    found = repaired.mapInArrow(_summarise, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                                            "cost long, audit string, repaired_sha256 string")
    found = found.withColumnRenamed("conv_id", "f_conv_id")
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    rest = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("f_conv_id")), "left").drop("f_conv_id").withColumns(zero | rest)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by crc32(``conv_id:turn``) % 20 (nulls count as one space).

    0 drops the row, 1 empties its text, 2 removes its `[.!?]`, 3 repeats the row, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"),
        part("text").alias("text"), F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20)).alias("way"))
    return rows.where("way <> 0").select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")
