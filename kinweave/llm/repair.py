r"""Repair of conversations: the cheapest edits that give roles the form ``(system? (user assistant)+)?``.

Every row may be kept (0), get another role (1) or be deleted (2), and empty turns may be inserted anywhere (5). Blank
rows and repeats of an earlier row must be deleted; a truncated row that stays adds 5. The edits found are the cheapest, and
of several cheapest lists the one whose initials (D, I, K, R) come first.

The search is Knuth's lightest derivation. An item (i, state) stands for the rows from i on, after what the state has seen; its
axioms are the states after the last row, each edit is a deduction from one item to another, and the goal is the first row in
the start state. A deduction puts its letter in front of the audit of its antecedent, so it is monotone in (cost, audit), and
it is superior in (cost, rows done), as only Keep costs nothing and it does one more row. Items are popped in that order until
the goal is final. Two deductions of one item never have the same letter, so of equal costs the least letter has the least
audit, and an item holds one letter and not its audit.

Long conversations are searched in blocks of rows from the end; the final items where a block begins are the axioms of the one
before. A conversation is sorted in a task that spills to disk: once downwards, where each row gets its choices, and once upwards,
where they are followed; so memory holds a block of rows and an Arrow batch. Texts are shuffled once by conversation, and the order is cut by no
other key, as the result of a conversation is one list.

Decisions: nulls in role and text are one space. Rows go by turn (nulls first), then role, then text; equal rows follow each other,
and all but the first are duplicates. Rows with a null ``conv_id`` are one conversation. Of a role only the first letter counts for
the form, so a role that begins with none of s, u and a (and a system row that is not first) must change or go. Blanks are the
space and the characters 9 to 13. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, release_memory, shuffle_partitions

BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: What the edits cost.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: Rows searched at once.
BLOCK_ROWS = 1024

# states: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a role's initial in each state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that may be inserted, or given to a row, in each state.
WANTED = ("user", "user", "assistant", "user")
#: Cost and letter of the end in each state: missing turns are inserted.
AT_END = {START: (0, ""), SYSTEM: (2 * INSERT, "I"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

Value = tuple[int, str]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` (nulls: one space) modulo 20 selects.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    made = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
    return made.select("conv_id", "turn", "role", "text")


def _with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, nth (of equal rows) and fault (null if none); all rows of a conversation in one task."""
    space = F.lit(" ")
    own = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    dealt = own.repartition(shuffle_partitions(turns.sparkSession), "conv_id")
    # the same distribution serves this window: its key begins with the conversation
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(F.length(bare) == 0, BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED)
    )
    return dealt.withColumn("nth", nth).withColumn("fault", fault)


def lightest(rows: list[tuple[str, str | None]], after: dict[int, Value], goals: set[int]) -> tuple[dict, list[str]]:
    """Lightest derivations over ``rows`` (role's initial, fault), given the final items behind them.

    Returns the (cost, letter) of the goal states before the first row, and for each row a string of four
    letters, the edit in each state (a blank where the search ended without needing it).
    """
    n = len(rows)
    final: list[dict[int, Value]] = [{} for _ in range(n + 1)]
    best: list[dict[int, Value]] = [{} for _ in range(n + 1)]
    agenda: list[tuple[int, int, str, int]] = []

    def propose(i: int, state: int, value: Value) -> None:
        if state not in final[i] and (state not in best[i] or value < best[i][state]):
            best[i][state] = value
            heapq.heappush(agenda, (value[0], n - i, value[1], state))

    for state, value in after.items():
        propose(n, state, value)
    wanted = set(goals)
    while wanted and agenda:
        cost, done, letter, state = heapq.heappop(agenda)
        i = n - done
        if state in final[i] or best[i][state] != (cost, letter):
            continue
        final[i][state] = (cost, letter)
        if i == 0:
            wanted.discard(state)
        # an insertion before row i, from each state that the inserted turn leads here
        if i < n:
            for before in STATES:
                if NEXT[before][WANTED[before][0]] == state:
                    propose(i, before, (cost + INSERT, "I"))
        if i == 0:
            continue
        initial, fault = rows[i - 1]
        propose(i - 1, state, (cost + DELETE, "D"))
        if fault in (BLANK, DUPLICATE):
            continue
        more = STAYS_TRUNCATED if fault == TRUNCATED else 0
        for before in STATES:
            if NEXT[before].get(initial) == state:
                propose(i - 1, before, (cost + more, "K"))
            if NEXT[before][WANTED[before][0]] == state:
                propose(i - 1, before, (cost + more + REROLE, "R"))
    choices = ["".join(f[s][1] if s in f else " " for s in STATES) for f in final[:n]]
    return final[0], choices


def _choose(batches: Iterator[pa.RecordBatch], fields: pa.Schema, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Adds its four choices to each row; rows come by conversation from the last to the first."""
    waiting: list[pa.RecordBatch] = []  # batches whose rows do not all have their choices yet
    choices: list[str] = []
    block: list[tuple[str, str | None]] = []
    after, conv, begun = dict(AT_END), None, False

    def close(goals: set[int]) -> None:
        nonlocal after, block
        after, found = lightest(block[::-1], after, goals)
        choices.extend(found[::-1])
        block = []

    def ready() -> Iterator[pa.RecordBatch]:
        nonlocal choices
        while waiting and len(choices) >= waiting[0].num_rows:
            whole = waiting.pop(0)
            made = pa.array(choices[: whole.num_rows], type=pa.string())
            choices = choices[whole.num_rows :]
            yield pa.RecordBatch.from_arrays([*whole.columns, made], schema=fields)

    for batch in batches:
        for own, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "fault")), strict=True):
            if begun and own != conv:
                close({START})
                after = dict(AT_END)
            elif len(block) >= block_rows:
                close(set(STATES))
            conv, begun = own, True
            block.append((role[:1], fault))
        waiting.append(batch)
        yield from ready()
    if block:
        close({START})
    yield from ready()
    release_memory()


def _follow(batches: Iterator[pa.RecordBatch], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation in order; its rows come from the first to the last with their choices."""
    names = fields.names
    conv, begun, state, step = None, False, START, 0
    out: dict[str, list] = {c: [] for c in names}

    def put(*values) -> None:
        nonlocal step
        for c, v in zip(names, (conv, step, *values), strict=True):
            out[c].append(v)
        step += 1

    def insert() -> None:
        nonlocal state
        role = WANTED[state]
        put("I", role, "", None, None, None, INSERT)
        state = NEXT[state][role[0]]

    for batch in batches:
        for own, turn, role, text, fault, choice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and own != conv:
                while AT_END[state][1]:
                    insert()
            if not begun or own != conv:
                conv, begun, state, step = own, True, START, 0
            while choice[state] == "I":
                insert()
            edit = choice[state]
            if edit == "D":
                put("D", role, text, role, turn, fault, DELETE)
                continue
            new = role if edit == "K" else WANTED[state]
            cost = (REROLE if edit == "R" else 0) + (STAYS_TRUNCATED if fault == TRUNCATED else 0)
            put(edit, new, text, role, turn, fault, cost)
            state = NEXT[state][new[0]]
        if out[names[0]]:
            yield as_batch(out, fields)
            out = {c: [] for c in names}
    if begun:
        while AT_END[state][1]:
            insert()
        if out[names[0]]:
            yield as_batch(out, fields)
    release_memory()


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The edits of every conversation of ``turns`` (conv_id, turn, role, text), one row an edit.

    conv_id, step (from 0), edit (D, I, K or R), role and text after it, was (role before; null if inserted), turn, fault
    and cost. The repaired conversation is the rows that are not D, by step.
    """
    dealt = _with_faults(turns).select("conv_id", "turn", "role", "text", "fault", "nth")
    down = dealt.sortWithinPartitions(
        F.desc("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")
    )
    schema = "conv_id long, turn long, role string, text string, fault string, nth int"
    chosen_schema = schema + ", choice string"
    chosen_fields = arrow_schema(chosen_schema)
    typed = down.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "nth")
    chosen = typed.mapInArrow(lambda batches: _choose(batches, chosen_fields, block_rows), chosen_schema)
    up = chosen.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")
    steps = (
        "conv_id long, step long, edit string, role string, text string, was string, turn long, fault string, cost long"
    )
    fields = arrow_schema(steps)
    return up.drop("nth").mapInArrow(lambda batches: _follow(batches, fields), steps)


def report(steps: DataFrame) -> DataFrame:
    """One row a conversation from the edits of :func:`repair`: gaps, faults, illegal neighbours, cost, audit and digest.

    A conversation is read as a sorted stream; memory holds its audit.
    """
    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"
    )
    fields = arrow_schema(schema)
    n = shuffle_partitions(steps.sparkSession)
    dealt = steps.repartition(n, "conv_id").sortWithinPartitions("conv_id", "step")
    columns = ("conv_id", "edit", "role", "text", "was", "turn", "fault", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for own, *step in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None or now.conv != own:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(own)
                now.add(*step)
            if out:
                yield as_batch(dict(zip(fields.names, map(list, zip(*out, strict=True)), strict=True)), fields)
        if now is not None:
            yield as_batch({c: [v] for c, v in zip(fields.names, now.row(), strict=True)}, fields)
        release_memory()

    return dealt.select("step", *columns).mapInArrow(run, schema)


class _Conversation:
    """What is reported of a conversation, step by step."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.turns = [None, None, 0]  # least, greatest, how many different
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit = bytearray()
        self.digest = hashlib.sha256()
        self.kept = False

    def add(self, edit, role, text, was, turn, fault, cost) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if edit != "D":
            self.digest.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode("utf-8", "replace"))
            self.kept = True
        if edit == "I":
            return
        if turn is not None and turn != self.turns[1]:  # turns rise
            self.turns = [turn if self.turns[2] == 0 else self.turns[0], turn, self.turns[2] + 1]
        if fault is not None:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + was[:1] not in ("su", "ua", "au")
        self.before = was[:1]

    def row(self) -> tuple:
        least, most, different = self.turns
        gaps = most - least + 1 - different if different else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def of_all(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of :func:`report` for every conversation of a table; zeros where no row was left."""
    ids = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = ids.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("_conv").cast("long").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
