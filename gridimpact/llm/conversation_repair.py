"""Repair of the structure of conversations at the least cost, by a recursive query over all conversations of a batch.

The roles of a conversation are to follow a grammar: nothing, or an optional system turn and then one or more pairs of user and assistant.
Edits: Keep a turn (0), Rerole it to user or assistant (3), Delete it (4), Insert an empty user or assistant turn anywhere (3). Blank turns and
turns that repeat an earlier one must go; a truncated turn that stays costs 3 more. Of the cheapest edits, those count whose
initials in order are the least in ASCII.

Spark puts the turns in order over ranges of conversation and turn, and tasks cut them into segments of at most `SEGMENT` turns: two letters for each
turn, no text. Segments are dealt by hash, and DuckDB runs one recursive query for each batch of them: a step advances all segments by one turn and
keeps, for each state of the grammar, the least cost and its audit. A conversation that is one segment is done then. One that is
longer, or cut by a range's border, gets answers for every state it could be entered in, and a pass over its segments from the last to the
first joins them. At last texts meet the edits of their conversation, in order, and are hashed as they come. So texts move once, and a
conversation of any length takes only its audit (one letter a turn, four while its segments are joined) from a task's memory; only that last pass,
whose result is one digest of the whole, takes a conversation in one task.

Turns of one number are in the order of role and a hash of the text. A role that begins with none of the letters s, u, a can't be kept.

Defined results: a null role or text is one space, so such a text is blank; null turn numbers come first and count for no gap;
a null identifier is a conversation like any other; repeated rows are turns that repeat; a conversation of which no turn is present has zeros, an
empty audit and the hash of the empty text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import written

#: Turns of a segment, and turns that one recursive query takes.
SEGMENT, BATCH = 256, 20_000
#: Costs of edits, and of keeping a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State of the grammar (0 begin, 1 after system, 2 after user, 3 after assistant) and role to the next state.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What brings a conversation to an end from each state.
ENDS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: One letter for a turn's role and what is wrong with it (k nothing, t truncated, d must go).
KINDS = {(role, fault): chr(65 + 3 * i + j) for i, role in enumerate("suax") for j, fault in enumerate("ktd")}

SQL = """
    WITH RECURSIVE best(id, entry, state, turn, cost, audit) USING KEY (id, entry, state) AS (
        SELECT id, entry, entry, 0, 0, '' FROM entries
        UNION
        SELECT id, entry, state, turn, least.cost, least.audit FROM (
            SELECT best.id, best.entry, steps.after AS state, best.turn + 1 AS turn, min({'cost': best.cost + steps.cost, 'audit': best.audit || steps.edits}) AS least
            FROM best JOIN segments ON segments.id = best.id
                      JOIN steps ON steps.before = best.state AND steps.kind = substr(segments.kinds, best.turn + 1, 1)
            WHERE best.turn < length(segments.kinds)
            GROUP BY best.id, best.entry, steps.after, best.turn
        )
    )
    SELECT best.id, entry, state, cost, audit FROM best JOIN segments ON segments.id = best.id WHERE turn = length(kinds)
"""


def steps() -> pa.Table:
    """What a turn of each kind can do in each state: up to two insertions, then one edit of the turn."""
    forced = lambda state: next((r, MOVES[state, r]) for r in "ua" if (state, r) in MOVES)  # noqa: E731  the only user or assistant turn that can follow
    rows = []
    for (role, fault), kind in KINDS.items():
        for before in range(4):
            state, paid, edits = before, 0, ""
            for _ in range(3):
                rows.append((kind, before, state, paid + DELETE, edits + "D"))
                if fault != "d":
                    more = TRUNCATED * (fault == "t")
                    rows.append((kind, before, forced(state)[1], paid + REROLE + more, edits + "R"))
                    if (state, role) in MOVES:
                        rows.append((kind, before, MOVES[state, role], paid + more, edits + "K"))
                state, paid, edits = forced(state)[1], paid + INSERT, edits + "I"
    return pa.table(dict(zip(("kind", "before", "after", "cost", "edits"), map(list, zip(*rows, strict=True)), strict=True)))


def cheapest(connection, kinds: list[str], entries: list[tuple[int, int]]) -> dict[int, dict[int, dict[int, tuple[int, str]]]]:
    """For each segment (by its number) and state it is entered in: the state behind it, with cost and audit."""
    connection.register("segments", pa.table({"id": pa.array(range(len(kinds)), pa.int32()), "kinds": pa.array(kinds, pa.string())}))
    connection.register("entries", pa.table({"id": pa.array([i for i, _ in entries], pa.int32()), "entry": pa.array([e for _, e in entries], pa.int32())}))
    out: dict = defaultdict(lambda: defaultdict(dict))
    for i, entry, state, cost, audit in connection.execute(SQL).fetchall():
        out[i][entry][state] = (cost, audit)
    return out


def _ended(states: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min((cost + ENDS[s][0], audit + ENDS[s][1]) for s, (cost, audit) in states.items())


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))


def in_order(turns: DataFrame) -> DataFrame:
    """conv, turn, initial and fault (b blank, d repeats an earlier turn, t truncated, k none) of each turn, in order over ranges."""
    light = turns.select(
        "conv", "turn", "role", initial(F.col("role")).alias("initial"), F.md5("text").alias("digest"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "k").otherwise("t").alias("fault"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"), F.col("row"))
    groups = light.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")  # only those that occur twice
    same = light.conv.eqNullSafe(groups.c) & (light.role == groups.r) & (light.digest == groups.d)
    again = F.coalesce(F.col("row") != F.col("first.row"), F.lit(False))
    marked = light.join(groups, same, "left").withColumn("fault", F.when((F.col("fault") != "b") & again, "d").otherwise(F.col("fault")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "row"]
    return marked.select("conv", "turn", "role", "hash", "row", "initial", "fault").repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "initial", "fault")


def segments(ordered: DataFrame, size: int) -> DataFrame:
    """part and at (its place), conv, initials, faults, turn numbers (first, last, how many) and whether it may be one of several of its conversation."""
    kind = ordered.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, rows, conv, held, cut, start = TaskContext.get().partitionId(), 0, [], None, [], False, True

        def close(edge: bool) -> None:
            nonlocal at, held
            known = [t for t, _, _ in held if t is not None]
            rows.append((part, at, conv, "".join(i for _, i, _ in held), "".join(f for _, _, f in held), known[0] if known else None, known[-1] if known else None, len(set(known)), edge))
            at, held = at + 1, []

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        names = ["part", "at", "conv", "initials", "faults", "low", "high", "n_turns", "edge"]
        for batch in batches:
            types = [pa.int32(), pa.int32(), batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            for c, *turn in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and c != conv:
                    close(start or cut)
                    cut, start = False, False
                elif len(held) >= size:
                    close(True)
                    cut = True
                conv = c
                held.append(turn)
            if rows:
                yield table()
        if held:
            close(True)
            yield table()

    return ordered.mapInArrow(run, f"part int, at int, conv {kind}, initials string, faults string, low long, high long, n_turns long, edge boolean")


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else high - low + 1 - n


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edits(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv and FOUND for every conversation with a turn."""
    kind = turns.schema["conv"].dataType.simpleString()
    dealt = written(segments(in_order(turns), size), "segments").repartition("part", "at")
    answer = "array<struct<entry:int,state:int,cost:long,audit:string>>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(config={"threads": 1})
        connection.register("steps", steps())
        for whole in batches:
            ends = whole.column("initials").to_pylist()
            begin = total = 0
            for k, x in enumerate(ends):
                total += len(x) * (4 if whole.column("edge")[k].as_py() else 1)
                if total < BATCH and k + 1 < len(ends):
                    continue
                batch = whole.slice(begin, k + 1 - begin)
                begin, total = k + 1, 0
                initials, faults, edge = (batch.column(c).to_pylist() for c in ("initials", "faults", "edge"))
                kinds = ["".join(KINDS[i, f if f in "kt" else "d"] for i, f in zip(a, b, strict=True)) for a, b in zip(initials, faults, strict=True)]
                found = cheapest(connection, kinds, [(i, e) for i, own in enumerate(edge) for e in (range(4) if own else (0,))])
                answers = [
                    [{"entry": e, "state": s, "cost": c, "audit": a} for e, states in found[i].items() for s, (c, a) in (states.items() if own else [(3, _ended(states))])]
                    for i, own in enumerate(edge)
                ]
                shape = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, shape)], [*batch.schema.names, "answers"])

    schema = f"part int, at int, conv {kind}, initials string, faults string, low long, high long, n_turns long, edge boolean, answers {answer}"
    solved = written(dealt.mapInArrow(solve, schema), "edits")
    count = lambda letter: (F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))).cast("long")
    pairs = F.sequence(F.lit(1), F.length("initials") - 1)
    illegal = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda i: ~F.substr("initials", i, F.lit(2)).isin(*LEGAL)))).otherwise(0)
    one = F.get("answers", F.lit(0))
    alone = solved.where("NOT edge").select(
        "conv", F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("n_turns")).cast("long").alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"),
        count("t").alias("truncated"), illegal.cast("long").alias("illegal"), one["cost"].alias("cost"), one["audit"].alias("audit"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of a conversation from the last to the first."""
        conv, numbers, tail, later = None, [0] * 6, {}, []  # later: what each segment does for each entry, the last first
        rest: tuple[str, int | None] = ("", None)  # the first role and turn number behind
        kind = None

        def row() -> pa.RecordBatch:
            state, audit = 0, []
            for choice in reversed(later):
                text, state = choice[state]
                audit.append(text)
            audit.append(ENDS[state][1])
            gaps = 0 if numbers[5] is None else numbers[5] + 1 - numbers[0]
            values = [gaps, *numbers[1:5], tail[0], "".join(audit)]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), *(pa.array([v], t) for v, t in zip(values, [pa.int64()] * 6 + [pa.string()], strict=True))], out_names)

        out_names = ["conv", *(x.split()[0] for x in FOUND.split(", "))]
        span: list = [None, None]
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, initials, faults, low, high, n, options in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if later and c != conv:
                    yield row()
                    later = []
                if not later:
                    conv, numbers, tail, rest, span = c, [0] * 6, {s: cost for s, (cost, _) in ENDS.items()}, ("", None), [None, None]
                best: dict[int, tuple] = {}
                for o in options:
                    mine = (o["cost"] + tail[o["state"]], o["audit"], o["state"])
                    if o["entry"] not in best or mine < best[o["entry"]]:
                        best[o["entry"]] = mine
                tail = {e: m[0] for e, m in best.items()}
                later.append({e: m[1:] for e, m in best.items()})
                for k, letter in enumerate("bdt"):
                    numbers[1 + k] += faults.count(letter)
                numbers[4] += _illegal(initials + rest[0])
                if low is not None:
                    numbers[0] += n - (high == rest[1])
                    span = [low, high if span[1] is None else span[1]]
                    rest = (initials[0], low)
                else:
                    rest = (initials[0], rest[1])
                numbers[5] = None if span[0] is None else span[1] - span[0]
        if later:
            yield row()

    cut = solved.where("edge").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("at"))
    joined = cut.select("conv", "initials", "faults", "low", "high", "n_turns", "answers").mapInArrow(join, f"conv {kind}, {FOUND}")
    return alone.unionByName(joined)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, size: int = SEGMENT) -> DataFrame:
    """For every conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of role:text, one turn a line).

    present_col, if given, says which rows are turns; the others only name their conversation.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
        (F.coalesce(present_col, F.lit(False)) if present_col else F.lit(True)).alias("present"),
    )
    id_type = rows.schema["conv"].dataType.simpleString()
    found = edits(rows.where("present"), size)
    names = [x.split()[0] for x in FOUND.split(", ")]
    nothing = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in FOUND.split(", ")]
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", "hash"]
    texts = rows.select("conv", F.when(F.col("present"), 1).otherwise(2).alias("kind"), "turn", "role", F.xxhash64("text").alias("hash"), F.when(F.col("present"), F.col("text")).alias("text"), *nothing)
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("hash", "long"), ("text", "string"))]
    both = texts.unionByName(found.select("conv", F.lit(0).alias("kind"), *blank, *names)).repartition("conv").sortWithinPartitions(*order)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edits of a conversation come first, then its turns."""
        conv, given, at, state, digest, first, open_ = None, None, 0, 0, None, True, False
        rows: list[tuple] = []

        def line(role: str, text: str) -> None:
            nonlocal first, state
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
            state = MOVES[state, role[0]]

        def inserted() -> None:
            nonlocal at
            while at < len(given[-1]) and given[-1][at] == "I":
                line(NAMES["a" if state == 2 else "u"], "")
                at += 1

        def close() -> None:
            inserted()
            rows.append((conv, *given, digest.hexdigest()))

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for c, kind, role, text, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not open_ or c != conv:
                    if open_:
                        close()
                    conv, at, state, digest, first, open_ = c, 0, 0, hashlib.sha256(), True, True
                    given = values if kind == 0 else [0] * 6 + [""]
                if kind == 1:
                    inserted()
                    edit = given[-1][at]
                    at += 1
                    if edit != "D":
                        line(role if edit == "K" else NAMES["a" if state == 2 else "u"], text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], out_names)
                rows.clear()
        if open_:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], out_names)

    out_names = ["conv", *names, "repaired_sha256"]
    done = both.select("conv", "kind", "role", "text", *names).mapInArrow(finish, f"conv {id_type}, {FOUND}, repaired_sha256 string")
    return done.withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present of the turns after the query's damage, chosen by the crc32 of conversation and turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"))
