"""Repair of conversation structure by depth-first branch and bound over cheapest edits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketweek.llm.storage import ship, staged

#: White space of words and turns.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States between edits: nothing kept yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: State after a role's initial, where the pattern allows it.
NEXT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
#: The role that an inserted or renamed turn takes in each state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: Cost of the insertions that end a conversation in each state: it ends before any turn or after assistant.
CLOSING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Turns and characters of a segment; longer conversations are solved in segments.
SEGMENT, CHARACTERS = 4096, 1 << 26
#: Characters of a text that place a row among the tasks.
PREFIX = 64
OK, CUT, LOST = range(3)


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copies)``: the rows after damage, equal rows as one.

    ``crc32(conv_id:turn) % 20`` of a row: 0 drops it, 1 empties its text, 2 removes ``.!?``,
    3 repeats it, 4 makes its role user. Nulls stand as one space, but for the order of turns. A
    dropped row stays with no copies, so that its conversation is not lost.
    """
    name = F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    rows = df.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("harm"),
    )
    gone = F.col("harm") == 0
    rows = rows.select(
        "conv", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("harm") == 1), "")
        .when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def ordered(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows with ``chunk`` and ``seen``, whether an earlier turn has the same role and text.

    Only keys that occur in several turns are joined back. Many copies of a row become chunks
    of bounded size, all but the first ``seen``.
    """
    rows = rows.withColumn("digest", F.md5("text"))
    twice = (
        rows.where("copies > 0").groupBy("conv", "role", "digest")
        .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("unplaced"))
        .where((F.col("low") < F.col("high")) | (F.col("unplaced") & F.col("low").isNotNull()))
        .toDF("c", "r", "d", "low", "high", "unplaced")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("low")))
    chunks = F.greatest(F.lit(0), F.ceil(F.col("copies") / segment).cast("int") - 1)
    return (
        rows.join(twice, same, "left")
        .select(
            "conv", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("later"),
            F.explode(F.sequence(F.lit(0), chunks)).alias("chunk"),
        )
        .select(
            "conv", "turn", "role", "text", "chunk",
            F.least(F.lit(segment), F.col("copies") - F.col("chunk") * segment).alias("copies"),
            (F.col("later") | (F.col("chunk") > 0)).alias("seen"),
        )
    )


def fault_of(text: str, seen: bool) -> tuple[str, int]:
    """Name and effect of a turn's first fault."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank", LOST
    if seen:
        return "duplicate", LOST
    return ("", OK) if bare[-1] in ".!?" else ("truncated", CUT)


def suffix_bounds(turns: list[tuple[str, int]], closing: tuple) -> list[list[int]]:
    """Least cost, whatever the letters, of the edits from each turn and state to the end."""
    bounds = [list(closing)]
    for initial, fault in reversed(turns):
        rest, kept = bounds[-1], NEXT.get(initial)
        extra = TRUNCATED if fault == CUT else 0
        here = [DELETE + r for r in rest]
        if fault != LOST:
            for s in STATES:
                here[s] = min(here[s], REROLE + extra + rest[AFTER[s]])
                if kept and kept[s] is not None:
                    here[s] = min(here[s], KEEP + extra + rest[kept[s]])
        # One or two insertions before the turn; a third would come back to a state at a cost.
        once = [min(here[s], INSERT + here[AFTER[s]]) for s in STATES]
        bounds.append([min(here[s], INSERT + once[AFTER[s]]) for s in STATES])
    bounds.reverse()
    return bounds


def cheapest(turns: list[tuple[str, int]], start: int, bounds: list[list[int]]) -> tuple[int, str] | None:
    """``(cost, audit)`` of the cheapest edits, the ASCII-least of equal cost; None if there are none.

    Depth first with an explicit stack, branches in the order of their letters, so that audits
    are met in ASCII order. A branch is cut off if its cost and the bound of what follows exceed
    the incumbent's cost, or only equal it once there is one; a node reached before at no
    higher cost dominates. The incumbent's cost starts at the bound of the whole, which is
    attained, so the first complete path proves itself.
    """
    n, most = len(turns), bounds[0][start]
    if most >= FAR:
        return None
    seen: dict[tuple[int, int], int] = {}
    stack: list[tuple] = [(0, start, 0, None)]
    while stack:
        i, state, cost, path = stack.pop()
        if seen.get((i, state), FAR) <= cost or cost + bounds[i][state] > most:
            continue
        seen[i, state] = cost
        if i == n and cost == most and bounds[i][state] == 0:
            letters = []
            while path:
                path, letter = path
                letters.append(letter)
            return cost, "".join(reversed(letters))
        # Pushed from the last letter to the first.
        if i < n:
            initial, fault = turns[i]
            extra = TRUNCATED if fault == CUT else 0
            if fault != LOST:
                stack.append((i + 1, AFTER[state], cost + REROLE + extra, (path, "R")))
                kept = NEXT.get(initial)
                if kept and kept[state] is not None:
                    stack.append((i + 1, kept[state], cost + KEEP + extra, (path, "K")))
        stack.append((i, AFTER[state], cost + INSERT, (path, "I")))
        if i < n:
            stack.append((i + 1, state, cost + DELETE, (path, "D")))
    raise AssertionError("the bound of the whole is attained")


def whole(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """The cheapest repair of a whole conversation."""
    return cheapest(turns, START, suffix_bounds(turns, CLOSING))


def passages(turns: list[tuple[str, int]]) -> list[dict]:
    """The cheapest edits of a segment from every state to every state."""
    out = []
    for end in STATES:
        bounds = suffix_bounds(turns, tuple(0 if s == end else FAR for s in STATES))
        for start in STATES:
            found = cheapest(turns, start, bounds)
            if found:
                out.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
    return out


class Repaired:
    """Digest of the repaired turns, fed letter by letter; roles follow from the letters."""

    def __init__(self, audit: str):
        self.audit, self.place, self.state, self.digest, self.any = audit, 0, START, hashlib.sha256(), False

    def emit(self, role: str, text: str, state: int) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any, self.state = True, state

    def inserted(self) -> None:
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            self.emit(WANTED[self.state], "", AFTER[self.state])
            self.place += 1

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.place]
        self.place += 1
        if letter == "K":
            self.emit(role, text, NEXT[role[:1]][self.state])
        elif letter == "R":
            self.emit(WANTED[self.state], text, AFTER[self.state])

    def end(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


class Segment:
    """Consecutive turns of a conversation and their counts."""

    def __init__(self):
        self.turns: list[tuple[str, int]] = []
        self.rows: list[tuple[str, str]] = []
        self.size = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        name, fault = fault_of(text, seen)
        if name:
            self.count[name] += 1
        initial = role[:1]
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.turns.append((initial, fault))
        self.rows.append((role, text))
        self.size += len(text)
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, conv, part: int, place: int, open_: bool, alone: bool) -> dict:
        """The segment's row; ``alone`` where it may be the whole conversation."""
        out = {
            "conv": conv, "part": part, "place": place, "open": open_, "n": len(self.turns), "low": self.low,
            "high": self.high, "distinct": self.distinct, "first": self.turns[0][0] if self.turns else None,
            "last": self.turns[-1][0] if self.turns else None, "cost": None, "audit": None, "sha": None,
            "passages": passages(self.turns) if open_ else [], **self.count,
        }
        if alone:
            out["cost"], out["audit"] = whole(self.turns)
            repaired = Repaired(out["audit"])
            for role, text in self.rows:
                repaired.turn(role, text)
            out["sha"] = repaired.end()
        return out


def segment_type(conv: T.DataType) -> T.StructType:
    passage = "array<struct<start:int,end:int,cost:long,audit:string>>"
    fields = (
        "part int, place int, open boolean, n long, low long, high long, distinct long, first string, last string, "
        f"blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string, passages {passage}"
    )
    return T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(fields).fields])


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of the sorted rows; those that may go on in another task, or were cut, are open."""
    conv_type = rows.schema["conv"].dataType
    schema = segment_type(conv_type)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        out, place, number, first = [], 0, 0, True
        held, conv, begun, previous = Segment(), None, False, None
        for batch in batches:
            for key, turn, role, text, _, copies, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and key != conv:
                    out.append(held.row(conv, part, place, first or number > 0, number == 0))
                    held, place, number, first, previous = Segment(), place + 1, 0, False, None
                conv, begun = key, True
                for copy in range(copies):
                    if len(held.turns) >= segment or held.size >= CHARACTERS:
                        out.append(held.row(conv, part, place, True, False))
                        held, place, number = Segment(), place + 1, number + 1
                    held.add(turn, role, text, seen or copy > 0)
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if begun:
            out.append(held.row(conv, part, place, True, number == 0))
        yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def chain(left: dict, right: dict) -> dict:
    """The cheapest edits of two neighbours together, by state before and after."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (start, middle), (cost, audit) in left.items():
        for end in STATES:
            if (middle, end) in right:
                more, rest = right[middle, end]
                # Equal costs need the audits; those of equal cost never begin one another.
                if (start, end) not in out or cost + more <= out[start, end][0]:
                    found = cost + more, audit + rest
                    out[start, end] = min(found, out.get((start, end), found))
    return out


def joined(open_: DataFrame) -> DataFrame:
    """Conversations of several segments: counts over their borders, cheapest chain of passages.

    A conversation's passages are at most eleven audits, together as long as its result's each.
    """
    schema = T.StructType([
        open_.schema["conv"],
        *T._parse_datatype_string(
            "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
        ).fields,
    ])

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        last = high = low = None
        distinct, total, parts = 0, {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, []
        rows = table.sort_by([("part", "ascending"), ("place", "ascending")]).to_pylist()
        for s in rows:
            for name in total:
                total[name] += s[name]
            if not s["n"]:
                continue
            if last is not None and last + s["first"] not in ("su", "ua", "au"):
                total["illegal"] += 1
            last = s["last"]
            if s["low"] is not None:
                distinct += s["distinct"] - (high == s["low"])
                low, high = s["low"] if low is None else low, s["high"]
            parts.append({(p["start"], p["end"]): (p["cost"], p["audit"]) for p in s["passages"]})
        while len(parts) > 1:
            parts = [chain(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        ends = {e: found for (s, e), found in parts[0].items() if s == START} if parts else {START: (0, "")}
        cost, audit = min((c + CLOSING[e], a + "I" * (CLOSING[e] // INSERT)) for e, (c, a) in ends.items())
        gaps = 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)
        row = {"conv": rows[0]["conv"], "gaps": gaps, **total, "cost": cost, "audit": audit}
        return pa.Table.from_pylist([row], to_arrow_schema(schema))

    return open_.groupBy("conv").applyInArrow(run, schema)


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv, sha)`` of the repaired ``rows`` of conversations of several segments, streamed in order.

    A digest is sequential, so one task reads such a conversation, one batch at a time.
    """
    conv_type = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv_type), T.StructField("sha", T.StringType())])
    first = audits.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(0).alias("chunk"), F.lit(1).cast("long").alias("copies"),
    )
    mine = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text", "chunk", "copies")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, repaired, conv = to_arrow_schema(schema), None, None
        for batch in batches:
            for key, kind, _, role, text, _, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if repaired:
                        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": repaired.end()}], arrow)
                    repaired, conv = Repaired(text), key
                else:
                    for _ in range(copies):
                        repaired.turn(role, text)
        if repaired:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": repaired.end()}], arrow)

    dealt = first.union(mine).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text", "chunk")
    return dealt.mapInArrow(run, schema)


def repairs(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            segment: int = SEGMENT) -> DataFrame:
    """One row for every conversation of the damaged ``df``: faults, and its cheapest repair.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``; see
    ``damaged`` for the damage. Turns stand in the order of ``turn`` (nulls first), then of role
    and text as they are after damage. Edits, their costs and the pattern of roles are the
    module's fixed values; ``audit`` holds the initials of the cheapest edits in order, the
    ASCII-least of equal cost, and fixes the repaired turns.

    Rows are sorted over all tasks, so a conversation of any length is solved in segments of at
    most ``segment`` turns. A segment that may not be all of its conversation gives the
    cheapest edits between every two states; chained, these are the conversation's. One that is
    all of it is solved at once. Only the digest of a long conversation is one task's work.

    Null conversation ids are one conversation; null turns come first and count in no gap; null
    roles and texts are one space (a blank turn). Roles of other initials can only be renamed or
    deleted. A conversation without rows after damage has zeros, an empty audit and the digest
    of nothing; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    given = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    rows = ordered(damaged(given), segment)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, "conv", "turn", "role", F.substring("text", 1, PREFIX), "chunk")
    found = staged(segments(dealt.sortWithinPartitions("conv", "turn", "role", "text", "chunk"), segment), "segments")
    # Of the open ones most are whole after all.
    alone = found.where("open").groupBy("conv").agg(F.count("*").alias("n_segments")).toDF("c", "n_segments")
    open_ = found.where("open").join(alone, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    wide = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("distinct")
    gaps = F.least(F.coalesce(wide, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps")
    of_one = found.where("not open").drop("open").union(open_.where("n_segments = 1").drop("open", "n_segments"))
    chained = staged(joined(open_.where("n_segments > 1").drop("n_segments")), "chained")
    # Few rows are read again: those of conversations that lie across tasks or segments.
    again = given.join(chained.select(F.col("conv").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    digests = hashed(ordered(damaged(again), segment), chained).toDF("c", "sha")
    of_many = chained.join(digests, F.col("conv").eqNullSafe(F.col("c")))
    out = of_one.select("conv", gaps, *names[2:]).union(of_many.select(*names))
    return out.withColumnRenamed("conv", "conv_id").withColumnRenamed("sha", "repaired_sha256")
