"""Repairs the structure of conversations at least cost: role initials become `(s?(ua)+)?`.

Rows are taken by turn (nulls first), ties by role, then text. A row may be kept, given the role user or assistant, or deleted, and
turns without text may be inserted anywhere. Conversations are dealt out by hash and sorted by Spark. A task hands some ten
thousand rows at once to a recursive DuckDB query, which advances by one row in all their conversations a round, and keeps the least
(cost, audit) for each state of the grammar. An audit tells its output: at each point the grammar allows one of user and assistant.

A conversation of over MOST_ROWS rows or MOST_BYTES of text isn't held by one task: its rows are dealt by ranges of their order, cut into chunks
of CHUNK rows, and the same query finds the best way through a chunk from each state to each other. Chunks are then put together in order.

Cases: a null role or text is one space; null turns come first and are no gap; a null conversation id is a conversation; rows that repeat are
duplicates of the first; a role that starts with none of s, u, a can't be kept; an empty text is blank; conversations without rows are
whole (no cost, no turns); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACES, partitions, read, scratch, written

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Where a letter leads from each state: 0 at the start, 1 after system, 2 after user, 3 after assistant.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A conversation within these bounds is one task's work.
MOST_ROWS, MOST_BYTES = 2000, 16_000_000
#: Rows, and bytes of text, that a task gathers for one recursive query; rows of a chunk.
BATCH_ROWS, BATCH_BYTES, CHUNK = 30_000, 16_000_000, 256

TURN = "struct<edit:string,role:string,text:string>"
REPAIRED = f"piece long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<{TURN}>"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def inserted(state: int) -> Iterator[tuple[int, str]]:
    """The states that inserts alone lead to, and their letters; no state twice, as each insert costs."""
    seen: dict[int, str] = {}
    letters = ""
    while state not in seen:
        seen[state] = letters
        state, letters = next(GRAMMAR[state, x] for x in "ua" if (state, x) in GRAMMAR), letters + "I"
    yield from seen.items()


def moves() -> list[tuple]:
    """(state, goal, letters, cost, edit, initial) of all inserts before a row with one edit of it."""
    out = []
    for state in range(4):
        for at, letters in inserted(state):
            cost = INSERT * len(letters)
            out.append((state, at, letters + "D", cost + DELETE, "D", None))
            for (a, x), goal in GRAMMAR.items():
                if a == at:
                    out.append((state, goal, letters + "K", cost + KEEP, "K", x))
                    if x in ROLES:
                        out.append((state, goal, letters + "R", cost + REROLE, "R", None))
    return out


#: starts: the units and the states they begin in; line: their rows, from 0.
WALK = """
WITH RECURSIVE walk AS (
  SELECT unit, state AS start, 0::BIGINT AS i, state, {cost: 0::BIGINT, audit: ''} AS best FROM starts
  UNION ALL
  SELECT unit, start, i + 1, state, best FROM (
    SELECT w.unit, w.start, w.i, m.goal AS state,
           min({cost: w.best.cost + m.cost + CASE WHEN r.truncated AND m.edit <> 'D' THEN $truncated ELSE 0 END, audit: w.best.audit || m.letters}) AS best
    FROM walk w JOIN line r ON r.unit = w.unit AND r.i = w.i
    JOIN moves m ON m.state = w.state AND (m.edit = 'D' OR NOT r.must_go AND (m.edit = 'R' OR m.initial = r.initial))
    GROUP BY w.unit, w.start, w.i, m.goal)
)
SELECT w.unit, w.start, w.state, w.best.cost AS cost, w.best.audit AS audit
FROM walk w JOIN (SELECT unit, max(n) AS n FROM starts GROUP BY unit) s ON s.unit = w.unit AND s.n = w.i
"""


class Walker:
    """A task's DuckDB session."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.db.execute("CREATE TABLE moves (state INT, goal INT, letters VARCHAR, cost BIGINT, edit VARCHAR, initial VARCHAR)")
        self.db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())

    def walk(self, starts: list[tuple[int, int, int]], line: pa.Table) -> list[tuple]:
        """(unit, start, state, cost, audit) of the best ways; starts: (unit, state, its number of rows)."""
        begin = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("unit", "state", "n"), zip(*starts, strict=True), strict=True)})
        self.db.register("starts", begin)
        self.db.register("line", line)
        out = self.db.execute(WALK, {"truncated": TRUNCATED}).fetchall()
        self.db.unregister("starts")
        self.db.unregister("line")
        return out


def line(units: list[int], places: list[int], initials: list[str], must_go: list[bool], truncated: list[bool]) -> pa.Table:
    return pa.table(
        {"unit": pa.array(units, pa.int64()), "i": pa.array(places, pa.int64()), "initial": pa.array(initials, pa.string()), "must_go": pa.array(must_go, pa.bool_()), "truncated": pa.array(truncated, pa.bool_())}
    )


def finished(ways: list[tuple[int, int, str]]) -> tuple[int, str, int]:
    """The least (cost, audit) of ways (state, cost, audit) with the inserts that end the grammar, and the state it was in before them."""
    return min((cost + INSERT * len(more), audit + more, state) for state, cost, audit in ways for goal, more in inserted(state) if goal in FINAL)


def applied(audit: str, rows: list[tuple[str, str]], state: int = 0) -> list[dict]:
    """The turns that an audit makes of rows (role, text), from a state on."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(x for x in "ua" if (state, x) in GRAMMAR)
        state = GRAMMAR[state, initial]
        out.append({"edit": edit, "role": role if edit == "K" else ROLES[initial], "text": text})
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def faults(text: Column) -> list[Column]:
    """Whether a text is blank, and whether it ends without a mark."""
    end = F.right(F.btrim(text, F.lit(SPACES)), F.lit(1))
    return [(end == "").alias("_blank"), (~end.isin("", ".", "!", "?")).alias("_truncated")]


def prepared(turns: DataFrame, names: tuple[str, str, str, str], gone: Column) -> DataFrame:
    """The columns that repair reads. Rows that are gone only say that their conversation is there."""
    conv, turn, role, text = (F.col(x) for x in names)
    text = F.coalesce(text, F.lit(" "))
    return turns.select(conv.alias("_conv"), turn.cast("long").alias("_turn"), F.coalesce(role, F.lit(" ")).alias("_role"), F.when(~gone, text).alias("_text"), *faults(text))


def short_ones(rows: DataFrame, conv_type: pa.DataType) -> DataFrame:
    """The repaired conversations of rows whose conversations are within the bounds: one row each."""
    schema = pa.schema([("conv", conv_type), *((k, pa.int64()) for k in ("piece", *COUNTS)), ("audit", pa.string()), ("turns", pa.list_(pa.struct([(k, pa.string()) for k in ("edit", "role", "text")])))])

    def solve(walker: Walker, held: list[tuple]) -> pa.RecordBatch:
        units, places, initials, must_go, truncated, starts, out = [], [], [], [], [], [], []
        for unit, (conv, found) in enumerate(held):
            seen, n, counts = set(), 0, dict.fromkeys(COUNTS, 0)
            for turn, role, text, blank, cut in found:
                repeats = not blank and (role, text) in seen
                seen.add((role, text))
                fault = "blank" if blank else "duplicate" if repeats else "truncated" if cut else None
                if fault:
                    counts[fault] += 1
                for column, value in ((units, unit), (places, n), (initials, role[:1]), (must_go, blank or repeats), (truncated, cut)):
                    column.append(value)
                n += 1
            at = {turn for turn, *_ in found if turn is not None}
            counts["gaps"] = max(at) - min(at) + 1 - len(at) if at else 0
            counts["illegal"] = illegal([x[1][:1] for x in found])
            starts.append((unit, 0, n))
            out.append({"conv": conv, "piece": 0, **counts})
        ways: dict[int, list] = {}
        for unit, _, state, cost, audit in walker.walk(starts, line(units, places, initials, must_go, truncated)):
            ways.setdefault(unit, []).append((state, cost, audit))
        for unit, row in enumerate(out):
            row["cost"], row["audit"], _ = finished(ways[unit])
            row["turns"] = applied(row["audit"], [x[1:3] for x in held[unit][1]])
        return pa.RecordBatch.from_pylist(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, held, size, n = Walker(), [], 0, 0
        for batch in batches:
            for conv, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not held or held[-1][0] != conv:
                    if n >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield solve(walker, held)
                        held, size, n = [], 0, 0
                    held.append((conv, []))
                if row[2] is not None:
                    held[-1][1].append(row)
                    size += len(row[2])
                    n += 1
        if held:
            yield solve(walker, held)

    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark), "_conv").sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text")
    return dealt.mapInArrow(run, f"_conv {rows.schema['_conv'].dataType.simpleString()}, {REPAIRED}")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with their place in order (_at), their chunk, and which of equal rows are not the first."""
    rows = rows.where("_text IS NOT NULL")
    order = ["_conv", F.col("_turn").asc_nulls_first(), "_role", "_text"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "turns")
    first = placed.groupBy("_conv", "_role", F.sha2("_text", 256)).agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    flagged = placed.join(first, "_at", "left")  # by place: no place repeats, however often a text does
    return flagged.withColumn("_repeats", F.col("_first").isNull()).withColumn("_chunk", F.floor(F.col("_at") / CHUNK)).drop("_first")


def ways_through(rows: DataFrame) -> DataFrame:
    """For each chunk the best (cost, audit) from each state to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, keys = Walker(), []

        def solve(units: list[int], columns: list[list]) -> pa.RecordBatch:
            n = pd.Series(units).value_counts()
            found = walker.walk([(int(u), s, int(k)) for u, k in n.items() for s in range(4)], line(units, *columns))
            out = [(*keys[u], start, state, cost, audit) for u, start, state, cost, audit in found]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["_first_at", "_start", "_state", "_cost", "_audit"])

        units, columns = [], [[], [], [], []]
        for batch in batches:
            for first_at, i, initial, must_go, truncated in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not i:
                    if len(units) >= BATCH_ROWS:
                        yield solve(units, columns)
                        units, columns, keys[:] = [], [[], [], [], []], []
                    keys.append((first_at,))
                units.append(len(keys) - 1)
                for column, value in zip(columns, (i, initial, must_go, truncated), strict=True):
                    column.append(value)
        if units:
            yield solve(units, columns)

    each = rows.groupBy("_conv", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_at", F.left("_role", F.lit(1)).alias("initial"), (F.col("_blank") | F.col("_repeats")).alias("must_go"), F.col("_truncated").alias("truncated")))).alias("_rows"))
    slim = each.select(F.col("_rows")[0]["_at"].alias("_first_at"), F.posexplode("_rows").alias("_i", "_row")).select("_first_at", F.col("_i").cast("long"), "_row.initial", "_row.must_go", "_row.truncated")
    return slim.mapInArrow(run, "_first_at long, _start long, _state long, _cost long, _audit string")


def put_together(ways: pd.DataFrame) -> pd.DataFrame:
    """One conversation's chunks in order: the audit, cost and first state of each on the best way through all."""
    best, steps = {0: (0, "")}, []
    chunks = list(ways.sort_values("_first_at", kind="stable").groupby("_first_at", sort=True))
    for _, through in chunks:
        after: dict[int, tuple] = {}
        for start, state, cost, audit in zip(through["_start"], through["_state"], through["_cost"], through["_audit"], strict=True):
            if start in best:
                way = (best[start][0] + cost, best[start][1] + audit, start, cost, audit)
                after[state] = min(after.get(state, way), way)
        best = {state: way[:2] for state, way in after.items()}
        steps.append(after)
    total, whole, state = finished([(state, *way) for state, way in best.items()])
    more = whole[len(best[state][1]) :]
    out = []
    for (first_at, _), after in zip(reversed(chunks), reversed(steps), strict=True):
        *_, start, cost, audit = after[state]
        out.append((first_at, start, cost + INSERT * len(more), audit + more))
        state, more = start, ""
    return pd.DataFrame(out[::-1], columns=["_first_at", "_start", "cost", "audit"])


def long_ones(rows: DataFrame) -> DataFrame:
    """The repaired conversations of rows, whatever their size: a row for each chunk of one, in the order of piece."""
    rows = numbered(rows)
    conv = f"_conv {rows.schema['_conv'].dataType.simpleString()}"
    chunks = rows.groupBy("_conv", "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_role", "_text"))).alias("_rows"), F.count_if("_blank").alias("blank"), F.count_if(F.col("_repeats") & ~F.col("_blank")).alias("duplicate"),
        F.count_if(F.col("_truncated") & ~F.col("_blank") & ~F.col("_repeats")).alias("truncated"),
    ).withColumn("_first_at", F.col("_rows")[0]["_at"])
    chunks = written(chunks, "chunks")
    ways = ways_through(rows).join(chunks.select("_first_at", "_conv"), "_first_at")
    chosen = ways.groupBy("_conv").applyInPandas(lambda x: put_together(x), "_first_at long, _start long, cost long, audit string")
    # Pairs of neighbours: inside a chunk, and the last row of the chunk before with the first. The chunks of a conversation are few rows.
    ends = chunks.select("_conv", "_first_at", F.left(F.col("_rows")[0]["_role"], F.lit(1)).alias("_head"), F.left(F.element_at("_rows", -1)["_role"], F.lit(1)).alias("_tail"))
    order = Window.partitionBy("_conv").orderBy("_first_at")
    before = F.lag("_tail").over(order)
    ends = ends.select("_first_at", F.when(before.isNull(), 0).otherwise((~F.concat(before, "_head").isin("su", "ua", "au")).cast("int")).alias("_joint"), (F.row_number().over(order) - 1).cast("long").alias("piece"))
    turns = rows.groupBy("_conv").agg((F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")).alias("_gaps"), F.min("_at").alias("_first_at"))
    whole = chunks.join(chosen, "_first_at").join(ends, "_first_at").join(turns.select("_first_at", "_gaps"), "_first_at", "left").select(
        "_conv", "piece", F.coalesce("_gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", F.col("_joint").cast("long").alias("illegal"), "cost", "audit", "_start", "_rows",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found, start = [(x["_role"], x["_text"]) for x in row.pop("_rows")], row.pop("_start")
                row["illegal"] += illegal([role[:1] for role, _ in found])
                row["turns"] = applied(row["audit"], found, start)
                fields = [x for x in batch.schema if x.name not in ("_rows", "_start")]
                yield pa.RecordBatch.from_pylist([row], pa.schema([*fields, ("turns", pa.list_(pa.struct([(k, pa.string()) for k in ("edit", "role", "text")])))]))

    return whole.mapInArrow(run, f"{conv}, {REPAIRED}")


def repaired(turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), gone: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The repaired conversations within the bounds, one row each, and those beyond, one for each chunk (None if there are none).

    Columns: _conv, piece, gaps, blank, duplicate, truncated, illegal, cost, audit, turns. Counts, cost, audits and turns of pieces add up.
    gone: rows that are dropped, and whose conversation comes back nonetheless.
    """
    rows = prepared(turns, names, F.lit(False) if gone is None else gone)
    conv_type = to_arrow_type(rows.schema["_conv"].dataType)
    size = rows.groupBy("_conv").agg(F.count("_text").alias("_n"), F.sum(F.octet_length("_text")).alias("_bytes"))
    beyond = written(size.where((F.col("_n") > MOST_ROWS) | (F.col("_bytes") > MOST_BYTES)).select(F.col("_conv").alias("_long")), "long-conversations")
    if beyond.isEmpty():
        return short_ones(rows, conv_type), None
    same = F.col("_conv").eqNullSafe(F.col("_long"))
    return short_ones(rows.join(beyond, same, "left_anti"), conv_type), long_ones(rows.join(beyond, same, "left_semi"))


def repair(turns: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """repaired(), in one table under the id's own name."""
    short, beyond = repaired(turns, names)
    return (short.unionByName(beyond) if beyond else short).withColumnRenamed("_conv", names[0])


def digested(pieces: DataFrame) -> DataFrame:
    """_conv, sha256 and the whole audit of conversations in pieces; their texts pass by in order and are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, digest, audit, some = none, None, [], False
        row = lambda: pa.RecordBatch.from_pylist([{"_conv": conv, "repaired_sha256": digest.hexdigest(), "audit": "".join(audit)}])
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.slice(i, 1).to_pylist()[0]
                if found["_conv"] != conv:
                    if conv is not none:
                        yield row()
                    conv, digest, audit, some = found["_conv"], hashlib.sha256(), [], False
                audit.append(found["audit"])
                for x in found["turns"]:
                    digest.update((("\n" if some else "") + f"{x['role']}:{x['text']}").encode())
                    some = True
        if conv is not none:
            yield row()

    ordered = pieces.select("_conv", "piece", "audit", "turns").repartition(partitions(pieces.sparkSession), "_conv").sortWithinPartitions("_conv", "piece")
    return ordered.mapInArrow(run, f"_conv {pieces.schema['_conv'].dataType.simpleString()}, repaired_sha256 string, audit string")


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with the faults of the contract, by the checksum of conversation and turn, and which rows are dropped."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    out = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("_kind"))
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))), F.col("_kind") == 0


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        turns, gone = damaged(read(spark, sf_dir, "conversations"))
        short, beyond = repaired(turns, gone=gone)
        said = F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
        out = short.select("_conv", *COUNTS, "audit", F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256"))
        if beyond:
            pieces = written(beyond, "pieces")
            sums = pieces.groupBy("_conv").agg(*(F.sum(x).alias(x) for x in COUNTS)).withColumnRenamed("_conv", "_id")
            out = out.unionByName(sums.join(digested(pieces), F.col("_id").eqNullSafe(F.col("_conv"))).drop("_id"))
        out = keep(written(out, "repaired"))
    return out.withColumnRenamed("_conv", "conv_id")
