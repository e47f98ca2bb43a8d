"""Conversation repair: the cheapest edits after which roles read [system] (user assistant)*, found by Dijkstra's algorithm.

Nodes of the lattice are (rows consumed, state of the grammar); they are made as the search meets them. The key of
the queue is (cost, audit), audit being the initials of the edits so far, so the first end node that comes off it is
the cheapest repair, least in ASCII order among equals. A conversation of more than LONG_ROWS rows or LONG_BYTES is cut into
pieces: tasks search each piece from each state to each state, and a fold joins what they found, so that no task holds
its texts.

Edits: Keep 0, Rerole 1, Delete 2, Insert (an empty text) 5. A blank or repeated row must be deleted; a truncated row that
stays adds 5. Rows are ordered by turn (nulls first), then role and text, so that equal rows stand side by side.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_stored, if_small, map_arrow, n_partitions, stored

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
#: A conversation of more rows or bytes is dealt with in pieces of PIECE_ROWS.
LONG_ROWS, LONG_BYTES, PIECE_ROWS = 4096, 32 << 20, 1024
NOTHING, BLANK, DUPLICATE, TRUNCATED = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTING = (START, AFTER_ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}
#: What an inserted or reroled row becomes in each state, and the state after it.
NEXT = {START: ("user", AFTER_USER), AFTER_SYSTEM: ("user", AFTER_USER), AFTER_USER: ("assistant", AFTER_ASSISTANT), AFTER_ASSISTANT: ("user", AFTER_USER)}
SPACE = " \t\n\v\f\r"

#: (initial of the role, fault) of a row, and a piece's best (cost, audit) from state to state.
Row = tuple[str, int]
Table = dict[tuple[int, int], tuple[int, str]]


def after(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None where the grammar forbids it."""
    if initial == "s":
        return AFTER_SYSTEM if state == START else None
    role, then = NEXT[state]
    return then if initial == role[0] else None


def steps(row: Row, state: int) -> Iterator[tuple[int, str, int]]:
    """Edits that consume a row in a state: cost, initial, next state."""
    initial, fault = row
    yield DELETE_COST, "D", state
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        yield REROLE_COST + more, "R", NEXT[state][1]
        kept = after(state, initial)
        if kept is not None:
            yield KEEP_COST + more, "K", kept


def search(rows: list[Row], begin: int = START) -> Iterator[tuple[int, int, str, int]]:
    """Nodes of the lattice in the order of (cost, audit): cost, rows consumed, audit, state. Each node once, at its least key."""
    queue, done = [(0, "", 0, begin)], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        yield cost, at, audit, state
        if at < len(rows):
            for more, initial, then in steps(rows[at], state):
                if (at + 1, then) not in done:
                    heapq.heappush(queue, (cost + more, audit + initial, at + 1, then))
        then = NEXT[state][1]
        if (at, then) not in done:
            heapq.heappush(queue, (cost + INSERT_COST, audit + "I", at, then))


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of the first accepting end node that comes off the queue."""
    return next((cost, audit) for cost, at, audit, state in search(rows) if at == len(rows) and state in ACCEPTING)


def piece_table(rows: list[Row]) -> Table:
    """The best way through a piece from each state to each state that ends with its last row: no insert follows it.

    Ways that meet at a border have then used up the same rows, so none of their audits begins another one.
    """
    found: Table = {}
    for begin in NEXT:
        before: dict[int, tuple[int, str]] = {}
        for cost, at, audit, state in search(rows[:-1], begin):
            if at == len(rows) - 1:
                before[state] = (cost, audit)
                if len(before) == len(NEXT):
                    break
        for state, (cost, audit) in before.items():
            for more, initial, then in steps(rows[-1], state):
                way = (cost + more, audit + initial)
                found[begin, then] = min(found.get((begin, then), way), way)
    return found


def joined(tables: Iterable[Table]) -> tuple[int, str]:
    """Cost and audit of the whole from its pieces' tables in order.

    Audits so far are compared by their rank among the states, not as strings, and written out at the end only.
    """
    best = {START: (0, 0)}  # state: cost, rank of the audit
    back: list[dict[int, tuple[int, str]]] = []
    for table in tables:
        ways: dict[int, tuple[int, int, str, int]] = {}
        for (begin, then), (cost, audit) in table.items():
            if begin in best:
                way = (best[begin][0] + cost, best[begin][1], audit, begin)
                ways[then] = min(ways.get(then, way), way)
        order = sorted(ways, key=lambda s: ways[s][1:3])
        best = {s: (ways[s][0], rank) for rank, s in enumerate(order)}
        back.append({s: (begin, audit) for s, (_, _, audit, begin) in ways.items()})
    ends = []
    for state, (cost, rank) in best.items():
        missing = {START: 0, AFTER_ASSISTANT: 0, AFTER_USER: 1, AFTER_SYSTEM: 2}[state]
        ends.append((cost + INSERT_COST * missing, rank, missing, state))
    cost, _, missing, state = min(ends)
    parts = ["I" * missing]
    for ways in reversed(back):
        state, audit = ways[state]
        parts.append(audit)
    return cost, "".join(reversed(parts))


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of the rows that stay or are put in, from an audit and the (role, text) it was found for."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = after(state, role[:1])
        else:
            role, state = NEXT[state]
        yield edit, role, text


def fault_of(role: str, text: str, seen: set[bytes]) -> int:
    """The first fault of a row; seen holds digests of the rows before it."""
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()[:16]
    repeat = digest in seen
    seen.add(digest)
    end = text.rstrip(SPACE)[-1:]
    return BLANK if not end else DUPLICATE if repeat else TRUNCATED if end not in ".!?" else NOTHING


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report_schema(conv: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), *(T.StructField(c, T.LongType()) for c in REPORT), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def turns_schema(conv: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv.dataType), T.StructField("position", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _pack(rows: Iterable[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most so many; none that holds much more than a few MB of strings."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(some) >= most or size > 2 << 20:
            yield _batch(some, schema)
            some, size = [], 0
    if some:
        yield _batch(some, schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _counted(rows: list[Row], turns: list[int | None]) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal."""
    known = {t for t in turns if t is not None}
    faults = [fault for _, fault in rows]
    illegal = sum(a + b not in LEGAL_PAIRS for (a, _), (b, _) in itertools.pairwise(rows))
    return [max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal]


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that a task may hold, one after the other."""
    out = turns_schema(rows.schema["conv_id"]) if turns else report_schema(rows.schema["conv_id"])
    ordered = rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))

    def one(conv, own: list[tuple]) -> Iterator[tuple]:
        own = [r for r in own if r[4]]
        seen: set[bytes] = set()
        marked = [(role[:1], fault_of(role, text, seen)) for _, _, role, text, _ in own]
        cost, audit = cheapest(marked)
        done = repaired(audit, ((role, text) for _, _, role, text, _ in own))
        if turns:
            yield from ((conv, n, *row) for n, row in enumerate(done))
        else:
            text = "\n".join(f"{role}:{text}" for _, role, text in done)
            yield conv, *_counted(marked, [r[1] for r in own]), cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        schema = pa.schema(_arrow_fields(out))
        yield from _pack((r for conv, own in itertools.groupby(_rows_of(batches), lambda r: r[0]) for r in one(conv, list(own))), schema)

    return map_arrow(ordered.select("conv_id", "turn", "role", "text", "present"), run, out, "conversations")


def _arrow_fields(schema: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in order: the task that holds them (piece) and the place there (at), with marks and digests."""
    first = F.left("text", F.lit(64))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    ranged = rows.withColumn("first", first).repartitionByRange(n_partitions(rows.sparkSession), *order, F.col("first").asc_nulls_first()).drop("first").sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    schema = T.StructType([*ranged.schema.fields, T.StructField("piece", T.LongType()), T.StructField("at", T.LongType())])

    def run(batches):
        piece, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece] * len(batch), pa.int64()), pa.array(range(at, at + len(batch)), pa.int64())], names=schema.names)
            at += len(batch)

    end = F.right(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), F.lit(1))
    marked = map_arrow(ranged, run, schema, "conversations").withColumns({"end": end, "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    return stored(marked, "long-conversations")


def _marks(placed: DataFrame) -> DataFrame:
    """conv_id, piece, at, turn, initial, fault: what the search needs, without texts. Repeats are found by a join on digests that occur twice."""
    key = F.xxhash64("conv_id", "digest")
    few = placed.select("conv_id", "digest", "piece", "at", key.alias("key")).groupBy("key", "conv_id", "digest").agg(F.min(F.struct("piece", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    found = placed.join(if_small(stored(few, "repeats")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("end") == "", BLANK).when(F.struct("piece", "at") > F.col("first"), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(NOTHING)
    return found.select("conv_id", "piece", "at", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def _tables(marks: DataFrame) -> DataFrame:
    """A row for each run of at most PIECE_ROWS rows: its table, counts and outer initials."""
    ordered = marks.repartition("piece").sortWithinPartitions("piece", "at")
    conv = marks.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", conv.dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "at", "blank", "duplicate", "truncated", "illegal")), T.StructField("ends", T.StringType()), T.StructField("ways", T.ArrayType(T.StringType()))])

    def run(batches):
        def found():
            for (conv_id, piece), own in itertools.groupby(_rows_of(batches), lambda r: (r[0], r[1])):
                while some := list(itertools.islice(own, PIECE_ROWS)):
                    rows = [(r[3], r[4]) for r in some]
                    ways = [f"{b} {e} {c} {a}" for (b, e), (c, a) in piece_table(rows).items()]
                    yield conv_id, piece, some[0][2], *_counted(rows, [])[1:], f"{rows[0][0]:1}{rows[-1][0]:1}", ways

        for row in found():
            yield _batch([row], pa.schema(_arrow_fields(schema)))

    return map_arrow(ordered.select("conv_id", "piece", "at", "initial", "fault"), run, schema, "conversations")


def _folded(tables: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit: the pieces of a conversation folded in order, one piece at a time."""
    ordered = tables.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece", "at")
    schema = T.StructType([tables.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])

    def run(batches):
        out = pa.schema(_arrow_fields(schema))
        for conv, own in itertools.groupby(_rows_of(batches), lambda r: r[0]):
            sums, last = [0, 0, 0, 0], ""

            def pieces(own=own, sums=sums):
                nonlocal last
                for *_, blank, duplicate, truncated, illegal, ends, ways in own:
                    border = int(bool(last) and last + ends[0] not in LEGAL_PAIRS)
                    last = ends[1]
                    for k, v in enumerate((blank, duplicate, truncated, illegal + border)):
                        sums[k] += v
                    yield {(int(b), int(e)): (int(c), a) for b, e, c, a in (w.split(" ") for w in ways)}

            cost, audit = joined(pieces())
            yield _batch([(conv, *sums, cost, audit)], out)

    return map_arrow(ordered, run, schema, "conversations")


def _long(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations in pieces; the texts pass one task a conversation in order, as a digest of the whole text needs, and none is kept."""
    placed = _placed(rows)
    marks = stored(_marks(placed), "marks")
    whole = stored(_folded(_tables(marks)), "repairs")
    known = marks.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    gaps = known.select(F.col("conv_id").alias("c"), "gaps")
    counts = whole.join(gaps, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *REPORT[1:], "audit")
    head = counts.select("conv_id", F.lit(-1).cast("long").alias("piece"), F.lit(0).cast("long").alias("at"), F.array(*REPORT).alias("counts"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = placed.select("conv_id", "piece", "at", F.lit(None).cast("array<bigint>").alias("counts"), "role", "text")
    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece", "at")
    out = turns_schema(rows.schema["conv_id"]) if turns else report_schema(rows.schema["conv_id"])

    def one(conv, own: Iterator[tuple]) -> Iterator[tuple]:
        *_, counts, _, audit = next(own)
        done = repaired(audit, ((r[4], r[5]) for r in own))
        if turns:
            yield from ((conv, n, *row) for n, row in enumerate(done))
            return
        digest = hashlib.sha256()
        for n, (_, role, text) in enumerate(done):
            digest.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield conv, *counts, audit, digest.hexdigest()

    def run(batches):
        schema = pa.schema(_arrow_fields(out))
        yield from _pack((r for conv, own in itertools.groupby(_rows_of(batches), lambda r: r[0]) for r in one(conv, own)), schema)

    return map_arrow(ordered, run, out, "conversations")


def _prepared(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space), present; other columns are left out."""
    present = F.coalesce(F.col("present").cast("boolean"), F.lit(True)) if "present" in df.columns else F.lit(True)
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), present.alias("present"))


def _repair(df: DataFrame, turns: bool, long_rows: int, long_bytes: int) -> DataFrame:
    rows = _prepared(df)
    sizes = rows.groupBy("conv_id").agg(F.count_if("present").alias("rows"), F.sum(F.when(F.col("present"), F.octet_length("text"))).alias("bytes")).where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes))
    long = stored(sizes.select(F.col("conv_id").alias("long_id")), "long-ids")
    if long.isEmpty():
        drop_stored(long)
        return _short(rows, turns)
    long, same = if_small(long), F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _short(rows.join(long, same, "left_anti"), turns).unionByName(_long(rows.where("present").join(long, same, "left_semi"), turns))


def repair_report(df: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A row for each conv_id: counts of faults before the repair, its cost and audit, and the digest of the repaired conversation.

    df: conv_id, turn, role, text and perhaps present; rows with present = false only name their conversation, and one
    without any other has zeros, an empty audit and the digest of the empty text. Null roles and texts count as one space,
    a null conv_id is a conversation of its own, null turns come first and leave no gap. Rows with the same turn go by role,
    then text; equal rows are duplicates. Extra columns are left out; an empty table gives no rows.
    """
    return _repair(df, False, long_rows, long_bytes)


def repaired_turns(df: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations themselves: conv_id, position, edit (K, R or I), role, text; as repair_report for odd rows."""
    return _repair(df, True, long_rows, long_bytes)


def damaged(df: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32 of conv_id:turn modulo 20: 0 dropped (present = false), 1 emptied, 2 without [.!?], 3 twice, 4 made user. Nulls count as one space."""
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, role, text = F.crc32(F.encode(named, "utf-8")) % 20, *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return df.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


