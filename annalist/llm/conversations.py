"""Operator 12, conversation structure repair: error-correcting Earley parsing.

A conversation's roles must read ``(system? (user assistant)+)?``.  The weighted grammar keeps a row (cost 0), gives it another role (3),
deletes it (4) or inserts an empty row (3); blank and duplicate rows must go, and a truncated row that stays costs 3 more.

* The chart: after each row one column of dotted items.  An item's rest decides what may follow, so items that differ in their origin
  alone are one, and each keeps the least (cost, audit): the edits' initials so far, the ASCII-least of the cheapest.  Scanning takes a row by
  keeping or rerolling it, the delete production passes it, the insert production moves the dot without a row.  Edits of equal cost over the
  same rows never are one a prefix of the other, so the least audit stays least whatever follows.
* A conversation is parsed where its rows lie after a sort by ranges.  One that spans tasks, or is longer than BLOCK rows, becomes several
  segments; each carries the chart from every item to every item, and the segments of a conversation are joined in order.  No conversation is
  held whole but for its audit, which is a column of the result.
* The completed chart's audit then replays over the rows, streamed in order, and yields the repaired rows.

Defined results: a null text, role or part of a row's key is one space; a null conv_id is one conversation; rows of one turn come by
role, then by the MD5 of the text; null turns first; rows that repeat a whole row are duplicates; roles count by their first character,
and one without characters can't be kept; a conversation without rows after the damage has zeros, an empty audit and the hash of the
empty string; an empty table gives no rows; texts of any length are read whole; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, with_clear_names
from .resampling import CRC_SQL, CRC_TABLE_SQL

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Dotted items: nothing read; a system row read; a user row waits for its assistant row; pairs complete.
ITEMS = START, SYSTEM, OPEN, DONE = range(4)
#: What an item may read next: (role, item after it, whether a row may be given that role or inserted).
RULES = {START: (("system", SYSTEM, False), ("user", OPEN, True)), SYSTEM: (("user", OPEN, True),), OPEN: (("assistant", DONE, True),), DONE: (("user", OPEN, True),)}
COMPLETE = (START, DONE)
LEGAL = {"su", "ua", "au"}
BLOCK = 1024
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
Entry = tuple[int, str] | None

SEGMENT = (
    "conv_id long, part int, seq long, rows long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, "
    "least_turn long, most_turn long, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def inserted(column: list[Entry]) -> list[Entry]:
    """A column with all its insert productions."""
    more = True
    while more:
        more = False
        for item in ITEMS:
            if column[item] is None:
                continue
            cost, audit = column[item]
            for _, after, free in RULES[item]:
                if free and (column[after] is None or (cost + INSERT, audit + "I") < column[after]):
                    column[after] = (cost + INSERT, audit + "I")
                    more = True
    return column


def scanned(column: list[Entry], initial: str, fault: int) -> list[Entry]:
    """The next column: a row of this role initial and fault, deleted, kept or given another role."""
    out: list[Entry] = [None if e is None else (e[0] + DELETE, e[1] + "D") for e in column]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT_OFF else 0
        for item in ITEMS:
            if column[item] is None:
                continue
            cost, audit = column[item]
            for role, after, free in RULES[item]:
                if role[0] == initial:
                    new = (cost + KEEP + more, audit + "K")
                elif free:
                    new = (cost + REROLE + more, audit + "R")
                else:
                    continue
                if out[after] is None or new < out[after]:
                    out[after] = new
    return inserted(out)


def begun() -> list[Entry]:
    return inserted([(0, ""), None, None, None])


class Segment:
    """The summary of neighbouring rows of one conversation and their chart, from the conversation's start or from every item."""

    def __init__(self, at_start: bool):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = self.least = self.most = self.first_turn = self.last_turn = None
        self.charts = {START: begun()} if at_start else {i: [(0, "") if i == j else None for j in ITEMS] for i in ITEMS}

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.rows:
            self.illegal += self.last_role + initial not in LEGAL
        else:
            self.first_role, self.first_turn = initial, turn
        if turn is not None:
            self.turns += self.last_turn is None or turn != self.last_turn
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.rows, self.last_role, self.last_turn = self.rows + 1, initial, turn
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT_OFF
        for item, column in self.charts.items():
            self.charts[item] = scanned(column, initial, fault)

    def row(self, conv_id: int | None, part: int, seq: int) -> tuple:
        entries = [e for i in ITEMS for e in self.charts.get(i, [None] * 4)]
        return (
            conv_id, part, seq, self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.first_role, self.last_role,
            self.least, self.most, self.first_turn, self.last_turn, self.turns, [e and e[0] for e in entries], [e and e[1] for e in entries],
        )


def joined(segments: Iterator[tuple]) -> tuple | None:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit) of one conversation from its segments in order."""
    rows = blank = duplicate = truncated = illegal = turns = 0
    least = most = last_role = last_turn = None
    column = begun()
    for _, _, _, n, b, d, t, bad, first_role, own_last_role, low, high, first_turn, own_last_turn, own_turns, costs, audits in segments:
        if not n:
            continue
        if rows:
            illegal += last_role + first_role not in LEGAL
            turns -= first_turn is not None and first_turn == last_turn
        whole = all(c is None for c in costs[4:])  # parsed from the conversation's start
        chart = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
        if whole:
            column = chart[:4]
        else:
            after: list[Entry] = [None] * 4
            for i in ITEMS:
                for j in ITEMS:
                    step = chart[4 * i + j]
                    if column[i] is not None and step is not None:
                        new = (column[i][0] + step[0], column[i][1] + step[1])
                        if after[j] is None or new < after[j]:
                            after[j] = new
            column = after
        rows, blank, duplicate, truncated, illegal, turns = rows + n, blank + b, duplicate + d, truncated + t, illegal + bad, turns + own_turns
        least, most, last_role, last_turn = low if least is None else least, most if high is None else high, own_last_role, own_last_turn
    cost, audit = min(column[i] for i in COMPLETE if column[i] is not None)
    return 0 if least is None else most - least + 1 - turns, blank, duplicate, truncated, illegal, cost, audit


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with the defined damage; copies: how often a row stands in the conversation, 0 for dropped ones."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """rows as they are, in the columns of ``damage``."""
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, initial, role, digest, copies, fault) without texts; a copy beside an equal row becomes a duplicate in the parse."""
    light = rows.select(
        "conv_id", "turn", "role", "copies", _digest().alias("digest"),
        (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("empty"),
        (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("open"),
    )
    # where a (role, text) stands at more than one turn: all but those at its first
    several = (
        light.where("copies > 0 and not empty")
        .groupBy("conv_id", "role", "digest")
        .agg(F.max(F.col("turn").isNull()).alias("without"), F.min("turn").alias("least"), F.max("turn").alias("most"))
        .where("(without and most is not null) or least < most")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.when(~F.col("without"), F.col("least")).alias("first_turn"), F.lit(True).alias("again"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    fault = F.when(F.col("empty"), BLANK).when(later, DUPLICATE).when(F.col("open"), CUT_OFF).otherwise(0)
    return light.join(several, same, "left").select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))


def segments(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of SEGMENT over rows of ``faults``: each conversation's, in order of part and seq."""
    order, types = ("conv_id", "turn", "role", "digest"), _types(SEGMENT)

    def run(batches):
        from pyspark import TaskContext

        part, seq, out = TaskContext.get().partitionId(), 0, []
        now, known, number = None, False, 0
        before = None

        def close():
            nonlocal seq
            if known and now is not None:
                out.append(now.row(conv, part, seq))
                seq += 1

        conv = None
        for batch in batches:
            for c, turn, role, digest, copies, fault in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if not known or c != conv:
                    close()
                    # the first conversation of a task may have begun in the task before
                    now, conv, before, number = Segment(at_start=known), c, None, number + 1
                    known = True
                for _ in range(copies):
                    if now.rows >= block:
                        close()
                        now = Segment(at_start=False)
                    own = (turn, role, digest)
                    now.add(turn, role[:1], DUPLICATE if own == before and fault != BLANK else fault)
                    before = own
            if len(out) >= 1024:
                yield _batch(out, types)
                out.clear()
        close()
        if out:
            yield _batch(out, types)

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "copies", "fault").mapInArrow(run, SEGMENT)


def _types(schema: str) -> pa.Schema:
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


def reports(found: DataFrame) -> DataFrame:
    """Rows of REPORT: a conversation's segments joined in order, as they stream by."""
    types = _types(REPORT)

    def run(batches):
        stream = (row for batch in batches for row in zip(*[x.to_pylist() for x in batch.columns], strict=True))
        out = []
        for conv, own in itertools.groupby(stream, key=lambda r: r[0]):
            out.append((conv, *joined(own)))
            if len(out) >= 1024:
                yield _batch(out, types)
                out.clear()
        if out:
            yield _batch(out, types)

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, REPORT)


def charts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of REPORT over rows of ``damage`` or ``undamaged``: the counts and cheapest edits of each conversation."""
    return reports(stored(segments(faults(rows), block), "segments"))


class Replay:
    """Applies an audit to a conversation's rows as they come: yields (role, text, edit)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.length = audit, 0, 0

    def _next(self) -> str:
        """The role that the next row of the repaired conversation has if it isn't kept."""
        return "assistant" if self.length % 2 else "user"

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._next(), "", "I"
            self.at, self.length = self.at + 1, self.length + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        yield (role if edit == "K" else self._next()), text, edit
        self.length += not (edit == "K" and role[:1] == "s")  # a system row stands before the pairs

    end = _inserts


def _ordered(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Each conversation's report, then its rows in order, dealt by conversation: what ``Replay`` streams."""
    parts = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    heads = report.select("conv_id", F.lit(0).alias("kind"), *parts, F.lit(0).alias("copies"), F.struct(*report.columns[1:]).alias("report"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("digest"), "copies", F.lit(None).cast(heads.schema["report"].dataType).alias("report"))
    order = ("conv_id", "kind", "turn", "role", "digest")
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "copies", "report", "turn")


def _streamed(batches):
    """Row by row, so that a batch's texts alone are held."""
    for batch in batches:
        for i in range(len(batch)):
            yield [c[i].as_py() for c in batch.columns]


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the repaired rows of each conversation; inserted ones have no turn."""
    schema = "conv_id long, position long, turn long, role string, text string, edit string"
    types = _types(schema)

    def run(batches):
        out, replay, conv, position = [], None, None, 0
        for c, kind, role, text, copies, report, turn in _streamed(batches):
            if kind == 0:
                if replay is not None:
                    for r, t, e in replay.end():
                        out.append((conv, position, None, r, t, e))
                        position += 1
                replay, conv, position = Replay(report["audit"]), c, 0
            for _ in range(copies):
                for r, t, e in replay.row(role, text):
                    out.append((conv, position, None if e == "I" else turn, r, t, e))
                    position += 1
            if len(out) >= 1024:
                yield _batch(out, types)
                out.clear()
        if replay is not None:
            for r, t, e in replay.end():
                out.append((conv, position, None, r, t, e))
                position += 1
        if out:
            yield _batch(out, types)

    return _ordered(rows, charts(rows, block)).mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of REPORT with repaired_sha256, the hash of the repaired rows as ``role:text``, joined by newlines."""
    schema = REPORT + ", repaired_sha256 string"
    types = _types(schema)

    def run(batches):
        out, replay, head, digest, some = [], None, None, None, False

        def put(found) -> None:
            nonlocal some
            for role, text, _ in found:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        def close() -> None:
            if replay is not None:
                put(replay.end())
                out.append((*head, digest.hexdigest()))

        for conv, kind, role, text, copies, report, _ in _streamed(batches):
            if kind == 0:
                close()
                replay, head, digest, some = Replay(report["audit"]), (conv, *report.values()), sha256(), False
            for _ in range(copies):
                put(replay.row(role, text))
            if len(out) >= 1024:
                yield _batch(out, types)
                out.clear()
        close()
        if out:
            yield _batch(out, types)

    return _ordered(rows, charts(rows, block)).mapInArrow(run, schema)


def _plus(entry: str, cost: str, letter: str) -> str:
    """SQL: an entry (ten digits of cost, then the audit) with one more edit."""
    return f"(lpad(CAST(CAST(left({entry}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({entry}, 11) || {letter})"


def _scan(targets: list[str], initial: str, own: str) -> str:
    read = [_plus(x, f"CASE WHEN initial = '{initial}' THEN more ELSE {REROLE} + more END", f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END") for x in targets]
    return "least(" + ", ".join([_plus(own, str(DELETE), "'D'"), *(f"CASE WHEN fault NOT IN (1, 2) THEN {x} END" for x in read)]) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
raw AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS w, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, {CRC_SQL} % 20 AS kind FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM dealt, range(2) c(copy) WHERE kind <> 0 AND copy < CASE WHEN kind = 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
  FROM placed),
rows AS (SELECT *, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faulty),
ids AS (SELECT DISTINCT conv_id FROM conversations),
chart AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '0000000000' AS a, CAST(NULL AS VARCHAR) AS b, '0000000003I' AS c, '0000000006II' AS d FROM ids
  UNION ALL
  SELECT conv_id, pos, a, b, c, least(d, {_plus("c", str(INSERT), "'I'")}) FROM (
    SELECT conv_id, pos, a, b, least(c, {_plus("a", str(INSERT), "'I'")}, {_plus("b", str(INSERT), "'I'")}, {_plus("d", str(INSERT), "'I'")}) AS c, d FROM (
      SELECT chart.conv_id, rows.pos, {_plus("a", str(DELETE), "'D'")} AS a,
        least({_plus("b", str(DELETE), "'D'")}, CASE WHEN initial = 's' AND fault NOT IN (1, 2) THEN {_plus("a", "more", "'K'")} END) AS b,
        {_scan(["a", "b", "d"], "u", "c")} AS c, {_scan(["c"], "a", "d")} AS d
      FROM chart JOIN rows ON rows.conv_id IS NOT DISTINCT FROM chart.conv_id AND rows.pos = chart.pos + 1))),
parsed AS (SELECT conv_id, arg_max(least(a, d), pos) AS entry FROM chart GROUP BY conv_id),
edits AS (SELECT conv_id, i, substr(entry, 10 + i, 1) AS edit FROM (SELECT conv_id, entry, unnest(range(1, length(entry) - 9)) AS i FROM parsed)),
taken AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM edits),
read AS (
  SELECT taken.conv_id, i, edit, role, text, row_number() OVER (PARTITION BY taken.conv_id ORDER BY i) - 1 AS place
  FROM taken LEFT JOIN rows ON edit <> 'I' AND rows.conv_id IS NOT DISTINCT FROM taken.conv_id AND rows.pos = taken.pos WHERE edit <> 'D'),
led AS (SELECT *, CAST(first_value(edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS system_row FROM read),
spelled AS (
  SELECT conv_id, i, CASE WHEN edit = 'K' THEN role WHEN (place - system_row) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM led),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM spelled GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT parsed.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(left(entry, 10) AS BIGINT) AS cost, substr(entry, 11) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM parsed LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM parsed.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM parsed.conv_id
"""


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired_digests(damage(with_clear_names(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))
