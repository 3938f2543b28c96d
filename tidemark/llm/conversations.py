"""Repairs the turn structure of conversations at least cost: a recursive DuckDB query inside hash-partitioned batches.

A conversation's rows stand in order of their turn (nulls first, then by role and text). Each row's first fault counts: blank (no
character but white space ``[ \\t-\\r]``), duplicate (role and text seen earlier), truncated (the last such character is no ``.!?``).
Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert of an empty text by user or assistant 5; a truncated row that
stays costs 5 more, and blank or duplicate rows must go. The cheapest edits that leave role initials of the form ``(s?(ua)+)?`` are
taken; of equally cheap ones those whose initials K, R, D, I in order are least.

How it is spread: rows are hash-partitioned by conversation and sorted inside the partition, so a task reads its conversations as a
stream. It gathers whole conversations to batches of ROWS rows and hands a batch to DuckDB: every recursion advances one row in all
conversations at once and keeps the least cost and audit per state of the grammar. Longer conversations are cut every SEGMENT
rows; such a piece is solved from every state, and the pieces are chained, so memory holds a batch, the audit and 16 bytes for each
row of the conversation at hand, however long it is. A conversation is one task's stream, as its digest has an order.

Keeping (cost, audit) per state is enough: an audit tells its cost, so of two equally dear ones none is the start of the other, and
what follows cannot change their order. An audit and its first kept role tell all roles, so results are unique.

Defined results: a null role or text is one space, so the row is blank or its role is none of the three. Conversations of null id are
one conversation. Repeated rows are duplicates. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a batch, its characters, and the rows after which a conversation is cut.
ROWS, CHARS, SEGMENT = 20_000, 16_000_000, 256
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. Where each role initial leads from each.
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ROLES = {"u": "user", "a": "assistant"}
FINE, MUST_GO, CUT_OFF = range(3)
RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

ADVANCE = """WITH RECURSIVE walk(seg, n, entry, state, best) AS (
  SELECT seg, 0, entry, entry, {'cost': 0::BIGINT, 'audit': ''} FROM entries
  UNION ALL
  SELECT w.seg, any_value(w.n) + 1, w.entry, m.next, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits})
  FROM walk w JOIN turns t ON t.seg = w.seg AND t.n = w.n + 1 JOIN moves m ON m.state = w.state AND m.kind = t.kind
  GROUP BY w.seg, w.entry, m.next)
SELECT w.seg, w.entry, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walk w JOIN lengths l ON l.seg = w.seg AND l.n = w.n"""


def kind(initial: str, fault: int) -> int:
    """A row's class: its role initial (or none of the three) and its fault."""
    return 3 * "sua".find(initial) + fault if initial and initial in "sua" else 9 + fault


def inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, edits) after no, one or two inserts; more lead back to where they began."""
    cost, edits = 0, ""
    yield state, cost, edits
    for _ in range(2):
        state = NEXT.get((state, "u")) or NEXT[state, "a"]
        cost, edits = cost + INSERT, edits + "I"
        yield state, cost, edits


def moves() -> list[tuple[int, int, int, int, str]]:
    """(state, kind of row, next state, cost, edits) of every way past a row: inserts, then one edit."""
    found = []
    for state, initial, fault in product(range(4), "sua-", (FINE, MUST_GO, CUT_OFF)):
        for at, cost, edits in inserts(state):
            found.append((state, kind(initial, fault), at, cost + DELETE, edits + "D"))
            if fault != MUST_GO:
                stays = cost + TRUNCATED * (fault == CUT_OFF)
                if (at, initial) in NEXT:
                    found.append((state, kind(initial, fault), NEXT[at, initial], stays + KEEP, edits + "K"))
                found += [(state, kind(initial, fault), NEXT[at, r], stays + REROLE, edits + "R") for r in ROLES if (at, r) in NEXT]
    return found


#: What leads from each state to an accepted end.
ENDS = {state: [(cost, edits) for at, cost, edits in inserts(state) if at in (START, A)] for state in range(4)}


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state after it) of every edit of an audit; deleted rows as they were."""
    left = iter(rows)
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit in "IR":
            role = ROLES["u" if (state, "u") in NEXT else "a"]
        if edit != "D":
            state = NEXT[state, role[:1]]
        yield edit, role, text, state


class Conversation:
    """What is known of a conversation while its rows go by. paths: cost, audit and running digest of the best way to each state."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.seen, self.rows, self.kinds = conv_id, set(), [], []
        self.first = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.paths = {START: (0, "", hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial, end = role[:1], text.rstrip(SPACE)[-1:]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = FINE
        if not end:
            self.blank, fault = self.blank + 1, MUST_GO
        elif mark in self.seen:
            self.duplicate, fault = self.duplicate + 1, MUST_GO
        elif end not in ".!?":
            self.truncated, fault = self.truncated + 1, CUT_OFF
        self.seen.add(mark)
        self.rows.append((role, text))
        self.kinds.append(kind(initial, fault))

    def chain(self, rows: list[tuple[str, str]], ways: list[tuple[int, int, int, str]], last: bool) -> None:
        """Carries paths on through a piece of rows. ways: (entry, state, cost, audit)."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for entry, state, cost, audit in ways:
            if entry in self.paths:
                before, so_far, _ = self.paths[entry]
                for more, edits in ENDS[state] if last else [(0, "")]:
                    to = START if last else state
                    best[to] = min(best.get(to, (1 << 62, "", 0, "")), (before + cost + more, so_far + audit + edits, entry, audit + edits))
        paths = {}
        for state, (cost, audit, entry, piece) in best.items():
            digest = self.paths[entry][2].copy()
            at = entry
            for edit, role, text, after in edited(rows, piece, entry):
                if edit != "D":
                    digest.update(f"{chr(10) if at != START else ''}{role}:{text}".encode())
                at = after
            paths[state] = (cost, audit, digest)
        self.paths = paths

    def result(self) -> tuple:
        cost, audit, digest = self.paths[START]
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())


def solve(pieces: list[tuple[Conversation, list, list, bool, bool]], con) -> Iterator[Conversation]:
    """Advances pieces (conversation, rows, kinds, first, last) of a batch; yields conversations that end."""
    turns = [(i, n + 1, k) for i, (_, _, kinds, _, _) in enumerate(pieces) for n, k in enumerate(kinds)]
    entries = [(i, e) for i, piece in enumerate(pieces) for e in ([START] if piece[3] else range(4))]
    made = {"turns": (("seg", "n", "kind"), turns), "entries": (("seg", "entry"), entries), "lengths": (("seg", "n"), [(i, len(p[1])) for i, p in enumerate(pieces)]), "moves": (("state", "kind", "next", "cost", "edits"), moves())}
    for name, (columns, rows) in made.items():
        values = list(zip(*rows, strict=True)) or [()] * len(columns)
        con.register(name, pa.table([pa.array(v, pa.string() if c == "edits" else pa.int64()) for c, v in zip(columns, values, strict=True)], names=list(columns)))
    ways: list[list] = [[] for _ in pieces]
    for seg, *way in con.execute(ADVANCE).fetchall():
        ways[seg].append(tuple(way))
    for (conversation, rows, _, _, last), found in zip(pieces, ways, strict=True):
        conversation.chain(rows, found, last)
        if last:
            yield conversation


def _conversations(batches: Iterator[pa.RecordBatch], rows: int, segment: int) -> Iterator[list[Conversation]]:
    """Sorted rows (id, here, turn, role, text) to finished conversations, in lists."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    pieces, held, chars, now = [], 0, 0, None

    def cut(last: bool) -> None:
        nonlocal held
        pieces.append((now, now.rows, now.kinds, not now_cut, last))
        held += len(now.rows)
        now.rows, now.kinds = [], []

    now_cut = False
    for batch in batches:
        for conv_id, here, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    cut(True)
                now, now_cut = Conversation(conv_id), False
            elif len(now.rows) == segment:
                cut(False)
                now_cut = True
            if held >= rows or chars >= CHARS:
                yield list(solve(pieces, con))
                pieces, held, chars = [], 0, 0
            if here:
                now.add(turn, role, text)
                chars += len(text)
    if now is not None:
        cut(True)
        yield list(solve(pieces, con))


def _repaired(id_type: pa.DataType, rows: int, segment: int):
    kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _conversations(batches, rows, segment):
            values = list(zip(*(c.result() for c in done), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    return repair


def _ordered(conversations: DataFrame, here: Column | None) -> DataFrame:
    told = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", (F.lit(True) if here is None else F.coalesce(here, F.lit(False))).alias("here"), F.col("turn").cast("long").alias("turn"), *told)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repair(conversations: DataFrame, here: Column | None = None, rows: int = ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): its faults, cost, audit and the digest of the repaired turns.

    gaps are the turns missing between its smallest and largest. here: of rows that it is false for only the conv_id counts.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema["conv_id"].dataType
    return _ordered(conversations, here).mapInArrow(_repaired(to_arrow_type(kind), rows, segment), RESULT.format(id=kind.simpleString()))


def repaired_turns(conversations: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of every turn that the audits of `repair` leave, in order from 0.

    An audit travels as the first row of its conversation, so these are streams too.
    """
    marked = conversations.select("conv_id", F.lit(1).alias("_part"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    audits = repaired.select("conv_id", F.lit(0).alias("_part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = marked.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "_part", F.col("turn").asc_nulls_first(), "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "_part", "role", "text").mapInArrow(_replayed, f"conv_id {kind}, position long, edit string, role string, text string")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, at, state, position = "", 0, START, 0
    for batch in batches:
        of, made = [], []
        for i, (part, role, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            if part == 0:
                audit, at, state, position = text, 0, START, 0
                continue
            own = len(audit[at:]) - len(audit[at:].lstrip("I")) + 1  # inserts before the row, and its own edit
            if not audit[at + own :].strip("I"):
                own = len(audit)  # the last row takes the inserts after it too
            for edit, role_now, text_now, after in edited([(role, text)], audit[at : at + own], state):
                if edit != "D":
                    of.append(i)
                    made.append((position, edit, role_now, text_now))
                    position += 1
                state = after
            at += own
        columns = list(zip(*made, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], ["conv_id", "position", "edit", "role", "text"])


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The query's damage by crc32(conv_id:turn) % 20, nulls being one space; dropped rows stay, with the condition that leaves them out."""
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("_fate"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_fate")
    copies = F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("_copy", F.explode(copies)), F.col("_fate") != 0


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: what `repair` makes of damaged conversations."""
    return repair(*damage(conversations))


#: SQL for the query's rows: one recursion over the whole table that carries the repaired text itself.
ORACLE_SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fate AS (SELECT src.*, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 20 AS f FROM src, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM fate WHERE f <> 0),
ord AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS mark FROM dmg),
flt AS (SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM ord),
grammar(st, initial, nst) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
one(st, nst, cost, edits, piece) AS (SELECT st, nst, 5, 'I', chr(10) || CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END FROM grammar WHERE initial <> 's'),
ins AS (SELECT st, st AS nst, 0 AS cost, '' AS edits, '' AS piece FROM (SELECT DISTINCT st FROM grammar) UNION ALL FROM one
  UNION ALL SELECT a.st, b.nst, 10, 'II', a.piece || b.piece FROM one a JOIN one b ON b.st = a.nst),
ways AS (SELECT conv_id, n, 'D' AS op, st, st AS nst, 2 AS cost, '' AS piece FROM flt, (SELECT DISTINCT st FROM grammar)
  UNION ALL SELECT conv_id, n, 'K', st, nst, CASE WHEN fault = '' THEN 0 ELSE 5 END, chr(10) || role || ':' || text FROM flt JOIN grammar ON initial = left(role, 1) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, n, 'R', st, nst, CASE WHEN fault = '' THEN 1 ELSE 6 END, chr(10) || CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text FROM flt JOIN grammar ON initial <> 's' WHERE fault IN ('', 'truncated')),
walk(conv_id, n, st, b) AS (SELECT DISTINCT conv_id, 0::BIGINT, '', {'cost': 0::BIGINT, 'audit': '', 'made': ''} FROM conversations
  UNION ALL SELECT w.conv_id, any_value(w.n) + 1, y.nst, min({'cost': w.b.cost + i.cost + y.cost, 'audit': w.b.audit || i.edits || y.op, 'made': w.b.made || i.piece || y.piece})
  FROM walk w JOIN ins i ON i.st = w.st JOIN ways y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.n = w.n + 1 AND y.st = i.nst GROUP BY w.conv_id, y.nst),
last AS (SELECT conv_id, max(n) AS n FROM walk GROUP BY conv_id),
best AS (SELECT w.conv_id, min({'cost': w.b.cost + i.cost, 'audit': w.b.audit || i.edits, 'made': w.b.made || i.piece}) AS b
  FROM walk w JOIN last l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.n JOIN ins i ON i.st = w.st AND i.nst IN ('', 'a') GROUP BY w.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM flt GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost AS cost, b.audit AS audit, sha256(b.made[2:]) AS repaired_sha256 FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id"""
