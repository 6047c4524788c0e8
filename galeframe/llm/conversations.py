"""Conversation structure repair by products of min-plus matrices.

The roles of a sound conversation are an optional system turn and then pairs of
user and assistant. Four states tell how far that has come; an edit of a turn
(keep, rerole, delete) or an inserted turn leads from one to another. Each turn
becomes a 4x4 matrix of the cheapest edits between states, closed under inserts
after the turn. An element is (cost, audit), the audit being the initials of the
edits; the sum is the smaller one, of equal costs the smaller audit in ASCII, and
the product adds costs and joins audits. The product is associative and keeps the
order: audits of equal cost over the same turns are never each other's beginning,
since an inserted turn always costs something.

Rows are range-partitioned and sorted by conversation and turn, so a conversation
of any length is many tasks. Those that lie within one task are repaired there.
Of all others (the first and last of a task, and any with more than ``HELD_BYTES``
of text) each task gives one matrix; these are multiplied by a tree over the
tasks' numbers, and the edits are handed back to the rows.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, settled, small_batches

INSERT, DELETE, REROLE, UNTRUNCATED = 5, 2, 1, 5
#: Text of one conversation that a task holds at once; a longer one is put together from its parts.
HELD_BYTES = 4 << 20
#: Matrices that are multiplied by one step of the tree over tasks.
FAN_IN = 8
#: Turns whose edits are handed back together.
CHUNK = 1024
#: Products of so few turns are remembered.
REMEMBERED_TURNS = 8

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = r"\x20\x09-\x0D"
#: From a state to the next: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def _less(x: Element, y: Element) -> Element:
    return y if x is None or (y is not None and y < x) else x


def product(x: Matrix, y: Matrix) -> Matrix:
    out: list[Element] = []
    for i in range(4):
        row = x[4 * i : 4 * i + 4]
        for j in range(4):
            best = None
            for k in range(4):
                a, b = row[k], y[4 * k + j]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = _less(best, (a[0] + b[0], a[1] + b[1]))
            out.append(best)
    return tuple(out)


IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def _edits(*kinds) -> Matrix:
    out: list[Element] = [None] * 16
    for cost, letter, steps in kinds:
        for i, j in steps.items():
            out[4 * i + j] = _less(out[4 * i + j], (cost, letter))
    return tuple(out)


def _closure() -> Matrix:
    """Any number of inserted turns; more than three never pay."""
    once = _edits((INSERT, "I", _NEXT["u"]), (INSERT, "I", _NEXT["a"]))
    out, power = IDENTITY, IDENTITY
    for _ in range(3):
        power = product(power, once)
        out = tuple(map(_less, out, power))
    return out


CLOSURE = _closure()


@functools.cache
def turn_matrix(code: str) -> Matrix:
    """The matrix of one turn: ``code`` is the role's initial (or ``-``) in upper case if truncated, or ``x`` if it must go."""
    kinds = [(DELETE, "D", {i: i for i in range(4)})]
    if code != "x":
        extra = UNTRUNCATED if code.isupper() or code == "+" else 0
        kinds += [(extra, "K", _NEXT.get(code.lower(), {}))]
        kinds += [(REROLE + extra, "R", _NEXT[role]) for role in "ua"]
    return product(_edits(*kinds), CLOSURE)


@functools.lru_cache(maxsize=1 << 16)
def _short(codes: str) -> Matrix:
    return segment_matrix(codes)


def segment_matrix(codes: str) -> Matrix:
    """The product of the turns' matrices, by halves."""
    if len(codes) <= 1:
        return turn_matrix(codes) if codes else IDENTITY
    half = len(codes) // 2
    of = _short if len(codes) <= 2 * REMEMBERED_TURNS else segment_matrix
    return product(of(codes[:half]), of(codes[half:]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """The cheapest edits of a whole conversation, inserts before its first turn included."""
    row = [functools.reduce(_less, (None if CLOSURE[k] is None or matrix[4 * k + j] is None else (CLOSURE[k][0] + matrix[4 * k + j][0], CLOSURE[k][1] + matrix[4 * k + j][1]) for k in range(4))) for j in range(4)]
    return functools.reduce(_less, (row[j] for j in _ENDS))


@dataclass
class Report:
    """What is told of a run of turns; runs are added in their order."""

    rows: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_role: str | None = None
    last_role: str | None = None

    def add(self, o: "Report") -> None:
        if o.first_turn is not None:
            self.distinct += o.distinct - (self.last_turn == o.first_turn)
            self.first_turn = o.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = o.last_turn
        if o.rows:
            self.illegal += o.illegal + (self.rows > 0 and self.last_role + o.first_role not in ("su", "ua", "au"))
            self.first_role = o.first_role if self.rows == 0 else self.first_role
            self.last_role = o.last_role
        self.rows, self.blank, self.duplicate, self.truncated = self.rows + o.rows, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct


REPORT = "rows long, first_turn long, last_turn long, distinct long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_REPORT = [f.split(" ")[0] for f in REPORT.split(", ")]


class Repairer:
    """Deals the edits of an audit to turns in their order, and gives the repaired turns."""

    def __init__(self, odd: bool, placed: int = 0):
        self.odd, self.placed = odd, placed

    def _role(self) -> str:
        return "user" if (self.placed - self.odd) % 2 == 0 else "assistant"

    def turns(self, edits: str, rows):
        """(place, role, text, edit) of the repaired turns; ``rows`` are (role, text)."""
        rows = iter(rows)
        for edit in edits:
            if edit == "D":
                next(rows)
                continue
            role, text = (self._role(), "") if edit == "I" else next(rows)
            yield self.placed, self._role() if edit == "R" else role, text, edit
            self.placed += 1


def _is_odd(audit: str) -> bool:
    """Only with a system turn is the number of repaired turns odd."""
    return (len(audit) - audit.count("D")) % 2 == 1


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with injected faults, chosen by ``crc32("conv_id:turn") % 20``; dropped rows stay as such, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("here"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: of rows that repeat another's role and text, those with a later turn; the order within one turn is looked at later."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    told = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.col("conv_id").isNull().cast("string"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    rows = rows.withColumns({"blank": blank, "told": told})
    again = rows.where(F.col("here") & ~F.col("blank")).groupBy("told").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("untimed"), F.count(F.lit(1)).alias("n"))
    again = settled(again.where("n > 1").select(F.col("told").alias("again"), "first", "untimed"))
    again = F.broadcast(again) if again.count() <= MOST_IDS // 2 else again
    later = F.col("again").isNotNull() & F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first")))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), TRUNCATED).otherwise(0)
    return rows.join(again, F.col("told") == F.col("again"), "left").select("conv_id", "turn", "role", "text", "here", fault.alias("fault"))


def _in_order(rows: DataFrame) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return dealt.sortWithinPartitions(*order)


#: What a task tells: repaired turns (``turn``), conversations (``done``), and of conversations that reach beyond it turns as they are (``row``) and a matrix (``part``).
_OUT = f"kind string, part int, row long, place long, role string, text string, edit string, cost long, audit string, costs array<long>, audits array<string>, {REPORT}, parts array<struct<part:int,rows:long>>"


class _Writer:
    """Rows of ``_OUT`` as record batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def put(self, **values) -> None:
        self.rows.append(values)
        self.bytes += len(values.get("text") or "") + 200

    def full(self) -> bool:
        return len(self.rows) >= 1000 or self.bytes >= 1 << 20

    def take(self):
        if self.rows:
            rows, self.rows, self.bytes = self.rows, [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _matrix(matrix: Matrix) -> dict:
    return {"costs": [None if e is None else e[0] for e in matrix], "audits": [None if e is None else e[1] for e in matrix]}


def _of_lists(costs, audits) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits, strict=True))


def _finish(put, conv, report: Report, audit: str, cost: int, rows, turns: bool) -> None:
    """A conversation all of whose turns are at hand."""
    digest = hashlib.sha256()
    for place, role, text, edit in Repairer(_is_odd(audit)).turns(audit, rows):
        if turns:
            put(kind="turn", conv_id=conv, place=place, role=role, text=text, edit=edit)
        digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    put(kind="done", conv_id=conv, cost=cost, audit=audit, text=digest.hexdigest(), **vars(report))


@dataclass
class _Open:
    """The conversation that a task is in."""

    conv: object
    beyond: bool  # it may reach beyond the task, or is too long to hold
    report: Report = field(default_factory=Report)
    codes: list[str] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    bytes: int = 0
    sent: int = 0
    before: tuple | None = None


def _scan(schema: pa.Schema, turns: bool):
    """One pass over the ordered rows of a task."""

    def send(now: _Open, out: _Writer, part: int) -> None:
        for role, text in now.rows:
            out.put(kind="row", conv_id=now.conv, part=part, row=now.sent, role=role, text=text)
            now.sent += 1
        now.rows, now.bytes = [], 0

    def close(now: _Open, out: _Writer, part: int) -> None:
        matrix = segment_matrix("".join(now.codes))
        if now.beyond:
            send(now, out, part)
            out.put(kind="part", conv_id=now.conv, part=part, parts=[{"part": part, "rows": now.report.rows}], **_matrix(matrix), **vars(now.report))
        else:
            cost, audit = cheapest(matrix)
            _finish(out.put, now.conv, now.report, audit, cost, now.rows, turns)

    def run(batches):
        part = TaskContext.get().partitionId()
        out, now = _Writer(schema), None
        for batch in batches:
            for conv, turn, role, text, here, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(now, out, part)
                    now = _Open(conv, beyond=now is None)
                if not here:
                    continue
                if fault != BLANK and now.before == (turn, role, text):
                    fault = DUPLICATE
                now.before = (turn, role, text)
                now.report.add(Report(1, turn, turn, int(turn is not None), fault == BLANK, fault == DUPLICATE, fault == TRUNCATED, 0, role[:1], role[:1]))
                code = "x" if fault in (BLANK, DUPLICATE) else role[:1] if role[:1] in ("s", "u", "a") else "-"
                now.codes.append({"-": "+"}.get(code, code.upper()) if fault == TRUNCATED else code)
                now.rows.append((role, text))
                now.bytes += len(text)
                if now.bytes > HELD_BYTES or len(now.rows) > HELD_BYTES // 64:
                    now.beyond = True
                if now.beyond and (now.bytes > 1 << 18 or len(now.rows) >= CHUNK):
                    send(now, out, part)
                if out.full():
                    yield from out.take()
        if now is not None:
            now.beyond = True
            close(now, out, part)
        yield from out.take()

    return run


def _multiply(schema: pa.Schema):
    """Neighbouring matrices of a conversation, one after another, as one."""

    def run(batches):
        out, key, now = _Writer(schema), None, None

        def close():
            if now is not None:
                out.put(kind="part", conv_id=key[0], part=key[1], parts=now[2], **_matrix(now[0]), **vars(now[1]))

        for batch in batches:
            for r in batch.to_pylist():
                at = (r["conv_id"], r["part"] // FAN_IN)
                report = Report(*(r[c] for c in _REPORT))
                matrix = _of_lists(r["costs"], r["audits"])
                if now is None or at != key:
                    close()
                    key, now = at, (matrix, report, r["parts"])
                else:
                    now[1].add(report)
                    now = (product(now[0], matrix), now[1], now[2] + r["parts"])
                if out.full():
                    yield from out.take()
        close()
        yield from out.take()

    return run


#: The edits of ``CHUNK`` turns (``edit``), before the turns themselves; the last of a conversation tells its report.
_EDITS = f"part int, chunk long, row long, role string, text string, edit string, placed long, odd boolean, cost long, audit string, {REPORT}"


def _hand_back(schema: pa.Schema):
    """From the whole product of a conversation to the edits of each chunk of its rows."""

    def run(batches):
        out = _Writer(schema)
        for batch in batches:
            for r in batch.to_pylist():
                cost, audit = cheapest(_of_lists(r["costs"], r["audits"]))
                odd, at, placed = _is_odd(audit), 0, 0
                chunks = [(p["part"], c, min(CHUNK, p["rows"] - c * CHUNK)) for p in r["parts"] for c in range(-(-p["rows"] // CHUNK))] or [(r["parts"][0]["part"], 0, 0)]
                for number, (part, chunk, rows) in enumerate(chunks):
                    begin = at
                    while rows and at < len(audit):
                        rows -= audit[at] != "I"
                        at += 1
                    last = number + 1 == len(chunks)
                    at = len(audit) if last else at
                    told = {"cost": cost, "audit": audit, **{c: r[c] for c in _REPORT}} if last else {}
                    out.put(conv_id=r["conv_id"], part=part, chunk=chunk, row=-1, edit=audit[begin:at], placed=placed, odd=odd, **told)
                    placed += at - begin - audit.count("D", begin, at)
                    if out.full():
                        yield from out.take()
        yield from out.take()

    return run


def _apply(schema: pa.Schema, turns: bool):
    """The repaired turns of conversations whose edits and rows come in order, one row at a time."""

    def run(batches):
        out = _Writer(schema)
        digest, repairer, edits, at, told = None, None, "", 0, None

        def give(conv, row):
            """The turns up to, and of, the given row; without a row all that is left."""
            nonlocal at
            end = at
            while end < len(edits) and edits[end] == "I":
                end += 1
            end += row is not None
            for place, role, text, edit in repairer.turns(edits[at:end], [] if row is None else [row]):
                if turns:
                    out.put(kind="turn", conv_id=conv, place=place, role=role, text=text, edit=edit)
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            at = end

        def end_of_chunk(conv):
            if repairer is not None:
                give(conv, None)
                if told is not None:
                    out.put(kind="done", conv_id=conv, text=digest.hexdigest(), **told)

        conv = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] < 0:
                    end_of_chunk(conv)
                    if repairer is None or told is not None:  # the conversation before has ended
                        digest = hashlib.sha256()
                    conv, edits, at = r["conv_id"], r["edit"], 0
                    repairer = Repairer(r["odd"], r["placed"])
                    told = {c: r[c] for c in ("cost", "audit", *_REPORT)} if r["cost"] is not None else None
                else:
                    give(conv, (r["role"], r["text"]))
                if out.full():
                    yield from out.take()
        end_of_chunk(conv)
        yield from out.take()

    return run


def _schema(rows: DataFrame, fields: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    named = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {fields}"
    return named, to_arrow_schema(StructType.fromDDL(named))


def _repaired(rows: DataFrame, turns: bool) -> DataFrame:
    """Rows ``done``, a report of each conversation with the hash of its repaired turns, and with ``turns`` the turns too."""
    small_batches(rows.sparkSession)
    named, schema = _schema(rows, _OUT)
    ordered = _in_order(_faults(rows))
    first = settled(ordered.mapInArrow(_scan(schema, turns), named))
    parts = first.where("kind = 'part'")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        key = F.floor(F.col("part") / FAN_IN).cast("int")
        parts = parts.repartition("conv_id", key).sortWithinPartitions("conv_id", "part").mapInArrow(_multiply(schema), named)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
    edit_named, edit_schema = _schema(rows, _EDITS)
    edits = parts.mapInArrow(_hand_back(edit_schema), edit_named)
    held = first.where("kind = 'row'").select("conv_id", "part", F.floor(F.col("row") / CHUNK).alias("chunk"), "row", "role", "text")
    mixed = edits.unionByName(held, allowMissingColumns=True)
    long_ones = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "row").mapInArrow(_apply(schema, turns), named)
    return first.where("kind IN ('done', 'turn')").unionByName(long_ones)


def _turns_of(conversations: DataFrame) -> DataFrame:
    """The rows with nulls as one space and, where it is not there, ``here``."""
    here = F.col("here") if "here" in conversations.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), here.alias("here"))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, in their places.

    ``edit`` is K for kept, R for reroled and I for inserted turns. Further as :func:`report`.
    """
    return _repaired(_turns_of(conversations), True).where("kind = 'turn'").select("conv_id", "place", "role", "text", "edit")


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by ``turn``, nulls first; rows that tie in it by role and
    text, so rows that are repeated stand together and all but the first are
    duplicates. A null role or text is one space, hence without a place in any
    conversation or blank. A null ``conv_id`` is a conversation like others. A
    conversation all of whose turns are gone has zeros, an empty audit and the
    hash of nothing; an empty table has no rows. Further columns, whatever their
    names, are not read, but for ``here`` of :func:`damage`, which marks rows that
    only name their conversation. Texts are read whole and held up to
    ``HELD_BYTES`` a conversation, or one turn. The audit is one value of the
    result, and its length, times eleven, is what the product of a conversation
    takes. SHA-256 has to read a conversation from end to end, so its repaired
    turns pass, one at a time, through one task.
    """
    rows = _repaired(_turns_of(conversations), False).where("kind = 'done'")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"), F.lit(0))
    return rows.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("text").alias("repaired_sha256"))
