"""Operator 11, conversation structure repair: the cheapest edits that give each conversation roles like `system? (user assistant)+`.

Spark damages, numbers and flags the rows, marks repeated ones by a grouped minimum and brings each conversation's rows together in order of
turn. A task then runs Viterbi over them as a stream. The states are what the output ends with: nothing, a system row, a user row, an assistant row.
Survivors are leaves of a tree of backpointers with reference counts; a branch that no survivor needs any more frees itself, and as soon as
the root has one child, that edit is final and leaves the tree. A state that another one beats whatever comes is no survivor, so that survivors
meet. Ties go to the least complete suffix of edits: of any two survivors it is known which suffix is less, or by which insertions one continues
the other, and each row refines that order, so that complete suffixes of any length are compared at a constant cost. Steps of the same relative
costs, order and kind of row are the same, so they are worked out once for each worker.

Edits: Keep 0, Rerole 1 (to user or assistant), Delete 2 (a must for blank and repeated rows), Insert an empty row 5; a truncated row that isn't deleted 5.

Memory: a conversation streams through its task, in no case is it gathered. A digest of the repaired text is sequential, so the rows of one conversation
pass through one task. Texts of unresolved edits above HELD_CHARS go into one running digest for each of the at most four survivors (`audits`);
`repaired`, which returns rows, holds those that are unresolved. The edits' initials are a column, so those are held.

Edge cases: nulls are one space (a null turn comes first and counts for no gap; a null conv_id is a conversation); rows with equal turn go by role, then
by the SHA-256 of role and text; a role without a character is never kept; a conversation without rows has zeros, an empty audit and the digest of
an empty text; an empty table gives none; columns besides conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common, textbytes

#: Costs of edits, and of leaving a truncated row.
RENAME, DROP, ADD, UNFINISHED = 1, 2, 5, 5
#: Characters of unresolved texts that a conversation holds at most before they go into its survivors' digests.
HELD_CHARS = 4 << 20
#: What the output ends with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_SPACE = " \t\n\x0b\f\r"
_PRESENT, _MARK, _ROW = range(3)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows, nulls as one space, damaged by the checksum of `conv_id:turn`; rows that it drops stay with `dropped`, so that no conversation is lost."""
    common.require(conversations, "conv_id", "turn", "role", "text")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _arranged(rows: DataFrame) -> DataFrame:
    """The rows of each conversation side by side in order: kind, conv_id, turn, role, text, finished, blank. Before a row that stood in an earlier turn comes a mark."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), dropped.alias("dropped"))
    own = own.withColumn("digest", F.when(~F.col("dropped"), _digest(F.col("role"), F.col("text"))))
    narrow = own.where("not dropped").select("conv_id", "digest", "turn", "role").distinct()
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = narrow.groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    again = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))).where(turn > F.col("first"))
    last = F.rtrim(F.col("text"), F.lit(_SPACE))
    words = own.select(
        F.when(F.col("dropped"), F.lit(_PRESENT)).otherwise(F.lit(_ROW)).alias("kind"), "conv_id", F.when(~F.col("dropped"), F.col("turn")).alias("turn"), F.when(~F.col("dropped"), F.col("role")).alias("role"),
        "digest", F.when(~F.col("dropped"), F.col("text")).alias("text"), F.right(last, F.lit(1)).isin(".", "!", "?").alias("finished"), (last == "").alias("blank"),
    )
    marks = again.select(F.lit(_MARK).alias("kind"), "conv_id", "turn", "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(False).alias("finished"), F.lit(False).alias("blank"))
    return words.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "kind")


class _Edit:
    """A node of the tree. refs: its children, and 1 for each survivor that ends in it. A top (without `up`) has what became final: digest, letters, last."""

    __slots__ = ("final", "letter", "refs", "role", "text", "up")

    def __init__(self, up: _Edit | None, letter: str, role: str, text: str) -> None:
        self.up, self.letter, self.role, self.text, self.refs, self.final = up, letter, role, text, 0, None
        if up is not None:
            up.refs += 1


#: A survivor: its cost above the cheapest one's, the rank of its suffix, and the insertions by which it continues the suffix of the same rank without any.
Survivor = tuple[int, int, str]
Signature = tuple[Survivor | None, ...]


def _inserted(best: dict[int, tuple], order: list[tuple[int, int]]) -> None:
    """Lower `best` (state to cost, rank, suffix, source, letter, insertions) by insertions from one state to another."""
    for a, b in order:
        if a in best:
            cost, rank, suffix, source, letter, more = best[a]
            new = (cost + ADD, rank, suffix + "I", source, letter, more + 1)
            if b not in best or new[:3] < best[b][:3]:
                best[b] = new


_INSERTIONS = [(NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)]


def _settled(best: dict[int, tuple]) -> tuple[Signature, list[tuple[int, int, str, int]], int]:
    """The next signature, the moves (state, source, letter, insertions) and the cost of the cheapest survivor."""
    # what an assistant row at the end allows, nothing allows too but for a kept system row, which deleted costs DROP more; all that follows a system row may follow either
    a, nothing, system = best.get(ASSISTANT), best.get(NOTHING), best.get(SYSTEM)
    if a and nothing and a[0] + DROP < nothing[0]:
        del best[NOTHING]
    if system and (a and a[0] < system[0] or nothing and nothing[0] < system[0]):
        del best[SYSTEM]
    base = min(x[0] for x in best.values())
    out: list[Survivor | None] = [None] * 4
    group, last, first = -1, None, ""
    for state in sorted(best, key=lambda s: best[s][1:3]):
        cost, rank, suffix = best[state][:3]
        if last is None or rank != last or not suffix.startswith(first):
            group, last, first = group + 1, rank, suffix
        out[state] = (cost - base, group, suffix[len(first) :])
    return tuple(out), [(state, x[3], x[4], x[5]) for state, x in best.items()], base


@lru_cache(maxsize=1 << 16)
def _step(now: Signature, initial: str, must: bool, unfinished: bool) -> tuple[Signature, list[tuple[int, int, str, int]], int]:
    """One row. initial: s, u, a or another."""
    best: dict[int, tuple] = {}

    def offer(target: int, source: int, letter: str, cost: int) -> None:
        own, rank, tail = now[source]
        new = (own + cost, rank, tail + letter, source, letter, 0)
        if target not in best or new[:3] < best[target][:3]:
            best[target] = new

    left = UNFINISHED if unfinished else 0
    for state in (s for s in range(4) if now[s] is not None):
        offer(state, state, "D", DROP)
        if must:
            continue
        wanted, target = ("a", ASSISTANT) if state == USER else ("u", USER)
        if initial == wanted:
            offer(target, state, "K", left)
        else:
            offer(target, state, "R", RENAME + left)
        if initial == "s" and state == NOTHING:
            offer(SYSTEM, state, "K", left)
    _inserted(best, _INSERTIONS)
    return _settled(best)


@lru_cache(maxsize=1)
def _start() -> tuple[Signature, list[tuple[int, int, str, int]], int]:
    best = {NOTHING: (0, 0, "", NOTHING, "", 0)}
    _inserted(best, _INSERTIONS)
    return _settled(best)


class _Final:
    """What is final of a conversation: the edits' initials, and the digest of its rows or the rows."""

    __slots__ = ("letters", "rows", "sha", "started")

    def __init__(self, rows: list | None) -> None:
        self.letters, self.rows, self.sha, self.started = [], rows, hashlib.sha256(), False

    def add(self, e: _Edit) -> None:
        self.letters.append(e.letter)
        if self.rows is not None:
            self.rows.append((e.letter, e.role, e.text))
        elif e.letter != "D":
            if self.started:
                self.sha.update(b"\n")
            self.sha.update(f"{e.role}:{e.text}".encode())
            self.started = True

    def copy(self) -> _Final:
        out = _Final(None)
        out.letters, out.sha, out.started = list(self.letters), self.sha.copy(), self.started
        return out


class Repairer:
    """Viterbi over one conversation's rows. rows: a list that final edits go to; None: they go to a digest."""

    def __init__(self, rows: list | None = None, held: int = HELD_CHARS) -> None:
        self.limit, self.held, self.cost, self.tops = held, 0, 0, 1
        self.root = _Edit(None, "", "", "")
        self.root.final = _Final(rows)
        self.root.refs = 1
        self.ends: dict[int, _Edit] = {NOTHING: self.root}
        self._move(_start(), "", "")

    def row(self, role: str, text: str, must: bool, unfinished: bool) -> None:
        initial = role[:1]
        self._move(_step(self.now, initial if initial in ("s", "u", "a") else "", must, unfinished), role, text)

    def _move(self, step: tuple, role: str, text: str) -> None:
        self.now, moves, cost = step
        self.cost += cost
        made: dict[tuple, _Edit] = {}
        ends: dict[int, _Edit] = {}
        for state, source, letter, more in moves:
            node, state_now = self.ends[source], source
            key = (source, letter)
            if letter:
                if key not in made:
                    told = ("assistant" if source == USER else "user") if letter == "R" else role
                    made[key] = _Edit(node, letter, told, text if letter != "D" else "")
                    self.held += len(made[key].text)
                node = made[key]
                if letter != "D":
                    state_now = SYSTEM if letter == "K" and role[:1] == "s" and source == NOTHING else ASSISTANT if source == USER else USER
            for k in range(more):
                key = (source, letter, k)
                if key not in made:
                    made[key] = _Edit(node, "I", "assistant" if state_now == USER else "user", "")
                node = made[key]
                state_now = ASSISTANT if state_now == USER else USER
            node.refs += 1
            ends[state] = node
        old, self.ends = self.ends, ends
        for node in old.values():
            self._released(node)
        if self.tops == 1:
            self._emit()
        if self.held > self.limit and (self.root.final.rows is None):
            self._fold()

    def _released(self, node: _Edit) -> None:
        node.refs -= 1
        while node.refs == 0:
            self.held -= len(node.text)
            if node.up is None:
                self.tops -= 1
                return
            node = node.up
            node.refs -= 1

    def _path(self, node: _Edit) -> tuple[_Edit, list[_Edit]]:
        path = []
        while node.up is not None:
            path.append(node)
            node = node.up
        return node, path[::-1]

    def _emit(self) -> None:
        """All edits that every survivor has become final."""
        if self.root.refs == 0:  # another top is left
            self.root = self._path(next(iter(self.ends.values())))[0]
        if self.root.refs > 1:
            return
        root = self.root
        for node in self._path(next(iter(self.ends.values())))[1]:
            root.final.add(node)
            self.held -= len(node.text)
            node.final, node.up, node.text = root.final, None, ""
            root = node
            if node.refs > 1:
                break
        self.root = root

    def _fold(self) -> None:
        """Each survivor gets what is final of its own, so that no text has to be held."""
        ends: dict[int, _Edit] = {}
        for state, node in self.ends.items():
            top, path = self._path(node)
            own = _Edit(None, "", "", "")
            own.final, own.refs = top.final.copy(), 1
            for e in path:
                own.final.add(e)
            ends[state] = own
        self.ends, self.held, self.tops, self.root = ends, 0, len(ends), next(iter(ends.values()))

    def end(self) -> tuple[int, _Final]:
        """The cost and all edits of the cheapest survivor, of equals the one with the least edits."""
        state = min((s for s in (NOTHING, ASSISTANT) if self.now[s] is not None), key=lambda s: self.now[s])
        top, path = self._path(self.ends[state])
        for e in path:
            top.final.add(e)
        return self.cost + self.now[state][0], top.final


class _Counts:
    """Faults of a conversation's rows, in order, and its repair."""

    __slots__ = ("blank", "duplicate", "illegal", "last", "mark", "most", "least", "repair", "role", "turn", "truncated", "turns")

    def __init__(self, rows: list | None, held: int) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.role = self.mark = self.last = self.turn = self.most = self.least = None
        self.repair = Repairer(rows, held)

    def take(self, turn: object, role: str, text: str, digest: bytes, finished: bool, blank: bool) -> None:
        again = (turn, digest) in (self.mark, self.last)
        self.last = (turn, digest)
        self.blank += blank
        self.duplicate += again and not blank
        unfinished = not (blank or again or finished)
        self.truncated += unfinished
        if self.role is not None:
            self.illegal += self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        self.repair.row(role, text, bool(blank or again), unfinished)

    def gaps(self) -> int:
        return int(self.most - self.least) + 1 - self.turns if self.turns else 0


def _streamed(batches: Iterator[pa.RecordBatch], make: object) -> Iterator[tuple[object, _Counts | None]]:
    """Each conversation's id and counts once it is over; (None, None) where a batch ends. Equal ids stand side by side."""
    nobody = object()
    conv, now = nobody, None
    for b in batches:
        for kind, c, turn, role, digest, text, finished, blank in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if conv is nobody or c != conv:
                if now is not None:
                    yield conv, now
                conv, now = c, make()
            if kind == _MARK:
                now.mark = (turn, digest)
            elif kind == _ROW:
                now.take(turn, role, text, digest, finished, blank)
        yield None, None
    if now is not None:
        yield conv, now


def audits(rows: DataFrame, held: int = HELD_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id, turn, role, text and perhaps dropped)."""
    kind = rows.schema["conv_id"].dataType
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([T.StructField("conv_id", kind), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    kinds = [to_arrow_type(kind), *[pa.int64()] * len(longs), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

        for conv, c in _streamed(textbytes.released(batches), lambda: _Counts(None, held)):
            if c is None:
                yield flush()
                continue
            cost, final = c.repair.end()
            out.append((conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(final.letters), final.sha.hexdigest()))
        yield flush()

    return _arranged(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R, D or I), role, text of each edit of each conversation; a deleted row's role and its text are null."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, c in _streamed(textbytes.released(batches), lambda: _Counts([], 0)):
            if c is None:
                continue
            final = c.repair.end()[1]
            for first in range(0, len(final.rows), 1_000):
                part = final.rows[first : first + 1_000]
                gone = lambda i: [None if x[0] == "D" else x[i] for x in part]  # noqa: B023, E731
                columns = [[conv] * len(part), list(range(first, first + len(part))), [x[0] for x in part], gone(1), gone(2)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

    return _arranged(rows).mapInArrow(run, schema)


def damaged_audits(conversations: DataFrame) -> DataFrame:
    return audits(damage(conversations))


AUDITS_SQL = rf"""
WITH RECURSIVE {common.CRC_TABLE_SQL},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {common.crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM keyed, (VALUES (0), (1)) AS v(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM damaged),
flagged AS (
  SELECT *, left(role, 1) AS i, own = '' AS blank, own <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
ready AS (
  SELECT *, NOT blank AND NOT again AND right(own, 1) NOT IN ('.', '!', '?') AS cut, blank OR again AS must FROM flagged),
ids AS (SELECT conv_id FROM conversations GROUP BY conv_id),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM ready GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS e, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
    {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS u, {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a FROM ids
  UNION ALL
  SELECT conv_id, pos, e, s, u, list_min(list_filter([a1, {{'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}}], lambda x: x.c IS NOT NULL)) FROM (
    SELECT conv_id, pos, e, s, a1, list_min(list_filter([u1, {{'c': e.c + 5, 'a': e.a || 'I', 't': e.t || chr(10) || 'user:'}}, {{'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'}},
      {{'c': a1.c + 5, 'a': a1.a || 'I', 't': a1.t || chr(10) || 'user:'}}], lambda x: x.c IS NOT NULL)) AS u FROM (
      SELECT w.conv_id, r.pos, {{'c': w.e.c + 2, 'a': w.e.a || 'D', 't': w.e.t}} AS e,
        list_min(list_filter([{{'c': w.s.c + 2, 'a': w.s.a || 'D', 't': w.s.t}}, CASE WHEN NOT r.must AND r.i = 's' THEN {{'c': w.e.c + x5, 'a': w.e.a || 'K', 't': w.e.t || chr(10) || r.role || ':' || r.text}} END], lambda x: x.c IS NOT NULL)) AS s,
        list_min(list_filter([{{'c': w.u.c + 2, 'a': w.u.a || 'D', 't': w.u.t}}] || list_transform(CASE WHEN r.must THEN [] ELSE [w.e, w.s, w.a] END, lambda y: 
          CASE WHEN r.i = 'u' THEN {{'c': y.c + x5, 'a': y.a || 'K', 't': y.t || chr(10) || r.role || ':' || r.text}} ELSE {{'c': y.c + x5 + 1, 'a': y.a || 'R', 't': y.t || chr(10) || 'user:' || r.text}} END), lambda x: x.c IS NOT NULL)) AS u1,
        list_min(list_filter([{{'c': w.a.c + 2, 'a': w.a.a || 'D', 't': w.a.t}}] || list_transform(CASE WHEN r.must THEN [] ELSE [w.u] END, lambda y: 
          CASE WHEN r.i = 'a' THEN {{'c': y.c + x5, 'a': y.a || 'K', 't': y.t || chr(10) || r.role || ':' || r.text}} ELSE {{'c': y.c + x5 + 1, 'a': y.a || 'R', 't': y.t || chr(10) || 'assistant:' || r.text}} END), lambda x: x.c IS NOT NULL)) AS a1
      FROM walk w JOIN (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS x5 FROM ready) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1))),
best AS (SELECT w.conv_id, list_min([w.e, w.a]) AS b FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.pos = coalesce(c.n, 0))
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.b.c AS cost, b.b.a AS audit, sha256(b.b.t[2:]) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
