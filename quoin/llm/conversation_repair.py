"""Repair of conversations: the cheapest edits that give turns the roles `(system? (user assistant)+)?`.

Rows of a conversation are in order of turn (nulls first), then role, then the SHA-256 of the text. A row's first fault
counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the last such character is none of
. ! ?). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty turn 5;
a truncated row that stays costs 5 more. A backward pass gives the cost to go from each row and state of the grammar, a
forward walk takes the ASCII-least edit among those that keep to it, and the turns are built again and hashed.

One conversation may hold a large share of all rows, so no task holds one. Faults come from grouped counts without texts. Narrow
rows (a byte each) are then sorted over ranges of conversation and turn and cut into chunks of at most CHUNK rows. The
costs through a chunk that is not a whole conversation are a 4 x 4 matrix by states; one pass backwards over a
conversation's chunks gives each its costs to go, four numbers at a time. Last, texts stream by conversation and turn
behind the chunk that they are in: what is held is a chunk of bytes, four edits a byte and the running hash. That hash is
over the whole conversation in order, so this one pass can't be split; it keeps no text.

Defined results: a null role or text counts as one space; null turns come first and count for no gap; a null conversation id
is a conversation; rows that repeat a turn or a whole row are rows of their own; an empty table gives an empty result; other
columns are not read. A role's first character decides whether it can stay; roles are compared as they are, without case.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import materialize, partitions_for, table

#: Rows of a conversation that are looked at together.
CHUNK = 1 << 14
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults, in this order.
NONE, BLANK, DUPLICATE, CUT = range(4)
# states: nothing yet, after the system turn, after a user turn, after an assistant turn; a conversation ends in the first or last
_STATES = range(4)
_END = (0, 10, 5, 0)
_INSERTED = (2, 2, 3, 2)
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_CLASSES = "uas?"
_FAR = 1 << 60
_LEGAL = {(2, 0), (0, 1), (1, 0)}


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """By state: the edits of a row as (letter, cost, next state). code: the class of its role and four times its fault."""
    kept, fault = _KEPT.get(_CLASSES[code & 3]), code >> 2
    out = []
    for q in _STATES:
        edits = [("D", DELETE, q)]
        if fault in (NONE, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if kept and kept[q] is not None:
                edits.append(("K", KEEP + extra, kept[q]))
            edits.append(("R", REROLE + extra, _INSERTED[q]))
        out.append(edits)
    return out


_EDITS = [_edits(code) for code in range(16)]


def _before(code: int, after: list[int]) -> list[int]:
    """The cost to go before a row from that after it."""
    g = [min(cost + after[to] for _, cost, to in edits) for edits in _EDITS[code]]
    user, assistant = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return [min(g[0], INSERT + user), min(g[1], INSERT + user), user, assistant]


def through(codes: bytes) -> list[int]:
    """The least cost of the rows for each state before (outer) and after them (inner); _FAR: there is no way."""
    columns = []
    for end in _STATES:
        now = [0 if q == end else _FAR for q in _STATES]
        for code in reversed(codes):
            now = _before(code, now)
        columns.append(now)
    return [min(columns[b][a], _FAR) for a in _STATES for b in _STATES]


def walk(codes: bytes, end: list[int], state: int) -> tuple[list[str], int, int]:
    """The edits of each row, with the insertions before it, from a state on; the state behind the rows, and the cost. end: cost to go behind them."""
    now, steps = list(end), []
    for code in reversed(codes):
        after, now = now, _before(code, now)
        step = []
        for q in _STATES:
            tight = [letter for letter, cost, to in _EDITS[code][q] if cost + after[to] == now[q]]
            step.append(min([*tight, *("I" for _ in (0,) if INSERT + now[_INSERTED[q]] == now[q])], default="?"))
        steps.append(step)
    out, total = [], now[state]
    for code, step in zip(codes, reversed(steps), strict=True):
        piece = ""
        while step[state] == "I":
            piece, state = piece + "I", _INSERTED[state]
        piece += step[state]
        state = next(to for letter, _, to in _EDITS[code][state] if letter == step[state])
        out.append(piece)
    return out, state, total


_ORDER = ["key", "turn", "role", "digest"]
_WHITE = " \t\n\v\f\r"


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """key (a string that is never null), conv, turn, role, text, digest."""
    conv, space = F.col(conv_col), F.lit(" ")
    rows = df.select(F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"), conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _faulty(rows: DataFrame) -> DataFrame:
    """Distinct rows without text: key, turn, role, digest, n (copies), code (of the first copy), later (of the others)."""
    bare = F.rtrim("text", F.lit(_WHITE))
    fault = F.when(bare == "", BLANK).when(~bare.rlike(r"[.!?]$"), CUT).otherwise(NONE)
    narrow = rows.select(*_ORDER, fault.alias("fault")).groupBy(*_ORDER).agg(F.count("*").alias("n"), F.first("fault").alias("fault"))
    narrow = materialize(narrow)
    # nulls first: a null turn is the least
    least = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least")
    repeated = narrow.groupBy("key", "role", "digest").agg(F.count("*").alias("turns"), least).where("turns > 1")
    told = narrow.join(repeated, ["key", "role", "digest"], "left")
    first = F.col("least").isNull() | F.col("turn").eqNullSafe(F.col("least.turn"))
    kind = F.coalesce(F.nullif(F.instr(F.lit(_CLASSES), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    kind = F.when(F.substring("role", 1, 1).isin(*"uas"), kind).otherwise(3)
    again = kind + 4 * F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    return told.select(*_ORDER, "n", F.when(first, kind + 4 * F.col("fault")).otherwise(again).alias("code"), again.alias("later"))


_CHUNKS = "key string, turn long, role string, digest binary, seg long, no long, codes binary, way array<long>, whole boolean"


def _chunked(most: int):
    """Rows (key, turn, role, digest, n, code, later, seg) in order to chunks of at most so many rows. whole: the chunk is surely all of its conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, start, codes, seg, no, cut = None, None, bytearray(), 0, 0, True

        def close(last: bool) -> None:
            nonlocal no
            whole = no == 0 and not cut and not last
            out.append((*start, seg, no, bytes(codes), None if whole else through(codes), whole))
            no += 1

        def flush() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "turn", "role", "digest", "seg", "no", "codes", "way", "whole"])

        first = True
        for batch in batches:
            for *at, n, code, later, seg_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at[0] != key:
                    if codes:
                        close(False)
                    # the partition's first conversation may have begun in the one before
                    key, cut, no, seg = at[0], first, 0, seg_
                    first, codes = False, bytearray()
                i = 0
                while i < n:
                    if len(codes) == most:
                        close(True)
                        codes, cut = bytearray(), True
                    if not codes:
                        start = at
                    take = min(n - i, most - len(codes))
                    codes += bytes([code] + [later] * (take - 1)) if i == 0 else bytes([later]) * take
                    i += take
            if len(out) > 2000:
                yield flush()
                out = []
        if codes:
            close(True)
        if out:
            yield flush()

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, way) by conversation and from its last chunk to its first, each with the cost to go behind it."""
    key, after = None, list(_END)
    for batch in batches:
        end = []
        for k, way in zip(batch.column(0).to_pylist(), batch.column(7).to_pylist(), strict=True):
            if k != key:
                key, after = k, list(_END)
            end.append(after)
            after = [min(way[4 * a + b] + after[b] for b in _STATES) for a in _STATES]
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(end, pa.list_(pa.int64()))], names=["key", "turn", "role", "digest", "seg", "no", "codes", "end"])


class _Conversation:
    """What is known of one conversation while its rows go by."""

    def __init__(self, conv: object) -> None:
        self.conv, self.hash, self.any, self.audit = conv, hashlib.sha256(), False, []
        self.faults, self.illegal, self.cost, self.state, self.last = [0] * 4, 0, 0, 0, None
        self.chunks: deque[tuple[bytes, list[int]]] = deque()
        self.edits: deque[tuple[int, str]] = deque()
        self.started = False
        self.low = self.high = None
        self.turns = 0

    def _turn(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _filled(self) -> None:
        role = "assistant" if _INSERTED[self.state] == 3 else "user"
        self.state = _INSERTED[self.state]
        self._turn(role, "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if not self.edits:
            codes, end = self.chunks.popleft()
            edits, _, cost = walk(codes, end, self.state)
            if not self.started:
                self.cost, self.started = cost, True
            self.edits.extend(zip(codes, edits, strict=True))
            self.audit.append("".join(edits))
        code, edit = self.edits.popleft()
        self.faults[code >> 2] += 1
        if self.last is not None and (self.last, code & 3) not in _LEGAL:
            self.illegal += 1
        self.last = code & 3
        for _ in edit[:-1]:
            self._filled()
        if edit[-1] == "K":
            self.state = _KEPT[_CLASSES[code & 3]][self.state]
            self._turn(role, text)
        elif edit[-1] == "R":
            self.state = _INSERTED[self.state]
            self._turn("assistant" if self.state == 3 else "user", text)

    def result(self) -> tuple:
        while _END[self.state]:
            self.audit.append("I")
            self._filled()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv, turn, role, text, codes, end) in order, those with codes before the rows that they are of."""
    key, now, done, kind = None, None, [], None

    def flush() -> pa.RecordBatch:
        types = [kind, *(t for _, t in _RESULT)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv", *(c for c, _ in _RESULT)])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for k, conv, turn, role, text, codes, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if now is not None:
                    done.append(now.result())
                key, now = k, _Conversation(conv)
            if codes is not None:
                now.chunks.append((codes, end))
            else:
                now.conv = conv
                now.row(turn, role, text)
        if len(done) > 2000:
            yield flush()
            done = []
    if now is not None:
        done.append(now.result())
    if done:
        yield flush()


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col)
    faulty = _faulty(rows)
    parts = partitions_for(faulty)
    ranged = faulty.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).withColumn("seg", F.spark_partition_id().cast("long"))
    chunks = materialize(ranged.mapInArrow(_chunked(chunk), _CHUNKS))
    fields = ["key", "turn", "role", "digest", "seg", "no", "codes"]
    split = chunks.where("NOT whole").select(*fields, "way").repartition(parts, "key").sortWithinPartitions("key", F.desc("seg"), F.desc("no"))
    split = split.mapInArrow(_ended, "key string, turn long, role string, digest binary, seg long, no long, codes binary, `end` array<long>")
    ended = chunks.where("whole").select(*fields, F.array(*map(F.lit, _END)).cast("array<long>").alias("end")).unionByName(split)
    conv = rows.schema["conv"].dataType
    heads = ended.withColumns({"conv": F.lit(None).cast(conv), "text": F.lit(None).cast("string")})
    bodies = rows.withColumns({"seg": F.lit(None).cast("long"), "no": F.lit(None).cast("long"), "codes": F.lit(None).cast("binary"), "end": F.lit(None).cast("array<long>")})
    stream = heads.unionByName(bodies).repartition(partitions_for(rows), "key").sortWithinPartitions(*_ORDER, F.col("seg").asc_nulls_last(), "no")
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([T.StructField("conv", conv), *[T.StructField(c, kinds[t]) for c, t in _RESULT]])
    return stream.select("key", "conv", "turn", "role", "text", "codes", "end").mapInArrow(_repaired, schema)


def damage(df: DataFrame) -> DataFrame:
    """conversations with rows dropped, emptied, cut, repeated or given to the user, by a hash of their conversation and turn."""
    space = F.lit(" ")
    of = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), of.alias("of")).where("of <> 0")
    role = F.when(F.col("of") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("of") == 1, F.lit("")).when(F.col("of") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("of") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations")
    done = repair(damage(df))
    every = df.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c, t in _RESULT if t == pa.int64()}
    out = every.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: Ends with the walk of every conversation at its last row; what is left to insert there follows from the state.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) AS r(b)
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda z: CAST(ord(z) AS BIGINT))),
             lambda c, x: xor(t[CAST((xor(c, x) & 255) + 1 AS INT)], c >> 8)), 4294967295) % 20 AS k
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE k <> 0
), numbered AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), rows_ AS (
  SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS was,
         CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM numbered
), stats AS (
  SELECT g, conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (was IS NOT NULL AND was || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY g, conv_id
), steps AS (
  SELECT g, i, role, text, c, fault IN (0, 3) AS may, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS x FROM rows_
), go(g, i, f) AS (
  SELECT g, n + 1, [0, 10, 5, 0] FROM stats
  UNION ALL
  SELECT g, i, [least(g0, 5 + least(g2, 5 + g3)), least(g1, 5 + least(g2, 5 + g3)), least(g2, 5 + g3), least(g3, 5 + g2)] FROM (
    SELECT s.g, s.i, least(2 + f[1], CASE WHEN may THEN least(1 + x + f[3], CASE c WHEN 's' THEN x + f[2] WHEN 'u' THEN x + f[3] END) END) AS g0,
           least(2 + f[2], CASE WHEN may THEN least(1 + x + f[3], CASE c WHEN 'u' THEN x + f[3] END) END) AS g1,
           least(2 + f[3], CASE WHEN may THEN least(1 + x + f[4], CASE c WHEN 'a' THEN x + f[4] END) END) AS g2,
           least(2 + f[4], CASE WHEN may THEN least(1 + x + f[3], CASE c WHEN 'u' THEN x + f[3] END) END) AS g3
    FROM go JOIN steps s ON s.g = go.g AND s.i = go.i - 1)
), walk(g, i, q, audit, out) AS (
  SELECT g, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM stats
  UNION ALL
  SELECT g, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND c = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, audit || e,
         CASE e WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text) ELSE list_append(out, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, s.c, s.role, s.text, CASE WHEN 2 + b.f[q + 1] = a.f[q + 1] THEN 'D' WHEN 5 + a.f[[3, 3, 4, 3][q + 1]] = a.f[q + 1] THEN 'I'
      WHEN may AND ((c = 's' AND q = 0 AND x + b.f[2] = a.f[1]) OR (c = 'u' AND q <> 2 AND x + b.f[3] = a.f[q + 1]) OR (c = 'a' AND q = 2 AND x + b.f[4] = a.f[3])) THEN 'K' WHEN s.i IS NOT NULL THEN 'R' END AS e
    FROM walk w JOIN go a ON a.g = w.g AND a.i = w.i LEFT JOIN go b ON b.g = w.g AND b.i = w.i + 1 LEFT JOIN steps s ON s.g = w.g AND s.i = w.i)
  WHERE e IS NOT NULL
), ended AS (
  SELECT w.g, w.audit, array_to_string(w.out, chr(10)) AS out FROM walk w JOIN stats t ON t.g = w.g AND w.i = t.n + 1 WHERE w.q IN (0, 3)
), cost AS (
  SELECT g, f[1] AS cost FROM go WHERE i = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.g = stats.g LEFT JOIN cost ON cost.g = stats.g
"""
