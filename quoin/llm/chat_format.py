"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked by score, one conversation per path.

Messages point to their parents. Pointer doubling joins the parent table with itself, so a path of n messages takes about
log2(n) joins; messages on or below a cycle never reach a root and belong to no path. The same tables then enumerate the
ancestors of each leaf. Branches are ranked by the mean score of their messages, then by leaf; the best `keep` per tree stay.
All of this reads ids and scores only. Texts move once, by tree, to where the kept paths of their tree are, in order of
message; a task holds the kept texts of one tree at a time, which is about what it writes for it.

Template: `### ROLE: TEXT</turn>\\n` per turn. In roles and texts a backslash goes before each backslash, `###` and `</turn>`, in
roles also before `: `, so what is written can be read back exactly. The loss mask is a list of code point ranges of the
formatted text: the texts of assistant turns.

Defined results: null role or text counts as empty; a null conversation id is a conversation of its own; a parent that does
not exist makes a root; rows that repeat a message id are turns of one message, in order of role and text; its parent
is the smallest, its score the largest; a message with null id is left out; a null turn of a linear conversation comes
first; a tree without a root gives no row; empty tables give an empty result; other columns are not read. A message
without score counts as 0.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import materialize, table

START, MIDDLE, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|: ")
_READ = re.compile(r"\\(?:\\|###|</turn>|: )|</turn>\n|: ")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|: )")
LEARNED = "assistant"


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = START + _IN_ROLE.sub(lambda m: "\\" + m[0], role) + MIDDLE
        body = _CONTROL.sub(lambda m: "\\" + m[0], text)
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, END
        at += len(head) + len(body) + len(END)
    return "".join(parts), mask


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at, middle = [], 0, None
    for m in _READ.finditer(formatted):
        if m[0] == MIDDLE and middle is None:
            middle = m.start()
        elif m[0] == END:
            turns.append((unescape(formatted[at + len(START) : middle]), unescape(formatted[middle + len(MIDDLE) : m.start()])))
            at, middle = m.end(), None
    return turns


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Linear conversations as reply trees, each turn a reply to the one before: links (tree, id, parent, score) and texts (tree, id, role, text)."""
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(2**63)))
    texts = rows.select(F.col(conv_col).alias("tree"), turn.alias("id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    before = F.lag("id").over(Window.partitionBy("tree").orderBy("id"))
    return texts.select("tree", "id").distinct().select("tree", "id", before.alias("parent"), F.lit(0.0).alias("score")), texts


def _jump(left: DataFrame, table_: DataFrame) -> DataFrame:
    """Rows of left whose `up` has a pointer in table_, with up moved along it."""
    t = table_.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("next"))
    return left.join(t, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")))


def best_paths(links: DataFrame, keep: int = 1) -> DataFrame:
    """links: tree, id, parent, score. One row per message of a kept path: tree, leaf, rank, back (0 at the leaf), id."""
    links = links.where("id IS NOT NULL").groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))
    links = materialize(links)
    known = links.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    ups = links.select("tree", "id", F.col("parent").alias("up")).join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i")), "left_semi")
    parents = links.select(F.col("tree").alias("t"), F.col("parent").alias("i")).where("i IS NOT NULL").distinct()
    leaves = links.select("tree", "id").join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    pointers, total = [materialize(ups)], links.count()
    while not pointers[-1].isEmpty() and 2 ** (len(pointers) - 1) < total:
        pointers.append(materialize(_jump(pointers[-1], pointers[-1]).select("tree", "id", F.col("next").alias("up"))))
    rooted = leaves
    if not pointers[-1].isEmpty():  # those that still point somewhere after as many steps as there are messages are above no root
        last = pointers[-1].select(F.col("tree").alias("t"), F.col("id").alias("i"))
        rooted = leaves.join(last, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")), "left_anti")
    paths = rooted.select("tree", F.col("id").alias("leaf"), F.col("id").alias("up"), F.lit(0).cast("long").alias("back"))
    for k, pointer in enumerate(pointers):
        if k == len(pointers) - 1 and k:
            break  # empty, or only messages that reach no root
        more = _jump(paths, pointer).select("tree", "leaf", F.col("next").alias("up"), (F.col("back") + 2**k).alias("back"))
        paths = materialize(paths.unionByName(more))
    scores = links.select(F.col("tree").alias("t"), F.col("id").alias("i"), "score")
    marks = paths.join(scores, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("i"))).groupBy("tree", "leaf").agg(F.avg("score").alias("s"))
    ranked = marks.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("s").desc(), "leaf"))).where(F.col("rank") <= keep)
    kept = ranked.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "rank")
    return paths.join(kept, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "rank", "back", F.col("up").alias("id"))


_FORMATTED = pa.schema([("tree", pa.int64()), ("rank", pa.int32()), ("formatted", pa.string()), ("loss_mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, id, is_text, leaf, rank, back, role, text) in order of the first three to formatted paths."""
    tree, at, here, turns = None, None, [], {}

    def finished() -> list[dict]:
        out = []
        for (rank, _), rows in sorted(turns.items()):
            text, mask = format_turns([r[1:] for r in sorted(rows)])
            out.append({"tree": tree, "rank": rank, "formatted": text, "loss_mask": [{"start": a, "end": b} for a, b in mask]})
        turns.clear()
        return out

    for batch in batches:
        out = []
        for t, i, is_text, leaf, rank, back, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != tree:
                out += finished()
                tree, at, here = t, None, []
            if i != at:
                at, here = i, []
            if not is_text:
                here.append((leaf, rank, back))
            else:
                for of, r, b in here:
                    turns.setdefault((r, of), []).append((-b, role, text))
        yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)
    yield pa.RecordBatch.from_pylist(finished(), schema=_FORMATTED)


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """paths: as best_paths() gives them; texts: tree, id, role, text. One row per path: tree, rank, formatted, loss_mask (start, end)."""
    steps = paths.select("tree", "id", F.lit(False).alias("is_text"), "leaf", "rank", "back")
    rows = texts.select("tree", "id", F.lit(True).alias("is_text"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = steps.unionByName(rows, allowMissingColumns=True).repartition("tree").sortWithinPartitions("tree", "id", "is_text")
    return both.mapInArrow(_assembled, "tree long, rank int, formatted string, loss_mask array<struct<start:int,end:int>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for tree, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_turns(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return formatted.select("tree", "formatted", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


EXTRA = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    links, texts = conversations(rows.unionByName(extra))
    return digest(format_paths(best_paths(links), texts))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(regexp_replace(role, '(\\|###|</turn>|: )', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
