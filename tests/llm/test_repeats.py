"""Line and substring deduplication against brute force and their SQL."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quoin.llm import line_dedup, substring_dedup

_LAST = 2**63 - 1


def _windows_gone(rows, w=13):
    first = {}
    for key, text in rows:
        words = (text or "").split()
        for i in range(len(words) - w + 1):
            at = tuple(words[i : i + w])
            first[at] = min(first.get(at, _LAST), _LAST if key is None else key)
    out = []
    for key, text in rows:
        words, gone = (text or "").split(), set()
        for i in range(len(words) - w + 1):
            if first[tuple(words[i : i + w])] < (_LAST if key is None else key):
                gone.update(range(i, i + w))
        out.append((key, len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def _thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def _passages():
    r = random.Random(1)
    long = _thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(12))
    # documents 1 and 2 share 12 words and differ in the 13th, whose polynomial hashes modulo 2**64 agree
    rows = [(1, f"{lead} {long}"), (2, f"{lead} {long.translate(str.maketrans('ab', 'ba'))}"), (None, None), (3, ""), (4, " \t\n"), (None, "a " * 80), (5, "a " * 150)]
    rows += [(r.choice([i + 10, 10]), " ".join(r.choices("xyz", k=r.randint(0, 60)))) for i in range(60)]
    shared = [" ".join(r.choices([f"q{j}" for j in range(50)], k=40)) for _ in range(4)]
    rows += [(100 + i, " ".join(r.choices(shared + [f"u{j}" for j in range(100)], k=8))) for i in range(60)]
    return [*rows, (None, shared[0]), (2000, " ".join(f"v{i}" for i in range(30000))), (2001, " ".join(f"v{i}" for i in range(100, 29000)))]


@pytest.mark.parametrize(("bits", "claims_bytes"), [(64, 1 << 24), (64, 200), (1, 1 << 24)])
def test_windows_equal_brute_force_even_if_hashes_collide(spark, bits, claims_bytes):
    rows = _passages()[: -2 if bits < 64 else None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("key", F.lit("k"))
    got = substring_dedup.relative_parse(df, bits=bits, claims_bytes=claims_bytes).collect()
    want = _windows_gone(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == want
    assert [n for key, _, n, _ in want if key == 2] == [0] and sum(x[2] for x in want) > 400
    texts = dict(rows)
    for r in got:  # every factor is a copy of its reference's words
        for f in r.factors if r.doc_id not in (None, 10) else ():
            assert f.ref < r.doc_id and (f.ref == 10 or f" {' '.join(texts[r.doc_id].split()[f.start : f.start + f.n])} " in f" {' '.join(texts[f.ref].split())} " or f.n > 13)


def test_a_claim_is_parsed_greedily_over_block_boundaries():
    blocks = substring_dedup._Blocks([b"a b c d e", b"c d e f g h"], 3)
    assert blocks.missing(b"a b c d e f g h") == []
    assert blocks.missing(b"a b c x e f g") == [1, 2, 3]


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.relative_parse(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _lined(i):
    return "\n".join(f"{i} {k} " + "x" * 30 for k in range(12))


@pytest.mark.parametrize("rows", [[(1, "a"), (None, "a"), (None, "b")], [(1, "a"), (2, "a"), (2, "b")]])
def test_rows_that_share_an_id_lose_only_what_they_hold(spark, rows):
    df = spark.createDataFrame([(i, _lined(t)) for i, t in rows], "doc_id long, text string")
    df = df.withColumns({"__n_removed": F.lit(7), "row": F.lit("r"), "gone": F.lit(1), "lines": F.lit(2), "n_lines": F.lit(3)})
    got = line_dedup.line_dedup(df, counts=("n_lines", "n_removed"))
    assert sorted(got.columns) == sorted([*df.columns, "n_removed"])
    assert sorted((r.text, r["__n_removed"], r.row, r.n_lines, r.n_removed) for r in got.collect()) == sorted([(_lined("a"), 7, "r", 12, 0), ("", 7, "r", 12, 12), (_lined("b"), 7, "r", 12, 0)])


@pytest.mark.parametrize("line_hash", [F.xxhash64, lambda x: F.length(x).cast("long"), lambda x: F.lit(1).cast("long")])
def test_line_pieces_equal_their_sql_even_if_hashes_collide(spark, monkeypatch, line_hash):
    r = random.Random(2)
    rows = [(i, "\n".join(r.choices([f"line {j} " + "y" * (2 * j) for j in range(25)], k=r.randint(0, 12)))) for i in range(80)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.execute(line_dedup.SQL).fetchall())
    for few in (line_dedup.FEW, 0):
        monkeypatch.setattr(line_dedup, "FEW", few)
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=("n", "m"), line_hash=line_hash).collect()
        assert sorted((x.doc_id, x.n, x.m, hashlib.sha256(x.text.encode()).hexdigest()) for x in got) == want
    assert sum(x[2] for x in want) > 20


def test_short_shared_passages_go_wherever_they_stand(spark):
    """A passage of two to five lines inside otherwise different texts: all its lines go from the later text, nothing else does."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(8))
    shared = [[line() for _ in range(2 + i % 4)] for i in range(40)]
    rows, own = [], {}
    for copy in range(2):
        for i, lines in enumerate(shared):
            before, after = [line() for _ in range(r.randint(0, 9))], [line() for _ in range(r.randint(0, 9))]
            rows.append((copy * 100 + i, "\n".join(before + lines + after)))
            own[copy * 100 + i] = "\n".join(before + (lines if not copy else []) + after)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()} == own


def test_lines_of_null_empty_and_very_long_texts(spark):
    long = "\n".join(f"a line with number {i % 30000} of some length" for i in range(60000))
    rows = [(1, None), (2, ""), (None, None), (3, "\n" * 50), (4, "\n" * 50), (5, long), (6, "one line"), (7, "one line")]
    got = {r.doc_id: (r.text, r.n, r.m) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=("n", "m")).collect() if r.doc_id}
    assert got[1] == (None, 1, 0) and got[2] == ("", 1, 0) and got[3] == got[4] == ("\n" * 50, 51, 0) and got[6] == got[7] == ("one line", 1, 0)
    assert got[5][1:] == (60000, 30000) and got[5][0] == long[: len(got[5][0])]
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0
