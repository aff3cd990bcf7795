"""Repairs against the shortest path over whole conversations, also when chunks are tiny and conversations cross partitions."""

import hashlib
import heapq
import random
import zlib

import pytest

from quoin.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, seg long"
WHITE = " \t\n\v\f\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _plain(rows):
    """The contract's columns of one conversation's (turn, role, text), in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # cheapest, then ASCII-least: a heap of (cost, audit, row, state, turns)
    heap, done, best = [(0, "", 0, 0, ())], set(), None
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            best = cost, audit, out
            break
        for c, role in (("u", "user"), ("a", "assistant")):
            if (q, c) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[q, c], (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if (q, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[q, role[:1]], (*out, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (q, c) in NEXT:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, NEXT[q, c], (*out, f"{name}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def _wanted(rows):
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    return sorted((repr(c), *_plain(x)) for c, x in by.items())


def _random(seed, n=60, longest=14):
    r = random.Random(seed)
    return [(c or None, r.choice([None, t, t, t, t - 1, -t]), r.choice([None, "", "user", "user", "assistant", "assistant", "system", "tool", "User", "usher"]), r.choice([None, "", " \n", "ok.", "ok. ", "no", "é!\t", "a?", f"t{t}.", f"t{t}", "x "])) for c in range(n) for t in range(r.randint(0, longest))]


def _got(df):
    return sorted((repr(r.conv), *tuple(r)[1:]) for r in df.collect())


@pytest.mark.parametrize(("chunk", "parts"), [(cr.CHUNK, None), (3, 7), (1, 5)])
def test_repairs_equal_the_shortest_path(spark, monkeypatch, chunk, parts):
    df = spark.createDataFrame([(*r, "x", 1) for r in _random(chunk)], SCHEMA)
    if parts:
        monkeypatch.setattr(cr, "partitions_for", lambda df: parts)
    assert _got(cr.repair(df, chunk=chunk)) == _wanted([tuple(r)[:4] for r in df.collect()])


def test_chunks_of_any_size_give_the_same_walk():
    r = random.Random(2)
    for _ in range(300):
        codes = bytes(r.randrange(16) for _ in range(r.randint(1, 30)))
        whole, end, cost = cr.walk(codes, list(cr._END), 0)
        size = r.randint(1, 7)
        pieces = [codes[i : i + size] for i in range(0, len(codes), size)]
        after, ends = list(cr._END), []
        for p in reversed(pieces):
            ends.append(after)
            way = cr.through(p)
            after = [min(way[4 * a + b] + after[b] for b in range(4)) for a in range(4)]
        state, out = 0, []
        for p, e in zip(pieces, reversed(ends), strict=True):
            edits, state, rest = cr.walk(p, e, state)
            out += edits
        assert out == whole and state == end and after[0] == cost


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["ok.", "no", "", f"t{t}."])) for t in range(3000)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows + [(8, 1, "user", "hi."), (None, None, None, None)]], SCHEMA)
    assert _got(cr.repair(df.repartition(9))) == _wanted([tuple(x)[:4] for x in df.collect()])


def test_query_damages_and_keeps_every_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text
        by[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = sorted(tuple(r) for r in cr.op13_conversation_repair(spark, SF).collect())
    assert got == sorted((c, *_plain(x)) for c, x in by.items())


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.repair(df).count() == 0
