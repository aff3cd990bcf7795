"""Contexts, bootstrapping and SQL of personal data spans."""

import random
import re

import duckdb
import pytest

from quoin.llm import pii

SF = "/root/testdata/sf0.001"


def _found(spark, texts, **settings):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [f.what for f in r.found] for r in pii.find_pii(df, **settings).collect() if r.found}


def test_a_place_has_one_context_for_seeds_and_candidates(spark):
    seeds = [f"order 1234{i:04d} to user{i}@ex.org" for i in range(20)]
    long = "ab-" + "c" * 60 + "-4711"
    assert _found(spark, [*seeds, "order 12349999 to jdoe-4711x", "order now to jdoe-4711x", f"order 12349999 to {long}!", "order 12349999 to " + "q" * 50 + "1234,"]) == {20: ["jdoe-4711x"], 22: [long], 23: ["q" * 50 + "1234"]}


def test_identifiers_written_in_groups_are_found(spark):
    seeds = [f"my phone +49 171 55538{i:02d} ok" for i in range(20)]
    assert _found(spark, [*seeds, "my phone 0171 555 3824, ok", "My  Phone\n0171-555 3825.", "a phone 0171 555 3824", "my phone ab12"]) == {20: ["0171 555 3824"], 21: ["0171-555 3825"], 23: ["ab12"]}


def test_long_context_words_do_not_merge(spark):
    seeds = [f"{'w' * 91} to user{i}@ex.org" for i in range(20)]
    assert _found(spark, [*seeds, "w" * 80 + " to jdoe-4711x", "w" * 91 + " to jdoe-4711x"]) == {21: ["jdoe-4711x"]}


@pytest.mark.parametrize("text", ["1 1 1 " * 20000 + "1a", "5 " + "-" * 100000 + "7", "x" * 200000 + " a b 7", "1.1.1.1 " * 20000, "u1@ex.org " * 20000])
def test_long_texts_take_no_long_time(spark, text):
    rows = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 1 and len(rows[0].base) == (20000 if text[:2] in ("1.", "u1") else 0)


def _brute(texts, min_seeds=5, half=0.5, confidence=0.8):
    """Bootstrap over texts in which every mention is a single word and the only base kind is email."""
    mentions, norm = [], lambda w: re.sub("[0-9]", "0", w.lower())
    for d, text in enumerate(texts):
        words = text.split()
        for i, w in enumerate(words):
            context = " ".join(norm(x) for x in words[max(0, i - 2) : i])
            if re.search("[0-9@]", w) and re.search("[a-z]", context):
                mentions.append((d, context, w, bool(re.fullmatch(r"[a-z0-9]+@[a-z]+\.[a-z]+", w))))
    graph = {}
    for _, c, w, seed in mentions:
        graph.setdefault(c, {})[w] = seed
    graph = {c: x for c, x in graph.items() if sum(x.values()) >= min_seeds}
    score = {w: 1.0 if s else 0.0 for x in graph.values() for w, s in x.items()}
    while True:
        sure = {c: sum(score[w] for w in x) / (len(x) + 1) for c, x in graph.items()}
        new = dict(score)
        for w in score:
            if not any(x.get(w) for x in graph.values()):
                miss = 1.0
                for c, x in graph.items():
                    if w in x and sure[c] >= half:
                        miss *= max(1 - sure[c], 1e-12)
                new[w] = 1 - miss
        if max(abs(new[w] - score[w]) for w in score) <= pii.SETTLED:
            trusted = {c for c in graph if sure[c] >= confidence}
            return sorted((d, w) for d, c, w, seed in mentions if not seed and c in trusted)
        score = new


def test_bootstrap_equals_brute_force(spark):
    r = random.Random(6)
    texts = []
    for _ in range(400):
        lead = r.choice(["write to", "mail me", "login as", "see page", "version of", "id is"])
        seed_share = {"write to": 0.9, "mail me": 0.7, "login as": 0.55, "see page": 0.1, "version of": 0.0, "id is": 0.95}[lead]
        what = f"user{r.randrange(80)}@ex.org" if r.random() < seed_share else f"k{r.randrange(25)}"
        texts.append(f"{r.choice(['so', 'well then', ''])} {lead} {what} and so on")
    want = _brute(texts)
    got = sorted((d, w) for d, ws in _found(spark, texts).items() for w in ws)
    assert got == want and 10 < len(want) < 300


def test_base_spans_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = pii.op7_pii(spark, SF)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({pii.SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
