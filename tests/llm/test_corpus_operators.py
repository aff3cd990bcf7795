import hashlib
import re

import pytest

from quoin.llm import chat_format, exact_dedup, pii, simhash_dedup, url_filter

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _base(text):
    out = []
    for i, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and _luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), i, m.end()))
    return sorted(out)


TEXTS = [None, "", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 1.2.3.999 a@b.c.", "x+1 (743) 555-3824, 4785380592391139 4785 3805 9239 1139 é😀 q@w.e", "9" * 5000 + " " + "a" * 5000 + "@", "0010.0.0.0255 1.1.1.1"]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: [(b.start, b.kind, b.end) for b in r.base] for r in pii.find_pii(df).collect()}
    assert got == {i: _base(t) for i, t in enumerate(TEXTS)}


def test_contexts_of_seeds_find_an_unseen_identifier(spark):
    rows = [(i, f"bla write to login user{i}@ex.org now") for i in range(20)] + [(100, "é😀 bla write to login jdoe-4711x, ok"), (101, "version of 12345-678x")]
    got = {r.doc_id: [(f.start, f.end, f.what) for f in r.found] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [(22, 32, "jdoe-4711x")] and got[101] == [] and got[3] == []


def test_pii_of_an_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string, row string")).count() == 0


def test_blocks_reach_aliases_and_allows_protect_what_they_name(spark):
    link = '<head><link rel="canonical" href="{}"></head>'
    rows = [
        (1, "http://A.com/en/1", None), (2, "https://b.info/x#f", link.format("http://a.com/en/1")), (3, "http://c.info/y", link.format("//b.info/x")),
        (4, "http://d.info/z", link.format("http://example.com/en/7")), (5, "http://e.info/", link.format("http://d.info/z")), (6, "http://f.info/a/b", link.format("../q")),
        (7, None, link.format("http://a.com/en/1")), (8, "no scheme", ""), (9, "http://example.com/en/71", link.format("http://a.com/en/1")), (1, "http://A.com/en/1", None),
        (10, "http://g.info/", "<meta http-equiv='refresh' content='0; url=http://h.org/es/'>"), (11, "http://sub.net/de/8", None), (12, "http://x.example.net/de/8?q", None),
    ]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({"html": "node"}), html_col="node").collect()
    blocked = {r.page_id for r in got if r.verdict == "block"}
    # pages 1, 2, 3 and 9 are one component: a rule blocks 1 and allows 9, which does not clear the others
    assert blocked == {1, 2, 3, 10, 12} and len(got) == 13


def test_aliases_equal_brute_force(spark):
    import random

    r = random.Random(8)
    hosts = ["a.com", "example.com", "x.net", "y.example.net", "z.org", "q.info", "r.info", "s.info"]
    urls = [f"http://{h}/{p}" for h in hosts for p in ("en/7", "en/1", "de/8", "de/1", "es/", "it/1", "it/2")]
    pages = [(i, u, f'<link href="{r.choice(urls)}" rel=canonical>' if r.random() < 0.35 else r.choice([None, "", "<p>"])) for i, u in enumerate(urls * 2)]
    moves = [(r.choice(urls), r.choice(urls)) for _ in range(6)]
    parent = {u: u for u in urls}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in [(u, re.search('href="([^"]*)', h)[1]) for _, u, h in pages if h and "href" in h] + moves:
        parent[root(a)] = root(b)

    def own(u):
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    bad = {root(u) for u in urls if own(u) == "block"}
    want = sorted((i, own(u) or ("block" if root(u) in bad else "allow")) for i, u, _ in pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = url_filter.url_filter(df, redirects=spark.createDataFrame(moves, "source string, target string")).collect()
    assert sorted((x.page_id, x.verdict) for x in got) == want and 5 < sum(v == "block" and not own(pages[i][1]) for i, v in want)


def test_urls_of_an_empty_table(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("turns", [[], [("", "")], [("user", r"\### Assistant: </turn> ok"), ("assistant", "\\\\### \\</turn>\n### User: ")], [("a: b\\###", "####</turn></turn>\n"), ("assistant", "\\")]])
def test_formatted_turns_read_back(turns):
    text, mask = chat_format.format_turns(turns)
    assert chat_format.read_turns(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_best_branch_of_each_tree(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 4, "assistant", "end", 0.9),
        (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (2, 3, 2, "user", "below", 1.0), (None, 1, 9, "user", None, None), (3, 1, None, None, "x", None),
    ]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    done = chat_format.format_paths(chat_format.best_paths(df, keep=2), df).collect()
    got = {(r.tree, r["rank"]): [t for _, t in chat_format.read_turns(r.formatted)] for r in done}
    assert len(done) == 4 and got == {(1, 1): ["q", "good", "more", "end"], (1, 2): ["q", "bad"], (None, 1): [""], (3, 1): ["x"]}


def test_repeated_turns_are_all_kept(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    links, texts = chat_format.conversations(df)
    row = chat_format.digest(chat_format.format_paths(chat_format.best_paths(links), texts)).first()
    assert row.n_turns == 3 and row.turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nassistant\n\n").hexdigest() and row.loss_chars == 0


def test_texts_that_share_a_hash_are_told_apart(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, None), (5, " ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, hash128=lambda c: F.lit("same")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2)}


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return sorted(((i, min(g)[2], len(g), i == min(g)[2], hashlib.sha256(b.encode()).hexdigest()) for b, g in groups.items() for _, _, i in g), key=repr)


@pytest.mark.parametrize("one_hash", [False, True])
def test_exact_groups_equal_brute_force(spark, one_hash):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(i, "".join(r.choices("ab \t\n", k=r.randint(0, 5)))) for i in range(300)] + [(None, "a b"), (None, None), (7, "a b"), (400, "z" * 200000), (401, " " + "z" * 200000)] + [(1000 + i, "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "h": F.lit("x"), "kept": F.lit(0)})
    got = exact_dedup.exact_dedup(df, **({"hash128": lambda c: F.lit("same")} if one_hash else {})).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=repr) == _exact(rows)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def _print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(spark):
    texts = [None, "", "\t\n", "one", "One  two", "a b c d", "a b c d e", "é É ß a\x0bb", "x " * 5000, "x " * 5000]
    ids = [1, 2, None, 4, 4, 6, 7, 8, 9, None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("fp", __import__("pyspark").sql.functions.lit(1))
    got = simhash_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), int(r.fingerprint, 16)) for r in got) == sorted((str(i), _print(t)) for i, t in zip(ids, texts, strict=True))
    assert {r.component_id for r in got if int(r.fingerprint, 16) == _print("x " * 5000)} == {9} and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_pivots_discard_nearly_all_pairs_of_a_bucket():
    import numpy as np

    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 2000, np.uint64) & np.uint64(~((1 << 21) - 1) & (1 << 63) - 1)  # a bucket: 21 bits agree
    linker = simhash_dedup._Linker([int(x) for x in rng.integers(0, 2**63, simhash_dedup.PIVOTS, np.uint64)], 4)
    t = linker.table(fp)
    left = sum(int((np.abs(t[i + 1 :] - t[i]).max(axis=1) <= 4).sum()) for i in range(len(fp) - 1))
    assert left < 0.02 * len(fp) * (len(fp) - 1) / 2


def test_finer_blocks_give_the_same_links(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    assert [simhash_dedup._blocks(n, 4) for n in (10, 1 << 20, 1 << 24, 1 << 40)] == [6, 6, 7, 8]
    monkeypatch.setattr(simhash_dedup, "_blocks", lambda n, distance: 8)
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()} == want


def test_fingerprints_within_the_distance_link(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash_dedup.near_duplicates(df).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id: r.component_id for r in rows} == {i: root(i) for i in ids}


def test_pipeline_runs_and_keeps_ids(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id").collect()]
    assert 0 < len(got) < docs.count() and len(set(got)) == len(got)


def _tokens(text):
    return [t for t in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if t]


def _coverage(doc, item, seed=5):
    """Share of the item's tokens under greedy tiles, by looking at every pair of places in every round."""
    least, used, done = min(seed, len(item)), set(), set()
    places = {}
    for i, t in enumerate(doc):
        places.setdefault(t, []).append(i)
    while item:
        found = []
        for b, t in enumerate(item):
            for a in places.get(t, ()):
                k = 0
                while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and a + k not in used and b + k not in done:
                    k += 1
                found.append((-k, a, b))
        longest = -min(found, default=(0,))[0]
        if longest < least:
            break
        for k, a, b in sorted(f for f in found if f[0] == -longest):
            if not used.intersection(range(a, a - k)) and not done.intersection(range(b, b - k)):
                used.update(range(a, a - k)), done.update(range(b, b - k))
    return len(done) / len(item) if item else 0.0


def test_tiling_equals_brute_force(spark):
    from quoin.llm import decontaminate

    items = [(1, "one two three four five six seven eight nine ten"), (2, "short item"), (3, None), (4, ""), (5, "a b a b a b a b a b"), (None, "x1 x2 x3 x4 x5")]
    docs = [
        (1, "pad six, seven eight nine ten; then One two three four five pad"), (2, "one two three four pad five six seven eight nine ten"), (3, None), (4, " "), (5, "a b a b a b a b a b a b"),
        (6, "here is a short item in it"), (7, "short pad item"), (8, "x1 x2 x3 x4 x5"), (8, "x1 x2 x3 x4 x5"), (9, "a b a b a pad b a b a b"), (None, "one two three four five six seven eight pad " * 3),
    ]
    sf = "/root/testdata/sf0.001"
    docs += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 5000]
    items += [(r.item_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, text in docs:
        doc = _tokens(text)
        for i, item in items:
            tokens = _tokens(item)
            if set(tokens) & set(doc) and (share := _coverage(doc, tokens)) >= 0.8:
                want.append((str(d), str(i), round(share, 6)))
    assert len(want) > 6 and sorted((str(r.doc_id), str(r.item_id), round(r.coverage, 6)) for r in got) == sorted(want)


def test_toxicity_of_held_out_rows(spark):
    from quoin.llm import toxicity

    sf = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).where("held_out").collect()}
    pairs = [(scored[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect() if r.doc_id in scored]
    bad, good = [s for s, t in pairs if t == 1], [s for s, t in pairs if t == 0]
    auc = sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))
    flagged = [t for s, t in pairs if s >= toxicity.THRESHOLD]
    print(f"auc {auc:.4f}, flagged {len(flagged)}, precision {sum(flagged) / max(1, len(flagged)):.4f}, recall {sum(flagged) / len(bad):.4f} of {len(bad)}")
    assert auc > 0.9 and sum(flagged) > 0.8 * len(flagged)


def test_toxicity_without_positives_or_rows(spark):
    from quoin.llm import toxicity

    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, "y")], "doc_id long, text string, score_ string")
    for d in (docs, docs.where("false")):
        assert [r.score for r in toxicity.score(d, toxicity.train(d, labels)).collect()] == [0.0] * d.count()


def _near_texts():
    """Texts at similarities around 0.8 of each other, a large group of near copies, and odd ones."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    out = [None, "", "  ", "one two", "One  two", "one two three four five"]
    for _ in range(40):
        base = [word() for _ in range(r.randint(60, 200))]
        out.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(max(1, len(base) // r.choice([40, 50, 60, 80]))):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    base = [word() for _ in range(120)]
    for _ in range(120):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def _shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_equal_brute_force_jaccard(spark):
    from quoin.llm import near_dedup

    texts = _near_texts()
    sets = [_shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_of_long_texts_and_in_dealt_buckets_are_found(spark, monkeypatch, block):
    import random

    from quoin.llm import near_dedup

    r = random.Random(block)
    rows, linked = [], 0
    passage = [r.randrange(10**6) for _ in range(40)]
    for n, pairs in ((100, 40), (400, 20), (1000, 10), (20_000, 6), (60_000, 4)):
        for _ in range(pairs):
            words = [r.randrange(10**6) for _ in range(n)]
            if n == 100:
                words[:40] = passage  # all short texts meet in buckets
            copy = list(words)
            for at in r.sample(range(n), max(1, int(n * r.choice([0.002, 0.015, 0.021])))):
                copy[at] = r.randrange(10**6)
            x, y = _shingle_set(" ".join(map(str, words))), _shingle_set(" ".join(map(str, copy)))
            linked += 5 * len(x & y) >= 4 * len(x | y)
            rows += [(len(rows), " ".join(map(str, words))), (len(rows) + 1, " ".join(map(str, copy)))]
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(rows), 2)) == linked > 60


def test_near_copies_are_found_by_their_fingerprints(spark, monkeypatch):
    import random

    import numpy as np

    from quoin.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_bands", lambda sets: np.zeros((len(sets), 0), np.int64))  # no bucket of min-hashes
    r = random.Random(3)
    base = [[str(r.randrange(10**6)) for _ in range(2000)] for _ in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:k] + ["x"] + w[k + 1 :]) for w in base for k in (0, 900)] + ["", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i if i < 6 else (i - 6) // 2 if i < 18 else 18 for i in range(20)}


def test_pairs_of_close_fingerprints_connect_all_and_are_verified(spark):
    from quoin.llm import near_dedup

    prints = [0, 0, 0b1111, 0b11110000, 0b11111111, 1 << 62, (1 << 62) + (31 << 40), 3 << 20, 3 << 20]
    nodes = spark.createDataFrame([(i, 0 if i == 7 else 5, x) for i, x in enumerate(prints)], "node long, n long, fp long")
    found = {(x.u, x.v) for x in near_dedup._simhash_pairs(nodes).collect()}
    assert all(u > v and (prints[u] ^ prints[v]).bit_count() <= 4 for u, v in found) and not any(7 in x for x in found)
    part = {i: i for i in range(9)}
    for _ in prints:
        for u, v in found:
            part[u] = part[v] = min(part[u], part[v])
    assert part == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7, 8: 0}
    rows = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2, 3], [1, 2, 3, 4]), ([], [1])], "x array<long>, y array<long>")
    assert [x[0] for x in rows.select(near_dedup._similar("x", "y", 0.8)).collect()] == [True, False, False]


def test_pipeline_stage_drops_near_copies_at_0_8(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50] + ["x"] + words[51:])), (3, " ".join(words[:30] + ["y", "y"] + words[32:70] + ["z"] + words[71:]))]
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id").collect()
    assert [r.doc_id for r in got] == [1, 3]


def test_toxicity_cut_does_not_follow_the_share_of_toxic_texts(spark):
    import random

    from quoin.llm import toxicity

    r = random.Random(1)
    mild, foul = [f"calm{i}" for i in range(300)], [f"foul{i}" for i in range(12)]

    def text(toxic):
        return " ".join(r.choices(mild, k=30) + (r.choices(foul, k=6) if toxic else []))

    labelled = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, t) for i, _, t in labelled], "doc_id long, toxic int")
    for share in (0.02, 0.3):
        rest = [(1000 + i, text(i < 1000 * share), i < 1000 * share) for i in range(1000)]
        docs = spark.createDataFrame([(i, t) for i, t, _ in labelled + rest], "doc_id long, text string")
        scores = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
        right = [(scores[i] >= toxicity.THRESHOLD) == bad for i, _, bad in rest]
        assert sum(right) >= 0.99 * len(right)


def test_toxicity_statistics_come_from_all_texts(spark, monkeypatch):
    from quoin.llm import toxicity

    rows = [(i, f"bad{i % 3} " * 2 + "w " * (i % 7)) for i in range(200)] + [(i, "calm " * (i % 50)) for i in range(200, 800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 800, 4)], "doc_id long, toxic int")
    full = toxicity.train(docs, labels)
    for name in ("MAX_POSITIVE", "MAX_UNLABELLED"):
        monkeypatch.setattr(toxicity, name, 20)
    small = toxicity.train(docs, labels)
    assert small.length[1:] == pytest.approx(full.length[1:]) and set(small.weights) == set(full.weights)


def test_texts_are_not_toxic_for_being_short(spark):
    from quoin.llm import toxicity

    for sf in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        assert (toxicity.train(docs, labels).score(["", None, " \t", "short", "two words"], {}) < toxicity.THRESHOLD).all()
