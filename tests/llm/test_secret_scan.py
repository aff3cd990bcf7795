"""The ledger of blobs against patterns applied to every text, over several versions of texts and rules."""

import hashlib
import re

from quoin.llm import secret_scan
from quoin.llm.secret_scan import Rule

PATTERNS = [r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
AKIA = "AKIA" + "Z" * 16
TEXTS = [
    None, "", "é😀 token = 'abcdef' x", "ToKeN=\"abcde", "toKen=abcdefgh paſſword: abcdefgh", "secret==abcdefg api_key:  AKIA apikey = abc_def password=token=abcdef",
    AKIA + " " + AKIA[:19] + " AKIA AKIAAKIA" + "9" * 12, "0123456789abcdef01234567 0123456789abcdef0123456 " + "f" * 100_000 + " token = \"" + "a1" * 20 + '"', "token" + " " * 60_000 + "x", "passwd='" * 20_000,
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- password:secret1",
]
SCHEMA = "doc_id long, text string, blob string"


def _base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            if [kind == 0 and len(m[m.lastindex or 0]) >= 6, kind == 1 and len(m[0]) >= 20, kind == 2 and len(m[0]) >= 24][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def _spans(rows):
    return sorted((-1 if r.id is None else r.id, [tuple(f) for f in r.findings if f.kind < 3]) for r in rows)


def _rules_scanned(spark, ledger):
    return sorted((bytes(r.blob), k) for r in secret_scan.entries(spark, ledger).collect() for k in r.rules)


def test_base_spans_equal_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None), (None, TEXTS[5], None)]
    got = secret_scan.scan(spark.createDataFrame(rows, SCHEMA), secret_scan.new_ledger(spark)).collect()
    assert _spans(got) == sorted((-1 if i is None else i, _base(t)) for i, t, _ in rows)
    pem = [f for r in got if r.id == 10 for f in r.findings if f.kind == 3]
    assert [tuple(f) for f in pem] == [(0, 3, 65)]


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark):
    ledger = secret_scan.new_ledger(spark)
    first = spark.createDataFrame([(i, f"password: {'abc' * i}", None) for i in range(10)] * 3, SCHEMA)
    rules = secret_scan.RULES
    assert secret_scan.scan(first, ledger).count() == 30
    once = _rules_scanned(spark, ledger)
    assert len(once) == 10 * len(rules) == len(set(once))
    assert secret_scan.unseen(first, ledger).count() == 0

    more = first.unionByName(spark.createDataFrame([(100, "password: zzzzzz", None)], SCHEMA))
    assert [r.text for r in secret_scan.unseen(more, ledger).collect()] == ["password: zzzzzz"]
    got = secret_scan.scan(more, ledger).collect()
    assert len(got) == 31 and len(_rules_scanned(spark, ledger)) == 11 * len(rules)

    changed = [Rule("assign", 2, "password: (z+)", 1, 6), *rules[1:]]
    todo = secret_scan.unseen(more, ledger, changed).collect()
    assert len(todo) == 11 and all(r.todo == ["assign@2"] for r in todo)
    got = {r.id: [tuple(f) for f in r.findings] for r in secret_scan.scan(more, ledger, changed).collect()}
    assert got[100] == [(0, 0, 16)] and got[5] == []
    # the old version's findings are still there for who asks for it, also after a repeated append
    secret_scan.entries(spark, ledger).write.mode("append").parquet(ledger)
    assert _spans(secret_scan.findings(more, ledger).where("id = 5").collect())[0] == (5, _base("password: " + "abc" * 5))


def test_empty_tables_and_hot_blobs(spark):
    ledger = secret_scan.new_ledger(spark)
    assert secret_scan.scan(spark.createDataFrame([], SCHEMA), ledger).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'secret: hunter22' ELSE concat('t', id) END AS text")
    rows = secret_scan.scan(hot, ledger).collect()
    assert len(rows) == 3000 and sum(len(r.findings) for r in rows) == 1000
    assert len(_rules_scanned(spark, ledger)) == 2001 * len(secret_scan.RULES)


def test_query_columns(spark):
    r = secret_scan.op11_secret_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for x in r:
        want = _base(texts[x.doc_id])
        spans = ",".join(f"{secret_scan.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert x.base_sha256 == hashlib.sha256(spans.encode()).hexdigest() and x.spans == spans
    assert len(r) == len(texts)
