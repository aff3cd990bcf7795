"""Every stage of the pipeline against brute force or SQL, on documents with nulls, repeats and empty texts; and mixing on its own."""

import duckdb
import pytest
from test_corpus_operators import _coverage, _shingle_set, _tokens

import corpus_pipeline
from quoin.llm import mixing, toxicity
from quoin.llm.common import materialize

SF = "/root/testdata/sf0.001"


def _docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 5000")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = "\n".join(f"line {i} of a passage that two documents hold, {'abcdef'[i]} times" for i in range(4))
    odd = [(9001, None, "en", "src1", None), (9002, "", None, None, 0), (None, None, None, None, None), (9003, " \t\n ", "en", "src2", 4), (9004, f"one\n{passage}\ntwo", "en", None, 9), (9005, f"three\n{passage}", "en", "src1", 9), (9006, item, "en", "src0", 9), (9007, "short", "en", "src3", 5)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id % 50 = 0")).withColumn("component_id", docs.doc_id).withColumn("score", docs.text)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_stages_equal_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = _docs(spark)
    out = materialize(stage["toxicity"](spark, docs, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    keep = [r for r in docs.collect() if model.score([r.text])[0] < toxicity.THRESHOLD]
    assert out.columns == docs.columns and _rows(out) == sorted(map(repr, keep)) and len(keep) < docs.count()

    docs = out
    out = materialize(stage["line_dedup"](spark, docs, SF))
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9004].count("\n") == 5 and texts[9005] == "three" and texts[9001] is None and texts[9003] == " \t\n "

    docs = out
    out = materialize(stage["simhash_dedup"](spark, docs, SF))
    rows = docs.collect()
    sets, parent = [_shingle_set(r.text) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (2**63,)), (2**63 if r.doc_id is None else r.doc_id, repr(r)))
    assert out.columns == docs.columns and _rows(out) == sorted(r for _, r in least.values())

    docs = out
    out = materialize(stage["benchmark_decontamination"](spark, docs, SF))
    items = [_tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in docs.collect() if not any(set(i) & set(_tokens(r.text)) and _coverage(_tokens(r.text), i) >= 0.8 for i in items)]
    assert out.columns == docs.columns and _rows(out) == sorted(map(repr, clean)) and 9006 not in {r.doc_id for r in clean}

    docs = out
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = stage["mixing"](spark, docs, SF).select(*names).collect()
    assert sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in got) == _mixed(docs, names)


def _mixed(docs, names):
    documents = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    want = duckdb.sql(mixing.mixing_sql("documents", columns=", ".join(names))).fetchall()
    return sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in want)


@pytest.mark.parametrize("step", range(5))
def test_stages_of_an_empty_table(spark, step):
    docs = _docs(spark).where("false")
    out = corpus_pipeline.STAGES[step][1](spark, docs, SF)
    assert out.count() == 0 and (step == 4 or out.columns == docs.columns)


def test_mixing_equals_its_sql_and_meets_the_targets(spark):
    docs = _docs(spark)
    docs = docs.withColumn("bin", docs.text)
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    got = mixing.mix(docs).select(*names).collect()
    assert sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in got) == _mixed(docs, names)
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and all(r.taken <= 3 * r.size for r in rows)
        assert rows[0].target <= 3 * rows[0].source_size + 1e-6


def test_one_row_of_each_group_stays_and_names_may_clash(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0.5, 1, "a"), (1, text, 0.5, 1, "a"), (None, text, 0.1, 2, "b"), (None, "alone here", 0.2, 3, "c"), (1, "another text of one id", 0.3, 4, "d"), (None, "", 0.4, 5, "e"), (5, None, 0.4, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, place int, Kept string")
    docs = materialize(docs.withColumns({"__score": docs.place, "__kept": docs.place, "group": docs.place, "row": docs.place, "component_id": docs.place}))
    out = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r.Kept for r in out.collect()) == ["a", "c", "d", "f"]
    labels_fit = corpus_pipeline.toxicity(spark, docs, SF)
    assert labels_fit.columns == docs.columns
