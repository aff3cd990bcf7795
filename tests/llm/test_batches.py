"""Texts go to Python workers in batches of few bytes, whatever their number and length."""

import pyarrow as pa
import pytest

from quoin.llm import common, decontaminate as d, near_dedup as n, toxicity as t

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    spark.conf.unset(NAME)
    yield
    spark.conf.unset(NAME)


@pytest.mark.parametrize("chars", [30, 40_000, 3_000_000])
def test_batches_end_after_few_bytes(spark, unset, chars):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = max(5, min(20_000, 20_000_000 // chars))
    docs = spark.range(0, rows, 1, 1).selectExpr("id AS doc_id", f"repeat(char(97 + id % 26), {chars}) AS text")
    got = common.map_texts(docs, sizes, "n long, size long").collect()
    assert sum(x.n for x in got) == rows and max(x.size for x in got) <= 1.25 * common.BATCH_BYTES + 2 * chars


def test_every_pass_over_texts_asks_for_small_batches_and_keeps_smaller_ones(spark, unset):
    docs = spark.createDataFrame([(i, f"some mild text about {i % 3} things" + " vile scum" * (i % 4 == 0)) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "mild text about 2 things")], "item_id long, text string")
    passes = [lambda: d.decontaminate(docs, items), lambda: d.contaminated(docs, items), lambda: n.near_duplicates(docs), lambda: t.score(docs, t.Model(0.1, {"vile": 1.0}))]
    for one in passes:
        for given, then in ((None, str(common.BATCH_BYTES)), ("1g", str(common.BATCH_BYTES)), ("5k", "5k"), ("1000b", "1000b")):
            spark.conf.unset(NAME) if given is None else spark.conf.set(NAME, given)
            out = one()
            assert spark.conf.get(NAME) == then
        assert out.count() > 0


def test_results_do_not_depend_on_batches(spark, unset):
    docs = spark.range(0, 300, 1, 2).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', x * (id % 40)))) AS text")
    items = docs.where("doc_id < 5").selectExpr("doc_id AS item_id", "text")
    found = []
    for given in ("64m", "1500"):
        spark.conf.set(NAME, given)
        groups = n.near_duplicates(docs).select("doc_id", "component_id").collect()
        found.append((sorted(map(tuple, groups)), sorted(r.doc_id for r in d.decontaminate(docs, items).collect())))
    assert found[0] == found[1] and len({c for _, c in found[0][0]}) == 40 and len(found[0][1]) == 300 - 40
