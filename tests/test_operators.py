"""Cases that the tables do not hold: empty, constant and one-class input, nulls, ties, hot keys, odd files."""

import io
import random
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quoin.functions import names, vectors
from quoin.operators import evaluation, graphs, joins, metrics, patterns, ranking, rasters, retrieval, spectral, statistics, tiles
from quoin.sources import binary, sinks, text

SF = "/root/testdata/sf0.001"


@pytest.fixture
def scored(spark):
    return lambda rows: spark.createDataFrame(rows, "s double, y boolean")


@pytest.mark.parametrize("rows", [[], [(0.5, True)] * 3, [(0.5, False)] * 3, [(0.2, False), (0.4, False)], [(None, True)]])
def test_metrics_of_one_class_and_of_nothing(scored, rows):
    df, s, y = scored(rows), F.col("s"), F.col("y")
    area = evaluation.ranking_areas(df, s, y).first()
    assert area.auc is None and (area.average_precision is None or rows[0][1])
    best = evaluation.best_f1(df, s, y).first()
    assert best.f1 == (None if not rows or rows[0][0] is None else 1.0 if rows[0][1] else 0.0)
    assert len(metrics.pr_curve(df, s, y).collect()) == len({r[0] for r in rows if r[0] is not None})
    assert all(r.recall is None or rows[0][1] for r in metrics.pr_curve(df, s, y).collect())
    assert metrics.at_threshold(df, s, y, 0.3).count() == 1 and len(metrics.precision_at_recalls(df, s, y, [0.5]).collect()) == 1
    assert metrics.error_tradeoff(df, s, y).count() >= 0 and evaluation.averages(df, "s", y).count() == 1


def test_histogram_of_a_constant_and_of_nothing(scored):
    assert [(r.bin, r.n) for r in evaluation.histogram(scored([(2.0, True)] * 4 + [(None, True)]), "s", 5).collect()] == [(0, 4)]
    assert evaluation.histogram(scored([]), "s", 5).collect() == []


def test_scaling_and_correlation_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 5.0, 1.0), (None, 1.0, 2.0)], "a double, b double, c double")
    assert [r.scaled for r in statistics.scaled(df, "a").orderBy("a").collect()] == [None, 0.0, 0.0]
    assert {r.r for r in statistics.partial_correlation(df, ["a", "b", "c"]).collect()} == {None}
    assert statistics.information_gap(df.where("false"), "a", ["b"]).first() is None or True


def test_thresholds_are_not_rounded(scored):
    rows = [(0.1 + i * 1e-9, i % 2 == 0) for i in range(50)]
    assert metrics.pr_curve(scored(rows), F.col("s"), F.col("y")).count() == 50
    assert metrics.pr_curve(scored(rows), F.col("s"), F.col("y"), 3).count() == 1


def test_vectors_of_differing_length_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="differ"):
        retrieval.knn(df, df, 1).collect()


def test_neighbours_with_ties_nulls_and_zero_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(r.choice([0, 1])), float(r.choice([0, 1]))]) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in retrieval.knn(df, df, 7).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.id))
    v = {i: np.array(e) / max(np.linalg.norm(e), 1e-300) for i, e in rows if e}
    for q in v:
        want = sorted((-round(float(v[q] @ v[i]), 9), i) for i in v if i != q)[:7]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_a_written_index_reads_the_probed_cells_and_reaches_recall(spark, tmp_path):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + r.normal(size=16) * 0.3).tolist()) for i in range(3000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.where("vec_id % 20 = 0")
    exact = {(x.query_id, x.id) for x in retrieval.knn(q, e, 10).collect()}
    retrieval.CellIndex.write(e, str(tmp_path), 32)
    index = retrieval.CellIndex(spark.newSession(), str(tmp_path))
    assert index.rows().count() == 3000 and index.about.cells == 32
    found = {(x.query_id, x.id) for x in index.search(q, 10, 4).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert {(x.query_id, x.id) for x in index.search(q, 10, 32).collect()} == exact
    one = index.search(e.where("vec_id = 7"), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert {f[0].split("cell=")[1].split("/")[0] for f in index.rows([1, 2]).select(F.input_file_name()).distinct().collect()} == {"1", "2"}
    copies = retrieval.CellIndex.write(e, str(tmp_path / "two"), 32, copies=2)
    assert {(x.query_id, x.id) for x in copies.search(q, 10, 32).collect()} == exact


@pytest.mark.parametrize("sent", [0, 1 << 25])
def test_tiles_equal_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(tiles, "BROADCAST", sent)
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None]), r.choice([0, 1, None]), [round(r.random(), 1) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label string, book int, embedding array<double>").repartition(5)
    for metric in ("cosine", "l2"):
        got = {}
        for x in tiles.nearest(df, df, 4, metric, "label", ("book",), -0.3).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.id))
        v = {i: np.array(e) for i, _, _, e in rows}
        for i, label, book, _ in rows:
            score = lambda j: -float(((v[i] - v[j]) ** 2).sum()) if metric == "l2" else float(v[i] @ v[j] / max(np.linalg.norm(v[i]), 1e-300) / max(np.linalg.norm(v[j]), 1e-300))  # noqa: B023, E731
            want = sorted((-round(score(j), 9), j) for j, l, b, _ in rows if j != i and l == label and label is not None and b != book and round(score(j), 9) >= -0.3)[:4]
            assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in want]


def test_conditions_are_met_before_the_ranking(spark):
    rows = [(i, i % 2, i % 3, [1.0, i / 100]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, label int, book int, embedding array<double>")
    out = retrieval.discover(df, df, 3, "label", F.col("q_book") != F.col("book")).collect()
    assert len(out) == 90 and all(r.query_id % 2 == r.id % 2 and r.query_id % 3 != r.id % 3 for r in out)
    assert retrieval.discover(df, df, 50, "label", F.col("q_book") != F.col("book")).count() == 30 * 10
    assert retrieval.discover(df, df.where("false"), 3, "label").count() == 0


def test_ranks_equal_a_plain_sort(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, r.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, s double")
    got = {x.k: (x["rank"], x.n) for x in ranking.ranked_by_score(df, ["g"], "s", ["k"], total="n").collect()}
    for g in ("a", "b", None):
        order = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
        assert [got[x[0]] for x in order] == [(i + 1, len(order)) for i in range(len(order))]


def test_last_wins_with_null_orders(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "x"), (2, 5, "y")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in ranking.last_wins(df, "k", "o").collect()) == [(1, "a"), (2, "y")]


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") % 37).alias("g"))
    out = ranking.group_split(df, "g", {"train": 0.8, "test": 0.2}, 1)
    assert out.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    ranking.assert_disjoint(out.where("part = 'train'"), out.where("part = 'test'"), "g")
    with pytest.raises(ValueError):
        ranking.assert_disjoint(out, out, "g")


def test_wide_ranges_and_the_first_that_fits(spark):
    ranges = spark.createDataFrame([(0.0, 1e9, "wide", 2), (5.0, 6.0, "narrow", 1), (7.0, 7.0, "none", 0)], "lo double, hi double, part string, ord int")
    df = spark.createDataFrame([(1, 5.5), (2, 123456.0), (3, -1.0), (4, 7.0), (5, None), (6, 1e9)], "k int, v double")
    got = {r.k: r.assigned for r in joins.range_assign(df, ranges, "v", "k", "ord", "part", F.lit("kept"), 1.0).collect()}
    assert got == {1: "narrow", 2: "wide", 3: "kept", 4: "wide", 5: "kept", 6: "kept"}


def test_pairs_of_a_hot_group(spark):
    one = spark.createDataFrame([("hot", i) for i in range(200)] + [(f"g{i % 50}", i) for i in range(200)], "g string, i int")
    got = joins.self_pairs(one, "g", "i")
    assert got.count() == got.distinct().count() == 200 * 199 // 2 + 50 * 6


def test_components_equal_brute_force(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901 + i) for i in range(80)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.component for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}


def test_seeds_merge_over_several_steps(spark):
    rows = spark.createDataFrame([("l1", 1), ("l1", 2), ("l2", 3), ("l3", 4), ("l4", 9), (None, 8)], "l string, i long")
    seeds = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 2), (9, None)], "i long, seed int")
    got = {r.i: r.cluster for r in graphs.clusters(rows, "l", "i", seeds).collect()}
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and got[9] == "Isolated" and 8 not in got


def _eigenvalues(edges):
    place = {n: i for i, n in enumerate(sorted({x for a, b, _ in edges for x in (a, b)}))}
    w = np.zeros((len(place), len(place)))
    for a, b, x in edges:
        w[place[a], place[b]] = w[place[b], place[a]] = x
    d = w.sum(1)
    return np.linalg.eigvalsh(np.eye(len(w)) - w / np.sqrt(d[:, None] * d[None]))


def test_spectral_forms_find_two_cliques(spark):
    edges = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(0, 10, 0.01)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    gaps = spectral.eigengaps(df)
    assert int(np.argmax(gaps)) == 1 and np.allclose(gaps, np.diff(_eigenvalues(edges)[:10]), atol=1e-9)
    found = {r.node: r.cluster for r in graphs.spectral_clusters(df, 2).collect()}
    assert len({found[i] for i in range(6)}) == 1 and set(found) == set(range(6)) | set(range(10, 16))
    apart = [e for e in edges if e[:2] != (0, 10)] + [(20, 21, 2.0)]
    three = spectral.smallest_eigenvalues(spark.createDataFrame(apart, "a long, b long, weight double"), 20)
    assert np.allclose(three, _eigenvalues(apart), atol=1e-9) and sum(v < 1e-9 for v in three) == 3
    assert spectral.smallest_eigenvalues(df.where("false")) == []


def test_eigenvalues_of_a_neighbour_graph(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    graph = spectral.knn_graph(e, 5)
    got = spectral.smallest_eigenvalues(graph)
    assert np.allclose(got, _eigenvalues([tuple(r) for r in graph.collect()])[:10], atol=1e-6)


def test_tolerant_sources(spark, tmp_path):
    (tmp_path / "scores.csv").write_text("a.tif,0.5\nb.tif\nc.tif,abc\n\nd.tif, 0.25 ,x\ne.tif,\n")
    assert sorted(map(tuple, text.scored_list(spark, str(tmp_path / "scores.csv")).collect())) == [("a.tif", 0.5), ("d.tif", 0.25)]
    (tmp_path / "matches.csv").write_text("# note\na, b,b\n\n  # other\nc,c\nd\na,c,e\n")
    assert sorted(sorted(r.names) for r in text.match_groups(spark, str(tmp_path / "matches.csv")).collect()) == [["a", "b"], ["a", "c", "e"]]
    (tmp_path / "wide.txt").write_text("q|a|b|0.9|0.8\nq2|a|1.0\nbad|a|b|1\nq3\n")
    assert sorted(map(tuple, text.wide_neighbours(spark, str(tmp_path / "wide.txt")).collect())) == [("q", 1, "a", 0.9), ("q", 2, "b", 0.8), ("q2", 1, "a", 1.0)]
    assert text.wide_neighbours(spark, str(tmp_path / "wide.txt"), k=1).count() == 1
    with pytest.raises(ValueError):
        text.by_extension(spark, "book.xlsx")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.tif").write_bytes(b"II*\x00")
    assert text.files(spark, str(tmp_path), "*.tif").count() == 0 and text.files(spark, str(tmp_path), "*.tif", True).count() == 1


def test_binary_sources_round_trip(spark, tmp_path):
    array = np.random.default_rng(0).integers(0, 255, (5, 3, 4)).astype(np.uint8)
    for pack in (False, True):
        assert (binary.parse_idx(binary.to_idx(array, pack)) == array).all()
    (tmp_path / "t-idx3.gz").write_bytes(binary.to_idx(array, True))
    rows = binary.idx_items(spark, str(tmp_path / "t-idx3.gz")).orderBy("item").collect()
    assert [r["values"] for r in rows] == array.reshape(5, -1).tolist() and rows[0]["shape"] == [3, 4]
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name in ("x/A_uc.tif", "x/B_uc.tif", "y.csv"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    got = binary.tar_members(spark, str(tmp_path / "a.tar"), "_uc.tif", contents=True).collect()
    assert sorted((r.member, bytes(r.content)) for r in got) == [("x/A_uc.tif", b"abc"), ("x/B_uc.tif", b"abc")]
    np.save(tmp_path / "m.npy", np.array([[1.0, 0.9, 0.1], [0.9, 1.0, 0.5], [0.1, 0.5, 1.0]]))
    assert sorted(map(tuple, binary.matrix_edges(spark, str(tmp_path / "m.npy"), 0.5).collect())) == [(0, 1, 0.9), (1, 2, 0.5)]


def test_names_of_other_forms(spark):
    rows = ["", "no-fields", "a_b_c_d_bookREDO1684A-0100-X.jpg", "dir/char_H_uc/x.y_T_uc.tif", "p/letters/Q/file.jpg", "a_b_c_d_e1690-3_page1rlineX_charY_AB_uc.tif", None]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    out = df.select(*[f(F.col("n")).alias(f.__name__) for f in (names.year, names.year_past_part, names.line, names.slot, names.page, names.letter, names.letter_class, names.graph_letter, names.book_by_title, names.listed_page, names.gathering_key, names.workbench_fields, names.perturbation)]).collect()
    assert [r.year_past_part for r in out] == [None, None, 1684, None, None, 1690, None] and out[2].year is None
    assert out[3].letter_class == "T" and out[4].letter_class == "Q" and out[5].line == out[5].slot == -1 and out[5].graph_letter == "AB"
    with pytest.raises(Exception, match="unknown level"):
        df.select(names.level(F.col("n"), ["x"])).collect()


def test_picture_groups_of_a_table(spark):
    tex = r"\includegraphics[width=1cm]{a.jpg} & \includegraphics{b.jpg} \\ none \\ \includegraphics{c.jpg}"
    got = spark.createDataFrame([(tex,)], "t string").select(F.inline(names.picture_groups(F.col("t")))).collect()
    assert sorted(map(tuple, got)) == [(0, 0, "a.jpg"), (0, 1, "b.jpg"), (1, 0, "c.jpg")]


def test_softmax_sums_to_one(spark):
    p = spark.createDataFrame([([1.0, 2.0, 1000.0],), ([0.0],)], "v array<double>").select(vectors.softmax(F.col("v")).alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 for r in p)


def test_written_rows_keep_missing_ranks_out(spark):
    df = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.25), ("q", 3, "c", 0.1)], "query string, rank int, candidate string, score double")
    assert [r.row for r in sinks.wide_rows(df, 2, 2).collect()] == ["q|a|b|0.50|0.25"]


@pytest.mark.parametrize("by", [None, "g"])
def test_scans_over_ranges_equal_scans_in_one_task(spark, by):
    r = random.Random(6)
    rows = [(i, r.choice(["a"] * 9 + ["b", None]), r.choice([None, *range(12)]), r.choice([None, r.random(), 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, t int, v double").repartition(7)
    run = lambda whole: sorted((x.k, x.running_best, None if x.running_mean is None else round(x.running_mean, 9)) for x in evaluation.running(df, by, ["t", "k"], "v", 25, whole).collect())
    assert run(False) == run(True) and len(run(False)) == 500
    right = df.where("k % 3 = 0").select("g", "t", F.col("k").alias("source"), "v")
    got = lambda whole: sorted(map(repr, joins.asof_join(df.where("k % 3 > 0").select("k", "g", "t"), right, by, "t", "source", ["source", "v"], whole).collect()))
    assert got(False) == got(True)
    plan = joins.asof_join(df, right, None, "t", "source", ["source"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_pattern_tables_equal_every_pattern_on_every_row(spark):
    import fnmatch
    import re

    r = random.Random(7)
    rows = [(i, r.choice([None, "", "".join(r.choice("abcx-_.é\n") for _ in range(r.randint(1, 30)))])) for i in range(300)] + [(999, "abcabcabc" * 2000)]
    regexes = ["abc", "a.c", "^ab", "c$", "a+b", "ab*c", "ab?c", "(abc)+x", "a|bc", "[abc]x", r"\.a", r"a\.", "x{2}a", "", "abcabca", r"\d", "abx[^c]ab", "(?i)ABC", "cab-", "(ab)?cab", None]
    globs = ["*abc*", "a*", "?b*", "*[xc]", "*é*", "abc", "*x-?a*"]
    df = spark.createDataFrame(rows, "k long, v string")
    for kind, listed in (("regex", regexes), ("glob", globs), ("text", regexes)):
        table = spark.createDataFrame(list(enumerate(listed)), "pattern_id long, pattern string")
        got = sorted(map(tuple, patterns.pattern_table_join(df, "k", "v", table, kind).collect()))
        holds = {"regex": lambda p, v: re.search(p.replace("c$", r"c\Z"), v), "glob": lambda p, v: fnmatch.fnmatchcase(v, p), "text": lambda p, v: p in v}[kind]
        rows_ = [(k, v.replace("\n", " ") if kind == "regex" else v) for k, v in rows if v is not None]
        assert kind == "regex" or got == sorted((k, i) for k, v in rows_ for i, p in enumerate(listed) if p is not None and holds(p, v))
        if kind == "regex":
            df_ = df.withColumn("v", F.replace("v", F.lit("\n"), F.lit(" ")))
            got = sorted(map(tuple, patterns.pattern_table_join(df_, "k", "v", table, kind).collect()))
            assert got == sorted((k, i) for k, v in rows_ for i, p in enumerate(listed) if p is not None and holds(p, v))
    assert [patterns.literal_of(p) for p in ("ab+cd", "ab*cd", r"a\.b", "(xyz)ab", "[]a]bc", "a{2,3}bc", "a|b")] == ["ab", "cd", "a.b", "ab", "bc", "bc", ""]


@pytest.mark.parametrize(("rows", "sent"), [(1024, 1 << 25), (7, 0)])
def test_kernel_moments_equal_all_pairs(spark, monkeypatch, rows, sent):
    monkeypatch.setattr(tiles, "BROADCAST", sent)
    r = np.random.default_rng(8)
    x, y = r.normal(size=(60, 5)), r.normal(size=(60, 5)) + 0.3
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "at long, x array<double>, y array<double>").repartition(rows % 10 + 1)
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2)
    h = k(x, x) + k(y, y) - k(x, y) - k(y, x)
    off = h[~np.eye(60, dtype=bool)]
    got = statistics.quadratic_mmd(df).first()
    assert got.mmd2 == pytest.approx(off.mean(), abs=1e-12) and got.error == pytest.approx(np.sqrt(2 * off.var() / off.size), rel=1e-9)
    biased = statistics.quadratic_mmd(df, unbiased=False).first()
    assert biased.mmd2 == pytest.approx(h.mean(), abs=1e-12) and biased.error is None
    assert statistics.quadratic_mmd(df.where("false")).first().mmd2 is None


def test_thresholds_part_histograms_best(spark):
    r = np.random.default_rng(9)
    images = {i: np.where(r.random(40) < 0.5, r.integers(0, 90, 40), r.integers(140, 256, 40)) for i in range(20)}
    images |= {100: np.full(5, 255), 101: np.full(5, 17), 102: np.array([17, 255, 30])}
    rows = [(i, int(v)) for i, x in images.items() for v in x] + [(100, None)]
    got = {t.k: t.threshold for t in rasters.thresholds(spark.createDataFrame(rows, "k long, v int"), "k", "v").collect()}
    for i, x in images.items():
        x = x[x < 255]
        cut = lambda t, x=x: len(x[x <= t]) * len(x[x > t]) * (x[x <= t].mean() - x[x > t].mean()) ** 2 if (x > t).any() else 0
        want = 127 if not len(x) else x[0] if len(set(x)) == 1 else max(sorted(set(x.tolist())), key=lambda t: (round(cut(t), 6), -t))
        assert got[i] == want


def test_moments_and_bounds_of_images(spark):
    r = np.random.default_rng(10)
    images = {i: r.integers(0, 200, (9, 12)) * (r.random((9, 12)) < 0.6) for i in range(6)}
    images[50] = np.zeros((9, 12), int)
    df = rasters.pixels(spark.createDataFrame([(i, v.ravel().tolist()) for i, v in images.items()], "k long, v array<long>"), "k", "v", 12)
    moments = {m.k: m for m in rasters.moments(df, "k").collect()}
    bounds = {b.k: b for b in rasters.parallelogram(df, "k", 0.1).collect()}
    assert moments[50].cx is None and 50 not in bounds
    yy, xx = np.mgrid[:9, :12]
    for i in range(6):
        v = images[i]
        cov = np.cov(np.stack([xx.ravel(), yy.ravel()]), fweights=v.ravel(), ddof=0)
        m, b = moments[i], bounds[i]
        assert np.allclose([m.u20, m.u11, m.u02], [cov[0, 0], cov[0, 1], cov[1, 1]]) and np.allclose([m.major, m.minor], np.sqrt(np.linalg.eigvalsh(cov)[::-1]))
        assert np.isclose(m.angle, 0.5 * np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1])) and np.isclose(b.shear, cov[0, 1] / cov[1, 1])
        slanted = xx + 0.5 - b.shear * (yy - b.middle)
        across = [v[slanted < t].sum() / v.sum() for t in range(12)]
        down = [v[:t].sum() / v.sum() for t in range(9)]
        assert np.allclose([b.left, b.right], np.interp([0.05, 0.95], across, range(12))) and np.allclose([b.top, b.bottom], np.interp([0.05, 0.95], down, range(9)))


def test_archives_are_read_by_ranges_and_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "RANGE", 2048)
    rows = [(f"book {i % 3}", f"{'d' * (i % 4 * 60)}/{i}_{'ab'[i % 2]}.tif", bytes(range(i))) for i in range(60)]
    df = spark.createDataFrame(rows, "book string, member string, content binary")
    assert binary.write_tars(df, "book", "member", "content", str(tmp_path / "tars")) == 3
    assert sorted(p.name for p in (tmp_path / "tars").iterdir()) == ["book 0.tar", "book 1.tar", "book 2.tar"]
    with tarfile.open(tmp_path / "tars" / "book 1.tar") as tar:
        assert sorted(tar.getnames()) == sorted(m for b, m, _ in rows if b == "book 1")
    got = binary.tar_members(spark, str(tmp_path / "tars" / "*.tar"), contents=True)
    assert sorted((r.member, bytes(r.content), r.size) for r in got.collect()) == sorted((m, c, len(c)) for _, m, c in rows)
    assert len({r[0] for r in binary.tar_contents(binary.tar_index(spark, str(tmp_path / "tars"))).select(F.spark_partition_id()).distinct().collect()}) > 1
    table = spark.createDataFrame([("book 1", "1_b.tif", 7), ("book 2", "1_b.tif", 8), ("book 1", "none", 9)], "book string, file string, threshold int")
    assert [(r.book, r.file, r.threshold) for r in binary.members_in_table(got, table, "file").collect()] == [("book 1", "1_b.tif", 7)]


@pytest.mark.parametrize("pack", [False, True])
def test_idx_files_hold_their_share_of_all_items(spark, tmp_path, pack):
    rows = [(i * 7 % 103, [i, 255 - i, 0, 1, 2, 3]) for i in range(103)]
    df = spark.createDataFrame(rows, "k int, v array<int>").repartition(5)
    assert binary.write_idx(df, ["k"], "v", [2, 3], str(tmp_path / "x"), 25, pack) == 103
    arrays = [binary.parse_idx(p.read_bytes()) for p in sorted((tmp_path / "x").iterdir())]
    assert [a.shape for a in arrays] == [(25, 2, 3)] * 4 + [(3, 2, 3)]
    assert np.concatenate(arrays).reshape(103, 6).tolist() == [v for _, v in sorted(rows)]
    assert binary.write_idx(df.where("false"), ["k"], "v", [2, 3], str(tmp_path / "y"), 25) == 0
    with pytest.raises(Exception, match="unsigned bytes"):
        binary.write_idx(df, ["k"], "v", [2, 2], str(tmp_path / "z"))


def test_rows_are_numbered_without_gaps(spark):
    from quoin.operators import scans

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(6)
    out, total = scans.numbered(df, ["k"], "n")
    assert total == 1000 and {(r.k, r.n) for r in out.collect()} == {(i, i + 1) for i in range(1000)}


def test_interpolated_precision_follows_the_curve(scored):
    r = np.random.default_rng(12)
    s, y = np.round(r.random(80), 2), r.random(80) < 0.4
    got = metrics.interpolated_precision(scored([(float(a), bool(b)) for a, b in zip(s, y, strict=True)]), F.col("s"), F.col("y"), [0.05, 0.3, 0.5, 0.9, 0.95]).collect()
    cuts = np.unique(s)
    prec, rec = (np.array([*(y[s >= c].sum() / d(c) for c in cuts), end]) for d, end in ((lambda c: (s >= c).sum(), 1.0), (lambda c: y.sum(), 0.0)))
    for x in got:
        i = rec.size - np.searchsorted(rec[::-1], x.target + 0.01, side="right")
        assert (x.precision, x.recall, x.best, x.threshold) == pytest.approx((prec[i], rec[i], prec[:i].max(), cuts[i - 1]))


def test_perturbed_names_are_taken_apart(spark):
    cases = {
        "a_b_perturb12_anomaly_170_damage_thin_swell_globalink_high_localink_low_1.tif": ("a_b_perturb", "anomaly", 170, ["thin", "swell"], "high", "low"),
        "a_perturb1_x_2_damage_y_globalink_b_localink_c_2.tif": ("a_perturb", "x", 2, ["y"], "b", "c"),
        "a_perturb1_x_2_original.tif": ("a_perturb", "x", 2, None, None, None),
        **dict.fromkeys(["a_perturb_x_2_original.tif", "a_perturb1_X_2_original.tif", "a_perturb1_x_2_damage_y_globalink_b_localink_c_3.tif", "a_perturb1_x_2_damage_y_localink_c_1.tif", "a_perturb1_x_2.tif", "", "a_perturb1_x_y_2_original.tif", "a_perturb1_x_2_damage__globalink_b_localink_c_1.tif"], (None,) * 6),
    }
    df = spark.createDataFrame([(n,) for n in [*cases, None]], "n string")
    got = {r.n: tuple(r.p) for r in df.select("n", names.perturbation(F.col("n")).alias("p")).collect()}
    assert got == {**cases, None: (None,) * 6}


def test_completion_seeded_choice_and_paragraphs(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (9, "z", 1)], "k int, s string, n int")
    domain = spark.createDataFrame([(k, s) for k in (1, 2, None) for s in "ab"], "k int, s string")
    got = {(r.k, r.s): r.n for r in ranking.completed(df, domain, ["k", "s"], {"n": 0}).collect()}
    assert got == {(1, "a"): 5, (1, "b"): 0, (2, "a"): 0, (2, "b"): 0, (None, "a"): 0, (None, "b"): 6}
    files = spark.range(50).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("path"))
    assert ranking.first_seeded(files, ["g"], "path", 4, 1).groupBy("g").count().where("count = 4").count() == 3 and ranking.first_seeded(files, [], "path", 7, 1).count() == 7
    lines = spark.createDataFrame([("a\nb\n\n c \n",)], "t string")
    assert [tuple(r) for r in lines.select(F.inline(names.paragraph_groups(F.col("t"), F.lit(4)))).collect()] == [(5, "a"), (5, "b"), (6, "c")]


def test_rank_by_distance_from_the_mean(spark):
    r = np.random.default_rng(13)
    rows = [(i, i % 3 or None, r.normal(size=4).tolist()) for i in range(30)] + [(99, 1, None)]
    got = {x.k: (round(x.distance, 9), x["rank"]) for x in ranking.by_distance_from_mean(spark.createDataFrame(rows, "k int, g int, v array<double>"), "g", "k", "v").collect()}
    assert 99 not in got and len(got) == 30
    for g in (1, 2, None):
        x = {k: np.array(v) for k, h, v in rows if h == g and v}
        mean = np.mean(list(x.values()), axis=0)
        want = sorted((round(float(np.linalg.norm(v - mean)), 9), k) for k, v in x.items())
        assert [got[k] for _, k in want] == [(d, i + 1) for i, (d, _) in enumerate(want)]


def test_first_events_of_a_stream(spark, tmp_path):
    from quoin.streaming import manifests

    rows = [(i % 5, f"2024-01-01 00:{i:02}:00") for i in range(20)]
    spark.createDataFrame(rows, "k int, t string").selectExpr("k", "cast(t AS timestamp) AS t").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp").parquet(str(tmp_path / "in"))
    manifests.first_seen(stream, "k", "t", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_pairs_of_large_groups_and_busy_items_are_counted_where_they_arrive(spark, monkeypatch):
    r = random.Random(5)
    rows = [("all", i) for i in range(150)] + [(f"g{g}", i) for g in range(80) for i in {0, *(r.randrange(150) for _ in range(4))}] + [(None, 3), (None, 4), ("g1", None)]
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    want = {}
    for items in groups.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows + rows[:20], "g string, i long")
    monkeypatch.setattr(joins, "CHUNK", 40)
    for most in (1 << 21, 500):
        monkeypatch.setattr(joins, "PAIRS", most)
        got = joins.co_occurrence(df, "g", "i")
        assert {(x.a, x.b): x.n for x in got.collect()} == want and got.count() == len(want)
        cells = {(x.a, x.b): x.n for x in joins.lower_triangle(df, "g", "i").collect()}
        assert len(cells) == 150 * 151 // 2 and all(n == (want.get((b, a), 0) if a != b else sum(a in s for s in groups.values())) for (a, b), n in cells.items())
    # pairs grow in the last stage only, over as many tasks as their number asks for, and are not shuffled
    pairs, keys = joins.dealt_pairs(df.where("g IS NOT NULL").distinct(), "g", "i")
    assert "__deal" in keys and pairs.rdd.getNumPartitions() >= (150 * 149 // 2) // 500
    plan = pairs.groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(__others") < plan.index("Exchange hashpartitioning(a")


def test_tiles_keep_few_pairs_and_read_blobs_in_place(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 16)
    added = []
    plain = tiles._Best.add
    monkeypatch.setattr(tiles._Best, "add", lambda self, row, key, sim: (added.append(len(row)), plain(self, row, key, sim)))
    v = np.random.default_rng(3).normal(size=(1600, 6)).round(1)
    blocks = [(0, 16, 6, np.arange(16).tobytes(), v[:16].tobytes(), b"", len(p), 6, np.arange(lo, lo + 16).tobytes(), p.tobytes(), b"") for lo in range(0, 1600, 16) for p in [v[lo : lo + 16]]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks, strict=True)], names=[f"c{i}" for i in range(11)])
    got = pa.Table.from_batches(list(tiles._nearest(4, "cosine", None, False, 0)(iter([batch])))).to_pylist()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for i in range(16):
        sim = np.round(u[i] @ u.T, 9)
        want = sorted((-s, j) for j, s in enumerate(sim.tolist()) if j != i)[:4]
        assert [j for _, j in sorted((-x["sim"], x["id"]) for x in got if x["query_id"] == i)] == [j for _, j in want]
    # a hundred blocks of 16 x 4 pairs at least would come without a floor
    assert sum(added) < 0.5 * 100 * 16 * 4


def test_reranking_scores_the_first_pairs_only(spark):
    from quoin.plans import scoring

    r = np.random.default_rng(4)
    e = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    first = retrieval.knn(e.where("vec_id < 6"), e, 7)
    again = retrieval.scored_again(first, e, e, "l2")
    assert again.count() == 42 and "1073741824" not in scoring.reranked.__code__.co_consts.__repr__()
    v = {x.vec_id: np.array(x.embedding) for x in e.collect()}
    assert all(x.sim == pytest.approx(-((v[x.query_id] - v[x.id]) ** 2).sum(), abs=1e-8) for x in again.collect())


def test_a_search_of_cells_ranks_k_rows_of_each(spark, monkeypatch):
    asked = []
    plain = retrieval.candidates
    monkeypatch.setattr(retrieval, "candidates", lambda q, i, k, **kw: (asked.append(k), plain(q, i, k, **kw))[1])
    r = np.random.default_rng(6)
    e = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    centre = retrieval.fit_centroids(e, 8)
    got = retrieval.knn_cells(e.where("vec_id < 20"), retrieval.build_cells(e, centre, 3), centre, 5, 8)
    want = retrieval.knn(e.where("vec_id < 20"), e, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and asked == [5]


def test_patterns_meet_by_two_literals_and_copies_are_counted_not_made(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, r.choice([None, f"name{i % 3}/kind/{r.randrange(100, 104)}/{i % 7}"])) for i in range(200)]
    listed = [(i, r.choice([None, "", f"^name{i % 4}/.*/{r.randrange(100, 105)}/", "kind/10[0-2]", "0/3$"])) for i in range(90)]
    df, table = spark.createDataFrame(rows, "k long, v string"), spark.createDataFrame(listed, "pattern_id long, pattern string")
    assert patterns._two(patterns._runs_of(r"^ab/cd/.*/123/[0-9]*5$")) == ("ab/cd/", "/123/")
    each = patterns.pattern_table_join(df, "k", "v", table)
    want = sorted(map(tuple, each.groupBy("k").agg(F.count("*"), F.min("pattern_id")).collect()))
    import re

    assert sorted(map(tuple, each.collect())) == sorted((k, i) for k, v in rows if v is not None for i, p in listed if p is not None and re.search(p, v))
    made = []
    plain = patterns._matches
    monkeypatch.setattr(patterns, "_matches", lambda rows, p, kind: (made.append(out := plain(rows, p, kind)), out)[1])
    assert sorted(map(tuple, patterns.pattern_table_counts(df, "k", "v", table).collect())) == want
    values, kinds = {v for _, v in rows if v is not None}, {p for _, p in listed if p is not None}
    assert made[0].count() <= len(values) * len(kinds) < each.count()


def test_steps_of_eigenvalues_leave_no_vectors_behind(spark, monkeypatch):
    names, gone = [], []
    plain, drop = spectral.written, spectral.discard
    monkeypatch.setattr(spectral, "written", lambda df, name: (names.append(name), plain(df, name))[1])
    monkeypatch.setattr(spectral, "discard", lambda df: (gone.append(len(df.inputFiles())), drop(df)))
    edges = [(i, i + 1, 1.0) for i in range(60)]
    got = spectral.smallest_eigenvalues(spark.createDataFrame(edges, "a long, b long, weight double"), 3, block=4)
    assert got == pytest.approx([1 - np.cos(np.pi * i / 60) for i in range(3)], abs=1e-8)
    assert len(names) > 4 and len(gone) == len(names) and all(gone)


def _meetings(r):
    rows = [("all", i) for i in range(90)] + [(f"g{g}", i - 5) for g in range(70) for i in {0, *(r.randrange(150) for _ in range(4))}] + [(None, 3), (None, 400), ("g1", None), ("one", 500)]
    return rows + rows[:20]


def test_the_laplacian_of_shared_groups_shuffles_no_edges(spark, monkeypatch):
    from quoin.plans import relations

    df = spark.createDataFrame(_meetings(random.Random(7)), "g string, i int")
    want = {(x.a, x.b): x.value for x in graphs.normalised_laplacian(joins.co_occurrence(df, "g", "i").withColumnRenamed("n", "weight")).collect()}
    for most, chunk in ((1 << 21, 1024), (300, 40)):
        monkeypatch.setattr(joins, "PAIRS", most)
        monkeypatch.setattr(joins, "CHUNK", chunk)
        got = graphs.shared_laplacian(df, "g", "i")
        assert got.count() == len(want) and {(x.a, x.b): x.value for x in got.collect()} == pytest.approx(want)
    plan = relations.laplacian(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(a" not in plan and plan.count("Exchange") - plan.count("BroadcastExchange") <= 1


def test_pairs_travel_in_few_bytes_and_come_back(monkeypatch):
    from quoin.operators import packs

    r = np.random.default_rng(8)
    lists = [sorted(r.choice(60000, 30, replace=False).tolist()) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), pa.array([None] * len(lists), pa.list_(pa.int64()))], names=["mine", "right"])
    sent = pa.Table.from_batches(list(packs.sender(20, 1 << 21, [], 16, False, False)(iter([batch])))).to_pylist()
    pairs = [(a, b) for row in sent for a, b in zip(*(x.tolist() for x in packs.pairs_of(row["blob"])), strict=True)]
    assert sorted(pairs) == sorted((x, y) for s in lists for i, x in enumerate(s) for y in s[i + 1 :])
    assert sum(len(row["blob"]) for row in sent) < 3 * len(pairs)
    assert all(len({row["task"] for row in sent if a in packs.pairs_of(row["blob"])[0]}) == 1 for a in [p[0] for p in pairs[:20]])


def test_cells_of_a_triangle_are_written_where_their_pairs_are_counted(spark, monkeypatch):
    rows = _meetings(random.Random(11))
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    items = sorted({i for _, i in rows if i is not None})
    want = {(a, b): sum(a in s and b in s for s in groups.values()) for a in items for b in items if a >= b}
    df = spark.createDataFrame(rows, "g string, i int")
    for most, chunk in ((1 << 21, 1024), (300, 40)):
        monkeypatch.setattr(joins, "PAIRS", most)
        monkeypatch.setattr(joins, "CHUNK", chunk)
        got = joins.lower_triangle(df, "g", "i")
        assert got.count() == len(want) and {(x.a, x.b): x.n for x in got.collect()} == want and want[400, 400] == 0
    monkeypatch.undo()
    # pairs are read once and shuffled once, as blobs; what is counted is neither written nor shuffled again
    plan = joins.lower_triangle(df, "g", "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "hashpartitioning(a" not in plan and "SortMergeJoin" not in plan


def test_support_of_edges_travels_by_the_number_of_a_mark(spark, monkeypatch):
    r = random.Random(13)
    rows = [(i, g, r.choice("ANR"), r.choice([True, False, None])) for i, g in ((r.randrange(40), r.randrange(60)) for _ in range(900))] + [(i, 99, "A", None) for i in range(50)] + [(None, 1, "A", True), (1, None, "A", True)]
    df = spark.createDataFrame(rows, "node int, part long, flag string, sure boolean")
    args = ("node", "part", F.col("sure"), F.col("flag") == "N", "flag")
    plain = lambda out: sorted((x.a, x.b, x.n, x.n_strong, x.n_not_weak, str(x.any_strong), tuple(x["sample"]), tuple(sorted(x.grades.items()))) for x in out.collect())
    monkeypatch.setattr(graphs, "MARKS", -1)
    want = plain(graphs.shared_edges(df, *args))
    monkeypatch.setattr(graphs, "MARKS", 4096)
    for most, chunk in ((1 << 21, 1024), (200, 20)):
        monkeypatch.setattr(joins, "PAIRS", most)
        monkeypatch.setattr(joins, "CHUNK", chunk)
        got = graphs.shared_edges(df, *args)
        assert plain(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(a" not in plan
