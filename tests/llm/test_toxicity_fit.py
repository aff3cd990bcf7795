"""The whole toxicity model against a plain dense one whose gradients are derivatives of the written-out risk."""

import random
import zlib
from math import log, log1p

import numpy as np

from quoin.llm import toxicity as t


def _gradient(risk, theta):
    out = np.zeros(len(theta))
    for i in range(len(theta)):
        step = theta.astype(complex)
        step[i] += 1e-30j
        out[i] = risk(step).imag / 1e-30
    return out


def _plain_fit(x, dense, positive, prior):
    n = x.shape[1]
    full = np.hstack([x, np.ones((len(x), 1)), dense[:, None]])
    rng, rows = np.random.default_rng(t.SEED), (np.flatnonzero(positive), np.flatnonzero(~positive))
    theta, m, v, step, late = np.concatenate([np.full(n, 0.1), [-2.0, 0.0]]), np.zeros(n + 2), np.zeros(n + 2), 0, []
    loss = lambda z: np.log1p(np.exp(z)).mean()
    for epoch in range(t.EPOCHS):
        for a, b in zip(*(np.array_split(rng.permutation(r), t.BATCHES) for r in rows), strict=True):
            if not len(a) or not len(b):
                continue

            def risk(th, a=a, b=b):
                bracket = loss(full[b] @ th) - prior * loss(full[a] @ th)
                ridge = t.L2 / 2 * (th[:n] ** 2).sum()
                return (prior * loss(-(full[a] @ th)) + bracket if bracket.real >= 0 else -bracket) + ridge

            g = _gradient(risk, theta)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - t.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if epoch >= t.EPOCHS * 2 // 3:
                late.append(theta)
    return np.mean(late, axis=0)


def _plain_scores(docs, labels):
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    marks = {i: y for i, y in labels.items() if not held(i)}
    prior = min(max(sum(marks.values()) / len(marks), 1e-4), 0.9)
    found = {i: t.features(x) for i, x in docs.items()}
    seen = [i for i in docs if not held(i)]
    bad = [i for i in seen if marks.get(i) == 1]
    fold = {i: zlib.crc32(x.encode()) % t.FOLDS for i, x in docs.items()}
    total = lambda ids, x: sum(log1p(found[i][0][x]) for i in ids if x in found[i][0])
    words = sorted({x for i in bad for x in found[i][0]})
    lengths = np.array([log1p(found[i][1]) for i in seen])

    def lifts(ids):
        out = {}
        for x in words:
            p, u, n = total(ids, x), total(seen, x), len(seen)
            if total(bad, x) >= t.SUPPORT and p >= t.SUPPORT:
                r = log((p + t.SMOOTH * len(ids) / n) / len(ids) / ((u + t.SMOOTH) / n))
                if r > t.LIFT:
                    out[x] = r
        return out

    every = {None: lifts(bad)} | {k: lifts([i for i in bad if fold[i] != k]) for k in range(t.FOLDS)}
    names = sorted(set().union(*every.values()))
    rows = [(0, i) for i in sorted(seen)] + [(1, i) for i in sorted(bad)] + [(2, i) for i in sorted(seen) if marks.get(i) == 0]
    kind = np.array([k for k, _ in rows])
    matrix = lambda k, ids: np.array([[log1p(found[i][0].get(x, 0)) * every[k].get(x, 0.0) for x in names] for i in ids])
    spread = lengths.std() or 1.0
    reach = lambda ids: np.clip((np.array([log1p(found[i][1]) for i in ids]) - lengths.mean()) / spread, -t.REACH, t.REACH)
    ids = [i for _, i in rows]

    def fit(k, at):
        at = [i for i in at if kind[i] != 2]
        return _plain_fit(matrix(k, [ids[i] for i in at]), reach([ids[i] for i in at]), kind[at] == 1, prior)

    decide = lambda k, th, ids: np.hstack([matrix(k, ids), np.ones((len(ids), 1)), reach(ids)[:, None]]) @ th
    theta, z = fit(None, range(len(rows))), np.zeros(len(rows))
    for k in range(t.FOLDS):
        at = [i for i in range(len(rows)) if fold[ids[i]] == k]
        z[at] = decide(k, fit(k, [i for i in range(len(rows)) if fold[ids[i]] != k]), [ids[i] for i in at])
    marked = kind != 0
    weight = np.array([0.5 * marked.sum() / (kind == k).sum() for k in kind[marked]])
    slope, shift = t._calibrate(z[marked], kind[marked] == 1, weight)
    order = list(docs)
    return dict(zip(order, 1 / (1 + np.exp(-np.clip(slope * decide(None, theta, order) + shift, -30, 30))), strict=True))


def test_scores_equal_a_plain_dense_model(spark):
    r = random.Random(4)
    mild, foul = [f"word{i}" for i in range(30)], ["vileness", "scumbags", "hateful"]
    bad = {i: i % 5 == 0 for i in range(240)}
    docs = {i: " ".join(r.choices(mild, k=r.randint(2, 20)) + (r.choices(foul, k=r.randint(1, 3)) if bad[i] and r.random() < 0.9 else [])) for i in bad}
    labels = {i: int(bad[i]) for i in bad if i % 2 == 0}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    model = t.train(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in t.score(df, model).collect()}
    want = _plain_scores(docs, labels)
    assert max(abs(got[i] - want[i]) for i in docs) < 1e-6 and max(want.values()) > 0.9 and min(want.values()) < 0.2


def test_confirmed_ids_go_by_a_shuffle_where_they_are_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some mild text {i}" + " vile scum" * (i % 4 == 0)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    sent = t.train(docs, labels)
    monkeypatch.setattr(t, "SENT", 0)
    assert t.train(docs, labels) == sent and sent.weights


def test_scores_come_in_groups_and_names_in_one_string():
    import pyarrow as pa

    from quoin.llm.common import tidy

    texts = [None, "", *(f"bad w{i} " * (i % 90) for i in range(3000))]
    model = t.Model(0.1, {"bad": 1.0, "^w120": -0.5}, -1.0, (0.3, 4.0, 1.0))
    groups = list(model.scores(iter(texts), t.Counts(model.weights)))
    assert len(groups) > 2 and np.array_equal(np.concatenate(groups), model.score(texts)) and np.allclose(model.score(texts), [model.score([x])[0] for x in texts])
    assert t.Model().score(texts).tolist() == [0.0] * len(texts) and model.score([]).tolist() == []
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for known in ([], ["bad", "^w120"]):
        got = {k: v for b in t._sums(known)(iter([batch])) for k, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)}
        assert set(got) == {*t.MOMENTS, *known} and got[" texts"] == len(texts)
    kept = []

    def run(batches):
        held = [bytes(2000) for _ in range(50_000)]
        kept.append(bytes(2000))  # above them in the heap, which so can't shrink by itself
        yield len(held)

    def size():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    before = size()
    assert list(tidy(run)(iter(()))) == [50_000] and size() - before < 30_000_000


def test_distinct_words_are_looked_up_once_and_counts_are_those_of_features():
    class Seen(dict):
        n = 0

        def get(self, *args):
            Seen.n += 1
            return super().get(*args)

        def __contains__(self, key):
            Seen.n += 1
            return super().__contains__(key)

    spaces = [" ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u2009", "\u3000"]
    odd = ["Straße.", "İstanbul", "ΟΔΟΣ,", "ΣΣ", "^abcd", "abcdxyz", "(abcd)", "###", "-_-", "été!", "\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600", "\U00010400\U00010401\U00010402\U00010403\U00010404", "a", "\u200b", ""]
    r = random.Random(5)
    texts = [None, "", " \t", *("".join(r.choice(spaces) + r.choice(odd) for _ in range(r.randint(1, 40))) for _ in range(200))]
    known = sorted({x for y in texts for x in t.features(y or "")[0]})[::2] + ["^wordz", "other"]
    counts = t.Counts(known)
    for given in (texts, texts[:1], texts[3:4]):
        found = []
        for words, row, feature, count in counts.of_texts(given):
            rows = [{} for _ in words]
            for i, x, n in zip(row, feature, count, strict=True):
                rows[i][known[x]] = n
            found += zip(rows, words, strict=True)
        assert found == [({x: n for x, n in f.items() if x in set(known)}, n) for f, n in (t.features(x or "") for x in given)]

    # 40,000 words of few heads: looking up each head of each word took five times as many
    many = [" ".join(f"wordwor{i:05}" for i in range(j, 40_000, 50)) for j in range(50)]
    counts.number = Seen(counts.number)
    assert sum(int(words.sum()) for words, *_ in counts.of_texts(many)) == 40_000 and 0 < Seen.n < 60_000


def test_calibration_never_turns_the_decisions_round():
    z, positive = np.array([-3.0, -2.0, 1.0, 2.0, 3.0]), np.array([True, True, False, False, False])
    weight = np.where(positive, 1.25, 5 / 6)
    slope, shift = t._calibrate(z, positive, weight)
    q = 1 / (1 + np.exp(-(slope * z + shift)))
    assert slope == 1 and abs((weight * (q - positive)).sum()) < 1e-6
    assert t._calibrate(z, ~positive, np.ones(5))[0] > 1
