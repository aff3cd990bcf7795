"""Toxicity scores from non-negative positive-unlabelled learning in numpy.

Training data are confirmed toxic texts and texts drawn from the corpus regardless of label; non-toxic labels are used only
to estimate the class prior and to calibrate. Features are word and word-prefix frequencies of the text alone (log(1 + count), weighted by
their log lift in the confirmed texts), and its length. A linear classifier minimises the logistic loss's risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)):
where a batch drives the bracket below zero, the step goes against it, as a flexible model would else fit the unlabelled
toxic texts as clean. The decision is calibrated last: a logistic curve over the decisions of fits
on the other FOLDS - 1 folds, for labelled rows of the training split, both classes with the same weight.
So a score is the probability of a toxic label where both are as frequent: the cut depends neither on the corpus's toxic share
nor on that of the labels.

Vocabulary sums and the moments of length come from all texts of the training split, confirmed ones and others. The rows of
the gradient steps and of the calibration are those with the smallest seeded hashes, at most MAX_POSITIVE, MAX_UNLABELLED
and MAX_CLEAN of each kind, written once to the shared folder; only the names of at most MAX_FEATURES features, the lifts of those that count and the sparse
rows over the chosen vocabulary reach the driver. The risk's unlabelled mean is over MAX_UNLABELLED texts, so that its standard error is
that of one text over 126. A fold's fit has its vocabulary and lifts from the other folds' confirmed texts, so that calibration sees decisions
on labels that had no part in them. Scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts are scored as short texts without features, which are not toxic (lengths count within REACH spreads); labels with a null id or null label are
unlabelled; of several labels of one id the highest counts; without confirmed texts all scores are 0; an empty table gives an
empty result; a null id is not held out; columns other than id and text are never read by a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice, repeat
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import map_texts, materialize, table

MAX_POSITIVE = 8000
MAX_UNLABELLED = 16000
#: Rows with a non-toxic label, for calibration.
MAX_CLEAN = 8000
#: Features that a model may choose from, those of the largest sums in confirmed texts; and confirmed ids that are sent to all executors.
MAX_FEATURES, SENT = 400_000, 1 << 20
FOLDS = 3
PREFIXES = (4, 5, 6, 7)
#: A feature counts if its values in confirmed texts sum to this, and its log lift exceeds LIFT.
SUPPORT, SMOOTH, LIFT = 2.0, 2.0, 1.0
POSITIVE, UNLABELLED, CLEAN = 1, 0, 2
#: No feature, as words hold no space.
MOMENTS = (" texts", " words", " squares")
EPOCHS, BATCHES, RATE, L2, SEED = 60, 10, 0.02, 2e-3, 11
THRESHOLD = 0.7
#: Spreads from the mean at which a length counts as no shorter or longer: a text is not toxic for being short.
REACH = 1.0
#: Characters of texts that are counted at a time, and features that leave a task at a time.
TOGETHER = 1 << 19
_EDGE = ".,;:!?%$&*#|\"'()[]{}<>-_"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for evaluation only."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _one_by_one(column: pa.Array) -> Iterator:
    """A column's values as Python's, never all at once: a batch's texts take several times their bytes as str."""
    return (x.as_py() for x in column)


def features(text: str) -> tuple[dict[str, int], int]:
    words = text.lower().split()
    out: Counter = Counter()
    for word, n in Counter(words).items():
        word = word.strip(_EDGE)
        if word:
            out[word] += n
            for k in PREFIXES:
                if len(word) >= k:
                    out["^" + word[:k]] += n
    return out, len(words)


class Counts:
    """Counts of known features, of many texts at a time. Arrow splits the texts; a group's distinct words and distinct heads of words are looked up once each, all else is arrays."""

    def __init__(self, known: Iterable[str]) -> None:
        self.number = {x: i for i, x in enumerate(known)}

    def of_texts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words of each text, row, feature, count) of groups of texts of about TOGETHER characters; features of a row are those of features(), as far as known."""
        group, size = [], 0
        for text in texts:
            group.append((text or "").lower())
            size += len(group[-1])
            if size >= TOGETHER:
                yield self._counted(group)
                group, size = [], 0
        if group:
            yield self._counted(group)

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """Of each name the number as a feature; -1 if it isn't known."""
        names = names.dictionary_encode()
        each = names.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() takes several times as long
        return np.fromiter(map(self.number.get, each, repeat(-1)), np.int64, len(each))[names.indices.to_numpy()]

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Known features of all words, one word's after the other's; and how many each word has."""
        bare = pc.utf8_trim(words, _EDGE)
        length = pc.utf8_length(bare).to_numpy()
        at, found = [np.arange(len(bare))], [self._numbers(bare)]
        mark, none = pa.scalar("^", bare.type), pa.scalar("", bare.type)
        for k in PREFIXES:
            at.append(np.flatnonzero(length >= k))
            heads = pc.utf8_slice_codeunits(bare.filter(pa.array(length >= k)), 0, k)
            found.append(self._numbers(pc.binary_join_element_wise(mark, heads, none)))
        word, feature = np.concatenate(at), np.concatenate(found)
        word, feature = word[feature >= 0], feature[feature >= 0]
        return feature[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(bare))

    def _counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))  # at the characters that str.split() takes
        row, tokens = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy()), split.flatten().dictionary_encode()
        word, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
        # white space at either end of a text leaves an empty word
        size = np.bincount(row[(pc.binary_length(words).to_numpy() > 0)[word]], minlength=len(texts))
        flat, has = self._known(words)
        some = has[word] > 0
        both, n = np.unique(row[some] * max(1, len(words)) + word[some], return_counts=True)
        row, word = np.divmod(both, max(1, len(words)))
        times = has[word]
        take = np.repeat((np.cumsum(has) - has)[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        key, place = np.unique(np.repeat(row, times) * max(1, len(self.number)) + flat[take], return_inverse=True)
        count = np.bincount(place, np.repeat(n, times), len(key))
        row, feature = np.divmod(key, max(1, len(self.number)))
        return size, row, feature, count


@dataclass
class Model:
    """Weights per feature, bias, and the weight, mean and spread of log(1 + words)."""

    prior: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    length: tuple[float, float, float] = (0.0, 0.0, 1.0)

    def scores(self, texts: Iterable[str | None], counts: Counts) -> Iterator[np.ndarray]:
        """Scores of groups of texts, which are taken one by one, so that few are at hand. counts: of the weights' features."""
        if not self.weights:
            yield np.zeros(sum(1 for _ in texts))
            return
        weight, (w, mean, spread) = np.array([self.weights[x] for x in counts.number]), self.length
        for words, row, feature, count in counts.of_texts(texts):
            z = self.bias + w * np.clip((np.log1p(words) - mean) / spread, -REACH, REACH) + np.bincount(row, weight[feature] * np.log1p(count), len(words))
            yield 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: Iterable[str | None], counts: Counts | None = None) -> np.ndarray:
        return np.concatenate([np.zeros(0), *self.scores(texts, counts or Counts(self.weights))])


def fit_nnpu(x: tuple[np.ndarray, np.ndarray, np.ndarray], dense: np.ndarray, positive: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """x: feature numbers, values and row ends. Weights of n features, and bias and weight of the dense column: means over the last third."""
    index, value, ends = x
    size = np.diff(ends)
    rng = np.random.default_rng(SEED)
    theta = np.concatenate([np.full(n, 0.1), [-2.0, 0.0]])
    m, v, step, mean, late = np.zeros(n + 2), np.zeros(n + 2), 0, np.zeros(n + 2), 0
    rows = np.flatnonzero(positive), np.flatnonzero(~positive)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def part(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        take = np.repeat(ends[at] - np.append(0, np.cumsum(size[at])[:-1]), size[at]) + np.arange(size[at].sum())
        row = np.repeat(np.arange(len(at)), size[at])
        return index[take], value[take], row

    for epoch in range(EPOCHS):
        for at in zip(*(np.array_split(rng.permutation(r), BATCHES) for r in rows), strict=True):
            if not all(map(len, at)):
                continue
            parts = [part(a) for a in at]
            zp, zu = (np.bincount(r, theta[i] * w, len(a)) + theta[n] + theta[n + 1] * dense[a] for (i, w, r), a in zip(parts, at, strict=True))
            unlabelled = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if unlabelled >= 0:
                gp, gu = prior * (-sigmoid(-zp) - sigmoid(zp)) / len(zp), sigmoid(zu) / len(zu)
            else:
                gp, gu = prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)
            g = np.zeros(n + 2)
            for (i, w, r), a, of in zip(parts, at, (gp, gu), strict=True):
                g[:n] += np.bincount(i, of[r] * w, n)
                g[n:] += of.sum(), (of * dense[a]).sum()
            g[:n] += L2 * theta[:n]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if epoch >= EPOCHS * 2 // 3:
                late += 1
                mean += (theta - mean) / late
    return mean[:n], mean[n:]


def _calibrate(z: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of a toxic label over decisions: Newton steps, with a slight pull on the slope towards 1. The slope is above 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = weight * (q - positive), weight * np.maximum(q * (1 - q), 1e-6)
        g = np.array([(d * z).sum() + 0.1 * (a - 1), d.sum()])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), g)
        a, b = np.array([a, b]) - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    if a <= 0:  # happens where labels are few, and would turn the ranking round: only the intercept is fitted
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            step = (weight * (q - positive)).sum() / ((weight * np.maximum(q * (1 - q), 1e-6)).sum() + 1e-6)
            b -= np.clip(step, -2, 2)
            if abs(step) < 1e-9:
                break
    return float(a), float(b)


def _fold(text: str | None) -> int:
    return crc32((text or "").encode()) % FOLDS


def _sums(known: list[str] | None):
    """Texts to per-task sums of log(1 + count) by feature, and by MOMENTS: of 1, log(1 + words) and its square. known: which features count; without, all do, by the text's fold."""

    def table(fold: int, total: dict[str, float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([fold] * len(total), pa.int32()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["fold", "feature", "value"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[dict[str, float]] = [{} for _ in range(FOLDS)]
        for batch in batches:
            for text in _one_by_one(batch.column(0)):
                fold, (found, words) = _fold(text), features(text or "")
                total = totals[fold]
                for x, v in zip(MOMENTS, (1.0, log1p(words), log1p(words) ** 2), strict=True):
                    total[x] = total.get(x, 0.0) + v
                for x, n in found.items():
                    total[x] = total.get(x, 0.0) + log1p(n)
                if len(total) > 200_000:
                    yield table(fold, total)
                    total.clear()
        for fold, total in enumerate(totals):
            yield table(fold, total)

    def of_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, moments = Counts(names.split("\n") if names else []), np.zeros(3)
        total = np.zeros(len(counts.number))
        for batch in batches:
            for words, _, feature, count in counts.of_texts(_one_by_one(batch.column(0))):
                logs = np.log1p(words)
                moments += len(words), logs.sum(), (logs**2).sum()
                total += np.bincount(feature, np.log1p(count), len(total))
        yield table(0, dict(zip(MOMENTS, moments.tolist(), strict=True)))
        some = (x for x in zip(counts.number, total.tolist(), strict=True) if x[1])
        while part := dict(islice(some, TOGETHER)):
            yield table(0, part)

    names = "\n".join(known or [])  # one string, which a task takes apart once; features hold no space
    return every if known is None else of_known


def _sparse(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary)
        for batch in batches:
            keys, kinds, texts = batch.columns
            fold = pa.array([_fold(x) for x in _one_by_one(texts)], pa.int32())
            first = 0
            for words, row, feature, count in counts.of_texts(_one_by_one(texts)):
                ends = pa.array(np.searchsorted(row, np.arange(len(words) + 1)), pa.int32())
                index, value = (pa.ListArray.from_arrays(ends, x) for x in (pa.array(feature, pa.int32()), pa.array(np.log1p(count))))
                part = [x.slice(first, len(words)) for x in (keys, kinds, fold)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(words, pa.int32()), index, value], names=["key", "kind", "fold", "words", "index", "value"])
                first += len(words)

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from rows of the training split: labels of held-out ids are never read."""
    marks = labels.where(~held_out(F.col(id_col))).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    n, toxic = marks.agg(F.count("*"), F.sum((F.col("label") == 1).cast("long"))).first()
    if not toxic:
        return Model()
    prior = min(max(toxic / n, 1e-4), 0.9)
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key = F.xxhash64("id", F.lit(SEED))
    confirmed = rows.select("id").join(marks.where("label = 1"), "id").select("id").distinct().orderBy(key, "id").limit(MAX_POSITIVE)
    any_row = rows.select("id").distinct().orderBy(key, "id").limit(MAX_UNLABELLED)
    clean = rows.select("id").join(marks.where("label = 0"), "id").select("id").distinct().orderBy(key, "id").limit(MAX_CLEAN)
    kinds = {POSITIVE: confirmed, UNLABELLED: any_row, CLEAN: clean}
    chosen = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(k)) for k, df in kinds.items()))
    # at most MAX_POSITIVE + MAX_UNLABELLED + MAX_CLEAN ids
    sample = materialize(rows.join(F.broadcast(chosen), "id").select("id", "kind", "text"))
    counted = {kind: c for kind, c in sample.groupBy("kind").count().collect()}
    if not counted.get(POSITIVE) or not counted.get(UNLABELLED):
        return Model()

    def sums(of: DataFrame, known: list[str] | None) -> DataFrame:
        return map_texts(of.select("text"), _sums(known), "fold int, feature string, value double").groupBy("fold", "feature").agg(F.sum("value").alias("value"))

    # every confirmed text, and every text of the training split; confirmed ids that are too many to send go by a shuffle
    ids = marks.where("label = 1").select("id")
    by_fold = materialize(sums(rows.join(F.broadcast(ids) if toxic <= SENT else ids, "id", "left_semi"), None))
    moments = dict(by_fold.where(F.col("feature") == MOMENTS[0]).select("fold", "value").collect())  # one row a fold
    often = by_fold.where(~F.col("feature").isin(*MOMENTS)).groupBy("feature").agg(F.sum("value").alias("value")).where(F.col("value") >= SUPPORT)
    often = often.orderBy(F.desc("value"), "feature").limit(MAX_FEATURES).select("feature")
    per_fold = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("value"))), F.lit(0.0)).alias(f"p{k}") for k in range(FOLDS)]
    p = materialize(by_fold.join(often, "feature", "left_semi").groupBy("feature").agg(*per_fold))
    of_fold = [moments.get(k, 0.0) for k in range(FOLDS)]
    # at most MAX_FEATURES names; the sums of all texts meet those of confirmed ones in Spark
    u = materialize(sums(rows, p.select("feature").toArrow()["feature"].to_pylist()).drop("fold"))
    nu_all, total, squares = (dict(u.where(F.col("feature").isin(*MOMENTS)).collect())[x] for x in MOMENTS)
    mean = total / nu_all
    spread = max(squares / nu_all - mean * mean, 0.0) ** 0.5 or 1.0

    def lift_of(without: int | None) -> Column:
        """Log lift by confirmed texts, those of one fold left out; 0 if it isn't over LIFT."""
        n_p = sum(of_fold) - (0.0 if without is None else of_fold[without])
        if not n_p:
            return F.lit(0.0)
        v = sum((F.col(f"p{k}") for k in range(FOLDS)), F.lit(0.0)) - (F.lit(0.0) if without is None else F.col(f"p{without}"))
        found = F.log((v + SMOOTH * n_p / nu_all) / n_p / ((F.coalesce("value", F.lit(0.0)) + SMOOTH) / nu_all))
        return F.when((v >= SUPPORT) & (found > LIFT), found).otherwise(0.0)

    lifts = p.join(u, "feature", "left").select("feature", *[lift_of(k).alias(f"lift{i}") for i, k in enumerate([None, *range(FOLDS)])])
    lifts = lifts.where(" OR ".join(f"lift{i} > 0" for i in range(FOLDS + 1))).toArrow().sort_by("feature")
    vocabulary = lifts["feature"].to_pylist()
    scale, *fold_scales = (lifts[f"lift{i}"].to_numpy() for i in range(FOLDS + 1))
    if not len(scale) or not scale.any():
        return Model()
    got = map_texts(sample.select("id", "kind", "text"), _sparse(vocabulary), "key long, kind int, fold int, words int, index array<int>, value array<double>").toArrow().sort_by([("kind", "ascending"), ("key", "ascending"), ("words", "ascending")])
    ends = np.append(0, np.cumsum(np.array([len(x) for x in got["index"].to_pylist()], np.int64)))
    index = got["index"].combine_chunks().flatten().to_numpy()
    raw = got["value"].combine_chunks().flatten().to_numpy()
    words = np.log1p(got["words"].to_numpy())
    kind = got["kind"].to_numpy()
    dense = np.clip((words - mean) / spread, -REACH, REACH)

    def fit(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at[kind[at] != CLEAN]
        taken = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in at])
        x = index[taken], value[taken], np.append(0, np.cumsum(np.diff(ends)[at]))
        return fit_nnpu(x, dense[at], kind[at] == POSITIVE, len(vocabulary), prior)

    every, fold = np.arange(len(dense)), got["fold"].to_numpy()
    row = np.repeat(every, np.diff(ends))
    w, (bias, length) = fit(every, raw * scale[index])
    z = np.zeros(len(dense))
    for k in range(FOLDS):
        rest = every[fold != k]
        # features of a fold's fit come from the other folds' labels too
        value = raw * fold_scales[k][index]
        if (kind[rest] == POSITIVE).any() and (kind[rest] == UNLABELLED).any() and fold_scales[k].any():
            wk, (bk, lk) = fit(rest, value)
        else:
            wk, bk, lk, value = w, bias, length, raw * scale[index]
        z = np.where(fold == k, np.bincount(row, wk[index] * value, len(dense)) + bk + lk * dense, z)
    marked = kind != UNLABELLED
    if (kind == CLEAN).any():
        of_class = {POSITIVE: 0.5 * marked.sum() / counted[POSITIVE], CLEAN: 0.5 * marked.sum() / counted[CLEAN]}
        slope, shift = _calibrate(z[marked], kind[marked] == POSITIVE, np.array([of_class[k] for k in kind[marked]]))
        w, bias, length = w * slope, bias * slope + shift, length * slope
    return Model(prior, {x: float(a * s) for x, a, s in zip(vocabulary, w, scale, strict=True) if s}, float(bias), (float(length), mean, spread))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(model.weights)
        for batch in batches:
            first = 0
            for scores in model.scores(_one_by_one(batch.column(at)), counts):
                part = batch.slice(first, len(scores))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*batch.schema.names, out])
                first += len(scores)

    return map_texts(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
