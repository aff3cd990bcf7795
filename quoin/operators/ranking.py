"""Row numbers within groups, however few and large the groups are, and what is built on them: best shares, splits, balancing, pairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quoin.operators.scans import ranged

def seeded_key(key: str, seed: int) -> Column:
    """What seeded orders go by, so that reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """df with its row number in its group, in that order; total: a column for the group's size.

    Rows are dealt to ranges of group and order, once and into the shared folder, and numbered within their range; what a range adds to is the
    number of rows that its first group has in earlier ranges. So a task sorts one range, whatever the sizes of the groups.
    """
    placed = ranged(df, group, order)
    sizes = placed.groupBy(*group, "__range").agg(F.count("*").alias("__rows"))
    if group:
        w = Window.partitionBy(*group)
        sums = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), (F.sum("__rows").over(w.orderBy("__range")) - F.col("__rows")).alias("__before"), F.sum("__rows").over(w).alias("__total"), F.count("*").over(w).alias("__ranges"))
        on = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)), F.col("__range") == F.col("__r"))
        # only groups that go on in another range: at most two rows a range
        placed = placed.join(F.broadcast(sums.where("__ranges > 1")), on, "left").drop("__r", "__ranges", *[f"__g{i}" for i in range(len(group))])
    else:
        rows = dict(sizes.collect())  # one row a range
        before = {r: sum(n for q, n in rows.items() if q < r) for r in rows}
        at = F.create_map(*[F.lit(x) for r in before for x in (r, before[r])])[F.col("__range")] if rows else F.lit(0)
        placed = placed.withColumns({"__before": at, "__total": F.lit(sum(rows.values()))})
    own = Window.partitionBy(*group, "__range")
    out = placed.withColumn(rank, (F.coalesce("__before", F.lit(0)) + F.row_number().over(own.orderBy(*order))).cast("long"))
    keep = [*df.columns, rank]
    if total:
        out, keep = out.withColumn(total, F.coalesce("__total", F.count("*").over(own)).cast("long")), [*keep, total]
    return out.select(*keep)


def ranked_by_score(df: DataFrame, group: list[str], score: str, tie: list[str], rank: str = "rank", total: str | None = None) -> DataFrame:
    """ranked() by falling score, nulls last, ties by the tie columns."""
    return ranked(df, group, [F.col(score).desc_nulls_last(), *map(F.col, tie)], rank, total)


def ranked_by_seed(df: DataFrame, group: list[str], key: str, seed: int = 0, rank: str = "rank", total: str | None = None) -> DataFrame:
    """ranked() by a seeded hash of the key."""
    return ranked(df, group, [seeded_key(key, seed), F.col(key)], rank, total)


def top_percent(df: DataFrame, group: str | None, score: str, percent: float, tie: str) -> DataFrame:
    """The ceil(percent of its rows) rows of each group, or of all, with the highest scores."""
    out = ranked_by_score(df, [group] if group else [], score, [tie], "__rank", "__n")
    return out.where(F.col("__rank") <= F.ceil(F.col("__n") * percent / 100)).drop("__rank", "__n")


def top_fraction(df: DataFrame, group: str, score: str, fraction: float, tie: str) -> DataFrame:
    """The floor(fraction of its rows) rows of each group with the highest scores; none of a small group."""
    out = ranked_by_score(df, [group], score, [tie], "__rank", "__n")
    return out.where(F.col("__rank") <= F.floor(F.col("__n") * F.lit(fraction))).drop("__rank", "__n")


def stratified_split(df: DataFrame, stratum: str, key: str, test_percent: int, seed: int = 0) -> DataFrame:
    """df with part: of each stratum floor(percent) rows are test, the others train."""
    out = ranked_by_seed(df, [stratum], key, seed, "__rank", "__n")
    return out.withColumn("part", F.when(F.col("__rank") * 100 <= F.col("__n") * test_percent, "test").otherwise("train")).drop("__rank", "__n")


def prefix_split(df: DataFrame, key: str, shares: dict[str, float], rest: str, seed: int = 0) -> DataFrame:
    """df with part: in seeded order the first round(share) rows for each named part in turn (halves to even), what is left for the rest."""
    out, part, upto = ranked_by_seed(df, [], key, seed, "__rank", "__n"), F.lit(rest), F.lit(0)
    bounds = []
    for name, share in shares.items():
        upto = upto + F.bround(F.col("__n") * F.lit(share)).cast("long")
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        part = F.when(F.col("__rank") <= bound, name).otherwise(part)
    return out.withColumn("part", part).drop("__rank", "__n")


def alternating_split(df: DataFrame, key: str, names: tuple[str, str], seed: int = 0) -> DataFrame:
    """df with part: in seeded order the rows get the two names by turns."""
    out = ranked_by_seed(df, [], key, seed, "__rank")
    return out.withColumn("part", F.when(F.col("__rank") % 2 == 1, names[0]).otherwise(names[1])).drop("__rank")


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """df with part, the same for all rows of a group: groups in seeded order up to floor(cumulative share of their number); the last part takes the rest."""
    groups = ranked_by_seed(df.select(group).distinct(), [], group, seed, "__rank", "__n")
    names, part, upto, bounds = list(shares), F.lit(list(shares)[-1]), 0.0, []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append((name, F.floor(F.col("__n") * F.lit(round(upto, 9)))))
    for name, bound in reversed(bounds):
        part = F.when(F.col("__rank") <= bound, name).otherwise(part)
    groups = groups.select(F.col(group).alias("__group"), part.alias("part"))
    return df.join(groups, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def balanced(df: DataFrame, label: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The first rows of each label, as many as the smallest label has, and at most limit // number of labels."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"), F.count("*").alias("__labels"))
    most = F.col("__least") if limit is None else F.least("__least", F.floor(F.lit(limit) / F.col("__labels")))
    out = ranked(df, [label], [F.col(c).asc_nulls_first() for c in order], "__rank")
    # one row
    return out.join(F.broadcast(counts)).where(F.col("__rank") <= most).select(*df.columns)


def pair_off(a: DataFrame, b: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """by, a, b: each row of a with one row of b of the same `by`, no row of b used twice; rows without partner are left out."""
    numbered = lambda df, name: ranked_by_seed(df.select(by, key), [by], key, seed, "__n").select(by, F.col(key).alias(name), "__n")
    return numbered(a, "a").join(numbered(b, "b"), [by, "__n"]).drop("__n")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that with the largest order; a null order is the smallest."""
    rest = [c for c in df.columns if c != key]
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("__r")).select(key, "__r.*")


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order (nulls first)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(key, "__r.*").select(*df.columns)


def batches(df: DataFrame, label: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """df with batch: rows of a label in seeded order in full batches of `size`; the incomplete last batch is dropped."""
    out = ranked_by_seed(df, [label], key, seed, "__rank", "__n").withColumn("batch", F.floor((F.col("__rank") - 1) / size))
    return out.where(F.col("batch") < F.floor(F.col("__n") / size)).drop("__rank", "__n")


def ordinal(df: DataFrame, value: str, order: str | None = None, name: str = "ordinal") -> DataFrame:
    """df with the number of its value from 0: by value, or by where the value first appears in `order`."""
    per = df.groupBy(value).agg(F.min(order or value).alias("__first"))
    numbers = ranked(per, [], [F.col("__first"), F.col(value)], "__rank").select(F.col(value).alias("__value"), (F.col("__rank") - 1).alias(name))
    return df.join(numbers, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def consecutive_pairs(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """pair, first, second: rows in seeded order, two by two; a last single row has no second."""
    out = ranked_by_seed(df.select(key), [], key, seed, "__rank").withColumn("pair", F.floor((F.col("__rank") - 1) / 2))
    side = lambda odd: F.max(F.when(F.col("__rank") % 2 == odd, F.col(key)))
    return out.groupBy("pair").agg(side(1).alias("first"), side(0).alias("second"))


def repeated(df: DataFrame, times: int) -> DataFrame:
    """df `times` times, with the number of the round."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(times))))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raises if a key is in both."""
    shared = a.select(key).intersect(b.select(key)).limit(1).collect()
    if shared:
        raise ValueError(f"{key} {shared[0][0]!r} is on both sides")


def missing_values(domain: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The values of the domain that df lacks."""
    return domain.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def completed(df: DataFrame, domain: DataFrame, keys: list[str], rest: dict[str, object]) -> DataFrame:
    """A row of df for each row of the domain's keys (null keys included), with the given values where df has none; rows of df outside the domain are left out."""
    own = df.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], *rest)
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)))
    out = domain.select(*keys).distinct().join(own, on, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in rest.items()])


def first_seeded(df: DataFrame, group: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """The first k rows of each group, or of all, in seeded order; each task passes on k rows of a group at most."""
    if not group:
        return df.orderBy(seeded_key(key, seed), key).limit(k)
    w = Window.partitionBy(*group).orderBy(seeded_key(key, seed), key)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= k).drop("__at")


def by_distance_from_mean(df: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    """df with distance from the mean vector of its label, and its rank by that (ties by key); null vectors count for nothing and have neither."""
    known = df.where(F.col(vector).isNotNull())
    sums = known.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # a row per label and place: the mean of a label is as long as one vector
    mean = sums.groupBy(F.col(label).alias("__label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("__mean"))
    near = known.join(mean, F.col(label).eqNullSafe(F.col("__label")))
    apart = F.sqrt(F.aggregate(F.zip_with(vector, "__mean", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    return ranked(near.withColumn("distance", apart).select(*df.columns, "distance"), [label], [F.round("distance", 9), F.col(key)], "rank")
