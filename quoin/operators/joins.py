"""As-of, range, pattern and pairing joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quoin.operators import packs
from quoin.operators.scans import carry_last, has_large_key
from quoin.sources.storage import written

#: A key that one in HOT rows has is joined in SALTS parts; there can't be more than HOT such keys.
HOT, SALTS = 256, 16
#: Pairs that a task makes, and items of a group that are packed together.
PAIRS, CHUNK = 1 << 21, 1024


def asof_join(left: DataFrame, right: DataFrame, by: str | None, on: str, tie: str, values: list[str], whole: bool | None = None) -> DataFrame:
    """left with the values of the latest row of right at or before `on`, within `by` if there is one (of equal times that of the largest tie).

    Both sides are stacked and the last values are carried forward: in one shuffle by key, or, where there is no key or one
    has very many rows (or whole is False), over ranges of key and time.
    """
    carried = F.struct(*[F.col(v) for v in values])
    keys = [by] if by else []
    a = left.select("*", F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType).alias("__c"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.xxhash64(*left.columns).alias("__h"))
    b = right.select(*keys, on, carried.alias("__c"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(0).cast("long").alias("__h"))
    order = [on, "__side", "__tie", "__h"]
    both = a.unionByName(b, allowMissingColumns=True)
    if whole is None:
        whole = by is not None and not has_large_key(both.select(by), by)
    if whole:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn("__last", F.last("__c", ignorenulls=True).over(w))
    else:
        both = carry_last(both, keys, order, "__c", "__last")
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(f"asof_{v}") for v in values])


def range_join(df: DataFrame, ranges: DataFrame, value: str, width: float) -> DataFrame:
    """Rows of df with the ranges (lo, hi, half-open) that hold their value.

    An equi-join on buckets. A range is dealt to its buckets of the width, one of over SALTS such to buckets of a width
    that is SALTS times as large, and so on, so no range becomes more than SALTS + 1 rows; rows look into each level that ranges use.
    """
    spans = ranges.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log(float(SALTS), F.greatest((F.col("hi") - F.col("lo")) / width, F.lit(1.0))) - 1)).cast("int"))
    bucket = lambda c: F.floor(c / (F.pow(F.lit(float(SALTS)), "__level") * width)).cast("long")
    dealt = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # logarithmic in the widest range
    if not levels:
        return df.join(ranges, F.lit(False))
    out = df.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("__b", bucket(F.col(value))).join(dealt, ["__level", "__b"])
    return out.where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("__level", "__b")


def range_assign(df: DataFrame, ranges: DataFrame, value: str, key: str, order: str, label: str, default: Column, width: float, name: str = "assigned") -> DataFrame:
    """df with the label of the first range in order that holds its value, else the default; key: what tells rows of df apart."""
    found = range_join(df.select(key, value), ranges, value, width).groupBy(key).agg(F.min_by(label, order).alias("__label"))
    return df.join(found, key, "left").withColumn(name, F.coalesce("__label", default)).drop("__label")


def dealt_pairs(one: DataFrame, group: str, item: str, extra: list[str] | None = None, carry: bool = True) -> tuple[DataFrame, list[str]]:
    """The rows of self_pairs(), dealt to tasks by their smaller item, and the columns to group a pair by without another shuffle.

    A group is packed into arrays, of each item the larger ones of its group travel in one row, and rows become pairs only where
    they arrive. There are as many tasks as give each about PAIRS pairs (fewer with extra columns), so a task's work and memory stay as they are when tables grow.
    A group of over CHUNK items is packed in chunks, which meet each other in tiles of their own; the pairs of a smaller item that has one in HOT
    of all rows are dealt to SALTS tasks. carry: whether pairs name their group.
    """
    extra, spark = extra or [], one.sparkSession
    most = PAIRS // (1 + len(extra))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = written(one.select(group, item, *extra).where(F.col(item).isNotNull() & F.col(group).isNotNull()), "members")
    sizes = one.groupBy(group).agg(F.count("*").alias("n"))
    met, rows = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n")).first()
    tasks = max(least, math.ceil((met or 0) / most), math.ceil((rows or 0) / most))
    large = sizes.where(F.col("n") > CHUNK).select(group, F.ceil(F.col("n") / CHUNK).cast("int").alias("__chunks"))
    is_large = not large.isEmpty()
    busy = [r[0] for r in one.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") >= max(64, (rows or 0) / HOT)).select(item).collect()]  # at most HOT
    member = F.struct(F.col(item), *[F.col(x) for x in extra]) if extra else F.col(item)
    value = (lambda m: m[item]) if extra else (lambda m: m)
    if is_large:
        one = one.join(large, group, "left").withColumn("__chunk", F.coalesce(F.pmod(F.xxhash64(item), F.col("__chunks")), F.lit(0)).cast("int"))
    at = [group, "__chunk"] if is_large else [group]
    packs = one.repartition(tasks, *at).groupBy(*at).agg(F.sort_array(F.collect_list(member)).alias("__all")).where(F.size("__all") > (0 if is_large else 1))
    own = packs.select(group, F.posexplode("__all").alias("__at", "__m"), "__all")
    found = own.select(group, "__m", F.slice("__all", F.col("__at") + 2, F.size("__all")).alias("__others"))
    if is_large:
        chunks = packs.join(large.select(group), group, "left_semi")
        # each two chunks of a group are a row, which is dealt before it grows
        tiles = chunks.join(chunks.select(group, F.col("__chunk").alias("__other"), F.col("__all").alias("__right")), group).where("__chunk <> __other").repartition(tasks, group, "__chunk", "__other")
        across = tiles.select(group, F.explode("__all").alias("__m"), "__right")
        found = found.unionByName(across.select(group, "__m", F.filter("__right", lambda y: value(y) > value(F.col("__m"))).alias("__others")))
    found = found.where(F.size("__others") > 0).withColumn("a", value(F.col("__m")))
    keys = ["a", "b"]
    deal = []
    if busy:
        salt = lambda y: F.pmod(F.xxhash64(value(y)), F.lit(SALTS)).cast("int")
        is_busy = F.col("a").isin(busy)
        found = found.withColumn("__deal", F.explode(F.when(is_busy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        found = found.withColumn("__others", F.when(is_busy, F.filter("__others", lambda y: salt(y) == F.col("__deal"))).otherwise(F.col("__others"))).where(F.size("__others") > 0)
        deal = ["__deal"]
    mine = [F.col(f"__m.{x}").alias(f"{x}_a") for x in extra]
    kept = [group] if carry else []
    sent = found.select(*kept, "a", *deal, *mine, "__others").repartition(tasks, "a", *deal)
    pair = sent.select(*kept, "a", *deal, *[f"{x}_a" for x in extra], F.explode("__others").alias("__b"))
    pair = pair.select(*kept, "a", value(F.col("__b")).alias("b"), *deal, *[f"{x}_a" for x in extra], *[F.col(f"__b.{x}").alias(f"{x}_b") for x in extra])
    return pair, keys + deal


def self_pairs(one: DataFrame, group: str, item: str, extra: list[str] | None = None) -> DataFrame:
    """group, a, b (a < b) and extra columns of both sides (suffix _a, _b) for each two items of a group; one: distinct group and item. Large groups are dealt to several tasks."""
    return dealt_pairs(one, group, item, extra)[0].drop("__deal")


def packed(df: DataFrame, group: str, item: str, codes: str | None = None) -> DataFrame:
    """__g, __chunk, __all (and __codes): sorted different items of a group (and the code of each), at most CHUNK to a row; written, after one shuffle.

    codes: df has one row of an item and group. A later chunk's items are all larger.
    """
    rows = df.select(F.col(group).alias("__g"), F.col(item).cast("long").alias("__i"), *([F.col(codes).cast("long").alias("__c")] if codes else [])).where("__g IS NOT NULL AND __i IS NOT NULL")
    if not codes:
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / PAIRS))
        rows = rows.repartition(tasks, "__g").distinct()
    at = Window.partitionBy("__g").orderBy("__i")
    dealt = rows.withColumn("__chunk", F.floor((F.row_number().over(at) - 1) / CHUNK).cast("int"))
    if not codes:
        return written(dealt.groupBy("__g", "__chunk").agg(F.sort_array(F.collect_list("__i")).alias("__all")), "packs")
    each = dealt.groupBy("__g", "__chunk").agg(F.sort_array(F.collect_list(F.struct("__i", "__c"))).alias("__m"))
    return written(each.select("__g", "__chunk", F.col("__m.__i").alias("__all"), F.col("__m.__c").alias("__codes")), "packs")


def _sent(packed_: DataFrame, own: bool = False, deal: bool = True) -> DataFrame:
    """task, blob: the pairs of packed() at their tasks, which are as many as give each about PAIRS."""
    spark, coded = packed_.sparkSession, "__codes" in packed_.columns
    sizes = packed_.groupBy("__g").agg(F.sum(F.size("__all").cast("long")).alias("n"), F.count("*").alias("chunks"))
    met, rows, chunks = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n"), F.max("chunks")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((met or 0) / PAIRS), math.ceil((rows or 0) / PAIRS))
    busy = []
    if deal:
        found = packed_.select(F.explode("__all").alias("i")).groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= max(64, (rows or 0) / HOT))
        busy = [r[0] for r in found.select("i").collect()]  # at most HOT
    long = F.array().cast("array<long>")
    kept = ["__g", "__codes"] if coded else []
    none = F.lit(None).cast("array<long>")
    mine = packed_.select("__all", none.alias("__right"), *kept, *([long.alias("__more")] if coded else []))
    if (chunks or 0) > 1:
        # each two chunks of a large group are a row, which is dealt before it grows
        large = packed_.join(sizes.where("chunks > 1").select("__g"), "__g", "left_semi")
        later = large.select("__g", F.col("__chunk").alias("__later"), F.col("__all").alias("__right"), *([F.col("__codes").alias("__more")] if coded else []))
        tiles = large.join(later, "__g").where("__chunk < __later").repartition(tasks, "__g", "__chunk", "__later")
        mine = mine.unionByName(tiles.select(*mine.columns))
    most = max(PAIRS, 2 * 1024 * tasks)
    out = mine.mapInArrow(packs.sender(tasks, min(most, 2 * PAIRS), busy, SALTS, own, coded), "task int, blob binary")
    return out.repartitionById(tasks, "task").select("blob")


def counted(packed_: DataFrame) -> DataFrame:
    """a, b (a < b), n of packed() items; a pair is counted where it arrives, and nothing is shuffled after that."""
    return _sent(packed_).mapInArrow(packs.counter(PAIRS, False), "a long, b long, n long")


def supported(packed_: DataFrame, flags: list, grades: list, sample: int) -> DataFrame:
    """a, b (a < b), counts, sample of packed() items with codes, as packs.supporter(); nothing is shuffled after a pair's arrival."""
    return _sent(packed_).mapInArrow(packs.supporter(PAIRS // 2, flags, grades, sample), "a long, b long, counts array<long>, sample array<long>")


def is_whole(df: DataFrame, item: str) -> bool:
    return isinstance(df.schema[item].dataType, (T.LongType, T.IntegerType))


def co_occurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, n: pairs of different items (a < b) and the number of groups that hold both."""
    if is_whole(df, item):
        kind = df.schema[item].dataType
        return counted(packed(df, group, item)).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "n")
    pairs, keys = dealt_pairs(df.select(group, item).distinct(), group, item, carry=False)
    return pairs.groupBy(*keys).agg(F.count("*").alias("n")).select("a", "b", "n")


def lower_triangle(df: DataFrame, group: str, item: str) -> DataFrame:
    """a, b, n for all (whole) items a >= b, equal ones and pairs that never meet (n 0) included: a matrix over few items, as it has their number squared rows.

    Pairs are counted at their smaller item, and there the larger ones that it never meets are written out of one array of all items,
    so that neither pairs that are counted nor the matrix are shuffled or written.
    """
    kind = df.schema[item].dataType
    if not is_whole(df, item):
        raise ValueError(f"items are whole numbers, not {kind.simpleString()}")
    met = _sent(packed(df, group, item), own=True, deal=False).mapInArrow(packs.counter(PAIRS, True), "a long, met array<long>, n array<long>")
    # items without any group meet nothing, not even themselves
    items = df.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("long").alias("a")).agg(F.count(group).alias("n"))
    alone = items.where("n = 0").select("a", F.array().cast("array<long>").alias("met"), F.array().cast("array<long>").alias("n"))
    # one row; a result of that many items squared rows has to be held elsewhere than this array
    every = items.agg(F.sort_array(F.collect_list("a")).alias("__every"))
    rows = met.unionByName(alone).join(F.broadcast(every))
    above = F.slice("__every", F.array_position("__every", F.col("a")).cast("int"), F.size("__every"))
    both = F.array(F.struct(F.col("met").alias("of"), F.col("n").alias("n")), F.struct(F.array_except(above, F.col("met")).alias("of"), F.lit(None).cast("array<long>").alias("n")))
    cells = rows.select("a", F.inline(both)).select("a", "n", F.posexplode("of").alias("at", "b"))
    return cells.select(F.col("b").cast(kind).alias("a"), F.col("a").cast(kind).alias("b"), F.coalesce(F.get("n", F.col("at")), F.lit(0).cast("long")).alias("n"))


def pattern_join(df: DataFrame, patterns: list[tuple[int, str]], value: str, glob: bool = False) -> DataFrame:
    """Rows of df with each pattern (regular expression, or glob) that their value matches, in one pass without a join."""
    import fnmatch

    regex = lambda p: "^" + fnmatch.translate(p).replace(r"\z", "$").replace(r"\Z", "$") if glob else p
    found = F.array_compact(F.array(*[F.when(F.col(value).rlike(regex(p)), F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"))) for i, p in patterns]))
    return df.select("*", F.inline(found))


def holds_any(value: Column, words: list[str]) -> Column:
    """Whether the value holds any of the words; null counts as holding none."""
    out = F.lit(False)
    for w in words:
        out = out | value.contains(w)
    return F.coalesce(out, F.lit(False))


def keep_if_absent_or_above(df: DataFrame, scores: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """Rows of df whose key has no score, or one above least (the highest, where a key has several)."""
    low = scores.groupBy(key).agg(F.max(score).alias("__s")).where(F.col("__s").isNotNull() & ~(F.col("__s") > least))
    return df.join(low, key, "left_anti")


def twins(df: DataFrame, group: str, item: str, alone: str = "_original") -> DataFrame:
    """group, first, second: the two items of each group of two; an item alone is paired with itself and the suffix; larger groups raise."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.min(item).alias("first"), F.max(item).alias("last"))
    checked = F.when(F.col("n") > 2, F.raise_error(F.concat(F.lit("more than two items in group "), F.col(group).cast("string"))).cast("string"))
    second = F.when(F.col("n") == 1, F.concat(F.col("first").cast("string"), F.lit(alone))).when(F.col("n") == 2, F.col("last").cast("string")).otherwise(checked)
    return per.select(group, F.col("first").cast("string").alias("first"), second.alias("second"))


def other_group_partner(df: DataFrame, key: str, group: str, seed: int = 0) -> DataFrame:
    """key, partner: for each row a row of another group, chosen by a seeded hash.

    Rows are numbered by group, then hash; the partner stands as many places further as the group has rows (around the end),
    which is another group's, if there is one. So no row meets more than one other.
    """
    from quoin.operators.ranking import ranked, seeded_key

    order = seeded_key(key, seed)
    group_order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    numbered = ranked(df.select(key, group), [], [group_order, F.col(group), order, F.col(key)], "__n", "__total")
    sizes = df.groupBy(F.col(group).alias("__of")).agg(F.count("*").alias("__size"))
    placed = numbered.join(sizes, F.col(group).eqNullSafe(F.col("__of")))
    to = placed.where("__size < __total").select(key, ((F.col("__n") - 1 + F.col("__size")) % F.col("__total") + 1).alias("__to"))
    return to.join(numbered.select(F.col(key).alias("partner"), F.col("__n").alias("__to")), "__to").select(key, "partner")


def interleave(frames: list[DataFrame], choice: DataFrame, place: str, source: str) -> DataFrame:
    """Row i from the frame that choice (place, source) names for i; all frames share their columns."""
    tagged = [df.withColumn(source, F.lit(i)) for i, df in enumerate(frames)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out.join(choice, [place, source])
