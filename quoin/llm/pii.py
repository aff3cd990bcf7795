"""Personal data: base patterns by kind, and more identifiers from bootstrapped contextual extraction.

Base spans are leftmost non-overlapping matches of each kind's pattern. They seed a graph of patterns and instances. A mention is a
word with a digit or @, of any length, or a run of digit groups with single spaces between them; its context is
the two words before it in the text (A-Z lower-cased, digits as 0), other mentions' words included. A base span has the context of the
mention that it starts in, so seeds and candidates see the same context at the same place. A pattern is a kind with a
context, an instance is a mentioned string. A pattern's confidence is the summed score of its distinct instances over their
number plus one, an instance's score is one minus the product of one minus the confidences of its patterns of at
least HALF; seeds keep score 1. Both only grow from round to round; the round in which no score moves by more than SETTLED is the
last. Patterns of at least CONFIDENCE that at least MIN_SEEDS distinct seeds show give their other mentions, of
the same kind, as new spans. Mentions that touch a base span are never added; base spans always stay.

Texts are read once; what goes on from there is one narrow row per document with its mentions. Counting is grouped with
map-side combine over (kind, pattern, instance), so a passage that many texts share adds little, and one row per pattern
or instance is what the joins of each round see. All regular expressions run in linear time: no part of them backtracks.

Defined results: null counts as empty; empty texts have no spans; rows that repeat an id are documents of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, materialize, table, text_or_empty

#: The patterns of the contract, with possessive quantifiers and starts only where a match can start, so that long runs stay linear.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match of the kind; cheaper than the pattern.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_ENDS = rf"(?![^{SPACE}])"
_GROUP = r"[+(]*+[0-9][0-9().+/:-]*+"
_MENTION = rf"(?<![^{SPACE}])(?:{_GROUP}(?:(?:\x20{_GROUP}{_ENDS})++(?:\x20{_GROUP}[,;!?]++{_ENDS})?+|\x20{_GROUP}[,;!?]++{_ENDS})|[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+)"
_LAST_TWO = rf"(?<![^{SPACE}])[^{SPACE}]++(?:[{SPACE}]++[^{SPACE}]++)?[{SPACE}]*+$"
MIN_SEEDS, HALF, CONFIDENCE, SETTLED = 5, 0.5, 0.8, 1e-3
_CHUNK = 256


def _running(a: Column) -> Column:
    """Running sums of an array of numbers, in chunks, so that no long array is copied for each element."""
    none = F.array().cast("array<long>")
    last = lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0).cast("long"))
    sums = lambda x: F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(last(acc) + v.cast("long"))))
    starts = F.sequence(F.lit(0), F.size(a) - 1, F.lit(_CHUNK))
    chunks = F.transform(starts, lambda s: sums(F.slice(a, s + 1, _CHUNK)))
    before = lambda cs: F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(cs, last)))
    moved = lambda cs: F.flatten(F.zip_with(cs, F.slice(before(cs), 1, F.size(cs)), lambda c, o: F.transform(c, lambda v: v + o)))
    return F.when(F.size(a) > 0, moved(chunks)).otherwise(none)


def _located(df: DataFrame, text: str, pattern: str, name: str, needs: str = "") -> DataFrame:
    """Adds name: matches of pattern as (start, end, what, piece: the text since the match before)."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("__found", F.when(F.contains(F.col(text), F.lit(needs)), found).otherwise(none) if needs else found)
    df = df.withColumn("__pieces", F.when(F.size("__found") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("__lengths", F.zip_with(F.slice("__pieces", 1, F.size("__found")), "__found", lambda p, m: F.length(p) + F.length(m)))
    df = df.withColumn("__ends", _running(F.col("__lengths")))
    parts = F.arrays_zip(F.col("__found").alias("what"), F.col("__ends").alias("end"), F.slice("__pieces", 1, F.size("__found")).alias("piece"))
    spans = F.transform(parts, lambda x: F.struct((x["end"] - F.length(x["what"])).alias("start"), x["end"].alias("end"), x["what"].alias("what"), x["piece"].alias("piece")))
    return df.withColumn(name, spans).drop("__found", "__pieces", "__lengths", "__ends")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, what: Column) -> Column:
    digits = F.regexp_replace(what, "[^0-9]", "")
    if kind == "ip":
        return what.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The last two words of before, normalised; null if they hold no letter."""
    words = F.translate(F.regexp_extract(before, _LAST_TWO, 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    words = F.rtrim(F.regexp_replace(words, f"[{SPACE}]+", " "))
    return F.when(words.rlike(r"\p{L}"), words)


def _at(starts: Column, place: Column) -> Column:
    """The index of the last of the ascending starts that is at most place (0 if none is), by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step) <= place, at + step).otherwise(at))


def _of_kind(number: int, kind: str) -> Column:
    """The matches in the column named like the kind that are valid, as (start, kind, end, what, first and last mention that they touch)."""
    valid = F.filter(kind, lambda x: _valid(kind, x["what"]))
    return F.transform(valid, lambda x: F.struct(x["start"], F.lit(number).alias("kind"), x["end"], x["what"], _at(F.col("starts"), x["start"]).alias("i"), _at(F.col("starts"), x["end"] - 1).alias("j")))


def _count(number: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long")


def _trimmed(x: Column, context: Column) -> Column:
    """A mention's span without punctuation at its ends."""
    what = F.regexp_replace(x["what"], r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    bare = F.regexp_replace(what, r"^[^\p{L}\p{N}+@]++", "")
    end = x["start"] + F.length(what)
    return F.struct((end - F.length(bare)).alias("start"), end.alias("end"), bare.alias("what"), context.alias("context"))


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row, doc_id, base (start, kind, end, what, context) by start, and words (start, end, what, context): mentions without base spans."""
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    df = _located(df, "text", _MENTION, "mentions")
    for kind, pattern in KINDS.items():
        df = _located(df, "text", pattern, kind, _NEEDS[kind])
    df = df.drop("text").withColumn("starts", F.transform("mentions", lambda m: m["start"]))
    df = df.withColumn("tails", F.transform("mentions", lambda m: F.regexp_extract(m["piece"], _LAST_TWO, 0)))
    # every mention is a word at least, so the two words before one are in what is between it and the last but one
    before = F.transform("mentions", lambda m, i: F.concat_ws(" ", F.get("mentions", i - 2)["what"], F.get("tails", i - 1), F.get("mentions", i - 1)["what"], F.get("tails", i)))
    df = df.withColumn("contexts", F.transform(before, lambda x: _context(x)))
    df = df.withColumn("base", F.array_sort(F.concat(*[_of_kind(i, kind) for i, kind in enumerate(KINDS)])))
    free = F.array_except(F.sequence(F.lit(0), F.size("mentions") - 1), F.flatten(F.transform("base", lambda b: F.sequence(b["i"], b["j"]))))
    words = F.transform(F.filter(free, lambda i: F.get("contexts", i).isNotNull()), lambda i: _trimmed(F.get("mentions", i), F.get("contexts", i)))
    base = F.transform("base", lambda b: F.struct(b["start"], b["kind"], b["end"], b["what"], F.get("contexts", b["i"]).alias("context")))
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("what"), F.lit("").alias("context"))), 1, 0)
    return df.select("row", "doc_id", base.alias("base"), F.when(F.size("mentions") > 0, words).otherwise(none).alias("words"))


def bootstrap(found: DataFrame, min_seeds: int = MIN_SEEDS, half: float = HALF, confidence: float = CONFIDENCE, settled: float = SETTLED) -> DataFrame:
    """found: as mentions() gives it. Patterns to trust: kind, context, confidence, seeds."""
    seeds = found.select(F.explode("base").alias("b")).select("b.context", "b.kind", "b.what").where("context IS NOT NULL").distinct()
    seeded = materialize(seeds.groupBy("kind", "context").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds))
    words = found.select(F.explode("words").alias("w")).select("w.context", "w.what").distinct()
    # only contexts that enough seeds show can be trusted, so that others need no score
    edges = words.join(seeded.select("context", "kind"), "context").groupBy("kind", "context", "what").agg(F.lit(False).alias("seed"))
    edges = edges.unionByName(seeds.join(seeded, ["kind", "context"], "left_semi").withColumn("seed", F.lit(True)))
    edges = materialize(edges.groupBy("kind", "context", "what").agg(F.max("seed").alias("seed")))
    scores = None
    while True:
        rated = edges.withColumn("score", F.col("seed").cast("double"))
        if scores is not None:
            rated = edges.join(scores, ["kind", "what"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        patterns = materialize(rated.groupBy("kind", "context").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence")))
        missed = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        strong = patterns.where(F.col("confidence") >= half)
        new = edges.where("NOT seed").join(strong, ["kind", "context"]).groupBy("kind", "what").agg((1 - F.exp(missed)).alias("score"))
        if scores is None:
            new = materialize(new)
            moved = not new.isEmpty()
        else:
            new = materialize(new.join(scores.withColumnRenamed("score", "old"), ["kind", "what"], "left"))
            moved = not new.where(F.col("score") - F.coalesce("old", F.lit(0.0)) > settled).isEmpty()
        scores = new.select("kind", "what", "score")
        if not moved:
            return patterns.where(F.col("confidence") >= confidence).join(seeded, ["kind", "context"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """One row per row of docs: doc_id, base and found (start, kind, end, what, context), each in order of start, then kind."""
    rows = materialize(mentions(docs, id_col, text_col))
    trusted = materialize(bootstrap(rows, **settings)).select("kind", "context")
    new = rows.select("row", "base", F.explode("words").alias("w")).select("row", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.what").alias("what"), F.col("w.context").alias("context"))
    new = new.join(trusted, "context").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "what", "context"))).alias("found"))
    out = rows.select("row", "doc_id", "base").join(new, "row", "left")
    clear = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select("doc_id", "base", F.coalesce(clear, F.slice("base", 1, 0)).alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "found"))).alias("spans"))


#: No context of the synthetic texts is shown by enough seeds, so that the base spans alone give their rows; tests hold the bootstrap against brute force.
SQL = r"""
WITH k(kind, name, pattern) AS (
  VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
         (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), m AS (
  SELECT doc_id, kind, name, regexp_extract_all(coalesce(text, ''), pattern) AS w, string_split_regex(coalesce(text, ''), pattern) AS p FROM documents, k
), x AS (
  SELECT *, unnest(w) AS what, generate_subscripts(w, 1) AS i FROM m WHERE len(w) > 0
), s AS (
  SELECT doc_id, kind, name, what, regexp_replace(what, '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start FROM x
), v AS (
  SELECT *, concat_ws(':', name, start, start + length(what)) AS span FROM s
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN list_bool_and(list_transform(string_split(what, '.'), lambda z: length(ltrim(z, '0')) <= 3 AND CAST(right(z, 4) AS INT) % 1000 <= 255))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: (CAST(digits[length(digits) - j] AS INT) * (1 + j % 2)) // 10 + (CAST(digits[length(digits) - j] AS INT) * (1 + j % 2)) % 10)) % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END
)
SELECT documents.doc_id, count(span) FILTER (kind = 0) AS n_email, count(span) FILTER (kind = 1) AS n_ip, count(span) FILTER (kind = 2) AS n_card, count(span) FILTER (kind = 3) AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM documents LEFT JOIN v ON documents.doc_id = v.doc_id GROUP BY documents.doc_id
"""
