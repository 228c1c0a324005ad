"""Filter interaction audit: what five filters remove in every order, by inclusion-exclusion over joint failures.

1. Each document gets five flags.  A-D are functions of its own text; E (a copy of a smaller id's
   text) is found by the least id of each text digest, joined back on (digest, id), so that a digest
   with a third of all rows is spread by the ids.
2. For every set S of filters the documents that fail all of S are counted, by part: the
   sum of the product of the flags in S, also of good and of toxic documents.
3. The rest follows from these 32 sums of each part.  Survivors of a set T are the sum of
   (-1)^|S| joint(S) over S in T; documents that fail f alone are the Moebius inverse over the supersets of {f};
   the Harsanyi dividend of S in the game "removed by T" is -(-1)^|S| joint(S), and a filter's
   Shapley value is the sum of dividend / |S| over the sets that hold it.  Times 120 orders that is an integer.

Only Spark's own functions are used.  No group is larger than a part's 32 sums.

Defined cases: a null or empty text has no words (A fails; B, C, D don't); a null doc_id comes after
every other, so a null row is a copy if any row with an id has its text, and null rows are no copies of each
other; rows with one id and one text are no copies of each other; a null source is the part ''; a document is
good (toxic) if any of its labels says so, null labels and ids without labels say nothing; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SPLIT = r"[\x20\x09-\x0D]+"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
SETS = 1 << len(LETTERS)


def text_flags(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the failures of A, B, C and D; `words` is the array of the text's words."""
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * DISTINCT_PERCENT,
        capitals * 100 > F.length(text) * CAPITAL_PERCENT,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic), a row for each of docs(doc_id, text, source); labels has doc_id, quality, toxic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.filter(F.split("text", SPLIT), lambda w: w != ""))
    docs = docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_flags(F.col("text"), F.col("words")).alias("mask"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    said = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    rows = docs.join(told, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "part", "digest", "mask", said("good"), said("toxic"))
    rows = B.stored(rows.groupBy("doc_id", "part", "digest", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")), "audit")
    least = rows.groupBy(F.col("digest").alias("of_digest")).agg(F.min("doc_id").alias("least"))
    first = rows.join(least, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("least")), "left")
    copy = F.when(F.col("of_digest").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return first.select("part", F.col("mask").bitwiseOR(copy).alias("mask"), "good", "toxic", "n")


def joint_failures(rows: DataFrame) -> DataFrame:
    """(part, joint): an array over all 32 sets S, of the documents (n, good, toxic) that fail every filter in S."""
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))
    flags = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(1)).otherwise(F.lit(0)) for k in range(len(LETTERS))]
    product = lambda s: functools.reduce(lambda a, b: a * b, [f for k, f in enumerate(flags) if s >> k & 1], F.lit(1))
    by_set = cells.withColumn("s", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), product(s).alias("product")) for s in range(SETS)])))
    sums = by_set.groupBy("part", F.col("s.s").alias("s")).agg(*[F.sum(F.col("s.product") * F.col(k)).alias(k) for k in ("n", "good", "toxic")])
    return sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("joint"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    joint = joint_failures(flagged(docs, labels))
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    sign = lambda s: F.when(F.bit_count(s) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    total = lambda kept, term: F.aggregate(F.filter("joint", kept), F.lit(0).cast("long"), lambda a, j: a + term(j))
    survivors = lambda t, k: total(lambda j: j["s"].bitwiseAND(F.bitwise_not(t)) == 0, lambda j: sign(j["s"]) * j[k])
    kept = lambda k: F.transform(sets, lambda t: survivors(t, k)).alias(f"left_{k}")
    left = joint.select("part", "joint", kept("n"), kept("good"), kept("toxic"))
    bits = F.array(*[F.lit(1 << k) for k in range(len(LETTERS))])
    alone = lambda f: total(lambda j: j["s"].bitwiseAND(f) != 0, lambda j: -sign(j["s"]) * j["n"])
    value = lambda f: total(lambda j: j["s"].bitwiseAND(f) != 0, lambda j: -sign(j["s"]) * j["n"] * F.element_at(F.array(*[F.lit(len(ORDERS) // k) for k in range(1, len(LETTERS) + 1)]), F.bit_count(j["s"])))
    left = left.withColumn("alone", F.transform(bits, alone)).withColumn("value", F.transform(bits, value))
    left = left.withColumn("fails", F.transform(bits, lambda f: F.get(F.col("joint"), f)["n"])).drop("joint")
    steps = left.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(LETTERS)), F.lit(0))
    filter_ = F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    steps = steps.withColumn("before", before).withColumn("f", filter_).withColumn("after", F.col("before").bitwiseOR(F.get(bits, F.col("f"))))
    lost = lambda k: F.get(f"left_{k}", F.col("before")) - F.get(f"left_{k}", F.col("after"))
    return steps.select(
        "part", "filter_order", "step", F.get("left_n", F.col("after")).alias("kept"), lost("n").alias("removed"), (F.get("fails", F.col("f")) - lost("n")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("value", F.col("f")).alias("shapley"),
    )


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), flags AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM flags LEFT JOIN told USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), steps AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.b, b.b, c.b, d.b, e.b]) AS own,
    unnest([0, a.b, a.b + b.b, a.b + b.b + c.b, a.b + b.b + c.b + d.b]) AS before
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
), counts AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""
