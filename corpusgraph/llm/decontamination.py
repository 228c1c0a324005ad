"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check; all native.

1. Texts become five-word shingles (lower case, words of letters and digits), weighted
   1 + ln(items / items with the shingle).
2. Exact pruning: a window 0.8 alike an item shares 0.8 of the item's weight with it, so the document shares one of
   the item's rarest shingles that make up the other 0.2 (its prefix), and 0.8 of its weight in all.  Only
   documents that do are slid over, for the sizes of the items in question; no match is lost, and a
   shingle that many items hold is not what items are looked up by.
3. Every window of such a document, as many shingles long as the item and clipped at the text's ends, gets a 64-bit
   SimHash: each shingle adds its weight to 64 running sums where it enters and takes it back where it leaves.
4. Fingerprints are cut in BLOCKS blocks; of two within RADIUS bits some block differs in at
   most one bit (RADIUS < 2 * BLOCKS), so an index of the items' blocks and their one-bit
   neighbours finds every such pair.  The index has for each document the items that step 2 left it, by size, and
   windows are looked up that have 0.8 of their weight in shingles of items, without loss: blocks of six bits
   select little, so what meets in them must be few before.  Fingerprints of sets that are 0.8 alike differ in about 10 bits
   (standard deviation 3), so one in some ten thousand lies beyond the radius, and then only windows beside it can match.
5. Pairs within the radius are verified: sum of minima over sum of maxima of the weights.

The items' tables are broadcast only if their counted rows are under BROADCAST_ROWS.

Defined cases: null and empty texts and items match nothing; a text of fewer than five words
is one shingle; items are told apart by id and text, so repeated or null item_ids are all
searched for; a null doc_id is kept as null; repeated rows give one result for each doc_id, text and
item_id; with no documents or no items the result is empty; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B

SHINGLE, THRESHOLD, BITS, BLOCKS, RADIUS = 5, 0.8, 64, 11, 21
BROADCAST_ROWS = 200_000
#: Weights are whole numbers of 2**-16 in running sums, which so are exact; bounds leave room for the rounding.
SCALE, SLACK = 1 << 16, 1e-4


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles, in order; of a shorter text one for the whole of it."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))[0]


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")


def _signed(hash_: Column, weight: Column) -> list[Column]:
    """For each bit of a hash: the weight, negative where the bit is not set."""
    return [F.when(hash_.bitwiseAND(_bit(i)) != 0, weight).otherwise(-weight) for i in range(BITS)]


def _fingerprint(sums: list[Column]) -> Column:
    """The bits whose sums are positive."""
    out = F.lit(0).cast("long")
    for i, x in enumerate(sums):
        out = out.bitwiseOR(F.when(x > 0, _bit(i)).otherwise(F.lit(0).cast("long")))
    return out


def simhash(hash_: Column, weight: Column) -> Column:
    """Aggregate: the 64-bit SimHash of weighted hashes."""
    return _fingerprint([F.sum(x) for x in _signed(hash_, weight)])


def window_fingerprints(shingled: DataFrame) -> DataFrame:
    """Of shingled(doc, size, n, at, h, weight, shared), one row a shingle: (doc, size, start, fp, total, shared) of all windows.

    A window is `size` shingles, or what the text has of them; `total` and `shared` are its sums of `weight` and `shared`.
    """
    enters = F.struct(F.col("at").alias("end"), F.col("weight").alias("w"), F.col("shared").alias("s"), F.lit(True).alias("enters"))
    leaves = F.struct((F.col("at") + F.col("size")).alias("end"), (-F.col("weight")).alias("w"), (-F.col("shared")).alias("s"), F.lit(False).alias("enters"))
    moves = shingled.select("doc", "size", "n", "h", F.explode(F.array(enters, leaves)).alias("m")).select("doc", "size", "n", "h", "m.*")
    upto = Window.partitionBy("doc", "size").orderBy("end")
    sums = moves.select("doc", "size", "n", "end", "enters", F.sum("w").over(upto).alias("total"), F.sum("s").over(upto).alias("shared"), *[F.sum(x).over(upto).alias(f"b{i}") for i, x in enumerate(_signed(F.col("h"), F.col("w")))])
    ends = sums.where("total > 0 and (enters or end >= n)")
    return ends.select("doc", "size", (F.col("end") - F.col("size") + 1).alias("start"), _fingerprint([F.col(f"b{i}") for i in range(BITS)]).alias("fp"), "total", "shared")


def _cuts() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    at = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def _part(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def near_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS, small=lambda df: df, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left(fp, size, ...) and right(item_fp, size, ...) of one size, and equal in the columns `also`, within `radius` bits, each pair once; radius < 2 * BLOCKS."""
    if radius >= 2 * BLOCKS:
        raise ValueError("blocks don't guarantee this radius")
    probes, keys = [], []
    for k, (at, n) in enumerate(_cuts()):
        part, asked = _part(F.col("item_fp"), at, n), _part(F.col("fp"), at, n)
        keys += [F.struct(F.lit(k).alias("k"), (part if j is None else part.bitwiseXOR(F.lit(1 << j).cast("long"))).alias("v")) for j in [None, *range(n)]]
        probes.append(F.struct(F.lit(k).alias("k"), asked.alias("v")))
    asked = left.withColumn("p", F.explode(F.array(*probes))).select("*", "p.k", "p.v").drop("p")
    index = right.withColumn("p", F.explode(F.array(*keys))).select("*", "p.k", "p.v").drop("p")
    near = asked.join(small(index), [*also, "size", "k", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return near.drop("k", "v").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, version, item_id, similarity, start) of docs(doc_id, text) that hold a passage of items(item_id, text).

    `version` is xxhash64 of the text; of equal similarities the first start counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"), F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("doc"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))
    tf = B.saved(items.select("item", "item_id", F.explode(shingles(F.col("text"))).alias("h")).groupBy("item", "item_id", "h").agg(F.count(F.lit(1)).alias("item_n")))
    n_items, n_rows = tf.select("item").distinct().count(), tf.count()
    small = (lambda df: F.broadcast(df)) if n_rows <= BROADCAST_ROWS else (lambda df: df)  # a counted size, and a plain join beyond it
    rare = 1.0 + math.log(max(1, n_items))
    weight = tf.groupBy("h").agg((1.0 + F.log(F.lit(float(max(1, n_items))) / F.count(F.lit(1)))).alias("weight"))
    rarest = Window.partitionBy("item").orderBy(F.desc("weight"), "h")
    tf = tf.join(weight, "h").withColumn("upto", F.sum(F.col("item_n") * F.col("weight")).over(rarest.rowsBetween(Window.unboundedPreceding, 0)))
    tf = B.saved(tf.withColumn("item_total", F.sum(F.col("item_n") * F.col("weight")).over(Window.partitionBy("item"))))
    whole = F.round(F.col("weight") * SCALE).cast("long")
    per_item = B.saved(tf.groupBy("item", "item_id").agg(simhash(F.col("h"), whole * F.col("item_n")).alias("item_fp"), F.max("item_total").alias("item_total"), F.sum("item_n").alias("size")))
    prefix = tf.where(F.col("upto") - F.col("item_n") * F.col("weight") <= (1 - threshold) * F.col("item_total") * (1 + SLACK)).select("h", "item")
    # documents that may hold an item: they share a shingle of its prefix, and enough of its weight
    hits = B.saved(docs.select("doc", F.explode(shingles(F.col("text"))).alias("h")).join(small(prefix), "h").select("doc", "item").distinct())
    asked = hits.select("doc").distinct()
    side = F.broadcast(asked) if asked.count() <= B.BROADCAST_IDS else asked
    held = B.stored(docs.join(side, "doc").dropDuplicates(["doc"]).select("doc", "doc_id", "version", shingles(F.col("text")).alias("hs")), "decontamination")
    in_doc = held.select("doc", F.explode("hs").alias("h")).groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n"))
    common = in_doc.join(hits, "doc").join(small(tf.select("item", "h", "item_n", "weight", "item_total")), ["item", "h"])
    live = common.groupBy("doc", "item").agg(F.sum(F.least("n", "item_n") * F.col("weight")).alias("most"), F.max("item_total").alias("item_total"))
    live = live.where(F.col("most") >= (threshold - SLACK) * F.col("item_total")).select("doc", "item")
    live = B.saved(live.join(small(per_item.select("item", "size", "item_fp", "item_total")), "item"))
    sizes = live.select("doc", "size").distinct()
    # all windows of these sizes
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes in make much work
    shingled = held.select("doc", "hs").join(sizes, "doc").repartition(tasks, "doc", "size").select("doc", "size", F.size("hs").alias("n"), F.posexplode("hs").alias("at", "h")).join(small(weight), "h", "left")
    whole = F.round(F.coalesce("weight", F.lit(rare)) * SCALE).cast("long")
    shingled = shingled.select("doc", "size", "n", "at", "h", whole.alias("weight"), F.when(F.col("weight").isNull(), F.lit(0).cast("long")).otherwise(whole).alias("shared"))
    # what a window shares with all items bounds what it shares with one
    windows = window_fingerprints(shingled).where(F.col("shared") >= (threshold - SLACK) * F.col("total"))
    few = (lambda df: F.broadcast(df)) if live.count() * (BITS + BLOCKS) <= BROADCAST_ROWS else (lambda df: df)
    pairs = near_pairs(windows, live, RADIUS, few, ("doc",))
    pairs = pairs.where(F.col("shared") >= (threshold - SLACK) * F.col("item_total") * SCALE).select("doc", "item", "size", "start", "item_total")
    pairs = B.saved(pairs)
    per_doc = pairs.groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("windows"))
    first = F.greatest(F.col("w.start"), F.lit(0)).cast("int")
    part = F.slice("hs", first + 1, F.greatest(F.lit(0), F.least(F.col("w.start") + F.col("w.size"), F.size("hs")) - first).cast("int"))
    windows = held.select("doc", "hs").join(per_doc, "doc").select("doc", "hs", F.explode("windows").alias("w")).select("doc", "w.start", "w.size", F.explode(part).alias("h"))
    windows = windows.groupBy("doc", "start", "size", "h").agg(F.count(F.lit(1)).alias("n")).join(small(weight), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(rare)))
    totals = windows.groupBy("doc", "start", "size").agg(F.sum(F.col("n") * F.col("weight")).alias("total"))
    low = windows.drop("weight").join(pairs, ["doc", "start", "size"]).join(small(tf.select("item", "h", "item_n", "weight")), ["item", "h"])
    low = low.groupBy("doc", "start", "size", "item", "item_total").agg(F.sum(F.least("n", "item_n") * F.col("weight")).alias("low"))
    like = low.join(totals, ["doc", "start", "size"]).withColumn("similarity", F.col("low") / (F.col("total") + F.col("item_total") - F.col("low")))
    best = like.where(F.col("similarity") >= threshold - 1e-12).groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    out = best.join(small(per_item.select("item", "item_id")), "item").join(held.select("doc", "doc_id", "version"), "doc")
    out = out.groupBy("doc_id", "version", "item_id").agg(F.max("b").alias("b"))
    return out.select("doc_id", "version", "item_id", "b.similarity", (-F.col("b.s")).cast("long").alias("start"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
