"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is the multiset of its words.  Sample k of a set is the term of least
a = c / (y e^r), where r and c are Gamma(2, 1) values that a hash of (term, k) gives,
beta is uniform, t = floor(ln w / r + beta) and y = e^(r (t - beta)).  It keeps (term, t), so
two documents agree on a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima of the word counts.

A sample is one long: ln a in the high 40 bits, 24 bits of the hash of (term, t) below,
so that the least sample is a plain minimum that is combined in generated code.  Texts
are shuffled once, to blocks in doc_id order; terms, samples and neighbours need no other.

Defined cases: null is the empty text; a text with no word has the fingerprint "" and is
like another such text (1.0) and unlike all others (0.0); null doc_ids come last in
descending order, in blocks by a hash of their text and there by text; equal doc_ids are ordered by text, and each row is a document; a single
document is its own next one; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B

SAMPLES, CHUNK = 32, 4
SPLIT = r"[\x20\x09-\x0D]+"


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of docs(doc_id, text) with block, place there, and the text of the next row in descending doc_id.

    After each block's rows comes one row (`extra`) that holds the first text of the next block.
    """
    docs = B.range_block(docs, blocks).withColumn("block", F.when(F.col("doc_id").isNull(), -1 - F.col("block")).otherwise(F.col("block")))
    # a row a block: its greatest doc_id, and the block that comes before it; the first one's is the last
    tops = B.saved(docs.groupBy("block").agg(F.max("doc_id").alias("top")))
    whole = Window.orderBy("block")
    owners = B.saved(tops.select(F.col("block").alias("b"), "top", F.coalesce(F.lead("block").over(whole), F.min("block").over(whole)).alias("owner")))
    small = F.broadcast(owners) if blocks <= B.BROADCAST_IDS else owners
    # the row of the greatest doc_id (and text) opens its block
    first = docs.join(small, (F.col("block") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("block", "owner").agg(F.max("text").alias("text"))
    extra = first.select(F.coalesce(F.col("owner").cast("int"), F.lit(-1)).alias("block"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("extra"))
    # blocks that can't be null get no null filter from the join, so both readers of the rows share one exchange
    rows = docs.select(F.coalesce(F.col("block").cast("int"), F.lit(-1)).alias("block"), "doc_id", "text", F.lit(False).alias("extra")).unionByName(extra)
    order = Window.partitionBy("block").orderBy("extra", F.desc("doc_id"), F.desc("text"))
    return rows.select("block", "doc_id", "text", F.row_number().over(order).alias("place"), "extra", F.lead("text").over(order).alias("next_text"))


def _draws(h: Column) -> tuple[Column, Column, Column]:
    """(r, ln c, beta) from a hash of (term, sample): Gamma(2, 1) twice as -ln of two uniforms' product, and a uniform."""
    u = lambda at, bits: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + F.lit(0.5)
    r = -F.ln(u(0, 13) * u(13, 13) * F.lit(2.0**-26))
    return r, F.ln(-F.ln(u(26, 13) * u(39, 13) * F.lit(2.0**-26))), u(52, 12) * F.lit(2.0**-12)


def _packed(h: Column, ln_w: Column, r: Column, ln_c: Column, beta: Column) -> Column:
    t = F.floor(ln_w / r + beta)
    ln_a = ln_c - r * (t - beta + F.lit(1.0))
    high = F.shiftleft(((ln_a + F.lit(256.0)) * F.lit(float(1 << 30))).cast("long"), 24)
    return high.bitwiseOR((h.bitwiseAND(F.lit((1 << 40) - 1).cast("long")) + t * F.lit(0x9E3779)).bitwiseAND(F.lit((1 << 24) - 1).cast("long")))


def least_samples(terms: DataFrame, samples: int) -> DataFrame:
    """Of terms(block, place, term, ln_n, ln_m): (block, place, own, other), arrays of the samples of both weightings.

    A row takes CHUNK samples at a time: so the generated loop stays small enough to be compiled, and draws
    are columns of their own, so none is worked out twice.
    """
    part = terms.withColumn("j", F.explode(F.array(*map(F.lit, range(samples // CHUNK)))))
    part = part.select("block", "place", "ln_n", "ln_m", "j", *[F.xxhash64("term", F.col("j") * CHUNK + k).alias(f"h{k}") for k in range(CHUNK)])
    draws = {}
    for k in range(CHUNK):
        draws |= dict(zip((f"r{k}", f"c{k}", f"b{k}"), _draws(F.col(f"h{k}")), strict=True))
    least = [F.min(_packed(F.col(f"h{k}"), F.col(f"ln_{x}"), F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}"))).alias(f"{x}{k}") for x in "nm" for k in range(CHUNK)]
    found = part.withColumns(draws).groupBy("block", "place", "j").agg(*least)
    ids = lambda x: F.array(*[F.col(f"{x}{k}").bitwiseAND(F.lit((1 << 24) - 1).cast("long")) for k in range(CHUNK)])
    whole = found.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("j", ids("n").alias("n"), ids("m").alias("m")))).alias("s"))
    return whole.select("block", "place", F.flatten(F.transform("s", lambda x: x["n"])).alias("own"), F.flatten(F.transform("s", lambda x: x["m"])).alias("other"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; null, or a first sample that is null, is the set of no terms."""
    none_a, none_b = F.coalesce(F.get(a, 0).isNull(), F.lit(True)), F.coalesce(F.get(b, 0).isNull(), F.lit(True))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")
    return F.when(none_a & none_b, F.lit(1.0)).when(none_a | none_b, F.lit(0.0)).otherwise(equal)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of docs(doc_id, text), and of each text with its last third replaced by the next one's start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, n_bytes = B.corpus_size(docs)
    rows = with_next(docs, B.block_count(n_bytes, n))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (size - third)), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    base = rows.select("block", "place", "extra", "doc_id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = base.select("block", "place", F.explode(F.array(F.struct(F.lit(1).alias("own"), F.col("text").alias("s")), F.struct(F.lit(0).alias("own"), F.col("edited").alias("s")))).alias("x"))
    words = both.select("block", "place", F.col("x.own").alias("own"), F.explode(F.split("x.s", SPLIT)).alias("w")).where("w <> ''")
    terms = words.select("block", "place", "own", F.xxhash64("w").alias("term")).groupBy("block", "place", "term").agg(F.sum("own").alias("n"), F.sum(1 - F.col("own")).alias("m"))
    terms = terms.select("block", "place", "term", F.ln(F.when(F.col("n") > 0, F.col("n").cast("double"))).alias("ln_n"), F.ln(F.when(F.col("m") > 0, F.col("m").cast("double"))).alias("ln_m"))
    told = base.select("block", "place", "extra", "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256")).join(least_samples(terms, samples), ["block", "place"], "left")
    told = told.withColumn("follow", F.lead(F.coalesce("own", F.array().cast("array<bigint>"))).over(Window.partitionBy("block").orderBy("place")))
    text = lambda c: F.when(F.get(c, 0).isNull(), F.lit("")).otherwise(F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), ""))
    return told.where("not extra").select("doc_id", "n_chars", "edited_sha256", F.coalesce(text("own"), F.lit("")).alias("fingerprint"), F.coalesce(text("other"), F.lit("")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("follow")).alias("near_next"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
