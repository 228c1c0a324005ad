"""Prefix trie of conversations: rolling fingerprints group equal prefixes, groups are verified, subtrees rolled up.

1. Turns get their place in their conversation, conversations are rebuilt on the first turns of the one they branch from.
2. A rolling polynomial over the turns' hashes, scanned with numpy, names every prefix.  A scan runs over rows
   sorted by (conversation, chunk) and never holds a conversation: sums of a long one's chunks are carried over
   in a scan of their own.
3. Equal names at one depth are candidates.  A group stands if each member's last turn (SHA-256 of role and text)
   and the node of the prefix before it equal those of its representative, the smallest member; by depth that is
   turn-by-turn equality.  A group that doesn't is split by both, and its descendants with it, until all stand.
   Groups are summed by salted parts, so that a first turn that all conversations share is no hot key.
4. A node is known by (smallest member, depth), so its ancestor is found in the representative's own path, a join
   on unique keys.  Subtree sums double their reach each round: the 2^j-th ancestor gets what has been summed
   below, about log2(depth) rounds.

Texts don't travel beyond the scan that hashes and counts them.

Defined cases: rows with a null conv_id belong to no conversation and are left out; a null turn comes first, rows of equal
turns are in order of their SHA-256, and repeated rows are repeated turns; null role or text is empty; a
conversation whose parent is absent or shorter takes what is there; empty texts count no words; an empty table gives an
empty table (not even a root); other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

#: conversation c branches from c - c % FAMILY, after crc32(c) % SHARED of its turns
FAMILY, SHARED = 20, 4
#: Turns of a conversation that are scanned in one piece, and ids that are joined into one text.
CHUNK = 4096
SALTS = 64
WORDS = r"[^\x20\x09-\x0D]+"
BASE = 0x9E3779B97F4A7C15
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Bits of a fingerprint that are kept (fewer only to provoke collisions).
BITS = 64


def _runs(batches, keys: list[str], value: str, out: str):
    """Adds the running sum (modulo 2^64) of `value` over rows of equal keys, which lie together; carries over from batch to batch."""
    last, carry = None, np.uint64(0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        add = batch.column(value).to_numpy(zero_copy_only=False).view(np.uint64)
        first = np.append(True, np.any([x[1:] != x[:-1] for x in part], axis=0))
        key = tuple(x[0] for x in part)
        total = np.cumsum(add, dtype=np.uint64)
        starts = np.flatnonzero(first)
        before = np.append(np.uint64(0), total[:-1])[starts]
        if key == last:
            before[0] -= carry
        total -= np.repeat(before, np.diff(np.append(starts, n)))
        last, carry = tuple(x[-1] for x in part), total[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total.view(np.int64))], names=[*batch.schema.names, out])


def _terms(batches):
    """h * BASE^depth, modulo 2^64, of each turn."""
    for batch in batches:
        depth, base = batch.column("depth").to_numpy(zero_copy_only=False).astype(np.uint64), np.uint64(BASE)
        power = np.ones(len(depth), np.uint64)
        square, bit = base, 0
        while len(depth) and int(depth.max()) >> bit:
            power = np.where((depth >> np.uint64(bit)) & np.uint64(1) == 1, power * square, power)
            with np.errstate(over="ignore"):
                square = square * square
            bit += 1
        h = B.mix(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((h * power).view(np.int64))], names=[*batch.schema.names, "term"])


def scanned(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """rows with `out`, the running sum of the long column `value` within equal keys, in the order given."""
    kinds = rows.dtypes
    ddl = ", ".join([*(f"`{k}` {t}" for k, t in kinds), f"`{out}` long"])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda b: _runs(b, keys, value, out), ddl)


def placed(turns: DataFrame) -> DataFrame:
    """(conv, place, hash, digest, words): turns in order, place from 1; a conversation's turns are dealt to ranges of the turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = rows.withColumn("hash", F.xxhash64("digest")).withColumn("one", F.lit(1).cast("long"))
    rows = B.range_block(rows, max(B.MIN_BLOCKS, rows.count() // 50_000), "turn")
    rows = B.stored(scanned(rows, ["conv", "block"], ["turn", "digest"], "one", "local"), "turns")
    sizes = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("size"))
    upto = scanned(sizes, ["conv"], ["block"], "size", "upto").select(F.col("conv").alias("c"), F.col("block").alias("b"), (F.col("upto") - F.col("size")).alias("before"))
    return rows.join(upto, (F.col("conv") == F.col("c")) & (F.col("block") == F.col("b"))).select("conv", (F.col("before") + F.col("local")).alias("place"), "hash", "digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length), and their turns (conv, depth, hash, digest, words) on the first turns of the conversation they branch from."""
    rows = B.stored(placed(turns), "placed")
    convs = rows.groupBy("conv").agg(F.max("place").alias("own")).withColumn("h", F.crc32(F.col("conv").cast("string")) % shared).withColumn("from", F.col("conv") - F.pmod("conv", F.lit(family)))
    base = convs.where(F.col("conv") == F.col("from")).select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(base, F.col("from") == F.col("base"), "left").withColumn("given", F.least("h", F.coalesce("base_own", F.lit(0).cast("long"))))
    convs = B.stored(convs.select("conv", "from", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    head = rows.where((F.col("place") < shared) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "of")
    taken = head.join(convs.select("conv", "from", "given"), F.col("of") == F.col("from")).where("place <= given").select("conv", F.col("place").alias("depth"), "hash", "digest", "words")
    own = rows.join(convs.select(F.col("conv").alias("c"), "h", "given"), F.col("conv") == F.col("c")).where("place > h").select("conv", (F.col("given") + F.col("place") - F.col("h")).alias("depth"), "hash", "digest", "words")
    return convs.select("conv", "length"), taken.unionByName(own)


def named(turns: DataFrame, bits: int = BITS) -> DataFrame:
    """turns with `name`, the rolling fingerprint of the prefix that ends there, and `before`, that of the prefix before it."""
    rows = turns.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes)
    rows = scanned(rows.mapInArrow(_terms, kinds + ", term long"), ["conv", "chunk"], ["depth"], "term", "part")
    rows = B.stored(rows, "prefixes")
    long = rows.where(F.col("chunk") > 0).select("conv").distinct()
    sums = rows.join(long, "conv", "left_semi").groupBy("conv", "chunk").agg(F.max_by("part", "depth").alias("sum"))
    upto = scanned(sums, ["conv"], ["chunk"], "sum", "upto").select(F.col("conv").alias("c"), (F.col("chunk") + 1).alias("k"), F.col("upto").alias("carry"))
    rows = rows.join(upto, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")), "left").select("conv", "depth", "digest", "words", "term", "part", F.coalesce("carry", F.lit(0).cast("long")).alias("carry"))

    def add(batches):
        keep = np.uint64((1 << bits) - 1)
        for batch in batches:
            term, part, carry = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("term", "part", "carry"))
            name, before = (part + carry) & keep, (part + carry - term) & keep
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("conv", "depth", "digest", "words")), pa.array(name.view(np.int64)), pa.array(before.view(np.int64))], names=["conv", "depth", "digest", "words", "name", "before"])

    return rows.mapInArrow(add, "conv long, depth long, digest binary, words long, name long, before long")


def grouped(rows: DataFrame) -> DataFrame:
    """Groups by (depth, name), summed by salts first, and whether they stand."""
    ends = F.col("depth") == F.col("length")
    salted = rows.groupBy("depth", "name", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).alias("salt")).agg(
        F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.count_if(ends).alias("n_ends"),
        F.min("digest").alias("least"), F.max("digest").alias("most"), F.min("before").alias("from_least"), F.max("before").alias("from_most"),
    )
    whole = salted.groupBy("depth", "name").agg(
        F.min("rep").alias("rep"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), F.sum("n_ends").alias("n_ends"),
        ((F.min("least") == F.max("most")) & (F.min("from_least") == F.max("from_most"))).alias("stands"), F.collect_list("salt").alias("salts"),
    )
    return B.stored(whole, "groups")


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with names under which equal means equal prefixes, and their groups; groups that don't stand are split until all do."""
    while True:
        groups = grouped(rows)
        bad = groups.where("not stands").select(F.col("depth").alias("bad_depth"), F.col("name").alias("bad_name"))
        if not bad.limit(1).count():
            return rows, groups
        bad = B.stored(bad, "split")
        fresh = F.xxhash64("depth", "name", "digest", "before")
        rows = B.stored(rows.join(bad, (F.col("depth") == F.col("bad_depth")) & (F.col("name") == F.col("bad_name")), "left").withColumn("fresh", F.when(F.col("bad_depth").isNotNull(), fresh).otherwise(F.col("name"))).drop("bad_depth", "bad_name"), "renamed")
        moved = rows.where(F.col("fresh") != F.col("name")).select(F.col("conv").alias("c"), (F.col("depth") + 1).alias("d"), F.col("fresh").alias("now"))
        rows = B.stored(rows.join(moved, (F.col("conv") == F.col("c")) & (F.col("depth") == F.col("d")), "left").select("conv", "depth", "length", "digest", "words", F.col("fresh").alias("name"), F.coalesce("now", "before").alias("before")), "renamed")


def paths(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(conv, depth, rep, length): the node of each prefix of each conversation, by its smallest member."""
    spread = groups.select(F.col("depth").alias("d"), F.col("name").alias("n"), "rep", F.explode("salts").alias("s"))
    same = (F.col("depth") == F.col("d")) & (F.col("name") == F.col("n")) & (F.pmod(F.xxhash64("conv"), F.lit(SALTS)) == F.col("s"))
    return rows.join(spread, same).select("conv", "depth", "rep", "length")


def ends(path: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256): of ids that end at a node, in order; a node's ids pass as chunks, one after another."""
    at = path.where("depth = length").groupBy("rep", "depth", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for rep, depth, ids in zip(*(batch.column(k).to_pylist() for k in ("rep", "depth", "ids")), strict=True):
                if (rep, depth) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("rep", "depth", "ends_sha256"), x, strict=True)) for x in out], schema=kinds)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(("rep", "depth", "ends_sha256"), (*key, sha.hexdigest()), strict=True))], schema=kinds)

    kinds = pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    return at.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "chunk").select("rep", "depth", "ids").mapInArrow(digest, "rep long, depth long, ends_sha256 string")


def rolled_up(nodes: DataFrame, path: DataFrame, sums: list[str]) -> DataFrame:
    """nodes(rep, depth, and `sums` of their own) with each sum taken over the subtree."""
    deepest = nodes.agg(F.max("depth")).head()[0] or 0
    step = 1
    while step <= deepest:
        far = path.select(F.col("conv").alias("c"), (F.col("depth") + step).alias("d"), F.col("rep").alias("up"))
        given = nodes.join(far, (F.col("rep") == F.col("c")) & (F.col("depth") == F.col("d"))).groupBy(F.col("up").alias("to"), (F.col("depth") - step).alias("to_depth")).agg(*[F.sum(k).alias(f"more_{k}") for k in sums])
        more = nodes.join(given, (F.col("rep") == F.col("to")) & (F.col("depth") == F.col("to_depth")), "left")
        nodes = B.stored(more.withColumns({k: F.col(k) + F.coalesce(f"more_{k}", F.lit(0)) for k in sums}).select(*nodes.columns), "subtrees")
        step *= 2
    return nodes


def trie(turns: DataFrame, family: int = FAMILY, shared: int = SHARED, bits: int = BITS) -> DataFrame:
    """A row for each node of the trie of turns(conv_id, turn, role, text), rebuilt; the root has depth 0."""
    convs, rows = rebuilt(turns, family, shared)
    rows = B.stored(named(rows, bits).join(convs, "conv"), "named")
    rows, groups = verified(rows)
    path = B.stored(paths(rows, groups), "paths")
    top = B.saved(convs.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends")).where("rep is not null"))
    root = [int(r["rep"]) for r in top.collect()]  # one number
    at_root = path.select("conv", "depth", "rep", "length").unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root[0] if root else None).cast("long").alias("rep"), "length"))
    nodes = groups.select("rep", "depth", "n_convs", "words").unionByName(top.select("rep", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words")))
    up = at_root.select(F.col("conv").alias("c"), (F.col("depth") + 1).alias("d"), F.col("rep").alias("parent"))
    nodes = B.stored(nodes.join(up, (F.col("rep") == F.col("c")) & (F.col("depth") == F.col("d")), "left").select("rep", "depth", "n_convs", "words", "parent"), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("p"), (F.col("depth") - 1).alias("pd")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("rep") == F.col("p")) & (F.col("depth") == F.col("pd")), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = nodes.select("rep", "depth", "n_convs", "parent", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = rolled_up(B.stored(own, "own"), at_root, ["n_leaves", "saved_tokens"])
    last = ends(at_root).select(F.col("rep").alias("r"), F.col("depth").alias("at"), "ends_sha256")
    told = summed.join(last, (F.col("rep") == F.col("r")) & (F.col("depth") == F.col("at")), "left")
    return told.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS place FROM turns
), bits AS (
  SELECT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1))) AS bs FROM (SELECT DISTINCT c FROM placed)
), conv AS (
  SELECT c, c - (c % 20 + 20) % 20 AS base, xor(list_reduce(bs, lambda a, b: xor(a >> 1, CASE WHEN (a & 1) <> b THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM bits
), given AS (
  SELECT conv.c, base, h, least(h, count(p.place)) AS given FROM conv LEFT JOIN placed p ON p.c = base GROUP BY conv.c, base, h
), turns_of AS (
  SELECT g.c, place AS depth, digest, words FROM given g JOIN placed p ON p.c = base WHERE place <= given
  UNION ALL
  SELECT g.c, given + place - h, digest, words FROM given g JOIN placed p ON p.c = g.c WHERE place > h
), prefix AS (
  SELECT c, depth, words, string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS key FROM turns_of
  UNION ALL
  SELECT c, 0, 0, '' FROM given
), lengths AS (
  SELECT c, max(depth) AS length FROM prefix GROUP BY c
), node AS (
  SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(CASE WHEN depth = length THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
  FROM prefix JOIN lengths USING (c) GROUP BY key, depth
), child AS (
  SELECT substr(key, 1, 64 * (depth - 1)) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON node.key = child.key
), below AS (
  SELECT substr(key, 1, 64 * d) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own) GROUP BY ALL
)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN below ON own.key = below.key LEFT JOIN own up ON own.depth > 0 AND up.key = substr(own.key, 1, 64 * (own.depth - 1))
"""
