"""Suffix-array dedup of bytes: sparse prefix doubling, ranks by sorted pairs at growing offsets until unique or past the threshold.

A byte is removed if it lies in a string of `LENGTH` bytes that also starts in a document with a smaller id;
strings are judged on the input.  The suffixes at all positions would be hundreds of bytes of shuffle a byte of text, so

* names double inside a block first: the strings of 2, 4 and 8 bytes are the numbers they spell, 16 is a pair of them.
  Every window of LENGTH bytes has one *anchor*, the leftmost least of its 16-byte names, and
  neighbouring windows that share an anchor are a *unit* (about 6 for 100 bytes).  Equal windows have equal anchors.
* offset 16: blocks send their anchors' names, sorted, to shards (a shard is a range of names); the shard merges
  and ranks them.  An anchor that only one document has is unique: its windows are done, they repeat nowhere.
* past the threshold: of the other units, pairs (rank of the anchor, name of the whole unit, itself a pair at
  offset 50) are sorted.  A unit that an earlier document has as a whole is repeated; one whose anchor
  has no other unit is done too.
* what is left are first copies of units whose anchor stands in unlike surroundings, at the edges of repeated passages:
  their single windows are sorted, by pairs 16 + 16 and 32 + 18.

A unit that an earlier one equals needs no single windows, as the earlier one's stand for it, so copies in any
number cost one sorted name a unit and block.  A row is a block's request to a shard, hot strings are one name a block.  Names are
64-bit hashes; chance collisions are as for the package's other keys.  Blocks are in order of the ids, so "earlier" is a smaller block.

Defined cases: a null or empty text has no bytes; rows with equal ids are not smaller than one another; null ids come after
all others and are not smaller than one another; a text shorter than LENGTH keeps all; an
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

LENGTH = 50
GRAM = 16
#: Shards of single windows for one of anchors.
WINDOW_SHARDS = 8
#: Blocks from here on hold rows with no id, which are no earlier than one another.
NO_ID = 1 << 30
U64 = np.uint64


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of two names that follow (or overlap) each other."""
    return B.mix(a * U64(0x9E3779B97F4A7C15) + (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F))


def _names(data: np.ndarray) -> np.ndarray:
    """Of each position the name of the GRAM bytes from there: doubled at offsets 1, 2, 4 and 8."""
    x = data.astype(U64)
    for offset in (1, 2, 4):
        x = x[:-offset] | (x[offset:] << U64(8 * offset))
    return _pair(x[:-8], x[8:])


def _long(names: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of `length` bytes (32 to 64) at some positions, doubled at 16 and then at length - 32."""
    rest = at + (length - 2 * GRAM)
    return _pair(_pair(names[at], names[at + GRAM]), _pair(names[rest], names[rest + GRAM]))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Block:
    """Documents of one block in order of their ids, as bytes, and their units."""

    def __init__(self, table: pa.Table, length: int):
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
        self.table, self.length, self.number = table, length, table["block"][0].as_py()
        self.data, self.off = B.text_arrays(table["text"])
        ids = table["doc_id"].combine_chunks()
        ids = np.zeros(len(ids), np.int64) if ids.null_count else ids.to_numpy()
        order = np.cumsum(np.append(0, ids[1:] != ids[:-1])) if len(ids) else ids
        parts = [self._units(a, min(a + B.RUN_BYTES, len(self.data))) for a in range(0, max(0, len(self.data) - length + 1), B.RUN_BYTES)]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.first, self.last, self.gram, self.whole = join(0, np.int64), join(1, np.int64), join(2, U64), join(3, U64)
        self.doc = order[np.searchsorted(self.off, self.first, side="right") - 1] if len(self.first) else np.zeros(0, np.int64)

    def _units(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Units of the windows that start from a to b: first and last start, name of the anchor, name of all their bytes."""
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        piece = self.data[a : b + self.length - 1]
        n = len(piece) - self.length + 1
        if n <= 0:
            return empty
        names = _names(piece)
        least = _sliding_min(names, self.length - GRAM + 1)
        fits = np.ones(n, bool)
        ends = self.off[np.searchsorted(self.off, a, side="right") : np.searchsorted(self.off, b + self.length, side="right")] - a
        no = (ends[:, None] - np.arange(1, self.length)).ravel()
        fits[no[(no >= 0) & (no < n)]] = False
        fresh = np.ones(n, bool)
        fresh[1:] = (least[1:] != least[:-1]) | (names[: n - 1] == least[:-1]) | ~fits[:-1]
        first = np.flatnonzero(fits & fresh)
        if not len(first):
            return empty
        stops = np.flatnonzero(fresh | ~fits)
        last = np.append(stops, n)[np.searchsorted(stops, first, side="right")] - 1
        whole = _pair(_long(names, first, self.length), _long(names, last, self.length)) ^ (last - first).astype(U64)
        return first + a, last + a, least[first], whole

    def windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, document and name of each window of some units."""
        first, lens = self.first[units], self.last[units] - self.first[units] + 1
        at = np.repeat(first - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
        out = np.zeros(len(at), U64)
        for a in range(0, len(self.data), B.RUN_BYTES):
            i, j = np.searchsorted(at, [a, a + B.RUN_BYTES])
            if j > i:
                out[i:j] = _long(_names(self.data[a : a + B.RUN_BYTES + self.length]), at[i:j] - a, self.length)
        return at, np.repeat(self.doc[units], lens), out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place in it of each distinct key, number of the key of each row); rows keep their order within a key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return order, first, of


class Request:
    """Rows of a block to shards."""

    def __init__(self, block: int):
        self.block, self.rows = block, []

    def add(self, kind: int, keys: np.ndarray, shards: int, more=None) -> None:
        """Sorted distinct keys, each slice to its shard; more(a, b) gives what goes along."""
        for k, a, b in B.shard_slices(keys, shards):
            self.rows.append((self.block, kind * shards + k, B.pack_keys(keys[a:b]), more(a, b) if more else b""))

    def own(self, keys: bytes, more: bytes) -> None:
        self.rows.append((self.block, -1 - self.block, keys, more))

    def table(self) -> pa.Table:
        return pa.table(dict(zip(_REQUEST.names, zip(*self.rows, strict=True), strict=True)) if self.rows else {k: [] for k in _REQUEST.names}, schema=_REQUEST)


class Answers:
    """Rows of shards to a block."""

    def __init__(self, table: pa.Table):
        self.of = {s: (x, y) for s, x, y in zip(table["shard"].to_pylist(), table["bits"].to_pylist(), table["ranks"].to_pylist(), strict=True)}

    def own(self, block: int) -> tuple[bytes, bytes]:
        return self.of[-1 - block]

    def bits(self, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for k, a, b in B.shard_slices(keys, shards):
            out[a:b] = B.unpack_bits(self.of[kind * shards + k][0], b - a)
        return out

    def ranks(self, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
        """Ranks of those keys whose bit is set, in order."""
        found = [B.unpack_keys(self.of[kind * shards + k][1]) for k, *_ in B.shard_slices(keys, shards)]
        return np.concatenate(found) if found else np.zeros(0, U64)


_REQUEST = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary()), ("ranks", pa.binary())])
_REQUEST_DDL, _ANSWER_DDL = "block int, shard int, keys binary, more binary", "block int, shard int, bits binary, ranks binary"


def _answer(table: pa.Table, bits: list[bytes], ranks: list[bytes] | None = None) -> pa.Table:
    return pa.table({"block": table["block"], "shard": table["shard"], "bits": bits, "ranks": ranks or [b""] * table.num_rows}, schema=_ANSWER)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's keys of all blocks: cuts between blocks, the blocks' order, and the keys' order, first places and numbers."""
    parts = [B.unpack_keys(raw) for raw in table["keys"].to_pylist()]
    keys = np.concatenate(parts) if parts else np.zeros(0, U64)
    return np.cumsum([0, *map(len, parts)]), np.minimum(table["block"].to_numpy(), NO_ID), *_groups(keys)


def _earlier(table: pa.Table) -> pa.Table:
    """For each block: which of its keys an earlier block has."""
    table = table.sort_by("block")
    cut, block, order, first, of = _merged(table)
    of_block = np.repeat(block, np.diff(cut))
    later = of_block > of_block[order[first]][of] if len(of) else np.zeros(0, bool)
    return _answer(table, [B.pack_bits(later[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])


def ask_anchors(table: pa.Table, length: int, shards: int) -> pa.Table:
    """Offset 16: the distinct anchors of a block, and which of them two of its documents have."""
    block = Block(table, length)
    order, first, _ = _groups(block.gram)
    docs = block.doc[order]
    more = docs[first] != docs[np.append(first[1:], len(docs)) - 1] if len(first) else np.zeros(0, bool)
    out = Request(block.number)
    out.add(0, block.gram[order[first]], shards, lambda a, b: B.pack_bits(more[a:b]))
    return out.table()


def rank_anchors(table: pa.Table, shards: int) -> pa.Table:
    """A shard's anchors in order: which are not unique, and their ranks (the shard's number in front)."""
    table = table.sort_by("block")
    cut, _, order, first, of = _merged(table)
    raw = table["more"].to_pylist()
    more = np.concatenate([B.unpack_bits(x, n) for x, n in zip(raw, np.diff(cut), strict=True)]) if len(of) else np.zeros(0, bool)
    many = np.bincount(of, weights=1 + more) > 1 if len(of) else np.zeros(0, bool)
    base = U64(table["shard"][0].as_py() << (64 - shards.bit_length() + 1))
    rank, bits = base + (np.cumsum(many) - 1).astype(U64), many[of] if len(of) else np.zeros(0, bool)
    slices = list(zip(cut[:-1], cut[1:], strict=True))
    return _answer(table, [B.pack_bits(bits[a:b]) for a, b in slices], [B.pack_keys(rank[of[a:b]][bits[a:b]]) for a, b in slices])


def ask_units(docs: pa.Table, answers: pa.Table, length: int, shards: int) -> pa.Table:
    """Past the threshold: of anchors that are not unique, the units (kind 0), and each rank's unit (kind 1; 0: several here)."""
    if not docs.num_rows:
        return _REQUEST.empty_table()
    block, told = Block(docs, length), Answers(answers)
    order, first, of = _groups(block.gram)
    anchors = block.gram[order[first]]
    alive = told.bits(0, anchors, shards)
    ranks = told.ranks(0, anchors, shards)
    out = Request(block.number)
    units = np.flatnonzero(alive[of]) if len(of) else np.zeros(0, np.int64)
    out.add(0, np.unique(block.whole[units]), shards)
    whole = block.whole[order]
    starts = first[alive]
    least, most = (np.minimum.reduceat(whole, first)[alive], np.maximum.reduceat(whole, first)[alive]) if len(first) else (starts.astype(U64), starts.astype(U64))
    one = np.where(least == most, least, U64(0))
    out.add(1, ranks, shards, lambda a, b: one[a:b].tobytes())
    out.own(B.pack_keys(ranks), B.pack_bits(alive))
    return out.table()


def rank_units(table: pa.Table, shards: int) -> pa.Table:
    """Kind 0: which units an earlier block has.  Kind 1: which ranks have more than one unit."""
    shard = table["shard"][0].as_py()
    if shard < 0:
        return _answer(table, table["more"].to_pylist(), table["keys"].to_pylist())
    if shard < shards:
        return _earlier(table)
    cut, _, order, first, of = _merged(table)
    if not len(of):
        return _answer(table, [b""] * table.num_rows)
    whole = np.frombuffer(b"".join(table["more"].to_pylist()), U64)
    ranked = whole[order]
    least, most = np.minimum.reduceat(ranked, first), np.maximum.reduceat(ranked, first)
    many = ((least != most) | (least == 0))[of]
    return _answer(table, [B.pack_bits(many[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])


def ask_windows(docs: pa.Table, answers: pa.Table, length: int, shards: int, wide: int) -> pa.Table:
    """Single windows of first copies of units whose anchor has other units too; and for the block itself what is settled."""
    if not docs.num_rows:
        return _REQUEST.empty_table()
    block, told = Block(docs, length), Answers(answers)
    order, first, of = _groups(block.gram)
    raw_alive, raw_ranks = told.own(block.number)
    alive, ranks = B.unpack_bits(raw_alive, len(first)), B.unpack_keys(raw_ranks)
    many = np.zeros(len(first), bool)
    many[alive] = told.bits(1, ranks, shards)
    units = np.flatnonzero(alive[of]) if len(of) else np.zeros(0, np.int64)
    w_order, w_first, w_of = _groups(block.whole[units])
    earlier = told.bits(0, block.whole[units][w_order[w_first]], shards) if len(units) else np.zeros(0, bool)
    repeated, single = np.zeros(len(block.first), bool), np.zeros(len(block.first), bool)
    if len(units):
        oldest = block.doc[units][w_order[w_first]]  # units are in document order
        repeated[units] = earlier[w_of] | (block.doc[units] > oldest[w_of])
        single[units] = ~repeated[units] & many[of[units]]
    *_, names = block.windows(np.flatnonzero(single))
    out = Request(block.number)
    out.add(0, np.unique(names), wide)
    out.own(B.pack_bits(repeated), B.pack_bits(single))
    return out.table()


def rank_windows(table: pa.Table) -> pa.Table:
    if table["shard"][0].as_py() < 0:
        return _answer(table, table["more"].to_pylist(), table["keys"].to_pylist())
    return _earlier(table)


def cut(docs: pa.Table, answers: pa.Table, length: int, shards: int) -> pa.Table:
    if not docs.num_rows:
        return _RESULT.empty_table()
    block, told = Block(docs, length), Answers(answers)
    raw_single, raw_repeated = told.own(block.number)
    single, repeated = (B.unpack_bits(x, len(block.first)) for x in (raw_single, raw_repeated))
    at, doc, names = block.windows(np.flatnonzero(single))
    order, first, of = _groups(names)
    hit = told.bits(0, names[order[first]], shards)[of] | (doc > doc[order[first]][of]) if len(names) else np.zeros(0, bool)
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, block.first[repeated], 1)
    np.add.at(edge, block.last[repeated] + length, -1)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rows: dict[str, list] = {"n_bytes": [], "removed": [], "kept": []}
    for a, b in zip(block.off[:-1], block.off[1:], strict=True):
        part = gone[a:b]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], part.view(np.int8), [0]))))
        rows["n_bytes"].append(int(b - a))
        rows["removed"].append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
        rows["kept"].append(block.data[a:b][~part].tobytes())
    return pa.table({"doc_id": block.table["doc_id"], **rows}, schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_RESULT_DDL = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed spans of bytes, kept bytes) for each row of docs(doc_id, text); length is from 32 to 64."""
    if not 2 * GRAM <= length <= 4 * GRAM:
        raise ValueError(f"length must lie from {2 * GRAM} to {4 * GRAM}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, n_bytes = B.corpus_size(docs)
    blocks, shards = B.block_count(n_bytes, n), B.shard_count(n_bytes // 16)
    wide = shards * WINDOW_SHARDS  # of single windows there may be half as many as bytes
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    placed = B.range_block(docs, blocks).withColumn("block", F.when(F.col("doc_id").isNull(), no_id).otherwise(F.col("block")))
    by_block = placed.select("block", "doc_id", "text").groupBy("block")
    told = by_block.applyInArrow(B.lean(ask_anchors, length, shards), _REQUEST_DDL).groupBy("shard").applyInArrow(B.lean(rank_anchors, shards), _ANSWER_DDL)
    told = by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(ask_units, length, shards), _REQUEST_DDL).groupBy("shard").applyInArrow(B.lean(rank_units, shards), _ANSWER_DDL)
    told = by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(ask_windows, length, shards, wide), _REQUEST_DDL).groupBy("shard").applyInArrow(B.lean(rank_windows), _ANSWER_DDL)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(cut, length, wide), _RESULT_DDL)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d)
), least AS (
  SELECT w, min(doc_id) AS m FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM win JOIN least USING (w) WHERE doc_id > m
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k
), gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM span
), lost AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS rest, string_agg(substr(x, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * rest + 1), x))) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
