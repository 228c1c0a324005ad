"""Blocks of documents, and packed requests between blocks and key shards.

Several operators of this package need, for every distinct key of a document
(a word, a shingle, a window), one number that depends on the whole corpus.  A
row per key would shuffle tens of bytes for each word of the corpus.  Here

* documents are dealt to *blocks* of a few megabytes (:func:`hash_block`, :func:`range_block`),
* a block sends each key shard ONE row: its distinct keys, sorted, as
  compressed gaps (:func:`pack_keys`),
* a shard sees at most a bounded number of keys, as the number of shards grows
  with the corpus, and answers each block with one compressed array,
* the block is built again from the same exchange and reads its answers.

No group is larger than a block or a shard, a hot key is one key per block, and
every step is a pure function of its input, so a lost executor only repeats it.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text for a block, and keys for a shard, aimed at.
BLOCK_BYTES = 3 << 20
SHARD_KEYS = 1 << 20
#: Texts are hashed in runs of about so many bytes, which bounds the temporary arrays.
RUN_BYTES = 1 << 18
MIN_BLOCKS = 48

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _BASE_W = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, for whole arrays."""
    x = x.astype(U64, copy=True) if seed == 0 else x ^ U64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U64), 11)


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    def run(b: int) -> np.ndarray:
        out = np.full(n, U64(b), dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 2**64))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    p, q = _powers(size, base)
    return p[:n], q[:n]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> list[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document is a run of its own."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        out.append((at, to))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word (a run of bytes that are not white space), in order."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    per = np.diff(np.searchsorted(start, offsets))
    return start, end, np.repeat(np.arange(len(per)), per)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word: polynomial sums, then mixed with the length."""
    if not len(start):
        return np.zeros(0, U64)
    p, q = powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * p, out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F), 3)


def window_hashes(word: np.ndarray, doc: np.ndarray, size: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each window of `size` words within one document; position indexes `word`."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    p, q = powers(len(word) + 1, _BASE_W)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * p[:-1], out=total[1:])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix((total[at + size] - total[at]) * q[at], seed)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: the first one, then the gaps as planes of bytes; the mixed planes are compressed."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    top = int(gaps.max()) if len(gaps) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    out = [len(keys).to_bytes(4, "little"), int(keys[0]).to_bytes(8, "little"), bytes([width])]
    full = max(0, (int(gaps.mean()) if len(gaps) else 0).bit_length() - 2) // 8  # these planes are noise
    for k, plane in enumerate(planes):
        part = plane.tobytes() if k < full else zlib.compress(plane.tobytes(), 1)
        out += [len(part).to_bytes(4, "little"), bytes([k >= full]), part]
    return b"".join(out)


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    n, first, width, at = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:12], "little"), raw[12], 13
    planes = np.zeros((n - 1, 8), np.uint8)
    for k in range(width):
        size, packed = int.from_bytes(raw[at : at + 4], "little"), raw[at + 4]
        part, at = raw[at + 5 : at + 5 + size], at + 5 + size
        planes[:, k] = np.frombuffer(zlib.decompress(part) if packed else part, np.uint8)
    out = np.empty(n, U64)
    out[0] = first
    out[1:] = planes.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=U64)


def pack_bits(x: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(x).tobytes(), 1)


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8), count=n).astype(bool)


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers, compressed, in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([kind]) + zlib.compress(x.astype(f"<u{kind}").tobytes(), 1)


def unpack_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def shard_slices(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys, by their top bits; shards is a power of two."""
    if not len(keys):
        return []
    top = (keys >> U64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    cut = np.searchsorted(top, np.arange(shards + 1))
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and UTF-8 bytes of text: two numbers."""
    small_batches(docs.sparkSession)
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).head()
    return int(r["n"]), int(r["b"])


def block_count(n_bytes: int, n_rows: int = 0) -> int:
    return max(MIN_BLOCKS, -(-n_bytes // BLOCK_BYTES), -(-n_rows // 50_000))


def shard_count(n_keys: int) -> int:
    """A power of two, so that a shard is a prefix of the key."""
    return 1 << max(4, (max(1, n_keys) // SHARD_KEYS).bit_length())


def hash_block(docs: DataFrame, blocks: int) -> DataFrame:
    """Adds `block` by a hash of doc_id and text, so that null or repeated ids spread as others do; equal rows share a block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


#: Cuts that are found, and stand in the plan, at once; percentiles of this accuracy tell so many apart.
COARSE = 2_000
#: Cuts that are broadcast at most (8 bytes each).
BROADCAST_CUTS = 1_000_000


def _place(table: Column, most: int, key: Column) -> Column:
    """How many numbers of the sorted array `table`, which has `most` at most, are less than `key`."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - F.lit(1)) < key, step).otherwise(F.lit(0)))


def range_block(docs: DataFrame, blocks: int, key: str = "doc_id") -> DataFrame:
    """Adds `block` such that blocks follow the order of the key (nulls last, in blocks by a hash of their text).

    The cuts are quantiles of the key; equal keys share a block.  Up to COARSE cuts are
    literals of the plan.  Beyond, each range between two such cuts gets finer cuts of its own, in a small table
    that is joined (broadcast only if it is known to be small), so cuts stay as many as blocks are asked.
    Every evaluation gives the same blocks.
    """
    quantiles = lambda n: F.percentile_approx(F.col(key), [i / n for i in range(1, n)], 10_000)
    first = min(blocks, COARSE)
    r = docs.agg((quantiles(first) if first > 1 else F.lit(None).cast("array<long>")).alias("q"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).head()
    cuts = sorted({int(c) for c in r["q"] or []})
    coarse = _place(F.array(*map(F.lit, cuts)), len(cuts), F.col(key)) if cuts else F.lit(0)
    spread = max(1, -(-blocks * int(r["nulls"]) // max(1, int(r["n"]))))
    null = F.pmod(F.xxhash64("text"), F.lit(spread)).cast("int") if r["nulls"] else F.lit(0)
    if blocks <= first:
        return docs.withColumn("block", F.when(F.col(key).isNull(), F.lit(len(cuts) + 1) + null).otherwise(coarse).cast("int"))
    each = -(-blocks // first)
    rough = docs.withColumn("_rough", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(coarse))
    fine = saved(rough.where("_rough >= 0").groupBy("_rough").agg(F.array_sort(F.array_distinct(quantiles(each))).alias("_fine_cuts")).select(F.col("_rough").alias("_of_rough"), "_fine_cuts"))
    side = F.broadcast(fine) if (len(cuts) + 1) * each <= BROADCAST_CUTS else fine
    found = rough.join(side, F.col("_rough") == F.col("_of_rough"), "left")
    block = F.when(F.col("_rough") < 0, F.lit((len(cuts) + 1) * each) + null).otherwise(F.col("_rough") * each + _place(F.col("_fine_cuts"), each, F.col(key)))
    return found.withColumn("block", block.cast("int")).drop("_rough", "_of_rough", "_fine_cuts")


def tidy() -> None:
    """Gives freed memory back to the system: a worker lives on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    _trim()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another libc, which has nothing to trim
        return lambda _: None


def _trim() -> None:
    _libc()(0)


def lean(f, *args):
    """`f`, a function from tables to a table, with `args` after the tables; keeps no memory when it is done."""
    def one(table: pa.Table) -> pa.Table:
        out = f(table, *args)
        tidy()
        return out

    return one


def lean_pair(f, *args):
    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right, *args)
        tidy()
        return out

    return two


#: Bytes of a batch that goes to a worker; ten thousand texts would be tens of megabytes, twice in each process.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.  Where it is unset, one of our own, if all runs in this process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage: a small frame goes to the shared folder as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: a table in the shared folder, so that later readers take only the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many ids (8 bytes each) are broadcast at most.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose columns of the names in `gone` are equal, nulls too; `gone` is broadcast if its counted number allows."""
    names = gone.columns
    gone = saved(gone.toDF(*(f"_gone_{k}" for k in names)).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in names]
    return docs.join(side, functools.reduce(lambda a, b: a & b, same), "left_anti")
