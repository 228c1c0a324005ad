"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard.

A document is the weighted set of its five-word shingles (ASCII lower case; a shorter
text is one shingle).  weight = (1 + ln tf) * (1 + IDF_SHARE * ln(N / df) / ln N): rare
shingles weigh more, but edits inside a large group of copies don't outweigh what its
members share.  tf and df are exact over all documents (see blocks.py).

* A document with less than `threshold` of its weight in shingles that another document
  has too can have no partner (sum of minima <= that share), so it is done: this bound is exact.
* The others get `bands * rows` samples (ICWS).  Equal band values make a bucket.
* All texts of a bucket are compared with each other, exactly, but no pair becomes a row: the
  sums of minima of a bucket are one matrix product (see :func:`low_sums`), and a bucket
  returns a star for each of its components, so rows grow in proportion to bucket sizes.
* A bucket over CHUNK texts or CHUNK_SHINGLES shingles is dealt to chunks; each pair of chunks is
  a task of its own, so no task grows with the bucket.  A text goes to as many tasks as there are chunks.

Defined cases: equal texts are one class, empty and null texts (no words) together too; a
null doc_id has a null class; rows that share a doc_id are one document (the least class
of their texts counts); an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .graph import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 10, 3
IDF_SHARE = 0.25
#: Texts and shingles (with repeats) of a chunk of a bucket, and cells of the matrix that is multiplied at a time.
CHUNK, CHUNK_SHINGLES, TILE = 512, 400_000, 1 << 22
_SEND, _TELL = "block int, shard int, keys binary, count binary", "block int, shard int, df binary"
_SEND_PA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("count", pa.binary())])
_TELL_PA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("df", pa.binary())])
_CAND = "doc_id long, content binary, bands array<long>, vec binary, size long"
_CAND_PA = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64())), ("vec", pa.binary()), ("size", pa.int64())])


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, tf), one row for each distinct shingle of a document, in document order."""
    out = []
    for a, b in B.runs(off):
        part, o = B.LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
        s, e, d = B.words(part, o)
        w = B.word_hashes(part, s, e)
        at, h = B.window_hashes(w, d, size)
        doc = d[at]
        few = np.bincount(d, minlength=b - a)
        short = np.flatnonzero((few > 0) & (few < size))
        if len(short):  # all words of a short text are its one shingle
            first = np.searchsorted(d, short)
            whole = np.array([int(B.mix(np.bitwise_xor.reduce(B.mix(w[i : i + few[k]] + np.arange(few[k], dtype=B.U64), 7), keepdims=True), 8)[0]) for k, i in zip(short, first, strict=True)], B.U64)
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        out.append((doc[at] + a, h[at], np.diff(np.append(at, len(h)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, B.U64), np.zeros(0, np.int64))


def _send(table: pa.Table, size: int, shards: int) -> pa.Table:
    data, off = B.text_arrays(table["text"])
    _, keys, _ = shingle_sets(data, off, size)
    keys, n = np.unique(keys, return_counts=True)
    out = [(table["block"][0].as_py(), k, B.pack_keys(keys[a:b]), B.pack_ints(n[a:b])) for k, a, b in B.shard_slices(keys, shards)]
    return pa.Table.from_pylist([dict(zip(_SEND_PA.names, x, strict=True)) for x in out], schema=_SEND_PA)


def sum_counts(table: pa.Table) -> pa.Table:
    """Of one shard: the sum over all blocks, for each key of each block."""
    parts = [B.unpack_keys(x) for x in table["keys"].to_pylist()]
    n = np.concatenate([B.unpack_ints(x) for x in table["count"].to_pylist()])
    cut = np.cumsum([0, *map(len, parts)])
    _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=n).astype(np.int64)[inverse]
    return pa.table({"block": table["block"], "shard": table["shard"], "df": [B.pack_ints(total[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]}, schema=_TELL_PA)


@functools.cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), as 2**16 values, and their logarithms at 2**20."""
    def quantile(n: int) -> np.ndarray:
        u = (np.arange(n) + 0.5) / n
        x = np.where(u < 0.1, np.sqrt(2 * u), 1 - np.log1p(-u))
        for _ in range(60):
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 2)
        return x

    return quantile(1 << 16), np.log(quantile(1 << 20))


def weighted_samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """ICWS samples, `k` for each of the weighted sets that begin at `starts` (none is empty)."""
    r_of, lnc_of = _gamma_tables()
    lnw, lens = np.log(weights), np.diff(np.append(starts, len(keys)))
    out = np.empty((len(starts), k), B.U64)
    for i in range(k):
        h = B.mix(keys, 1000 + i)
        r = r_of[(h & B.U64(0xFFFF)).astype(np.int32)]
        lnc = lnc_of[((h >> B.U64(16)) & B.U64(0xFFFFF)).astype(np.int32)]
        beta = (h >> B.U64(36)).astype(np.float64) * 2.0**-28
        t = np.floor(lnw / r + beta)
        a = lnc - r * (t - beta + 1)
        best = np.repeat(np.minimum.reduceat(a, starts), lens)
        value = h + (t.astype(np.int64) + 1024).astype(B.U64) * B.U64(0x9E3779B97F4A7C15)
        out[:, i] = np.maximum.reduceat(np.where(a == best, value | B.U64(1), B.U64(0)), starts)
    return out


def _pack_vec(keys: np.ndarray, tf: np.ndarray, df: np.ndarray) -> bytes:
    """Keys shortened to 48 bits, which is enough for the texts of one bucket, with their tf and df."""
    keys = keys >> B.U64(16)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    raw, counts = B.pack_keys(keys[new]), B.pack_ints(tf[new])
    return len(raw).to_bytes(4, "little") + len(counts).to_bytes(4, "little") + raw + counts + B.pack_ints(df[new])


def _unpack_vec(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = 8 + int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    return B.unpack_keys(raw[8:n]), B.unpack_ints(raw[n : n + m]), B.unpack_ints(raw[n + m :])


def rarity(df: np.ndarray, n_docs: int, idf: float) -> np.ndarray:
    return 1 + idf * np.log(n_docs / df) / np.log(max(2, n_docs))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets (sorted keys, weights), neither empty."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def low_sums(row: np.ndarray, keys: np.ndarray, tf: np.ndarray, rare: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Sums of minima of the weights of all sets in `left` with all sets in `right` (indexes below `n`).

    min((1 + ln s) r, (1 + ln t) r) is the sum over levels j up to min(s, t) of r (ln j - ln(j - 1)), with r for
    j = 1.  So with a column sqrt(that) for each key and level, the sum of minima is a product of matrices.
    """
    _, key, seen = np.unique(keys, return_inverse=True, return_counts=True)
    own = np.flatnonzero(seen[key] > 1)
    own = own[np.argsort(key[own], kind="stable")]
    row, key, tf, rare = row[own], key[own], tf[own], rare[own]
    many = np.flatnonzero(tf > 1)  # levels above one; there are at most as many as words
    out = np.zeros((len(left), len(right)), np.float32)

    def add(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:  # columns are ascending
        new = np.ones(len(column), bool)
        new[1:] = column[1:] != column[:-1]
        column = np.cumsum(new) - 1
        width = max(1, TILE // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            part = slice(*np.searchsorted(column, [lo, lo + width]))
            tile = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
            tile[row[part], column[part] - lo] = np.sqrt(value[part])
            np.add(out, tile[left] @ tile[right].T, out=out)

    add(row, key, rare)
    more = tf[many] - 1
    at, level = np.repeat(many, more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 2
    order = np.lexsort((level, key[at]))
    at, level = at[order], level[order]
    add(row[at], key[at] * (1 << 32) + level, rare[at] * np.log(level / (level - 1)))
    return out


def _bucket_links(reps: list[int], sides: np.ndarray, vecs: list[bytes], threshold: float, n_docs: int, idf: float) -> list[tuple[int, int]]:
    """Stars (least text, text) of the components that the links of a bucket, or of two of its chunks, make."""
    sets = [_unpack_vec(v) for v in vecs]
    n = len(sets)
    rare = [rarity(df, n_docs, idf) for _, _, df in sets]
    weight = [(1 + np.log(tf)) * r for (_, tf, _), r in zip(sets, rare, strict=True)]
    exact = lambda a, b: weighted_jaccard((sets[a][0], weight[a]), (sets[b][0], weight[b])) >= threshold
    left, right = (np.arange(n), np.arange(n)) if not sides.any() else (np.flatnonzero(sides == 1), np.flatnonzero(sides == 2))
    if not len(left) or not len(right):
        return []
    if n < 4:
        found = [(a, b) for a in left.tolist() for b in right.tolist() if a != b and (a < b or sides.any()) and exact(a, b)]
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
    else:
        total, rows = np.array([w.sum() for w in weight]), np.repeat(np.arange(n), [len(w) for w in weight])
        low = low_sums(rows, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.concatenate(rare), left, right, n)
        like = low / (total[left][:, None] + total[right][None, :] - low)
        a, b = np.nonzero(like >= threshold - 1e-4)
        a, b, near = left[a], right[b], like[a, b] < threshold + 1e-4
        if not sides.any():
            a, b, near = a[a < b], b[a < b], near[a < b]
        ok = ~near
        for k in np.flatnonzero(near):  # what 32-bit sums can't decide
            ok[k] = exact(a[k], b[k])
        a, b = a[ok], b[ok]
    label, names = np.arange(n), np.array(reps, np.int64)
    order = np.argsort(names, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    a, b = place[a], place[b]
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    names = names[order]
    return list(zip(names[label[moved]].tolist(), names[moved].tolist(), strict=True))


def _links(batches, threshold: float, n_docs: int, idf: float):
    """Of rows (bucket, i, j, side, rep, vec), sorted by (bucket, i, j): the stars of each (bucket, i, j)."""
    held: list = []
    last = None

    def flush() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        return _bucket_links([x[0] for x in held], np.array([x[1] for x in held]), [x[2] for x in held], threshold, n_docs, idf)

    for batch in batches:
        out: list[tuple[int, int]] = []
        for *key, side, rep, vec in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "rep", "vec")), strict=True):
            if key != last:
                out += flush()
                held.clear()
                last = key
            held.append((rep, side, vec))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    out = flush()
    held.clear()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _candidates(docs: pa.Table, told: pa.Table, n_docs: int, size: int, threshold: float, bands: int, rows: int, shards: int, idf: float) -> pa.Table:
    if not docs.num_rows:
        return _CAND_PA.empty_table()
    data, off = B.text_arrays(docs["text"])
    doc, shingle, tf = shingle_sets(data, off, size)
    keys, inverse = np.unique(shingle, return_inverse=True)
    df, answers = np.ones(len(keys), np.int64), dict(zip(told["shard"].to_pylist(), told["df"].to_pylist(), strict=True))
    for k, a, b in B.shard_slices(keys, shards):
        df[a:b] = B.unpack_ints(answers[k])
    df = df[inverse]
    w = (1 + np.log(tf)) * rarity(df, n_docs, idf)
    n = len(off) - 1
    total, shared = np.bincount(doc, weights=w, minlength=n), np.bincount(doc, weights=w * (df > 1), minlength=n)
    may = (total > 0) & (shared >= (threshold - 1e-9) * total)
    keep = may[doc]
    doc, shingle, w, tf, df = doc[keep], shingle[keep], w[keep], tf[keep], df[keep]
    ids = np.flatnonzero(may)
    starts = np.searchsorted(doc, ids)
    values, vecs = [], []
    cuts = np.append(starts, len(doc))
    for lo in range(0, len(ids), 64):
        hi = min(lo + 64, len(ids))
        part = slice(cuts[lo], cuts[hi])
        got = weighted_samples(shingle[part], w[part], starts[lo:hi] - cuts[lo], bands * rows).reshape(hi - lo, bands, rows)
        mixed = B.mix(np.arange(bands, dtype=B.U64), 77)[None, :]
        for r in range(rows):
            mixed = B.mix(mixed ^ got[:, :, r], 78 + r)
        values += mixed.view(np.int64).tolist()
        vecs += [_pack_vec(*(x[cuts[i] : cuts[i + 1]] for x in (shingle, tf, df))) for i in range(lo, hi)]
    return pa.table({"doc_id": docs["doc_id"].take(pa.array(ids)), "content": docs["content"].take(pa.array(ids)), "bands": values, "vec": vecs, "size": np.add.reduceat(tf, starts) if len(ids) else []}, schema=_CAND_PA)


def near_duplicate_classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, idf: float = IDF_SHARE) -> DataFrame:
    """(doc_id, class_id) for each row of docs(doc_id, text): class_id is the least doc_id of the class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, n_bytes = B.corpus_size(docs)
    shards = max(16, B.shard_count(n_bytes // 6))
    by_block = B.hash_block(docs, B.block_count(n_bytes, n)).withColumn("content", F.unhex(F.md5("text"))).groupBy("block")
    told = by_block.applyInArrow(B.lean(_send, size, shards), _SEND).groupBy("shard").applyInArrow(B.lean(sum_counts), _TELL)
    found = by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(_candidates, n, size, threshold, bands, rows, shards, idf), _CAND)
    cand = B.stored(found, "near-dedup")
    narrow = cand.where("doc_id is not null")
    reps = B.saved(narrow.groupBy("content").agg(F.min("doc_id").alias("rep")))
    sets = cand.select(F.col("doc_id").alias("rep"), "content", "bands", "vec", "size").join(reps, ["content", "rep"], "left_semi").dropDuplicates(["rep"])
    buckets = B.saved(sets.select("rep", "size", F.explode("bands").alias("bucket")))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 40)).alias("y")).where("n > 1")
    full = full.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles"))  # bands often make the same bucket
    chunks = full.select("bucket", F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    members = buckets.join(chunks, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    task = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("own", c).alias("i"), F.greatest("own", c).alias("j"), F.when(F.col("own") == c, 0).when(F.col("own") < c, 1).otherwise(2).alias("side")))
    tasks = members.select("bucket", "rep", F.explode(task).alias("t")).select("bucket", "t.*", "rep").join(sets.select("rep", "vec"), "rep")
    tasks = tasks.select("bucket", "i", "j", "side", "rep", "vec").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    label = components(tasks.mapInArrow(lambda x: _links(x, threshold, n, idf), "a long, b long"))
    copies = narrow.select("doc_id", "content").join(reps, "content").select("doc_id", "rep")
    copies = copies.join(label.toDF("rep", "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("rep"))
    classes = copies.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    out = docs.select("doc_id", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("empty"))
    least_empty = F.lit(out.where("empty").agg(F.min("doc_id")).head()[0]).cast("long")
    out = out.join(classes, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("empty"), F.coalesce(F.least("class_id", least_empty), least_empty)).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
