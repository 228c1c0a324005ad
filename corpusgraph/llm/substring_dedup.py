"""Substring dedup: a merged count-min sketch finds windows that may repeat, a second pass groups only those, exactly.

A window is ``size`` consecutive words of one document.  Words covered by a window
whose word sequence also starts earlier (smaller key, or same document, earlier
start) are removed; windows are judged on the input.

1. Every block sends its windows' cells of a count-min sketch (``depth`` rows, its
   width grows with the corpus) to the shard of that cell range; shards add up the
   partition sketches and tell each block which of its cells count two or more.
   The estimate, the least of the rows, is never below the true count.
2. Windows estimated to repeat go, as distinct 64-bit hashes, to exact shards.  Blocks
   follow document order, so "an earlier block has it" is one bit an answer; inside
   a block the first occurrence is found locally.

Defined cases: null and empty texts have no words and stay as they are; a null key sorts
last; rows with one key are ordered by their text, each being a document of its own, so
of repeated rows the first stays; texts shorter than a window keep all words; an empty
table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

WINDOW = 20
DEPTH = 2
#: Sketch cells for each byte of text (a word has about six bytes) and cells a shard holds.
CELLS_A_BYTE = 1.4
SHARD_CELLS = 1 << 24


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return B.mix(hashes, 21 + row) >> B.U64(64 - bits)


def _block_windows(table: pa.Table, size: int):
    """Documents of a block in order, with word spans and window hashes."""
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    data, off = B.text_arrays(table["text"])
    starts, ends, docs, at_all, hash_all, seen = [], [], [], [], [], 0
    for a, b in B.runs(off):
        part = data[off[a] : off[b]]
        s, e, d = B.words(part, off[a : b + 1] - off[a])
        at, h = B.window_hashes(B.word_hashes(part, s, e), d, size)
        starts.append(s + off[a])
        ends.append(e + off[a])
        docs.append(d + a)
        at_all.append(at + seen)
        hash_all.append(h)
        seen += len(s)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return table, data, off, join(starts, np.int64), join(ends, np.int64), join(docs, np.int64), join(at_all, np.int64), join(hash_all, B.U64)


def _sketch_request(table: pa.Table, size: int, depth: int, bits: int, shards: int) -> pa.Table:
    block = table["block"][0].as_py()
    *_, hashes = _block_windows(table, size)
    out: dict[str, list] = {"block": [], "shard": [], "keys": [], "more": []}
    for row in range(depth):
        cells, n = np.unique(_cells(hashes, row, bits), return_counts=True)
        for k, a, b in B.shard_slices(cells << B.U64(64 - bits), shards):
            out["block"].append(block)
            out["shard"].append(row * shards + k)
            out["keys"].append(B.pack_keys(cells[a:b]))
            out["more"].append(B.pack_bits(n[a:b] > 1))
    return pa.table(out, schema=_REQUEST)


def _sketch_answer(table: pa.Table, bits: int, shards: int) -> pa.Table:
    shard = table["shard"][0].as_py()
    per = 1 << (bits - shards.bit_length() + 1)
    first = (shard % shards) * per
    count = np.zeros(per, np.uint8)
    for raw, more in zip(table["keys"].to_pylist(), table["more"].to_pylist(), strict=True):
        at = (B.unpack_keys(raw) - B.U64(first)).astype(np.int64)
        count[at] = np.minimum(2, count[at] + 1 + B.unpack_bits(more, len(at)))
    bits_out = [B.pack_bits(count[(B.unpack_keys(raw) - B.U64(first)).astype(np.int64)] > 1) for raw in table["keys"].to_pylist()]
    return pa.table({"block": table["block"], "shard": table["shard"], "bits": bits_out}, schema=_ANSWER)


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["shard"].to_pylist(), table["bits"].to_pylist(), strict=True))


def _repeated(hashes: np.ndarray, answers: dict[int, bytes], depth: int, bits: int, shards: int) -> np.ndarray:
    """Which windows the merged sketch estimates to occur twice or more."""
    out = np.ones(len(hashes), bool)
    for row in range(depth):
        cells, inverse = np.unique(_cells(hashes, row, bits), return_inverse=True)
        flag = np.zeros(len(cells), bool)
        for k, a, b in B.shard_slices(cells << B.U64(64 - bits), shards):
            flag[a:b] = B.unpack_bits(answers[row * shards + k], b - a)
        out &= flag[inverse]
    return out


def _exact_request(docs: pa.Table, answers: pa.Table, size: int, depth: int, bits: int, shards: int, exact: int) -> pa.Table:
    """Keys that may repeat, for their shards; and which these are, for the block itself (a negative shard)."""
    out: dict[str, list] = {"block": [], "shard": [], "keys": [], "more": []}
    if docs.num_rows:
        block = docs["block"][0].as_py()
        *_, hashes = _block_windows(docs, size)
        keys = np.unique(hashes)
        asked = _repeated(keys, _answers(answers), depth, bits, shards)
        own = keys[asked]
        for k, a, b in B.shard_slices(own, exact):
            out["block"].append(block)
            out["shard"].append(k)
            out["keys"].append(B.pack_keys(own[a:b]))
            out["more"].append(b"")
        out["block"].append(block)
        out["shard"].append(-1 - block)
        out["keys"].append(b"")
        out["more"].append(B.pack_bits(asked))
    return pa.table(out, schema=_REQUEST)


def _exact_answer(table: pa.Table) -> pa.Table:
    """For each block: which of its keys an earlier block has."""
    if table["shard"][0].as_py() < 0:
        return pa.table({"block": table["block"], "shard": table["shard"], "bits": table["more"]}, schema=_ANSWER)
    table = table.sort_by("block")
    parts = [B.unpack_keys(raw) for raw in table["keys"].to_pylist()]
    cut = np.cumsum([0, *map(len, parts)])
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return pa.table({"block": table["block"], "shard": table["shard"], "bits": [B.pack_bits(later[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]}, schema=_ANSWER)


def _kept(docs: pa.Table, exact_bits: pa.Table, size: int, exact: int, carry: list[str]) -> pa.Table:
    schema = pa.schema([*_RESULT, *(docs.schema.field(k) for k in carry)])
    if not docs.num_rows:
        return schema.empty_table()
    table, data, off, start, end, doc, at, hashes = _block_windows(docs, size)
    answers = _answers(exact_bits)
    gone = np.zeros(len(start), bool)
    if len(hashes):
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        later = np.ones(len(hashes), bool)
        later[index] = False  # windows are in document order: the first of each key here
        asked = np.flatnonzero(B.unpack_bits(answers[-1 - table["block"][0].as_py()], len(keys)))
        earlier = np.zeros(len(keys), bool)
        for k, a, b in B.shard_slices(keys[asked], exact):
            earlier[asked[a:b]] = B.unpack_bits(answers[k], b - a)
        hit = at[later | earlier[inverse]]
        edges = np.bincount(hit, minlength=len(start) + 1) - np.bincount(hit + size, minlength=len(start) + 1)
        gone = np.cumsum(edges[:-1]) > 0
    n_docs = len(off) - 1
    n_words, n_gone = np.bincount(doc, minlength=n_docs), np.bincount(doc[gone], minlength=n_docs)
    room, cut, start, end = np.append(data, np.uint8(32)), np.cumsum(np.append(0, n_words - n_gone)), start[~gone], end[~gone]
    texts = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            texts.append("")
            continue
        lo, hi = start[a], end[b - 1]
        piece, s, e = room[lo : hi + 1].copy(), start[a:b] - lo, end[a:b] - lo
        edge = np.zeros(len(piece), np.int8)
        edge[s] += 1
        edge[e] -= 1
        keep = np.cumsum(edge) > 0
        keep[e[:-1]] = True  # the byte after a word becomes the joining space
        piece[e] = 32
        texts.append(piece[keep].tobytes().decode("utf-8"))
    return pa.table({"doc_id": table["doc_id"], "n_words": n_words, "n_removed": n_gone, "kept_text": texts} | {k: table[k] for k in carry}, schema=schema)


_REQUEST = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_REQUEST_DDL, _ANSWER_DDL = "block int, shard int, keys binary, more binary", "block int, shard int, bits binary"


def remove_repeats(docs: DataFrame, size: int = WINDOW, depth: int = DEPTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs(doc_id, text), and the columns in `carry`."""
    more = [k for k in carry if k not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
    n, n_bytes = B.corpus_size(docs)
    bits = max(16, int(n_bytes * CELLS_A_BYTE).bit_length())
    shards = max(16, (1 << bits) // SHARD_CELLS)
    exact = max(16, B.shard_count(n_bytes // 12))
    by_block = B.range_block(docs, B.block_count(n_bytes, n)).groupBy("block")
    asked = by_block.applyInArrow(B.lean(_sketch_request, size, depth, bits, shards), _REQUEST_DDL)
    told = asked.groupBy("shard").applyInArrow(B.lean(_sketch_answer, bits, shards), _ANSWER_DDL)
    asked = by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(_exact_request, size, depth, bits, shards, exact), _REQUEST_DDL)
    told = asked.groupBy("shard").applyInArrow(B.lean(_exact_answer), _ANSWER_DDL)
    out = [k for k in carry if k != "doc_id"]
    kinds = dict(docs.dtypes)
    result = ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *(f"`{k}` {kinds[k]}" for k in out)])
    return by_block.cogroup(told.groupBy("block")).applyInArrow(B.lean_pair(_kept, size, exact, out), result)


def rewrite(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, lang, source, n_chars) without repeats: untouched texts stay as they are, emptied documents go."""
    rows = remove_repeats(docs, size, carry=("text", "lang", "source")).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return rows.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later
), lost AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id
"""
