"""Best-fit packing with exact-complement hashing.

Documents become token ids (and an end id); only documents longer than a sequence are
cut.  The plan works on the number of pieces of each length (at most ``capacity``
numbers, so it is small however large the corpus), from the longest piece down: sums of
one, two or three available lengths are looked up, in hash indexes of single, pair and
triple sums, to fill the gap exactly, as often as the counts of all parts allow; what no
combination completes goes to the open sequence with the least room that takes it.  A plan is
a few runs "n sequences of these lengths".  Pieces find their places by their rank among
the pieces of their length; ranks are counted by bucket first, so a frequent length is
no hot key.

Defined cases: a null or empty text is one piece that holds only the end id; rows that
share a doc_id are documents of their own and keep their rows; a null doc_id is packed like any other; an
empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Distinct segments whose ids a worker remembers (about 32 bytes each), and bytes of text it looks up at a time.
CACHE_WORDS, RUN_BYTES = 1_000_000, 1 << 20
#: Segments that go to the tokenizer at a time.
LEARN = 2_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_PA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class WordIds:
    """Token ids of segments that the tokenizer's own rules never look across.

    Segments end at ASCII white space and between an ASCII letter and any other ASCII
    sign but an apostrophe (contractions), where the tokenizer's pattern always ends a
    pre-token.  ASCII letters count in lower case, as its normaliser makes them.  A run
    of texts that holds the start of a special token is parted at white space alone.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, B.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, spans: list[str]) -> None:
        sizes, parts, model = [], [], self.tokenizer.model
        for lo in range(0, len(spans), LEARN):  # the tokenizer's own results are large
            part = spans[lo : lo + LEARN]
            # the rules before the model leave a run of lower-case ASCII letters as it is
            plain = [x.isalpha() and x.isascii() and x.islower() for x in part]
            rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(part, plain, strict=True) if not p], add_special_tokens=False))
            got = [[t.id for t in model.tokenize(x)] if p else next(rest).ids for x, p in zip(part, plain, strict=True)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        n = np.concatenate(sizes)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *parts])
        # both are sorted and have no key in common: one merge for all columns
        where = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[where] = False
        for name, new in (("keys", keys), ("at", at), ("n", n)):
            merged = np.empty(len(old), new.dtype)
            merged[where], merged[old] = new, getattr(self, name)
            setattr(self, name, merged)

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        whole = b"<|" in data.tobytes()
        if not whole:
            data = B.LOWER[data]
        s, e, doc = B.words(data, off) if whole else _segments(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        keys, first, inverse = np.unique(B.word_hashes(data, s, e), return_index=True, return_inverse=True)
        if whole:
            keys = B.mix(keys, 99)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            order = new[np.argsort(keys[new])]
            self._learn(keys[order], [raw[a:b].decode("utf-8") for a, b in zip(s[first[order]].tolist(), e[first[order]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        n, lo = self.n[at][inverse], self.at[at][inverse]
        ends = np.cumsum(n)
        index = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
        return self.flat[index], np.diff(np.append(0, ends)[np.searchsorted(doc, np.arange(len(off)))])


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[97:123] = _SIGN[39] = False


def _segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each segment of lower-cased bytes."""
    s, e, doc = B.words(data, off)
    letter, sign = _LETTER[data], _SIGN[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
    cut[s] = False
    cut[off[:-1][off[:-1] < len(data)]] = False
    # words and cuts inside them never meet, so marks are enough to merge them
    cut[s] = True
    starts = np.flatnonzero(cut)
    cut[s] = False
    last = np.append(cut, False)
    last[e] = True
    return starts, np.flatnonzero(last), doc[np.searchsorted(s, starts, side="right") - 1]


@functools.cache
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(batches, path: str, capacity: int, end_id: int):
    words = _word_ids(path)
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        for a, b in B.runs(off, RUN_BYTES):
            flat, n = words.of(data[off[a] : off[b]], off[a : b + 1] - off[a])
            cut = np.append(0, np.cumsum(n))
            for k in range(b - a):
                own = np.append(flat[cut[k] : cut[k + 1]], np.uint32(end_id)).astype("<u4")
                for p, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo : lo + capacity]
                    crc = zlib.crc32(part.tobytes())
                    out.append((ids[a + k], p, lo, len(part), crc))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PIECES_PA, strict=True)] if out else [pa.array([], f.type) for f in _PIECES_PA], schema=_PIECES_PA)
    B.tidy()


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Runs (number of sequences, lengths of their pieces) that hold exactly these pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    done: list[tuple[int, list[int]]] = []
    loose: list[list] = []  # [sequences, lengths] that no exact combination filled
    rooms: list[tuple[int, int]] = []  # (room, index in loose), sorted

    def times(parts: tuple[int, ...]) -> int:
        return min(int(left[p]) // parts.count(p) for p in parts)

    def exact(first: int) -> tuple[int, ...] | None:
        """`first` with up to three available lengths that fill the rest exactly."""
        gap = capacity - first
        if not gap:
            return (first,)
        if times((first, gap)):
            return (first, gap)
        have = left > 0
        for x in np.flatnonzero(have[: gap + 1] & have[gap::-1])[::-1]:
            if 2 * x >= gap and times(parts := (first, int(x), int(gap - x))):
                return parts
        spectrum = np.fft.rfft(have, 2 * capacity + 2)
        pairs = np.fft.irfft(spectrum * spectrum, 2 * capacity + 2) > 0.5  # sums of two available lengths
        for x in np.flatnonzero(have[: gap + 1] & pairs[gap::-1])[::-1]:
            rest = int(gap - x)
            for y in np.flatnonzero(have[: rest + 1] & have[rest::-1])[::-1]:
                if 2 * y < rest or y > x:
                    continue
                if times(parts := (first, int(x), int(y), int(rest - y))):
                    return parts
        return None

    def loosen(n: int, parts: list[int]) -> None:
        loose.append([n, parts])
        if room := capacity - sum(parts):
            bisect.insort(rooms, (room, len(loose) - 1))

    for length in range(capacity, 0, -1):
        while n := int(left[length]):
            if (parts := exact(length)) is not None:
                m = times(parts)
                done.append((m, list(parts)))
                for p in parts:
                    left[p] -= m
                continue
            at = bisect.bisect_left(rooms, (length, -1))
            if at < len(rooms):  # best fit: the least room that still takes this length
                room, k = rooms.pop(at)
                have, parts = loose[k]
                m = min(n, have)
                loose[k][0] = have - m
                if have > m:
                    bisect.insort(rooms, (room, k))
                loosen(m, [*parts, length])
            else:
                each = min(n, capacity // length)
                m = n // each
                loosen(m, [length] * each)
                n = m * each
                left[length] -= n
                continue
            left[length] -= m
    return done + [(n, parts) for n, parts in loose if n]


def _places(runs: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length * 2**44 + first rank), and the first sequence and the offset of each."""
    taken, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for n, parts in runs:
        at = 0
        for p in parts:
            rows.append((p * (1 << 44) + int(taken[p]), base, at))
            taken[p] += n
            at += p
        base += n
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def _assign(batches, keys: np.ndarray, first: np.ndarray, offset: np.ndarray):
    for batch in batches:
        key = batch.column("length").to_numpy() * (1 << 44) + batch.column("rank").to_numpy()
        at = np.searchsorted(keys, key, side="right") - 1
        cols = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(first[at] + key - keys[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of docs(doc_id, text): where it begins in its document, and its sequence and offset."""
    B.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = B.stored(docs.mapInArrow(lambda x: _pieces(x, path, capacity, end_id), _PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    keys, first, offset = _places(plan(counts, capacity), capacity)
    buckets = max(B.MIN_BLOCKS, sum(counts.values()) // 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("bucket", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = local.join(before, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(lambda x: _assign(x, keys, first, offset), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
