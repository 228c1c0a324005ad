"""Language-model scores by class bigrams: exchange clustering, then class transitions times word emissions.

Words are runs of bytes that are not ASCII white space, A-Z lower-cased; each document
ends with one end token, which is also the context of its first word.

1. Blocks send their distinct words with training counts to key shards, which add them up (exact, of all
   training documents) and name the most frequent words.
2. Units are the `top` most frequent training words, and for all other words their
   shape (last letter, length).  Unit bigrams are counted over all training documents; the exchange
   algorithm moves units between classes while the bigram likelihood rises.
3. Every other word seen RARE times or more gets a class of its own by one exchange step against these classes: blocks send
   the classes before and after it, with counts, to the word's shard, which picks the class of the greatest likelihood.
   Rarer words, and words that training lacks, keep their shape's class.  So the word classes grow with the vocabulary.
4. Class transitions and class sizes are counted again under the classes of all words.
5. p(word | before) = mix * p(class | class before) * p(word | class) + (1 - mix) * base,
   base = (c + 1) / (N + V + 1).

Defined cases: a null or empty text is its end token alone; with no training document
c = N = V = 0; a null doc_id counts as training (no remainder); rows that share a doc_id are
documents of their own; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

TOP, CLASSES, SWEEPS = 448, 48, 12
MIX, DELTA, ALPHA = 0.9, 0.5, 0.1
SHAPES, RARE = 64, 2
#: Words and contexts that are rated at a time in a shard.
KEYS_AT_A_TIME, CONTEXTS_AT_A_TIME = 1 << 15, 200_000
_SEND = "block int, shard int, keys binary, count binary"
_SEND_PA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("count", pa.binary())])
_LONGS = pa.list_(pa.int64())
_TELL = "tokens array<long>, kinds array<long>, top array<long>, top_count array<long>"
_TELL_PA = pa.schema([(k, _LONGS) for k in ("tokens", "kinds", "top", "top_count")])
_ASK = "block int, shard int, keys binary, count binary, entries binary, sides binary, times binary"
_ASK_PA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), *((k, pa.binary()) for k in ("keys", "count", "entries", "sides", "times"))])
_CLASS = "block int, shard int, count binary, cls binary, tokens array<long>, kinds array<long>"
_CLASS_PA = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("count", pa.binary()), ("cls", pa.binary()), ("tokens", _LONGS), ("kinds", _LONGS)])
_SCORE = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"

#: Last byte of a word -> 32 kinds: the letters, full stop, comma, digits, other signs, bytes of other letters.
_LAST = np.full(256, 29, np.int64)
_LAST[97:123] = np.arange(26)
_LAST[46], _LAST[44], _LAST[48:58], _LAST[128:] = 26, 27, 28, 30


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of each word; the low six bits of a key are the word's shape."""
    data = B.LOWER[data]
    s, e, doc = B.words(data, off)
    shape = _LAST[data[e - 1]] * 2 + (e - s > 6) if len(s) else np.zeros(0, np.int64)
    return (B.word_hashes(data, s, e) & B.U64(2**64 - SHAPES)) | shape.astype(B.U64), doc


def _columns(table: pa.Table):
    data, off = B.text_arrays(table["text"])
    keys, docs = [], []
    for a, b in B.runs(off):
        k, d = word_keys(data[off[a] : off[b]], off[a : b + 1] - off[a])
        keys.append(k)
        docs.append(d + a)
    train = np.array(table["train"].to_pylist(), bool)
    return (np.concatenate(keys) if keys else np.zeros(0, B.U64)), (np.concatenate(docs) if docs else np.zeros(0, np.int64)), train


def _send(table: pa.Table, shards: int) -> pa.Table:
    words, doc, train = _columns(table)
    keys, inverse = np.unique(words, return_inverse=True)
    n = np.bincount(inverse, weights=train[doc], minlength=len(keys)).astype(np.int64)
    rows = [(table["block"][0].as_py(), k, B.pack_keys(keys[a:b]), B.pack_ints(n[a:b])) for k, a, b in B.shard_slices(keys, shards)]
    return pa.Table.from_pylist([dict(zip(_SEND_PA.names, r, strict=True)) for r in rows], schema=_SEND_PA)


def _tell(table: pa.Table, top: int) -> pa.Table:
    """Of one shard: training tokens and kinds of each shape, and the most frequent words."""
    keys, inverse = np.unique(np.concatenate([B.unpack_keys(x) for x in table["keys"].to_pylist()]), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([B.unpack_ints(x) for x in table["count"].to_pylist()])).astype(np.int64)
    shape = (keys & B.U64(SHAPES - 1)).astype(np.int64)
    best = np.lexsort((keys, -n))[:top]
    best = best[n[best] > 0]
    by_shape = lambda w: np.bincount(shape, weights=w, minlength=SHAPES).astype(np.int64).tolist()
    return pa.table({"tokens": [by_shape(n)], "kinds": [by_shape(n > 0)], "top": [keys[best].view(np.int64).tolist()], "top_count": [n[best].tolist()]}, schema=_TELL_PA)


def _units(words: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Unit of each word: its place among the (sorted) top words, or len(top) + its shape."""
    unit = len(top) + (words & B.U64(SHAPES - 1)).astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, words), len(top) - 1)
        unit = np.where(top[at] == words, at, unit)
    return unit


def _chain(words: np.ndarray, doc: np.ndarray, n_docs: int, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with an end after each document, and the place of each word there."""
    end = len(top) + SHAPES
    place = np.arange(len(words)) + doc
    out = np.full(len(words) + n_docs, end, np.int64)
    out[place] = _units(words, top)
    return out, place


def _bigrams(batches, top: np.ndarray):
    u = len(top) + SHAPES + 1
    total = np.zeros(u * u, np.int64)
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        for a, b in B.runs(off):
            words, doc = word_keys(data[off[a] : off[b]], off[a : b + 1] - off[a])
            seq, _ = _chain(words, doc, b - a, top)
            total += np.bincount(np.append(u - 1, seq[:-1]) * u + seq, minlength=u * u)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; pairs[u, v] counts v after u.  Each unit in turn moves to the class of greatest likelihood."""
    n = len(pairs)
    freq = pairs.sum(1) + pairs.sum(0)
    order = np.lexsort((np.arange(n), -freq))
    cls = np.empty(n, np.int64)
    cls[order] = np.minimum(np.arange(n), classes - 1) if n <= classes else np.arange(n) % classes
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    one = np.zeros((n, classes))
    one[np.arange(n), cls] = 1
    g = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, right, left, own = cls[u], pairs[u] @ one, pairs[:, u] @ one, float(pairs[u, u])
            if not right.sum() + left.sum():
                continue
            right[old] -= own  # counts to and from the other units of each class
            left[old] -= own
            g[old] -= right
            g[:, old] -= left
            g[old, old] -= own
            row, col = g.sum(1) + left, g.sum(0) + right  # the others keep their links with u wherever it goes
            gain = (f(g + right[None, :]) - f(g)).sum(1) + (f(g + left[:, None]) - f(g)).sum(0)
            d = np.arange(classes)
            gain += f(g[d, d] + right[d] + left[d] + own) - f(g[d, d] + right[d]) - f(g[d, d] + left[d]) + f(g[d, d])
            r, c = right.sum() + own, left.sum() + own
            gain -= f(row + r) - f(row) + f(col + c) - f(col)
            new = int(np.argmax(np.round(gain, 6)))
            cls[u] = new
            one[u, old], one[u, new] = 0, 1
            g[new] += right
            g[:, new] += left
            g[new, new] += own
            moved += new != old
        if not moved:
            break
    return cls


def _contexts(table: pa.Table, top: np.ndarray, cls: np.ndarray, shards: int) -> pa.Table:
    """Of one block: its distinct words, their training counts, and the classes before (0..) and after (128..) each that isn't frequent."""
    words, doc, train = _columns(table)
    seq, place = _chain(words, doc, table.num_rows, top)
    c = cls[seq].astype(np.int64)
    before, after = np.append(cls[-1], c[:-1])[place], np.append(c, cls[-1])[place + 1]
    keys, inverse = np.unique(words, return_inverse=True)
    used = train[doc]
    count = np.bincount(inverse, weights=used, minlength=len(keys)).astype(np.int64)
    asked = np.flatnonzero(used & (seq[place] >= len(top)))
    code = inverse[asked].astype(np.int64) * 256
    code, times = np.unique(np.concatenate([code + before[asked], code + 128 + after[asked]]), return_counts=True)
    entries = np.bincount(code // 256, minlength=len(keys)) if len(keys) else np.zeros(0, np.int64)
    cut = np.append(0, np.cumsum(entries))
    rows = [(table["block"][0].as_py(), k, B.pack_keys(keys[x:y]), B.pack_ints(count[x:y]), B.pack_ints(entries[x:y]), B.pack_ints(code[cut[x] : cut[y]] % 256), B.pack_ints(times[cut[x] : cut[y]])) for k, x, y in B.shard_slices(keys, shards)]
    return pa.Table.from_pylist([dict(zip(_ASK_PA.names, r, strict=True)) for r in rows], schema=_ASK_PA)


def best_classes(word: np.ndarray, side: np.ndarray, times: np.ndarray, count: np.ndarray, step: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Class of each word (0 .. len(count)) by its contexts (word, side, times), sorted by word; rare words keep `start`.

    A class is worth the log likelihood of the word's transitions from and to it, less that of choosing the word among the class's tokens.
    """
    cls, worth = start.copy(), np.concatenate([step, np.zeros((128 - len(step), len(step))), step.T])  # of a side: by class
    for lo in range(0, len(count), KEYS_AT_A_TIME):
        hi = min(lo + KEYS_AT_A_TIME, len(count))
        total = -np.outer(count[lo:hi], np.log(np.maximum(size, 1)))
        a, b = np.searchsorted(word, [lo, hi])
        for x in range(a, b, CONTEXTS_AT_A_TIME):
            part = slice(x, min(b, x + CONTEXTS_AT_A_TIME))
            first = np.flatnonzero(np.append(True, word[part][1:] != word[part][:-1]))
            total[word[part][first] - lo] += np.add.reduceat(worth[side[part]] * times[part][:, None], first, axis=0)
        known = np.flatnonzero(count[lo:hi] >= RARE)
        cls[lo + known] = np.argmax(np.round(total[known], 6), axis=1)
    return cls


def _assign(table: pa.Table, top: np.ndarray, cls: np.ndarray, step: np.ndarray, size: np.ndarray) -> pa.Table:
    """Of one shard: count and class of each key of each block, and (block -1) tokens and kinds of each class."""
    parts, n = [B.unpack_keys(x) for x in table["keys"].to_pylist()], [B.unpack_ints(x) for x in table["count"].to_pylist()]
    cut = np.cumsum([0, *map(len, parts)])
    keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(n)).astype(np.int64)
    read = lambda c: np.concatenate([B.unpack_ints(x) for x in table[c].to_pylist()])
    word = np.repeat(inverse, read("entries"))
    order = np.argsort(word, kind="stable")
    start = cls[_units(keys, top)]
    got = best_classes(word[order], read("sides")[order], read("times")[order], count, step, size, start)
    frequent = np.isin(keys, top, assume_unique=True)
    got[frequent] = start[frequent]
    by_class = lambda w: np.bincount(got, weights=w, minlength=len(step)).astype(np.int64).tolist()
    none: list[list] = [[]] * len(parts)
    pick = lambda x: [B.pack_ints(x[inverse[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    out = {"block": [*table["block"].to_pylist(), -1], "shard": [*table["shard"].to_pylist(), table["shard"][0].as_py()], "count": [*pick(count), b""], "cls": [*pick(got), b""]}
    return pa.table(out | {"tokens": [*none, by_class(count)], "kinds": [*none, by_class(count > 0)]}, schema=_CLASS_PA)


def _told(words: np.ndarray, told: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each word of a block."""
    keys, inverse = np.unique(words, return_inverse=True)
    out = np.zeros((2, len(keys)), np.int64)
    answers = {k: (n, c) for k, n, c in zip(*(told[x].to_pylist() for x in ("shard", "count", "cls")), strict=True)}
    for k, a, b in B.shard_slices(keys, shards):
        out[:, a:b] = [B.unpack_ints(x) for x in answers[k]]
    return out[0][inverse], out[1][inverse]


def _sequence(cls: np.ndarray, doc: np.ndarray, n_docs: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes with that of the end after each document, and the place of each word there."""
    place = np.arange(len(cls)) + doc
    out = np.full(len(cls) + n_docs, end, np.int64)
    out[place] = cls
    return out, place


def _transitions(table: pa.Table, told: pa.Table, end: int, classes: int, shards: int) -> pa.Table:
    """Class bigrams of a block's training documents."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    if not table.num_rows:
        return schema.empty_table()
    words, doc, train = _columns(table)
    _, cls = _told(words, told, shards)
    seq, _ = _sequence(cls, doc, table.num_rows, end)
    used = np.repeat(train, np.bincount(doc, minlength=table.num_rows) + 1)
    total = np.bincount((np.append(end, seq[:-1]) * classes + seq)[used], minlength=classes * classes)
    at = np.flatnonzero(total)
    return pa.table({"pair": at, "n": total[at]}, schema=schema)


class Model:
    """What scoring needs beside the words' own counts and classes, all of bounded size."""

    def __init__(self, n: int, v: int, ends: int, end: int, pairs: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> None:
        self.n, self.v, self.ends, self.end = n, v, ends, end
        self.emit = tokens + DELTA * (kinds + 1)
        self.step = smoothed(pairs)

    def score(self, cls: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int):
        seq, place = _sequence(cls, doc, n_docs, self.end)
        c = np.full(len(seq), self.ends, np.int64)
        c[place] = count
        of = np.repeat(np.arange(n_docs), np.bincount(doc, minlength=n_docs) + 1)
        before = np.append(self.end, seq[:-1])  # before the first word stands an end, as after each document
        base = (c + 1) / (self.n + self.v + 1)
        p = MIX * np.exp(self.step[before, seq]) * (c + DELTA) / self.emit[seq] + (1 - MIX) * base
        total = lambda w: np.bincount(of, weights=w, minlength=n_docs)
        return total(np.ones(len(seq))).astype(np.int64), total(c > 0).astype(np.int64), total(np.log10(base)), total(np.log10(p))


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Logarithms of transition probabilities; pairs[a, b] counts b after a."""
    return np.log((pairs + ALPHA) / (pairs.sum(1, keepdims=True) + ALPHA * len(pairs)))


def _score(table: pa.Table, told: pa.Table, model: Model, shards: int) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    if not table.num_rows:
        return pa.schema(kinds.items()).empty_table()
    words, doc, _ = _columns(table)
    count, cls = _told(words, told, shards)
    cut, out = np.searchsorted(doc, np.arange(table.num_rows + 1)), []
    for a in range(0, table.num_rows, 256):
        b = min(a + 256, table.num_rows)
        part = slice(cut[a], cut[b])
        out.append(model.score(cls[part], count[part], doc[part] - a, b - a))
    return pa.table([table["doc_id"], table["train"], *(np.concatenate(x) for x in zip(*out, strict=True))], schema=pa.schema(kinds.items()))


def class_lm_scores(docs: DataFrame, train, top: int = TOP, classes: int = CLASSES) -> DataFrame:
    """Scores of every row of docs(doc_id, text); `train` is a condition on docs: the rows to learn from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    n, n_bytes = B.corpus_size(docs)
    ends = docs.where("train").count()
    shards = max(16, B.shard_count(n_bytes // 24))
    by_block = B.hash_block(docs, B.block_count(n_bytes, n)).groupBy("block")
    about = B.saved(by_block.applyInArrow(B.lean(_send, shards), _SEND).groupBy("shard").applyInArrow(B.lean(_tell, top), _TELL))
    add = lambda df, name, size: _added(df.select(F.posexplode(name).alias("p", "x")), size)
    tokens, kinds = add(about, "tokens", SHAPES), add(about, "kinds", SHAPES)
    best = about.select(F.explode(F.arrays_zip("top", "top_count")).alias("x")).select("x.*").orderBy(F.desc("top_count"), "top").limit(top).collect()
    key, count = np.array([r["top"] for r in best], np.int64).view(B.U64), np.array([r["top_count"] for r in best], np.int64)
    order = np.argsort(key)
    key, count = key[order], count[order]
    u = len(key) + SHAPES + 1
    pairs = np.zeros(u * u, np.int64)
    counted = docs.where("train").select("text").mapInArrow(lambda x: _bigrams(x, key), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most u * u rows
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(u, u)
    # classes of units, then of all words
    cls = exchange(pairs, classes)
    by_class = np.zeros((classes, classes))
    np.add.at(by_class, (cls[:, None], cls[None, :]), pairs)
    end, size = int(cls[-1]), np.bincount(cls, weights=pairs.sum(0), minlength=classes)
    first_step = smoothed(by_class)
    asked = by_block.applyInArrow(B.lean(_contexts, key, cls, shards), _ASK)
    told = B.stored(asked.groupBy("shard").applyInArrow(B.lean(_assign, key, cls, first_step, size), _CLASS), "word-classes")
    answers = told.where("block >= 0").select("block", "shard", "count", "cls").groupBy("block")
    class_tokens, class_kinds = (add(told.where("block = -1"), k, classes) for k in ("tokens", "kinds"))
    class_tokens[end] += ends
    class_kinds[end] += ends > 0
    moves = by_block.cogroup(answers).applyInArrow(B.lean_pair(_transitions, end, classes, shards), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    again = np.zeros(classes * classes, np.int64)
    for r in moves.collect():  # at most classes * classes rows
        again[r["pair"]] = r["n"]
    model = Model(int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0), ends, end, again.reshape(classes, classes), class_tokens, class_kinds)
    scored = by_block.cogroup(answers).applyInArrow(B.lean_pair(_score, model, shards), _SCORE)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _added(numbers: DataFrame, size: int) -> np.ndarray:
    """Sums of numbers(p, x) by place; `size` rows at most."""
    out = np.zeros(size, np.int64)
    for r in numbers.groupBy("p").agg(F.sum("x").alias("n")).collect():
        out[r["p"]] = r["n"]
    return out


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return class_lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
