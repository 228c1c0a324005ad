"""Token counts by rank-synchronous merging of whole arrays of pre-tokens.

The vocabulary's pieces hold the space mark only at their front (or are runs of it), so
a text falls into pre-tokens "run of marks, then other characters" that no merge
crosses.  Distinct pre-tokens of a batch lie in ragged numpy arrays of symbol ids; in
each round every sequence applies its lowest-rank pair (the first such), all at once,
until none has a mergeable pair.  Surviving symbols are counted; a symbol that is no
piece counts as its UTF-8 bytes.

Defined cases: null and empty texts have no bytes and no tokens; rows stay rows, whatever
their doc_id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

TOKENIZER, LIMIT = "piece_bpe_32k.model", 4096
MARK = "▁"
#: Distinct pre-tokens whose counts a worker remembers.
CACHE_WORDS = 1_000_000


class PieceCounter:
    """Counts for words between ASCII spaces, with the marks before them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.cost: list[int] = []
        for i in range(sp.vocab_size()):
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
                self._symbol(sp.id_to_piece(i), 1)
        for piece in self.rank:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece holds the space mark inside: {piece!r}")
        self._pair_table()
        self.known: dict[bytes, int] = {}

    def _symbol(self, s: str, cost: int) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.ids)
            self.cost.append(cost)
        return self.ids[s]

    def _pair_table(self) -> None:
        """Every split of a piece into two symbols that can occur, with the merge's rank and result."""
        keys, rank, to = [], [], []
        for piece, r in self.rank.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if (a in self.rank or len(a) == 1) and (b in self.rank or len(b) == 1):
                    x, y = (self._symbol(s, len(s.encode())) for s in (a, b))
                    keys.append(x << 32 | y)
                    rank.append(r)
                    to.append(self.ids[piece])
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.to = np.array(keys, np.int64)[order], np.array(rank)[order], np.array(to, np.int64)[order]

    def _merge(self, sym: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
        """Tokens of each of `n` sequences whose symbols lie one after another."""
        out = np.zeros(n, np.int64)
        cost = np.array(self.cost, np.int64)
        while len(sym):
            pair = np.append(sym[:-1] << 32 | sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            can = self.keys[at] == pair
            can[:-1] &= seq[:-1] == seq[1:]
            rank = np.where(can, self.ranks[at], np.inf)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, first)
            lens = np.diff(np.append(first, len(sym)))
            busy = np.repeat(np.isfinite(best), lens)
            out += np.bincount(seq[~busy], weights=cost[sym[~busy]], minlength=n).astype(np.int64)
            hit = busy & (rank == np.repeat(best, lens))
            # the first lowest pair of each sequence
            where = np.flatnonzero(hit)
            where = where[np.append(True, seq[where[1:]] != seq[where[:-1]])] if len(where) else where
            sym = sym.copy()
            sym[where] = self.to[at[where]]
            keep = busy
            keep[where + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole pre-tokens (marks first)."""
        order = [self._symbol(c, len(c.encode())) for t in texts for c in t]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        return self._merge(np.array(order, np.int64), np.repeat(np.arange(len(texts)), lens), len(texts))

    def of(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text: space becomes the mark, and one mark stands before each text that isn't empty."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        raw = data.tobytes()
        text = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        mark = MARK.encode()
        counts, words, doc = np.zeros(n, np.int64), [], []
        odd = mark in raw or b"  " in raw
        for k, t in enumerate(text):
            if not t:
                continue
            if t[:1] == b" " or odd and (mark in t or b"  " in t):
                t = (b" " + t).replace(mark, b" ")
                parts, lead = [], b""
                for i, w in enumerate(t.split(b" ")):
                    if i:
                        lead += b" "
                    if w:
                        parts.append(lead + w)
                        lead = b""
                if lead:
                    parts.append(lead)
            else:
                parts = [b" " + w for w in t.split(b" ")]  # a space at the end is a mark of its own
            words += parts
            doc += [k] * len(parts)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = [w for w in set(words) if w not in known]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            known.update(zip(part, self.count([w.decode("utf-8").replace(" ", MARK) for w in part]).tolist(), strict=True))
        return counts + np.bincount(np.array(doc, np.int64), weights=np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=n).astype(np.int64)


@functools.cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _count(batches, path: str):
    counter = _counter(path)
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        got = [counter.of(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in B.runs(off, 1 << 20)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], names=["doc_id", "n_bytes", "n_tokens"])
    B.tidy()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of docs(doc_id, text)."""
    B.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda x: _count(x, path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
