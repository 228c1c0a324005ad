"""Language ID by mixtures: EM over word likelihoods gives a document's language proportions.

Every language has letter-trigram counts (bytes folded to 64 signs, A-Z lower-cased) from
the labelled rows; a word's likelihood is the product over its trigrams.  A document
begins with the one language of the best likelihood; EM finds the proportions in each set that adds or drops one, and the
document moves to the one with the best penalised likelihood (BIC) for as long as that grows.  The set it ends with is its
languages, the largest its label.  Each document stops by itself, so a result doesn't depend on what lies beside it.

Labels come from a sample of labelled rows bounded by `sample` (about; by a hash of the
doc_id, so it is the same each time).

Defined cases: null texts and texts with no letter are `und` with score 0; with no labelled row
every text is `und`; rows that share a doc_id are rated each for itself; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE, ALPHA, STEPS = 20_000, 0.02, 6
UNKNOWN = "und"
SIGNS = 64
_SIGN = np.zeros(256, np.int32)
_SIGN[97:123] = _SIGN[65:91] = np.arange(1, 27)
_SIGN[128:] = 27 + np.arange(128) % 37


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, word, document of each word); words are runs of letters, with a blank on each side."""
    sign = np.zeros(len(data) + len(off) - 1, np.int32)
    place = np.arange(len(data)) + np.repeat(np.arange(len(off) - 1), np.diff(off))
    sign[place] = _SIGN[data]  # a blank follows each text
    first = np.flatnonzero((sign > 0) & (np.append(0, sign[:-1]) == 0))
    gram = np.append([0], sign[:-1]) * SIGNS * SIGNS + sign * SIGNS + np.append(sign[1:], 0)
    inside = np.flatnonzero(sign > 0)
    word = np.searchsorted(first, inside, side="right") - 1
    doc = np.searchsorted(off[1:] + np.arange(1, len(off)), first, side="right")
    return gram[inside], word, doc


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist())
        for a, b in B.runs(off):
            gram, word, doc = _trigrams(data[off[a] : off[b]], off[a : b + 1] - off[a])
            lang = langs[a:b][doc][word] if len(word) else np.array([], str)
            for x in np.unique(lang):
                total.setdefault(str(x), np.zeros(SIGNS**3, np.int64))
                total[str(x)] += np.bincount(gram[lang == x], minlength=SIGNS**3)
    for x, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([B.pack_ints(n)])], names=["lang", "n"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(B.unpack_ints(x) for x in table["n"].to_pylist())
    return pa.table({"lang": [table["lang"][0].as_py()], "n": [B.pack_ints(total)]})


def mixture(loglik: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(language index, its share) of each document, from words' log-likelihoods [word, language]; -1 with no word."""
    share = np.zeros(n_docs)
    if not len(loglik):
        return np.full(n_docs, -1), share
    ids, first, lens = np.unique(doc, return_index=True, return_counts=True)
    top = loglik.max(1, keepdims=True)
    like, k = np.exp(np.maximum(loglik - top, -60)), loglik.shape[1]

    def em(part: np.ndarray, starts: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS):
            post = part * np.repeat(pi, n, axis=0)
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            pi = np.add.reduceat(post, starts, axis=0) / n[:, None]
        return pi, np.add.reduceat(np.log(np.maximum((part * np.repeat(pi, n, axis=0)).sum(1), 1e-300)), starts)

    alone = np.add.reduceat(np.log(np.maximum(like, 1e-300)), first, axis=0) - 0.5 * np.log(lens)[:, None]
    chosen, worth = alone.argmax(1), alone.max(1)
    sets, part = np.zeros((len(ids), k), bool), np.ones(len(ids))
    sets[np.arange(len(ids)), chosen] = True
    active = np.arange(len(ids))
    while len(active) and k > 1:
        best, move = worth[active].copy(), np.full(len(active), -1)
        label, label_share = np.zeros(len(active), np.int64), np.zeros(len(active))
        for j in range(k):  # each document adds or drops language j; none is left without one
            may = np.flatnonzero(~(sets[active, j] & (sets[active].sum(1) == 1)))
            if not len(may):
                continue
            docs = active[may]
            n = lens[docs]
            starts = np.append(0, np.cumsum(n)[:-1])
            words = np.repeat(first[docs] - starts, n) + np.arange(n.sum())
            tried = sets[docs].copy()
            tried[:, j] = ~tried[:, j]
            pi, ll = em(like[words], starts, n, tried.astype(np.float64))
            value = ll - 0.5 * tried.sum(1) * np.log(n)
            better = value > best[may]
            best[may[better]], move[may[better]] = value[better], j
            label[may[better]], label_share[may[better]] = pi[better].argmax(1), pi[better].max(1)
        moved = np.flatnonzero(move >= 0)
        docs = active[moved]
        sets[docs, move[moved]] = ~sets[docs, move[moved]]
        worth[docs], chosen[docs], part[docs] = best[moved], label[moved], label_share[moved]
        active = docs
    out, share[ids] = np.full(n_docs, -1), part
    out[ids] = chosen
    return out, share


def _predict(batches, langs: list[str], table: np.ndarray, out: list[str]):
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        best, share = [], []
        for a, b in B.runs(off):
            gram, word, doc = _trigrams(data[off[a] : off[b]], off[a : b + 1] - off[a])
            ll = np.zeros((len(doc), len(langs)))
            if len(doc):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                for k in range(len(langs)):
                    ll[:, k] = np.add.reduceat(table[k][gram], first)
            x, y = mixture(ll, doc, b - a)
            best.append(x)
            share.append(y)
        best = np.concatenate(best) if best else np.zeros(0, int)
        letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        known = letters & bool(langs)
        pred = [langs[max(0, k)] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
        score = np.where(known, np.concatenate(share) if share else np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in out), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*out, "lang_pred", "score"])
    B.tidy()


def identify(docs: DataFrame, learn, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, learnt_from, lang_pred, score) of docs(doc_id, text, lang), and the columns in `carry`; `learn` says which rows may teach."""
    more = [k for k in carry if k not in ("doc_id", "text", "lang")]
    B.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", *more, F.coalesce(learn, F.lit(False)).alias("learnt_from"))
    able = docs.where("learnt_from and lang is not null and text is not null")
    share = min(1.0, sample / max(1, able.count()))
    sampled = able.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = sampled.select("text", "lang").mapInArrow(_count, "lang string, n binary").groupBy("lang").applyInArrow(_sum, "lang string, n binary")
    rows = sorted((r["lang"], B.unpack_ints(bytes(r["n"]))) for r in counts.collect())  # one a language
    langs = [x for x, _ in rows]
    table = np.array([np.log((n + ALPHA) / (n.sum() + ALPHA * len(n))) for _, n in rows], np.float32)
    out = ["doc_id", "learnt_from", *(k for k in carry if k != "doc_id")]
    rated = docs.select(*dict.fromkeys([*out, "text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kinds = dict(docs.dtypes)
    return rated.mapInArrow(lambda x: _predict(x, langs, table, out), ", ".join([*(f"`{k}` {kinds[k]}" for k in out), "lang_pred string", "score double"]))


def teaching(doc_id="doc_id"):
    """Rows whose crc32 of the id leaves a remainder other than 0 on division by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), teaching())
    return out.select("doc_id", (~F.col("learnt_from")).alias("held_out"), "lang_pred", "score")
