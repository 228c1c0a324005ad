"""Toxicity: a Levenshtein automaton over a lexicon trie, and context windows around its hits.

The lexicon is learnt: words, and stems (prefixes of words), whose documents are toxic far
more often than others', picked greedily until each toxic document of the sample has
`COVER` of them where possible; of terms in the same documents the longest.  Words are 3 to 40 letters long, and
candidates stand in `MIN_DOCS` toxic documents of the sample or more, which bounds their number.  The words a
picked stem stands for stay in the lexicon, so that they may be misspelled.
Its trie, intersected with the Levenshtein
automaton of distance 1 (for terms of five letters and more; stems must match exactly),
is made into one deterministic automaton, state by state as words need it.

A hit is quoted if its window of `WINDOW` words has quotation marks before and after it.
Quoted and plain, exact and misspelled hits are separate features of a logistic
regression, so the labels say how much a quotation weighs.

Labels come from a sample of labelled rows, bounded by `sample` (about; by a hash of the doc_id).

Defined cases: null and empty texts have no hits, and their score is the model's for none; null
labels and null doc_ids teach nothing; several labels of one doc_id count as the greatest; with no
labels every score is 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

SAMPLE, MIN_DOCS, LOG_ODDS, COVER, STEMS = 20_000, 5, 3.0, 4, (4, 5, 6, 7, 8, 9)
WINDOW, FUZZY_LENGTH, CUT = 8, 5, 0.3
OUTER = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&-_=+/\\~^`@“”„«»‘’…"
_QUOTES = set("\"“”„«»")
FEATURES = 7


class Automaton:
    """Words within distance 1 of a lexicon term; states are sets of (trie node, errors)."""

    def __init__(self, words: list[str], stems: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # 1: a word, 2: a long word (may be misspelled), 4: a stem
        for kind, terms in ((1, words), (4, stems)):
            for term in terms:
                at = 0
                for c in term:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.ends.append(0)
                    at = self.child[at][c]
                self.ends[at] |= kind | (2 if kind == 1 and len(term) >= FUZZY_LENGTH else 0)
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.step: list[dict[str, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, found: set[tuple[int, int]]) -> frozenset:
        """With the states that leave a letter of the term out."""
        more = {(to, 1) for node, e in found if e == 0 for to in self.child[node].values()}
        return frozenset(x for x in found | more if not (x[1] == 1 and (x[0], 0) in found))

    def _state(self, found: frozenset) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            self.step.append({})
        return self.number[found]

    def _next(self, state: int, c: str) -> int:
        to: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.child[node]:
                to.add((self.child[node][c], e))
            if e == 0:
                to.add((node, 1))  # a letter too many
                to.update((x, 1) for k, x in self.child[node].items() if k != c)
        self.step[state][c] = got = self._state(self._closed(to))
        return got

    def match(self, word: str) -> int:
        """2 for a term or a stem's word, 1 for a misspelled term, else 0."""
        state, steps = self.start, self.step
        stem = False
        for c in word:
            got = steps[state].get(c)
            state = self._next(state, c) if got is None else got
            if state == self.dead:
                break
            stem = stem or any(e == 0 and self.ends[n] & 4 for n, e in self.sets[state])
            if stem:
                return 2
        found = self.sets[state]
        if any(e == 0 and self.ends[n] & 1 for n, e in found):
            return 2
        return int(any(self.ends[n] & 2 for n, _ in found))


def _features(data: np.ndarray, off: np.ndarray, automaton: Automaton) -> np.ndarray:
    n = len(off) - 1
    out = np.zeros((n, FEATURES))
    s, e, doc = B.words(data, off)
    if not len(s):
        return out
    _, first, inverse = np.unique(B.word_hashes(data, s, e), return_index=True, return_inverse=True)
    raw = data.tobytes()
    spans = zip(s[first].tolist(), e[first].tolist(), strict=True)
    kind = np.fromiter((automaton.match(raw[a:b].decode("utf-8").lower().strip(OUTER)) for a, b in spans), np.int8, len(first))[inverse]
    hits = np.flatnonzero(kind)
    if len(hits):
        cut = np.searchsorted(doc, np.arange(n + 1))
        for i in hits.tolist():
            k = doc[i]
            lo, hi = max(cut[k], i - WINDOW), min(cut[k + 1], i + WINDOW + 1)
            before, after = raw[s[lo] : e[i]].decode("utf-8"), raw[s[i] : e[hi - 1]].decode("utf-8")
            word = raw[s[i] : e[i]].decode("utf-8")
            core = word.strip(OUTER)
            at = word.find(core)
            quoted = bool(_QUOTES & set(before[: len(before) - len(word) + at])) and bool(_QUOTES & set(after[at + len(core) :]))
            out[k, (0 if kind[i] == 2 else 2) + quoted] += 1
    words = np.bincount(doc, minlength=n)
    all_hits = out[:, :4].sum(1)
    out[:, 4] = all_hits > 0
    out[:, 5] = np.minimum(1, 20 * all_hits / np.maximum(1, words))
    out[:, 6] = out[:, 0] + out[:, 2] > 0
    out[:, :4] = np.log1p(out[:, :4])
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_lexicon(sampled: DataFrame) -> tuple[list[str], list[str]]:
    """(words, stems) from sampled(doc_id, text, toxic); what reaches the driver is bounded by the sample."""
    sides = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_n, clean_n = sides.get(1, 0), sides.get(0, 0)
    words = sampled.select("doc_id", "toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,40})"), 1))).alias("w"))
    terms = words.select("doc_id", "toxic", F.explode(F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS])).alias("term")).where("term is not null")
    odds = F.log((F.col("t") + 0.5) / (toxic_n + 1.0)) - F.log((F.col("c") + 0.5) / (clean_n + 1.0))
    count = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where((F.col("t") >= MIN_DOCS) & (odds >= LOG_ODDS) & (F.col("c") * 8 <= F.col("t")))
    best = B.saved(count.select("term"))
    docs_of = {r["term"]: set(r["d"]) for r in terms.where("toxic = 1").join(best, "term").groupBy("term").agg(F.collect_set("doc_id").alias("d")).collect()}
    need = dict.fromkeys(set().union(*docs_of.values()) if docs_of else set(), COVER)
    words_out, stems, left = [], [], dict(docs_of)
    while left:
        gain = {t: sum(1 for d in ds if need[d] > 0) for t, ds in left.items()}
        left = {t: left[t] for t, g in gain.items() if g >= MIN_DOCS}
        if not left:
            break
        term = max(left, key=lambda t: (gain[t], len(t), t))
        same = left.pop(term)
        for d in same:
            need[d] -= 1
        (stems if term.endswith("*") else words_out).append(term.rstrip("*"))
        left = {t: ds for t, ds in left.items() if not (term.endswith("*") and t.startswith(term[:-1])) and not (t.endswith("*") and term.startswith(t[:-1]) and ds == same)}
    words_out += [t for t in docs_of if not t.endswith("*") and t.startswith(tuple(stems))]
    return sorted(set(words_out)), sorted(stems)


def _rows(batches, words: list[str], stems: list[str], weights: list[float] | None):
    automaton = Automaton(words, stems)
    for batch in batches:
        data, off = B.text_arrays(batch.column("text"))
        parts = [_features(data[off[a] : off[b]], off[a : b + 1] - off[a], automaton) for a, b in B.runs(off, 1 << 20)]
        x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
        if weights is None:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])
        else:
            w = np.array(weights)
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])
    B.tidy()


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text); labels(doc_id, toxic) are those to learn from."""
    B.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    taught = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sampled = B.stored(docs.join(F.broadcast(taught), "doc_id"), "toxicity-sample")  # about `sample` rows at most
    words, stems = learn_lexicon(sampled)
    got = sampled.select("toxic", "text").mapInArrow(lambda x: _rows(x, words, stems, None), "toxic int, x array<double>").toPandas()
    if len(got) and got["toxic"].nunique() > 1:
        weights = _fit(np.array(got["x"].tolist()), got["toxic"].to_numpy(float)).tolist()
    else:
        weights = [0.0] * FEATURES + [-math.inf if not len(got) or not got["toxic"].max() else 30.0]
    return docs.mapInArrow(lambda x: _rows(x, words, stems, weights), "doc_id long, score double")


def teaching(doc_id="doc_id"):
    """Rows whose crc32 of the id leaves a remainder other than 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(True))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(teaching())
    out = toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return out.select("doc_id", (~teaching()).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
