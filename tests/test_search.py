"""Words with white space are found where they stand, and pairs that are found are not shuffled."""

import random

import numpy as np
import pyarrow as pa

from corpusgraph.operators import fulltext, search


def test_gapped_words_as_by_brute_force(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 256)  # texts that go over several blocks
    random.seed(4)
    for signs in ["ab ", "ab \n", "aé \t ", "a€\x1c"] * 25:
        made = lambda sizes: "".join(random.choice(signs) for _ in range(random.choice(sizes)))
        words = list({made([1, 2, 3, 5, 35, 140]) for _ in range(20)} | {"ab" * 20 + "a b", "x " + "y" * 50, "x " + "y" * 50 + " " + "z" * 50})
        texts = [made([1, 30, 900]) + random.choice(words) + made([1, 30]) for _ in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["text_id", "text"]).slice(1)
        found = [x for r in search._found(iter([batch]), words, np.arange(len(words)) + 7) for x in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
        assert sorted(found) == sorted((k, i + 7) for k, t in enumerate(texts) for i, w in enumerate(words) if k and w in t)


def test_pairs_of_short_quotes_are_not_shuffled(spark):
    sources = spark.createDataFrame([(1, "alpha beta  gamma"), (2, "xbeta gamma")], "source_id int, text string")
    quotes = spark.createDataFrame([(1, "beta gam"), (2, "a beta")], "quote_id int, text string")
    got = fulltext.verbatim(quotes, sources)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "source_id" in plan and "hashpartitioning(quote_id" not in plan and "hashpartitioning(query_id" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1)]
    twice = fulltext.verbatim(quotes, sources.union(sources))
    assert sorted(map(tuple, twice.collect())) == [(1, 1), (1, 2), (2, 1)]
