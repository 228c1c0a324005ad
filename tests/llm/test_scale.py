"""What grows with the corpus stays out of the plan and out of joins."""

import collections
import random

from pyspark.sql import functions as F

from corpusgraph.llm import decontamination, fingerprints


def test_next_documents_of_many_blocks(spark):
    """Blocks and their order are rows, not literals; null ids are dealt to blocks, and all documents form one ring."""
    rows = [(k, f"text {k % 40} of {k}") for k in range(400)] + [(None, f"none {k % 30}") for k in range(100)] + [(7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for blocks in (1, 50, 20_000):
        got = fingerprints.with_next(df, blocks)
        assert len(got._jdf.queryExecution().toString()) < 400_000
        rs = got.where("not extra").collect()
        follows = collections.Counter(r["next_text"] for r in rs)
        assert follows == collections.Counter(t for _, t in rows)
        by_id = {r["doc_id"]: r["next_text"] for r in rs}
        assert by_id[100] == "text 19 of 99" and by_id[8] in ("again", "text 7 of 7")
        if blocks > 1:
            assert len({r["block"] for r in rs if r["doc_id"] is None}) > 1 or blocks < 5


def test_near_pairs_within_a_document(spark):
    rng = random.Random(4)
    items = [rng.getrandbits(63) for _ in range(60)]
    left = [(rng.randrange(4), 9, x ^ sum(1 << b for b in rng.sample(range(63), rng.choice([0, 5, 20, 24])))) for x in items for _ in range(3)]
    right = [(d, 9, x) for d in range(4) for x in rng.sample(items, 25)]
    got = decontamination.near_pairs(spark.createDataFrame(left, "doc int, size int, fp long"), spark.createDataFrame(right, "doc int, size int, item_fp long"), also=("doc",)).collect()
    want = {(d, a, b) for d, _, a in left for e, _, b in right if d == e and (a ^ b).bit_count() <= decontamination.RADIUS}
    assert {(r["doc"], r["fp"], r["item_fp"]) for r in got} == want and len(got) == len(want)


def test_few_windows_meet_items(spark, monkeypatch):
    """2,000 items of one size: a document's windows meet the items it may hold, not all of that size."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(24))) for k in range(2000)]
    docs = []
    for k in range(40):
        t = [rng.choice(words) for _ in range(300)]
        if k % 4 == 0:
            t[100:100] = items[k][1].split()
        docs.append((k, " ".join(t)))
    counts, plain = {}, decontamination.near_pairs

    def counted(left, right, radius, small, also):
        counts["left"], counts["right"] = left.count(), right.groupBy(*also).count().agg(F.max("count")).head()[0]
        return plain(left, right, radius, small, also)

    monkeypatch.setattr(decontamination, "near_pairs", counted)
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(k, k) for k in range(0, 40, 4)}
    assert counts["left"] * counts["right"] < 0.05 * 40 * 300 * len(items)
