"""Set-similarity and substring joins against brute force."""

import collections
import itertools
import random

import pytest

from corpusgraph.operators import citations, fulltext, payloads, retrieval, search


def _brute(rows, least):
    sets = collections.defaultdict(set)
    for i, x in rows:
        if i is not None and x is not None:
            sets[i].add(x)
    return sorted((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least)


@pytest.mark.parametrize(("least", "chunk"), [(1, 3), (2, 3), (2, 2000), (3, 4), (5, 2)])
def test_sharing_pairs(spark, least, chunk):
    rng = random.Random(least)
    rows = [(i, rng.choice([0, 0, 1, 2, rng.randrange(40)])) for i in range(150) for _ in range(rng.randrange(9))] + [(None, 1), (3, None)]
    got = citations.sharing_pairs(spark.createDataFrame(rows, "id int, item int"), least, chunk)
    assert sorted(map(tuple, got.collect())) == _brute(rows, least)


def test_a_reference_of_a_third_of_all_works(spark):
    """It makes no candidates by itself: works that share only it are never paired."""
    rng = random.Random(7)
    rows = [(i, 10_000 + i * 4 + k) for i in range(3000) for k in range(3)] + [(i, 1) for i in range(0, 3000, 3)]
    rows += [(i, 2 + rng.randrange(300)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, item int")
    pairs = citations.sharing_pairs(df, 2)
    assert sorted(map(tuple, pairs.collect())) == _brute(rows, 2)
    joined = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in joined and "CartesianProduct" not in joined


def test_pairs_that_meet_by_rare_and_frequent_items(spark):
    """Rare items, twos of frequent ones, sets of many items and keys of many sets together give the exact counts."""
    rng = random.Random(7)
    sets = {k: {f"rare{rng.randrange(60)}" for _ in range(rng.randrange(4))} | {f"often{int(rng.random() ** 2 * 12)}" for _ in range(rng.randrange(5))} for k in range(120)}
    sets |= {k: {f"often{i}" for i in range(12)} | {f"rare{i}" for i in range(k % 7, 60, 7)} for k in range(200, 206)}
    rows = [(k, i) for k, x in sets.items() for i in x]
    for least in (1, 2, 3):
        got = citations.sharing_pairs(spark.createDataFrame(rows, "id int, item string"), least, chunk=9, light=8)
        want = [(a, b, n, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= least]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_substrings(spark):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcd é\n𝄞") for _ in range(n))
    texts = [(i, make(rng.randrange(0, 60))) for i in range(200)] + [(999, None), (998, "")]
    words = [(i, make(rng.randrange(0, 6))) for i in range(80)] + [(81, None), (82, "zzz"), (83, "abz")]
    got = search.substring_matches(spark.createDataFrame(words, "query_id int, word string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, t) for q, w in words if w for t, x in texts if x and w in x)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "query_id int, word string")
    assert search.substring_matches(none, spark.createDataFrame(texts, "text_id int, text string")).count() == 0


def test_substring_search_writes_the_asked_words_alone(spark, monkeypatch):
    """Neither texts nor their pieces are written or shuffled; long words, and more words than go at once, are found all the same."""
    written = []
    monkeypatch.setattr(search, "staged", lambda df, name: written.append(name) or df)
    monkeypatch.setattr(search, "SENT_WORDS", 3)
    long = "x" * 40 + "é𝄞" * 30
    texts = [(1, long + "y tail"), (2, "a  b\u00a0c"), (3, " edge"), (4, long[:-1])]
    words = [(k, w) for k, w in enumerate([long, long[3:], " ", "  b", "b\u00a0", " edge", "e", "e ", "?", "y t", "il"])]
    got = search.substring_matches(spark.createDataFrame(words, "query_id int, word string"), spark.createDataFrame(texts, "text_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, t) for q, w in words for t, x in texts if w in x)
    assert written == ["asked"]


def test_quotes_of_any_length(spark):
    rng = random.Random(2)
    words = ["a", "bb", "agent", "agents", "of", "trust"]
    sources = [(i, "  ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(99, None)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(60)] + [(98, "gent"), (97, ""), (96, None)]
    got = fulltext.verbatim(spark.createDataFrame(quotes, "quote_id int, text string"), spark.createDataFrame(sources, "source_id int, text string"))
    squeeze = lambda t: " ".join((t or "").split())
    assert sorted(map(tuple, got.collect())) == sorted((q, s) for q, w in quotes if squeeze(w) for s, t in sources if squeeze(w) in squeeze(t))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def _index(spark):
    topics = [("1", "Budget and spend caps"), ("1.2", "Permission scopes for autonomous agents"), ("2", "Audit of agents and approval"), ("2.10", "Rate limits and spend budgets budgets"), ("3", "")]
    return spark.createDataFrame(topics, "code string, text string")


def test_the_coded_scorer_is_the_scorer(spark):
    """From integers alone, with idf unrounded: the scores that the index over words gives."""
    texts = [(1, "agents exceeded spend caps and budgets"), (2, "permission scopes"), (3, ""), (4, None), (5, "nothing that is known"), (6, "audit audit approval of agents")]
    asked = spark.createDataFrame(texts, "id int, text string")
    coded = payloads.CodedIndex(_index(spark), places=12)
    want = {(r["id"], r["code"]): r["score"] for r in retrieval.TopicIndex(_index(spark)).score(asked).collect()}
    got = {(r["id"], r["code"]): r["score"] for r in coded.score(asked).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.02 for k in want)
    order = lambda s: [k for k, _ in sorted(s.items(), key=lambda x: (x[0][0], -x[1], x[0][1]))]
    assert order(got) == order(want)
    ids = {r["code"]: list(r["ids"]) for r in coded.topics.collect()}
    assert ids["3"] == [] and ids["1"][0] == 0 and sorted({i for x in ids.values() for i in x}) == list(range(coded.terms.count()))


def test_tools_for_a_need(spark):
    need = spark.createDataFrame([(1, "stop an agent exceeding its spend budget caps"), (2, "xyzzy")], "id int, text string")
    held = spark.createDataFrame([(k, 100 - k, "framework" if k % 2 else "preprint", k == 4, ["2.10"]) for k in range(12)], "id int, pos int, resource_type string, has_tool boolean, taxonomy_topics array<string>")
    mirror = spark.createDataFrame([(1, 2, "SpendGuard", None), (2, 1, "x", "Budgeting tools"), (3, 3, "an", "a of"), (4, 4, None, None)], "entry int, pos int, name string, description string")
    rows = retrieval.tools_for(retrieval.TopicIndex(_index(spark)), need, held, mirror, limit=3).collect()
    got = {k: [r["id"] for r in sorted(rows, key=lambda r: r["place"]) if r["kind"] == k and r["need"] == 1] for k in ("tool", "paper", "unassessed")}
    assert got == {"tool": ["11", "9", "7"], "paper": ["10", "8", "6"], "unassessed": ["2", "1"]}
    assert any(r["kind"] == "topic" and r["id"] == "2.10" for r in rows) and not [r for r in rows if r["need"] == 2]


def test_the_first_entries_of_each_word_are_enough(spark):
    need = spark.createDataFrame([(1, "spend budget"), (2, "budget")], "id int, text string")
    mirror = spark.createDataFrame([(k, 50 - k, "budget" if k % 3 else "spending", None) for k in range(40)], "entry int, pos int, name string, description string")
    got = sorted(map(tuple, retrieval.mirror_matches(need, mirror, 2).collect()))
    assert got == sorted([(1, 38), (1, 37), (1, 39), (1, 36), (2, 38), (2, 37)])


def test_matched_terms_are_gathered_in_place(spark):
    """Texts are dealt by id, and nothing is dealt by id and code after them."""
    asked = spark.createDataFrame([(1, "spend caps and budgets"), (2, "audit of agents")], "id int, text string")
    got = retrieval.TopicIndex(_index(spark)).matched(asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and {(r["id"], r["code"]) for r in got.collect()} >= {(1, "1"), (2, "2")}
