"""Records to rows and back, forms, the reference store's lines, YAML."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import fixed
from corpusgraph.operators import curation, graph, people, review
from corpusgraph.sources import readers, writers

TOOL = ", ".join([*(f"{k}:string" for k in fixed.ROW_TOOLS.values()), *(f"{k}:array<string>" for k in fixed.ROW_TOOL_LISTS.values())])
SCHEMA = ", ".join([*(f"{k} string" for k in fixed.ROW_FIELDS.values()), *(f"{k} array<string>" for k in fixed.ROW_LISTS.values()), *(f"{k} boolean" for k in fixed.ROW_CHECKBOXES.values()), "facets map<string,array<string>>", f"tool struct<{TOOL}>", "sources array<struct<url:string,accessed:string,title:string,supports:array<string>>>"])


def test_push_and_sync_change_no_record(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ann", "b c", "x-1", "Ö", "10.1"])
    some = lambda f, p=0.6: f() if rng.random() < p else None
    records = []
    for k in range(120):
        row = [f"resource:r:{k}" if c == "id" else some(word) for c in fixed.ROW_FIELDS.values()]
        row += [some(lambda: [word() for _ in range(rng.randrange(1, 4))]) for _ in fixed.ROW_LISTS]
        row += [some(lambda: rng.random() < 0.5) for _ in fixed.ROW_CHECKBOXES]
        row.append(some(lambda: {name: rng.sample(values, 2 if many else 1) for _, name, many, values in rng.sample(fixed.FACETS, 3)}))
        tool = [some(word) for _ in fixed.ROW_TOOLS] + [some(lambda: [word() for _ in range(rng.randrange(1, 3))]) for _ in fixed.ROW_TOOL_LISTS]
        row.append(tuple(tool) if any(x is not None for x in tool) and rng.random() < 0.5 else None)
        row.append(some(lambda: sorted((f"https://{n}", some(word), some(word), some(lambda: [word(), word()])) for n in rng.sample(range(9), 3))))
        records.append(tuple(row))
    # one address has one row, so it says the same everywhere
    told = {}
    records = [(*r[:-1], [told.setdefault(s[0], s) for s in r[-1]] if r[-1] else None) for r in records]
    before = spark.createDataFrame(records, SCHEMA)
    fresh = curation.fresh_sources(before, spark.createDataFrame([], "url string, id string")).withColumn("id", F.concat(F.lit("row "), "url"))
    assert fresh.count() == len(told)
    rows = curation.rows_from_records(before, fresh.select("url", "id"))
    assert rows.where("not Published").count() == 0 and rows.where("`ID *` like 'resource:%'").count() == 0
    after = curation.records_from_rows(rows, fresh)
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(key, after.select(*before.columns).collect())) == sorted(map(key, before.collect()))


def test_known_sources_are_linked_in_order(spark):
    r = spark.createDataFrame([("resource:x", [("https://b",), ("https://zz",), ("https://a",)])], "id string, sources array<struct<url:string>>")
    got = curation.rows_from_records(r, spark.createDataFrame([("https://a", "s1"), ("https://b", "s2")], "url string, id string")).head()
    assert got["ID *"] == "x" and list(got["Sources"]) == ["s2", "s1"] and got["Published"]


def test_forms(spark):
    body = "## Title\n\nA title\n\n### Nothing known\nlost\n**Topics, if you already know them:** 2.2, 3.1\nnot this\n**What it does**\nIt\n  does.\n\n### Maintainer\n_No response_\n### Notes\none\n**Anything a reviewer should know:** two\n"
    got = {r["key"]: r["value"] for r in readers.parse_forms(spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string")).collect()}
    assert got == {"title": "A title", "topics": "2.2, 3.1", "summary": "It\n  does.", "why": "one\ntwo"}


def test_the_last_line_of_a_store_counts(spark, tmp_path):
    """In order of files and lines, also where a file is cut into splits."""
    line = lambda i, n: json.dumps({"resource_id": i, "key": None, "source": "s", "cited_by_count": n, "referenced_works": []})
    (tmp_path / "a.jsonl").write_text("\n".join(line(f"r{k % 50}", k) for k in range(2000)) + "\n" + line("", 1) + "\n")
    (tmp_path / "b.jsonl").write_text(line("r7", -1) + "\n" + line(None, 5))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("1g", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            got = {r["resource_id"]: r["cited_by_count"] for r in readers.read_store(spark, str(tmp_path)).collect()}
            assert got == {f"r{k}": 1950 + k for k in range(50)} | {"r7": -1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_yaml_is_written_only_if_all_is_well(spark, tmp_path):
    pytest.importorskip("yaml")
    r = spark.createDataFrame([("a.yml", "resource:a", "T: x", ["1"], None, [], "x.yml"), ("b.yml", "resource:b", "ü", None, "", ["y"], "z")], "file string, id string, title string, taxonomy_topics array<string>, doi string, authors array<string>, url string")
    with pytest.raises(ValueError, match="broken rules"):
        writers.write_yaml(r, str(tmp_path / "no"), spark.createDataFrame([("resource:a", "bad")], "id string, problem string"))
    assert not (tmp_path / "no").exists()
    writers.write_yaml(r, str(tmp_path / "yes"), spark.createDataFrame([], "id string, problem string"))
    text = next((tmp_path / "yes" / "file=a.yml").glob("part-*")).read_text()
    assert text.strip() == "id: resource:a\ntitle: 'T: x'\ntaxonomy_topics:\n- '1'\nurl: x.yml"


def test_facets_briefs_and_names(spark):
    r = spark.createDataFrame([(1, {"artifact_type": ["preprint", "essay"], "control_type": ["legal", "nope"], "colour": ["red"]}), (2, {"control_type": ["legal"]}), (3, None)], "id int, facets map<string,array<string>>")
    assert sorted(map(tuple, review.facet_problems(r).collect())) == [(1, "artifact_type", "takes a single value"), (1, "colour", "unknown facet"), (1, "control_type", "no value nope")]
    topics = spark.createDataFrame([("2", "T", list("abcdef")), ("2.1", "U", None)], "code string, title string, subpoints array<string>")
    brief = {x["code"]: x for x in graph.topic_brief(topics, spark.createDataFrame([(1, "2.1"), (2, "2")], "id int, code string")).collect()}
    assert list(brief["2"]["notes"]) == list("abcd") and (brief["2"]["records"], brief["2"]["children"], brief["2"]["under"]) == (1, 1, 1) and brief["2.1"]["parent"] == "2" and list(brief["2.1"]["notes"]) == []
    names = spark.createDataFrame([("J. Doe",), ("J Doe",), ("Al",)], "name string")
    assert [(x["canonical"], x["variants"], x["n"]) for x in people.duplicate_names(names).collect()] == [("J. Doe", 2, 2)]
    assert [x["id"] for x in review.promoted(spark.createDataFrame([(1, "r"), (2, ""), (3, None)], "id int, promoted_to string")).collect()] == [1]


def test_taxonomy_problems(spark):
    empty = spark.createDataFrame([], "code string")
    assert [tuple(r) for r in readers.taxonomy_problems(empty).collect()] == [("no topics", None)]
    got = readers.taxonomy_problems(spark.createDataFrame([("1",), ("2.1.1",), ("99",)], "code string"))
    assert {("parent missing", "2.1"), ("section unknown", "99"), ("section missing", "3")} <= set(map(tuple, got.collect()))
    assert [tuple(r) for r in readers.taxonomy_problems(spark.createDataFrame([("1.2",)], "code string"), False).collect()] == [("parent missing", "1")]
