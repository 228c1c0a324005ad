"""Operators on small literals."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusgraph.functions import fixed
from corpusgraph.functions import text as T
from corpusgraph.operators import citations, curation, fulltext, graph, payloads, people, ranks, retrieval, review
from corpusgraph.sources import readers, writers


def _refs(spark):
    return spark.createDataFrame([(i, r) for i, rs in {"A": "XYZ", "B": "XYW", "C": "QR"}.items() for r in rs], "id string, ref string")


def test_coupling_is_jaccard(spark):
    assert citations.bibliographic_coupling(_refs(spark)).collect() == [Row(source="A", target="B", shared=2, score=0.5)]


def test_co_cited_pair(spark):
    got = citations.co_cited_pairs(_refs(spark)).collect()
    assert [(r.left, r.right, r.shared) for r in got] == [("X", "Y", 2)]


def test_connectivity_counts(spark):
    cand = spark.createDataFrame([("NEW", "X"), ("NEW", "Y"), ("FAR", "ZZZ"), ("X", None)], "id string, ref string")
    got = {r.id: (r.shared, r.cited_by) for r in citations.connectivity(cand, _refs(spark)).collect()}
    assert got == {"NEW": (2, 0), "FAR": (0, 0), "X": (0, 2)}


def test_tokens_and_phrases(spark):
    texts = ["agents and permissions", "overspending", "bias data", "evaluating evaluation", "", None, "spend cap"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.t for r in df.orderBy("i").select(T.with_phrases(T.tokens(F.col("text"))).alias("t")).collect()]
    assert got[0] == ["permission"] and got[1] == ["overspend"] and got[2] == ["bias", "data", "bias_data"]
    assert got[3][0] != got[3][1] and got[4] == got[5] == [] and got[6] == ["spend", "cap", "spend_cap"]


def test_prune_and_numeric_order(spark):
    df = spark.createDataFrame([(1, "2", 9.0), (1, "2.2", 8.0), (1, "3.10", 7.0), (1, "3.2", 7.0), (2, "2", 5.0)], "id int, code string, score double")
    got = [(r.id, r.code, r["rank"]) for r in retrieval.top_k(retrieval.prune_ancestors(df), 3).orderBy("id", "rank").collect()]
    assert got == [(1, "2.2", 1), (1, "3.2", 2), (1, "3.10", 3), (2, "2", 1)]


def test_people(spark):
    names = ["Joel Z. Leibo", "Joel Z Leibo", "Duéñez-Guzmán", "Barfuß", "Barfuss", "Alan Chan", "Alan Chen"]
    folds = {r.name: r.f for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", T.fold_name(F.col("name")).alias("f")).collect()}
    assert folds["Joel Z. Leibo"] == folds["Joel Z Leibo"] and folds["Duéñez-Guzmán"] == "duenezguzman"
    assert folds["Barfuß"] == folds["Barfuss"] and folds["Alan Chan"] != folds["Alan Chen"]
    counts = spark.createDataFrame([("Joel Z Leibo",)] * 12 + [("Joel Z. Leibo",)], "name string")
    assert people.canonical_spellings(counts).collect()[0].canonical == "Joel Z. Leibo"
    pairs = [("Michael E. Houle", "Michael Houle", True), ("S. S. Zhu", "Shenzhe Zhu", True), ("Zhao Yue", "Yue Zhao", True), ("Bin Hu", "Botao 'Amber' Hu", False), ("Dhruv Tailor", "Om Tailor", False), ("", "x", False)]
    for a, b, same in pairs:
        left, right = (spark.createDataFrame([(x,)], "name string") for x in (a, b))
        assert people.same_person_pairs(left, right).count() == same, (a, b)


def test_headings(spark):
    want = {"1 Introduction": "introduction", "IV. Results": "results", "4.4 Secondary evaluation metrics": "results", "Limitations and threats to validity": "discussion", "7 What does Melting Pot evaluate?": "other"}
    df = spark.createDataFrame([(k,) for k in want], "h string").select("h", T.heading_kind(F.col("h")).alias("k"))
    assert {r.h: r.k for r in df.collect()} == want


def test_sections_and_quotes(spark):
    html = '<h6 class="ltx_title">Abstract</h6><p class="ltx_p">We test.</p><h2 class="ltx_title">1 Introduction</h2><nav><p class="ltx_p">menu</p></nav><p class="ltx_p">Overspending fell<cite>[1]</cite> from 27% to 3% .</p><h2 class="ltx_title">Empty</h2><div class="x ltx_bibliography"><p class="ltx_p">ref</p></div>'
    parts = fulltext.sections(spark.createDataFrame([("a", html), ("b", None), ("c", "")], "id string, html string")).orderBy("pos").collect()
    assert [(p.kind, p.text) for p in parts] == [("abstract", "We test."), ("introduction", "Overspending fell from 27% to 3%.")]
    quotes = spark.createDataFrame([(1, "a", "fell  from 27%"), (2, "a", "rose from 27%")], "quote_id int, id string, text string")
    made = spark.createDataFrame([(p.id, p.pos, p.kind, p.text) for p in parts], "id string, pos int, kind string, text string")
    assert [(r.quote_id, r.kind) for r in fulltext.first_section(quotes, made).collect()] == [(1, "introduction")]


def test_identifiers(spark):
    cases = [({"DOI": "10.48550/arXiv.2107.06857"}, "arxiv:2107.06857"), ({"ArXiv": "2107.06857"}, "arxiv:2107.06857"), ({"doi": "10.1038/S41586"}, "doi:10.1038/s41586"), ({"CorpusId": "999"}, "semanticscholar:999"), ({}, None)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,string>")
    assert [r.k for r in df.orderBy("i").select(T.canonical_key(F.col("m")).alias("k")).collect()] == [w for _, w in cases]


def test_agreement_in_both_directions(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, code string")
    for gold, pred, hit, exact in (("2.2", "2.2.2", 1, 0), ("2.2.2", "2.2", 1, 0), ("2.2", "11.6", 0, 0), ("2.2", "2.2", 1, 1)):
        r = review.agreement(make([(1, gold)]), make([(1, pred)])).head()
        assert (r.recovered, r.exact) == (hit, exact)


def test_upsert_keeps_old_list(spark):
    ddl = "resource_id string, key string, source string, cited_by_count int, referenced_works array<string>"
    got = review.store_upsert(spark.createDataFrame([("r", "k", "s2", 5, ["b", "a"])], ddl), spark.createDataFrame([("r", None, "oa", 9, [])], ddl)).head()
    assert (got.key, got.source, got.cited_by_count, got.referenced_works) == ("k", "s2", 9, ["a", "b"])


def test_empty_overlay_changes_nothing(spark):
    ranked = spark.createDataFrame([("a", 10.0), ("b", 8.0), ("c", 6.0)], "id string, score double")
    none = spark.createDataFrame([], "member string, id string")
    assert [r.id for r in review.trust_rerank(ranked, review.affinity(none, none)).orderBy("rank").collect()] == ["a", "b", "c"]


def test_taxonomy_markdown(spark, tmp_path):
    text = "# T\n## 1. First **part**\n- 1.1 One:\n  - point [x](y)\n  - point\n```\n9.9 no\n```\n- **1.10** Ten\n- 1.2 Two\n## Notes\n- 3 no\n"
    (tmp_path / "t.md").write_text(text)
    rows = readers.read_taxonomy(spark, str(tmp_path / "t.md")).orderBy("pos").collect()
    assert [r.code for r in rows] == ["1", "1.1", "1.2", "1.10"] and rows[1].subpoints == ["point"] and rows[0].title == "First part"
    assert [r.usage_mode for r in rows] == ["navigation"] * 4


def test_absent_files_are_empty(spark, tmp_path):
    assert readers.read_yaml(spark, str(tmp_path / "none.yml"), readers.CLAIM).count() == 0


def test_numeric_references(spark):
    want = {"a &#8217;b&#x2019; &amp;#65; &amp;": "a ’b’ &#65; &", "&#0;&#xD800;": "\ufffd\ufffd", "&copy; 2 &lt;p&gt;": "© 2 <p>", "none": "none"}
    df = spark.createDataFrame([(k,) for k in want], "h string").select("h", T.plain_text(F.col("h")).alias("t"))
    assert {r.h: r.t for r in df.collect()} == want


def test_short_quotes(spark):
    sources = spark.createDataFrame([(1, "alpha beta  gamma delta"), (2, "xbeta gamma"), (3, None)], "source_id int, text string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, "ha beta gam"), (4, "beta gamma"), (5, " "), (6, "q w e r t y u i")], "quote_id int, text string")
    got = sorted(map(tuple, fulltext.verbatim(quotes, sources).collect()))
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2)]


def test_global_rank(spark):
    df = spark.range(3000).select(F.col("id"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))
    got = ranks.exact_rank(df, [F.desc("v"), F.asc("id")], "rank", 1).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001)) and [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_node_types_are_checked(spark):
    with pytest.raises(TypeError):
        graph.node_records(thing=spark.range(1))


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "x"), ("a", "x")], "id string, kind string")
    links = spark.createDataFrame([("a", "b", "cites"), ("b", "a", "cites")], "source string, target string, kind string")
    payloads.write_graph(str(tmp_path / "g"), nodes, links)
    assert [r.id for r in spark.read.json(str(tmp_path / "g" / "nodes")).orderBy("id").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no node"):
        payloads.write_graph(str(tmp_path / "h"), nodes, links.withColumn("target", F.lit("zz")))


def test_mapping_fits_the_model():
    model = {x.strip().split(" ")[0] for x in readers.RESOURCE.replace("map<string,array<string>>", "map").split(",")}
    table = [*fixed.ROW_FIELDS, *fixed.ROW_LISTS, *fixed.ROW_CHECKBOXES, *fixed.FACET_COLUMNS, *fixed.ROW_TOOLS, *fixed.ROW_TOOL_LISTS, "Published"]
    assert curation.definition_problems(model, table) == [] and curation.definition_problems(model - {"doi"}, table) == ["unknown attribute doi"]
    assert curation.definition_problems(model, [x for x in table if x != "License"] + ["Extra *", "URL"]) == ["defined twice: URL", "mapped but not defined: License", "starred but not checked: Extra *"]
    assert "F1 Artifact Type" in table and "F12 Applicability" in table


def test_store_round_trip(spark, tmp_path):
    store = spark.createDataFrame([("r2", "k", "s2", 3, ["b", "a"]), ("r1", None, "oa", 0, [])], readers.REFS)
    writers.write_store(store, str(tmp_path / "s"))
    got = {r.resource_id: (r.key, r.referenced_works) for r in readers.read_store(spark, str(tmp_path / "s")).collect()}
    assert got == {"r2": ("k", ["a", "b"]), "r1": (None, [])}


def test_tool_tables_and_lists(spark):
    md = ["## Build", "### Sub", "| Name | What | Stars |", "|---|---|---|", "| [A](http://a) | does | 1.2k |", "| [B](http://b) | x | MIT/2 |", "## Next", "| [C](http://c) | y |"]
    got = readers.parse_tool_tables(spark.createDataFrame([("d", i, x) for i, x in enumerate(md)], "doc string, pos int, line string")).orderBy("name").collect()
    assert [(r.name, r.section, r.subsection, r.stars) for r in got] == [("A", "Build", "Sub", "1.2k"), ("B", "Build", "Sub", None), ("C", "Next", None, None)]
    lines = ["# no", "- 2107.06857 [2.2, 3.1]", "1. Hammond et al., 10.1000/x.", "see https://a.b/c here"]
    got = readers.parse_list(spark.createDataFrame(list(enumerate(lines)), "pos int, line string")).orderBy("pos").collect()
    assert [(r.token, r.topics) for r in got] == [("2107.06857", "2.2, 3.1"), ("10.1000/x", ""), ("https://a.b/c", "")]


def test_works_and_atom(spark):
    work = '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.48550/arXiv.2101.1","title":"t","abstract_inverted_index":{"b":[1],"a":[0,2]},"referenced_works":["https://openalex.org/W2"]}'
    r = readers.parse_works(spark.createDataFrame([(work,)], "value string")).head()
    assert (r.openalex_id, r.arxiv_id, r.abstract, r.referenced_works) == ("W1", "2101.1", "a b a", ["W2"])
    feed = "<feed><entry><id>http://arxiv.org/abs/2101.1v2</id><title>A\n b</title><name>X &amp; Y</name><summary>s</summary><published>2021-01-02T0</published></entry></feed>"
    r = readers.parse_atom(spark.createDataFrame([(feed,)], "value string")).head()
    assert (r.arxiv_id, r.title, r.authors, r.published) == ("2101.1", "A b", ["X & Y"], "2021-01-02")


def test_filings(spark):
    fenced = """Thanks.
```
not: a filing
```
```yaml
records:
  resource:a: {topics: ["11.10", "2.2"], reviewed_on: 2026-01-02}
  resource:b: {topics: [11.10], verdict: out-of-scope, unsure: yes, note: " why "}
  resource:c: [x]
claims:
  claim:a:1: accurate
  claim:a:2: {verdict: overstated, note: " too strong "}
new_statements:
  resource:a:
    - {text: A statement of some length., quote: A sentence of the paper., type: method}
    - just text
```
"""
    bare = "records:\n  resource:a:\n    topics: '1.1, 1.2'\n"
    issues = [(1, fenced), (2, bare), (3, "hello"), (4, None), (5, ""), (6, "```yaml\nrecords: [\n```"), (7, "claims: {x: accurate}\nrecords: [1]"), (8, "records: {x: {d: 2026-13-45}}")]
    got = readers.parse_filings(spark.createDataFrame(issues, "id int, body string")).collect()
    one = [r for r in got if r.issue == "1"]
    assert [(r.id, list(r.topics or []), list(r.numbers or []), r.problem) for r in one if r.part == "records"] == [
        ("resource:a", ["11.10", "2.2"], [], None), ("resource:b", [], ["11.1"], None), ("resource:c", [], [], "wrong form")]
    by_id = {r.id: r for r in one if r.part == "records"}
    assert by_id["resource:a"].reviewed_on == "2026-01-02" and (by_id["resource:b"].verdict, by_id["resource:b"].unsure, by_id["resource:b"].note) == ("out-of-scope", True, "why")
    assert [(r.id, r.verdict, r.note) for r in one if r.part == "claims"] == [("claim:a:1", "accurate", None), ("claim:a:2", "overstated", "too strong")]
    assert [(r.pos, r.type, r.problem) for r in one if r.part == "new_statements"] == [(1, "method", None), (2, None, "wrong form")]
    assert [list(r.topics) for r in got if r.issue == "2"] == [["1.1", "1.2"]]
    assert {r.issue for r in got if r.problem == "no filing found"} == {"3", "4", "5", "6", "8"}
    assert sorted((r.part, r.problem) for r in got if r.issue == "7") == [("claims", None), ("records", "not a map")]


def test_papers(spark):
    full = '{"paperId":"p1","title":"T","externalIds":{"DOI":"10.1/X","paperid":"other"},"authors":[{"name":"A"},{"name":null}],"references":[{"externalIds":{"ArXiv":"2101.00001"}},{"externalIds":null}]}'
    bare = '{"paperId":"p2","title":"U"}'
    got = {r["title"]: r for r in readers.parse_papers(spark.createDataFrame([(full,), (bare,)], "value string")).collect()}
    assert got["T"]["key"] == "doi:10.1/x" and got["U"]["key"] is None
    assert list(got["T"]["authors"]) == ["A"] and list(got["U"]["authors"]) == [] and got["U"]["citation_count"] == 0 and list(got["T"]["referenced_keys"]) == ["arxiv:2101.00001"]
