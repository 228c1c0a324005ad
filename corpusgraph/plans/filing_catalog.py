"""More queries over the driver tables with their SQL: records, filing, curation, payloads, and texts' small parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import citations, curation, filing, fulltext, graph, payloads, people, records, retrieval, review, search
from ..sources import readers, writers
from .catalog import _BM25_SQL, _COUPLING, _NAMES_SQL, _TOPICS_SQL, _bench, _claims, _filed, _names, _r6, _refs, _snapshots, _t, _texts, _topics, query


def _s(*parts):
    """Concatenation of columns and texts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _full_claims(spark, d):
    """Every turn of a conversation as a claim of one of the suppliers."""
    c, none = _t(spark, d, "conversations"), F.lit(None).cast("string")
    own = (F.col("conv_id") % 20 + 1).cast("long")
    return c.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), own.alias("resource_id"), "text", none.alias("standalone"), F.col("role").alias("claim_type"), F.substring("text", 1, 12).alias("quote"), F.lit("abstract").alias("extracted_from"),
        F.lit("m").alias("extraction_method"), F.array(own.cast("string")).alias("topic_codes"), F.when(F.col("turn") % 3 == 0, "reviewed").otherwise("unreviewed").alias("review_status"),
        F.when(F.col("turn") % 3 == 0, "accurate").alias("verdict"), F.when(F.col("turn") % 3 == 0, "r").alias("reviewed_by"),
    )


_CLAIM = """SELECT conv_id || ':' || turn AS id, conv_id % 20 + 1 AS of_record, text AS claim, NULL::VARCHAR AS in_context, role AS type, left(text, 12) AS quoted_from_the_paper, 'abstract' AS read_from, 'm' AS extracted_by,
[CAST(conv_id % 20 + 1 AS VARCHAR)] AS suggests_topics, CASE WHEN turn % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review_status, CASE WHEN turn % 3 = 0 THEN 'accurate' END AS verdict, CASE WHEN turn % 3 = 0 THEN 'r' END AS verified_by FROM conversations"""


def _resources(spark, d):
    """Suppliers as records; every third has no address, every fourth no abstract."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    return _t(spark, d, "supplier").select(
        k.alias("id"), F.col("s_name").alias("title"), F.lit("preprint").alias("resource_type"), F.when(k % 2 == 0, F.array("s_name")).alias("authors"), F.when(k % 5 == 0, "2024-01-02").alias("published_at"),
        F.when(k % 3 != 0, _s("https://x.org/", k, "/")).alias("url"), none.alias("doi"), F.when(k % 3 == 0, _s("2101.0000", k % 10)).alias("arxiv_id"), F.array(k.cast("string")).alias("taxonomy_topics"), F.lit("unreviewed").alias("review_status"),
        (k % 7 == 0).alias("is_borrowed_background"), F.lit("seed").alias("source_provenance"), F.when(k % 4 != 0, _s("text ", k)).otherwise("").alias("abstract"), none.alias("description"), _s("W", k).alias("openalex_id"), k.alias("pos"),
    )


_RECORD = """SELECT s_suppkey AS id, s_name AS title, 'preprint' AS type, CASE WHEN s_suppkey % 2 = 0 THEN [s_name] ELSE [] END AS authors, CASE WHEN s_suppkey % 5 = 0 THEN '2024-01-02' ELSE '' END AS published,
CASE WHEN s_suppkey % 3 <> 0 THEN 'https://x.org/' || s_suppkey || '/' ELSE '' END AS url, '' AS doi, CASE WHEN s_suppkey % 3 = 0 THEN '2101.0000' || s_suppkey % 10 ELSE '' END AS arxiv_id, [CAST(s_suppkey AS VARCHAR)] AS filed_under,
'unreviewed' AS review_status, s_suppkey % 7 = 0 AS is_borrowed_background, 'seed' AS provenance, coalesce(n, 0) AS claims_extracted, CASE WHEN s_suppkey % 4 <> 0 THEN 'text ' || s_suppkey END AS abstract
FROM supplier LEFT JOIN (SELECT conv_id % 20 + 1 AS r, count(*) AS n FROM conversations GROUP BY 1) ON r = s_suppkey"""


@query(_CLAIM)
def claim_brief(spark, d):
    return records.claim_brief(_full_claims(spark, d))


@query(_RECORD)
def record_brief(spark, d):
    return records.record_brief(_resources(spark, d), _full_claims(spark, d))


@query(f"WITH c AS ({_CLAIM}) SELECT r.id, r.title, r.claims_extracted, r.url, (SELECT list(c.id ORDER BY c.id) FROM c WHERE c.of_record = r.id) AS claims, NULL::VARCHAR AS error FROM ({_RECORD}) r WHERE r.id = 2 UNION ALL SELECT -1, NULL, NULL, NULL, NULL, '-1 is not a record in this corpus'")
def get_record(spark, d):
    one = lambda k: records.get_record(_resources(spark, d), _full_claims(spark, d), F.lit(k).cast("long")).select("id", "title", "claims_extracted", "url", F.transform("claims", lambda c: c["id"]).alias("claims"), "error")
    return one(2).unionByName(one(-1))


@query("SELECT conv_id AS resource_id, conv_id || ':' || turn AS id, CASE WHEN turn % 4 = 1 THEN 'overstated' WHEN turn % 3 = 0 THEN 'accurate' END AS verdict, CASE WHEN turn % 4 = 1 OR turn % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review_status, CASE WHEN turn % 8 = 1 THEN 'seen' ELSE role END AS note FROM conversations")
def load_claims(spark, d):
    c = _t(spark, d, "conversations")
    ident = F.concat_ws(":", "conv_id", "turn")
    done = F.col("turn") % 3 == 0
    one = F.struct(ident.alias("id"), F.when(done, "accurate").alias("verdict"), F.when(done, "r").alias("reviewed_by"), F.col("role").alias("note"), F.when(done, "reviewed").otherwise("unreviewed").alias("review_status"))
    files = c.groupBy(F.col("conv_id").alias("resource_id")).agg(F.collect_list(one).alias("claims"))
    verdicts = c.where("turn % 4 = 1").select(ident.alias("id"), F.lit("overstated").alias("verdict"), F.lit("x").alias("reviewer"), F.when(F.col("turn") % 8 == 1, "seen").alias("note"))
    return records.load_claims(files, verdicts).select("resource_id", "id", "verdict", "review_status", "note")


@query("SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'ambiguous' WHEN turn % 3 = 0 THEN 'accurate' END AS verdict, CASE WHEN turn % 2 = 0 OR turn % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review_status FROM conversations")
def apply_verdicts(spark, d):
    claims = _full_claims(spark, d).withColumn("note", F.lit("n"))
    new = _t(spark, d, "conversations").where("turn % 2 = 0").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("ambiguous").alias("verdict"), F.lit("x").alias("reviewer"), F.lit(None).cast("string").alias("note"))
    return review.apply_verdicts(claims, new).select("id", "verdict", "review_status")


@query(f"""WITH {_TOPICS_SQL} SELECT t.code, array_to_string(list_filter([t.title, 'sub ' || lower(t.title), CASE WHEN t.code LIKE '2%' THEN 'also' END, (SELECT p.title FROM topics p WHERE p.code = split_part(t.code, '.', 1) AND t.code <> p.code), CASE WHEN t.code LIKE '%1' THEN 'about' END], lambda x: x IS NOT NULL), ' ') AS text FROM topics t""")
def topic_texts(spark, d):
    topics = _topics(spark, d).withColumns({"subpoints": F.array(_s("sub ", F.lower("title"))), "description": F.when(F.col("code").endswith("1"), "about").otherwise("")})
    aliases = topics.where("code LIKE '2%'").select("code", F.array(F.lit("also")).alias("aliases"))
    return records.topic_texts(topics, aliases)


_BM25_TITLED = _BM25_SQL.replace("AS w FROM documents", "AS w FROM (SELECT doc_id, source || CASE WHEN text <> '' THEN ' ' || text ELSE '' END AS text FROM documents)")


@query(f"WITH {_BM25_TITLED} SELECT id, code, score, rank FROM rk WHERE rank <= 6")
def classify_resources(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("description"), F.col("text").alias("abstract"))
    return records.classify_resources(retrieval.TopicIndex(_bench(spark, d)), docs)


@query(f"""WITH {_BM25_TITLED}, g AS (SELECT doc_id AS id, (doc_id % 4 + 1) || CASE WHEN quality = 1 THEN '' ELSE '.' || (doc_id % 40 + 1) END AS code FROM labels), p AS (SELECT id, code FROM rk WHERE rank <= 6),
h AS (SELECT g.id, g.code, max(CASE WHEN p.code = g.code OR starts_with(p.code, g.code || '.') OR starts_with(g.code, p.code || '.') THEN 1 ELSE 0 END) AS hit, max(CASE WHEN p.code = g.code THEN 1 ELSE 0 END) AS ex FROM g LEFT JOIN p USING (id) GROUP BY ALL)
SELECT count(DISTINCT id) AS records, count(*) AS tags, CAST(sum(hit) AS BIGINT) AS recovered, CAST(sum(ex) AS BIGINT) AS exact, count(DISTINCT CASE WHEN hit = 1 THEN id END) AS records_hit, count(DISTINCT id) < 30 AS few FROM h""")
def evaluate_classifier(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("description"), F.col("text").alias("abstract"))
    i = F.col("doc_id")
    gold = _t(spark, d, "labels").select(i.alias("id"), F.when(F.col("quality") == 1, (i % 4 + 1).cast("string")).otherwise(_s(i % 4 + 1, ".", i % 40 + 1)).alias("code"))
    return records.evaluate(retrieval.TopicIndex(_bench(spark, d)), docs, gold)


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN [p_brand] WHEN p_size % 3 = 0 THEN ['a', 'b'] ELSE [] END AS authors,
CASE WHEN p_size % 4 = 0 THEN true ELSE p_size % 3 = 0 END AS is_open_access FROM part""")
def resolve_fill_only(spark, d):
    n = F.col("p_size")
    none = F.array().cast("array<string>")
    own = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when((n % 3 == 0) | (n % 5 == 0), "").otherwise(F.col("p_name")).alias("title"), F.when(n % 2 == 0, F.array("p_brand")).otherwise(none).alias("authors"), (n % 4 == 0).alias("is_open_access"))
    new = _t(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("authors"), F.lit(True).alias("is_open_access"))
    return records.fill_only(own, new)


@query("SELECT 'W' || s_suppkey AS openalex_id, coalesce(n, 0) AS cited_by_count FROM supplier LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) ON k = s_suppkey WHERE s_suppkey % 7 <> 0 ORDER BY 2 DESC, s_suppkey LIMIT 5")
def expansion_seeds(spark, d):
    store = _t(spark, d, "lineitem").where("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("resource_id")).agg(F.count(F.lit(1)).alias("cited_by_count"))
    return records.seeds(_resources(spark, d), store, 5)


_WORKS = "w AS (SELECT p_partkey AS id, 'ai agent ' || p_name AS title, p_brand AS abstract, CAST(p_size AS BIGINT) AS cited_by FROM part), s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey <= 20)"


def _works(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), _s("ai agent ", F.col("p_name")).alias("title"), F.col("p_brand").alias("abstract"), F.col("p_size").cast("long").alias("cited_by"))


def _neighbours(spark, d):
    """One hop from twenty works: what each cites, and by whom it is cited; works are parts, citations order lines."""
    seeds = _t(spark, d, "orders").where("o_orderkey <= 20").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))
    links = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")).distinct().withColumn("pos", F.col("cited"))
    return citations.expand_neighborhood(seeds, links, _works(spark, d), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), min_score=3, per_seed=4)


_HOP = f"""{_WORKS}, l AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem),
near AS (SELECT cited AS work, s.id AS via, 0 AS way, row_number() OVER (PARTITION BY s.id ORDER BY cited) AS r FROM s JOIN l ON s.id = l.citing
  UNION ALL SELECT citing, s.id, 1, row_number() OVER (PARTITION BY s.id ORDER BY w.cited_by DESC, cited, citing) FROM s JOIN l ON s.id = l.cited JOIN w ON w.id = l.citing),
hop AS (SELECT work, via FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY via, way, r) AS f FROM near WHERE r <= 4) WHERE f = 1 AND work NOT IN (SELECT s_suppkey FROM supplier)),
found AS (SELECT work, title, cited_by, via AS found_via, CAST(3 AS BIGINT) AS score FROM hop JOIN w ON w.id = work)"""


@query(f"WITH {_HOP} SELECT work, title, cited_by, found_via, score FROM found")
def expand_neighborhood(spark, d):
    return _neighbours(spark, d).select("work", "title", "cited_by", "found_via", F.col("score").cast("long").alias("score"))


@query(f"""WITH {_HOP}, often AS (SELECT l_partkey AS work, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3 ORDER BY 2 DESC, 1 LIMIT 40)
SELECT work, title, cited_by, score, CAST(found_via AS VARCHAR) AS found_via FROM found UNION ALL SELECT work, w.title, w.cited_by, 3 + 3 * n, 'co-cited by ' || n || ' corpus papers' FROM often JOIN w ON w.id = work WHERE work NOT IN (SELECT work FROM found)""")
def expand_structural(spark, d):
    return records.expand(_neighbours(spark, d), _refs(spark, d), _works(spark, d), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("SELECT p_partkey AS id, ['a' || p_size, 'b', 'c', 'd', 'e', 'f', 'g', 'h'] AS authors, ['x', 'y', 'z', p_brand] AS institutions, round(p_retailprice / 7, 3) AS score FROM part")
def candidate_rows(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(_s("a", F.col("p_size")), *map(F.lit, "bcdefghij")).alias("authors"), F.array(*map(F.lit, "xyz"), F.col("p_brand"), F.lit("w")).alias("institutions"), (F.col("p_retailprice") / 7).alias("score"))
    return records.candidate_rows(part)


@query("SELECT count_if(l_orderkey % 2 = 1) AS with_references, count(*) AS total FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def reference_coverage(spark, d):
    k = F.col("l_orderkey")
    return records.store_coverage(_t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(k % 2 == 1, F.col("l_partkey"))).alias("referenced_works")))


@query(f"WITH {_COUPLING}, held AS (SELECT p_partkey AS id, p_partkey + 1 AS key FROM part) SELECT DISTINCT l_orderkey AS source_id, b.id AS target_id, 'CITES' AS relation, NULL::DOUBLE AS score FROM lineitem JOIN held a ON a.id = l_orderkey JOIN held b ON b.key = l_partkey WHERE l_orderkey <> b.id UNION ALL SELECT source, target, 'SIMILAR_TO', score FROM coupled WHERE source IN (SELECT id FROM held) AND target IN (SELECT id FROM held)".replace("SELECT DISTINCT l_orderkey AS source_id, b.id AS target_id", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(b.id AS VARCHAR) AS target_id").replace("SELECT source, target, 'SIMILAR_TO'", "SELECT CAST(source AS VARCHAR), CAST(target AS VARCHAR), 'SIMILAR_TO'"))
def scholarly_edges(spark, d):
    held = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("key"), F.col("p_partkey").alias("pos"))
    return _r6(records.scholarly_edges(_refs(spark, d), held), "score").select("source_id", "target_id", "relation", "score")


@query(f"""WITH {_TOPICS_SQL}, r AS (SELECT s_suppkey AS id, [(s_suppkey % 6) || '', '3', 'zz', CAST(s_suppkey % 4 + 1 AS VARCHAR)] AS l FROM supplier), e AS (SELECT DISTINCT id, unnest(l) AS code FROM r)
SELECT id, coalesce(list(code ORDER BY code) FILTER (code IN (SELECT code FROM topics)), []) AS codes, coalesce(list(code ORDER BY code) FILTER (code NOT IN (SELECT code FROM topics)), []) AS unknown FROM e GROUP BY id""")
def read_topics(spark, d):
    k = F.col("s_suppkey")
    raw = _t(spark, d, "supplier").select(k.alias("id"), _s(" ", k % 6, ", 3;zz  ", k % 4 + 1).alias("topics"))
    return filing.read_topics(raw, _topics(spark, d))


@query("SELECT c_custkey AS pos, s_suppkey AS held FROM customer LEFT JOIN supplier ON (c_custkey % 3 = 2 AND s_suppkey = c_custkey % 40) OR (c_custkey % 3 = 0 AND s_suppkey = c_custkey % 50)")
def already_held(spark, d):
    k, s, none = F.col("c_custkey"), F.col("s_suppkey"), F.lit(None).cast("string")
    asked = _t(spark, d, "customer").select(k.alias("pos"), none.alias("doi"), F.when(k % 3 == 2, _s(" arXiv:2101.", k % 40)).alias("arxiv"), F.when(k % 3 == 0, _s("HTTPS://x.org/", k % 50)).alias("url"))
    held = _t(spark, d, "supplier").select(s.alias("id"), s.alias("pos"), F.when(s % 2 == 0, _s("10.48550/arXiv.2101.", s)).alias("doi"), F.when(s % 2 == 1, _s("2101.", s)).alias("arxiv_id"), _s("https://x.org/", s, "/").alias("url"), none.alias("repository_url"))
    return filing.already_held(asked, held)


def _sources(spark, d):
    """Three snapshots about parts: works of two in three, papers of each, preprints of each third."""
    part = _t(spark, d, "part")
    k, ident = F.col("p_partkey"), _s("10.5555/x", F.col("p_partkey"))
    ident = F.when(k % 3 == 0, _s("2101.", k)).otherwise(ident)
    none = F.lit(None).cast("string")
    works = part.where("p_partkey % 3 <> 1").select(ident.alias("ident"), F.when(k % 4 == 0, "").otherwise(_s("T", k)).alias("title"), F.when(k % 2 == 0, _s("A", k)).alias("abstract"), F.array(F.lit("Ann"), F.lit("Bob")).alias("authors"), F.array("p_brand").alias("institutions"), F.when(k % 5 == 0, "report").otherwise("article").alias("type"), none.alias("publication_date"))
    papers = part.select(ident.alias("ident"), F.when(k % 7 != 0, _s("S", k)).alias("abstract"), F.array(F.lit("Cy")).alias("authors"))
    preprints = part.where("p_partkey % 3 = 0").select(ident.alias("ident"), _s("X", k).alias("title"), _s("P", k).alias("abstract"), F.array(F.lit("Ann")).alias("authors"))
    return works, papers, preprints


_PAPERS = """paper AS (SELECT p_partkey AS pos, p_partkey AS k, p_partkey % 3 = 0 AS pre, p_partkey % 3 <> 1 AS found FROM part),
rec AS (SELECT pos, CASE WHEN pre THEN 'resource:arxiv:2101.' || k ELSE 'resource:doi:10-5555-x' || k END AS id, CASE WHEN pre THEN 'preprint' WHEN found AND k % 5 = 0 THEN 'technical-report' ELSE 'peer-reviewed-paper' END AS resource_type,
CASE WHEN found AND k % 4 <> 0 THEN 'T' || k WHEN k % 8 = 0 THEN 'F' || k WHEN pre THEN 'X' || k END AS title, CASE WHEN found AND k % 2 = 0 THEN 'A' || k WHEN k % 7 <> 0 THEN 'S' || k WHEN pre THEN 'P' || k END AS abstract,
CASE WHEN pre THEN ['Ann'] WHEN found THEN ['Ann', 'Bob'] ELSE ['Cy'] END AS authors FROM paper)"""


@query(f"WITH {_PAPERS} SELECT *, CASE WHEN title IS NULL THEN 'no title' END AS problem FROM rec")
def paper_records(spark, d):
    k = F.col("p_partkey")
    asked = _t(spark, d, "part").select(k.alias("pos"), F.when(k % 3 == 0, "arxiv").otherwise("doi").alias("kind"), F.when(k % 3 == 0, _s("2101.", k)).otherwise(_s("10.5555/x", k)).alias("ident"), F.when(k % 8 == 0, _s("F", k)).otherwise("").alias("title"), F.array().cast("array<string>").alias("topics"), F.lit("me").alias("author"), F.lit(7).alias("issue"))
    return filing.paper_records(asked, *_sources(spark, d)).select("pos", "id", "resource_type", "title", "abstract", "authors", "problem")


@query("""SELECT p_partkey AS pos, 'resource:tool:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS id, CASE WHEN p_size % 2 = 0 THEN 'https://github.com/a/' || p_partkey END AS repository_url, CASE WHEN p_size % 3 = 0 THEN 'MIT' END AS license,
CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'unknown' END AS open_source, CASE WHEN p_size % 5 = 0 THEN ['controls', 'maintainer'] ELSE ['maintainer'] END AS gaps, CASE WHEN p_size % 7 = 0 THEN 'no description' END AS problem,
'added automatically from issue #' || p_size || ' by @me; described by the contributor and not verified against vendor documentation. no topic tags yet — it enters the review queue untagged.' AS source_provenance FROM part""")
def thing_records(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    asked = _t(spark, d, "part").select(k.alias("pos"), F.col("p_name").alias("name"), F.when(n % 7 != 0, "does").alias("summary"), F.when(n % 2 == 0, _s("https://github.com/a/", k)).otherwise("https://b.org").alias("url"), F.when(n % 3 == 0, "MIT · open").alias("license"), F.lit("yes").alias("agents"), F.when(n % 5 == 0, "").otherwise("stop").alias("controls"), F.lit("").alias("maintainer"), F.array().cast("array<string>").alias("topics"), F.lit("me").alias("author"), n.alias("issue"))
    return filing.thing_records(asked).select("pos", "id", "repository_url", "license", "open_source", "gaps", "problem", "source_provenance")


def _arxiv(k):
    """The five-digit arXiv id that stands for a number, as people type them: 100,000 to a month, from January 2021 on."""
    month = F.floor(k / 100_000).cast("long")
    return F.concat(F.lpad((month / 12 + 21).cast("int").cast("string"), 2, "0"), F.lpad((month % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 100_000).cast("string"), 5, "0"))


def _arxiv_number(ident):
    """The number that such an id stands for."""
    part = lambda at, n: F.substring(ident, at, n).cast("long")
    return ((part(1, 2) - 21) * 12 + part(3, 2) - 1) * 100_000 + part(6, 5)


@query(f"""WITH {_PAPERS}, m AS (SELECT pos, id, title, pos % 11 AS z FROM rec) SELECT pos, CASE WHEN z = 1 OR z = 2 OR z = 3 THEN 'refused' WHEN z = 4 THEN 'held' WHEN z = 5 THEN CASE WHEN pos = min(pos) FILTER (z = 5) OVER () THEN 'added' ELSE 'held' END WHEN title IS NULL THEN 'refused' WHEN z = 6 THEN 'held' ELSE 'added' END AS outcome,
CASE WHEN z = 4 THEN 'resource:held' WHEN z IN (1, 2, 3) THEN NULL WHEN z = 5 THEN 'resource:tool:a-tool' WHEN title IS NOT NULL THEN id END AS id, CASE WHEN z = 1 THEN 'nothing to add' WHEN z = 2 THEN 'not an identifier' WHEN z = 3 THEN 'not taxonomy codes: 99' WHEN z NOT IN (4, 5) AND title IS NULL THEN 'no title' END AS detail FROM m""")
def process_proposals(spark, d):
    k = F.col("p_partkey")
    z, none = k % 11, F.lit(None).cast("string")
    raw = F.when(z == 1, "").when(z == 2, "none").when(z == 4, "https://held.org/").when(z == 5, "https://tool.org").otherwise(F.when(k % 3 == 0, none).otherwise(_s("10.5555/X", k)))
    works, papers, preprints = _sources(spark, d)
    proposals = _t(spark, d, "part").select(k.alias("pos"), F.coalesce(raw, _arxiv(k)).alias("identifier"), F.when(z == 5, "A tool").otherwise("").alias("name"), F.when(k % 8 == 0, _s("F", k)).otherwise("").alias("title"), F.lit("does").alias("summary"), F.when(z == 3, "1, 99").otherwise("1").alias("topics"), F.lit("me").alias("author"), F.lit(7).alias("issue"))
    pad = lambda df: df.withColumn("ident", F.when(F.col("ident").startswith("2101."), _arxiv(F.substring("ident", 6, 19).cast("long"))).otherwise(F.col("ident")))
    there = _t(spark, d, "part").where("p_partkey % 11 = 6").select(F.when(k % 3 == 0, _s("resource:arxiv:", _arxiv(k))).otherwise(_s("resource:doi:10-5555-x", k)).alias("id"), k.alias("pos"), none.alias("doi"), none.alias("arxiv_id"), none.alias("url"), none.alias("repository_url"))
    held = spark.range(1).select(F.lit("resource:held").alias("id"), F.lit(-1).cast("long").alias("pos"), none.alias("doi"), none.alias("arxiv_id"), F.lit("https://HELD.org").alias("url"), none.alias("repository_url"))
    out = filing.process(proposals, there.unionByName(held), _topics(spark, d), pad(works), pad(papers), pad(preprints)).drop("record")
    typed = F.regexp_extract("id", r"^resource:arxiv:(\d{4}\.\d{5})$", 1)
    return out.withColumn("id", F.when(typed != "", _s("resource:arxiv:2101.", _arxiv_number(typed))).otherwise(F.col("id")))


def _seeds(spark, d):
    k, c, s = F.col("p_partkey"), F.col("c_custkey"), F.col("s_suppkey")
    papers = _t(spark, d, "part").select(_s("2101.", k).alias("arxiv"), F.col("p_name").alias("title"), F.array(F.lit("1"), F.when(k % 6 == 0, "x").otherwise("2")).alias("topics"), (k % 4 == 0).alias("borrowed"))
    dois = _t(spark, d, "customer").select(_s("10.1/A_", c).alias("doi"), F.col("c_name").alias("title"), F.when(c % 5 == 0, F.array(_s("9.", c), F.lit("y"))).alias("topics"))
    platforms = _t(spark, d, "supplier").select(_s("p", s).alias("id"), F.col("s_name").alias("title"), _s("https://s", s).alias("url"), F.when(s % 2 == 0, "deployment").alias("type"))
    return papers, dois, platforms


@query("""SELECT 'resource:arxiv:2101.' || p_partkey AS id, 'preprint' AS resource_type, p_name AS title, 'https://arxiv.org/abs/2101.' || p_partkey AS url, '10.48550/arXiv.2101.' || p_partkey AS doi, p_partkey % 4 = 0 AS is_borrowed_background FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'resource:doi:10-1-a_' || c_custkey, 'peer-reviewed-paper', c_name, 'https://doi.org/10.1/A_' || c_custkey, '10.1/A_' || c_custkey, false FROM customer UNION ALL SELECT 'resource:platform:p' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'deployment' ELSE 'code-tool' END, s_name, 'https://s' || s_suppkey, NULL, false FROM supplier""")
def expand_seeds(spark, d):
    held = _t(spark, d, "part").where("p_partkey % 10 = 0").select(_s("resource:arxiv:2101.", F.col("p_partkey")).alias("id"))
    return filing.expand_seeds(*_seeds(spark, d), held).select("id", "resource_type", "title", "url", "doi", "is_borrowed_background")


@query("""SELECT 'resource:arxiv:2101.' || p_partkey AS id, ['x'] AS unknown FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'resource:doi:10-1-a_' || c_custkey, ['9.' || c_custkey, 'y'] FROM customer WHERE c_custkey % 5 = 0""")
def unknown_seed_tags(spark, d):
    return filing.unknown_tags(filing.seed_records(*_seeds(spark, d)), _topics(spark, d))


@query(f"""WITH {_HOP}, often AS (SELECT l_partkey AS work, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3 ORDER BY 2 DESC, 1 LIMIT 40),
every AS (SELECT work, title, cited_by, score FROM found UNION ALL SELECT work, w.title, w.cited_by, 3 + 3 * n FROM often JOIN w ON w.id = work WHERE work NOT IN (SELECT work FROM found))
SELECT * FROM every ORDER BY score DESC, cited_by DESC, work LIMIT 25""")
def expand_top(spark, d):
    """The best candidates, as a run writes them."""
    known = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return records.expand(_neighbours(spark, d), _refs(spark, d), _works(spark, d), known, limit=25).select("work", "title", "cited_by", "score")


@query("""WITH t AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, role FROM conversations), p AS (SELECT *, k - k % 2 AS h FROM t)
SELECT id, CAST(min(k + k // 2 + 1) AS INTEGER) AS pos, CASE h % 8 WHEN 0 THEN 'introduction' WHEN 2 THEN 'method' WHEN 4 THEN 'other' ELSE 'results' END AS kind, h % 8 IN (0, 6) AS claim_bearing,
CASE h % 8 WHEN 0 THEN '1 Introduction' WHEN 2 THEN 'II. The Setup of it' WHEN 4 THEN 'Thanks' ELSE '3.1. Findings & more' END AS heading, string_agg('said by ' || role || ', at ' || k, chr(10) || chr(10) ORDER BY k) AS text FROM p GROUP BY id, h""")
def article_sections(spark, d):
    """Conversations as articles: a heading before every second turn."""
    t = _t(spark, d, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    k = F.col("k")
    name = F.when(k % 8 == 0, "1 Introduction").when(k % 8 == 2, "II. The <b>Setup</b> of it").when(k % 8 == 4, "Thanks").otherwise("3.1. Findings &amp; more")
    head = F.when(k % 2 == 0, _s('<h2 class="ltx_title x">', name, "</h2>")).otherwise("")
    each = t.select("conv_id", "k", _s(head, '<div><p class="ltx_p">said by ', F.col("role"), " <cite>[3]</cite>, at ", k, "</p></div>").alias("part"))
    pages = each.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("html"))
    return fulltext.sections(pages).select("id", "pos", "kind", "claim_bearing", "heading", "text")


@query(f"""WITH {_TOPICS_SQL} SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'not a record in this corpus' WHEN c_custkey % 3 = 0 THEN 'topic codes must be quoted: 11.1' WHEN c_custkey % 4 = 1 THEN 'not taxonomy codes: x, ' || c_custkey || '.9' ELSE 'unknown verdict maybe' END AS problem FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 4 = 1 OR c_custkey % 7 = 2""")
def filing_problems(spark, d):
    k = F.col("c_custkey")
    filed = _t(spark, d, "customer").select(k.alias("id"), F.when(k % 4 == 1, F.array(F.lit("x"), F.lit("1"), _s(k, ".9"))).otherwise(F.array(F.lit("1"))).alias("topics"), F.when(k % 3 == 0, F.array(F.lit("11.1"))).alias("numbers"), F.when(k % 7 == 2, "maybe").when(k % 7 == 3, "filed").when(k % 7 == 4, "out-of-scope").alias("verdict"))
    return filing.filing_problems(filed, _t(spark, d, "customer").where("c_custkey % 5 <> 0").select(k.alias("id")), _topics(spark, d))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'not a claim in this corpus' ELSE 'unknown verdict ' || CASE WHEN doc_id % 3 = 1 THEN 'fine' ELSE 'none' END END AS problem FROM labels WHERE doc_id % 4 = 0 OR doc_id % 3 <> 0")
def verdict_problems(spark, d):
    k = F.col("doc_id")
    lab = _t(spark, d, "labels")
    return filing.verdict_problems(lab.select(k.alias("id"), F.when(k % 3 == 0, "accurate").when(k % 3 == 1, "fine").alias("verdict")), lab.where("doc_id % 4 <> 0").select(k.alias("id")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'accurate' ELSE 'overstated' END ELSE 'accurate' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'kept' WHEN doc_id % 3 = 1 THEN 'added' WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS change FROM labels")
def merge_verdicts(spark, d):
    k, lab = F.col("doc_id"), _t(spark, d, "labels")
    return filing.merge_verdicts(lab.where("doc_id % 3 <> 1").select(k.alias("id"), F.lit("accurate").alias("verdict")), lab.where("doc_id % 3 <> 0").select(k.alias("id"), F.when(k % 2 == 0, "accurate").otherwise("overstated").alias("verdict")))


@query("""WITH s AS (SELECT conv_id, turn, conv_id * 10 + turn % 3 AS issue, CASE WHEN conv_id % 9 = 8 THEN 'not a record in this corpus' WHEN turn % 6 = 1 THEN 'quote too short' WHEN turn % 12 = 2 THEN 'unknown type' WHEN turn % 12 = 4 THEN 'quote is not in the paper' END AS problem FROM conversations),
v AS (SELECT *, count(problem) OVER (PARTITION BY issue) > 0 AS voided FROM s), k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY issue, turn) AS k FROM v WHERE NOT voided)
SELECT CASE WHEN k IS NOT NULL THEN 'claim:c' || conv_id || ':' || (2 + k) END AS id, issue, 'resource:c' || conv_id AS resource_id, CASE WHEN turn % 6 = 1 OR turn % 12 = 4 THEN 'by hand' ELSE 'results' END AS read_from, 'written by @me in issue #' || issue AS extraction_method, problem, voided FROM v LEFT JOIN k USING (conv_id, turn)
WHERE issue > 0""")
def new_statements(spark, d):
    """An issue for each third of a conversation's turns; a problem voids all of its issue."""
    c = _t(spark, d, "conversations")
    t, rid = F.col("turn"), _s("resource:c", F.col("conv_id"))
    quote = F.when(t % 6 == 1, "short").when(t % 12 == 4, "this is not in it at all").otherwise(_s("sentence number ", t, " of the paper"))
    issue = F.col("conv_id") * 10 + t % 3
    statements = c.where(issue > 0).select(issue.alias("issue"), F.lit("me").alias("author"), rid.alias("resource_id"), t.alias("pos"), F.lit("a text of some length").alias("text"), quote.alias("quote"), F.when(t % 12 == 2, "guess").when(t % 2 == 0, "finding").alias("type"))
    claims = c.select(rid.alias("resource_id")).distinct().withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))
    parts = c.select(rid.alias("id"), t.alias("pos"), F.lit("results").alias("kind"), _s("So: sentence  number ", t, " of the paper.").alias("text"))
    held = c.where("conv_id % 9 <> 8").select(rid.alias("id")).distinct()
    return filing.new_statements(statements, claims, parts, held).select("id", "issue", "resource_id", "read_from", "extraction_method", "problem", "voided")


@query("""SELECT 'resource:' || s_suppkey AS id, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN ['Ann', 'Bob'] END AS authors, s_suppkey % 3 = 0 AS is_open_access, CASE WHEN s_suppkey % 4 = 0 THEN ['big'] END AS size_facet,
CASE WHEN s_suppkey % 5 = 0 THEN ['https://a', 'https://b'] END AS urls, CASE WHEN s_suppkey % 6 = 0 THEN 'Org' END AS maintainer, CASE WHEN s_suppkey % 6 = 0 THEN ['Go', 'C'] END AS languages, s_suppkey % 6 <> 0 AS no_tool FROM supplier""")
def records_from_rows(spark, d):
    k = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select(F.when(k % 2 == 0, _s("resource:", k)).otherwise(k.cast("string")).alias("ID *"), F.col("s_name").alias("Title *"), F.when(k % 2 == 0, " Ann, ,Bob ").alias("Authors"), (k % 3 == 0).alias("Open Access"), F.when(k % 4 == 0, "big").otherwise("").alias("Size"), F.when(k % 5 == 0, F.array(F.lit("s2"), F.lit("s1"), F.lit("s3"))).alias("Sources"), F.when(k % 6 == 0, "Org").otherwise("").alias("Tool: Maintainer"), F.when(k % 6 == 0, "Go, C,").alias("Tool: Languages"))
    sources = spark.createDataFrame([("s1", "https://a", "2024", "", "x, y"), ("s2", "https://b", None, "t", None), ("s3", "", None, None, None)], "id string, url string, accessed string, title string, supports string")
    out = curation.records_from_rows(rows, sources, facets={"Size": "size"})
    return out.select("id", "title", "authors", "is_open_access", F.col("facets")["size"].alias("size_facet"), F.transform("sources", lambda s: s["url"]).alias("urls"), F.col("tool.maintainer").alias("maintainer"), F.col("tool.languages").alias("languages"), F.col("tool").isNull().alias("no_tool"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS "ID *", s_name AS "Title *", 'preprint' AS "Resource Type *", CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS "Authors", s_suppkey % 7 = 0 AS "Borrowed Background", 'preprint' AS "F1 Artifact Type", ['legal', 'social'] AS "F7 Control Type", CASE WHEN s_suppkey % 3 = 0 THEN 'mcp, a2a' END AS "Tool: Protocols", CASE WHEN s_suppkey % 4 > 0 THEN list_transform(range(s_suppkey % 4, 0, -1), lambda x: 'row' || x) END AS "Sources", true AS "Published" FROM supplier""")
def rows_from_records(spark, d):
    k = F.col("pos")
    res = _resources(spark, d).withColumn("id", _s("resource:", F.col("id"))).withColumn("facets", F.create_map(F.lit("artifact_type"), F.array(F.lit("preprint")), F.lit("control_type"), F.array(F.lit("legal"), F.lit("social"))))
    res = res.withColumn("tool", F.when(k % 3 == 0, F.struct(F.array(F.lit("mcp"), F.lit("a2a")).alias("protocols")))).withColumn("sources", F.transform(F.sequence(k % 4, F.lit(0), F.lit(-1)), lambda n: F.struct(_s("https://", n).alias("url"))))
    ids = spark.range(1, 9).select(_s("https://", F.col("id")).alias("url"), _s("row", F.col("id")).alias("id"))
    return curation.rows_from_records(res, ids).select("ID *", "Title *", "Resource Type *", "Authors", "Borrowed Background", "F1 Artifact Type", "F7 Control Type", "Tool: Protocols", "Sources", "Published")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'https://p/' || p_partkey END AS url FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 10 <> 0")
def push_plan(spark, d):
    k = F.col("p_partkey")
    own = _t(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, _s("https://p/", k)).alias("url"))
    rows = _t(spark, d, "part").where("p_partkey % 3 = 0 OR p_partkey % 10 = 0").select(F.when(k % 3 == 0, k).alias("id"), F.when(k % 10 == 0, _s("https://p/", k)).otherwise("").alias("url"))
    return curation.push_plan(own, rows).select("id", "url")


_SYNC = """r AS (SELECT p_partkey AS id, p_partkey % 6 <> 0 AS published, CASE WHEN p_partkey % {broken} = 3 THEN 'no title' END AS problem FROM part),
valid AS (SELECT id FROM r WHERE published AND problem IS NULL), managed AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25),
gone AS (SELECT id FROM managed WHERE id NOT IN (SELECT id FROM valid)), g AS (SELECT count(*) >= 5 AND (SELECT count(*) FROM gone) > 0.25 * count(*) AS refused FROM managed)
SELECT id, 'upsert' AS action FROM valid, g WHERE NOT refused UNION ALL SELECT id, CASE WHEN refused THEN 'refuse' ELSE 'delete' END FROM gone, g UNION ALL SELECT id, 'skip' FROM r WHERE published AND problem IS NOT NULL"""


def _sync(spark, d, broken: int):
    k, part = F.col("p_partkey"), _t(spark, d, "part")
    rows = part.select(k.alias("id"), (k % 6 != 0).alias("published"), F.when(k % broken == 3, "no title").alias("problem"))
    return curation.sync_plan(rows, part.where("p_size <= 25").select(k.alias("id")))


@query("WITH " + _SYNC.format(broken=40))
def sync_plan(spark, d):
    return _sync(spark, d, 40)


@query("WITH " + _SYNC.format(broken=4))
def sync_plan_refused(spark, d):
    """Too many records would go, so nothing is written."""
    return _sync(spark, d, 4)


@query("""SELECT 'f' || p_size AS field, unnest(CASE WHEN p_size % 5 = 0 THEN ['missing field'] WHEN p_size % 7 = 0 THEN ['extra field'] WHEN p_size % 3 = 0 THEN ['is text, not select', 'missing options: a', 'extra options: c'] ELSE ['missing options: a', 'extra options: c'] END) AS problem FROM (SELECT DISTINCT p_size FROM part)""")
def schema_problems(spark, d):
    n = F.col("p_size")
    sizes = _t(spark, d, "part").select("p_size").distinct()
    wanted = sizes.where("p_size % 7 <> 0 OR p_size % 5 = 0").select(_s("f", n).alias("field"), F.lit("select").alias("kind"), F.array(F.lit("b"), F.lit("a")).alias("options"))
    there = sizes.where("p_size % 5 <> 0").select(_s("f", n).alias("field"), F.when(n % 3 == 0, "text").otherwise("select").alias("kind"), F.array(F.lit("c"), F.lit("b")).alias("options"))
    return curation.schema_problems(wanted, there)


_GRAPH_SQL = f"{_TOPICS_SQL}, au AS (SELECT id, 'p' || id % 20 AS name FROM filed)"


@query(f"""WITH {_GRAPH_SQL}, w AS (SELECT name, split_part(code, '.', 1) AS section, count(*) AS k FROM au JOIN filed USING (id) GROUP BY ALL)
SELECT 'topic:' || code AS id, 'topic' AS kind, title AS label, split_part(code, '.', 1) AS section, NULL::BIGINT AS n FROM topics UNION ALL SELECT CAST(id AS VARCHAR), 'resource', 'r' || id, split_part(code, '.', 1), NULL FROM filed
UNION ALL SELECT 'person:' || name, 'author', name, (SELECT arg_min(section, (-k, CAST(section AS INT))) FROM w WHERE w.name = au.name), count(*) FROM au GROUP BY name UNION ALL SELECT conv_id || ':' || turn, 'claim', role, NULL, NULL FROM conversations""")
def graph_nodes(spark, d):
    filed = _filed(spark, d).withColumn("id", F.col("id").cast("string"))
    authors = filed.select("id", _s("p", F.col("id").cast("int") % 20).alias("name"))
    claims = _claims(spark, d).select("id", F.col("role").alias("text"), "resource_id")
    return payloads.graph_nodes(_topics(spark, d), filed.select("id", _s("r", F.col("id")).alias("title"), "code"), authors, claims)


@query(f"""WITH {_GRAPH_SQL}, {_COUPLING} SELECT 'topic:' || split_part(code, '.', 1) AS source, 'topic:' || code AS target, 'parent' AS kind, NULL::DOUBLE AS score FROM topics WHERE contains(code, '.')
UNION ALL SELECT CAST(id AS VARCHAR), 'topic:' || code, 'tagged', NULL FROM filed WHERE code IN (SELECT code FROM topics) UNION ALL SELECT 'person:' || name, CAST(id AS VARCHAR), 'wrote', NULL FROM au
UNION ALL SELECT CAST(source AS VARCHAR), CAST(target AS VARCHAR), 'similar', round(score, 3) FROM coupled UNION ALL SELECT CAST(conv_id AS VARCHAR), conv_id || ':' || turn, 'claim', NULL FROM conversations UNION ALL SELECT conv_id || ':' || turn, 'topic:' || (conv_id % 5 + 1), 'about', NULL FROM conversations""")
def graph_links(spark, d):
    topics, filed = _topics(spark, d), _filed(spark, d)
    edges = graph.parent_edges(topics).unionByName(graph.tagged_edges(filed, topics)).unionByName(graph.claim_edges(_claims(spark, d), topics)).unionByName(graph.as_edges(_r6(citations.similarity_edges(_refs(spark, d)), "score")))
    return payloads.graph_links(edges, graph.wrote_edges(filed.select(F.col("id").cast("string").alias("id"), _s("p", F.col("id") % 20).alias("name"))))


@query(f"""WITH {_BM25_SQL}, e AS (SELECT code, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM td), f AS (SELECT term, min((list_transform(string_split(code, '.'), lambda x: CAST(x AS INT)), p)) AS place FROM e GROUP BY term)
SELECT f.term, row_number() OVER (ORDER BY place) - 1 AS term_id, round(ln(1 + (nt - df + 0.5) / (df + 0.5)), 3) AS idf FROM f JOIN df USING (term), st""")
def term_index(spark, d):
    return payloads.term_index(_bench(spark, d))


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars <= 300, doc_id) AS place FROM documents")
def site_order(spark, d):
    return payloads.site_order(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 300, "x").otherwise("").alias("abstract"))).select("id", "place")


@query("SELECT page_id AS id, left(sha256(html), 8) AS stamp FROM pages")
def page_stamp(spark, d):
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), payloads.page_stamp(F.col("html")).alias("stamp"))


@query(f"""WITH {_TOPICS_SQL} SELECT 'topic' AS kind, code AS id, '{{"title":"' || title || '","id":"' || code || '","kind":"topic"}}' AS value FROM topics UNION ALL SELECT 'resource', CAST(s_suppkey AS VARCHAR), '{{"id":"' || s_suppkey || '","title":"' || s_name || '","kind":"resource"}}' FROM supplier""".replace("""'{"title":"' || title || '","id":"' || code || '","kind":"topic"}'""", """'{"id":"' || code || '","title":"' || title || '","kind":"topic"}'"""))
def node_lines(spark, d):
    nodes = graph.node_records(topic=_topics(spark, d).select(F.col("code").alias("id"), "title", F.array().cast("array<string>").alias("subpoints")), resource=_t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.lit("").alias("doi")))
    return writers.json_rows(nodes.select("id", "title", "kind", "subpoints", "doi"), ["kind", "id"])


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS resource_id, '{"cited_by_count":' || max(l_linenumber) || ',"key":null,"referenced_works":["' || array_to_string(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))), '","') || '"],"resource_id":"' || l_orderkey || '","source":"s2"}' AS value FROM lineitem GROUP BY l_orderkey""")
def store_lines(spark, d):
    store = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("resource_id")).agg(F.lit(None).cast("string").alias("key"), F.lit("s2").alias("source"), F.max("l_linenumber").alias("cited_by_count"), F.collect_set(F.col("l_partkey").cast("string")).alias("referenced_works"))
    return writers.store_lines(store)


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'https://api.openalex.org/works/W' || p_partkey WHEN 1 THEN 'https://api.openalex.org/works/https://doi.org/10.48550/arXiv.2101.0000' || p_partkey % 10 WHEN 2 THEN 'https://api.openalex.org/works/https://doi.org/10.5555/x' || p_partkey END AS url, 'W' || p_partkey AS short FROM part")
def lookup_urls(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, _s(" W", k)).when(k % 4 == 1, _s("2101.0000", k % 10, "v2")).when(k % 4 == 2, _s("10.5555/x", k)).otherwise("none")
    return _t(spark, d, "part").select(k.alias("id"), T.lookup_url(raw).alias("url"), T.short_id(_s("https://openalex.org/W", k, "/")).alias("short"))


@query("SELECT p_partkey AS id, 'a-' || p_partkey || '.yml' AS file, CASE WHEN p_size <= 9 THEN 'short' WHEN length(p_name) <= 4 THEN 'word ' || p_name ELSE left('word ' || p_name, 9 - position(' ' IN reverse(left('word ' || p_name, 9)))) || '…' END AS brief, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def small_text_forms(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), filing.record_file(_s("resource:a:", F.col("p_partkey"))).alias("file"), T.truncated(F.when(F.col("p_size") > 9, _s("word ", F.col("p_name"))).otherwise("short"), 9).alias("brief"), T.blank_to_null(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))).alias("brand"))


_SNAP_INDEX = "a AS (SELECT doc_id AS url, n_chars, doc_id % 9 = 0 AS held FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_SNAP_INDEX} SELECT url FROM a WHERE held")
def promoted_tools(spark, d):
    return review.promoted(_snapshots(spark, d)[0]).select("url")


@query("SELECT p_partkey AS url FROM part WHERE p_partkey % 9 <> 0 AND p_size % 3 = 0")
def tool_candidates(spark, d):
    k = F.col("p_partkey")
    index = _t(spark, d, "part").select(k.alias("url"), F.when(k % 9 == 0, "r").alias("promoted_to"), F.when(F.col("p_size") % 3 == 0, "An agent with a budget of its own").otherwise("A parser for tables").alias("description"))
    return review.tool_candidates(index).select("url")


@query("SELECT 'member:' || user_id AS source_id, CAST(event_id AS VARCHAR) AS target_id, 'RELATED_TO' AS relation, CASE WHEN event_type = 'purchase' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence_class FROM events WHERE event_type IN ('purchase', 'click')")
def trust_edges(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("member"), F.col("event_id").cast("string").alias("id"), "event_type")
    return graph.trust_edges(e.where("event_type = 'purchase'"), e.where("event_type = 'click'")).select("source_id", "target_id", "relation", "confidence_class")


@query("SELECT DISTINCT 'person:' || c_mktsegment AS source_id, CAST(c_nationkey AS VARCHAR) AS target_id, 'WROTE' AS relation FROM customer")
def wrote_edges(spark, d):
    return graph.wrote_edges(_t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_mktsegment").alias("name")))


@query("SELECT item_id AS quote_id, CASE WHEN item_id % 3 = 0 THEN 'results' ELSE 'abstract' END AS kind FROM benchmark WHERE item_id % 5 <> 0")
def quote_sections(spark, d):
    b, k = _t(spark, d, "benchmark"), F.col("item_id")
    parts = b.select(k.alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("abstract").alias("kind"), F.when(k % 3 != 0, _s("x  ", F.col("text"))).otherwise("none").alias("text")), F.struct(F.lit(1).alias("pos"), F.lit("results").alias("kind"), _s(F.col("text"), "\n y").alias("text")))).alias("p")).select("id", "p.*")
    quotes = b.select(k.alias("quote_id"), k.alias("id"), F.when(k % 5 == 0, "not there").otherwise(F.col("text")).alias("text"))
    return fulltext.first_section(quotes, parts)


@query("SELECT conv_id AS id, turn AS pos, CASE WHEN turn % 2 = 0 THEN 'Ana María Lund' ELSE 'Bo Ek' || turn END AS name FROM conversations")
def reconcile_bylines(spark, d):
    c = _t(spark, d, "conversations")
    even = F.col("turn") % 2 == 0
    theirs = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.when(even, "Ana Maria Lund").otherwise(_s("Bo Ek", F.col("turn"))).alias("name"))
    ours = c.where(even).select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.lit("Ana María Lund").alias("name")).dropDuplicates(["id"]).withColumn("pos", F.lit(0).cast("long"))
    return people.reconcile(ours, theirs)[0]


_NEED = _BM25_SQL.replace("AS w FROM documents", "AS w FROM (SELECT item_id AS doc_id, text FROM benchmark)")


@query(f"""WITH {_NEED}, t AS (SELECT id AS need, code, rank FROM rk WHERE rank <= 4 AND score >= 4.0), low AS (SELECT * FROM sc WHERE score >= 0.5),
lp AS (SELECT * FROM low a WHERE NOT EXISTS (SELECT 1 FROM low b WHERE b.id = a.id AND b.code LIKE a.code || '.%')),
lt AS (SELECT id AS need, code, row_number() OVER (PARTITION BY id ORDER BY score DESC, list_transform(string_split(code, '.'), lambda x: CAST(x AS INT))) AS rank FROM lp QUALIFY rank <= 4),
w AS (SELECT DISTINCT item_id AS need, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM benchmark),
f AS (SELECT DISTINCT need, CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'tool' ELSE 'paper' END AS kind, 100000 - p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id FROM part JOIN lt ON code = (p_partkey % 4 + 1) || '.' || (p_partkey % 40 + 1)
  UNION SELECT w.need, 'unassessed', doc_id, CAST(doc_id AS VARCHAR) FROM w JOIN documents ON len(word) > 3 AND (contains(lower(text), word) OR contains(lower(source), word)) WHERE need IN (SELECT need FROM lt))
SELECT need, 'topic' AS kind, rank AS place, code AS id FROM lt UNION ALL SELECT * FROM (SELECT need, kind, row_number() OVER (PARTITION BY need, kind ORDER BY pos, id) AS place, id FROM f) WHERE place <= 8""")
def tools_for(spark, d):
    """Every benchmark item as a need; parts as records from the last to the first, documents as the mirrored list."""
    k = F.col("p_partkey")
    part = _t(spark, d, "part").select(k.alias("id"), (100000 - k).alias("pos"), F.when(F.col("p_size") % 2 == 0, "framework").otherwise("preprint").alias("resource_type"), (F.col("p_size") % 5 == 0).alias("has_tool"), F.array(_s(k % 4 + 1, ".", k % 40 + 1)).alias("taxonomy_topics"))
    mirror = _t(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("doc_id").alias("pos"), F.col("source").alias("name"), F.col("text").alias("description"))
    return retrieval.tools_for(retrieval.TopicIndex(_bench(spark, d)), _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), part, mirror)


@query(f"WITH {_TOPICS_SQL} SELECT count(*) AS topics, CAST(2 * count(*) AS BIGINT) AS subpoints, 0::BIGINT AS coding_scheme FROM topics")
def taxonomy_totals(spark, d):
    return graph.taxonomy_totals(_topics(spark, d).withColumn("subpoints", F.array(F.lit("a"), F.lit("b"))))


@query("""SELECT p_partkey AS id, (CASE WHEN contains(lower(p_name), '1') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_brand), '1') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), '1') THEN 1 ELSE 0 END) AS score FROM part WHERE false""")
def search_records_none(spark, d):
    """A term of one letter finds nothing."""
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("abstract"), F.lit(None).cast("string").alias("description"))
    return retrieval.search_records(part, " 1 ", 10)


@query("""WITH s AS (SELECT p_partkey AS id, (CASE WHEN contains(lower(p_name), 'an') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'an') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'an') THEN 1 ELSE 0 END) AS score FROM part)
SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def search_records_top(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("abstract"), F.lit(None).cast("string").alias("description"))
    return retrieval.search_records(part, " An", 25)


@query(f"WITH {_COUPLING} SELECT source AS source_id, target AS target_id, score FROM coupled ORDER BY score DESC, shared DESC, source, target LIMIT 50")
def similarity_edges_top(spark, d):
    return citations.similarity_edges(_refs(spark, d), None, 2, 50).select("source_id", "target_id", F.round("score", 6).alias("score"))


@query("SELECT lang AS doc, list(code ORDER BY code) AS codes, count(*) AS topics FROM (SELECT DISTINCT lang, CAST(doc_id % 9 + 1 AS VARCHAR) AS code FROM documents WHERE lang IS NOT NULL) GROUP BY lang")
def taxonomy_lines(spark, d):
    """Markdown made of documents' numbers: headings with bold marks, each code more than once, fences and bullets between."""
    k = F.col("doc_id")
    rows = _t(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("doc"), F.explode(F.array(F.struct((k * 4).alias("pos"), F.lit("```").alias("line")), F.struct((k * 4 + 1).alias("pos"), F.lit("99 not a topic").alias("line")), F.struct((k * 4 + 2).alias("pos"), F.lit("```").alias("line")), F.struct((k * 4 + 3).alias("pos"), _s("## **", k % 9 + 1, ".** Title ", k % 9 + 1, ":").alias("line")))).alias("x")).select("doc", "x.*")
    topics = readers.taxonomy_topics(rows)
    return topics.where(F.col("title") == _s("Title ", F.col("code"))).groupBy("doc").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.count(F.lit(1)).alias("topics"))


@query("""WITH q AS (SELECT DISTINCT text[1:instr(text || ' ', ' ') - 1] AS word FROM conversations UNION SELECT DISTINCT left(role, 2) FROM conversations)
SELECT word AS query_id, doc_id AS text_id FROM q JOIN documents ON contains(text, word) WHERE word <> ''""")
def substring_matches(spark, d):
    """The first words of all turns, and two signs of each role, in all documents."""
    c = _t(spark, d, "conversations")
    words = c.select(F.substring_index("text", " ", 1).alias("word")).union(c.select(F.substring("role", 1, 2))).distinct()
    return search.substring_matches(words.select(F.col("word").alias("query_id"), "word"), _t(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query("""WITH q AS (SELECT conv_id * 100 + turn AS quote_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[2:3], ' ') AS quote FROM conversations),
s AS (SELECT doc_id AS source_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS t FROM documents)
SELECT quote_id, source_id FROM q JOIN s ON contains(t, quote) WHERE quote <> ''""")
def short_quotes(spark, d):
    """The second and third word of each turn, as a quote."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    quotes = _t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("quote_id"), F.array_join(F.slice(words, 2, 2), " ").alias("text"))
    return fulltext.verbatim(quotes, _t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, value) - 1 AS place, value FROM (SELECT *, '{"source_id":' || l_orderkey || ',"target_id":' || l_partkey || ',"line":' || l_linenumber || '}' AS value FROM lineitem))
SELECT place // 1000 AS file, count(*) AS n, sha256(string_agg(value, chr(10) ORDER BY place) || chr(10)) AS sha256 FROM l GROUP BY 1""")
def release_files(spark, d):
    """What the files of a release are, byte by byte: lines in exact order, cut at each thousandth."""
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("line"))
    return writers.file_digests(writers.cut_lines(rows, ["source_id", "line"], 1000))


_CODED = """e AS (SELECT code, unnest(t) AS term, generate_subscripts(t, 1) AS p FROM td), f AS (SELECT term, min((list_transform(string_split(code, '.'), lambda x: CAST(x AS INT)), p)) AS place FROM e GROUP BY term),
ids AS (SELECT f.term, row_number() OVER (ORDER BY place) - 1 AS term_id, df, round(ln(1 + (nt - df + 0.5) / (df + 0.5)), 3) AS idf FROM f JOIN df USING (term), st)"""


@query(f"WITH {_BM25_SQL}, {_CODED} SELECT td.code, coalesce(list(term_id ORDER BY p) FILTER (term_id IS NOT NULL), []) AS ids, any_value(len(t)) AS length FROM td LEFT JOIN e ON e.code = td.code LEFT JOIN ids USING (term) GROUP BY td.code")
def coded_topics(spark, d):
    return payloads.CodedIndex(_bench(spark, d)).topics


@query(f"""WITH {_BM25_SQL}, {_CODED} SELECT id, tf.code, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.4 + 0.6 * len(t) / round(ml, 2)))), 6) AS score
FROM dq JOIN tf USING (term) JOIN td ON td.code = tf.code JOIN ids ON ids.term = tf.term, st GROUP BY ALL""")
def coded_scores(spark, d):
    """The scorer of the coded index on all documents; a test holds it against TopicIndex.score."""
    return payloads.CodedIndex(_bench(spark, d)).score(_texts(spark, d))


@query(f"""WITH {_BM25_SQL}, low AS (SELECT * FROM sc WHERE score >= 0.5), lp AS (SELECT * FROM low a WHERE NOT EXISTS (SELECT 1 FROM low b WHERE b.id = a.id AND b.code LIKE a.code || '.%')),
r AS (SELECT id, code, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, list_transform(string_split(code, '.'), lambda x: CAST(x AS INT))) AS rank FROM lp),
s AS (SELECT *, rank <= 2 OR rank <= 6 AND score >= 0.7 * max(score) OVER (PARTITION BY id) AS shown FROM r WHERE rank <= 14),
g AS (SELECT id, list(code ORDER BY rank) FILTER (shown) AS a, list(code ORDER BY rank) FILTER (NOT shown) AS b FROM s GROUP BY id),
c AS (SELECT conv_id, list(role || ':' || turn ORDER BY turn) AS said FROM conversations GROUP BY conv_id)
SELECT row_number() OVER (ORDER BY doc_id % 4 = 0, doc_id) AS place, doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' WHEN length(text) > 1100 THEN CASE WHEN contains(left(text, 1100), ' ') THEN regexp_replace(left(text, 1100), ' [^ ]*$', '', 's') ELSE left(text, 1100) END || '…' ELSE text END AS abstract,
  coalesce(a, []) AS suggested, coalesce(b, []) AS suggested_more, coalesce(said, []) AS claims FROM documents LEFT JOIN g ON g.id = doc_id LEFT JOIN c ON conv_id = doc_id""")
def site_records(spark, d):
    """Documents as records, each fourth without an abstract; turns of the conversation of their number as claims."""
    k, none, some = F.col("doc_id"), F.lit(None).cast("string"), F.array().cast("array<string>")
    docs = _t(spark, d, "documents").select(k.alias("id"), F.col("source").alias("title"), F.when(k % 4 != 0, F.col("text")).alias("abstract"), none.alias("description"), some.alias("authors"), none.alias("published_at"), none.alias("url"), F.lit("preprint").alias("resource_type"), none.alias("doi"), none.alias("arxiv_id"), none.alias("repository_url"), some.alias("taxonomy_topics"))
    ranked = retrieval.TopicIndex(_bench(spark, d)).classify(_texts(spark, d), payloads.SUGGESTIONS, payloads.SUGGESTION_SCORE)
    claims = _t(spark, d, "conversations").select(F.col("conv_id").alias("resource_id"), F.col("turn").alias("pos"), _s(F.col("role"), ":", F.col("turn")).alias("id"), "text", none.alias("standalone"), none.alias("quote"), none.alias("extracted_from"), none.alias("claim_type"), some.alias("topic_codes"), none.alias("verdict"), none.alias("reviewed_by"))
    out = payloads.site_records(docs, ranked, claims)
    return out.select("place", "id", "abstract", "suggested", "suggested_more", F.transform("claims", lambda c: c["id"]).alias("claims"))


@query("""SELECT 's' || s_suppkey AS url, 'd' || s_suppkey AS accessed, CASE WHEN s_suppkey % 2 = 0 THEN 'a, b' END AS supports FROM supplier WHERE s_suppkey % 3 <> 0""")
def fresh_sources(spark, d):
    """Each source stands in two records, and a third of them has a row."""
    k = F.col("s_suppkey")
    source = F.struct(_s("s", k).alias("url"), _s("d", k).alias("accessed"), F.lit(None).cast("string").alias("title"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("supports"))
    one = _t(spark, d, "supplier").select(_s("r", k).alias("id"), F.array(source).alias("sources"))
    again = _t(spark, d, "supplier").select(_s("s", k).alias("id"), F.array(source.withField("accessed", F.lit("later"))).alias("sources"))
    held = _t(spark, d, "supplier").where("s_suppkey % 3 = 0").select(_s("s", k).alias("url"), _s("row", k).alias("id"))
    return curation.fresh_sources(one.unionByName(again), held).select("url", "accessed", "supports")


@query("""SELECT p_partkey AS id, f AS facet, CASE f WHEN 'shade' THEN 'unknown facet' WHEN 'artifact_type' THEN 'takes a single value' ELSE 'no value x' || p_size END AS problem
FROM (SELECT *, unnest(['shade', 'artifact_type', 'control_type']) AS f FROM part) WHERE CASE f WHEN 'shade' THEN p_size % 4 = 1 WHEN 'artifact_type' THEN p_size % 3 = 0 ELSE p_size % 5 = 2 END""")
def facet_problems(spark, d):
    n, one = F.col("p_size"), lambda *v: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v])
    facets = F.map_filter(F.create_map(F.lit("shade"), F.when(n % 4 == 1, one("dark")), F.lit("artifact_type"), F.when(n % 3 == 0, one("preprint", "essay")).otherwise(one("dataset")), F.lit("control_type"), F.when(n % 5 == 2, one("legal", _s("x", n))).otherwise(one("legal", "social"))), lambda _, v: v.isNotNull())
    return review.facet_problems(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), facets.alias("facets")))


@query("""SELECT c_custkey AS id, unnest(CASE c_custkey % 3 WHEN 0 THEN ['identifier', 'summary', 'topics'] WHEN 1 THEN ['title', 'license'] ELSE ['name', 'why'] END) AS key,
unnest(CASE c_custkey % 3 WHEN 0 THEN ['10.5555/' || c_custkey, 'It does' || chr(10) || c_name, '1.1, ' || c_nationkey] WHEN 1 THEN ['T' || c_custkey, 'MIT'] ELSE [c_name, 'good' || chr(10) || 'and more'] END) AS value FROM customer""")
def form_fields(spark, d):
    """Customers' forms in the three shapes that come in."""
    k, name = F.col("c_custkey"), F.col("c_name")
    form = _s("### DOI, arXiv ID, or link\n\n10.5555/", k, "\n\n### What does it do?\n\nIt does\n", name, "\n\n### License and source\n\n_No response_\n## Topics (if you already know them)\n1.1, ", F.col("c_nationkey"))
    paper = _s("**Title:** T", k, "\nstray line\n**License:** MIT\n**Maintainer:** n/a\n**Unknown:** x")
    tool = _s("Hello\n**Name:** ", name, "\n**Why does it belong**\ngood\n\n#### Something else\nnot this\n### Notes\nand more\n")
    body = F.when(k % 3 == 0, form).when(k % 3 == 1, paper).otherwise(F.regexp_replace(tool, "good\n\n", "good\n"))
    return readers.parse_forms(_t(spark, d, "customer").select(k.alias("id"), body.alias("body")))


@query(f"""WITH {_TOPICS_SQL} SELECT 'parent missing' AS rule, '77' AS code UNION ALL SELECT 'usage mode', code FROM topics WHERE code LIKE '2.%' UNION ALL SELECT 'section missing', CAST(unnest(range(6, {fixed.SECTION_COUNT + 1})) AS VARCHAR) UNION ALL SELECT 'section unknown', '88'""")
def taxonomy_problems(spark, d):
    more = spark.createDataFrame([("77.1",), ("88",)], "code string")
    topics = _topics(spark, d).select("code").union(more).withColumn("usage_mode", F.when(F.col("code").like("2.%"), "coding-scheme").otherwise("navigation"))
    return readers.taxonomy_problems(topics)


@query(f"""WITH {_NAMES_SQL} SELECT fold, count(DISTINCT name) AS variants, count(*) AS n FROM folded GROUP BY fold HAVING count(DISTINCT name) > 1""")
def duplicate_names(spark, d):
    return people.duplicate_names(_names(spark, d)).select("fold", "variants", "n")


@query(f"""SELECT p_partkey AS id, '{fixed.SECOND_SOURCE}' || CASE p_partkey % 5 WHEN 1 THEN 'arXiv:2101.0000' || p_partkey % 10 WHEN 2 THEN 'DOI:10.5555/x' || p_partkey WHEN 3 THEN 'abc' || p_partkey END || '?fields={','.join(fixed.SECOND_SOURCE_FIELDS)}' AS url FROM part""")
def paper_urls(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, _s(" W", k)).when(k % 5 == 1, _s("2101.0000", k % 10, "v2")).when(k % 5 == 2, _s(" 10.5555/x", k)).when(k % 5 == 3, _s("abc", k)).otherwise(" ")
    return _t(spark, d, "part").select(k.alias("id"), T.paper_url(raw).alias("url"))
