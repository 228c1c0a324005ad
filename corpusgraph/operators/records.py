"""Single records and claims as a reader sees them, and how the corpus fills and grows its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.staging import staged
from . import citations, retrieval, review

CLAIM_BRIEF = {
    "id": "id", "of_record": "resource_id", "claim": "text", "in_context": "standalone", "type": "claim_type", "quoted_from_the_paper": "quote", "read_from": "extracted_from",
    "extracted_by": "extraction_method", "suggests_topics": "topic_codes", "review_status": "review_status", "verdict": "verdict", "verified_by": "reviewed_by",
}


def claim_brief(claims: DataFrame) -> DataFrame:
    """Claims under the names that readers get, always with the sentence each was read from."""
    return claims.select(*[F.col(old).alias(new) for new, old in CLAIM_BRIEF.items()])


def record_brief(resources: DataFrame, claims: DataFrame, with_claims: bool = False) -> DataFrame:
    """One row a record with its number of claims; texts that are missing are "", missing lists are empty.

    `with_claims` adds the claims themselves, in the order of their ids, as an array of structs.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    own = claims.groupBy(F.col("resource_id").alias("id"))
    briefs = claim_brief(claims)
    if with_claims:
        per = briefs.groupBy(F.col("of_record").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*briefs.columns))).alias("claims"))
    else:
        per = own.agg(F.count(F.lit(1)).alias("n"))
    out = resources.join(per, "id", "left").select(
        "id", "title", F.col("resource_type").alias("type"), some("authors").alias("authors"), text("published_at").alias("published"), text("url").alias("url"), text("doi").alias("doi"),
        text("arxiv_id").alias("arxiv_id"), some("taxonomy_topics").alias("filed_under"), "review_status", "is_borrowed_background", F.col("source_provenance").alias("provenance"),
        F.coalesce("n", F.lit(0)).alias("claims_extracted"), F.nullif(F.col("abstract"), F.lit("")).alias("abstract"), *(["claims"] if with_claims else []),
    )
    return out


def get_record(resources: DataFrame, claims: DataFrame, record) -> DataFrame:
    """The brief of one record with its claims; a row with only `error` if there is none."""
    found = record_brief(resources.where(F.col("id") == record), claims.where(F.col("resource_id") == record), with_claims=True)
    asked = resources.sparkSession.range(1).select(F.lit(record).alias("id"))
    return asked.join(found, "id", "left").withColumn("error", F.when(F.col("claims_extracted").isNull(), F.concat(F.col("id").cast("string"), F.lit(" is not a record in this corpus"))))


def load_claims(files: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Claims of files(resource_id, claims), each a list of structs, under the verdicts on them; no verdict leaves a claim as it is."""
    claims = files.select("resource_id", F.explode("claims").alias("c")).select("resource_id", "c.*")
    return claims if verdicts is None else review.apply_verdicts(claims, verdicts)


def topic_texts(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """(code, text) of topics(code, title, subpoints, description): what a topic is found by.

    Title, subpoints, aliases(code, aliases), titles of the topics above from the top, description: joined by
    spaces in this order, so that phrases may cross from one to the next.
    """
    named = topics.select(F.col("code").alias("above"), F.col("title").alias("t"))
    up = topics.select("code", F.posexplode(T.ancestors(F.col("code"))).alias("p", "above")).join(named, "above").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("up"))
    out = topics.join(aliases.select("code", "aliases"), "code", "left").join(up, "code", "left")
    parts = [F.array("title"), F.col("subpoints"), F.col("aliases"), F.transform("up", lambda x: x["t"]), F.array(F.nullif(F.col("description"), F.lit("")))]
    none = F.array().cast("array<string>")
    return out.select("code", F.array_join(F.concat(*[F.coalesce(p, none) for p in parts]), " ").alias("text"))


def classify_resources(index: retrieval.TopicIndex, resources: DataFrame, **options) -> DataFrame:
    """Topics for resources(id, title, description, abstract), by these three texts alone."""
    return index.classify(resources.select("id", retrieval.resource_text(F.col("title"), F.col("description"), F.col("abstract")).alias("text")), **options)


def evaluate(index: retrieval.TopicIndex, resources: DataFrame, gold: DataFrame, limit: int = 6, min_score: float = 4.0) -> DataFrame:
    """Agreement of the classifier with gold(id, code), over the records that have gold; `few` if they are under thirty."""
    held = resources.join(gold.select("id").distinct(), "id", "left_semi")
    found = classify_resources(index, held, limit=limit, min_score=min_score).select("id", "code")
    return review.agreement(gold.join(held.select("id"), "id", "left_semi"), found).withColumn("few", F.col("records") < 30)


def fill_only(curated: DataFrame, fetched: DataFrame, key: str = "id", refresh: bool = True, skip: DataFrame | None = None) -> DataFrame:
    """curated with fetched values where its own are missing: null, "", an empty list or map, or false.

    Without `refresh`, rows whose key is in skip(key) keep what they have.
    """
    def empty(c: Column, kind: str) -> Column:
        if kind == "string":
            return c.isNull() | (c == "")
        if kind.startswith(("array", "map")):
            return c.isNull() | (F.size(c) == 0)
        return c.isNull() | (~c if kind == "boolean" else F.lit(False))

    new = [c for c in fetched.columns if c != key]
    side = fetched.select(key, *[F.col(c).alias(f"_new_{c}") for c in new])
    if skip is not None and not refresh:
        side = side.join(skip.select(key), key, "left_anti")
    kinds = dict(curated.dtypes)
    value = lambda c: F.when(empty(F.col(c), kinds[c]) & ~empty(F.col(f"_new_{c}"), kinds[c]), F.col(f"_new_{c}")).otherwise(F.col(c))
    return curated.join(side, key, "left").select(*[value(c).alias(c) if c in new else F.col(c) for c in curated.columns])


def seeds(resources: DataFrame, store: DataFrame, most: int, borrowed: bool = False) -> DataFrame:
    """(openalex_id, cited_by_count): where expansion starts, the most cited first; borrowed background only on request."""
    pool = resources.where(F.col("openalex_id").isNotNull() & (F.lit(borrowed) | ~F.coalesce("is_borrowed_background", F.lit(False))))
    counts = store.select(F.col("resource_id").alias("id"), "cited_by_count")
    rated = pool.join(counts, "id", "left").select("id", "openalex_id", F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))
    return rated.orderBy(F.desc("cited_by_count"), "id").limit(most).select("openalex_id", "cited_by_count")


def expand(found: DataFrame, refs: DataFrame, works: DataFrame, known: DataFrame, min_count: int = 3, structural: int | None = 40, limit: int | None = None) -> DataFrame:
    """(work, title, cited_by, score, found_via): neighbours found by words, and works the corpus cites often, with three for each citation.

    found(work, title, cited_by, score, found_via) are the neighbours, works(id, title, abstract, cited_by) what is known of any
    work, known(id) what the corpus holds.  A neighbour is not added again.
    """
    found = staged(found, "found")  # read twice below
    often = citations.structural_candidates(refs, known.select(F.col("id").alias("ref")), min_count, structural).select(F.col("ref").alias("work"), F.col("cited_by").alias("n"))
    fresh = often.join(found.select("work"), "work", "left_anti").join(works.withColumnRenamed("id", "work"), "work")
    rated = fresh.select("work", "title", "cited_by", (T.scope_score(F.col("title"), F.col("abstract"))["score"] + 3 * F.col("n")).cast("long").alias("score"), F.format_string("co-cited by %d corpus papers", "n").alias("found_via"))
    both = found.select("work", "title", "cited_by", F.col("score").cast("long").alias("score"), F.col("found_via").cast("string").alias("found_via")).unionByName(rated)
    return both if limit is None else both.orderBy(F.desc("score"), F.desc("cited_by"), "work").limit(limit)


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Candidates as they are written: at most eight authors and four institutions, scores to three places."""
    return candidates.withColumns({"authors": F.slice("authors", 1, 8), "institutions": F.slice("institutions", 1, 4), "score": F.round("score", 3)})


def store_coverage(store: DataFrame) -> DataFrame:
    """One row: entries with references, and all entries."""
    return store.agg(F.count_if(F.size(F.coalesce("referenced_works", F.array().cast("array<string>"))) > 0).alias("with_references"), F.count(F.lit(1)).alias("total"))


def scholarly_edges(refs: DataFrame, held: DataFrame, min_shared: int = 2) -> DataFrame:
    """CITES between held works and SIMILAR_TO of coupled ones; refs(id, ref), held(id, key, pos)."""
    from .graph import as_edges

    cites = citations.citation_pairs(refs, held).select(F.col("citing").alias("source_id"), F.col("cited").alias("target_id"), F.lit("CITES").alias("relation"))
    similar = citations.similarity_edges(refs.join(held.select("id"), "id", "left_semi"), None, min_shared)
    return as_edges(cites).unionByName(as_edges(similar))
