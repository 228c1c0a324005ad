"""Review, evaluation and upkeep: samples, agreement, merges, mirrors, overlays, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ranks import exact_rank


def stratified_sample(resources: DataFrame, reviewed: DataFrame, limit: int) -> DataFrame:
    """(id, section, r) of resources(id, code, abstract) not yet reviewed(id): round robin over sections, abstracts first."""
    pool = resources.join(reviewed.select("id"), "id", "left_anti").withColumn("section", F.coalesce(T.section(F.col("code")), F.lit("?")))
    order = Window.partitionBy("section").orderBy(F.coalesce(F.col("abstract") == "", F.lit(True)), "id")
    return pool.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).orderBy("r", "section").limit(limit).select("id", "section", "r")


def agreement(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of hierarchy-aware recall: gold(id, code), predicted(id, code); a tag counts if equal, above or below.

    Predictions are folded once to their codes and all codes above them, an array an id, so they are worked out once.
    """
    found = predicted.where("code is not null").groupBy("id").agg(F.collect_set("code").alias("codes"), F.array_distinct(F.flatten(F.collect_set(T.ancestors(F.col("code"))))).alias("up"))
    tags = gold.where("code is not null").groupBy("id").agg(F.collect_set("code").alias("tags"))
    each = tags.join(found, "id", "left").select("id", "codes", "up", F.explode("tags").alias("code")).withColumn("own_up", T.ancestors(F.col("code")))
    exact = F.coalesce(F.array_contains("codes", F.col("code")), F.lit(False))
    hit = exact | F.coalesce(F.array_contains("up", F.col("code")), F.lit(False)) | F.coalesce(F.arrays_overlap("codes", "own_up"), F.lit(False))
    per = each.groupBy("id").agg(F.count_if(hit).alias("hits"), F.count_if(exact).alias("exact"), F.count(F.lit(1)).alias("tags"))
    return per.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("tags"), F.lit(0)).alias("tags"), F.coalesce(F.sum("hits"), F.lit(0)).alias("recovered"), F.coalesce(F.sum("exact"), F.lit(0)).alias("exact"), F.count_if(F.col("hits") > 0).alias("records_hit"))


def claim_coverage(claims: DataFrame) -> DataFrame:
    """One row: claims, resources, reviewed, and verdicts among the reviewed; claims(resource_id, review_status, verdict)."""
    done = F.col("review_status") != "unreviewed"
    verdicts = [F.count_if(done & (F.col("verdict") == v)).alias(v.replace("-", "_")) for v in fixed.CLAIM_VERDICTS]
    return claims.agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("resource_id").alias("resources"), F.count_if(done).alias("reviewed"), *verdicts)


def get_claims(claims: DataFrame, record=None, claim_type: str | None = None, only_unverified: bool = False, limit: int = 20) -> DataFrame:
    """(id, matched, ..) of claims(id, resource_id, claim_type, verdict, pos): the first `limit`, and how many matched."""
    if record is not None:
        claims = claims.where(F.col("resource_id") == record)
    if claim_type:
        claims = claims.where(F.col("claim_type") == claim_type)
    if only_unverified:
        claims = claims.where("verdict is null")
    matched = claims.agg(F.count(F.lit(1)).alias("matched"))
    return claims.orderBy("pos", "id").limit(limit).crossJoin(F.broadcast(matched))  # one row


def apply_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims with verdicts(id, verdict, reviewer, note): a verdict makes a claim reviewed."""
    v = verdicts.select("id", F.col("verdict").alias("v"), F.col("reviewer").alias("who"), F.col("note").alias("why"))
    out = claims.join(v, "id", "left")
    new = {"verdict": F.coalesce("v", "verdict"), "reviewed_by": F.coalesce("who", "reviewed_by"), "note": F.coalesce("why", "note"), "review_status": F.when(F.col("v").isNotNull(), "reviewed").otherwise(F.col("review_status"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in claims.columns])


def mirror_diff(before: DataFrame, after: DataFrame, key: str = "url", compared: tuple[str, ...] = ("description", "name", "section", "subsection")) -> DataFrame:
    """(key, change): added, removed and changed entries of two snapshots."""
    b, a = before.select(key, F.struct(*compared).alias("b")), after.select(key, F.struct(*compared).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def carry_promotions(before: DataFrame, after: DataFrame, key: str = "url") -> DataFrame:
    old = before.select(key, F.col("promoted_to").alias("old"))
    return after.join(old, key, "left").select(*[F.coalesce("old", "promoted_to").alias(c) if c == "promoted_to" else F.col(c) for c in after.columns])


def tool_candidates(index: DataFrame) -> DataFrame:
    """Entries not promoted whose description speaks of an agent's authority."""
    return index.where((F.coalesce("promoted_to", F.lit("")) == "") & F.col("description").rlike(fixed.AUTHORITY))


def store_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and new (resource_id, key, source, cited_by_count, referenced_works): an empty new list keeps the old list and source."""
    o = store.select("resource_id", *[F.col(c).alias(f"o_{c}") for c in ("key", "source", "cited_by_count", "referenced_works")])
    both = o.join(new, "resource_id", "full_outer")
    filled = F.size(F.coalesce("referenced_works", F.array().cast("array<string>"))) > 0
    keep = ~filled & (F.size(F.coalesce("o_referenced_works", F.array().cast("array<string>"))) > 0)
    refs = F.when(keep, F.col("o_referenced_works")).otherwise(F.coalesce("referenced_works", F.array().cast("array<string>")))
    source = F.when(keep | F.col("source").isNull(), F.col("o_source")).otherwise(F.col("source"))
    return both.select("resource_id", F.coalesce(F.nullif("key", F.lit("")), "o_key").alias("key"), source.alias("source"), F.greatest("cited_by_count", "o_cited_by_count").alias("cited_by_count"), F.sort_array(F.array_distinct(refs)).alias("referenced_works"))


def gold_merge(gold: DataFrame, filed: DataFrame) -> DataFrame:
    """(id, topics, change): filed(id, topics) replaces gold(id, topics); what isn't filed stays."""
    both = gold.withColumnRenamed("topics", "old").join(filed, "id", "full_outer")
    change = F.when(F.col("topics").isNull(), "kept").when(F.col("old").isNull(), "added").when(F.sort_array("old") == F.sort_array("topics"), "unchanged").otherwise("changed")
    return both.select("id", F.coalesce("topics", "old").alias("topics"), change.alias("change"))


def bulk_status(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(pos, raw, ident, status) of rows(pos, raw): added, held, repeated or failed; held(ident)."""
    who = rows.select("pos", "raw", T.identify(F.col("raw")).alias("i")).select("pos", "raw", F.when(F.col("i.kind") != "error", F.concat("i.kind", F.lit(":"), "i.id")).alias("ident"))
    first = F.row_number().over(Window.partitionBy("ident").orderBy("pos"))
    known = held.select("ident").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("ident").isNull(), "failed").when(F.col("known"), "held").when(F.col("r") > 1, "repeated").otherwise("added")
    return who.withColumn("r", first).join(known, "ident", "left").select("pos", "raw", "ident", status.alias("status"))


def deletion_guard(managed: DataFrame, valid: DataFrame, least: int = 5, share: float = 0.25) -> DataFrame:
    """One row: managed, removed, refused; a sync that would remove over a quarter is refused. Both (id)."""
    known = valid.select("id").distinct().withColumn("v", F.lit(1))
    out = managed.select("id").distinct().join(known, "id", "left").agg(F.count(F.lit(1)).alias("managed"), F.count_if(F.col("v").isNull()).alias("removed"))
    return out.withColumn("refused", (F.col("managed") >= least) & (F.col("removed") > share * F.col("managed")))


def affinity(authored: DataFrame, endorsed: DataFrame, weight: float = 1.0) -> DataFrame:
    """(id, affinity) = weight * sqrt(1 + 2 * authored + endorsed), of (member, id) rows."""
    both = authored.select("id", F.lit(2.0).alias("w")).unionByName(endorsed.select("id", F.lit(1.0).alias("w")))
    return both.groupBy("id").agg((F.lit(weight) * F.sqrt(1.0 + F.sum("w"))).alias("affinity"))


def trust_rerank(ranked: DataFrame, trust: DataFrame) -> DataFrame:
    """(id, score, total, rank): score plus affinity, ties by the old order (score, id)."""
    out = ranked.join(trust, "id", "left").withColumn("total", F.col("score") + F.coalesce("affinity", F.lit(0.0)))
    return exact_rank(out, [F.desc("total"), F.desc("score"), F.asc("id")], "rank", 1).select("id", "score", "total", "rank")


def facet_problems(resources: DataFrame) -> DataFrame:
    """(id, facet, problem) of resources(id, facets): unknown facets, several values where one is meant, values out of the vocabulary; the first of each facet."""
    table = F.create_map(*[x for _, name, _, values in fixed.FACETS for x in (F.lit(name), F.array(*map(F.lit, values)))])
    each = resources.select("id", F.explode("facets").alias("facet", "values"))
    strange = F.filter("values", lambda v: ~F.array_contains(table[F.col("facet")], v))
    what = (
        F.when(~F.col("facet").isin([name for _, name, _, _ in fixed.FACETS]), "unknown facet").when(F.col("facet").isin(fixed.SINGLE_VALUED_FACETS) & (F.size("values") > 1), "takes a single value")
        .when(F.size(strange) > 0, F.concat(F.lit("no value "), F.array_join(strange, ", ")))
    )
    return each.select("id", "facet", what.alias("problem")).where("problem is not null")


def promoted(index: DataFrame) -> DataFrame:
    """Entries of index(.., promoted_to) that a record of the corpus has taken up."""
    return index.where(F.coalesce("promoted_to", F.lit("")) != "")


def violations(resources: DataFrame, claims: DataFrame, topics: DataFrame) -> DataFrame:
    """(rule, id, detail): all broken rules at once.

    resources(id, taxonomy_topics, reviewed_by, review_status, resource_type, has_tool, facets), claims(id, quote, verdict,
    reviewed_by, review_status), topics(code, parent_code).
    """
    code = r"^\d+(\.\d+)*$"
    say = lambda df, rule, cond, detail, key="id": df.where(cond).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"), detail.cast("string").alias("detail"))
    facet = resources.select("id", F.explode("facets").alias("facet", "values"))
    parents = topics.where("parent_code is not null").join(topics.select(F.col("code").alias("parent_code")), "parent_code", "left_anti")
    unsigned: Column = (F.coalesce("reviewed_by", F.lit("")) != "") & (F.col("review_status") == "unreviewed")
    parts = [
        say(topics, "C1 code syntax", ~F.col("code").rlike(code), F.col("code"), "code"),
        say(topics, "C2 parent", ~F.col("parent_code").eqNullSafe(T.parent_code(F.col("code"))), F.col("parent_code"), "code"),
        say(facet, "C3 single-valued facet", F.col("facet").isin(fixed.SINGLE_VALUED_FACETS) & (F.size("values") > 1), F.col("facet")),
        say(resources, "C4 topic syntax", F.exists("taxonomy_topics", lambda c: ~c.rlike(code)), F.array_join("taxonomy_topics", ",")),
        say(resources, "C5 reviewer without review", unsigned, F.col("reviewed_by")),
        say(claims, "C5 reviewer without review", unsigned, F.col("reviewed_by")),
        say(resources, "C6 tool profile", F.col("has_tool") & ~F.col("resource_type").isin(fixed.TOOL_TYPES), F.col("resource_type")),
        say(claims, "C7 quote", F.trim(F.coalesce("quote", F.lit(""))) == "", F.lit("blank")),
        say(claims, "C7 verdict", ~F.col("verdict").isin(fixed.CLAIM_VERDICTS), F.col("verdict")),
        say(resources.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "C9 repeated id", F.col("n") > 1, F.col("n")),
        say(parents, "C10 parent missing", F.lit(True), F.col("parent_code"), "code"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
