"""Topics tree, edge builders with provenance, releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

EDGE_COLUMNS = {
    "source_id": "string", "target_id": "string", "relation": "string", "confidence_class": "string", "confidence_score": "double",
    "score": "double", "method": "string", "source_resource_id": "string", "source_location": "string",
    "extraction_method": "string", "computed_at": "string", "created_at": "string", "attribution": "string",
}


def as_edges(df: DataFrame) -> DataFrame:
    """All thirteen columns; those that `df` lacks are null."""
    return df.select(*[(F.col(k) if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in EDGE_COLUMNS.items()])


def parent_edges(topics: DataFrame) -> DataFrame:
    """PARENT_OF where the parent exists."""
    child = topics.select(F.col("code").alias("target_id"), T.parent_code(F.col("code")).alias("source_id"))
    return as_edges(child.join(topics.select(F.col("code").alias("source_id")), "source_id", "left_semi").withColumn("relation", F.lit("PARENT_OF")))


def tagged_edges(filed: DataFrame, topics: DataFrame) -> DataFrame:
    """TAGGED_WITH of filed(id, code) for known codes."""
    known = filed.join(topics.select("code"), "code", "left_semi")
    return as_edges(known.select(F.col("id").alias("source_id"), F.col("code").alias("target_id"), F.lit("TAGGED_WITH").alias("relation"), F.lit("EXTRACTED").alias("confidence_class"), F.lit("curated").alias("method")))


def unknown_tags(filed: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, codes): what is filed under codes that the taxonomy doesn't have."""
    return filed.join(topics.select("code"), "code", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def claim_edges(claims: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """MAKES_CLAIM (the claim's own confidence) and ABOUT (inferred) of claims(id, resource_id, topic_codes, confidence_class, extracted_from)."""
    makes = claims.select(F.col("resource_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("MAKES_CLAIM").alias("relation"), "confidence_class", F.col("extracted_from").alias("source_location"), F.col("resource_id").alias("source_resource_id"))
    about = claims.select(F.col("id").alias("source_id"), F.explode("topic_codes").alias("target_id"), F.lit("ABOUT").alias("relation"), F.lit("INFERRED").alias("confidence_class"), F.col("resource_id").alias("source_resource_id"))
    if topics is not None:
        about = about.join(topics.select(F.col("code").alias("target_id")), "target_id", "left_semi")
    return as_edges(makes).unionByName(as_edges(about))


def trust_edges(authored: DataFrame, endorsed: DataFrame) -> DataFrame:
    """RELATED_TO from members: authorship is extracted, endorsement inferred; both (member, id)."""
    one = lambda df, kind: df.select(F.concat(F.lit("member:"), "member").alias("source_id"), F.col("id").alias("target_id"), F.lit("RELATED_TO").alias("relation"), F.lit(kind).alias("confidence_class"))
    return as_edges(one(authored, "EXTRACTED").unionByName(one(endorsed, "INFERRED")))


def wrote_edges(authors: DataFrame) -> DataFrame:
    """WROTE from person nodes, of authors(id, name)."""
    return authors.where("name <> ''").select(F.concat(F.lit("person:"), "name").alias("source_id"), F.col("id").alias("target_id"), F.lit("WROTE").alias("relation")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, side, n): ends of edges that are no node(id)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit("source").alias("side")), F.struct(F.col("target_id").alias("id"), F.lit("target").alias("side")))).alias("e")).select("e.*")
    return ends.join(nodes.select("id"), "id", "left_anti").groupBy("id", "side").agg(F.count(F.lit(1)).alias("n"))


def rollup(filed: DataFrame) -> DataFrame:
    """(code, here, under): records filed at a code and below it, of filed(id, code)."""
    up = filed.select("id", F.explode(T.ancestors(F.col("code"))).alias("code")).distinct().groupBy("code").agg(F.count(F.lit(1)).alias("under"))
    here = filed.select("id", "code").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("here"))
    return here.join(up, "code", "full_outer").select("code", F.coalesce("here", F.lit(0)).alias("here"), F.coalesce("under", F.lit(0)).alias("under"))


def topic_brief(topics: DataFrame, filed: DataFrame, aliases: DataFrame | None = None, notes: int = 4) -> DataFrame:
    """Of every topic(code, title, subpoints) its place in the tree, other names of aliases(code, names), the first notes, and how much is filed there and below."""
    none = F.array().cast("array<string>")
    counts = rollup(filed)
    kids = topics.select(T.parent_code(F.col("code")).alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("children"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    points = F.coalesce("subpoints", none) if "subpoints" in topics.columns else none
    own = topics.select("code", "title", T.section(F.col("code")).alias("section"), T.parent_code(F.col("code")).alias("parent"), T.depth(F.col("code")).alias("depth"), F.slice(points, 1, notes).alias("notes"))
    known = own.join(aliases.select("code", F.col("names").alias("_names")), "code", "left") if aliases is not None else own.withColumn("_names", none)
    out = known.join(counts, "code", "left").join(kids, "code", "left")
    return out.select("code", "title", "section", "parent", "depth", F.coalesce("_names", none).alias("also_known_as"), "notes", z("here").alias("records"), z("children"), z("under"))


def get_topic(topics: DataFrame, filed: DataFrame, code: str) -> DataFrame:
    """(part, id) of one topic: its children, the records filed there, and those filed below."""
    kids = topics.where(T.parent_code(F.col("code")) == code).select(F.lit("child").alias("part"), F.col("code").alias("id"))
    here = filed.where(F.col("code") == code).select(F.lit("record").alias("part"), F.col("id").cast("string").alias("id"))
    below = filed.where(F.array_contains(T.ancestors(F.col("code")), code)).select(F.lit("below").alias("part"), F.col("id").cast("string").alias("id")).distinct()
    return kids.unionByName(here).unionByName(below)


def taxonomy_totals(topics: DataFrame) -> DataFrame:
    """One row: topics, subpoints, and topics that are coded by rather than browsed; topics(code, subpoints)."""
    scheme = T.section(F.col("code")) == fixed.CODING_SCHEME_SECTION
    return topics.agg(F.count(F.lit(1)).alias("topics"), F.sum(F.size(F.coalesce("subpoints", F.array().cast("array<string>")))).cast("long").alias("subpoints"), F.count_if(scheme).alias("coding_scheme"))


def taxonomy_stats(topics: DataFrame) -> DataFrame:
    """(kind, value, n): topics by depth and by section."""
    by = F.explode(F.array(F.struct(F.lit("depth").alias("kind"), T.depth(F.col("code")).cast("string").alias("value")), F.struct(F.lit("section").alias("kind"), T.section(F.col("code")).alias("value"))))
    return topics.select(by.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def release_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value, n): nodes by kind, edges by relation and by confidence; nulls are not counted."""
    count = lambda df, col, part: df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "value", "n")
    return count(nodes, "kind", "node").unionByName(count(edges, "relation", "relation")).unionByName(count(edges, "confidence_class", "confidence"))


def edge_violations(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, violation): edges whose provenance breaks the rules."""
    sure = F.col("relation").isin(fixed.RELATIONS_WITHOUT_CONFIDENCE)
    what = (
        F.when(sure & F.col("confidence_class").isNotNull(), "deterministic edge with a confidence class")
        .when((F.col("relation") == "SIMILAR_TO") & (F.col("method").isNull() | F.col("score").isNull()), "similarity without method or score")
        .when(~sure & (F.col("relation") != "SIMILAR_TO") & F.col("confidence_class").isNull(), "no confidence class")
        .when(~F.col("confidence_score").between(0, 1), "confidence score out of range")
    )
    return edges.select("source_id", "target_id", "relation", what.alias("violation")).where("violation is not null")


def dominant_section(written: DataFrame) -> DataFrame:
    """(author, section) of written(author, code): the section most written in, ties to the lowest number."""
    tally = written.groupBy("author", T.section(F.col("code")).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return tally.groupBy("author").agg(F.min_by("section", F.struct(-F.col("n"), F.col("section").cast("int"))).alias("section"))


def node_records(**kinds: DataFrame) -> DataFrame:
    """All nodes in one frame with their kind; columns that a kind lacks are null, and a kind that is none is an error."""
    if other := set(kinds) - {"topic", "resource", "entity", "claim"}:
        raise TypeError(f"not a node type: {sorted(other)}")
    out = None
    for kind, df in sorted(kinds.items()):
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def last_of(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with one key the last by position."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))).where("_r = 1").drop("_r")
