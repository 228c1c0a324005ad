"""People: spellings of a name, tolerant matches between bylines, author profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def spellings(names: DataFrame) -> DataFrame:
    """(fold, name, n) of names(name)."""
    return names.groupBy(T.fold_name(F.col("name")).alias("fold"), "name").agg(F.count(F.lit(1)).alias("n"))


def canonical_spellings(names: DataFrame) -> DataFrame:
    """(fold, canonical, variants, n): the most complete spelling, then the most frequent, of each name."""
    one = spellings(names).withColumn("key", F.struct(T.richness(F.col("name")).alias("r"), F.col("n"), F.col("name")))
    return one.groupBy("fold").agg(F.max_by("name", "key").alias("canonical"), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n"))


def duplicate_names(names: DataFrame) -> DataFrame:
    return canonical_spellings(names).where("variants > 1")


def name_index(names: DataFrame) -> DataFrame:
    """(name, canonical) of spellings that aren't the canonical one."""
    best = canonical_spellings(names).select("fold", "canonical")
    return spellings(names).join(best, "fold").where("name <> canonical").select("name", "canonical")


def apply_index(bylines: DataFrame, index: DataFrame) -> DataFrame:
    """(id, names) of bylines(id, names): canonical spellings in the order of the byline, each once."""
    each = bylines.select("id", F.posexplode("names").alias("p", "name")).join(index, "name", "left").select("id", "p", F.coalesce("canonical", "name").alias("name"))
    listed = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "name"))).alias("x"))
    return listed.select("id", F.array_distinct(F.transform("x", lambda e: e["name"])).alias("names"))


def _parts(names: DataFrame, suffix: str) -> DataFrame:
    parts = F.split(T.fold_name(F.col("name")), " ")
    return names.select(F.col("name").alias(f"name_{suffix}"), parts.alias(f"parts_{suffix}")).where(F.col(f"parts_{suffix}")[0] != "")


def same_parts(l: Column, r: Column) -> Column:
    """Equal words in any order, or one last name and first names that are equal or an initial of each other; of arrays of folded words."""
    first_l, first_r = l[0], r[0]
    initial = ((F.length(first_l) == 1) | (F.length(first_r) == 1)) & (F.substring(first_l, 1, 1) == F.substring(first_r, 1, 1))
    some = (F.coalesce(first_l, F.lit("")) != "") & (F.coalesce(first_r, F.lit("")) != "")
    return some & ((F.array_sort(l) == F.array_sort(r)) | ((F.element_at(l, -1) == F.element_at(r, -1)) & ((first_l == first_r) | initial)))


def _same(a: str, b: str) -> Column:
    return same_parts(F.col(f"parts_{a}"), F.col(f"parts_{b}"))


def name_parts(names: Column) -> Column:
    """Of an array of names the pairs (name, its folded words)."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.split(T.fold_name(n), " ").alias("parts")))


def unmatched(ours: Column, theirs: Column) -> Column:
    """Names of one array of `name_parts` that no name of the other may be the same person as."""
    return F.transform(F.filter(ours, lambda a: ~F.exists(theirs, lambda b: same_parts(a["parts"], b["parts"]))), lambda a: a["name"])


def same_person_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name_a, name_b) that may be one person; names meet by last word or by the same words, never all with all."""
    a, b = _parts(left.select("name").distinct(), "a"), _parts(right.select("name").distinct(), "b")
    key = lambda s: F.array(F.concat(F.lit("l:"), F.element_at(f"parts_{s}", -1)), F.concat(F.lit("w:"), F.array_join(F.array_sort(f"parts_{s}"), " ")))
    met = a.withColumn("k", F.explode(key("a"))).join(b.withColumn("k", F.explode(key("b"))), "k")
    return met.where(_same("a", "b")).select("name_a", "name_b").distinct()


def author_profile(authors: DataFrame, name: str) -> DataFrame:
    """(name, records, co_authors) of authors(id, name): the first matching spelling, their records, and who else wrote these."""
    asked = authors.sparkSession.createDataFrame([(name,)], "name string")
    mine = same_person_pairs(authors, asked).select(F.col("name_a").alias("name"))
    ids = authors.join(mine, "name", "left_semi").select("id").distinct()
    others = authors.join(ids, "id", "left_semi").join(mine, "name", "left_anti").agg(F.array_sort(F.collect_set("name")).alias("co_authors"))
    records = ids.agg(F.array_sort(F.collect_set("id")).alias("records"))
    return mine.agg(F.min("name").alias("name")).where("name is not null").crossJoin(F.broadcast(records)).crossJoin(F.broadcast(others))  # one row each


def reconcile(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bylines (id, pos, name) of two sources: (id, pos, name) to keep, and (id, name) of ours that theirs lack."""
    a, b = _parts_of(ours, "a"), _parts_of(theirs, "b")
    hits = b.join(a, "id").where(_same("a", "b")).withColumn("r", F.row_number().over(Window.partitionBy("id", "pos_b").orderBy("pos_a"))).where("r = 1")
    equal = F.array_join("parts_a", " ") == F.array_join("parts_b", " ")
    richer = F.struct(T.richness(F.col("name_a")), F.col("name_a")) >= F.struct(T.richness(F.col("name_b")), F.col("name_b"))
    named = hits.select("id", "pos_b", F.when(equal & richer, F.col("name_a")).otherwise(F.col("name_b")).alias("name"))
    kept = b.select("id", "pos_b", "name_b").join(named, ["id", "pos_b"], "left").select("id", F.col("pos_b").alias("pos"), F.coalesce("name", "name_b").alias("name"))
    lost = a.join(hits.select("id", "pos_a"), ["id", "pos_a"], "left_anti").select("id", F.col("name_a").alias("name"))
    return kept, lost


def _parts_of(df: DataFrame, s: str) -> DataFrame:
    return df.select("id", F.col("pos").alias(f"pos_{s}"), F.col("name").alias(f"name_{s}"), F.split(T.fold_name(F.col("name")), " ").alias(f"parts_{s}"))
