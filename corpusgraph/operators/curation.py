"""The curation service: flat rows to records and back, what a push or a sync would do, and whether a table fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.staging import staged
from ..sources import versions
from .review import deletion_guard


def _listed(c: Column) -> Column:
    """Parts between commas, without blanks; null where there is nothing to split."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def records_from_rows(rows: DataFrame, sources: DataFrame | None = None, facets: dict[str, str] | None = None) -> DataFrame:
    """Nested records of flat rows, whose columns have the service's names; what a row doesn't give, or its column isn't there, is null.

    `facets` maps column names to facets (all of them if None).  `tool` is a struct of the profile's fields, null if all are.  rows may have
    `Sources`, a list of ids of sources(id, url, accessed, title, supports); linked sources without an address
    are dropped, the others stand in the order of their addresses.
    """
    have = set(rows.columns)
    kinds = dict(rows.dtypes)
    get = lambda name: F.col(f"`{name}`") if name in have else F.lit(None)
    some = lambda name: F.nullif(get(name).cast("string"), F.lit(""))
    out = {key: some(name) for name, key in fixed.ROW_FIELDS.items()}
    out["id"] = F.when(out["id"].startswith("resource:"), out["id"]).otherwise(F.concat(F.lit("resource:"), out["id"]))
    out |= {key: _listed(get(name).cast("string")) for name, key in fixed.ROW_LISTS.items()}
    out |= {key: get(name).cast("boolean") for name, key in fixed.ROW_CHECKBOXES.items()}
    value = lambda n: F.when(F.size(get(n)) > 0, get(n)) if kinds.get(n, "").startswith("array") else F.when(some(n).isNotNull(), F.array(some(n)))
    named = [F.struct(F.lit(k).alias("key"), value(n).alias("value")) for n, k in (fixed.FACET_COLUMNS if facets is None else facets).items() if n in have]
    found = F.filter(F.array(*named), lambda e: e["value"].isNotNull()) if named else None
    out["facets"] = F.when(F.size(found) > 0, F.map_from_entries(found)) if named else F.lit(None).cast("map<string,array<string>>")
    profile = {key: some(name) for name, key in fixed.ROW_TOOLS.items()} | {key: _listed(get(name).cast("string")) for name, key in fixed.ROW_TOOL_LISTS.items()}
    out["tool"] = F.when(F.coalesce(*[c.cast("string") for c in profile.values()]).isNotNull(), F.struct(*[c.alias(k) for k, c in profile.items()]))
    linked_by = fixed.ROW_SOURCES
    picked = rows.select(*[c.alias(k) for k, c in out.items()], *([F.col(linked_by).alias("_sources")] if linked_by in have and sources is not None else []))
    if "_sources" not in picked.columns:
        return picked
    linked = sources.where(F.coalesce("url", F.lit("")) != "").select(F.col("id").alias("_s"), F.struct("url", F.nullif("accessed", F.lit("")).alias("accessed"), F.nullif("title", F.lit("")).alias("title"), _listed(F.col("supports")).alias("supports")).alias("source"))
    per = picked.select("id", F.explode("_sources").alias("_s")).join(linked, "_s").groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return picked.drop("_sources").join(per, "id", "left")


def rows_from_records(records: DataFrame, source_ids: DataFrame | None = None, facets: dict[str, str] | None = None) -> DataFrame:
    """The flat rows of records: bare ids, lists joined by commas, facets of one value unwrapped, tools' fields, links to sources; published.

    source_ids(url, id) says which row a source has; a record's sources without one are left out, the others keep their order.
    """
    have = set(records.columns)
    cols = [F.nullif(F.regexp_replace(key, "^resource:", "") if key == "id" else F.col(key).cast("string"), F.lit("")).alias(name) for name, key in fixed.ROW_FIELDS.items() if key in have]
    cols += [F.nullif(F.array_join(key, ", "), F.lit("")).alias(name) for name, key in fixed.ROW_LISTS.items() if key in have]
    cols += [F.col(key).alias(name) for name, key in fixed.ROW_CHECKBOXES.items() if key in have]
    if "facets" in have:
        cols += [(F.get(F.col("facets")[key], F.lit(0)) if key in fixed.SINGLE_VALUED_FACETS else F.col("facets")[key]).alias(name) for name, key in (fixed.FACET_COLUMNS if facets is None else facets).items()]
    if "tool" in have:
        inside = {f.name for f in records.schema["tool"].dataType.fields}
        cols += [F.nullif(F.col("tool")[key], F.lit("")).alias(name) for name, key in fixed.ROW_TOOLS.items() if key in inside]
        cols += [F.nullif(F.array_join(F.col("tool")[key], ", "), F.lit("")).alias(name) for name, key in fixed.ROW_TOOL_LISTS.items() if key in inside]
    if source_ids is not None and "sources" in have:
        known = source_ids.select(F.col("url").alias("_url"), F.col("id").alias("_row"))
        links = records.select("id", F.posexplode("sources").alias("_p", "_source")).join(known, F.col("_source.url") == F.col("_url")).groupBy(F.col("id").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_row"))), lambda x: x["_row"]).alias("_links"))
        records = records.join(links, F.col("id") == F.col("_id"), "left")
        cols.append(F.col("_links").alias(fixed.ROW_SOURCES))
    return records.select(*cols, F.lit(True).alias(fixed.ROW_PUBLISHED))


def fresh_sources(records: DataFrame, source_ids: DataFrame) -> DataFrame:
    """(url, accessed, title, supports) of sources in records(id, sources) that no row of source_ids(url, id) has: a row for each address, as the first record has it."""
    each = records.select("id", F.posexplode("sources").alias("p", "s")).where(F.coalesce("s.url", F.lit("")) != "")
    first = each.groupBy(F.col("s.url").alias("url")).agg(F.min_by("s", F.struct("id", "p")).alias("s"))
    return first.join(source_ids.select("url"), "url", "left_anti").select("url", "s.accessed", "s.title", F.nullif(F.array_join("s.supports", ", "), F.lit("")).alias("supports"))


def push_plan(records: DataFrame, rows: DataFrame) -> DataFrame:
    """records(id, url) that the service lacks, by id and by address; rows(id, url)."""
    fresh = records.join(rows.select("id").where("id is not null"), "id", "left_anti")
    known = rows.where(F.coalesce("url", F.lit("")) != "").select("url").distinct()
    return fresh.join(known, "url", "left_anti")


def sync_plan(rows: DataFrame, managed: DataFrame, least: int = 5, share: float = 0.25, allow_deletions: bool = False) -> DataFrame:
    """(id, action) of rows(id, published, problem) and managed(id), the records that came from the service: one verdict for all.

    Published rows without a problem are valid; the others are reported as `skip`.  A managed record that no valid row has is
    removed, also if its row is there but broken.  If too large a share would go, nothing is written: those records say
    `refuse`, and no record is `upsert` or `delete`.
    """
    live = rows.where("published and id is not null")
    valid = live.where("problem is null").select("id").distinct()
    guard = deletion_guard(managed, valid, least, share).select((F.col("refused") & F.lit(not allow_deletions)).alias("refused"))
    gone = managed.select("id").distinct().join(valid, "id", "left_anti").crossJoin(F.broadcast(guard))  # one row
    fresh = valid.crossJoin(F.broadcast(guard)).where("not refused").select("id", F.lit("upsert").alias("action"))  # one row
    broken = live.where("problem is not null").select("id").distinct().join(valid, "id", "left_anti").select("id", F.lit("skip").alias("action"))
    return fresh.unionByName(gone.select("id", F.when(F.col("refused"), "refuse").otherwise("delete").alias("action"))).unionByName(broken)


def row_problems(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """rows(id, taxonomy_topics, ..) with `problem`: no id, tags that no topic has, or a broken rule of the record itself."""
    tags = rows.select("id", F.explode("taxonomy_topics").alias("code")).join(topics.select("code"), "code", "left_anti")
    bad = tags.groupBy(F.col("id").alias("_bad")).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("_tags"))
    kind = F.col("resource_type") if "resource_type" in rows.columns else F.lit("")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == "" if c in rows.columns else F.lit(False)
    what = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.col("_tags").isNotNull(), F.concat(F.lit("tags not in the taxonomy: "), "_tags")).when(blank("title"), "no title").when(kind.isNull(), "no resource type")
    return rows.join(bad, F.col("id") == F.col("_bad"), "left").withColumn("problem", what).drop("_bad", "_tags")


def sync(root: str, records: DataFrame, origin: str = fixed.SERVICE, least: int = 5, share: float = 0.25, allow_deletions: bool = False) -> DataFrame:
    """Brings the table at `root` to what records(id, published, problem, source_provenance, ..) say, all or nothing; returns the plan, once.

    Records whose provenance begins with `origin` are managed; the others stay unless a valid row has their id.  The new
    table is a version of its own, which readers see when its manifest is written, last.  A refused plan writes nothing.
    """
    spark, columns = records.sparkSession, [c for c in records.columns if c not in ("published", "problem")]
    there = versions.read_current(spark, root, records.select(*columns).schema)
    managed = there.where(F.coalesce("source_provenance", F.lit("")).startswith(origin)).select("id")
    plan = staged(sync_plan(records, managed, least, share, allow_deletions), "sync")
    if plan.where("action = 'refuse'").limit(1).count():
        return plan
    fresh = records.where("published and id is not null and problem is null").select(*columns).withColumn("source_provenance", F.coalesce(F.nullif("source_provenance", F.lit("")), F.lit(origin)))
    gone = plan.where("action in ('upsert', 'delete')").select("id")
    # of rows with one id the last counts, by pos if there is one, else by their text
    last = [F.col("pos")] if "pos" in columns else []
    one = fresh.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*last, F.to_json(F.struct(*columns)).alias("_text"))).alias("row")).select("row.*")
    versions.write_next(there.join(gone, "id", "left_anti").unionByName(one), root)
    return plan


def schema_problems(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(field, problem) of two lists (field, kind, options): missing and extra fields, other kinds, missing and extra options."""
    w, t = wanted.toDF("field", "wk", "wo"), there.toDF("field", "tk", "to")
    none = F.array().cast("array<string>")
    left, right = F.coalesce("wo", none), F.coalesce("to", none)
    less, more = F.array_sort(F.array_except(left, right)), F.array_sort(F.array_except(right, left))
    both = F.col("wk").isNotNull() & F.col("tk").isNotNull()
    what = F.array_compact(F.array(
        F.when(F.col("tk").isNull(), "missing field"), F.when(F.col("wk").isNull(), "extra field"), F.when(both & (F.col("wk") != F.col("tk")), F.concat(F.lit("is "), "tk", F.lit(", not "), "wk")),
        F.when(both & (F.size(less) > 0), F.concat(F.lit("missing options: "), F.array_join(less, ", "))), F.when(both & (F.size(more) > 0), F.concat(F.lit("extra options: "), F.array_join(more, ", "))),
    ))
    return w.join(t, "field", "full_outer").select("field", F.explode(what).alias("problem"))


def definition_problems(model: set[str], table: list[str], checked: list[str] | None = None) -> list[str]:
    """What is wrong with a table's definition: attributes that the model lacks or that are mapped twice, fields that are mapped but
    not defined, named twice, or starred but not checked before publishing (or checked but not starred)."""
    mapped = {**fixed.ROW_FIELDS, **fixed.ROW_LISTS, **fixed.ROW_CHECKBOXES}
    keys, checked = list(mapped.values()), fixed.ROW_REQUIRED if checked is None else checked
    starred = {n for n in table if n.endswith(" *")}
    found = {f"unknown attribute {k}" for k in keys if k not in model} | {f"mapped twice: {k}" for k in keys if keys.count(k) > 1}
    found |= {f"defined twice: {n}" for n in table if table.count(n) > 1}
    found |= {f"mapped but not defined: {n}" for n in [*mapped, *fixed.FACET_COLUMNS, *fixed.ROW_TOOLS, *fixed.ROW_TOOL_LISTS] if n not in table}
    found |= {f"starred but not checked: {n}" for n in starred - set(checked)} | {f"checked but not starred: {n}" for n in set(checked) - starred}
    return sorted(found)
