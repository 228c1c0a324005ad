"""Sinks: deterministic releases as JSON lines, with counts and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import exact_rank

#: Lines of a release's file; a file is sorted, written and hashed by one task.
FILE_ROWS = 100_000


def json_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """(row_no order columns.., value): a JSON line a row without null, empty text, empty list or empty map; False and 0 stay."""
    kept = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind.startswith(("array", "map")):
            c = F.when(F.size(c) > 0, c)
        kept.append(c.alias(name))
    return df.select(*[F.col(o) for o in order], F.to_json(F.struct(*kept)).alias("value"))


def cut_lines(df: DataFrame, order: list[str], file_rows: int = FILE_ROWS) -> DataFrame:
    """(file, place, value): JSON lines, each with its exact place in the whole (ties by their text) and the file it falls in.

    Which lines share a file follows from the rows alone: not from partitions, samples or cluster size.
    """
    lines = exact_rank(json_rows(df, order), [*order, "value"], "place")
    return lines.select(F.floor(F.col("place") / file_rows).alias("file"), "place", "value")


def file_digests(lines: DataFrame) -> DataFrame:
    """(file, n, sha256) of files as they are written of lines(file, place, value); a file's lines are in one row, FILE_ROWS at most."""
    listed = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "value"))).alias("x"))
    return listed.select("file", "n", F.sha2(F.concat(F.array_join(F.transform("x", lambda x: x["value"]), "\n"), F.lit("\n")), 256).alias("sha256"))


def write_lines(lines: DataFrame, folder: str) -> int:
    """Writes each file of lines(file, place, value) into a folder `file=k` of its own, in order; returns how many files."""
    files = (lines.agg(F.max("file")).head()[0] or 0) + 1
    dealt = lines.repartition(files, "file").sortWithinPartitions("file", "place")
    dealt.select("file", "value").write.mode("overwrite").option("maxRecordsPerFile", 0).partitionBy("file").text(folder)
    return files


def file_checksums(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """(part, value, n): SHA-256 of each file of a written folder, by its number; each file is read where it is hashed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    number = F.regexp_extract("path", r"file=(\d+)/", 1)
    return files.select(F.lit(part).alias("part"), F.concat(F.lit("sha256 "), number).alias("value"), F.sha2("content", 256).alias("n"))


def write_release(out_dir: str, nodes: DataFrame, edges: DataFrame, version: str, built_at: str, taxonomy_version: str = "v3", file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes nodes by (kind, id), edges by (relation, source, target) and topics by code; returns counts and checksums.

    File k of a part holds the lines from k * file_rows on, so the same rows give the same bytes on any cluster.  `checksums`,
    a line `digest  part/file` for each file as `sha256sum` has it, comes last: a folder without it is no release.
    `checksum` is over the rows alone, however they were dealt.
    """
    from ..functions.text import code_key
    from ..operators.graph import release_counts

    spark, parts = nodes.sparkSession, []
    topics = nodes.where("kind = 'topic'").withColumn("_k", code_key(F.col("id")))
    sums = None
    for name, df, order in (("nodes", nodes, ["kind", "id"]), ("edges", edges, ["relation", "source_id", "target_id"]), ("taxonomy", topics, ["_k"])):
        folder = f"{out_dir}/{version}/{name}"
        write_lines(cut_lines(df, order, file_rows), folder)
        parts.append(json_rows(df, order).agg(F.lit(name).alias("part"), F.lit("checksum").alias("value"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("n")))
        written = file_checksums(spark, folder, name)
        sums = written if sums is None else sums.unionByName(written)
    meta = release_counts(nodes, edges).select("part", "value", F.col("n").cast("string").alias("n"))
    for p in [*parts, sums]:
        meta = meta.unionByName(p)
    meta = meta.withColumns({"version": F.lit(version), "taxonomy_version": F.lit(taxonomy_version), "built_at": F.lit(built_at)})
    meta.orderBy("part", "value").write.mode("overwrite").json(f"{out_dir}/{version}/metadata")
    line = F.concat("n", F.lit("  "), "part", F.lit("/file="), F.regexp_extract("value", r"(\d+)$", 1))
    # a line a file; these few are one file, in order
    sums.select("part", F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("k"), line.alias("value")).repartition(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(f"{out_dir}/{version}/checksums")
    return meta


def store_lines(store: DataFrame) -> DataFrame:
    """(resource_id, value): a reference store as JSON lines with sorted keys; `write_store` writes them by id."""
    return store.select("resource_id", F.to_json(F.struct("cited_by_count", "key", F.sort_array("referenced_works").alias("referenced_works"), "resource_id", "source"), {"ignoreNullFields": "false"}).alias("value"))


def write_store(store: DataFrame, path: str) -> None:
    store_lines(store).orderBy("resource_id").select("value").write.mode("overwrite").text(path)


def yaml_texts(records: DataFrame, file: str = "file") -> DataFrame:
    """(file, value): a YAML text for each record of the columns beside `file`, in their order, without what is empty."""
    names = [c for c in records.columns if c != file]

    def dump(batches):
        import json

        import pandas as pd
        import yaml

        for batch in batches:
            kept = [{n: r[n] for n in names if r.get(n) not in (None, "", [], {})} for r in map(json.loads, batch["json"])]
            yield pd.DataFrame({file: batch[file], "value": [yaml.safe_dump(r, sort_keys=False, allow_unicode=True, width=88) for r in kept]})

    return records.select(file, F.to_json(F.struct(*names)).alias("json")).mapInPandas(dump, f"`{file}` string, value string")


def write_yaml(records: DataFrame, path: str, problems: DataFrame | None = None, file: str = "file") -> None:
    """A YAML text for each record, in a folder of its own named by the column `file`.  If problems(id, ..) has a row, nothing is written."""
    if problems is not None and (found := problems.limit(3).collect()):  # three rows at most
        raise ValueError(f"records with broken rules are not written: {found}")
    yaml_texts(records, file).write.mode("overwrite").partitionBy(file).text(path)


def read_release(spark, out_dir: str, version: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{out_dir}/{version}/{part}")
