"""Releases: the same bytes on any cluster."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import ranks
from corpusgraph.sources import writers


def _release(spark, out, parts):
    """300 nodes, of which each tenth stands twice, and edges that tie on all they are ordered by."""
    k = F.col("id")
    nodes = spark.range(300).select(F.when(k % 5 == 0, "topic").otherwise("resource").alias("kind"), F.when(k % 10 == 9, k - 1).otherwise(k).cast("string").alias("id"), F.concat(F.lit("t"), k % 7).alias("title"))
    edges = spark.range(500).select((k % 3).cast("string").alias("source_id"), (k % 2).cast("string").alias("target_id"), F.lit("CITES").alias("relation"), F.lit(None).cast("string").alias("confidence_class"), (k * 31 % 500).alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        meta = writers.write_release(str(out), nodes.repartition(parts), edges.repartition(parts), "v1", "now", file_rows=64).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = {f"{part}/{d.name}": next(d.glob("part-*")).read_bytes() for part in ("nodes", "edges", "taxonomy") for d in (out / "v1" / part).glob("file=*")}
    sums = "".join(f.read_text() for f in (out / "v1" / "checksums").glob("part-*"))
    return files, sums, sorted(map(tuple, meta))


def test_equal_files_on_any_number_of_partitions(spark, tmp_path):
    first = _release(spark, tmp_path / "a", 1)
    for parts in (4, 40):
        assert _release(spark, tmp_path / str(parts), parts) == first
    files, sums, _ = first
    assert len(files) == 5 + 8 + 1
    assert sums == "".join(f"{hashlib.sha256(files[k]).hexdigest()}  {k}\n" for k in sorted(files, key=lambda k: (k.split("/")[0], int(k.split("=")[1]))))
    lines = b"".join(files[f"nodes/file={k}"] for k in range(5)).decode().splitlines()
    assert len(lines) == 300 and [(x["kind"], x["id"]) for x in map(json.loads, lines)] == sorted((x["kind"], x["id"]) for x in map(json.loads, lines))


def test_an_empty_release(spark, tmp_path):
    nodes = spark.createDataFrame([], "kind string, id string")
    edges = spark.createDataFrame([], "source_id string, target_id string, relation string, confidence_class string")
    meta = writers.write_release(str(tmp_path), nodes, edges, "v1", "now").collect()
    assert all(r["n"] in (None, "0") or r["value"].startswith("sha256") for r in meta)


def test_digests_are_those_of_the_files(spark, tmp_path):
    df = spark.range(50).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"))
    lines = writers.cut_lines(df, ["a"], 20)
    writers.write_lines(lines, str(tmp_path / "x"))
    told = {r["file"]: r["sha256"] for r in writers.file_digests(lines).collect()}
    assert told == {k: hashlib.sha256(next((tmp_path / "x" / f"file={k}").glob("part-*")).read_bytes()).hexdigest() for k in range(3)}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ranks_of_rows_that_tie_on_the_first_column(spark, n):
    """Ties on the leading column are dealt by the rest of the order."""
    df = spark.range(n).select((F.col("id") % 2).alias("flag"), (F.col("id") * 7919 % 10007).alias("v"))
    rows = ranks.exact_rank(df.repartition(7), ["flag", "v"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(n)) and [(r["flag"], r["v"]) for r in rows] == sorted((r["flag"], r["v"]) for r in rows)
