"""Streams over files: the same functions on streams and tables, deduplication, batch upserts."""

import json

from pyspark.sql import functions as F

from corpusgraph.operators import review
from corpusgraph.streaming import events

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _files(folder, parts):
    folder.mkdir()
    for k, rows in enumerate(parts):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))


def _run(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_counts_and_first_events_on_a_stream(spark, tmp_path):
    parts = [[{"event_id": k, "ts": f"2024-01-01T0{b}:{k % 60:02d}:00", "user_id": k % 3, "event_type": "ab"[k % 2], "value": 1.5} for k in range(20)] for b in range(3)]
    _files(tmp_path / "in", parts)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    table = spark.read.schema(EVENT).json(str(tmp_path / "in"))
    got = _run(spark, events.windowed_counts(stream), "windows", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, events.windowed_counts(table).collect())) and len(got) == 6
    first = _run(spark, events.first_events(stream, ["event_id"], "5 hours"), "firsts", "append")
    assert sorted(r["event_id"] for r in first) == list(range(20)) == sorted(r["event_id"] for r in events.first_events(table, ["event_id"]).collect())


def test_upserts_batch_by_batch(spark, tmp_path):
    schema = "resource_id string, key string, source string, cited_by_count int, referenced_works array<string>"
    row = lambda i, n, refs: {"resource_id": i, "key": None, "source": "s", "cited_by_count": n, "referenced_works": refs}
    _files(tmp_path / "in", [[row("a", 1, ["x"]), row("b", 2, [])], [row("a", 3, []), row("c", 1, ["z"])]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = events.upsert_stream(stream, str(tmp_path / "out"), review.store_upsert, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["resource_id"]: (r["cited_by_count"], list(r["referenced_works"])) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).select(F.col("*")).collect()}
    assert got == {"a": (3, ["x"]), "b": (2, []), "c": (1, ["z"])}
