import json

from pyspark.sql import functions as F

from costgrain.plans import source_queries
from costgrain.sources import transcripts


def lines_of(spark, records):
    rows = [("f", k, json.dumps(r), False) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "source_path string, source_offset long, line string, oversize boolean")


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_a_line_of_a_stream_is_parsed_once_for_counts_and_once_for_faults(spark):
    use = {"type": "usage", "requestId": "r", "usage": {"input_tokens": 5}}
    rows, odd = transcripts.streams_of(lines_of(spark, [use, {"version": "v77"}, {"type": "turn_start", "turn_id": "t"}, use | {"requestId": "s"}]))
    assert parses(rows) == 0 and parses(odd) <= 1
    assert sorted((r.request_id, r.turn_id) for r in rows.collect()) == [("r", None), ("s", "t")]
    assert [(r.type, r.details) for r in odd.collect()] == [("unsupported_version", '{"unsupported_version":"v77"}')]


def test_the_first_event_may_be_a_purchase(spark, tmp_path):
    made = spark.range(5).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(2.5).alias("value"), F.lit('{"k": 3}').alias("props"))
    made.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = source_queries.request_transcripts(spark, str(tmp_path)).select("key", "reasoning_tokens").collect()
    assert sorted(found) == [(f"r{n}", None) for n in range(5)]
