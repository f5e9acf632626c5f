import random

from pyspark.sql import functions as F

from costgrain.functions import text
from costgrain.operators import deltas
from costgrain.sources import files


def test_context_is_carried_over_pieces_as_over_one(spark):
    draw = random.Random(1)
    rows = [(f"f{draw.randrange(2)}", k, draw.choice([None, None, f"a{k}"]), draw.choice([None, None, None, f"b{k}"]), draw.random() < 0.1) for k in range(300)]
    table = spark.createDataFrame(rows, "path string, n long, a string, b string, e boolean")
    for own in (False, True):
        whole = deltas.sticky(table, ["path"], ["n"], ["a", "b"], F.col("e"), own=own)
        for size in (1, 7, 50, 1000):
            pieces = deltas.sticky(table, ["path"], ["n"], ["a", "b"], F.col("e"), own=own, chunk=(F.col("n") / size).cast("long"))
            assert sorted(map(str, pieces.collect())) == sorted(map(str, whole.collect())), (own, size)


def test_a_file_is_read_by_many_tasks_with_right_offsets(spark, tmp_path):
    draw = random.Random(2)
    lines = ["x" * draw.randrange(200) + "é" * draw.randrange(3) for _ in range(4_000)]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48k")
    try:
        found = files.lines(spark, str(tmp_path))
        rows = found.select("source_offset", "line").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at, want = 0, []
    for x in lines:
        want.append((at, x))
        at += len(x.encode()) + 1
    assert sorted(map(tuple, rows)) == want


def scrubbed(message, raw):
    """The same by hand."""
    import re

    tokens = {t for t in re.split(r"[^\w]+|_", raw or "") if len(t.encode()) >= 4}
    core = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    out = " ".join("[redacted]" if len(core(w).encode()) >= 4 and core(w) in tokens else w for w in message.split())
    if len(out.encode()) > 300:
        out = out.encode()[:300].decode(errors="ignore") + "…[truncated]"
    return out


def test_scrubbing_counts_bytes(spark):
    cases = [("bad 日本 here", '{"p": "日本"}'), ("ab éé abcd (wort)", "éé ab abcd wort"), ("é" * 149 + " x" + "日" * 20, ""), ("x" * 299 + "é", None), ("x" * 300, "y"), ("", "word")]
    got = [r[0] for r in spark.createDataFrame(cases, "m string, raw string").select(text.scrub(F.col("m"), F.col("raw"))).collect()]
    assert got == [scrubbed(*c) for c in cases]


def test_run_files_by_name_and_version(spark, tmp_path):
    import json

    from costgrain.sources import documents

    for name, body in {"a.usage.json": {"session_id": "a", "input_tokens": 1}, "request_dump_7.json": {"session_id": "b", "input_tokens": 2}, "usage.txt": {"session_id": "c"}, "old-usage.json": {"version": 99, "input_tokens": 3}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    out, odd = documents.read_runs(spark, str(tmp_path))
    assert sorted(r.session for r in out.collect()) == ["a", "b"] and [r.type for r in odd.collect()] == ["unsupported_version"]


def test_instants_of_mixed_forms(spark):
    cases = ["2026-01-01T00:00:00Z", "2026-01-01t05:30:00.5+05:30", "2025-12-31 21:00:00.123456789-03:00", "2026-01-01T00:00:00", "2026-13-01T00:00:00Z", "", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string")
    got = [r[0] for r in df.orderBy("k").select(F.unix_micros(text.rfc3339(F.col("c")))).collect()]
    base = 1767225600 * 10**6
    assert got == [base, base + 500_000, base + 123_456, None, None, None, None]
