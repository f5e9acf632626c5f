import hashlib
import json
import os
import pickle
import tracemalloc

import pytest
from pyspark.sql import functions as F

from costgrain.plans import store_queries
from costgrain.sources import files, transcripts
from costgrain.streaming import tail


@pytest.fixture
def home(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    return tmp_path


def run(spark, home, version="1", sink="out", **options):
    """One run of the stream over what is there; stops like a process that ends."""
    lines = tail.follow(spark, str(home / "in"), parser_version=version, **options)
    write = lines.writeStream.format("parquet").option("path", str(home / sink)).option("checkpointLocation", str(home / f"{sink}-checkpoint"))
    query = write.trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((os.path.basename(r.source_path), r.source_offset, r.line) for r in spark.read.parquet(str(home / sink)).collect())


def batch(spark, home):
    return sorted((os.path.basename(r.source_path), r.source_offset, r.line) for r in files.lines(spark, str(home / "in")).collect())


def add(home, name, text):
    with open(home / "in" / name, "ab") as f:
        f.write(text.encode())


def test_a_run_goes_on_where_the_last_one_ended_and_holds_torn_lines(spark, home):
    add(home, "a.jsonl", "one\n\ntwo\nthr")
    add(home, "deep/b.jsonl", "x\r\n")
    add(home, "c.txt", "no\n")
    assert run(spark, home) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, ""), ("a.jsonl", 5, "two"), ("b.jsonl", 0, "x")]
    add(home, "a.jsonl", "ee\nfour\n")
    add(home, "d.jsonl", "torn")
    rows = run(spark, home)
    add(home, "d.jsonl", "\n")
    assert run(spark, home) == sorted([*rows, ("d.jsonl", 0, "torn")]) == batch(spark, home)
    assert run(spark, home) == batch(spark, home)  # nothing new


def test_truncated_rotated_and_reparsed_files_begin_anew(spark, home):
    add(home, "a.jsonl", "".join(f"line {k}\n" for k in range(600)))  # longer than the hashed beginning
    first = run(spark, home)
    assert len(first) == 600
    (home / "in/a.jsonl").write_text("line 0\nline 1\n")  # cut
    second = run(spark, home)
    assert len(second) == 602
    (home / "in/a.jsonl").write_text("other 0\n" * 900)  # another file in its place
    third = run(spark, home)
    assert len(third) == 602 + 900 and sum(r[2] == "other 0" for r in third) == 900
    os.rename(home / "in/a.jsonl", home / "in/a.jsonl.1")
    add(home, "a.jsonl", "new\n")
    assert len(run(spark, home)) == 602 + 900 + 1
    assert len(run(spark, home, version="2")) == 602 + 900 + 2
    assert len(run(spark, home, version="2")) == 602 + 900 + 2


def test_a_run_that_dies_is_made_up_for(spark, home):
    add(home, "a.jsonl", "".join(f"{k}\n" for k in range(50)))

    def break_(df, n):
        raise ValueError("died")

    lines = tail.follow(spark, str(home / "in"))
    query = lines.writeStream.foreachBatch(break_).option("checkpointLocation", str(home / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="died"):
        query.awaitTermination()
    add(home, "a.jsonl", "".join(f"{k}\n" for k in range(50, 80)))
    got = []
    for _ in range(2):  # the first makes up for the batch that was planned, at least
        _again(spark, home, got)
    assert got == [(0, list(range(50))), (1, list(range(50, 80)))]


def _again(spark, home, got):
    again = tail.follow(spark, str(home / "in")).writeStream.foreachBatch(lambda df, n: got.append((n, sorted(int(r.line) for r in df.collect())))).option("checkpointLocation", str(home / "c"))
    again.trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_ranges_share_a_file_without_loss(spark, home, block):
    text = "".join("x" * (k % 23) + "é\n" for k in range(120))
    add(home, "a.jsonl", text)
    assert run(spark, home, blockBytes=block) == batch(spark, home)


def test_lines_that_are_too_long_are_cut_and_told(spark, home):
    add(home, "a.jsonl", "short\n" + "y" * 5_000 + "\nend\n")
    reader = tail.TailReader({"path": str(home / "in"), "lineBytes": "2000"})
    rows = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["source_offset"], len(r["line"]), r["oversize"]) for r in rows] == [(0, 5, False), (6, tail.STUB, True), (5_007, 3, False)]


def test_a_range_of_a_file_that_was_replaced_holds_nothing(home):
    add(home, "a.jsonl", "one\ntwo\n")
    reader = tail.TailReader({"path": str(home / "in")})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    (home / "in/a.jsonl").write_text("uno\ndos\n")
    assert [b for p in parts for b in reader.read(p)] == []
    os.remove(home / "in/a.jsonl")
    assert [b for p in parts for b in reader.read(p)] == [] and reader.latestOffset()["files"] == {}


def test_totals_of_requests_equal_one_batch_read(spark, home):
    record = lambda k: json.dumps({"type": "assistant", "session_id": f"s{k % 3}", "request_id": f"r{k}", "usage": {"input_tokens": k, "output_tokens": 2 * k}}) + "\n"
    for n in range(4):
        add(home, f"f{n % 2}.jsonl", "".join(record(k) for k in range(20 * n, 20 * n + 20)))
        run(spark, home, sink="lines")
    total = lambda raw: transcripts.requests_of(raw)[0].groupBy("session").agg(F.sum("input_tokens"), F.sum("output_tokens"), F.count("*")).orderBy("session").collect()
    assert total(spark.read.parquet(str(home / "lines"))) == total(files.lines(spark, str(home / "in")))


def test_many_small_files_are_few_tasks(home):
    for k in range(300):
        (home / f"in/{k}.jsonl").write_text(f"{k}\n")
    reader = tail.TailReader({"path": str(home / "in")})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) == 1
    assert sorted(int(r["line"]) for p in parts for b in reader.read(p) for r in b.to_pylist()) == list(range(300))


def read(reader, start, end):
    return sorted((os.path.basename(r["source_path"]), r["line"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist())


def test_what_the_driver_holds_does_not_grow_with_files(home, monkeypatch):
    """Neither what it sends (offsets, tasks) nor what it has in memory."""
    monkeypatch.setattr(tail, "ROWS", 64, raising=False)
    peaks = []
    for n in (400, 4_000):
        for k in range(n):
            if k % 100 == 0:
                os.makedirs(home / f"in/{k // 100}", exist_ok=True)
            (home / f"in/{k // 100}/{k}.jsonl").write_text(f"{k}\n")
        reader = tail.TailReader({"path": str(home / "in"), "blockBytes": str(8 << 20)})
        tracemalloc.start()
        end = reader.latestOffset()
        parts = reader.partitions(reader.initialOffset(), end)
        assert reader.latestOffset() == end and reader.partitions(end, end) == []
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(json.dumps(end)) < 500 and max(len(pickle.dumps(p)) for p in parts) < 500
        assert [x[1] for x in read(reader, reader.initialOffset(), end)] == [str(k) for k in sorted(range(n), key=lambda k: f"{k}.jsonl")]
    assert peaks[1] < peaks[0] + 200_000


def test_files_are_found_again_in_whatever_order_their_names_stand(home):
    names = ["a.jsonl", "a/b.jsonl", "a-b/c.jsonl", "a/0/d.jsonl", "a0.jsonl", "é/f.jsonl", "Z.jsonl"]
    for k, name in enumerate(names):
        (home / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        add(home, name, f"{k}\n")
    reader = tail.TailReader({"path": str(home / "in"), "glob": "*"})
    first = reader.latestOffset()
    assert [x[1] for x in read(reader, reader.initialOffset(), first)] == sorted(map(str, range(7)), key=lambda k: os.path.basename(names[int(k)]))
    for name in names[1::2]:
        add(home, name, f"more {name}\n")
    (home / "in/a/new.jsonl").write_text("new\n")
    os.remove(home / "in/Z.jsonl")
    assert [x[1] for x in read(reader, first, reader.latestOffset())] == sorted([*(f"more {n}" for n in names[1::2]), "new"], key=lambda x: os.path.basename(x.split()[-1]) if " " in x else "new.jsonl")


def test_offsets_of_older_checkpoints_are_gone_on_from(home):
    for name in ("a.jsonl", "b.jsonl"):
        add(home, name, "one\n")
    reader = tail.TailReader({"path": str(home / "in")})
    old = {"parser": "1", "files": {str(home / "in" / name): {"end": 4, "head": hashlib.sha256(b"one\n").hexdigest()} for name in ("a.jsonl", "b.jsonl")}}
    add(home, "b.jsonl", "two\n")
    assert read(reader, old, reader.latestOffset()) == [("b.jsonl", "two")]
    assert read(reader, reader.initialOffset(), old) == [("a.jsonl", "one"), ("b.jsonl", "one")]


def test_a_folder_of_its_own_is_cleared_of_what_no_batch_needs(home, monkeypatch):
    monkeypatch.setattr(tail, "KEPT", 2)
    reader, start, offsets = tail.TailReader({"path": str(home / "in"), "state": str(home / "read")}), None, []
    for k in range(5):
        add(home, "a.jsonl", f"{k}\n")
        offsets.append(reader.latestOffset())
        assert read(reader, start or reader.initialOffset(), offsets[-1]) == [("a.jsonl", str(k))]
        start = offsets[-1]
        (home / "read/dead.part").touch()
        (home / "read/dead.plan").touch()
        reader.commit(start)
    assert sorted(x.suffix for x in (home / "read").iterdir()) == [".manifest"] * 2 and not (home / "in" / tail.STATE).exists()
    again = tail.TailReader({"path": str(home / "in"), "state": str(home / "read")})
    assert read(again, offsets[3], offsets[4]) == [("a.jsonl", "4")]
    assert again.latestOffset() == offsets[4]


def test_users_files_are_written_by_tasks(spark, home):
    rows = [(str(k % 3), f"f{k % 9}", k) for k in range(900)]
    dealt = spark.createDataFrame(rows, "folder string, file string, n long").repartition("folder").sortWithinPartitions("folder", "file", "n")
    write = store_queries._text_files(str(home / "files"))
    for _ in range(2):  # a task that is tried again replaces what it wrote
        assert dealt.select("folder", "file", F.col("n").cast("string").alias("value")).mapInArrow(write, "files long").agg(F.sum("files")).first()[0] == 9
    got = {str(p.relative_to(home / "files")): p.read_text() for p in (home / "files").rglob("*") if p.is_file()}
    assert got == {f"{k % 3}/f{k}.txt": "".join(f"{n}\n" for n in range(k, 900, 9)) for k in range(9)}
