import os

import pytest
from pyspark.sql import functions as F

from costgrain.functions.identity import with_identity
from costgrain.sources.observation import COLUMNS, SCHEMA
from costgrain.streaming.ledger import Ledger
from costgrain.streaming.store import Store, bucket_of


def rows(spark, first, n, **known):
    base = {"adapter": "a", "source": "transcript_request", "source_path": "p"}
    made = [base | {"session": f"s{k}", "request_id": f"r{k}", "source_offset": k, "input_tokens": k} | known for k in range(first, first + n)]
    return spark.createDataFrame([tuple(m.get(c) for c in COLUMNS) for m in made], SCHEMA)


def test_tables_become_visible_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.range(3).select("id")
    before = store.snapshot()
    first = store.write("a", one)
    assert store.read("a", "id long").count() == 0  # written, not committed
    after = store.commit(before, {"a": first, "b": store.write("b", one)}, notes={"n": 1})
    assert store.read("a", "id long").count() == store.read("b", "id long").count() == 3 and after["version"] == 1
    with pytest.raises(RuntimeError):  # another writer was faster
        store.commit(before, {"a": store.write("a", one)})
    assert store.read("a", "id long").count() == 3 and store.snapshot()["notes"] == {"n": 1}
    assert store.clean() == 1 and store.clean() == 0 and store.read("a", "id long").count() == 3


def test_buckets_are_read_and_replaced_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    by = bucket_of(F.col("id"), 1)
    at = store.commit(store.snapshot(), {"t": store.write("t", spark.range(200).select("id"), by)})
    buckets = sorted(at["tables"]["t"])
    assert len(buckets) == 16
    some = store.read("t", "id long", buckets[:2])
    assert {f.split("bucket=")[1][0] for f in some.inputFiles()} == set(buckets[:2])
    new = store.write("t", some.select((-F.col("id")).alias("id")), F.lit(buckets[0]))
    store.commit(at, replace={"t": (buckets[:2], new)})
    kept = {r.id for r in store.read("t", "id long").collect()}
    assert {abs(k) for k in kept} == set(range(200)) and sum(k < 0 for k in kept) == some.where("id > 0").count()


def test_old_manifests_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    at = store.snapshot()
    for k in range(12):
        at = store.commit(at, notes={"k": k})
    assert len(os.listdir(tmp_path / "s/_commits")) <= 2 * 8 and store.snapshot()["notes"] == {"k": 11}


def test_a_batch_opens_only_the_buckets_of_its_sessions(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.ingest(rows(spark, 0, 300), 0)
    whole = ledger.store.read("index", "use string").inputFiles()
    clean = with_identity(rows(spark, 7, 2)).withColumns({"source_kind": F.col("source"), "logical_event_hash": F.lit(None).cast("string")})
    part = ledger.known(clean)
    assert 0 < len({f.rsplit("/", 1)[0] for f in part.inputFiles()}) <= 2 < len({f.rsplit("/", 1)[0] for f in whole})
    assert {"s7", "s8"} <= {r.session for r in part.collect()}
    assert "Location: InMemoryFileIndex" in part._jdf.queryExecution().toString()


@pytest.mark.parametrize("folders", [1, 99])
def test_batches_supersede_alike_with_and_without_compaction(spark, tmp_path, folders):
    ledger = Ledger(spark, str(tmp_path / "l"), folders=folders)
    ledger.ingest(rows(spark, 0, 6), 0)
    ledger.ingest(rows(spark, 3, 6, source="provider_fields"), 1)
    ledger.ingest(rows(spark, 0, 12), 2)  # no better than what is there
    ledger.ingest(rows(spark, 3, 1, source="official_telemetry"), 3)
    ledger.ingest(rows(spark, 3, 1, source="provider_fields"), 4)
    ledger.ingest(rows(spark, 0, 12, source="official_telemetry"), 4)  # comes again: nothing
    found = ledger.events().select("session", "source", F.col("superseded_by").isNull().alias("active")).collect()
    active = {r.session: r.source for r in found if r.active}
    assert active == {f"s{k}": "official_telemetry" if k == 3 else "provider_fields" if 3 <= k < 9 else "transcript_request" for k in range(12)}
    assert len(found) == 12 + 3 + 1
    index = ledger.store.snapshot()["tables"]["index"]
    assert max(map(len, index.values())) <= max(folders, 1) or folders == 99


def test_events_and_hashes_are_taken_across_sessions(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.ingest(rows(spark, 0, 1, source_event_id="e", request_id=None), 0)
    ledger.ingest(rows(spark, 5, 1, source_event_id="e", request_id=None), 1)  # the same hash in another session
    ledger.ingest(rows(spark, 6, 1, source_event_id="e"), 2)  # another hash of the same event
    assert [r.session for r in ledger.events().collect()] == ["s0"]


def test_a_run_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.ingest(rows(spark, 0, 2), 0)

    def die(*a, **k):
        raise OSError("died")

    monkeypatch.setattr(ledger.store, "commit", die)
    with pytest.raises(OSError):
        ledger.ingest(rows(spark, 2, 2), 1)
    monkeypatch.undo()
    assert ledger.events().count() == 2
    ledger.ingest(rows(spark, 2, 2), 1)
    assert ledger.events().count() == 4 and ledger.store.clean() == 4
