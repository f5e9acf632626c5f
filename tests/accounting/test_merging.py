import json
import random

import pytest
from pyspark.sql import functions as F

from costgrain.operators import merging
from costgrain.operators.stages import numbered
from costgrain.operators.tree import paths
from costgrain.plans import reports
from costgrain.functions.vocabulary import TOKENS
from costgrain.sources import documents
from costgrain.streaming.identities import Identities
from costgrain.streaming.imports import SCHEMAS, Imports

MERGE, ITEM, NOTE, SHARE = "source string, target string, sequence long", "id string, parent_id string, project_id string, status string", "work_item_id string, body string", "group_id string, work_item_id string, role string, weight int, ordinal int, confidence double"


def plain(merges, items, notes, shares):
    """Merges by a loop, each source looked up until nothing leads on."""
    status, to = {i: s for i, _, _, s in items}, {}
    project = {i: p for i, _, p, _ in items}
    for a, b, _ in sorted(merges, key=lambda m: (m[2], m[1])):
        if a != b and a in status and b in status and project[a] == project[b] and status[a] != "merged" and a not in to:
            to[a] = b

    def end(x):
        while x in to:
            x = to[x]
        return x

    new_items = {(i, None if p is None or end(p) == i else end(p), q, "merged" if i in to else s) for i, p, q, s in items}
    sums = {}
    for g, w, role, weight, ordinal, confidence in shares:
        old = sums.get((g, end(w)), (0, None, 10**9, 0.0))
        sums[(g, end(w))] = (old[0] + weight, role if ordinal < old[2] else old[1], min(ordinal, old[2]), max(confidence, old[3]))
    return new_items, sorted((end(w), b) for w, b in notes), {(g, w, v[0], v[1], v[3]) for (g, w), v in sums.items()}


def test_chains_of_merges_are_a_loop(spark):
    draw = random.Random(1)
    items = [(f"i{k}", f"i{k // 3}" if k else None, f"p{k % 2}", "merged" if k % 17 == 5 else "open") for k in range(80)]
    # Each goes to a higher one, so chains are long and there is no cycle.
    merges = [(f"i{k}", f"i{min(79, k + draw.choice([2, 2, 2, 4, 1]))}", k) for k in range(70) if k % 5] + [("i1", "i9", 99), ("i2", "nowhere", 1), ("nobody", "i2", 2), ("i3", "i3", 3)]
    notes = [(f"i{draw.randrange(80)}", str(k)) for k in range(40)]
    shares = [(f"g{k}", f"i{draw.randrange(80)}", "primary" if o == 0 else "secondary", 5000, o, 0.5 + o / 10) for k in range(40) for o in range(2)]
    out = merging.merge_all(spark.createDataFrame(merges, MERGE), spark.createDataFrame(items, ITEM), spark.createDataFrame(notes, NOTE), spark.createDataFrame(shares, SHARE))
    want = plain(merges, items, notes, shares)
    assert {tuple(r) for r in out["items"].collect()} == want[0]
    assert sorted(tuple(r) for r in out["notes"].collect()) == want[1]
    assert {(r.group_id, r.work_item_id, r.weight, r.role, r.confidence) for r in out["attributions"].collect()} == want[2]
    refused = {(r.source, r.reason) for r in out["refused"].collect()}
    assert {("i3", "itself"), ("i2", "unknown target"), ("nobody", "unknown source")} <= refused and "another project" in {r for _, r in refused} and "merged already" in {r for _, r in refused}
    assert out["items"].count() == 80


def test_a_cycle_of_merges_is_an_error(spark):
    chain = [(f"i{k}", f"i{k + 1}", k) for k in range(40)]
    ends = {r.target for r in merging.last_targets(spark.createDataFrame(chain, MERGE)).collect()}
    assert ends == {"i40"}
    with pytest.raises(merging.MergeCycle, match="i"):
        merging.last_targets(spark.createDataFrame([*chain, ("i40", "i10", 41)], MERGE))
    assert merging.last_targets(spark.createDataFrame([], MERGE)).collect() == []


def nodes(spark, draw, n):
    rows = [(f"n{k}", None if k < 3 else f"n{draw.randrange(max(0, k - 6), k)}", f"t{draw.randrange(9)}", f"d{draw.randrange(3)}") for k in range(n)]
    project = {}
    for i, p, _, _ in rows:
        project[i] = project[p] if p else f"p{len(project) % 2}"
    df = paths(spark.createDataFrame([(*r, project[r[0]]) for r in rows], "id string, parent_id string, title string, created_at string, project_id string"))
    totals = [*TOKENS, "requests", "measured", "unavailable", "anomalous", "priced", "amount_micros"]
    return rows, project, df.withColumns({c: F.length("title").cast("long") for c in totals})


def test_nested_export_is_that_of_recursion(spark):
    rows, project, df = nodes(spark, random.Random(2), 60)
    below = {}
    for i, p, title, created in rows:
        below.setdefault(p, []).append((created, title, i))

    def tree(entries):
        return [{"id": i, "title": t, "children": tree(below.get(i, []))} for _, t, i in sorted(entries)]

    got = {}
    for r in reports.nested_lines(df).orderBy("project_id", "place").collect():
        got[r.project_id] = got.get(r.project_id, "") + r.line
    strip = lambda x: [{"id": n["id"], "title": n["title"], "children": strip(n["children"])} for n in x]
    for p, text in got.items():
        assert strip(json.loads(text)) == tree([e for e in below[None] if project[e[2]] == p])
    assert set(got) == set(project.values())


def test_pages_have_sections_and_a_grand_total(spark, tmp_path):
    _, project, df = nodes(spark, random.Random(3), 12)
    projects = spark.createDataFrame([("p0", "k0", "<Zeta>"), ("p1", "k1", "Alpha"), ("p2", "k2", "Empty")], "id string, key string, title string")
    reports.write_html(df, str(tmp_path / "page"), "T", "d", projects)
    page = [r.value for r in spark.read.text(str(tmp_path / "page")).collect()]
    heads = [x for x in page if x.startswith("<section>")]
    assert len(page) == 1 + 1 + 3 * 2 + 12 + 1 and ["Alpha" in heads[0], "&lt;Zeta&gt;" in heads[1] or "&lt;Zeta&gt;" in heads[0]] and sum("no usage" in h for h in heads) == 1
    roots = df.where("size(path) = 1").agg(F.sum("unavailable")).first()[0]
    assert f"{roots} unavailable" in page[1] and page[1].startswith("<p>")


def test_numbering_by_ranges(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(50), k) for k in range(500)]
    got = {(r.a, r.b): r.n for r in numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"], "n").collect()}
    assert got == {x: k for k, x in enumerate(sorted(rows), 1)}


def test_imports_are_there_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    files = lambda *names: spark.createDataFrame([(f, json.dumps([{"project": "Alpha", "task": f"t{k % 2}", "session": f"s{k}", "input": k} for k in range(n)])) for f, n in names], "source_path string, content string")
    imports = Imports(spark, str(tmp_path / "i"), digits=1)

    def die(*a, **k):
        raise OSError("died")

    monkeypatch.setattr(imports.store, "commit", die)
    with pytest.raises(OSError):
        imports.apply(documents.prototypes_of(files(("f", 4))))
    monkeypatch.undo()
    assert all(imports.table(n).count() == 0 for n in SCHEMAS) and imports.store.clean() > 0
    assert imports.apply(documents.prototypes_of(files(("f", 4)))) == {"records": 4, "inserted": 4, "duplicates": 0}
    before = {n: sorted(map(str, imports.table(n).collect())) for n in SCHEMAS}
    assert {n: len(r) for n, r in before.items()} == {"projects": 1, "items": 2, "sessions": 4, "events": 4, "spans": 4, "groups": 4, "attributions": 4}
    assert imports.apply(documents.prototypes_of(files(("f", 4)))) == {"records": 4, "inserted": 0, "duplicates": 4}
    assert {n: sorted(map(str, imports.table(n).collect())) for n in SCHEMAS} == before
    assert imports.apply(documents.prototypes_of(files(("f", 6), ("g", 1))))["inserted"] == 3
    met = imports.table("events").join(imports.table("spans"), F.col("id") == F.col("usage_event_id")).join(imports.table("groups"), "span_id").join(imports.table("attributions"), "group_id")
    assert met.count() == 7 and met.where("weight = 10000").join(imports.table("items").select(F.col("id").alias("work_item_id"), F.col("title")), "work_item_id").count() == 7


def test_unlike_buckets_alone_are_joined(spark, tmp_path):
    kept = Identities(spark, str(tmp_path / "k"), digits=1)
    ids = lambda *ranges: spark.createDataFrame([(f"id{k}",) for r in ranges for k in r] + [(None,)], "identity string")
    kept.keep("a", ids(range(100), range(50)))
    kept.keep("b", ids(range(100)))
    assert kept.unlike("a", "b") == [] and kept.difference("a", "b").collect() == []
    kept.keep("b", ids(range(1, 101)))
    assert len(kept.unlike("a", "b")) <= 2
    assert sorted(map(tuple, kept.difference("a", "b").collect())) == [("id0", "removed"), ("id100", "added")]
    kept.keep("none", ids())
    assert kept.difference("none", "a").count() == 100
