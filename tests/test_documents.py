"""Documents as ordered lines against the nested details, places by key against brute force, and trees by pointer doubling."""

import collections
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import tables_for
from ledgerloom.operators.documents import positions, write_documents
from ledgerloom.plans import insights, receiving, shipping
from ledgerloom.sources.snapshot import materialize
from ledgerloom.tables import Tables
from tables_at import SMALL


@pytest.fixture()
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_positions_of_a_hot_key(spark, many_partitions):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "c", "z"]), rng.randrange(4000)) for _ in range(6000)] + [("tie", 1)] * 5 + [("last", 0)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = collections.defaultdict(list)
    placed = positions(df, ["k"], [F.col("v")])
    for r in placed.collect():
        got[r.k].append((r.position, r.v))
    want = collections.defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    for k, values in want.items():
        assert sorted(got[k]) == list(enumerate(sorted(values)))
    assert set(got) == set(want) and positions(df.where("false"), ["k"], [F.col("v")]).count() == 0


def test_positions_go_on_over_several_runs(spark, many_partitions):
    df = spark.range(5000).select(F.lit("one").alias("k"), F.col("id").alias("v"))
    assert positions(df, ["k"], [F.col("v").desc()]).where("position != 4999 - v").count() == 0


def texts(lines):
    out = collections.defaultdict(list)
    for r in lines.collect():
        out[r[0]].append((r.section, r.position, r.line))
    return {k: "".join(x[2] for x in sorted(v)) for k, v in out.items()}


def as_json(detail):
    detail = receiving._stringify_ts(detail.drop("page"))
    return {r.id: r.doc for r in detail.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("doc")).collect()}


@pytest.mark.parametrize("lines, detail", [(receiving.inspection_report_lines, receiving.inspection_report_detail),
                                           (receiving.receiving_order_lines, receiving.receiving_order_detail),
                                           (shipping.shipping_order_lines, shipping.shipping_order_detail)])
def test_lines_are_the_nested_documents(spark, lines, detail):
    t = tables_for(spark, SMALL)
    got = texts(lines(t))
    assert got == as_json(detail(t)) and all(json.loads(x) for x in got.values())
    some = sorted(got)[:3]
    assert texts(lines(t, ids=some)) == {k: got[k] for k in some}


def test_a_large_document_is_written_by_many_tasks(spark, many_partitions, tmpdir_path):
    checks = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 40 + 10).cast("long").alias("inspection_report_id"),
                                      F.lit("weight").alias("check_item"), F.lit("pass").alias("result"))
    reports = spark.createDataFrame([(i, i, "Ann", 80.0) for i in (5, *range(10, 50), 99)], "id long, receiving_order_id long, inspector string, overall_rating double")
    t = Tables.from_frames(spark, {"quality_checks": checks, "inspection_reports": reports})
    lines = receiving.inspection_report_lines(t)
    write_documents(lines, f"{tmpdir_path}/docs")
    files = sorted(glob.glob(f"{tmpdir_path}/docs/part-*"))
    parts = [open(f, encoding="utf-8").read() for f in files]
    docs, decoder, text = [], json.JSONDecoder(), "".join(parts).strip()
    while text:
        doc, end = decoder.raw_decode(text)
        docs.append(doc)
        text = text[end:].lstrip()
    assert [d["id"] for d in docs] == [5, *range(10, 50), 99]
    assert [c["id"] for c in docs[0]["quality_checks"]] == [i for i in range(9000) if i % 3] and docs[-1]["quality_checks"] == []
    first = "".join(parts).index('{"id":10,"receiving_order_id"')  # where the large document ends
    sizes = [len(p) for p in parts]
    assert sum(sum(sizes[:i]) < first for i in range(len(sizes))) >= 4


# ---- category trees


def cats(spark, rows):
    return Tables.from_frames(spark, {"categories": spark.createDataFrame(rows, "id long, name string, parent_id long")})


def brute_tree(rows):
    parent, name = {i: p for i, _, p in rows}, {i: n for i, n, _ in rows}
    good, circles = {}, {}
    for i in parent:
        chain, seen = [i], {i}
        while parent.get(chain[-1]) is not None and parent[chain[-1]] in parent and parent[chain[-1]] not in seen:
            chain.append(parent[chain[-1]])
            seen.add(chain[-1])
        last = parent[chain[-1]]
        if last is None:
            good[i] = (len(chain) - 1, " > ".join(name[c] for c in reversed(chain)))
        elif last == i:
            circles[i] = min(chain)
    return good, circles


def test_trees_and_circles_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"n{i}", rng.choice([None, i - 1, rng.randrange(300), 999, i]) if rng.random() < 0.5 else rng.randrange(max(1, i))) for i in range(300)]
    rows += [(400 + i, "c", 400 + (i + 1) % 7) for i in range(7)] + [(500, "under", 403)]
    good, circles = brute_tree(rows)
    t = cats(spark, rows)
    assert {r.id: (r.depth, r.path) for r in insights.category_tree(t).collect()} == good
    assert {r.id: r.cycle_id for r in insights.category_cycles(t).collect()} == circles and len(circles) > 7


def test_a_deep_chain(spark):
    rows = [(i, "n", i - 1 if i else None) for i in range(3000)]
    got = {r.id: (r.depth, r.n) for r in insights.category_tree(cats(spark, rows)).select("id", "depth", F.length("path").alias("n")).collect()}
    assert got == {i: (i, 4 * i + 1) for i in range(3000)}
    assert insights.category_cycles(cats(spark, rows)).count() == 0
    assert insights.category_tree(cats(spark, rows).__class__.from_frames(spark, {"categories": spark.createDataFrame([], "id long, name string, parent_id long")})).count() == 0


def test_trees_and_circles_broadcast_nothing(spark, monkeypatch):
    """Files far below the broadcast threshold: no round may gather a side on the driver, and rounds follow the longest branch or circle."""
    plans = []

    def watched(spark, df, *args):
        plans.append(df._jdf.queryExecution().executedPlan())  # adaptive: shows the plan as it ran
        out = materialize(spark, df, *args)
        df.count()
        return out

    monkeypatch.setattr(insights, "materialize", watched)
    last = lambda i: i % 10
    rows = [(i, f"n{i}", i + 1 if last(i) < 2 else i - 2 if last(i) == 2 else i - 3 if last(i) < 6 else None) for i in range(2000)]
    t = cats(spark, rows)
    found = insights.category_cycles(t)
    assert {r.id: r.cycle_id for r in found.collect()} == {i: i - last(i) for i in range(2000) if last(i) < 3}
    assert len(plans) <= 9
    insights.category_tree(t).collect()
    plans.append(found._jdf.queryExecution().executedPlan())
    assert not any("Broadcast" in p.toString() for p in plans)
    repeated = cats(spark, [*rows, *rows[:20]])
    assert {(r.id, r.cycle_id) for r in insights.category_cycles(repeated).collect()} == {(i, i - last(i)) for i in range(2000) if last(i) < 3}


def test_long_branches_into_circles_of_any_length(spark):
    rows = [(i, "up", i + 1) for i in range(90)] + [(90, "in", 250)]
    rows += [(200 + i, "c", 200 + (i + 1) % 64) for i in range(64)]
    rows += [(300, "self", 300), (301, "under", 300), (400, "two", 401), (401, "two", 400), (500, "lost", 999), *((501 + i, "lost", 500 + i) for i in range(30))]
    _, circles = brute_tree(rows)
    assert {r.id: r.cycle_id for r in insights.category_cycles(cats(spark, rows)).collect()} == circles and len(circles) == 67
