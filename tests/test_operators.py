import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numeric, text
from ledgerloom.operators import evidence, raster, relations, retrieval, winners


def test_components_agree_with_flood_fill(spark):
    rng = random.Random(6)
    cells = {g: {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.55} for g in "ab"}
    cells["a"] |= {(0, c) for c in range(14)}
    df = spark.createDataFrame([(g, r, c) for g, s in cells.items() for r, c in s], "scene string, row long, col long")
    for connectivity in (4, 8):
        got = {(r.scene, r.row, r.col): r.region for r in raster.components(df, "scene", connectivity).collect()}
        for g, left in cells.items():
            left, region = set(left), 0
            while left:
                region += 1
                stack = [min(left)]
                left.remove(stack[0])
                while stack:
                    r, c = stack.pop()
                    assert got[g, r, c] == region
                    near = [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (abs(a) + abs(b) == 1 or connectivity == 8 and (a or b))]
                    for n in near:
                        if n in left:
                            left.remove(n)
                            stack.append(n)
    assert raster.components(df.limit(0), "scene").collect() == []


def test_index_thresholds_are_inclusive_and_exact(spark):
    df = spark.createDataFrame([("0.275", "0.725", "0.4", "0.6"), ("0.2", "0.8", "0.325", "0.675"), ("0.3", "0.7", "0.300001", "0.7"), ("0", "0", "0", "0")], "a string, b string, c string, d string")
    before, after = raster.index(F.col("a"), F.col("b")), raster.index(F.col("c"), F.col("d"))
    got = [r[0] for r in df.select(raster.loss(before, after, "0.45", "0.25")).collect()]
    assert got == [True, True, False, None]


def test_rounding_and_plain_text(spark):
    df = spark.sql("SELECT CAST('5.840' AS DECIMAL(10,3)) AS a, CAST('100' AS DECIMAL(10,0)) AS b, 1L AS n, 128L AS d, 0L AS z")
    row = df.select(numeric.plain(F.col("a")), numeric.plain(F.col("b")), numeric.rate(F.col("n"), F.col("d")), numeric.rate(F.col("n"), F.col("z"))).first()
    assert tuple(row) == ("5.84", "100", 0.007812, None)


def test_phrases_and_forms(spark):
    df = spark.createDataFrame([("cbam은 art 5", "cbam"), ("xcbam", "cbam"), ("필지진술서", "진술"), ("a", ""), ("a.b", "a.b")], "t string, p string")
    assert [r[0] for r in df.select(text.contains_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, True, False, True]
    got = spark.createDataFrame([("Ｓtraße",), (None,)], "t string").select(text.compatibility_fold("t"))
    assert [r[0] for r in got.collect()] == ["strasse", None]


def test_order_of_input_does_not_matter(spark, small_data):
    lines = spark.read.parquet(f"{small_data}/trade_case_documents.parquet")
    labels = spark.read.parquet(f"{small_data}/field_labels.parquet")
    flat = evidence.bundle_lines(winners.latest_delivery(lines, "doc_key", "received_at"))
    keys = ["doc_key", "page", "line"]
    once, again = (evidence.match_labels(x, labels, keys) for x in (flat, flat.repartition(5).orderBy(F.rand(3))))
    assert once.exceptAll(again).count() == 0 == again.exceptAll(once).count()


def test_labels_keep_to_words_and_report_rivals(spark):
    labels = spark.createDataFrame([("net mass", "m"), ("mass", "x"), ("price", "p")], "label string, field string")
    lines = spark.createDataFrame([(1, " Net mass: 5"), (2, "massive: 5"), (3, "mass and price: 5"), (4, "the mass: 5"), (5, ""), (6, None)], "k int, text string")
    got = {r.k: (r.label, r.reason) for r in evidence.match_labels(lines, labels, ["k"]).collect()}
    assert got[1] == ("net mass", None) and got[3] == (None, "multiple configured labels")
    assert {got[k] for k in (2, 4, 5, 6)} == {(None, "no configured label")}


def test_spans_are_code_points_of_the_raw_text(spark):
    df = spark.createDataFrame([("라벨 ：  5 t ", 2), ("l = [BLANK]", 1)], "t string, n int")
    value, start, end = evidence.raw_value(F.col("t"), F.col("n"))
    rows = [tuple(r) for r in df.select(value, start, end).collect()]
    assert rows == [("5 t", 6, 9), ("", 4, 11)]


def test_replay_and_trace_find_faults(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.5), (3, 2.0)], "k int, v double")
    row = relations.replay(a, b, ["k"], "v", 0.1).first()
    assert (row.rows, row.unpaired, row.largest, row.within) == (3, 2, 0.5, False)
    steps = spark.createDataFrame([("sum/a", "sum", 5, 1), ("sum", None, 6, 3), ("sum/b/x", "sum/b", 1, 0)], "step_id string, parent_id string, amount int, level int")
    row = relations.trace_check(steps).first()
    assert (row.steps, row.edges, row.dangling, row.wrong_sums) == (3, 2, 1, 1)


def test_scores_do_not_hang_on_other_queries(spark, small_data):
    items = spark.read.parquet(f"{small_data}/eval_items.parquet")
    fields = retrieval.entry_fields(spark.read.parquet(f"{small_data}/legal_corpus.parquet"))
    every = retrieval.bm25f(items, fields, "item_id", "query").filter("item_id = 7")
    alone = retrieval.bm25f(items.filter("item_id = 7"), fields, "item_id", "query")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("name", ["select_winner", "component_inventory", "doc_frequency", "contract_violations"])
def test_plans_stay_in_the_jvm(spark, small_data, name):
    from ledgerloom.plans import catalogue

    plan = catalogue.QUERIES[name](spark, small_data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_across_tiles(spark, connectivity):
    """Pieces of tiles are merged along borders: the same regions for any tile, and for row numbers of any size."""
    rng = random.Random(connectivity)
    cells = {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.6} | {(r, 10) for r in range(20)}
    far = 2**40
    rows = [("s", r, c) for r, c in cells] + [("t", r + far, c + far) for r, c in cells] + [("s", 0, 0), ("s", 0, 0)]
    cells.add((0, 0))
    df = spark.createDataFrame(rows, "scene string, row long, col long")
    whole = {(r.scene, r.row, r.col): r.region for r in raster.components(df, "scene", connectivity).collect()}
    tiled = {(r.scene, r.row, r.col): r.region for r in raster.components(df, "scene", connectivity, tile=3).collect()}
    assert whole == tiled and len([k for k in whole if k[0] == "s"]) == len(cells)


def test_gap_runs_agree_with_the_grid(spark):
    rng = random.Random(4)
    cells = {(g, r, c) for g in "ab" for r in range(9) for c in range(7) if rng.random() < 0.5 and r not in (3, 4)}
    df = spark.createDataFrame(sorted(cells), "scene string, row long, col long")
    got = sorted(tuple(r) for r in raster.grid_gaps(df, "scene").collect())
    want = []
    for g in "ab":
        own = [(r, c) for x, r, c in cells if x == g]
        rows, cols = [r for r, _ in own], [c for _, c in own]
        want += [(g, r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1) if (g, r, c) not in cells]
    assert got == sorted(want)
    stray = spark.createDataFrame([("a", 0, 0), ("a", 10**9, 1)], "scene string, row long, col long")
    assert sorted(tuple(r)[1:] for r in raster.gap_runs(stray, "scene").collect()) == [(0, 0, 1, 1), (1, 10**9 - 1, 0, 1), (10**9, 10**9, 0, 0)]


def test_large_groups_are_ranked_by_range(spark):
    """Spread over tasks or not, positions are the same; null groups are groups."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    order = [F.col("v").desc(), F.col("i").asc()]
    one, many = (sorted((tuple(r) for r in winners.ranked(df, ["g"], order, n).collect()), key=str) for n in (10**6, 10))
    assert one == many
    for g in ("hot", "b", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [r[2] for r in sorted((r for r in one if r[0] == g), key=lambda r: r[3])] == [r[2] for r in want]


def test_alternatives_are_material_or_equivalent(spark):
    rows = [("c", 1, "5.0", 9), ("c", 2, "5.05", 8), ("c", 3, "5", 7), ("c", 4, "x", 6), ("c", 5, None, 5), ("c", 6, "7", 4), (None, 7, "1", 1), (None, 8, "1", 0), ("e", 9, None, 1), ("e", 10, "3", 0)]
    df = spark.createDataFrame(rows, "g string, k int, v string, o int")
    got = {r.k: (r.kind, None if r.difference is None else float(r.difference)) for r in winners.alternatives(df, ["g"], F.col("o"), "k", "v", F.lit(0.1).cast("decimal(4,2)")).collect()}
    assert got == {2: ("equivalent", 0.05), 3: ("equivalent", 0.0), 4: ("material", None), 6: ("material", 2.0)}
