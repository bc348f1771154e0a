import math

import pytest
from pyspark.sql import functions as F

from densigrid.functions.expression import compile_expression, names_in
from densigrid.operators.report import write_report
from densigrid.plans.grid import Axis, Goal, GridError
from densigrid.sources.tables import DEFAULT_GOALS, Store, latest_payload, read_rows


def holds(spark, text, **values):
    df = spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{n} double" for n in values))
    return df.select(compile_expression(text, {n: F.col(n) for n in values}).alias("ok")).first().ok


@pytest.mark.parametrize(
    "text,values,want",
    [
        ("salt < 3 + 0.5 * depth ** 2", {"depth": 4, "salt": 10}, True),
        ("salt < 3 + 0.5 * depth ** 2", {"depth": 2, "salt": 10}, False),
        ("1 < x <= 3", {"x": 3}, True),
        ("x % -3 == -2", {"x": 7}, True),
        ("x / 0 > 1e308", {"x": 1}, True),
        ("x / 0 == x / 0", {"x": 0}, False),
        ("x / 0 != x / 0", {"x": 0}, True),
        ("log(x) < -1e308", {"x": 0}, True),
        ("min(x, 1) < 5 or max(x, 1) > 0", {"x": math.nan}, False),
        ("not x", {"x": 0}, True),
        ("not (x > 1) and abs(-x) == x", {"x": 1}, True),
        ("sqrt(exp(log(x))) == 2", {"x": 4}, True),
    ],
)
def test_expressions(spark, text, values, want):
    assert holds(spark, text, **values) is want


@pytest.mark.parametrize("text", ["__import__('os')", "x.real > 1", "y > 1", "x +", "x + 1", "[x] > 1", "1 and x > 1", "pow(x, 2) > 1", "x if x > 1 else 2", "'a' > 'b'", "min(x) > 1", "abs(x=1) > 1"])
def test_what_the_language_lacks(spark, text):
    with pytest.raises(GridError):
        compile_expression(text, {"x": F.lit(1.0)})


def test_names():
    assert names_in("max(a, 2) > b ** 2") == {"a", "b"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load_goals() == list(DEFAULT_GOALS)
    a, b = (Goal(i, (Axis("x", 0.0, 1.0, 0.1),)) for i in "ab")
    store.save_goals([a])
    store.upsert_goal(b)
    store.upsert_goal(Goal("a", a.axes, 5.0))
    assert [(g.id, g.k) for g in store.load_goals()] == [("a", 5.0), ("b", 10.0)]
    assert store.delete_goal("b") and not store.delete_goal("b")
    with pytest.raises(GridError):
        store.delete_goal("a")
    store.append("records", spark.createDataFrame([("r1", "a"), ("r2", "a")], "record_id string, goal_id string"))
    assert store.delete_record("r1") and not store.delete_record("zz")
    assert [r.record_id for r in store.records().collect()] == ["r2"]
    assert {r.name: r.rows for r in store.status().collect()} == {"goals": 1, "records": 2}
    store.append("records", spark.createDataFrame([("r1", "a")], "record_id string, goal_id string"))
    assert sorted(r.record_id for r in store.records().collect()) == ["r1", "r2"]
    assert store.delete_record("r1") and [r.record_id for r in store.records("a").collect()] == ["r2"]
    silent = Store(spark, store.root, saving=False)
    silent.append("records", spark.createDataFrame([("r9", "a")], "record_id string, goal_id string"))
    assert store.read("records").count() == 3


def test_goals_of_two_writers(spark, tmp_path):
    """Writers at once lose nothing, also if one has read before the other wrote; goals that do not parse are dropped."""
    import threading

    root, axes = str(tmp_path / "s"), (Axis("x", 0.0, 1.0, 0.1),)
    writers = [threading.Thread(target=lambda i=i: [Store(spark, root).upsert_goal(Goal(f"g{i}_{k}", axes)) for k in range(4)]) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    store = Store(spark, root)
    assert {g.id for g in store.load_goals()} == {f"g{i}_{k}" for i in range(4) for k in range(4)} | {"default"} and store.state()[0] == 16
    old = store.at(1)
    assert len(old.load_goals()) == 2
    with pytest.raises(GridError):
        old.save_goals([Goal("z", axes)])
    store.change(lambda now: {**now, "goals": ["{}", "broken", Goal("ok", axes).to_json()]})
    assert [g.id for g in store.load_goals()] == ["ok"]


def test_claims_of_many_writers(spark, tmp_path):
    import threading

    from densigrid.sources import files

    got, folder = [], str(tmp_path / "c")
    writers = [threading.Thread(target=lambda: got.extend(files.claim(spark, folder) for _ in range(12))) for _ in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == list(range(1, 73))
    assert files.publish(spark, f"{folder}/x", "a") and not files.publish(spark, f"{folder}/x", "b") and files.read_text(spark, f"{folder}/x") == "a"


def rebuilt_counts(df):
    return {r.record_id: r.row_count for r in df.collect()}


def test_applied_grids_are_not_stale(spark, tmp_path):
    """Observations that come after a grid was applied, grids A-B-A, a crash before the manifest, deletion, and a pinned reader."""
    store, goal = Store(spark, str(tmp_path / "s")), Goal("tide", (Axis("depth", 0.0, 60.0, 5.0),))
    seen = lambda *rows: store.append("observations", spark.createDataFrame([(r, "tide", [v]) for r, v in rows], "record_id string, goal_id string, v array<double>"))
    store.save_goals([goal])
    with pytest.raises(GridError):
        store.rebuilt_records(goal)
    store.append("records", spark.createDataFrame([("r1", "tide"), ("r2", "tide")], "record_id string, goal_id string"))
    seen(("r1", 1.0))
    assert rebuilt_counts(store.apply_grid("tide", [], ["depth"])) == {"r1": 1}
    pinned = store.at()
    seen(("r1", 2.0), ("r1", 3.0))
    assert rebuilt_counts(store.apply_grid("tide", [], ["depth"])) == {"r1": 3}
    finer = [{"name": "depth", "step": 1.0}]
    assert rebuilt_counts(store.apply_grid("tide", finer, ["depth"])) == {"r1": 3} and store.goal("tide").total_bins == 60
    seen(("r1", 4.0), ("r2", 4.0))
    again = store.apply_grid("tide", [{"name": "depth", "step": 5.0}], ["depth"])
    assert rebuilt_counts(again) == {"r1": 4, "r2": 1} and {r.grid_signature for r in again.collect()} == {goal.signature()}
    assert rebuilt_counts(pinned.rebuilt_records(goal)) == {"r1": 1}
    assert tuple(store.applied_counts(goal).first()) == (2, 0)
    store.append("records", spark.createDataFrame([("r3", "tide")], "record_id string, goal_id string"))
    assert tuple(store.applied_counts(goal).first()) == (2, 1)

    dying = Store(spark, store.root)
    dying.change = lambda how: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        dying.apply_grid("tide", finer, ["depth"])
    assert store.goal("tide").total_bins == 12 and rebuilt_counts(store.rebuilt_records(goal)) == {"r1": 4, "r2": 1}

    other, reads = Store(spark, store.root), store.change
    def overtaken(how):
        other.upsert_goal(goal.with_axes([{"name": "depth", "high": 90.0}]))
        return reads(how)
    store.change = overtaken
    with pytest.raises(GridError):
        store.apply_grid("tide", finer, ["depth"])
    store.change = reads
    store.upsert_goal(goal)

    assert store.delete_record("r1") and rebuilt_counts(store.rebuilt_records(goal)) == {"r2": 1}
    assert rebuilt_counts(store.apply_grid("tide", [], ["depth"])) == {"r2": 1}
    store.append("records", spark.createDataFrame([("r1", "tide")], "record_id string, goal_id string"))
    seen(("r1", 9.0))
    assert rebuilt_counts(store.apply_grid("tide", [], ["depth"])) == {"r1": 1, "r2": 1}


def test_database(spark, tmp_path):
    """Only where it is asked for and named; its ids are its own."""
    import threading

    from densigrid.sources.tables import Database, backend

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    known = {"storage": "Database", "database_url": url, "database_driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert isinstance(backend(spark, {}, "x"), Store) and isinstance(backend(spark, {"database_url": url}, "x"), Store) and isinstance(backend(spark, {"storage": "database"}, "x"), Store)
    assert not backend(spark, {"save": "off"}, "x").saving
    db = backend(spark, known, "x")
    assert isinstance(db, Database)
    db.create()
    db.create()
    write = lambda key, payload: db.append(spark.createDataFrame([(key, payload)], "key string, payload string"))
    writers = [threading.Thread(target=lambda i=i: [write(f"k{i}", str(n)) for n in range(3)]) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    write('odd "key"', '{"a":[1,null]}')
    write("none", None)
    assert {r.key: r.payload for r in db.latest().collect()} == {"k0": "2", "k1": "2", "k2": "2", 'odd "key"': '{"a":[1,null]}', "none": None}
    assert db._read(db.table).count() == 11


def test_previews_and_applied_grids(spark, tmp_path):
    store, goal = Store(spark, str(tmp_path / "s")), Goal("tide", (Axis("depth", 0.0, 60.0, 5.0), Axis("salt", 0.0, 8.0, 1.0)))
    store.save_goals([goal])
    assert store.goal(" tide") == goal
    finer, wider = [{"name": " DEPTH", "step": 2.5}], [{"name": "salt", "high": 16.0}]
    first, second, other = (store.log_preview(goal, s, c, "2024-01-01") for s, c in (("a", finer), ("a", wider), ("b", wider)))
    assert [e["sequence"] for e in (first, second, other)] == [1, 2, 1]
    assert second["axes_before"] == first["axes_after"] and other["axes_before"] == first["axes_before"] and store.read("logs").count() == 3
    obs = [("r1", "tide", [61.0, 1.0]), ("r1", "tide", [3.0, 1.0]), ("r2", "tide", [4.0, 9.0]), ("r3", "other", [1.0, 1.0])]
    store.append("observations", spark.createDataFrame(obs, "record_id string, goal_id string, v array<double>"))
    store.append("records", spark.createDataFrame([("r1", "tide"), ("r2", "tide")], "record_id string, goal_id string"))
    before = store.apply_grid("tide", [], ["depth", "salt"]).orderBy("record_id").collect()
    after = store.apply_grid("tide", finer + wider, ["depth", "salt"]).orderBy("record_id").collect()
    assert [r.record_id for r in after] == ["r1", "r2"] == [r.record_id for r in before] and store.goal("tide").total_bins == 24 * 16
    assert before[0].occupancy_hash != after[0].occupancy_hash and before[1].occupancy_hash is None and after[1].occupancy_hash
    assert store.record("r2").first().goal_id == "tide"
    for wrong in (lambda: store.goal("none"), lambda: store.record("none")):
        with pytest.raises(GridError):
            wrong()


def test_envelopes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert [store.write_envelope(key, payload) for key, payload in (("goals", [1]), ("records", {"a": 1}), ("goals", [2]))] == [1, 2, 3]
    assert {r.key: r.payload for r in latest_payload(store.read("envelopes")).collect()} == {"goals": "[2]", "records": '{"a":1}'}


def test_rows_from_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,10\n3,\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\t10\n")
    assert [tuple(r) for r in read_rows(spark, str(tmp_path / "a.csv")).collect()] == [("1", "10"), ("3", None)]
    assert read_rows(spark, str(tmp_path / "a.tsv")).columns == ["x", "y"]
    with pytest.raises(GridError):
        read_rows(spark, str(tmp_path / "a.xls"))


def test_latest_payload(spark):
    rows = [(1, '{"key":"a_b","payload":1}'), (2, '{"key":"a_b","payload":2}'), (3, '{"key":"axb","payload":3}'), (4, "broken"), (5, None)]
    got = latest_payload(spark.createDataFrame(rows, "id int, content string"))
    assert {r.key: (r.id, r.payload) for r in got.collect()} == {"a_b": (2, "2"), "axb": (3, "3")}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("external", 0.5, "<b>")], "mode string, score double, note string")
    for kind in ("json", "csv", "html"):
        write_report(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().score == "0.5"
    assert "&lt;b&gt;" in spark.read.text(str(tmp_path / "html"), wholetext=True).first().value
    with pytest.raises(ValueError):
        write_report(df, str(tmp_path / "x"), "pdf")


def test_flat_report(spark, tmp_path):
    """The row of all fixed columns, written as csv and read back."""
    from conftest import DATA

    from densigrid import queries
    from densigrid.operators.report import REPORT_FIELDS

    row = queries._report(spark, DATA)
    assert row.columns == list(REPORT_FIELDS) and len(set(REPORT_FIELDS)) == 55
    write_report(row, str(tmp_path / "r"), "csv")
    (back,) = spark.read.options(header=True, escape='"').csv(str(tmp_path / "r")).collect()
    first = row.first()
    assert list(back.asDict()) == list(REPORT_FIELDS)
    assert float(back.specificity_score) == first.specificity_score and back.confidence_reasons == first.confidence_reasons and back.reference_modes == first.reference_modes


def test_streams(spark, tmp_path):
    from densigrid.functions.cells import finite
    from densigrid.streaming.histogram import stream_histogram, windowed_histogram

    goal = Goal("g", (Axis("x", 0.0, 10.0, 1.0),))
    for i in range(3):
        spark.createDataFrame([(float(i),), (5.0,), (99.0,)], "x double").selectExpr("x", "timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x,0) AS ts").write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("x double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_histogram(events, goal, {"x": finite(F.col("x"))}).writeStream.format("memory").queryName("hist").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.cell[0]: r.cnt for r in spark.table("hist").collect()} == {0: 1, 1: 1, 2: 1, 5: 3}
    assert "window" in windowed_histogram(events, goal, {"x": finite(F.col("x"))}, "ts", "1 minute", "5 minutes").columns
