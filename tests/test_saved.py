"""Snapshots and records of several generations, and whatever is wrong in them."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from densigrid.sources import saved


def snapshots(spark, *values):
    df = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    return [r.s.asDict() for r in df.select("i", saved.snapshot(F.col("t")).alias("s")).orderBy("i").collect()]


def test_spellings():
    assert len(saved.SNAPSHOT) == 48 and sum(len(saved.spellings(k)) - 1 for k in saved.SNAPSHOT) == 43
    assert saved.spellings("observationSupportS") == ["observationSupportS", "observation_support_s", "observation_support_S"] and saved.spellings("confidence") == ["confidence"]


def test_every_spelling_gives_the_same(spark):
    value = {"double": 0.5, "long": 3, "boolean": True, "string": "x", "json": [1]}
    new = {k: value[t] for k, t in saved.SNAPSHOT.items()}
    forms = [{saved.spellings(k)[min(i, len(saved.spellings(k)) - 1)]: v for k, v in new.items()} for i in range(3)]
    a, b, c = snapshots(spark, *forms)
    assert a == b == c and a["coverageC"] == 0.5 and a["feasibleExpressions"] == "[1]" and a["other"] == {}
    assert all(v is not None for v in a.values())


def test_odd_snapshots(spark):
    empty, null, text, listed, broken = snapshots(spark, {}, None, "text", [1], "{broken")
    assert empty == null == text == listed == broken
    assert (empty["referenceModes"], empty["feasibleExpressions"], empty["outOfDomainWarnings"], empty["confidence"], empty["other"]) == ("{}", "[]", "[]", None, {})
    last, nulls, wrong = snapshots(spark, '{"specificityScore":1,"specificity_score":2,"z":1,"z":{"y":[2]}}', '{"total_bins":4,"totalBins":null,"feasible_expressions":null,"referenceModes":null}', {"confidence": "high", "outOfDomainWarnings": {"a": 1}, "engine": 7})
    assert last["specificityScore"] == 2.0 and last["other"] == {"z": '{"y":[2]}'}
    assert nulls["totalBins"] is None and nulls["feasibleExpressions"] is None and nulls["referenceModes"] is None
    assert wrong["confidence"] is None and wrong["outOfDomainWarnings"] == "[]" and wrong["engine"] == "7"


GOOD = {"id": "r", "goalId": " g", "axisNames": ["B ", "a"], "values": [1, "2.5"]}


def normal(spark, *items):
    df = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(items)], "i int, item string")
    return [r for r in saved.records(df, "now").orderBy("i").collect()]


def test_a_record_with_little_in_it(spark):
    (r,) = normal(spark, GOOD)
    assert r.reason is None and (r.record_id, r.goal_id, r.axis_names, r.values, r.means, r.axis_signature) == ("r", "g", ["B", "a"], [1.0, 2.5], [1.0, 2.5], "a|b")
    assert (r.row_count, r.bin_occupancy, r.axis_bin_occupancy, r.vectors, r.vector_axis_order, r.variances, r.created_at, r.uploaded_at, r.summary_method) == (1, {}, [], [], ["B", "a"], None, "now", "now", "mean")
    assert r.occupancy_hash == hashlib.sha256(b"{}").hexdigest() and r.meta.total_rows == 1 and r.vector_row_count == 1 and r.at_upload.confidence is None


def test_a_record_with_all(spark):
    full = {
        **GOOD, "rowCount": "7", "binOccupancy": {"[0,1]": 3, "[0,0]": "2", "[9,9]": 0, "[8,8]": "x", "[7,7]": 2.9}, "axisBinOccupancy": {"a": {"0": 1, "1": -1}, "B": 5, "c": {"0": 0}},
        "binOccupancyMeta": {"invalidRowCount": 4, "infeasibleRowCount": 2, "totalRows": 11}, "valuesVariance": [1, 2], "valuesStd": [1], "rowLevelVectors": [[1, 2], [1], ["3", "4"], ["x", 1], 5, None],
        "rowLevelVectorAxisOrder": ["a", "b "], "uploadedAt": "2021", "source_batch_id": "s", "summary_method": "median", "validMultidimensionalNumericRowCount": 5, "analysisAtUpload": {"confidence": 0.5},
    }
    (r,) = normal(spark, full)
    assert (r.row_count, r.bin_occupancy, [tuple(x) for x in r.axis_bin_occupancy], r.vectors, r.vector_axis_order) == (7, {"[0,1]": 3, "[0,0]": 2, "[7,7]": 2}, [("a", {"0": 1})], [[1.0, 2.0], [3.0, 4.0]], ["a", "b"])
    assert r.occupancy_hash == hashlib.sha256(b'{"[0,0]":2,"[0,1]":3,"[7,7]":2}').hexdigest()
    assert r.meta.asDict() == {"valid_rows": 7, "feasible_rows": 7, "invalid_rows": 4, "out_of_domain_rows": 0, "masked_rows": 2, "masked_bins": 0, "total_rows": 11}
    assert (r.variances, r.deviations, r.created_at, r.uploaded_at, r.source_batch_id, r.summary_method, r.vector_row_count, r.at_upload.confidence) == ([1.0, 2.0], None, "2021", "2021", "s", "median", 5, 0.5)


@pytest.mark.parametrize(
    "wrong,reason",
    [
        ("[1]", "no_object"), (None, "no_object"), ("{broken", "no_axis_names"), ({**GOOD, "axisNames": "a"}, "no_axis_names"), ({**GOOD, "axisNames": ["a", None]}, "no_axis_names"),
        ({**GOOD, "values": None}, "no_values"), ({**GOOD, "values": [1, "x"]}, "value_no_number"), ({**GOOD, "values": [1, None]}, "value_no_number"), ({**GOOD, "values": [1, "nan"]}, "value_no_number"),
        ({**GOOD, "values": [1]}, "lengths_differ"), ({k: v for k, v in GOOD.items() if k != "goalId"}, "no_goal"), ({**GOOD, "rowCount": "many"}, "row_count_no_number"),
    ],
)
def test_records_that_cannot_be_used(spark, wrong, reason):
    (r,) = normal(spark, wrong)
    assert r.reason == reason


def test_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "clusters": [GOOD, 5, {**GOOD, "values": []}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{**GOOD, "id": "s"}]))
    (tmp_path / "c.json").write_text('{"other": 1}')
    (tmp_path / "d.json").write_text("nothing")
    found = saved.read_records(spark, str(tmp_path), "now")
    assert sorted(r.record_id for r in saved.usable(found).collect()) == ["r", "s"]
    assert {r.reason: r.records for r in saved.dropped(found).collect()} == {"no_object": 1, "lengths_differ": 1}


AXIS = {"name": "Depth", "domainMin": 0, "domainMax": "10", "resolution": 1}
GOAL = {"id": " g ", "name": " Tide ", "axes": [{**AXIS, "name": " salt", "unit": " % "}, AXIS, {**AXIS, "name": "yield", "role": " OUTPUT "}]}


def stored(spark, *values):
    df = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, goal string")
    return saved.goals(df).orderBy("i")


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"name": " "}, "no_name"), ({"axes": []}, "no_axes"), ({"axes": 3}, "no_axes"), ({"K_m": "x"}, "k_no_number"), ({"K_m": 0}, "k_not_positive"), ({"km": -1}, "k_not_positive"),
        ({"axes": [{**AXIS, "name": " "}]}, "axis_without_name"), ({"axes": [AXIS, {**AXIS, "name": "DEPTH "}]}, "axis_twice"), ({"axes": [{**AXIS, "resolution": None}]}, "axis_no_number"),
        ({"axes": [{**AXIS, "domainMax": "nan"}]}, "axis_no_number"), ({"axes": [{**AXIS, "role": "output"}]}, "no_input_axis"), ({"axes": [{**AXIS, "domainMax": 0}]}, "axis_domain"), ({"axes": [{**AXIS, "resolution": -1}]}, "axis_resolution"),
    ],
)
def test_goals_that_cannot_be_used(spark, change, reason):
    assert stored(spark, {**GOAL, **change}).first().reason == reason


def test_goals_of_older_forms(spark):
    rule = {"id": "r", "enabled": True, "expression": "own", "guiSpec": {"type": "conditional_range", "if": {"axis": "Depth", "op": ">", "value": 5}, "then": {"axis": "salt", "min": 0, "max": 4}}}
    out = {**rule, "guiSpec": {**rule["guiSpec"], "then": {"axis": "yield", "min": 0, "max": 4}}}
    full = {**GOAL, "km": "5", "feasibleDomainRules": [rule, out, 7, {"guiSpec": {"type": "conditional_range"}}], "legacyAdvancedExpressions": ["b", " a ", ""], "feasibleDomainAdvancedExpressions": ["a", "c"], "feasibleDomainExpressions": ["own", "d", "b"]}
    rows = stored(spark, full, {k: v for k, v in GOAL.items() if k != "id"}, "7", None)
    first, nameless, number, null = rows.collect()
    assert (first.goal_id, first.name, first.k, first.legacy, first.input_axes, first.output_axes, int(first.total_bins)) == ("g", "Tide", 5.0, ["b", "a", "c", "d"], ["Depth", "salt"], ["yield"], 100)
    assert [(a.name, a.unit, a.role) for a in first.axes] == [("Depth", "", "input"), ("salt", "%", "input"), ("yield", "", "output")]
    assert nameless.k == 10.0 and nameless.legacy == [] and nameless.goal_id == "goal_" + hashlib.sha1(b"Tide").hexdigest()[:12]
    assert number.reason == null.reason == "no_object"
    goals = {g.id: g for g in saved.as_goals(rows)}
    assert set(goals) == {"g", nameless.goal_id} and [r["id"] for r in goals["g"].rules] == ["r"] and goals["g"].k == 5.0 and goals["g"].design.names == ["Depth", "salt"]


def test_snapshot_of_a_report(spark):
    row = spark.createDataFrame([('say "x"\n', 0.5, 3, True, '[{"a":1}]', None, "t")], "engine string, specificity_score double, peer_group_size long, no_external_reference boolean, reference_modes string, coverage_C double, analysis_timestamp string")
    text = row.select(saved.at_upload(row).alias("t")).first().t
    assert json.loads(text) == {"engine": 'say "x"\n', "specificityScore": 0.5, "peerGroupSize": 3, "noExternalReference": True, "referenceModes": [{"a": 1}], "coverageC": None, "analysisTimestamp": "t"}
    (back,) = snapshots(spark, text)
    assert (back["engine"], back["specificityScore"], back["peerGroupSize"], back["noExternalReference"], back["referenceModes"], back["coverageC"]) == ('say "x"\n', 0.5, 3, True, '[{"a":1}]', None)


def test_preview_logs(spark):
    full = {
        "id": " l ", "sessionId": "s", "createdAt": "t", "sequence": "3.7", "action": "", "axesBefore": [AXIS, {**AXIS, "name": ""}, {**AXIS, "resolution": "x"}, 5], "axesAfter": 7,
        "referenceModesBefore": {"internal": {"label": "own", "aValid": 2.9, "confidence": "0.5"}, "external": {"targetIncludedInReference": "x", "noExternalReference": 0, "coverageC": []}, "pooled": [1]},
        "referenceModesAfter": [1], "appliedAsGoalDefault": 1, "appliedAt": " ",
    }
    texts = [full, {"id": "m", "sessionId": "s", "createdAt": "t", "sequence": -4}, {"id": "n", "sessionId": "", "createdAt": "t"}, {"id": "o", "sessionId": "s"}, [1], None]
    df = spark.createDataFrame([(None if t is None else json.dumps(t),) for t in texts], "entry string")
    first, second = saved.logs(df).orderBy("log_id").collect()
    assert (first.log_id, first.sequence, first.action, first.applied, first.applied_at, first.axes_after, first.modes_after) == ("l", 3, "preview_recalculated", True, None, [], [])
    assert [tuple(a) for a in first.axes_before] == [("Depth", 0.0, 10.0, 1.0)]
    external, internal = first.modes_before
    assert (external.mode, external.label, external.target_included, external.no_external, external.coverageC) == ("external", "External", True, False, None)
    assert (internal.label, internal.aValid, internal.confidence, internal.policy) == ("own", 2, 0.5, "")
    assert (second.sequence, second.applied, second.modes_before) == (1, False, [])
