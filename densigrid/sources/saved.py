"""Records and snapshots as JSON of several generations, read into one shape.

A snapshot is what was found about a dataset when it was uploaded; a record is what was saved of the dataset.  Both are read
on the cluster, one text a row, whatever is wrong in them: a snapshot that is no object is an empty one, a record that cannot
be used has the reason beside it.
"""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.functions import cells
from densigrid.plans.grid import Axis, Goal, GridError, rule_axes
from densigrid.plans.rules import normalised

#: Fixed keys of a snapshot, with their types.
SNAPSHOT = {
    "analysisTimestamp": "string", "peerGroupSize": "long", "peerRecordCount": "long", "externalPeerRecordCount": "long", "externalPeerObservationCount": "long",
    "referenceObservationCount": "long", "referenceOccupiedBins": "long", "targetIncludedInReference": "boolean", "primaryReferenceMode": "string", "referenceModes": "json",
    "noExternalReference": "boolean", "internalDensityMode": "boolean", "selfContainedReferenceWarning": "string", "engine": "string", "specificityMethod": "string",
    "specificityInterpretation": "string", "specificityScore": "double", "meanBinSpecificity": "double", "maxSpecificity": "double", "extremeSpecificityRate": "double",
    "meanRarity": "double", "maxRarity": "double", "unseenBinRate": "double", "rareBinRate": "double", "outOfDomainRate": "double", "confidence": "double",
    "observationSupportS": "double", "coverageC": "double", "equitabilityE": "double", "peerObservationCount": "long", "validTargetRows": "long", "invalidTargetRows": "long",
    "outOfDomainRows": "long", "maskedOutTargetRows": "long", "infeasibleTargetRows": "long", "totalBins": "long", "validBins": "long", "maskedBins": "long",
    "validDomainRatio": "double", "occupiedBins": "long", "feasibleMaskEnabled": "boolean", "feasibleMaskEvaluationSkipped": "boolean", "feasibleMaskWarning": "string",
    "coverageWarning": "string", "feasibleExpressions": "json", "infeasiblePeerRows": "long", "infeasiblePeerBins": "long", "outOfDomainWarnings": "json",
}
#: Of these there never was an older spelling.
ONE_SPELLING = ("analysisTimestamp", "peerGroupSize", "primaryReferenceMode", "referenceModes", "noExternalReference", "engine", "confidence", "outOfDomainWarnings")
#: What stands for a key that is missing, where that is not null.
ABSENT = {"referenceModes": "{}", "feasibleExpressions": "[]"}


def spellings(key: str) -> list[str]:
    """A key and its older spellings: words parted by underscores, a single capital at the end as it is or small."""
    if key in ONE_SPELLING:
        return [key]
    words = re.sub(r"([A-Z])", r"_\1", key).split("_")
    small = "_".join(w.lower() for w in words)
    return [key, small] + ([f"{small[:-1]}{key[-1]}"] if key[-1].isupper() else [])


def _last(entries: Column, *keys) -> Column:
    """The last entry with one of the keys, or null."""
    mine = F.filter(entries, lambda e: e["key"].isin(*keys))
    return F.get(mine, F.size(mine) - 1)


def _typed(value: Column, kind: str) -> Column:
    return value.try_cast(kind) if kind in ("double", "long", "boolean") else value


def snapshot(text: Column) -> Column:
    """A struct of the keys of SNAPSHOT and ``other``, a map of all further keys to their values as text.

    Of several spellings of one key the last in the text holds, also if it is null.  Values of a wrong type are null; lists and
    objects stay JSON.  What is not an object counts as an empty one.
    """
    entries = F.map_entries(F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>"), F.create_map().cast("map<string,string>")))
    known = [s for key in SNAPSHOT for s in spellings(key)]

    def made(found: Column) -> Column:
        parts = []
        for key, kind in SNAPSHOT.items():
            last = _last(found, *spellings(key))
            value = _typed(last["value"], kind)
            if key in ABSENT:
                value = F.when(last.isNull(), F.lit(ABSENT[key])).otherwise(value)
            if key == "outOfDomainWarnings":
                value = F.when(value.rlike(r"^\s*\["), value).otherwise(F.lit("[]"))
            parts.append(value.alias(key))
        other = F.filter(found, lambda e: ~e["key"].isin(*known))
        keys = F.array_distinct(F.transform(other, lambda e: e["key"]))
        return F.struct(*parts, F.map_from_arrays(keys, F.transform(keys, lambda k: _last(other, k)["value"])).alias("other"))

    return F.transform(F.array(entries), made)[0]


def items(content: Column) -> Column:
    """Records, each as JSON text, of a store's content: an object with ``clusters``, or a list; of anything else none."""
    inner = F.when(content.rlike(r"^\s*\{"), F.get_json_object(content, "$.clusters")).when(content.rlike(r"^\s*\["), content)
    return F.coalesce(F.from_json(inner, "array<string>"), F.array().cast("array<string>"))


_RECORD = (
    "id string, goalId string, goalName string, axisNames array<string>, values array<string>, valuesMean array<string>, valuesVariance array<string>, valuesStd array<string>, rowCount string,"
    " binOccupancy map<string,string>, axisBinOccupancy map<string,string>, binOccupancyMeta map<string,string>, binOccupancyHash string, clusterVectorRowCount string,"
    " validMultidimensionalNumericRowCount string, axisNumericCounts map<string,string>, rowLevelVectorAxisOrder array<string>, rowLevelVectors array<string>, gridSignature string,"
    " createdAt string, uploadedAt string, sourceBatchId string, source_batch_id string, summaryMethod string, summary_method string, analysisAtUpload string"
)


def counted(counts: Column) -> Column:
    """A map of keys to whole numbers above 0; others are left out."""
    numbers = F.transform_values(counts, lambda k, v: v.try_cast("double").try_cast("long"))
    return F.coalesce(F.map_filter(numbers, lambda k, v: v.isNotNull() & (v > 0)), F.create_map().cast("map<string,bigint>"))


def occupancy_hash(counts: Column) -> Column:
    """sha256 of a histogram map as compact JSON with sorted keys."""
    parts = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string")))
    return F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256)


def _whole(text: Column, absent: int) -> Column:
    """A whole number; ``absent`` for null, an empty text and 0; null for what is no number."""
    number = F.floor(text.try_cast("double"))
    return F.when(F.coalesce(text, F.lit("")).isin("", "0"), F.lit(absent)).otherwise(F.when(number == 0, F.lit(absent)).otherwise(number)).cast("long")


def records(texts: DataFrame, now: str, text: str = "item") -> DataFrame:
    """Of records as JSON text, each normalised, with ``reason``: null if it can be used, else what it lacks.

    Needed are a goal, names of axes and as many finite values.  Missing counts are made from the histogram, wrong ones are
    left out, rows of vectors of another width or with a value that is no number too; a time that is missing is ``now``.
    """
    r = F.from_json(F.when(F.col(text).rlike(r"^\s*\{"), F.col(text)), _RECORD)
    df = texts.withColumn("__r", r)
    f = lambda n: F.col(f"__r.{n}")
    names = F.transform(f("axisNames"), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
    values = F.transform(f("values"), cells.parsed)
    row_count = _whole(f("rowCount"), 1)
    reason = (
        F.when(~F.coalesce(F.col(text).rlike(r"^\s*\{"), F.lit(False)), "no_object")
        .when(f("axisNames").isNull() | F.exists(f("axisNames"), lambda n: n.isNull()), "no_axis_names")
        .when(f("values").isNull(), "no_values")
        .when(F.exists(values, lambda v: v.isNull()), "value_no_number")
        .when(F.size(names) != F.size(values), "lengths_differ")
        .when(f("goalId").isNull(), "no_goal")
        .when(row_count.isNull(), "row_count_no_number")
    )
    counts = counted(f("binOccupancy"))
    meta = lambda *keys: F.coalesce(*[_whole(f("binOccupancyMeta")[k], 0) for k in keys], F.lit(0).cast("long"))
    either = lambda a, b: F.when(meta(a) > 0, meta(a)).otherwise(meta(b))
    filled = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, v: a + v)
    valid = F.when(f("binOccupancyMeta")["validMultidimensionalRowCount"].isNull(), filled).otherwise(meta("validMultidimensionalRowCount"))
    order = F.when(F.size(f("rowLevelVectorAxisOrder")) > 0, F.transform(f("rowLevelVectorAxisOrder"), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))).otherwise(names)
    lists = F.transform(F.filter(f("rowLevelVectors"), lambda v: v.rlike(r"^\s*\[")), lambda v: F.from_json(v, "array<string>"))
    rows = F.transform(F.filter(lists, lambda v: F.size(v) == F.size(order)), lambda v: F.transform(v, cells.parsed))
    rows = F.coalesce(F.filter(rows, lambda v: F.forall(v, lambda x: x.isNotNull())), F.array().cast("array<array<double>>"))
    optional = lambda n: F.when((F.size(f(n)) == F.size(values)) & F.forall(F.transform(f(n), cells.parsed), lambda x: x.isNotNull()), F.transform(f(n), cells.parsed))
    given = lambda *ns: F.coalesce(*[F.nullif(f(n), F.lit("")) for n in ns])
    created = F.coalesce(given("createdAt", "uploadedAt"), F.lit(now))
    axis_counts = F.filter(F.transform(F.map_entries(f("axisBinOccupancy")), lambda e: F.struct(e["key"].alias("axis"), counted(F.from_json(e["value"], "map<string,string>")).alias("counts"))), lambda e: F.size(e["counts"]) > 0)
    out = df.select(
        *[c for c in texts.columns if c != text],
        reason.alias("reason"),
        f("id").alias("record_id"),
        F.regexp_replace(f("goalId"), r"^\s+|\s+$", "").alias("goal_id"),
        F.coalesce(f("goalName"), F.lit("")).alias("goal_name"),
        names.alias("axis_names"),
        cells.subset_key(names).alias("axis_signature"),
        F.coalesce(F.trim(f("gridSignature")), F.lit("")).alias("grid_signature"),
        values.alias("values"),
        F.coalesce(optional("valuesMean"), values).alias("means"),
        optional("valuesVariance").alias("variances"),
        optional("valuesStd").alias("deviations"),
        row_count.alias("row_count"),
        counts.alias("bin_occupancy"),
        F.coalesce(axis_counts, F.array().cast("array<struct<axis:string,counts:map<string,bigint>>>")).alias("axis_bin_occupancy"),
        F.coalesce(given("binOccupancyHash"), occupancy_hash(counts)).alias("occupancy_hash"),
        F.struct(
            valid.alias("valid_rows"), F.when(meta("feasibleValidRowCount") > 0, meta("feasibleValidRowCount")).otherwise(valid).alias("feasible_rows"), meta("invalidRowCount").alias("invalid_rows"),
            meta("outOfDomainRowCount").alias("out_of_domain_rows"), either("maskedOutRowCount", "infeasibleRowCount").alias("masked_rows"), meta("maskedOutBinCount").alias("masked_bins"),
            F.when(meta("totalRows") > 0, meta("totalRows")).otherwise(row_count).alias("total_rows"),
        ).alias("meta"),
        F.coalesce(_whole(f("clusterVectorRowCount"), 0), F.lit(0)).alias("__vectors"),
        _whole(f("validMultidimensionalNumericRowCount"), 0).alias("__numeric"),
        counted(f("axisNumericCounts")).alias("axis_numeric_counts"),
        order.alias("vector_axis_order"),
        rows.alias("vectors"),
        created.alias("created_at"),
        F.coalesce(given("uploadedAt"), created).alias("uploaded_at"),
        given("sourceBatchId", "source_batch_id").alias("source_batch_id"),
        F.coalesce(given("summaryMethod", "summary_method"), F.lit("mean")).alias("summary_method"),
        snapshot(f("analysisAtUpload")).alias("at_upload"),
    )
    vector_rows = F.when(F.col("__vectors") > 0, F.col("__vectors")).when(F.col("__numeric") > 0, F.col("__numeric")).otherwise(F.col("row_count"))
    return out.withColumn("vector_row_count", vector_rows).drop("__vectors", "__numeric")


def read_records(spark: SparkSession, path: str, now: str) -> DataFrame:
    """All records of the JSON files under a path, each with ``reason``.  A file is an object with ``clusters`` or a list; each
    is one text, as JSON lists cannot be split, so large histories belong in many files."""
    texts = spark.read.text(path, wholetext=True)
    return records(texts.select(F.explode(items(F.col("value"))).alias("item")), now)


def usable(found: DataFrame) -> DataFrame:
    return found.where("reason IS NULL").drop("reason")


def dropped(found: DataFrame) -> DataFrame:
    """reason, records: what was left out, and why."""
    return found.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("records"))



#: Fixed value of a goal's K where it names none.
K = 10.0

_GOAL = (
    "id string, name string, K_m string, km string, axes array<struct<name:string,unit:string,domainMin:string,domainMax:string,resolution:string,role:string>>, feasibleDomainRules array<string>,"
    " legacyAdvancedExpressions array<string>, feasibleDomainAdvancedExpressions array<string>, feasibleDomainExpressions array<string>"
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def expressions(*lists: Column) -> Column:
    """The expressions of several lists in order, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), stripped), lambda x: x != ""))


def goals(texts: DataFrame, text: str = "goal") -> DataFrame:
    """Of goals as JSON text, each normalised, with ``reason``: null if it can be used, else what is wrong with it.

    goal_id (if there is none, made from the name), name, k, axes (canonical order; low, high, step, unit, role), names of input and output
    axes, total_bins of the input axes, rules as JSON, and legacy: the older expressions in order, each once, without those
    that the rules' own texts repeat.
    """
    df = texts.withColumn("__g", F.from_json(F.when(F.col(text).rlike(r"^\s*\{"), F.col(text)), _GOAL))
    f = lambda n: F.col(f"__g.{n}")
    number = lambda x: F.when(F.abs(x.try_cast("double")) < float("inf"), x.try_cast("double"))
    axis = lambda a: F.struct(F.lower(stripped(a["name"])).alias("key"), stripped(a["name"]).alias("name"), number(a["domainMin"]).alias("low"), number(a["domainMax"]).alias("high"), number(a["resolution"]).alias("step"), stripped(a["unit"]).alias("unit"), F.when(F.lower(stripped(a["role"])) == "output", "output").otherwise("input").alias("role"))
    axes = F.array_sort(F.transform(f("axes"), axis))
    given_k = F.coalesce(f("K_m"), f("km"))
    k = F.when(given_k.isNull(), F.lit(K)).otherwise(number(given_k))
    rules = F.coalesce(f("feasibleDomainRules"), F.array().cast("array<string>"))
    rule_texts = F.array_compact(F.transform(rules, lambda r: F.get_json_object(r, "$.expression")))
    own = F.filter(f("feasibleDomainExpressions"), lambda x: ~F.array_contains(rule_texts, stripped(x)))
    name = stripped(f("name"))
    df = df.withColumns({"__axes": axes, "__k": k, "__name": name, "__rules": rules, "__legacy": expressions(f("legacyAdvancedExpressions"), f("feasibleDomainAdvancedExpressions"), own)})
    ax, inputs = F.col("__axes"), F.filter("__axes", lambda a: a["role"] == "input")
    reason = (
        F.when(~F.coalesce(F.col(text).rlike(r"^\s*\{"), F.lit(False)), "no_object")
        .when(F.col("__name") == "", "no_name")
        .when(ax.isNull() | (F.size(ax) <= 0), "no_axes")
        .when(F.col("__k").isNull(), "k_no_number")
        .when(F.col("__k") <= 0, "k_not_positive")
        .when(F.exists(ax, lambda a: a["key"] == ""), "axis_without_name")
        .when(F.size(F.array_distinct(F.transform(ax, lambda a: a["key"]))) < F.size(ax), "axis_twice")
        .when(F.exists(ax, lambda a: a["low"].isNull() | a["high"].isNull() | a["step"].isNull()), "axis_no_number")
        .when(F.size(inputs) == 0, "no_input_axis")
        .when(F.exists(ax, lambda a: a["high"] <= a["low"]), "axis_domain")
        .when(F.exists(ax, lambda a: a["step"] <= 0), "axis_resolution")
    )
    size = F.aggregate(inputs, F.lit(1).cast("decimal(38,0)"), lambda n, a: (n * F.greatest(F.lit(1), F.ceil((a["high"] - a["low"]) / a["step"])).cast("decimal(19,0)")).cast("decimal(38,0)"))
    names = lambda of: F.transform(of, lambda a: a["name"])
    return df.withColumn("reason", reason).select(
        *[c for c in texts.columns if c != text],
        "reason",
        F.coalesce(F.nullif(stripped(f("id")), F.lit("")), F.concat(F.lit("goal_"), F.substring(F.sha1(F.col("__name")), 1, 12))).alias("goal_id"),
        F.col("__name").alias("name"),
        F.col("__k").alias("k"),
        ax.alias("axes"),
        names(inputs).alias("input_axes"),
        names(F.filter("__axes", lambda a: a["role"] == "output")).alias("output_axes"),
        F.when(F.col("reason").isNull(), size).alias("total_bins"),
        F.col("__rules").alias("rules"),
        F.col("__legacy").alias("legacy"),
    )


def as_goals(found: DataFrame) -> list[Goal]:
    """Usable goals as plans take them, in order of id; goals are few.  Their rules are brought to the present shape; rules that
    cannot be are left out."""
    out = []
    for r in usable(found).orderBy("goal_id").collect():
        axes = tuple(Axis(a.name, a.low, a.high, a.step, a.unit, a.role) for a in r.axes)
        goal = Goal(r.goal_id, axes, r.k, r.name)
        inputs, rules = set(goal.design.names), []
        for raw in r.rules:
            try:
                rules += [x for x in normalised([json.loads(raw)], goal) if rule_axes(x) <= inputs]
            except (GridError, KeyError, TypeError, ValueError):
                continue
        out.append(replace(goal, rules=tuple(rules)))
    return out


def at_upload(report: DataFrame) -> Column:
    """A snapshot as JSON text, in the present spelling, of a row of the flat report: what a record keeps of its upload."""
    have = {c.lower(): c for c in report.columns}
    names = {"peerGroupSize": "peer_group_size", "analysisTimestamp": "analysis_timestamp", "noExternalReference": "no_external_reference", "primaryReferenceMode": "primary_reference_mode", "referenceModes": "reference_modes", "outOfDomainWarnings": "out_of_domain_warnings"}
    parts = []
    for key, kind in SNAPSHOT.items():
        column = next((have[s.lower()] for s in (*spellings(key), names.get(key, key)) if s.lower() in have), None)
        if column:
            text = F.to_json(F.array(F.col(column)))  # quotes and escapes are those of JSON
            value = F.col(column) if kind == "json" else F.substring(text, F.lit(2), F.length(text) - 2)
            parts.append(F.concat(F.lit(f'"{key}":'), F.coalesce(F.when(F.col(column).isNotNull(), value), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


_LOG = "id string, sessionId string, sequence string, createdAt string, action string, axesBefore array<string>, axesAfter array<string>, referenceModesBefore map<string,string>, referenceModesAfter map<string,string>, appliedAsGoalDefault string, appliedAt string"
#: Fixed terms of a mode in a log entry, with their types.
LOG_TERMS = {
    "specificityScore": "double", "confidence": "double", "observationSupportS": "double", "coverageC": "double", "equitabilityE": "double", "referenceObservationCount": "long", "occupiedBins": "long",
    "validBins": "long", "maskedBins": "long", "aValid": "long",
}
MODES = ("external", "pooled", "internal")
_FALSE = ("", "false", "0", "0.0", "null", "[]", "{}")


def _truth(text: Column) -> Column:
    """Is a JSON value something: not null, false, 0, or empty?"""
    return ~F.lower(F.coalesce(text, F.lit(""))).isin(*_FALSE)


def _log_axes(axes: Column) -> Column:
    """Axes that have a name and three numbers."""
    one = lambda t: F.from_json(F.when(t.rlike(r"^\s*\{"), t), "name string, domainMin string, domainMax string, resolution string")
    made = F.transform(F.transform(axes, one), lambda a: F.struct(stripped(a["name"]).alias("name"), *[a[k].try_cast("double").alias(n) for k, n in (("domainMin", "low"), ("domainMax", "high"), ("resolution", "step"))]))
    kept = F.filter(made, lambda a: (a["name"] != "") & a["low"].isNotNull() & a["high"].isNotNull() & a["step"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<name:string,low:double,high:double,step:double>>"))


def _log_modes(modes: Column) -> Column:
    """The known modes that are objects, in fixed order, with their terms; a term of a wrong type is null."""
    fields = ", ".join(f"{k} string" for k in ("label", "referencePolicy", "targetIncludedInReference", "noExternalReference", *LOG_TERMS))

    def one(mode: str) -> Column:
        text = F.element_at(modes, mode)
        m = F.from_json(text, fields)
        whole = lambda v: F.floor(v.try_cast("double")).cast("long")
        terms = [(whole(m[k]) if t == "long" else m[k].try_cast(t)).alias(k) for k, t in LOG_TERMS.items()]
        head = [F.lit(mode).alias("mode"), F.coalesce(F.nullif(m["label"], F.lit("")), F.lit(mode.title())).alias("label"), F.coalesce(m["referencePolicy"], F.lit("")).alias("policy")]
        flags = [_truth(m["targetIncludedInReference"]).alias("target_included"), _truth(m["noExternalReference"]).alias("no_external")]
        return F.when(text.rlike(r"^\s*\{"), F.struct(*head, *flags, *terms))

    return F.array_compact(F.array(*map(one, MODES)))


def logs(texts: DataFrame, text: str = "entry") -> DataFrame:
    """Entries of preview logs as JSON text, each normalised; those without an id, a session or a time are left out.

    A number that is missing, wrong or below 1 is 1; an action that is missing is a recalculated preview.
    """
    df = texts.withColumn("__l", F.from_json(F.when(F.col(text).rlike(r"^\s*\{"), F.col(text)), _LOG))
    f = lambda n: F.col(f"__l.{n}")
    out = df.select(
        *[c for c in texts.columns if c != text],
        stripped(f("id")).alias("log_id"),
        stripped(f("sessionId")).alias("session_id"),
        F.greatest(F.lit(1), F.coalesce(F.floor(f("sequence").try_cast("double")), F.lit(1))).cast("long").alias("sequence"),
        stripped(f("createdAt")).alias("created_at"),
        F.coalesce(F.nullif(f("action"), F.lit("")), F.lit("preview_recalculated")).alias("action"),
        _log_axes(f("axesBefore")).alias("axes_before"),
        _log_axes(f("axesAfter")).alias("axes_after"),
        _log_modes(f("referenceModesBefore")).alias("modes_before"),
        _log_modes(f("referenceModesAfter")).alias("modes_after"),
        _truth(f("appliedAsGoalDefault")).alias("applied"),
        F.nullif(stripped(f("appliedAt")), F.lit("")).alias("applied_at"),
    )
    return out.where("log_id <> '' AND session_id <> '' AND created_at <> ''")
