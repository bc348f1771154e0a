"""Words about results: which terms lower the confidence, what the scores mean, warnings; reports as files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.plans.grid import Goal
from densigrid.plans.rules import normalised

#: Fixed thresholds below which a confidence term counts against the result.
LOW = {"s": ("Observation Support", 0.6), "c": ("Coverage", 0.3), "e": ("Equitability", 0.5)}


def confidence_reasons(results: DataFrame) -> DataFrame:
    """mode, label, score, impact (down, stable, or pending where the score is not known yet)."""
    each = [F.struct(F.lit(label).alias("label"), F.round(F.col(n), 4).alias("score"), F.when(F.col(n).isNull(), "pending").when(F.col(n) < least, "down").otherwise("stable").alias("impact")) for n, (label, least) in LOW.items()]
    return results.select("mode", F.explode(F.array(*each)).alias("r")).select("mode", "r.*")


def verdict(results: DataFrame) -> DataFrame:
    """mode, verdict: the summary sentence's kind."""
    high = F.col("specificity_score") > 0.75
    kind = F.when(high & (F.col("confidence") > 0.7), "rare_and_supported").when(high & (F.col("confidence").isNull() | (F.col("confidence") <= 0.4)), "rare_but_weakly_supported").when(F.col("specificity_score") <= 0.5, "ordinary").otherwise("moderate")
    return results.select("mode", kind.alias("verdict"))


def warnings(counts: DataFrame) -> DataFrame:
    """kind, rows, total_rows: target rows that were left out, if there are any."""
    each = F.array(F.struct(F.lit("out_of_domain").alias("kind"), F.col("out_of_domain_rows").alias("rows")), F.struct(F.lit("masked").alias("kind"), F.col("masked_rows").alias("rows")))
    return counts.select(F.explode(each).alias("w"), "total_rows").select("w.*", "total_rows").where("rows > 0")


#: Fixed columns of a flat report, in the order in which they are written.
REPORT_FIELDS = (
    "experiment_goal", "goal_id", "axis_names", "target_vector", "peer_group_size", "peer_record_count", "external_peer_record_count", "external_peer_observation_count",
    "reference_observation_count", "reference_occupied_bins", "reference_density_policy", "primary_reference_mode", "reference_modes", "target_included_in_reference",
    "no_external_reference", "internal_density_mode", "self_contained_reference_warning", "engine", "specificity_method", "specificity_score", "mean_bin_specificity",
    "max_specificity", "extreme_specificity_rate", "mean_rarity", "max_rarity", "unseen_bin_rate", "rare_bin_rate", "out_of_domain_rate", "masked_out_target_rows",
    "infeasible_target_rows", "feasible_mask_enabled", "feasible_expressions", "feasible_mask_evaluation_skipped", "feasible_mask_warning", "coverage_warning", "valid_bins",
    "masked_bins", "valid_domain_ratio", "infeasible_peer_rows", "infeasible_peer_bins", "confidence", "observation_support_S", "coverage_C", "equitability_E",
    "peer_observation_count", "valid_target_rows", "invalid_target_rows", "out_of_domain_rows", "total_bins", "occupied_bins", "analysis_timestamp", "out_of_domain_warnings",
    "confidence_reasons", "summary_messages", "grid_preview_logs",
)


def report_row(goal: Goal, modes: DataFrame, target: DataFrame, means: DataFrame, peers: DataFrame, sizes: dict, timestamp: str, logs: list | None = None) -> DataFrame:
    """One row with REPORT_FIELDS: lists as JSON text, numbers as numbers, what is pending as null.

    ``modes`` is ``density.reference_modes``, ``target`` the counters and ``means`` (mean_<axis>) the summary of the target,
    ``peers`` the counters of ``records.global_counts``, ``sizes`` those of ``rules.feasible_size``.
    """
    from densigrid.operators.density import with_target

    told = with_target(modes, target)
    external = told.where("mode = 'external'").drop("mode")
    listed = lambda df, name: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias(name))  # noqa: E731  a handful of rows
    parts = [
        external,
        means.select(F.to_json(F.array(*[F.col(f"mean_{n}") for n in goal.names])).alias("target_vector")),
        peers.select("eligible_records", "infeasible_rows", "infeasible_bins"),
        listed(modes.select("mode", "specificity_score", "mean_rarity", "confidence", "reference_rows"), "reference_modes"),
        listed(confidence_reasons(modes.where("mode = 'external'")).drop("mode"), "confidence_reasons"),
        listed(verdict(modes.where("mode = 'external'")).drop("mode"), "summary_messages"),
        listed(warnings(target), "out_of_domain_warnings"),
    ]
    row = reduce(DataFrame.crossJoin, parts)  # of one row each
    text = [r["text"] for r in normalised(list(goal.rules), goal) if r["enabled"]]
    alone = F.col("reference_rows") == 0
    known = {
        "experiment_goal": F.lit(goal.name or goal.id), "goal_id": F.lit(goal.id), "axis_names": F.lit(json.dumps(goal.names, ensure_ascii=False)),
        "peer_group_size": F.col("eligible_records"), "peer_record_count": F.col("eligible_records"), "external_peer_record_count": F.col("eligible_records"),
        "external_peer_observation_count": F.col("reference_rows"), "reference_observation_count": F.col("reference_rows"), "reference_occupied_bins": F.col("occupied_bins"),
        "reference_density_policy": F.lit("external_only"), "primary_reference_mode": F.lit("external"), "target_included_in_reference": F.lit(False), "no_external_reference": alone,
        "internal_density_mode": F.lit(False), "self_contained_reference_warning": F.when(alone, "no saved record to compare with").otherwise(""), "engine": F.lit("density_grid"),
        "specificity_method": F.lit("occupied_bin_count_ecdf"), "mean_bin_specificity": F.col("specificity_score"), "rare_bin_rate": F.col("extreme_specificity_rate"),
        "infeasible_target_rows": F.col("masked_out_target_rows"), "feasible_mask_enabled": F.lit(bool(text)), "feasible_expressions": F.lit(json.dumps(text, ensure_ascii=False)),
        "feasible_mask_evaluation_skipped": F.lit(False), "feasible_mask_warning": F.lit(""), "coverage_warning": F.when(F.col("c").isNull(), "pending").otherwise(""),
        "valid_bins": F.lit(sizes["valid_bins"]).cast("long"), "masked_bins": F.lit(sizes["masked_bins"]).cast("long"), "valid_domain_ratio": F.lit(sizes["valid_bins"] / sizes["total_bins"]),
        "infeasible_peer_rows": F.col("infeasible_rows"), "infeasible_peer_bins": F.col("infeasible_bins"), "observation_support_S": F.col("s"), "coverage_C": F.col("c"),
        "equitability_E": F.col("e"), "peer_observation_count": F.col("reference_rows"), "total_bins": F.lit(sizes["total_bins"]).cast("long"), "analysis_timestamp": F.lit(timestamp),
        "grid_preview_logs": F.lit(json.dumps(logs or [], ensure_ascii=False)),
    }
    return row.select(*[known.get(n, F.col(n)).alias(n) for n in REPORT_FIELDS])


def write_report(results: DataFrame, path: str, kind: str) -> None:
    """Results as json, csv or html (a page for each file that Spark writes) under ``path``; no row is left out."""
    if kind == "json":
        results.write.mode("overwrite").json(path)
    elif kind == "csv":
        results.write.mode("overwrite").options(header=True, escape='"').csv(path)
    elif kind == "html":
        text = F.to_json(F.struct(*results.columns))
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(mark), F.lit(name))
        results.select(F.concat(F.lit("<!doctype html><meta charset=utf-8><pre>"), text, F.lit("</pre>")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind of report {kind!r}")
