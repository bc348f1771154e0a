"""How unusual target cells are against a reference: eCDF specificity, rarity, confidence, in three reference modes.

The rows are read once: ``split_counts`` gives each cell's count in peers and in the target.  The modes external (peers),
pooled (peers and target) and internal (target) are three readings of that one small frame.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.functions.cells import delta
from densigrid.operators.occupancy import histogram, in_grid, indices, unmasked
from densigrid.operators.prefix import running
from densigrid.plans.grid import Goal, GridError
from densigrid.sources.files import written

MODES = ("external", "pooled", "internal")
EXTREME = 0.95
ALPHA = 0.5
EPSILON = 1e-12


def ecdf_rank(counts: DataFrame, by: list[str] | None = None, cnt: str = "cnt") -> DataFrame:
    """by..., cnt, cells, rank: how many occupied cells have that count, and that or less."""
    by = by or []
    spread = counts.where(F.col(cnt) > 0).groupBy(*by, F.col(cnt).alias("cnt")).agg(F.count("*").alias("cells"))
    return running(spread, "cnt", {"rank": "cells"}, by).select(*by, "cnt", "cells", "rank")


def split_counts(rows: DataFrame, goal: Goal, is_target: Column) -> DataFrame:
    """cell, peer, target: counts of valid rows."""
    names = indices(goal)
    flat = in_grid(rows, goal, is_target.alias("__t"))
    counts = flat.groupBy(*names).agg(F.count(F.when(~F.col("__t"), 1)).alias("peer"), F.count(F.when(F.col("__t"), 1)).alias("target"))
    return unmasked(counts, goal, ["peer", "target"]).select(F.array(*names).alias("cell"), "peer", "target")


def split_cells(grouped: DataFrame, goal: Goal, is_target: Column) -> DataFrame:
    """cell, peer, target of the rows of ``occupancy.per_cell``, which know whether they are the target's."""
    names = indices(goal)
    here = grouped.where(F.col(names[0]).isNotNull()).withColumn("__t", is_target)
    counts = here.groupBy(*names).agg(*[F.sum(F.when(F.col("__t") == t, F.col("n")).otherwise(0)).alias(c) for t, c in ((False, "peer"), (True, "target"))])
    return unmasked(counts, goal, ["peer", "target"]).select(F.array(*names).alias("cell"), "peer", "target")


def by_mode(counts: DataFrame) -> DataFrame:
    """mode, cell, ref, target."""
    readings = F.array(*[F.struct(F.lit(m).alias("mode"), r.alias("ref")) for m, r in (("external", F.col("peer")), ("pooled", F.col("peer") + F.col("target")), ("internal", F.col("target")))])
    return counts.select(F.explode(readings).alias("r"), "cell", "target").select("r.mode", "cell", "r.ref", "target")


def by_count(modes: DataFrame) -> DataFrame:
    """mode, ref, cells, hit, rank, rank_all, n_all: for each reference count the cells that have it, the target rows in them, the
    occupied cells with that count or less, and all occupied cells and reference rows of the mode.

    All scores of a cell follow from its count, so they are computed for distinct counts, of which there are far fewer.
    """
    spread = modes.groupBy("mode", "ref").agg(F.count("*").alias("cells"), F.sum("target").alias("hit"))
    spread = spread.withColumns({"full": F.when(F.col("ref") > 0, F.col("cells")).otherwise(0), "rows": F.col("cells") * F.col("ref")})
    return running(spread, "ref", {"rank": "full", "n": "rows"}, ["mode"]).drop("full", "rows", "n")


def _score() -> Column:
    """1 less the share of occupied reference cells that hold no more rows than this one; 1 where the reference has none."""
    return F.when(F.col("ref") <= 0, 1.0).otherwise(1.0 - F.col("rank") / F.col("rank_all"))


def _rarity(total_bins: int) -> Column:
    """-ln of the smoothed probability, over the whole rectangular grid."""
    return -F.log((F.col("ref") + F.lit(ALPHA)) / (F.col("n_all") + F.lit(ALPHA * float(total_bins))))


def scored_cells(modes: DataFrame) -> DataFrame:
    """mode, cell, ref, target, specificity of the target's cells."""
    scores = by_count(modes).where("hit > 0").select("mode", "ref", _score().alias("specificity"))
    return modes.where("target > 0").join(scores, ["mode", "ref"]).select("mode", "cell", "ref", "target", "specificity")


def _specificity(score: str) -> list[Column]:
    rows = F.sum("hit")
    return [
        (F.sum(F.col("hit") * F.col(score)) / rows).alias("specificity_score"),
        F.max(score).alias("max_specificity"),
        (F.coalesce(F.sum(F.when(F.col("ref") == 0, F.col("hit"))), F.lit(0)) / rows).alias("unseen_bin_rate"),
        (F.coalesce(F.sum(F.when(F.col(score) >= EXTREME, F.col("hit"))), F.lit(0)) / rows).alias("extreme_specificity_rate"),
        rows.alias("valid_target_rows"),
    ]


def _mean_max(term: str) -> list[Column]:
    return [(F.sum(F.col("hit") * F.col(term)) / F.sum("hit")).alias("mean_rarity"), F.max(term).alias("max_rarity")]


def specificity(counted: DataFrame) -> DataFrame:
    """Of the rows of ``by_count``, for each mode: mean (by target rows) and maximum, and the shares of target rows in cells without
    reference rows and in extreme ones."""
    return counted.where("hit > 0").withColumn("__s", _score()).groupBy("mode").agg(*_specificity("__s"))


def rarity(counted: DataFrame, total_bins: int) -> DataFrame:
    """Of the rows of ``by_count``, for each mode: mean (by target rows) and maximum."""
    return counted.where("hit > 0").withColumn("__r", _rarity(total_bins)).groupBy("mode").agg(*_mean_max("__r"))


def _entropy(p: Column, epsilon: float) -> Column:
    """Of ``cells`` with share ``p`` each.  Doubles add up to other last digits in another order, and a shuffle has none, so the terms
    are added up exactly: none is more than ln 2^63, and the 24 digits kept of each are far beyond a double's."""
    return -F.sum((F.col("cells") * p * F.log(p + F.lit(epsilon))).cast("decimal(28,24)")).cast("double")


def confidence_terms(n: Column, occ: Column, h: Column, valid_bins: int | None, k: float) -> dict[str, Column]:
    """s, c, e, confidence: support, coverage, evenness and (s c e)^(1/3) of n rows in occ cells with entropy h."""
    s = n / (n + F.lit(float(k)))
    e = F.when(occ <= 1, 0.0).otherwise(h / F.log(occ.cast("double")))
    c = F.when(n > 0, occ / F.lit(float(valid_bins))) if valid_bins else F.lit(None).cast("double")
    return {"s": s, "c": c, "e": e, "confidence": F.pow(s * c * e, F.lit(1.0 / 3.0))}


def confidence(counts: DataFrame, valid_bins: int | None, k: float, by: list[str] | None = None, cnt: str = "cnt", epsilon: float = EPSILON) -> DataFrame:
    """by..., reference_rows, occupied_bins, s, c, e, confidence: support, coverage, evenness and (s c e)^(1/3).

    Without reference rows 0, null, 0, null; coverage and confidence are null while the number of valid cells is unknown.
    """
    by = by or []
    # Equal counts give equal terms, so the entropy runs over distinct counts.
    spread = counts.where(F.col(cnt) > 0).groupBy(*by, F.col(cnt).alias("x")).agg(F.count("*").alias("cells"), F.sum(cnt).alias("n"))
    if by:
        total = F.sum("n").over(Window.partitionBy(*by))
    else:
        spread, total = running(spread, "x", {"upto": "n"}), F.col("upto_all")
    terms = spread.select(*by, "cells", "n", (F.col("x") / total).alias("p"))
    made = terms.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("cells").alias("occ"), _entropy(F.col("p"), epsilon).alias("h"))
    n, occ = F.coalesce("n", F.lit(0)), F.coalesce("occ", F.lit(0))
    return made.select(*by, n.alias("reference_rows"), occ.alias("occupied_bins"), *[v.alias(t) for t, v in confidence_terms(n, occ, F.col("h"), valid_bins, k).items()])


def reference_modes(selected: DataFrame, design: DataFrame, selected_goal: Goal, design_goal: Goal, valid_bins: int | None) -> DataFrame:
    """One row for each mode: specificity and rarity on the selected grid, confidence on the grid of the input axes.

    A mode without reference rows has its row too: external is then the boundary case, with score 1, rarity
    ln(total cells) and confidence 0.  A target without valid rows gives no scores (nulls).
    """
    if valid_bins is not None and valid_bins <= 0:
        raise GridError("the rules leave no valid cell, so there is nothing to compare", hint="relax a rule")
    every = selected.sparkSession.createDataFrame([(i, m) for i, m in enumerate(MODES)], "place int, mode string")
    counted = by_count(by_mode(selected))
    hits = counted.where("hit > 0").withColumns({"__s": _score(), "__r": _rarity(selected_goal.total_bins)})
    out = every.join(hits.groupBy("mode").agg(*_specificity("__s"), *_mean_max("__r")), "mode", "left")
    # The same frame of distinct counts serves the confidence where the grids are the same.
    spread = counted if design is selected else by_count(by_mode(design))
    terms = spread.where("ref > 0").withColumn("__p", F.col("ref") / F.col("n_all"))
    made = terms.groupBy("mode").agg(F.first("n_all").alias("reference_rows"), F.first("rank_all").alias("occupied_bins"), _entropy(F.col("__p"), EPSILON).alias("h"))
    n, occ = F.coalesce("reference_rows", F.lit(0)), F.coalesce("occupied_bins", F.lit(0))
    sure = confidence_terms(n, occ, F.col("h"), valid_bins, selected_goal.k)
    out = out.join(made.select("mode", "reference_rows", "occupied_bins", *[v.alias(t) for t, v in sure.items()]), "mode", "left")
    none = (F.col("mode") == "external") & (F.coalesce("reference_rows", F.lit(0)) == 0) & F.col("valid_target_rows").isNotNull()
    edge = math.log(max(1, selected_goal.total_bins))
    bound = {"specificity_score": 1.0, "max_specificity": 1.0, "extreme_specificity_rate": 1.0, "unseen_bin_rate": 1.0, "mean_rarity": edge, "max_rarity": edge, "s": 0.0, "c": 0.0, "e": 0.0, "confidence": 0.0}
    return out.select(
        "mode",
        *[F.when(none, F.lit(v)).otherwise(F.col(n)).alias(n) for n, v in bound.items()],
        F.coalesce("reference_rows", F.lit(0)).alias("reference_rows"),
        F.coalesce("occupied_bins", F.lit(0)).alias("occupied_bins"),
        "valid_target_rows",
    )


def with_target(modes: DataFrame, target: DataFrame) -> DataFrame:
    """The modes with what became of the target's rows: ``target`` is the one row of ``occupancy.counters`` for it."""
    n = F.col("total_rows")
    rates = target.select(
        n.alias("target_total_rows"),
        F.col("invalid_rows").alias("invalid_target_rows"),
        "out_of_domain_rows",
        F.col("masked_rows").alias("masked_out_target_rows"),
        F.when(n > 0, F.col("out_of_domain_rows") / n).otherwise(0.0).alias("out_of_domain_rate"),
    )
    return modes.crossJoin(rates)  # of one row each by mode


#: The terms whose change a deletion is judged by.
IMPACT = {"confidence": "confidence", "coverage": "c", "equitability": "e", "specificity": "specificity_score", "mean_rarity": "mean_rarity"}


def delete_impact(modes: DataFrame, peers: DataFrame, unique: DataFrame) -> DataFrame:
    """One row on what the loss of a record would change, from its three modes, its peers and its uniqueness.

    ``all_*`` and ``without_*`` leave the record itself out of its reference, both of them, as it is reported; so the
    deltas between them are 0 (null while a term is pending).  ``effect_*`` is the change that its rows make: external, without
    them, less pooled, with them.
    """
    of = lambda mode, term: F.max(F.when(F.col("mode") == mode, F.col(term)))
    ext = {n: of("external", c) for n, c in IMPACT.items()}
    row = modes.agg(
        *[v.alias(f"all_{n}") for n, v in ext.items()],
        *[v.alias(f"without_{n}") for n, v in ext.items()],
        *[delta(v, v).alias(f"delta_{n}") for n, v in ext.items()],
        *[delta(v, of("pooled", IMPACT[n])).alias(f"effect_{n}") for n, v in ext.items()],
    )
    size = peers.agg(F.count("*").alias("peers_all"), F.count("*").alias("peers_without"))
    return row.crossJoin(size).crossJoin(unique)  # of one row each


def own_counts(rows: DataFrame, goal: Goal, record: str) -> DataFrame:
    """record, cell, o: each record's valid rows per cell; the cell is a number where a long can hold it."""
    own = histogram(rows, goal, [record]).withColumnRenamed("cnt", "o")
    if goal.total_bins < 1 << 62:  # joined faster than indices
        own = own.withColumn("cell", reduce(lambda n, ka: n * ka[1].bins + F.col("cell")[ka[0]], enumerate(goal.axes), F.lit(0).cast("long")))
    return written(own)  # read several times; so rows are binned once


def _steps(own: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """(record, at, of_g, of_e, hit): of each record's cells those that all records fill with ``at`` rows, those that the others
    do, and the record's rows in the latter; and (cell, g) of all records.

    A record has no more steps than there are distinct counts, at most some sqrt(2 n) among n rows, however many cells it has.
    """
    whole = own.groupBy("cell").agg(F.sum("o").alias("g"))
    both = own.join(whole, "cell").withColumn("e", F.col("g") - F.col("o"))
    zero = F.lit(0).cast("long")
    point = lambda at, g, e, hit: F.struct(at.alias("at"), g.cast("long").alias("of_g"), e.cast("long").alias("of_e"), hit.alias("hit"))
    points = both.select(record, F.explode(F.array(point(F.col("g"), F.lit(1), F.lit(0), zero), point(F.col("e"), F.lit(0), F.lit(1), F.col("o")))).alias("p"))
    return points.groupBy(record, "p.at").agg(F.sum("p.of_g").alias("of_g"), F.sum("p.of_e").alias("of_e"), F.sum("p.hit").alias("hit")), whole


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)


def left_out_confidence(own: DataFrame, valid_bins: int | None, k: float, record: str) -> DataFrame:
    """record, reference_rows, occupied_bins, s, c, e, confidence of all rows but the record's own, for every record in one pass.

    The entropy of counts e that add up to n is ln n - (sum of e ln e) / n.  For the others, that sum is the one over all
    cells, less g ln g and plus e ln e of the record's own cells.  The constant inside the logarithm adds its first order, EPSILON
    times the occupied cells (what is left is below EPSILON^2 n cells / 2).
    """
    steps, whole = _steps(own, record)
    totals = whole.agg(F.count("*").alias("cells_all"), F.sum("g").alias("rows_all"), F.sum(_xlogx(F.col("g"))).alias("log_all"))
    at = _xlogx(F.col("at"))
    per = steps.groupBy(record).agg(F.sum("hit").alias("own"), F.sum(F.when(F.col("at") == 0, F.col("of_e")).otherwise(0)).alias("alone"), F.sum((F.col("of_e") - F.col("of_g")) * at).alias("log_own"))
    return _left_out(per.crossJoin(F.broadcast(totals)), valid_bins, k, record)  # of one row


def _left_out(per: DataFrame, valid_bins: int | None, k: float, *keep: str) -> DataFrame:
    n, occ = F.col("rows_all") - F.col("own"), F.col("cells_all") - F.col("alone")
    h = F.log(n.cast("double")) - (F.col("log_all") + F.col("log_own")) / n - F.lit(EPSILON) * occ
    terms = confidence_terms(n, occ, F.greatest(h, F.lit(0.0)), valid_bins, k)
    return per.select(*keep, n.alias("reference_rows"), occ.alias("occupied_bins"), *[F.when(n > 0, v).otherwise(0.0).alias(t) for t, v in terms.items()])


def reevaluated(rows: DataFrame, goal: Goal, record: str, design_rows: DataFrame | None = None, valid_bins: int | None = None) -> DataFrame:
    """Every record against all others, in one pass over the rows: record, the specificity and rarity of its valid rows, and the
    others' reference_rows, occupied_bins, s, c, e and confidence.  ``design_rows`` are the rows on the grid of the input axes,
    where that is another grid; ``valid_bins`` its valid cells (None: coverage and confidence are pending).

    With global counts g and a record's own counts o, the others have e = g - o.  The number of their occupied cells with
    at most e rows is that of all cells with g <= e, less the record's own cells with g <= e, plus its own cells with
    0 < e' <= e: only own cells are looked at again, and only their distinct values.  A record without others has the boundary
    scores (1, rarity ln of all cells, confidence 0).
    """
    own = own_counts(rows, goal, record)
    steps, whole = _steps(own, record)
    steps = written(steps)
    # G(e) at every value that occurs: values at which it is only asked add no cells.
    known = whole.select(F.col("g").alias("at"), F.lit(1).alias("cells")).unionByName(steps.where("hit > 0").select("at", F.lit(0).alias("cells")))
    known = running(known.groupBy("at").agg(F.sum("cells").alias("cells")), "at", {"before": "cells"}).select("at", "before")
    totals = whole.agg(F.count("*").alias("cells_all"), F.sum("g").alias("rows_all"), F.sum(_xlogx(F.col("g"))).alias("log_all"))
    every = Window.partitionBy(record)
    so_far = every.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    full = F.when(F.col("at") > 0, F.col("of_e")).otherwise(0)
    alone = F.when(F.col("at") == 0, F.col("of_e")).otherwise(0)
    cum = steps.select("*", F.sum("of_g").over(so_far).alias("own_g"), F.sum(full).over(so_far).alias("own_e"), F.sum("hit").over(every).alias("own"), F.sum(alone).over(every).alias("alone"))
    met = cum.join(known, "at", "left").crossJoin(F.broadcast(totals))  # of one row
    n = F.col("rows_all") - F.col("own")
    rank = F.col("before") - F.col("own_g") + F.col("own_e")
    score = F.when(F.col("hit") > 0, F.when(F.col("at") <= 0, 1.0).otherwise(1.0 - rank / (F.col("cells_all") - F.col("alone"))))
    rare = F.when(F.col("hit") > 0, F.when(n <= 0, F.lit(math.log(max(1, goal.total_bins)))).otherwise(-F.log((F.col("at") + F.lit(ALPHA)) / (n + F.lit(ALPHA * float(goal.total_bins))))))
    scored = met.withColumns({"__s": score, "__r": rare})
    own_rows = F.first("own")
    per = scored.groupBy(record).agg(
        (F.sum(F.col("hit") * F.col("__s")) / own_rows).alias("specificity_score"),
        F.max("__s").alias("max_specificity"),
        (F.sum(F.when(F.col("at") == 0, F.col("hit")).otherwise(0)) / own_rows).alias("unseen_bin_rate"),
        (F.sum(F.when(F.col("__s") >= EXTREME, F.col("hit")).otherwise(0)) / own_rows).alias("extreme_specificity_rate"),
        *[(F.sum(F.col("hit") * F.col("__r")) / own_rows).alias("mean_rarity"), F.max("__r").alias("max_rarity")],
        own_rows.alias("valid_rows"),
        own_rows.alias("own"),
        F.first("alone").alias("alone"),
        F.sum((F.col("of_e") - F.col("of_g")) * _xlogx(F.col("at"))).alias("log_own"),
        *[F.first(c).alias(c) for c in ("cells_all", "rows_all", "log_all")],
    )
    scores = [c for c in per.columns if c not in ("own", "alone", "log_own", "cells_all", "rows_all", "log_all")]
    if design_rows is None:
        return _left_out(per, valid_bins, goal.k, *scores)
    return per.select(*scores).join(left_out_confidence(own_counts(design_rows, goal.design, record), valid_bins, goal.k, record), record, "left")


def compared_with_upload(current: DataFrame, uploaded: DataFrame, record: str) -> DataFrame:
    """The re-evaluation beside the scores that were saved with each record (record, specificity_score, confidence; either may be
    missing): ``uploaded_*``, changes to six digits (null while a term is pending) and what they mean, as kinds in order.

    fell: looked highly specific, now close to the baseline; specific: still is; mild: is not; weak_support: the confidence at
    upload was low; similar: nothing of these can be said.
    """
    was = uploaded.select(record, F.col("specificity_score").cast("double").alias("uploaded_specificity"), F.col("confidence").cast("double").alias("uploaded_confidence"))
    out = current.join(was, record, "left")
    now, then = F.col("specificity_score"), F.col("uploaded_specificity")
    known = now.isNotNull() & then.isNotNull()
    kind = F.when(known, F.when((then >= 0.75) & (now <= 0.55), "fell").when(now >= 0.75, "specific").otherwise("mild"))
    kinds = F.array_compact(F.array(kind, F.when(F.col("uploaded_confidence") < 0.4, "weak_support")))
    return out.select(
        "*",
        delta(now, then).alias("specificity_delta"),
        delta(F.col("confidence"), F.col("uploaded_confidence")).alias("confidence_delta"),
        F.when(F.size(kinds) > 0, F.array_join(kinds, ",")).otherwise("similar").alias("interpretation"),
    )
