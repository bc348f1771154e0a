"""Goals over the test tables that queries and oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.plans.grid import Axis, Goal

DISCOUNT = Axis("discount", 0.0, 0.1, 0.01)
PRICE = Axis("price", 0.0, 100000.0, 10000.0)
QUANTITY = Axis("quantity", 0.0, 50.0, 5.0)
MAPPING = {"discount": "l_discount", "price": "l_extendedprice", "quantity": "l_quantity"}

RULES = (
    {"type": "focused_2d_mask", "x": "discount", "y": "price", "x_range": (0.08, 0.1), "y_range": (0.0, 20000.0)},
    {"type": "focused_2d_mask", "x": "discount", "y": "price", "x_range": (0.05, 0.09), "y_range": (10000.0, 30000.0), "scope": {"quantity": {"mode": "range", "min": 20.0, "max": 40.0}}},
    {"type": "conditional_range", "if": {"axis": "quantity", "op": ">", "value": 45.0}, "then": {"axis": "price", "min": 20000.0, "max": 100000.0}},
)

PRICING = Goal("pricing", (DISCOUNT, PRICE, QUANTITY), 1000.0)
FINE = Goal("pricing_fine", (DISCOUNT, Axis("price", 0.0, 100000.0, 2500.0), Axis("quantity", 0.0, 50.0, 1.0)), 1000.0)
ROLES = Goal("pricing_roles", (DISCOUNT, PRICE, Axis("quantity", 0.0, 50.0, 5.0, role="output")), 1000.0)
MASKED = Goal("pricing_masked", (DISCOUNT, PRICE, QUANTITY), 1000.0, rules=RULES)
EVENTS = Goal("events_k", (Axis("k", 0.0, 100.0, 10.0), Axis("value", 0.0, 100.0, 5.0)), 100.0)

#: Ids of records without observations, beyond those of suppliers.
SILENT = tuple(range(10_000_001, 10_000_008))
#: The record that is compared with the others.
TARGET = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; a supplier's are one record."""
    return table(spark, sf_dir, "lineitem").withColumn("record_id", F.col("l_suppkey"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header for each supplier: some belong to another goal, some lack an axis; SILENT more have no observations."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id")).union(spark.range(SILENT[0], SILENT[-1] + 1).toDF("record_id"))
    goal = F.when(F.col("record_id") % 4 == 3, "other").otherwise(" pricing ")
    names = F.when(F.col("record_id") % 5 == 4, F.array(F.lit("Discount"), F.lit("PRICE"))).otherwise(F.array(F.lit(" Discount"), F.lit("price"), F.lit("Quantity")))
    return s.select("record_id", goal.alias("goal_id"), names.alias("axis_names"), F.when(F.col("record_id") % 6 != 5, "sig").alias("grid_signature"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, v) of all line items, price, discount, quantity in that order."""
    return lines(spark, sf_dir).select("record_id", F.array("l_extendedprice", "l_discount", "l_quantity").alias("v"))


ORDER = ["Price", "discount", "quantity "]


def values(goal: Goal = PRICING) -> dict[str, Column]:
    from densigrid.functions.cells import finite

    return {a.name: finite(F.col(MAPPING[a.name])) for a in goal.axes}


# The same in DuckDB's SQL.


def double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def sql_index(a: Axis, v: str) -> str:
    cell = f"CAST(least({a.bins - 1}, greatest(0, floor(({v} - {double(a.low)}) / {double(a.step)}))) AS INTEGER)"
    return f"CASE WHEN {v} < {double(a.low)} OR {v} > {double(a.high)} THEN NULL WHEN {v} = {double(a.high)} THEN {a.bins - 1} ELSE {cell} END"


def sql_cells(goal: Goal, exprs: dict[str, str] | None = None, source: str = "lineitem", keep: str = "l_suppkey AS record_id", boxes: list[dict] | None = None) -> str:
    """A query: keep..., v<k>, b<k>, status, key of every row."""
    from densigrid.plans.rules import boxes_of

    exprs = exprs or MAPPING
    boxes = boxes_of(goal) if boxes is None else boxes
    d = range(len(goal.axes))
    kept = [k.split(" AS ")[-1].strip() for k in keep.split(",") if k.strip()]
    vs = ", ".join(f"{exprs[a.name]} AS v{k}" for k, a in enumerate(goal.axes))
    bs = ", ".join(f"{sql_index(a, f'v{k}')} AS b{k}" for k, a in enumerate(goal.axes))
    place = {a.name: k for k, a in enumerate(goal.axes)}
    inside = " OR ".join("(" + " AND ".join(f"b{place[n]} >= {s} AND b{place[n]} < {e}" for n, (s, e) in box.items()) + ")" for box in boxes) or "FALSE"
    invalid = " OR ".join(f"v{k} IS NULL" for k in d)
    outside = " OR ".join(f"b{k} IS NULL" for k in d)
    key = "'[' || " + " || ',' || ".join(f"b{k}" for k in d) + " || ']'"
    return (
        f"(SELECT *, CASE WHEN {invalid} THEN 'invalid' WHEN {outside} THEN 'out_of_domain' WHEN {inside} THEN 'masked' ELSE 'valid' END AS status, {key} AS key "
        f"FROM (SELECT {', '.join([*kept, *[f'v{k}' for k in d]])}, {bs} FROM (SELECT {', '.join(x for x in [keep, vs] if x)} FROM {source})))"
    )


SQL_HEADERS = f"""(SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 4 = 3 THEN 'other' ELSE ' pricing ' END AS goal_id,
  CASE WHEN s_suppkey % 5 = 4 THEN ['discount', 'price'] ELSE ['discount', 'price', 'quantity'] END AS keys,
  CASE WHEN s_suppkey % 6 <> 5 THEN 'sig' END AS grid_signature FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT unnest({list(SILENT)})))"""
SQL_OBSERVATIONS = "lineitem"
