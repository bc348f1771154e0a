"""Rows, goals, records, observations, logs and payloads in files that Spark reads and writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densigrid.plans.grid import Axis, Goal, GridError, axis_key, digest
from densigrid.sources import files

#: Used where nothing is stored yet.
DEFAULT_GOALS = (Goal("default", (Axis("x", 0.0, 10.0, 1.0), Axis("y", 0.0, 10.0, 1.0)), 10.0, "Default"),)


def read_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows of csv, tsv, txt, json or parquet files; cells of text files stay text."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        sep = "," if kind == "csv" else "\t"
        return spark.read.options(header=True, inferSchema=False, sep=sep).csv(path)
    if kind in ("json", "parquet"):
        return getattr(spark.read, kind)(path)
    raise GridError(f"cannot read {kind} files", hint="csv, tsv, txt, json or parquet")


class Store:
    """Tables under one folder, in any file system that Spark knows.

    Records, observations, tombstones and logs are appended, partitioned by goal, so that a goal's peers are read without the
    others; each append has a number of a sequence that no other writer gets.  What must change together, the goals and the
    records as rebuilt on their grids, is named by a manifest: a small file for each version, which is written last and of which
    two writers cannot make the same one.  A writer that comes second reads again and repeats its change.  So a reader
    finds one version or the next, never half of it, and ``at`` keeps to one; a writer that dies before the manifest leaves
    only files that nothing names.

    ``saving`` = False makes a store that appends no records and observations, as a service for visitors wants it.
    """

    #: Tables whose rows carry the number of their append.
    NUMBERED = ("records", "observations")
    #: How often a change is repeated when others come first.
    TRIES = 50

    def __init__(self, spark: SparkSession, root: str, version: int | None = None, saving: bool = True):
        self.spark, self.root, self.version, self.saving = spark, root.rstrip("/"), version, saving

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # Versions

    def at(self, version: int | None = None) -> Store:
        """The store as of a version (the present one) for readers: goals and rebuilt records stay what they are now."""
        return Store(self.spark, self.root, self.state()[0] if version is None else version, self.saving)

    def state(self) -> tuple[int, dict]:
        """Number and content of the manifest that is read: 0 and nothing before the first change."""
        found = [n for n in files.names(self.spark, self.path("manifest")) if n.endswith(".json") and not n.startswith("_")]
        if self.version is not None:
            found = [n for n in found if int(n.removesuffix(".json")) == self.version]
        return (int(found[-1].removesuffix(".json")), json.loads(files.read_text(self.spark, self.path(f"manifest/{found[-1]}")))) if found else (0, {})

    def change(self, how: Callable[[dict], dict]) -> int:
        """Make the next version: ``how`` gives it from the present one, again if another writer comes first."""
        if self.version is not None:
            raise GridError("a store at a fixed version is for reading")
        for _ in range(self.TRIES):
            n, now = self.state()
            if files.publish(self.spark, self.path(f"manifest/{n + 1:012d}.json"), json.dumps(how(now), ensure_ascii=False)):
                return n + 1
        raise GridError("too many writers at once", hint="try again")

    # Goals

    def load_goals(self) -> list[Goal]:
        """Stored goals; those that are not valid are dropped, and the defaults stand in for none."""
        return _valid(self.state()[1].get("goals", [])) or list(DEFAULT_GOALS)

    def save_goals(self, goals: list[Goal]) -> None:
        self._goals(lambda old: goals)

    def _goals(self, how: Callable[[list[Goal]], list[Goal]]) -> None:
        def changed(now: dict) -> dict:
            goals = how(_valid(now.get("goals", [])) or list(DEFAULT_GOALS))
            if not goals:
                raise GridError("at least one goal must stay")
            return {**now, "goals": [g.to_json() for g in goals]}

        self.change(changed)

    def upsert_goal(self, goal: Goal) -> None:
        """The goal in the place of the one with its id, or after all others."""
        self._goals(lambda old: [goal if g.id == goal.id else g for g in old] + [goal] * all(g.id != goal.id for g in old))

    def delete_goal(self, goal_id: str) -> bool:
        found = any(g.id == goal_id for g in self.load_goals())
        if found:
            self._goals(lambda old: [g for g in old if g.id != goal_id])
        return found

    def goal(self, goal_id: str) -> Goal:
        for g in self.load_goals():
            if g.id == goal_id.strip():
                return g
        raise GridError(f"there is no goal {goal_id!r}", hint="the ids of saved goals are in load_goals()")

    # Tables

    def append(self, name: str, rows: DataFrame, by: str | None = "goal_id") -> None:
        if name in self.NUMBERED:
            if not self.saving:
                return
            rows = rows.withColumn("saved_seq", F.lit(self.claim("saved")).cast("long"))
        writer = rows.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))

    def claim(self, name: str) -> int:
        return files.claim(self.spark, self.path(f"claims/{name}"))

    def read(self, name: str) -> DataFrame:
        """The rows of a table as they were written, those of deleted records among them."""
        return self.spark.read.parquet(self.path(name))

    def present(self, name: str, goal_id: str | None = None) -> DataFrame:
        """Rows whose record was not deleted after they were saved."""
        rows = self.read(name)
        return self._without_deleted(rows if goal_id is None else rows.where(F.col("goal_id") == goal_id))

    def _without_deleted(self, rows: DataFrame) -> DataFrame:
        if not files.exists(self.spark, self.path("deleted")):
            return rows.drop("saved_seq")
        gone = self.read("deleted").groupBy("record_id").agg(F.max("seq").alias("gone_seq"))
        kept = rows.join(gone, "record_id", "left").where(F.col("gone_seq").isNull() | (F.col("saved_seq") > F.col("gone_seq")))
        return kept.drop("saved_seq", "gone_seq")

    def records(self, goal_id: str | None = None) -> DataFrame:
        return self.present("records", goal_id)

    def observations(self, goal_id: str | None = None) -> DataFrame:
        return self.present("observations", goal_id)

    def record(self, record_id: str) -> DataFrame:
        found = self.records().where(F.col("record_id") == record_id.strip())
        if found.isEmpty():
            raise GridError(f"there is no record {record_id!r}")
        return found

    def delete_record(self, record_id: str) -> bool:
        """A record goes by a tombstone, which hides what was saved before it: saved again, the record is there again."""
        found = not self.records().where(F.col("record_id") == record_id).isEmpty()
        if found:
            self.append("deleted", self.spark.createDataFrame([(record_id, self.claim("saved"))], "record_id string, seq long"), None)
        return found

    # Previews and applied grids

    def log_preview(self, goal: Goal, session: str, changes: list[dict], created_at: str, action: str = "preview_recalculated") -> dict:
        """Append an entry on a previewed grid to the goal's log: its number in the session, which no other entry gets, the axes
        before (those after the session's last entry, else the goal's) and after.  Only a session's own entries are read."""
        sequence = self.claim(f"log-{digest([goal.id, session])[:32]}")
        last = None
        if sequence > 1 and files.exists(self.spark, self.path("logs")):
            mine = self.read("logs").where((F.col("goal_id") == goal.id) & (F.col("session_id") == session) & (F.col("sequence") < sequence))
            last = mine.agg(F.max_by("axes_after", "sequence").alias("axes")).first().axes
        axes = lambda g: json.dumps([vars(a) for a in g.axes])
        entry = {"goal_id": goal.id, "session_id": session, "sequence": sequence, "created_at": created_at, "action": action, "axes_before": last or axes(goal), "axes_after": axes(goal.with_axes(changes))}
        self.append("logs", self.spark.createDataFrame([tuple(entry.values())], "goal_id string, session_id string, sequence long, created_at string, action string, axes_before string, axes_after string"))
        return entry

    def preview(self, goal_id: str, selected: list[str], changes: list[dict], order: list[str], target: DataFrame | None = None, session: str = "", created_at: str = "", action: str = "preview_recalculated") -> tuple[DataFrame, dict | None]:
        """A previewed grid of a goal over the store's records (``preview.request``), and the log entry of the session, if one is named
        and the preview was not too large to be made."""
        from densigrid.operators import preview
        from densigrid.operators.grids import MOST_PREVIEW_BINS

        goal = self.goal(goal_id)
        made = preview.request(self.records(goal.id), self.observations(goal.id), goal, selected, changes, order, target)
        if not session.strip() or preview.previewed_goal(goal, selected, changes).total_bins > MOST_PREVIEW_BINS:
            return made, None
        wanted = {axis_key(n) for n in selected}
        return made, self.log_preview(goal, session.strip(), [c for c in changes if axis_key(c["name"]) in wanted], created_at, action)

    def apply_grid(self, goal_id: str, changes: list[dict], order: list[str]) -> DataFrame:
        """Change a goal's axes and rebuild its records from their observations on the new grid.  The records are written
        first, under a name of their own; then one manifest names them and the changed goal.  An error if someone else
        changed the goal's axes meanwhile."""
        from densigrid.operators.records import rebuilt

        before = self.goal(goal_id)
        goal = before.with_axes(changes)
        upto, folder = self.claim("saved"), f"rebuilt/{uuid.uuid4().hex}"
        rows = rebuilt(self.observations(goal.id), goal, order)
        rows.withColumns({"goal_id": F.lit(goal.id), "saved_seq": F.lit(upto).cast("long")}).write.parquet(self.path(folder))

        def changed(now: dict) -> dict:
            goals = _valid(now.get("goals", [])) or list(DEFAULT_GOALS)
            if next((g.axes for g in goals if g.id == goal.id), None) != before.axes:
                raise GridError(f"the axes of goal {goal.id!r} have changed meanwhile", hint="look at the goal again")
            here = [replace(g, axes=goal.axes) if g.id == goal.id else g for g in goals]
            return {**now, "goals": [g.to_json() for g in here], "rebuilt": {**now.get("rebuilt", {}), goal.id: folder}}

        version = self.change(changed)
        return self.at(version).rebuilt_records(goal)

    def rebuilt_records(self, goal: Goal) -> DataFrame:
        """The goal's records as they were rebuilt when its grid was last applied; deleted ones are left out."""
        folder = self.state()[1].get("rebuilt", {}).get(goal.id)
        if folder is None:
            raise GridError(f"no grid of goal {goal.id!r} was applied yet")
        return self._without_deleted(self.read(folder))

    def applied_counts(self, goal: Goal) -> DataFrame:
        """One row: the goal's records that were rebuilt, and those that could not be for want of observations."""
        made = self.rebuilt_records(goal).select("record_id", F.lit(1).alias("__made"))
        return self.records(goal.id).select("record_id").distinct().join(made, "record_id", "left").agg(F.count("__made").alias("updated_records"), F.count(F.when(F.col("__made").isNull(), 1)).alias("legacy_excluded"))

    # Envelopes

    def write_envelope(self, key: str, payload: object) -> int:
        """Append an envelope ``{"key", "payload"}`` under the next number; ``latest_payload`` reads the newest of each key."""
        n = self.claim("envelopes")
        row = (n, json.dumps({"key": key, "payload": payload}, ensure_ascii=False))
        self.append("envelopes", self.spark.createDataFrame([row], "id long, content string"), None)
        return n

    def status(self) -> DataFrame:
        """name, rows, path of each table that exists."""
        made = [(n, self.read(n).count(), self.path(n)) for n in ("records", "observations", "logs") if files.exists(self.spark, self.path(n))]
        _, now = self.state()
        if now.get("goals"):
            made.insert(0, ("goals", len(now["goals"]), self.path("manifest")))
        return self.spark.createDataFrame(made, "name string, rows long, path string")


def _valid(goals: list[str]) -> list[Goal]:
    out = []
    for text in goals:
        try:
            out.append(Goal.from_json(text))
        except (GridError, KeyError, TypeError, ValueError):
            continue
    return out


class Database:
    """Envelopes in a table of a database: ids come from the database, so writers never share one."""

    def __init__(self, spark: SparkSession, url: str, table: str = "contents", properties: dict | None = None):
        self.spark, self.url, self.table, self.properties = spark, url, table, dict(properties or {})

    def _connected(self):
        settings = self.spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            settings.setProperty(k, v)
        if driver := self.properties.get("driver"):
            self.spark._jvm.java.lang.Class.forName(driver)
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url, settings)

    def create(self, content: str = "CLOB") -> None:
        """Make the table, unless it is there; ``content`` is the database's type for long texts."""
        connection = self._connected()
        try:
            known = connection.getMetaData().getTables(None, None, "%", None)
            while known.next():
                if known.getString("TABLE_NAME").lower() == self.table.lower():
                    return
            connection.createStatement().execute(f"CREATE TABLE {self.table} (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, content {content})")
        finally:
            connection.close()

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, what, properties=self.properties)

    def append(self, envelopes: DataFrame) -> None:
        """(key, payload as JSON text) of each row as an envelope; the database numbers them."""
        content = F.concat(F.lit('{"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
        envelopes.select(content.alias("content")).write.jdbc(self.url, self.table, "append", self.properties)

    def latest(self) -> DataFrame:
        return latest_payload(self._read(self.table).toDF("id", "content"))


def backend(spark: SparkSession, settings: dict[str, str], root: str) -> Store | Database:
    """The database only where it is asked for (``storage`` = database) and named (``database_url``); else the files under
    ``root``.  ``save`` = false makes a store of files that takes no records."""
    if settings.get("storage", "").strip().lower() == "database" and settings.get("database_url", "").strip():
        known = {k.removeprefix("database_"): v for k, v in settings.items() if k.startswith("database_") and k not in ("database_url", "database_table")}
        return Database(spark, settings["database_url"], settings.get("database_table", "").strip() or "contents", known)
    return Store(spark, root, saving=settings.get("save", "true").strip().lower() in ("1", "true", "yes", "on"))


def latest_payload(envelopes: DataFrame, content: str = "content", order: str = "id") -> DataFrame:
    """key, id, payload: of envelopes ``{"key": ..., "payload": ...}`` the newest of each key."""
    parts = envelopes.select(F.col(order).alias("id"), F.get_json_object(content, "$.key").alias("key"), F.get_json_object(content, "$.payload").alias("payload"))
    return parts.where("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("id"), F.max_by("payload", "id").alias("payload"))


def numbered(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
