"""Tables of tasks, settings, history and relations between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def superseded(rows: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """All rows but the first of each key in an order: what a clean-up deletes."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1").drop("_n")


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with incoming rows in place of those of equal keys."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def stale(tasks: DataFrame, now: F.Column, seconds: int = 600) -> DataFrame:
    """Running tasks whose heartbeat is older than so many seconds; tasks without one are not stale."""
    return tasks.where((F.col("status") == "running") & (F.col("heartbeat") < now - F.expr(f"INTERVAL {seconds} SECONDS")))


def due(dispatches: DataFrame, now: F.Column, most: int = 100) -> DataFrame:
    """Pending dispatches whose time has come, the oldest first: the next batch of an outbox."""
    return dispatches.where((F.col("status") == "pending") & ~F.coalesce(F.col("available_at") > now, F.lit(False))).orderBy("created_at", "id").limit(most)


def claimed(tasks: DataFrame, claims: DataFrame) -> DataFrame:
    """(task_id, worker): the first claim of each queued task wins. claims(task_id, worker, at)."""
    queued = tasks.where("status = 'queued'").select("task_id")
    return latest(claims.join(queued, "task_id", "left_semi"), ["task_id"], F.asc("at"), F.asc("worker")).select("task_id", "worker")


def setting(scopes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(project, stage) with value: that of project and stage, else of the project, else of the stage, else the default.

    scopes(project, stage, priority, value), null project or stage: any. Four equality joins, no join on a disjunction."""
    first = lambda keys, where, name: latest(scopes.where(where), keys or [F.lit(1)], F.asc("priority"), F.asc("value")).select(*keys, F.col("value").alias(name))
    exact = first(["project", "stage"], "project IS NOT NULL AND stage IS NOT NULL", "v1")
    project = first(["project"], "project IS NOT NULL AND stage IS NULL", "v2")
    stage = first(["stage"], "project IS NULL AND stage IS NOT NULL", "v3")
    default = scopes.where("project IS NULL AND stage IS NULL").agg(F.min_by("value", F.struct("priority", "value")).alias("v4"))
    out = wanted.join(exact, ["project", "stage"], "left").join(project, "project", "left").join(stage, "stage", "left").crossJoin(F.broadcast(default))
    return out.select("project", "stage", F.coalesce("v1", "v2", "v3", "v4").alias("value"))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """parents' keys with the number of rows of each child table, pre-aggregated before the joins."""
    out = parents.select(key)
    for name, rows in children.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in children))


def next_code(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, code): of slug, slug-2, slug-3, ... the first that is free; names of one slug take them in order of name.

    names(name, slug), taken(code). Another name's own slug counts as taken, so that slugs are settled before numbers. Taken
    numbers and names of a slug are swept together: the k-th name gets k plus as many as are taken before the k-th free number."""
    own = names.select(F.col("slug").alias("code"))
    codes = taken.select("code").unionByName(own).where(F.col("code").isNotNull()).distinct()
    number = F.regexp_extract("code", r"-([1-9]\d*)$", 1).try_cast("long")
    numbered = codes.select(F.regexp_replace("code", r"-[1-9]\d*$", "").alias("slug"), number.alias("n")).where("n >= 2")
    plain = taken.select(F.col("code").alias("slug"), F.lit(1).cast("long").alias("n"))
    used = numbered.unionByName(plain).distinct().withColumn("at", F.col("n") - F.row_number().over(Window.partitionBy("slug").orderBy("n")))
    wanted = names.select("slug", "name", F.row_number().over(Window.partitionBy("slug").orderBy("name")).cast("long").alias("at"))
    # a number taken before the k-th free one has fewer than k free ones below it
    rows = wanted.withColumn("used", F.lit(0)).unionByName(used.select("slug", F.lit(None).cast(dict(names.dtypes)["name"]).alias("name"), "at", F.lit(1).alias("used")))
    swept = rows.withColumn("n", F.col("at") + F.sum("used").over(Window.partitionBy("slug").orderBy("at", "used").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("used = 0")
    return swept.select("name", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n"))).alias("code"))


def audit(events: DataFrame, path: str, value: str) -> DataFrame:
    """Events whose JSON payload has a value at a path."""
    return events.where(F.get_json_object("payload", path) == value)


def first_known(rows: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """For each key and column the first value in order that is not null."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def most_common(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """For each key the most frequent value that is not null; of equally frequent ones that seen first in order, then the smallest."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return seen.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), "first", value)).alias(value))


def listed(tasks: DataFrame, album: str | None = None, kind: str | None = None) -> DataFrame:
    """Tasks of an album and of a kind, where these are asked for, the newest first."""
    for column, value in (("album_id", album), ("task_type", kind)):
        tasks = tasks if value is None else tasks.where(F.col(column) == value)
    return tasks.orderBy(F.desc("created_at"), "task_id")


def reassigned(rows: DataFrame, column: str, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with old values of a column replaced by new ones, and (old, moved): how many rows each move touched. moves(old, new), old distinct."""
    both = rows.join(moves.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    counts = rows.groupBy(F.col(column).alias("old")).agg(F.count("*").alias("moved"))
    changed = both.withColumn(column, F.coalesce("_new", column)).drop("_new").select(rows.columns)
    return changed, moves.select("old").join(counts, "old", "left").na.fill({"moved": 0})


def fresh(changes: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """changes with accepted: whether the revision that each expects is the current one; a change that expects none is accepted, one of an unknown key is not."""
    now = current.select(key, F.col("revision").alias("_now"))
    ok = F.col("_now").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == F.col("_now")))
    return changes.join(now, key, "left").withColumn("accepted", ok).drop("_now")
