"""Projections and changes of entities over their life: nested children, states, revisions, deletion, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.operators import graphs


def nested(parents: DataFrame, key: str, children: DataFrame, name: str, *order: str) -> DataFrame:
    """parents with an array of their children's rows in order; empty without any. A parent's children meet in one row, so this is for serving
    parents of bounded families; otherwise join flat."""
    own = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in own if c not in order)))).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def states(log: DataFrame) -> DataFrame:
    """(task_id, status, progress, error, attempts): a task's state from its log(task_id, at, status, progress, error). Success is of progress 100; later rows of a finished task don't count."""
    done = log.where(F.col("status").isin("succeeded", "failed", "cancelled")).groupBy("task_id").agg(F.min("at").alias("end"))
    alive = log.join(done, "task_id", "left").where(F.col("end").isNull() | (F.col("at") <= F.col("end")))
    last = alive.groupBy("task_id").agg(F.max_by(F.struct("status", "progress", "error"), F.struct("at", "status")).alias("s"), F.count_if(F.col("status") == "running").alias("attempts"))
    return last.select("task_id", "s.status", F.when(F.col("s.status") == "succeeded", 100).otherwise(F.coalesce("s.progress", F.lit(0))).alias("progress"), F.when(F.col("s.status") == "failed", F.col("s.error")).alias("error"), "attempts")


def superseded_but(profiles: DataFrame, keep: Column, active: tuple[str, ...] = ("candidates_ready", "review_pending", "confirmed")) -> DataFrame:
    """profiles with all active ones but those to keep marked superseded."""
    return profiles.withColumn("status", F.when(F.col("status").isin(*active) & ~keep, "superseded").otherwise(F.col("status")))


def revisions(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """after with the revision of before, one more where a field differs; null and null are equal."""
    old = before.select(key, "revision", F.struct(*fields).alias("_old"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_old.{f}"))
    return after.drop("revision").join(old, key).withColumn("revision", F.col("revision") + F.when(same, 0).otherwise(1)).drop("_old")


def storage_keys(albums: DataFrame, key: str, *owned: tuple[DataFrame, str]) -> DataFrame:
    """(key, path): every file of the albums, from tables of (table, column of paths): what a deletion removes before the rows."""
    out = None
    for rows, column in owned:
        part = rows.join(albums.select(key).distinct(), key, "left_semi").where(F.col(column).isNotNull()).select(key, F.col(column).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def owned_keys(start: DataFrame, owns: DataFrame, files: DataFrame) -> DataFrame:
    """(node, path): every file that goes with the nodes of start: those of what they own, through any number of owners. owns(owner, owned), files(node, path)."""
    return graphs.reached(start, owns, []).select("node").join(files.where(F.col("path").isNotNull()), "node").select("node", "path").distinct()


def manifest(sections: DataFrame, key: str, html: str, chapter: str) -> DataFrame:
    """By album: pages, chapters and bytes of UTF-8 of its markup."""
    return sections.groupBy(key).agg(F.count("*").alias("pages"), F.count_distinct(chapter).alias("chapters"), F.sum(F.octet_length(html)).alias("bytes"))


def exportable(albums: DataFrame) -> DataFrame:
    """Albums that are rendered or exported and have an artifact, its legacy path where the new one is missing."""
    ready = albums.withColumn("artifact", F.coalesce("artifact_path", "legacy_path"))
    return ready.where(F.col("status").isin("rendered", "exported") & F.col("artifact").isNotNull())


def with_project(albums: DataFrame, projects: DataFrame) -> DataFrame:
    """albums whose missing project is filled by their user's; users without one are what projects lack."""
    mine = projects.groupBy("user_id").agg(F.min("project_id").alias("_own"))
    return albums.join(mine, "user_id", "left").withColumn("project_id", F.coalesce("project_id", "_own")).drop("_own")


def seeded(existing: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """existing with the defaults whose key it lacks."""
    return existing.unionByName(defaults.join(existing.select(key), key, "left_anti").select(existing.columns))


def recounted(albums: DataFrame, photos: DataFrame, key: str) -> DataFrame:
    """albums with photo_count as counted, and whether it was wrong."""
    n = photos.groupBy(key).agg(F.count("*").alias("_n"))
    out = albums.join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.withColumn("corrected", ~F.col("photo_count").eqNullSafe(F.col("_n"))).withColumn("photo_count", F.col("_n")).drop("_n")


def run_metrics(chapters: DataFrame, photos: DataFrame, key: str) -> DataFrame:
    """By album: chapters, segments, low-quality chapters, first chosen and automatic number, and the share of photos with an embedding.

    chapters(key, nth, segments, quality, auto_k, selected_k), photos(key, embedding)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("nth")))
    a = chapters.groupBy(key).agg(F.count("*").alias("chapters"), F.sum("segments").alias("segments"), F.count_if(F.col("quality") < 0.60).alias("low_quality"), first("auto_k").alias("auto_k"), first("selected_k").alias("selected_k"))
    b = photos.groupBy(key).agg(F.round(F.count("embedding") / F.count("*"), 4).alias("embedded"))
    return a.join(b, key, "left")


def failure_hash(id: Column, storage_key: Column) -> Column:
    """A stable stand-in for the content hash of a photo that could not be read."""
    return F.sha2(F.concat_ws(":", id, storage_key), 256)


def token_valid(token: Column, now: Column, **expected: Column) -> Column:
    """Whether a verified token's claims (a struct) are unexpired and equal what is asked for."""
    ok = token["exp"] >= now
    for name, value in expected.items():
        ok = ok & token[name].eqNullSafe(value)
    return F.coalesce(ok, F.lit(False))


def cleared(albums: DataFrame, changed: DataFrame, key: str, stale: str = "cleaned") -> tuple[DataFrame, DataFrame]:
    """albums, of which the changed ones lose their artifacts and, if they were rendered or exported, go back to a status; and (key, path) of the files to delete.

    albums: key, status, preview_path, print_path, manifest_path."""
    paths = ("preview_path", "print_path", "manifest_path")
    hit = albums.join(changed.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    gone = hit.where("_hit").select(key, F.explode(F.array_compact(F.array(*paths))).alias("path"))
    back = F.when(F.col("_hit") & F.col("status").isin("rendered", "exported"), stale).otherwise(F.col("status"))
    return hit.withColumn("status", back).withColumns({p: F.when(~F.col("_hit"), F.col(p)) for p in paths}).select(albums.columns), gone


def positions(photos: DataFrame) -> DataFrame:
    """photos with position, from 0, in their album's order of upload."""
    return photos.withColumn("position", F.row_number().over(Window.partitionBy("album_id").orderBy("uploaded_at", "photo_id")) - 1)


def best_rated(photos: DataFrame, most: int = 6) -> DataFrame:
    """Each album's photos of highest quality, those without one last."""
    order = Window.partitionBy("album_id").orderBy(F.coalesce("quality", F.lit(0.0)).desc(), "photo_id")
    return photos.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def busy(tasks: DataFrame, albums: DataFrame, key: str) -> DataFrame:
    """Distinct keys (as of projects) of albums that have queued or running tasks."""
    active = tasks.where(F.col("status").isin("queued", "running")).select("album_id")
    return albums.join(active, "album_id", "left_semi").select(key).distinct()
