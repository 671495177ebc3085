"""Keeping the catalog in step with its sources: diffs, deletions, jobs, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.filters import in_scope

RETRY_STATUSES = ("queued", "failed", "locked", "denied")
FIRST_DELAY, LONGEST_DELAY, MOST_DOUBLINGS = 30, 86_400, 12
MOST_PENDING = 512


def diff(known: DataFrame, listed: DataFrame, keys: list[str], complete: bool = True, scope: str = "", extractor_changed: Column | None = None, verify_all: bool = False) -> DataFrame:
    """keys with change: new, changed, retry, same or gone.

    Both have keys, size, mtime, relative_path; known also status. Rows go only after a complete listing, and
    only inside the scope. One full outer join; nothing is compared on the driver.
    """
    a = known.filter(in_scope(F.col("relative_path"), scope)).select(*keys, F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("status").alias("old_status"), F.lit(True).alias("was"))
    b = listed.filter(in_scope(F.col("relative_path"), scope)).select(*keys, "size", "mtime", F.lit(True).alias("now"))
    both = a.join(b, keys, "full_outer")
    differs = (F.col("old_size") != F.col("size")) | (F.abs(F.col("old_mtime") - F.col("mtime")) > 1e-6) | F.lit(verify_all)
    if extractor_changed is not None:
        differs = differs | extractor_changed
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), F.lit("gone" if complete else "same")).when(differs, "changed").when(F.col("old_status").isin(*RETRY_STATUSES), "retry").otherwise("same")
    return both.select(*keys, change.alias("change"))


def apply_diff(known: DataFrame, listed: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot of files: gone rows leave, new and changed ones come from the listing and are queued."""
    stay = known.join(changes.filter(F.col("change").isin("same", "retry")), keys, "left_semi")
    fresh = listed.join(changes.filter(F.col("change").isin("new", "changed")), keys, "left_semi").withColumn("status", F.lit("queued"))
    return stay.unionByName(fresh, allowMissingColumns=True)


def delete_scope(files: DataFrame, scope: str) -> DataFrame:
    return files.filter(~in_scope(F.col("relative_path"), scope))


def cascade(files: DataFrame, contents: DataFrame, passages: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contents, passages and vectors that some file still owns; shared contents stay until the last owner goes."""
    kept = contents.join(files.select("content_id"), "content_id", "left_semi")
    own = passages.join(kept.select("content_id"), "content_id", "left_semi")
    return kept, own, vectors.join(own.select("passage_id"), "passage_id", "left_semi")


def revoke(files: DataFrame, hit: Column) -> DataFrame:
    """Files with access withdrawn: denied, without content."""
    return files.withColumn("content_id", F.when(~hit, F.col("content_id"))).withColumn("status", F.when(hit, "denied").otherwise(F.col("status")))


def revoke_all(files: DataFrame, contents: DataFrame, passages: DataFrame, vectors: DataFrame, jobs: DataFrame, hit: Column) -> tuple[DataFrame, ...]:
    """revoke() with all that follows: the files' jobs go, and contents, passages and vectors that no file owns any more."""
    left = revoke(files, hit)
    waiting = jobs.join(files.filter(hit).select("file_id"), "file_id", "left_anti")
    return left, *cascade(left, contents, passages, vectors), waiting


def retry_delay(attempts: Column) -> Column:
    """Seconds to wait after so many attempts: doubling from 30, a day at most."""
    return F.least(F.lit(float(LONGEST_DELAY)), FIRST_DELAY * F.pow(F.lit(2.0), F.least(F.lit(MOST_DOUBLINGS), attempts)))


def ready_jobs(jobs: DataFrame, phase: str, now: float, limit: int | None = None, folder: str | None = None) -> DataFrame:
    """Jobs of a phase whose retry time has come, in id order; with a folder, its own jobs only."""
    out = jobs.filter((F.col("phase") == phase) & (F.col("retry_at") <= now))
    if folder is not None:
        out = out.filter(in_scope(F.col("relative_path"), folder))
    out = out.orderBy("file_id")
    return out.limit(limit) if limit else out


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, the root '' included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def minimal_scopes(scopes: DataFrame, path: str = "path") -> DataFrame:
    """Scopes that no other scope covers. An absolute one or one with '..' means the whole root.

    Each scope looks its ancestors up by an equi-join; none is compared with all others.
    """
    p = F.col(path)
    unsafe = p.startswith("/") | F.array_contains(F.split(p, "/"), "..")
    clean = scopes.select(F.when(unsafe, "").otherwise(p).alias("scope")).distinct()
    up = clean.filter("scope <> ''").select("scope", F.explode(ancestors(F.col("scope"))).alias("above"))
    covered = up.join(clean.select(F.col("scope").alias("above")), "above", "left_semi").select("scope").distinct()
    return clean.join(covered, "scope", "left_anti")


def frontier_order(changed: list[str]) -> list[Column]:
    """Folders with pending changes first, then Documents, Desktop, the rest; shorter paths first."""
    hit = F.lit(False)
    for s in changed:
        hit = hit | in_scope(F.col("relative_path"), s)
    p = F.col("relative_path")
    home = F.when((p == "Documents") | p.startswith("Documents/"), 0).when((p == "Desktop") | p.startswith("Desktop/"), 1).otherwise(2)
    return [F.when(hit, 0).otherwise(1), home, F.length(p), p]


def upsert_sources(known: DataFrame, added: DataFrame) -> DataFrame:
    """Sources by identity: one added again takes the new path and comes online; others are appended."""
    a, b = known.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.identity") == F.col("b.identity"), "full_outer")
    new = F.col("b.identity").isNotNull()
    return joined.select(
        F.coalesce("a.source_id", "b.source_id").alias("source_id"), F.coalesce("a.identity", "b.identity").alias("identity"), F.coalesce("a.name", "b.name").alias("name"),
        F.when(new, F.col("b.path")).otherwise(F.col("a.path")).alias("path"), F.when(new, "online").otherwise(F.col("a.availability")).alias("availability"),
    )


def exclude(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that a source keeps after its exclusions change."""
    from lodestack.functions.text import excluded

    return files.filter(~excluded(F.col("relative_path"), patterns))


RECONCILE_SECONDS = 900


def due_sources(sources: DataFrame, now: float) -> DataFrame:
    """Sources to look at again: neither paused nor offline, and not looked at for a quarter of an hour."""
    late = F.col("last_scan").isNull() | (F.col("last_scan") <= now - RECONCILE_SECONDS)
    return sources.filter(~F.col("availability").isin("paused", "offline") & late)


def stable_reads(before: DataFrame, read: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """read's rows with verdict: publish, retry or gone.

    before and after are listings (keys, size, mtime) from just before and just after the contents were read. What was read
    of a file whose stamp changed meanwhile may be half of one state and half of another, so it isn't published but read
    again; a file that is no longer listed goes. A row that the first listing doesn't have is read again as well.
    """
    stamp = lambda of, n: of.select(*keys, F.col("size").alias(f"_size{n}"), F.col("mtime").alias(f"_mtime{n}"))
    joined = read.join(stamp(before, 0), keys, "left").join(stamp(after, 1), keys, "left")
    same = (F.col("_size0") == F.col("_size1")) & (F.abs(F.col("_mtime0") - F.col("_mtime1")) <= 1e-6)
    verdict = F.when(F.col("_size1").isNull(), "gone").when(same, "publish").otherwise("retry")
    return joined.withColumn("verdict", verdict).drop("_size0", "_mtime0", "_size1", "_mtime1")


def queued_files(jobs: DataFrame, files: DataFrame, phase: str, now: float, limit: int | None = None, folder: str | None = None) -> DataFrame:
    """Files whose job of a phase is ready, in id order, with its attempts and the time of the next try if this one fails:
    jobs has (file_id, phase, attempts, retry_at). A job whose file is gone is left out."""
    met = jobs.join(files, "file_id")
    ready = ready_jobs(met, phase, now, limit, folder)
    return ready.withColumn("next_try", F.lit(float(now)) + retry_delay(F.col("attempts") + 1))
