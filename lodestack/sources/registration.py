"""Registering sources: identity, bounded probes, availability, application folders."""

from __future__ import annotations

import os
import plistlib
import queue
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.incremental import ancestors

NETWORK_TYPES = ("smbfs", "nfs", "afpfs", "webdav")
PROBES, PROBE_SECONDS = 2, 20.0
# Folders that count as one thing, and limits of a walk.
PACKAGES = {"app", "framework", "bundle", "plugin", "xpc", "appex", "kext"}
MOST_ENTRIES, MOST_DEPTH, MOST_PLIST = 20_000, 5, 1 << 20


def identity(kind: Column, volume: Column, mount: Column, path: Column) -> Column:
    """type|volume|path below the mount: the same place keeps it under another mount point."""
    below = F.when(F.startswith(path, mount), F.substring(path, F.length(mount) + 1, F.length(path))).otherwise(path)
    return F.concat_ws("|", kind, volume, below)


def source_kind(fs: Column, local: Column, internal: Column) -> Column:
    return F.when(~local | fs.isin(*NETWORK_TYPES), "network").when(~internal, "external").otherwise("local")


class Prober:
    """Runs file-system probes that may hang: at most two at a time, each caller waiting for a bounded time.

    A probe whose caller gave up before it started never runs; a running one that hangs holds its place but no
    caller.
    """

    def __init__(self, probe: Callable, workers: int = PROBES, seconds: float = PROBE_SECONDS):
        self.probe, self.seconds = probe, seconds
        self.waiting: queue.Queue = queue.Queue()
        for _ in range(workers):
            threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        while True:
            place, box = self.waiting.get()
            if box["cancelled"].is_set():
                continue
            try:
                box["out"] = self.probe(place)
            except Exception as e:  # noqa: BLE001  handed to the caller
                box["error"] = e
            box["done"].set()

    def inspect(self, place, seconds: float | None = None):
        box = {"done": threading.Event(), "cancelled": threading.Event()}
        self.waiting.put((place, box))
        if not box["done"].wait(self.seconds if seconds is None else seconds):
            box["cancelled"].set()
            raise TimeoutError("the location did not answer in time")
        if "error" in box:
            raise box["error"]
        return box["out"]


def refresh_availability(sources: DataFrame, found: DataFrame) -> DataFrame:
    """sources (identity, path, paused, ...) after a look at their places: found has (identity, path, state).

    A place with the same identity is online under its present path; denied, missing or other places are
    offline; a paused source stays paused. Catalogs of offline sources are kept.
    """
    seen = found.filter("state = 'ok'").groupBy("identity").agg(F.min("path").alias("_path"))
    joined = sources.join(seen, "identity", "left")
    state = F.when(F.col("paused"), "paused").when(F.col("_path").isNotNull(), "online").otherwise("offline")
    return joined.withColumn("availability", state).withColumn("path", F.coalesce("_path", "path")).drop("_path")


def nearest_folders(scopes: DataFrame, folders: DataFrame, scope: str = "scope", path: str = "relative_path") -> DataFrame:
    """(scope, folder): the nearest folder at or above each scope that exists, '' (the root) if none does.

    A scope looks itself and its ancestors up among the folders by an equi-join, so neither side is carried whole.
    """
    own = scopes.select(F.col(scope).alias("scope")).distinct()
    up = own.select("scope", F.explode(F.array_append(ancestors(F.col("scope")), F.col("scope"))).alias("folder"))
    met = up.join(folders.select(F.col(path).alias("folder")).distinct(), "folder", "left_semi").unionByName(own.select("scope", F.lit("").alias("folder")))
    return met.groupBy("scope").agg(F.max_by("folder", F.length("folder")).alias("folder"))


@dataclass(frozen=True)
class Application:
    path: str
    name: str
    bundle_id: str | None


def _usable(value) -> str | None:
    if not isinstance(value, str):
        return None
    value = "".join(" " if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in value).strip()
    return value[:256] if value and "$(" not in value else None


def read_application(path: str, target: str) -> Application | None:
    """The application of a bundle, or None for background helpers and other kinds of bundles."""
    info: dict = {}
    plist = os.path.join(target, "Contents", "Info.plist")
    try:
        if os.path.isfile(plist) and not os.path.islink(plist) and os.path.getsize(plist) <= MOST_PLIST:
            with open(plist, "rb") as f:
                loaded = plistlib.load(f)
            info = loaded if isinstance(loaded, dict) else {}
    except Exception:  # noqa: BLE001  an unreadable description counts as none
        info = {}
    bundle = _usable(info.get("CFBundleIdentifier"))
    kind = info.get("CFBundlePackageType")
    if isinstance(kind, str) and kind not in ("APPL", "XPC!") and not (kind == "FNDR" and bundle == "com.apple.finder"):
        return None
    background = info.get("LSBackgroundOnly")
    if background is True or background == 1 or isinstance(background, str) and background.lower() in ("1", "true", "yes"):
        return None
    name = _usable(info.get("CFBundleDisplayName")) or _usable(info.get("CFBundleName")) or os.path.basename(path)[:-4]
    return Application(path, name, bundle)


def discover_applications(roots: Iterable[str]) -> list[Application]:
    """Bundles below the roots, each target once; linked folders aren't entered and bundles aren't looked into."""
    out: list[Application] = []
    targets: set[str] = set()
    entered: set[str] = set()
    seen = 0

    def take(path: str) -> None:
        target = os.path.realpath(path)
        if target.lower().endswith(".app") and os.path.isdir(target) and target not in targets:
            targets.add(target)
            app = read_application(path, target)
            if app:
                out.append(app)

    for root in roots:
        if root == "/":
            continue
        if root.lower().endswith(".app"):
            take(root)
            continue
        pending = [(root, 0)]
        while pending and seen < MOST_ENTRIES:
            folder, depth = pending.pop()
            if folder in entered or os.path.islink(folder) or not os.path.isdir(folder):
                continue
            entered.add(folder)
            try:
                names = sorted(os.listdir(folder))
            except OSError:
                continue
            for name in names:
                if name.startswith("."):
                    continue
                seen += 1
                if seen > MOST_ENTRIES:
                    break
                path = os.path.join(folder, name)
                ext = name.rpartition(".")[2].lower() if "." in name else ""
                if ext == "app":
                    take(path)
                elif os.path.isdir(path) and not os.path.islink(path) and depth < MOST_DEPTH and ext not in PACKAGES:
                    pending.append((path, depth + 1))
    return out


def applications(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """(path, name, file_name, bundle_id, running) of the machine that the driver runs on."""
    rows = [(a.path, a.name, os.path.basename(a.path)[:-4], a.bundle_id, False) for a in discover_applications(roots)]
    return spark.createDataFrame(rows, "path string, name string, file_name string, bundle_id string, running boolean")
