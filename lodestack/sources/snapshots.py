"""Versioned snapshots of the catalog's tables: atomic publication, stable readers, erasure."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lodestack.runtime import cleaned


class Snapshots:
    """Tables of one catalog below a folder that all machines share.

    A publication writes every table under a new version, then moves a pointer file into place; readers follow
    the pointer once and so always see one version whole. A failed publication leaves the pointer alone.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str) -> dict | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(path).collect()))  # one short file

    def current(self) -> int:
        """The number of the newest published version; 0 if there is none."""
        if not self._fs.exists(self._path(self.root)):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max([int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json")], default=0)

    def publish(self, tables: dict[str, DataFrame], sort: dict[str, list[str]] | None = None, base: int | None = None, segments: tuple[str, ...] = (), pieces: dict[str, int] | None = None) -> int:
        """Write the tables as the next version. Tables left out keep their files of the base version.

        base is the version that the caller started from: if another one was published since, nothing changes
        and an error is raised. sort gives columns to order a table's files by, such as an index's term: all its files
        together, or those named in segments each by itself, which shuffles nothing; a reader then prunes within each file.
        pieces gives the bytes of a table's row groups, so that tasks of this size can read a large file side by side.
        """
        now = self.current()
        if base is not None and base != now:
            raise RuntimeError(f"version {now} was published after {base}")
        version = now + 1
        paths = dict((self._read(f"{self.root}/current-{now}.json") or {}).get("tables", {}))
        for name, df in tables.items():
            path = f"{self.root}/v{version}/{name}"
            if sort and name in sort:
                df = (df if name in segments else df.repartitionByRange(*sort[name])).sortWithinPartitions(*sort[name])
            out = df.write.mode("overwrite").option("compression", "zstd")
            if pieces and name in pieces:
                out = out.option("parquet.block.size", pieces[name])
            with cleaned(self.spark):
                out.parquet(path)
            paths[name] = path
        part = self._path(f"{self.root}/.next-{version}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"tables": paths}).encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{self.root}/current-{version}.json")):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def table(self, name: str, version: int | None = None) -> DataFrame:
        held = self._read(f"{self.root}/current-{version or self.current()}.json")
        return self.spark.read.parquet(held["tables"][name])

    def names(self) -> list[str]:
        """The names of the newest version's tables."""
        return list((self._read(f"{self.root}/current-{self.current()}.json") or {}).get("tables", {}))

    def erase(self, keep: int = 1) -> list[str]:
        """Delete the files of all but the newest versions, so that removed text is gone from storage as well.

        Tables that an older version shares with a kept one stay. Returns what was deleted.
        """
        last = self.current()
        kept = range(max(1, last - keep + 1), last + 1)
        live = {p for v in kept for p in (self._read(f"{self.root}/current-{v}.json") or {"tables": {}})["tables"].values()}
        gone = []
        for v in range(1, last + 1):
            folder = self._path(f"{self.root}/v{v}")
            if not self._fs.exists(folder):
                continue
            for s in self._fs.listStatus(folder):
                path = f"{self.root}/v{v}/{s.getPath().getName()}"
                if path not in live:
                    self._fs.delete(s.getPath(), True)
                    gone.append(path)
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/current-{v}.json"), False)
        return gone
