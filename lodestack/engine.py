"""The request interface: one lazy plan per request over a catalog."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.text import parse_query, unquoted
from lodestack.operators import fulltext, fusion, health, name_index, names, topk, vectors
from lodestack.operators.filters import SearchRequest, content_allowed, is_document, is_path_query, not_revoked, readable, stale, visible
from lodestack.plans.catalog import Catalog
from lodestack.runtime import split

PREVIEW, BEFORE, RELATED = 300, 30, 6
FULL_SECONDS, NAMES_SECONDS, RELATED_SECONDS = 15, 2, 5
#: What the files of published indexes are sorted by. Names share few words, so a word's files are told apart by id.
_SORTS = {"name_index": ["term", "file_id"], "passage_index": ["term"], "gram_index": name_index.SORT, "passage_blocks": topk.SORT}
#: Indexes that are large beside their rows: each task's part is sorted by itself.
_SEGMENTS = ("passage_index", "passage_blocks")


class TimedOut(Exception):
    """A request used up its time budget; its jobs were cancelled."""


@dataclass
class Engine:
    """Searches over a catalog. Indexes are plans too: pass written ones to read instead of to build, see indexed().

    access has (file_id, state) of files that a check found denied, redirected or missing just now, revoked has
    (file_id, revoked_at): both hold for every search, preview and related list.
    """

    catalog: Catalog
    name_index: DataFrame | None = None
    passage_index: DataFrame | None = None
    name_stats: DataFrame | None = None
    passage_stats: DataFrame | None = None
    access: DataFrame | None = None
    revoked: DataFrame | None = None
    #: Optional indexes: trigrams of names (operators.name_index) and bounded postings of passages (operators.topk).
    gram_index: DataFrame | None = None
    passage_blocks: DataFrame | None = None
    #: Sees each part of a request's plan under its name and returns it, observed; see profile().
    watch: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows

    def __post_init__(self):
        c = self.catalog
        if self.name_stats is None:
            self.name_stats = fulltext.index_stats(c.files, ["name", "relative_path"])
        if self.passage_stats is None:
            self.passage_stats = fulltext.index_stats(c.passages, ["text"])
        if self.name_index is None:
            self.name_index = fulltext.postings(c.files, "file_id", ["name", "relative_path"])
        if self.passage_index is None:
            self.passage_index = fulltext.postings(c.passages, "passage_id", ["text"])

    @classmethod
    def indexed(cls, catalog: Catalog, snapshots) -> Engine:
        """An engine whose tables and indexes are written once, sorted by term, and then read."""
        c = catalog
        own = cls(c)
        tables = {"sources": c.sources, "files": c.files, "passages": c.passages, "vectors": c.vectors, "name_index": own.name_index, "passage_index": own.passage_index, "name_stats": own.name_stats, "passage_stats": own.passage_stats}
        version = snapshots.publish(tables, sort={n: _SORTS[n] for n in ("name_index", "passage_index")}, segments=_SEGMENTS)
        return cls.opened(snapshots, version)

    @classmethod
    def ranked(cls, catalog: Catalog, snapshots) -> Engine:
        """indexed(), with the optional indexes too: literal names by trigrams, and text results without scoring every
        posting. The latter runs two small jobs when a request's plan is made."""
        cls.indexed(catalog, snapshots)
        made = {"gram_index": name_index.postings(catalog.files), "passage_blocks": topk.index(catalog.passages, "passage_id", "text")}
        version = snapshots.publish(made, sort={n: _SORTS[n] for n in made}, segments=_SEGMENTS)
        return replace(cls.opened(snapshots, version), **{n: snapshots.table(n, version) for n in made})

    @classmethod
    def published(cls, catalog: Catalog, snapshots, names: list[str]) -> Engine:
        """An engine that reads the named tables and indexes as published; those that are missing are written first, no others.

        The rest are plans over the catalog. Tables come before what is made from them, so that indexes are built from
        published rows: those of passages lie in row groups of bounded size, and a task makes the postings of one where it
        lies, so that no passage is shuffled for its index.
        """
        for wave in (("sources", "files", "passages"), ("vectors", *(f.name for f in fields(cls)))):
            held = cls._held(catalog, snapshots)
            own = cls(**held)
            make = {
                "sources": lambda: own.catalog.sources, "files": lambda: own.catalog.files, "passages": lambda: own.catalog.passages, "vectors": lambda: own.catalog.vectors,
                "gram_index": lambda: name_index.postings(own.catalog.files), "passage_blocks": lambda: topk.index(own.catalog.passages, "passage_id", "text"),
                "passage_index": lambda: postings(own.catalog.passages, "passage_id", ["text"]),
            }
            done = snapshots.names()
            # Passages that aren't published are a plan whose tasks have any size.
            postings = fulltext.postings if "passages" in done else fulltext.dealt
            missing = {n: make[n]() if n in make else getattr(own, n) for n in names if n in wave and n not in done}
            if missing:
                size = fulltext.TASK_BYTES
                with split(snapshots.spark, size) if "passage_index" in missing else nullcontext():
                    snapshots.publish(missing, sort={n: s for n, s in _SORTS.items() if n in missing}, segments=_SEGMENTS, pieces={"passages": size})
        return cls(**cls._held(catalog, snapshots))

    @classmethod
    def _held(cls, catalog: Catalog, snapshots) -> dict:
        """The parts of an engine of the newest version, the catalog's own plans where a table isn't published."""
        t = {n: snapshots.table(n) for n in snapshots.names()}
        return {"catalog": replace(catalog, **{n: t.pop(n) for n in ("sources", "files", "passages", "vectors") if n in t}), **t}

    @classmethod
    def opened(cls, snapshots, version: int | None = None) -> Engine:
        version = version or snapshots.current()
        t = {n: snapshots.table(n, version) for n in ("sources", "files", "passages", "vectors", "name_index", "passage_index", "name_stats", "passage_stats")}
        return cls(Catalog(*[t.pop(n) for n in ("sources", "files", "passages", "vectors")]), **t)

    def _current(self) -> DataFrame:
        """Files with their sources as they may be shown now, with stale."""
        found = self.catalog.files.join(self.catalog.sources, "source_id")
        if self.revoked is not None:
            found = not_revoked(found if "indexed_at" in found.columns else found.withColumn("indexed_at", F.col("indexed_mtime")), self.revoked)
        return found.withColumn("stale", stale()) if self.access is None else readable(found, self.access)

    def _visible(self, request: SearchRequest) -> DataFrame:
        return self._current().filter(visible(request))

    def search(self, request: SearchRequest) -> DataFrame:
        """Results of a request in order: file_id, name, path, source_name, ext, mtime, score, name_matched, match_kind,
        stale, passage_ids (up to three, best first), passage (text of the first), ordinal (its place).

        Category all fills up: documents first, then other files; every channel's limit holds per category. Without a
        query, and for files found by name alone, the passage is the file's first. A request without passages, or for
        names only, is one lazy plan and has no passage and ordinal.
        """
        if request.category == "all":
            parts = [self._search(replace(request, category=c)) for c in ("documents", "other")]
        else:
            parts = [self._search(request)]
        order = fusion.final_order() if request.query.strip() else [F.desc("mtime"), F.col("file_id")]
        rows = fusion.fill(parts, request.clamped, order)
        if request.names_only or not request.passages:
            return rows.drop("content_id", "shows", "part")
        # The ranked rows, 100 at most, are fetched first: named twice in one plan, they would be searched for twice.
        held = self.catalog.files.sparkSession.createDataFrame(rows.collect(), rows.schema)
        return self._with_passage(held, order)

    def _with_passage(self, rows: DataFrame, order: list) -> DataFrame:
        """rows with the passage to show: the first of passage_ids, else the file's first where its content may be shown."""
        shown = rows.select("file_id", "content_id", "shows", F.get("passage_ids", F.lit(0)).alias("asked") if "passage_ids" in rows.columns else F.lit(None).cast("long").alias("asked"))
        met = self.catalog.passages.join(F.broadcast(shown), "content_id").filter(F.col("shows"))  # at most 100 rows
        best = met.groupBy("file_id").agg(F.min(F.struct((~F.coalesce(F.col("passage_id") == F.col("asked"), F.lit(False))).alias("other"), "ordinal", "passage_id", "text")).alias("p"))
        passages = best.select("file_id", F.col("p.passage_id").alias("first"), F.col("p.text").alias("passage"), F.col("p.ordinal").alias("ordinal"))
        ids = F.when((F.size("passage_ids") > 0) | F.col("first").isNull(), F.col("passage_ids")).otherwise(F.array("first"))
        return rows.join(passages, "file_id", "left").withColumn("passage_ids", ids).drop("content_id", "shows", "first").orderBy("part", *order).drop("part")

    def hits(self, request: SearchRequest) -> DataFrame:
        """(file_id, kind, score, position, passage_id): every channel's list for one category."""
        found = self._visible(request)
        lists = []
        if request.mode != "semantic":
            exact = request.mode == "exact"
            phrases = parse_query(request.query, exact)
            if phrases:
                prefixed = parse_query(request.query, exact, prefix=not exact)
                lists.append(self.watch("names", self._name_hits(found, request, prefixed)))
                lists.append(self.watch("literal names", self._literal_hits(self.watch("visible", found), request)))
                if not request.names_only:
                    lists.append(self.watch("text", self._text_hits(found, phrases)))
        if not request.names_only and request.mode in ("hybrid", "semantic") and request.vector is not None:
            lists.append(self.watch("meaning", self._meaning_hits(found, request.vector)))
        spark = self.catalog.files.sparkSession
        out = spark.createDataFrame([], "file_id long, kind string, score double, position long, passage_id long")
        for x in lists:
            out = out.unionByName(x)
        return out

    def _search(self, request: SearchRequest) -> DataFrame:
        found = self._visible(request)
        if not request.query.strip():
            rows = found.orderBy(F.desc("mtime"), "file_id").limit(request.clamped)
            fused = rows.select("file_id", F.lit(0.0).alias("score"), F.lit(False).alias("name_matched"), F.lit("").alias("match_kind"), F.array().cast("array<long>").alias("passage_ids"))
        else:
            fused = fusion.fuse(self.hits(request))
        path = F.concat_ws("/", "source_path", "relative_path")
        return fused.join(found, "file_id").select(
            "file_id", "name", path.alias("path"), "source_name", "ext", "mtime", "score", "name_matched", "match_kind", "stale", "passage_ids", "content_id", content_allowed().alias("shows"),
        )

    def _name_hits(self, found: DataFrame, request: SearchRequest, phrases) -> DataFrame:
        fields = None if is_path_query(request.query) else ["name"]
        scored = fulltext.bm25(self.name_index, self.name_stats, "file_id", phrases, fields)
        order = [F.round("relevance", 9), F.col("file_id")]
        top = names.ranked(scored.join(found.select("file_id"), "file_id").orderBy(*order).limit(fusion.NAME_LIMIT), order)
        return top.select("file_id", F.lit(fusion.KINDS[0]).alias("kind"), fusion.contribution(F.col("position"), fusion.NAME).alias("score"), "position", F.lit(None).cast("long").alias("passage_id"))

    def _literal_hits(self, found: DataFrame, request: SearchRequest) -> DataFrame:
        literal = unquoted(request.query.strip()[:512])
        if self.gram_index is not None and not is_path_query(request.query) and len(literal.lower()) >= name_index.GRAM:
            found = name_index.matching(found, self.gram_index, literal)
        top = names.literal_names(found, request)
        return top.select("file_id", F.lit(fusion.KINDS[0]).alias("kind"), fusion.contribution(F.col("position"), fusion.LITERAL, fusion.LITERAL_BASE).alias("score"), "position", F.lit(None).cast("long").alias("passage_id"))

    def _text_hits(self, found: DataFrame, phrases) -> DataFrame:
        allowed = found.filter(content_allowed())
        eligible = self.catalog.passages.join(allowed.select("content_id"), "content_id", "left_semi")
        order = [F.col("relevance"), F.col("file_id")]

        def first(scored: DataFrame) -> DataFrame:
            best = fulltext.representatives(scored.withColumn("relevance", F.round("relevance", 9)), eligible)
            return best.join(allowed.select("file_id", "content_id"), "content_id").orderBy(*order).limit(fusion.TEXT_LIMIT)

        plain = None if self.passage_blocks is None else topk.plain_words(phrases)
        if plain:
            rows = topk.best(self.passage_blocks, self.passage_stats, plain, "passage_id", fusion.TEXT_LIMIT, first)
        else:
            rows = first(fulltext.bm25(self.passage_index, self.passage_stats, "passage_id", phrases))
        top = names.ranked(rows, order)
        return top.select("file_id", F.lit(fusion.KINDS[1]).alias("kind"), fusion.contribution(F.col("position"), fusion.TEXT).alias("score"), "position", "passage_id")

    def _meaning(self, found: DataFrame, vector) -> DataFrame:
        allowed = found.filter(content_allowed())
        eligible = self.catalog.vectors.join(allowed.select("content_id"), "content_id", "left_semi")
        best = vectors.scan(eligible, vector).withColumn("score", F.round("score", 9))
        fan = best.join(allowed.select("file_id", "content_id"), "content_id")
        w = Window.partitionBy("content_id").orderBy("file_id")
        return fan.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= vectors.FAN_OUT).drop("n")

    def _meaning_hits(self, found: DataFrame, vector) -> DataFrame:
        order = [F.desc("score"), F.col("passage_id"), F.col("file_id")]
        top = names.ranked(self._meaning(found, vector), order)
        return top.select("file_id", F.lit(fusion.KINDS[2]).alias("kind"), fusion.contribution(F.col("position"), fusion.MEANING).alias("score"), "position", "passage_id")

    def preview(self, file_id: int, matching_passage: int | None = None) -> DataFrame:
        """Passages of a file from a little before the match on, in order."""
        c = self.catalog
        file = self._current().filter((F.col("file_id") == file_id) & (F.col("status") != "denied")).filter(content_allowed()).select("content_id")
        own = c.passages.join(file, "content_id", "left_semi")
        if matching_passage is not None:
            start = own.filter(F.col("passage_id") == matching_passage).agg(F.greatest(F.coalesce(F.max("ordinal"), F.lit(0)) - BEFORE, F.lit(0)).alias("start"))
            own = own.crossJoin(F.broadcast(start)).filter("ordinal >= start").drop("start")  # one row
        return own.orderBy("ordinal").limit(PREVIEW)

    def related(self, file_id: int) -> DataFrame:
        """Files whose meaning is nearest to the file's first vector, itself left out."""
        c = self.catalog
        own = self._current().filter((F.col("file_id") == file_id) & (F.col("status") != "denied")).filter(content_allowed()).select("content_id")
        first = c.vectors.join(own, "content_id", "left_semi").orderBy("passage_id").limit(1).collect()  # one vector
        found = self._visible(SearchRequest(""))
        if not first:
            return found.select("file_id", F.lit(0.0).alias("score")).limit(0)
        near = self._meaning(found, first[0]["embedding"]).filter(F.col("file_id") != file_id)
        return near.groupBy("file_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_id").limit(RELATED)

    def sources(self) -> DataFrame:
        return health.source_health(self.catalog.sources, self.catalog.files)

    def statistics(self) -> DataFrame:
        return health.statistics(self.catalog.files, self.catalog.passages, self.catalog.vectors)


def within(spark: SparkSession, query: DataFrame | Callable[[], DataFrame], seconds: float):
    """A query's rows, or TimedOut once the budget is over; the query's own jobs are then cancelled and no others."""
    import threading
    import uuid

    tag = f"budget-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        rows = (query() if callable(query) else query).collect()
        if late.is_set():
            raise TimedOut(f"more than {seconds} s")
        return rows
    except TimedOut:
        raise
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def profile(engine: Engine, request: SearchRequest) -> str:
    """One JSON line: rows of each part of a request's plan and milliseconds of the whole, from one run of it."""
    table, took = stage_rows(engine, request)
    return json.dumps({"query": request.query, "mode": request.mode, "total_ms": round(took * 1000, 3), "rows": table.pop("results"), "stages": table})


def stage_rows(engine: Engine, request: SearchRequest) -> tuple[dict[str, int], float]:
    """Rows per part of a request's plan, and seconds: counters in the plan itself count them while it runs once.

    Of category all, the parts of both categories are counted under their names. Visible files are counted where names are
    searched for; a part that the request doesn't have isn't listed.
    """
    seen: list[tuple[str, Observation]] = []

    def watch(name: str, rows: DataFrame) -> DataFrame:
        seen.append((name, Observation(f"{name} {len(seen)}")))
        return rows.observe(seen[-1][1], F.count(F.lit(1)).alias("rows"))

    plan = replace(engine, watch=watch).search(replace(request, passages=False))
    began = time.perf_counter()
    results = len(plan.collect())  # a hundred rows at most
    took = time.perf_counter() - began
    out: dict[str, int] = {}
    for name, o in seen:
        out[name] = out.get(name, 0) + o.get["rows"]
    return out | {"results": results}, took


def citation(text, name, location, path):
    """A passage with its place, as plain text."""
    return F.concat(text, F.lit("\n\n"), name, F.lit(", "), location, F.lit("\n"), path)


def _merged(spark: SparkSession, channels: list[list], request: SearchRequest) -> list[dict]:
    """The channels' rows (a few hundred) merged by fusion.merge_channels; content is the first channel."""
    own, hits = {}, []
    for channel, rows in enumerate(channels):
        for r in (x.asDict() for x in rows):
            own.setdefault((r["path"], r["file_id"]), r)
            hits.append((r["path"], r["file_id"], r["ext"], bool(r.get("name_matched")), float(r.get("score") or 0), len(r.get("passage_ids") or ()), channel))
    if not hits:
        return []
    table = spark.createDataFrame(hits, "path string, file_id long, ext string, name_matched boolean, score double, passages int, channel int")
    best = fusion.merge_channels(table.withColumn("is_document", is_document(F.col("ext"))).drop("ext"), request.clamped).collect()
    return [own[r["path"], r["file_id"]] | {"name_matched": r["name_matched"], "score": r["score"]} for r in best]


def search_channels(engine: Engine, request: SearchRequest, metadata: DataFrame | None = None, on_update=None) -> list:
    """Names, metadata and content side by side; on_update sees the merged list after each of them.

    Rows carry the ids of their passages, not the texts. Errors of the fast channels are ignored. A time-out of the content channel is raised after all channels have
    ended; other errors of content are raised at once.
    """
    from concurrent.futures import ThreadPoolExecutor, as_completed

    spark = engine.catalog.files.sparkSession
    calls = {"content": (engine.search(replace(request, passages=False)), FULL_SECONDS)}
    if request.mode != "semantic":
        calls = {"names": (engine.search(replace(request, names_only=True)), NAMES_SECONDS)} | ({"metadata": (metadata, NAMES_SECONDS)} if metadata is not None else {}) | calls
    arrived: dict[str, list] = {}
    ranked: list = []
    late = False

    with ThreadPoolExecutor(len(calls)) as pool:
        waiting = {pool.submit(within, spark, query, seconds): name for name, (query, seconds) in calls.items()}
        for done in as_completed(waiting):
            try:
                rows = done.result()
            except TimedOut:
                late = late or waiting[done] == "content"
                continue
            except Exception:
                if waiting[done] == "content":
                    raise
                continue
            arrived[waiting[done]] = rows
            ranked = _merged(spark, [arrived.get(name, []) for name in ("content", "names", "metadata")], request)
            if on_update:
                on_update(ranked)
    if late:
        raise TimedOut("content")
    return ranked
