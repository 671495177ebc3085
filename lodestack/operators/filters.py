"""Predicates that decide which files a request may show."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.batch import negative_id
from lodestack.functions.text import excluded, unquoted

# What counts as a document, and folders that hold dependencies or belong to the system.
DOCUMENT_EXTENSIONS = (
    "md", "markdown", "mdown", "txt", "text", "rtf", "rtfd", "pdf", "doc", "docx", "odt", "pages", "ppt", "pptx", "odp", "key", "keynote", "xls", "xlsx", "xlsm", "ods", "numbers",
    "csv", "tsv", "epub",
)
DEPENDENCY_FOLDERS = (".venv", "venv", "node_modules", ".node_modules", ".node")
SYSTEM_PREFIXES = ("/.nofollow/", "/.resolve/", "/System/", "/Library/", "/Applications/")
MODES = ("names", "hybrid", "exact", "semantic")
CATEGORIES = ("all", "documents", "other")


@dataclass(frozen=True)
class SearchRequest:
    """What a caller asks for. now is a parameter wherever time matters, so results are repeatable."""

    query: str
    mode: str = "hybrid"
    category: str = "all"
    limit: int = 60
    source_id: str | None = None
    extension: str | None = None
    modified_after: float | None = None
    file_ids: tuple[int, ...] | None = None
    names_only: bool = False
    passages: bool = True
    vector: tuple[float, ...] | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.mode not in MODES or self.category not in CATEGORIES:
            raise ValueError(f"unknown mode or category: {self.mode}, {self.category}")

    @property
    def clamped(self) -> int:
        return max(1, min(100, self.limit))


def requested(query: str) -> set[str]:
    """The dependency folders that a query names as words of their own, and .node if one of its words ends so."""
    parts = set(re.findall(r"""[^\s/\\"']+""", query.lower()))
    return parts.intersection(DEPENDENCY_FOLDERS) | {mark for mark in (".node",) for p in parts if p.endswith(mark)}


def is_path_query(query: str) -> bool:
    return "/" in query or bool(requested(query).intersection(DEPENDENCY_FOLDERS))


def is_document(ext: Column) -> Column:
    return F.lower(ext).isin(*DOCUMENT_EXTENSIONS)


def in_dependency(path: Column, ext: Column) -> Column:
    """A path with a dependency folder among its components, or a native add-on file."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, DEPENDENCY_FOLDERS))) | (F.lower(ext) == "node")


def visible(request: SearchRequest) -> Column:
    """The conjunction of all predicates of a request, over files joined with sources."""
    query = request.query.strip().lower()
    exact = F.lower("name") == unquoted(query)
    path = F.concat_ws("/", "source_path", "relative_path")
    keep = F.col("status") != "denied"
    if request.category != "all":
        keep = keep & (is_document(F.col("ext")) if request.category == "documents" else ~is_document(F.col("ext")))
    for folder in DEPENDENCY_FOLDERS:
        if folder not in requested(query):
            keep = keep & (~F.contains(F.concat(F.lit("/"), F.lower(path), F.lit("/")), F.lit(f"/{folder}/")) | exact)
    if ".node" not in requested(query):
        keep = keep & ((F.lower("ext") != "node") | exact)
    for prefix in SYSTEM_PREFIXES:
        if prefix.lower() not in query:
            keep = keep & (~F.startswith(F.replace(path, F.lit("//"), F.lit("/")), F.lit(prefix)) | exact)
    if request.file_ids is not None:
        keep = keep & (F.col("file_id").isin(*request.file_ids) if request.file_ids else F.lit(False))
    if request.source_id is not None:
        keep = keep & (F.col("source_id") == request.source_id)
    if request.extension:
        keep = keep & (F.col("ext") == request.extension.lower())
    if request.modified_after is not None:
        keep = keep & (F.col("mtime") >= request.modified_after)
    return keep


def content_allowed() -> Column:
    """Content of an offline source is shown only where its owner allows that."""
    return (F.col("availability") != "offline") | F.col("offline_content")


def stale() -> Column:
    """A file that changed since it was indexed."""
    return F.coalesce(F.abs(F.col("indexed_mtime") - F.col("mtime")) > 1e-6, F.lit(False))


def in_scope(path: Column, scope: str) -> Column:
    return F.lit(True) if scope == "" else (path == scope) | path.startswith(scope + "/")


def under(path: Column, root: str) -> Column:
    """A path that is a source's folder or lies below it."""
    return in_scope(path, root.rstrip("/"))


def readable(found: DataFrame, access: DataFrame) -> DataFrame:
    """Rows whose file may be read now: access has (file_id, state) with state denied, redirected or missing.

    Denied and redirected files vanish; missing ones stay, marked offline and stale, without content.
    """
    joined = found.join(access.select("file_id", "state"), "file_id", "left")
    gone = F.coalesce(F.col("state") == "missing", F.lit(False))
    kept = joined.filter(F.col("state").isNull() | ~F.col("state").isin("denied", "redirected"))
    return kept.withColumn("availability", F.when(gone, "offline").otherwise(F.col("availability"))).withColumn("stale", gone | stale()).drop("state")


def not_revoked(found: DataFrame, revoked: DataFrame) -> DataFrame:
    """Rows of files that were never revoked, or indexed again since: revoked has (file_id, revoked_at)."""
    joined = found.join(revoked.select("file_id", "revoked_at"), "file_id", "left")
    return joined.filter(F.col("revoked_at").isNull() | F.coalesce(F.col("indexed_at") > F.col("revoked_at"), F.lit(False))).drop("revoked_at")


def status_label() -> Column:
    s = F.col("status")
    return F.when(s == "indexed", F.col("match_kind")).when(s == "queued", "Waiting to be indexed").when(s == "partial", "Partly indexed").when(s == "needsOCR", "Needs text recognition").when(s == "locked", "Locked").when(s == "denied", "No access").when(s == "unsupported", "Name only").otherwise("Could not be read")


def metadata_hits(paths: DataFrame, sources: DataFrame, request: SearchRequest, exclusions: list[str] | None = None) -> DataFrame:
    """Hits of a name index outside the catalog, judged by the request: paths has (path, mtime).

    The source with the longest path that contains a hit owns it. Sources are few; the join on their paths is
    by the path's own ancestors, not by comparing every pair.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("path", "mtime", F.explode(ancestors).alias("source_path"))
    usable = sources.filter(~F.col("availability").isin("offline", "paused"))
    if request.source_id is not None:
        usable = usable.filter(F.col("source_id") == request.source_id)
    owned = up.join(usable, "source_path").groupBy("path", "mtime").agg(F.max_by(F.struct("source_id", "source_name", "source_path"), F.length("source_path")).alias("s")).select("path", "mtime", "s.*")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))
    rows = owned.withColumn("name", name).withColumn("ext", ext).withColumn("relative_path", F.expr("substring(path, length(source_path) + 2)"))
    query = request.query.lower()
    exact = F.lower("name") == query.strip('" ')
    tokens = [t for t in re.split(r'[\s/"]+', query) if t]
    keep = ~excluded(F.col("relative_path"), exclusions or [])
    if request.category != "all":
        keep = keep & (is_document(F.col("ext")) if request.category == "documents" else ~is_document(F.col("ext")))
    if request.extension:
        keep = keep & (F.col("ext") == request.extension)
    if request.modified_after is not None:
        keep = keep & (F.col("mtime") >= request.modified_after)
    for folder in DEPENDENCY_FOLDERS:
        if folder not in tokens:
            keep = keep & (~F.array_contains(F.split(F.lower("path"), "/"), folder) | exact)
    if ".node" not in query:
        keep = keep & ((F.col("ext") != "node") | exact)
    keep = keep & ~F.exists(F.split("relative_path", "/"), lambda x: x.endswith(".app") | x.endswith(".framework"))
    return rows.filter(keep).select(negative_id("path").alias("file_id"), "path", "name", "ext", "mtime", "source_id", "source_name")
