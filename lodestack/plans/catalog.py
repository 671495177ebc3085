"""A catalog of sources, files, contents and passages derived from the documents table.

The derivation is a fixed rule, so that SQL engines can repeat it: it stands in for a scan of real folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt", "swift", "html", "node", "pdf", "csv", "py")
NAMES = ("report", "notes", "Budget", "plan", "readme", "data", "Meeting", "Über-archiv")
EXTRACTOR = "1"
PASSAGE = 1000
#: Room for this many passages of a content in its passage ids.
PER_CONTENT = 1_000_000
EPOCH = 1_700_000_000


@dataclass(frozen=True)
class Catalog:
    sources: DataFrame
    files: DataFrame
    passages: DataFrame
    vectors: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _pick(options: tuple[str, ...], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, options)), (i % len(options) + 1).cast("int"))


def sources(documents: DataFrame) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    return documents.select("source").distinct().select(
        F.col("source").alias("source_id"),
        F.when(n % 2 == 0, F.concat(F.lit("Src"), n)).otherwise(F.col("source")).alias("source_name"),
        F.concat(F.when(n == 7, "/Library/").otherwise("/vol/"), "source").alias("source_path"),
        F.when(n % 3 == 0, "local").when(n % 3 == 1, "external").otherwise("network").alias("kind"),
        F.when(n % 5 == 0, "offline").otherwise("online").alias("availability"),
        (n % 10 == 0).alias("offline_content"),
    )


def files(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    ext = _pick(EXTENSIONS, i)
    name = F.concat(_pick(NAMES, F.floor(i / 8)), F.lit("-"), (i % 50).cast("string"), F.lit("."), ext)
    folder = F.when(i % 9 == 0, "project/node_modules/").when(i % 9 == 1, "Documents/").when(i % 9 == 2, "app/.venv/lib/").when(i % 9 == 3, "Desktop/old/").otherwise("files/")
    mtime = (F.lit(EPOCH) + i * 3600).cast("double")
    state = i % 20
    status = F.when(state == 0, "denied").when(state == 1, "partial").when(state == 2, "needsOCR").when(state == 3, "failed").when(state == 4, "queued").when(state == 5, "unsupported").when(state == 6, "locked").otherwise("indexed")
    return documents.select(
        i.alias("file_id"), F.col("source").alias("source_id"), name.alias("name"), ext.alias("ext"), F.concat(folder, name).alias("relative_path"), F.col("n_chars").alias("size"),
        mtime.alias("mtime"), F.when(i % 17 != 0, F.when(i % 13 == 0, mtime - 5).otherwise(mtime)).alias("indexed_mtime"), status.alias("status"),
        F.concat_ws(":", F.sha2("text", 256), F.lit(EXTRACTOR), ext).alias("content_id"), F.sha2("text", 256).alias("fingerprint"),
    )


def passages(documents: DataFrame) -> DataFrame:
    """Lines of each distinct content, cut into pieces of at most PASSAGE characters; blank pieces go.

    Contents are deduplicated before any line is cut.
    """
    keyed = documents.select("doc_id", "text", F.concat_ws(":", F.sha2("text", 256), F.lit(EXTRACTOR), _pick(EXTENSIONS, F.col("doc_id"))).alias("content_id"))
    firsts = keyed.groupBy("content_id").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("first"))
    pieces = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.transform(F.sequence(F.lit(1), F.greatest(F.length(line), F.lit(1)), F.lit(PASSAGE)), lambda at: F.substring(line, at, PASSAGE))))
    cut = firsts.select("content_id", "first", F.posexplode(pieces).alias("ordinal", "text")).filter(F.trim("text") != "")
    return cut.select((F.col("first") * PER_CONTENT + F.col("ordinal")).alias("passage_id"), "content_id", "ordinal", "text")


def vectors(embeddings: DataFrame, file_table: DataFrame) -> DataFrame:
    """Vector vec_id belongs to the content of file vec_id."""
    owner = file_table.select(F.col("file_id").alias("vec_id"), "content_id")
    return embeddings.select("vec_id", "embedding").join(owner, "vec_id").select(F.col("vec_id").alias("passage_id"), "content_id", "embedding")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    documents = read(spark, sf_dir, "documents")
    f = files(documents)
    return Catalog(sources(documents), f, passages(documents), vectors(read(spark, sf_dir, "embeddings"), f))


def _sql_list(options: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


#: The same rule for SQL engines: common table expressions sources_, files_, passages_, vectors_.
CATALOG_SQL = f"""
sources_ AS (
  SELECT source AS source_id, CASE WHEN n % 2 = 0 THEN 'Src' || n ELSE source END AS source_name,
         CASE WHEN n = 7 THEN '/Library/' ELSE '/vol/' END || source AS source_path,
         CASE n % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'external' ELSE 'network' END AS kind,
         CASE WHEN n % 5 = 0 THEN 'offline' ELSE 'online' END AS availability, n % 10 = 0 AS offline_content
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)
), named_ AS (
  SELECT *, {_sql_list(EXTENSIONS)}[doc_id % 8 + 1] AS ext,
         {_sql_list(NAMES)}[(doc_id // 8) % 8 + 1] || '-' || (doc_id % 50) || '.' || {_sql_list(EXTENSIONS)}[doc_id % 8 + 1] AS name,
         CAST({EPOCH} + doc_id * 3600 AS DOUBLE) AS mtime FROM documents
), files_ AS (
  SELECT doc_id AS file_id, source AS source_id, name, ext,
         CASE doc_id % 9 WHEN 0 THEN 'project/node_modules/' WHEN 1 THEN 'Documents/' WHEN 2 THEN 'app/.venv/lib/' WHEN 3 THEN 'Desktop/old/' ELSE 'files/' END || name AS relative_path,
         n_chars AS size, mtime, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN mtime - 5 ELSE mtime END AS indexed_mtime,
         CASE doc_id % 20 WHEN 0 THEN 'denied' WHEN 1 THEN 'partial' WHEN 2 THEN 'needsOCR' WHEN 3 THEN 'failed' WHEN 4 THEN 'queued' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'locked' ELSE 'indexed' END AS status,
         sha256(text) || ':{EXTRACTOR}:' || ext AS content_id, sha256(text) AS fingerprint FROM named_
), contents_ AS (
  SELECT sha256(text) || ':{EXTRACTOR}:' || ext AS content_id, min(doc_id) AS first, min_by(text, doc_id) AS text FROM named_ GROUP BY 1
), lines_ AS (
  SELECT content_id, first, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM contents_
), pieces_ AS (
  SELECT content_id, first, line_no, cut_at, substr(line, cut_at, {PASSAGE}) AS text FROM (SELECT *, unnest(generate_series(1, greatest(length(line), 1), {PASSAGE})) AS cut_at FROM lines_)
), passages_ AS (
  SELECT first * {PER_CONTENT} + ordinal AS passage_id, content_id, ordinal, text
  FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY line_no, cut_at) - 1 AS ordinal FROM pieces_) WHERE trim(text) <> ''
), vectors_ AS (
  SELECT vec_id AS passage_id, content_id, embedding FROM embeddings JOIN files_ ON vec_id = file_id
)"""
