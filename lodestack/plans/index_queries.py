"""Registered queries over indexes, profiles, applications and file readers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.engine import Engine, stage_rows
from lodestack.operators import encoder, incremental, name_index, names, relevance, topk, vectors, word_tiles
from lodestack.operators.filters import SearchRequest
from lodestack.plans import catalog as cat
from lodestack.plans import oracles
from lodestack.plans import registry as reg
from lodestack.plans.catalog import CATALOG_SQL, catalog, read
from lodestack.plans.registry import QUERIES, SQL, query, visible_sql
from lodestack.sources.extract import PASSAGE_CHARS

# --- literal names by trigrams -----------------------------------------------------------------------------------

_LITERAL = SearchRequest("über-archiv-1", category="documents")


@query(SQL["name_literal"].replace(CATALOG_SQL, "{cat}"))
def name_literal_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Literal names by the published trigram index, which is read for the query's trigrams alone."""
    engine = reg._indexed(spark, sf, ["sources", "files", "gram_index"])
    found = name_index.matching(engine._visible(_LITERAL), engine.gram_index, _LITERAL.query)
    return names.literal_names(found, _LITERAL).select("file_id", "name", "position")


@query("""WITH {cat}, n AS (SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 'Renamed-' || file_id ELSE name END AS name FROM files_ WHERE file_id % 10 <> 1 UNION ALL SELECT file_id + 1000000, 'New Ünit ' || file_id FROM files_ WHERE file_id % 50 = 7),
g AS (SELECT file_id, unnest(range(1, length(name) - 1)) AS i, lower(name) AS low FROM n) SELECT substr(low, i, 3) AS gram, count(DISTINCT file_id) AS files, sum(DISTINCT file_id) AS ids FROM g GROUP BY 1""")
def name_grams_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The trigram index after every tenth file got another name, every next one went and others came."""
    f = cat.files(read(spark, sf, "documents")).select("file_id", "name")
    i = F.col("file_id")
    fresh = f.filter(i % 10 == 0).select("file_id", F.concat(F.lit("Renamed-"), i).alias("name")).union(f.filter(i % 50 == 7).select((i + 1_000_000).alias("file_id"), F.concat(F.lit("New Ünit "), i)))
    now = name_index.refresh(name_index.postings(f), f.filter(i % 10 == 1), fresh)
    each = now.select("gram", F.explode("ids").alias("id"))
    return each.groupBy("gram").agg(F.count("id").alias("files"), F.sum("id").cast("decimal(38,0)").cast("double").alias("ids"))


# --- first results without all postings --------------------------------------------------------------------------

_TOP = 100


@query(f"WITH {{cat}}, {reg.bm25_sql('passages_', 'passage_id', ['text'], reg._WORDS)} SELECT passage_id, round(relevance, 6) AS relevance FROM scored ORDER BY scored.relevance, passage_id LIMIT {_TOP}")
def top_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The best passages for some words, by bounded postings."""
    engine = reg._indexed(spark, sf, ["passages", "passage_stats", "passage_blocks"])

    def first(scored: DataFrame) -> DataFrame:
        return scored.withColumn("relevance", F.round("relevance", 9)).orderBy("relevance", "passage_id").limit(_TOP)

    rows = topk.best(engine.passage_blocks, engine.passage_stats, topk.plain_words(reg._WORDS), "passage_id", _TOP, first)
    return rows.select("passage_id", F.round("relevance", 6).alias("relevance"))


for _key in ("hybrid_fusion", "names_mode"):
    QUERIES[f"{_key}_ranked"], SQL[f"{_key}_ranked"] = reg._search_indexed(_key, ranked=True), SQL[_key]


# --- whole requests -----------------------------------------------------------------------------------------------


def _recent_sql() -> str:
    parts = []
    for n, c in enumerate(("documents", "other")):
        parts.append(f"(SELECT f.*, s.availability, s.offline_content, {n} AS part FROM {reg._JOINED} WHERE {visible_sql(SearchRequest('', category=c))} ORDER BY mtime DESC, file_id LIMIT 100)")
    return f"""WITH {{cat}}, r AS (SELECT * FROM ({' UNION ALL '.join(parts)}) ORDER BY part, mtime DESC, file_id LIMIT 100), p AS (SELECT content_id, min_by(passage_id, ordinal) AS passage_id, min_by(text, ordinal) AS text, min(ordinal) AS ordinal FROM passages_ GROUP BY content_id)
SELECT file_id, name, CASE WHEN shown THEN [p.passage_id] ELSE [] END AS passage_ids, CASE WHEN shown THEN p.text END AS passage, CAST(CASE WHEN shown THEN p.ordinal ELSE -1 END AS BIGINT) AS ordinal
FROM (SELECT r.*, (availability <> 'offline' OR offline_content) AND p.content_id IS NOT NULL AS shown FROM r LEFT JOIN p USING (content_id)) r LEFT JOIN p USING (content_id)"""


@query(_recent_sql())
def recent_shown(spark: SparkSession, sf: str) -> DataFrame:
    """A request without a query: the newest files with their first passages, documents first."""
    found = Engine(catalog(spark, sf)).search(SearchRequest("  ", limit=100))
    return found.select("file_id", "name", "passage_ids", "passage", F.coalesce(F.col("ordinal").cast("long"), F.lit(-1).cast("long")).alias("ordinal"))


_PROFILED = SearchRequest("report thing", category="documents", limit=100, passages=False)


def _profile_sql() -> str:
    body = reg._channels_sql(_PROFILED, "d", False)
    hits = body[body.index("hits_d AS (") + 11 : body.index("), one_d AS")].split(" UNION ALL ")
    names_, literal, text = (f"(SELECT count(*) FROM ({h}))" for h in hits)
    return f"""WITH {CATALOG_SQL}, {body} SELECT 'visible' AS stage, (SELECT count(*) FROM vis_d) AS rows UNION ALL SELECT 'names', {names_} UNION ALL SELECT 'literal names', {literal}
UNION ALL SELECT 'text', {text} UNION ALL SELECT 'results', (SELECT least(count(*), 100) FROM fused_d)"""


@query(_profile_sql())
def stage_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each part of a request, counted while it runs once. A row for each part."""
    counted, _ = stage_rows(Engine(catalog(spark, sf)), _PROFILED)
    return spark.createDataFrame(list(counted.items()), "stage string, rows long")


# --- applications -------------------------------------------------------------------------------------------------

_APPS_SQL = """a AS (SELECT p_partkey, '/Applications/' || p_partkey || '.app' AS path, p_name AS name, split_part(p_name, ' ', 2) || p_partkey % 3 AS file_name, CASE WHEN p_partkey % 4 > 0 THEN 'b.' || p_partkey % 90 END AS bundle_id, p_partkey % 7 = 0 AS running FROM part)"""


def _apps(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    return read(spark, sf, "part").select(
        k, F.concat(F.lit("/Applications/"), k, F.lit(".app")).alias("path"), name.alias("name"), F.concat(F.split_part(name, F.lit(" "), F.lit(2)), k % 3).alias("file_name"),
        F.when(k % 4 > 0, F.concat(F.lit("b."), k % 90)).alias("bundle_id"), (k % 7 == 0).alias("running"),
    )


def ladder_sql(q: str, name: str) -> str:
    """The score of a name of lower-case words for a query of one word, or null; the steps are tried in their order."""
    t = f"string_split({name}, ' ')"
    cuts = " OR ".join(f"(starts_with({t}[1], '{q[:i]}') AND starts_with({t}[2], '{q[i:]}'))" for i in range(1, len(q)))
    spread = f"regexp_extract(replace({name}, ' ', ''), '^{'[^%s]*'.join(q) % tuple(q[1:])}')" if len(q) >= 3 else "''"
    gaps = f"length({spread}) - {len(q)}"
    return f"""CASE WHEN {name} = '{q}' THEN 1000 WHEN replace({name}, ' ', '') = '{q}' THEN 980 WHEN list_contains({t}, '{q}') THEN 920 WHEN starts_with({name}, '{q}') THEN 900 - least(length({name}) - {len(q)}, 30)
  WHEN len(list_filter({t}, lambda x: starts_with(x, '{q}'))) > 0 THEN 820 WHEN len({t}) > 1 AND array_to_string(list_transform({t}, lambda x: x[1]), '') = '{q}' THEN 850 WHEN len({t}) > 1 AND ({cuts}) THEN {800 + min(len(q), 30)}
  WHEN {spread} <> '' AND {gaps} <= 3 AND {len(q)} / ({len(q)} + {gaps}) >= 0.65 THEN 500 - 20 * ({gaps}) END"""


for _key, _asked in (("app_abbreviation", "smgi"), ("app_scattered", "bleolt"), ("app_whole_word", "gizmo")):

    def _app(spark: SparkSession, sf: str, asked: str = _asked) -> DataFrame:
        return names.app_score(_apps(spark, sf), asked).select("p_partkey", "score")

    QUERIES[_key] = _app
    SQL[_key] = f"WITH {_APPS_SQL} SELECT * FROM (SELECT p_partkey, CAST({ladder_sql(_asked, 'lower(name)')} AS INTEGER) AS score FROM a) WHERE score IS NOT NULL"


@query(f"""WITH {_APPS_SQL} SELECT p_partkey, CASE WHEN starts_with(lower(name), 'b r') THEN 900 - least(length(name) - 3, 30) ELSE 860 END AS score FROM a WHERE regexp_matches(' ' || lower(name), ' b[^ ]*.* r[^ ]*')""")
def app_word_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Two words of a query begin two words of a name, in order."""
    return names.app_score(_apps(spark, sf), "b r").filter("score >= 860").select("p_partkey", "score")


@query(f"""WITH {_APPS_SQL}, own AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY coalesce(bundle_id, path) ORDER BY running DESC, path) = 1),
s AS (SELECT path, name, greatest(coalesce({ladder_sql('ri', 'lower(name)')}, -1), coalesce({ladder_sql('ri', 'lower(file_name)')} - 10, -1)) AS score FROM own)
SELECT path, CAST(score AS INTEGER) AS score, row_number() OVER (ORDER BY score DESC, lower(name), path) AS place, 'application:' || path AS identity FROM s WHERE score >= 0""")
def app_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Applications ranked: one copy of each bundle, a running one first, by name or file name. The list of matches is short."""
    ranked = names.ranked(names.app_ranking(_apps(spark, sf), "ri"), [F.desc("score"), names.natural(F.col("name")), F.col("path")])
    return ranked.select("path", "score", (F.col("position") + 1).alias("place"), names.result_identity(F.lit("application"), F.col("path")).alias("identity"))


@query(f"WITH {_APPS_SQL} SELECT path, name FROM a WHERE p_partkey % 3 > 0 UNION SELECT path, upper(name) FROM a WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
def app_extras(spark: SparkSession, sf: str) -> DataFrame:
    """Known applications and the extra ones that aren't among them."""
    a, k = _apps(spark, sf), F.col("p_partkey")
    known, extra = a.filter(k % 3 > 0).select("path", "name"), a.filter(k % 2 == 0).select("path", F.upper("name").alias("name"))
    return names.with_extras(known, extra)


# --- readers, jobs ------------------------------------------------------------------------------------------------


@query(rf"""WITH RECURSIVE c AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey NULLS FIRST, c_name NULLS FIRST) AS i, coalesce(c_name, '') AS name FROM customer),
w AS (SELECT c_nationkey, name, i AS rest, '' AS letters FROM c UNION ALL SELECT c_nationkey, name, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INTEGER)) || letters FROM w WHERE rest > 0),
t AS (SELECT c_nationkey, letters || '1' AS cell, regexp_replace(letters || '1: ' || name, '[{oracles.BLANK}]+$', '') AS whole FROM w WHERE rest = 0)
SELECT c_nationkey AS nation, cell, substr(whole, first, {PASSAGE_CHARS}) AS text FROM (SELECT *, unnest(generate_series(1, length(whole), {PASSAGE_CHARS})) AS first FROM t)""")
def wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One delimited file per nation whose only row has a cell for each customer, by key, then name: columns go beyond Z and ZZ.

    A name may hold any text, so each is quoted; a missing one is a blank cell, and blank cells have rows too. Cells' texts
    are passages: without blanks at the end, and in pieces if they are long.
    """
    from lodestack.sources.extract import NO_LIMITS, extract, whole

    quoted = lambda name: F.concat(F.lit('"'), F.replace(F.coalesce(name, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    names_ = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: quoted(r["c_name"]))
    files = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(names_, "\t").alias("text"))
    held = files.select("c_nationkey", F.sha2("text", 256).alias("fingerprint"), F.encode("text", "utf-8").alias("content"))
    found = whole(extract(held.select(F.lit("t.tsv").alias("name"), "content"), replace(NO_LIMITS, blank_cells=True))).select("fingerprint", F.inline("passages"))
    return found.join(held.select("c_nationkey", "fingerprint"), "fingerprint").select(F.col("c_nationkey").alias("nation"), "cell", "text")


@query("""WITH {cat}, j AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'ocr' ELSE 'text' END AS phase, CAST(file_id % 16 AS INTEGER) AS attempts, CAST(1700000000 + file_id * 100 AS DOUBLE) AS retry_at FROM files_ WHERE file_id % 4 < 3)
SELECT file_id, name, attempts, 1700050000 + least(86400.0, 30 * pow(2, least(12, attempts + 1))) AS next_try FROM j JOIN files_ USING (file_id) WHERE phase = 'text' AND retry_at <= 1700050000 AND (relative_path = 'Documents' OR starts_with(relative_path, 'Documents/'))""")
def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder whose text is to be read now, with the time of the next try should this one fail."""
    f = cat.files(read(spark, sf, "documents"))
    i = F.col("file_id")
    jobs = f.filter(i % 4 < 3).select("file_id", F.when(i % 3 == 0, "ocr").otherwise("text").alias("phase"), (i % 16).cast("int").alias("attempts"), (F.lit(1_700_000_000) + i * 100).cast("double").alias("retry_at"))
    return incremental.queued_files(jobs, f, "text", 1_700_050_000.0, folder="Documents").select("file_id", "name", "attempts", "next_try")


# --- an encoder of the corpus --------------------------------------------------------------------------------------

_COMMON = 30


@query(f"""WITH {{cat}}, t AS (SELECT passage_id, {reg._tokens_sql('text')} AS toks FROM passages_), e AS (SELECT passage_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM t), v AS (SELECT w FROM e GROUP BY w HAVING count(*) >= {_COMMON}),
p AS (SELECT x.w AS a, y.w AS b FROM e x JOIN e y ON x.passage_id = y.passage_id AND y.i BETWEEN x.i + 1 AND x.i + {encoder.WINDOW} WHERE x.w IN (FROM v) AND y.w IN (FROM v)),
n AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM p GROUP BY 1, 2), s AS (FROM n UNION ALL SELECT b, a, n FROM n WHERE a <> b), m AS (SELECT a, sum(n) AS m FROM s GROUP BY a), tot AS (SELECT CAST(sum(m) AS DOUBLE) AS total FROM m)
SELECT s.a AS word, count(*) AS partners, round(sum(ln(n * total / (m.m * o.m))), 4) AS weight FROM s JOIN m ON m.a = s.a JOIN m o ON o.a = s.b, tot WHERE ln(n * total / (m.m * o.m)) > 0 GROUP BY s.a""")
def word_partners(spark: SparkSession, sf: str) -> DataFrame:
    """How many words each frequent word is drawn to, and how strongly: the matrix that the encoder is trained on."""
    counts = word_tiles.counted(catalog(spark, sf).passages, "text", _COMMON, encoder.WINDOW)
    return counts.partners().select("word", "partners", F.round("weight", 4).alias("weight"))


@query()
def encoder_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the first half of a benchmark item finds its second half among those of all items, by the trained encoder and by
    the hashed one. The benchmark is the stated set of queries."""
    words = F.split("text", " ")
    half = F.floor(F.size(words) / 2).cast("int")
    items = read(spark, sf, "benchmark")
    first, second = (items.select("item_id", F.array_join(F.slice(words, at, n), " ").alias("text")) for at, n in ((F.lit(1), half), (half + 1, F.size(words) - half)))
    trained = encoder.train(catalog(spark, sf).passages)
    truth = items.select(F.col("item_id").alias("query_id"), "item_id")
    out = None
    for name, encode in ((trained.name, lambda t: trained.encode(t, "item_id", "text")), (vectors.MODEL, lambda t: t.select("item_id", vectors.encode("text").alias("vector")).filter("vector IS NOT NULL"))):
        near = encode(first).select(F.col("item_id").alias("query_id"), F.col("vector").alias("q")).crossJoin(encode(second))
        ranked = near.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(vectors.cosine(F.col("q"), F.col("vector"))), "item_id")).alias("position"))
        row = relevance.metrics(ranked.withColumn("position", F.col("position") - 1), truth).select(F.lit(name).alias("encoder"), "*")
        out = row if out is None else out.unionByName(row)
    return out
