"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe_codec, decontaminate, frame_store, html_text, importance, line_dedup, lm_scoring, ngram_join, quality_rules, secret_scan, simhash, spelling, token_counts
from lodestack.llm.tables import table
from lodestack.runtime import scratch


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    rules = secret_scan.RULES
    base = [i for i, r in enumerate(rules) if r.base]

    def count(i: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{rules[i].kind}")

    digest = F.sha2(secret_scan.span_text(F.filter("spans", lambda s: s["kind"] <= max(base))), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, base), digest, secret_scan.span_text(F.col("spans")).alias("spans"))


def _op3_sql() -> str:
    """Every rule over every text: the places follow from the lengths of matches and of the pieces between."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        rx = r.regex.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {i} AS kind, '{r.kind}' AS name, unnest(regexp_extract_all(t, '{rx}', 0)) AS hit, unnest(regexp_extract_all(t, '{rx}', {r.group})) AS judged,
         unnest(regexp_split_to_array(t, '{rx}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{rx}', 0), 1) AS i, {r.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}
), s AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM m
), k AS (
  SELECT doc_id, kind, name, CAST(stop - length(hit) AS BIGINT) AS start, name || ':' || CAST(stop - length(hit) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM s WHERE length(judged) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


OP3_SQL = _op3_sql()


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_rules(docs, carry_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op5_sql() -> str:
    """The measures by unnested words and lines, the prior and the verdicts by sums per host."""
    q = quality_rules
    rules = ", ".join(f"({rule}) AS fail_{k}" for k, rule in q.RULES.items())
    each = lambda form, sep=", ": sep.join(form.format(k=k) for k in q.RULES)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM d
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split
), five AS (
  SELECT doc_id, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five WHERE g IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + {q.WINDOW})) AS p FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), same AS (
  SELECT doc_id, line, count(*) AS n FROM l GROUP BY doc_id, line
), dup AS (
  SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n - 1) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')), 0) AS n_dup_lines FROM same GROUP BY doc_id
), m AS (
  SELECT d.doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines FROM d JOIN split USING (doc_id) JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, {rules} FROM m
), h AS (
  SELECT source AS host, count(*) AS n, {each("count(*) FILTER (fail_{k}) AS failed_{k}")} FROM f GROUP BY source
), p AS (
  SELECT count(*) / sum(n) AS inv, {each("sum(failed_{k}) / sum(n) AS mean_{k}, sum(n * (failed_{k} / n) * (failed_{k} / n)) / sum(n) AS square_{k}")} FROM h
), s AS (
  SELECT h.*, p.*, {each("least(greatest(mean_{k} * (1 - mean_{k}) / greatest((square_{k} - mean_{k} * mean_{k} - mean_{k} * (1 - mean_{k}) * inv) / greatest(1 - inv, 1e-9), 1e-12) - 1, 1e-3), 1e9) AS strength_{k}")} FROM h, p
), r AS (
  SELECT *, {each("(failed_{k} + mean_{k} * strength_{k}) / (n + strength_{k}) AS rate_{k}")} FROM s
), v AS (
  SELECT host, {each("rate_{k} + 2 * sqrt(greatest(rate_{k} * (1 - rate_{k}), 0) / (n + strength_{k} + 1)) >= " + str(q.TRUSTED) + " * mean_{k} AS prone_{k}")}, {each("rate_{k} - 2 * sqrt(greatest(rate_{k} * (1 - rate_{k}), 0) / (n + strength_{k} + 1)) <= " + str(q.HOST_RATE), " AND ")} AS host_ok FROM r
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, fail_base AS base_failed,
       NOT fail_base AND host_ok AND {each("NOT (fail_{k} AND prone_{k})", " AND ")} AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host
"""


OP5_SQL = _op5_sql()


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_token_id_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    manifest = frame_store.write_store(table(spark, sf_dir, "documents"), path)
    return frame_store.read_store(spark, path, manifest)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op9_sql() -> str:
    """Windows as strings instead of hashes. RE2 has no looking around: what would be looked at is matched and put
    back, twice, as neighbours may share it."""
    d = decontaminate
    name, unit = "'([\\p{L}\\p{N},;][ \\n])(\\p{Lu}\\p{Ll}+)', '\\1' || chr(1) || '\\2', 'g'", f"'(?i)(\\x02[0-9.,]+) ?({'|'.join(d.UNITS)})([^\\p{{L}}\\p{{N}}]|$)', '\\1 ' || chr(3) || '\\2\\3', 'g'"

    def tokens(text: str) -> str:
        t = f"regexp_replace(coalesce({text}, ''), '[\\x01-\\x03]', ' ', 'g')"
        t = f"regexp_replace(regexp_replace({t}, {name}), {name})"
        t = f"regexp_replace({t}, '[0-9]+(?:[.,][0-9]+)*', chr(2) || '\\0', 'g')"
        t = f"regexp_replace(regexp_replace({t}, {unit}), {unit})"
        return f"regexp_extract_all(lower({t}), '\\x02[0-9]+(?:[.,][0-9]+)*|[\\x01\\x03]?[\\p{{L}}\\p{{M}}]+')"

    folded = "CASE WHEN x < chr(2) THEN x[2:] ELSE x END"
    lists = f"""toks, len(toks) AS size, list_transform(toks, lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END) AS named,
         list_transform(toks, lambda x: {folded}) AS exact, list_transform(list_transform(toks, lambda x: {folded}), lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END) AS plain"""
    window = lambda c, width=d.WINDOW: f"array_to_string({c}[pos + 1 : pos + {width}], ' ')"
    at = f"unnest(range(greatest(size - {d.WINDOW - 1}, 1))) AS pos"
    return f"""
WITH d AS (SELECT doc_id, {lists} FROM (SELECT doc_id, {tokens("text")} AS toks FROM documents WHERE doc_id IS NOT NULL) WHERE len(toks) > 0),
b AS (SELECT item_id, {lists} FROM (SELECT item_id, {tokens("text")} AS toks FROM benchmark WHERE item_id IS NOT NULL) WHERE len(toks) > 0),
iw AS (SELECT *, len(list_filter(toks[pos + 1 : pos + {d.WINDOW}], lambda x: x >= chr(4))) AS words, len(list_filter(exact[pos + 1 : pos + {d.WINDOW}], lambda x: x >= chr(4))) AS plain_words FROM (SELECT *, {at} FROM b)),
used AS (
  SELECT item_id, 0 AS kind, pos AS item_at, {window("named")} AS h FROM iw WHERE words >= {d.WORDS} UNION
  SELECT item_id, 1, pos, CASE WHEN plain_words >= {d.WORDS} THEN {window("plain")} ELSE {window("exact")} END FROM iw WHERE size >= {d.WINDOW} UNION
  SELECT item_id, 2, 0, array_to_string(exact, ' ') FROM b WHERE size BETWEEN {d.LEAST} AND {d.WINDOW - 1}
), wanted AS (SELECT *, count(*) OVER (PARTITION BY item_id, kind) AS n FROM used),
dw AS (SELECT *, {at} FROM d),
dh AS (SELECT doc_id, pos, {window("named")} AS h FROM dw UNION SELECT doc_id, pos, {window("plain")} FROM dw UNION SELECT doc_id, pos, {window("exact")} FROM dw),
short AS (SELECT DISTINCT size AS width FROM b WHERE size BETWEEN {d.LEAST} AND {d.WINDOW - 1}),
sw AS (SELECT doc_id, exact, width, unnest(range(greatest(size - width + 1, 1))) AS pos FROM d, short),
met AS (
  SELECT doc_id, item_id, kind, n, pos - item_at AS shift, item_at FROM dh JOIN wanted USING (h) WHERE kind < 2 UNION
  SELECT doc_id, item_id, kind, n, pos, 0 FROM (SELECT *, {window("exact", "width")} AS h FROM sw) w JOIN wanted USING (h) JOIN b USING (item_id) WHERE kind = 2 AND b.size = width
), shifts AS (SELECT doc_id, item_id, kind, n, shift, count(*) AS most FROM met GROUP BY ALL),
best AS (SELECT doc_id, item_id, kind, n, shift, most FROM shifts QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, kind ORDER BY most DESC, shift) = 1),
pairs AS (SELECT doc_id, item_id, kind, n, count(DISTINCT item_at) AS covered FROM met GROUP BY ALL),
found AS (SELECT doc_id, item_id, shift, max(covered / n) AS coverage FROM pairs JOIN best USING (doc_id, item_id, kind, n) WHERE covered >= {d.COVERAGE} * n OR most >= {d.RUN - d.WINDOW + 1} GROUP BY ALL),
faced AS (
  SELECT doc_id, item_id, shift, coverage, b.toks[p + 1] AS i, d.toks[p + shift + 1] AS t
  FROM (SELECT *, unnest(range(greatest(0, -shift), least(bn, dn - shift))) AS p FROM (SELECT f.*, b.size AS bn, d.size AS dn FROM found f JOIN b USING (item_id) JOIN d USING (doc_id))) f JOIN b USING (item_id) JOIN d USING (doc_id)
), judged AS (
  SELECT doc_id, item_id, coverage, count(DISTINCT i || ' ' || t) FILTER (i < chr(4) AND i[1] = t[1]) AS slots, count(DISTINCT i) FILTER (i < chr(4) AND i[1] = t[1]) AS left_, count(DISTINCT t) FILTER (i < chr(4) AND i[1] = t[1]) AS right_,
         count(*) FILTER ({folded.replace("x", "i", 1).replace("x[", "i[").replace("ELSE x", "ELSE i")} = {folded.replace("x", "t", 1).replace("x[", "t[").replace("ELSE x", "ELSE t")}) / count(*) AS literal
  FROM faced GROUP BY doc_id, item_id, shift, coverage
)
SELECT doc_id, item_id, coverage, CAST(slots AS INTEGER) AS slots, slots = left_ AND slots = right_ AS slots_agree, literal FROM judged WHERE slots = left_ AND slots = right_ OR literal >= {d.LITERAL}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY coverage DESC, literal DESC, slots DESC, slots_agree DESC) = 1
"""


OP9_SQL = _op9_sql()


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8, bit by bit; the polynomial is a fixed value."""
    bits = f"CAST(CAST(encode({text}) AS BIT) AS VARCHAR)"
    each = f"list_transform(range(length({bits})), lambda k: CASE WHEN substr({bits}, k // 8 * 8 + 8 - k % 8, 1) = '1' THEN 1 ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS_SQL = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT doc_id, {_RUNS_SQL} AS f FROM d), nd AS (SELECT f, count(*) AS n FROM fd GROUP BY f), nb AS (SELECT f, count(*) AS n FROM (SELECT {_RUNS_SQL} AS f FROM b) GROUP BY f), u AS (SELECT f FROM nd UNION SELECT f FROM nb),
k AS (SELECT f, CAST({_crc32_sql("f")} % {importance.BUCKETS} AS BIGINT) AS bucket FROM u),
raw AS (SELECT bucket, sum(n) AS s FROM nd JOIN k USING (f) GROUP BY bucket), aim AS (SELECT bucket, sum(n) AS t FROM nb JOIN k USING (f) GROUP BY bucket),
tot AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM raw) AS DOUBLE) AS s_all, CAST((SELECT coalesce(sum(t), 0) FROM aim) AS DOUBLE) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {importance.BUCKETS}) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + {importance.BUCKETS})))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN raw USING (bucket) LEFT JOIN aim USING (bucket), tot),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY doc_id),
sc AS (SELECT d.doc_id, len(w) >= {importance.LEAST_WORDS} AS fit, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT *, weight + noise AS score, row_number() OVER (ORDER BY fit DESC, weight + noise DESC, doc_id) AS place, count(*) FILTER (fit) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= {importance.SHARE[0]} * n // {importance.SHARE[1]} THEN place END AS rank FROM r
"""

OP12_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER_SQL}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {ngram_join.SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {ngram_join.SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {ngram_join.SHINGLE - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)), both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM both_ UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x), least_ AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON x = w.doc_id
"""

OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents), o AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= {spelling.LEAST_CHARS} GROUP BY ALL),
h AS (SELECT run, n, CAST({_crc32_sql("doc_id || ':' || run")} AS BIGINT) AS h FROM o),
f AS (SELECT CASE WHEN h % {spelling.SLIPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM f WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
c AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT x.word, y.word AS other, y.n FROM c x JOIN c y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.a || c.b UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM near GROUP BY word),
k AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {spelling.RATIO} * v.n THEN other END AS form, CASE WHEN top >= {spelling.RATIO} * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, form AS root, 1 AS depth FROM k WHERE form IS NOT NULL UNION ALL SELECT up.word, k.form, depth + 1 FROM up JOIN k ON k.word = up.root WHERE k.form IS NOT NULL),
last_ AS (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)
SELECT k.word, form, coalesce(root, k.word) AS root, n, n_near, form_n FROM k LEFT JOIN last_ USING (word)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_line_dedup, op2_html_extraction, op3_secret_scans, op4_lm_scoring, op5_quality_rules, op6_token_counts, op7_token_id_frames, op8_bpe_codec,
        op9_benchmark_decontamination, op10_simhash_near_dedup, op11_importance_resampling, op12_ngram_jaccard_join, op13_spelling_variants,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_secret_scans": OP3_SQL, "op5_quality_rules": OP5_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_ngram_jaccard_join": OP12_SQL, "op13_spelling_variants": OP13_SQL}
