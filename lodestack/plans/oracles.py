"""SQL for registered queries whose rule is a loop or bit arithmetic: packing lines, packed vectors, hashed planes."""

from __future__ import annotations

from lodestack.operators import vectors as v
from lodestack.sources import extract

#: White space as packing.cut strips it, within a class of RE2.
BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MAX = f"{1 << 64}::UHUGEINT"


def packed_lines(texts: str, place: str, line: str, markdown: str = "false") -> str:
    """Common table expressions from texts (key, t) to packed (key, ordinal, text, location, line).

    Lines are taken one after another: size is what the open passage holds, part the number of the passage that a line
    belongs to. place and line are expressions over heading, first and last.
    """
    most = extract.PASSAGE_CHARS
    begins = f"(size = 0 OR size + length(x) + 1 > {most} OR title)"
    return f"""
ls AS (SELECT key, regexp_split_to_array(t, '\\r\\n|[\\n\\r\\v\\f\\x85\\x{{2028}}\\x{{2029}}]') AS a FROM {texts}),
cl AS (SELECT key, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM ls),
ln AS (SELECT key, unnest(a) AS x, generate_subscripts(a, 1) AS n, {markdown} AS md FROM cl),
tl AS (SELECT *, md AND starts_with(x, '#') AS title FROM ln),
go AS (
  WITH RECURSIVE step AS (
    SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS part, '' AS x, false AS title FROM cl
    UNION ALL
    SELECT s.key, s.n + 1, CASE WHEN length(t.x) > {most} THEN 0 WHEN {begins.replace("length(x)", "length(t.x)").replace("title", "t.title").replace("size", "s.size")} THEN length(t.x) ELSE s.size + length(t.x) + 1 END,
           CASE WHEN {begins.replace("length(x)", "length(t.x)").replace("title", "t.title").replace("size", "s.size")} THEN s.part + 1 ELSE s.part END, t.x, t.title
    FROM step s JOIN tl t ON t.key = s.key AND t.n = s.n + 1
  ) SELECT * FROM step WHERE n > 0
), hd AS (
  SELECT *, last_value(CASE WHEN title THEN trim(ltrim(x, '#')) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY n) AS heading FROM go
), gr AS (
  SELECT key, part, string_agg(x, chr(10) ORDER BY n) AS text, min(n) AS first, max(n) AS last, any_value(heading) AS heading, max(length(x)) > {most} AS giant FROM hd GROUP BY key, part
), st AS (
  SELECT *, regexp_replace(text, '^[\\s\\x1c-\\x1f\\x85\\x{{a0}}\\x{{2028}}\\x{{2029}}]+|[\\s\\x1c-\\x1f\\x85\\x{{a0}}\\x{{2028}}\\x{{2029}}]+$', '', 'g') AS whole FROM gr
), pc AS (
  SELECT key, part, cut, substr(whole, cut, {most}) AS text, {place} AS location, {line} AS line FROM (SELECT *, unnest(generate_series(1, length(whole), {most})) AS cut FROM st WHERE whole <> '')
), packed AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY part, cut) - 1 AS ordinal, text, location, line FROM pc)"""


_LINES = "CASE WHEN first = last THEN 'Line ' || first ELSE 'Lines ' || first || '-' || last END"

CHUNK_LINES = f"""WITH f AS (
  SELECT DISTINCT sha256(text) AS fingerprint, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS kind, text FROM documents
), texts AS (SELECT {{'fingerprint': fingerprint, 'kind': kind}} AS key, text AS t FROM f), {packed_lines("texts", f"CASE WHEN heading IS NULL THEN {_LINES} ELSE heading || ' · ' || lower({_LINES}) END", "first", "key.kind = 'md'")}
SELECT fingerprint, '{extract.VERSION}|' || kind || '|text' AS extractor, 'indexed' AS status, coalesce(ordinal, -1) AS ordinal, p.text, location, CAST(coalesce(line, -1) AS INTEGER) AS line
FROM f LEFT JOIN packed p ON p.key = {{'fingerprint': f.fingerprint, 'kind': f.kind}}"""


def visible_text(page: str) -> str:
    """Markup out, block tags to line breaks, known entities to characters. An unfinished comment, script or tag ends the text."""
    t = f"regexp_replace({page}, '(?s)<!--.*?-->|<!--.*$', '', 'g')"
    for tag in ("script", "style"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}[^>]*>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<(head|noscript|template)\\b[^>]*>.*?</(head|noscript|template)[^>]*>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)</?({'|'.join(sorted(extract.HTML_BLOCKS, key=len, reverse=True))})(?:[^a-z0-9>][^>]*)?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*(>|$)', '', 'g')"
    for name, shown in extract.VISIBLE_ENTITIES.items():
        if name != "amp":
            t = f"replace({t}, '&{name};', '{shown.replace(chr(39), chr(39) * 2)}')"
    return f"replace({t}, '&amp;', '&')"


HTML_TEXT = f"""WITH f AS (SELECT DISTINCT sha256(html) AS fingerprint, html FROM pages), texts AS (SELECT fingerprint AS key, {visible_text("html")} AS t FROM f),
{packed_lines("texts", f"'Extracted text · ' || lower({_LINES})", "NULL")}
SELECT fingerprint, 'indexed' AS status, coalesce(ordinal, -1) AS ordinal, p.text, location FROM f LEFT JOIN packed p ON p.key = f.fingerprint"""

_UNIT = """u AS (SELECT vec_id, list_transform(e, lambda x: CAST(x / top / sqrt(list_sum(list_transform(e, lambda y: (y / top) * (y / top)))) AS FLOAT)) AS unit, e
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) AS top FROM embeddings))"""


def pack_roundtrip(probe: int) -> str:
    return f"""WITH {_UNIT}, s AS (SELECT *, list_max(list_transform(unit, lambda x: abs(x))) / CAST(127 AS FLOAT) AS scale FROM u),
q AS (SELECT *, list_transform(unit, lambda x: least(127, greatest(-127, sign(x) * floor(abs(x / scale) + CAST(0.5 AS FLOAT))))) AS q FROM s),
b AS (SELECT *, list_transform(q, lambda x: CAST(CAST(x AS FLOAT) * scale AS DOUBLE)) AS back, list_transform(q, lambda x: CAST(x AS DOUBLE)) AS qd FROM q),
p AS (SELECT list_transform(unit, lambda x: CAST(x AS DOUBLE)) AS probe FROM u WHERE vec_id = {probe})
SELECT vec_id, CAST(12 + len(q) AS INTEGER) AS bytes, round(least(1.0, list_dot_product(e, back) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(back, back))), 6) AS fidelity,
       round(least(1.0, greatest(-1.0, list_dot_product(qd, probe) / sqrt(list_dot_product(qd, qd)))), 6) AS to_probe FROM b, p"""


_PLANES = f"""k AS (SELECT r, c, ({v.PLANE_SEED}::UHUGEINT + (r * {v.MOST_DIMENSIONS} + c + 1)::UHUGEINT * {v.GAMMA}::UHUGEINT) % {_MAX} AS x FROM range({v.TABLES * v.BITS}) a(r), range((SELECT max(len(embedding)) FROM embeddings)) b(c)),
k1 AS (SELECT r, c, (xor(x, x >> 30) * {v.MIX1}::UHUGEINT) % {_MAX} AS x FROM k), k2 AS (SELECT r, c, (xor(x, x >> 27) * {v.MIX2}::UHUGEINT) % {_MAX} AS x FROM k1),
planes AS (SELECT r, list(CAST(bit_count(CAST(xor(x, x >> 31) AS HUGEINT)) - 32 AS DOUBLE) ORDER BY c) AS p FROM k2 GROUP BY r),
dots AS (SELECT vec_id, r // {v.BITS} AS tab, r % {v.BITS} AS bit, list_dot_product(CAST(embedding AS DOUBLE[]), p) AS d, sqrt(list_dot_product(p, p)) AS size FROM embeddings, planes),
keys AS (SELECT vec_id, tab, CAST(tab * {1 << v.BITS} + sum(CASE WHEN d >= 0 THEN 1 << bit ELSE 0 END) AS BIGINT) AS bucket FROM dots GROUP BY vec_id, tab)"""

LSH_BUCKETS = f"WITH {_PLANES} SELECT vec_id, bucket FROM keys"


def multiprobe(probe: int) -> str:
    return f"""WITH {_PLANES}, near AS (SELECT tab, bit, row_number() OVER (PARTITION BY tab ORDER BY abs(d) / size, bit) - 1 AS place FROM dots WHERE vec_id = {probe}),
masks AS (SELECT m FROM range({1 << v.PROBED_BITS}) t(m) WHERE bit_count(m) <= 3),
flips AS (SELECT tab, m, sum(CASE WHEN (m >> place) & 1 = 1 THEN 1 << bit ELSE 0 END) AS flip FROM near, masks WHERE place < {v.PROBED_BITS} GROUP BY tab, m),
probes AS (SELECT DISTINCT xor(bucket, CAST(flip AS BIGINT)) AS bucket FROM keys JOIN flips USING (tab) WHERE vec_id = {probe})
SELECT vec_id AS passage_id, count(*) AS hits FROM keys SEMI JOIN probes USING (bucket) GROUP BY vec_id ORDER BY hits DESC, passage_id LIMIT 1200"""
