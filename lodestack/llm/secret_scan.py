"""Operator 3: secret scans over a trigram inverted index. DataFrame functions only.

1. Each rule's regex is parsed and turned into a Boolean query of trigrams that every match must contain.
2. The index lists, per trigram that some query asks for, the documents whose lower-cased text holds it.
3. Postings are intersected per document and each query is evaluated; documents that pass are candidates.
4. Candidates are verified with the regex itself. Rules whose query is empty scan every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """regex has Java and Python meaning alike. A match counts if group ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds, then the kinds that are added to them.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # These ask for their least length at once: a run of characters that is too short has no match inside either.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query is True (no demand), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple[str, tuple]
_MOST_STRINGS = 64


def _join(kind: str, queries: list[Query]) -> Query:
    if kind == "or" and any(q is True for q in queries):
        return True
    kept = tuple(dict.fromkeys(q for q in queries if q is not True))
    if kind == "or":  # "a and b" adds nothing beside "a"
        kept = tuple(q for q in kept if not any(_conjuncts(p) < _conjuncts(q) for p in kept))
    return True if not kept else kept[0] if len(kept) == 1 else (kind, kept)


def _conjuncts(query: Query) -> frozenset:
    return frozenset(query[1]) if isinstance(query, tuple) and query[0] == "and" else frozenset([query])


def _of_strings(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node, flags: int) -> set[str] | None:
    """All lower-cased strings that a node matches, or None if there are too many or it can't be told."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _MOST_STRINGS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3], flags)
    if op is sre.BRANCH:
        parts = [_sequence_strings(x, flags) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        once = _sequence_strings(arg[2], flags)
        if once is None:
            return None
        runs = [{""}]
        for _ in range(arg[1]):
            runs.append({a + b for a in runs[-1] for b in once})
        return set().union(*runs[arg[0] :])
    return None


def _sequence_strings(nodes, flags: int) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node, flags)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes, flags: int = 0) -> Query:
    demands: list[Query] = []
    run = {""}
    for node in nodes:
        more = _strings(node, flags)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        demands.append(_of_strings(run))
        run = more if more is not None else {""}
        op, arg = node
        if more is None:
            if op is sre.SUBPATTERN:
                demands.append(_query(arg[3], flags))
            elif op is sre.BRANCH:
                demands.append(_join("or", [_query(x, flags) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                demands.append(_query(arg[2], flags))
    return _join("and", [*demands, _of_strings(run)])


def trigram_query(regex: str) -> Query:
    """Trigrams of the lower-cased text that every match of regex implies."""
    return _query(parser.parse(regex))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def index(docs: DataFrame, wanted: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram number, key) of the wanted trigrams. A text is lower-cased once and never shuffled."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    return docs.select(F.col(key).alias("key"), low.alias("low")).select("key", F.explode(found).alias("trigram"))


def _holds(query: Query, place: dict[str, int]) -> Column:
    """Whether a document's trigrams, as words of 62 bits, satisfy a query."""
    if isinstance(query, str):
        i = place[query]
        return F.col(f"word{i // 62}").bitwiseAND(F.lit(1 << i % 62)) != 0
    out = None
    for q in query[1]:
        more = _holds(q, place)
        out = more if out is None else out & more if query[0] == "and" else out | more
    return out


def candidates(postings: DataFrame, wanted: list[str], queries: dict[str, Query]) -> DataFrame:
    """Per key with a candidate rule: may_<kind> for each rule that has a query."""
    words = [F.bit_or(F.when(F.col("trigram").between(w * 62, w * 62 + 61), F.expr(f"shiftleft(1L, trigram - {w * 62})")).otherwise(F.lit(0).cast("long"))).alias(f"word{w}") for w in range((len(wanted) + 61) // 62)]
    place = {t: i for i, t in enumerate(wanted)}
    met = postings.groupBy("key").agg(*words).select("key", *[_holds(q, place).alias(f"may_{k}") for k, q in queries.items()])
    any_rule = None
    for k in queries:
        any_rule = F.col(f"may_{k}") if any_rule is None else any_rule | F.col(f"may_{k}")
    return met.filter(any_rule)


#: Matches whose spans are gathered at once: appending to an array copies it, so long lists grow by parts.
_PART = 256


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, leftmost and non-overlapping, in code points.

    The pieces between matches and the matches themselves alternate; running lengths give the places.
    """
    rx = F.lit(rule.regex)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    judged = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(judged, F.length).alias("judged"))
    kind = "array<struct<start:int,kind:int,end:int>>"

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + x["size"]
        new = F.struct(a.alias("start"), F.lit(order).alias("kind"), b.alias("end"))
        return F.struct(b.alias("at"), F.when(x["judged"] >= rule.least, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    def part(acc, some):
        done = F.array(F.aggregate(some, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step))
        return F.element_at(F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)

    def parts(each):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(each) / _PART).cast("int")), lambda i: F.slice(each, i * _PART + 1, _PART))

    # The outer lambda names the matches once; they would be searched anew for every part otherwise.
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.flatten(F.aggregate(F.element_at(F.transform(F.array(steps), parts), 1), start, part, lambda acc: acc["out"]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: key and ``spans``, the array of (start, kind number in rules, end), sorted.

    Candidates meet their rows in one join on key, with nulls equal; a repeated key's postings are united, so
    each of its rows is verified. Null and empty texts have no spans; very long texts are scanned whole, in time
    about linear in their matches; an empty table gives an empty table.
    Only key and text are read, so other columns can't clash.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    wanted = sorted(set().union(*map(trigrams, indexed.values())))
    if indexed:
        may = candidates(index(docs, wanted, "key"), wanted, indexed).withColumnRenamed("key", "_key")
        docs = docs.join(may, docs["key"].eqNullSafe(may["_key"]), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for i, r in enumerate(rules):
        test = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.kind in indexed else F.lit(True)
        each.append(F.when(test & F.col("text").rlike(r.regex), spans(F.col("text"), r, i)).otherwise(none))
    return docs.select(F.col("key").alias(key), F.array_sort(F.concat(*each)).alias("spans"))


def span_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
