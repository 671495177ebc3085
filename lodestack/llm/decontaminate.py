"""Operator 9: benchmark decontamination by template windows. DataFrame functions only.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units after numbers turn
into typed placeholders. Windows of WINDOW template tokens of the benchmark are hash-joined with those of the
documents. An item whose windows a document covers to at least COVERAGE is a candidate, and so is a run of RUN
tokens or more of a longer item; the candidate's slots are then compared along its best alignment: one value of
the item must stand for one value of the document and the other way round. Copies with other numbers or names
keep that rule, chance meetings of common phrases don't. Where slots disagree, a match still counts if the two
passages agree word by word to LITERAL.

Names are known by capitals, so copies in other letter case are found by a second key that takes names as plain
words. Windows of few words (lists of numbers) are hashed with all their values. An item of fewer tokens than
WINDOW is looked up whole, with its values, in document windows of its own length. One of fewer than LEAST tokens
("Why?") stands in many clean documents and is no evidence: it condemns none, and too_short() lists it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import materialize

WINDOW, LEAST, COVERAGE, RUN, LITERAL = 8, 3, 0.5, 20, 0.9
#: A window of the benchmark is used if at least this many of its tokens are words.
WORDS = 4
# Units that count as such after a number.
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters",
    "metre", "metres", "kilometer", "kilometers", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ton", "tons", "tonne", "tonnes", "gram", "grams",
    "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ms", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes",
    "h", "hr", "hrs", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "ml", "l", "liter", "liters", "litre",
    "litres", "gallon", "gallons", "j", "kj", "cal", "kcal", "w", "kw", "mw", "v", "kv", "a", "hz", "khz", "mhz", "ghz", "pa", "kpa", "bar", "k", "b",
    "kb", "mb", "gb", "tb", "byte", "bytes", "percent", "degree", "degrees", "dollar", "dollars", "cent", "cents", "euro", "euros", "mph", "kmh",
)
_NAME, _NUMBER, _UNIT = "\x01", "\x02", "\x03"


def tokens(text: Column) -> Column:
    """Lower-cased words and numbers of a text; a placeholder token starts with its type's mark."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x03]", " ")
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;][ \n])(\p{Lu}\p{Ll}+)", _NAME + "$1")
    t = F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", _NUMBER + "$0")
    t = F.regexp_replace(t, r"(?i)(\x02[0-9.,]+) ?(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", "$1 " + _UNIT + "$2")
    return F.regexp_extract_all(F.lower(t), F.lit(r"\x02[0-9]+(?:[.,][0-9]+)*|[\x01\x03]?[\p{L}\p{M}]+"), F.lit(0))


def _is_slot(token: Column) -> Column:
    return token < F.lit("\x04")


def _template(token: Column) -> Column:
    return F.when(_is_slot(token), F.substring(token, 1, 1)).otherwise(token)


def _folded(token: Column) -> Column:
    """A name without its mark: the same in every letter case."""
    return F.when(token < F.lit("\x02"), F.substring(token, 2, 1 << 30)).otherwise(token)


def _slices(hashed: Column | str, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashed) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashed, i, width)))


def windows(rows: DataFrame, key: str, text: str, literal: bool = False, width: int = WINDOW) -> DataFrame:
    """(key, at, hs): the 64-bit hashes of each window of tokens and its first token's place from 0.

    hs has the window's template and the same with names as plain words; with literal its tokens with all values.
    A text of fewer tokens than width is one window; one without tokens has none.
    """
    hashed = rows.select(F.col(key).alias("key"), tokens(F.col(text)).alias("toks")).select(
        "key",
        F.transform("toks", lambda x: F.xxhash64(_template(x))).alias("named"),
        F.transform("toks", lambda x: F.xxhash64(_template(_folded(x)))).alias("plain"),
        *([F.transform("toks", lambda x: F.xxhash64(_folded(x))).alias("exact")] if literal else []),
    )
    some = F.when(F.size("named") > 0, F.arrays_zip(*[_slices(c, width).alias(c) for c in hashed.columns[1:]]))
    # An outer explode: for an inner one Catalyst adds a filter on the array's size that computes it all again.
    each = hashed.select("key", F.posexplode_outer(some).alias("at", "w")).filter(F.col("w").isNotNull())
    return each.select("key", "at", "w.*")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, kind, at, h, n): the benchmark's windows, n being the item's number of them in this kind.

    Kind 0: templates with enough words. Kind 1, for items of WINDOW tokens or more: every window with names as
    plain words, or with all its values where it has too few words even so. Kind 2, for shorter
    items of LEAST tokens or more: the whole item with all its values; at is 0.
    """
    toks = items.select(F.col(key).alias("key"), tokens(F.col(text)).alias("toks"))

    def words(i: Column, names: bool) -> Column:
        return F.size(F.filter(F.slice("toks", i, WINDOW), lambda x: ~_is_slot(_folded(x) if names else x)))

    counts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("toks") - (WINDOW - 1), F.lit(1))), lambda i: F.struct(words(i, False).alias("words"), words(i, True).alias("plain_words")))
    wordy = toks.select("key", F.size("toks").alias("size"), F.posexplode(counts).alias("at", "c")).select("key", "size", "at", "c.*")
    all_ = windows(items, key, text, True).join(wordy, ["key", "at"])
    item = F.col("key").alias("item")
    used = all_.filter(F.col("words") >= WORDS).select(item, F.lit(0).alias("kind"), "at", F.col("named").alias("h"))
    long = all_.filter(F.col("size") >= WINDOW)
    used = used.union(long.select(item, F.lit(1), "at", F.when(F.col("plain_words") >= WORDS, F.col("plain")).otherwise(F.col("exact"))))
    short = toks.filter(F.size("toks").between(LEAST, WINDOW - 1))
    whole = F.xxhash64(F.transform("toks", lambda x: F.xxhash64(_folded(x))))
    used = used.union(short.select(item, F.lit(2), F.lit(0), whole))
    used = used.distinct()
    return used.join(used.groupBy("item", "kind").agg(F.count(F.lit(1)).alias("n")), ["item", "kind"])


def too_short(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, tokens) of the items that have fewer than LEAST tokens, which nothing is checked for."""
    return items.select(key, F.size(tokens(F.col(text))).alias("tokens")).filter(F.col("tokens") < LEAST)


def poor_items(items: DataFrame, text: str) -> bool:
    """Whether a window of an item has too few words even if names count as such."""
    toks = items.select(tokens(F.col(text)).alias("toks"))
    poor = F.exists(F.sequence(F.lit(1), F.greatest(F.size("toks") - (WINDOW - 1), F.lit(1))), lambda i: F.size(F.filter(F.slice("toks", i, WINDOW), lambda x: ~_is_slot(_folded(x)))) < WORDS)
    return toks.filter(poor).limit(1).count() > 0


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Candidates (doc, item, coverage, shift): documents that cover an item's windows of one kind, and the shift
    from item to document places that most of the shared windows have."""
    wanted = materialize(item_windows(items, item_key, text), "item-windows").select("item", "kind", F.col("at").alias("item_at"), "h", "n")
    # All values are hashed only if an item asks for them; a window without names has one template.
    literal = poor_items(items, text)
    hs = F.array_distinct(F.array("named", "plain", *(["exact"] if literal else [])))
    met = windows(docs, key, text, literal).select("key", "at", F.explode(hs).alias("h")).join(wanted.filter("kind < 2"), "h")
    # One pass for each length of an item shorter than WINDOW, whatever other text stands around it.
    sizes = items.select(F.size(tokens(F.col(text))).alias("size")).filter(F.col("size").between(LEAST, WINDOW - 1)).distinct()
    for (width,) in sizes.collect():  # WINDOW - 1 rows at most
        own = items.filter(F.size(tokens(F.col(text))) == width).select(F.col(item_key).alias("item")).distinct()
        whole = windows(docs, key, text, True, width).select("key", "at", F.col("exact").alias("h"))
        met = met.unionByName(whole.join(wanted.filter("kind = 2").join(own, "item", "left_semi"), "h"))
    # One row per (document, item, shift) first; then per pair. Partial sums come before either shuffle.
    by_shift = met.groupBy(F.col("key").alias("doc"), "item", "kind", "n", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("places"))
    pairs = by_shift.groupBy("doc", "item", "kind", "n").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.max(F.struct(F.size("places").alias("most"), (-F.col("shift")).alias("back"))).alias("best"),
    )
    wide = (F.col("covered") >= COVERAGE * F.col("n")) | (F.col("best.most") >= RUN - WINDOW + 1)
    # Every kind that found the pair names its alignment.
    found = pairs.filter(wide).select("doc", "item", (F.col("covered") / F.col("n")).alias("coverage"), (-F.col("best.back")).alias("shift"))
    return found.groupBy("doc", "item", "shift").agg(F.max("coverage").alias("coverage")).select("doc", "item", "coverage", "shift")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item_key, coverage, slots, slots_agree, literal): one row per document and item it leaks.

    coverage is the share of the item's windows found, slots the number of distinct slot pairs along the best
    alignment, slots_agree whether they map one to one, literal the share of equal tokens there. The
    benchmark's windows are broadcast only if their table is below Spark's threshold; else both sides meet by
    hash. Null and empty texts leak nothing; null keys are left out (give such rows a key of their own, as the
    pipeline does); repeated rows of a key count as one document; very long texts are read whole, their windows
    being rows of their own; empty tables give an empty table. Only keys and texts are read, so other columns can't clash.
    """
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    items = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).alias("_item"), F.col(text).alias("_item_text"))
    renamed = items.select("_item", F.col("_item_text").alias("_text"))
    found = materialize(overlaps(docs, renamed, "_doc", "_item", "_text"), "overlaps")
    own = docs.join(found, docs["_doc"] == found["doc"]).join(items, F.col("item") == items["_item"])
    # Written before it is used: inside the lambdas below Catalyst would tokenise again for every element.
    sides = materialize(own.select("_doc", "_item", "coverage", "shift", tokens(F.col("_text")).alias("d"), tokens(F.col("_item_text")).alias("i")), "overlap-tokens")
    # Along the alignment, token p of the item stands opposite token p + shift of the document.
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("i"), F.size("d") - F.col("shift")) - 1
    opposite = F.transform(F.sequence(first, last), lambda p: F.struct(F.element_at("i", p + 1).alias("item"), F.element_at("d", p + F.col("shift") + 1).alias("doc")))
    # Another text of a repeated key may not reach the alignment at all.
    faced = materialize(sides.filter(last >= first).select("_doc", "_item", "coverage", opposite.alias("faced")), "overlap-faced")
    slots = F.array_distinct(F.filter("faced", lambda x: _is_slot(x["item"]) & (F.substring(x["item"], 1, 1) == F.substring(x["doc"], 1, 1))))
    equal = F.size(F.filter("faced", lambda x: _folded(x["item"]) == _folded(x["doc"]))) / F.size("faced")
    judged = faced.select("_doc", "_item", "coverage", slots.alias("pairs"), equal.alias("literal"))
    agree = (F.size(F.array_distinct("pairs.item")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.doc")) == F.size("pairs"))
    judged = judged.select("_doc", "_item", "coverage", F.size("pairs").alias("slots"), agree.alias("slots_agree"), "literal")
    leaks = judged.filter(F.col("slots_agree") | (F.col("literal") >= LITERAL))
    # Rows of one key with other texts may each leak; the fullest counts.
    best = leaks.groupBy("_doc", "_item").agg(F.max(F.struct("coverage", "literal", "slots", "slots_agree")).alias("best"))
    return best.select(F.col("_doc").alias(key), F.col("_item").alias(item_key), "best.coverage", "best.slots", "best.slots_agree", "best.literal")
