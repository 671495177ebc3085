"""Packing the lines of a text into passages, as one expression over built-in functions.

A fold over the lines says where passages begin; their texts, places and pieces follow from slices. The fold runs over
stretches of lines, so that appending to its arrays costs no square of the number of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BREAK = r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRETCH = 1024
_BEGIN = "array<struct<first:int,heading:string>>"

PASSAGE = "struct<text:string,location:string,page:int,line:int,sheet:string,cell:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def lines(text: Column) -> Column:
    """The text's lines; a break at the very end begins no further one."""
    return let(F.split(text, _BREAK, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def cut(text: Column, chars: int) -> Column:
    """Pieces of at most so many characters of the stripped text; none of a blank one."""
    return let(stripped(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t), F.lit(chars)), lambda at: F.substring(t, at, F.lit(chars)))))


def begins(all_lines: Column, headings: Column, chars: int) -> Column:
    """Where passages begin, from 1, and under which heading.

    ``size`` is what the open passage holds, 0 if the next line begins one: it is then empty, or was one long line. A line
    that doesn't fit begins the next passage, and so does a heading.
    """

    def line(held: Column, x: Column) -> Column:
        title = headings & x.startswith("#")
        n = F.length(x)
        new = (held["size"] == 0) | (held["size"] + n + 1 > chars) | title
        heading = F.when(title, stripped(F.regexp_replace(x, "^#+", ""))).otherwise(held["heading"])
        at = held["at"] + 1
        return F.struct(
            F.when(new, F.concat(held["begins"], F.array(F.struct(at.alias("first"), heading.alias("heading"))))).otherwise(held["begins"]).alias("begins"),
            F.when(n > chars, 0).when(new, n).otherwise(held["size"] + n + 1).cast("int").alias("size"), at.cast("int").alias("at"), heading.alias("heading"),
        )

    none = F.array().cast(_BEGIN)

    def stretch(held: Column, k: Column) -> Column:
        start = F.struct(none.alias("begins"), held["size"].alias("size"), held["at"].alias("at"), held["heading"].alias("heading"))
        ran = F.aggregate(F.slice(all_lines, k, F.lit(_STRETCH)), start, line)
        return let(ran, lambda r: F.struct(F.concat(held["begins"], F.array(r["begins"])).alias("begins"), r["size"].alias("size"), r["at"].alias("at"), r["heading"].alias("heading")))

    zero = F.struct(F.array().cast(f"array<{_BEGIN}>").alias("begins"), F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("heading"))
    steps = F.when(F.size(all_lines) > 0, F.sequence(F.lit(1), F.size(all_lines), F.lit(_STRETCH))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(steps, zero, stretch)["begins"])


def packed(text: Column, headings: Column, chars: int = 1000, numbered: Column | None = None) -> Column:
    """Passages (PASSAGE) of a text: whole lines up to so many characters, longer lines in pieces.

    headings: a line that begins with # begins a passage and names what follows. numbered: lines are those of the file;
    else they are of text that was taken out of it, and passages carry no line. Null gives null; no line is left out.
    """
    numbered = F.lit(True) if numbered is None else numbered

    def place(first: Column, last: Column, heading: Column) -> Column:
        label = F.when(first == last, F.concat(F.lit("Line "), first)).otherwise(F.concat(F.lit("Lines "), first, F.lit("-"), last))
        label = F.when(numbered, label).otherwise(F.concat(F.lit("Extracted text · "), F.lower(label)))
        return F.when(heading.isNull(), label).otherwise(F.concat(heading, F.lit(" · "), F.lower(label)))

    def passages(all_lines: Column, at: Column) -> Column:
        def passage(b: Column, i: Column) -> Column:
            last = F.when(i + 1 < F.size(at), F.get(at, i + 1)["first"] - 1).otherwise(F.size(all_lines))
            whole = F.array_join(F.slice(all_lines, b["first"], last - b["first"] + 1), "\n")
            made = lambda piece: F.struct(piece.alias("text"), place(b["first"], last, b["heading"]).alias("location"), F.lit(None).cast("int").alias("page"), F.when(numbered, b["first"]).alias("line"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"))
            return F.transform(cut(whole, chars), made)

        return F.flatten(F.transform(at, passage))

    return let(lines(text), lambda a: let(begins(a, headings, chars), lambda b: passages(a, b)))


def bounded(passages: Column, most: int | None, most_chars: int | None) -> Column:
    """The first passages within both limits (None: no limit); the last one may be cut."""
    out = passages if most is None else F.slice(passages, 1, most)
    if most_chars is None:
        return out
    fits = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars")), lambda s, p: F.when(s["chars"] >= most_chars, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["chars"] + F.length(p["text"])).alias("chars"))))
    short = lambda p, over: p.withField("text", F.substring(p["text"], F.lit(1), F.length(p["text"]) - over.cast("int")))

    def kept(a: Column) -> Column:
        def taken(s: Column) -> Column:
            over = F.greatest(s["chars"] - most_chars, F.lit(0))
            return F.transform(F.slice(a, 1, s["n"]), lambda p, i: F.when(i == s["n"] - 1, short(p, over)).otherwise(p))

        return let(fits(a), taken)

    return let(out, kept)
