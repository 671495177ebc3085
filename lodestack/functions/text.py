"""Text functions: accent folding, word tokens, query parsing, glob patterns."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the plain letters they fold to, from their canonical decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def words(text: Column) -> Column:
    """Tokens of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def word_list(text: str) -> list[str]:
    out, run = [], ""
    for c in fold_text(text):
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out, run = [*out, run], ""
    return [*out, run] if run else out


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; prefix: the last one need only begin so."""

    tokens: tuple[str, ...]
    prefix: bool = False


MOST_TERMS, MOST_CHARS = 24, 512


def unquoted(query: str) -> str:
    return query[1:-1] if len(query) >= 2 and query[0] == query[-1] == '"' else query


def parse_query(query: str, exact: bool = False, prefix: bool = False) -> list[Phrase]:
    """The phrases whose union a query asks for. What users type is data: quotes group words, nothing else counts."""
    query = query.strip()[:MOST_CHARS]
    whole = exact or unquoted(query) != query
    query = unquoted(query)
    if whole:
        parts = [query]
        prefix = False
    else:
        parts = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)[:MOST_TERMS]]
    found = [Phrase(tuple(word_list(p)), prefix) for p in parts]
    return [p for p in found if p.tokens]


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regex for the whole string; * also matches slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def _matches(rx: str):
    return lambda part: part.rlike(rx)


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path falls under an exclusion: with a slash, the whole path is equal, below or matches;
    without, any of its components matches."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip().strip("/")
        if not p:
            continue
        rx = glob_regex(p)
        if "/" in p:
            out = out | (path == p) | path.startswith(p + "/") | path.rlike(rx)
        else:
            out = out | F.exists(F.split(path, "/"), _matches(rx))
    return out


def column_name(number: Column) -> Column:
    """Spreadsheet column: 1 is A, 27 is AA (up to three letters)."""
    n = number.cast("long")

    def letter(x: Column) -> Column:
        return F.char((x % 26) + 65)

    one, two = n - 1, F.floor((n - 1) / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(two)).otherwise(""), letter(one))
