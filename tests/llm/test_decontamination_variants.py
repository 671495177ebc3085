"""Operator 9 on planted variants of items of every length: recall, and equality with its SQL twin."""

import random

import duckdb
import pandas as pd

from lodestack.llm import decontaminate, queries

NAMES = ("Peter", "Anna", "Miller", "Jones", "Karl", "Maria", "Tom", "Lucy")
UNITS = ("kg", "km", "hours", "dollars")
WORDS = "which of these old rivers runs past that small town before the farmer sells all baskets and counts how many apples remain when every child has eaten more than half".split()
FILLER = "some quite different sentences stand around it in every one of these long texts and nothing in them looks like a question at all "


def item(rng, size):
    """About size tokens: words, with a number every seventh, a unit behind some numbers and a name every ninth."""
    out = []
    while len(out) < size:
        k = len(out)
        if k and k % 7 == 0:
            out.append(str(rng.randrange(2, 90)))
            if rng.random() < 0.5:
                out.append(rng.choice(UNITS))
        elif k and k % 9 == 0:
            out.append(rng.choice(NAMES))
        else:
            out.append(rng.choice(WORDS))
    return " ".join(out[:size])


def other_values(rng, text):
    """The same question with other numbers, names and units, each old value having one new one."""
    numbers, new = iter(rng.sample(range(100, 999), 60)), {}

    def change(w):
        if w.isdigit():
            return new.setdefault(w, str(next(numbers)))
        if w in NAMES:
            return new.setdefault(w, rng.choice([n for n in ("Otto", "Paula", "Felix", "Ida", "Hugo", "Nora", "Emil", "Vera") if n not in new.values()]))
        return {"kg": "tons", "km": "miles", "hours": "days", "dollars": "euros"}.get(w, w)

    return " ".join(map(change, text.split()))


def test_variants_of_every_length(spark):
    rng = random.Random(11)
    sizes = [*range(3, 13), 15, 20, 30, 45, 60]
    items = {n: item(rng, n) for n in sizes}
    forms = {"whole": lambda t: t, "lower": str.lower, "upper": str.upper, "values": lambda t: other_values(rng, t)}
    docs, planted = [], []
    for n, text in items.items():
        for form, change in forms.items():
            planted.append((len(docs), n, form, change(text) != text))
            docs.append(FILLER + change(text) + " " + FILLER)
    clean = range(len(docs), len(docs) + 30)
    docs += [FILLER + item(rng, 40) + " " + FILLER for _ in clean]
    d = pd.DataFrame({"doc_id": range(len(docs)), "text": docs})
    b = pd.DataFrame({"item_id": list(items), "text": list(items.values())})
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 9), r["slots"], r["slots_agree"], round(r["literal"], 9)) for r in decontaminate.contaminated(spark.createDataFrame(d), spark.createDataFrame(b)).collect()}
    con = duckdb.connect()
    con.register("documents", d)
    con.register("benchmark", b)
    want = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.slots, r.slots_agree, round(r.literal, 9)) for r in con.sql(queries.OP9_SQL).df().itertuples()}
    assert got == want
    # A short item is looked up with its values, so copies with other values are asked of WINDOW tokens and more.
    asked = [(i, n) for i, n, form, changed in planted if form != "values" or n >= decontaminate.WINDOW or not changed]
    missed = [(i, n) for i, n in asked if (i, n) not in got]
    assert len(missed) <= 0.1 * len(asked), missed
    by_chance = {(i, n) for i in clean for n, text in items.items() if f" {text.lower()} " in docs[i].lower()}  # three words, say
    assert {k for k in got if k[0] in clean} <= by_chance


def test_rows_without_key_and_repeated_keys(spark):
    text = item(random.Random(3), 20)
    docs = spark.createDataFrame([(None, FILLER + text), (1, FILLER), (1, FILLER + text), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, None), (9, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7)]
