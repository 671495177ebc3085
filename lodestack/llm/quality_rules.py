"""Operator 5: quality rules per document and per host.

Each document is measured and judged by rules; failures are summed by host; each host's failure rate of a rule is
shrunk towards an empirical beta prior fitted to all hosts. The host's verdict comes back to its documents:

* trusted: a host surely fails a rule much less than the corpus does, if its rate plus two posterior standard deviations
  is below TRUSTED times the corpus' mean. A failure there counts as a chance find (the rule's own false alarms), and the
  document stays. On every other host it goes: there the host's documents are no better than any.
* bad: if the rate less two posterior standard deviations exceeds HOST_RATE, all documents of the host go. The
  margin keeps small hosts, whose rates are mostly the prior's, from being judged by a few documents.

The base rule rejects a document whatever its host.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.tables import extended, pieces
from lodestack.runtime import materialize

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A host is rejected if its failure rate of a rule surely exceeds HOST_RATE; it is trusted below TRUSTED times the mean.
HOST_RATE, TRUSTED = 0.5, 0.5
#: Document rules whose failures are counted by host. base is the only one that rejects a document by itself.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    # A window can only be found twice if its first pair is; few texts get past this.
    pair = ids[:-1] * len(names) + ids[1:]
    order = np.sort(pair)
    if not (order[1:] == order[:-1]).any():
        return 0
    two = np.unique(pair, return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    five = four[: n] * len(names) + ids[WINDOW - 1 :]
    _, at, count = np.unique(five, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += hit
    cover[WINDOW : WINDOW + n] -= hit
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - sum(map(text.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line.strip(_SPACE):
            dup += line in seen
            seen.add(line)
    return len(words), chars, int(_SYMBOL[raw].sum()), dup, repeated_words(words), len(lines)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns with MEASURES and a boolean fail_<rule> per rule added. No shuffle. Null text: no words."""
    own = [c for c in docs.columns if c not in MEASURES and not c.startswith("fail_")]
    docs = docs.select(*[docs[c] for c in own])
    schema = extended(docs.schema, **dict.fromkeys(MEASURES, T.LongType()))

    def run(batches):
        for batch in batches:
            for rows, texts in pieces(batch, text):
                found = np.array([_measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(found[:, i].copy()) for i in range(len(MEASURES))]], names=[*own, *MEASURES])

    measured = docs.mapInArrow(run, schema)
    return measured.withColumns({f"fail_{k}": F.expr(rule) for k, rule in RULES.items()})


def host_verdicts(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host (null is a host too): documents, failures, shrunken rate and prone_<rule> per rule, host_ok.

    The prior of a rule is the beta distribution whose mean and variance match the hosts' observed rates
    (method of moments, weighted by documents, less the binomial variance); with no spread beyond binomial
    chance, all hosts get the common rate. Partial sums precede the shuffle, so a host may hold any share of rows.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("documents"), *[F.sum(F.col(f"fail_{k}").cast("long")).alias(f"failed_{k}") for k in RULES])
    moments = []
    for k in RULES:
        rate = F.col(f"failed_{k}") / F.col("documents")
        moments += [
            (F.sum(f"failed_{k}") / F.sum("documents")).alias(f"mean_{k}"),
            (F.sum(F.col("documents") * rate * rate) / F.sum("documents")).alias(f"square_{k}"),
        ]
    prior = counts.agg((F.count(F.lit(1)) / F.sum("documents")).alias("inverse_size"), *moments)
    out = counts.crossJoin(F.broadcast(prior))  # one row
    rates, habits, ok = {}, {}, F.lit(True)
    for k in RULES:
        mean, spread = F.col(f"mean_{k}"), F.col(f"square_{k}") - F.col(f"mean_{k}") * F.col(f"mean_{k}")
        chance = mean * (1 - mean)
        # spread = between + (chance - between) * inverse_size; strength = chance / between - 1
        between = (spread - chance * F.col("inverse_size")) / F.greatest(1 - F.col("inverse_size"), F.lit(1e-9))
        strength = F.least(F.greatest(chance / F.greatest(between, F.lit(1e-12)) - 1, F.lit(1e-3)), F.lit(1e9))
        size = F.col("documents") + strength
        rate = (F.col(f"failed_{k}") + mean * strength) / size
        rates[f"rate_{k}"] = rate
        doubt = 2 * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (size + 1))
        habits[f"prone_{k}"] = rate + doubt >= TRUSTED * mean
        ok = ok & (rate - doubt <= HOST_RATE)
    return out.withColumns(rates | habits).select("host", "documents", *[f"failed_{k}" for k in RULES], *rates, *habits, ok.alias("host_ok"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", carry_text: bool = True) -> DataFrame:
    """measure() with base_failed and kept added: kept is false if base_failed, else the host's verdict on it.

    Without carry_text the result lacks the text, and texts are read and measured once, the measures being
    written for both uses; with it they are measured twice, which costs less than writing all texts.

    The verdict table has a row per host. It comes back by a join on the host that Spark broadcasts only
    below its own measured threshold; beyond it a hot host is split by adaptive skew handling. Null and empty
    texts fail (no words); very long texts are measured whole; repeated rows count each; an empty table gives an
    empty table. Columns named like a measure, fail_<rule>, base_failed or kept are replaced.
    """
    docs = docs.drop("base_failed", "kept")
    measured = measure(docs, text)
    if not carry_text:
        measured = materialize(measured.drop(text), "measures")
    judged = host_verdicts(measured.select(host, *[f"fail_{k}" for k in RULES]), host)
    # Written first, so that the join is planned by the table's real size and texts aren't shuffled for a small one.
    verdicts = materialize(judged.select(F.col("host").alias("_host"), F.col("host_ok").alias("_host_ok"), *[F.col(f"prone_{k}").alias(f"_prone_{k}") for k in RULES]), "host-verdicts")
    joined = measured.join(verdicts, measured[host].eqNullSafe(verdicts["_host"]), "inner")
    kept = ~F.col("fail_base") & F.col("_host_ok")
    for k in RULES:
        kept = kept & ~(F.col(f"fail_{k}") & F.col(f"_prone_{k}"))
    return joined.select(*[measured[c] for c in measured.columns], F.col("fail_base").alias("base_failed"), kept.alias("kept"))
