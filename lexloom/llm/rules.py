"""Quality rules as a bitmask ledger.

`measure` evaluates every rule once and stores the measurements and one failure bit per rule; `apply_policy` and `ablation`
only combine stored bits, so another policy or an ablation never reads a text again.

Null text: no words, zero measurements (base rule `too_few_words` fails). Null ids and repeated rows: row by row. Empty table:
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textscan as ts
from lexloom.llm import util

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps_words", "n_bang_words", "n_stutters")
#: Bit k of the ledger is rule k. Conditions are over the measures; all integer arithmetic.
RULES = (
    ("too_few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "n_words >= 10 and 100 * n_caps_words > 25 * n_words"),
    ("exclamations", "100 * n_bang_words > 10 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("stutter", "100 * n_stutters > 25 * n_words"),
)
#: Versioned policies: the rules that each lets decide.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = ts.words(data, offsets)
    count = lambda of, w=None: np.bincount(of, w, n).astype(np.int64)
    out = {"n_words": count(rows), "word_chars": ts.sums((data & 0xC0 != 0x80) & ~ts.SPACE[data], offsets), "n_symbols": ts.sums(_SYMBOL[data], offsets)}
    upper, lower = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_LOWER[data])])
    caps = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    out["n_caps_words"] = count(rows[caps])
    out["n_bang_words"] = count(rows[data[ends - 1] == 33]) if len(ends) else count(rows)
    of_word = ts.hashes(data, starts, ends)
    out["n_stutters"] = count(rows[1:][(of_word[1:] == of_word[:-1]) & (rows[1:] == rows[:-1])])
    first, h = ts.windows(of_word, rows, 5)
    again = first[ts.repeated(ts.mix(h ^ (rows[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    out["n_repeat_words"] = count(rows[np.cumsum(edge)[:-1] > 0])
    a, b, of = ts.lines(data, offsets)
    spoken = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, of = a[spoken], b[spoken], of[spoken]
    key = ts.mix(ts.hashes(data, a, b) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    out["n_lines"] = count(of)
    _, once = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - count(of[once])
    return out


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger: `keep` columns, every measure, and `failed_bits` (bit k set if rule k of RULES fails)."""
    util.prepare(docs.sparkSession)
    docs = docs.select(*keep, "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + [f"{m} long" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in ts.chunks(rows):
                found = _measures(*ts.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(found[m], pa.int64()) for m in MEASURES], names=[*keep, *MEASURES])

    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return docs.mapInArrow(run, schema).withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: str, into: str = "kept") -> DataFrame:
    return ledger.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that it fails, rows that only it fails (kept again without it), from the stored bits alone."""
    whole = mask(policy)
    names = [name for name, _ in RULES]
    one = F.col("failed_bits").bitwiseAND(F.lit(whole))
    aggs = [F.count("*").alias("n")]
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        aggs += [F.sum((one.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f_{r}"), F.sum((one == bit).cast("long")).alias(f"o_{r}")]
    row = ledger.agg(*aggs)
    stack = ", ".join(f"'{r}', f_{r}, o_{r}" for r in POLICIES[policy])
    return row.select("n", F.expr(f"stack({len(POLICIES[policy])}, {stack}) as (rule, n_failed, n_only)"))
