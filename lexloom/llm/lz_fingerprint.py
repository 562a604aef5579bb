"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into units (words, longer ones cut every UNIT_BYTES bytes); the parse walks the units and ends a phrase at the
first unit that makes it new to the document's dictionary, as in LZ78. The set of phrases is hashed; a fingerprint holds, for
each of BINS bins, 8 bits of the smallest hash that falls into it (0: none). Two fingerprints agree in a bin about as often as
their phrase sets overlap (Jaccard), which follows how well one text's dictionary compresses the other.

Null text: empty (an all-zero fingerprint; two empty texts have likeness 1). Null doc_ids come last in the order; rows that share
a doc_id are ordered by a hash of the text; equal texts have equal fingerprints. One row is its own next. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util

BINS = 128
UNIT_BYTES = 24
_LONG = re.compile(rb"[^ \t-\r]{%d,}" % (UNIT_BYTES + 1))


def _units(text: bytes) -> list[bytes]:
    if _LONG.search(text):
        return [w[i : i + UNIT_BYTES] for w in text.split() for i in range(0, len(w), UNIT_BYTES)]
    return text.split()


def phrases(text: bytes) -> set[int]:
    """Hashes of the phrases. A phrase is its own running hash: (hash of what stands before, unit)."""
    seen: set[int] = set()
    add, at = seen.add, 0
    for h in map(hash_unit, _units(text)):
        at = (at * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        if at not in seen:
            add(at)
            at = 0
    if at:
        add(at)
    return seen


hash_unit = xxhash.xxh3_64_intdigest


def signature(found: set[int]) -> np.ndarray:
    """One byte a bin: 0 where it is empty, else 1 to 255 from the bin's smallest hash."""
    out = np.zeros(BINS, np.uint8)
    if found:
        h = np.fromiter(found, np.uint64, len(found))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = np.full(BINS, 2**64 - 1, np.uint64)
        np.minimum.at(least, (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
        used = least != np.uint64(2**64 - 1)
        out[used] = (least[used] % np.uint64(255)).astype(np.uint8) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills, less what chance alone gives."""
    used = (a > 0) | (b > 0)
    n = int(used.sum())
    if not n:
        return 1.0
    share = float((a[used] == b[used]).sum()) / n
    return max(0.0, (share - 1 / 255) / (1 - 1 / 255))


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (section, order); `lent` rows are the first of the next section and only serve as the row before's next."""
    last = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=_NAMES)
        out.clear()
        return batch

    for rows in batches:
        for doc_id, text, section, lent in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "section", "lent"))):
            text = text or ""
            mark = signature(phrases(text.encode()))
            if last is not None and last[2] == section:
                before, old = last[1], last[3]
                edit = _edited(before, text)
                raw = edit.encode()
                new = signature(phrases(raw))
                out.append((last[0], len(before), hashlib.sha256(raw).hexdigest(), old.tobytes().hex(), new.tobytes().hex(), likeness(old, new), likeness(old, mark)))
            last = None if lent else (doc_id, text, section, mark)
        if len(out) >= 256:
            yield flush()
    if out:
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: n_chars, sha of the edited text (its second half from the next document, ascending doc_id, the last takes the
    first), both fingerprints and their likeness to each other and to the next document's.

    Ids are cut into sections by quantiles of a narrow pass; the first row of each section is lent to the section before it, so
    each section is walked alone and the texts are shuffled once.
    """
    spark = docs.sparkSession
    util.prepare(spark)
    n = 4 * util.partitions(spark)
    base = docs.select("doc_id", "text")
    ids = docs.select("doc_id")
    quantiles = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)) if n > 1 else []
    bounds = np.unique(np.array([int(q) for q in quantiles], np.int64))
    last_section = len(bounds)

    @F.pandas_udf("int")
    def section(doc_id: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, doc_id.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(doc_id.isna(), last_section, at).astype(np.int32))

    order = ["section", "lent", F.col("doc_id").asc_nulls_last(), "row"]
    base = base.withColumn("section", section("doc_id").cast("int")).withColumn("row", util.row_key(F.col("text")))
    # One row a section: bounded by the number of partitions.
    heads = ids.withColumn("section", section("doc_id").cast("int")).groupBy("section").agg(F.min("doc_id").alias("head")).orderBy("section").collect()
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    to = [(heads[k].section, heads[k].head, heads[k - 1].section) for k in range(len(heads))]
    lend = F.broadcast(spark.createDataFrame(to, "of int, least long, borrower int"))
    lent = base.join(lend, (F.col("section") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "text", F.col("borrower").alias("section"), "row")
    firsts = lent.groupBy("section").agg(F.min_by(F.struct("doc_id", "text", "row"), "row").alias("x")).select("x.doc_id", "x.text", "section", F.col("x.row").alias("row"), F.lit(True).alias("lent"))
    both = base.select("doc_id", "text", "section", "row", F.lit(False).alias("lent")).unionByName(firsts)
    return both.repartition(util.partitions(spark), "section").sortWithinPartitions(*order).select("doc_id", "text", "section", "lent").mapInArrow(_walk, _SCHEMA)
