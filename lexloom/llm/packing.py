"""Best-fit packing by sum of squares.

Documents become token pieces of at most `capacity` ids (only longer documents are cut). Pieces go, longest first, to the open
bin for which the sum over gaps of (number of open bins with that gap) squared becomes smallest; a bin is opened only where none
fits, as fewest sequences are wanted. The sum changes by 1 - 2 N(g) when a bin leaves gap g and by 2 N(g - s) + 1 when it arrives
at g - s; a bin that becomes full leaves the count. Ties go to the smaller gap.

Pieces are dealt by hash of their row's number into groups of about GROUP_SEQUENCES full sequences, each packed alone; a group leaves
a bin or two partly filled. The group is a column, so where its rows lie, and in how many files they are written, is free.

Null text: empty, a single end id. Null ids and repeated rows: each row is packed, and rows are told apart by number, so equal ones
spread over the groups. Very long texts: pieces of `capacity` ids, dealt alone. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util
from lexloom.llm.tokens import encoder, split

CAPACITY = 4096
END_ID = 1
GROUP_SEQUENCES = 1024


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids) of each piece; row numbers the rows of docs. To be materialised before use."""
    util.prepare(docs.sparkSession)
    step, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer).__getitem__
        for rows in batches:
            texts = [split(t) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            out: list[list] = [[] for _ in fields]
            for doc_id, row, text in zip(rows.column("doc_id").to_pylist(), rows.column("row").to_pylist(), texts):
                raw = b"".join(map(ids, text)) + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    values = [doc_id, row, k, at // 4, len(part) // 4, zlib.crc32(part)] + [np.frombuffer(part, "<i4")] * keep_ids
                    for column, v in zip(out, values):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields)], names=[n for n, _ in fields])

    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)


class Bins:
    """Open bins of one group, counted by gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.ids: dict[int, list[int]] = {}
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of this size."""
        count, cap = self.count, self.capacity
        fits = np.flatnonzero(count[size:cap])
        if len(fits):
            arrives = 2 * count[fits] + 1
            arrives[fits == 0] = 0
            gap = int(fits[np.argmin(arrives - 2 * count[fits + size] + 1)]) + size
            number = self.ids[gap].pop()
            count[gap] -= 1
        else:
            gap, number = cap, self.opened
            self.opened += 1
        if gap > size:
            count[gap - size] += 1
            self.ids.setdefault(gap - size, []).append(number)
        return number, cap - gap


def _pack(capacity: int):
    """Rows sorted by group, longest first -> with sequence_id and offset; a group's bins live only while its rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, group = Bins(capacity), None
        for rows in batches:
            numbers, offsets = [], []
            for g, n in zip(rows.column("_group").to_pylist(), rows.column("length").to_pylist()):
                if g != group:
                    bins, group = Bins(capacity), g
                number, offset = bins.place(n)
                numbers.append((g << 40) + number)
                offsets.append(offset)
            kept = [n for n in rows.schema.names if n != "_group"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, group_sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """Pieces (narrow, materialised; no column `_group`) with sequence_id and offset."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, int(total // (capacity * group_sequences)))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "row", "piece")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(_pack(capacity), schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(util.cut(pieces(docs, tokenizer, capacity)), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array<int>) and the pieces in it: the training sequences themselves."""
    full = util.cut(pieces(docs, tokenizer, capacity, keep_ids=True))
    joined = pack(full.drop("ids"), capacity).join(full.select("row", "piece", "ids"), ["row", "piece"])
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("parts"))
    where = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset")))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), where.alias("pieces"))
