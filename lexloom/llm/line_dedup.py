"""Line dedup: hashes range-partitioned with a secondary sort by document and position, first occurrences streamed, bitmaps returned.

A key is a line stripped of [\\x20\\x09-\\x0D] at both ends with A-Z lower-cased. A key of at least `min_chars` code points found
in at least `min_docs` documents stays only in the largest doc_id that holds it (all its lines there).

The range partitioning is over (hash, document, position), so the rows of one very common line spread over as many partitions
as they need. A key that crosses a partition's edge is settled from at most `min_docs` witnesses per edge.

Null text: one empty line. Null doc_id: one document before all others. Rows that share a doc_id count as one document, each
keeps its own row. Very long texts: their lines are keyed like any other, their bitmap is compressed. Empty table: no rows. Keys are
compared by 128-bit XXH3. Other columns, of any name, pass through `keep_lines` untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util

BLANK = b" \t\n\x0b\x0c\r"
_OCCURRENCE = "hi long, lo long, doc long, row long, pos int"
_STREAMED = "kind int, hi long, lo long, doc long, row long, pos int"
_NULL_DOC = -(2**63)


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines whose key is long enough."""
    out = []
    for i, line in enumerate(text.lower().split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANK)
            if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
                out.append((i, key))
    return out


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found, at, pos = [], [], []
            for k, text in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    keys = line_keys(text, min_chars)
                    found += [xxhash.xxh3_128_digest(key) for _, key in keys]
                    pos += [i for i, _ in keys]
                    at += [k] * len(keys)
            h = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype(np.int64)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), rows.column("doc").take(take), rows.column("row").take(take), pa.array(pos, pa.int32())], names=["hi", "lo", "doc", "row", "pos"])

    return run


def _spans(hi: np.ndarray, lo: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of one key."""
    edges = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(hi)]))


class _Run:
    """One key's rows as they come, largest document first.

    Until `min_docs` documents are seen the rows are held, as the arrays they came in; from then on all but those of the first document
    are known to go and leave at once. `headless`: the key may have begun in the partition before, so nothing is sure here.
    """

    def __init__(self, key: tuple, min_docs: int, headless: bool):
        self.key, self.min_docs, self.headless = key, min_docs, headless
        self.docs: list[int] = []
        self.witnesses: list[list] = []
        self.held: list[list[np.ndarray]] = []

    def add(self, rows: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        doc = rows[2]
        if len(self.docs) < self.min_docs:
            fresh = np.flatnonzero(np.append(not self.docs or doc[0] != self.docs[-1], doc[1:] != doc[:-1]))[: self.min_docs - len(self.docs)]
            self.docs += doc[fresh].tolist()
            if len(fresh):
                self.witnesses.append([x[fresh] for x in rows])
        if self.headless:
            yield 1, rows
        else:
            self.held.append(rows)
            if len(self.docs) >= self.min_docs:
                yield from self._sure()

    def _sure(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        for rows in self.held:
            gone = rows[2] != self.docs[0]
            if gone.any():
                yield 0, [x[gone] for x in rows]
        self.held.clear()

    def close(self, at_edge: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
        """At a partition's edge the undecided rows and the witnesses leave, as others may settle them."""
        if at_edge:
            for rows in self.held:
                yield 1, rows
            for rows in self.witnesses:
                yield 2, rows
        self.held.clear()


def _stream(min_docs: int):
    """Over rows sorted by (hash, doc descending, row, pos): kind 0 is dropped for certain, kind 1 lies in a run at the partition's
    edge, kind 2 is a witness of such a run (its `min_docs` largest documents). Runs inside one batch are settled together."""

    def inner(now: list[np.ndarray]) -> tuple[int, list[np.ndarray]] | None:
        hi, lo, doc = now[:3]
        fresh = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
        starts, key = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        new_doc = fresh | np.append(True, doc[1:] != doc[:-1])
        gone = (np.add.reduceat(new_doc.astype(np.int64), starts)[key] >= min_docs) & (doc != doc[starts][key])
        return (0, [x[gone] for x in now]) if gone.any() else None

    def batch(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), kind, np.int32)), *map(pa.array, rows)], names=["kind", "hi", "lo", "doc", "row", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Run | None = None
        for rows in batches:
            if not rows.num_rows:
                continue
            now = [rows.column(c).to_numpy() for c in ("hi", "lo", "doc", "row", "pos")]
            spans = _spans(now[0], now[1])
            key = lambda at: (int(now[0][at]), int(now[1][at]))
            first, last = spans[0], spans[-1]
            if open_ is None or open_.key != key(0):
                if open_ is not None:
                    yield from (batch(*x) for x in open_.close(open_.headless))
                open_ = _Run(key(0), min_docs, headless=open_ is None)
            yield from (batch(*x) for x in open_.add([x[first[0] : first[1]] for x in now]))
            if first != last:
                yield from (batch(*x) for x in open_.close(open_.headless))
                if first[1] < last[0] and (found := inner([x[first[1] : last[0]] for x in now])):
                    yield batch(*found)
                open_ = _Run(key(last[0]), min_docs, headless=False)
                yield from (batch(*x) for x in open_.add([x[last[0] : last[1]] for x in now]))
        if open_ is not None:
            yield from (batch(*x) for x in open_.close(True))

    return run


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc, row, bitmap: per row of docs(doc_id, text) that loses lines, a zlib-compressed bitmap of the positions to drop."""
    util.prepare(docs.sparkSession)
    base = docs.select(F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), util.row_key(F.col("text")).alias("row"), "text")
    order = ["hi", "lo", F.desc("doc"), "row", "pos"]
    runs = base.mapInArrow(_occurrences(min_chars), _OCCURRENCE).repartitionByRange(util.partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    runs = util.cut(runs.mapInArrow(_stream(min_docs), _STREAMED))
    # At most 2 runs an edge and `min_docs` rows a run: bounded by the number of partitions.
    edges = runs.filter("kind = 2").groupBy("hi", "lo").agg(F.size(F.collect_set("doc")).alias("n"), F.max("doc").alias("top")).filter(F.col("n") >= min_docs)
    sure = runs.filter("kind = 0").select("doc", "row", "pos")
    late = runs.filter("kind = 1").join(F.broadcast(edges), ["hi", "lo"]).filter("doc < top").select("doc", "row", "pos")
    return sure.unionAll(late).groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).select("doc", "row", _bitmap()("dropped").alias("bitmap"))


def _bitmap():
    @F.pandas_udf("binary")
    def pack(positions: pd.Series) -> pd.Series:
        def one(at):
            bits = np.zeros(int(at[-1]) + 1, bool)
            bits[at] = True
            return zlib.compress(np.packbits(bits).tobytes(), 1)

        return positions.map(one)

    return pack


def positions(bitmap: bytes | None) -> set[int]:
    return set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))).tolist()) if bitmap else set()


def with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, text, box (the other columns as a struct) and bitmap (nullable) of each row; one shuffle of the texts, none where AQE
    finds the bitmaps small."""
    maps = dropped_lines(docs, min_chars, min_docs)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    left = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("box"), F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), util.row_key(F.col("text")).alias("row"))
    return left.join(maps, ["doc", "row"], "left").drop("doc", "row")


def keep_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the duplicate lines gone from `text` (a null text without drops stays null); columns and their order as given."""
    joined = with_bitmaps(docs, min_chars, min_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            for k, bitmap in enumerate(rows.column("bitmap").to_pylist()):
                if bitmap:
                    gone = positions(bitmap)
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in gone)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("box")], names=["doc_id", "text", "box"])

    kept = joined.mapInArrow(run, joined.drop("bitmap").schema)
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"box.`{c}`") for c in docs.columns])


def digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, dropped, sha = [], [], []
            for text, bitmap in zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("bitmap").to_pylist()):
                text = text or b""
                gone = positions(bitmap)
                n.append(text.count(b"\n") + 1)
                dropped.append(len(gone))
                if gone:
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
