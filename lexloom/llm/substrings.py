"""Substring dedup with fixed-block anchors.

A window is `width` consecutive words of one document. A word goes if a window covers it whose words also start earlier (a
smaller document, or an earlier start in the same one), judged on the input.

1. Anchors. Blocks of width/2 words that start at multiples of width/2 are the index; every rolling block is a probe. Each
   window holds a whole indexed block, so a window that occurs twice has a probe in both places that hits a common block. Probes
   travel as packed hashes by hash bucket; a bucket returns the probes whose block is indexed and occurs in two documents.
2. Extension. Around each hit the windows that contain it are hashed anew (64 bits and an independent bucket hash); a bucket keeps
   each window's first place and returns the others. Runs of such windows are the maximal exact repeats.
3. The words under returned windows are removed.

A document sends equal blocks or windows once, whatever their number in it, so a bucket receives at most one entry a document for
any hash: a passage that a third of the documents share adds one entry each, never pairs. Repeats inside a document are settled
where it is read.

Probes carry 32 bits of a hash beside its bucket; a false hit costs work in step 2, which compares windows by 64 bits, never a result.
A bucket is held by one task: the number of buckets is `spark.sql.shuffle.partitions`, to be set in proportion to the input.

Null or empty text: no words. Very long texts: scanned whole, alone in their chunk. Null doc_id: before all others. Rows that share doc_id and text are one document and get the same
result; rows that share only doc_id are ordered by a hash of the text. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textscan as ts
from lexloom.llm import util

_NULL_DOC = -(2**63)
_BLOB = "bucket int, docs binary, rows binary, counts binary, hashes binary, flags binary"
_BLOB_NAMES = ["bucket", "docs", "rows", "counts", "hashes", "flags"]


def _first_in_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first of each (row, hash), in order, and for every entry the index of its first."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ts.mix(h ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    first = np.minimum.reduceat(order, np.flatnonzero(fresh))
    lead = np.empty(len(h), np.int64)
    lead[order] = first[np.cumsum(fresh) - 1]
    return np.sort(first), lead


def _squeeze(x: np.ndarray) -> bytes:
    """Ascending or small numbers in few bytes."""
    return zlib.compress(np.diff(x, prepend=x.dtype.type(0)).tobytes(), 1)


def _widen(blob: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), kind), dtype=kind)


def _pack(keys, buckets, rows, flags, doc, row, width) -> Iterator[tuple]:
    """Blobs, one a bucket: per row its number of entries, per entry a `width`-byte hash and a flag. Entries come in row order."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 2**16 else buckets, kind="stable")
    buckets, rows, keys, flags = buckets[order], rows[order], keys[order], flags[order]
    edges = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else []
    for a, b in zip(edges, [*edges[1:], len(buckets)]):
        begins = np.flatnonzero(np.append(True, rows[a + 1 : b] != rows[a : b - 1]))
        of, counts = rows[a:b][begins], np.diff(np.append(begins, b - a))
        packed = keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        yield int(buckets[a]), _squeeze(doc[of].astype("<i8")), row[of].astype("<i4").tobytes(), _squeeze(counts.astype("<i4")), packed, np.packbits(flags[a:b]).tobytes()


class _Bucket:
    """All entries of one bucket, gathered from its blobs."""

    def __init__(self, blobs: list[dict], width: int):
        parts = [np.frombuffer(x["hashes"], np.uint8).reshape(-1, width) for x in blobs]
        raw = np.zeros((sum(map(len, parts)), 8), np.uint8)
        raw[:, :width] = np.concatenate(parts)
        self.keys = raw.view("<u8").ravel()
        self.flags = np.concatenate([np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: len(p)] for x, p in zip(blobs, parts)]).astype(bool)
        counts = np.concatenate([_widen(x["counts"], "<i4") for x in blobs]).astype(np.int64)
        self.doc = np.concatenate([_widen(x["docs"], "<i8") for x in blobs])
        self.row = np.concatenate([np.frombuffer(x["rows"], "<i4") for x in blobs])
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.rank = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)  # of an entry in its document's part

    def answers(self, chosen: np.ndarray, bucket: int, lanes: int) -> Iterator[tuple]:
        """One blob a lane of documents: doc, row, and how many ranks each; the ranks."""
        at = np.flatnonzero(chosen)
        owner = self.owner[at]
        lane = (ts.mix(self.doc[owner].view(np.uint64) ^ (self.row[owner].astype(np.uint64) << np.uint64(32))) % np.uint64(lanes)).astype(np.int64)
        order = np.argsort(lane, kind="stable")
        at, owner, lane = at[order], owner[order], lane[order]
        edges = np.flatnonzero(np.append(True, lane[1:] != lane[:-1])) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)]):
            begins = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
            who = owner[a:b][begins]
            yield int(lane[a]), bucket, _squeeze(self.doc[who]), self.row[who].tobytes(), _squeeze(np.diff(np.append(begins, b - a)).astype("<i4")), self.rank[at[a:b]].astype("<u4").tobytes()


def _hit(entries: _Bucket) -> np.ndarray:
    """Entries whose block is indexed somewhere and occurs in two documents."""
    order = np.argsort(entries.keys)
    keys = entries.keys[order]
    fresh = np.append(True, keys[1:] != keys[:-1])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(keys)))
    good = (sizes > 1) & np.logical_or.reduceat(entries.flags[order], starts)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(good, sizes)
    return out


def _later(entries: _Bucket) -> np.ndarray:
    """Entries whose window also stands in an earlier document. Equal (doc, row) are one document and stay together."""
    rank = np.empty(len(entries.doc), np.int64)
    by = np.lexsort((entries.row, entries.doc))
    fresh = np.append(True, (np.diff(entries.doc[by]) != 0) | (np.diff(entries.row[by]) != 0))
    rank[by] = np.cumsum(fresh)
    place = rank[entries.owner]
    order = np.lexsort((place, entries.keys))
    keys, place = entries.keys[order], place[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lowest = np.repeat(place[starts], np.diff(np.append(starts, len(keys))))
    out = np.zeros(len(keys), bool)
    out[order] = place > lowest
    return out


_ANSWER_NAMES = ["lane", "bucket", "docs", "rows", "counts", "ranks"]
_ANSWER_SCHEMA = pa.schema([("lane", pa.int32()), ("bucket", pa.int32())] + [(n, pa.binary()) for n in _ANSWER_NAMES[2:]])


def _resolve(rule, width: int, lanes: int):
    """Blobs sorted by bucket -> the chosen entries of each bucket, one blob a lane: as many rows as buckets times lanes at most."""

    def settle(blobs: list[dict]) -> Iterator[pa.RecordBatch]:
        entries, bucket = _Bucket(blobs, width), blobs[0]["bucket"]
        found = list(zip(*entries.answers(rule(entries), bucket, lanes)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, _ANSWER_SCHEMA)], schema=_ANSWER_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for rows in batches:
            for blob in rows.to_pylist():
                if held and held[0]["bucket"] != blob["bucket"]:
                    yield from settle(held)
                    held = []
                held.append(blob)
        if held:
            yield from settle(held)

    return run


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answer blobs sorted by lane -> doc, row and all its (bucket, rank) pairs, packed."""

    def settle(blobs: list[dict]) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([_widen(x["counts"], "<i4") for x in blobs]).astype(np.int64)
        doc = np.repeat(np.concatenate([_widen(x["docs"], "<i8") for x in blobs]), counts)
        row = np.repeat(np.concatenate([np.frombuffer(x["rows"], "<i4") for x in blobs]), counts)
        ranks = np.concatenate([np.frombuffer(x["ranks"], "<u4") for x in blobs])
        bucket = np.repeat(np.array([x["bucket"] for x in blobs], "<u4"), [len(x["ranks"]) // 4 for x in blobs])
        order = np.lexsort((ranks, bucket, row, doc))
        doc, row, pairs = doc[order], row[order], np.stack([bucket[order], ranks[order]], 1)
        edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
        raw, ends = pairs.tobytes(), np.append(edges[1:], len(doc))
        for a in range(0, len(edges), 4096):
            part = slice(a, a + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(doc[edges[part]]), pa.array(row[edges[part]]), pa.array([raw[8 * i : 8 * j] for i, j in zip(edges[part], ends[part])], pa.binary())], names=["doc", "row", "answers"])

    held: list[dict] = []
    for rows in batches:
        for blob in rows.to_pylist():
            if held and held[0]["lane"] != blob["lane"]:
                yield from settle(held)
                held = []
            held.append(blob)
    if held:
        yield from settle(held)


class _Blocks:
    """Rolling blocks of `width` words of some rows; `sent`: the first of each (row, hash), in the order in which buckets count them."""

    def __init__(self, h: np.ndarray, of: np.ndarray, starts_of_row: np.ndarray, width: int, n_buckets: int):
        self.at, self.h = ts.windows(h, of, width)
        self.of = of[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.sent, self.lead = _first_in_row(self.h, self.of)
        self.place = self.at - starts_of_row[self.of] if len(self.at) else self.at
        self.bucket = ((self.h >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)


def _probes(half: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in ts.chunks(rows):
                data, offsets = ts.buffers(part.column("text"))
                starts, ends, of = ts.words(data, offsets)
                x = _Blocks(ts.hashes(data, starts, ends), of, np.searchsorted(of, np.arange(part.num_rows)), half, n_buckets)
                indexed = np.zeros(len(x.h), bool)
                np.logical_or.at(indexed, x.lead[x.place % half == 0], True)
                s = x.sent
                doc, row = part.column("doc").to_numpy(), part.column("row").to_numpy()
                blobs = list(zip(*_pack(x.h[s], x.bucket[s], x.of[s], indexed[s], doc, row, 4)))
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(blobs, _BLOB_SCHEMA)], schema=_BLOB_SCHEMA)

    return run


_BLOB_SCHEMA = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in _BLOB_NAMES[1:]])


def _chosen(lists: list, bucket: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Entries (given by bucket and row, in sending order) that the buckets' answers name."""
    out = np.zeros(len(bucket), bool)
    edges = np.searchsorted(of, np.arange(n + 1))
    for k, blob in enumerate(lists):
        if blob:
            named = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
            order = np.argsort(bucket[edges[k] : edges[k + 1]], kind="stable")
            begins = np.searchsorted(bucket[edges[k] : edges[k + 1]][order], named[:, 0])
            out[edges[k] + order[begins + named[:, 1]]] = True
    return out


class _Scan:
    """Words, blocks, windows and hits of some rows, computed alike when windows are sent and when answers are read."""

    def __init__(self, part: pa.RecordBatch, width: int, n_buckets: int):
        half, self.n, self.width = width // 2, part.num_rows, width
        data, offsets = ts.buffers(part.column("text"))
        self.starts, self.ends, of = ts.words(data, offsets)
        self.begins = np.searchsorted(of, np.arange(self.n + 1))
        self.raw = data.tobytes()
        h = ts.hashes(data, self.starts, self.ends)
        blocks = _Blocks(h, of, self.begins[:-1], half, n_buckets)
        hit = np.zeros(len(blocks.h), bool)
        hit[blocks.sent] = _chosen(part.column("answers").to_pylist(), blocks.bucket[blocks.sent], blocks.of[blocks.sent], self.n)
        hit = hit[blocks.lead]
        twice = np.zeros(len(blocks.h), bool)  # blocks that the row itself holds more than once
        own = np.flatnonzero(blocks.lead != np.arange(len(blocks.h)))
        twice[own] = twice[blocks.lead[own]] = True
        # Only windows that begin with a common block can repeat: half of a repeated window is a repeated block.
        near = np.zeros(len(of) + 1, np.int64)
        near[blocks.at[hit] + 1] = 1
        near = np.cumsum(near)
        at = blocks.at[blocks.place <= (np.diff(self.begins) - width)[blocks.of]] if len(blocks.at) else blocks.at
        touched = near[at + width - half + 1] > near[at]  # a hit block starts in the window and ends in it
        again = twice[np.searchsorted(blocks.at, at)] if len(at) else touched
        at, touched = at[touched | again], touched[touched | again]
        self.at, self.key = at, ts.window_hashes(h, at, width)
        self.first, self.lead = _first_in_row(self.key, of[at])
        self.wanted = self.first[touched[self.first]]
        self.of = of[self.at[self.wanted]]
        key2 = ts.window_hashes(h, self.at[self.wanted], width, 1)
        self.bucket = (key2 % np.uint64(n_buckets)).astype(np.int64)

    def results(self, rows: list[int], later: np.ndarray | None = None) -> dict[str, list]:
        gone = np.ones(len(self.at), bool)
        gone[self.first] = False
        if later is not None:
            named = np.zeros(len(self.at), bool)
            named[self.wanted] = later
            gone |= named[self.lead]
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + self.width, -1)
        under = np.cumsum(edge)[:-1] > 0
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
        for k in rows:
            a, b = self.begins[k], self.begins[k + 1]
            left = ~under[a:b]
            kept = b" ".join([self.raw[i:j] for i, j in zip(self.starts[a:b][left].tolist(), self.ends[a:b][left].tolist())])
            out["n_words"].append(int(b - a))
            out["n_removed"].append(int(b - a - left.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append(np.flatnonzero(np.diff(np.concatenate([[0], under[a:b].astype(np.int8), [0]]))).tolist())
        return out


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>"
_EXTENDED = f"kind int, doc long, row int, packed binary, answers binary, {_RESULT}, {_BLOB}"
_RESULT_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))]
_EXTENDED_SCHEMA = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("row", pa.int32()), ("packed", pa.binary()), ("answers", pa.binary()), *_RESULT_FIELDS, *_BLOB_SCHEMA])


def _table(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        packed = util.squeeze([t.encode() for t in rows.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "doc", "row")), packed], names=["doc_id", "doc", "row", "packed"])


def _opened(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows.append_column("text", pa.array([t.decode() for t in util.unsqueeze(rows.column("packed"))], pa.string()))


def _extend(width: int, n_buckets: int):
    """Rows with the buckets' answers -> kind 0: a finished row that shares no window; kind 1: a row to finish; kind 2: a blob of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in ts.chunks(_opened(rows)):
                x = _Scan(part, width, n_buckets)
                doc, row = part.column("doc").to_numpy(), part.column("row").to_numpy()
                blobs = list(zip(*_pack(x.key[x.wanted], x.bucket, x.of, np.zeros(len(x.wanted), bool), doc, row, 8)))
                if blobs:
                    yield _table(_EXTENDED_SCHEMA, len(blobs[0]), kind=[2] * len(blobs[0]), **dict(zip(_BLOB_NAMES, blobs)))
                is_open = np.zeros(x.n, bool)
                is_open[x.of] = True
                for kind, which in ((0, np.flatnonzero(~is_open)), (1, np.flatnonzero(is_open))):
                    if len(which):
                        same = {k: part.column(k).take(pa.array(which)) for k in (("doc_id",) if kind == 0 else ("doc", "row", "packed", "answers", "doc_id"))}
                        if kind == 0:
                            same |= x.results(which.tolist())
                        yield _table(_EXTENDED_SCHEMA, len(which), kind=[kind] * len(which), **same)

    return run


def _finish(width: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in ts.chunks(_opened(rows)):
                x = _Scan(part, width, n_buckets)
                later = _chosen(part.column("later").to_pylist(), x.bucket, x.of, x.n)
                yield _table(pa.schema(_RESULT_FIELDS), x.n, doc_id=part.column("doc_id"), **x.results(list(range(x.n)), later))

    return run


def repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), spans (word positions where removed runs begin and end)."""
    spark = docs.sparkSession
    util.prepare(spark)
    n = util.partitions(spark)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NULL_DOC)).alias("doc"), F.hash(text).alias("row"), text.alias("text"))

    def asked(blobs: DataFrame, rule, bytes_each: int) -> DataFrame:
        dealt = blobs.repartition(n, "bucket").sortWithinPartitions("bucket")
        answers = dealt.mapInArrow(_resolve(rule, bytes_each, n), "lane int, bucket int, docs binary, rows binary, counts binary, ranks binary")
        return answers.repartition(n, "lane").sortWithinPartitions("lane").mapInArrow(_regroup, "doc long, row int, answers binary")

    packed = base.mapInArrow(_squeezed, "doc_id long, doc long, row int, packed binary")
    hits = util.cut(asked(base.select("doc", "row", "text").mapInArrow(_probes(width // 2, n), _BLOB), _hit, 4))
    util.release(spark)
    extended = util.cut(packed.join(hits, ["doc", "row"], "left").mapInArrow(_extend(width, n), _EXTENDED))
    util.drop(hits)
    util.release(spark)
    later = asked(extended.filter("kind = 2").select(*_BLOB_NAMES), _later, 8).withColumnRenamed("answers", "later")
    names = [k for k, _ in _RESULT_FIELDS]
    last = extended.filter("kind = 1").select("doc_id", "doc", "row", "packed", "answers").join(later, ["doc", "row"], "left")
    return extended.filter("kind = 0").select(*names).unionByName(last.mapInArrow(_finish(width, n), _RESULT))
