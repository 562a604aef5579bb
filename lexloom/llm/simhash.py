"""SimHash near-dedup with pigeonhole blocks.

A 64-bit fingerprint has a bit set if over half of the XXH64 (seed 42) values of the text's 3-word shingles have it. The bits are cut
into BLOCKS blocks; two fingerprints within `distance` bits agree on at least BLOCKS - distance whole blocks, so the rows of each
choice of so many blocks are joined on these and verified by Hamming distance. Only distinct fingerprints are joined, so a group of
copies is one row, and fingerprints that agree on the chosen blocks differ in the others only: a join group holds at most
2 ** (bits of `distance` blocks) of them by construction. Small groups compare all their members; larger ones compare through
shared neighbours at half the distance (one bit for two), which is exact for an even distance and linear in the group; an odd one
compares all pairs. A group returns links that span it, not all pairs.

Null or empty text, or one without words: fingerprint 0, linked like any other. Null doc_id: never the smallest; a component of
such rows alone has a null id. Repeated rows are equal members of a component. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util
from lexloom.llm.components import stars

SHINGLE, SEED, BLOCKS, DISTANCE = 3, 42, 6, 2
SMALL_GROUP = 48
NEIGHBOURS = 1 << 19  # held at a time for a large group; where it has more, they are made again for each share of their values
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) >= SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, *others) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and other columns of each row."""
    rows = docs.select("doc_id", "text", *others)
    kept = [c for c in rows.columns if c != "text"]
    util.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [_signed(fingerprint(t or b"")) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, "fp"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("fp", "long"))


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bits that must agree, one mask for each choice of the blocks that agree."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(bits[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _spanning(fps: np.ndarray, free: int, distance: int) -> list[tuple[int, int]]:
    """Links that connect all members of one large group that are connected by steps of `distance` bits or fewer."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    if distance % 2:
        for i in range(len(fps)):
            for j in (np.flatnonzero(_bits_set(fps[i + 1 :] ^ fps[i]) <= distance) + i + 1).tolist():
                join(i, j)
        return links
    bits = [1 << b for b in range(64) if free >> b & 1]
    flips = np.array([sum(chosen) for k in range(distance // 2 + 1) for chosen in combinations(bits, k)], np.uint64)
    shares = 1 << max(0, len(fps) * len(flips) // NEIGHBOURS).bit_length()
    rows = max(1, (1 << 16) // len(flips))
    for share in range(shares):
        near, owner = [], []
        for at in range(0, len(fps), rows):
            x = (fps[at : at + rows, None] ^ flips[None, :]).ravel()  # a and b are within `distance` bits exactly if they share one of these
            kept = np.flatnonzero((x * _ODD >> np.uint64(32)) & np.uint64(shares - 1) == share) if shares > 1 else np.arange(len(x))
            near.append(x[kept])
            owner.append((kept // len(flips) + at).astype(np.int32))
        near, owner = np.concatenate(near), np.concatenate(owner)
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        for pair in np.unique(owner[same].astype(np.int64) * len(fps) + owner[same + 1]).tolist():
            join(*divmod(pair, len(fps)))
    return links


def _link(distance: int, all_masks: list[int]):
    def flush(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        fresh = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(fp)))
        bits = fp.view(np.uint64)
        a, b = [], []
        group, size_of = np.cumsum(fresh) - 1, None
        size_of = sizes[group]
        for lag in range(1, min(SMALL_GROUP, int(sizes.max()))):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & (size_of[lag:] <= SMALL_GROUP))
            i = i[_bits_set(bits[i] ^ bits[i + lag]) <= distance]
            a.append(fp[i])
            b.append(fp[i + lag])
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            s = slice(starts[g], starts[g] + sizes[g])
            links = np.array(_spanning(bits[s], ~all_masks[int(choice[starts[g]])] & (2**64 - 1), distance), np.int64).reshape(-1, 2)
            a.append(fp[s][links[:, 0]])
            b.append(fp[s][links[:, 1]])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows in batches:
            if not rows.num_rows:
                continue
            now = [rows.column(c).to_numpy() for c in ("choice", "key", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            tail = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
            if tail and (out := flush(*[np.ascontiguousarray(x[:tail]) for x in now])) is not None:
                yield out
            held = [x[tail:] for x in now]
        if held is not None and (out := flush(*[np.ascontiguousarray(x) for x in held])) is not None:
            yield out

    return run


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of fingerprints within `distance` bits: enough of them to connect all that are connected."""
    chosen = masks(blocks, distance)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(chosen)]))
    keyed = distinct.select("fp", rows.alias("x")).select("x.choice", "x.key", "fp")
    dealt = keyed.repartition(util.partitions(distinct.sparkSession), "choice", "key").sortWithinPartitions("choice", "key", "fp")
    return dealt.mapInArrow(_link(distance, chosen), "a long, b long")


def components(docs: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) of each row."""
    marked = util.cut(fingerprints(docs))
    distinct = util.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = stars(links(distinct, blocks, distance))
    rooted = util.cut(distinct.join(star, distinct.fp == star.a, "left").select("fp", "least", F.coalesce("b", "fp").alias("root")))
    ids = util.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = util.cut(rooted.join(ids, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
