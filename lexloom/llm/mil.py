"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is described by PASSAGE_FEATURES rates and by the shares of its words, A-Z
lower-cased, in HASHED buckets of a hash (the words' learned part: each bucket has weights of its own), and encoded by a learned tanh
layer; gated attention weighs the encodings and a logistic unit scores their weighted mean. All weights are learned together from document
labels. No label, language, source or id is an input.

Fitting takes at most SAMPLE labelled rows (the least by a hash of the id, so the same at every run), which bounds what the driver
holds by SAMPLE texts' features; everything is scored.

Null or empty text: one empty passage. Null doc_id: not held out, never a training row. A doc_id with several labels takes the
smallest; rows that repeat a labelled id train too, within SAMPLE. Very long texts: all their passages. Equal texts: equal scores. Without labelled rows every score is 0.5. Empty table: no rows. Other columns
pass through `scored` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import textscan as ts
from lexloom.llm import util

PASSAGE = 64
PASSAGE_FEATURES = ("size", "word_length", "symbols", "caps", "exclamations", "stutters", "distinct", "digits", "other_bytes", "stops", "repeats", "breaks", "capitals", "long_words")
HASHED, WORD_DECAY = 24, 0.3
WIDTH = len(PASSAGE_FEATURES) + HASHED
SAMPLE = 6_000
ENCODED, GATE = 16, 8


def held_out(doc_id, parts: int = 3, part: int = 1):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


_TABLES = {"symbols": _flags(b"#*$%&|<>=_{}[]\\^~"), "digits": _flags(b"0123456789"), "other_bytes": _flags(bytes(range(128, 256))), "stops": _flags(b".,;:?")}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and the row of it; every row has one at least."""
    n = len(offsets) - 1
    starts, ends, of = ts.words(data, offsets)
    count = np.bincount(of, minlength=n)
    per_row = np.maximum(1, -(-count // PASSAGE))
    base = np.cumsum(per_row) - per_row
    at = base[of] + (np.arange(len(of)) - (np.cumsum(count) - count)[of]) // PASSAGE
    total = int(per_row.sum())
    size = np.bincount(at, minlength=total).astype(np.float64)
    each = lambda w: np.bincount(at, w, total) / np.maximum(size, 1)
    inside = lambda table: (c := np.concatenate([[0.0], np.cumsum(table[data])]))[ends] - c[starts]
    h = ts.hashes(data, starts, ends)
    upper, lower = inside(_UPPER), inside(_LOWER)
    again = np.zeros(len(of))
    if len(of):
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    first, grams = ts.windows(h, of, 5)
    repeated = np.zeros(len(of))
    repeated[first[ts.repeated(ts.mix(grams ^ (of[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]] = 1
    once = np.unique(ts.mix(h ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    length = (ends - starts).astype(np.float64)
    gap = np.ones(len(of))
    if len(of):
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        gap[1:] = np.minimum(breaks[starts[1:]] - breaks[ends[:-1]], 3)
    columns = {
        "size": np.log1p(size),
        "word_length": each(length) / 8,
        "caps": each((upper >= 2) & (lower == 0)),
        "exclamations": each(data[ends - 1] == 33) if len(ends) else np.zeros(total),
        "stutters": each(again),
        "distinct": np.bincount(at[once], minlength=total) / np.maximum(size, 1),
        "repeats": each(repeated),
        "breaks": each(gap),
        "capitals": each(upper > 0),
        "long_words": each(length > 24),
    } | {k: np.minimum(each(inside(t)), 8) for k, t in _TABLES.items()}
    low = ts.hashes(_FOLD[data], starts, ends) if len(data) else h
    hashed = np.bincount(at * HASHED + (low >> np.uint64(33)).astype(np.int64) % HASHED, minlength=total * HASHED).reshape(total, HASHED)
    shares = np.sqrt(hashed / np.maximum(size, 1)[:, None])
    return np.concatenate([np.stack([columns[k] for k in PASSAGE_FEATURES], 1), shares], 1), np.repeat(np.arange(n), per_row)


class Model:
    """Weights in one flat vector; forward pass and gradients over bags given by passage and bag number."""

    SHAPES = (("mean", (WIDTH,)), ("scale", (WIDTH,)), ("W", (WIDTH, ENCODED)), ("b", (ENCODED,)), ("V", (ENCODED, GATE)), ("U", (ENCODED, GATE)), ("w", (GATE,)), ("c", (ENCODED,)), ("c0", (1,)))

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        edges = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        z = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp(np.clip((t * g) @ p["w"], -30, 30))
        a = e / np.repeat(np.add.reduceat(e, edges), np.diff(np.append(edges, len(bag))))
        m = np.add.reduceat(a[:, None] * h, edges)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["c0"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "m": m, "y": y, "edges": edges}

    def gradients(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, bag)
        d = (f["y"] - label) / len(label)
        of = np.repeat(np.arange(len(f["edges"])), np.diff(np.append(f["edges"], len(bag))))
        dm = d[:, None] * p["c"]
        da = (f["h"] * dm[of]).sum(1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["edges"])[of])
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dm[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["m"].T @ d, "c0": d.sum(keepdims=True)}


def train(x: np.ndarray, bag: np.ndarray, label: np.ndarray, steps: int = 400, rate: float = 0.02, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    parts = {k: rng.normal(0, 0.3, s) if k in "WVUwc" else np.zeros(s) for k, s in Model.SHAPES}
    parts["mean"], parts["scale"] = x.mean(0), x.std(0) + 1e-3
    parts["W"][-HASHED:] = 0  # words count for nothing until labels say so, and are held back: most of them say nothing
    decay = {k: np.full(s, 1e-5) for k, s in Model.SHAPES}
    decay["W"][-HASHED:] = WORD_DECAY
    model = Model(parts)
    m, v = ({k: np.zeros(s) for k, s in Model.SHAPES} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in model.gradients(x, bag, label).items():
            g = g + decay[k] * parts[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            parts[k] = parts[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most `sample` labelled, not held-out ids; None without any."""
    spark = docs.sparkSession
    util.prepare(spark)
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows, hence the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch):
                x, of = passages(*ts.buffers(part.column("text")))
                edges = np.searchsorted(of, np.arange(part.num_rows + 1))
                blobs = [x[a:b].astype("<f4").tobytes() for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "quality", "features"])

    found = rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, features binary")
    # Rows that repeat a labelled id count too: the bound holds for rows, in the order of the ids' hash.
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(sample).orderBy("doc_id", "features").toArrow()
    if not found.num_rows:
        return None
    each = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in found.column("features").to_pylist()]
    bag = np.repeat(np.arange(len(each)), [len(e) for e in each])
    return train(np.concatenate(each).astype(np.float64), bag, found.column("quality").to_numpy().astype(np.float64))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `score`, which replaces a column of that name."""
    util.prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != "score"]
    parts = None if model is None else model.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ts.chunks(batch):
                if parts is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    score = Model(parts).forward(*passages(*ts.buffers(part.column("text"))))["y"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    schema = docs.select(*names).schema.add("score", "double")
    return docs.select(*names).mapInArrow(run, schema)
