"""LM scoring: a causal self-attention model on subword ids (see `attention`) and a word-unigram base, both learned from training rows.

Gathered from all training rows: counts of words, of subword ids, and of symbol pairs (the model's direct path); all are shuffled
as partial sums. Symbols are the most frequent subword ids; the others share bands of like frequency, in which an id has its
add-one share, so each text has a proper probability.

The attention weights are fitted on every window of every training row, once each, where the rows lie. Rows are dealt by the hash of
their text into ROUNDS rounds; in a round each task starts from the common weights, takes one optimizer step for each BATCH of its
windows, and the tasks' weights are averaged by their numbers of windows. A task has about TASK_WINDOWS windows or more, so small
tables are fitted by one. What travels is one set of weights a task, averaged in a tree, whatever the size of the table.

Base counts of frequent words are broadcast (at most TABLE of them, as hashes); those of the others are joined, so no worker holds
the whole vocabulary. Words are compared by 64-bit hashes.

Null or empty text: the end token alone. Null doc_id: a training row. Repeated rows each count and are each scored. Empty table: no
rows; without training rows all counts are 0 and the model is its smoothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import attention as at
from lexloom.llm import bpe
from lexloom.llm import textscan as ts
from lexloom.llm import util
from lexloom.llm.mil import held_out
from lexloom.llm.tokens import encoder

TABLE = 1 << 20
ROUNDS, RATES = 4, (0.03, 0.015, 0.008, 0.003)
BATCH, MIXED, TASK_WINDOWS = 256, 16, 250_000
BANDS = 16
_HELD = 1 << 20
_WORDS = 1 << 19  # words a slice of prepared rows; a longer text stands alone
_SLICE = 32  # symbols a slice of the pair counts
LANES = 64


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash (signed) and row of each word, A-Z lower-cased."""
    data, offsets = ts.buffers(part.column("text"))
    data = bpe.FOLD[data] if len(data) else data
    starts, ends, of = ts.words(data, offsets)
    return ts.hashes(data, starts, ends).view(np.int64), of


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, where = np.unique(keys, return_inverse=True)
    return known, np.bincount(where, n, len(known)).astype(np.int64)


def _prepare(tokenizer: str):
    """Each row's word hashes and subword ids, compressed: read and tokenized once, used by every later pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, merges, width = encoder(tokenizer), bpe.merges(tokenizer), _width(tokenizer)
        for batch in batches:
            for part in ts.chunks(batch):
                ids, words = bpe.encode(part.column("text"), enc, merges)
                packed = [util.squeeze([x.astype(kind).tobytes() for x in found]) for kind, found in (("<u8", words), (width, ids))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held", "row")), *packed], names=["doc_id", "held", "row", "packed", "ids"])

    return run


def _width(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).n_ids <= 2**16 else "<u4"


def subwords(part: pa.RecordBatch, tokenizer: str) -> list[np.ndarray]:
    width = _width(tokenizer)
    return [np.frombuffer(x, width) for x in util.unsqueeze(part.column("ids"))]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of a batch, some at a time, with the hash (signed) and the row of each word, A-Z lower-cased."""
    sizes = np.cumsum([0, *(int.from_bytes(b[:8], "little") // 8 for b in batch.column("packed").to_pylist())])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _WORDS, "right")) - 1)
        part = batch.slice(at, end - at)
        yield part, np.frombuffer(b"".join(util.unsqueeze(part.column("packed"))), "<i8"), np.repeat(np.arange(end - at), np.diff(sizes[at : end + 1]))
        at = end


def _count(tokenizer: str):
    """kind 0: word hash, 1: subword id, 2: texts."""

    def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, texts, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.zeros(0, np.int64)
        for batch in batches:
            for part, h, _ in _parts(batch):
                own, count = np.unique(h, return_counts=True)
                keys, n = _summed(np.concatenate([keys, own]), np.concatenate([n, count]))
                if len(keys) > _HELD:
                    yield out(0, keys, n)
                    keys, n = keys[:0], n[:0]
                found = np.bincount(np.concatenate(subwords(part, tokenizer)).astype(np.int64)) if part.num_rows else ids
                ids, found = (found, ids) if len(found) > len(ids) else (ids, found)
                ids = ids.copy()
                ids[: len(found)] += found
                texts += part.num_rows
        yield out(0, keys, n)
        used = np.flatnonzero(ids)
        yield out(1, used, ids[used])
        yield out(2, np.zeros(1, np.int64), np.array([texts]))

    return run


class Symbols:
    """subword id -> symbol and the log10 share of the id in its symbol."""

    def __init__(self, counts: np.ndarray):
        p = (counts + 1) / (counts.sum() + len(counts))
        order = np.argsort(-counts, kind="stable")
        single = at.SYMBOLS - BANDS - 1
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:single]] = np.arange(min(single, len(counts)))
        rest = order[single:]
        if len(rest):
            self.of[rest] = single + np.minimum(np.cumsum(p[rest]) / p[rest].sum() * BANDS, BANDS - 1).astype(np.int64)
        self.share = np.log10(p / np.bincount(self.of, p, at.SYMBOLS)[self.of])
        self.end = at.SYMBOLS - 1

    def texts(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts as end, symbols, end; and where each begins."""
        sizes = np.array([len(x) + 2 for x in ids], np.int64)
        begins = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), self.end, np.int64)
        inside = np.ones(len(out), bool)
        inside[begins] = inside[begins + sizes - 1] = False
        out[inside] = self.of[np.concatenate(ids).astype(np.int64)]
        return out, begins


def _gather(tokenizer: str, symbols):
    """Counts of neighbouring symbols, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sym, lane = np.zeros(at.SYMBOLS**2, np.int64), symbols.value, TaskContext.get().partitionId() % LANES
        for batch in batches:
            for at_row in range(0, batch.num_rows, 1024):
                seq, begins = sym.texts(subwords(batch.slice(at_row, 1024), tokenizer))
                flat = np.delete(seq[:-1] * at.SYMBOLS + seq[1:], begins[1:] - 1)
                pairs += np.bincount(flat, minlength=len(pairs))
        blobs = [zlib.compress(x.tobytes(), 1) for x in pairs.reshape(-1, _SLICE * at.SYMBOLS)]
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([lane] * n, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "lane", "data"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the pair counts of each slice that a task sees, in place."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist()):
            x = np.frombuffer(zlib.decompress(blob), np.int64)
            sums[k] = sums[k] + x if k in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["slice", "data"])


def windows(places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, valid, y, scored (see `Attention.gradients`) of all windows of texts that lie one after another; each place is scored once."""
    back, ends = at.WINDOW - at.STEP, np.append(begins[1:], len(places))
    blocks = -(-(ends - begins - 1) // at.STEP)
    text = np.repeat(np.arange(len(begins)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    spots = (begins[text] + nth * at.STEP)[:, None] + np.arange(-back, at.STEP + 1)
    good = (spots >= begins[text][:, None]) & (spots < ends[text][:, None])
    found = places.take(spots, mode="clip")
    return found[:, :-1], good[:, :-1], found[:, back + 1 :], good[:, back + 1 :]


_WEIGHTS = "lane int, n long, data binary"


def _fitted(tokenizer: str, shared, rate: float):
    """One task's share of a round: the weights after a step for each batch of its windows, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, model = shared.value
        model = model.copy()
        optimizer, rng, lane = at.Adam(model.w), np.random.default_rng(3), TaskContext.get().partitionId()
        held: list[tuple] = []
        n = 0

        def learn(last: bool) -> None:
            whole = [np.concatenate(x) for x in zip(*held)]
            order = rng.permutation(len(whole[0]))
            size = len(order) if last else len(order) // BATCH * BATCH
            for a in range(0, size, BATCH):
                i = order[a : min(a + BATCH, size)]
                optimizer.update(model.gradients(*(x.take(i, 0) for x in whole))[1], rate)
            held[:] = [tuple(x[order[size:]] for x in whole)]

        for batch in batches:
            for at_row in range(0, batch.num_rows, 256):
                seq, begins = symbols.texts(subwords(batch.slice(at_row, 256), tokenizer))
                held.append(windows(model.place[seq], begins))
                n += len(held[-1][0])
                if sum(len(x[0]) for x in held) >= MIXED * BATCH:
                    learn(False)
        if n:
            learn(True)
            yield _weights(lane % LANES, n, model.flat())

    return run


def _weights(lane: int, n: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.astype("<f4").tobytes()], pa.binary())], names=["lane", "n", "data"])


def _mean(rows: list[dict]) -> tuple[int, np.ndarray]:
    total = sum(r["n"] for r in rows)
    return total, sum(np.frombuffer(r["data"], "<f4").astype(np.float64) * (r["n"] / total) for r in rows)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lane -> one row a lane, the mean of its weights, as they come."""
    lane, n, mean = None, 0, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["lane"] != lane:
                if lane is not None:
                    yield _weights(lane, n, mean)
                lane, n, mean = r["lane"], 0, 0.0
            n += r["n"]
            mean = mean + (np.frombuffer(r["data"], "<f4").astype(np.float64) - mean) * (r["n"] / n)
    if lane is not None:
        yield _weights(lane, n, mean)


def fit(model: at.Attention, symbols: Symbols, docs: DataFrame, tokenizer: str, n_windows: int) -> at.Attention:
    """The model after all rounds over docs(row, ids), prepared training rows."""
    spark = docs.sparkSession
    docs = docs.coalesce(max(1, n_windows // TASK_WINDOWS))
    for k, rate in enumerate(RATES):
        shared = spark.sparkContext.broadcast((symbols, model))
        part = docs.filter(F.pmod(F.shiftrightunsigned("row", 32), F.lit(ROUNDS)) == k).select("ids")
        found = part.mapInArrow(_fitted(tokenizer, shared, rate), _WEIGHTS).repartition(LANES, "lane").sortWithinPartitions("lane").mapInArrow(_averaged, _WEIGHTS)
        if rows := found.toArrow().to_pylist():  # one a lane
            model = model.copy(_mean(sorted(rows, key=lambda r: r["lane"]))[1])
    return model


class Trained:
    def __init__(self, model: at.Attention, symbols: Symbols, keys: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, texts: int, whole: bool):
        self.model, self.symbols, self.keys, self.counts = model, symbols, keys, counts
        self.tokens, self.distinct, self.texts, self.whole = tokens, distinct, texts, whole


def train(docs: DataFrame, tokenizer: str, table: int = TABLE) -> tuple[Trained, DataFrame]:
    """The model and the (kind, key, n) table of training counts. docs: prepared training rows."""
    spark = docs.sparkSession
    n_ids = encoder(tokenizer).n_ids
    counted = docs.select("packed", "ids").mapInArrow(_count(tokenizer), "kind int, key long, n long")
    counts = util.cut(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    totals = {r.kind: (r.n, r.distinct) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    ids = counts.filter("kind = 1").select("key", "n").toArrow()  # at most the tokenizer's ids
    of_id = np.zeros(n_ids, np.int64)
    of_id[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    symbols = Symbols(of_id)
    texts = totals.get(2, (0, 0))[0]
    shared = spark.sparkContext.broadcast(symbols)
    gathered = util.cut(docs.select("ids").mapInArrow(_gather(tokenizer, shared), "slice int, lane int, data binary"))
    n = util.partitions(spark)
    sums = gathered.repartition(n, "slice", "lane").mapInArrow(_add, "slice int, data binary")
    sums = sums.repartition(n, "slice").mapInArrow(_add, "slice int, data binary").toArrow().to_pylist()  # one a slice
    util.drop(gathered)
    pairs = np.zeros((at.SYMBOLS // _SLICE, _SLICE * at.SYMBOLS), np.int64)
    for r in sums:
        pairs[r["slice"]] += np.frombuffer(zlib.decompress(r["data"]), np.int64)
    model = at.Attention(pairs.reshape(at.SYMBOLS, at.SYMBOLS))
    model = fit(model, symbols, docs.select("row", "ids"), tokenizer, (int(of_id.sum()) + texts) // at.STEP)
    words, distinct = totals.get(0, (0, 0))
    # The least power of two such that at most `table` words are counted so often.
    bands = counts.filter("kind = 0").groupBy(F.floor(F.log2("n")).cast("int").alias("band")).count().collect()
    least, held = 0, 0
    for r in sorted(bands, key=lambda r: -r.band):
        if held + r["count"] > table:
            least = r.band + 1
            break
        held += r["count"]
    frequent = counts.filter(f"kind = 0 and n >= {2**least}").select("key", "n").toArrow()
    keys, n_of = frequent.column("key").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(keys)
    return Trained(model, symbols, keys[order], n_of[order], words + texts, distinct + (texts > 0), texts, least == 0), counts


def _score(tokenizer: str, trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Trained = trained.value
        model, sym, scale = t.model, t.symbols, t.tokens + t.distinct + 1
        for batch in batches:
            for part, h, of in _parts(batch):
                n = part.num_rows
                one, where = bpe.distinct(h)
                distinct = h[one]
                at_ = np.minimum(np.searchsorted(t.keys, distinct), max(0, len(t.keys) - 1))
                known = t.keys[at_] == distinct if len(t.keys) else np.zeros(len(distinct), bool)
                c = np.where(known, t.counts[at_], 0) if len(t.keys) else np.zeros(len(distinct), np.int64)
                settled = known | t.whole
                gain = np.where(settled, np.log10((c + 1) / scale), 0.0)
                base = np.bincount(of, gain[where], n) + np.log10((t.texts + 1) / scale)
                n_known = np.bincount(of, known[where], n).astype(np.int64) + (t.texts > 0)
                n_tokens = np.bincount(of, minlength=n) + 1
                open_ = ~settled[where]
                edges = np.searchsorted(of[open_], np.arange(n + 1))
                rare = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[open_]))
                ids = subwords(part, tokenizer)
                seq, begins = sym.texts(ids)
                score = np.add.reduceat(model.log_probabilities(model.place[seq], begins), begins) / np.log(10) if n else np.zeros(0)
                score = score + np.array([sym.share[x.astype(np.int64)].sum() for x in ids])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), rare], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def scores(docs: DataFrame, tokenizer: str, parts: int = 7, part: int = 2, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows with crc32(doc_id) mod parts = part are held out."""
    spark = docs.sparkSession
    util.prepare(spark)
    held = held_out(F.col("doc_id"), parts, part)
    docs = docs.select("doc_id", held.alias("held"), util.row_key(F.col("text")).alias("row"), "text")
    docs = util.cut(docs.mapInArrow(_prepare(tokenizer), "doc_id long, held boolean, row long, packed binary, ids binary"))
    trained, counts = train(docs.filter("not held"), tokenizer, table)
    shared = spark.sparkContext.broadcast(trained)
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    out = docs.select("doc_id", "packed", "ids").mapInArrow(_score(tokenizer, shared), schema)
    if not trained.whole:
        out = util.cut(out.withColumn("id", F.monotonically_increasing_id()))
        rare = out.select("id", F.explode("rare").alias("key")).groupBy("id", "key").agg(F.count("*").alias("times"))
        rare = util.cut(rare)
        words = util.cut(counts.filter("kind = 0").select("key", F.col("n").alias("c")))
        c = F.coalesce("c", F.lit(0))
        found = rare.join(words, "key", "left").groupBy("id").agg(
            F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(trained.tokens + trained.distinct + 1)))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
        )
        out = out.drop("rare").join(found, "id", "left")
        out = out.withColumn("base_score", F.col("base_score") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(trained.tokens).cast("long").alias("train_tokens"), "base_score", "score")
