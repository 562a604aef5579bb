"""Token counts by a map-side two-tier lookup, and the encoder that token operators share.

The tokenizer drops white space and never joins pre-tokens over it, so a text's ids are the concatenation of the ids of its
chunks between [\\x20\\x09-\\x0D], and a chunk's those of its pre-tokens. A chunk is cut and encoded once per worker and then looked up.
What a worker keeps is bounded in bytes: long chunks are not kept, and a full cache forgets what was not asked for since it was last half full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import util

TABLE_SIZE = 65_536
#: So many chunks, or chunks of so many bytes of text, and so many pre-tokens a task counts before it hands its counts on.
COUNTED, COUNTED_BYTES = 1 << 18, 64 << 20
#: Bytes that a worker's cache may hold, an entry's own cost, and the longest chunk that it keeps.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 96 << 20, 180, 128
_encoders: dict = {}


def split(text: bytes | None) -> list[bytes]:
    """Chunks of a text. The tokenizer lower-cases, so case is folded first to share lookups, but not where a special token may be spelled."""
    if not text:
        return []
    return text.split() if b"<|" in text else text.lower().split()


class Bounded(dict):
    """A cache by chunk that holds at most `size` bytes: a young half, and the half before it, from which chunks asked again come back."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.held, self.old = size, 0, {}

    def keep(self, chunk: bytes, value, extra: int = 0) -> None:
        if len(chunk) <= LONGEST:
            if self.held > self.size // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + len(chunk) + extra
            self[chunk] = value


class Encoder(Bounded):
    """chunk (UTF-8 bytes) -> its ids as little-endian unsigned 32-bit bytes: a bounded cache before the library.

    A chunk of ASCII and Latin-1 letters is cut into the tokenizer's pre-tokens here and goes to its BPE model directly; any other
    goes through the whole library. Both give the same ids.
    """

    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    # Fixed value: the file's own pre-token pattern, with its letter and digit classes written out for these characters.
    PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, size: int = CACHE_BYTES):
        super().__init__(size)
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.n_ids = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.packed = [i.to_bytes(4, "little") for i in range(self.n_ids)]
        # Byte-level alphabets show a printable Latin-1 byte as itself and the others, in order, from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = {b: b if b in shown else next(others) for b in range(256)}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.keep(chunk, ids, len(ids))
        return ids

    def _known(self, text: str) -> list[int]:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(shown)]

    def pre_tokens(self, chunk: bytes) -> list[str] | None:
        """The pre-tokens of a plain chunk; None: only the library can cut it."""
        if chunk.isalpha():  # ASCII letters only
            return [chunk.decode().lower()]
        text = chunk.decode()
        return self.PRE_TOKEN.findall(text.lower()) if b"<|" not in chunk and self.PLAIN.fullmatch(text) else None

    def encode(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return b"".join([self.packed[t.id] for t in self.model.tokenize(chunk.decode().lower())])
        parts = self.pre_tokens(chunk)
        if parts is None:
            return b"".join([self.packed[i] for i in self.library.encode(chunk.decode(), add_special_tokens=False).ids])
        if len(parts) == 1:
            return b"".join([self.packed[i] for i in self._known(parts[0])])
        return b"".join([self[part.encode()] for part in parts])  # the word without its comma is often known

    def length(self, part: str) -> int:
        return len(self._known(part))


class Lengths(Bounded):
    """chunk -> number of ids: the sum over its pre-tokens, each from the broadcast table or, if it is not there, encoded."""

    def __init__(self, table: dict[str, int], encoder: Encoder, size: int = CACHE_BYTES):
        super().__init__(size)
        self.table, self.encoder = table, encoder

    def __missing__(self, chunk: bytes) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = self._counted(chunk)
        self.keep(chunk, n)
        return n

    def _counted(self, chunk: bytes) -> int:
        parts = self.encoder.pre_tokens(chunk)
        if parts is None:
            n = len(self.encoder.library.encode(chunk.decode(), add_special_tokens=False).ids)
        else:
            n = 0
            for part in parts:
                known = self.table.get(part)
                n += self.encoder.length(part) if known is None else known
        return n


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pre_tokens(tokenizer: str):
    """Partial counts of the pre-tokens of every text, of those of at most LONGEST bytes; handed on whenever COUNTED of them are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        chunks: Counter = Counter()
        parts: Counter = Counter()
        read = 0

        def cut() -> None:
            for chunk, n in chunks.items():
                for part in enc.pre_tokens(chunk) or ():
                    parts[part] += n
            chunks.clear()

        def out() -> pa.RecordBatch:
            kept = [(k, n) for k, n in parts.items() if len(k.encode()) <= LONGEST]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["part", "n"])

        for rows in batches:
            for text in rows.column("text").cast(pa.binary()).to_pylist():
                chunks.update(split(text))
                read += len(text or b"")
                if len(chunks) >= COUNTED or read >= COUNTED_BYTES:
                    cut()
                    read = 0
                    if len(parts) >= COUNTED:
                        yield out()
        cut()
        yield out()

    return run


def frequent_pre_tokens(docs: DataFrame, tokenizer: str, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens of all texts, `size` at most, by their counts in every row; of equally frequent ones all or none.

    They only decide what is broadcast, never a count. Partial counts are shuffled; the driver gets the numbers of pre-tokens that occur
    equally often (a count is one of about sqrt(2 * pre-tokens) values at most) and the table.
    """
    counts = util.cut(docs.select("text").mapInArrow(_pre_tokens(tokenizer), "part string, n long").groupBy("part").agg(F.sum("n").alias("n")))
    tied = counts.groupBy("n").agg(F.count("*").alias("parts")).toArrow().sort_by([("n", "descending")])
    fits = np.cumsum(tied.column("parts").to_numpy()) <= size
    best = []
    if fits.any():
        least = tied.column("n")[int(fits.sum()) - 1].as_py()
        best = counts.filter(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("part", "ascending")]).column("part").to_pylist()
    util.drop(counts)
    return best


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs(doc_id, text).

    Tier one is a broadcast table of the `table_size` most frequent pre-tokens at most, by exact frequency over all rows, and their
    token counts; tier two encodes the rest through each worker's cache. Texts are looked up where they lie. A null text is empty (0 bytes, 0 tokens); very long texts and chunks are
    counted whole; repeated rows and null ids are counted row by row; an empty table gives no rows; other columns are ignored.
    """
    util.prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = frequent_pre_tokens(docs, tokenizer, table_size)
    lengths = np.array([encoder(tokenizer).length(part) for part in known], np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((known, lengths.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes = shared.value
        count = Lengths(dict(zip(parts, np.frombuffer(sizes, np.int32).tolist())), encoder(tokenizer)).__getitem__
        for rows in batches:
            texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
            n_tokens = [sum(map(count, split(t))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
