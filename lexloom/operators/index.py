"""A keyword index that is written once for a version of the chunks and read by every search.

Documents are dealt to shards by a hash of their id; shards are bounded in rows and in bytes, and number their documents in path order.
Building shuffles the texts once, one shard to a task: its syllables become numbers, one sort of (term, document) counts them, and the
lists leave packed, a block for each bucket of terms, so that nothing is exploded, aggregated or spilled by row. A block is one row
(shard, part, sub, terms, posts): its terms with their counts, and their postings one after the other, as Arrow data. Blocks are written
in folders by a hash of the term, so that a question reads the folders of its own terms only; the folder of part -1 holds the documents
as the shards number them.

A search takes the postings of the asked terms out of the blocks, sends each shard its own, scores there and returns the shard's best
rows, so no (query, document) pair is shuffled but those. Statistics (n, avgdl, df) are of the whole corpus, filtered or not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DataType, IntegerType, LongType, StructField, StructType

from lexloom.functions import text as T
from lexloom.sources import store

K1, B = 1.2, 0.75
SHARD_ROWS, SHARD_BYTES, PARTS = 16_384, 16_000_000, 16
#: Bytes of packed lists that a task gives at once, and buckets of a part at most: a bucket's terms, of all shards, meet in one task.
PACKED, SUBS = 4_000_000, 64
QUERY_BLOCK = 2_000  # queries that one job holds
#: Columns of a chunk that filters and answers need.
DOC = ("id", "path", "doc_code", "effective", "expiration", "start_line")


def part_of(term) -> "F.Column":
    """Folder of a term, from the CRCs of its one or two syllables."""
    crc = lambda k: F.coalesce(F.crc32(F.get(F.split(term, "_"), F.lit(k)).cast("binary")), F.lit(0))
    return F.pmod(crc(0) * 31 + crc(1), F.lit(PARTS)).cast("int")


def _posted(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """term * size + pos of each occurrence -> terms in order, where each one's postings start (and the end), their pos and tf."""
    keys.sort()
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    tf = np.diff(at, append=len(keys)).astype(np.int32)
    term, pos = np.divmod(keys[at], size)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    return term[starts], np.append(starts, len(term)), pos.astype(np.int32), tf


def _packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _blocks(bucket: np.ndarray, term: pa.Array, starts: np.ndarray, pos: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, terms, posts) of each bucket that has a term."""
    order = np.argsort(bucket, kind="stable")
    df, cf = np.diff(starts)[order], np.add.reduceat(tf, starts[:-1], dtype=np.int64)[order]
    ends = np.cumsum(df)
    at = np.repeat(starts[:-1][order] - (ends - df), df) + np.arange(len(pos))
    bucket, term, pos, tf = bucket[order], term.take(pa.array(order)), pos[at], tf[at]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = slice(ends[a] - df[a], ends[b - 1])
        yield int(bucket[a]), _packed(term=term.slice(a, b - a), df=pa.array(df[a:b]), cf=pa.array(cf[a:b])), _packed(pos=pa.array(pos[part]), tf=pa.array(tf[part]))


def _lists_of(table: pa.Table, subs: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One shard's rows (shard, DOC, w) -> its documents (part -1), its blocks of syllables and of adjacent pairs."""
    size, shard = table.num_rows, table.column("shard")[0].as_py()
    order = pc.sort_indices(table.select(["path", "id"]), sort_keys=[("path", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    dl = pc.list_value_length(table.column("w")).to_numpy().astype(np.int64)
    kept = table.select(DOC).take(pa.array(order))
    doc = schema.field("doc").type
    columns = {"pos": pa.array(np.arange(size)), **{c: kept.column(c).combine_chunks() for c in DOC}, "dl": pa.array(dl[order])}
    fixed = lambda n, part, sub: [pa.array(np.full(n, shard)), pa.array(part), pa.array(sub), pa.array(np.full(n, subs))]
    made = lambda *x: pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(x, schema)], schema=schema)
    yield made(*fixed(size, np.full(size, -1), np.zeros(size, int)), pa.nulls(size), pa.nulls(size), pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in doc], fields=list(doc)))
    words = pc.list_flatten(table.column("w")).combine_chunks().dictionary_encode()
    if not len(words):
        return
    known, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
    crc = np.fromiter((zlib.crc32(x.encode()) for x in known.to_pylist()), np.int64, len(known))
    pos = np.repeat(place, dl)
    term, starts, at, tf = _posted(code * size + pos, size)
    found = [(crc[term] * 31, known.take(pa.array(term)), starts, at, tf)]
    inner = np.ones(len(code), bool)
    inner[np.cumsum(dl[dl > 0]) - 1] = False  # the last word of a document opens no pair
    first = np.flatnonzero(inner)
    pair = code[first] * len(known) + code[first + 1]
    del table, words
    if len(pair):
        few = len(known) ** 2 * size < 2**63
        distinct, pair = (None, pair) if few else np.unique(pair, return_inverse=True)
        term, starts, at, tf = _posted(pair * size + pos[first], size)
        a, b = np.divmod(term if few else distinct[term], len(known))
        found.append((crc[a] * 31 + crc[b], pc.binary_join_element_wise(known.take(pa.array(a)), known.take(pa.array(b)), "_"), starts, at, tf))
    held: list[tuple[int, bytes, bytes]] = []

    def flushed() -> pa.RecordBatch:
        bucket = np.array([x[0] for x in held])
        return made(*fixed(len(held), bucket // subs, bucket % subs), pa.array([x[1] for x in held]), pa.array([x[2] for x in held]), pa.nulls(len(held)))

    for mark, *rest in found:
        for block in _blocks(mark % PARTS * subs + mark // PARTS % subs, *rest):
            held.append(block)
            if sum(len(x[1]) + len(x[2]) for x in held) >= PACKED:
                yield flushed()
                held.clear()
    if held:
        yield flushed()


def _lists(chunks: DataFrame, shards: int, subs: int) -> DataFrame:
    """Blocks and documents of chunks; the one shuffle carries the texts as they are, one shard to a task."""
    dealt = chunks.select(*DOC, "text", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).repartitionById(shards, "shard")
    rows = dealt.select("shard", *DOC, T.syllables(F.col("text")).alias("w"))
    doc = StructType([StructField("pos", IntegerType()), *(rows.schema[c] for c in DOC), StructField("dl", LongType())])
    whole = StructType([*(StructField(c, IntegerType()) for c in ("shard", "part", "sub", "subs")), StructField("terms", BinaryType()), StructField("posts", BinaryType()), StructField("doc", doc)])
    arrow = to_arrow_schema(whole)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _lists_of(pa.Table.from_batches(held), subs, arrow)

    return rows.mapInArrow(each, whole)


def _docs(lists: DataFrame) -> DataFrame:
    return lists.filter("part = -1").select("shard", "doc.pos", *(f"doc.{c}" for c in DOC), "doc.dl")


def _merged(key: tuple, blocks: pa.Table) -> pa.Table:
    """One bucket's blocks of all shards -> its terms."""
    each = pa.concat_tables([_unpacked(x) for x in blocks.column("terms")]).group_by("term", use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
    return pa.table({"part": pa.array(np.full(each.num_rows, key[0].as_py(), np.int32)), "term": each.column("term"), "df": each.column("df_sum"), "tf": each.column("cf_sum")})


def _terms(lists: DataFrame) -> DataFrame:
    by = lists.filter("part >= 0").select("part", "sub", "terms").groupBy("part", "sub").applyInArrow(_merged, "part int, term string, df long, tf long")
    return by.select("term", "df", "tf", "part").sortWithinPartitions("part", "term")


def _taken(wanted: dict[int, list[str]]):
    """Blocks -> (shard, term, pos, tf) of the wanted terms of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {part: pa.array(terms) for part, terms in wanted.items()}
        for batch in batches:
            for shard, part, terms, posts in zip(*(batch.column(c) for c in ("shard", "part", "terms", "posts"))):
                block = _unpacked(terms)
                at = np.flatnonzero(pc.is_in(block.column("term"), value_set=sets[part.as_py()]).to_numpy())
                if not len(at):
                    continue
                df = block.column("df").to_numpy()
                n, held = df[at], _unpacked(posts)
                rows = pa.array(np.repeat(np.cumsum(df)[at] - np.cumsum(n), n) + np.arange(n.sum()))
                ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                pos, tf = (pa.ListArray.from_arrays(ends, held.column(c).combine_chunks().take(rows)) for c in ("pos", "tf"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard.as_py(), np.int32)), block.column("term").combine_chunks().take(pa.array(at)), pos, tf], names=["shard", "term", "pos", "tf"])

    return run


@dataclass
class Index:
    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return store.read(self.spark, self.root, name)

    @property
    def docs(self) -> DataFrame:
        return self.table("docs")

    @property
    def lists(self) -> DataFrame:
        return self.table("lists").filter("part >= 0")

    @property
    def terms(self) -> DataFrame:
        """term, part, df, tf."""
        return self.table("terms")

    def stats(self) -> DataFrame:
        """One row: n chunks and avgdl (1 at least)."""
        return self.docs.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def _commit(spark: SparkSession, root: str, lists: DataFrame) -> Index:
    written = lambda at: spark.read.parquet(f"{at}/lists")
    store.commit(spark, root, {"lists": lists, "docs": lambda at: _docs(written(at)), "terms": lambda at: _terms(written(at))}, {"lists": "part", "terms": "part"})
    return Index(spark, root)


def build(chunks: DataFrame, root: str, shard_rows: int = SHARD_ROWS) -> Index:
    """The index of chunks, as the current version of the store at `root`."""
    spark = chunks.sparkSession
    n, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard_rows), -(-size // SHARD_BYTES))
    return _commit(spark, root, _lists(chunks, shards, min(SUBS, -(-shards // PARTS))))


def refresh(index: Index, chunks: DataFrame, changed: DataFrame) -> Index:
    """The index after changes: only shards that hold a changed id (new, altered or removed) are read and built again.

    chunks: the new state of all; changed(id). The number of shards stays; a table that has grown many times over is built anew.
    """
    spark = index.spark
    lists = index.table("lists")
    last, subs = lists.agg(F.max("shard"), F.max("subs")).first()
    shards = (last or 0) + 1
    of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    touched = [r[0] for r in changed.select(of.alias("s")).distinct().collect()]  # shard numbers
    fresh = _lists(chunks.filter(of.isin(touched)), shards, subs or 1)
    return _commit(spark, index.root, lists.filter(~F.col("shard").isin(touched)).select(fresh.columns).unionByName(fresh))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, is_pair, wants_pair: the set of a query's terms; a repeated word counts once."""
    words = queries.select("qid", F.array_distinct(T.terms(T.syllables(F.col("query_text")))).alias("t"))
    has = F.exists("t", lambda x: F.contains(x, F.lit("_")))
    return words.select("qid", has.alias("wants_pair"), F.explode("t").alias("term")).withColumn("is_pair", F.contains("term", F.lit("_")))


def term_idf(index: Index, wanted: DataFrame) -> DataFrame:
    """term, df, idf of the wanted terms, over the whole index."""
    n = index.docs.count()
    asked = wanted.select("term").distinct().withColumn("part", part_of(F.col("term")))
    return index.terms.join(asked, ["part", "term"], "left_semi").select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


_FOUND = "qid long, id long, path string, bm25 double, phrase_matched boolean"


def _scorer(plan: dict[str, tuple[float, list[int]]], qids: list[int], wants_pair: list[bool], avgdl: float, limit: int):
    """One shard's posting lists and open documents -> its best `limit` rows of each query."""

    def run(lists: pa.Table, docs: pa.Table) -> pa.Table:
        pos = docs.column("pos").to_numpy()
        size = int(pos.max()) + 1 if len(pos) else 0
        open_, norm = np.zeros(size, bool), np.ones(size)
        open_[pos], norm[pos] = True, K1 * (1 - B + B * docs.column("dl").to_numpy() / avgdl)
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for term, at, tf in zip(lists.column("term").to_pylist(), lists.column("pos"), lists.column("tf")):
            at, tf = at.values.to_numpy(), tf.values.to_numpy().astype(np.float64)
            keep = at < size
            at, tf = at[keep], tf[keep]
            keep = open_[at]
            at, tf = at[keep], tf[keep]
            if len(at):
                found[term] = at, plan[term][0] * tf * (K1 + 1) / (tf + norm[at])
        of: dict[int, list[str]] = {}
        for term in sorted(found):  # one order of addition for all documents: equal ones score alike
            for q in plan[term][1]:
                of.setdefault(q, []).append(term)
        row = np.empty(size, np.int64)
        row[pos] = np.arange(len(pos))
        out: list[list] = [[], [], [], []]
        for q, terms in sorted(of.items()):
            score, phrase = np.zeros(size), np.full(size, not wants_pair[q])
            for term in terms:
                at, weight = found[term]
                score[at] += weight
                if "_" in term:
                    phrase[at] = True
            hit = np.flatnonzero(score)
            if len(hit) > limit:
                least = np.partition(score[hit], len(hit) - limit)[len(hit) - limit]
                hit = hit[score[hit] >= least]
            best = hit[np.lexsort((hit, -score[hit]))[:limit]]  # places follow the path
            out[0].append(np.full(len(best), qids[q]))
            out[1].append(row[best])
            out[2].append(score[best])
            out[3].append(phrase[best])
        if not out[0]:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())], names=["qid", "id", "path", "bm25", "phrase_matched"])
        qid, at, score, phrase = (np.concatenate(x) for x in out)
        take = pa.array(at)
        return pa.Table.from_arrays([pa.array(qid), docs.column("id").take(take), docs.column("path").take(take), pa.array(score), pa.array(phrase)], names=["qid", "id", "path", "bm25", "phrase_matched"])

    return run


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """A stated set of queries (materialised or read from a file) in parts of about `size` rows."""
    n = queries.count()
    count = -(-n // size)
    return [queries] if count < 2 else [queries.filter(F.pmod(F.xxhash64("qid"), F.lit(count)) == k) for k in range(count)]


def bm25(index: Index, queries: DataFrame, limit: int, open_: DataFrame | None = None) -> DataFrame:
    """qid, id, path, bm25, phrase_matched, rank: the best `limit` chunks of each query, ties by path.

    open_: rows of `index.docs` that may be returned. Queries go to the shards in blocks of QUERY_BLOCK.
    """
    stats = index.stats().first()
    docs = (index.docs if open_ is None else open_).select("shard", "pos", "id", "path", "dl")
    found = []
    for part in blocks(queries):
        wanted = query_terms(part)
        asked = wanted.withColumn("part", part_of(F.col("term")))
        have = index.terms.select("part", "term", "df")
        rows = have.join(F.broadcast(asked), ["part", "term"]).toArrow()  # at most the terms of QUERY_BLOCK queries
        qids = sorted(set(rows.column("qid").to_pylist()))
        number = {q: k for k, q in enumerate(qids)}
        plan: dict[str, tuple[float, list[int]]] = {}
        wants = [False] * len(qids)
        for term, df, q, pair in zip(*(rows.column(c).to_pylist() for c in ("term", "df", "qid", "wants_pair"))):
            plan.setdefault(term, (float(np.log(1 + (stats.n - df + 0.5) / (df + 0.5))), []))[1].append(number[q])
            wants[number[q]] = pair
        of_part: dict[int, list[str]] = {}
        for term, k in set(zip(rows.column("term").to_pylist(), rows.column("part").to_pylist())):
            of_part.setdefault(k, []).append(term)
        lists = index.lists.filter(F.col("part").isin(sorted(of_part))).mapInArrow(_taken(of_part), "shard int, term string, pos array<int>, tf array<int>")
        found.append(lists.groupBy("shard").cogroup(docs.groupBy("shard")).applyInArrow(_scorer(plan, qids, wants, stats.avgdl, limit), _FOUND))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    return ranked(both, limit, F.desc("bm25"), F.asc("path"))


def ranked(df: DataFrame, limit: int, *order, name: str = "rank") -> DataFrame:
    """The first `limit` rows of each query; Spark cuts each task's rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).filter(F.col(name) <= limit)


def widened(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The frame's schema with one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])
