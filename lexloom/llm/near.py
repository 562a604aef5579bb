"""Near copies: candidates by SimHash and by bands of minimum hashes, verified by exact Jaccard similarity of word shingles.

A text is the set of its windows of SHINGLE words, A-Z lower-cased; one of fewer words is a single shingle. Texts are linked at a
similarity of LEAST (a fraction) or more, and a group is all that links reach. Texts of equal words are one row. The others are
candidates in two ways. First, each has a 64-bit SimHash fingerprint of its shingles, and `simhash.links` joins the fingerprints on
BLOCKS - BITS of BLOCKS blocks and gives links that connect all within BITS bits: a band each. Blocks that still select reach no
further, and at 0.8 two fingerprints differ by about 10 bits; so, second, texts share a band where one of BANDS groups of ROWS minimum
hashes is equal: at 0.8 a pair shares none with a chance of (1 - 0.8**5)**32, about 3 in a million, and less above. A set of up to
LARGE candidates that bands connect meets in one task, which compares all its pairs not yet linked whose hashes agree by ESTIMATE or
more (six deviations under 0.8) on their whole sets of shingles.

A larger set is taken apart first, in up to ROUNDS rounds: each band's members are compared with one leader of the band, the text that
shares most bands with others, while they stream past it in lanes, so that no task holds more than two texts. Then a leader has met all
its band and leaves it, and so do bands whose members are all linked. What the bands left still connect is small enough for one task,
or goes to the next round. After the last one, a band is dealt into blocks of about BLOCK members, and each two of them meet in a task.
No pair of a band is left out unless its texts are linked already.

Null or empty text, or one without words: one group of its own. Null doc_id: never the smallest. Repeated rows are equal members of
a group. Empty table: no rows. Other columns are kept. Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import simhash, util
from lexloom.llm import textscan as ts
from lexloom.llm.components import stars
from lexloom.llm.lm import words_of

SHINGLE, LEAST, ROWS, BANDS, ESTIMATE = 5, (4, 5), 5, 32, 0.6
#: Four bits: 35 choices of three of seven blocks, 27 bits that must agree.
BLOCKS, BITS = 7, 4
#: One task holds LARGE texts' shingle hashes (8 bytes a word) and compares them in seconds; taking a set apart costs dozens of jobs a round.
LARGE, ROUNDS, BLOCK = 4096, 4, 64
_RNG = np.random.default_rng(7)
_TIMES, _FOLD = (_RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (ROWS * BANDS, ROWS))


def shingles(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each text's words (0: none), the shingle hashes of all texts, and where each text's begin (one more at the end)."""
    h, of = words_of(part)
    h = h.view(np.uint64)
    n = part.num_rows
    edges = np.searchsorted(of, np.arange(n + 1))
    sizes = np.diff(edges)
    whole = ts.window_hashes(h, edges[:-1], sizes) if len(h) else np.zeros(n, np.uint64)
    first, wide = ts.windows(h, of, SHINGLE)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    rows = np.concatenate([of[first], short])
    order = np.argsort(rows, kind="stable")
    return np.where(sizes > 0, whole, np.uint64(0)), np.concatenate([wide, whole[short]])[order], np.searchsorted(rows[order], np.arange(n + 1))


def minima(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """ROWS * BANDS minimum hashes of each text that has shingles; all ones of one that has none."""
    out = np.full((len(edges) - 1, len(_TIMES)), 2**64 - 1, np.uint64)
    used = np.flatnonzero(np.diff(edges))
    if len(used):
        for k, times in enumerate(_TIMES):
            out[used, k] = np.minimum.reduceat(h * times, edges[:-1][used])
    return out


def fingerprints(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each text's set of shingles."""
    return np.array([simhash.majority(np.unique(h[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], np.uint64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tags = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for part in ts.chunks(batch):
            key, h, edges = shingles(part)
            bands = ts.mix((minima(h, edges).reshape(-1, BANDS, ROWS) * _FOLD).sum(2, dtype=np.uint64) + tags)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            texts = util.squeeze([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(key.view(np.int64)), pa.array(fingerprints(h, edges).view(np.int64)), bands, texts], names=["doc_id", "row", "key", "fp", "bands", "packed"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of LEAST or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    up, down = LEAST
    if len(small) * down < len(large) * up:
        return False
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return common * down >= (len(a) + len(b) - common) * up


def grouped(sets: list[np.ndarray], hashes: np.ndarray, known: list[int]) -> np.ndarray:
    """The first member of each set's group; sets of equal `known` are linked already."""
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    root = first[of]
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        for j in others[(hashes[others] == hashes[i]).mean(1) >= ESTIMATE].tolist():
            if root[i] != root[j] and alike(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root[root == b] = a
    return root


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their shingle hashes and where each row's begin."""
    for batch in batches:
        texts = pa.array([t.decode() for t in util.unsqueeze(batch.column("packed"))], pa.string())
        for part in ts.chunks(batch.append_column("text", texts)):
            yield part, *shingles(part)[1:]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (candidates, key): key and the least key of its group, one set of candidates after another."""

    def flush(keys: list[int], known: list[int], sets: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        found = np.array(keys, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(found[grouped(sets, np.array(hashes), known)])], names=["key", "root"])

    now, held = None, ([], [], [], [])
    for part, h, edges in _sets(batches):
        least = minima(h, edges).astype(np.uint16)
        for k, (of, key, known) in enumerate(zip(*(part.column(c).to_pylist() for c in ("candidates", "key", "known")))):
            if of != now:
                if held[0]:
                    yield flush(*held)
                now, held = of, ([], [], [], [])
            if not held[0] or held[0][-1] != key:  # a row repeated whole comes again
                for x, value in zip(held, (key, known, np.unique(h[edges[k] : edges[k + 1]]), least[k].copy())):
                    x.append(value)
    if held[0]:
        yield flush(*held)


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (leader, lane, member), a lane's leader before its members: the links between them."""
    leader = None
    for part, h, edges in _sets(batches):
        linked = []
        for k, (of, member) in enumerate(zip(part.column("leader").to_pylist(), part.column("member").to_pylist())):
            own = np.unique(h[edges[k] : edges[k + 1]])
            if not member:
                leader = own
            elif alike(leader, own):
                linked.append((part.column("key")[k].as_py(), of))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _led(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs(leader, key) that are alike. A leader's members are dealt into lanes, each with a copy of the leader's text."""
    n = util.partitions(pairs.sparkSession)
    lanes = pairs.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(n)))
    members = lanes.join(texts, "key").select("leader", "lane", F.lit(True).alias("member"), "key", "packed")
    leaders = lanes.select("leader", "lane", F.lit(False).alias("member"), F.col("leader").alias("key")).distinct().join(texts, "key").select("leader", "lane", "member", "key", "packed")
    return members.unionByName(leaders).repartition(n, "leader", "lane").sortWithinPartitions("leader", "lane", "member").mapInArrow(_against, "a long, b long")


def by_simhash(distinct: DataFrame) -> DataFrame:
    """(band, key): the texts of distinct(key, fp) with the same fingerprint share a band, and those of each two that are linked."""
    keyed = distinct.filter("key <> 0").select("key", "fp")
    # By number, so that the few bytes of fingerprints are not put into one task, which would hold all their choices of blocks.
    fps = util.cut_bare(keyed.select("fp").repartition(util.partitions(distinct.sparkSession), "fp").distinct())
    pairs = util.cut_bare(simhash.links(fps, BLOCKS, BITS).distinct())
    util.drop(fps)
    ends = pairs.select(F.xxhash64(F.lit("simhash"), "a", "b").alias("band"), F.explode(F.array("a", "b")).alias("fp"))
    return keyed.select(F.xxhash64(F.lit("simhash"), "fp").alias("band"), "key").unionByName(ends.join(keyed, "fp").select("band", "key"))


def _connected(banded: DataFrame) -> DataFrame:
    """(key, candidates): each member of banded(band, key) that shares a band with another, and the least key that bands reach."""
    first = util.cut_bare(banded.groupBy("band").agg(F.min("key").alias("b"), F.count("*").alias("n")).filter("n > 1"))
    star = stars(banded.join(first, "band").select(F.col("key").alias("a"), "b"))
    util.drop(first)
    return star.select(F.col("a").alias("key"), F.col("b").alias("candidates")).unionByName(star.select(F.col("b").alias("key"), F.col("b").alias("candidates")).distinct())


def _by_size(candidates: DataFrame, large: int) -> tuple[DataFrame, DataFrame]:
    """The members of sets of up to `large`, and those of larger ones."""
    sizes = util.cut_bare(candidates.groupBy("candidates").count())
    of = lambda which: candidates.join(sizes.filter(which).select("candidates"), "candidates").select("key", "candidates")
    return of(f"count <= {large}"), of(f"count > {large}")


def _apart(banded: DataFrame, texts: DataFrame, large: int, rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Takes large sets apart. banded: (band, key) of their members, texts: (key, packed).

    (key, candidates, known): what is left to compare, in sets of bounded size, and the root that a key has so far; and (a, b): the links.
    """
    spark = banded.sparkSession
    known, links = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "a long, b long")
    left = spark.createDataFrame([], "key long, candidates long")
    rows = util.cut_bare(banded)
    for _ in range(rounds):
        # The text that shares most bands with others leads.
        sizes = util.cut_bare(rows.groupBy("band").agg(F.count("*").alias("n")))
        weights = util.cut_bare(rows.join(sizes, "band").groupBy("key").agg(F.sum("n").alias("weight")))
        rooted = util.cut_bare(rows.join(weights, "key").join(known.withColumnRenamed("a", "key"), "key", "left").select("band", "key", "weight", F.coalesce("b", "key").alias("root")))
        led = rooted.groupBy("band").agg(F.max(F.struct("weight", "key", "root")).alias("x"), F.min("root").alias("low"), F.max("root").alias("high"))
        led = util.cut_bare(led.filter("low <> high").select("band", F.col("x.key").alias("leader"), F.col("x.root").alias("leader_root")))
        open_ = util.cut_bare(rooted.join(led, "band").filter("key <> leader").select("band", "key", "root", "leader", "leader_root"))
        pairs = util.cut_bare(open_.filter("root <> leader_root").select("leader", "key").distinct())
        links = util.cut_bare(links.unionByName(_led(pairs, texts)))
        known = stars(links)
        # A leader has met its band; a band of one root needs nothing more.
        rest = open_.select("band", "key").join(known.withColumnRenamed("a", "key"), "key", "left").select("band", "key", F.coalesce("b", "key").alias("root"))
        rest = util.cut_bare(rest)
        mixed = util.cut_bare(rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band"))
        now = util.cut_bare(rest.join(mixed, "band").select("band", "key"))
        util.drop(rows, sizes, weights, rooted, led, open_, pairs, rest, mixed)
        few, many = _by_size(util.cut_bare(_connected(now)), large)
        left = util.cut_bare(left.unionByName(few))
        rows = util.cut_bare(now.join(many.select("key"), "key", "left_semi"))
        util.drop(now)
        if rows.isEmpty():
            break
    else:
        blocks = util.cut_bare(rows.groupBy("band").agg(F.ceil(F.count("*") / F.lit(block)).alias("n")))
        own = F.pmod(F.xxhash64("key"), F.col("n"))
        each = rows.join(blocks, "band").select("band", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
        left = left.unionByName(each.select("key", F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("candidates")))
    return left.join(known.withColumnRenamed("a", "key"), "key", "left").select("key", "candidates", F.coalesce("b", "key").alias("known")), links


def keep_one(docs: DataFrame, large: int = LARGE, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null last), then of the least text hash."""
    spark, names = docs.sparkSession, docs.columns
    util.prepare(spark)
    text_row = util.row_key(F.col("text")).alias("row")
    marked = util.cut(docs.select("doc_id", text_row, "text").mapInArrow(_mark, "doc_id long, row long, key long, fp long, bands array<long>, packed binary"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    distinct = util.cut(marked.groupBy("key").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    banded = distinct.filter("key <> 0").select(F.explode("bands").alias("band"), "key").unionByName(by_simhash(distinct))
    few, many = _by_size(util.cut(_connected(banded)), large)
    few, many = few.withColumn("known", F.col("key")), util.cut(many)

    def packed(wanted: DataFrame) -> DataFrame:
        return marked.join(distinct.select("key", "least").join(wanted, "key"), "key").filter(order == F.col("least")).drop("doc_id", "row", "fp", "bands", "least")

    links = None
    if not many.isEmpty():
        rest, links = _apart(banded.join(many.select("key"), "key", "left_semi"), util.cut(packed(many.select("key"))), large, rounds, block)
        few = few.unionByName(rest)
    roots = util.cut(packed(few).repartition(util.partitions(spark), "candidates").sortWithinPartitions("candidates", "key").mapInArrow(_verify, "key long, root long"))
    if links is not None:
        roots = stars(links.unionByName(roots.select(F.col("key").alias("a"), F.col("root").alias("b")))).select(F.col("a").alias("key"), F.col("b").alias("root"))
    best = distinct.select("key", "least").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("x"))
    best = util.cut(best.select(F.col("x.no_id").alias("_no_id"), F.col("x.id").alias("_id"), F.col("x.row").alias("_text")))
    boxed = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), text_row.alias("_text"))
    kept = boxed.join(best, ["_no_id", "_id", "_text"], "left_semi")
    if not marked.groupBy("doc_id", "row").count().filter("count > 1").isEmpty():  # rows repeated whole: one of them
        kept = kept.dropDuplicates(["_no_id", "_id", "_text"])
    return kept.select("_row.*")
