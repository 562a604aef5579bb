"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Sources in code-point order (null last) carry the cycled `weights`. Their targets share the total size by weight; a target stops at
`max_epochs` times its source's size and the excess goes to the others by weight, until none is above. In closed form: with the
sources sorted by cap / weight, the level is (total - caps before) / (weights from here on) at the first source that it doesn't fill.

A document is taken floor(target / size) times whole. The rest of its source's target is filled by one more repetition of documents
in the order of a seeded digest of id and text; the document at the border gives the part that is missing, so a source takes its
rounded target exactly. The order is searched by digest prefixes (256 sums a source and level), so no source's rows meet in one task.
Rows equal in id and text share a digest. Where the border falls on them they are numbered by the partition they lie in and their
place there: the first ones are taken whole, one in part, and none after it; which of equal rows is which does not show.

One row a source is sorted in one task (tens of millions of sources are that task's limit); nothing else is.

Null text: size 0. Null source: a source of its own. Null doc_id: hashed as an empty string. Repeated rows each count. Sources of
size 0 have target 0. Very long texts: like any other. Empty table: no rows. Other columns pass through `mixed` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import util

WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


OUTPUTS = ("size", "source_size", "target", "repetitions", "partial", "taken")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """source, size, digest and, in a struct `_row`, the columns of docs but the names that mixing computes and, for narrow tables, the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.struct(*docs.columns).alias("_row"), "source", size.alias("size"), digest.alias("digest"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size)."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn("w", F.element_at(cycle, F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1)).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    before, rest, all_ = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    x = x.withColumn("total", F.sum("source_size").over(all_).cast("double"))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source, in this order, that the level of its place does not fill sets the level of all after it
    x = x.withColumn("open", F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level")))
    x = x.withColumn("final", F.first("open", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return x.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def _border(sums: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Per source the digest prefix in which its `need` is reached, and what is still needed inside it."""
    run = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    x = sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    return x.filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("size") >= F.col("need"))).select("source", *keys, level, (F.col("need") - F.col("before")).alias("need"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, repetitions (whole), partial (words of one more, incomplete, repetition) and taken.

    A column of docs with one of these names gives way to the computed one.
    """
    others = [f"_row.{c}" for c in docs.columns if c not in OUTPUTS]
    return _planned(sized(docs, seed), weights, max_epochs).select(*others, *OUTPUTS)


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id and the computed columns alone: the texts are read once, and no later step carries them."""
    table = sized(docs.select("doc_id", "text", "source"), seed).withColumn("_row", F.struct("_row.doc_id"))
    return _planned(util.cut(table), weights, max_epochs).select("_row.doc_id", *OUTPUTS)


def _planned(table: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    narrow = util.cut(table.select("source", "digest", "size", F.substring("digest", 1, 2).alias("d1"), F.substring("digest", 3, 2).alias("d2")))
    by = narrow.groupBy("source", "d1", "d2").agg(F.sum("size").alias("size"))
    by = util.cut(by)  # at most 65,536 sums a source
    sources = util.cut(targets(by.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    need = sources.select(F.col("source").alias("s"), "need").filter("need > 0")
    attach = lambda df, other, on: df.join(util.small(other), on).drop("s")
    first = attach(by.groupBy("source", "d1").agg(F.sum("size").alias("size")), need, F.col("source").eqNullSafe(F.col("s")))
    first = util.cut(_border(first, [], "d1"))
    inside = first.select(F.col("source").alias("s"), F.col("d1").alias("p1"), "need")
    second = attach(by, inside, F.col("source").eqNullSafe(F.col("s")) & (F.col("d1") == F.col("p1")))
    second = util.cut(_border(second, ["d1"], "d2"))
    inside = second.select(F.col("source").alias("s"), F.concat("d1", "d2").alias("p"), "need")
    last = attach(narrow, inside, F.col("source").eqNullSafe(F.col("s")) & (F.concat("d1", "d2") == F.col("p")))
    run = Window.partitionBy("source").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.groupBy("source", "digest", "need").agg(F.sum("size").alias("size"))
    last = last.withColumn("through", F.sum("size").over(run))
    edge = last.filter((F.col("through") >= F.col("need")) & (F.col("through") - F.col("size") < F.col("need"))).select(F.col("source").alias("s"), F.col("digest").alias("border"), (F.col("need") - F.col("through") + F.col("size")).alias("part"))
    edge = util.cut(edge)
    plan = sources.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "border", "part")
    plan = util.cut(plan)
    out = table.join(util.small(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_border = F.coalesce(F.col("digest") == F.col("border"), F.lit(False))
    whole_rest = out.filter(~at_border).withColumn("partial", F.when(F.col("digest") < F.col("border"), F.col("size")).otherwise(0).cast("long"))
    out = whole_rest.unionByName(_shared(out.filter(at_border)))
    out = out.withColumn("repetitions", F.col("whole") + F.when((F.col("partial") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    out = out.withColumn("partial", F.when(F.col("partial") == F.col("size"), F.lit(0)).otherwise(F.col("partial")).cast("long"))
    return out.withColumn("taken", F.col("repetitions") * F.col("size") + F.col("partial"))


def _shared(border: DataFrame) -> DataFrame:
    """Rows at their source's border, equal but for their columns beside id and text: `part` words go to them in turn, as `partial`."""
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    border = util.cut(border.withColumns({"_s": named, "_at": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}))
    before = Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = border.groupBy("_s", "_at").agg(F.count(F.lit(1)).alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_s", "_at").orderBy("_n")) - 1
    numbered = border.withColumn("nth", own).join(util.small(counts.drop("rows")), ["_s", "_at"])
    left = F.col("part") - (F.col("nth") + F.col("first")) * F.col("size")
    return numbered.withColumn("partial", F.greatest(F.lit(0), F.least("size", left)).cast("long")).select(*[c for c in border.columns if c not in ("_s", "_at", "_n")], "partial")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, in the columns of docs: each document as often as it is taken, a partial one cut after its last word taken."""
    x = _planned(sized(docs, options.get("seed", SEED)), options.get("weights", WEIGHTS), options.get("max_epochs", MAX_EPOCHS))
    lead = F.regexp_extract("_row.text", rf"^{BLANK}*", 0)
    words = F.split(F.substr("_row.text", F.length(lead) + 1), rf"(?<={BLANK})(?!{BLANK})")  # each word with the white space after it
    copies = F.concat(F.array_repeat(F.lit(False), F.col("repetitions").cast("int")), F.array_repeat(F.lit(True), F.when(F.col("partial") > 0, 1).otherwise(0)))
    x = x.select("_row", "partial", F.explode(copies).alias("_cut"))
    head = F.concat(lead, F.regexp_replace(F.array_join(F.slice(words, 1, F.col("partial").cast("int")), ""), rf"{BLANK}+$", ""))
    text = F.when(F.col("_cut"), head).otherwise(F.col("_row.text"))
    return x.select(*[text.alias(c) if c == "text" else f"_row.{c}" for c in docs.columns])
