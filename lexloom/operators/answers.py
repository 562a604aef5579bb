"""Answers of a language model over found provisions: its prompt, its citations, what it claims, and a report over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompts(queries: DataFrame, hits: DataFrame, header: str) -> DataFrame:
    """qid, prompt: the header, each hit as a numbered block in rank order, the question. Queries without hits have no block.

    queries: qid, query_text. hits: qid, rank, doc_code, path, address (null: the path), effective, text (with its context).
    """
    where = F.coalesce("address", "path")
    block = F.concat(F.lit("] "), "doc_code", F.lit(" — "), where, F.lit(" (hiệu lực "), F.coalesce(F.col("effective").cast("string"), F.lit("?")), F.lit(")\n"), F.trim("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x, k: F.concat(F.lit("[#"), (k + 1).cast("string"), x["block"]))
    blocks = hits.groupBy("qid").agg(F.array_join(ordered, "\n\n").alias("blocks"))
    whole = F.concat(F.lit(header + "\n\n===== ĐIỀU KHOẢN =====\n"), F.coalesce("blocks", F.lit("")), F.lit("\n===== HẾT =====\n\nCÂU HỎI: "), F.trim("query_text"))
    return queries.join(blocks, "qid", "left").select("qid", whole.alias("prompt"))


def renumbered(answer: Column, cited: Column, shown: Column) -> Column:
    """The answer with each [#n], the n-th of the paths `cited`, as the place of that path among those `shown`; others are deleted."""
    pieces = F.split(answer, r"(?=\[#\d+\])")

    def one(piece: Column) -> Column:
        n = F.regexp_extract(piece, r"^\[#(\d+)\]", 1).try_cast("int")
        at = F.array_position(shown, F.get(cited, n - 1))
        rest = F.regexp_replace(piece, r"^\[#\d+\]", "")
        return F.when(n.isNull(), piece).when(F.coalesce(at, F.lit(0)) > 0, F.concat(F.lit("[#"), at.cast("string"), F.lit("]"), rest)).otherwise(rest)

    return F.array_join(F.transform(pieces, one), "")


def _share(flag: Column, among: Column) -> Column:
    return F.avg(F.when(among, F.coalesce(flag, F.lit(False)).cast("double")))


def report(graded: DataFrame) -> DataFrame:
    """One row over what `evaluate.grade` gives, with columns ms and cost (null where not measured), amounts and facts as asked.

    Shares are among the answers in scope but where the name says otherwise; the median is the upper one.
    """
    inside, asked = F.col("in_scope"), F.col("in_scope") & ((F.size("amounts") > 0) | (F.size("facts") > 0))
    whole = (F.size("missing_amounts") == 0) & (F.size("missing_facts") == 0)
    return graded.agg(
        F.count("*").alias("n"), F.sum(inside.cast("long")).alias("n_in_scope"), _share(F.col("correct"), inside).alias("correct"), _share(F.col("cite_article"), inside).alias("cite_article"),
        _share(F.col("cite_exact"), inside).alias("cite_exact"), _share(whole, asked).alias("whole"), F.avg(F.col("grounded").cast("double")).alias("grounded"), _share(F.col("refused"), inside).alias("wrongly_refused"),
        _share(F.col("correct"), ~inside).alias("rightly_refused"), F.expr("percentile_disc(0.5) within group (order by ms desc)").alias("median_ms"), F.max("ms").alias("max_ms"), F.sum("cost").alias("cost"), F.avg("cost").alias("mean_cost"),
    )


def by_style(graded: DataFrame) -> DataFrame:
    """style, n, correct of the answers in scope."""
    return graded.filter("in_scope").groupBy("style").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("correct"))
