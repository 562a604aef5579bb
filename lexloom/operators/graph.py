"""The citation graph: depth-bounded walks, link groups, audited curation. edges: edge_id, source, target, relation, citation."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import tree
from lexloom.sources import session

#: Relations that hold in both directions.
SYMMETRIC = ("CONFLICTS_WITH", "SEE_ALSO")
KEY = ["source", "target", "relation"]


def directed(edges: DataFrame, direction: str = "OUTGOING") -> DataFrame:
    """Each edge as the steps it allows; a symmetric relation always allows both. Makes the recursive join an equi-join."""
    if direction not in ("OUTGOING", "INCOMING", "BOTH"):
        raise ValueError(direction)
    both = F.col("relation").isin(*SYMMETRIC)
    forward = edges.filter(F.lit(direction != "INCOMING") | both).select("edge_id", F.col("source").alias("from"), F.col("target").alias("to"), "relation", "citation", F.lit("OUTGOING").alias("step"))
    backward = edges.filter(F.lit(direction != "OUTGOING") | both).select("edge_id", F.col("target").alias("from"), F.col("source").alias("to"), "relation", "citation", F.lit("INCOMING").alias("step"))
    return forward.unionByName(backward)


def traverse(edges: DataFrame, starts: DataFrame, direction: str = "OUTGOING", depth: int = 1, relations: list[str] | None = None) -> DataFrame:
    """starts(start) -> start, edge_id, from, to, relation, citation, step, depth: walks that visit no node twice, each step once at its
    least depth, by (start, depth, relation, from, citation).

    A level joins the front of the one before on its nodes. Walks that stand at one node after the same set of nodes are one row of the
    front, so parallel edges and reordered detours do not multiply; a front is materialised once, as the next level and the result read it.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth is 1 to 4")
    steps = directed(edges, direction)
    if relations:
        steps = steps.filter(F.col("relation").isin(relations))
    front = starts.select("start", F.col("start").alias("at"), F.array("start").alias("seen")).distinct()
    found = []
    for level in range(1, depth + 1):
        walked = front.join(steps, (F.col("at") == F.col("from")) & ~F.array_contains("seen", F.col("to")))
        found.append(walked.select("start", "edge_id", "from", "to", "relation", "citation", "step", F.lit(level).alias("depth")))
        if level < depth:
            front = session.cut(walked.select("start", F.col("to").alias("at"), F.array_sort(F.array_append("seen", F.col("to"))).alias("seen")).distinct())
    every = reduce(DataFrame.unionByName, found).groupBy("start", "edge_id", "from", "to", "relation", "citation", "step").agg(F.min("depth").cast("long").alias("depth"))
    return every.orderBy("start", "depth", "relation", "from", "citation", "to")


def links(walk: DataFrame, nodes: DataFrame, limit_per_link: int = 20) -> DataFrame:
    """Steps grouped by (start, from, step, relation, citation, depth): total and the first targets by (doc_code, start_line, path).

    nodes: path, doc_code, start_line.
    """
    if not 1 <= limit_per_link <= 100:
        raise ValueError("limit_per_link is 1 to 100")
    by = ["start", "from", "step", "relation", "citation", "depth"]
    placed = walk.join(nodes.select(F.col("path").alias("to"), "doc_code", "start_line"), "to", "left")
    nth = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("doc_code", "start_line", "to")))
    first = F.collect_list(F.when(F.col("_n") <= limit_per_link, F.struct("_n", "to")))
    out = nth.groupBy(*by).agg(F.count("*").alias("total"), F.array_join(F.transform(F.sort_array(first), lambda x: x["to"].cast("string")), ",").alias("targets"))
    return out.withColumn("truncated", F.col("total") > limit_per_link)


def with_paths(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """edges(edge_id, source_id, target_id, …) with `source`, `target` and their documents. chunks: id, path, doc_code. Lost ends drop out."""
    end = lambda name: chunks.select(F.col("id").alias(f"{name}_id"), F.col("path").alias(name), F.col("doc_code").alias(f"{name}_doc"))
    return edges.join(end("source"), "source_id").join(end("target"), "target_id")


def touching(edges: DataFrame, chunks: DataFrame, doc_codes: list[str]) -> DataFrame:
    """Edges with an end in one of the documents. edges: source, target; chunks: path, doc_code."""
    inside = chunks.filter(F.col("doc_code").isin(doc_codes)).select("path", F.lit(True).alias("_in")).distinct()
    marked = edges.join(inside.withColumnsRenamed({"path": "source", "_in": "_s"}), "source", "left").join(inside.withColumnsRenamed({"path": "target", "_in": "_t"}), "target", "left")
    return marked.filter("_s or _t").select(edges.columns)


def find_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges that keys(source, target, relation) name."""
    return edges.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def insert_absent(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges, each once, that are not there yet."""
    return proposed.dropDuplicates(KEY).join(edges.select(*KEY), KEY, "left_anti")


def invalidated(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges that lost an end or whose citation no longer stands in the source's text, with the reason. chunks: path, text."""
    own, other = chunks.select(F.col("path").alias("source"), "text"), chunks.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    joined = edges.join(own, "source", "left").join(other, "target", "left")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    reason = F.when(F.col("text").isNull() | F.col("there").isNull(), "ORPHANED").when(~F.contains(plain("text"), plain("citation")), "UNGROUNDED")
    return joined.select("edge_id", *KEY, reason.alias("reason")).filter("reason is not null")


def _leaves(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(target) -> target, leaf: a target that names a container stands for all chunks under it."""
    asked = wanted.select(F.col("target").alias("query_path"))
    return tree.expand_to_leaves(chunks, asked).select(F.col("query_path").alias("target"), F.col("path").alias("leaf"))


def violations(chunks: DataFrame, proposed: DataFrame) -> DataFrame:
    """What forbids a proposal; any row refuses the whole change. A target may be a chunk or a container of chunks."""
    own = chunks.select(F.col("path").alias("source"), "text")
    leaves = _leaves(chunks, proposed).groupBy("target").agg(F.count("*").alias("_leaves"), F.max("leaf").alias("_leaf"))
    joined = proposed.join(own, "source", "left").join(leaves, "target", "left")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    code = (
        F.when(F.col("text").isNull(), "SOURCE_NOT_FOUND").when(F.col("_leaves").isNull(), "TARGET_NOT_FOUND")
        .when(~F.contains(plain("text"), plain("citation")), "UNGROUNDED_CITATION_TEXT").when((F.col("_leaves") == 1) & (F.col("_leaf") == F.col("source")), "SELF_REFERENCING_EDGE")
    )
    return joined.select(*KEY, "citation", code.alias("code")).filter("code is not null")


class Curated(NamedTuple):
    edges: DataFrame
    log: DataFrame  # action, source, target, relation, citation, actor, reason
    outcome: DataFrame  # outcome (added, existing, removed, not_found), source, target, relation


def plan_curation(edges: DataFrame, chunks: DataFrame, added: DataFrame, removed: DataFrame, reason: str) -> Curated:
    """The new edge table, its log and what became of each request, for proposals without violations.

    Removals come first. A container as target stands for the chunks under it, on both sides; a request to remove that finds no edge
    at all is reported as asked. Of proposals for one edge the least citation counts.
    """
    asked = removed.select(*KEY).distinct()
    there = asked.join(_leaves(chunks, asked), "target", "left").select(*KEY, F.coalesce("leaf", "target").alias("leaf"))
    met = there.join(edges.select("source", F.col("target").alias("leaf"), "relation", "edge_id", "citation"), ["source", "leaf", "relation"])
    gone = met.select("edge_id", "source", F.col("leaf").alias("target"), "relation", "citation").dropDuplicates(["edge_id"])
    missed = asked.join(met.select(*KEY).distinct(), KEY, "left_anti")
    left = edges.join(gone.select("edge_id"), "edge_id", "left_anti").select("edge_id", *KEY, "citation")

    wanted = added.select(*KEY, "citation").join(_leaves(chunks, added), "target").filter("leaf <> source")
    wanted = wanted.groupBy("source", F.col("leaf").alias("target"), "relation").agg(F.min("citation").alias("citation"))
    new = insert_absent(left, wanted.withColumn("edge_id", F.concat_ws(":", *KEY))).select("edge_id", *KEY, "citation")
    old = wanted.join(left.select(*KEY), KEY, "left_semi")

    log = [df.select(F.lit(action).alias("action"), *KEY, "citation", F.lit("AGENT").alias("actor"), F.lit(reason.strip()).alias("reason")) for action, df in (("REMOVED", gone), ("ADDED", new))]
    outcome = [df.select(F.lit(name).alias("outcome"), *KEY) for name, df in (("removed", gone), ("not_found", missed), ("added", new), ("existing", old))]
    return Curated(left.unionByName(new), reduce(DataFrame.unionByName, log), reduce(DataFrame.unionByName, outcome))


def curate(edges: DataFrame, chunks: DataFrame, added: DataFrame, removed: DataFrame, reason: str) -> Curated:
    """As `plan_curation`; raises, with nothing changed, if one proposal is bad. removed: source, target, relation."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    if bad := violations(chunks, added).limit(20).collect():
        raise ValueError("; ".join(f"{r.code}: {r.source} -> {r.target}" for r in bad))
    return plan_curation(edges, chunks, added, removed, reason)
