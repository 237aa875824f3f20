"""Links between colliding items and their connected components, as Spark joins.

Items that fall into one bucket are not paired with each other. One item leads the bucket
and is compared with the others; what it links becomes one component, and later rounds
compare only items of different components. When few such pairs are left, or a round has
not made them much fewer, they are all compared: as pairs in small buckets, in large ones as
blocks of items against blocks of items, so that no row stands for a pair. Every pair of one bucket thus ends in one component or has been compared,
unless both ends already are connected; no link between components is lost and a bucket
of n copies costs about n comparisons, not n * n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import Scratch, small_batches
from prefrank.llm.similarity import alike, links_between

MAX_ROUNDS = 4
#: The rest is compared at once when it has at most so many pairs for each member row.
REST_PAIRS = 2
#: Items in a block, and the largest bucket whose rest is compared as pairs.
BLOCK = 128
PAIRED = 32


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the smallest node it is connected with.

    Alternating star operations (Kiveris et al., 2014): each round hangs all neighbours of a
    node onto the smallest of them, until nothing changes. A hub's edges are joined with one
    row for each node, so adaptive execution can split them.
    """
    edges = scratch.save(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _fingerprint(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = scratch.save(
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        scratch.drop(edges)
        edges, now = small, _fingerprint(small)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _nearer(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Every label becomes the least of its own and its neighbours'; ``edges`` (node, via) go both ways."""
    seen = edges.join(labels.withColumnRenamed("node", "via"), "via").select("node", "root")
    return seen.union(labels).groupBy("node").agg(F.min("root").alias("root"))


def shared_buckets(members: DataFrame) -> DataFrame:
    """Rows of (bucket, node) whose bucket holds two or more nodes; rows must be distinct."""
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return members.join(several, "bucket", "left_semi")


def _block_links(scratch: Scratch, tagged: DataFrame, bodies: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links between the items outside a bucket's largest component and all its items."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    rows = tagged.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).join(bodies.withColumnRenamed("key", "node"), "node")
    fields = F.collect_list(F.struct("node", "comp", "text"))
    every = rows.groupBy("bucket", "block").agg(fields.alias("a")).select(
        "bucket", F.col("a.node").alias("n1"), F.col("a.comp").alias("c1"), F.col("a.text").alias("t1"))
    minor = rows.where("comp <> major").groupBy("bucket", "block").agg(fields.alias("a")).select(
        "bucket", F.col("a.node").alias("n2"), F.col("a.comp").alias("c2"), F.col("a.text").alias("t2"))
    compare = links_between(threshold, weighted)
    small_batches(tagged.sparkSession, 8)  # a row holds up to two blocks of whole texts
    found = scratch.save(minor.join(every, "bucket").select(
        F.inline(compare("n1", "c1", "t1", "n2", "c2", "t2"))).distinct(), "block-links")
    small_batches(tagged.sparkSession)
    return found


def bucket_components(scratch: Scratch, members: DataFrame, bodies: DataFrame, threshold: float,
                      weighted: bool = True) -> DataFrame:
    """(node, root) of all nodes that links of ``threshold`` or more connect.

    ``members``: distinct (bucket, node), saved. ``bodies``: (key, text) of every node, saved.
    ``weighted``: a link is a plain or a probability Jaccard of ``threshold``, else a plain one alone.
    """
    left = bodies.select(F.col("key").alias("u"), F.col("text").alias("left_text"))
    right = bodies.select(F.col("key").alias("v"), F.col("text").alias("right_text"))
    same = alike(threshold, weighted)

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.join(right, "v").join(left, "u").where(same("left_text", "right_text")).select("u", "v")

    spark = members.sparkSession
    kind = members.schema["node"].dataType.simpleString()
    labels = checked = links = pending = None
    state = members.withColumn("comp", F.col("node"))
    for turn in range(MAX_ROUNDS + 1):
        parts = state.groupBy("bucket", "comp").agg(
            F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("lead"))
        heads = scratch.save(parts.groupBy("bucket").agg(
            F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
            F.max(F.struct("n", "comp"))["comp"].alias("major"),
            F.min(F.struct("lead", "comp")).alias("first")).where("comps > 1").select(
            "bucket", "n", "n2", "major", F.col("first.lead.node").alias("lead"),
            F.col("first.comp").alias("lead_comp")), "heads")
        size = heads.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("n2")) / 2).alias("pairs")).first()
        if not size["n"]:
            break
        stuck = pending is not None and size["pairs"] > 0.7 * pending
        rest = turn == MAX_ROUNDS or stuck or size["pairs"] <= REST_PAIRS * size["n"]
        pending = size["pairs"]
        if rest:
            tagged = state.join(heads.select("bucket", "major", "n"), "bucket")
            large = tagged.where(F.col("n") > PAIRED)
            tagged = tagged.where(F.col("n") <= PAIRED)
            minor = tagged.where("comp <> major").select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"))
            pairs = minor.join(tagged, "bucket").where("ca <> comp and (comp = major or a < node)").select(
                "a", F.col("node").alias("b"))
        else:
            pairs = state.join(heads.select("bucket", "lead", "lead_comp"), "bucket").where("comp <> lead_comp").select(
                F.col("lead").alias("a"), F.col("node").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["u", "v"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        found = scratch.save(verify(pairs), "links")
        links = found if links is None else links.union(found)
        if rest:
            links = links.union(_block_links(scratch, large, bodies, threshold, weighted))
            break
        checked = pairs if checked is None else checked.union(pairs)
        # Two steps take the whole star of a leader to one label.
        edges = found.select(F.col("u").alias("node"), F.col("v").alias("via")).union(
            found.select(F.col("v").alias("node"), F.col("u").alias("via")))
        own = edges.select("node", F.col("node").alias("root")).distinct()
        if labels is not None:
            own = own.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        labels = scratch.save(_nearer(_nearer(own, edges), edges), "labels")
        open_rows = members.join(heads.select("bucket"), "bucket", "left_semi")
        state = scratch.save(open_rows.join(labels, "node", "left").select(
            "bucket", "node", F.coalesce("root", "node").alias("comp")), "state")
    if links is None:
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    if labels is None:
        return components(scratch, links)
    # Labels stay inside components; components of the labels that links still connect join them.
    one, two = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "uv")
    joint = links.join(one, "u", "left").join(two, "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    above = components(scratch, joint.union(labels.select(F.col("node").alias("u"), F.col("root").alias("v"))
                                            .join(labels.select(F.col("root").alias("u")).distinct(), "u", "left_semi")))
    merged = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return labels.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(
        above.join(labels.select("node"), "node", "left_anti"))
