"""Parent-child rows to full hierarchies by heavy-path decomposition.

Rounds, not levels: every loop below doubles a reach, so a tree of depth D costs
log2(D) joins, and chains of chains cost log2(log2(n)). Each join is keyed by a
node id; a hot parent is pre-aggregated where rows are summed and left to the
adaptive skew join where they are looked up.

1. leaves are set aside (they get their answer from the parent by one join);
2. reach doubling over the inner nodes: ``anc`` is the 2**k-th ancestor, ``acc``
   the number of descendants nearer than 2**k. A round in which no node runs
   past its root proves that only nodes that lead to loops are left;
3. loops: the image of a long enough jump is exactly the nodes on loops; the
   lowest id of each becomes its head, the edge into it is cut, and step 2 runs
   again for those components alone;
4. the child with the largest subtree continues its parent's chain; doubling
   along such edges gives each node its chain and position;
5. doubling over the chain tree concatenates the chain segments, which are the
   path, and adds up depths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions.urls import url_key
from tidewrack.runtime import drop_stage, key128, stage, stage_counted

MAX_ROUNDS = 64


@dataclass
class Forest:
    """``nodes``: id, parent, root, depth, loop, chain, pos, segs, size, is_leaf - one row per node."""

    nodes: DataFrame


def link_nodes(rows: DataFrame, id_col: str, key: Column, parent_key: Column) -> DataFrame:
    """Nodes (``id``, ``parent``) of rows that name themselves and their parents by keys.

    A node is a distinct non-null key, known by its lowest id; that row's parent
    key counts. A null, empty or unknown parent key makes a root (parent null).
    Rows with a null id or key are left out.
    """
    k1, k2 = key128(key)
    parent_key = F.when(parent_key != "", parent_key)
    p1, p2 = key128(parent_key)
    firsts = (
        rows.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"))
        .where("id is not null and k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("id", "p1", "p2")).alias("m"))
        .select("k1", "k2", "m.id", "m.p1", "m.p2")
    )
    firsts = stage(firsts, "firsts")
    names = firsts.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"))
    return firsts.select("id", "p1", "p2").join(names, ["p1", "p2"], "left").select("id", "parent")


def _double(state: DataFrame) -> DataFrame:
    """(id, anc, acc) with twice the reach."""
    sums = (
        state.select("id", "acc")
        .unionAll(state.where("anc is not null").select(F.col("anc").alias("id"), "acc"))
        .groupBy("id")
        .agg(F.sum("acc").alias("acc"))
    )
    jump = state.where("anc is not null").select("id", "anc")
    further = state.where("anc is not null").select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
    jumped = jump.join(further, "anc").select("id", F.col("anc2").alias("anc"))
    return sums.join(jumped, "id", "left").select("id", "anc", "acc")


def _sizes(inner: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sizes (id, acc) below each node, and the nodes (id, anc) that never reach a root."""
    state, n = stage_counted(inner.select("id", F.col("parent").alias("anc"), "acc"), "reach", active=F.col("anc").isNotNull())
    active = n["active"]
    for _ in range(MAX_ROUNDS):
        if not active:
            return state.select("id", "acc"), None
        grown, n = stage_counted(_double(state), "reach", active=F.col("anc").isNotNull())
        left = n["active"]
        if left == active:
            return state.where("anc is null").select("id", "acc"), grown.where("anc is not null").select("id", "anc")
        drop_stage(state)
        state, active = grown, left
    raise RuntimeError("deeper than 2**64 levels")


def _loops(stuck: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, head) for nodes that run into a loop; head is the lowest id on it."""
    jump = stuck
    on = jump.select("anc").distinct().count()
    for _ in range(MAX_ROUNDS):
        further = jump.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        jump = stage(jump.join(further, "anc").select("id", F.col("anc2").alias("anc")), "jump")
        now = jump.select("anc").distinct().count()
        if now == on:
            break
        on = now
    ring = jump.select(F.col("anc").alias("id")).distinct()
    ring = stage(ring.join(inner.select("id", "parent"), "id").select("id", F.col("parent").alias("nxt"), F.col("id").alias("low")), "ring")
    for _ in range(MAX_ROUNDS):
        ahead = ring.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        grown = ring.join(ahead, "nxt").select("id", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed"))
        grown, n = stage_counted(grown, "ring", changed=F.col("changed"))
        ring = grown.select("id", "nxt", "low")
        if not n["changed"]:
            break
    lows = ring.select(F.col("id").alias("anc"), F.col("low").alias("head"))
    return stage(jump.join(lows, "anc").select("id", "head"), "heads")


def decompose(links: DataFrame) -> Forest:
    """Heavy-path decomposition of (``id``, ``parent``) rows; parent null means a root.

    A parent id that is no node makes a root as well; repeated ids keep the
    lowest parent; null ids are left out; an empty table gives an empty forest.
    Nodes that run into a loop have ``loop`` true and hang below the loop's
    lowest id, whose edge is cut.
    """
    links = links.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    links = stage(links, "links")
    kids = links.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"))
    marked = links.join(kids.withColumnRenamed("parent", "id"), "id", "left")
    marked = stage(marked.select("id", "parent", F.coalesce("kids", F.lit(0)).alias("kids")), "marked")
    inner = marked.where("kids > 0").select("id", "parent")
    known = inner.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    # An inner node whose parent is no node is a root; leaves are checked at the end.
    inner = inner.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    leaf_kids = marked.where("kids = 0 and parent is not null").groupBy("parent").agg(F.count("*").alias("leaves"))
    inner = inner.join(leaf_kids.withColumnRenamed("parent", "id"), "id", "left")
    inner = stage(inner.select("id", "parent", (F.lit(1) + F.coalesce("leaves", F.lit(0))).alias("acc")), "inner")

    sizes, stuck = _sizes(inner)
    heads = None
    if stuck is not None:
        heads = _loops(stuck, inner)
        ringed = inner.join(heads, "id").select("id", F.when(F.col("id") != F.col("head"), F.col("parent")).alias("parent"), "acc")
        more, _ = _sizes(ringed)
        sizes = sizes.unionAll(more)
        inner = inner.join(heads, "id", "left").select("id", F.when(F.col("head").isNull() | (F.col("id") != F.col("head")), F.col("parent")).alias("parent"), F.col("head"))
    else:
        inner = inner.select("id", "parent", F.lit(None).cast("bigint").alias("head"))
    inner = stage(inner.join(sizes.withColumnRenamed("acc", "size"), "id"), "sized")

    # Heavy child: the largest subtree, the lowest id among equals.
    heavy = inner.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("id"), F.lit(True).alias("heavy"))
    climb = inner.join(heavy, "id", "left").select("id", F.when(F.col("heavy"), F.col("parent")).alias("up"))
    climb, n = stage_counted(climb.select("id", "up", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("pos")), "climb", moving=F.col("up").isNotNull())
    for _ in range(MAX_ROUNDS):
        if not n["moving"]:
            break
        moving = climb.where("up is not null")
        ahead = climb.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("pos").alias("pos2"))
        moved = moving.join(ahead, "up").select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("pos") + F.col("pos2")).alias("pos"))
        grown, n = stage_counted(climb.where("up is null").unionAll(moved), "climb", moving=F.col("up").isNotNull())
        drop_stage(climb)
        climb = grown
    placed = stage(inner.join(climb.drop("up"), "id").select("id", "parent", "head", "size", F.col("top").alias("chain"), "pos"), "placed")

    # The chain tree: a chain hangs at the place of its top's parent.
    tops = placed.where("id = chain").select(F.col("id").alias("chain"), "parent", "head")
    where = placed.select(F.col("id").alias("parent"), F.col("chain").alias("over"), F.col("pos").alias("at"))
    chains = tops.join(where, "parent", "left")
    seg = F.struct(F.col("over").alias("chain"), (F.col("at") + 1).alias("len"))
    chains = chains.select("chain", "over", "head", F.when(F.col("over").isNull(), F.array().cast("array<struct<chain:bigint,len:bigint>>")).otherwise(F.array(seg)).alias("segs"), F.coalesce(F.col("at") + 1, F.lit(0)).cast("bigint").alias("base"), F.coalesce("over", "chain").alias("root"))
    chains, n = stage_counted(chains, "chains", hanging=F.col("over").isNotNull())
    for _ in range(MAX_ROUNDS):
        if not n["hanging"]:
            break
        ahead = chains.select(F.col("chain").alias("over"), F.col("over").alias("over2"), F.col("segs").alias("segs2"), F.col("base").alias("base2"), F.col("root").alias("root2"))
        stepped = chains.join(ahead, "over", "left")
        grown, n = stage_counted(
            stepped.select(
                "chain",
                F.col("over2").alias("over"),
                "head",
                F.concat(F.coalesce("segs2", F.array().cast("array<struct<chain:bigint,len:bigint>>")), "segs").alias("segs"),
                (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"),
                F.coalesce("root2", "root").alias("root"),
            ),
            "chains",
            hanging=F.col("over").isNotNull(),
        )
        drop_stage(chains)
        chains = grown

    inner_out = placed.drop("head").join(chains.select("chain", "segs", "base", "root", "head"), "chain").select("id", "parent", "root", (F.col("base") + F.col("pos")).alias("depth"), F.col("head").isNotNull().alias("loop"), "chain", "pos", "segs", "size", F.lit(False).alias("is_leaf"))
    inner_out = stage(inner_out, "hierarchy")
    above = inner_out.select(F.col("id").alias("parent"), "root", "depth", "loop", "chain", "pos", "segs")
    leaf_out = marked.where("kids = 0").select("id", "parent").join(above, "parent", "left")
    alone = F.col("root").isNull()
    leaf_out = leaf_out.select(
        "id",
        F.when(~alone, F.col("parent")).alias("parent"),
        F.coalesce("root", "id").alias("root"),
        F.coalesce(F.col("depth") + 1, F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("loop", F.lit(False)).alias("loop"),
        F.col("id").alias("chain"),
        F.lit(0).cast("bigint").alias("pos"),
        F.when(alone, F.array().cast("array<struct<chain:bigint,len:bigint>>")).otherwise(F.concat("segs", F.array(F.struct(F.col("chain").alias("chain"), (F.col("pos") + 1).alias("len"))))).alias("segs"),
        F.lit(1).cast("bigint").alias("size"),
        F.lit(True).alias("is_leaf"),
    )
    return Forest(inner_out.unionAll(leaf_out))


def roots_and_depths(forest: Forest) -> DataFrame:
    """(``id``, ``root_id``, ``depth``); depth -1 where the steps up never end."""
    n = forest.nodes
    return n.select("id", F.col("root").alias("root_id"), F.when(F.col("loop"), -1).otherwise(F.col("depth")).cast("int").alias("depth"))


BLOCK = 64


def paths(forest: Forest) -> DataFrame:
    """(``id``, ``root_id``, ``path``): ids from the root down to the node itself.

    Chains are cut into blocks of at most 64 ids, so no chain is ever gathered
    whole, however long; a node's path is the concatenation of its segments'
    blocks. Paths of nodes on or below a loop start at the loop's head.
    """
    n = stage(forest.nodes.select("id", "root", "chain", "pos", "segs"), "pathnodes")
    # A leaf is a chain of its own; it is no part of anybody's path but its own.
    blocks = n.groupBy("chain", F.floor(F.col("pos") / BLOCK).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("b")).select("chain", "blk", F.col("b.id").alias("ids"))
    own = F.concat("segs", F.array(F.struct(F.col("chain").alias("chain"), (F.col("pos") + 1).alias("len"))))
    parts = (
        n.select("id", "root", F.posexplode(own).alias("k", "s"))
        .select("id", "root", "k", F.col("s.chain").alias("chain"), F.col("s.len").alias("len"))
        .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - 1) / BLOCK))))
        .join(blocks, ["chain", "blk"])
        .select("id", "root", "k", "blk", F.slice("ids", F.lit(1), F.least(F.lit(BLOCK), F.col("len") - F.col("blk") * BLOCK).cast("int")).alias("ids"))
    )
    merged = parts.groupBy("id", "root").agg(F.sort_array(F.collect_list(F.struct("k", "blk", "ids"))).alias("p"))
    return merged.select("id", F.col("root").alias("root_id"), F.flatten("p.ids").alias("path"))


def descendant_intervals(forest: Forest, block: int = 65536) -> DataFrame:
    """(``id``, ``root_id``, ``first``, ``last``): numbers such that the nodes below
    v are exactly those of its root whose ``first`` lies in [v.first, v.last].

    Preorder numbers with the heavy child first make each chain one interval.
    The place of a light child is a running sum over its siblings; siblings are
    cut into blocks of ids, so a parent with a third of all rows is summed in
    bounded pieces.
    """
    n = stage(forest.nodes.select("id", "parent", "root", "chain", "pos", "segs", "size", "is_leaf"), "intervals")
    light = n.where("parent is not null and id = chain").select("id", "parent", "size", F.floor(F.col("id") / block).alias("blk"))
    per_block = light.groupBy("parent", "blk").agg(F.sum("size").alias("total"))
    before_block = per_block.withColumn("ahead", F.coalesce(F.sum("total").over(Window.partitionBy("parent").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("parent", "blk", "ahead")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "blk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = light.withColumn("inside", inside).join(before_block, ["parent", "blk"]).select(F.col("id").alias("chain"), (F.col("ahead") + F.col("inside")).alias("off"), "parent")
    heavy_size = n.where("id <> chain").select("parent", F.col("size").alias("heavy"))
    # first(top of chain) = first(parent) + 1 + size of the heavy child + sizes of light siblings ahead.
    offset = offset.join(heavy_size, "parent", "left").select("chain", (F.col("off") + 1 + F.coalesce("heavy", F.lit(0))).alias("off"))
    own = F.concat("segs", F.array(F.struct(F.col("chain").alias("chain"), (F.col("pos") + 1).alias("len"))))
    hops = n.where("id = chain").select(F.col("chain").alias("of"), F.posexplode(own).alias("k", "s")).select("of", F.col("s.chain").alias("chain"), F.col("s.len").alias("len"))
    sums = hops.join(offset, "chain", "left").groupBy("of").agg((F.sum(F.coalesce("off", F.lit(0))) + F.sum(F.col("len") - 1)).alias("start"))
    out = n.join(sums.withColumnRenamed("of", "chain"), "chain")
    first = F.col("start") + F.col("pos")
    return out.select("id", F.col("root").alias("root_id"), first.alias("first"), (first + F.col("size") - 1).alias("last"))


def crawl_forest(fetches: DataFrame) -> Forest:
    """Hierarchy of fetched pages: keys of ``url`` under keys of ``parent_url``."""
    return decompose(link_nodes(fetches, "fetch_id", url_key(F.col("url")), url_key(F.col("parent_url"))))
