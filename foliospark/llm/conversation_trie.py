"""Prefix trie of conversations, found block by block.

A node of the trie is a distinct sequence of first turns (role, text); its members are the
conversations that start with it.  Rather than hash every prefix of every conversation, turns are
taken ``BLOCK`` at a time:

1. Each turn gets a digest of its role and text; each full block of ``BLOCK`` turns a digest of its
   turn digests; a conversation's block prefixes are chained, ``P_k = sha256(P_{k-1} + block_k)``.
2. Conversations are grouped by ``(k * BLOCK, P_k)``: the nodes at block boundaries.  A group also
   learns whether its continuing members all go on with one and the same full next block.
3. Where they do, the ``BLOCK - 1`` nodes inside that block are one chain with the members of the next
   boundary node; nothing more is hashed.  Only inside blocks where siblings diverge (or members end)
   are turn boundaries refined: prefix digests of the turns inside the block, grouped again.
4. Node figures come from these groups and one pass over the nodes: the conversation id of a node is
   its smallest member; since a conversation stays the smallest member of every deeper node once it is
   one, the nodes kept by one conversation form a suffix of its path, and a subtree sum is
   ``S(r, depth) - T(r) + sum over members c of T(c)`` with ``T(c)`` the total kept by ``c`` and
   ``S`` a suffix sum over ``r``'s own nodes.  No pair of conversations is ever formed.

The only Python is the chain of block digests, one array of block digests per conversation.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import materialise

#: Turns per block of the first grouping.
BLOCK = 4
#: Turns of a conversation ``c`` are taken from ``c - c % 5``, up to ``crc32(c) % 9`` of them.
BASE_MOD, HEAD_MOD = 5, 9

OUTPUT = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, role, text``: turns numbered from 0 by turn (null first), then role and text.

    Null role or text is empty; rows without ``conv_id`` belong to no conversation and are left out.
    Turns with equal ``turn`` are ordered by role, then text, so repeated rows give one order.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("i"), "role", "text")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: ``(convs: conv_id, n_turns)`` and ``(turns: conv_id, pos, role, text)``.

    Conversation ``c`` is the first ``h = crc32(str(c)) % 9`` turns of conversation ``c - c % 5`` (all
    if fewer, none if absent), then ``c``'s own turns after its first ``h``.  Every ``conv_id`` of the
    table is a conversation, even where nothing is left of it.
    """
    turns = ordered_turns(conversations)
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    head = (F.crc32(F.col("conv_id").cast("string")) % HEAD_MOD).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % BASE_MOD
    convs = own.select("conv_id", "n_own", head.alias("h"), base.alias("base"))
    base_sizes = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(base_sizes, "base", "left").select(
        "conv_id",
        "h",
        "base",
        F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("n_head"),
        F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("n_tail"),
    )
    heads = (
        turns.where(F.col("i") < HEAD_MOD - 1)
        .withColumnRenamed("conv_id", "base")
        .join(convs.select("conv_id", "h", "base"), "base")
        .where(F.col("i") < F.col("h"))
        .select("conv_id", F.col("i").alias("pos"), "role", "text")
    )
    tails = (
        turns.join(convs.select("conv_id", "h", "n_head"), "conv_id")
        .where(F.col("i") >= F.col("h"))
        .select("conv_id", (F.col("n_head") + F.col("i") - F.col("h")).alias("pos"), "role", "text")
    )
    sizes = convs.select("conv_id", (F.col("n_head") + F.col("n_tail")).alias("n_turns"))
    return sizes, heads.unionByName(tails)


def _digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def _chained_digests(blocks: pd.Series) -> pd.Series:
    """Block prefix digests ``P_1..P_m`` of each conversation from its block digests in order."""
    out = []
    for row in blocks:
        prefix, chain = "", []
        for block in row if row is not None else []:
            prefix = hashlib.sha256((prefix + block).encode()).hexdigest()
            chain.append(prefix)
        out.append(chain)
    return pd.Series(out)


def _ends(ids: Column, ends_here: Column) -> Column:
    """SHA-256 of the ids of members ending here, ascending, comma-joined (none: of the empty string)."""
    listed = F.array_join(F.array_sort(F.collect_list(F.when(ends_here, ids))), ",")
    return F.sha2(listed, 256)


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` (all long but the digest).

    ``conv_id`` is the smallest member; the root (depth 0) has no parent; ``n_leaves`` counts childless
    nodes of the subtree, the node included; ``saved_tokens`` sums ``(n_convs - 1) * bytes of the last
    text`` over the subtree (the root has no text); ``ends_sha256`` digests the members with exactly
    ``depth`` turns.  Rebuilt conversations without turns are members of the root only.  An empty table
    gives no rows.  Repeated rows are repeated turns of their conversation.  Extra columns are ignored.
    """
    sizes, turns = rebuilt(conversations)
    # the texts are read once: each later step works on digests and byte counts, written to the shared
    # scratch folder so that every step's plan starts from a table, not from the whole plan before it
    sizes = materialise(sizes, "trie-sizes")
    digested = materialise(
        turns.select(
            "conv_id",
            "pos",
            (F.col("pos") / block).cast("long").alias("k"),
            _digest(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("td"),
            F.octet_length("text").cast("long").alias("n_bytes"),
        ),
        "trie-turns",
    )

    # 1. block digests of full blocks, chained per conversation
    full = digested.join(sizes, "conv_id").where(F.col("k") < (F.col("n_turns") / block).cast("long"))
    blocks = full.groupBy("conv_id", "k").agg(
        _digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "td"))), lambda s: s["td"]), "")).alias("bd")
    )
    chained_udf = F.pandas_udf(_chained_digests, "array<string>")
    chains = blocks.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "bd"))), lambda s: s["bd"]).alias("bds")
    ).select("conv_id", chained_udf("bds").alias("chain"))
    paths = sizes.join(chains, "conv_id", "left").select(
        "conv_id", "n_turns", F.concat(F.array(F.lit("")), F.coalesce("chain", F.array().cast("array<string>"))).alias("chain")
    )
    bounds = materialise(paths.select(
        "conv_id", "n_turns", F.posexplode("chain").alias("k", "p"), F.col("chain")
    ).select(
        "conv_id",
        "n_turns",
        "k",
        (F.col("k") * block).alias("depth"),
        "p",
        F.try_element_at("chain", (F.col("k") + 2).cast("int")).alias("nxt"),
    ), "trie-bounds")

    # 2. nodes at block boundaries
    continuing = F.col("n_turns") > F.col("depth")
    groups = bounds.groupBy("depth", "p").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count(F.when(continuing, 1)).alias("n_cont"),
        F.count("nxt").alias("n_full"),
        F.min("nxt").alias("nxt_min"),
        F.max("nxt").alias("nxt_max"),
        F.min(F.when(continuing, F.col("conv_id"))).alias("cont_min"),
        _ends(F.col("conv_id"), F.col("n_turns") == F.col("depth")).alias("ends_sha256"),
    )
    uniform = (F.col("n_cont") > 0) & (F.col("n_cont") == F.col("n_full")) & (F.col("nxt_min") == F.col("nxt_max"))
    groups = materialise(groups.withColumn("uniform", uniform), "trie-groups")
    # each conversation's boundary node, and whether the block after it is one chain
    placed = materialise(
        bounds.join(groups.select("depth", "p", F.col("conv_id").alias("rep"), "uniform"), ["depth", "p"]),
        "trie-placed",
    )

    # 3. refinement inside blocks where continuing members diverge
    open_blocks = placed.where(~F.col("uniform") & (F.col("n_turns") > F.col("depth"))).select(
        "conv_id", "k", "n_turns", "p"
    )
    inner = (
        digested.where(F.col("pos") % block < block - 1)
        .join(open_blocks, ["conv_id", "k"])
        .withColumn(
            "q",
            _digest(
                F.concat(
                    F.col("p"),
                    F.array_join(
                        F.collect_list("td").over(
                            Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
                        ),
                        "",
                    ),
                )
            ),
        )
        .select("conv_id", "n_turns", (F.col("pos") + 1).alias("depth"), "q")
    )
    inner = materialise(inner, "trie-inner")
    refined_groups = inner.groupBy("depth", "q").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        _ends(F.col("conv_id"), F.col("n_turns") == F.col("depth")).alias("ends_sha256"),
    )
    refined_groups = materialise(refined_groups, "trie-refined-groups")
    refined = materialise(
        inner.join(refined_groups.select("depth", "q", F.col("conv_id").alias("rep")), ["depth", "q"]), "trie-refined"
    )

    # 4. the chains inside uniform blocks
    chained = groups.where(F.col("uniform")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(block - 1))).alias("j")
    ).select(
        (F.col("depth") + F.col("j")).alias("depth"),
        F.col("cont_min").alias("conv_id"),
        F.col("n_cont").alias("n_convs"),
        F.sha2(F.lit(""), 256).alias("ends_sha256"),
        F.col("conv_id").alias("first_parent"),
    ) if block > 1 else None

    # parents: the node one turn up that holds the smallest member
    lookup = placed.select("conv_id", "depth", "rep").unionByName(refined.select("conv_id", "depth", "rep"))
    # with one turn a block there is no chain: the node one turn up is the boundary node itself
    chain_start = placed.select(
        "conv_id", (F.col("depth") + block).alias("depth"), (F.col("uniform") & F.lit(block > 1)).alias("after_chain")
    )
    own_nodes = groups.select("depth", "conv_id", "n_convs", "ends_sha256").unionByName(
        refined_groups.select("depth", "conv_id", "n_convs", "ends_sha256")
    )
    up = lookup.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent"))
    own_nodes = (
        own_nodes.join(up, ["conv_id", "depth"], "left")
        .join(chain_start, ["conv_id", "depth"], "left")
        .select(
            "depth",
            "conv_id",
            "n_convs",
            "ends_sha256",
            F.when(F.col("depth") == 0, F.lit(None).cast("long"))
            .when(F.coalesce("after_chain", F.lit(False)), F.col("conv_id"))
            .otherwise(F.col("parent"))
            .alias("parent_conv_id"),
        )
    )
    nodes = own_nodes
    if chained is not None:
        nodes = nodes.unionByName(
            chained.select(
                "depth",
                "conv_id",
                "n_convs",
                "ends_sha256",
                F.when(F.col("depth") % block == 1, F.col("first_parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            )
        )

    # children, last texts, values
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where(F.col("parent_conv_id").isNotNull()).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")
    ).agg(F.count("*").alias("n_children"))
    last = digested.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    valued = (
        nodes.join(children, ["depth", "conv_id"], "left")
        .join(last, ["conv_id", "depth"], "left")
        .select(
            "depth",
            "conv_id",
            "parent_conv_id",
            "n_convs",
            "ends_sha256",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0))).alias("v_saved"),
            F.when(F.coalesce("n_children", F.lit(0)) == 0, 1).otherwise(0).cast("long").alias("v_leaf"),
        )
    )

    # subtree sums: S(r, depth) - T(r) + sum of T over the members
    mine = Window.partitionBy("conv_id")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    valued = valued.select(
        "*",
        F.sum("v_saved").over(deeper).alias("s_saved"),
        F.sum("v_leaf").over(deeper).alias("s_leaf"),
        F.sum("v_saved").over(mine).alias("t_saved"),
        F.sum("v_leaf").over(mine).alias("t_leaf"),
    )
    valued = materialise(valued, "trie-valued")
    totals = valued.groupBy("conv_id").agg(F.first("t_saved").alias("t_saved"), F.first("t_leaf").alias("t_leaf"))
    member_rows = (
        placed.select("conv_id", "depth", "rep")
        .unionByName(refined.select("conv_id", "depth", "rep"))
        .join(totals, "conv_id", "left")
    )
    member_sums = member_rows.groupBy("depth", "rep").agg(
        F.sum(F.coalesce("t_saved", F.lit(0))).alias("m_saved"), F.sum(F.coalesce("t_leaf", F.lit(0))).alias("m_leaf")
    )
    # a chain inside a uniform block has the members of the boundary node below it
    if block > 1:
        boundary = member_sums.where(F.col("depth") % block == 0)  # refined depths are never multiples
        below = boundary.select("*", F.explode(F.sequence(F.lit(1), F.lit(block - 1))).alias("j")).select(
            (F.col("depth") - F.col("j")).alias("depth"),
            "rep",
            "m_saved",
            "m_leaf",
        )
        chain_keys = chained.select("depth", F.col("conv_id").alias("rep"))
        member_sums = member_sums.unionByName(below.join(chain_keys, ["depth", "rep"]))
    return (
        valued.join(member_sums.withColumnRenamed("rep", "conv_id"), ["depth", "conv_id"], "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.col("n_children").cast("long").alias("n_children"),
            (F.col("s_leaf") - F.col("t_leaf") + F.coalesce("m_leaf", F.lit(0))).cast("long").alias("n_leaves"),
            (F.col("s_saved") - F.col("t_saved") + F.coalesce("m_saved", F.lit(0))).cast("long").alias("saved_tokens"),
            "ends_sha256",
        )
    )
