"""Prefix trie of conversations: whole sequences are collapsed first, and only distinct ones are spread into prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.functions.ranking import with_position
from lurelens.llm.common import named, stored, token

#: Turns that are numbered, and added up along a conversation, in one piece.
BLOCK_TURNS = 1024
#: Conversation numbers whose list is written as one text.
BLOCK_IDS = 256
#: Conversations in a row that share the head of the first one, and the most turns that they share.
FAMILY = 20
HEAD_TURNS = 3

NODE = ["depth", "node1", "node2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns without their texts: ``conv_id, position`` (from 1), ``content1, content2`` (128 bits that stand for role and
    text) and ``n_words`` of the text.

    Null roles and texts are empty. Turns are in the order of ``turn``, null first; those of one turn number are in the
    order of role, then of the content's hash. Rows without ``conv_id`` are no conversation and drop out.
    """
    role, text = (F.coalesce(named(name).cast("string"), F.lit("")) for name in ("role", "text"))
    known = conversations.where(named("conv_id").isNotNull()).select(
        named("conv_id").cast("long").alias("conv_id"), named("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("content1"), F.xxhash64(F.lit(2), role, text).alias("content2"),
        F.size(token(conversations)).cast("long").alias("n_words"))
    block = F.coalesce(F.expr(f"turn div {BLOCK_TURNS}"), F.lit(-(1 << 63)))
    return with_position(known, "conv_id", ["turn", "role", "content1", "content2"], [block]).select(
        "conv_id", "position", "content1", "content2", "n_words")


def rebuilt_turns(turns: DataFrame, heads: int = HEAD_TURNS, family: int = FAMILY) -> DataFrame:
    """Conversations of which each begins with turns of the first one of its family.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % family``, then its own turns after its first
    ``h``, with ``h`` the CRC-32 of its decimal number modulo ``heads + 1``. A conversation that is left without turns
    keeps a row at position 0; all others have that row too.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads + 1))
    base = F.col("conv_id") - F.col("conv_id") % family
    given = turns.where(F.col("position") <= heads).where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.col("position").alias("at"), *[F.col(c).alias(f"head_{c}") for c in ("content1", "content2", "n_words")])
    sizes = given.groupBy("base").agg(F.max("at").alias("size"))
    convs = turns.where("position = 1").select("conv_id", head.alias("head"), base.alias("base"))
    taken = convs.join(given, "base").where(F.col("at") <= F.col("head"))
    shifts = convs.join(sizes, "base", "left").select(
        "conv_id", "head", (F.least("head", F.coalesce("size", F.lit(0))) - F.col("head")).alias("shift"))
    own = turns.join(shifts, "conv_id").where(F.col("position") > F.col("head"))
    columns = ["conv_id", "position", "content1", "content2", "n_words"]
    return own.withColumn("position", F.col("position") + F.col("shift")).select(columns).unionByName(
        taken.select("conv_id", F.col("at").alias("position"), *[F.col(f"head_{c}").alias(c) for c in columns[2:]])).unionByName(
        convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in columns[1:]]))


def _item(k: int) -> Column:
    """What turn and position add to the hash of a sequence; position 0 adds nothing."""
    return F.when(F.col("position") > 0, F.xxhash64("position", "content1", "content2", F.lit(k))).otherwise(F.lit(0).cast("long"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Adds the hash of the sequence up to each turn (``node1, node2``) and its words so far (``n_until``). Long sequences
    are added up in blocks."""
    blocks = turns.withColumn("block", F.expr(f"position div {BLOCK_TURNS}"))
    sums = blocks.groupBy("conv_id", "block").agg(
        F.bit_xor("item1").alias("sum1"), F.bit_xor("item2").alias("sum2"), F.sum("n_words").alias("sum_words"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = sums.select(
        "conv_id", "block", F.coalesce(F.bit_xor("sum1").over(earlier), zero).alias("before1"),
        F.coalesce(F.bit_xor("sum2").over(earlier), zero).alias("before2"), F.coalesce(F.sum("sum_words").over(earlier), zero).alias("before_words"))
    inside = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.withColumns({
        "in1": F.bit_xor("item1").over(inside), "in2": F.bit_xor("item2").over(inside), "in_words": F.sum("n_words").over(inside)})
    return running.join(before, ["conv_id", "block"]).withColumns({
        "node1": F.col("in1").bitwiseXOR(F.col("before1")), "node2": F.col("in2").bitwiseXOR(F.col("before2")),
        "n_until": F.col("in_words") + F.col("before_words")})


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per distinct sequence of first turns, ``ends``: the node ``(end_conv_id, depth)`` at which each
    conversation ends. Smallest member and depth name a node, as a conversation has one node of each depth."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(turns: DataFrame) -> Trie:
    """Trie of the sequences ``turns (conv_id, position, content1, content2, n_words)``.

    A row at position 0 stands for the start that all conversations share; a conversation without it, or with gaps
    between its positions, is not allowed. Identical conversations are grouped into one sequence with a weight before
    anything else. Sequences that are a proper prefix of another are dropped by an anti-join; what is left are the
    leaves. Distinct sequences alone are spread into their prefixes, whose weights are added up.

    ``nodes``: ``conv_id`` (smallest member), ``depth, parent_conv_id`` (null for the root), ``n_convs, n_children,
    n_leaves, saved_tokens`` (over the node and all below it, each node's words times its members but one).

    ``saved_tokens`` needs no pairs of nodes and ancestors: the sum of members times words below a node is a sum over the
    sequences through it of weight times the words they have from there on. From it go the words of each node once: a
    node counts for the sequence that its smallest member belongs to, and the nodes that count for one sequence are its
    last ones.
    """
    items = stored(turns.withColumns({"item1": _item(1), "item2": _item(2)}), "turns")
    whole = stored(items.groupBy("conv_id").agg(
        F.max("position").alias("depth"), F.bit_xor("item1").alias("node1"), F.bit_xor("item2").alias("node2"),
        F.sum("n_words").alias("total")), "conversations")
    sequences = stored(whole.groupBy(NODE).agg(
        F.min("conv_id").alias("first"), F.count("*").alias("weight"), F.max("total").alias("total")), "sequences")
    paths = stored(_prefixes(items.join(sequences.select(F.col("first").alias("conv_id"), F.col("depth").alias("size")), "conv_id")).select(
        F.col("conv_id").alias("first"), F.col("position").alias("depth"), "node1", "node2", "n_words", "n_until", "size",
        F.col("node1").bitwiseXOR(F.col("item1")).alias("parent1"), F.col("node2").bitwiseXOR(F.col("item2")).alias("parent2")), "paths")
    inner = paths.where("depth < size").select(NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("first", F.lit(1).alias("leaf"))
    known = sequences.select("first", "weight", "total").join(leaves, "first", "left")
    left = F.col("total") - F.col("n_until") + F.col("n_words")
    nodes = stored(paths.join(known, "first").groupBy(NODE).agg(
        F.min("first").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.max("n_words").alias("n_words"), F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"),
        F.sum(F.col("weight") * left).alias("gross")), "nodes")
    own = nodes.groupBy(F.col("conv_id").alias("first")).agg(F.min("depth").alias("from_depth"), F.sum("n_words").alias("own_words"))
    once = F.when(F.col("depth") >= F.col("from_depth"), left).otherwise(F.col("own_words"))
    counted = paths.join(known.join(own, "first"), "first").groupBy(NODE).agg(F.sum(once).alias("once"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent1").alias("node1"), F.col("parent2").alias("node2")).agg(
        F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    full = nodes.join(counted, NODE, "left").join(below, NODE, "left").select(
        "conv_id", "depth", "parent1", "parent2", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("gross") - F.coalesce("once", zero)).alias("saved_tokens"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    full = full.join(parents, ["depth", "parent1", "parent2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    at = nodes.join(sequences.select(NODE), NODE, "left_semi").select(*NODE, F.col("conv_id").alias("end_conv_id"))
    return Trie(full, whole.join(at, NODE).select("conv_id", "end_conv_id", "depth"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each node in their order, with commas between; rows of a node follow each other."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple[tuple[int, int], str]] = []
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text")), strict=True):
            if (conv, depth) == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            digest.update(text.encode())
        yield _finished(done)
    if node is not None:
        yield _finished([(node, digest.hexdigest())])


def _finished(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([n[0] for n, _ in done], pa.int64()), pa.array([n[1] for n, _ in done], pa.int64()),
        pa.array([d for _, d in done], pa.string())], names=["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the numbers that end at each node, ascending, with commas between: ``conv_id, depth, ends_sha256``.

    Numbers are joined to texts in blocks, in any task; the task of a node reads these texts as a stream.
    """
    blocks = ends.groupBy(F.col("end_conv_id").alias("conv_id"), "depth", F.expr(f"conv_id div {BLOCK_IDS}").alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    dealt = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return dealt.mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations, with the digest of the conversations that end there.

    Defined results: null roles and texts are empty, null turns come first, a null ``conv_id`` is no conversation; rows
    that are alike are turns of their own; a conversation without turns ends at the root; extra columns are ignored. An
    empty table has no nodes, not even a root.
    """
    trie = prefix_trie(rebuilt_turns(stored(numbered_turns(conversations), "numbered-turns")))
    ends = ends_digests(trie.ends)
    return trie.nodes.join(ends, ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Last turn of every node of a trie of plain conversations, from ``turns (conv_id, position, role, text)``; the root
    has none."""
    return nodes.join(turns.withColumnRenamed("position", "depth"), ["conv_id", "depth"], "left")
