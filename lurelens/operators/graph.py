"""State graphs of all targets at once: dedup, walks, bounded exploration, summaries.

Iterative jobs run one loop over all targets, never one per target, and cut lineage with a reliable checkpoint
after every level, so a lost executor costs one level at most.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lurelens.schemas import as_json, emit
from lurelens.session import ensure_checkpoint_dir, fresh_folder

# Exploration limits.
MAX_DEPTH = 6
MAX_NODES = 40
PROBE_DEPTH = 2
PROBE_RESERVE = 2

# Crawl errors that become evidence.
CRAWL_ERRORS = (
    "navigation_error", "blocked_by_gate", "replay_fallback_used", "unhandled_node_error", "cloaking_probe_error",
)


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame, *parts: str) -> DataFrame:
    """Write a step to the shared folder, in folders by ``parts``, and read it back: like a checkpoint, but compressed, and
    later joins of a step with itself are free to rename its columns."""
    path = fresh_folder(df.sparkSession, "graph-step")
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dedupe_states(states: DataFrame, keys: tuple[str, ...] = ("target_id", "dom_hash")) -> DataFrame:
    """The first state per key by depth and id. Use ``(target_id, url, dom_hash)`` for the stored form."""
    rest = [c for c in states.columns if c not in keys and c not in ("depth", "state_id")]
    order = W.partitionBy(*keys).orderBy("depth", "state_id", *rest)
    return states.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def budget_cut(states: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """The first ``max_nodes`` states of every target in exploration order; the limit applies before the shuffle."""
    order = W.partitionBy("target_id").orderBy("depth", "state_id")
    return states.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_nodes).drop("rank")


def with_leaf_flag(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """Add ``is_leaf``: no transition starts at the state."""
    sources = transitions.select("target_id", F.col("from_state").alias("state_id"), F.lit(True).alias("_left")).distinct()
    return states.join(sources, ["target_id", "state_id"], "left").withColumn("is_leaf", F.col("_left").isNull()).drop("_left")


def first_incoming(transitions: DataFrame) -> DataFrame:
    """``(target_id, to_state, from_state, transition_id)``: the earliest edge into each state."""
    order = W.partitionBy("target_id", "to_state").orderBy("ts", "transition_id", "from_state")
    first = transitions.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return first.select("target_id", "to_state", "from_state", "transition_id")


def root_paths(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(target_id, state_id, path)``: transitions from the root to each state, following first incoming edges.

    Every state holds an ancestor and the path from it. In each round states whose ancestor has its whole path are
    done, the others jump to their ancestor's ancestor, so rounds grow with the logarithm of the longest path, which is
    not limited. States that hang on a cycle without a root are not returned; see ``every_path``.
    """
    found, waiting = _rooted_steps(states, transitions)
    return _as_text(_followed(found, waiting))


def _rooted_steps(states: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States without an incoming edge and their empty paths; the other states, the one before each, and the edge from it."""
    keys = ["target_id", "state_id"]
    waiting = _written(first_incoming(transitions).select(
        "target_id", F.col("to_state").alias("state_id"), F.col("from_state").alias("ancestor"), F.array("transition_id").alias("path")))
    return _written(_at_start(states.select(*keys).distinct().join(waiting, keys, "left_anti"), waiting)), waiting


def _at_start(states: DataFrame, steps: DataFrame) -> DataFrame:
    return states.withColumn("path", F.array().cast(steps.schema["path"].dataType))


def _as_text(paths: DataFrame) -> DataFrame:
    """Paths carry the ids as they are until they are whole: numbers are shorter than their texts."""
    return paths.withColumn("path", F.col("path").cast("array<string>"))


def _followed(found: DataFrame, waiting: DataFrame) -> DataFrame:
    """``found (target_id, state_id, path)`` and all of ``waiting (target_id, state_id, ancestor, path)`` that hang on it.

    One join a round looks the ancestor up among both; what comes out is written once, compressed, and parted by whether its
    path is whole. Nothing is joined any more once no state waits.
    """
    while not waiting.isEmpty():
        above = found.withColumn("ancestor", F.lit(None).cast(waiting.schema["ancestor"].dataType)).withColumn("whole", F.lit(True)).unionByName(
            waiting.withColumn("whole", F.lit(False)))
        above = above.select(
            "target_id", F.col("state_id").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("path").alias("_above"), "whole")
        # files of paths are small for what they hold: their size is no reason to broadcast them
        moved = _written(waiting.join(above.hint("merge"), ["target_id", "ancestor"]).select(
            "target_id", "state_id", F.col("_next").alias("ancestor"), F.concat("_above", "path").alias("path"), "whole"), "whole")
        done = moved.where("whole").select("target_id", "state_id", "path")
        if done.isEmpty():
            break
        found, waiting = found.unionByName(done), moved.where("not whole").drop("whole")
    return found


def every_path(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(target_id, state_id, path, cyclic)``: the paths of ``root_paths``, and paths of the states that no root reaches.

    Walking back from those ends in a cycle. The cycle's smallest state stands for its root: the edge into it is left out,
    and paths begin there; ``cyclic`` is true. So every state has a path, and no path visits a state twice.
    """
    keys = ["target_id", "state_id"]
    found, steps = _rooted_steps(states, transitions)
    found = _followed(found, steps)
    steps = _written(steps.join(found, keys, "left_anti"))
    rooted = _as_text(found).withColumn("cyclic", F.lit(False))
    if steps.isEmpty():
        return rooted
    heads = _written(_cycle_heads(steps.select(*keys, "ancestor")))
    below = _followed(_at_start(heads, steps), _written(steps.join(heads, keys, "left_anti")))
    return rooted.unionByName(_as_text(below).withColumn("cyclic", F.lit(True)))


def _leap(steps: DataFrame, *columns: Column) -> DataFrame:
    """Steps ``(target_id, state_id, ancestor)`` twice as far; ``_further.ancestor`` is where the second half ends."""
    ahead = steps.select("target_id", F.col("state_id").alias("ancestor"), F.struct(*steps.columns[2:]).alias("_further"))
    return _written(steps.join(ahead, ["target_id", "ancestor"]).select("target_id", "state_id", F.col("_further.ancestor").alias("ancestor"), *columns))


def _cycle_heads(steps: DataFrame) -> DataFrame:
    """Smallest state of every cycle of ``steps (target_id, state_id, ancestor)``, in which every ancestor has a step itself.

    States that some number of steps back reach become fewer as the number doubles, until only cycles are left: two equal
    counts in a row say so. Their smallest labels then travel around, twice as far each round, until none changes.
    """
    keys = ["target_id", "state_id"]
    reached = lambda df: _written(df.select("target_id", F.col("ancestor").alias("state_id")).distinct())
    far, ring = steps, reached(steps)
    size = ring.count()
    while True:
        far = _leap(far)
        ring = reached(far)
        before, size = size, ring.count()
        if before == size:
            break
    labels = _written(steps.join(ring, keys, "left_semi").withColumn("label", F.col("state_id")))
    while True:
        label = F.least("label", "_further.label")
        labels = _leap(labels, label.alias("label"), (label < F.col("label")).alias("changed"))
        if labels.where("changed").isEmpty():
            return labels.where(F.col("label") == F.col("state_id")).select(keys)
        labels = labels.drop("changed")


class Exploration(NamedTuple):
    """``nodes``, and of the second trees ``probe_status (target_id, status, reason)`` and ``probe_edges``, the edges that join
    explored ones to their roots."""

    nodes: DataFrame
    probe_status: DataFrame | None
    probe_edges: DataFrame | None = None


# Why a second tree has its status.
PROBE_REASONS = {
    "skipped": "budget", "error": "navigation", "deduped": "duplicate_dom", "explored": "divergent_profile_detected",
}


class _Progress(NamedTuple):
    nodes: DataFrame
    visited: DataFrame


def _explore(seeds: DataFrame, edges: DataFrame, done: _Progress, max_depth: int, max_nodes: int) -> _Progress:
    """Breadth-first levels from ``seeds`` (already counted in ``done.nodes``)."""
    nodes, visited, frontier = done.nodes, done.visited, seeds
    for depth in range(max_depth):
        first = F.min(F.struct("rank", "state_id")).alias("s")
        fresh = frontier.groupBy("target_id", "dom_hash").agg(first).select("target_id", "dom_hash", "s.*")
        fresh = _checkpoint(fresh.join(visited, ["target_id", "dom_hash"], "left_anti"))
        visited = visited.unionByName(fresh.select("target_id", "dom_hash"))
        used = nodes.groupBy("target_id").agg(F.count(F.lit(1)).alias("used"))
        source = fresh.select("target_id", F.col("state_id").alias("from_state"), F.col("rank").alias("_from_rank"))
        order = W.partitionBy("target_id").orderBy("_from_rank", "ts", "transition_id")
        reached = source.join(edges, ["target_id", "from_state"]).withColumn("_n", F.row_number().over(order))
        reached = reached.filter(F.col("_n") <= max_nodes).join(used, "target_id")
        reached = reached.filter(F.col("used") + F.col("_n") <= max_nodes)
        frontier = _checkpoint(reached.select(
            "target_id", F.col("to_state").alias("state_id"), "dom_hash", F.lit(depth + 1).alias("depth"),
            (F.col("used") + F.col("_n")).cast("long").alias("rank"),
        ))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    return _Progress(nodes, visited)


def bounded_bfs(
    roots: DataFrame,
    edges: DataFrame,
    max_depth: int = MAX_DEPTH,
    max_nodes: int = MAX_NODES,
    probe_roots: DataFrame | None = None,
) -> Exploration:
    """Budgeted breadth-first exploration of recorded edges, all targets together.

    ``roots``: ``target_id, state_id, dom_hash``; ``edges``: ``target_id, from_state, to_state, dom_hash`` (of the
    target state), ``ts, transition_id``. Every followed edge counts as a node, each ``dom_hash`` is expanded
    once per target, and a target stops at ``max_nodes``. ``probe_roots`` (same shape as ``roots``) are a second
    tree per target, explored first to a smaller depth and sharing the node budget; one that shows the root's
    own content is skipped, and one without content could not be reached: its status is ``error``. A target never holds more than ``max_nodes`` rows in any group of the loop.
    """
    edges = _checkpoint(edges.select("target_id", "from_state", "to_state", "dom_hash", "ts", "transition_id"))
    start = roots.groupBy("target_id").agg(F.min(F.struct("state_id", "dom_hash")).alias("s")).select("target_id", "s.*")
    seeds = _checkpoint(start.withColumns({"depth": F.lit(0), "rank": F.lit(1).cast("long")}))
    columns = ["target_id", "state_id", "dom_hash", "depth", "rank"]
    done = _Progress(seeds.select(columns), seeds.select("target_id", "dom_hash").limit(0))
    status = edges_to = None
    if probe_roots is not None:
        first = F.min(F.struct("state_id", "dom_hash")).alias("p")
        probes = probe_roots.groupBy("target_id").agg(first).join(
            seeds.select("target_id", F.col("state_id").alias("from_state"), F.col("dom_hash").alias("_root_hash")), "target_id"
        )
        outcome = (
            F.when(F.lit(max_nodes <= PROBE_RESERVE + 1), "skipped")
            .when(F.col("p.state_id").isNull() | F.col("p.dom_hash").isNull(), "error")
            .when(F.col("p.dom_hash") == F.col("_root_hash"), "deduped")
            .otherwise("explored")
        )
        probes = _checkpoint(probes.select("target_id", "from_state", "p.*", outcome.alias("status")))
        reason = F.lit(None).cast("string")
        for name, why in PROBE_REASONS.items():
            reason = F.when(F.col("status") == name, why).otherwise(reason)
        status = probes.select("target_id", "status", reason.alias("reason"))
        edges_to = probes.filter("status = 'explored'").select(
            "target_id", "from_state", F.col("state_id").alias("to_state"), F.lit("cloaking_probe").alias("kind"))
        branch = probes.filter("status = 'explored'").select(
            "target_id", "state_id", "dom_hash", F.lit(0).alias("depth"), F.lit(2).cast("long").alias("rank")
        )
        done = _Progress(done.nodes.unionByName(branch), done.visited)
        done = _explore(branch, edges, done, min(PROBE_DEPTH, max_depth), max_nodes)
    done = _explore(seeds.select(columns), edges, done, max_depth, max_nodes)
    return Exploration(done.nodes, status, edges_to)


def probe_evidence(status: DataFrame) -> DataFrame:
    """Status of each target's second tree and its reason, weight 0."""
    return emit(status, "L4", "cloaking_probe", as_json(F.col("status"), F.col("reason")), 0.0, "explorer")


def changed_edges(snapshots: DataFrame) -> DataFrame:
    """Edges after which the URL (ignoring trailing slashes) or the content differs."""
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    same = (bare("post_url") == bare("pre_url")) & (F.col("post_hash") == F.col("pre_hash"))
    return snapshots.filter(~same)


def kind_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("target_id", "kind").agg(F.count(F.lit(1)).alias("edges"))


def kind_maps(transitions: DataFrame) -> DataFrame:
    """``(target_id, transition_kinds, num_transitions)``; the map has one entry per kind."""
    counts = kind_counts(transitions)
    return counts.groupBy("target_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "edges")))).alias("transition_kinds"),
        F.sum("edges").alias("num_transitions"),
    )


def graph_size(targets: DataFrame, states: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(target_id, num_states, num_transitions, max_depth_reached)``, zeros for empty graphs."""
    s = states.groupBy("target_id").agg(F.count(F.lit(1)).alias("num_states"), F.max("depth").alias("max_depth_reached"))
    t = transitions.groupBy("target_id").agg(F.count(F.lit(1)).alias("num_transitions"))
    df = targets.select("target_id").join(s, "target_id", "left").join(t, "target_id", "left")
    return df.select("target_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_states", "num_transitions", "max_depth_reached")))


def crawl_evidence(crawl_log: DataFrame) -> DataFrame:
    """Crawl errors (weight 1) and probe status rows (weight 0) of ``(target_id, scope, scope_id, key, message)``."""
    known = crawl_log.filter(F.col("key").isin(*CRAWL_ERRORS, "cloaking_probe"))
    weight: Column = F.when(F.col("key") == "cloaking_probe", 0.0).otherwise(1.0)
    return emit(known, "L4", F.col("key"), F.col("message"), weight, "explorer", F.col("scope"), F.col("scope_id"))
