"""State graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import graph as jobs
from workload.registry import Inputs, query


@query("""
    select target_id, dom_hash, arg_min(state_id, (depth, state_id)) as state_id, min(depth) as depth from states group by target_id, dom_hash""")
def deduped_states(t: Inputs):
    return jobs.dedupe_states(t.states).select("target_id", "dom_hash", "state_id", F.col("depth").cast("int").alias("depth"))


@query("select target_id, url, dom_hash, arg_min(state_id, (depth, state_id)) as state_id from states group by target_id, url, dom_hash")
def stored_states(t: Inputs):
    return jobs.dedupe_states(t.states, ("target_id", "url", "dom_hash")).select("target_id", "url", "dom_hash", "state_id")


@query("""
    select target_id, state_id from (select target_id, state_id, row_number() over (partition by target_id order by depth, state_id) as r from states)
    where r <= 3""")
def budgeted_states(t: Inputs):
    return jobs.budget_cut(t.states, 3).select("target_id", "state_id")


@query("""
    select n.target_id, n.state_id, not exists (select 1 from transitions x where x.target_id = n.target_id and x.from_state = n.state_id) as is_leaf from nodes n""")
def leaf_states(t: Inputs):
    return jobs.with_leaf_flag(t.nodes, t.transitions).select("target_id", "state_id", "is_leaf")


@query("select target_id, kind, count(*) as edges from transitions group by target_id, kind")
def transition_kind_counts(t: Inputs):
    return jobs.kind_counts(t.transitions)


@query("""
    with k as (select target_id, kind, count(*) as edges from transitions group by target_id, kind)
    select target_id, string_agg(concat(kind, '=', edges), ',' order by kind) as kinds, cast(sum(edges) as bigint) as num_transitions from k group by target_id""")
def transition_kind_maps(t: Inputs):
    text = F.array_join(F.transform(F.map_entries("transition_kinds"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return jobs.kind_maps(t.transitions).select("target_id", text.alias("kinds"), "num_transitions")


@query("""
    select t.target_id, coalesce(s.n, 0) as num_states, cast(coalesce(x.n, 0) as int) as num_transitions, coalesce(s.d, 0) as max_depth_reached
    from targets t left join (select target_id, count(*) as n, max(depth) as d from case_states group by target_id) s using (target_id)
      left join (select target_id, count(*) as n from case_transitions group by target_id) x using (target_id)""")
def graph_sizes(t: Inputs):
    return jobs.graph_size(t.targets, t.case_states, t.case_transitions).withColumns({
        "num_transitions": F.col("num_transitions").cast("int"), "max_depth_reached": F.col("max_depth_reached").cast("int"),
    })


@query("""
    with recursive walk as (
      select user_id as target_id, event_id as state_id, rn, '' as path, 0 as hops from steps where rn = 1
      union all
      select w.target_id, s.event_id, s.rn, concat(w.path, '/', s.event_id), w.hops + 1 from walk w join steps s
        on s.user_id = w.target_id and cast(floor(s.rn / 2) as bigint) = w.rn)
    select target_id, state_id, path, hops from walk""")
def root_paths(t: Inputs):
    df = jobs.root_paths(t.nodes, t.transitions)
    path = F.array_join(F.transform("path", lambda x: F.concat(F.lit("/"), x)), "")
    return df.select("target_id", "state_id", path.alias("path"), F.size("path").cast("int").alias("hops"))


@query("select user_id as target_id, event_id as state_id, rn - 1 as hops from steps")
def long_root_paths(t: Inputs):
    """The events of a user as one chain of states."""
    chain = t.sql("""
        select c.event_id as transition_id, c.user_id as target_id, p.event_id as from_state, c.event_id as to_state, c.ts
        from steps c join steps p on c.user_id = p.user_id and p.rn = c.rn - 1""")
    paths = jobs.root_paths(t.nodes, chain)
    whole = F.element_at("path", -1) == F.col("state_id").cast("string")
    return paths.select("target_id", "state_id", F.when((F.size("path") == 0) | whole, F.size("path")).cast("long").alias("hops"))


@query("""
    select target_id, state_id, cast(floor(log2(rn)) as int) as depth, rn as rank from nodes where rn <= 40 and rn < 128""")
def bounded_exploration(t: Inputs):
    nodes = t.nodes
    roots = nodes.filter("rn = 1")
    return jobs.bounded_bfs(roots, t.transitions).nodes.select("target_id", "state_id", "depth", "rank")


@query("""
    select target_id, state_id, cast(floor(log2(rn)) as int) as depth, rn as rank from nodes where rn < 8""")
def shallow_exploration(t: Inputs):
    return jobs.bounded_bfs(t.nodes.filter("rn = 1"), t.transitions, max_depth=2, max_nodes=10_000).nodes.select(
        "target_id", "state_id", "depth", "rank"
    )


_SECOND = """case when target_id % 4 = 0 then 'deduped' when target_id % 5 = 0 then 'error' else 'explored' end"""


@query(f"""
    with sized as (select *, {_SECOND} as status, count(*) over (partition by target_id) as n from nodes)
    select target_id, 'node' as part, cast(state_id as varchar) as state_id, cast(cast(floor(log2(rn)) as int) as varchar) as detail from sized
      where rn <= case when status = 'explored' then 40 - least(n, 7) else 40 end
    union all select target_id, 'node', concat('p', state_id), cast(cast(floor(log2(rn)) as int) as varchar) from sized where status = 'explored' and rn < 8
    union all select target_id, 'edge', concat('p', state_id), concat('cloaking_probe from ', state_id) from sized where status = 'explored' and rn = 1
    union all select target_id, status, null, case status when 'deduped' then 'duplicate_dom' when 'error' then 'navigation' else 'divergent_profile_detected' end from sized where rn = 1""")
def probe_branches(t: Inputs):
    """Two trees per target, the second one with other contents: nodes of both, the edge between them, and the status."""
    nodes, second = t.nodes, F.expr(_SECOND)
    roots = nodes.filter("rn = 1")
    seen = F.when(second == "deduped", F.col("dom_hash")).when(second == "explored", F.concat(F.lit("p"), F.col("dom_hash")))
    probes = roots.select("target_id", F.concat(F.lit("p"), F.col("state_id")).alias("state_id"), seen.alias("dom_hash"))
    text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ("state_id", "from_state", "to_state", "transition_id") if c in df.columns})
    edges = text(t.transitions)
    named = lambda c: F.concat(F.lit("p"), F.col(c)).alias(c)
    others = edges.select("target_id", *[named(c) for c in ("transition_id", "from_state", "to_state", "dom_hash")], "ts")
    explored = jobs.bounded_bfs(text(roots), edges.select(others.columns).unionByName(others), probe_roots=probes)
    rows = jobs.probe_evidence(explored.probe_status)
    value = lambda name: F.get_json_object("value", f"$.{name}")
    none = F.lit(None).cast("string")
    return explored.nodes.select("target_id", F.lit("node").alias("part"), "state_id", F.col("depth").cast("string").alias("detail")).unionByName(
        explored.probe_edges.select("target_id", F.lit("edge").alias("part"), F.col("to_state").alias("state_id"), F.concat_ws(" from ", "kind", "from_state").alias("detail"))
    ).unionByName(rows.select("target_id", value("status").alias("part"), none.alias("state_id"), value("reason").alias("detail")))


@query("""
    with pairs as (select user_id, event_id, event_type, value, lag(event_type) over w as before, lag(value) over w as was from events window w as (partition by user_id order by ts, event_id))
    select user_id, event_id from pairs where before is not null and (event_type <> before or value <> was)""")
def changed_edges(t: Inputs):
    pairs = t.sql("""
        select user_id, event_id, concat('https://', event_type, '.example.com/') as post_url, concat('https://', lag(event_type) over w, '.example.com') as pre_url,
          cast(value as string) as post_hash, cast(lag(value) over w as string) as pre_hash from events window w as (partition by user_id order by ts, event_id)""")
    return jobs.changed_edges(pairs.filter("pre_url is not null")).select("user_id", "event_id")


@query("""
    select user_id as target_id, case event_type when 'error' then 'navigation_error' when 'click' then 'cloaking_probe' else 'unhandled_node_error' end as key,
      case when event_type = 'view' then 'state' else 'target' end as scope, cast(event_id as varchar) as scope_id, props as value,
      case when event_type = 'click' then 0e0 else 1e0 end as weight
    from events where event_type <> 'purchase'""")
def crawl_evidence(t: Inputs):
    log = t.sql("""
        select user_id as target_id, case event_type when 'error' then 'navigation_error' when 'click' then 'cloaking_probe' when 'purchase' then 'debug' else 'unhandled_node_error' end as key,
          case when event_type = 'view' then 'state' else 'target' end as scope, event_id as scope_id, props as message from events""")
    return jobs.crawl_evidence(log).select("target_id", "key", "scope", "scope_id", "value", "weight")
