"""Evidence, bundle, verdict and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import decisions, evidence as jobs, verdicts
from lurelens.operators.graph import crawl_evidence
from lurelens.operators.probes import probe_errors
from lurelens.plans.analysis import risk_listing as listing
from lurelens.schemas import identified
from lurelens.session import stored
from workload.registry import Inputs, brand_values, query


@query("""
    select target_id, scope_id, layer, key, value, weight, count(*) as n from (
      select user_id as target_id, cast(event_id as varchar) as scope_id, 'L4' as layer, 'navigation_error' as key, props as value, 1e0 as weight from events
      union all
      select user_id, cast(user_id as varchar), 'L3', 'active_probe_error', concat('{"probe":"', event_type, '","error":"', replace(props, '"', '\\"'), '"}'), 0e0 from events
      union all
      select user_id, cast(user_id as varchar), 'API', 'pipeline_error', event_type, 1e0 from events)
    group by all""")
def evidence_union(t: Inputs):
    crawl = crawl_evidence(t.events.select(
        F.col("user_id").alias("target_id"), F.lit("navigation_error").alias("key"), F.lit("state").alias("scope"),
        F.col("event_id").alias("scope_id"), F.col("props").alias("message"),
    ))
    probes = probe_errors(t.events.select(F.col("user_id").alias("target_id"), F.col("event_type").alias("probe"), F.col("props").alias("error")))
    rejects = jobs.rejected_rows(t.events.select(F.col("user_id").alias("target_id"), F.col("event_type").alias("reason")), "intake")
    stored = identified(jobs.union_evidence(crawl, probes, rejects), F.lit("2024-02-01").cast("timestamp"))
    return stored.groupBy("target_id", "scope_id", "layer", "key", "value", "weight").agg(F.count("evidence_id").alias("n"))


@query("select target_id, key, count(*) as n from evidence group by target_id, key")
def evidence_counts(t: Inputs):
    return jobs.evidence_counts(t.evidence)


_FLAGS = """
    bool_or(key = 'blocked_by_gate') as had_gate, bool_or(key = 'navigation_error') as had_navigation_error,
    bool_or(key = 'replay_fallback_used') as had_replay_fallback, bool_or(key = 'unhandled_node_error') as had_unhandled_error,
    bool_or(key in ('navigation_error', 'active_probe_error') and regexp_matches(upper(value), 'ERR_CERT|CERTIFICATE_VERIFY_FAILED|HOSTNAME MISMATCH')) as had_tls_error"""


@query(f"select target_id, {_FLAGS} from evidence group by target_id")
def evidence_flags(t: Inputs):
    return jobs.evidence_flags(t.evidence)


@query("""
    select target_id, key, try_cast(value as json) is not null as is_json, value,
      coalesce(array_to_string(list_sort(list_transform(json_keys(try_cast(value as json)), lambda k: concat(k, '=', json_extract_string(try_cast(value as json), '$."' || k || '"')))), '|'), '') as decoded
    from evidence where key in ('typosquat', 'reputation_hit', 'cloaking_detected')""")
def strong_evidence(t: Inputs):
    fields = F.array_sort(F.transform(F.map_entries("decoded"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return jobs.strong_details(t.evidence).withColumn("decoded", F.coalesce(F.array_join(fields, "|"), F.lit("")))


def _case_states(t: Inputs, max_chars: int | None = None):
    return jobs.bundle_states(t.case_states, t.case_transitions, t.case_pages, max_chars)


_STATE_TEXT = """
    state_text as (select target_id, state_id, depth, dom_hash, url, flag, not exists (select 1 from case_transitions x where x.from_state = s.state_id) as is_leaf,
      case when flag = 'N' then '' else concat('T ', target_id) end as title, case when flag = 'N' then '' else concat('T ', target_id, ' Hello ', target_id) end as visible_text
      from case_states s)"""


@query(f"with {_STATE_TEXT} select target_id, state_id, is_leaf, title, visible_text, '' as ocr_text from state_text")
def state_contents(t: Inputs):
    return _case_states(t).select("target_id", "state_id", "is_leaf", "title", "visible_text", "ocr_text")


def _bundles(t: Inputs, states=None):
    return jobs.bundles(t.targets, _case_states(t) if states is None else states, t.case_transitions, t.case_evidence, t.case_fields)


_BUNDLES = f"""{_STATE_TEXT},
    s as (select target_id, count(*) as num_states, max(depth) as max_depth_reached, bool_or(visible_text <> '') as has_text from state_text group by target_id),
    x as (select target_id, count(*) as num_transitions, count(distinct kind) as kinds from case_transitions group by target_id),
    f as (select target_id, count(*) as total_fields from case_fields group by target_id),
    k as (select target_id, key, count(*) as n from case_evidence group by target_id, key),
    m as (select target_id, string_agg(concat(key, '=', n), ',' order by key) as counts from k group by target_id),
    e as (select target_id, {_FLAGS},
        bool_or(key = 'typosquat' and contains(value, '"distance":1')) as close_lookalike,
        bool_or(key = 'cloaking_detected') as cloaked, bool_or(key = 'abuse_prone_infra') as abused, bool_or(key = 'reputation_hit') as listed,
        round(least(1, coalesce(sum(weight) filter (layer = 'L1'), 0)), 4) as lexical_risk_score,
        round(least(1, coalesce(sum(weight) filter (layer = 'L2'), 0)), 4) as passive_risk_score,
        min(value) filter (key = 'reputation_hit' and contains(value, '"to_ids_match":true')) as misp_hit,
        min(value) filter (key = 'reputation_hit' and contains(value, '"active_ioc_match":true')) as opencti_hit
      from case_evidence group by target_id),
    bundle as (select t.target_id, coalesce(final_url, input_url) as landing, num_states, coalesce(num_transitions, 0) as num_transitions, coalesce(kinds, 0) as kinds, max_depth_reached,
        coalesce(has_text, false) as has_text, coalesce(total_fields, 0) as total_fields, counts, e.* exclude (target_id), status
      from targets t join s using (target_id) join e using (target_id) join m using (target_id) left join x using (target_id) left join f using (target_id)
      union all
      select t.target_id, coalesce(final_url, input_url), 0, 0, 0, 0, false, 0, '', false, false, false, false, false, false, false, false, false, 0, 0, null, null, status
      from targets t anti join s using (target_id))"""


@query(f"""
    with {_BUNDLES}
    select target_id, num_states, num_transitions, cast(max_depth_reached as int) as max_depth_reached, has_text, total_fields, counts, had_gate, had_navigation_error,
      had_replay_fallback, had_unhandled_error, had_tls_error, close_lookalike, lexical_risk_score, passive_risk_score from bundle""")
def evidence_bundles(t: Inputs):
    counts = F.array_join(F.transform(F.map_entries("evidence_counts"), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), ",")
    return _bundles(t).select(
        "target_id", "num_states", "num_transitions", F.col("max_depth_reached").cast("int").alias("max_depth_reached"), "has_text",
        "total_fields", counts.alias("counts"), *jobs.FLAGS, "close_lookalike", "lexical_risk_score", "passive_risk_score",
    )


_VERDICTS = f"""{_BUNDLES},
    pre as (select *, lexical_risk_score >= 0.5 or passive_risk_score >= 0.5 or cloaked or listed or close_lookalike as strong_signal,
        num_states <= 1 and not has_text as nothing, had_unhandled_error and not had_gate and total_fields = 0 and not had_navigation_error and kinds <= 1 as failed from bundle),
    ruled as (select *,
        case when misp_hit is not null or opencti_hit is not null then 'phishing' when strong_signal then null when nothing or failed then 'suspicious' end as rule_class,
        case when misp_hit is not null then case when contains(misp_hit, '"url"') then 0.95e0 else 0.85e0 end
          when opencti_hit is not null then case when contains(opencti_hit, '"Hostname"') then 0.95e0 else 0.85e0 end
          when strong_signal then null when nothing or failed then case when had_tls_error then 0.6e0 else 0.05e0 end end as rule_confidence,
        case when misp_hit is not null then 'Acme, Zeta' end as rule_brand,
        case when cloaked and abused then 0.6e0 when cloaked or abused then 0.4e0 when num_states <= 1 and total_fields = 0 then 0.1e0
          when total_fields >= 2 then 0.2e0 else 0.15e0 end as fallback from pre),
    answered as (select r.*, raw_json, cast(r.target_id as bigint) % 6 as kind, cast(r.target_id as bigint) as id from ruled r join case_answers using (target_id)),
    final as (select target_id, status, landing,
        coalesce(rule_class, case kind when 0 then 'phishing' when 2 then 'benign' else 'suspicious' end) as classification,
        coalesce(rule_confidence, case kind when 0 then least(1e0, (id % 150) / 100e0) when 1 then 0.7e0 when 2 then 0.3e0 when 4 then (id % 10) / 10e0 else fallback end) as confidence,
        case when rule_class is not null then 'prefilter' when kind in (0, 1, 2, 4) then 'model' else 'heuristic_fallback' end as produced_by,
        case when rule_class is not null then rule_brand when kind = 0 then 'Acme' end as brand,
        case when rule_class is null and kind = 0 then 'aitm-x' end as kit_family from answered)"""


@query(f"with {_VERDICTS} select target_id, strong_signal, rule_class as classification, rule_confidence as confidence, rule_brand as brand, case when rule_class = 'phishing' then landing end as final_url from ruled")
def prefilter_verdicts(t: Inputs):
    v = F.col("prefilter")
    return verdicts.prefilter(_bundles(t)).select(
        "target_id", "strong_signal", v["classification"].alias("classification"), v["confidence"].alias("confidence"),
        v["brand"].alias("brand"), v["final_url"].alias("final_url"),
    )


@query(f"with {_VERDICTS} select target_id from ruled where rule_class is null")
def undecided_cases(t: Inputs):
    return verdicts.undecided(verdicts.prefilter(_bundles(t))).select("target_id")


@query(f"""
    with {_VERDICTS}
    select target_id, coalesce(rule_class, 'suspicious') as classification, coalesce(rule_confidence, fallback) as confidence,
      case when rule_class is null then 'heuristic_fallback' else 'prefilter' end as produced_by from ruled""")
def heuristic_verdicts(t: Inputs):
    return verdicts.verdicts(verdicts.prefilter(_bundles(t))).select("target_id", "classification", "confidence", "produced_by")


@query("""
    with a as (select target_id, cast(target_id as bigint) as id, cast(target_id as bigint) % 6 as kind from case_answers)
    select target_id, case kind when 0 then 'phishing' when 1 then 'suspicious' when 2 then 'benign' when 4 then 'suspicious' end as classification,
      case kind when 0 then least(1e0, (id % 150) / 100e0) when 1 then 0.7e0 when 2 then 0.3e0 when 4 then (id % 10) / 10e0 end as confidence,
      case when kind = 0 then 'Acme' end as brand from a""")
def model_answers(t: Inputs):
    v = verdicts.answer_verdict(F.col("raw_json"))
    df = t.case_answers.select("target_id", v.alias("v"))
    return df.select("target_id", "v.classification", "v.confidence", "v.brand")


def _final(t: Inputs):
    return verdicts.verdicts(verdicts.prefilter(_bundles(t)), t.case_answers)


@query(f"with {_VERDICTS} select target_id, classification, confidence, produced_by, brand, kit_family from final")
def final_verdicts(t: Inputs):
    return _final(t).select("target_id", "classification", "confidence", "produced_by", "brand", "kit_family")


_FACTS = """
    facts as (select target_id, min(concat('B', regexp_extract(value, '"brand":"B([0-9])"', 1))) filter (key = 'typosquat') as lookalike,
      bool_or(key = 'gate_solved') as gate, bool_or(key = 'aitm_email_payload') as email, min(value) filter (key = 'pipeline_error') as broken from case_evidence group by target_id)"""

_DECISIONS = f"""
    decided as (select v.*, lookalike, coalesce(gate, false) as gate, coalesce(email, false) as email, broken,
      status = 'done' and (classification = 'phishing' or classification = 'suspicious' and confidence >= 0.6) as bad
      from final v left join facts using (target_id)),
    answer as (select target_id, case when bad then 'malicious' else 'safe' end as verdict,
      case when status <> 'done' then 0.1e0 when bad then round(greatest(0.8e0, confidence), 2)
        when classification = 'suspicious' then round(least(0.5e0, case when confidence = 0 then 0.4e0 else confidence end), 2) else round(greatest(0.9e0, confidence), 2) end as confidence,
      case when status = 'error' then 'Analysis-Failed' when status = 'running' then 'Analysis-Incomplete — Benign By Default'
        when bad and lookalike is not null then concat('Phishing: ', lookalike, ' Impersonation') when bad and brand is not null then concat('Phishing: ', brand, ' Impersonation')
        when bad and gate then 'Suspicious Gate Bypass Detected' when bad and (email or kit_family = 'aitm-x') then 'Credential Harvesting Detected'
        when bad and classification = 'suspicious' then 'Suspicious Site Blocked' when classification = 'phishing' then 'Phishing Page Detected'
        when classification = 'benign' then 'No Threats Detected' else 'Suspicious Site (Low Confidence)' end as signature,
      case when bad then 'block' else 'allow' end as recommended_action,
      status = 'error' and broken is not null as explained from decided)"""


@query(f"with {_VERDICTS}, {_FACTS}, {_DECISIONS} select * from answer")
def decisions_made(t: Inputs):
    df = decisions.decide(t.targets, _final(t), decisions.signature_facts(t.case_evidence))
    explained = F.col("reason").startswith("Analysis failed: ") & ~F.col("reason").endswith("unknown error")
    return df.withColumn("explained", explained).drop("reason")


@query("""
    select t.target_id, 'safe' as verdict, 0.1e0 as confidence, 'Analysis-Incomplete — Benign By Default' as signature
    from targets t where not exists (select 1 from verdicts v where v.target_id = t.target_id)""")
def decisions_not_started(t: Inputs):
    return decisions.not_started(t.targets, t.verdicts).select("target_id", "verdict", "confidence", "signature")


_DETAIL = """
    placed as (select *, row_number() over (partition by target_id order by depth, state_id) as position from case_states),
    first as (select target_id, dom_hash, min(position) as full_at from placed group by target_id, dom_hash),
    detailed as (select p.target_id, p.state_id, p.position, case when position = full_at then 'full' else 'same' end as detail,
      case when position > full_at then full_at else 0 end as same_as from placed p join first f using (target_id, dom_hash))"""


@query(f"with {_DETAIL} select target_id, state_id, position, detail, same_as from detailed")
def state_detail_levels(t: Inputs):
    df = jobs.with_detail_level(stored(_case_states(t), "states"))
    return df.select("target_id", "state_id", "position", "detail", F.coalesce("same_as", F.lit(0)).alias("same_as"))


@query(f"""
    with {_BUNDLES}, {_DETAIL},
    kinds as (select target_id, list(concat('  ', kind, ': ', n) order by kind) as found from (select target_id, kind, count(*) as n from case_transitions group by all) group by target_id),
    keys as (select target_id, list(concat('  ', key, ': ', n) order by key) as found from k group by target_id),
    heads as (
      select b.target_id, 0 as section, 0 as position, list_concat(
        ['=== EXPLORATION SUMMARY ===', concat('Input URL: ', input_url)], case when final_url is null then [] else [concat('Canonical URL: ', final_url)] end,
        [concat('States visited: ', num_states), concat('Transitions recorded: ', num_transitions), concat('Max depth reached: ', max_depth_reached),
          concat('Lexical risk score (L1): ', lexical_risk_score), concat('Passive risk score (L2): ', passive_risk_score), '=== TRANSITION TYPES ==='],
        coalesce(kinds.found, []), ['=== FLAGS (from Evidence) ===', concat('  had_gate: ', had_gate), concat('  had_navigation_error: ', had_navigation_error),
          concat('  had_replay_fallback: ', had_replay_fallback), concat('  had_tls_error: ', had_tls_error), concat('  had_unhandled_error: ', had_unhandled_error),
          '=== EVIDENCE COUNTS ==='], coalesce(keys.found, []), ['=== STATE DETAILS (every explored state) ===']) as lines
      from bundle b join targets using (target_id) left join kinds using (target_id) left join keys using (target_id)),
    shown as (
      select state_id, ord, concat('    input[type=email]  name_or_id=', name_or_id, case when nearby_label_text <> '' then concat('  → "', nearby_label_text, '"') else '' end) as line
      from case_fields),
    form as (select state_id, count(*) as n, list(line order by ord, line) as found from shown group by state_id),
    bodies as (
      select d.target_id, 1 as section, d.position, list_concat(
        [concat('--- State #', position, case detail when 'full' then '' else concat(' (same content as State #', same_as, ')') end, ' ---'),
          concat('  Depth: ', depth, case when is_leaf then ' (leaf, no further action)' else ' (continued)' end), concat('  URL: ', url)],
        case when detail = 'same' then [] else list_concat(
          case when title <> '' then [concat('  Title: ', title)] else [] end,
          case when form.n is null then ['  Form fields: none'] else list_concat([concat('  Form fields detected (', form.n, '):')], form.found) end,
          case when visible_text <> '' then ['  Visible text (truncated):', concat('    ', visible_text)] else [] end) end) as lines
      from detailed d join state_text using (target_id, state_id) left join form using (state_id))
    select target_id, section, position, line_no, lines[line_no + 1] as line
    from (select *, unnest(range(len(lines))) as line_no from (from heads union all from bodies))""")
def case_digests(t: Inputs):
    """Every line of every report."""
    states = stored(_case_states(t), "states")
    return jobs.case_digest(_bundles(t, states), states, t.case_fields)


@query(f"""
    with p as (select page_id, url, html, regexp_extract(url, '//([^/:?#]+)', 1) as host, html like '%<p>%' as any_text from pages),
    d as (select *, array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:2]), '.') as domain from p),
    near as (select page_id, min(damerau_levenshtein(d.domain, b.domain)) as distance from d join {brand_values()}
      on d.domain <> b.domain and abs(length(d.domain) - length(b.domain)) <= 2 and damerau_levenshtein(d.domain, b.domain) <= 2 group by page_id)
    select d.page_id, url as input_url, coalesce(distance = 1, false) as close_lookalike from d left join near using (page_id)""")
def page_lookalikes(t: Inputs):
    """Which pages live on a domain one edit away from a brand."""
    df = listing(t.pages, t.brands, t.rules)
    return df.select(F.col("target_id").cast("long").alias("page_id"), "input_url", (F.col("lookalike_distance") == 1).alias("close_lookalike"))


@query()
def risk_listing(t: Inputs):
    """Every page with scores, verdict and decision, worst first."""
    return listing(t.pages, t.brands, t.rules).drop("lookalike_distance")
