"""URL intake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import intake as jobs
from lurelens.operators.domains import with_registrable_domain
from lurelens.operators.overrides import with_url_key
from workload.registry import Inputs, query

# what each kind of submission must become, by construction
_EXPECTED = """
    expected as (
      select target_id, submitted_at, input_url, page_id,
        case target_id % 9
          when 5 then concat('https://evil.example.org/', cast(page_id as varchar))
          when 7 then concat('http://inner.example.net/', cast(page_id as varchar))
          when 8 then input_url else plain_url end as landing_url
      from submissions),
    parts as (
      select *, case when contains(landing_url, '#') then split_part(landing_url, '#', 1) else landing_url end as head,
        case when contains(landing_url, '#') then concat('#', split_part(landing_url, '#', 2)) else '' end as frag
      from expected),
    canon as (
      select target_id, submitted_at, input_url, page_id, landing_url,
        concat(split_part(head, '?', 1),
          case when contains(head, '?') then concat('?', array_to_string(list_transform(list_sort(string_split(substr(head, instr(head, '?') + 1), '&')),
            lambda x: concat(split_part(x, '=', 1), '=', replace(substr(x, instr(x, '=') + 1), '=', '%3D'))), '&')) else '' end, frag) as canonical_url
      from parts)"""

_WRAPPERS = """
    unwrapped as (
      select target_id, 0 as hop, case target_id % 9 when 2 then 'safe-links' when 3 then 'open-redirect' when 4 then 'proofpoint-v2'
          when 5 then 'proofpoint-v3' when 6 then 'barracuda' when 7 then 'mimecast' end as wrapper,
        input_url, case target_id % 9 when 5 then concat('https://evil.example.org/', cast(page_id as varchar))
          when 7 then concat('https://trusted.example.com/?goto=http%3A%2F%2Finner.example.net%2F', cast(page_id as varchar)) else plain_url end as output_url
      from submissions
      union all
      select target_id, 1, 'open-redirect', concat('https://trusted.example.com/?goto=http%3A%2F%2Finner.example.net%2F', cast(page_id as varchar)),
        concat('http://inner.example.net/', cast(page_id as varchar)) from submissions where target_id % 9 = 7),
    steps_found as (select *, wrapper = 'mimecast' as opaque from unwrapped where wrapper is not null)"""

_PAYLOADS = """
    payloads as (
      select target_id, 0 as ord, base64(cast(concat('user', cast(page_id as varchar), '@mail.example.com') as blob)) as raw,
        concat('user', cast(page_id as varchar), '@mail.example.com') as decoded, 'email' as kind
      from submissions where target_id % 9 = 8)"""


@query("""
    select target_id, case target_id % 9 when 1 then plain_url else input_url end as refanged_url from submissions""")
def refang_urls(t: Inputs):
    return jobs.with_refanged(t.submissions, "input_url").select("target_id", "refanged_url")


@query(f"with {_WRAPPERS} select target_id, hop, wrapper, input_url, output_url, opaque from steps_found")
def unwrap_steps(t: Inputs):
    return jobs.unwrap_steps(jobs.with_unwrapped(t.submissions, "input_url"))


@query(f"with {_PAYLOADS} select target_id, ord, raw, decoded, kind from payloads")
def nested_payloads(t: Inputs):
    return jobs.intake(t.submissions).payloads


@query("""
    select target_id, concat(lower(scheme), '://', host, case when lower(scheme) = 'https' then '' else ':8080' end,
      '/Files/a b?a=', cast(target_id as varchar), '&b=2&b=1%202&c=#FrAg') as canonical_url,
      sha256(concat(lower(scheme), '://', host, case when lower(scheme) = 'https' then '' else ':8080' end,
      '/Files/a b?a=', cast(target_id as varchar), '&b=2&b=1%202&c=#FrAg')) as url_hash
    from messy_urls""")
def canonical_urls(t: Inputs):
    return jobs.with_canonical(t.messy_urls, "url").select("target_id", "canonical_url", "url_hash")


@query(f"with {_EXPECTED} select target_id, input_url, canonical_url, sha256(canonical_url) as url_hash from canon")
def url_intake(t: Inputs):
    return jobs.intake(t.submissions).urls.select("target_id", "input_url", "canonical_url", "url_hash")


@query(f"""
    with {_WRAPPERS}, {_PAYLOADS}
    select target_id, 'L0' as layer, concat('unwrap_step_', hop) as key,
      concat(wrapper, ': ', input_url, ' → ', output_url, case when opaque then ' [opaque]' else '' end) as value,
      1e0 as weight, 'ingestion.unwrap' as produced_by from steps_found
    union all
    select target_id, 'L0', 'nested_payload_email', decoded, 1e0, 'ingestion.payload_extraction' from payloads""")
def intake_evidence(t: Inputs):
    annotated = jobs.with_intake(t.submissions)
    return jobs.intake_evidence(annotated).drop("scope", "scope_id")


@query(f"""
    with {_EXPECTED}
    select sha256(canonical_url) as url_hash, count(*) as submissions, strftime(min(submitted_at), '%Y-%m-%d %H:%M:%S.%f') as first_seen,
      strftime(max(submitted_at), '%Y-%m-%d %H:%M:%S.%f') as last_seen, arg_min(input_url, (submitted_at, target_id)) as input_url, min(canonical_url) as canonical_url
    from canon group by canonical_url""")
def dedupe_submissions(t: Inputs):
    unique = jobs.dedupe_submissions(jobs.intake(t.submissions).urls)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return unique.select("url_hash", "submissions", stamp("first_seen"), stamp("last_seen"), "input_url", "canonical_url")


@query("""
    select target_id, host, case target_id % 9
        when 0 then brand_domain when 1 then brand_domain when 5 then host when 6 then host
        when 7 then substr(host, 5) when 8 then array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:2]), '.')
        else host end as registrable_domain
    from hosts""")
def registrable_domains(t: Inputs):
    return with_registrable_domain(t.hosts, t.rules).select("target_id", "host", "registrable_domain")


@query("""
    select target_id, concat(lower(scheme), '://', host, case when lower(scheme) = 'https' then '' else ':8080' end, '/Files/a b') as url_key
    from messy_urls""")
def override_url_keys(t: Inputs):
    return with_url_key(t.messy_urls, "url").select("target_id", "url_key")


@query("""
    select request_id,
      case request_id % 4 when 0 then substr(raw_query, 9) when 1 then replace(replace(substr(raw_query, 5), '%3A', ':'), '%252F', '/')
        when 3 then '' end as submitted_url,
      case request_id % 4 when 2 then 'missing url parameter' when 3 then 'empty url' end as url_error
    from access_log""")
def urls_from_access_log(t: Inputs):
    return jobs.extract_submitted_url(t.access_log).select("request_id", "submitted_url", "url_error")
