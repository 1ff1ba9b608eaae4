"""Inputs derived from the given tables with SQL that Spark and DuckDB read the same way.

Every statement covers whole tables; modulo expressions only vary values between rows, they select nothing.
"""

from __future__ import annotations

AS_OF = "2024-02-01T00:00:00Z"

_encode = "p.url"
for _char, _code in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26"), ("#", "%23")):
    _encode = f"replace({_encode}, '{_char}', '{_code}')"

_hops = ", ".join(f"({n}, {hop})" for n in range(1, 13) for hop in range(1, n + 1))
_profiles = ", ".join(
    f"({kind}, '{name}', {i})"
    for kind, names in enumerate((
        ("desktop_chrome", "mobile_safari", "bot_googlebot", "no_referer_desktop"),
        ("desktop_chrome", "mobile_safari", "bot_googlebot"),
        ("desktop_chrome", "bot_googlebot"),
        ("desktop_chrome",),
    ))
    for i, name in enumerate(names)
)

INPUTS = {
    # one submission per event: the URLs of all pages in turn, plain, defanged or wrapped
    "submissions": f"""
        select e.event_id as target_id, e.ts as submitted_at, p.url as plain_url, p.page_id,
          case e.event_id % 9
            when 0 then p.url
            when 1 then concat('  ', replace(replace(p.url, 'http', 'hXXp'), '.', '[.]'), ' ')
            when 2 then concat('https://emea01.safelinks.protection.outlook.com/?url=', {_encode}, '&data=05')
            when 3 then concat('https://trusted.example.com/r?x=1&next=', {_encode})
            when 4 then concat('https://urldefense.proofpoint.com/v2/url?u=', replace(replace(replace({_encode}, '-', '%2D'), '_', '%5F'), '%', '-'), '&d=x')
            when 5 then concat('https://urldefense.com/v3/__https://evil.example.org/', cast(p.page_id as varchar(20)), '__;!!x')
            when 6 then concat('https://linkprotect.cudasvc.com/url?a=', {_encode})
            when 7 then concat('https://protect.mimecast.com/s/x?url=https%3A%2F%2Ftrusted.example.com%2F%3Fgoto%3Dhttp%253A%252F%252Finner.example.net%252F', cast(p.page_id as varchar(20)))
            else concat('https://x.workers.dev/login?e=', base64(cast(concat('user', cast(p.page_id as varchar(20)), '@mail.example.com') as binary)))
          end as input_url
        from events e cross join (select count(*) as n from pages) c join pages p on e.event_id % c.n = p.page_id""",
    # page URLs written untidily: case, user info, default port, nested escapes, unsorted query
    "messy_urls": """
        select page_id as target_id,
          replace(replace(substr(url, 1, instr(url, '://') - 1), 'https', 'HTTPS'), 'http:', 'HTTP:') as scheme,
          split_part(split_part(url, '://', 2), '/', 1) as host,
          concat(substr(url, 1, instr(url, '://') - 1), '://User:pw@', upper(split_part(split_part(url, '://', 2), '/', 1)),
            case when substr(url, 1, 5) = 'https' then ':443' else ':8080' end,
            '/Files/a%2520b;v=1?b=2&a=', cast(page_id as varchar(20)), '%2526&c&b=1+2#Fr%41g') as url
        from pages""",
    "hosts": """
        select p.page_id as target_id, b.domain as brand_domain,
          case p.page_id % 9
            when 0 then b.domain
            when 1 then concat('login.', b.domain)
            when 2 then concat(substr(b.domain, 1, 1), substr(b.domain, 3, 1), substr(b.domain, 2, 1), substr(b.domain, 4))
            when 3 then concat('x', b.domain)
            when 4 then concat(substr(b.domain, 2), 'm')
            when 5 then concat('x7k9q2z5v8b', cast(p.page_id as varchar(20)), '.workers.dev')
            when 6 then concat('10.0.0.', cast(p.page_id % 256 as varchar(20)))
            when 7 then concat('www.a', cast(p.page_id as varchar(20)), '.co.uk')
            else split_part(split_part(p.url, '://', 2), '/', 1) end as host
        from pages p join (values (0, 'paypal.com'), (1, 'poste.it'), (2, 'microsoft.com'), (3, 'inps.it'), (4, 'dhl.com')) as b(k, domain)
          on p.page_id % 5 = b.k""",
    "host_urls": "select target_id, host, concat('https://', host, '/') as canonical_url from hosts",
    # analysis runs: one per order, one URL hash per customer
    "targets": """
        select cast(o_orderkey as varchar(20)) as target_id,
          concat('https://', lower(c_mktsegment), '.example.com/', cast(c_custkey as varchar(20))) as input_url,
          cast(o_custkey as varchar(20)) as url_hash,
          case when o_orderkey % 4 = 0 then null else concat('https://', lower(c_mktsegment), '.example.net/') end as final_url,
          case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'error' end as status,
          o_orderdate as created_at
        from orders join customer on o_custkey = c_custkey""",
    # a run has a verdict unless it is still running
    "verdicts": """
        select cast(o_orderkey as varchar(20)) as target_id,
          case substr(o_orderpriority, 1, 1) when '1' then 'phishing' when '2' then 'suspicious' when '3' then 'suspicious' else 'benign' end as classification,
          (o_orderkey % 101) / 100e0 as confidence,
          case when o_orderkey % 7 = 0 then 'PayPal' end as brand,
          case o_orderkey % 5 when 0 then 'Evilginx2' when 1 then 'plain' end as kit_family,
          case when o_orderkey % 6 = 0 then concat('case ', cast(o_orderkey as varchar(20))) end as rationale
        from orders where o_orderstatus <> 'O'""",
    # graph of a run: order lines are states, consecutive lines are edges
    "states": """
        select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20))) as state_id,
          cast(l_orderkey as varchar(20)) as target_id, concat('https://s', cast(l_suppkey as varchar(20)), '.example.com/') as url,
          concat('h', cast(l_partkey % 3 as varchar(20))) as dom_hash, l_linenumber as depth
        from lineitem""",
    # user activity as a binary tree of page states: event n follows event n/2
    "steps": "select user_id, event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events",
    "nodes": """
        select user_id as target_id, event_id as state_id, concat('d', cast(event_id as varchar(20))) as dom_hash, rn,
          concat('https://n', cast(event_id % 50 as varchar(20)), '.example.com/') as url
        from steps""",
    "transitions": """
        select c.event_id as transition_id, c.user_id as target_id, p.event_id as from_state, c.event_id as to_state,
          case c.event_type when 'click' then 'click' when 'view' then 'meta_refresh' when 'error' then 'js_location'
            when 'signup' then 'gate_solved' else 'http_3xx' end as kind,
          c.ts, concat('d', cast(c.event_id as varchar(20))) as dom_hash
        from steps c join steps p on c.user_id = p.user_id and p.rn = cast(floor(c.rn / 2) as bigint)""",
    "evidence": """
        select event_id as evidence_id, user_id as target_id, 'target' as scope, cast(user_id as varchar(20)) as scope_id,
          concat('L', cast(event_id % 7 as varchar(20))) as layer,
          case event_type
            when 'error' then case event_id % 3 when 0 then 'navigation_error' when 1 then 'unhandled_node_error' else 'active_probe_error' end
            when 'signup' then 'typosquat'
            when 'click' then case event_id % 4 when 0 then 'cloaking_detected' when 1 then 'blocked_by_gate' when 2 then 'replay_fallback_used' else 'abuse_prone_infra' end
            when 'view' then 'provider_unavailable' else 'reputation_hit' end as key,
          case
            when event_type = 'error' and event_id % 3 = 0 and event_id % 5 = 0 then 'net::err_cert_common_name_invalid'
            when event_type = 'error' then concat('net::ERR ', cast(event_id as varchar(20)))
            when event_type = 'signup' then concat('{"brand":"B', cast(event_id % 9 as varchar(20)), '","matched_domain":"b.com","distance":', cast(1 + event_id % 2 as varchar(20)), '}')
            else props end as value,
          case when event_type = 'view' then 0e0 else floor(value) / 1000e0 end as weight,
          'test' as produced_by, ts
        from events""",
    "fetches": f"""
        select p.page_id as target_id, f.profile, f.ord,
          case when f.profile = 'bot_googlebot' and p.page_id % 5 = 0 then 403 else 200 end as status_code,
          case when f.profile = 'mobile_safari' and p.page_id % 7 = 0 then concat(p.url, '#m') else p.url end as final_url,
          length(p.html) + f.ord * (p.page_id % 3) as content_length,
          case when f.ord = 3 and p.page_id % 3 = 0 then 'b' else 'a' end as body_sha256,
          case when (p.page_id + f.ord) % 11 = 0 then 'timeout' end as error
        from pages p join (values {_profiles}) as f(k, profile, ord) on p.page_id % 4 = f.k""",
    "hops": f"""
        select p.page_id as target_id, h.hop, concat(p.url, '/', cast(h.hop as varchar(20))) as url,
          case when h.hop < h.n then 302 when p.page_id % 17 = 0 then 301 else 200 end as status_code,
          case when h.hop < h.n then concat('/next/', cast(h.hop + 1 as varchar(20))) end as location,
          case p.page_id % 4 when 0 then 'nginx/1.25' when 1 then 'Boa/0.94' when 2 then 'cloudflare' end as server,
          case when p.page_id % 13 = 0 and h.hop = h.n then 'timeout' end as error
        from pages p join (values {_hops}) as h(n, hop) on h.n = p.page_id % 12 + 1""",
    # feed records about customers' pages: orders are attributes, line items indicators
    "feed_values": """
        select c_custkey as target_id, concat('https://h', cast(c_custkey as varchar(20)), '.s', cast(c_nationkey as varchar(20)), '.com/login') as canonical_url,
          concat('h', cast(c_custkey as varchar(20)), '.s', cast(c_nationkey as varchar(20)), '.com') as host,
          concat('s', cast(c_nationkey as varchar(20)), '.com') as registrable_domain
        from customer""",
    "misp_attributes": """
        select cast(o_orderkey as varchar(20)) as attribute_id,
          case when o_orderkey % 3 = 0 then concat('s', cast(o_custkey % 40 as varchar(20)), '.com')
            else concat('h', cast(o_custkey as varchar(20)), '.s', cast(o_custkey % 25 as varchar(20)), '.com') end as value,
          case o_orderkey % 4 when 0 then 'domain' when 1 then 'hostname' when 2 then 'url' else 'sha1' end as type,
          cast(o_custkey % 97 as varchar(20)) as event_id, o_orderkey % 211 = 0 as to_ids,
          concat('phishing-name:B', cast(o_orderkey % 5 as varchar(20))) as tag_a, concat('tlp:', lower(o_orderpriority)) as tag_b
        from orders""",
    "observables": """
        select cast(c_custkey as varchar(20)) as observable_id,
          case when c_custkey % 2 = 0 then concat('s', cast(c_nationkey as varchar(20)), '.com')
            else concat('h', cast(c_custkey as varchar(20)), '.s', cast(c_nationkey as varchar(20)), '.com') end as value,
          case c_custkey % 3 when 0 then 'Domain-Name' when 1 then 'Hostname' else 'Artifact' end as type,
          lower(c_mktsegment) as label, concat('TLP:', cast(c_nationkey % 3 as varchar(20))) as marking,
          case when c_custkey % 5 <> 0 then concat('org', cast(c_custkey % 4 as varchar(20))) end as creator
        from customer""",
    "indicators": """
        select cast(o_custkey as varchar(20)) as observable_id, cast(o_orderkey as varchar(20)) as indicator_id,
          o_orderkey % 4 = 0 as revoked,
          case o_orderkey % 4 when 1 then '2099-01-01T00:00:00Z' when 2 then '2023-01-01T00:00:00Z' when 3 then 'soon' end as valid_until,
          cast(o_orderkey % 101 as double) as score, concat('i', cast(o_orderkey % 6 as varchar(20))) as label
        from orders""",
    # certificates: one per order, named after its customer; the names in it are its suppliers
    "certificates": """
        select concat('h', cast(o_custkey as varchar(20)), '.com') as host, cast(o_orderkey as varchar(20)) as cert_id,
          o_orderdate as not_before, o_custkey % 11 = 0 as has_next
        from orders""",
    "cert_names": """
        select cast(l_orderkey as varchar(20)) as cert_id,
          case when l_linenumber = 1 then concat('H', cast(o_custkey as varchar(20)), '.com')
            else concat(' N', cast(l_suppkey as varchar(20)), '.example.com. ') end as san
        from lineitem join orders on l_orderkey = o_orderkey""",
    "dns_answers": """
        select c_custkey as target_id, concat('H', cast(c_custkey as varchar(20)), '.com') as host,
          case when c_custkey % 7 = 0 then '' else concat('10.0.', cast(c_nationkey as varchar(20)), '.1|10.0.', cast(c_nationkey as varchar(20)), '.1|10.0.0.2') end as a_text,
          case when c_custkey % 3 = 0 then '::ffff:10.0.0.1|2001:db8::1' when c_custkey % 7 = 1 then '::ffff:10.0.0.1' else '' end as aaaa_text,
          case when c_custkey % 19 = 0 then 'servfail' end as error
        from customer""",
    "registrations": """
        select c_custkey as target_id, concat('h', cast(c_custkey as varchar(20)), '.com') as domain,
          concat('{"events":[{"eventAction":"last changed","eventDate":"2020-01-01"},{"eventAction":"registration","eventDate":"2024-01-',
            case when c_custkey % 31 < 9 then '0' else '' end, cast(c_custkey % 31 + 1 as varchar(20)),
            case c_custkey % 5 when 0 then 'T06:00:00Z' when 1 then '' when 2 then 'T06:00:00.5Z' when 3 then 'T06:00:00' else ' bad' end,
            '"}],"entities":[{"roles":["Registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","', lower(c_mktsegment), ' Inc"]]]}],',
            '"nameservers":[{"ldhName":"NS', cast(c_nationkey as varchar(20)), '.EXAMPLE.NET"},{"unicodeName":"ns2.example.net"}]}') as raw
        from customer""",
    "overrides": """
        select event_id as change_id, ts as added_at, event_type as added_by, user_id,
          case when event_id % 3 = 0 then 'whitelist' else 'blacklist' end as list_type,
          case when event_id % 2 = 0 then concat('note ', cast(event_id as varchar(20))) end as note,
          event_type = 'error' as removed
        from events""",
    "elements": """
        select cast(floor(doc_id / 20) as bigint) as page_id, doc_id as ord, concat('#e', cast(doc_id as varchar(20))) as selector,
          case doc_id % 6 when 0 then 'Sign   In' when 1 then 'Home' when 2 then 'Readers corner' when 3 then 'VIEW document now' when 4 then text else '' end as text,
          case when doc_id % 4 = 0 then 'Continue' end as aria_label,
          cast(doc_id % 13 * 100 as double) as x, cast(doc_id % 11 * 90 - 50 as double) as y,
          cast(2 + doc_id % 7 * 60 as double) as width, cast(3 + doc_id % 5 * 40 as double) as height,
          1280e0 as vp_w, 720e0 as vp_h
        from documents""",
    "nav_log": """
        select user_id as page_id, event_id as ord,
          case when event_type = 'error' then '' when event_type = 'view' then null
            else concat('https://j', cast(event_id % 7 as varchar(20)), '.example.com/') end as url
        from events""",
    "access_log": """
        select e.event_id as request_id, e.ts as requested_at,
          case e.event_id % 4
            when 0 then concat('k=1&url=', p.url)
            when 1 then concat('url=', replace(replace(p.url, ':', '%3A'), '/', '%252F'))
            when 2 then 'other=1'
            else 'url=  ' end as raw_query
        from events e cross join (select count(*) as n from pages) c join pages p on e.event_id % c.n = p.page_id""",
    # a case per order: what was found (order lines), the states seen (one per return flag), fields, model answers
    "case_evidence": """
        select cast(l_orderkey as varchar(20)) as target_id, 'target' as scope, cast(l_orderkey as varchar(20)) as scope_id,
          case l_partkey % 14 when 0 then 'L3' when 1 then 'L1' when 2 then 'L1' when 3 then 'L2' when 10 then 'L1' when 11 then 'API' when 12 then 'L1' else 'L4' end as layer,
          case l_partkey % 14 when 0 then 'cloaking_detected' when 1 then 'abuse_prone_infra' when 2 then 'typosquat' when 3 then 'reputation_hit'
            when 4 then 'unhandled_node_error' when 5 then 'navigation_error' when 6 then 'blocked_by_gate' when 7 then 'active_probe_error'
            when 8 then 'replay_fallback_used' when 9 then 'gate_solved' when 10 then 'aitm_email_payload' when 11 then 'pipeline_error'
            else 'dga_borderline' end as key,
          case l_partkey % 14
            when 2 then concat('{"brand":"B', cast(l_suppkey % 5 as varchar(20)), '","matched_domain":"b.com","distance":', cast(1 + l_suppkey % 2 as varchar(20)), '}')
            when 3 then case l_suppkey % 3
              when 0 then concat('{"match_count":2,"matched_types":["', case when l_suppkey % 2 = 0 then 'url' else 'ip-dst' end,
                '"],"tags":["phishing-name: Acme","phishing-name:Zeta","theme:bank","tlp:red"],"event_count":1,"to_ids_match":true,"context_only":false}')
              when 1 then concat('{"match_count":1,"matched_types":["', case when l_suppkey % 2 = 0 then 'Hostname' else 'Domain-Name' end,
                '"],"active_indicator_count":1,"total_indicator_count":3,"labels":["x"],"markings":[],"created_by":[],"score_avg":70.0,"active_ioc_match":true,"context_only":false}')
              else '{"query_status":"ok"}' end
            when 5 then case when l_suppkey % 2 = 0 then 'net::ERR_CERT_DATE_INVALID' else 'net::ERR_FAILED' end
            when 7 then case when l_suppkey % 2 = 0 then '{"probe":"redirect_chain","error":"certificate_verify_failed"}' else '{"error":"timeout"}' end
            else concat('v', cast(l_linenumber as varchar(20))) end as value,
          case l_partkey % 14 when 0 then 0.25e0 when 1 then 0.2e0 when 2 then case when l_suppkey % 2 = 0 then 0.3e0 else 0.15e0 end
            when 3 then case when l_suppkey % 3 < 2 then 0.55e0 else 0.5e0 end when 10 then 0.4e0 when 12 then 0e0 else 1e0 end as weight,
          'test' as produced_by
        from lineitem""",
    "case_states": """
        select distinct cast(l_orderkey as varchar(20)) as target_id, concat(cast(l_orderkey as varchar(20)), l_returnflag) as state_id,
          concat('https://s.example.com/', l_returnflag) as url, case when l_returnflag = 'R' then 'A' else l_returnflag end as dom_hash,
          case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as depth, l_returnflag as flag
        from lineitem""",
    "case_transitions": """
        select a.target_id, concat(a.state_id, b.flag) as transition_id, a.state_id as from_state, b.state_id as to_state,
          case when a.flag = 'A' then 'click' else 'js_location' end as kind
        from case_states a join (values ('A', 'N'), ('N', 'R')) as v(f, g) on a.flag = v.f
          join case_states b on a.target_id = b.target_id and b.flag = v.g""",
    "case_pages": """
        select target_id, state_id, case flag when 'N' then '<html><title></title><p> </p></html>'
          else concat('<title>T ', target_id, '</title><p>Hello', chr(10), target_id, '</p>') end as html from case_states""",
    "case_fields": """
        select cast(l_orderkey as varchar(20)) as target_id, concat(cast(l_orderkey as varchar(20)), l_returnflag) as state_id,
          l_linenumber as ord, 'input' as tag, 'email' as type, concat('f', cast(l_linenumber as varchar(20))) as name_or_id,
          case when l_partkey % 2 = 0 then 'Mail' else '' end as nearby_label_text
        from lineitem""",
    "case_answers": """
        select cast(o_orderkey as varchar(20)) as target_id,
          case o_orderkey % 6
            when 0 then concat('{"classification":"phishing","confidence":', cast(o_orderkey % 150 as varchar(20)), 'e-2,"brand":"Acme","kit_family":"aitm-x"}')
            when 1 then '{"classification":"harmless","confidence":0.7,"brand":""}'
            when 2 then '{"classification":"benign"}'
            when 3 then 'no json here'
            when 4 then concat('{"classification":"suspicious","confidence":"0.', cast(o_orderkey % 10 as varchar(20)), '"}') end as raw_json
        from orders""",
}
