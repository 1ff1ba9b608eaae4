"""URL intake: refang, unwrap gateway links, find nested payloads, canonicalise, hash, deduplicate.

Everything is a chain of projections, so one pass over the submissions yields all outputs and the only
shuffle is the final deduplication by hash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurelens.functions.text import (
    form_encode, percent_decode, percent_decode_stable, strip,
)
from lurelens.functions.url import (
    Named, decode_host, first_param, is_web_url, query_params, staged, url_steps,
)
from lurelens.schemas import emit

# Defanging patterns and what they stand for, in order of application. Each group names what a
# text must contain for any of its patterns to match.
REFANG_RULES = (
    ("contains(lower({0}), 'hxxp')", (
        (r"hxxps(?=://)", "https"),
        (r"hxxp(?=://)", "http"),
        (r"\bhxxps\b", "https"),
        (r"\bhxxp\b", "http"),
    )),
    ("contains({0}, '[')", ((r"\[:\]", ":"), (r"\[\.\]", "."))),
    ("contains({0}, '(')", ((r"\(\s*\.\s*\)", "."),)),
    ("contains({0}, '{{')", ((r"\{\s*\.\s*\}", "."),)),
    ("contains({0}, '[')", ((r"\[://\]", "://"), (r"\[at\]", "@"), (r"\[@\]", "@"))),
    ("contains(lower({0}), 'wxw.')", ((r"\bwxw\.", "www."),)),
    (r"{0} rlike r'\s'", (
        (r"h\s+t\s+t\s+p\s*:\s*/\s*/\s*", "http://"),
        (r"h\s+t\s+t\s+p\s+s\s*:\s*/\s*/\s*", "https://"),
        (r"\s+dot\s+", "."),
        (r"\s+slash\s+", "/"),
    )),
)

# Hosts and parameters of the link wrappers, in order of application.
SAFE_LINK_DOMAINS = (
    "safelinks.protection.outlook.com",
    "safelinks.protection.office365.us",
    "safelinks.protection.office365.com",
)
URL_DEFENSE_DOMAINS = ("urldefense.proofpoint.com", "urldefense.com")
MIMECAST_HOST = r"(?:\.|\A)mimecast\.com\z"
BARRACUDA_HOST = "linkprotect.cudasvc.com"
OPEN_REDIRECT_PARAMS = (
    "url", "next", "redirect", "dest", "u", "target", "return", "return_url", "returnurl", "goto",
    "redir", "link", "uri", "forward",
)
MAX_UNWRAP_HOPS = 5

# Shapes of a nested payload.
MIN_PAYLOAD_CHARS = 20
BASE64_RUN = rf"([A-Za-z0-9+/=]{{{MIN_PAYLOAD_CHARS},}})"
BASE64_SHAPE = r"\A[A-Za-z0-9+/]+={0,2}\z"
EMAIL_SHAPE = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\n?\z"

class Intake(NamedTuple):
    """Outputs of the intake job; all four are lazy views on one pass over the submissions."""

    urls: DataFrame
    unwrap_steps: DataFrame
    payloads: DataFrame
    rejects: DataFrame


def refang_steps(text: str, out: str) -> list[Named]:
    """Steps ending in ``out``: common defanging undone; a clean URL comes back unchanged."""
    steps, current = [(f"{out}_0", strip(text))], f"{out}_0"
    for i, (needed, rules) in enumerate(REFANG_RULES, start=1):
        plain = current
        for pattern, meant in rules:
            plain = f"regexp_replace({plain}, r'(?i){pattern}', '{meant}')"
        name = out if i == len(REFANG_RULES) else f"{out}_{i}"
        steps.append((name, f"if({needed.format(current)}, {plain}, {current})"))
        current = name
    return steps


def with_refanged(df: DataFrame, column: str, out: str = "refanged_url") -> DataFrame:
    return staged(df, refang_steps(column, out), [out])


def _at_domain(host: str, domains: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"{host} = '{d}' or endswith({host}, '.{d}')" for d in domains) + ")"


def _hop_steps(source: str, p: str) -> list[Named]:
    """Steps ending in ``{p}target`` and ``{p}wrapper``: the first wrapper that recognises ``source``."""
    host, path, query, params = f"{p}host", f"{p}path", f"{p}query", f"{p}params"
    names = ", ".join(f"'{name}'" for name in OPEN_REDIRECT_PARAMS)
    defense = _at_domain(host, URL_DEFENSE_DOMAINS)
    v2 = rf"nullif(regexp_extract({query}, r'(?:\A|[?&])u=([^&?#]+)', 1), '')"
    v3 = f"nullif(regexp_extract({path}, '/v3/__([^_;]+)__', 1), '')"
    firsts = f"transform(array({names}), name -> {first_param(params, 'name')})"
    targets = {
        "safe-links": f"if({_at_domain(host, SAFE_LINK_DOMAINS)}, {first_param(params, repr('url'))}, null)",
        "proofpoint-v2": f"if({defense} and contains({path}, '/v2/'), {percent_decode(f'translate({v2}, {chr(39)}-_{chr(39)}, {chr(39)}%/{chr(39)})')}, null)",
        "proofpoint-v3": f"if({defense}, {percent_decode(v3)}, null)",
        "mimecast": f"if({host} rlike r'{MIMECAST_HOST}', {first_param(params, repr('url'))}, null)",
        "barracuda": f"if({host} = '{BARRACUDA_HOST}', {first_param(params, repr('a'))}, null)",
        "open-redirect": f"if(size({params}) > 0, get(filter({firsts}, v -> {is_web_url('v')}), 0), null)",
    }
    found = [(f"{p}to{i}", target) for i, target in enumerate(targets.values())]
    which = " ".join(f"when {name} is not null then '{wrapper}'" for (name, _), wrapper in zip(found, targets))
    return [
        *url_steps(source, p),
        (params, query_params(query, keep_blank=False)),
        *found,
        (f"{p}target", f"coalesce({', '.join(name for name, _ in found)})"),
        (f"{p}wrapper", f"case {which} end"),
    ]


def with_unwrapped(df: DataFrame, column: str, max_hops: int = MAX_UNWRAP_HOPS) -> DataFrame:
    """Add ``unwrap_chain`` (array of steps) and ``landing_url`` (innermost decodable target).

    One stage per hop; a hop without a wrapper leaves NULL, on which the later hops do no work.
    """
    source, chain, targets, working = column, [], [], []
    for hop in range(1, max_hops + 1):
        p = f"_h{hop}_"
        df = staged(df, _hop_steps(source, p), [f"{p}target", f"{p}wrapper"])
        chain.append(
            f"if({p}wrapper is null, null, named_struct('wrapper', {p}wrapper, 'input_url', {source}, "
            f"'output_url', {p}target, 'opaque', {p}wrapper = 'mimecast'))"
        )
        source = f"{p}target"
        targets.insert(0, source)
        working += [f"{p}target", f"{p}wrapper"]
    steps = [
        ("unwrap_chain", f"filter(array({', '.join(chain)}), s -> s is not null)"),
        ("landing_url", f"coalesce({', '.join([*targets, column])})"),
    ]
    return staged(df, steps, ["unwrap_chain", "landing_url"]).drop(*working)


def _decoded_base64(raw: str) -> str:
    padded = f"concat({raw}, repeat('=', pmod(4 - pmod(length({raw}), 4), 4)))"
    text = strip(f"make_valid_utf8(cast(unbase64({padded}) as string))")
    return f"if({padded} rlike r'{BASE64_SHAPE}', {text}, null)"


def payload_steps(query: str, fragment: str) -> list[Named]:
    """Steps ending in ``nested_payloads``: base64 URLs and e-mail addresses in a URL's query and fragment."""
    keyed = "named_struct('g', array_position(transform(_p_params, q -> q.k), p.k), 'i', p.i, 'v', p.v)"
    kind = f"case when {is_web_url('d.decoded')} then 'url' when d.decoded rlike r'{EMAIL_SHAPE}' then 'email' end"
    return [
        ("_p_any", f"length({query}) >= {MIN_PAYLOAD_CHARS} or length({fragment}) >= {MIN_PAYLOAD_CHARS}"),
        ("_p_params", f"if(_p_any, {query_params(query, keep_blank=True)}, null)"),
        ("_p_texts", f"concat(transform(array_sort(transform(_p_params, p -> {keyed})), p -> p.v), array({fragment}, {query}))"),
        ("_p_runs", f"array_distinct(flatten(transform(_p_texts, t -> regexp_extract_all(t, '{BASE64_RUN}', 1))))"),
        ("_p_decoded", f"transform(_p_runs, r -> named_struct('raw', r, 'decoded', {_decoded_base64('r')}))"),
        ("_p_found", f"""filter(transform(_p_decoded, d ->
            named_struct('raw', d.raw, 'decoded', d.decoded, 'kind', {kind})), d -> d.kind is not null)"""),
        ("nested_payloads", "coalesce(_p_found, array())"),
    ]


def canonical_steps(column: str, out: str = "") -> list[Named]:
    """Steps ending in ``{out}url_error``, ``{out}canonical_url`` and ``{out}url_hash``."""
    c = "_c_"
    pair = f"concat({form_encode('p.k')}, '=', {form_encode('p.v')})"
    return [
        *url_steps(column, c),
        (f"{c}name", decode_host(f"{c}host")),
        (f"{c}shown_port", f"""if({c}port is null or {c}port <=> case {c}scheme when 'http' then 80
            when 'https' then 443 end, '', concat(':', {c}port))"""),
        (f"{c}authority", f"concat({c}name, {c}shown_port)"),
        (f"{c}dpath", percent_decode_stable(f"{c}path")),
        (f"{c}params", query_params(percent_decode_stable(f"{c}query"), keep_blank=True)),
        (f"{c}sorted", f"array_sort(transform({c}params, p -> named_struct('k', p.k, 'i', p.i, 'v', p.v)))"),
        (f"{c}squery", f"array_join(transform({c}sorted, p -> {pair}), '&')"),
        (f"{c}dfragment", percent_decode_stable(f"{c}fragment")),
        (f"{c}fpath", f"if({c}dpath = '' and {c}name != '', '/', {c}dpath)"),
        (f"{c}body", f"""case
            when {c}authority != '' and {c}fpath != '' and not startswith({c}fpath, '/') then concat('//', {c}authority, '/', {c}fpath)
            when {c}authority != '' then concat('//', {c}authority, {c}fpath)
            when startswith({c}fpath, '//') then concat('//', {c}fpath)
            when {c}scheme in ('http', 'https', 'ftp') and ({c}fpath = '' or startswith({c}fpath, '/')) then concat('//', {c}fpath)
            else {c}fpath end"""),
        (f"{out}url_error", f"{c}error"),
        (f"{out}canonical_url", f"""if({c}error is not null, null, concat(if({c}scheme = '', '', concat({c}scheme, ':')), {c}body,
            if({c}squery = '', '', concat('?', {c}squery)), if({c}dfragment = '', '', concat('#', {c}dfragment))))"""),
        (f"{out}url_hash", f"sha2({out}canonical_url, 256)"),
    ]


def with_canonical(df: DataFrame, column: str, out: str = "") -> DataFrame:
    """Add ``{out}canonical_url``, ``{out}url_hash`` and ``{out}url_error``.

    User info and path parameters are dropped, default ports removed, nested escapes decoded, the query
    sorted by key. Unreadable URLs get NULL and a reason instead of failing the job.
    """
    return staged(df, canonical_steps(column, out), [f"{out}canonical_url", f"{out}url_hash", f"{out}url_error"])


def with_intake(df: DataFrame, url_column: str = "input_url", max_hops: int = MAX_UNWRAP_HOPS) -> DataFrame:
    """Annotate submissions with every intake result; one row in, one row out."""
    df = with_refanged(df, url_column)
    df = with_unwrapped(df, "refanged_url", max_hops)
    results = ["canonical_url", "url_hash", "url_error", "_c_query", "_c_fragment"]
    df = staged(df, canonical_steps("landing_url"), results)
    return staged(df, payload_steps("_c_query", "_c_fragment"), ["nested_payloads"]).drop("_c_query", "_c_fragment")


def unwrap_steps(annotated: DataFrame, id_column: str = "target_id") -> DataFrame:
    return annotated.select(id_column, F.posexplode("unwrap_chain").alias("hop", "s")).select(
        id_column, "hop", "s.wrapper", "s.input_url", "s.output_url", "s.opaque"
    )


def payload_rows(annotated: DataFrame, id_column: str = "target_id") -> DataFrame:
    return annotated.select(id_column, F.posexplode("nested_payloads").alias("ord", "p")).select(
        id_column, "ord", "p.raw", "p.decoded", "p.kind"
    )


def intake(df: DataFrame, id_column: str = "target_id", url_column: str = "input_url") -> Intake:
    """The whole intake job. ``urls`` keeps the input verbatim; unreadable rows go to ``rejects``.

    Each distinct text is worked out once, however often it was submitted, and joined back by itself.
    """
    known = with_intake(df.select(url_column).distinct(), url_column)
    annotated = df.join(known.withColumnRenamed(url_column, "_text"), F.col(url_column).eqNullSafe(F.col("_text"))).drop("_text")
    good = annotated.filter(F.col("url_error").isNull())
    urls = good.drop("refanged_url", "unwrap_chain", "nested_payloads", "landing_url", "url_error")
    rejects = annotated.filter(F.col("url_error").isNotNull()).select(
        id_column, url_column, F.col("url_error").alias("reason")
    )
    return Intake(urls, unwrap_steps(good, id_column), payload_rows(good, id_column), rejects)


def intake_evidence(annotated: DataFrame) -> DataFrame:
    """One evidence row per unwrap hop and per nested payload."""
    steps = unwrap_steps(annotated)
    text = F.concat(
        F.col("wrapper"), F.lit(": "), F.col("input_url"), F.lit(" → "), F.col("output_url"),
        F.when(F.col("opaque"), " [opaque]").otherwise(""),
    )
    hops = emit(steps, "L0", F.concat(F.lit("unwrap_step_"), F.col("hop")), text, None, "ingestion.unwrap")
    payloads = emit(
        payload_rows(annotated), "L0", F.concat(F.lit("nested_payload_"), F.col("kind")), F.col("decoded"), None,
        "ingestion.payload_extraction",
    )
    return hops.unionByName(payloads)


def dedupe_submissions(urls: DataFrame, id_column: str = "target_id", time_column: str = "submitted_at") -> DataFrame:
    """One row per ``url_hash``: count, first and last submission, the earliest input text.

    All aggregates combine map-side, so a URL submitted by everyone does not load one task.
    """
    first = F.struct(time_column, id_column)
    return urls.groupBy("url_hash").agg(
        F.count(F.lit(1)).alias("submissions"),
        F.min(time_column).alias("first_seen"),
        F.max(time_column).alias("last_seen"),
        F.min_by("input_url", first).alias("input_url"),
        F.min("canonical_url").alias("canonical_url"),
    )


def extract_submitted_url(log: DataFrame, query_column: str = "raw_query", max_chars: int = 2048) -> DataFrame:
    """URLs from raw request queries: everything after the first ``url=``, decoded; adds ``url_error``."""
    at = f"instr({query_column}, 'url=')"
    found = percent_decode_stable(strip(f"substring({query_column}, {at} + 4)"))
    return staged(log, [
        ("submitted_url", f"if({at} > 0, {found}, null)"),
        ("url_error", f"""case when submitted_url is null then 'missing url parameter'
            when submitted_url = '' then 'empty url' when length(submitted_url) > {max_chars} then 'url too long' end"""),
    ], ["submitted_url", "url_error"])
