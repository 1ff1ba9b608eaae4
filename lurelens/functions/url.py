"""URL splitting, query lookup and relative resolution.

Splitting is a list of named SQL expressions that refer to each other by name, so callers put it into the
same ``select`` as the work that uses the parts and drop the names afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lurelens.functions.text import form_decode

# Schemes whose last path segment may carry ";parameters".
_PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips",
    "mms", "sftp", "tel",
)
URL_PARTS = ("scheme", "netloc", "host", "port", "path", "query", "fragment", "error")

_LEADING = "".join(f"\\u{point:04X}" for point in range(0x21))

Named = tuple[str, str | Column]


def named_columns(steps: list[Named]) -> list[Column]:
    return [(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in steps]


def staged(df: DataFrame, steps: list[Named], keep: list[str]) -> DataFrame:
    """Run ``steps`` as one projection and keep only the columns ``keep`` of them.

    The kept columns pass through a one-row ``inline``: a later filter on them is then evaluated on the result
    and not rewritten into a copy of every step, which would grow with each stage.
    """
    base = [c for c in df.columns if c not in keep]
    worked = df.select("*", *named_columns(steps))
    return worked.select(*base, F.inline_outer(F.array(F.struct(*keep))))


def after(text: str, mark: str) -> str:
    """What follows the first ``mark``, empty when there is none."""
    return f"if(instr({text}, '{mark}') > 0, substring({text}, instr({text}, '{mark}') + 1), left({text}, 0))"


def unpadded(url: str) -> str:
    """Without leading control characters and blanks, and without tabs and line breaks anywhere."""
    trimmed = f"ltrim('{_LEADING}', {url})"
    for mark in ("\\t", "\\r", "\\n"):
        trimmed = f"replace({trimmed}, '{mark}', '')"
    return trimmed


def url_steps(url: str, p: str) -> list[Named]:
    """Steps ending in ``{p}scheme/netloc/host/port/path/query/fragment/error``, all NULL for a NULL URL.

    ``{p}error`` names why a URL cannot be read (bad port or brackets).
    """
    schemes = ", ".join(f"'{s}'" for s in _PARAM_SCHEMES)
    return [
        (f"{p}clean", unpadded(url)),
        (f"{p}head", f"substring_index({p}clean, '#', 1)"),
        (f"{p}fragment", after(f"{p}clean", "#")),
        (f"{p}hier", f"substring_index({p}head, '?', 1)"),
        (f"{p}query", after(f"{p}head", "?")),
        (f"{p}scheme", rf"lower(regexp_extract({p}hier, r'\A([A-Za-z][A-Za-z0-9+.\-]*):', 1))"),
        (f"{p}rest", f"if({p}scheme != '', substring({p}hier, length({p}scheme) + 2), {p}hier)"),
        (f"{p}netloc", f"if(startswith({p}rest, '//'), substring_index(substring({p}rest, 3), '/', 1), left({p}rest, 0))"),
        (f"{p}local", f"if(startswith({p}rest, '//'), substring({p}rest, length({p}netloc) + 3), {p}rest)"),
        (f"{p}path", rf"if(contains({p}local, ';') and {p}scheme in ({schemes}), regexp_replace({p}local, r';[^/]*\z', ''), {p}local)"),
        (f"{p}site", f"substring_index({p}netloc, '@', -1)"),
        (f"{p}host", rf"lower(if(contains({p}site, '['), regexp_extract({p}site, r'\[([^\]]*)', 1), substring_index({p}site, ':', 1)))"),
        (f"{p}digits", rf"if(contains({p}site, '['), regexp_extract({p}site, r'\][^:]*:(.*)\z', 1), {after(f'{p}site', ':')})"),
        (f"{p}port", rf"case when {p}digits rlike r'\A[0-9]{{1,9}}\z' then cast({p}digits as int) end"),
        (f"{p}error", f"""case when contains({p}netloc, '[') != contains({p}netloc, ']') then 'invalid host brackets'
            when {p}digits != '' and ({p}port is null or {p}port > 65535) then 'invalid port' end"""),
    ]


def with_url_parts(df: DataFrame, column: str, prefix: str = "url_") -> DataFrame:
    """Add the eight parts of a URL column."""
    return staged(df, url_steps(column, prefix), [prefix + part for part in URL_PARTS])


def query_params(query: str, keep_blank: bool) -> str:
    """``array<struct<k, v, i>>`` of a query string in order, decoded."""
    kept = "p != ''" if keep_blank else "instr(p, '=') > 0 and instr(p, '=') < length(p)"
    return f"""transform(filter(split({query}, '&', -1), p -> {kept}), (p, i) -> named_struct(
        'k', {form_decode("substring_index(p, '=', 1)")}, 'v', {form_decode(after("p", "="))}, 'i', i))"""


def first_param(params: str, name: str) -> str:
    """Value of the first parameter called ``name`` (SQL text), NULL if absent."""
    return f"get(filter({params}, p -> p.k = {name}), 0).v"


def is_web_url(text: str) -> str:
    """True for an http(s) URL with a host part."""
    return rf"{unpadded(text)} rlike r'(?i)\Ahttps?://[^/?#]'"


def _without_dot_segments(path: str) -> str:
    """Collapse ``.``, ``..`` and empty inner segments of an absolute path."""
    return f"""concat('/', array_join(aggregate(
        filter(split({path}, '/', -1), (s, i) -> s != '' or i = size(split({path}, '/', -1)) - 1),
        cast(array() as array<string>),
        (acc, s) -> case when s = '..' then slice(acc, 1, greatest(size(acc) - 1, 0))
                         when s = '.' then acc else concat(acc, array(s)) end,
        acc -> if(element_at(split({path}, '/', -1), -1) in ('.', '..'), concat(acc, array('')), acc)), '/'))"""


def resolve(base: str, ref: str) -> str:
    """Resolve a reference against a hierarchical base URL (RFC 3986)."""
    scheme = rf"regexp_extract({base}, r'\A[^:/?#]+:', 0)"
    origin = rf"regexp_extract({base}, r'\A(?:[^:/?#]+:)?(?://[^/?#]*)?', 0)"
    base_path = rf"regexp_extract({base}, r'\A(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
    ref_path = rf"regexp_extract({ref}, r'\A[^?#]*', 0)"
    ref_tail = f"substring({ref}, length({ref_path}) + 1)"
    folder = rf"regexp_extract({base_path}, r'\A(.*/)?', 0)"
    joined = f"concat(if({folder} = '', '/', {folder}), {ref_path})"
    return rf"""case when {ref} = '' then {base}
        when {ref} rlike r'\A[A-Za-z][A-Za-z0-9+.\-]*:' then {ref}
        when startswith({ref}, '//') then concat({scheme}, {ref})
        when startswith({ref}, '/') then concat({origin}, {_without_dot_segments(ref_path)}, {ref_tail})
        when startswith({ref}, '?') then concat({origin}, {base_path}, {ref})
        when startswith({ref}, '#') then concat(substring_index({base}, '#', 1), {ref})
        else concat({origin}, {_without_dot_segments(joined)}, {ref_tail}) end"""


@F.pandas_udf(StringType())
def _decode_idn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def decode(host: str) -> str:
        try:
            return host.encode("ascii").decode("idna")
        except UnicodeError:
            return host

    for hosts in batches:
        out = pd.Series([None] * len(hosts), dtype=object)
        present = hosts.notna().to_numpy()
        if present.any():
            out[present] = [decode(h) for h in hosts[present]]
        yield out


def decode_host(host: str) -> Column:
    """Punycode hosts to Unicode. Python sees NULL for every host without ``xn--``."""
    return F.coalesce(_decode_idn(F.expr(f"if(contains({host}, 'xn--'), {host}, null)")), F.expr(host))
