"""Page snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelens.operators import pages as jobs
from lurelens.session import stored
from workload.registry import Inputs, query

# What the given pages lack is added to the end of each whole page, the same way in both engines.
_EXTRA = """concat(html,
    '<div nonce="', cast(page_id as varchar(20)), '" data-ts="17400', cast(10000 + page_id as varchar(20)), '">x</div>',
    '<meta http-equiv="Refresh" content="3; URL=/next/', cast(page_id % 5 as varchar(20)), '">',
    case when page_id % 3 = 0 then '<iframe class="a" src="https://challenges.cloudflare.com/x"></iframe>'
      when page_id % 3 = 1 then '<iframe src="/local"></iframe><iframe src="https://www.google.com/recaptcha/api2"></iframe>' else '' end,
    '<form><label for="u">Your  Email</label><input id="u" type="email" name="user"><label>Pass <input type=password id="p"></label>',
    '<input type="hidden" name="csrf" value="', cast(page_id as varchar(20)), '"><select name="s"><option>1</option></select></form>')"""


def _plus(t: Inputs):
    return t.sql(f"select page_id, url, {_EXTRA} as html from pages")


_TEXT = r"""
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'),
      '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', '', 'g')"""


@query(rf"""
    with t as (select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title,
      trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({_TEXT}, '<[^>]+>', ' ', 'g'),
        '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')) as visible_text from pages)
    select page_id, title, length(visible_text) as n_chars, sha256(visible_text) as text_hash from t""")
def page_text(t: Inputs):
    df = jobs.with_page_text(t.pages)
    return df.select(
        "page_id", "title", F.length("visible_text").cast("long").alias("n_chars"), F.sha2("visible_text", 256).alias("text_hash")
    )


@query("""
    with captures as (
      select page_id, capture, html, capture = 'other' as changed from pages, (values ('first'), ('second'), ('open'), ('other')) as c(capture)),
    alike as (select html, changed, min(page_id) as state, count(*) as captures from captures group by html, changed)
    select page_id, capture, state, alike.captures from captures join alike using (html, changed)""")
def page_state_hashes(t: Inputs):
    """Captures of every page: two that differ in nonce, timestamp and token only, one without the tags that part head
    and body, one with another text. Equal states are named after their first page and counted."""
    noise = lambda kind: f"""concat(html, '<div data-ts="17{kind}0000', cast(10000 + page_id as varchar(20)), '" nonce="{kind}">x</div>',
        '<input name="csrf-token" value="{kind}', cast(page_id as varchar(20)), '"><b title="z" class="c">k</b>')"""  # noqa: E731
    captures = {
        "first": noise("4"), "second": f"""replace({noise("5")}, 'title="z" class="c"', 'class="c" title="z"')""",
        "open": f"regexp_replace({noise('6')}, '(?i)</head>|</?body[^>]*>', '')", "other": f"concat({noise('4')}, '<p>changed</p>')",
    }
    rows = t.sql(" union all ".join(f"select page_id, '{name}' as capture, {html} as html from pages" for name, html in captures.items()))
    # parsed once: the states and the captures that they name read the same hashes
    hashed = stored(jobs.with_dom_hash(rows).select("page_id", "capture", "dom_hash"), "hashes")
    states = hashed.groupBy("dom_hash").agg(F.min("page_id").alias("state"), F.count("*").alias("captures"))
    return hashed.join(states, "dom_hash").drop("dom_hash")


@query("""
    select page_id, url as from_url, concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), '/next/', cast(page_id % 5 as varchar)) as to_url,
      'meta_refresh' as kind from pages""")
def meta_refresh_edges(t: Inputs):
    return jobs.meta_refresh_edges(_plus(t)).drop("ord")


@query("""
    select page_id, unnest(['input', 'input', 'select']) as tag, unnest(['email', 'password', 'select']) as type,
      unnest(['user', 'p', 's']) as name_or_id, unnest(['Your Email', 'Pass', 'Pass']) as label from pages""")
def form_fields(t: Inputs):
    fields = jobs.page_fields(_plus(t))
    # the select has no label of its own: the nearest text before it is that of the password label
    return fields.select("page_id", "tag", "type", "name_or_id", F.col("nearby_label_text").alias("label"))


@query("""
    select page_id, case page_id % 3 when 0 then 'cloudflare_turnstile' else 'recaptcha' end as provider
    from pages where page_id % 3 < 2""")
def challenge_gates(t: Inputs):
    return jobs.detect_gates(_plus(t))


@query("""
    select page_id, min(ord) as ord, url as to_url, 'js_location' as kind from nav_log where url <> '' group by page_id, url""")
def script_redirects(t: Inputs):
    return jobs.script_redirects(t.nav_log)


_RANKED = """
    visible as (select *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' ' || lower(trim(regexp_replace(coalesce(aria_label, ''), '\\s+', ' ', 'g'))) as label
      from elements where width >= 4 and height >= 4 and y + height >= 0 and y <= vp_h and x + width >= 0 and x <= vp_w),
    scored as (select page_id, ord, selector,
        0.5e0 * case when regexp_matches(label, {whole}) then 1e0 when regexp_matches(label, {part}) then 0.6e0 else 0e0 end
        + 0.3e0 * (0.6e0 * least(width * height / (vp_w * vp_h * 0.25e0), 1e0)
          + 0.4e0 * (1e0 - least(sqrt(pow(x + width / 2 - vp_w / 2, 2) + pow(y + height / 2 - vp_h / 2, 2)) / sqrt(pow(vp_w / 2, 2) + pow(vp_h / 2, 2)), 1e0)))
        + 0.2e0 * case when y < vp_h * 0.6e0 then 1e0 else 0.3e0 end as s from visible),
    ranked as (select *, row_number() over (partition by page_id order by round(s, 4) desc, ord) as rank from scored)
""".format(
    whole="'" + "|".join(jobs.ACTION_WORDS) + "'",
    part="'" + "|".join(sorted({w for p in jobs.ACTION_WORDS for w in p.split() if len(w) >= 3})) + "'",
)


@query(f"with {_RANKED} select page_id, selector, rank, round(s, 4) as score from ranked where rank <= 5")
def ranked_elements(t: Inputs):
    top = jobs.rank_elements(t.elements, 5)
    return top.select("page_id", "selector", F.col("rank").cast("long").alias("rank"), F.col("combined_score").alias("score"))
