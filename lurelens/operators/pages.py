"""Page snapshots: title, visible text, state hash, passive edges, form fields, challenge gates, click ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from lurelens.functions.html import canonical_markup, form_fields
from lurelens.functions.text import SPACE, SPACE_CHARS, collapse_space
from lurelens.functions.url import resolve

# Entities decoded in visible text, in this order.
TEXT_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "))
VISIBLE_TEXT_CHARS = 1500

# Challenge providers by iframe address, in order of preference.
GATES = (
    ("challenges.cloudflare.com", "cloudflare_turnstile"),
    ("hcaptcha.com", "hcaptcha"),
    ("google.com/recaptcha", "recaptcha"),
)

# Weights and words of the click ranking.
WEIGHT_KEYWORD, WEIGHT_SALIENCE, WEIGHT_POSITION = 0.50, 0.30, 0.20
WEIGHT_AREA, WEIGHT_CENTRE = 0.60, 0.40
ABOVE_FOLD, BELOW_FOLD, FOLD = 1.0, 0.3, 0.6
AREA_SATURATION = 0.25
MIN_SIDE = 4
PARTIAL_KEYWORD = 0.6
ACTION_WORDS = (
    "verify", "continue", "view document", "unlock", "sign in", "proceed", "open", "download", "confirm",
    "next", "submit", "accept", "allow", "login", "log in", "register", "sign up", "get started",
    "try again", "retry", "update", "install", "enable", "access", "view", "read more", "show more",
    "expand", "play", "start",
)

_META_TAG = r"(?is)(<meta\b[^>]*>)"
_IFRAME_SRC = r"(?is)<iframe\b[^>]*?\ssrc\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH_URL = r"(?i)url\s*=\s*[\"']?([^\"'\s;]+)"
_FIELD = "tag string, type string, name_or_id string, nearby_label_text string"


def title(html: Column) -> Column:
    """Trimmed content of the first ``<title>``, empty when there is none."""
    return F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(SPACE_CHARS))


def visible_text(html: Column, max_chars: int | None = None) -> Column:
    """Text without scripts, styles and tags; the evidence bundle asks for the first 1500 characters."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in TEXT_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def with_page_text(pages: DataFrame, html: str = "html", max_chars: int | None = None) -> DataFrame:
    return pages.withColumns({"title": title(F.col(html)), "visible_text": visible_text(F.col(html), max_chars)})


@F.pandas_udf(StringType())
def _canonical_markup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(canonical_markup, na_action="ignore")


def with_dom_hash(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``dom_hash``: SHA-256 of the page with request-specific attributes removed.

    Parsing needs Python; the hash is built in.
    """
    return pages.withColumn("dom_hash", F.sha2(_canonical_markup(F.col(html)), 256))


def page_fields(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """One row per field a visitor would fill in: tag, type, name or id, label. Pages without one give no rows."""
    id_type = dict(pages.dtypes)[id_column]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (key, i, f["tag"], f["type"], f["name_or_id"], f["nearby_label_text"])
                for key, page in zip(batch[id_column], batch[html]) if page
                for i, f in enumerate(form_fields(page))
            ]
            yield pd.DataFrame(found, columns=[id_column, "ord", "tag", "type", "name_or_id", "nearby_label_text"])

    may_have = F.col(html).rlike(r"(?i)<(input|select|textarea)\b")
    return pages.filter(may_have).select(id_column, html).mapInPandas(rows, f"{id_column} {id_type}, ord int, {_FIELD}")


def _attribute(tag: Column, name: str) -> Column:
    quoted = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}([^{q}]*){q}", 1) for q in ("\"", "'")]
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.coalesce(*(F.nullif(value, F.lit("")) for value in (*quoted, bare)))


def meta_refresh_edges(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """``(page_id, ord, from_url, to_url, kind)`` of refresh tags, relative targets resolved."""
    tags = pages.filter(F.col("html").rlike("(?i)<meta")).select(
        id_column, F.col("url").alias("from_url"),
        F.posexplode(F.regexp_extract_all("html", F.lit(_META_TAG), F.lit(1))).alias("ord", "tag"),
    )
    tags = tags.filter(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    ref = F.nullif(F.regexp_extract(_attribute(F.col("tag"), "content"), _REFRESH_URL, 1), F.lit(""))
    edges = tags.withColumn("ref", ref).filter(F.col("ref").isNotNull())
    return edges.select(id_column, "ord", "from_url", F.expr(resolve("from_url", "ref")).alias("to_url"), F.lit("meta_refresh").alias("kind"))


def detect_gates(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """``(page_id, provider)`` of pages whose first recognised iframe belongs to a challenge provider."""
    frames = pages.filter(F.col("html").rlike("(?i)<iframe")).select(
        id_column, F.regexp_extract_all("html", F.lit(_IFRAME_SRC), F.lit(1)).alias("srcs")
    )

    def provider(src: Column) -> Column:
        name = F.lit(None).cast("string")
        for domain, label in reversed(GATES):
            name = F.when(src.contains(domain), label).otherwise(name)
        return name

    found = F.get(F.filter(F.transform("srcs", provider), lambda p: p.isNotNull()), 0)
    return frames.select(id_column, found.alias("provider")).filter(F.col("provider").isNotNull())


def script_redirects(nav_log: DataFrame, id_column: str = "page_id") -> DataFrame:
    """``js_location`` edges of recorded script navigations: empty targets dropped, one edge per page and URL."""
    seen = nav_log.filter(F.coalesce("url", F.lit("")) != "")
    edges = seen.groupBy(id_column, "url").agg(F.min("ord").alias("ord"))
    return edges.select(id_column, "ord", F.col("url").alias("to_url"), F.lit("js_location").alias("kind"))


def _keyword_score(text: Column) -> Column:
    """1.0 for a whole action phrase, 0.6 for one of its words inside a word, else 0."""
    words = sorted({w for phrase in ACTION_WORDS for w in phrase.split() if len(w) >= 3})
    whole, part = "|".join(ACTION_WORDS), "|".join(words)
    return F.when(text.rlike(whole), 1.0).when(text.rlike(part), PARTIAL_KEYWORD).otherwise(0.0)


def score_elements(elements: DataFrame) -> DataFrame:
    """Add ``combined_score`` to visible elements: action words, size and centrality, place above the fold.

    ``elements``: ``page_id, selector, text, aria_label, x, y, width, height, vp_w, vp_h``.
    """
    e = F.expr
    visible = elements.filter(
        f"width >= {MIN_SIDE} and height >= {MIN_SIDE} and y + height >= 0 and y <= vp_h and x + width >= 0 and x <= vp_w"
    )
    label = e(
        "concat(lower(" + collapse_space("coalesce(text, '')") + "), ' ', lower(" + collapse_space("coalesce(aria_label, '')") + "))"
    )
    area = F.least(e(f"(width * height) / (vp_w * vp_h * {AREA_SATURATION}d)"), F.lit(1.0))
    distance = e("sqrt(pow(x + width / 2d - vp_w / 2d, 2) + pow(y + height / 2d - vp_h / 2d, 2))")
    centre = 1.0 - F.least(distance / e("sqrt(pow(vp_w / 2d, 2) + pow(vp_h / 2d, 2))"), F.lit(1.0))
    position = F.when(F.col("y") < F.col("vp_h") * FOLD, ABOVE_FOLD).otherwise(BELOW_FOLD)
    combined = (
        WEIGHT_KEYWORD * _keyword_score(label)
        + WEIGHT_SALIENCE * (WEIGHT_AREA * area + WEIGHT_CENTRE * centre)
        + WEIGHT_POSITION * position
    )
    return visible.withColumn("combined_score", F.round(combined, 4))


def rank_elements(elements: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most promising elements per page, best first; the limit is applied before the shuffle."""
    order = W.partitionBy("page_id").orderBy(F.col("combined_score").desc(), "ord")
    scored = score_elements(elements).withColumn("rank", F.row_number().over(order))
    return scored.filter(F.col("rank") <= top_n)
