"""Lexical risk of a URL's host: look-alikes, random names, abused hosting, IP literals, mixed scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.functions.url import URL_PARTS, with_url_parts
from lurelens.operators.domains import with_lookalike, with_registrable_domain
from lurelens.schemas import as_json, emit

# Weights and thresholds of the lexical signals.
WEIGHT_TYPOSQUAT_1 = 0.30
WEIGHT_TYPOSQUAT_2 = 0.15
WEIGHT_DGA = 0.25
WEIGHT_INFRA = 0.20
WEIGHT_IP = 0.15
WEIGHT_MIXED = 0.25
WEIGHT_EMAIL = 0.40
DGA_STRONG = 0.6
DGA_BORDERLINE = 0.3
DGA_MIX = {"entropy": 0.35, "consonants": 0.35, "digits": 0.30}
ENTROPY_FLOOR = 3.0
CONSONANT_RANGE = (0.5, 4.0)
DIGIT_SHARE = 0.30

# Hosting that is often abused; the first match wins.
INFRA_PATTERNS = (
    ("cloudflare-workers", r"\.workers\.dev\z"),
    ("cloudflare-pages", r"\.pages\.dev\z"),
    ("cloudflare-r2", r"\.r2\.dev\z"),
    ("azure-blob", r"\.blob\.core\.windows\.net\z"),
    ("firebase-hosting", r"\.web\.app\z"),
    ("firebase-app", r"\.firebaseapp\.com\z"),
    ("ipfs-gateway", r"ipfs\.io/ipfs/|\.ipfs\.dweb\.link\z|cloudflare-ipfs\.com"),
    ("cloudflare-tunnel", r"\.trycloudflare\.com\z"),
    ("ngrok-tunnel", r"\.ngrok\.io\z|\.ngrok-free\.app\z"),
    ("loca-lt-tunnel", r"\.loca\.lt\z"),
)

# Letter ranges of the scripts used in look-alike hosts.
SCRIPTS = (r"[a-zA-Z]", r"[\x{0400}-\x{04ff}]", r"[\x{0370}-\x{03ff}]", r"[\x{0530}-\x{058f}]")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = r"[0-9a-fA-F]{1,4}"


def entropy(text: Column) -> Column:
    """Shannon bits per character."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    return F.when(F.length(text) == 0, 0.0).otherwise(
        F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    )


def _count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def dga_score(host: Column) -> Column:
    """0-1 score of how machine-made a host name looks; the last label is ignored."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    labels = F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    labels = F.filter(labels, lambda x: F.length(x) >= 3)

    def add(total: Column, label: Column) -> Column:
        vowels, consonants = _count_of(label, "aeiou"), _count_of(label, "bcdfghjklmnpqrstvwxyz")
        ratio, digits = consonants / vowels, _count_of(label, "0123456789") / F.length(label)
        odd = F.when(vowels > 0, (ratio < CONSONANT_RANGE[0]) | (ratio > CONSONANT_RANGE[1])).otherwise(consonants > 0)
        return F.struct(
            (total["entropy"] + entropy(label)).alias("entropy"),
            (total["odd"] + F.when(odd, 1.0).otherwise(0.0)).alias("odd"),
            (total["digits"] + F.when(digits > DIGIT_SHARE, digits).otherwise(0.0)).alias("digits"),
            (total["n"] + 1).alias("n"),
        )

    def score(total: Column) -> Column:
        mean = lambda field: total[field] / total["n"]
        excess = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean("entropy") - ENTROPY_FLOOR) / 2.0))
        mix = (
            DGA_MIX["entropy"] * excess
            + DGA_MIX["consonants"] * F.least(F.lit(1.0), mean("odd"))
            + DGA_MIX["digits"] * F.least(F.lit(1.0), mean("digits"))
        )
        return F.when(total["n"] == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), mix), 4))

    start = F.struct(F.lit(0.0).alias("entropy"), F.lit(0.0).alias("odd"), F.lit(0.0).alias("digits"), F.lit(0).alias("n"))
    return F.aggregate(labels, start, add, score)


def infra_category(host: Column) -> Column:
    category = F.lit(None).cast("string")
    for name, pattern in reversed(INFRA_PATTERNS):
        category = F.when(host.rlike(f"(?i)(?:{pattern})"), name).otherwise(category)
    return category


def is_ip_literal(host: Column) -> Column:
    """IPv4 without leading zeros, or IPv6 with at most one ``::``, an IPv4 tail and a zone allowed."""
    bare = F.regexp_replace(host, r"\A[\[\]]+|[\[\]]+\z", "")
    v6 = F.regexp_replace(F.regexp_replace(bare, r"%[^%/]+\z", ""), rf":{_IPV4}\z", ":0:0")
    groups = F.size(F.filter(F.split(v6, ":"), lambda g: g != ""))
    shaped = v6.rlike(rf"\A(?:{_GROUP}(?::{_GROUP})*)?(?:::)?(?:{_GROUP}(?::{_GROUP})*)?\z")
    squeezed = F.size(F.split(v6, "::", -1)) == 2
    return bare.rlike(rf"\A{_IPV4}\z") | (
        shaped & v6.contains(":") & F.when(squeezed, groups <= 7).otherwise(groups == 8)
    )


def has_mixed_script(host: Column) -> Column:
    seen = sum((F.when(host.rlike(block), 1).otherwise(0) for block in SCRIPTS), F.lit(0))
    return seen >= 2


def with_host_signals(df: DataFrame, host: str = "host") -> DataFrame:
    """Add the per-host measures as plain columns."""
    name = F.col(host)
    return df.withColumns({
        "dga_score": F.when(name != "", dga_score(name)).otherwise(0.0),
        "infra_category": F.when(name != "", infra_category(name)),
        "ip_literal": (name != "") & is_ip_literal(name),
        "mixed_script": (name != "") & has_mixed_script(name),
    })


def lexical_signals(urls: DataFrame, brands: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``lexical_signals`` (array of key, value, weight) and ``lexical_risk_score`` to canonical URLs.

    Expects ``canonical_url`` and, when the URL went through intake, ``nested_payloads``. With a
    brand list and suffix rules of ordinary size all of it is one pass without a shuffle.
    """
    df = with_url_parts(urls, "canonical_url", "_x_").withColumn("host", F.col("_x_host"))
    df = df.drop(*(f"_x_{part}" for part in URL_PARTS))
    df = with_host_signals(with_registrable_domain(df, rules))
    df = with_lookalike(df, brands)
    match, dga, host = F.col("typosquat"), F.col("dga_score"), F.col("host")
    if "nested_payloads" in df.columns:
        emails = F.transform(F.filter("nested_payloads", lambda p: p["kind"] == "email"), lambda p: p["decoded"])
    else:
        emails = F.array().cast("array<string>")

    def signal(when: Column, key: str, value: Column, weight: Column | float) -> Column:
        weight = F.lit(weight) if isinstance(weight, float) else weight
        return F.when(when, F.struct(F.lit(key).alias("key"), value.alias("value"), weight.alias("weight")))

    scored = as_json(dga.alias("score"), host.alias("hostname"))
    just_host = as_json(host.alias("hostname"))
    closeness = F.when(match["distance"] == 1, WEIGHT_TYPOSQUAT_1).otherwise(WEIGHT_TYPOSQUAT_2)
    fired = F.array(
        signal(match.isNotNull() & (host != ""), "typosquat", F.to_json(match), closeness),
        signal(dga > DGA_STRONG, "dga_score", scored, WEIGHT_DGA),
        signal(
            F.col("infra_category").isNotNull(), "abuse_prone_infra",
            as_json(F.col("infra_category").alias("category"), host.alias("hostname")), WEIGHT_INFRA,
        ),
        signal(F.col("ip_literal"), "ip_literal", just_host, WEIGHT_IP),
        signal(F.col("mixed_script"), "mixed_script", just_host, WEIGHT_MIXED),
        signal(
            F.size(emails) > 0, "aitm_email_payload",
            as_json(F.size(emails).alias("count"), emails.alias("emails")), WEIGHT_EMAIL,
        ),
        signal((dga > DGA_BORDERLINE) & (dga <= DGA_STRONG), "dga_borderline", scored, 0.0),
    )
    df = df.withColumn("lexical_signals", F.filter(fired, lambda s: s.isNotNull()))
    total = F.aggregate("lexical_signals", F.lit(0.0), lambda acc, s: acc + s["weight"])
    return df.withColumn("lexical_risk_score", F.round(F.least(F.lit(1.0), total), 4))


def lexical_evidence(signals: DataFrame) -> DataFrame:
    """Evidence rows of annotated URLs: one per signal that fired, none for absence."""
    rows = signals.select("target_id", F.explode_outer("lexical_signals").alias("s")).filter("s is not null")
    return emit(rows, "L1", F.col("s.key"), F.col("s.value"), F.col("s.weight"), "lexical")
