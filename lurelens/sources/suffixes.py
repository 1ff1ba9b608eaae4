"""A small public-suffix rule table; pass the full list as a DataFrame for production use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A curated part of the public suffix rules (public section first, then private).
SUFFIX_RULES = """
com net org edu gov mil int info biz name pro mobi eu dev app io co me tv cc ws online site shop top xyz club
cloud page link live icu vip work space website store tech digital email agency support center services
it fr de es pt nl be ch at pl cz se no dk fi ie gr ro hu bg hr si sk lt lv ee lu uk us ca mx br ar cl
pe ru ua tr il in cn jp kr tw hk sg my th vn id ph au nz za ng ke eg ma sa ae ir pk bd tk ml ga cf gq
co.uk org.uk gov.uk ac.uk com.br gov.br com.mx gob.mx co.in gov.in com.au gov.au co.jp co.kr co.za com.ar com.tr
com.cn com.tw com.hk com.sg com.my gov.it edu.it go.id co.id
*.ck !www.ck
workers.dev pages.dev r2.dev web.app firebaseapp.com blogspot.com github.io netlify.app vercel.app herokuapp.com
trycloudflare.com ngrok.io ngrok-free.app loca.lt blob.core.windows.net azurewebsites.net
""".split()


_SCHEMA = "suffix string, labels int, exact boolean, wildcard boolean, exception boolean"


def suffix_rules(spark: SparkSession, rules: list[str] | None = None) -> DataFrame:
    """The rule table ``(suffix, labels, exact, wildcard, exception)``, one row per suffix, from list notation."""
    kinds: dict[str, set[str]] = {}
    for rule in rules or SUFFIX_RULES:
        kind = "wildcard" if rule.startswith("*.") else "exception" if rule.startswith("!") else "exact"
        kinds.setdefault(rule.removeprefix("*.").removeprefix("!").lower(), set()).add(kind)
    rows = [
        (suffix, suffix.count(".") + 1, "exact" in found, "wildcard" in found, "exception" in found)
        for suffix, found in kinds.items()
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def parse_rules(raw: DataFrame) -> DataFrame:
    """The same table from a DataFrame of list lines (column ``rule``); comments and blank lines are skipped."""
    rule = F.lower(F.trim("rule"))
    suffix = F.regexp_replace(rule, r"\A(\*\.|!)", "")
    exception, wildcard = rule.startswith("!"), rule.startswith("*.")
    lines = raw.filter((rule != "") & ~rule.startswith("//")).select(
        suffix.alias("suffix"), wildcard.alias("wildcard"), exception.alias("exception")
    )
    return lines.groupBy("suffix").agg(
        F.first(F.size(F.split("suffix", r"\."))).alias("labels"),
        F.bool_or(~F.col("wildcard") & ~F.col("exception")).alias("exact"),
        F.bool_or("wildcard").alias("wildcard"), F.bool_or("exception").alias("exception"),
    )
