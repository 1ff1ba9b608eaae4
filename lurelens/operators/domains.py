"""Registrable domains and look-alike brand domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.functions.joins import is_short

# Brand lists up to this many domains are matched by length bucket, larger ones by deletion keys.
BUCKET_MATCH_LIMIT = 5_000
# Suffix rule tables up to this many rows are held by every task (the full public list has about 10,000).
RULE_BROADCAST_LIMIT = 50_000
MAX_DISTANCE = 2


def with_registrable_domain(
    df: DataFrame, rules: DataFrame, host: str = "host", out: str = "registrable_domain",
) -> DataFrame:
    """Add the public suffix plus one label; hosts without a known suffix come back whole.

    ``rules``: one row per suffix, ``suffix, labels, exact, wildcard, exception``. One equi join per number of labels
    that the table has. The rules are counted once: a short table is broadcast, so that no URL is shuffled by a suffix
    half the table shares; a longer one joins as Spark decides.
    """
    # a host name has 127 labels at most, so this is a short list
    sizes = {row["labels"]: row["n"] for row in rules.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = sum(sizes.values()) <= RULE_BROADCAST_LIMIT
    df = df.withColumn("_host", F.lower(F.regexp_replace(F.col(host), r"\A\.+|\.+\z", "")))
    df = df.withColumn("_labels", F.split("_host", r"\."))
    size = F.size("_labels")
    lengths, exceptions = [], []
    for n in sorted(sizes):
        key = f"_suffix{n}"
        side = rules.filter(F.col("labels") == n).select(
            F.col("suffix").alias(key), F.struct("exact", "wildcard", "exception").alias(f"_rule{n}")
        )
        tail = F.when(size >= n, F.array_join(F.slice("_labels", -n, n), "."))
        df = df.withColumn(key, tail).join(F.broadcast(side) if short else side, key, "left")
        rule = F.col(f"_rule{n}")
        lengths.append(F.when(rule["wildcard"] & (size > n), n + 1).when(rule["exact"], n))
        exceptions.append(F.when(rule["exception"], n - 1))
    df = df.withColumn("_len", F.coalesce(*exceptions, *_longest(lengths), F.lit(None).cast("int")))
    length = F.col("_len")
    domain = (
        F.when(length.isNull(), F.col("_host"))
        .when(size == length, F.concat(F.lit("."), F.col("_host")))
        .otherwise(F.array_join(F.slice(F.col("_labels"), -(length + 1), length + 1), "."))
    )
    temporary = ["_host", "_labels", "_len"]
    temporary += [f"_{part}{n}" for n in sizes for part in ("suffix", "rule")]
    return df.withColumn(out, domain).drop(*temporary)


def _longest(lengths: list[Column]) -> list[Column]:
    return [F.greatest(*lengths)] if len(lengths) > 1 else lengths


def _alignment_distance(a: Column, b: Column) -> Column:
    """Edit distance with adjacent transpositions, no substring edited twice (two-row recurrence)."""
    char = lambda text, i: F.substring(text, i, F.lit(1))

    def cell(rows: Column, i: Column, row: Column, j: Column) -> Column:
        same = char(a, i) == char(b, j)
        crossed = (i > 1) & (j > 1) & (char(a, i) == char(b, j - 1)) & (char(a, i - 1) == char(b, j))
        return F.least(
            F.get(rows["prev"], j) + 1,
            F.get(row, j - 1) + 1,
            F.get(rows["prev"], j - 1) + F.when(same, 0).otherwise(1),
            F.when(crossed, F.get(rows["prev2"], j - 2) + 1),
        )

    start = F.struct(F.array().cast("array<int>").alias("prev2"), F.sequence(F.lit(0), F.length(b)).alias("prev"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.length(a)),
        start,
        lambda rows, i: F.struct(
            rows["prev"].alias("prev2"),
            F.aggregate(
                F.sequence(F.lit(1), F.length(b)),
                F.array(i),
                lambda row, j: F.concat(row, F.array(cell(rows, i, row, j))),
            ).alias("prev"),
        ),
    )
    return F.get(table["prev"], F.length(b))


def alignment_distance(a: Column, b: Column) -> Column:
    return (
        F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(_alignment_distance(a, b))
    )


def _is_one_swap(a: Column, b: Column) -> Column:
    """Whether exchanging two neighbouring characters of ``a`` gives ``b``."""
    swapped = lambda i: F.concat(
        F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)),
        F.substring(a, i + 2, F.length(a)),
    )
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    return (F.length(a) == F.length(b)) & F.exists(places, lambda i: swapped(i) == b)


def sorted_letters(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def maybe_near(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """Cheap test that no pair within distance 2 fails.

    Levenshtein is at most twice the distance, and above 2 only if a swap took part; then at most one letter differs.
    """
    return (F.levenshtein(a, b, 2 * MAX_DISTANCE) >= 0) & (
        (F.levenshtein(a, b, MAX_DISTANCE) >= 0) | (F.levenshtein(a_letters, b_letters, MAX_DISTANCE) >= 0)
    )


def near_distance(a: Column, b: Column) -> Column:
    """``alignment_distance`` of a pair that is likely near: the full recurrence runs only if a swap is mixed with edits."""
    edits = F.levenshtein(a, b, MAX_DISTANCE)
    return (
        F.when(edits == 1, 1)
        .when(edits == 2, F.when(_is_one_swap(a, b), 1).otherwise(2))
        .otherwise(alignment_distance(a, b))
    )


def _deletion_keys(text: Column) -> Column:
    """Every string left after deleting at most two characters."""
    def shorter(word: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
            lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
        )

    once = F.array_distinct(shorter(text))
    return F.array_distinct(F.concat(F.array(text), once, F.flatten(F.transform(once, shorter))))


def _candidates(domains: DataFrame, brands: DataFrame, by_deletion: bool, short: bool) -> DataFrame:
    if by_deletion:
        left = domains.select("domain", F.explode(_deletion_keys(F.col("domain"))).alias("_key"))
        right = brands.select("*", F.explode(_deletion_keys(F.col("matched_domain"))).alias("_key"))
        return left.join(right, "_key").drop("_key").dropDuplicates(["domain", "matched_domain", "ord"])
    lengths = F.sequence(F.length("domain") - MAX_DISTANCE, F.length("domain") + MAX_DISTANCE)
    left = domains.select("domain", F.explode(lengths).alias("_key"))
    right = brands.withColumn("_key", F.length("matched_domain"))
    return left.join(F.broadcast(right) if short else right, "_key").drop("_key")


def typosquat(
    domains: DataFrame, brands: DataFrame, exclude_known: bool = False, by_deletion: bool | None = None
) -> DataFrame:
    """Closest brand domain at distance 1 or 2: ``(domain, brand, matched_domain, distance)``.

    Work is done once per distinct domain. A short brand list joins on length buckets (map-side); a list
    over ``BUCKET_MATCH_LIMIT`` joins on shared deletion keys, which no pair within distance 2 can miss.
    Levenshtein (at most twice the alignment distance) discards most pairs before the exact distance.
    """
    known = brands.select("brand", F.col("domain").alias("matched_domain"), "ord")
    short = is_short(brands, BUCKET_MATCH_LIMIT)
    if by_deletion is None:
        by_deletion = not short
    unique = domains.select("domain").filter(F.length("domain") > 0).distinct()
    if exclude_known:
        unique = unique.join(known.select(F.col("matched_domain").alias("domain")), "domain", "left_anti")
    domain, matched = F.col("domain"), F.col("matched_domain")
    near = _candidates(unique, known, by_deletion, short).filter(
        (domain != matched) & maybe_near(domain, matched, sorted_letters(domain), sorted_letters(matched))
    )
    scored = near.withColumn("distance", near_distance(domain, matched)).filter(F.col("distance") <= MAX_DISTANCE)
    best = scored.groupBy("domain").agg(F.min(F.struct("distance", "ord", "brand", "matched_domain")).alias("m"))
    return best.select("domain", "m.brand", "m.matched_domain", "m.distance")


def with_lookalike(df: DataFrame, brands: DataFrame, domain: str = "registrable_domain", out: str = "typosquat") -> DataFrame:
    """Add the closest brand domain as ``struct<brand, matched_domain, distance>``, NULL when none is near.

    A short brand list becomes a scalar subquery that every task holds, so URLs are neither shuffled nor read
    a second time. A longer one is matched per distinct domain and joined back.
    """
    if not is_short(brands, BUCKET_MATCH_LIMIT):
        matches = typosquat(df.select(F.col(domain).alias("domain")), brands, by_deletion=True)
        found = F.struct("brand", "matched_domain", "distance").alias(out)
        return df.join(matches.select(F.col("domain").alias(domain), found), domain, "left")
    entry = F.struct("ord", "brand", F.col("domain").alias("matched_domain"), sorted_letters(F.col("domain")).alias("letters"))
    df = df.withColumn("_brands", brands.agg(F.collect_list(entry)).scalar())
    df, name = df.withColumn("_letters", sorted_letters(F.col(domain))), F.col(domain)
    near = F.filter("_brands", lambda b: (
        (F.abs(F.length(name) - F.length(b["matched_domain"])) <= MAX_DISTANCE) & (name != b["matched_domain"])
        & maybe_near(name, b["matched_domain"], F.col("_letters"), b["letters"])
    ))
    scored = F.transform(F.when(name != "", near), lambda b: F.struct(
        near_distance(name, b["matched_domain"]).alias("distance"), b["ord"], b["brand"], b["matched_domain"]
    ))
    best = F.array_min(F.filter(scored, lambda m: m["distance"] <= MAX_DISTANCE))
    df = df.withColumn("_near", best)
    near = F.col("_near")
    found = F.struct(*(near[c].alias(c) for c in ("brand", "matched_domain", "distance")))
    return df.withColumn(out, F.when(near.isNotNull(), found)).drop("_near", "_brands", "_letters")
