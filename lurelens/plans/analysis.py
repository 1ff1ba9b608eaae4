"""From URLs and collected data to evidence, verdicts and decisions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.operators import decisions, evidence, feeds, probes, verdicts
from lurelens.operators.domains import with_registrable_domain
from lurelens.operators.intake import intake_evidence, with_intake
from lurelens.operators.lexical import lexical_evidence, lexical_signals
from lurelens.operators.overrides import apply_overrides, with_url_key
from lurelens.operators.pages import VISIBLE_TEXT_CHARS, page_fields, with_page_text
from lurelens.session import dealt, ensure_checkpoint_dir


class Collected(NamedTuple):
    """Tables somebody collected for the submitted URLs; a missing one gives no evidence."""

    dns: DataFrame | None = None
    certificates: DataFrame | None = None
    certificate_names: DataFrame | None = None
    registrations: DataFrame | None = None
    misp: DataFrame | None = None
    observables: DataFrame | None = None
    indicators: DataFrame | None = None
    urlhaus: DataFrame | None = None
    hops: DataFrame | None = None
    fetches: DataFrame | None = None
    favicons: DataFrame | None = None
    tls_prints: DataFrame | None = None
    probe_failures: DataFrame | None = None
    crawl: DataFrame | None = None
    rejects: DataFrame | None = None

    def of(self, targets: DataFrame) -> Collected:
        """The same tables without rows of other targets; tables by host or value say nothing by themselves."""
        ids = targets.select("target_id")
        own = {
            name: table.join(ids, "target_id", "left_semi") for name, table in self._asdict().items()
            if table is not None and "target_id" in table.columns
        }
        return self._replace(**own)


class Analysis(NamedTuple):
    urls: DataFrame
    evidence: DataFrame
    bundles: DataFrame
    verdicts: DataFrame
    decisions: DataFrame


def annotate(submissions: DataFrame) -> DataFrame:
    """Submissions with the columns of the intake, written once. They are dealt out by target first, so that the intake and
    what is done with its rows later is the work of many tasks, whatever the size of their file."""
    ensure_checkpoint_dir(submissions.sparkSession)
    return with_intake(dealt(submissions, "target_id")).checkpoint()


def collect_evidence(urls: DataFrame, brands: DataFrame, rules: DataFrame, data: Collected, as_of: Column) -> DataFrame:
    """All evidence of annotated URLs (``with_intake`` plus ``target_id``) in one table."""
    signals = lexical_signals(urls, brands, rules)
    parts = [intake_evidence(urls), lexical_evidence(signals)]
    hosts = signals.select("target_id", "canonical_url", "host", "registrable_domain")
    if data.dns is not None:
        parts.append(feeds.dns_evidence(hosts, data.dns))
    if data.certificates is not None and data.certificate_names is not None:
        history = feeds.certificate_history(data.certificates, as_of)
        parts.append(feeds.certificate_evidence(hosts, history, feeds.sibling_domains(data.certificates, data.certificate_names)))
    if data.registrations is not None:
        parts.append(feeds.registration_evidence(hosts, data.registrations, as_of))
    providers = _providers(data, hosts, as_of)
    if providers:
        parts.append(feeds.reputation_evidence(feeds.check_reputation(feeds.search_values(hosts, data.dns), providers)))
    if data.hops is not None:
        parts.append(probes.redirect_evidence(data.hops))
    if data.fetches is not None:
        parts.append(probes.cloaking_evidence(probes.compare_profiles(data.fetches)))
    if data.favicons is not None and data.tls_prints is not None:
        parts.append(probes.fingerprint_evidence(data.favicons, data.tls_prints))
    if data.probe_failures is not None:
        parts.append(probes.probe_errors(data.probe_failures))
    if data.crawl is not None:
        parts.append(data.crawl)
    if data.rejects is not None:
        parts.append(evidence.rejected_rows(data.rejects, "collection"))
    return evidence.union_evidence(*parts)


def _providers(data: Collected, hosts: DataFrame, as_of: Column) -> dict[str, feeds.Provider]:
    """The reputation feeds whose answers were collected."""
    found: dict[str, feeds.Provider] = {}
    if data.misp is not None:
        found["misp"] = lambda values: feeds.misp_summary(values, data.misp)
    if data.observables is not None and data.indicators is not None:
        found["opencti"] = lambda values: feeds.opencti_summary(values, data.observables, data.indicators, as_of)
    if data.urlhaus is not None:
        found["urlhaus"] = lambda values: feeds.urlhaus_matches(hosts, data.urlhaus)
    return found


def analyse(
    submissions: DataFrame, states: DataFrame, transitions: DataFrame, pages: DataFrame, fields: DataFrame | None,
    brands: DataFrame, rules: DataFrame, data: Collected, as_of: Column, answers: DataFrame | None = None,
    override_urls: DataFrame | None = None, override_domains: DataFrame | None = None,
) -> Analysis:
    """The whole analysis of ``submissions`` (``target_id, input_url``).

    URLs an override list decides leave before any costly stage, with whatever was collected for them; their verdict is
    stored with the others. Unreadable URLs, and answers that could not be read (``Collected.rejects``: ``target_id,
    reason``), become error evidence. The annotated URLs and the evidence are each written once, because several later
    steps read them.
    """
    annotated = annotate(submissions)
    readable = annotated.filter(F.col("url_error").isNull())
    rejects = annotated.filter(F.col("url_error").isNotNull()).select("target_id", F.col("url_error").alias("reason"))
    forced = None
    if override_urls is not None and override_domains is not None:
        keyed = with_url_key(readable, "canonical_url")
        keyed = with_registrable_domain(keyed.withColumn("host", F.regexp_extract("url_key", "//([^/:]+)", 1)), rules)
        matched = apply_overrides(keyed, override_urls, override_domains)
        forced, stored = decisions.override_decision(matched), decisions.override_verdicts(matched)
        readable = readable.join(forced.select("target_id"), "target_id", "left_anti")
        states, transitions, pages = (x.join(forced.select("target_id"), "target_id", "left_anti") for x in (states, transitions, pages))
        fields = fields if fields is None else fields.join(forced.select("target_id"), "target_id", "left_anti")
        data = data.of(annotated.join(forced.select("target_id"), "target_id", "left_anti"))
    rows = evidence.union_evidence(
        collect_evidence(readable, brands, rules, data, as_of), evidence.rejected_rows(rejects, "intake")
    ).checkpoint()
    targets = annotated.select(
        "target_id", "input_url", "canonical_url", "url_hash", F.col("canonical_url").alias("final_url"),
        F.when(F.col("url_error").isNull(), "done").otherwise("error").alias("status"),
    )
    if forced is not None:
        targets = targets.join(forced.select("target_id"), "target_id", "left_anti")
    shown = evidence.bundle_states(states, transitions, pages)
    bundle = evidence.bundles(targets, shown, transitions, rows, fields)
    final = verdicts.verdicts(verdicts.prefilter(bundle), answers)
    answer = decisions.decide(targets, final, decisions.signature_facts(rows, transitions))
    if forced is not None:
        answer = answer.unionByName(forced)
        final = final.unionByName(stored, allowMissingColumns=True)
    return Analysis(annotated, rows, bundle, final, answer)


def risk_listing(pages: DataFrame, brands: DataFrame, rules: DataFrame) -> DataFrame:
    """Which of these pages look risky, worst first.

    Pages ``(page_id, url, html)`` are their own single-state graphs: intake, lexical score, form fields, bundle, rules
    and decision. The scored URLs are written once and read by every later step; page
    texts stay where they are, only their summaries are shuffled.
    """
    named = pages.withColumn("target_id", F.col("page_id").cast("string"))
    submissions = named.select("target_id", F.col("url").alias("input_url"))
    scored = lexical_signals(with_intake(submissions), brands, rules).select(
        "target_id", "input_url", "canonical_url", "lexical_signals", "lexical_risk_score",
        F.coalesce("typosquat.distance", F.lit(0)).alias("lookalike_distance"),
    )
    ensure_checkpoint_dir(pages.sparkSession)
    scored = scored.checkpoint()
    rows = lexical_evidence(scored)
    contents = with_page_text(named, max_chars=VISIBLE_TEXT_CHARS)
    states = contents.select(
        "target_id", F.col("target_id").alias("state_id"), "url", F.lit(0).alias("depth"), F.lit(True).alias("is_leaf"),
        "title", "visible_text", F.lit("").alias("ocr_text"),
    )
    transitions = pages.sparkSession.createDataFrame([], "target_id string, from_state string, to_state string, kind string")
    targets = scored.select("target_id", "input_url", F.col("canonical_url").alias("final_url"), F.lit("done").alias("status"))
    bundle = evidence.bundles(targets, states, transitions, rows, page_fields(named, "target_id"))
    final = verdicts.verdicts(verdicts.prefilter(bundle))
    answer = decisions.decide(targets, final, decisions.signature_facts(rows))
    listed = scored.drop("lexical_signals").join(final.select("target_id", "classification", "produced_by"), "target_id")
    return listed.join(answer.drop("reason"), "target_id").orderBy(
        F.col("lexical_risk_score").desc(), F.col("confidence").desc(), "target_id"
    )
