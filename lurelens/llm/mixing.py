"""Soft-membership mixing: domain posteriors from a labelled table, and document rates that meet domain targets."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lurelens.llm.common import named, stored, token

#: Bound of the training sample, in labelled documents, each with its whole text.
SAMPLE_DOCS = 20_000
FEATURES = 1 << 16
#: Standard deviations by which a feature's count must be off in some domain to count as evidence.
SIGNIFICANT = 4.0
#: Pairs of labels are domains; more kinds than these are no labels but keys.
MAX_DOMAINS = 64
#: One of so many labelled documents of the sample is held out to calibrate the posteriors.
HELD_OUT = 5
#: What a change of all rates counts against the distance to the targets: it settles which of many right rates are taken, and
#: how near targets out of reach are met.
RIDGE = 1e-7
TOLERANCE = 1e-9
#: Share of all tokens by which a domain's total may miss its target and still count as met.
MET = 1e-3


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over the hashed words that a text has: log odds of each feature and the prior log odds, against the
    first domain. Features that no domain has significantly more or less often than the others have odds of 0."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    odds: np.ndarray  # domains but the first, by feature
    scale: float = 1.0
    shift: tuple[float, ...] = ()  # of each domain, nothing if not calibrated

    def scores(self, words: Column) -> Column:
        """Log odds of all domains against the first, as the word counts have them."""
        scores = [F.lit(0.0)]
        for prior, odds in zip(self.prior[1:], self.odds, strict=True):
            table = F.split(F.lit(",".join(map(repr, odds.tolist()))), ",").cast("array<double>")
            scores.append(F.aggregate(F.array_distinct(words), F.lit(prior), _adding(table)))
        return F.array(*scores)

    def posteriors(self, words: Column) -> Column:
        """Probabilities of all domains, in their order, from a text's words, each counted once; the priors for a text
        without words."""
        if not self.domains:
            return F.array().cast("array<double>")
        shift = F.array(*[F.lit(x) for x in self.shift or [0.0] * len(self.domains)])
        calibrated = lambda all_: F.zip_with(all_, shift, lambda x, b: x * self.scale + b)
        # e to the difference from the largest never overflows, and the largest is 1
        return _transformed(self.scores(words), calibrated, lambda all_: F.transform(all_, lambda x: F.exp(x - F.array_max(all_))), _shares)


def _adding(table: Column) -> Callable[[Column, Column], Column]:
    return lambda total, word: total + F.get(table, F.pmod(F.hash(word), F.lit(FEATURES)))


def _transformed(value: Column, *steps) -> Column:
    """Apply steps one after the other, each to a value that is worked out once."""
    for step in steps:
        value = F.get(F.transform(F.array(value), step), F.lit(0))
    return value


def _shares(values: Column) -> Column:
    return _transformed(
        F.struct(values.alias("v"), F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("s")),
        lambda both: F.transform(both["v"], lambda x: x / both["s"]))


def label_domain() -> Column:
    """The domain a labelled document stands for: its quality and whether it is toxic."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> Classifier:
    """Learn word odds of the domains from at most ``sample_docs`` labelled documents, chosen by a hash of their key.

    ``labels`` has ``doc_id, quality, toxic``; rows with a null among them are left out, of several for one key the
    largest labels count. The odds are those of all but one of ``HELD_OUT`` of them; on the others scale and shifts of the
    odds are fitted, so that posteriors are as often right as they say. Only counts by domain and feature, and the scores
    of the held-out documents, reach the driver.
    """
    known = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("_key"), label_domain().alias("domain"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample_docs)
    sample = docs.select(named(key).alias("_key"), token(docs, text).alias("words")).join(F.broadcast(chosen), "_key")
    held = F.pmod(F.xxhash64("_key", F.lit("held out")), F.lit(HELD_OUT)) == 0
    texts, others = sample.where(~held), sample.where(held)
    domains = texts.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"labels name more than {MAX_DOMAINS} domains")
    names = tuple(row["domain"] for row in domains)
    counts = np.zeros((len(names), FEATURES))
    words = texts.select("domain", F.explode(F.array_distinct("words")).alias("word")).groupBy(
        "domain", F.pmod(F.hash("word"), F.lit(FEATURES)).alias("feature")).agg(F.count("*").alias("n"))
    found = words.toArrow()  # columns: a row object for each of so many counts would fill the driver
    place = found["domain"].combine_chunks().dictionary_encode()
    rows = np.array([names.index(name) for name in place.dictionary.to_pylist()], int)[place.indices.to_numpy()]
    counts[rows, found["feature"].to_numpy()] = found["n"].to_numpy()
    if not names:
        return Classifier((), (), counts)
    totals = counts.sum(axis=1, keepdims=True)
    expected = counts.sum(axis=0) * totals / max(1, totals.sum())
    significant = np.abs((counts - expected) / np.sqrt(np.maximum(expected, 0.5))).max(axis=0) >= SIGNIFICANT
    logs = np.where(significant, np.log((counts + 0.5) / (totals + 0.5 * FEATURES)), 0.0)
    prior = np.log([row["n"] for row in domains])
    plain = Classifier(names, tuple((prior - prior[0]).tolist()), logs[1:] - logs[:1])
    known = others.where(F.col("domain").isin(*names)).select("domain", plain.scores(F.col("words")).alias("scores")).collect()
    scale, shift = _calibration(np.array([row["scores"] for row in known]), [names.index(row["domain"]) for row in known])
    return replace(plain, scale=scale, shift=shift)


def _calibration(scores: np.ndarray, truth: list[int]) -> tuple[float, tuple[float, ...]]:
    """Scale and shifts of log odds under which the truth is likeliest (logistic regression, by Newton steps); too few rows
    leave the odds as they are."""
    if len(truth) < 20:
        return 1.0, ()
    k = scores.shape[1]
    right = np.eye(k)[truth]
    # one parameter scales the scores, the others shift all domains but the first; a little weight holds them at 1 and 0
    design = np.concatenate((scores[:, :, None], np.broadcast_to(np.eye(k)[:, 1:], (len(truth), k, k - 1))), axis=2)
    start = np.concatenate(([1.0], np.zeros(k - 1)))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        z = design @ at
        z -= z.max(axis=1, keepdims=True)
        total = np.exp(z).sum(axis=1)
        return float(np.log(total).sum() - (z * right).sum() + 0.5 * ((at - start) ** 2).sum()), np.exp(z) / total[:, None]

    at = start
    value, p = loss(at)
    while True:
        gradient = np.einsum("idq,id->q", design, p - right) + at - start
        mean = np.einsum("idq,id->iq", design, p)
        curve = np.einsum("idq,idr,id->qr", design, design, p) - mean.T @ mean + np.eye(k)
        step = np.linalg.solve(curve, gradient)
        while (after := loss(at - step))[0] > value and np.abs(step).max() > 1e-9:
            step /= 2
        if value - after[0] <= 1e-9 * abs(value):
            break
        at, (value, p) = at - step, after
    return max(0.0, float(at[0])), (0.0, *at[1:].tolist())


@dataclass(frozen=True)
class Rates:
    """Rates that follow from posteriors: 1 less the ``dual`` of each domain by its posterior, within the bounds.

    ``targets`` and ``reached`` are tokens of each domain."""

    domains: tuple[str, ...]
    dual: tuple[float, ...]
    upper: float | None
    targets: tuple[float, ...] = ()
    reached: tuple[float, ...] = ()
    tokens: float = 0.0

    @property
    def met(self) -> bool:
        """Whether no total misses its target by more than ``MET`` of all tokens."""
        return all(abs(a - b) <= MET * self.tokens for a, b in zip(self.reached, self.targets, strict=True))

    def free(self, posteriors: Column) -> Column:
        """One array holds the numbers: as single literals they would be part of the generated code, and the driver would
        compile and keep other code for every round."""
        if not self.dual:
            return F.lit(1.0)
        parts = F.zip_with(posteriors, F.array(*[F.lit(x) for x in self.dual]), lambda p, x: p * x)
        return F.lit(1.0) - F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)

    def of(self, posteriors: Column) -> Column:
        rate = F.greatest(self.free(posteriors), F.lit(0.0))
        return rate if self.upper is None else F.least(rate, F.lit(self.upper))


def _second_moments(p: list[Column], weight: Column, prefix: str) -> list[Column]:
    return [F.sum(weight * p[a] * p[b]).alias(f"{prefix}{a}_{b}") for a in range(len(p)) for b in range(a, len(p))]


def _matrix(row: Row, k: int, prefix: str) -> np.ndarray:
    return np.array([[row[f"{prefix}{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])


def present_tokens(memberships: DataFrame, domains: tuple[str, ...]) -> dict[str, float]:
    """Expected tokens of each domain."""
    row = memberships.agg(*[F.sum(F.col("n_tokens") * F.get("posteriors", F.lit(d))).alias(str(d)) for d in range(len(domains))]).first()
    return {name: row[str(d)] or 0.0 for d, name in enumerate(domains)}


def reachable_total(memberships: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float]) -> float:
    """The most tokens that can be had in these shares when documents are only dropped: the domain that is scarcest for
    its share says how many."""
    whole, there = math.fsum(weights.get(d, 0.0) for d in domains), present_tokens(memberships, domains)
    return min((there[d] * whole / weights[d] for d in domains if weights.get(d, 0.0) > 0), default=0.0)


def fit_rates(
    memberships: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float], total: float | None = None,
    upper: float | None = None,
) -> Rates:
    """Nonnegative rates ``r`` of documents for which ``sum(r * n_tokens * posterior)`` meets every domain's target.

    Projected gradient on least squares, from rates of 1: a round sums the token totals of the present rates over all rows, and
    all rates move against the gradient of the distance, projected on their bounds (at least 0, at most ``upper``).
    Distances are weighted by the inverse of the totals' second moments; a step is as long as the second moments of the
    documents within their bounds say, shorter if that brings nothing. As every gradient is a sum over domains, what all
    rounds have added up to is one number per domain, whatever their number. Domains that ``weights`` leaves out have
    target 0. ``total`` defaults to the tokens there are. Only sums by domain reach the driver. Rounds end when nothing
    can be gained any more: targets are met, or as near as bounds and posteriors allow; ``Rates.met`` tells.
    """
    k = len(domains)
    if not k:
        return Rates((), (), upper)
    p, n = [F.get("posteriors", F.lit(d)) for d in range(k)], F.col("n_tokens")
    moments = memberships.agg(F.sum(n).alias("n"), *_second_moments(p, n, "m")).first()
    tokens, second = float(moments["n"] or 0), _matrix(moments, k, "m")
    whole = math.fsum(weights.get(d, 0.0) for d in domains)
    if whole <= 0:
        raise ValueError(f"no weight for any of the domains {', '.join(domains)}")
    targets = np.array([weights.get(d, 0.0) / whole for d in domains]) * (tokens if total is None else total)

    def sums(dual: np.ndarray) -> Sums:
        rates = Rates(domains, tuple(dual.tolist()), upper)
        rows = memberships.select("n_tokens", "posteriors", rates.free(F.col("posteriors")).alias("free"), rates.of(F.col("posteriors")).alias("rate"))
        inside = F.when(F.col("free") == F.col("rate"), n).otherwise(0)
        row = rows.agg(
            F.sum(n * F.col("rate") * (F.col("free") - F.col("rate") / 2)).alias("value"), F.sum(n * (F.col("rate") - 1) * (F.col("rate") - 1)).alias("change"),
            *[F.sum(n * F.col("rate") * x).alias(f"t{d}") for d, x in enumerate(p)], *_second_moments(p, inside, "s")).first()
        return Sums(row["value"] or 0.0, row["change"] or 0.0, np.array([row[f"t{d}"] or 0.0 for d in range(k)]), _matrix(row, k, "s"))

    dual, reached = solved(sums, second, targets, tokens)
    return Rates(domains, tuple(dual.tolist()), upper, tuple(targets.tolist()), tuple(reached.tolist()), tokens)


class Sums(NamedTuple):
    """Of the documents at some rates: the value whose slope the totals are, the squared change of all rates, the totals, and
    the second moments of those within their bounds."""

    value: float
    change: float
    totals: np.ndarray
    inside: np.ndarray


def solved(sums: Callable[[np.ndarray], Sums], second: np.ndarray, targets: np.ndarray, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all steps by domain, and the totals they reach.

    ``sums`` gives the sums at the rates that follow from such steps. The merit falls with every step that is taken, and is
    never below the best there is by more than the gap; rounds end at the targets or, where these are out of reach, when the
    gap is a thousandth of what keeps them apart.
    """
    ridge, metric = RIDGE * second, np.linalg.pinv(second)
    dual = np.zeros(len(targets))
    merit = lambda at, dual: at.value + targets @ dual + 0.5 * dual @ ridge @ dual
    slope = lambda at, dual: targets - at.totals + ridge @ dual
    at = sums(dual)
    now, gradient = merit(at, dual), slope(at, dual)
    while tokens and np.abs(gradient).max() > TOLERANCE * tokens:
        apart = (at.totals - targets) @ metric @ (at.totals - targets) / (2 * RIDGE)
        least = 0.5 * tokens - now
        if apart > at.change and 0.5 * at.change + apart - least <= 1e-3 * apart:
            break
        step = -np.linalg.lstsq(at.inside + ridge, gradient, rcond=1e-14)[0]
        size = 1.0
        while True:
            there = sums(dual + size * step)
            after, gradient_after = merit(there, dual + size * step), slope(there, dual + size * step)
            if after <= now + 1e-4 * size * float(gradient @ step) or size < 1e-6:
                break
            size /= 4
        if not (after < now or np.abs(gradient_after).max() < np.abs(gradient).max()):
            break  # what is left is less than sums of so many numbers can tell
        dual, now, at, gradient = dual + size * step, after, there, gradient_after
    return dual, at.totals


def memberships(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens (words parted by white space) and domain posteriors of every document."""
    words = docs.select(named(key).alias("doc_id"), token(docs, text).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), classifier.posteriors(F.col("words")).alias("posteriors"))


def mixture_rates(
    docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], total: float | None = None, upper: float | None = None,
) -> DataFrame:
    """Rates of all documents: ``doc_id, n_tokens, domain, posterior, rate, domain_target, domain_reached, targets_met``.

    ``domain`` is the likeliest one and ``posterior`` its probability; ``rate`` is how often a document is to be taken,
    in expectation, so that domains share the tokens by ``weights``. ``domain_target`` and ``domain_reached`` are the tokens
    that the document's domain should have and has; ``targets_met`` is false if any domain misses its target.

    Defined results: null, empty and blank texts have no tokens and the prior as posteriors; without any labelled text
    there is no domain, ``domain``, ``posterior`` and the totals are null and all rates are 1; copies of a row each get the same
    rate; ties go to the domain that sorts first; extra columns are not handed on. An empty table gives an empty result.
    """
    classifier = fit_classifier(docs, labels)
    known = stored(memberships(docs, classifier), "memberships")
    rates = fit_rates(known, classifier.domains, weights, total, upper)
    p, names = F.col("posteriors"), F.array(*[F.lit(d) for d in classifier.domains]).cast("array<string>")
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]).cast("array<double>"), F.array_position(p, F.array_max(p)).cast("int") - 1)
    return known.select(
        "doc_id", "n_tokens", F.get(names, F.array_position(p, F.array_max(p)) - 1).alias("domain"),
        F.array_max(p).alias("posterior"), rates.of(p).alias("rate"), of(rates.targets).alias("domain_target"),
        of(rates.reached).alias("domain_reached"), F.lit(rates.met).alias("targets_met"))


def mixed_documents(
    docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], total: float | None = None, relative: bool = False, seed: int = 0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Documents drawn once with their rates as probabilities (at most 1), with the columns they came with.

    ``total`` tokens are wanted, by default as many as documents that are only dropped can give in these shares
    (``reachable_total``). With ``relative`` weights say which part of the tokens of each domain is to stay; domains that are
    not named stay whole. The draw is a seeded hash of key and text, so it does not depend on where a row lies and equal
    rows are drawn alike. Texts are scored once: documents and posteriors are written together.
    """
    classifier = fit_classifier(docs, labels, key=key, text=text)
    words = token(docs, text)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), named(key), named(text)), 11) / F.lit(float(1 << 53))
    row = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    known = stored(docs.select(row.alias("row"), words.alias("words"), draw.alias("draw")).select(
        "row", "draw", F.size("words").cast("long").alias("n_tokens"), classifier.posteriors(F.col("words")).alias("posteriors")), "scored")
    if relative and classifier.domains:
        weights = {name: weights.get(name, 1.0) * there for name, there in present_tokens(known, classifier.domains).items()}
        total = math.fsum(weights.values())
    elif total is None and classifier.domains:
        total = reachable_total(known, classifier.domains, weights)
    rates = fit_rates(known, classifier.domains, weights, total, upper=1.0)
    kept = known.where(F.col("draw") < rates.of(F.col("posteriors")))
    return kept.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
