"""Secrets in texts: strong ones by their form, weak ones where complementary parts of a credential stand close together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurelens.llm.common import named, stored

#: Kinds in the order in which spans of one start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = 3
_ASSIGN, _ACCESS, _HEX, _IDENTIFIER, _SECRET, _ENDPOINT, _GAP = range(7)

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: a named account, a mixed token, an address of a service.
IDENTIFIER = r"""(?i:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
SECRET = "[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"""(?i:https?|s?ftp|ssh|ldaps?|postgres|postgresql|mysql|mongodb|redis|amqps?)://[^\x00-\x20"'<>]+"""
#: Blank lines part scopes; parts further away than the reach do not belong together either.
BLANK = r"\n[\x20\x09\x0D]*\n"
REACH = 200

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_PIECE = 256


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """Work a value out once, for a lambda that uses it many times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spans(text: Column, pattern: str, kind: int, good: Column | None = None) -> Column:
    """Spans of all matches, leftmost first and without overlaps; ``good`` is an array that says which of them count.

    Positions are sums of the lengths of matches and of what lies between them, added up in pieces so that a text with
    very many matches is not copied for each.
    """
    sizes = lambda parts: F.transform(parts, lambda part: F.char_length(part))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counts = F.transform(matches, lambda _: F.lit(True)) if good is None else good
    rows = F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("gap"), sizes(matches).alias("size"), counts.alias("good"))
    none = F.array().cast(_SPANS)

    def one(total: Column, row: Column) -> Column:
        start = total["at"] + row["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + row["size"]).alias("end"))
        return F.struct((start + F.coalesce(row["size"], F.lit(0))).alias("at"), F.when(
            F.coalesce(row["good"], F.lit(False)), F.concat(total["found"], F.array(span))).otherwise(total["found"]).alias("found"))

    def piece(rows: Column, total: Column, number: Column) -> Column:
        inner = F.aggregate(F.slice(rows, number * _PIECE + 1, _PIECE), F.struct(total["at"].alias("at"), none.alias("found")), one)
        return _bound(inner, lambda both: F.struct(both["at"].alias("at"), F.concat(total["found"], both["found"]).alias("found")))

    whole = _bound(rows, lambda rows: F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _PIECE).cast("int")), F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda total, number: piece(rows, total, number))["found"])
    return F.when(F.rlike(text, F.lit(pattern)), whole).otherwise(none)


def _mixed(token: Column) -> Column:
    """Whether a token looks random: digits with letters of both cases, or hex digits with a number among them."""
    has = lambda pattern: F.rlike(token, F.lit(pattern))
    return has("[0-9]") & ((has("[a-z]") & has("[A-Z]")) | has("^[0-9a-f]+$"))


def text_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Strong spans and weak parts of every text: ``doc_id, strong, weak, gaps, text_key``.

    Weak secrets are looked for only where the text names an identifier, endpoints only where there is a secret as well;
    ``text_key`` is null for texts without both, in which nothing can be linked.
    """
    rows = docs.select(named(key).alias("doc_id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("_text"))
    body = F.col("_text")
    values = F.transform(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda value: F.char_length(value) >= ASSIGN_VALUE)
    none = F.array().cast(_SPANS)
    rows = rows.withColumns({
        "assign": _spans(body, ASSIGN, _ASSIGN, values), "access": _spans(body, ACCESS, _ACCESS), "hex": _spans(body, HEX, _HEX),
        "identifier": _spans(body, IDENTIFIER, _IDENTIFIER)})
    tokens = F.transform(F.regexp_extract_all(body, F.lit(SECRET), F.lit(0)), _mixed)
    named_ = (F.size("identifier") > 0) | (F.size("access") > 0)
    rows = rows.withColumn("secret", F.when(named_, _spans(body, SECRET, _SECRET, tokens)).otherwise(none))
    both = named_ & ((F.size("assign") > 0) | (F.size("hex") > 0) | (F.size("secret") > 0))
    return rows.select(
        "doc_id", F.concat("assign", "access", "hex").alias("strong"),
        F.when(both, F.concat("identifier", "secret", _spans(body, ENDPOINT, _ENDPOINT))).otherwise(none).alias("weak"),
        F.when(both, _spans(body, BLANK, _GAP)).otherwise(none).alias("gaps"), F.when(both, F.sha2(body.cast("binary"), 256)).alias("text_key"))


def _placed(parts: DataFrame) -> DataFrame:
    """Parts with their scope: ``text_key, kind, start, end, scope``. Weak parts that overlap a strong span drop out, weak
    secrets also where they overlap an identifier or endpoint."""
    each = parts.where("text_key is not null").dropDuplicates(["text_key"]).select(
        "text_key", F.inline(F.concat("strong", "weak", "gaps")))
    order = Window.partitionBy("text_key").orderBy("start")
    so_far = order.rangeBetween(Window.unboundedPreceding, 0)
    onwards = order.rangeBetween(0, Window.unboundedFollowing)
    strong, other = F.col("kind") < STRONG, (F.col("kind") != _SECRET) & (F.col("kind") != _GAP)
    limits = each.withColumns({
        "scope": F.sum(F.when(F.col("kind") == _GAP, 1).otherwise(0)).over(so_far),
        "strong_until": F.max(F.when(strong, F.col("end"))).over(so_far), "strong_from": F.min(F.when(strong, F.col("start"))).over(onwards),
        "other_until": F.max(F.when(other, F.col("end"))).over(so_far), "other_from": F.min(F.when(other, F.col("start"))).over(onwards)})
    meets = lambda name: F.coalesce(F.col(f"{name}_until") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col(f"{name}_from") < F.col("end"), F.lit(False))
    covered = F.when(strong, False).when(F.col("kind") == _SECRET, meets("other")).otherwise(meets("strong"))
    return limits.where((F.col("kind") != _GAP) & ~covered).select("text_key", "kind", "start", "end", "scope")


def _near(parts: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """Parts that have one of ``others`` in their scope, after or before them with at most ``reach`` characters between.

    Ends and starts are points in cells of the reach: a partner lies in the own cell or in the next one.
    """
    cell = lambda at: F.expr(f"`{at}` div {reach + 1}")
    side = lambda name, at: F.struct(F.lit(name).alias("side"), at.alias("cell"))
    left = parts.withColumn("meet", F.explode(F.array(
        side("after", cell("end")), side("after", cell("end") + 1), side("before", cell("start")), side("before", cell("start") - 1))))
    right = others.select("text_key", "scope", F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.explode(F.array(
        side("after", cell("start")), side("before", cell("end")))).alias("meet"))
    gap = F.when(F.col("meet.side") == "after", F.col("other_start") - F.col("end")).otherwise(F.col("start") - F.col("other_end"))
    right = right.select(F.col("text_key").alias("k"), F.col("scope").alias("s"), F.col("meet").alias("m"), "other_start", "other_end")
    close = (F.col("text_key") == F.col("k")) & (F.col("scope") == F.col("s")) & (F.col("meet") == F.col("m")) & gap.between(0, reach)
    return left.join(right, close, "left_semi").select(parts.columns).distinct()


def linked_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts that belong to a credential: ``text_key, kind, start, end``.

    A weak secret counts if an identifier (a weak one or an access key) is in reach, a weak identifier if a secret (weak,
    assigned or hex) is, and an endpoint if a secret is in reach that has an identifier itself.
    """
    placed = stored(_placed(parts), "parts")
    identifiers = placed.where(F.col("kind").isin(_IDENTIFIER, _ACCESS))
    secrets = placed.where(F.col("kind").isin(_SECRET, _ASSIGN, _HEX))
    with_name = _near(secrets, identifiers, reach)
    with_secret = _near(identifiers.where(F.col("kind") == _IDENTIFIER), secrets, reach)
    with_place = _near(placed.where(F.col("kind") == _ENDPOINT), with_name, reach)
    return with_name.where(F.col("kind") == _SECRET).unionByName(with_secret).unionByName(with_place).select("text_key", "kind", "start", "end")


def find_secrets(docs: DataFrame, reach: int = REACH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every document: ``doc_id, spans``, an array of ``start, end, kind, linked`` in the order of starts, then
    of ``KINDS``.

    Positions count characters (code points), the end is the first one after the span. Strong spans (``linked`` false)
    are found by their form alone; weak ones are reported only if complementary parts are in reach in the same scope,
    that is without a blank line between. Strong spans may overlap each other; weak ones overlap no strong one.

    Linking works once per distinct text, as an interval join in cells of the reach. Defined results: null and empty texts
    have no spans; rows alike have spans alike, whatever their keys; a null key is handed on; extra columns are not. An
    empty table gives an empty result.
    """
    parts = stored(text_parts(docs, key, text), "secret-parts")
    found = linked_parts(parts, reach).groupBy("text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    single = parts.where("text_key is null").select("doc_id", "strong", F.array().cast(_SPANS).alias("added"))
    joined = parts.where("text_key is not null").join(found, "text_key", "left").select(
        "doc_id", "strong", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return single.unionByName(joined).select("doc_id", F.transform(F.array_sort(F.concat("strong", "added")), lambda span: F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.get(names, span["kind"]).alias("kind"),
        (span["kind"] >= STRONG).alias("linked"))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as one text: ``kind:start:end``, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
