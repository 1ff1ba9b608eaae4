"""Runs of lines that an earlier document, or an earlier place of the same one, already has."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurelens.llm.common import SPACES, named

#: A repeated run has at least so many lines, or so many words in fewer lines.
MIN_RUN = 3
MIN_WORDS = 50
_FIRST = -(1 << 63)


def _written(line: Column) -> Column:
    """Whether a line has more than white space."""
    return F.regexp_replace(line, SPACES, "") != ""


def _order(key: str) -> Column:
    return F.coalesce(named(key).cast("long"), F.lit(_FIRST))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))


def _windows(docs: DataFrame, run: int, words: int, key: str, text: str) -> DataFrame:
    """Winnowing: every window with the line it selects, the last one with the least hash.

    A window begins at any line and ends as soon as it has ``run`` lines or ``words`` words; the end of a text cuts off
    those that have neither. Rows ``doc, version, start, size, window, check, fingerprint, at``; lines that are blank
    don't count.
    """
    known = docs.select(
        _order(key).alias("doc"), F.xxhash64(named(text)).alias("version"), F.filter(F.split(named(text), "\n", -1), _written).alias("lines"))
    known = known.where(F.size("lines") >= 1).select(
        "doc", "version", F.transform("lines", lambda line: F.xxhash64(line)).alias("hashes"), F.transform("lines", _words).alias("words"))

    def size(i: Column) -> Column:
        found, total = F.lit(run), [F.coalesce(F.get("words", i + k), F.lit(0)) for k in range(run - 1)]
        for n in range(run - 1, 0, -1):
            found = F.when(reduce(add, total[:n]) >= words, n).otherwise(found)
        return found

    sized = F.transform("hashes", lambda _, i: F.struct(i.alias("start"), size(i).alias("size")))
    whole = F.filter(sized, lambda w: w["start"] + w["size"] <= F.size("hashes"))
    cut = known.select("doc", "version", F.explode(F.transform(whole, lambda w: F.struct(
        w["start"].alias("start"), w["size"].alias("size"), F.slice("hashes", w["start"] + 1, w["size"]).alias("own")))).alias("w"))
    least = F.array_min("w.own")
    return cut.select(
        "doc", "version", "w.start", "w.size", F.xxhash64("w.own").alias("window"), F.xxhash64(F.lit(1), "w.own").alias("check"),
        least.alias("fingerprint"), (F.col("w.start") + F.col("w.size") - F.array_position(F.reverse("w.own"), least)).alias("at"))


def repeated_windows(docs: DataFrame, run: int = MIN_RUN, words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows that start earlier elsewhere: ``doc, version, start, size``.

    A selected line that is a fingerprint of one place only is dropped with all windows that select it, as equal windows
    select equal lines. Windows around the others are joined with the first place of the same window; each next window
    extends a match by a line, so together they span the whole common run on both sides of the fingerprint.
    """
    windows = _windows(docs, run, words, key, text)
    shared = windows.groupBy("fingerprint", "doc", "version", "at").agg(F.count("*").alias("n")).groupBy("fingerprint").agg(
        F.count("*").alias("places")).where("places > 1").select("fingerprint")
    own = windows.join(shared, "fingerprint", "left_semi").groupBy("window", "check", "size", "doc", "version").agg(
        F.min("start").alias("first"), F.collect_set("start").alias("starts"))
    earliest = own.groupBy("window", "check").agg(
        F.min("doc").alias("first_doc"), F.count("*").alias("n"), F.max(F.size("starts")).alias("most"))
    return own.join(earliest.where("n > 1 or most > 1"), ["window", "check"]).select(
        "doc", "version", "size", "first", (F.col("doc") > F.col("first_doc")).alias("later"), F.explode("starts").alias("start"),
    ).where("later or start > first").select("doc", "version", "start", "size")


def without_repeated_lines(
    docs: DataFrame, run: int = MIN_RUN, words: int = MIN_WORDS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Delete every run of lines that already stands in a document of smaller key, or earlier in the same one: ``doc_id,
    n_lines, n_removed, text``. A run has at least ``run`` lines, or ``words`` words in fewer lines.

    Lines are parts between line feeds; blank ones are neither compared, counted nor deleted, so a run may span them.
    Every line of a repeated window goes, judged on the input and not on what is left.

    Defined results: a null text stays null with no lines; a null key is smaller than all keys; documents of equal key
    are no earlier than each other, so rows alike keep alike lines; documents with fewer than ``run`` lines and
    ``words`` words are never cut. Extra columns are not handed on. An empty table gives an empty result.
    """
    repeated = repeated_windows(docs, run, words, key, text).groupBy("doc", "version").agg(
        F.collect_list(F.struct("start", "size")).alias("starts"))
    lines = F.split("text", "\n", -1)
    rows = docs.select(named(key).cast("long").alias("doc_id"), named(text).cast("string").alias("text"), _order(key).alias("doc")).withColumn(
        "version", F.xxhash64("text")).join(repeated, ["doc", "version"], "left")
    rows = rows.select("doc_id", "text", "starts", lines.alias("lines")).withColumn(
        # numbers of written lines, 1 first
        "written", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: _written(F.get("lines", i - 1))))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.slice("written", s["start"] + 1, s["size"]))))
    rows = rows.withColumn("gone", F.when(F.col("starts").isNotNull(), gone))
    left = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    return rows.select(
        "doc_id", F.coalesce(F.size("written"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("lines", i - 1)), "\n")).alias("text"))
