"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lurelens.llm import archive, conversations, credentials, decontamination, language, mixing, near_duplicates, phrases, quality, repeated_bytes, repeated_lines, sharding, token_counts
from lurelens.llm.common import table
from lurelens.session import fresh_folder

#: Public vocabulary files.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Shares of the tokens that documents like those labelled good, poor and toxic are to have.
TARGET_WEIGHTS = {"quality1_toxic0": 0.94, "quality0_toxic0": 0.05, "quality1_toxic1": 0.01}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: In DuckDB, with whole windows instead of fingerprints.
ORACLES["op3_line_dedup"] = """
with lines as (
  select doc_id, text, string_split(text, chr(10)) as lines from documents),
written as (
  select doc_id, text, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_replace(lines[i], '[\x20\x09-\x0D]+', '', 'g') <> '') as w
  from lines),
counted as (
  select doc_id, lines, w, list_transform(w, lambda k: len(regexp_extract_all(lines[k], '[^\x20\x09-\x0D]+'))) as n from written),
sized as (
  select doc_id, lines, w, i, case when n[i] >= 50 then 1 when n[i] + n[i + 1] >= 50 then 2 else 3 end as size
  from (select *, unnest(range(1, len(w) + 1)) as i from counted)),
places as (
  select doc_id, i as start, size, array_to_string([lines[k] for k in w[i:i + size - 1]], chr(10)) as own from sized where i + size - 1 <= len(w)),
ranked as (select doc_id, start, size, row_number() over (partition by own order by doc_id, start) as place from places),
gone as (
  select doc_id, list_distinct(flatten(list(range(start, start + size)))) as gone from ranked where place > 1 group by doc_id)
select d.doc_id, coalesce(len(d.w), 0) as n_lines, coalesce(len(g.gone), 0) as n_removed,
  case when g.gone is null then d.text else array_to_string(
    [d.lines[i] for i in range(1, len(d.lines) + 1) if not list_contains([d.w[k] for k in g.gone], i)], chr(10)) end as text
from written d left join gone g using (doc_id)"""

#: In DuckDB, with a join of word runs instead of an automaton.
ORACLES["op7_benchmark_decontamination"] = """
with texts as (
  select true as is_doc, doc_id as id, text from documents union all select false, item_id, text from benchmark),
words as (
  select is_doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
starts as (
  select id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from words where not is_doc and len(w) > 0),
patterns as (select distinct id as item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as run from starts),
runs as (
  select id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as run
  from (select id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select distinct k from patterns) where is_doc and len(w) >= k)),
found as (select id, i, k, item_id from runs join patterns using (k, run)),
hit as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + k)) as p from found) group by id),
items as (select id, list_sort(list(distinct cast(item_id as varchar))) as items from found group by id)
select id as doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (id) left join items using (id) where is_doc"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // {}) % 32, 1)"
#: In DuckDB, from the pages alone: what a right archive must say.
ORACLES["op10_warc_archive"] = f"""
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as digest,
    max(page_id) over (partition by coalesce(html, '')) as newest from pages),
digits as (
  select page_id, payload_bytes, newest, list_transform(range(8), lambda i: cast('0x' || substr(digest, 5 * i + 1, 5) as bigint)) as groups from payloads)
select page_id, payload_bytes,
  array_to_string(list_transform(groups, lambda v: concat({", ".join(_DIGIT.format(32 ** k) for k in (3, 2, 1, 0))})), '') as payload_digest,
  case when page_id = newest then 'response' else 'revisit' end as record_type,
  case when page_id <> newest then newest end as refers_to from digits"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda d:
    [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, e: case when e >= 0 then xor(crc, e)
    else xor(crc >> 1, 3988292384 * (crc & 1)) end), 4294967295)"""
#: In DuckDB, with whole texts as keys and every pair of a node and one above it.
ORACLES["op11_conversation_trie"] = f"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 20 as base, {_CRC} % 4 as h from (select distinct conv_id from own)),
built as (
  select c.conv_id, place, role, text from convs c join own o on o.conv_id = c.base and place <= h
  union all select conv_id, place, role, text from own join convs using (conv_id) where place > h),
turns as (select conv_id, row_number() over (partition by conv_id order by place) as depth, role, text from built),
paths as (
  select conv_id, depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by depth) as path,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words from turns
  union all select conv_id, 0, '', 0 from convs),
nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(n_words) as n_words from paths group by depth, path),
steps as (
  select n.*, p.path as parent from nodes n left join paths p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
children as (select depth - 1 as depth, parent as path, count(*) as n_children from steps where depth > 0 group by all),
below as (
  select p.depth, p.path, sum((s.n_convs - 1) * s.n_words) as saved_tokens, count(*) filter (c.path is null) as n_leaves
  from steps s join paths p on p.conv_id = s.conv_id and p.depth <= s.depth left join children c on c.depth = s.depth and c.path = s.path
  group by all),
ends as (
  select depth, path, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends_sha256
  from (select conv_id, max(depth) as depth from paths group by conv_id) join paths using (conv_id, depth) group by all)
select s.conv_id, s.depth, u.conv_id as parent_conv_id, s.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves,
  cast(b.saved_tokens as bigint) as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from steps s join below b using (depth, path) left join children c using (depth, path) left join ends e using (depth, path)
left join nodes u on u.depth = s.depth - 1 and u.path = s.parent"""


#: In DuckDB, with all phrases counted at once.
ORACLES["op12_phrase_mining"] = f"""
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts)),
totals as (select lang, sum(len(w)) as n from pieces group by lang),
runs as (
  select lang, k, list_slice(w, i, i + k - 1) as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest(range(1, 5)) as k) where len(w) >= k)),
counts as (select lang, k, phrase, count(*) as f from runs group by all having f >= 30),
cuts as (
  select c.lang, c.k, c.phrase, c.f as a, cut, l.f as l, r.f as r, cast(2000000 * cast(c.f as hugeint) // (l.f + r.f) as bigint) as score
  from (select *, unnest(range(1, k)) as cut from counts where k > 1) c
  join counts l on l.lang = c.lang and l.phrase = list_slice(c.phrase, 1, cut)
  join counts r on r.lang = c.lang and r.phrase = list_slice(c.phrase, cut + 1, c.k)),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ as (
  select lang, f, list_slice(phrase, i, j) as phrase
  from (select *, unnest(range(i + 1, k + 1)) as j from (select *, unnest(range(1, k)) as i from counts where k > 2)) where j - i + 1 < k),
around as (select lang, phrase, max(f) as around from inner_ group by all),
ranked as (
  select b.*, array_to_string(b.phrase, ' ') as words from best b left join around o on o.lang = b.lang and o.phrase = b.phrase
  where o.around is null or 100 * o.around < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, words) as rank, words as phrase, a, l, r, cast(n as bigint) as n, score
from ranked join totals using (lang) qualify rank <= 2000"""


def _matches(number: int, kind: str, pattern: str, good: str = "true") -> str:
    """Spans of one kind; ``m`` is a match, ``value`` the second group of it."""
    pattern = pattern.replace("'", "''")
    values = f"regexp_extract_all(t, '{pattern}', 2)" if "value" in good else "m"
    return f"""select row, {number} as number, '{kind}' as kind, start, start + length(m) as stop from (
      select row, m[i] as m, value[i] as value, cast(list_sum(list_transform(parts[:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) as bigint) as start
      from (select row, m, value, parts, unnest(range(1, len(m) + 1)) as i
        from (select *, {values} as value from (
          select row, t, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as parts from texts)))) where {good}"""


_RANDOM = "regexp_matches(m, '[0-9]') and (regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') or regexp_matches(m, '^[0-9a-f]+$'))"
_CLOSE = f"a.row = b.row and a.scope = b.scope and (b.start - a.stop between 0 and {credentials.REACH} or a.start - b.stop between 0 and {credentials.REACH})"
#: In DuckDB, with joins of all parts of a text.
ORACLES["op13_secret_scans"] = f"""
with texts as materialized (select doc_id, coalesce(text, '') as t, row_number() over () as row from documents),
strong as materialized (
  {_matches(0, "assign", credentials.ASSIGN, f"length(value) >= {credentials.ASSIGN_VALUE}")}
  union all {_matches(1, "access", credentials.ACCESS)}
  union all {_matches(2, "hex", credentials.HEX)}),
named as ({_matches(3, "identifier", credentials.IDENTIFIER)} union all {_matches(5, "endpoint", credentials.ENDPOINT)}),
names as materialized (select * from named a where not exists (from strong b where a.row = b.row and a.start < b.stop and b.start < a.stop)),
tokens as materialized (
  select * from ({_matches(4, "secret", credentials.SECRET, _RANDOM)}) a
  where not exists (from (from strong union all from named) b where a.row = b.row and a.start < b.stop and b.start < a.stop)),
gaps as materialized ({_matches(6, "gap", credentials.BLANK)}),
parts as materialized (
  select p.*, (select count(*) from gaps g where g.row = p.row and g.start < p.start) as scope
  from (from strong union all from names union all from tokens) p),
secrets as materialized (
  select * from parts a where number in (0, 2, 4) and exists (from parts b where b.number in (1, 3) and {_CLOSE})),
added as (
  select row, number, kind, start, stop from secrets where number = 4
  union all select row, number, kind, start, stop from parts a where number = 3 and exists (from parts b where b.number in (0, 2, 4) and {_CLOSE})
  union all select row, number, kind, start, stop from parts a where number = 5 and exists (from secrets b where {_CLOSE})),
every as (
  select row, number, start, kind || ':' || start || ':' || stop as span, number < {credentials.STRONG} as base from (from strong union all from added))
select doc_id, count(*) filter (number = 0) as n_assign, count(*) filter (number = 1) as n_access, count(*) filter (number = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, number) filter (base), '')) as base_sha256,
  coalesce(string_agg(span, ',' order by start, number), '') as spans
from texts left join every using (row) group by row, doc_id"""


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of all documents that bring the domains of the labels to their target shares of the tokens."""
    return mixing.mixture_rates(table(spark, folder, "documents"), table(spark, folder, "labels"), TARGET_WEIGHTS)


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document under chains of near duplicates, and its verified links."""
    return near_duplicates.near_duplicate_classes(table(spark, folder, "documents"))


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines that earlier ones have."""
    return repeated_lines.without_repeated_lines(table(spark, folder, "documents"))


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and word pieces of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, token_counts.read_vocabulary(BYTE_VOCABULARY)).drop("text")


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, divergences and verdict of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return quality.with_quality(docs).drop("lang", "text")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    pieces = language.read_pieces(PIECE_MODEL)
    model = language.fit(docs.where(~F.col("held_out")), pieces)
    return language.with_language(docs.select("doc_id", "text", "held_out"), model, pieces).drop("text")


@query
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document."""
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the bytes that earlier ones have."""
    cut = repeated_bytes.without_repeated_bytes(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.interleaved_shards(docs, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as records, then read what the archive says of each."""
    written = archive.write_archive(table(spark, folder, "pages"), fresh_folder(spark, "warc"))
    return archive.read_records(spark, written)


@query
def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return conversations.conversation_nodes(table(spark, folder, "conversations"))


@query
def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The foremost collocations of every language."""
    return phrases.collocations(table(spark, folder, "documents"))


@query
def op13_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, by their form or by linked parts."""
    found = credentials.find_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda span: ~span["linked"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in credentials.KINDS[:credentials.STRONG]]
    return found.select(
        "doc_id", *counts, F.sha2(credentials.listed(base).cast("binary"), 256).alias("base_sha256"),
        credentials.listed(F.col("spans")).alias("spans"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The training corpus: every document that all stages keep, with its shard."""
    return corpus_pipeline.run(spark, folder)
