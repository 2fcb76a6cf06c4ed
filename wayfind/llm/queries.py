"""The registered queries over the operations of this subpackage, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind import storage
from wayfind.llm import chat, decontaminate, language_crf, licenses, manifest, mixing, quality, secrets, simhash, suffixes, trie, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and its source's size and target."""
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || doc_id) as place
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight from sized group by source),
levels as (
  select *, 3.0::double * source_size as cap, (3.0::double * source_size) / weight as ratio from sources),
ranked as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from levels window before as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(cap, weight * (select max(level) from ranked where level <= ratio)) as target from ranked),
flow as (
  select s.doc_id, s.size, t.source_size, t.target, sum(s.size) over (partition by s.source order by s.place, s.doc_id, s.size rows unbounded preceding) as tokens
  from sized s join targets t on s.source is not distinct from t.source),
queue as (
  select size, (k * source_size + tokens)::double / target as finish from flow, (select unnest([0, 1, 2]) as k) where size > 0 and target > 0),
spent as (
  select finish, sum(sum(size)) over (order by finish) as run from queue group by finish),
cut as (
  select max(finish) as last_finish from spent where run <= (select sum(size) from sized))
select doc_id, size, source_size, target,
  case when size > 0 and target > 0 then size * (
    (tokens::double / target <= last_finish)::int + ((source_size + tokens)::double / target <= last_finish)::int + ((2 * source_size + tokens)::double / target <= last_finish)::int) else 0 end::bigint as taken
from flow, cut
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    found = quality.quality_scores(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op2_sql() -> str:
    white, stop, symbol = r"\x20\x09-\x0D", r""".,;:?''"()\-""", r"#*$%&|<>"
    count = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')))"
    classes = {"c1": "a-z", "c2": "A-Z", "c3": "0-9", "c4": white, "c5": stop, "c6": "!", "c7": symbol, "c8": r"^\x00-\x7F"}
    listed = ", ".join(f"('{lang}', '{w}')" for lang, words in quality.COMMON_WORDS.items() for w in sorted(set(words.split())))
    names = ["c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9"]
    bins = " union all ".join(f"select doc_id, '{c}' as bin, {c}::double as n from d" for c in names)
    distance = lambda q, total: (
        f"sqrt(greatest(0, (sum(case when n > 0 then n / {total} * log2(2 * (n / {total}) / (n / {total} + {q})) else 0 end) + 1 - sum({q}) + sum(case when {q} > 0 then {q} * log2(2 * {q} / (n / {total} + {q})) else 0 end)) / 2))"
    )
    return rf"""
with d0 as (select doc_id, lang, coalesce(text, '') as t from documents),
d1 as (select *, regexp_extract_all(t, '[^{white}]+') as w, {", ".join(f"{count(c)} as {k}" for k, c in classes.items())} from d0),
d as (select *, length(t) - c1 - c2 - c3 - c4 - c5 - c6 - c7 - c8 as c9, length(t) - c4 as word_chars, len(w) as n_words from d1),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^{white}]') group by doc_id),
grams as (select doc_id, i, count(*) over (partition by doc_id, gram) as c from (select doc_id, i, array_to_string(w[i:i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d))),
repeats as (select doc_id, count(distinct i + k) as n_repeat_words from grams, (select unnest(range(5)) as k) where c > 1 group by doc_id),
base as (select d.doc_id, lang, n_words, word_chars, c7 as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  n_words < {quality.MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from d left join lines using (doc_id) left join repeats using (doc_id)),
listed(lang, word) as (values {listed}),
said as (select doc_id, word, count(*)::double as n from (select doc_id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{white}{stop}!{symbol}]+')) as word from d) group by all),
totals as (select doc_id, sum(n) as total from said group by doc_id),
ordinary as (select d.doc_id, d.lang from d join totals using (doc_id) where d.lang in (select lang from listed) and total >= {quality.MIN_JUDGED_WORDS} and c7 <= {quality.MAX_REFERENCE_SYMBOLS} * word_chars and c2 <= {quality.MAX_REFERENCE_UPPER} * word_chars),
word_bins as (select doc_id, l.lang, word, n from said join listed l using (word)),
all_bins as (select * from word_bins union all select t.doc_id, l.lang, '', total - coalesce((select sum(n) from word_bins b where b.doc_id = t.doc_id and b.lang = l.lang), 0) from totals t, (select distinct lang from listed) l),
word_sums as (select o.lang, word, sum(n) as n from ordinary o join all_bins b on b.doc_id = o.doc_id and b.lang = o.lang group by all),
word_refs as (select lang, word, n / sum(n) over (partition by lang) as q from word_sums),
by_word as (select b.doc_id, b.lang, {distance("coalesce(r.q, 0)", "total")} as distance from all_bins b join totals using (doc_id) left join word_refs r on r.lang = b.lang and r.word = b.word
  where b.lang in (select lang from word_refs) group by b.doc_id, b.lang),
fits as (select doc_id, lang as fits_lang, distance as word_distance from (select *, row_number() over (partition by doc_id order by distance, lang) as k from by_word) where k = 1),
bins as ({bins}),
class_sums as (select o.lang, bin, sum(n) as n from ordinary o join bins using (doc_id) group by all),
class_refs as (select lang, bin, n / sum(n) over (partition by lang) as q from class_sums),
by_class as (select f.doc_id, word_distance, {distance("q", "length(t)")} as class_distance from fits f join d using (doc_id) join bins using (doc_id) join class_refs r on r.lang = fits_lang and r.bin = bins.bin group by all)
select base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(n_words >= {quality.MIN_JUDGED_WORDS} and (lang is null or lang in (select lang from word_refs)) and (
  class_distance * class_distance > {quality.MAX_CLASS_DISTANCE} * {quality.MAX_CLASS_DISTANCE} + {quality.CLASS_NOISE}::double / n_words or
  word_distance * word_distance > {quality.MAX_WORD_DISTANCE} * {quality.MAX_WORD_DISTANCE} + {quality.WORD_NOISE}::double / n_words), false) as kept
from base left join by_class using (doc_id)
"""


OP2_SQL = _op2_sql()


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a quarter of them is held out of training."""
    docs = _read(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_crf.train(docs.where(~out))
    found = language_crf.predict(docs, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of every document."""
    found = secrets.with_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, entropy = F.col("secret_spans"), len(secrets.BASE_PATTERNS)
    counts = [F.size(F.filter(spans, secrets.of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in secrets.BASE_PATTERNS]
    base = secrets.joined(F.filter(spans, lambda s: s["ord"] < entropy))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def _op5_sql() -> str:
    quote = lambda x: x.replace("'", "''").replace("++", "+")
    kinds = [*secrets.BASE_PATTERNS, ("entropy", secrets.CANDIDATE, 0, 20)]
    found = " union all ".join(
        f"select doc_id, {n} as ord, '{kind}' as kind, {least} as least, regexp_extract_all(t, '{quote(p)}') as found, regexp_extract_all(t, '{quote(p)}', {group}) as sized, regexp_split_to_array(t, '{quote(p)}') as pieces from d"
        for n, (kind, p, group, least) in enumerate(kinds)
    )
    allowed = " or ".join(f"regexp_matches(s, '{quote(p)}')" for p in secrets.ALLOW_LIST)
    most = lambda w, bits: -1 if bits is None else (math.log2(w) - bits) * w + 1e-9
    windows = " union all ".join(
        f"select *, {w} as w, substr(s, k, {w}) as part, case when digits then {most(w, bits)!r} else {most(w, strict)!r} end::double as most, '[{chars}]+' as chars from (select *, unnest(range(1, length(s) - {w} + 2)) as k from candidates)"
        for _, chars, w, bits, strict in secrets.ENTROPY_CLASSES
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({found}),
each_one as (select *, unnest(range(1, len(found) + 1)) as i from found),
spans as (select doc_id, ord, kind, found[i] as s, length(sized[i]) >= least as long_enough,
  coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::bigint as start from each_one),
base as (select doc_id, ord, kind, start, start + length(s) as stop from spans where ord < 3 and long_enough),
candidates as (select *, length(regexp_replace(s, '[^0-9]', '', 'g')) >= {secrets.MIN_DIGITS} and regexp_matches(s, '[A-Za-z]') as digits from spans
  where ord = 3 and not ({allowed}) and (digits or (regexp_matches(s, '[a-z]') and regexp_matches(s, '[A-Z]')))),
windows as ({windows}),
hot as (select doc_id, start, s, min(k - 1) as first, max(k - 1 + w) as last from windows
  where regexp_full_match(part, chars) and list_sum(list_transform(map_values(list_aggregate(string_split(part, ''), 'histogram')), lambda c: c * log2(c))) <= most group by all),
stretches as (select doc_id, 3 as ord, 'entropy' as kind, start + first as a, start + last as stop, substr(s, first + 1, last - first) as s from hot),
every as (select * from base union all select * exclude s from stretches h where not ({allowed} or regexp_matches(s, '{secrets.ALLOWED_PARTS}'))
  and not exists (select 1 from base b where b.doc_id = h.doc_id and b.start <= h.a and h.stop <= b.stop)),
joined as (select doc_id, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < 3) as base,
  count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex from every group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join joined using (doc_id)
"""


OP5_SQL = _op5_sql()


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a license notice in a document."""
    return licenses.license_scan(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, over shingles of three words."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.hex16(found["fp"]).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict for every page, and what its aliases say (null: none has a rule)."""
    return url_filter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "alias_verdict")


def _attribute_sql(name: str) -> str:
    forms = (r'"([^"]*)"', r"''([^'']*)''", r"([^\s""''>]+)")
    return "(" + " || ".join(rf"regexp_extract(tag, '(?is)\b{name}\s*=\s*{form}', 1)" for form in forms) + ")"


def _node_sql(url: str) -> str:
    part = lambda k: rf"regexp_extract({url}, '(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)([^#]*?)\s*(?:#.*)?$', {k})"
    return f"case when {part(1)} <> '' then translate({part(1)} || {part(2)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace({part(3)}, '^$', '/') end"


def _rule_sql(host: str, path: str, field: str) -> str:
    return f"(select {field} from rules where ({host} = h or ends_with({host}, '.' || h)) and starts_with({path}, p) order by length(h || p) desc limit 1)"


_HOST, _PATH = (
    rf"translate(regexp_extract(coalesce({{0}}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    r"regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)",
)
OP8_SQL = rf"""
with recursive rules(v, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select page_id, url, {_HOST.format("url")} as host, {_PATH.format("url")} as path, {_node_sql("url")} as node from pages),
tags as (select url as base, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)[^>]*>')) as tag from pages),
links as (select base, regexp_replace(regexp_replace(trim(case
    when regexp_matches(tag, '(?i)^<link') and regexp_matches({_attribute_sql("rel")}, '(?i)(^|\s)canonical(\s|$)') then {_attribute_sql("href")}
    when regexp_matches(tag, '(?i)^<meta') and regexp_matches({_attribute_sql("http-equiv")}, '(?i)^\s*refresh\s*$') then regexp_extract({_attribute_sql("content")}, '(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*[''"]?([^''"]*)', 1) end), '(?i)&amp;', '&', 'g'), '[	

]', '', 'g') as link
  from tags),
absolute as (select base, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then regexp_extract(base, '(?s)^(.*?:)//', 1) || link
    when starts_with(link, '/') then regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || link when link = '' or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    when starts_with(link, '?') then regexp_extract(base, '(?s)^(.*?://[^?#]*)', 1) || link
    else regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(base, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || link end as target from links),
edges as (select {_node_sql("base")} as a, {_node_sql("target")} as b from absolute),
both_ways as (select a, b from edges where a is not null and b is not null and a <> b union select b, a from edges where a is not null and b is not null and a <> b),
reach as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
near as (select r.a as node, bool_or({_rule_sql(_HOST.format("r.b"), _PATH.format("r.b"), "v")} = 'allow') as allowed, bool_or({_rule_sql(_HOST.format("r.b"), _PATH.format("r.b"), "v")} = 'block') as blocked from reach r group by r.a)
select page_id, host, path, {_rule_sql("host", "path", "h || p")} as rule,
  coalesce({_rule_sql("host", "path", "v")}, case when near.allowed then 'allow' when near.blocked then 'block' end, 'allow') as verdict,
  case when near.allowed then 'allow' when near.blocked then 'block' end as alias_verdict
from u left join near on u.node = near.node
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation, and one of control strings."""
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    formatted = chat.format_paths(chat.reply_paths(chat.linear_messages(rows)))
    return chat.read_back(formatted).withColumnRenamed("id", "conv_id")


OP9_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as escaped_role,
    replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as escaped from c)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(replace(escaped_role, ':', '\:')) + 2 + length(escaped) + 9)::bigint as formatted_chars
from e group by conv_id
"""


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read them back, and resolve the revisits."""
    path = storage.scratch_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


OP10_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun anew with turns of the first of its hundred."""
    turns = storage.materialize(trie.ordered_turns(_read(spark, sf_dir, "conversations")), "turns")
    convs = turns.where("place = 0").select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")
    bases = convs.select(F.col("conv_id").alias("_b"), F.col("size").alias("base_size"))
    convs = storage.materialize(convs.join(bases, F.col("base") == F.col("_b"), "left").select("conv_id", "base", "h", "size", taken), "convs", compact=True)
    lent = turns.where("place < 6").select(F.col("conv_id").alias("_b"), "place", "said", "tokens").join(convs, (F.col("base") == F.col("_b")) & (F.col("place") < F.col("taken")))
    own = turns.select(F.col("conv_id").alias("_c"), "place", "said", "tokens").join(convs, (F.col("conv_id") == F.col("_c")) & (F.col("place") >= F.col("h")))
    rebuilt = lent.select("conv_id", "place", "said", "tokens").unionAll(own.select("conv_id", F.col("place") - F.col("h") + F.col("taken"), "said", "tokens"))
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    return trie.prefix_trie(rebuilt, lengths).drop("enters")


_CRC_TABLE = "table_crc as materialized (select k, list_reduce(list_prepend(k, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as k)), crcs as materialized (select list(v order by k) as t from table_crc)"


def _crc_sql(id_column: str) -> str:
    """CRC-32 of a decimal id, where ``t`` of ``crcs`` is in reach."""
    chars = f"list_transform(string_split({id_column}::varchar, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {chars}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP11_SQL = f"""
with {_CRC_TABLE},
turns as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
  from conversations where conv_id is not null),
sizes as (select conv_id, count(*) as size from turns group by conv_id),
convs as materialized (select c.conv_id, c.h, c.size, c.base, least(c.h, coalesce(b.size, 0)) as taken from (select conv_id, size, conv_id - conv_id % 100 as base, {_crc_sql("conv_id")} % 6 as h from sizes, crcs) c left join sizes b on b.conv_id = c.base),
rebuilt as materialized (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.place < c.taken
  union all select c.conv_id, t.place - c.h + c.taken, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.place >= c.h),
members as materialized (
  select conv_id, place + 1 as depth, length(text) as tokens, string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '' order by place) over (partition by conv_id order by place) as k from rebuilt
  union all select conv_id, 0, 0, '' from convs),
nodes as materialized (select k, depth, min(conv_id) as conv_id, count(*) as n_convs, min(tokens) as tokens from members group by k, depth),
ups as materialized (select n.k, n.depth, m.k as up, m.depth as up_depth from nodes n join members m on m.conv_id = n.conv_id and m.depth <= n.depth),
children as (select up as k, count(*) as n_children from ups where up_depth = depth - 1 group by up),
parents as (select u.k, p.conv_id as parent_conv_id from ups u join nodes p on p.k = u.up where u.up_depth = u.depth - 1),
inside as (select u.up as k, count(*) filter (c.k is null) as n_leaves, sum((n.n_convs - 1) * n.tokens) as saved_tokens from ups u join nodes n on n.k = u.k left join children c on c.k = u.k group by u.up),
ends as (select m.k, string_agg(m.conv_id::varchar, ',' order by m.conv_id) as ids from members m join (select conv_id, max(depth) as depth from members group by conv_id) l on l.conv_id = m.conv_id and l.depth = m.depth group by m.k)
select n.conv_id, n.depth::bigint as depth, p.parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n_children, 0)::bigint as n_children, i.n_leaves::bigint as n_leaves, i.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join inside i on i.k = n.k left join parents p on p.k = n.k left join children c on c.k = n.k left join ends e on e.k = n.k
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from every document because an earlier one has it: passages of 50 bytes and more."""
    found = suffixes.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least from w) where least < doc_id),
marked as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as opens from hit),
grouped as (select doc_id, i, sum(opens) over (partition by doc_id order by i) as g from marked),
spans as (select doc_id, min(i) as a, max(i) + 50 as b from grouped group by doc_id, g),
left_over as (
  select d.doc_id, s.a, substr(h, 2 * coalesce(lag(s.b) over (partition by d.doc_id order by s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) over (partition by d.doc_id order by s.a), 0))) as part
  from d join spans s on d.doc_id = s.doc_id
  union all
  select d.doc_id, 1000000000000, substr(h, 2 * coalesce(m.b, 0) + 1) from d left join (select doc_id, max(b) as b from spans group by doc_id) m on d.doc_id = m.doc_id),
kept as (select doc_id, string_agg(part, '' order by a) as h from left_over group by doc_id),
totals as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept on d.doc_id = kept.doc_id left join totals on d.doc_id = totals.doc_id
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf, proof and verification of every document; every seventh or so is tampered with."""
    docs = _read(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = [F.col(f) for f in manifest.FIELDS]
    claimed = manifest.leaf_of([changed if f == "n_chars" else F.col(f) for f in manifest.FIELDS])
    leaves = docs.select(manifest.tree_key("lang").alias("tree"), F.col("doc_id").alias("id"), manifest.leaf_of(fields).alias("hash"), claimed.alias("claimed"))
    made = manifest.build(leaves, payload=["claimed"])
    root = F.lit(made.root).cast("string")
    proof = F.concat_ws("", F.transform("proof", lambda s: F.substring(s, 2, 64)))
    return manifest.verified(made, "claimed").select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def _op13_sql(most: int = 24) -> str:
    """Trees of up to 2 ** ``most`` leaves."""
    field = lambda f, v: f"coalesce(octet_length(encode(({v})::varchar)) || ':' || ({v})::varchar, '-')"
    leaf = lambda change: "sha256(" + " || ".join(field(f, f"n_chars + {change}" if f == "n_chars" else f) for f in manifest.FIELDS) + ")"
    parts = [
        _CRC_TABLE,
        f"docs as materialized (select documents.*, {_crc_sql('doc_id')} as crc from documents, crcs)",
        f"leaves as materialized (select doc_id, lang, {leaf(0)} as leaf, case when crc % 7 = 0 then {leaf(1)} else {leaf(0)} end as claimed from docs)",
        "l0 as materialized (select doc_id, lang as tree, leaf as hash, claimed, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves)",
    ]

    def tree(name: str, first: str) -> str:
        parts.append(f"{name}0 as materialized ({first})")
        for k in range(1, most + 1):
            parts.append(
                f"{name}{k} as materialized (select tree, case when n > 1 then place // 2 else place end as place, case when n > 1 then sha256(string_agg(hash, '' order by place)) else min(hash) end as hash, max((n + 1) // 2) as n from {name}{k - 1} group by tree, n, case when n > 1 then place // 2 else place end)"
            )
        return f"{name}{most}"

    subroots = tree("s", "select tree, place, hash, n from l0")
    root = tree("t", f"select 0 as tree, tree as of, row_number() over (order by tree nulls first) - 1 as place, hash, count(*) over () as n from {subroots}")
    parts.append("p0 as materialized (select l0.*, claimed as folded, '' as proof, place as pos from l0)")
    for k in range(most):
        step = "case when s.hash is null then sha256(p.folded) when s.place < p.pos then sha256(s.hash || p.folded) else sha256(p.folded || s.hash) end"
        parts.append(
            f"p{k + 1} as materialized (select p.* exclude (folded, proof, pos, n), case when p.n > 1 then {step} else p.folded end as folded, case when p.n > 1 then p.proof || coalesce(s.hash, '') else p.proof end as proof, case when p.n > 1 then p.pos // 2 else p.pos end as pos, (p.n + 1) // 2 as n from p{k} p left join s{k} s on p.tree is not distinct from s.tree and p.n > 1 and s.place = xor(p.pos, 1))"
        )
    parts.append(f"q0 as materialized (select p.* exclude (pos, n), p.hash as leaf, t.place as pos, t.n, s.hash as subroot from p{most} p join t0 t on p.tree is not distinct from t.of join {subroots} s on p.tree is not distinct from s.tree)")
    for k in range(most):
        step = "case when s.hash is null then sha256(p.folded) when s.place < p.pos then sha256(s.hash || p.folded) else sha256(p.folded || s.hash) end"
        parts.append(
            f"q{k + 1} as materialized (select p.* exclude (folded, proof, pos, n), case when p.n > 1 then {step} else p.folded end as folded, case when p.n > 1 then p.proof || coalesce(s.hash, '') else p.proof end as proof, case when p.n > 1 then p.pos // 2 else p.pos end as pos, (p.n + 1) // 2 as n from q{k} p left join t{k} s on p.n > 1 and s.place = xor(p.pos, 1))"
        )
    return "with " + ", ".join(parts) + f" select doc_id, leaf, subroot, r.hash as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.hash as verified from q{most}, {root} r"


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix_sources": op1_mix_sources,
        "op2_quality_rules": op2_quality_rules,
        "op3_language_id": op3_language_id,
        "op4_decontaminate": op4_decontaminate,
        "op5_secret_scan": op5_secret_scan,
        "op6_license_scan": op6_license_scan,
        "op7_simhash": op7_simhash,
        "op8_url_filter": op8_url_filter,
        "op9_chat_format": op9_chat_format,
        "op10_warc_revisits": op10_warc_revisits,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB can express the query."""
    found = {"op1_mix_sources": OP1_SQL, "op2_quality_rules": OP2_SQL, "op5_secret_scan": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_chat_format": OP9_SQL, "op10_warc_revisits": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
