"""Registered queries of this package, with SQL counterparts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowrill.llm.collocations import collocations
from flowrill.llm.decontaminate import contamination
from flowrill.llm.fingerprints import fingerprint_documents
from flowrill.llm.frames import stored
from flowrill.llm.lexical_search import build_index, search
from flowrill.llm.licenses import scan_licenses
from flowrill.llm.line_dedup import drop_common_lines
from flowrill.llm.mixing import replicate
from flowrill.llm.near_dups import near_classes
from flowrill.llm.quality import quality_scores
from flowrill.llm.sharding import shuffle_into_shards
from flowrill.llm.token_counts import token_counts
from flowrill.llm.token_files import token_id_output
from flowrill.llm.warc import archive, read_records
from flowrill.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, _table(spark, sf_dir, "benchmark")).drop("passages")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt to shards; sizes and checksums are those of the texts that arrive."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs, 16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(_table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_id_output(docs, shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_size", "keep")


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the SQL counterpart, read back from the mixed corpus of whole documents."""
    mixed, _ = stored(replicate(_table(spark, sf_dir, "documents")), "mixed", "zstd")
    return mixed.select("doc_id", "source", "copy", "order_key").orderBy("order_key")


@query
def op10_mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus itself, texts and all other columns."""
    return replicate(_table(spark, sf_dir, "documents"))


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), k=10)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("lang", "text")
    found = collocations(docs, longest=5, min_count=100, share=100, best=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op3_decontaminate"] = f"""
with item as (select item_id, {_WORDS_SQL} as w from benchmark),
windows as (
  select item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from item, unnest(range(1, greatest(len(w) - 11, 2))) as u(i) where len(w) > 0
),
doc as (select doc_id, {_WORDS_SQL} as w from documents),
lengths as (select distinct n from windows),
places as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from doc, lengths, unnest(range(1, len(w) + 1)) as u(i) where i + n - 1 <= len(w)
),
found as (select doc_id, item_id, i, places.n from places join windows using (s)),
hit as (
  select doc_id, count(distinct p) as n_hit from found, unnest(range(i, i + n)) as u(p) group by doc_id
),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select doc.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""

ORACLES["op7_warc"] = """
with page as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
  from pages
),
largest as (
  select payload_digest, max(page_id) as target from page where payload_bytes >= 1000 group by payload_digest
)
select page_id, payload_bytes, payload_digest,
  case when page_id <> target then 'revisit' else 'response' end as record_type,
  case when page_id <> target then target end as refers_to
from page left join largest using (payload_digest)
"""

ORACLES["op10_mix_sources"] = """
with counts as (select source, count(*) as n from documents group by source),
rates as (
  select source, pow(n, 0.5) / sum(pow(n, 0.5)) over () * sum(n) over () / n as rate from counts
),
terms as (
  select source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) as term
  from rates, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint) + 1)) as u(k)
),
steps as (
  select source, sum(term) over (partition by source order by k rows unbounded preceding) as step from terms
),
drawn as (
  select doc_id, source,
    cast(concat('0x', substr(md5(concat('10:', coalesce(cast(doc_id as varchar), ''))), 1, 13)) as bigint)
      / 4503599627370496.0 as u
  from documents
),
times as (
  select doc_id, source, (select count(*) from steps s where s.source is not distinct from drawn.source and s.step <= u) as n
  from drawn
)
select doc_id, source, cast(c as integer) as copy,
  cast(concat('0x', substr(md5(concat('10:', coalesce(cast(doc_id as varchar), ''), ':', c)), 1, 15)) as bigint) as order_key
from times, unnest(range(1, n + 1)) as u(c)
"""

ORACLES["op11_line_dedup"] = """
with line as (
  select doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (
    select doc_id, unnest(range(1, len(lines) + 1)) as i, unnest(lines) as l
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)
  )
),
common as (select key from line where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from (select line.*, common.key is not null as gone from line left join common using (key)) group by doc_id
"""

ORACLES["op12_lexical_search"] = f"""
with query as (select distinct item_id, unnest({_WORDS_SQL}) as term from benchmark),
doc as (select doc_id, unnest(w) as term, len(w) as n from (select doc_id, {_WORDS_SQL} as w from documents) where len(w) > 0),
sums as (select count(*) as docs, cast(sum(n) as bigint) as terms from (select doc_id, any_value(n) as n from doc group by doc_id)),
posting as (
  select doc_id, term, count(*) as tf, any_value(n) as n from doc where term in (select term from query) group by doc_id, term
),
weight as (
  select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w
  from posting, sums group by term
),
impact as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) as part
  from posting join weight using (term), sums
),
scored as (
  select item_id, doc_id, cast(sum(part) as bigint) as score from impact join query using (term) group by item_id, doc_id
),
ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""

ORACLES["op13_collocations"] = r"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents
),
run as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
sizes as (select lang, cast(sum(len(w)) as bigint) as n from run group by lang),
phrase as (
  select lang, array_to_string(w[i : i + d - 1], ' ') as phrase, d, count(*) as f
  from run, unnest(range(1, 6)) as x(d), unnest(range(1, len(w) + 1)) as y(i)
  where i + d - 1 <= len(w) group by all having count(*) >= 100
),
split as (select lang, phrase, d, f, string_split(phrase, ' ') as w from phrase),
inside as (
  select lang, array_to_string(w[s : s + k - 1], ' ') as phrase, max(f) as longer
  from split, unnest(range(2, 5)) as x(k), unnest(range(1, 5)) as y(s)
  where k < d and s + k - 1 <= d group by all
),
cut as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, n, k,
    cast((1000 * c.f::hugeint * n) // (l.f::hugeint * r.f) as bigint) as score
  from split c join sizes using (lang), unnest(range(1, 5)) as x(k), phrase l, phrase r
  where c.d > 1 and k < c.d
    and l.lang = c.lang and l.phrase = array_to_string(c.w[1 : k], ' ')
    and r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1 : c.d], ' ')
),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as nth from cut),
ranked as (
  select o.lang, o.phrase, a, l, r, n, score,
    row_number() over (partition by o.lang order by score desc, a desc, o.phrase) as rank
  from lowest o left join inside i on i.lang = o.lang and i.phrase = o.phrase
  where nth = 1 and (longer is null or 100 * longer < 100 * a)
)
select lang, cast(rank as integer) as rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
