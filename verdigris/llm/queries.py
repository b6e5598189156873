"""The registered queries of the text operators, over the whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import (
    chat_quotes, decontaminate, hard_negatives, license_scan, line_dedup, periodic_runs, piece_codec, pii, quality_rules, secret_scan, simhash, token_counts, toxicity,
)
from verdigris.llm.license_scan import GRAM, LEAST, NOTICES, PHRASES, SLACK, gram_size, template_words

MODEL = "piece_bpe_32k.model"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def model_path(name: str = MODEL) -> str:
    """Where a public vocabulary file is; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.sanitise(read(spark, folder, "documents"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encode_pieces(read(spark, folder, "documents"), model_path()).drop("ids")


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"), model_path())


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_dropped and dropped_lines (number:doc_id:number of the line that stays) of every document."""
    found = line_dedup.deduplicate_lines(read(spark, folder, "documents").select("doc_id", "text"))
    told = F.transform("__dropped", lambda x: F.concat_ws(":", x["number"].cast("string"), x["doc_id"].cast("string"), x["first"].cast("string")))
    return found.select("doc_id", F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(told, ","), F.lit("")).alias("dropped_lines"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_chat_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return chat_quotes.reply_ordered(read(spark, folder, "conversations"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth document is made periodic first, by the query's rule."""
    return periodic_runs.periodic_runs(read(spark, folder, "documents"), alter=True, texts=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_sentencepiece, op3_secret_scan, op4_simhash, op5_token_counts, op6_line_dedup, op7_decontaminate, op8_quality_rules, op9_toxicity, op10_chat_quotes,
        op11_license_scan, op12_hard_negatives, op13_periodic_runs,
    )
}


def _template_rows() -> str:
    """The templates of the license scan as SQL rows (template, label, base, k, words)."""
    told = [(text, label, base) for group, base in ((PHRASES, "true"), (NOTICES, "false")) for text, label in group]
    return ", ".join(f"({t}, '{label}', {base}, {gram_size(template_words(text))}, string_split('{' '.join(template_words(text))}', ' '))" for t, (text, label, base) in enumerate(told))


#: Where SQL can say the same over the whole tables. The others are held against brute force in the tests.
ORACLE_SQL = {
    "op7_decontaminate": r"""
with words as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), phrases as (
  select id, least(len(w), 10) as size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) as phrase
  from words where side = 'b' and len(w) > 0
), starts as (
  select id, size, unnest(range(1, len(w) - size + 2)) as i, w
  from words cross join (select distinct size from phrases) where side = 'd' and len(w) >= size
), hits as (
  select s.id, s.i, s.size, p.id as item from (select id, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase from starts) s join phrases p on s.phrase = p.phrase and s.size = p.size
), covered as (
  select id, count(distinct place) as n_hit from (select id, unnest(range(i, i + size)) as place from (select distinct id, i, size from hits)) group by id
), items as (
  select id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct id, cast(item as varchar) as item from hits) group by id
)
select w.id as doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join covered c on w.id = c.id left join items i on w.id = i.id where w.side = 'd'
""",
    "op11_license_scan": rf"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), templates(template, label, base, k, t) as (values {_template_rows()}
), wanted as (
  select template, label, base, k, len(t) as size, i as tp, array_to_string(t[i + 1:i + k], ' ') as gram from templates, unnest(range(len(t) - k + 1)) as u(i)
), grams as (
  select doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') as gram from words cross join (select distinct k from templates), unnest(range(len(w) - k + 1)) as u(i)
), hits as (
  select doc_id, template, label, base, g.k, size, i - tp as diagonal, tp, i from grams g join wanted t on g.gram = t.gram and g.k = t.k
), places as (
  select doc_id, label, diagonal from hits where base group by doc_id, template, label, diagonal, size, k having count(distinct tp) = max(size - k + 1)
), centres as (select distinct doc_id, template, label, diagonal, size, k from hits where not base
), merged as (
  select c.doc_id, c.template, c.label, c.diagonal, c.size, h.tp, h.i, c.k from centres c join hits h on c.doc_id = h.doc_id and c.template = h.template and abs(h.diagonal - c.diagonal) <= {SLACK}
), shares as (
  select m.doc_id, template, label, diagonal, size, min(i) as first, max(i) + k - 1 as last, count(distinct tp + o) / size as share from merged m, unnest(range(m.k)) as u(o) group by m.doc_id, template, label, diagonal, size, k
), sure as (
  select *, case when (diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal)) * 2 < size then 0 else 1 end as opens from shares where share >= {LEAST}
), grouped as (select *, sum(opens) over (partition by doc_id, template order by diagonal) as span from sure
), spans as (
  select doc_id, label, first, last from (select *, row_number() over (partition by doc_id, template, span order by share desc, diagonal) as r from grouped) where r = 1
), by_base as (
  select doc_id, count(*) as n, min(diagonal) as a, max(diagonal) as b, string_agg(distinct label, ',' order by label) as labels from places group by doc_id
), by_label as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from spans) group by doc_id
), by_span as (select doc_id, string_agg(label || ':' || first || ':' || last, ',' order by first, last, label) as spans from spans group by doc_id
), by_share as (select doc_id, max(share) as share from shares group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(b.n, 0) as bigint) as n_base, cast(b.a as bigint) as first_word, cast(b.b as bigint) as last_word,
       coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels, cast(case when b.n > 0 then 1 else coalesce(s.share, 0) end as double) as score, coalesce(p.spans, '') as spans
from words w left join by_base b on w.doc_id = b.doc_id left join by_label l on w.doc_id = l.doc_id left join by_share s on w.doc_id = s.doc_id left join by_span p on w.doc_id = p.doc_id
""",
    "op12_hard_negatives": """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, r.vec_id, r.label, cast(list_inner_product(a.v, r.v) as bigint) as score from rows a join rows r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
), positives as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from scored where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and s.label <> p.anchor_label and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
""",
    "op13_periodic_runs": r"""
with hashed as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as o,
         xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
           lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) as h
  from documents
), rule as (select doc_id, o, len(o) as n, h, case when h % 10 = 0 and len(o) > 0 then (h // 10) % len(o) end as a, 3 + (h // 10) % 8 as d from hashed
), words as (
  select doc_id, n, list_transform(range(n), lambda i: o[1 + case when a is not null and i >= a then a + (i - a) % (1 + (n - a) // d) else i end]) as w from rule
), grams as (
  select doc_id, i, array_to_string(w[i + 1:i + 6], ' ') as gram from words, unnest(range(n - 5)) as u(i) where n >= 12
), pairs as (
  select x.doc_id, y.i - x.i as q, x.i from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
), islands as (
  select doc_id, q, min(i) as start, count(*) + 5 + q as length from (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs) group by doc_id, q, island
), runs as (
  select doc_id, start, length, min(q) as period from islands where length >= 2 * q and length >= 12 group by doc_id, start, length
), best as (
  select doc_id, start, length, period from runs qualify row_number() over (partition by doc_id order by length desc, start, period) = 1
), told as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as list from runs group by doc_id
), gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), left_over as (
  select s.doc_id, string_agg(s.w, ' ' order by s.i) as text from (select doc_id, unnest(range(n)) as i, unnest(w) as w from words) s left join gone g on s.doc_id = g.doc_id and s.i = g.i where g.i is null group by s.doc_id
)
select w.doc_id, coalesce(n_runs, 0) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length, cast(period as bigint) as period, cast(1000 * length // period as bigint) as exponent_milli,
       sha256(coalesce(list, '')) as runs_sha256, sha256(coalesce(l.text, '')) as collapsed_sha256
from words w left join best b on w.doc_id = b.doc_id left join told t on w.doc_id = t.doc_id left join left_over l on w.doc_id = l.doc_id
""",
}
