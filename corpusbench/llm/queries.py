"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusbench.llm.chat import repair_conversations
from corpusbench.llm.compression import fit_quality, score_quality
from corpusbench.llm.decontam import contaminated_pairs
from corpusbench.llm.jaccard import near_copies
from corpusbench.llm.language import fit_languages, predict_languages
from corpusbench.llm.middle import middle_digests
from corpusbench.llm.packing import pack_documents
from corpusbench.llm.quality import quality_rules
from corpusbench.llm.resample import importance_sample
from corpusbench.llm.suffix import repeat_report
from corpusbench.llm.tokens import token_round_trip
from corpusbench.llm.toxicity import fit_toxicity, score_toxicity
from corpusbench.llm.warc import page_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
# shingles of five words, or of a shorter item's own length
LEAKS_SQL = f"""
with i as (select item_id, {SPLIT.format("lower(text)")} as w from benchmark),
     b as (select distinct item_id, least(len(w), 5) as k, array_to_string(w[j : j + least(len(w), 5) - 1], ' ') as s
           from (select item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as j from i where len(w) > 0)),
     n as (select item_id, count(*) as n_item from b group by item_id),
     d as (select distinct doc_id, k, array_to_string(w[j : j + k - 1], ' ') as s
           from (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) as j
                 from (select doc_id, {SPLIT.format("lower(text)")} as w from documents), (select distinct k from b) where len(w) >= k))
select doc_id, item_id, count(*) as n_shared, n_item, count(*) / n_item as containment
from d join b using (k, s) join n using (item_id) group by doc_id, item_id, n_item having 10 * count(*) >= 8 * n_item
"""


@query("op1_decontamination", LEAKS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_planes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, length=4096)


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_SQL = f"""
with recursive w as (select doc_id, {SPLIT.format(LOWER)} as w from documents where text is not null),
     s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     o as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
     links as (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 80 * (na.n + nb.n - o)),
     reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) as component_id
from documents d left join n using (doc_id) left join reach r on r.doc_id = d.doc_id group by d.doc_id, n.n
"""


@query("op7_jaccard_join", NEAR_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query("op9_chat_repair")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as body, cast(cast(from_hex(sha1(coalesce(html, ''))) as bit) as varchar) as bits,
                  max(page_id) over (partition by coalesce(html, '')) as latest from pages)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('{BASE32}', 1
         + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int) + 4 * cast(substr(bits, 5 * i + 3, 1) as int)
         + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int), 1)), 'string_agg', '') as payload_digest,
       case when page_id < latest then 'revisit' else 'response' end as record_type,
       case when page_id < latest then latest end as refers_to
from p
"""


@query("op10_warc", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_round_trip(spark, table(spark, sf_dir, "pages"))


# crc32 of each distinct feature, byte by byte with the usual table; distinct features only, since this is slow
RESAMPLE_SQL = f"""
with steps as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
     words as materialized (select 'd' as kind, doc_id as id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
              union all select 'b', null, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
     grams as materialized (select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words where len(w) > 0),
     hashes as materialized (select f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: cast('0x' || substr(hex(encode(f)), 2 * i + 1, 2) as bigint)),
              lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 as bucket from (select distinct f from grams) x, steps),
     counts as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from grams join hashes using (f) group by bucket),
     totals as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from counts),
     gains as (select bucket, floor(1000 * ln(((t + 1)::double * (ss + 10000)::double) / ((s + 1)::double * (tt + 10000)::double))) as g from counts, totals),
     sums as (select id, count(*) as n, sum(g) as g from grams join hashes using (f) join gains using (bucket) where kind = 'd' group by id),
     scored as (select doc_id, coalesce(len(w), 0) as n_words, coalesce(n, 0) as n_features, cast(coalesce(floor(g / n), 0) as bigint) as weight,
              cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as noise
              from documents d left join sums on sums.id = d.doc_id left join words on kind = 'd' and words.id = d.doc_id),
     ranked as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as rank, count(*) over () as n from scored where n_words >= 20)
select doc_id, n_features, weight, weight + noise as score, case when rank <= (25 * n) // 100 then rank end as rank from scored left join ranked using (doc_id)
"""


@query("op11_importance_resampling", RESAMPLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=7, percent=25, least_words=20, longest=2, buckets=10_000)


MIDDLE_SQL = """
with h as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
                  list_transform(range(4), lambda k: cast('0x' || substr(sha256('1:' || doc_id), 8 * k + 1, 8) as bigint)) as h from documents),
     c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
                  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
                       when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t
                        when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) as output_sha256,
       sha256(t) as restored_sha256
from c
"""


@query("op12_fill_in_middle", MIDDLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)


@query("op13_compression_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
