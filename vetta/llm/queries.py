"""One query for each operator, over whole tables; and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.llm import bpe, language, lexical, lines, lzprint, media, packing, pii, quality, resample, simhash, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), kept="")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(table(spark, sf_dir, "pages")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_bpe, op3_lzprint, op4_language, op5_quality, op6_simhash, op7_packing, op8_personal, op9_media, op10_warc, op11_resample, op12_lines, op13_lexical)}

#: DuckDB has no XXH64, tokenizer or wave reader; tests hold the others against brute force.
ORACLE: dict[str, str] = {
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
        g as (select page_id, n, sha1(html) as d, max(page_id) over (partition by html) as last from p)
        select page_id, n as payload_bytes, d as payload_digest,
            case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
            case when n >= 1000 and page_id < last then last end as refers_to
        from g
    """,
    "op12_lines": """
        with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
        l as (select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from d),
        k as (select key, max(doc_id) as last from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        j as (select l.doc_id, line, pos, k.key is not null and l.doc_id < k.last as gone from l left join k on l.key = k.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from j group by doc_id
    """,
    "op13_lexical": """
        with low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        d as (select doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from low),
        total as (select count(*) filter (len(terms) > 0) as n, sum(len(terms))::bigint as l from d),
        p as (select doc_id, any_value(n) as n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from d) group by doc_id, term),
        q as (
            select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from benchmark
        ),
        w as (select term, floor(1000 * ln((2 * total.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, total group by term, total.n),
        s as (
            select item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * p.n * total.n) // total.l)))))::bigint as score
            from q join p using (term) join w using (term) cross join total group by item_id, doc_id
        ),
        r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 50
    """,
}
