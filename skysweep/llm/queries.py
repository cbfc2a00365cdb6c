"""Registered queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysweep.llm.exact_dedup import exact_duplicates
from skysweep.llm.metric_search import top_products
from skysweep.llm.mixing import mix_sources
from skysweep.llm.near_dedup import near_duplicates
from skysweep.llm.piece_dropout import encode_documents
from skysweep.llm.private_data import find_private_data
from skysweep.llm.resampling import resample
from skysweep.llm.sharding import assign_shards
from skysweep.llm.token_counts import token_counts
from skysweep.llm.toxicity import score_toxicity
from skysweep.llm.tree_encoding import encode_documents as encode_by_tree
from skysweep.llm.turn_repair import repair_conversations
from skysweep.llm.url_filter import judge_urls, label_outcomes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every worker; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_private_data")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return find_private_data(table(spark, folder, "documents"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query(
    "op4_mtree_search",
    """
    with v as (
        select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
        where vec_id is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
        select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
    select query_id, cast(rank as int) as rank, vec_id, score
    from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"))


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"))


@query("op6_piece_dropout")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op8_url_reputation",
    """
    with rules(verdict, host, path, rule) as (values ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'),
        ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')),
    p as (
        select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
        from pages),
    l as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
    n as (
        select p.host, array_to_string(list_slice(string_split(p.host, '.'), -2, -1), '.') as domain,
            list_last(string_split(p.host, '.')) as suffix, count(l.bad) as seen, coalesce(sum(l.bad), 0) as bad
        from p left join l using (page_id) group by p.host),
    s1 as (select suffix, sum(seen) as seen, sum(bad) as bad, ((select sum(bad) from n) - sum(bad) + 1.0) / ((select sum(seen) from n) - sum(seen) + 2.0) as m
        from n group by suffix),
    r1 as (select 1 / coalesce(least(greatest(sum(seen * power(bad / seen - m, 2) - m * (1 - m)) filter (seen > 0)
        / nullif(sum(m * (1 - m) * (seen - 1)) filter (seen > 0), 0), 0.001), 0.5), 0.001) - 1 as s from s1),
    s2 as (select suffix, domain, sum(n.seen) as seen, sum(n.bad) as bad, any_value(s1.bad) as b, any_value(s1.seen) as c, any_value(s1.m) as p
        from n join s1 using (suffix) group by suffix, domain),
    t2 as (select suffix, domain, seen, bad, (b - bad + r1.s * p) / (c - seen + r1.s) as m from s2, r1),
    r2 as (select 1 / coalesce(least(greatest(sum(seen * power(bad / seen - m, 2) - m * (1 - m)) filter (seen > 0)
        / nullif(sum(m * (1 - m) * (seen - 1)) filter (seen > 0), 0), 0.001), 0.5), 0.001) - 1 as s from t2),
    s3 as (select n.host, n.seen, n.bad, (t2.bad - n.bad + r2.s * t2.m) / (t2.seen - n.seen + r2.s) as m
        from n join t2 using (suffix, domain), r2),
    r3 as (select 1 / coalesce(least(greatest(sum(seen * power(bad / seen - m, 2) - m * (1 - m)) filter (seen > 0)
        / nullif(sum(m * (1 - m) * (seen - 1)) filter (seen > 0), 0), 0.001), 0.5), 0.001) - 1 as s from s3),
    t3 as (select host, (bad + r3.s * m) / (seen + r3.s) as mean, seen + r3.s as weight from s3, r3),
    fit as (
        select p.page_id, p.host, p.path, max_by(rules.rule, length(rules.rule)) as rule, max_by(rules.verdict, length(rules.rule)) as verdict
        from p left join rules on (p.host = rules.host or suffix(p.host, '.' || rules.host)) and starts_with(p.path, rules.path)
        group by p.page_id, p.host, p.path)
    select page_id, host, path, rule,
        coalesce(verdict, case when mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 then 'block' else 'allow' end) as verdict
    from fit join t3 using (host)
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), label_outcomes(table(spark, folder, "labels")))


@query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query(
    "op10_exact_dedup",
    """
    with t as (
        select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
        from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
        row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
    from t window g as (partition by text_sha256)
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_tree_encoding")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    made = encode_by_tree(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(table(spark, folder, "conversations"))
