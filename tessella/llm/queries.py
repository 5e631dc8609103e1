"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.hnsw import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.jaccard import near_components

    found = near_components(table(spark, sf_dir, "documents"), percent=85, words=4)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.common import fresh_path
    from tessella.llm.warc import read_archives, resolve, write_archives

    path = fresh_path(spark, "warc")
    write_archives(resolve(table(spark, sf_dir, "pages"), min_bytes=0), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pivots import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


#: The rules of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.urlfilter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.secrets import find_secrets, update_ledger

    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, update_ledger(docs))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.quality import held_out, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return score(rows, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op9_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.dac import token_archive

    return token_archive(table(spark, sf_dir, "documents"), vocabulary())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixing import mixed_sizes

    return mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


ALL = (
    op1_packing,
    op2_hnsw,
    op3_jaccard,
    op4_warc,
    op5_top_products,
    op6_url_filter,
    op7_secrets,
    op8_quality,
    op9_token_archive,
    op10_mixing,
)


#: Digits of base32 and lower-casing of A-Z, as DuckDB SQL.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _sha1_base32(x: str) -> str:
    digit = f"substr('{_BASE32}', 1 + ((('0x' || substr(sha1({x}), 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int, 1)"
    return f"list_aggregate([{digit} for k in range(32)], 'string_agg', '')"


def _spans(kind: str, pattern: str, rank: int, group: int, least: int) -> str:
    """Rows (doc_id, start, rank, stop, kind) of a pattern's matches, from the texts between them."""
    p = pattern.replace("'", "''")
    return f"""
    select doc_id, a + len(m) * 0 as start, {rank} as rank, a + len(m) as stop, '{kind}' as kind from (
        select doc_id, m, g, len(b) + sum(len(b) + len(m)) over (partition by doc_id order by i) - len(b) - len(m) as a from (
            select doc_id, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gs) as g, unnest(bs[:len(ms)]) as b from (
                select doc_id, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {group}) as gs, string_split_regex(t, '{p}') as bs
                from (select doc_id, coalesce(text, '') as t from documents) where regexp_matches(t, '{p}'))))
    where len(g) >= {least}"""


def _secrets_sql() -> str:
    from tessella.llm.secrets import RULES

    rows = " union all ".join(_spans(r.kind, r.pattern, i, r.group, r.least) for i, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    text = "concat(kind, ':', start, ':', stop)"
    return f"""
    with found as ({rows}), lines as (
        select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
            string_agg({text}, ',' order by start, rank) filter (kind in ({base})) as base, string_agg({text}, ',' order by start, rank) as spans
        from found group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from documents d left join lines using (doc_id)"""


def _jaccard_sql() -> str:
    """All pairs that share a shingle, then reachability; for small tables."""
    return f"""
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
    shingles as (
        select distinct doc_id, s from (
            select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as s from words)),
    sets as (select doc_id, count(*) as n, hash(list(s order by s)) as h from shingles group by doc_id),
    firsts as (select h, n, min(doc_id) as rep from sets group by h, n),
    slim as (select s.doc_id as rep, s.s, f.n from shingles s join firsts f on s.doc_id = f.rep),
    pairs as (
        select a.rep as a, b.rep as b from slim a join slim b on a.s = b.s and a.rep < b.rep and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
        group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    edges as (select a, b from pairs union all select b, a from pairs union all select rep, rep from firsts),
    reach(node, root) as (select a, b from edges union select r.node, e.b from reach r join edges e on r.root = e.a),
    roots as (select node, min(root) as root from reach group by node)
    select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.root, d.doc_id) as component_id
    from documents d left join sets s using (doc_id) left join firsts f on s.h = f.h and s.n = f.n left join roots r on r.node = f.rep"""


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    rest = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
    return f"""
    with parts as (
        select page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
        from (select page_id, coalesce({rest}, '') as r from pages)),
    rules(h, p, a) as (values {rules})
    select page_id, host, path, max_by(h || p, len(h || p)) as rule, coalesce(max_by(a, len(h || p)), 'allow') as verdict
    from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id, host, path"""


_WARC_SQL = f"""
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html) as payload_bytes, {_sha1_base32("html")} as payload_digest,
        min(page_id) over (partition by html) as first_id from p)
    select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
        case when page_id <> first_id then first_id end as refers_to from d"""

_TOP_SQL = """
    with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as c from embeddings),
    s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.c::double[], v.c::double[])::bigint as score
        from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
    from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force.

    No SQL is given for tokenizers, trained trees, graphs and Newton steps.
    """
    return {
        "op3_jaccard": _jaccard_sql(),
        "op4_warc": _WARC_SQL,
        "op5_top_products": _TOP_SQL,
        "op6_url_filter": _url_sql(),
        "op7_secrets": _secrets_sql(),
    }
