"""The registered queries of the corpus operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import urls
from karst.llm.urls import Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.minhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.hamming import top_k

    rows = _table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm import chat

    said = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "'</s>[INST] ok [/INST]'"
    said = said.union(spark.sql(f"SELECT -7L, 0L, 'user', {odd} UNION ALL SELECT -7L, 1L, 'assistant', {odd}"))
    done = chat.format_chats(said.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("segments"))
    return done.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from karst.llm.common import Scratch
    from karst.llm.repair import read_shards, write_shards

    docs = _table(spark, sf_dir, "documents")
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 2, Scratch(spark, "repair")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from karst.llm.pieces import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm import pii

    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.written(F.filter("pii", pii.is_base)), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.lm import learn_and_score

    return learn_and_score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.mainhtml import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.impact import Index

    return Index(_table(spark, sf_dir, "documents")).search(_table(spark, sf_dir, "benchmark"), 20)


#: Verdicts by host and path that the contract of op12 fixes.
URL_RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, urls.reported(pages))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from karst.llm.whiten import whiten

    return whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_hamming_top_k": op2_hamming_top_k,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_repair_token_ids": op4_repair_token_ids,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_search": op11_ranked_search,
    "op12_url_filters": op12_url_filters,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
    FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
    SELECT doc_id, doc_id AS c FROM s
    UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id),
class AS (SELECT list_sort(s) AS k, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept, coalesce(class_id, s.doc_id) AS class_id
FROM s JOIN comp USING (doc_id) LEFT JOIN class ON class.k = list_sort(s.s) AND len(s.s) > 0
""",
    "op2_hamming_top_k": """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x >= 0, false)) AS s FROM embeddings),
d AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 65), lambda i: (q.s[i] <> c.s[i])::INT))::BIGINT AS distance
    FROM c AS q, c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
""",
    "op3_chat_formatting": """
WITH t AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS er, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS et FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(er) + length(et) + 33)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op11_ranked_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
m AS (SELECT doc_id, t, 75 + (25 * len(t) * n) // l AS m FROM d, size WHERE len(t) > 0),
tf AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(t) AS term FROM m) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""",
    "op12_url_filters": f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}'))) AS q
    FROM p),
c AS (
    SELECT page_id, host, path, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') AS site, regexp_replace(path, '/+$', '') AS way,
        CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS query
    FROM h),
u AS (SELECT page_id, host, path, CASE WHEN site <> '' THEN site || way || query END AS canonical FROM c),
listed AS (SELECT DISTINCT canonical FROM u WHERE canonical IS NOT NULL AND regexp_matches(host, '{urls.REPORTED}')),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}) AS r(verdict, host, path)),
fits AS (
    SELECT u.host, u.path, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host) + length(r.path)) AS best
    FROM (SELECT DISTINCT host, path FROM u) AS u JOIN rules AS r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY 1, 2)
SELECT u.page_id, u.host, u.path, best.rule AS rule, coalesce(best.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, u.canonical
FROM u LEFT JOIN fits ON fits.host = u.host AND fits.path = u.path LEFT JOIN listed ON listed.canonical = u.canonical
""",
}
