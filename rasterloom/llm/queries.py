"""The queries opN_<name> and pipeline: each applies its operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import chat_format, decontaminate, html_text, jaccard_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, warc
from rasterloom.llm._session import discarded_at_exit, prepared, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL["op6_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * met >= 4 * (x.n + y.n - met)),
s AS (SELECT doc_id, list(g ORDER BY g) AS s FROM g GROUP BY doc_id), c AS (SELECT s, count(*) - 1 AS n_copies FROM s GROUP BY s),
r(id, place) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.place)
SELECT w.doc_id, k.class_id, coalesce(d.n, 0) AS n_links, coalesce(c.n_copies, 0) AS n_copies FROM w JOIN (SELECT id, min(place) AS class_id FROM r GROUP BY id) k ON k.id = w.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN c ON c.s = s.s"""
_ANY = "|".join(sorted((m[0].replace("[", r"\[") + r"\\*" + m[1:].replace("[", r"\[").replace("]", r"\]") for m in chat_format._CONTROL), key=len, reverse=True))
SQL["op8_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(text) + len(regexp_extract_all(text, '{_ANY}')) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 34 + length(role) + len(regexp_extract_all(role, '{_ANY}')) END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""
SQL["op9_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages), q AS (SELECT page_id, octet_length(h) AS n, sha1(h) AS d FROM p), r AS (SELECT d, max(page_id) AS last FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM q LEFT JOIN r ON q.d = r.d AND q.n >= 1000"""
SQL["op10_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS x FROM w, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) > 34),
f AS (SELECT doc_id, i FROM x JOIN (SELECT x FROM x GROUP BY x HAVING count(*) > 1) d ON d.x = x.x),
g AS (SELECT DISTINCT doc_id, i + k AS j FROM f, range(35) AS t(k)), h AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)))) END AS kept FROM w LEFT JOIN h ON h.doc_id = w.doc_id)
SELECT doc_id, n AS n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), target, keep=["doc_id"])


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(prepared(spark), sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", (quality_classifier.fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(prepared(spark), sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_chats(told.unionByName(own)))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.as_records(table(spark, sf_dir, "pages")), path)
    discarded_at_exit(spark, path)
    return warc.read_warc(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), quality_rules.SPACE, " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
