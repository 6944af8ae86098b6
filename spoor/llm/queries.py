"""The registered queries of this subpackage; each digests its operator's rows."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import content_sort, decontaminate, mixing, neighbours, runs, secrets, sharding, simhash, substring_dedup, token_store, toxicity, warc, whitening
from spoor.llm.common import word_count
from spoor.session import land, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file: from its installed index if there is one, else below SPOOR_TOKENIZERS."""
    try:
        return importlib.import_module("public_tokenizers").path(name)
    except ModuleNotFoundError:
        return os.path.join(os.environ.get("SPOOR_TOKENIZERS", "/opt/tokenizers"), name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_samples(docs))
    found = secrets.scan(docs, model)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), number("model").alias("n_model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))
    rows = land(rows.withColumn("tie", F.xxhash64("doc_id", "key")), "shard_keys")
    out = sharding.shard(rows, "size", "key", "tie", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_store.read_token_summaries(spark, path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = land(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key")), "mix_rows")
    return mixing.mix(rows, "size", "source", "key").select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    model = toxicity.train(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    out = toxicity.score(docs, "text", model, "score", "sentences")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_decontamination, op4_sharding, op5_token_planes, op6_mixing, op7_simhash, op8_nearest_vectors, op9_toxicity, op10_warc_revisits, op11_periodic_runs, op12_exact_dedup, op13_whitening)}

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(p) WHERE len(w) >= 35),
rep AS (SELECT r, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, p + i AS p FROM rep, range(35) AS s(i)),
word AS (SELECT r, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)""",
    "op10_warc_revisits": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS best FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr({_BASE32}, ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM h""",
    "op12_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT doc_id, x, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g""",
}
