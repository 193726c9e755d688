"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import (conversations, exact, lines, mixing, mtree, packing, quality, repeats, simhash, spelling, token_counts, token_files,
               toxicity)
from .common import documents

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
LIMIT, END_ID, K, QUERY_EVERY, DAMAGE_EVERY = 512, 1, 20, 20, 97


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts through a new digest cache in the shared folder."""
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), scratch_folder(spark, "token_cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "content_digest")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every 20th vector."""
    return mtree.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, K)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix with target weights by source."""
    return mixing.mix(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole texts, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    trie, weights = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.score(docs, trie, weights)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=END_ID)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that strings of 50 bytes from earlier documents cover."""
    cut = repeats.remove_repeats(documents(spark, sf_dir), digest=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, counts and checksums of all documents, read back from the ORC files."""
    path = scratch_folder(spark, "token_files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE), end_id=END_ID)
    return token_files.file_manifest(spark, path)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stays for each text, and the digest of its squeezed form."""
    docs = documents(spark, sf_dir).withColumn("text_sha256", F.sha2(exact.squeezed(), 256))
    return exact.mark_duplicates(docs, carry=("text_sha256",))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document."""
    return quality.graded(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word, with misspellings planted in the texts."""
    return spelling.spelling_variants(spelling.count_words(documents(spark, sf_dir), damage_every=DAMAGE_EVERY))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, audit and digest of the repair of every damaged conversation."""
    given = documents(spark, sf_dir, "conversations")
    return conversations.summary_with_digests(given, conversations.repair(conversations.damaged(given)))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as repeats, and the digest of the rest."""
    kept = lines.drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_top_k, op3_mix_sources, op4_toxicity, op5_packing, op6_repeats,
                                   op7_token_files, op8_exact_dedup, op9_simhash, op10_quality, op11_spelling, op12_conversations,
                                   op13_line_dedup)}

SPACES = "[\\x20\\x09-\\x0D]+"

STATEMENTS = {
    "op2_exact_top_k": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
""",
    "op13_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.keep IS NOT NULL AND r.keep <> k.doc_id AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
