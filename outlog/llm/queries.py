"""Registered queries of the operators: thin calls over whole tables, results by contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import ann, bpe, exact, langid, lm, minhash, mixing, quality, runs, sharding, suffix, trie, url_rules
from .common import ascii_lower, words

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: fixed rules first, else mined rules (no match: allow).

    Rules are mined from the labelled pages: bad is quality 0 or toxic 1.  A null url has empty
    host and path, no tokens, and is allowed.  Every row of ``pages`` gives one row, repeated and null
    ids too; an id with several labels counts once for each; without labels nothing is mined.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = pages.select("page_id", url_rules.host_of(F.col("url")).alias("host"),
                          url_rules.path_of(F.col("url")).alias("path"), url_rules.url_tokens(F.col("url")).alias("tokens"))
    mined = url_rules.mine_rules(judged.join(labels, "page_id").select("tokens", "bad"))
    hits = url_rules.match_rules(judged, mined)
    rule, verdict = url_rules.apply_rules(F.col("host"), F.col("path"), URL_RULES)
    out = judged.join(hits, "tokens", "left")
    by_method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, by_method).alias("verdict"), "mined_rule", "confidence")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others, by inner product."""
    return ann.neighbours(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, "vec_id", "embedding", 20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mixture takes; see ``mixing``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixing.numbered(docs, keep_text=False)
    placed = mixing.streams(rows)
    return mixing.taken_words(rows, placed, mixing.draw(placed)).select(
        F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again; digests of both."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs).select("doc_id", "ids")
    both = bpe.decode(ids)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 of 100 two-word shingles."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=2, percent=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; the cascade judges what the base rules pass."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = [r for r, _, _ in quality.order_rules(docs, quality.default_rules())]
    judged = quality.cascade(quality.measure(docs).drop("text"), rules)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed.alias("base_failed"),
                         (~base_failed & F.col("rejected_by").isNull()).alias("kept"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards under the law ``rows``; sizes and checksums are taken where the text is read."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = sharding.interleave(docs, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a field fitted on rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    crf = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), crf).select("doc_id", "held_out", "lang_pred", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document; one row in ten by id checksum is held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = lm.score(docs, ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that no earlier 100-byte string covers."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal text that stays: by length, prefix hash, then full hash."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_duplicates(docs, hash_all=True, keep_text=False).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt on the first turns of every hundredth one."""
    turns = trie.positions(read_table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.on_shared_heads(turns, every=100, longest=5))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, after the contract's planting of repeats."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.periodic_runs(docs, plant=True)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_ann, op3_mixing, op4_bpe, op5_minhash, op6_quality, op7_sharding, op8_language_id,
                                        op9_lm_score, op10_suffix_dedup, op11_exact_dedup, op12_prefix_trie, op13_periodic_runs)}
