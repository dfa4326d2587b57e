"""Registered queries ``opN_<name>`` over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm import chat, decontamination, fill_in_middle, fingerprints, licenses, merkle, packing, sharding, simhash_gray, suffix_dedup, token_counts, toxicity, url_templates
from tillmark.llm.common import join_heavy, written
from tillmark.llm.oracle import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(name: str):
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every restored text, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    chars, model = toxicity.train(docs, labels)
    out = toxicity.score(docs, chars, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op2_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, and the components of links within three bits."""
    out = simhash_gray.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes; law ``bytes``."""
    out = sharding.shard_rows(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that lines, blocks or whole texts of ``documents`` match at Dice 0.8 or more."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in whole documents."""
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted into windows and read back from them."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], table.schema)
    c = chat.read_back(chat.windows(table.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of whole documents under a 50-byte string that a document with a smaller id has too."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by its template."""
    return url_templates.judge_urls(_table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as byte tokens and an end mark, packed into sequences of four lengths."""
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return packing.pack(_table(spark, sf_dir, "documents"), length)


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and their edits; ``n_near`` counts other fingerprints within three bits."""
    rows, _ = written(fingerprints.edited_likeness(_table(spark, sf_dir, "documents")), "edited")
    counts, _ = written(rows.groupBy("fp").agg(F.count("*").alias("n")), "fingerprint-counts")
    near, _ = written(counts.join(fingerprints.near_counts(counts.select("fp")), "fp", "left"), "near-counts")
    out = join_heavy(rows, near, "fp", "n")
    return out.select("doc_id", "n_chars", "edited_sha256", _hex("fp").alias("fingerprint"), _hex("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("n_near", F.lit(0)).alias("n_near"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, subroots and proofs of all documents by source, audited where line ends were deleted from every other one."""
    deleted = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs, _, _ = merkle.manifest(_table(spark, sf_dir, "documents"), tampered=("text", deleted))
    return merkle.audited(proofs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents by a public byte-level BPE; over the limit are those of more than 1024."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut at line ends and rearranged, and the texts read back from that."""
    out = fill_in_middle.rearrange(_table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES = (
    op1_noisy_channel_toxicity, op2_gray_simhash, op3_minimax_shards, op4_license_scan, op5_fm_decontaminate, op6_chat_windows, op7_induced_suffix_dedup, op8_url_templates,
    op9_best_fit_packing, op10_simhash_blocks, op11_merkle_manifest, op12_token_counts, op13_fill_in_middle,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are held against plain versions in the tests."""
    return dict(ORACLE)
