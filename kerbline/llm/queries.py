"""The queries of this subpackage, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.llm import bpe, line_dedup, media, merkle, minhash, mixing, pii, quality_classifier, quality_rules, rank_bpe, sql, suffix_dedup, token_files, vector_codes
from kerbline.llm.arrow import bound_batches
from kerbline.plans.scratch import Scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), Scratch(spark, "minhash"), k=4)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file under some declared type, then sniffed, carved and described from what was stored.

    The declared types are right, wrong, vague or missing, by the text's hash; the
    payload read back is sniffed once more for media embedded in the text.
    """
    bound_batches(spark)
    declared = F.array(F.lit("audio/wav"), F.lit("image/png"), F.lit("application/octet-stream"), F.lit(None))
    docs = _documents(spark, sf_dir).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        media.to_wav(media.pad_payload("text")).alias("media"),
        declared[F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(4)).cast("int")].alias("declared_type"),
    )
    stored = Scratch(spark, "media").write(docs, "wav")
    body = media.body_of_first()
    read = media.sniff(media.sniff(stored).withColumn("body", body), "body", out="inner")
    item = lambda i: F.concat_ws(":", i["type"], i["start"], i["length"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha2("body", 256).alias("payload_sha256"),
        F.crc32(F.substring("body", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "sniffed.type", media.sample_features("body")).alias("feature"),
        "sniffed.corrected",
        F.array_join(F.transform("inner.items", item), ",").alias("embedded"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir), Scratch(spark, "mixing"))
    return mixed.select("doc_id", "source", "lang", "mix.*")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(_documents(spark, sf_dir), Scratch(spark, "suffix-dedup"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "quality"))
    return quality_classifier.score(docs, model).select("doc_id", "quality.*")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    path = tokenizer_file()
    coded = _documents(spark, sf_dir).select("doc_id", bpe.encode(path)(F.col("text")).alias("ids"))
    return coded.select(
        "doc_id",
        bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(path)(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    chunks = token_files.write_ids(_documents(spark, sf_dir), tokenizer_file(), scratch)
    return token_files.with_starts(token_files.read_ids(chunks), chunks).select("doc_id", "start", F.col("doc_ids").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "line-dedup"), whole=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(of(k.name) for k in pii.BASE),
        F.sha2(pii.listed(F.filter("spans", lambda s: s["rank"] < len(pii.BASE))), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.compression_bands(docs).select(
        "doc_id",
        *(F.col(f"rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "rules.base_failed",
        "rules.kept",
        "rules.reason",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.code_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "vector-codes"))
    books = coded.books.digest() if coded.books else None
    return vector_codes.with_label_error(coded.rows).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books).cast("string").alias("codebooks_sha256")
    )


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, scratch = _documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "rank-bpe")
    with rank_bpe.literals(rank_bpe.write_ranks(spark, tokenizer_file("byte_bpe_50k.tiktoken"), scratch)) as tables:
        codec = rank_bpe.RankCodec(tables, public_tokenizers.PATTERN)
        with rank_bpe.literals(rank_bpe.common_words(docs, codec, scratch)) as known:
            coded = docs.select("doc_id", codec.encode(F.col("text"), known["common"]).alias("ids"))
        return coded.select(
            "doc_id",
            F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(codec.pack(F.col("ids")), 256).alias("ids_sha256"),
            F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"),
        )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, held against copies of which some have one character more."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = merkle.leaf_digest(*(F.col(c) + F.when(changed, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in fields))
    found = merkle.manifest(_documents(spark, sf_dir).select(*fields), "lang", "doc_id", fields, Scratch(spark, "merkle"), {"claim": claim})
    found = found.withColumn("again", merkle.folded(F.col("claim"), F.col("path")))
    return found.select(
        F.col("key").alias("doc_id"),
        *(merkle.text_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        merkle.text_of(merkle.proof_digest(F.col("path"))).alias("proof_sha256"),
        merkle.text_of(F.col("again")).alias("folded_root"),
        (F.col("again") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_media_columns": op2_media_columns,
        "op3_mixing": op3_mixing,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_bpe": op6_bpe,
        "op7_token_files": op7_token_files,
        "op8_line_dedup": op8_line_dedup,
        "op9_pii": op9_pii,
        "op10_quality_rules": op10_quality_rules,
        "op11_vector_codes": op11_vector_codes,
        "op12_rank_bpe": op12_rank_bpe,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": sql.VECTOR_CODES, "op13_merkle": sql.MERKLE}
