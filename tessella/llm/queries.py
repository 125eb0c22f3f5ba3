"""The thin queries over the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.base import read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document, by ``bpe.encode`` and ``bpe.decode``."""
    from tessella.llm import bpe

    path = vocabulary()
    both = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by ``packing.pack``."""
    from tessella.llm import packing

    pieces = packing.pack(read(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, sample key and verdict of every document, by ``importance.resample``."""
    from tessella.llm import importance

    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by ``rules.assess``."""
    from tessella.llm import rules

    return rules.assess(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every text as a clip, by ``audio.features``; bytes 0 fill up to a positive multiple of 64."""
    from tessella.llm import audio

    body = F.coalesce("text", F.lit("")).cast("binary")
    short = F.when(F.length(body) == 0, 64).otherwise(F.pmod(-F.length(body), F.lit(64))).cast("int")
    clips = read(spark, sf_dir, "documents").select("doc_id", F.concat(body, F.repeat(F.lit("\0"), short).cast("binary")).alias("payload"), F.length(body).cast("long").alias("n_bytes"))
    out = audio.features(clips, keep=("n_bytes",))
    back = F.expr(f"substring(media, {audio.HEADER + 1}, length(media) - {audio.HEADER})")
    rounded = F.array_join(F.transform("mel_mean", lambda x: F.format_string("%.2f", x)), ",")
    return out.select(
        "doc_id", "n_bytes",
        F.length(back).cast("long").alias("payload_bytes"),
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, length(media) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.col("frames").cast("string"), F.size("spans").cast("string"), rounded).alias("feature"),
        F.length("tensors").cast("long").alias("tensor_bytes"),
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, by ``jaccard.classes``."""
    from tessella.llm import jaccard

    return jaccard.classes(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, by ``lines.dedup`` with ``source`` as host."""
    from tessella.llm import lines

    return lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "text", "n_lines", "n_dropped")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the list entry in force, by ``urls.evaluate``; captures and list follow from the pages."""
    from tessella.llm import urls

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.evaluate(urls.demo_captures(pages), urls.demo_list(pages))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity

    """Scores of all documents; rows without an id are not held out."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with its full response, by ``warc.resolve``; captures follow from the pages."""
    from tessella.llm import warc

    done = warc.resolve(warc.demo_captures(read(spark, sf_dir, "pages").select("page_id", "url")))
    listed = F.array_sort(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])))
    return done.withColumn("headers", F.concat(F.array_join(listed, ";"), F.lit(";")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return {k: found[k] for k in sorted(found, key=lambda k: int(k[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    from tessella.llm import lines, urls, warc

    return {"op6_line_dedup": lines.ORACLE_SQL, "op8_url_filters": urls.ORACLE_SQL, "op10_warc_revisits": warc.ORACLE_SQL}
