"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import ann, bpe, centroids, decontamination, exact_dedup, language_id, oracles, pii, resampling, simhash, substring_dedup, token_files, tool_calls, vector_codes
from tesserae.session import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of the documents that language models do not learn from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


#: Tools of op1's conversations: each assistant turn is a call of one of them.
TOOLS = {
    "answer": {"type": "object", "required": ["length", "text"], "properties": {"length": {"type": "integer"}, "text": {"type": "string"}}, "additionalProperties": False},
    "lookup": {"type": "object", "required": ["terms"], "properties": {"terms": {"type": "array", "items": {"type": "string"}}}},
}


def _with_calls(turns: DataFrame) -> DataFrame:
    """Conversations as tool messages: an assistant turn calls a tool, after the call before it; a user turn that is not the first is the result of the turn before it.

    By a hash of the text, some calls break their schema, call a tool that is not there, wait for the call after them (a
    cycle), or repeat the id of the call before.
    """
    pick = F.pmod(F.xxhash64("text"), F.lit(40))
    turn = F.when(pick == 3, F.col("turn") - 2).otherwise(F.col("turn"))
    answers = F.col("turn") % 4 == 1
    length = F.when(pick == 0, F.length("text").cast("string"))  # a string where the schema asks for a number
    arguments = F.when(answers & length.isNotNull(), F.to_json(F.struct(length.alias("length"), "text"))).when(answers, F.to_json(F.struct(F.length("text").alias("length"), "text"))).otherwise(F.to_json(F.struct(F.split("text", " ").alias("terms"))))
    name = F.when(pick == 1, "nobody").when(answers, "answer").otherwise("lookup")
    after = F.concat(F.lit('["c'), F.col("turn") - 2, F.when(pick == 2, F.concat(F.lit('","c'), F.col("turn") + 2)).otherwise(""), F.lit('"]'))
    call = F.concat(F.lit('{"call":{"id":"c'), turn, F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit(',"after":'), after, F.lit("}}"))
    result = F.concat(F.lit('{"result":{"id":"c'), F.col("turn") - 1, F.lit('","content":'), F.get_json_object(F.to_json(F.struct(F.struct("text").alias("x"))), "$.x"), F.lit("}}"))
    text = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (F.col("turn") > 0), result).otherwise(F.col("text"))
    role = F.when((F.col("role") == "user") & (F.col("turn") > 0), "tool").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(_with_calls(_table(spark, sf_dir, "conversations")), TOOLS)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    found = language_id.identify(docs, model, F.struct("doc_id", "text"))
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out())


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    # Labels grow with the documents: a merge join at every size, never one that depends on the labels being few.
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    return resampling.resample(docs)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"), F.struct("doc_id"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS[: pii.BASE]))
    counts = [_count_of(k).alias(f"n_{k}") for k in pii.KINDS[: pii.BASE]]
    return found.select("row.doc_id", *counts, F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.encode(vectors, books, F.struct("vec_id", "label"))
    coded = materialise(coded.select("row.vec_id", "row.label", vector_codes.code_text(F.col("codes")).alias("code"), "error"), "codes")
    summed = vector_codes.with_label_errors(coded)
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"), F.struct("vec_id"))
    return found.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    found = exact_dedup.find(_table(spark, sf_dir, "documents"), F.struct("doc_id", digest))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "row.text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_tool_calls, op2_language_id, op3_importance_resampling, op4_substring_dedup, op5_nearest_vectors, op6_token_files, op7_bpe, op8_simhash_near_dedup, op9_pii, op10_decontamination, op11_vector_codes, op12_centroids, op13_exact_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
