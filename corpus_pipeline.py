"""The corpus pipeline over ``documents``, as written and reread stages.

Quality rules drop what repeats itself, near-duplicates keep one document of a
group, repeated passages are cut out, sources are mixed to their targets, and
the texts that the mix takes are encoded. Each stage takes (spark, docs, sf_dir)
and returns a DataFrame; all but the last return the columns of documents.
Documents may hold nulls, repeated rows and further columns; what an operator
decides is joined back under names that no column of documents has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm import bpe, mixing, neardup, quality, repeats
from gneiss.llm.common import drop_since, materialize, scratch, table

#: Shortest repeated string that is cut out, in bytes: less than 50 words take.
REPEAT_BYTES = 200


def _own(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the repetition rules keep."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, once.

    Documents are linked at a similarity of 0.8 on five-word shingles. Repeated
    rows of a document become one. Rows without doc_id, or with one that other
    texts have too, or that is no integer, form groups by text like all others.
    """
    unclear = not isinstance(docs.schema["doc_id"].dataType, T.IntegralType) or docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if unclear:
        return _near_duplicates_by_row(docs)
    kept = neardup.near_duplicates(docs, size=5, percent=80).where("kept")
    key = _own(docs, "kept_id")
    kept = kept.select(F.col("doc_id").alias(key))
    return docs.join(kept, F.col("doc_id").cast("long") == F.col(key), "left_semi").select(docs.columns)


def _near_duplicates_by_row(docs: DataFrame) -> DataFrame:
    """The same where doc_id does not name one text: by a key of id and text."""
    key = _own(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), size=5, percent=80)
    found = found.select(F.col("doc_id").alias("k"), F.coalesce("component_id", "doc_id").alias("component")).distinct()
    named = found.join(keyed.select(F.col(key).alias("k"), "doc_id").distinct(), "k")
    # The smallest id of a group stays; a row without id only where no other is there.
    kept = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("first"))
    kept = kept.select(F.col("first.k").alias(_own(keyed, "kept_key")))
    out = keyed.join(kept, F.col(key) == F.col(kept.columns[0]), "left_semi")
    return out.dropDuplicates([key]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that start anywhere else too.

    Bytes of a character that a cut splits go with the cut. n_chars, where it
    is, follows the text. Texts that nothing is cut from stay as they are.
    """
    found = repeats.remove_repeats(docs, REPEAT_BYTES, with_text=True).where("n_removed > 0")
    kept = _own(docs, "repeat_text")
    keys = [_own(docs, f"repeat_{c}") for c in repeats.TEXT]
    found = found.select(*[F.col(c).alias(k) for c, k in zip(repeats.TEXT, keys)], F.col("kept").alias(kept)).dropDuplicates(keys)
    own = repeats.fingerprint(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = docs.withColumns(dict(zip(keys, own))).join(found, keys, "left")
    text = F.coalesce(F.col(kept), F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            count = F.when(F.col(kept).isNotNull(), F.char_length(kept)).otherwise(F.col(c))
            columns.append(count.cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass over them.

    Documents without a word weigh nothing in the mix and stay as they are.
    """
    taken = mixing.mix(docs)
    key, times = _own(docs, "mix_id"), _own(docs, "mix_times")
    passes = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    taken = taken.groupBy(F.col("id").alias(key)).agg(F.max(passes).alias(times)).where(F.col(times) > 0)
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of their decoded bytes."""
    import public_tokenizers

    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
#: SQL can't express the stages' methods; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, there = table(spark, sf_dir, "documents"), scratch()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
            drop_since(there, docs)
    return docs
