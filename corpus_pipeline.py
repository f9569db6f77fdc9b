"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

The operators are those of ``logevidence.llm``. Every stage works on all rows that its predecessor kept; all but the last
return the columns of documents, with a null id kept as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logevidence.llm.common import Scratch, table, unpacked, whole_row
from logevidence.llm.decontaminate import contamination, verdicts
from logevidence.llm.jaccard import linked_documents
from logevidence.llm.langid import identify_languages
from logevidence.llm.packing import pack_documents
from logevidence.llm.privacy import private_spans, sanitised

#: The near-duplicate stage's shingle length and the percentage of the union that links.
SHINGLE, PERCENT = 5, 80
#: Lists of rows up to this length are sent to the tasks that read documents; longer ones are joined by a shuffle.
MOST_SENT = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: null texts and those without a letter, and no others.

    Where no language is known (``lang`` is null in all rows), every text with a letter stays.
    """
    found = identify_languages(docs, docs.select("lang", "text"), carry=True)
    kept = found.where((F.col("lang_pred") != "und") | F.col("row").getField("text").rlike(r"\p{L}"))
    return unpacked(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked documents, that with the smallest id (without an id: last).

    Every row stands for itself, whatever its id: rows that share an id, or have none, are linked by their texts alone. Rows
    with equal id and text are copies, of which one stays. Rows are told apart by a 64-bit hash of id and text.
    """
    scratch = Scratch(spark)
    id_, text = docs["doc_id"].cast("long"), docs["text"]
    keyed = docs.select(F.xxhash64(id_.isNull(), id_, text.isNull(), text).alias("key"), id_.alias("id"), text, whole_row(docs))
    linked = scratch.write(linked_documents(keyed.select(F.col("key").alias("doc_id"), "text"), SHINGLE, PERCENT))
    groups = linked.select(F.col("doc_id").alias("key"), "component_id")
    # only groups of several rows can lose one
    several = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    member = scratch.write(groups.join(several, "component_id"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    least = (
        keyed.select("key", "id").join(member.select("key", "component_id").distinct(), "key")
        .groupBy("component_id").agg(F.min(place).alias("first")).select("component_id", F.col("first.key").alias("kept"))
    )
    placed = member.join(least, "component_id")
    leaves = scratch.write(placed.where("key <> kept").select("key").distinct())
    copies = scratch.write(placed.where("key = kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    sent = lambda keys: F.broadcast(keys) if keys.count() <= MOST_SENT else keys
    rows = keyed.select("key", "row")
    alone = rows.join(sent(leaves.unionByName(copies)), "key", "left_anti")
    chosen = rows.join(sent(copies), "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return unpacked(alone.select("row").unionByName(chosen.select("row")), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth of the words, at least, stand in the benchmark."""
    found = verdicts(contamination(docs, table(spark, sf_dir, "benchmark"), carry=True))
    return unpacked(found.where("NOT contaminated"), docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by placeholders and takes out the terms that give it away; ``n_chars`` follows the text."""
    clean = sanitised(docs, private_spans(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    path = public_tokenizers.path
    return pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", privacy),
    ("packing", packing),
]

#: SQL cannot express the language mixtures, nor the tokenizer; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
