"""Queries p6 to p8 over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspring.llm import packing, subjects, tokens
from tallyspring.session import materialize, table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k")


def _pack(budget: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        docs = table(spark, folder, "documents")
        name, capacity = table(spark, folder, "token_budgets").where(F.col("budget_name") == budget).select("tokenizer", "capacity_tokens").first()
        sized = tokens.encode_texts(docs, "doc_id", "text", name, count=True)
        return packing.fill_containers(sized, "doc_id", "tokens", capacity, docs.count()).withColumnRenamed("size", "tokens").withColumn("budget_name", F.lit(budget))

    return query


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document and budget: whether it is in one container (or in as few as its size needs), with all its tokens, and in none that is over its capacity."""
    docs, out, sizes = table(spark, folder, "documents"), [], {}
    number = docs.count()
    # the budgets are a fixed small table
    for budget, name, capacity in table(spark, folder, "token_budgets").select("budget_name", "tokenizer", "capacity_tokens").orderBy("budget_name").collect():
        if name not in sizes:
            sizes[name] = materialize(tokens.encode_texts(docs, "doc_id", "text", name, count=True), "sizes")
        packed = materialize(packing.fill_containers(sizes[name], "doc_id", "tokens", capacity, number), "packed")
        load = packed.groupBy("container").agg(F.sum("size").alias("load"))
        held = packed.join(load, "container").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("kept"), F.max("load").alias("load"))
        checked = sizes[name].join(held, "doc_id", "left").select(
            F.lit(budget).alias("budget_name"), "doc_id", F.coalesce(F.col("n") == F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)), F.lit(False)).alias("kept_whole"),
            F.coalesce(F.col("kept") == F.col("tokens"), F.lit(False)).alias("tokens_kept"), F.coalesce(F.col("load") <= capacity, F.lit(False)).alias("fits"),
        )
        out.append(checked)
    return reduce(lambda a, b: a.unionByName(b), out)


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    # the list of subjects is a fixed small table
    names = sorted(r[0] for r in table(spark, folder, "subjects").select("subject").collect() if r[0])
    return subjects.assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), names)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder)


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents are about each subject."""
    return _subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_ids": p6_ids,
    "p7_pack_middle": _pack("middle"),
    "p7_pack_short": _pack("short"),
    "p7_pack_long": _pack("long"),
    "p7_pack_piece_middle": _pack("piece_middle"),
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

SQL: dict[str, str] = {
    # what packing must keep to, whatever the tokens are
    "p7_checked": "SELECT budget_name, doc_id, true AS kept_whole, true AS tokens_kept, true AS fits FROM documents, token_budgets",
}
