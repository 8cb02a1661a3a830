"""The store of conversations as two tables, conversations (conv_id, title, created_at, updated_at) and messages (msg_id, conv_id, role, text, sources_json, meta_json,
created_at): each change is a function from the tables to new ones, which the caller writes as a new version. Times and ids are parameters, so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.chat import json_or_null

MESSAGE = "msg_id string, conv_id string, role string, text string, sources_json string, meta_json string, created_at timestamp"


def new_id(*parts: Column | str) -> Column:
    """A hex id of 32 characters that the parts decide."""
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def created(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """With new conversations (conv_id, title, at)."""
    return conversations.unionByName(new.select("conv_id", "title", F.col("at").alias("created_at"), F.col("at").alias("updated_at")))


def _touched(conversations: DataFrame, at: DataFrame) -> DataFrame:
    """With updated_at of conversations (conv_id, at) no earlier than that; others stay."""
    latest = at.groupBy("conv_id").agg(F.max("at").alias("at"))
    return conversations.join(latest, "conv_id", "left").withColumn("updated_at", F.coalesce("at", "updated_at")).select(*conversations.columns)


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With new messages (msg_id, conv_id, role, text, sources: array, meta: map, at), which bump their conversations."""
    rows = new.select("msg_id", "conv_id", "role", "text", json_or_null(F.col("sources")).alias("sources_json"), json_or_null(F.col("meta")).alias("meta_json"), F.col("at").alias("created_at"))
    return _touched(conversations, new.select("conv_id", "at")), messages.unionByName(rows)


def renamed(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """With the last of each conversation's changes (conv_id, title, at)."""
    last = changes.groupBy("conv_id").agg(F.max_by("title", "at").alias("new_title"), F.max("at").alias("at"))
    rows = conversations.join(last, "conv_id", "left")
    return rows.withColumn("title", F.coalesce("new_title", "title")).withColumn("updated_at", F.coalesce("at", "updated_at")).select(*conversations.columns)


def deleted(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without conversations (conv_id) and their messages."""
    return conversations.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def listed(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, title, updated_at, preview of the first user message, position: latest first."""
    text = F.trim(F.coalesce("first_text", F.lit("")))
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "created_at").alias("first_text"))
    rows = conversations.join(first, "conv_id", "left").withColumn("preview", F.concat(F.substring(text, 1, 120), F.when(F.length(text) > 120, "…").otherwise("")))
    return rows.select("conv_id", "title", "updated_at", "preview").orderBy(F.desc("updated_at"), "conv_id")


def opened(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Conversations (conv_id) with their messages in order; unknown ids have no row."""
    rows = messages.join(ids, "conv_id", "left_semi").withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at", "msg_id")))
    return conversations.join(ids, "conv_id", "left_semi").select("conv_id", "title").join(rows, "conv_id", "left")


def without_last_answer(messages: DataFrame) -> DataFrame:
    """As before the last assistant message of each conversation, which regeneration replaces."""
    last = messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("created_at", "msg_id")).alias("l")).select("l.msg_id")
    return messages.join(last, "msg_id", "left_anti")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all versions of the table's schema: columns that older files lack are null."""
    return spark.read.schema(MESSAGE).parquet(path)
