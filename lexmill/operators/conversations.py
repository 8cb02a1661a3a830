"""Conversations as two tables: listing, history windows, regeneration, costs, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip


def conversation_list(messages: DataFrame) -> DataFrame:
    """conv_id, n_messages, last_turn, preview (the first user message, 120 characters), position: latest first."""
    text = strip(F.coalesce("first_text", F.lit("")))
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
    stats = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    preview = F.concat(F.substring(text, 1, 120), F.when(F.length(text) > 120, "…").otherwise(""))
    return stats.join(first, "conv_id", "left").select("conv_id", "n_messages", "last_turn", preview.alias("preview")).orderBy(F.desc("last_turn"), "conv_id")


def history(messages: DataFrame) -> DataFrame:
    """Turns that go into a prompt: the last 8 and a summary of the others beyond 12 turns, else the last 20. kind: verbatim or summarised."""
    rows = messages.filter("role IN ('user', 'assistant') AND text IS NOT NULL AND text != ''")
    w = Window.partitionBy("conv_id")
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("turn"))))
    long = F.col("n") > 12
    kind = F.when(long & (F.col("back") > 8), "summarised").when(long | (F.col("back") <= 20), "verbatim")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("conv_id", "turn", "role", "kind", "back")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation: 6 for rewriting a query, 40 for a chat about one document."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).filter(F.col("back") <= n)


def without_open_question(messages: DataFrame) -> DataFrame:
    """History as regeneration sends it: a user turn that is the last goes, as it is the question asked again."""
    last = messages.groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("l")).filter("l.role = 'user'").select("conv_id", "l.turn")
    return messages.join(last, ["conv_id", "turn"], "left_anti")


def without_last_answer(messages: DataFrame) -> DataFrame:
    """Messages as regeneration finds them: the last assistant turn is gone."""
    last = messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return messages.join(last, ["conv_id", "turn"], "left_anti")


def token_cost(messages: DataFrame) -> DataFrame:
    """Tokens (a third of the characters, rounded up) in and out, and their price."""
    t = F.ceil(F.length("text") / 3)
    user = F.col("role") == "user"
    sums = messages.groupBy("conv_id").agg(F.sum(F.when(user, t).otherwise(0)).alias("tokens_in"), F.sum(F.when(user, 0).otherwise(t)).alias("tokens_out"))
    cost = F.round((F.col("tokens_in") * 0.15 + F.col("tokens_out") * 0.60) / 1e6, 8)
    return sums.withColumn("cost", cost).withColumn("label", F.when(cost < 0.001, "<$0.001").otherwise(F.concat(F.lit("~$"), F.regexp_replace(F.format_number(cost, 3), ",", ""))))


def title_filter(conversations: DataFrame, query: str, default: str = "New conversation") -> DataFrame:
    if not query.strip():
        return conversations
    return conversations.filter(F.contains(F.lower(F.coalesce("title", F.lit(default))), F.lit(query.strip().lower())))


def fallback_query(messages: DataFrame) -> DataFrame:
    """For each user turn: the user turn before and the message, the query where none is written by a model."""
    users = messages.filter("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return users.select("conv_id", "turn", F.trim(F.concat_ws(" ", before, "text")).alias("query"))


def markdown(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One markdown text for each conversation: its title (conv_id, title), then a head and the text of each message (conv_id, turn, role, text, sources: array of (doc_id, title)),
    numbered sources below an answer, and a rule."""
    if "sources" not in messages.columns:
        messages = messages.withColumn("sources", F.lit(None).cast("array<struct<doc_id: string, title: string>>"))
    rows = F.transform("sources", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(x["title"], F.lit("")), x["doc_id"]), F.lit(" — `"), x["doc_id"], F.lit("`")))
    listed = F.when((F.col("role") == "assistant") & (F.size("sources") > 0), F.concat(F.array(F.lit("**المصادر:**"), F.lit("")), rows, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    head = F.when(F.col("role") == "user", "### 🧑 المستخدم").otherwise("### 🤖 المساعد")
    block = F.array_join(F.concat(F.array(head, F.lit(""), strip("text"), F.lit("")), listed, F.array(F.lit("---"), F.lit(""))), "\n")
    parts = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("x"))
    parts = parts.withColumn("title", F.lit(None).cast("string")) if titles is None else parts.join(titles.select("conv_id", "title"), "conv_id", "left")
    name = F.coalesce(F.nullif("title", F.lit("")), F.lit("محادثة"))
    return parts.select("conv_id", F.concat(F.lit("# "), name, F.lit("\n\n"), F.array_join(F.transform("x", lambda b: b["block"]), "\n")).alias("markdown"))


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``gone``."""
    return conversations.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")
