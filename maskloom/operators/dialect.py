"""The two chat formats: reasons, and conversations built as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Reasons for the end of an answer in the two formats.
FINISH_TO_STOP = {"length": "max_tokens", "tool_calls": "tool_use", "function_call": "tool_use", "content_filter": "refusal"}
STOP_TO_FINISH = {"max_tokens": "length", "tool_use": "tool_calls", "refusal": "content_filter"}


def stop_reason(finish: Column) -> Column:
    out = F.lit("end_turn")
    for k, v in FINISH_TO_STOP.items():
        out = F.when(finish == k, v).otherwise(out)
    return out


def finish_reason(stop: Column) -> Column:
    out = F.lit("stop")
    for k, v in STOP_TO_FINISH.items():
        out = F.when(stop == k, v).otherwise(out)
    return out


def mapped_model(model: Column, models: Column) -> Column:
    return F.coalesce(F.element_at(models, model), model)


def direction(source: Column, target: Column) -> Column:
    """same, a_to_o or o_to_a; an error for formats that can't be translated."""
    pair = F.concat(source, F.lit(">"), target)
    return F.when(source == target, "same").when(pair == "anthropic>openai", "a_to_o").when(pair == "openai>anthropic", "o_to_a").otherwise(F.raise_error(F.concat(F.lit("no translation "), pair)))


def to_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, system, messages array<struct<role, content>>) of turns(key, turn, role, text): system turns are
    joined by line ends in front, consecutive turns of tools become one turn of the user, developer is system."""
    rows = turns.withColumn("role", F.when(F.col("role") == "developer", "system").otherwise(F.col("role")))
    system = rows.filter("role = 'system'").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("system"))
    said = rows.filter("role <> 'system'")
    order = W.partitionBy(key).orderBy("turn")
    said = said.withColumn("new", F.coalesce(((F.col("role") != "tool") | (F.lag("role").over(order) != "tool")).cast("int"), F.lit(1)))
    said = said.withColumn("part", F.sum("new").over(order))
    merged = said.groupBy(key, "part").agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    merged = merged.withColumn("role", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")))
    listed = merged.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    return listed.join(system, key, "full").select(key, "system", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")).alias("messages"))


def to_completions(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): the system text as the first message, then the turns in order."""
    rows = to_messages(turns, key)
    first = F.when(F.col("system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return rows.select(key, F.concat(first, "messages").alias("messages"))


def request_json(rows: DataFrame, model: Column, max_tokens: int | None = None) -> DataFrame:
    """rows of to_messages() or to_completions() with body, the request as JSON."""
    fields = [model.alias("model"), *([F.lit(max_tokens).alias("max_tokens")] if max_tokens else []), *([F.col("system")] if "system" in rows.columns else []), F.col("messages")]
    return rows.withColumn("body", F.to_json(F.struct(*fields)))
