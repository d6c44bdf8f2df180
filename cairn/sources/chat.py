"""Chat messages to raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = r"(?i)^\s*\[(slack|instagram|discord)\]\s*"


def from_messages(messages: DataFrame) -> DataFrame:
    """Events of messages (id, guild_id, channel_id, content, created_at, author, attachments, snapshots).

    A forwarded snapshot's content and attachments win over the message's. The source is the prefix in brackets, else
    discord for forwarded messages, else what the addresses in the content tell. Messages outside a guild are left out.
    """
    forwarded = F.coalesce(F.size("snapshots"), F.lit(0)) > 0
    snapshot = F.get("snapshots", F.lit(0))
    raw = F.coalesce(F.when(forwarded, F.coalesce(snapshot["content"], F.lit(""))), F.col("content"), F.lit(""))
    content = F.trim(F.regexp_replace(raw, r"(?i)^\[(?:slack|instagram|discord)\]\s*", ""))
    named = F.nullif(F.lower(F.regexp_extract(F.coalesce("content", F.lit("")), PREFIX, 1)), F.lit(""))
    linked = F.when(F.regexp_like(content, F.lit(r"(?i)https?://(?:www\.)?slack\.com/")), "slack").when(F.regexp_like(content, F.lit(r"(?i)https?://(?:www\.)?instagram\.com/")), "instagram").otherwise("discord")
    kind = F.coalesce(named, F.when(forwarded, "discord"), linked)
    files = F.when(forwarded, snapshot["attachments"]).otherwise(F.col("attachments"))
    typed = F.transform(files, lambda a: F.struct(F.when(F.startswith(a["content_type"], F.lit("image/")), "image").otherwise("file").alias("type"), a["url"].alias("url"), a["content_type"].alias("content_type"), a["name"].alias("filename")))
    own = F.col("kind") == "discord"
    marked = messages.filter(F.col("guild_id").isNotNull()).withColumns({"kind": kind, "__content": content, "__files": typed, "__forwarded": forwarded})
    seconds = F.concat(F.unix_timestamp("created_at").cast("string"), F.lit(".000000"))
    discord = F.when(own, F.struct("guild_id", "channel_id", F.col("id").alias("message_id"), F.col("__forwarded").alias("forwarded")))
    slack = F.when(F.col("kind") == "slack", F.struct(F.lit("discord-intake").alias("workspace"), "channel_id", seconds.alias("message_ts"), F.lit(None).cast("string").alias("thread_ts")))
    instagram = F.when(F.col("kind") == "instagram", F.struct(F.lit("discord-intake").alias("username"), F.col("id").alias("media_id"), F.lit("post").alias("media_type"), F.lit(None).cast("string").alias("shortcode")))
    return marked.select(
        F.lit(1).alias("schema_version"), F.concat(F.col("kind"), F.lit("_manual")).alias("source"), F.when(own, F.col("guild_id")).otherwise("discord-intake").alias("source_account"), F.col("id").alias("source_event_id"),
        F.when(own, F.concat_ws("/", F.lit("https://discord.com/channels"), "guild_id", "channel_id", "id")).alias("source_url"), F.col("created_at").alias("occurred_at"), F.col("author").alias("author_display"),
        F.nullif("__content", F.lit("")).alias("text"), F.coalesce("__files", F.array().cast("array<struct<type:string,url:string,content_type:string,filename:string>>")).alias("attachments"), F.struct(discord.alias("discord"), slack.alias("slack"), instagram.alias("instagram")).alias("metadata"),
    )
