"""The outbox: what is due, rendered messages, outcomes, retries; and the life of events in the queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

# Limits and delays.
EVENT_ATTEMPTS, DELIVERY_ATTEMPTS = 5, 10
RETRY_SECONDS, RETRY_HORIZON = (30, 120, 600, 3600, 21600), 86400
COLORS = {"feed": 0x2F6FED, "review": 0xC9933C, "alert": 0xB42318}
OUTBOX_KEY = ["opportunity_id", "destination_type", "destination_key"]


# --- due work (P9, P10, T1, T2) ---


def due(queue: DataFrame, now: Column, waiting: tuple[str, ...], working: str, attempts: int) -> DataFrame:
    ready = F.col("status").isin(*waiting) & (F.col("next_attempt_at") <= now)
    expired = (F.col("status") == working) & (F.col("lease_expires_at") <= now)
    return queue.filter((F.col("attempt_count") < attempts) & (ready | expired))


def due_events(queue: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    """The oldest events that are due; the limit is the batch size."""
    return due(queue, now, ("pending", "failed"), "processing", EVENT_ATTEMPTS).orderBy("created_at", "id").limit(max(1, min(limit, 100)))


def due_deliveries(outbox: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    return due(outbox, now, ("pending", "retry"), "delivering", DELIVERY_ATTEMPTS).orderBy("created_at", "id").limit(max(1, min(limit, 50)))


# --- delays and transitions (F30, R4, R5) ---


def event_backoff(attempt: Column) -> Column:
    """Seconds before the next try after a failed attempt."""
    return F.least(F.lit(3600), (F.lit(30) * F.pow(F.lit(2), attempt - 1)).cast("long")).cast("long")


def delivery_backoff(attempt: Column, retry_after: Column) -> Column:
    ladder = F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))
    return F.when(retry_after > 0, F.least(F.ceil(retry_after), F.lit(RETRY_HORIZON))).otherwise(ladder).cast("long")


def outcome(status: Column, message_id: Column) -> Column:
    """delivered, rate_limited, retryable or permanent."""
    ok = status.isin(200, 201)
    return F.when(ok & (F.coalesce(message_id, F.lit("")) != ""), "delivered").when(status == 429, "rate_limited").when(status.between(400, 499), "permanent").otherwise("retryable")


def seconds_after(at: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(at) + seconds)


def attempt_log(attempts: DataFrame, now: Column | None, limit: int, *facts: Column) -> DataFrame:
    """id and log: the attempts of each id in the order of their times, the first `limit` of them.

    Each attempt counts one, so no later one can matter. Spark prunes them before the shuffle, so an id with many attempts
    costs little. Attempts without a time, or all without the column, are made `now`; equal rows are one attempt.
    """
    at = F.coalesce(*([F.col("attempted_at")] if "attempted_at" in attempts.columns else []), *([now] if now is not None else []), F.lit(None).cast("timestamp"))
    made = attempts.select("id", at.cast("timestamp").alias("at"), *facts).distinct()
    entry = made.columns[1:]
    first = made.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(*entry))).filter(F.col("__n") <= limit)
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("__log"))


def folded(rows: DataFrame, log: DataFrame, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], done: Callable[[Column], Column]) -> DataFrame:
    """The rows with the columns of `start` as the log leaves them: `step` gives them after an attempt, unless `done`."""
    state = F.struct(*(c.alias(n) for n, c in start.items()))
    take = lambda s, a: F.when(done(s), s).otherwise(F.struct(*(c.alias(n) for n, c in step(s, a).items())))
    joined = rows.join(log, "id", "left")
    entries = F.coalesce("__log", F.array().cast(log.schema["__log"].dataType))
    ended = joined.withColumn("__end", F.aggregate(entries, state, take))
    return ended.select(*(F.col("__end").getField(c).cast(rows.schema[c].dataType).alias(c) if c in start else F.col(c) for c in rows.columns))


def settle_deliveries(outbox: DataFrame, attempts: DataFrame, now: Column | None = None, limit: int = DELIVERY_ATTEMPTS) -> DataFrame:
    """The outbox after the attempts (id, status_code, message_id, retry_after and attempted_at, else all `now`): delivered, retry or dead.

    An id's attempts count one after the other, until one delivers or the row is dead: such a row isn't attempted again.
    Each row stays one row, whatever the log holds; attempts of unknown ids change nothing.
    """
    log = attempt_log(attempts, now, limit, outcome(F.col("status_code"), F.col("message_id")).alias("o"), F.col("message_id").cast("string").alias("message_id"), F.col("retry_after").cast("double").alias("retry_after"))

    def step(s: Column, a: Column) -> dict[str, Column]:
        n = s["attempt_count"] + 1
        status = F.when(a["o"] == "delivered", "delivered").when((a["o"] == "permanent") | (n >= limit), "dead").otherwise("retry")
        asked = F.when(a["o"] == "rate_limited", F.coalesce(a["retry_after"], F.lit(30.0)))
        return {"status": status, "attempt_count": n, "next_attempt_at": F.when(status == "retry", seconds_after(a["at"], delivery_backoff(n, asked))), "external_id": F.when(status == "delivered", a["message_id"]).otherwise(s["external_id"])}

    start = {"status": F.col("status"), "attempt_count": F.col("attempt_count").cast("long"), "next_attempt_at": F.col("next_attempt_at").cast("timestamp"), "external_id": F.col("external_id").cast("string")}
    return folded(outbox, log, start, step, lambda s: s["status"].isin("delivered", "dead"))


def settle_events(queue: DataFrame, results: DataFrame, now: Column | None = None, limit: int = EVENT_ATTEMPTS) -> DataFrame:
    """The event queue after runs (results: id, disposition processed, review, ignored or failed, and attempted_at, else all `now`).

    An id's runs count one after the other, until one settles it or the last attempt has failed.
    """
    log = attempt_log(results.filter("disposition IS NOT NULL"), now, limit, F.col("disposition"))

    def step(s: Column, a: Column) -> dict[str, Column]:
        n, failed = s["attempt_count"] + 1, a["disposition"] == "failed"
        return {"status": a["disposition"], "attempt_count": n, "next_attempt_at": F.when(failed & (n < limit), seconds_after(a["at"], event_backoff(n)))}

    start = {"status": F.col("status"), "attempt_count": F.col("attempt_count").cast("long"), "next_attempt_at": F.col("next_attempt_at").cast("timestamp")}
    return folded(queue, log, start, step, lambda s: s["status"].isin("processed", "review", "ignored") | ((s["status"] == "failed") & (s["attempt_count"] >= limit)))


# --- gates, payloads, routing (P11, P12, P15, P17, P18, S10) ---


def publishable(linked: DataFrame, sources: DataFrame) -> DataFrame:
    """Linked events that make a feed row: new, active, and their source isn't in shadow mode."""
    shadow = sources.select("source_account", F.col("shadow_mode").alias("__shadow")).dropDuplicates(["source_account"])
    return linked.join(shadow, "source_account", "left").filter(F.col("created") & (F.col("status") == "active") & ~F.coalesce("__shadow", F.lit(False))).drop("__shadow")


def payload(review: bool = False) -> Column:
    """The message's fields as JSON, from prepared columns."""
    proofs = F.array_join(F.map_values(F.coalesce("evidence", F.create_map().cast("map<string,string>"))), "\n")
    mode = tx.work_mode("locations", F.concat_ws("\n", F.coalesce("description_excerpt", F.lit("")), proofs))
    fields = [F.col(c) for c in ("company", "role", "locations", "season", "year", "employment_type")]
    fields += [tx.employment_label("employment_type").alias("category_label"), tx.employment_order("employment_type").alias("sort_order"), mode.alias("work_mode")]
    fields += [F.col(c) for c in ("sponsorship_status", "application_url", "posted_at", "description_excerpt", "source_url", "confidence")]
    return F.to_json(F.struct(*fields, *([F.col("reasons").alias("review_reasons")] if review else [])), {"ignoreNullFields": "false"})


def enqueue(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to append: the first of each outbox key that isn't there yet."""
    return rows.dropDuplicates(OUTBOX_KEY).join(outbox.select(*OUTBOX_KEY), OUTBOX_KEY, "left_anti")


def route(outbox: DataFrame, feed: str, review: str) -> DataFrame:
    """The rows with `channel`, or with `dead_reason` where the destination isn't served."""
    kind = F.col("destination_type")
    return outbox.withColumns({"channel": F.when(kind == "discord_review", review).when(kind == "discord_feed", feed), "dead_reason": F.when(kind == "notion", "notion_not_implemented")})


def reaction_target(source: Column, metadata: Column, event_id: Column, default_channel: str | None = None) -> Column:
    """struct(channel_id, message_id) of the chat message that an event came from, or null."""
    number = lambda c: F.coalesce(F.regexp_like(c, F.lit(r"^\d+$")), F.lit(False))
    pair = lambda c, m: F.struct(c.alias("channel_id"), m.alias("message_id"))
    slack, default = metadata["slack"]["channel_id"], F.lit(default_channel).cast("string")
    return (
        F.when(source.isin("discord_manual", "discord_browser"), pair(metadata["discord"]["channel_id"], metadata["discord"]["message_id"]))
        .when((source == "slack_manual") & number(slack) & number(event_id), pair(slack, event_id))
        .when((source == "instagram_manual") & number(default) & number(event_id), pair(default, event_id))
    )


def exact_duplicates(links: DataFrame, events: DataFrame, default_channel: str | None = None) -> DataFrame:
    """X5: raw_event_id, opportunity_id, channel_id, message_id of every event that was linked to a record that is there
    already, where it came from a chat message. links: raw_event_id, opportunity_id, created; events: event_id, source,
    source_event_id, metadata."""
    known = events.select(F.col("event_id").alias("raw_event_id"), reaction_target(F.col("source"), F.col("metadata"), F.col("source_event_id"), default_channel).alias("target"))
    return links.filter("NOT created").join(known.filter(F.col("target").isNotNull()), "raw_event_id").select("raw_event_id", "opportunity_id", "target.channel_id", "target.message_id")


# --- rendering (F33, F34) ---


def escaped(text: Column) -> Column:
    return F.regexp_replace(uncontrolled(text), r"([\\`*_~|:>\[\]()])", r"\\$1")


def uncontrolled(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def truncated(text: Column, length: int) -> Column:
    clean = F.trim(uncontrolled(text))
    return F.when(F.length(clean) <= length, clean).otherwise(F.concat(F.substring(clean, 1, length - 1), F.lit("…")))


def _field(name: str, value: Column, inline: bool = True) -> Column:
    shown = F.struct(F.lit(name).alias("name"), truncated(escaped(value), 1024).alias("value"), F.lit(inline).alias("inline"))
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", shown)


def _message(embed: dict[str, Column], content: str | None = None) -> Column:
    nobody = F.struct(F.array().cast("array<string>").alias("parse")).alias("allowed_mentions")
    parts = [] if content is None else [F.lit(content).alias("content")]
    return F.to_json(F.struct(*parts, F.array(F.struct(*(v.alias(k) for k, v in embed.items()))).alias("embeds"), nobody))


def feed_message() -> Column:
    """The feed's message of a prepared row with opportunity_id, work_mode, deadline and discovered_at."""
    role, company = F.coalesce("role", F.lit("Unknown role")), F.coalesce("company", F.lit("Unknown company"))
    lines = F.array_compact(F.array(escaped(tx.employment_label("employment_type")), tx.season_year("season", "year"), F.when(F.size("locations") > 0, escaped(F.array_join("locations", " · "))), F.nullif(escaped(F.trim("work_mode")), F.lit(""))))
    fields = F.array_compact(F.array(_field("Posted", tx.date_label("posted_at")), _field("Deadline", F.col("deadline")), _field("Sponsorship", tx.sponsorship_label("sponsorship_status")), _field("About", F.substring(tx.one_line("description_excerpt", 100_000), 1, 180), False), _field("Source", F.col("source_url"), False)))
    footer = F.struct(truncated(F.concat(F.lit("Opportunity ID: "), "opportunity_id"), 2048).alias("text"))
    return _message({"title": truncated(escaped(F.concat(role, F.lit(" — "), company)), 256), "description": truncated(F.array_join(lines, " · "), 4096), "fields": fields, "footer": footer, "timestamp": F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "color": F.lit(COLORS["feed"]), "url": F.col("application_url")})


def review_message() -> Column:
    reasons = F.coalesce(F.nullif(F.array_join(F.transform("reasons", escaped), ", "), F.lit("")), F.lit("unspecified"))
    missing = lambda c: F.coalesce(c, F.lit("Missing"))
    fields = F.array_compact(F.array(_field("Company", missing("company")), _field("Role", missing("role")), _field("Application URL", missing("application_url"), False), _field("Reasons", reasons, False), _field("Source", F.col("source_url"), False)))
    excerpt = F.coalesce(truncated(escaped(F.col("description_excerpt")), 4096), F.lit("No source excerpt available."))
    footer = F.struct(truncated(F.concat(F.lit("Opportunity ID: "), "opportunity_id"), 2048).alias("text"))
    return _message({"title": F.lit("Review required"), "description": excerpt, "fields": fields, "footer": footer, "color": F.lit(COLORS["review"])})


def alert_message() -> Column:
    """An operations alert from workflow, category, attempt, next_retry, source_id and execution_url."""
    fields = F.array_compact(F.array(_field("Workflow", F.col("workflow")), _field("Category", F.col("category")), _field("Attempt", F.col("attempt").cast("string")), _field("Next retry", F.coalesce("next_retry", F.lit("n/a"))), _field("Source config", F.col("source_id")), _field("Execution", F.col("execution_url"), False)))
    return _message({"title": F.lit("Workflow failure"), "fields": fields, "color": F.lit(COLORS["alert"])}, "Aggregator operations alert")
