"""The raw-event contract: JSON lines to typed events, or a coded reject; no row is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
SOURCES = ("github", "discord_browser", "slack_api", "slack_browser", "instagram_browser", "discord_manual", "slack_manual", "instagram_manual")
BODY_BYTES, ATTACHMENT_BYTES, TEXT_LENGTH, ATTACHMENTS = 256 * 1024, 64 * 1024, 100_000, 20

ATTACHMENT = "struct<type:string,url:string,content_type:string,filename:string>"
METADATA = {
    "github": "struct<repository:string,branch:string,path:string,commit_sha:string,row_index:long>",
    "discord": "struct<guild_id:string,channel_id:string,message_id:string,forwarded:boolean>",
    "slack": "struct<workspace:string,channel_id:string,message_ts:string,thread_ts:string>",
    "instagram": "struct<username:string,media_id:string,media_type:string,shortcode:string>",
}
FIELDS = {
    "schema_version": "int", "source": "string", "source_account": "string", "source_event_id": "string", "source_url": "string", "occurred_at": "string",
    "captured_at": "string", "author_display": "string", "text": "string", "attachments": f"array<{ATTACHMENT}>", "metadata": "variant",
}


def family(source: Column) -> Column:
    return F.substring_index(source, "_", 1)


def between(text: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(F.trim(text)).between(low, high), F.lit(False))


def or_null(value: Column, test: Column) -> Column:
    return value.isNull() | F.coalesce(test, F.lit(False))


def instant(text: Column) -> Column:
    """An ISO time with an offset."""
    return F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$")), F.try_to_timestamp(text))


def only_keys(json: Column, names) -> Column:
    """Every key of the JSON object is one of the names, and all of them are there."""
    keys = F.array_sort(F.json_object_keys(json))
    return F.coalesce(keys == F.array_sort(F.array(*map(F.lit, names))), F.lit(False))


def metadata_valid(source: Column, meta: Column, raw: Column) -> Column:
    g, d, s, i = (meta[n] for n in METADATA)
    digits = lambda c: F.coalesce(F.regexp_like(c, F.lit(r"^\d+$")), F.lit(False))
    stamp = lambda c: F.regexp_like(c, F.lit(r"^\d+\.\d+$"))
    names = lambda n: [f.split(":")[0] for f in METADATA[n][7:-1].split(",")]
    tests = {
        "github": between(g["repository"], 3, 255) & between(g["branch"], 1, 255) & between(g["path"], 1, 1024) & or_null(g["commit_sha"], F.regexp_like(g["commit_sha"], F.lit("^[a-fA-F0-9]{40}$"))) & or_null(g["row_index"], g["row_index"] >= 0),
        "discord": digits(d["guild_id"]) & digits(d["channel_id"]) & digits(d["message_id"]) & d["forwarded"].isNotNull(),
        "slack": between(s["workspace"], 1, 255) & between(s["channel_id"], 1, 255) & F.coalesce(stamp(s["message_ts"]), F.lit(False)) & or_null(s["thread_ts"], stamp(s["thread_ts"])),
        "instagram": between(i["username"], 1, 64) & between(i["media_id"], 1, 255) & F.coalesce(i["media_type"].isin("post", "reel", "story"), F.lit(False)) & or_null(i["shortcode"], between(i["shortcode"], 1, 64)),
    }
    return reduce(lambda rest, n: F.when(family(source) == n, tests[n] & only_keys(raw, names(n))).otherwise(rest), METADATA, F.lit(False))


def parse_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies (a column of bytes) with `event` (struct, null if rejected) and `reject_code` (null if accepted).

    Codes in the order of the checks: empty_body, payload_too_large, invalid_utf8, invalid_json, validation_error,
    attachment_metadata_too_large.
    """
    data = F.col(body).cast("binary")
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    parsed = bodies.withColumn("__json", F.when(F.octet_length(data) <= BODY_BYTES, text)).withColumn("__v", F.try_parse_json("__json"))
    shape = ", ".join(f"{n}: {t}" for n, t in FIELDS.items() if n != "metadata")
    parsed = parsed.withColumn("__e", F.from_json("__json", shape.replace(": ", " "))).withColumn("__raw", F.get_json_object("__json", "$.metadata"))
    parsed = parsed.withColumn("__m", F.struct(*(F.from_json("__raw", t[7:-1].replace(":", " ")).alias(n) for n, t in METADATA.items())))
    e = F.col("__e")
    common = (
        (e["schema_version"] == 1) & e["source"].isin(*SOURCES) & between(e["source_account"], 1, 512) & between(e["source_event_id"], 1, 1024) & instant(e["captured_at"]).isNotNull()
        & or_null(e["source_url"], F.regexp_like(e["source_url"], F.lit(r"^[a-z][a-z0-9+.\-]*:.+"))) & or_null(e["occurred_at"], instant(e["occurred_at"]).isNotNull()) & or_null(e["author_display"], between(e["author_display"], 1, 512))
        & or_null(e["text"], F.length(e["text"]) <= TEXT_LENGTH) & e["attachments"].isNotNull() & (F.size(e["attachments"]) <= ATTACHMENTS)
        & F.forall(e["attachments"], lambda a: F.coalesce(a["type"].isin("image", "file", "embed") & a["url"].isNotNull() & or_null(a["content_type"], between(a["content_type"], 1, 255)), F.lit(False)))
    )
    fits = F.coalesce(common & only_keys(F.col("__json"), FIELDS) & metadata_valid(e["source"], F.col("__m"), F.col("__raw")), F.lit(False))
    code = (
        F.when(F.coalesce(F.octet_length(data), F.lit(0)) == 0, "empty_body")
        .when(F.octet_length(data) > BODY_BYTES, "payload_too_large")
        .when(text.isNull(), "invalid_utf8")
        .when(F.col("__v").isNull(), "invalid_json")
        .when(~fits, "validation_error")
        .when(F.octet_length(F.to_json(e["attachments"])) > ATTACHMENT_BYTES, "attachment_metadata_too_large")
    )
    family_only = F.struct(*(F.when(family(e["source"]) == n, F.col("__m")[n]).alias(n) for n in METADATA))
    event = F.struct(*(instant(e[n]).alias(n) if n.endswith("_at") else e[n].alias(n) for n in FIELDS if n != "metadata"), family_only.alias("metadata"), F.col("__raw").alias("metadata_json"), F.sha2(data, 256).alias("payload_sha256"))
    return parsed.withColumn("reject_code", code).withColumn("event", F.when(F.col("reject_code").isNull(), event)).drop("__json", "__v", "__e", "__raw", "__m")


def identity_key() -> list[str]:
    """What makes two events the same."""
    return ["source", "source_account", "source_event_id"]
