"""Sources, extraction, linkage, observation, intake, delivery, upkeep and streaming on golden and random cases."""

import hashlib
import hmac
import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.operators import delivery, extract, intake, linkage, metrics, observations, upkeep
from cairn.plans import bindings
from cairn.plans.process import process
from cairn.sources import events as ev
from cairn.sources import snapshots
from cairn.streaming import jobs

EVENT = "event_id string, ord string, source string, source_account string, source_event_id string, source_url string, captured_at timestamp, text string, attachment_urls array<string>, metadata_path string, metadata_json string"


def events(spark, *rows, account="o/r", path="README.md", source="github"):
    """rows: texts, or (id, text)."""
    import datetime

    made = [(str(r[0]), f"{i:06d}", source, account, str(r[0]), None, datetime.datetime(2026, 7, 1, 0, i % 60), r[1], [], path, "{}") for i, r in enumerate(x if isinstance(x, tuple) else (i, x) for i, x in enumerate(rows))]
    return spark.createDataFrame(made, EVENT)


def extracted(spark, text, **k):
    return extract.extract(events(spark, text, **k)).first()


# --- extraction ---


def test_markdown_row(spark):
    r = extracted(spark, "| **Acme** | Data Intern 🛂 | NYC; Boston, MA<br>Remote US | [Apply](https://jobs.lever.co/acme/1) | Jun 3 |", account="o/Summer2027")
    assert (r.c.company, r.c.role, r.c.locations, r.c.season, r.c.year, r.c.employment_type, r.c.sponsorship_status) == ("Acme", "Data Intern", ["NYC", "Boston, MA", "Remote US"], "summer", 2027, "internship", "does_not_offer")
    assert (r.c.application_url, str(r.c.posted_at), r.c.confidence, r.disposition, r.missing_evidence) == ("https://jobs.lever.co/acme/1", "2026-06-03 00:00:00", 0.99, "link", [])


def test_offseason_file_and_explicit_season(spark):
    r = extracted(spark, "| A | Intern | Falls Church, VA | https://a.com/jobs/1 | May 1 |", account="o/Summer2027", path="OFFSEASON_README.md")
    assert (r.c.season, r.c.year, r.disposition) == (None, 2026, "link")
    r = extracted(spark, "| A | Intern, Fall 2026 | Austin, TX | https://a.com/jobs/1 | May 1 |", account="o/Summer2027")
    assert (r.c.season, r.c.year) == ("fall", 2026)


def test_a_number_in_an_address_is_a_year_only_where_nothing_else_says_one(spark):
    row = "| Acme | Data Intern | Boston, MA | [Apply](https://jobs.lever.co/s7/p2073) | May 13 |"
    year = lambda text, **k: extract.extract(events(spark, text, **k)).select("c.year").first().year
    assert [year(row, account="o/Summer2027"), year(row, path="OFFSEASON.md"), year(row)] == [2027, 2026, 2073]
    assert [year("https://jobs.ashbyhq.com/acme-2047", path="OFFSEASON.md"), year("https://jobs.ashbyhq.com/acme-2047")] == [2026, 2047]
    assert year("https://jobs.lever.co/acme/data-summer-2026 of 2028") == 2026


def test_extraction_generates_methods_that_the_jvm_compiles(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(name)
    extract.extract(events(spark, "hello"))
    assert spark.conf.get(name) == "8000"
    spark.conf.set(name, "9000")
    extract.extract(events(spark, "hello"))
    assert spark.conf.get(name) == "9000"
    spark.conf.unset(name)


def test_a_number_after_a_number_sign_is_no_year(spark):
    year = lambda text: extract.extract(events(spark, text, source="discord_manual")).select("c.year").first().year
    assert [year(f"Company: Office {sign}2030 Inc.\nRole: Data Intern\n2027") for sign in ("№ ", "№", "#", "# ")] == [2027] * 4
    assert year("Company: Office 2030 Inc.\nRole: Data Intern\n2027") == 2030


def test_header_rule_and_short_rows_are_no_candidates(spark):
    got = extract.extract(events(spark, "| Company | Role | L | A | D |", "| --- | --- | --- | --- | --- |", "| a | b |")).collect()
    assert [r.c for r in got] == [None] * 3


def test_bare_host_keeps_its_evidence(spark):
    r = extracted(spark, "| A | Intern | Austin, TX | [x](https://a.com) | May 1 |")
    assert r.c.application_url == "https://a.com/" and r.missing_evidence == []


def test_inherited_company_stands_in_for_the_marker(spark):
    e = events(spark, "| ↳ | Intern | Austin, TX | https://a.com/jobs/1 | May 1 |")
    assert extract.extract(e).first().reasons == ["missing_company", "low_confidence"]
    filled = extract.extract(e.withColumn("row_company", F.lit("Acme"))).first()
    assert filled.c.company == "Acme"


def test_labelled_text(spark):
    r = extracted(spark, "Company: Acme\nRole: New Grad Engineer\nPosted: 2026-05-13\nDescription: About the role: Build. More.\nApplications closed", source="discord_manual")
    assert (r.c.employment_type, r.c.application_url, r.c.confidence, r.c.closed, r.c.description_excerpt, str(r.c.posted_at)) == ("new_grad", None, 0.70, True, "Build.", "2026-05-13 00:00:00")
    assert r.reasons == ["missing_application_url", "low_confidence"] and r.disposition == "review"
    assert tx.feed_key("x") is not None


def test_job_url_paste(spark):
    r = extracted(spark, "https://jobs.smartrecruiters.com/BigCo/744000068202601-data-science-intern-fall-2026", source="discord_manual")
    assert (r.c.parser, r.c.company, r.c.role, r.c.season, r.c.year, r.disposition) == ("job-application-url-v1", "Big Co", "Data Science Intern Fall 2026", "fall", 2026, "link")
    r = extracted(spark, "https://ats.rippling.com/acme/jobs/0f1e2d3c", source="discord_manual")
    assert (r.c.company, r.c.role, r.c.evidence["company"], r.missing_evidence) == ("Acme", None, "acme", [])


def test_unparsed_events_are_judged_and_providers_asked(spark):
    e = events(spark, ("a", "Apply for our internship"), ("b", "lunch?"), ("c", "webinar tonight"), source="discord_manual")
    got = {r.event_id: (r.disposition, r.reasons) for r in extract.extract(e).collect()}
    assert got == {"a": ("review", ["ai_unavailable"]), "b": ("ignored", []), "c": ("ignored", [])}

    def provider(asked):
        fields = {n: F.lit(None) for n in extract.CANDIDATE} | {"company": F.lit("Made up"), "role": F.lit("internship"), "locations": F.array(F.lit("Austin, TX")), "application_url": F.lit("https://not.there/"), "sponsorship_status": F.lit("unknown"), "confidence": F.lit(0.9), "closed": F.lit(False), "parser": F.lit("p"), "evidence": F.create_map(F.lit("role"), F.lit("internship"))}
        kinds = {"season": "string", "year": "int", "employment_type": "string", "posted_at": "timestamp", "description_excerpt": "string"}
        return asked.select("event_id", F.struct(*(fields[n].cast(kinds[n]).alias(n) if n in kinds else fields[n].alias(n) for n in extract.CANDIDATE)).alias("c"))

    r = next(x for x in extract.extract(e, provider).collect() if x.event_id == "a")
    assert r.reasons == ["invalid_evidence"] and r.missing_evidence == ["company", "locations", "application_url", "application_url_literal"]


def test_filters_do_not_repeat_the_extraction(spark):
    e = events(spark, *[ROW.format("C", "R", "c", i) for i in range(3)])
    plan = lambda frame: len(frame._jdf.queryExecution().optimizedPlan().toString())
    whole = extract.extract(e)
    kept = whole.filter("disposition = 'link' AND c.company IS NOT NULL AND size(missing_evidence) = 0").select("event_id")
    assert plan(kept) < 1.2 * plan(whole) and kept.count() == whole.filter("true").collect().__len__()
    ready = extract.prepared(whole)
    found = ready.filter("status = 'active' AND fingerprint IS NOT NULL AND canonical_url_hash <> '' AND disposition = 'link'")
    assert plan(found) < 1.2 * plan(ready)


# --- snapshots ---

TABLE = "intro | no table\n\n| Company | Role | Location | Application/Link | Date Posted |\n| --- | --- | :---: | --- | --- |\n"
LINES = ["| **Acme** | Intern 🔒 | NY | [a](https://a.com/1) | May 1 |", "| ↳ | Co-op | NY | <a href='https://a.com/2'>x</a> | May 2 |", "|  | Other | NY | 🔒 | May 3 |", "| ↳ | Esc \\| aped | NY | https://a.com/4. | May 4 |"]


def files(spark, **contents):
    return spark.createDataFrame([(1, p, 5, c, list(bindings.HEADERS)) for p, c in contents.items()], "source_id long, path string, captured_at long, content string, expected_headers array<string>")


def test_snapshot_rows(spark):
    rows = snapshots.parse_tables(files(spark, a=TABLE + "\r\n".join(LINES))).orderBy("row_index").collect()
    assert [(r.row_index, r.company, r.role, r.application_url) for r in rows] == [(0, "Acme", "Intern", "https://a.com/1"), (1, "Acme", "Co-op", "https://a.com/2"), (2, None, "Other", None), (3, "Acme", "Esc \\| aped", "https://a.com/4")]


def test_tables_are_parsed_in_one_pass(spark):
    content = "| Company | Role | L | A | D |\n| - | - | - | - | - |\n| A | Intern | NY | https://a.com/1 | May 1 |"
    rows = snapshots.parse_tables(files(spark, a=content, b=content.replace("Company", "Firm")).withColumn("expected_headers", F.array(*map(F.lit, ("Company", "Role", "L", "A", "D")))))
    assert [(r.path, r.role) for r in rows.filter("application_url IS NOT NULL").collect()] == [("a", "Intern")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_drift_and_missing_headers(spark):
    got = {r.path: r.detail for r in snapshots.drift(snapshots.with_options(files(spark, good=TABLE, other=TABLE.replace("Company", "Firm"), none="text only"))).collect()}
    assert got == {"good": None, "other": "table_headers_mismatch", "none": "table_headers_missing"}
    assert snapshots.parse_tables(files(spark, other=TABLE.replace("Company", "Firm") + LINES[0])).count() == 0


def test_keys_are_stable_and_removals_show(spark):
    keys = lambda *lines: {r.observation_key for r in snapshots.seen_keys(snapshots.parse_tables(files(spark, a=TABLE + "\n".join(lines))), F.lit("o/r")).collect()}
    assert keys(*LINES) == keys(*reversed(LINES))
    assert keys(*LINES) - keys(*LINES[1:]) == {"url:https://a.com/1"}
    assert len(keys(LINES[2], LINES[2])) == 1


def test_file_options_override(spark):
    options = spark.createDataFrame([(1, "a", 1, 0, 5)], "source_id long, path string, company_column int, role_column int, source_min_columns int")
    rows = snapshots.parse_tables(files(spark, a=TABLE + LINES[0]), options).collect()
    assert [(r.company, r.role) for r in rows] == [("Intern 🔒", "Acme")]


def test_parser_registry():
    with pytest.raises(ValueError):
        snapshots.register_parser("markdown_table_v1", snapshots.parse_tables)
    assert snapshots.parsers() == ["markdown_table_v1"]


# --- linkage ---

KEYS = "event_id long, ord string, canonical_url_hash string, stable_job_board string, stable_job_id string, fingerprint string"


def sequential(rows):
    """What the events do one by one, in order."""
    founders, out = [], {}
    for e in sorted(rows, key=lambda r: r[1]):
        keys = lambda r: {k for k in (("u", r[2]), ("s", r[3] and r[4] and (r[3], r[4])), ("f", r[5])) if k[1]}
        hits = [f for f in founders if keys(f) & keys(e)]
        if not hits:
            founders.append(e)
            out[e[0]] = (e[0], True)
        else:
            by_url = [f for f in hits if f[2] and f[2] == e[2]]
            out[e[0]] = ((by_url or hits)[0][0], False)
    return out


def name_of(event_id):
    return hashlib.sha256(f"opportunity\x1f{event_id}".encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_batch_linkage_equals_sequential_rule(spark, seed):
    r = random.Random(seed)
    pick = lambda n: r.choice([None, *map(str, range(n))])
    rows = [(i, f"{r.randint(0, 50):03d}-{i:03d}", pick(18), pick(3), pick(12), pick(18)) for i in range(45)]
    got = {x.event_id: (x.opportunity_id, x.created) for x in linkage.link_batch(spark.createDataFrame(rows, KEYS)).collect()}
    assert got == {e: (name_of(f), c) for e, (f, c) in sequential(rows).items()}


def test_first_match_is_not_transitive(spark):
    rows = [(1, "1", "u1", None, None, "f1"), (2, "2", "u2", None, None, "f2"), (3, "3", "u1", None, None, "f2")]
    got = {x.event_id: (x.opportunity_id, x.created) for x in linkage.link_batch(spark.createDataFrame(rows, KEYS)).collect()}
    assert got == {1: (name_of(1), True), 2: (name_of(2), True), 3: (name_of(1), False)}


def test_fuzzy_equals_brute_force(spark):
    r = random.Random(5)
    words = "data science software engineer hardware platform research intern cloud ai".split()
    company = lambda: r.choice(["Acme", "Acme Labs", "Labs Acme Inc", " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(9)), " ".join(f"w{i}" for i in range(1, 11))])
    row = lambda i, p: (f"{p}{i}", company(), " ".join(r.sample(words, r.randint(4, 7))), r.choice([2026, 2027, None]), f"2026-01-{r.randint(1, 28):02d}", "active", r.choice([None, "h1", "h2"]), None, None, None)
    stored = [row(i, "s") for i in range(60)]
    batch = [row(i, "e") for i in range(60)]
    tail = "company string, role string, year int, seen string, status string, canonical_url_hash string, stable_job_board string, stable_job_id string, fingerprint string"
    s = spark.createDataFrame(stored, "opportunity_id string, " + tail).withColumn("last_seen_at", F.to_timestamp("seen"))
    got = {x.event_id: x.opportunity_id for x in linkage.fuzzy_matches(spark.createDataFrame(batch, "event_id string, " + tail), s, role_least=0.6, limit=20).collect()}

    def form(t, drop=()):
        parts = t.lower().split()
        return {w for w in (parts[:-1] if parts[-1] in ("inc",) else parts)}

    def alike(a, b, least):
        return len(a & b) / len(a | b) >= least

    want = {}
    order = sorted(stored, key=lambda x: x[0])
    order = sorted(order, key=lambda x: x[4], reverse=True)
    for e in batch:
        pool = [x for x in order if e[3] is None or x[3] == e[3]][:20]
        hit = next((x for x in pool if not (e[6] and e[6] == x[6]) and alike(form(e[1]), form(x[1]), 0.9) and alike(set(e[2].replace("internship", "intern").split()), set(x[2].split()), 0.6)), None)
        if hit:
            want[e[0]] = hit[0]
    assert got == want and got


def test_linkage_plans_have_no_nested_loop(spark):
    """Joins by key only, in the plans that the operators themselves make, with broadcasts forbidden."""
    rows = [(i, str(i), f"u{i % 3}", None, None, f"f{i % 2}") for i in range(6)]
    keys = spark.createDataFrame(rows, KEYS)
    stored = keys.select(F.concat(F.lit("o"), F.col("event_id")).alias("opportunity_id"), F.lit(1).alias("created_at"), F.current_timestamp().alias("last_seen_at"), F.lit("active").alias("status"), F.lit("Acme").alias("company"), F.lit("Intern").alias("role"), F.lit(2027).alias("year"), *keys.columns[2:])
    asked = keys.select("*", F.lit("Acme").alias("company"), F.lit("Intern").alias("role"), F.lit(2027).alias("year"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (linkage.link_batch(keys, stored), linkage.match_stored(keys, stored), linkage.fuzzy_matches(asked, stored)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_insert_first_write_wins(spark):
    batch = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, at int, v string")
    new, marked = linkage.insert_new(batch, spark.createDataFrame([("b",)], "k string"), ["k"], ["at"])
    assert [tuple(r) for r in new.collect()] == [("a", 1, "x")] and marked.filter("inserted").count() == 1


# --- the whole run ---

ROW = "| {} | {} Intern | Austin, TX | https://jobs.lever.co/{}/{} | May 1 |"


def test_processing_cases(spark):
    e = events(spark, ("a", ROW.format("Acme", "Data", "acme", "1")), ("b", ROW.format("Acme", "Data", "acme", "1?utm_source=q")), ("c", ROW.format("Acme", "Web", "acme", "2")), ("d", ROW.format("Beta", "Web", "b", "3").replace("Intern", "Intern 🔒")), ("e", "lunch"), ("f", ROW.format("Gamma", "X", "g", "4").replace("Austin, TX", "Toronto")), account="o/Summer2027")
    made = process(e)
    got = {r.event_id: (r.disposition, r.created) for r in made["results"].collect()}
    assert got == {"a": ("processed", True), "b": ("processed", False), "c": ("processed", True), "d": ("processed", True), "e": ("ignored", None), "f": ("ignored", None)}
    assert made["opportunities"].count() == 3 and made["links"].count() == 4
    assert sorted(r.destination_key for r in made["outbox"].collect()) == ["internship-feed", "internship-feed"]
    assert upkeep.violations(made["opportunities"], made["links"], made["outbox"].withColumns({"status": F.lit("pending"), "external_id": F.lit(None).cast("string")})).count() == 0
    # Shuffled input changes nothing; a second batch links to what is stored, and a similar row goes to review.
    again = process(e.orderBy(F.rand(3)))
    assert sorted(map(tuple, again["links"].collect())) == sorted(map(tuple, made["links"].collect()))
    stored = linkage.checkpointed(made["opportunities"])
    later = process(events(spark, ("x", ROW.format("Acme", "Data", "acme", "1")), ("y", ROW.format("ACME", "Data", "other", "9")), account="o/Summer2027"), stored)
    got = {r.event_id: (r.disposition, r.reasons) for r in later["results"].collect()}
    assert got == {"x": ("processed", []), "y": ("review", ["fuzzy_duplicate"])}
    assert [r.destination_type for r in later["outbox"].collect()] == ["discord_review"]
    shadow = spark.createDataFrame([("o/Summer2027", True)], "source_account string, shadow_mode boolean")
    assert process(e, sources=shadow)["outbox"].count() == 0


# --- observation ---


def test_observation_states(spark):
    seen = lambda *keys: spark.createDataFrame([(1, k) for k in keys], "source_id long, observation_key string")
    state = spark.createDataFrame([], "source_id long, observation_key string, last_seen_at timestamp, consecutive_misses int")
    history = []
    for at, keys in enumerate((("url:a", "url:b"), ("url:b",), ("url:b",), ("url:a", "url:b"))):
        state = linkage.checkpointed(observations.observe(state, seen(*keys), f"2026-01-0{at + 1}"))
        history.append({r.observation_key: (r.consecutive_misses, r.event) for r in state.collect()})
        state = state.drop("event")
    assert [h["url:a"] for h in history] == [(0, None), (1, "possibly_removed"), (2, "closed"), (0, "reappeared")]
    assert history[3]["url:b"] == (0, None)


# --- intake ---


def test_signature_equals_hmac(spark):
    secret = b"s" * 80
    inner, outer = intake.pads(secret)
    body = spark.createDataFrame([(bytearray(b"{\xc3\xa9}"),)], "b binary")
    got = body.select(intake.hmac(F.lit(inner), F.lit(outer), F.col("b")).alias("x")).first().x
    assert got == hmac.new(secret, b"{\xc3\xa9}", hashlib.sha256).hexdigest()


def event_json(**k):
    base = {"schema_version": 1, "source": "github", "source_account": "o/r", "source_event_id": "1", "source_url": None, "occurred_at": None, "captured_at": "2026-07-29T22:01:00Z", "author_display": None, "text": "x", "attachments": [], "metadata": {"repository": "o/r", "branch": "b", "path": "p", "commit_sha": None, "row_index": 0}}
    return json.dumps(base | k).encode()


def test_contract(spark):
    many = [{"type": "image", "url": "https://x.com/" + "y" * 4000, "content_type": None, "filename": None}] * 20
    bodies = [event_json(), event_json(source="discord_manual"), event_json(extra=1), event_json(text="x" * 100_001), b"", b"{", b"\xff\xfe", b" " * (256 * 1024 + 1), event_json(captured_at="yesterday"), event_json(attachments=many), event_json(source="discord_manual", metadata={"guild_id": "1", "channel_id": "2", "message_id": "3", "forwarded": False})]
    want = [None, "validation_error", "validation_error", "validation_error", "empty_body", "invalid_json", "invalid_utf8", "payload_too_large", "validation_error", "attachment_metadata_too_large", None]
    got = [r.reject_code for r in ev.parse_events(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bodies)], "i int, body binary")).orderBy("i").collect()]
    assert got == want


# --- delivery ---


def test_backoff_and_outcomes(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, None), (4, None), (9, None), (1, 12.0), (1, 100000.0)], "n int, after double")
    assert [r.x for r in rows.select(delivery.delivery_backoff(F.col("n"), F.col("after")).alias("x")).collect()] == [30, 120, 600, 3600, 21600, 12, 86400]
    assert [r.x for r in spark.range(1, 10).select(delivery.event_backoff(F.col("id")).alias("x")).collect()] == [30, 60, 120, 240, 480, 960, 1920, 3600, 3600]
    codes = spark.createDataFrame([(201, "m"), (200, None), (429, None), (500, None), (404, None), (302, None)], "s int, m string")
    assert [r.x for r in codes.select(delivery.outcome(F.col("s"), F.col("m")).alias("x")).collect()] == ["delivered", "retryable", "rate_limited", "retryable", "permanent", "retryable"]


def test_escaping(spark):
    t = spark.createDataFrame([("a*b_[x](y)\x07",), ("x" * 10,)], "t string")
    assert [r.x for r in t.select(delivery.escaped(F.col("t")).alias("x")).collect()][0] == "a\\*b\\_\\[x\\]\\(y\\)"
    assert [r.x for r in t.select(delivery.truncated(F.col("t"), 6).alias("x")).collect()] == ["a*b_[…", "xxxxx…"]


# --- upkeep and streaming ---


def test_publishing_is_a_switch(spark, tmp_path):
    folder = str(tmp_path / "tables")
    upkeep.publish({"a": spark.range(3)}, folder, "v1")
    upkeep.publish({"a": spark.range(5)}, folder, "v2")
    assert upkeep.published(spark, folder, "a").count() == 5 and upkeep.published(spark, folder, "a", "v1").count() == 3
    upkeep.publish({"a": spark.range(2)}, folder, "v3", onto="v2")
    # A version may be published again from what it holds, under its own name.
    upkeep.publish({"a": upkeep.published(spark, folder, "a").union(spark.range(1))}, folder, "v3")
    assert upkeep.published(spark, folder, "a").count() == 8
    with pytest.raises(LookupError):
        upkeep.published(spark, str(tmp_path / "none"), "a")


def test_days_retire_without_a_rewritten_file(spark, tmp_path):
    folder, start = str(tmp_path / "tables"), datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, start + timedelta(hours=i)) for i in range(100)] + [(100, None)], "id long, at timestamp")
    upkeep.publish({"e": rows.filter("id < 60 OR id = 100"), "other": spark.range(3)}, folder, "v1", dated={"e": "at"})
    upkeep.publish({"e": rows.filter("id BETWEEN 60 AND 99")}, folder, "v2", onto="v1", dated={"e": "at"})
    assert sorted(r.id for r in upkeep.published(spark, folder, "e").collect()) == list(range(101)) and upkeep.published(spark, folder, "e").columns == ["id", "at"]
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    there, cut = files(), datetime(2026, 1, 3)
    assert len(upkeep.retire(spark, folder, "e", cut.date(), "v3", "v2")) == 2
    assert files() == there
    left = upkeep.published(spark, folder, "e")
    assert sorted(r.id for r in left.collect()) == sorted(r.id for r in rows.filter(F.col("at").isNull() | (F.col("at") >= F.lit(cut))).collect())
    assert upkeep.published(spark, folder, "e", "v2").count() == 101 and upkeep.published(spark, folder, "other").count() == 3
    upkeep.forget(spark, folder, keep=1)
    assert set(files()) < set(there) and upkeep.published(spark, folder, "e").count() == left.count()
    upkeep.retire(spark, folder, "e", datetime(2030, 1, 1).date(), "v4", "v3")
    assert [r.id for r in upkeep.published(spark, folder, "e").collect()] == [100]


def test_sketches_keep_their_rank_error(spark):
    times = spark.range(0, 60_000, 1, 6).select(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 20).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("s")).withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("s")))
    weeks = metrics.sketched_latencies(metrics.rolled_up(metrics.latency_sketches(times, "a", "b"))).collect()
    for w in weeks:
        own = sorted(r.s for r in times.filter((F.col("a") >= F.lit(w.start)) & (F.col("a") < F.lit(w.start + timedelta(days=7)))).select("s").collect())
        assert w.n == len(own) and w.longest == own[-1]
        for value, q in ((w.p50, 0.5), (w.p95, 0.95)):
            assert abs(sum(x <= value for x in own) / len(own) - q) < 0.005
    assert sum(w.n for w in weeks) == 60_000 and all(w.start.weekday() == 0 for w in weeks)


def test_counted_latencies_are_exact(spark):
    times = spark.range(0, 60_000, 1, 6).select(F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 20).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("s")).withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("s")))
    weeks = metrics.counted_latencies(metrics.counts_rolled_up(metrics.latency_counts(times, "a", "b"))).collect()
    for w in weeks:
        own = sorted(r.s for r in times.filter((F.col("a") >= F.lit(w.start)) & (F.col("a") < F.lit(w.start + timedelta(days=7)))).select("s").collect())
        assert (w.n, w.p50, w.p95, w.longest) == (len(own), own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1], own[-1])
    assert sum(w.n for w in weeks) == 60_000 and all(w.start.weekday() == 0 for w in weeks)


def test_streamed_latencies_equal_the_batch(spark, tmp_path):
    start, r = datetime(2026, 1, 1), random.Random(3)
    events_ = [(f"e{i}", start + timedelta(minutes=i)) for i in range(40)]
    canonical = [(e, f"o{i}", at + timedelta(seconds=r.randrange(3000))) for i, (e, at) in enumerate(events_) if i % 5]
    delivered = [(o, at + timedelta(seconds=r.randrange(3000))) for i, (_, o, at) in enumerate(canonical) if i % 3]
    canonical.append(("e7", "slow", start + timedelta(days=3)))  # beyond the horizon
    frames = {"a": spark.createDataFrame(events_, "event_id string, captured_at timestamp"), "b": spark.createDataFrame(canonical, "event_id string, opportunity_id string, canonical_at timestamp"), "c": spark.createDataFrame(delivered, "opportunity_id string, delivered_at timestamp")}
    for n, f in frames.items():
        f.repartition(2).write.parquet(str(tmp_path / n))
    stream = lambda n: spark.readStream.schema(frames[n].schema).parquet(str(tmp_path / n))
    q = jobs.latency_stream(*map(stream, "abc")).writeStream.format("memory").queryName("latencies").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got, columns = spark.table("latencies"), ["event_id", "captured_at", "delivered_at"]
    want = frames["a"].join(frames["b"], "event_id").join(frames["c"], "opportunity_id").filter("opportunity_id <> 'slow'")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and jobs.late_rows(q) == 0
    assert metrics.latencies(got, "captured_at", "delivered_at").first() == metrics.latencies(want, "captured_at", "delivered_at").first()


def linked(spark, folder):
    """Rows of the linkage store, as text."""
    tables = {"opportunities": jobs.records_of(spark, folder)} | {n: upkeep.published(spark, folder, n) for n in ("links", "outbox")}
    return {n: sorted(map(str, t.select(*sorted(c for c in t.columns if c != "evidence")).collect())) for n, t in tables.items()}


def made(tables):
    return {n: sorted(map(str, tables[n].select(*sorted(c for c in tables[n].columns if c != "evidence")).collect())) for n in ("opportunities", "links", "outbox")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), ROW.format(f"C{i % 4}", f"Role{i % 3}", f"c{i % 4}", i % 5)) for i in range(12)]
    e = events(spark, *rows, account="o/Summer2027")
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    e.coalesce(1).write.parquet(source)
    for _ in range(2):  # the second start finds nothing new
        jobs.link_events(spark.readStream.schema(e.schema).parquet(source), folder, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert linked(spark, folder) == made(process(e))


def test_batches_that_run_again_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    texts = [ROW.format(f"C{i % 4}", f"Role{i % 3}", f"c{i % 4}", i % 5) for i in range(12)]
    e = linkage.checkpointed(events(spark, *[(f"e{i:02d}", t) for i, t in enumerate(texts)], account="o/Summer2027"))
    batches = [e.filter(f"event_id BETWEEN '{a}' AND '{b}'") for a, b in (("e00", "e03"), ("e02", "e07"), ("e06", "e11"))]  # some events come twice
    whole = None
    for crash in (False, True):
        folder = str(tmp_path / f"out{crash}")
        step, read, published = jobs.link_step(folder, compact=2), [], upkeep.published
        monkeypatch.setattr(upkeep, "published", lambda s, f, name, version=None: (read.append(name), published(s, f, name, version))[1])
        for n, batch in enumerate(batches):
            assert n != 2 or set(read) == {"index", "recent"}  # no batch reads the tables, but to write them anew
            if crash:
                with monkeypatch.context() as m:  # the tables are written, the manifest isn't
                    m.setattr(upkeep, "file_system", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                    with pytest.raises(OSError, match="lost"):
                        upkeep.publish({"links": spark.range(1)}, folder, jobs.named(n))
            step(batch, n)
            step(batch, n)  # the progress of the stream wasn't saved
        monkeypatch.setattr(upkeep, "published", published)
        got = linked(spark, folder)
        whole = whole or got
        assert got == whole
        assert len(got["links"]) == 12 and len(set(got["opportunities"])) == len(got["opportunities"])
        runs = len(list((tmp_path / f"out{crash}" / "_index").iterdir()))
        jobs.forget(spark, folder, keep=1)
        assert runs == 6 and len(list((tmp_path / f"out{crash}" / "_index").iterdir())) == 3  # each batch ran twice
        assert linked(spark, folder) == whole and upkeep.versions(spark, folder) == [jobs.named(2)]
        with pytest.raises(RuntimeError, match="another checkpoint"):
            step(batches[0], 0)
    with pytest.raises(RuntimeError, match="lost"):
        jobs.link_step(str(tmp_path / "nowhere"))(batches[1], 1)


def test_the_nonce_guard_answers_as_the_batch(spark, tmp_path):
    """Over several micro-batches: 0, 5, 11, 20 and 21 minutes, another key, and a key whose state is long gone."""
    start, schema = datetime(2026, 1, 1), "caller string, nonce string, received_at timestamp, request_id string"
    minutes = {"n": (0, 5, 11, 20, 21, 300), "m": (3, 3, 14), "late": (400, 409, 411)}
    rows = sorted((("c", n, start + timedelta(minutes=m), f"{n}{i}") for n, ms in minutes.items() for i, m in enumerate(ms)), key=lambda r: (r[2], r[3]))
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        time.sleep(0.02)  # files are read by their time
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
        q = jobs.nonce_guard(stream).writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {r.request_id: r.reject_code for r in intake.judged_nonces(spark.createDataFrame(rows, schema)).collect()}
    assert {r.request_id: r.reject_code for r in spark.table("guarded").collect()} == want
    assert [k for k, v in sorted(want.items()) if v] == ["late1", "m1", "n1", "n3"]


def test_windowed_rates(spark, tmp_path):
    results = spark.createDataFrame([("s", "processed", f"2026-01-0{d} 01:00:00") for d in (1, 1, 2, 5)], "source string, disposition string, at string").withColumn("captured_at", F.to_timestamp("at"))
    results.write.parquet(str(tmp_path / "w"))
    q = jobs.windowed_rates(spark.readStream.schema(results.schema).parquet(str(tmp_path / "w"))).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.start)[:10], r.processed) for r in spark.table("rates").collect()} == {("2026-01-01", 2), ("2026-01-02", 1)}


# --- nonces ---


def plain_nonces(rows, lifetime, used=()):
    """request_id -> accepted, one use after the other."""
    last, out = {}, {}
    for caller, nonce, at, request in sorted([(*u, "") for u in used] + [tuple(r) for r in rows]):
        old = last.get((caller, nonce))
        fresh = request == "" or old is None or (at - old).total_seconds() >= lifetime
        if fresh:
            last[caller, nonce] = at if old is None else max(old, at)
        if request:
            out[request] = fresh
    return out


def test_a_nonce_lives_from_its_last_accepted_use(spark):
    start = datetime(2026, 1, 1)
    rows = [("c", "n", start + timedelta(minutes=m), f"r{m:02d}") for m in (0, 5, 11, 20, 21)]
    frame = spark.createDataFrame(rows, "caller string, nonce string, received_at timestamp, request_id string")
    got = {r.request_id: r.reject_code for r in intake.judged_nonces(frame).collect()}
    assert got == {"r00": None, "r05": "replayed_nonce", "r11": None, "r20": "replayed_nonce", "r21": None}


@pytest.mark.parametrize("parts", [1, 9])
def test_nonces_equal_one_use_after_the_other(spark, parts):
    """Also where one key fills nearly all tasks and its accepted uses follow each other without a pause."""
    r = random.Random(parts)
    start = datetime(2026, 1, 1)
    rows = [("hot", "n", start + timedelta(seconds=r.randrange(9000)), f"h{i:03d}") for i in range(400)] + [(r.choice("ab"), r.choice("xyz"), start + timedelta(seconds=r.randrange(9000)), f"c{i:03d}") for i in range(120)]
    used = [("hot", "n", start - timedelta(seconds=50)), ("a", "x", start + timedelta(seconds=700)), ("b", "y", start - timedelta(days=9))]
    schema = "caller string, nonce string, received_at timestamp, request_id string"
    frame = spark.createDataFrame([*rows, (None, "n", start, "bad"), ("a", None, start, "bad"), ("a", "x", None, "bad")], schema).withColumn("__new", F.lit("clash")).repartition(5)
    old = spark.createDataFrame(used, "caller string, nonce string, received_at timestamp")
    found = intake.judged_nonces(frame, old, 100, parts)
    assert found.columns == [*frame.columns, "reject_code"]
    got = found.collect()
    assert {x.request_id: x.reject_code is None for x in got if x.request_id != "bad"} == plain_nonces(rows, 100, used)
    assert [x.reject_code for x in got if x.request_id == "bad"] == ["unauthorized"] * 3
    assert intake.judged_nonces(frame.limit(0), old).count() == 0


# --- whole logs ---


def test_a_log_of_attempts_equals_one_call_an_attempt(spark):
    r, start = random.Random(4), datetime(2026, 1, 1)
    box = [(i, r.choice(["pending", "retry", "delivering", "delivered", "dead"]), r.randrange(9), start, None, "x") for i in range(60)]
    outbox = spark.createDataFrame(box, "id long, status string, attempt_count int, next_attempt_at timestamp, external_id string, at string")
    log = [(r.randrange(65), start + timedelta(seconds=i), r.choice([200, 201, 429, 500, 400, None]), r.choice([None, "", "m"]), r.choice([None, 0, 7, 10**6])) for i in range(300)]
    log += [(7, start + timedelta(days=1, seconds=i), 500, None, None) for i in range(40)]  # far more than can matter
    schema = "id long, attempted_at timestamp, status_code int, message_id string, retry_after int"
    state = linkage.checkpointed(outbox)
    for turn in range(max(sum(a[0] == i for a in log) for i in range(65))):  # the n-th attempt of each id
        some = [own[turn] for i in range(65) if len(own := [a for a in log if a[0] == i]) > turn]
        one = spark.createDataFrame(some, schema)
        state = linkage.checkpointed(delivery.settle_deliveries(state, one))
        if turn == 11:
            break
    got = delivery.settle_deliveries(outbox, spark.createDataFrame([*log, *log[:50]], schema).repartition(4))
    assert got.columns == outbox.columns and dict(got.dtypes) == dict(outbox.dtypes)
    assert sorted(map(str, got.collect())) == sorted(map(str, state.collect()))
    queue = outbox.drop("external_id", "at").withColumn("status", F.when(F.col("status") == "dead", "failed").when(F.col("status") == "delivered", "processed").otherwise("pending"))
    runs = [(i, at, r.choice(["failed", "failed", "failed", "processed", "review", None])) for i, at, *_ in log[:200]]
    known = spark.createDataFrame(runs, "id long, attempted_at timestamp, disposition string")
    state = queue
    for turn in range(12):
        some = [own[turn] for i in range(65) if len(own := [a for a in runs if a[0] == i]) > turn]
        if some:
            state = linkage.checkpointed(delivery.settle_events(state, spark.createDataFrame(some, known.schema)))
    assert sorted(map(str, delivery.settle_events(queue, known).collect())) == sorted(map(str, state.collect()))


def test_many_snapshots_equal_one_after_the_other(spark):
    r, start = random.Random(6), datetime(2026, 1, 1)
    state = spark.createDataFrame([(s, f"k{k}", start, r.randrange(4)) for s in (1, 2, 3, 9) for k in range(6)], "source_id long, observation_key string, last_seen_at timestamp, consecutive_misses int")
    rows = [(s, start + timedelta(days=d), f"k{k}") for d in range(1, 9) for s in (1, 2, 3) if r.random() < 0.7 for k in [r.randrange(9), *(k for k in range(9) if r.random() < 0.5)]]
    seen = spark.createDataFrame(rows, "source_id long, observed_at timestamp, observation_key string").repartition(3)
    now, told, last = state, [], {}
    for at in sorted({x[1] for x in rows}):
        step = linkage.checkpointed(observations.observe(now, seen.filter(F.col("observed_at") == at), at))
        for x in step.filter("event IS NOT NULL").collect():
            key = (x.source_id, x.observation_key)
            if not (x.event == "closed" and last.get(key) == "closed"):
                told.append((*key, x.event, at))
            last[key] = x.event
        now = step.drop("event")
    after, events_ = observations.observe_all(state, seen)
    assert sorted(map(tuple, after.select(now.columns).collect())) == sorted(map(tuple, now.collect()))
    assert sorted(map(tuple, events_.collect())) == sorted(told) and {t[2] for t in told} == {"possibly_removed", "closed", "reappeared"}
    # An empty snapshot is a read too.
    reads = seen.select("source_id", "observed_at").union(spark.createDataFrame([(9, start), (9, start + timedelta(days=1))], "source_id long, observed_at timestamp"))
    nine = observations.observe_all(state, seen, reads)[0].filter("source_id = 9").collect()
    assert {x.observation_key: x.consecutive_misses for x in nine} == {x.observation_key: x.consecutive_misses + 2 for x in state.filter("source_id = 9").collect()}
