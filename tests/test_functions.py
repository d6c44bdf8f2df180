"""Text, address and page functions on golden cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import pages as pg
from cairn.functions import text as tx
from cairn.functions import urls as ul


def one(spark, column, **values):
    kinds = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), list: T.ArrayType(T.StringType()), type(None): T.StringType()}
    schema = T.StructType([T.StructField(k, kinds[type(v)]) for k, v in values.items()] or [T.StructField("none", T.StringType())])
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("x")).first().x


def many(spark, column, texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("x", column).orderBy("i").collect()]


def test_normal_forms(spark):
    assert many(spark, tx.normalized("t"), ["A & B, Inc.", "  Équipe--Nord ", None, "", "x&y"]) == ["a and b inc", "équipe nord", None, "", "x and y"]
    assert many(spark, tx.company_form("t"), ["Acme, Inc.", "Acme Company", "Company", "Coca-Co la", "Zinc"]) == ["acme", "acme", "", "coca co la", "zinc"]
    assert many(spark, tx.role_form("t"), ["Engineering Internship (Summer 2027)", "Interns, Data Engineering", "internal"]) == ["engineer intern", "interns data engineer", "internal"]
    wide = spark.createDataFrame([(1, "ＡＢＣ １"), (2, "plain"), (3, None)], "i long, t string")
    assert [r.t for r in tx.compatible(wide, "t").orderBy("i").collect()] == ["ABC 1", "plain", None]


def test_seasons_and_years(spark):
    cases = ["Summer2027", "Falls Church, VA", "Role, Fall 2026 start", "autumn", "winter-spring", "req 7202612345", "équipe fall", "Summer 2027 or 2026", "in 2031"]
    assert many(spark, tx.season_of("t"), cases) == ["summer", None, "fall", "fall", "spring", None, "fall", "summer", None]
    assert many(spark, tx.year_of("t"), cases) == [2027, None, 2026, None, None, None, None, 2027, 2031]


def test_posted_dates_roll_and_wrap(spark):
    at = F.lit("2026-01-20 00:00:00").cast("timestamp")
    got = many(spark, F.date_format(tx.posted_at("t", at), "yyyy-MM-dd"), ["Jan 5", "Dec 30", "february 20", "Feb 31", "Mayday", "Sept 9", None])
    assert got == ["2026-01-05", "2025-12-30", "2026-02-20", "2025-03-03", None, "2025-09-09", None]


def test_vocabulary(spark):
    assert many(spark, tx.employment_type("t"), ["Co-op intern", "INTERNSHIP", "new grad", "international", "early-career x"]) == ["co_op", "internship", "new_grad", None, "new_grad"]
    assert many(spark, tx.sponsorship("t"), ["a 🛂", "🇺🇸 🛂", "b"]) == ["does_not_offer", "us_citizenship_required", "unknown"]
    where = lambda *p: one(spark, tx.geography("p"), p=list(p))
    assert [where("Boston, MA"), where("Remote US"), where("Toronto"), where("Toronto", "Paris"), where("Remote"), where("EMEA / Remote")] == ["allowed", "allowed", "rejected", "ambiguous", "ambiguous", "rejected"]
    mode = lambda p, t="": one(spark, tx.work_mode("p", "t"), p=p, t=t)
    assert [mode(["Hybrid - NY"]), mode(["Remote"]), mode([], "work from home"), mode(["NYC"], "in-office"), mode(["NYC"])] == ["Hybrid", "Remote", "Remote", "On-site", None]


def test_an_address_is_taken_apart_once(spark):
    """However deep the functions of addresses are nested, the plan holds one match of their shape a step."""
    plan = lambda column: spark.createDataFrame([("",)], "t string").select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    shape = "(?:([^/?#@]*)@)?"
    assert [plan(c).count(shape) for c in (ul.canonical("t"), ul.job_identity("t"), ul.is_job_url("t"), ul.serialized("t"), ul.job_identity(ul.canonical("t")))] == [1, 1, 1, 1, 2]


def test_plain_addresses_are_their_own_form(spark):
    plain = ["https://a.com/b", "https://jobs.lever.co/a-b/C_1~"]
    assert many(spark, ul.canonical("t"), plain) == plain and many(spark, ul.serialized("t"), [p + "/?a=1&a" for p in plain]) == [p + "/?a=1&a" for p in plain]
    other = ["https://a.com/b/", "https://A.com/b", "https://a.com/./b", "http://a.com/b", "https://a.com/b?ref=1", "https://u@a.com/b", "https://a.com:443/b", "https://a.com"]
    assert many(spark, ul.canonical("t"), other) == ["https://a.com/b", "https://a.com/b", "https://a.com/b", None, "https://a.com/b", None, "https://a.com/b", "https://a.com/"]


RELEVANCE = [
    ("Summer internship, apply now", "relevant"), ("co-op application open", "relevant"), ("new grad careers", "relevant"), ("early-career: https://jobs.lever.co/a/b", "relevant"), ("internship", "ambiguous"), ("apply here", "ambiguous"),
    ("https://boards.greenhouse.io/acme/jobs/1", "ambiguous"), ("Senior engineer, apply", "irrelevant"), ("staff role at career fair", "irrelevant"), ("Senior intern mentor apply", "relevant"), ("webinar tonight", "irrelevant"), ("hackathon https://x.example/news", "irrelevant"),
    ("see https://movies.example/times", "irrelevant"), ("hello", "irrelevant"), (None, "irrelevant"), ("webinar: apply for the internship", "relevant"),
]


def test_relevance(spark):
    column = tx.relevance("t", F.exists(ul.urls_in("t"), lambda u: ul.is_job_url(u)), F.size(ul.urls_in("t")) > 0)["disposition"]
    assert many(spark, column, [t for t, _ in RELEVANCE]) == [d for _, d in RELEVANCE]


def test_labels(spark):
    assert many(spark, tx.humanized("t"), ["data-science_Intern", "bigCo", "a--b", "x2y Z"]) == ["Data Science Intern", "Big Co", "A B", "X2y Z"]
    assert many(spark, tx.one_line("t", 20), ["About the role: Build it. More.", "No stop", "  ", None, "abcdefghij klmnopqrstuvwxyz"]) == ["Build it.", "No stop", None, None, "abcdefghij klmnopqr…"]
    assert many(spark, tx.employment_label("t"), ["co_op", None, "new_grad"]) == ["Co-op", "Uncategorized", "New Grad"]
    assert one(spark, tx.season_year("s", "y"), s="fall", y=2026) == "Fall 2026"


def test_jaccard_and_fingerprint(spark):
    j = lambda a, b: one(spark, tx.jaccard(tx.tokens("a"), tx.tokens("b")), a=a, b=b)
    assert j("a b c", "b c d") == 0.5 and j("", "") == 0.0
    f = lambda **k: one(spark, tx.fingerprint("c", "r", "p", "s", "y", "b", "i"), **({"c": "Acme Inc", "r": "Data Intern", "p": ["NY", "Boston"], "s": "fall", "y": 2026, "b": None, "i": None} | k))
    assert f() == f(c="ACME", p=["boston", "ny"]) != f(s="spring")
    assert f(c="Inc") is None and f(r=None) is None


URLS = [
    ("https://Jobs.Lever.co/acme/1/?utm_source=x&b=2&a=1#top", "https://jobs.lever.co/acme/1?a=1&b=2"), ("https://x.com", "https://x.com/"), ("https://x.com:443/a//", "https://x.com/a"), ("https://x.com:8443/a", "https://x.com:8443/a"),
    ("http://x.com/a", None), ("https://u:p@x.com/a", None), ("https://x.com/?q=a%20b&jobSite=1&ref=z", "https://x.com/?q=a+b"), ("https://x.com/?a=2&a=1", "https://x.com/?a=2&a=1"), ("nonsense", None), (None, None), ("https://é.com/", None),
]


def test_canonical_addresses(spark):
    assert many(spark, ul.canonical("t"), [u for u, _ in URLS]) == [c for _, c in URLS]
    assert many(spark, ul.url_error("t"), ["http://x.com", "https://u@x.com", "nonsense", "https://x.com"]) == ["not_https", "credentials", "invalid", None]


def test_job_identity(spark):
    cases = {"https://jobs.lever.co/acme/abc-1": ("lever", "abc-1"), "https://job-boards.greenhouse.io/acme/jobs/123": ("greenhouse", "123"), "https://x.com/apply?gh_jid=4567": ("x.com", "4567"), "https://acme.wd5.myworkdayjobs.com/en/job/R1": ("workday", "R1"), "https://ats.rippling.com/acme/jobs/u-1": ("rippling", "u-1"), "https://jobs.ashbyhq.com/a/b": ("ashby", "b"), "https://jobs.lever.co/acme": None, "https://x.com/?gh_jid=a": None}
    got = many(spark, ul.job_identity("t"), list(cases))
    assert [g and (g.board, g.id) for g in got] == list(cases.values())


def test_addresses_in_text(spark):
    got = one(spark, ul.urls_in("t", "a"), t="See (https://X.com/a), http://y.com. https://x.com/a <https://z.com/q?x=1>", a=["https://w.com"])
    assert got == ["https://x.com/a", "http://y.com/", "https://z.com/q?x=1", "https://w.com/"]
    assert many(spark, ul.cell_url("t"), ['<a href="https://a.com/x">Apply</a>', "[Apply](https://b.com/y)", "https://c.com/z;", "none"]) == ["https://a.com/x", "https://b.com/y", "https://c.com/z", None]
    assert many(spark, ul.is_job_url("t"), ["https://acme.com/careers/1", "https://jobs.acme.com/", "https://acme.com/news?x=/apply", "https://boards.greenhouse.io/a", "https://acme.com/jobsite"]) == [True, True, True, True, False]


PAGE = """<html><head><title>Ignored | Site</title><meta content="OG &amp; Title | Acme" property='og:title'><meta property="og:site_name" content="Acme Recruiting"></head><body><h1>Head <b>ing</b></h1>%s</body></html>"""


def test_page_precedence(spark):
    page = lambda html: one(spark, pg.job_page("h"), h=html)
    ld = '<script type="application/ld+json">%s</script>'
    full = page(PAGE % (ld % "{bad" + ld % '[{"@type":"Thing"},{"@type":"JobPosting","title":"Dev &amp; Ops","hiringOrganization":"Org","datePosted":"2026-05-13","description":"<p>Work <b>hybrid</b></p>","jobLocation":[{"name":"HQ"},{"address":{"addressLocality":"Paris","addressCountry":"FR"}},"Berlin"]}]'))
    assert (full.role, full.company, full.locations, full.work_mode, full.description, str(full.posted)) == ("Dev & Ops", "Org", ["HQ", "Paris, FR", "Berlin"], "Hybrid", "Work hybrid", "2026-05-13 00:00:00")
    assert (page(PAGE % "").role, page(PAGE % "").company) == ("OG & Title", "Acme")
    assert page("<h1>Only <i>this</i></h1>").role == "Only this" and page("<title>Just | that</title>").role == "Just"
    assert page("").role is None and page("").locations == []


def test_deep_postings_and_entities(spark):
    pages = spark.createDataFrame([(1, '<script type="application/ld+json">{"@graph":[{"@graph":[{"@type":"JobPosting","title":"T"}]}]}</script>'), (2, None)], "i int, html string")
    assert [r.job for r in pg.deep_postings(pages).orderBy("i").collect()] == ['{"@type": "JobPosting", "title": "T"}', None]
    # The posting is found in the JVM too, in lists and graphs within each other, in the order of the page.
    nested = '<script type="application/ld+json">[{"@type":"Thing"},[{"@graph":[{"@type":"Thing"},[{"@graph":[{"@type":"JobPosting","title":"Deep"}]}]]},{"@type":"JobPosting","title":"Later"}]]</script>'
    assert one(spark, pg.job_page("h"), h=nested).role == "Deep"
    assert one(spark, pg.job_page("h"), h=pages.first().html).role == "T"


def test_entities_are_decoded_in_order(spark):
    texts = ["a &#233; b", "x &amp;lt; y &AMP;amp; z", "&#65;&#x42;&#X1F600;", "&#38;lt; &#1114112; &#55296; &#0; &#x110000; &#99999999999999999999;", "&bogus; & &#; &#x;", "&nbsp;&quot;&#39;&gt;", None]
    assert many(spark, pg.decoded("t"), texts) == ["a é b", "x < y &amp; z", "AB😀", "&lt; &#1114112; &#55296; &#0; &#x110000; &#99999999999999999999;", "&bogus; & &#; &#x;", " \"'>", None]


def test_forms_of_compatibility_characters(spark):
    rows = spark.createDataFrame([(1, "Ａcme Oﬃce Ｉｎｃ．", ["Ｂoston", "plain"], None), (2, "Plain Inc", [], "x"), (3, None, None, "ﬁ")], "i int, company string, places array<string>, role string")
    got = [(r.company, r.places, r.role, r.f) for r in tx.compatible(rows, "company", "places", "role").withColumn("f", tx.company_form("company")).orderBy("i").collect()]
    assert got == [("Acme Office Inc.", ["Boston", "plain"], None, "acme office"), ("Plain Inc", [], "x", "plain"), (None, None, "fi", None)]


def test_addresses_of_other_hosts_and_dot_segments(spark):
    given = ["https://[2001:DB8::1]:443/a/./b/../c/", "https://a.com/x y?z=1", "https://a.com/../../q/.", " https://a.com/%2E%2e/x ", "https://a.com/a..b/.c"]
    assert many(spark, ul.canonical("t"), given) == ["https://[2001:db8::1]/a/c", "https://a.com/x%20y?z=1", "https://a.com/q", "https://a.com/x", "https://a.com/a..b/.c"]
    assert many(spark, ul.url_error("t"), ["https://[::1", "https://a b/", "ftp://a.com", "https://u@[::1]/"]) == ["invalid", "invalid", "invalid", "credentials"]


@pytest.mark.parametrize("seed", range(3))
def test_normal_form_is_stable(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("aÉ &-.,1 \tßx") for _ in range(20)) for _ in range(30)]
    once = many(spark, tx.normalized("t"), texts)
    assert many(spark, tx.normalized("t"), once) == once


def test_normal_forms_keep_control_characters_in_their_columns(spark):
    rows = [(1, "Ａcme\x1eX", "b", ["Ｏslo\x1fZ", None, "", "a"]), (2, "plain\x1e", None, None), (3, None, "Ｂ\x1f\x1e", []), (4, "\x1f", "c", ["d\x1e"])]
    frame = spark.createDataFrame(rows, "i int, company string, role string, places array<string>")
    got = [tuple(r) for r in tx.compatible(frame, "company", "role", "places").orderBy("i").collect()]
    assert got == [(1, "Acme\x1eX", "b", ["Oslo\x1fZ", None, "", "a"]), (2, "plain\x1e", None, None), (3, None, "B\x1f\x1e", []), (4, "\x1f", "c", ["d\x1e"])]
