"""Titles against a catalog of role families and concepts, and against each other.

The catalog is a parameter: a list of families and concepts (``read_catalog`` takes a
JSON file, ``standard`` makes one by rule).  Its phrases are normalised by the same column
functions as the titles, once.  Titles are made distinct first; a phrase index (a posting
row for each phrase and concept) meets the runs of words of a title by equality, and only
concepts that a title meets are scored for it, with higher-order functions.  A concept
that shares no phrase and no word with a title gets less than any threshold, so nothing is
lost, and the work grows with the matches instead of titles times phrases.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as X
from vacantia.operators.tagging import matches as phrase_matches


@dataclass
class Family:
    """A role family: its group, and words for and against it."""

    name: str
    group: str
    positive: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    anchor: str = ""
    discovery: list[str] = field(default_factory=list)
    broadens: bool = True


@dataclass
class Concept:
    """A role: canonical title, other names, and how it stands to other roles."""

    name: str
    family: str
    title: str
    aliases: list[str] = field(default_factory=list)
    abbreviations: list[str] = field(default_factory=list)
    synonyms: list[list[str]] = field(default_factory=list)
    adjacent: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    related: list[str] = field(default_factory=list)
    discovery: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    families: list[Family]
    concepts: list[Concept]


def read_catalog(path: str) -> Catalog:
    """A catalog from JSON with ``families`` and ``concepts``."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    return Catalog([Family(**f) for f in spec["families"]], [Concept(**c) for c in spec["concepts"]])


# Weights of what speaks for a concept, thresholds, groups of head words.
WEIGHTS = {"canonical": 420, "alias": 280, "synonym": 65, "token": 90, "phrase": 55, "covered": 70, "core": 120, "head": 45, "no_head": -140, "family": 80, "other_family": -70, "negative": -260}
PRIMARY, RELATED, LEAD, MOST = 260, 180, 140, 4
GROUPS = {
    "architect": "solutions", "administrator": "support", "consultant": "solutions", "developer": "engineering", "designer": "design", "engineer": "engineering",
    "analyst": "analysis", "manager": "management", "owner": "management", "researcher": "design", "recruiter": "recruiting", "scientist": "engineering",
    "sourcer": "recruiting", "staff": "engineering", "writer": "writing", "specialist": "operations", "coordinator": "operations", "tester": "quality",
}
STAND_INS = [
    ("administrator", "engineer"), ("developer", "engineer"), ("engineer", "developer"), ("architect", "engineer"), ("researcher", "scientist"),
    ("scientist", "analyst"), ("tester", "engineer"), ("staff", "engineer"), ("specialist", "manager"), ("owner", "manager"),
]
BROAD_FAMILIES = ["software_engineering", "data_platform", "ai_ml_science", "product", "cloud_devops_security", "architecture_solutions"]
THRESHOLDS = {"strict": 760, "balanced": 420, "broad": 260}
SAMPLE = Catalog(
    [
        Family("software_engineering", "engineering", ["software engineer", "software developer", "backend engineer", "frontend engineer", "full stack engineer", "mobile engineer"], ["data engineer", "product manager", "recruiter"]),
        Family("data_platform", "engineering", ["data engineer", "analytics engineer", "etl", "data warehouse", "pipeline"], ["software engineer", "product manager", "recruiter"]),
        Family("data_analytics", "analysis", ["data analyst", "business analyst", "reporting"], ["data engineer", "recruiter"]),
        Family("product", "management", ["product manager", "product owner"], ["software engineer", "recruiter"]),
    ],
    [
        Concept("software_engineer", "software_engineering", "software engineer", ["software developer", "software development engineer", "application developer"], ["swe", "sde"], [["software", "application"], ["engineer", "developer"]], ["backend_engineer", "frontend_engineer"]),
        Concept("backend_engineer", "software_engineering", "backend engineer", ["backend developer", "api engineer", "server engineer"], [], [["backend", "server", "api"], ["engineer", "developer"]], ["software_engineer"]),
        Concept("frontend_engineer", "software_engineering", "frontend engineer", ["frontend developer", "ui engineer", "web engineer"], [], [["frontend", "ui", "web"], ["engineer", "developer"]], ["software_engineer"]),
        Concept("data_engineer", "data_platform", "data engineer", ["data platform engineer", "etl developer"], [], [["data", "etl"], ["engineer", "developer"]], ["data_analyst"]),
        Concept("data_analyst", "data_analytics", "data analyst", ["reporting analyst", "analytics analyst"], [], [["data", "reporting"], ["analyst"]], ["data_engineer"]),
        Concept("product_manager", "product", "product manager", ["product owner"], ["pm"], [["product"], ["manager", "owner"]], [], ["software_engineer"]),
    ],
)
_CONCEPT = "name string, family string, title string, aliases array<string>, abbreviations array<string>, synonyms array<array<string>>, tokens array<string>, phrases array<string>, head string, adjacent array<string>, excludes array<string>, negative array<string>"
_FAMILY = "name string, grp string, positive array<string>, negative array<string>"


@dataclass
class Prepared:
    """A catalog with all phrases in normal form, as JSON constants."""

    concepts: str
    families: str
    source: Catalog

    def column(self) -> Column:
        return F.from_json(F.lit(self.concepts), f"array<struct<{_typed(_CONCEPT)}>>")

    def plain(self) -> dict[str, dict]:
        """Concepts by name, phrases in normal form, for the driver's side of a query."""
        return {c["name"]: c for c in json.loads(self.concepts)}

    def family_column(self) -> Column:
        return F.from_json(F.lit(self.families), f"array<struct<{_typed(_FAMILY)}>>")


def _typed(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (p.split(" ", 1) for p in ddl.split(", ")))


_prepared: dict[str, Prepared] = {}


def prepare(spark: SparkSession, catalog: Catalog = SAMPLE) -> Prepared:
    """Normalise the catalog's phrases, once a process; a row a concept, a handful of kilobytes."""
    key = repr(catalog)
    if key not in _prepared:
        _prepared[key] = _prepare(spark, catalog)
    return _prepared[key]


def _prepare(spark: SparkSession, catalog: Catalog) -> Prepared:
    rows = [(c.name, c.family, c.title, c.aliases, c.abbreviations, c.synonyms, [c.title, *c.aliases, *[s for g in c.synonyms for s in g], *c.related], c.adjacent, c.excludes, c.negative) for c in catalog.concepts]
    raw = spark.createDataFrame(rows, "name string, family string, title string, aliases array<string>, abbreviations array<string>, synonyms array<array<string>>, all array<string>, adjacent array<string>, excludes array<string>, negative array<string>")
    normal = lambda c: F.transform(c, X.normal_title)
    done = raw.select(
        "name", "family", X.normal_title(F.col("title")).alias("title"), normal("aliases").alias("aliases"), normal("abbreviations").alias("abbreviations"),
        F.transform("synonyms", normal).alias("synonyms"), F.array_distinct(F.flatten(F.transform("all", lambda p: X.meaningful(X.normal_title(p))))).alias("tokens"),
        F.array_distinct(F.flatten(F.transform("all", lambda p: X.phrases(X.meaningful(X.normal_title(p)), 2, 3)))).alias("phrases"),
        X.head_word(X.normal_title(F.col("title"))).alias("head"), "adjacent", "excludes", normal("negative").alias("negative"),
    )
    families = spark.createDataFrame([(f.name, f.group, f.positive, f.negative) for f in catalog.families], "name string, grp string, positive array<string>, negative array<string>")
    families = families.select("name", "grp", normal("positive").alias("positive"), normal("negative").alias("negative"))
    pack = lambda df: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns))))).first()[0]
    return Prepared(pack(done), pack(families), catalog)


def standard() -> Catalog:
    """Ten families of five roles each, made by rule: fields of work, the head word of their titles, and words that stand for it."""
    plan = {
        "software_engineering": ("engineering", "engineer", ["developer", "programmer"], ["software", "backend", "frontend", "full stack", "mobile"]),
        "data_platform": ("engineering", "engineer", ["developer"], ["data", "etl", "data platform", "data warehouse", "big data"]),
        "data_analytics": ("analysis", "analyst", ["specialist"], ["data", "business", "reporting", "financial", "marketing analytics"]),
        "ai_ml_science": ("engineering", "scientist", ["researcher"], ["data", "machine learning", "applied ai", "deep learning", "computer vision"]),
        "product": ("management", "manager", ["owner"], ["product", "technical product", "growth product", "platform product", "digital product"]),
        "cloud_devops_security": ("engineering", "engineer", ["administrator", "specialist"], ["devops", "cloud", "site reliability", "security", "network"]),
        "quality_assurance": ("quality", "tester", ["engineer", "analyst"], ["qa", "quality assurance", "test automation", "performance test", "manual test"]),
        "design_research": ("design", "designer", ["researcher"], ["ux", "ui", "interaction", "visual", "service design"]),
        "talent_acquisition": ("recruiting", "recruiter", ["sourcer", "coordinator"], ["technical", "talent acquisition", "executive", "campus", "hr"]),
        "architecture_solutions": ("solutions", "architect", ["consultant"], ["solutions", "enterprise", "cloud solutions", "integration", "security solutions"]),
    }
    families, concepts = [], []
    for family, (group, head, others, fields) in plan.items():
        families.append(Family(family, group, [f"{f} {h}" for f in fields for h in (head, *others)]))
        names = [f"{f} {head}".replace(" ", "_") for f in fields]
        for f, name in zip(fields, names):
            concepts.append(Concept(name, family, f"{f} {head}", [f"{f} {h}" for h in others], [], [[f], [head, *others]], [n for n in names if n != name]))
    return Catalog(families, concepts)


def postings(spark: SparkSession, ready: Prepared) -> DataFrame:
    """``alias, names``: a row for each phrase and word of the catalog, with the concepts that it speaks for."""
    found: dict[str, set[str]] = {}
    for c in ready.plain().values():
        for p in [c["title"], *c["aliases"], *c["abbreviations"], *c["tokens"], *c["phrases"], *(s for g in c["synonyms"] for s in g)]:
            if p:
                found.setdefault(p, set()).add(c["name"])
    return spark.createDataFrame([(p, sorted(n)) for p, n in sorted(found.items())], "alias string, names array<string>")


def met_concepts(rows: DataFrame, ready: Prepared) -> DataFrame:
    """``rows`` with ``pool``: the concepts whose phrases stand in a title's signal or normal form."""
    spark = rows.sparkSession
    texts = rows.select("title", F.explode(F.array_distinct(F.array("signal", "normal"))).alias("said"))
    said = texts.select("said").where("said <> ''").distinct()
    names = phrase_matches(said, postings(spark, ready), "said", X.tokens(F.col("said"))).select("said", F.explode("names").alias("name")).distinct()
    # a catalog's concepts at most
    pools = texts.join(names, "said").groupBy("title").agg(F.collect_set("name").alias("met"))
    pool = F.filter(ready.column(), lambda c: F.coalesce(F.array_contains("met", c["name"]), F.lit(False)))
    return rows.join(pools, "title", "left").withColumn("pool", pool).drop("met")


def _within(normal: Column, phrase: Column) -> Column:
    return (phrase != "") & F.contains(normal, phrase)


def _score_concept(c: Column, normal: Column, means: Column, head: Column, family: Column) -> Column:
    """What a title says for a concept."""
    count = lambda a, f: F.size(F.filter(a, f))
    some = lambda a, f: F.exists(a, f)
    points = lambda test, name: F.when(F.coalesce(test, F.lit(False)), WEIGHTS[name]).otherwise(0)
    synonyms = count(c["synonyms"], lambda g: some(g, lambda p: _within(normal, p) | F.array_contains(means, p)))
    stands = F.coalesce((head == c["head"]) | F.array_contains(F.array(*[F.lit(f"{a}>{b}") for a, b in STAND_INS]), F.concat(head, F.lit(">"), c["head"])), F.lit(True))
    return (
        points(_within(normal, c["title"]), "canonical") + points(some(c["aliases"], lambda a: _within(normal, a)), "alias") + synonyms * WEIGHTS["synonym"]
        + F.size(F.array_intersect(c["tokens"], means)) * WEIGHTS["token"] + count(c["phrases"], lambda p: _within(normal, p)) * WEIGHTS["phrase"]
        + points((F.size(means) > 0) & F.forall(means, lambda t: F.array_contains(c["tokens"], t)), "covered")
        + points((F.size(c["tokens"]) > 0) & F.forall(c["tokens"], lambda t: F.array_contains(means, t)), "core")
        + F.when(stands, WEIGHTS["head"]).otherwise(WEIGHTS["no_head"])
        + F.when(family.isNull(), 0).when(family == c["family"], WEIGHTS["family"]).otherwise(WEIGHTS["other_family"])
        + points(some(c["negative"], lambda n: _within(normal, n)), "negative")
    ).cast("int")


def _group(head: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), head)


def analyze(titles: DataFrame, ready: Prepared, column: str = "title") -> DataFrame:
    """A row for each distinct title: normal and stripped form, head, words, family, concepts, primary concept, alias kind, group.

    A family needs keywords or its head's group, a least score and a lead; a concept
    becomes primary through the longest alias, or through signals that lead it clearly.
    """
    worth = lambda k: 90 + 25 * (F.size(F.split(k, " ")) - 1)
    rows = titles.select(F.col(column).alias("title")).where(F.col("title").isNotNull()).distinct()
    rows = rows.withColumn("normal", X.normal_title(F.col("title")))
    rows = rows.withColumn("stripped", X.strip_seniority(F.col("normal")))
    rows = rows.withColumn("signal", F.when(F.col("stripped") != "", F.col("stripped")).otherwise(F.col("normal")))
    rows = rows.withColumn("head", X.head_word(F.col("signal"))).withColumn("words", X.meaningful(F.col("signal"))).withColumn("seniority", X.seniority(F.col("normal")))

    def family_score(f: Column) -> Column:
        plus, minus = (F.filter(f[k], lambda p: _within(F.col("signal"), p)) for k in ("positive", "negative"))
        total = F.aggregate(plus, F.lit(0), lambda s, k: s + worth(k)) - F.aggregate(minus, F.lit(0), lambda s, k: s + worth(k) + 20)
        total = total + F.when(_group(F.col("head")) == f["grp"], 35 + 95).otherwise(0)
        return F.struct(total.cast("int").alias("score"), F.size(plus).alias("hits"), f["name"].alias("family"), f["grp"].alias("grp"))

    rows = rows.withColumn("families", F.sort_array(F.transform(ready.family_column(), family_score), asc=False))
    best, second = F.try_element_at("families", F.lit(1)), F.try_element_at("families", F.lit(2))
    least = F.when(best["hits"] > 0, 120).otherwise(150)
    sure = (F.col("signal") != "") & (best["score"] >= least) & (second.isNull() | (best["score"] >= second["score"] + 20))
    rows = rows.withColumn("family", F.when(sure, best["family"]))
    scored = lambda c: F.struct(_score_concept(c, F.col("signal"), F.col("words"), F.col("head"), F.col("family")).alias("score"), c["title"].alias("title"), c["name"].alias("name"), c["family"].alias("family"), c["tokens"].alias("tokens"))
    floor = F.when(F.col("family").isNull(), RELATED).otherwise(RELATED - 20)
    fits = lambda s: (s["score"] >= floor) & (F.col("family").isNull() | (s["family"] == F.col("family")) | (s["score"] >= PRIMARY))
    order = lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0)
    rows = met_concepts(rows, ready)
    rows = rows.withColumn("scores", F.transform("pool", scored))
    rows = rows.withColumn("candidates", F.slice(F.array_sort(F.filter("scores", fits), order), 1, MOST))
    covers = lambda tokens: (F.size("words") <= 1) | F.forall("words", lambda w: F.array_contains(tokens, w))
    by_signal = F.try_element_at(F.filter("candidates", lambda s: (s["score"] >= PRIMARY) & covers(s["tokens"])), F.lit(1))

    def named(c: Column) -> Column:
        kinds = F.concat(
            F.array(F.struct(F.lit(3).alias("rank"), c["title"].alias("phrase"))), F.transform(c["aliases"], lambda p: F.struct(F.lit(2).alias("rank"), p.alias("phrase"))),
            F.transform(c["abbreviations"], lambda p: F.struct(F.lit(1).alias("rank"), p.alias("phrase"))),
        )
        inside = lambda p: F.concat(F.lit(" "), F.col("normal"), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))
        ok = lambda p: inside(p) & ((p == F.col("signal")) | covers(c["tokens"]))
        return F.transform(F.filter(kinds, lambda k: ok(k["phrase"])), lambda k: F.struct(F.size(F.split(k["phrase"], " ")).alias("n"), F.length(k["phrase"]).alias("size"), k["rank"].alias("rank"), c["name"].alias("name"), c["family"].alias("family"), c["title"].alias("canonical")))

    rows = rows.withColumn("by_signal", by_signal).withColumn("aliases", F.sort_array(F.flatten(F.transform("pool", named)), asc=False))
    rows = rows.withColumn("by_alias", F.try_element_at("aliases", F.lit(1)))
    alias_score = F.try_element_at(F.filter("scores", lambda s: s["name"] == F.col("by_alias.name")), F.lit(1))["score"]
    overruled = F.col("by_signal").isNotNull() & (F.col("by_signal.name") != F.col("by_alias.name")) & (F.col("by_signal.score") >= alias_score + LEAD)
    primary = F.when(F.col("by_alias").isNull() | F.coalesce(overruled, F.lit(False)), F.col("by_signal.name")).otherwise(F.col("by_alias.name"))
    rows = rows.withColumn("concept", primary)
    matched = F.array_distinct(F.concat(F.transform("aliases", lambda a: a["name"]), F.array_compact(F.array("by_signal.name"))))
    of_concept = F.try_element_at(F.filter("pool", lambda c: c["name"] == F.col("concept")), F.lit(1))
    kind = F.element_at(F.array(F.lit("abbreviation"), F.lit("alias"), F.lit("canonical")), F.col("by_alias.rank"))
    family = F.coalesce(of_concept["family"], F.col("family"))
    group_of = F.try_element_at(F.filter(ready.family_column(), lambda f: f["name"] == family), F.lit(1))["grp"]
    return rows.select(
        "title", "normal", "stripped", "head", "words", "seniority", family.alias("family"), F.coalesce(group_of, _group(F.col("head"))).alias("role_group"), "concept",
        matched.alias("concepts"), F.when(F.col("by_alias").isNotNull(), kind).alias("alias_kind"), F.transform("candidates", lambda s: s["name"]).alias("candidates"),
    )


def adjacency(catalog: Catalog) -> list[str]:
    """Pairs "a>b" of adjacent concepts, both ways."""
    pairs = {(c.name, a) for c in catalog.concepts for a in c.adjacent}
    return sorted(f"{a}>{b}" for a, b in pairs | {(b, a) for a, b in pairs} if a != b)


def relatedness(q, ready: Prepared, same_group: Column, shared: Column) -> Column:
    """Points for two concepts of one broad family: same group, shared neighbours, one in the other's expansion, shared words; 0 to 560."""
    catalog = ready.source
    mine = next((c for c in catalog.concepts if c.name == q["concept"]), None)
    if mine is None or mine.family not in BROAD_FAMILIES:
        return F.lit(0)
    rest = [c for c in catalog.concepts if c.family == mine.family]
    near = [c.name for c in rest if set(c.adjacent) & set(mine.adjacent)]
    family = F.coalesce(F.col("concept").isin([c.name for c in rest]), F.lit(False))
    in_query = F.coalesce(F.col("concept").isin([*(q["concepts"] or []), *(q["candidates"] or [])]), F.lit(False)) if q["concepts"] or q["candidates"] else F.lit(False)
    in_job = F.coalesce(F.array_contains("concepts", mine.name) | F.array_contains("candidates", mine.name), F.lit(False))
    neighbours = F.coalesce(F.col("concept").isin(near), F.lit(False)) if near else F.lit(False)
    points = 430 + F.when(same_group, 45).otherwise(0) + F.when(neighbours, 35).otherwise(0) + F.when(in_query | in_job, 30).otherwise(0) + shared * 25
    return F.when(family & (same_group | in_query | in_job), F.least(F.lit(560), points)).otherwise(0)


def match(analyzed: DataFrame, query: str, ready: Prepared, mode: str = "balanced") -> DataFrame:
    """Add tier, score and whether it matches, of each analysed title against one query.

    Tiers: the same title, the same without seniority, a shared concept (canonical, alias
    or abbreviation), an adjacent concept, the same family, shared words. Conflicts of
    family or concept take points from the last three tiers and void them.
    """
    spark = analyzed.sparkSession
    q = analyze(spark.createDataFrame([(query,)], "title string"), ready).first()
    lit_array = lambda v: X.words(list(v or []))
    words, concepts = lit_array(q["words"]), lit_array(q["concepts"])
    shared = F.array_intersect(words, F.col("words"))
    n = F.size(shared)
    both = F.array_intersect(concepts, F.col("concepts"))
    pairs = F.flatten(F.transform(concepts, lambda a: F.transform("concepts", lambda b: F.concat(a, F.lit(">"), b))))
    adjacent = F.arrays_overlap(pairs, lit_array(adjacency(ready.source)))
    same_family = F.coalesce(F.col("family") == F.lit(q["family"]), F.lit(False))
    same_group = F.coalesce(F.col("role_group") == F.lit(q["role_group"]), F.lit(False))
    other_family = F.coalesce(F.col("family") != F.lit(q["family"]), F.lit(False)) & ~F.coalesce(adjacent, F.lit(False))
    excludes = {c.name: c.excludes for c in ready.source.concepts}
    barred = F.col("concept").isin(excludes.get(q["concept"], [])) if excludes.get(q["concept"]) else F.lit(False)
    bars = F.col("concept").isin([k for k, v in excludes.items() if q["concept"] in v]) if any(q["concept"] in v for v in excludes.values()) else F.lit(False)
    hard = other_family | F.coalesce(barred | bars, F.lit(False))
    covered = (F.size(words) > 0) & (n == F.size(F.array_distinct(words)))
    job_covered = (F.size("words") > 0) & (n == F.size(F.array_distinct("words")))
    abbreviated = F.coalesce(F.col("alias_kind") == "abbreviation", F.lit(False)) | F.lit(q["alias_kind"] == "abbreviation")
    aliased = F.coalesce(F.col("alias_kind") == "alias", F.lit(False)) | F.lit(q["alias_kind"] == "alias")
    concept_tier = F.when(abbreviated, "abbreviation").when(aliased, "synonym").otherwise("canonical_variant")
    concept_score = F.when(abbreviated, 760).when(aliased, 820).otherwise(880)
    related = relatedness(q, ready, same_group, n)
    family_score = F.least(F.lit(620), 440 + n * 55 + F.when(same_group, 40).otherwise(0) + F.when(covered, 35).otherwise(0) + related)
    word_score = F.least(F.lit(460), 250 + n * 70 + 50 + F.when(covered, 60).otherwise(0) + F.when(job_covered, 20).otherwise(0))
    empty = (F.col("normal") == "") | F.lit(q["normal"] == "")
    same, stripped = F.col("normal") == q["normal"], (F.col("stripped") == q["stripped"]) & (F.col("stripped") != "")
    tests = [
        (empty, "none", F.lit(0)), (same, "exact", F.lit(1000)), (stripped, "canonical_variant", F.lit(900)), (F.size(both) > 0, concept_tier, concept_score),
        (hard, "none", F.lit(0)), (F.coalesce(adjacent, F.lit(False)), "adjacent_concept", F.lit(640)), (same_family & (n > 0), "same_family_related", family_score),
        (same_family & (related > 0), "same_family_related", related),
        ((n > 0) & same_group, "generic_token_overlap", word_score),
    ]
    tier, score = None, None
    for test, name, points in tests:
        label = name if isinstance(name, Column) else F.lit(name)
        tier = F.when(test, label) if tier is None else tier.when(test, label)
        score = F.when(test, points) if score is None else score.when(test, points)
    out = analyzed.withColumn("tier", tier.otherwise("none")).withColumn("score", score.otherwise(0).cast("int")).withColumn("shared", shared)
    return out.withColumn("matches", (F.col("tier") != "none") & (F.col("score") >= THRESHOLDS[mode]))
