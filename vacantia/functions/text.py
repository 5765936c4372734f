"""Text functions over columns: comparable text, titles, slugs, HTML, snippets.

All are built-in expressions and stay inside generated code, except that folding
accents has no built-in: it is a ``translate`` over a table made from Unicode's own
decompositions.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the title grammar.
SENIORITY_PHRASES = [
    "new grad", "new graduate", "recent grad", "recent graduate", "entry level", "early career", "mid level", "associate level",
]
SENIORITY_WORDS = [
    "associate", "distinguished", "fellow", "intern", "internship", "jr", "junior", "lead", "mid", "principal", "senior", "sr", "staff",
    "trainee", "apprentice", "ii", "iii", "iv", "v",
]
STOP_WORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
HEAD_WORDS = [
    "analyst", "architect", "administrator", "consultant", "coordinator", "designer", "developer", "engineer", "manager", "owner",
    "researcher", "recruiter", "scientist", "staff", "specialist", "sourcer", "tester", "writer",
]
# Rewrites of a title, in this order, before punctuation goes.
TITLE_REWRITES = [
    (r"&", " and "), (r"\bfront[\s-]*end\b", "frontend"), (r"\bback[\s-]*end\b", "backend"), (r"\bfull[\s-]*stack\b", "full stack"),
    (r"\bml[\s-]*ops\b", "mlops"), (r"\bpre[\s-]*sales\b", "pre sales"), (r"\bsite reliability engineer\b", "sre"),
    (r"\bmember(?:\s+of)?\s+technical\s+staff\b", "member of technical staff"), (r"\bprod(?:uct)?\s+mgr\b", "product manager"),
    (r"\btech(?:nical)?\s+pm\b", "technical product manager"),
]


def _folds() -> tuple[str, str]:
    """Letters whose compatibility decomposition leaves one ASCII character."""
    pairs = {}
    for code in range(0x80, 0x2E80):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(plain) == 1:
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folds()


def words(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def comparable(value: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 a single space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", " "))


def slug_to_label(value: Column) -> Column:
    """Words between hyphens, underscores and spaces with their first letter in upper case."""
    parts = F.filter(F.split(text(value), r"[-_\s]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")


def ascii_folded(value: Column) -> Column:
    """Accents off, what then is not ASCII dropped."""
    given = text(value)
    folded = F.regexp_replace(F.translate(given, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(given) == F.length(given), given).otherwise(folded)  # a byte a character: nothing to fold


def normal_title(value: Column) -> Column:
    """The form in which titles are compared."""
    out = F.lower(ascii_folded(value))
    for pattern, to in TITLE_REWRITES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def contains_phrase(normal: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand together in a normal text."""
    return F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {phrase} ")


def remove_phrase(normal: Column, phrase: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normal, rf"(^| ){re.escape(phrase)}(?= |$)", " "), r"\s+", " "))


def _spaced(normal: Column) -> Column:
    """Every word of a normal text between spaces of its own, so that phrases go without a regular expression."""
    return F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("  ")), F.lit(" "))


def _spaced_phrase(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


def without_phrases(normal: Column) -> Column:
    left = _spaced(normal)
    for phrase in SENIORITY_PHRASES:
        left = F.replace(left, F.lit(_spaced_phrase(phrase)), F.lit(""))
    return F.trim(F.replace(left, F.lit("  "), F.lit(" ")))


def strip_seniority(normal: Column) -> Column:
    """A normal title without the phrases and words of seniority."""
    return F.array_join(F.filter(tokens(without_phrases(normal)), lambda t: ~t.isin(SENIORITY_WORDS)), " ")


def seniority(normal: Column) -> Column:
    """Phrases, then words of seniority, in order, each once."""
    # a fold, as each phrase looks at what the ones before it left: an expression for each would repeat theirs
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(_spaced_phrase(p)).alias("spaced")) for p in SENIORITY_PHRASES])
    start = F.struct(_spaced(normal).alias("left"), words([]).alias("found"))
    hit = lambda s, p: F.when(F.contains(s["left"], p["spaced"]), F.concat(s["found"], F.array(p["phrase"]))).otherwise(s["found"])
    step = lambda s, p: F.struct(F.replace(s["left"], p["spaced"], F.lit("")).alias("left"), hit(s, p).alias("found"))
    single = lambda s: F.filter(tokens(s["left"]), lambda t: t.isin(SENIORITY_WORDS))
    return F.aggregate(phrases, start, step, lambda s: F.array_distinct(F.concat(s["found"], single(s))))


def head_word(normal: Column) -> Column:
    """The last word that names a role; null if there is none."""
    found = F.filter(tokens(normal), lambda t: t.isin(HEAD_WORDS))
    return F.try_element_at(found, F.lit(-1))


def meaningful(normal: Column) -> Column:
    """Words other than the head and the stop words."""
    head = head_word(normal)
    return F.filter(tokens(normal), lambda t: ~t.isin(STOP_WORDS) & ~t.eqNullSafe(head))


def phrases(parts: Column, least: int = 1, most: int = 3) -> Column:
    """Runs of ``least`` to ``most`` neighbouring words, longest first, each once."""

    def runs_of(n: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))
        return F.when(F.size(parts) >= n, run).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs_of, range(most, least - 1, -1))))


def replace_head(normal: Column, old: str, new: str) -> Column:
    """The last word ``old`` of a normal title made ``new``."""
    parts = tokens(normal)
    at = F.size(parts) - F.array_position(F.reverse(parts), old).cast("int")
    return F.when(F.array_contains(parts, old), F.array_join(F.transform(parts, lambda t, i: F.when(i == at, F.lit(new)).otherwise(t)), " ")).otherwise(normal)


def distinct_texts(values: Column) -> Column:
    """Trimmed, without empty ones, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.array_compact(values), lambda v: F.trim(v)), lambda v: v != ""))


ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]


def _character(reference: Column) -> Column:
    """What a numeric reference stands for, as one unit of UTF-16."""
    code = F.when(F.lower(reference).startswith("&#x"), F.conv(F.regexp_extract(reference, "(?i)&#x([0-9a-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(reference, r"&#(\d+);", 1)).try_cast("long")
    return F.decode(F.unhex(F.lpad(F.hex(F.coalesce(code, F.lit(0xFFFD)) % 65536), 4, "0")), "UTF-16BE")


def decode_entities(value: Column) -> Column:
    """Named references of the list, then numeric ones."""
    for entity, plain in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(plain))
    numeric = F.array_distinct(F.regexp_extract_all(value, F.lit("(?i)&#(?:x[0-9a-f]+|[0-9]+);"), F.lit(0)))
    return F.when(value.contains("&#"), F.aggregate(numeric, value, lambda out, r: F.replace(out, r, _character(r)))).otherwise(value)


def strip_html(value: Column) -> Column:
    """Text of a fragment: scripts, styles and tags out, entities decoded, white space collapsed."""
    out = F.regexp_replace(text(value), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def snippet(value: Column, most: int = 280) -> Column:
    """The text without tags, cut to ``most`` characters with three dots; null if blank."""
    out = F.trim(F.regexp_replace(F.regexp_replace(value, r"<[^>]+>", " "), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(out, 1, most - 3)), F.lit("..."))
    return F.when(out != "", F.when(F.length(out) <= most, out).otherwise(cut))
