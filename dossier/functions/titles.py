"""Job title rules as linear column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import sql_let, sql_list, sql_map, sql_name, sql_replace, sql_text
from .text import UNCOLLAPSED, WHITESPACE, WORD, whole_word

# ---- Fixed values: the word lists and spellings that define the title rules. ----
UNKNOWN_TITLE = "Unknown Title"

CONTRACT_PREFIXES = ["fl", "ft", "pt", "temp", "contract", "freelance"]

SENIORITY_TERMS = [
    "senior", "sr.", "sr", "junior", "jr.", "jr", "lead", "principal", "staff", "intern",
]

PRESERVED_TERMS = {
    "devops": "DevOps",
    "mysql": "MySQL",
    "postgresql": "PostgreSQL",
    "mongodb": "MongoDB",
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "nodejs": "NodeJS",
    "reactjs": "ReactJS",
    "vuejs": "VueJS",
    "angularjs": "AngularJS",
    "dotnet": ".NET",
    "aspnet": "ASP.NET",
    "fullstack": "Fullstack",
    "frontend": "Frontend",
    "backend": "Backend",
    "nosql": "NoSQL",
    "graphql": "GraphQL",
    "restapi": "RESTful API",
    "cicd": "CI/CD",
    "android": "Android",
    "ios": "iOS",
}

SPECIAL_TERMS = {
    "to": "to",
    "xml": "XML",
    "mean": "MEAN",
    "js": "JS",
    "php": "PHP",
    "css": "CSS",
    "html": "HTML",
    "ui": "UI",
    "ux": "UX",
    "api": "API",
    "aws": "AWS",
    "gcp": "GCP",
    "qa": "QA",
    "sre": "SRE",
    "ml": "ML",
    "ai": "AI",
    "ci": "CI",
    "cd": "CD",
    "it": "IT",
}

COMPARISON_STOP_WORDS = ["and", "or", "the", "a", "an", "in", "on", "at", "for", "with", "to"]

COMPARISON_WORDS = {
    "front": "frontend",
    "frontenddev": "frontend developer",
    "back": "backend",
    "full": "fullstack",
    "ui": "user interface",
    "ux": "user experience",
    "dev": "developer",
    "eng": "engineer",
    "engg": "engineering",
    "arch": "architect",
    "cons": "consultant",
}

COMPOUND_WORDS = {"front": "end", "back": "end", "full": "stack"}
# ---- End of fixed values. ----

# Spellings that a repeated pass must recognize again (used with fix_quirks only).
_STABLE_SPELLINGS = {
    **PRESERVED_TERMS,
    ".net": ".NET",
    "asp.net": "ASP.NET",
    "restful": "RESTful",
    "ci/cd": "CI/CD",
}


def _collapsed(value: str) -> str:
    return f"trim({sql_replace(value, [(UNCOLLAPSED, ' ')])})"


def _main_role(title: str, fix_quirks: bool) -> str:
    """Cut the title down to its main role and drop contract and seniority prefixes."""
    if fix_quirks:
        ranks = "|".join(sorted({t.rstrip(".") for t in SENIORITY_TERMS}, key=len, reverse=True))
        seniority = rf"(?i)^{WHITESPACE}*(?:(?:{ranks})(?!{WORD})\.?{WHITESPACE}*)+"
    else:
        # The dots in the list stay wildcards and no word end is asked for.
        seniority = rf"(?i)^(?:{'|'.join(SENIORITY_TERMS)})\.?{WHITESPACE}*"
    return sql_replace(
        title,
        [
            (r"(?s)[;|(].*$", ""),
            (rf"^{WHITESPACE}+|{WHITESPACE}+$", ""),
            ("&", " / "),
            ("(?i)" + whole_word("and"), " / "),
            (whole_word(r"\p{Nd}+"), ""),
            (rf"(?i)^(?:{'|'.join(CONTRACT_PREFIXES)})\.?{WHITESPACE}+", ""),
            (rf"(?s)^{WHITESPACE}*([^,]*?){WHITESPACE}*,.*$", "$1"),
            (seniority, ""),
        ],
    )


def _mark_preserved(role: str) -> str:
    """Lower-case titles with a preserved term and turn each term into a numbered placeholder.

    Only the placeholder with the highest number keeps its upper-case form, and with it its
    replacement; the others stay visible in the result.
    """
    marked = sql_replace(
        "lower(t)", [(whole_word(term), f"__preserved_{i}__") for i, term in enumerate(PRESERVED_TERMS)]
    )
    numbers = r"regexp_extract_all(m, r'__preserved_(\d+)__', 1)"
    last = f"CAST(array_max(transform({numbers}, n -> CAST(n AS int))) AS string)"
    raised = sql_let(
        last, "i", "replace(m, concat('__preserved_', i, '__'), concat('__PRESERVED_', i, '__'))"
    )
    found = f"lower(t) RLIKE {sql_text(whole_word('|'.join(PRESERVED_TERMS)))}"
    return sql_let(role, "t", f"CASE WHEN {found} THEN {sql_let(marked, 'm', raised)} ELSE t END")


def _protect_preserved(role: str) -> str:
    """Lower-case the preserved terms alone, and part them from hyphens (fix_quirks)."""
    terms = "|".join(PRESERVED_TERMS)
    return sql_replace(
        role,
        [
            (rf"(?i)(?<!{WORD})ci\s*/\s*cd(?!{WORD})", "cicd"),
            (rf"(?i)-(?=(?:{terms})(?!{WORD}))", " "),
            (rf"(?i)(?<!{WORD})({terms})-", "$1 "),
            *[("(?i)" + whole_word(term), term) for term in PRESERVED_TERMS],
        ],
    )


def _join_compounds(role: str) -> str:
    """Hyphenated words are joined, slashes are spaced, front end / back end / full stack unite."""
    w = f"({WORD}+)"
    hyphens = [(f"{w}{gap}{w}", "$1$2") for gap in ("-", " -", "- ", " - ")]
    # Most titles have no hyphen; these patterns try every word, so they only run where one is.
    role = sql_let(role, "h", f"CASE WHEN contains(h, '-') THEN {sql_replace('h', hyphens)} ELSE h END")
    steps = [(rf"{WHITESPACE}*/{WHITESPACE}*", " / ")]
    for head, tail in COMPOUND_WORDS.items():
        pattern = "(?i)" + whole_word(rf"{head}(?:{WHITESPACE}|-)*{tail}")
        steps.append((pattern, (head + tail).capitalize()))
    steps.append(("([a-z])([A-Z])", "$1 $2"))
    return sql_replace(role, steps)


def _words(role: str) -> str:
    """Words of the role; neighbours that together spell a compound become one.

    Every word carries its own pair of spaces while compounds are sought, so that matches never
    share one.
    """
    steps = []
    for head, tail in COMPOUND_WORDS.items():
        word = head + tail
        cuts = "|".join(f"{word[:i]}  {word[i:]}" for i in range(1, len(word)))
        steps.append((f"(?i) (?:{cuts}) ", f" {word} "))
    padded = f"concat(' ', replace({_collapsed(role)}, ' ', '  '), ' ')"
    return f"filter(split({sql_replace(padded, steps)}, ' +'), w -> w <> '')"


def _one_pass(title: str, fix_quirks: bool) -> str:
    role = _main_role("title", fix_quirks)
    if fix_quirks:
        role, spellings, placeholders = _protect_preserved(role), {**SPECIAL_TERMS, **_STABLE_SPELLINGS}, {}
    else:
        role, spellings = _mark_preserved(role), SPECIAL_TERMS
        placeholders = {f"__PRESERVED_{i}__": v for i, v in enumerate(PRESERVED_TERMS.values())}
    words = f"filter({_words(_join_compounds(role))}, w -> lower(w) NOT IN {sql_list(SENIORITY_TERMS)})"
    known = f"try_element_at({sql_map(spellings)}, lower(w))"
    if placeholders:
        known += f", try_element_at({sql_map(placeholders)}, w)"
    capitalized = "concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))"
    spelled = f"array_join(transform({words}, w -> coalesce({known}, {capitalized})), ' ')"
    empty = "title IS NULL OR title = ''"
    return sql_let(title, "title", f"CASE WHEN {empty} THEN {sql_text(UNKNOWN_TITLE)} ELSE {_collapsed(spelled)} END")


def standardize(column: str, passes: int = 1, fix_quirks: bool = False) -> Column:
    """Standardized form of a title column; ``passes`` repeats the rules, as chained callers do."""
    value = f"CAST({sql_name(column)} AS string)"
    for _ in range(passes):
        value = _one_pass(value, fix_quirks)
    return F.expr(value).alias(column)


def comparison_key(column: str, fix_quirks: bool = False) -> Column:
    """Key under which near-equal titles meet; null and empty give an empty key."""
    bare = sql_replace(
        f"lower({_one_pass('raw', fix_quirks)})", [(rf"(?!{WORD}|{WHITESPACE})(?s:.)", "")]
    )
    words = f"filter(split({_collapsed(bare)}, ' '), w -> w <> '' AND w NOT IN {sql_list(COMPARISON_STOP_WORDS)})"
    mapped = f"transform({words}, w -> coalesce(try_element_at({sql_map(COMPARISON_WORDS)}, w), w))"
    key = f"CASE WHEN raw IS NULL OR raw = '' THEN '' ELSE array_join({mapped}, ' ') END"
    return F.expr(sql_let(f"CAST({sql_name(column)} AS string)", "raw", key)).alias("title_key")
