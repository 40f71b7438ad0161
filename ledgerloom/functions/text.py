"""Text functions as column expressions; all run inside code generation."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns, thresholds and forms of the source format (fixed values), down to FORMS.
SPECIALS = r'[+\-&|!(){}\[\]^"~*?:\\/]'
SECTION = r"\b(\d+\.\d+)(?:\.\d+)*\b"
CREDITS = r"\b[Bb]y:\s*([^.;\n]{2,60})"
JUNK = {"shortest": 30, "tags": 3, "letters": 0.55, "tokens": 12, "single": 0.3, "phrases": ("©", "all rights reserved", "isbn")}
STOP_TOKENS = ("the", "of", "and", "&")
CORPORATE = ("company", "corporation", "incorporated")
#: Whole-word replacements in the order in which they apply (fixed values).
FORMS = (
    ("company", "company"), ("co", "company"), ("corporation", "corporation"), ("corp", "corporation"), ("inc", "incorporated"),
    ("incorporated", "incorporated"), ("rail road", "railroad"), ("rail-road", "railroad"),
)


def strip_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<[^>]+>", ""))


def note_content(parts: Column) -> Column:
    """Parts of a note joined by a space, without tags."""
    return strip_markup(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))


def relation_type(relator: Column) -> Column:
    return F.upper(F.regexp_replace(relator, r"[^a-zA-Z0-9]", "_"))


def relation_constant(name: Column, prefix: str = "RICO_") -> Column:
    """camelCase to PREFIX_SCREAMING_SNAKE."""
    return F.concat(F.lit(prefix), F.upper(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")))


def humanised(relation: Column, nature: Column | None = None, prefix: str = "RICO_") -> Column:
    plain = F.lower(F.replace(F.regexp_replace(relation, f"^{prefix}", ""), F.lit("_"), F.lit(" ")))
    return plain if nature is None else F.coalesce(F.nullif(nature, F.lit("")), plain)


def credits(text: Column) -> Column:
    """Names after `By:`, first seen first."""
    found = F.regexp_extract_all(text, F.lit(CREDITS), F.lit(1))
    names = F.flatten(F.transform(found, lambda x: F.split(x, r"\s+and\s+|\s*,\s*|\s*&\s*")))
    tidy = F.transform(names, lambda x: F.trim(F.regexp_replace(F.trim(x), r",$", "")))
    return F.array_distinct(F.filter(tidy, lambda x: F.length(x) >= 2))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def estimated_tokens(text: Column) -> Column:
    return (F.floor(F.length(text) / 4) + 1).cast("long")


def normal_name(name: Column) -> Column:
    """Lower case, no punctuation, no trailing life dates, corporate forms spelled out."""
    out = F.regexp_replace(F.lower(name), r"""[.,;:'"()\[\]]""", " ")
    out = F.trim(F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"\s+", " "))
    out = F.trim(F.regexp_replace(out, r"\s*\b\d{4}\s*-\s*(\d{4})?$", ""))
    for form, full in FORMS:
        out = F.regexp_replace(out, rf"\b{re.escape(form)}\b", full)
    return out


def plain_name(name: Column) -> Column:
    """The simpler normal form used within one collection."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"""[.,;:'"()\[\]]""", " "), r"\s+", " "))


def name_tokens(normal: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(normal, " "), lambda t: t != "")), F.array(*map(F.lit, STOP_TOKENS)))


def core_name(normal: Column) -> Column:
    return F.array_join(F.filter(F.split(normal, r"\s+"), lambda t: (t != "") & ~t.isin(*CORPORATE)), " ")


def year_of(value: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(value, r"\b(\d{4})\b", 1), F.lit("")), F.lit("9999")).cast("int")


def is_junk(text: Column) -> Column:
    """Six rules: too short, table markup, imprint phrases, few letters, single-character tokens."""
    length, low = F.length(text), F.lower(text)
    tags = F.regexp_count(text, F.lit("<td>")) + F.regexp_count(text, F.lit("</tr>"))
    letters = F.regexp_count(text, F.lit(r"[\p{L}\s]"))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    rules = [F.length(F.trim(text)) < JUNK["shortest"], tags >= JUNK["tags"], *(low.contains(x) for x in JUNK["phrases"]), letters < JUNK["letters"] * length]
    return functools.reduce(lambda a, b: a | b, rules) | ((F.size(tokens) >= JUNK["tokens"]) & (single > JUNK["single"] * F.size(tokens)))


def redacted(text: Column, denied: list[str]) -> Column:
    """Without sentences that mention a denied name."""
    names = "|".join(map(re.escape, denied))
    return F.array_join(F.filter(F.split(text, r"(?<=[.;!?])\s+"), lambda s: ~s.rlike(names)), " ")


def csv_cell(text: Column, guard: bool = True) -> Column:
    """White space collapsed, formulas guarded, quoted where needed."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    if guard:
        out = F.when(out.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), out)).otherwise(out)
    return F.when(out.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(out, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(out)


def markdown_cell(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.replace(F.replace(F.replace(flat, F.lit("|"), F.lit("\\|")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def slug(text: Column, fallback: str = "chart") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.left(made, F.lit(60)), F.lit("")), F.lit(fallback))


def within_budget(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def safe_path(path: Column) -> Column:
    """Relative path without `.` parts; null if any part is `..` or nothing is left."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def json_object(text: Column) -> Column:
    """The outermost JSON object of a model's answer, without thoughts or fences."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def tool_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"^functions?[.:/]", ""))), r"[_\s]+", "-")


def passage_chips(text: Column) -> Column:
    return F.regexp_replace(text, r"\[Passage (\d+)\]", r'<span class="chip" data-passage="$1">$1</span>')


def section_numbers(text: Column) -> Column:
    """`d.d` prefixes of section numbers, in order."""
    return F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))


def lexical_query(topic: str, fuzzy: bool = True) -> dict:
    """Phrase, words and the edits allowed for each, after special characters are stripped."""
    plain = re.sub(r"\s+", " ", re.sub(SPECIALS, " ", topic)).strip() or topic
    words = plain.split(" ")
    edits = {w: (2 if len(w) >= 8 else 1 if len(w) >= 5 else 0) for w in words} if fuzzy else dict.fromkeys(words, 0)
    return {"phrase": plain if len(words) > 1 else None, "phrase_boost": 2.0, "words": words, "edits": edits}


def lexical_query_text(topic: str, fuzzy: bool = True) -> str:
    """The same in the usual syntax of full-text engines."""
    q = lexical_query(topic, fuzzy)
    near = " ".join(f"{w}~{n}" if n else w for w, n in q["edits"].items())
    if q["phrase"] is None:
        return q["words"][0] if near == q["words"][0] else f"{q['words'][0]} OR ({near})"
    parts = [f'"{q["phrase"]}"^2', f"({' '.join(q['words'])})"]
    return " OR ".join(parts + ([f"({near})"] if fuzzy else []))
