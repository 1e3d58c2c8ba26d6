"""Text column functions. All run inside the JVM on whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import constants as C

# Unicode white space and the separators U+001C to U+001F, where Python's
# str.split cuts. The (?U) class is one test per character, so it is fast.
BLANK = r"\s\x{1C}-\x{1F}"
WORD = rf"(?U)[^{BLANK}]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """White-space separated words; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def unique_word_ratio(text: Column) -> Column:
    """Distinct words over words plus one; empty text gives 0."""
    return unique_ratio_of(words(text))


def unique_ratio_of(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens)).cast("double") / (F.size(tokens) + 1).cast("double")


def delimiter_count(text: Column, delimiter: str) -> Column:
    """Occurrences of the delimiter plus one; null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    removed = F.length(whole) - F.length(F.replace(whole, F.lit(delimiter), F.lit("")))
    return (removed / len(delimiter)).cast("int") + 1


def has_any(text: Column, keywords: Sequence[str], lowered: bool = False) -> Column:
    """Whether any keyword occurs, ignoring case; null text has none."""
    searched = text if lowered else F.lower(text)
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(searched, F.lit(keyword.lower()))
    return F.coalesce(found, F.lit(False))


def keyword_flag(text: Column, keywords: Sequence[str], lowered: bool = False) -> Column:
    return has_any(text, keywords, lowered).cast("int")


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def concat_nonempty(parts: Sequence[Column], separator: str = "\n") -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(separator, *[F.nullif(part, F.lit("")) for part in parts])


def blank_to_token(text: Column, token: str = C.BLANK_TOKEN) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(strip(whole) == "", token).otherwise(whole)


def title_fallback(candidates: Sequence[Column], text: Column, width: int = 200) -> Column:
    """First usable title, else the first line of the text cut to ``width``."""
    usable = [F.nullif(F.nullif(c, F.lit("")), F.lit("nan")) for c in candidates]
    return F.coalesce(*usable, F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, width))


def from_marker(text: Column, markers: Sequence[str] = tuple(C.CRITERIA_MARKERS)) -> Column:
    """Text from the first listed marker that occurs, else all of it."""
    lowered = F.lower(text)
    found = F.lit(None).cast("string")
    for marker in reversed(markers):
        at = F.instr(lowered, marker)
        found = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(found)
    return F.coalesce(found, text)


def title_case(text: Column) -> Column:
    """Capital first letter for every run of letters."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    capital = lambda run: F.concat(F.upper(run.substr(1, 1)), F.substr(run, F.lit(2)))
    return F.array_join(F.transform(runs, capital), "")


def section_headers(text: Column) -> Column:
    """Names in ``--- NAME ---`` lines, title-cased, in order, without repeats."""
    names = F.regexp_extract_all(text, F.lit(r"(?dm)^--- (.+?) ---$"), 1)
    return F.array_distinct(F.transform(names, lambda name: title_case(strip(name))))


def list_sections(text: Column, extra: Column | None = None) -> Column:
    """Headers of the text, then other section names, else the default choices."""
    found = section_headers(F.coalesce(text, F.lit("")))
    if extra is not None:
        found = F.array_distinct(F.concat(found, F.coalesce(extra, F.array().cast("array<string>"))))
    default = F.array(*[F.lit(name) for name in C.DEFAULT_SECTIONS])
    return F.when(F.size(found) == 0, default).otherwise(found)


def section_block(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"--- {name.upper()} ---\n"), text)


def section_blocks(parts: Mapping[str, Column]) -> Column:
    """Non-null parts as titled blocks, one blank line apart."""
    return F.concat_ws("\n\n", *[section_block(name, text) for name, text in parts.items()])


def extract_section(
    text: Column,
    section: Column,
    markers: Mapping[str, Sequence[str]] = C.SECTION_MARKERS,
    before: int = C.SECTION_WINDOW_BEFORE,
    after: int = C.SECTION_WINDOW_AFTER,
) -> Column:
    """Body of a named section.

    A titled block runs to the next title. Without one, the first marker of a
    section keyword opens a window; without any, the window opens at the start.
    """
    lowered = F.lower(text)
    named = F.lower(section)

    def position(marker: str) -> Column:
        return F.instr(lowered, marker)

    def window(at: Column) -> Column:
        start = F.greatest(at - before, F.lit(1))
        return strip(F.substring(text, start, at + after - start))

    by_marker = F.lit(None).cast("string")
    for key, choices in reversed(list(markers.items())):
        first = F.lit(0)
        for marker in reversed(list(choices)):
            first = F.when(position(marker) > 0, position(marker)).otherwise(first)
        by_marker = F.when(
            F.contains(named, F.lit(key)) & (first > 0), window(first)
        ).otherwise(by_marker)

    header = F.concat(F.lit("--- "), F.upper(section), F.lit(" ---"))
    at = F.position(header, text)
    tail = F.substring(text, at + F.length(header), F.length(text))
    body = F.split(tail, r"(?d)\n--- .+? ---", 2)[0]
    by_header = strip(F.concat(header, body))

    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "")
        .when(F.startswith(section, F.lit("(")), text)
        .when(at > 0, by_header)
        .otherwise(F.coalesce(by_marker, strip(F.substring(text, 1, after))))
    )


def terms(text: Column) -> Column:
    """Lower-case terms of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def replies_to_list(raw: Column, limit: int = 3) -> Column:
    """Suggestions in a reply: a JSON list, else numbered lines, else the text."""
    whole = F.coalesce(raw, F.lit(""))
    opened = F.regexp_replace(strip(whole), rf"(?U)^```(?:json)?[{BLANK}]*", "")
    cleaned = F.regexp_replace(opened, rf"(?U)[{BLANK}]*```$", "")
    listed = F.from_json(cleaned, "rewrites array<string>")["rewrites"]
    trimmed = F.filter(F.transform(listed, strip), lambda item: item != "")
    parts = F.filter(
        F.transform(F.split(whole, rf"(?U)\n[{BLANK}]*\p{{Nd}}+[.):][{BLANK}]+"), strip),
        lambda item: item != "",
    )
    return (
        F.when(F.size(listed) > 0, trimmed)
        .when(F.size(parts) >= 2, F.slice(parts, 1, limit))
        .when(strip(whole) != "", F.array(strip(whole)))
        .otherwise(F.array(F.lit(C.NO_SUGGESTIONS)))
    )


def apply_suggestion(suggestions: Column, text: Column, index: Column) -> Column:
    """Append the chosen numbered line to the text; out of range changes nothing."""
    lines = F.transform(F.split(suggestions, "\n"), strip)
    numbered = F.filter(
        lines,
        lambda line: (F.length(line) > 2)
        & line.rlike(r"^\p{Nd}")
        & F.contains(line, F.lit(". ")),
    )
    bodies = F.transform(numbered, lambda line: F.substr(line, F.instr(line, ". ") + 2))
    chosen = F.get(bodies, index)
    revised = F.concat(text, F.lit(f"\n\n{C.REVISION_MARK}: "), chosen)
    return F.coalesce(revised, text)
