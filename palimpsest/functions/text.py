"""Text, label and title expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palimpsest import constants as C


def lit_array(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def casefold(c: Column) -> Column:
    """Lower case with the folds that ``lower`` leaves alone (sharp s, final sigma, long s)."""
    folded = F.lower(c)
    for source, target in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        folded = F.replace(folded, F.lit(source), F.lit(target))
    return folded


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, C.BLANKS, " "))


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def words(c: Column) -> Column:
    """Blank-separated words, none empty."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), strip_blanks), lambda p: p != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip_blanks), lambda s: s != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(C.TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(C.TOKEN))


def search_terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(C.SEARCH_TERM), F.lit(0))


def without_urls(c: Column) -> Column:
    """Query text without web addresses; the text as given when nothing else remains."""
    cleaned = strip_blanks(F.regexp_replace(c, C.URL, ""))
    return F.when(cleaned == "", c).otherwise(cleaned)


def name_key(c: Column) -> Column:
    """Case- and blank-insensitive key of a project name or claim value."""
    return casefold(collapse(c))


def event_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(casefold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def identifier_key(c: Column) -> Column:
    return F.regexp_replace(casefold(c), r"[^\p{L}\p{N}]", "")


def loose_key(c: Column) -> Column:
    """Only letters a-z, digits and single spaces remain."""
    return F.trim(F.regexp_replace(F.regexp_replace(casefold(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def loose_keys(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, loose_key), lambda v: v != ""))


def stable_identifiers(values: Column) -> Column:
    """Identifier-like values named inside free entity strings, in order of appearance."""
    found = F.flatten(F.transform(
        values, lambda v: F.regexp_extract_all(casefold(v), F.lit(C.STABLE_IDENTIFIER), F.lit(0))))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, "[^a-z0-9]", "")))


def identifier_mentions(c: Column) -> Column:
    """Tokens that read like references: letters with digits, or three and more digits.

    One struct per distinct normalised value, first mention kept.
    """
    candidates = F.filter(
        F.regexp_extract_all(c, F.lit(C.IDENTIFIER_TOKEN), F.lit(0)),
        lambda v: (v.rlike("[A-Za-z]") & v.rlike("[0-9]")) | v.rlike("^[0-9]{3,}$"))
    references = F.transform(candidates, lambda v: F.struct(
        F.lit("external_reference").alias("scheme"), v.alias("value"),
        identifier_key(v).alias("normalized_value"), v.alias("mention"), F.lit(0.9).alias("confidence")))
    keys = F.transform(references, lambda r: r["normalized_value"])
    return F.filter(references, lambda r, i: F.array_position(keys, r["normalized_value"]) == i + 1)


def subject_terms(c: Column) -> Column:
    """Distinct descriptive words of at least two characters, stop words left out."""
    found = F.regexp_extract_all(casefold(c), F.lit(C.SUBJECT_TERM), F.lit(0))
    return F.array_except(F.array_distinct(found), lit_array(C.SUBJECT_STOP_TERMS))


def _fit_title(c: Column) -> Column:
    """Shorten to the title length, at a word end when there is one."""
    cut = F.rtrim(F.substring(c, 1, C.TITLE_CHARS))
    return F.when(F.length(c) > C.TITLE_CHARS, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(c)


def title_from_message(c: Column) -> Column:
    clean = collapse(c)
    head = F.array_join(F.slice(F.split(clean, " "), 1, C.TITLE_WORDS), " ")
    title = _fit_title(head)
    return (F.when(clean == "", F.lit(C.DEFAULT_TITLE))
            .when(F.length(clean) > F.length(title), F.concat(title, F.lit("…")))
            .otherwise(title))


def clean_title(c: Column) -> Column:
    """A supplied title without quotes, marks and closing punctuation, within bounds."""
    bare = F.regexp_replace(collapse(c), "^['\"`#*\\- ]+|['\"`#*\\- ]+$", "")
    bare = F.regexp_replace(bare, "[.!?:;, ]+$", "")
    return _fit_title(F.array_join(F.slice(F.split(bare, " "), 1, C.TITLE_WORDS), " "))


def text_metrics(c: Column) -> Column:
    """Visible characters, words, alphanumeric share and bad-character share."""
    visible = F.length(F.regexp_replace(c, r"[\s\p{Z}]", ""))
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    bad = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]", ""))
    return F.struct(
        visible.alias("char_count"), F.size(words(c)).alias("word_count"),
        (alnum / F.greatest(visible, F.lit(1))).alias("alnum_ratio"),
        (bad / F.greatest(F.length(c), F.lit(1))).alias("bad_char_ratio"))


def usable_native_text(metrics: Column, min_chars: int = C.NATIVE_MIN_CHARS) -> Column:
    return (((metrics["char_count"] >= min_chars) | (metrics["word_count"] >= C.NATIVE_MIN_WORDS))
            & (metrics["alnum_ratio"] >= C.NATIVE_MIN_ALNUM) & (metrics["bad_char_ratio"] <= C.NATIVE_MAX_BAD))


def usable_ocr(metrics: Column) -> Column:
    return (metrics["char_count"] >= C.OCR_MIN_CHARS) & (metrics["alnum_ratio"] >= C.OCR_MIN_ALNUM)


def is_compound(c: Column) -> Column:
    lowered = casefold(c)
    has_marker = F.lit(False)
    for marker in C.COMPOUND_MARKERS:
        has_marker = has_marker | lowered.contains(marker)
    return (F.length(c) >= C.COMPOUND_MIN_CHARS) & (has_marker | (F.regexp_count(c, F.lit(r"\?")) > 1))


def valid_subqueries(proposed: Column, original: Column) -> Column:
    """Proposed sub-queries that are long enough, new and not the question itself."""
    cleaned = F.transform(F.slice(proposed, 1, C.MAX_SUBQUERIES), collapse)
    kept = F.filter(cleaned, lambda s: (F.length(s) >= C.MIN_SUBQUERY_CHARS) & (casefold(s) != casefold(original)))
    keys = F.transform(kept, casefold)
    return F.filter(kept, lambda s, i: F.array_position(keys, casefold(s)) == i + 1)


def seconds(hours: Column, minutes: Column, secs: Column, millis: Column) -> Column:
    return (hours.cast("double") * 3600 + minutes.cast("double") * 60
            + secs.cast("double") + millis.cast("double") / 1000)


def segment_header(name: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("[%s %.1fs–%.1fs]\n%s", name, start, end, text)


def sheet_header(sheet: Column, first_row: Column, last_row: Column, body: Column) -> Column:
    return F.format_string("[Sheet: %s rows %d-%d]\n%s", sheet, first_row, last_row, body)


def image_header(name: Column, body: Column, representation: Column) -> Column:
    return F.when(representation == "ocr", F.concat(F.lit("[Image: "), name, F.lit("]\nText in image:\n"), body)
                  ).otherwise(F.concat(F.lit("[Image: "), name, F.lit("]\n"), body))


def section_prefix(top: Column, current: Column) -> Column:
    """``[Section: A > B]`` line above a block; empty without a heading."""
    path = F.when((top != "") & (current != "") & (top != current), F.concat(top, F.lit(" > "), current)
                  ).when(top != "", top).otherwise(current)
    return F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("[Section: "), path, F.lit("]\n")))
