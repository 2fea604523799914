"""Text functions as column expressions: tokens, stems, terms, redaction, numbers, chunks."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order they are tried, what replaces them, and the least bytes
#: that must be left before them. The first that applies is used.
SUFFIXES = (
    ("ies", "i", 2), ("ied", "i", 2), ("sses", "ss", 0), ("ness", "", 2), ("ment", "", 3), ("ing", "", 3),
    ("tion", "t", 2), ("able", "", 3), ("ible", "", 3), ("ful", "", 3), ("ous", "", 3),
    ("ive", "", 3), ("ly", "", 3), ("ed", "", 3), ("er", "", 3), ("es", "", 3),
)
#: Words whose meaning is yes or no.
POSITIVE = ("true", "yes", "y", "on", "enabled", "enable", "active", "complete", "completed", "passed", "pass", "approved", "approve", "present")
NEGATIVE = ("false", "no", "n", "off", "disabled", "disable", "inactive", "blocked", "failed", "fail", "rejected", "reject", "absent")
TOKEN = r"[\p{L}\p{N}']+"


def ascii_lower(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def stem(word: Column) -> Column:
    """The first suffix rule that applies to a word of over three bytes, else a plural s taken off."""
    size = F.octet_length(word)
    out = F.when(size <= 3, word)
    for suffix, instead, least in SUFFIXES:
        base = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out = out.when(F.endswith(word, F.lit(suffix)) & (size - len(suffix) >= least), F.concat(base, F.lit(instead)))
    plural = F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss"))
    return out.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def words(text: Column) -> Column:
    """Search words in order, repeats kept: runs of letters, digits and apostrophes of over one byte, in lower case."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: F.octet_length(w) > 1)


def tokens(text: Column) -> Column:
    """Stemmed search tokens in order, repeats kept."""
    return F.transform(words(text), stem)


def runs(tokens: Column) -> Column:
    """One text for each distinct search token: the token and a space, as often as it is in the array. See run_term and run_count."""
    return F.regexp_extract_all(F.concat(F.array_join(F.sort_array(tokens), " "), F.lit(" ")), F.lit(r"([^ ]+ )\1*+"), F.lit(0))


def run_term(run: Column) -> Column:
    return F.substring_index(run, " ", 1)


def run_count(run: Column) -> Column:
    return (F.octet_length(run) / (F.octet_length(run_term(run)) + 1)).cast("long")


def case_terms(text: Column) -> Column:
    """Distinct terms of a task: runs of letters and digits of two bytes or more, in lower case."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(found, lambda w: F.octet_length(w) >= 2))


def query_terms(text: Column) -> Column:
    """Sorted distinct terms of a memory query: letters, digits, - and _, two bytes or more."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_-]+")
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: F.octet_length(w) >= 2)))


def stem_sql(w: str) -> str:
    """`stem` as DuckDB SQL."""
    cases = [f"WHEN strlen({w}) <= 3 THEN {w}"]
    for suffix, instead, least in SUFFIXES:
        cases.append(f"WHEN {w} LIKE '%{suffix}' AND strlen({w}) - {len(suffix)} >= {least} THEN left({w}, length({w}) - {len(suffix)}) || '{instead}'")
    cases.append(f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1)")
    return "CASE " + " ".join(cases) + f" ELSE {w} END"


def tokens_sql(text: str) -> str:
    """`tokens` as DuckDB SQL."""
    low = f"translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"list_transform(list_filter(regexp_extract_all({low}, '[\\p{{L}}\\p{{N}}'']+'), lambda w: strlen(w) > 1), lambda w: {stem_sql('w')})"


def fact_tokens(value: Column) -> Column:
    """Estimated tokens of a fact: bytes over four, rounded up."""
    return F.ceil(F.octet_length(value) / 4).cast("long")


def leading_number(value: Column) -> Column:
    """The number a text begins with, after a currency sign, with thousands commas; null without one."""
    found = F.regexp_extract(F.trim(value), r"^[$£€]?\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def polarity(value: Column) -> Column:
    """'positive', 'negative' or null, by the whole value without marks around it."""
    bare = F.regexp_replace(ascii_lower(F.trim(value)), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.when(bare.isin(*POSITIVE), "positive").when(bare.isin(*NEGATIVE), "negative")


def redacted(text: Column) -> Column:
    """Values after secret-like keys, key prefixes and signed-token shapes replaced by a mark."""
    out = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|passwd)\s*[=:]\s*\S+", "$1=[REDACTED]")
    out = F.regexp_replace(out, r"\b(sk-|ghp_|xoxb-|AKIA)[A-Za-z0-9_-]{8,}", "[REDACTED]")
    return F.regexp_replace(out, r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED]")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


#: Words that carry no content in a recall query.
STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "with", "from", "this", "that", "into", "over", "under", "about",
    "after", "before", "more", "most", "some", "such", "only", "own", "same", "too", "very", "just", "now", "which",
    "who", "whom", "these", "those", "there", "here", "where", "while", "during", "each", "few", "other", "again",
    "further", "once", "how", "what", "when", "why", "you", "its", "our", "their", "new", "use", "using", "can",
    "does", "not", "all", "any", "has", "have", "had", "been", "but", "then", "than",
)


def content_terms(query: Column) -> Column:
    """Distinct runs of ASCII letters, digits and _ of three or more, without STOP_WORDS, in order of first use."""
    found = F.split(ascii_lower(query), r"[^a-z0-9_]+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def address(query: Column) -> Column:
    """A query that addresses a fact (one word with a colon), in lower case with single colons; null for others."""
    bare = F.trim(query)
    return F.when(F.contains(bare, F.lit(":")) & ~bare.rlike(r"\s"), F.replace(ascii_lower(bare), F.lit("::"), F.lit(":")))


#: Characters of a chunk, the least of one that ends at a boundary, and those that the next one repeats.
CHUNK, CHUNK_LEAST, CHUNK_OVERLAP = 1800, 1200, 180


#: White space at the ends of a text, as `\\s` has it.
_SPACE = " \t\n\x0b\f\r"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda that names an expression from outside computes it at every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunk_pattern(least: int, most: int) -> str:
    """The next piece of a text: all that is left, else up to the last blank line, the last white space, or `most`."""
    # a blank line that ends just at `most` is white space there as well
    return rf"(?:.{{1,{most}}}+\z|.{{{least - 2},{most - 2}}}\n\n|.{{{least - 1},{most - 1}}}\s|.{{{most}}})"


def chunks(text: Column) -> Column:
    """Overlapping chunks of a text: each ends after the last blank line in reach, else after the last white space, else at CHUNK.

    One expression finds what each chunk adds to those before it, in one pass; a chunk repeats the end of the piece before.
    """
    more = _chunk_pattern(CHUNK_LEAST - CHUNK_OVERLAP, CHUNK - CHUNK_OVERLAP)
    pattern = rf"(?s)\A{_chunk_pattern(CHUNK_LEAST, CHUNK)}|(?!\A)\G{more}"
    body = F.trim(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE)))

    def made(pieces: Column) -> Column:
        before = lambda i: F.coalesce(F.right(F.get(pieces, i - 1), F.lit(CHUNK_OVERLAP)), F.lit(""))
        return F.filter(F.transform(pieces, lambda p, i: F.btrim(F.concat(before(i), p), F.lit(_SPACE))), lambda c: c != "")

    return _once(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), made)


def markdown_sections(text: Column) -> Column:
    """A Markdown text cut before its ATX headings; sections of white space only are left out."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^(?=[ \t]*#{1,6}[ \t])", "\u001e")
    return F.filter(F.split(marked, "\u001e"), lambda s: F.trim(F.regexp_replace(s, r"\s+", "")) != "")


def summary(text: Column, chars: int) -> Column:
    """The first sentence, those of a decision, and the last one, in order, as far as they fit `chars`."""
    found = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"(?<=[.!?]) "), lambda s: s != "")
    said = lambda s: s.rlike(r"(?i)\b(decided|decision|agreed|chose|because|must)\b")
    kept = _once(found, lambda all_: F.filter(all_, lambda s, i: (i == 0) | (i == F.size(all_) - 1) | said(s)))
    joined = lambda acc, s: F.when(acc == "", s).otherwise(F.concat_ws(" ", acc, s))
    size = lambda acc, s: F.length(acc) + F.length(s) + F.when(acc == "", 0).otherwise(1)
    return F.aggregate(kept, F.lit(""), lambda acc, s: F.when(size(acc, s) <= chars, joined(acc, s)).otherwise(acc))


#: Kinds of facts that a text states, and the pattern of each one's object.
FACT_PATTERNS = {
    "money": r"[$£€]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|k|m|bn))?",
    "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "month_date": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,\s*\d{4})?\b",
    "count": r"\b\d[\d,]*\s+(?:users|people|items|files|tests|days|hours|minutes)\b",
    "version": r"\bv?\d+\.\d+\.\d+\b",
}


def stated_facts(text: Column) -> Column:
    """Distinct (kind, object) that FACT_PATTERNS find in a text, objects told apart without letter case."""

    def found(kind: str, pattern: str) -> Column:
        objects = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
        return F.transform(objects, lambda o: F.struct(F.lit(kind).alias("kind"), F.lower(o).alias("object")))

    return F.array_distinct(F.concat(*(found(k, p) for k, p in FACT_PATTERNS.items())))


def log_redacted(text: Column) -> Column:
    """`redacted`, and addresses of mail and numbers of four dotted parts and of cards, for logs."""
    out = F.regexp_replace(redacted(text), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    out = F.regexp_replace(out, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]")
    return F.regexp_replace(out, r"\b(?:\d[ -]?){13,16}\b", "[NUMBER]")
