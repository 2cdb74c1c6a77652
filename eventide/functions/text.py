"""Token, entity and context-text builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventide.functions.vector import let

# The stop words that token sets leave out.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "of", "in", "on", "to", "and", "or", "but", "at", "by", "for", "from",
    "with", "about", "as", "this", "that", "these", "those", "it", "its",
    "what", "when", "where", "who", "whom", "which", "why", "how",
    "do", "does", "did", "have", "has", "had", "can", "could", "would",
    "should", "may", "might", "will", "shall",
]

# Spelled out so that the meaning of a word edge or a blank does not depend on the JDK.
WORD_CHARS = r"\p{L}\p{N}_"
BLANK = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
_TITLE_WORD = r"[A-Z][A-Za-z0-9]+"
TITLE_RUN = (
    rf"(?<![{WORD_CHARS}]){_TITLE_WORD}(?:{BLANK}+{_TITLE_WORD})*(?![{WORD_CHARS}])"
)


def tokens(text: Column | str) -> Column:
    """Set of lower-cased whole words of three or more ASCII letters, minus stop words."""
    words = F.split(F.lower(text), f"[^{WORD_CHARS}]+")
    kept = F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOP_WORDS)))


def entities(text: Column | str) -> Column:
    """Set of lower-cased title-case runs after the first word."""
    col = F.col(text) if isinstance(text, str) else text
    stripped = F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")

    def after_first_word(t: Column) -> Column:
        gap = F.instr(t, " ")
        return F.when(gap > 0, F.substr(t, gap)).otherwise(F.lit(""))

    runs = F.regexp_extract_all(let(stripped, after_first_word), F.lit(TITLE_RUN), F.lit(0))
    return F.array_distinct(F.transform(runs, F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap; 0 when either side is empty (or missing)."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(empty, F.lit(0.0)).otherwise(both / either)


def question(text: Column) -> Column:
    return F.concat(F.lit("Q: "), text)


def exchange(q: Column, a: Column) -> Column:
    return F.concat(F.lit("Q: "), q, F.lit(" A: "), a)


def pair_up(flat: Column) -> Column:
    """``[q1, a1, q2, a2, ...]`` to an array of (q, a) structs; an odd tail is dropped."""
    starts = F.filter(
        F.transform(flat, lambda _, i: i), lambda i: (i % 2 == 0) & (i + 1 < F.size(flat))
    )
    return F.transform(
        starts, lambda i: F.struct(F.get(flat, i).alias("q"), F.get(flat, i + 1).alias("a"))
    )


def context_text(current: Column, pairs: Column, k: int | str) -> Column:
    """``Q: .. A: ..`` for the last ``k`` pairs (or ``"all"``), then ``Q: current``."""
    if k == "all":
        kept = pairs
    elif int(k) > 0:
        kept = F.slice(pairs, F.greatest(F.size(pairs) - int(k) + 1, F.lit(1)), F.lit(int(k)))
    else:
        return question(current)
    parts = F.transform(kept, lambda p: exchange(p["q"], p["a"]))
    return F.array_join(F.concat(parts, F.array(question(current))), " ")
