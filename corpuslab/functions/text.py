"""String and keyword expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separators that Python also strips.
SPACE = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]{2,}"
SENTENCE_END = r"[.!?]+\s+|\n+"
NOT_SENTENCE_TEXT = r"[^\p{L}\p{M}\p{N}\p{Z}\s-]+"
# Hyphens at the start or end of a word; what is no hyphen is passed over before anything else is tried.
OUTER_HYPHENS = r"(?U)(?=-)(?:(?<![^\s\x1c-\x1f])-+|-+(?![^\s\x1c-\x1f]))"
URL = r"https?://[^\s<>\"]+"


def strip(value: Column) -> Column:
    """Drop white space at both ends, including tabs and no-break spaces."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def capitalize(value: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substr(value, F.lit(2))))


def casefold(value: Column) -> Column:
    """Lower case for comparison; sharp s becomes ss."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def keyword_list(value: Column) -> Column:
    """A comma list as an array of stripped strings; null stays null."""
    return F.transform(F.split(value, ","), strip)


def space_tokens(value: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(value, rf"(?U){SPACE}+"), lambda piece: piece != "")


def word_tokens(value: Column) -> Column:
    """Lower-cased runs of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0))


def run_lengths(items: Column, name: str, count: str) -> Column:
    """Entries (item, its number) of the different items of an array, in rising order; null if null.

    The items are sorted and cut into runs inside the row, so nothing is shuffled. Every step sees
    the one before as a variable of a lambda, so that none is evaluated once per item.
    """
    shifted = lambda xs, by: F.slice(xs, by + 1, F.size(xs) + 1)

    def starts(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))))
        marked = F.zip_with(ordered, before, lambda a, b: F.when(~a.eqNullSafe(b), a))
        placed = F.transform(marked, lambda a, i: F.when(a.isNotNull(), F.struct(a.alias("a"), i.alias("i"))))
        end = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.size(ordered).alias("i")))
        return F.concat(F.array_compact(placed), end)

    def lengths(runs: Column) -> Column:
        pairs = F.zip_with(
            runs, shifted(runs, 1),
            lambda a, b: F.struct(a["a"].alias(name), (b["i"] - a["i"]).cast("long").alias(count)),
        )
        return F.slice(pairs, 1, F.size(runs) - 1)

    ordered = F.transform(F.array(F.array_sort(items)), lambda xs: F.when(xs.isNotNull(), starts(xs)))
    return F.transform(ordered, lambda runs: F.when(runs.isNotNull(), lengths(runs)))[0]


def term_counts(value: Column) -> Column:
    """Entries (term, tf) of the different words of a text; null stays null."""
    return run_lengths(word_tokens(value), "term", "tf")


def raw_sentences(value: Column) -> Column:
    """Pieces of a text between sentence ends; positions keep empty pieces."""
    return F.split(value, SENTENCE_END)


def sentence_tokens(value: Column) -> Column:
    """Lower-cased words without punctuation; a hyphen inside a word stays."""
    plain = F.regexp_replace(F.lower(value), NOT_SENTENCE_TEXT, "")
    return space_tokens(F.regexp_replace(plain, OUTER_HYPHENS, ""))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens joined by a blank; an empty array if there are fewer.

    Every further word is appended by pairing the runs with the tokens shifted by one more place.
    The lambda sees the pair only: an outer column inside it could be evaluated once per token.
    """
    runs = tokens
    for k in range(1, n):
        shifted = F.slice(tokens, k + 1, F.size(tokens) + 1)
        runs = F.zip_with(runs, shifted, lambda run, word: F.concat(run, F.lit(" "), word))
    return F.array_compact(runs)


def urls(value: Column) -> Column:
    """Web addresses in a text, without closing punctuation."""
    found = F.regexp_extract_all(value, F.lit(URL), F.lit(0))
    return F.transform(found, lambda url: F.regexp_replace(url, r"[.,;:!?)\]]+$", ""))


def url_query(parameters: dict[str, Column]) -> Column:
    """``a=1&b=2`` with encoded values."""
    return F.concat_ws(
        "&", *[F.concat(F.lit(name + "="), F.url_encode(value)) for name, value in parameters.items()]
    )


def ratio(part: Column, whole: Column) -> Column:
    """Division in double precision; null where the denominator is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
