"""Name matching as column expressions: ASCII-only case folding, word boundaries, match scores, n-gram tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores of the ways in which a needle can match, and the gate for short needles.
EXACT, PREFIX, BOUNDARY, SUBSTRING, INITIALS, SUBSEQUENCE = 1000, 800, 650, 500, 400, 200
WORD_EXACT, WORD_PREFIX, WORD_SUBSTRING = 700, 550, 250
SHORT_LENGTH, SHORT_SCORE = 3, 650
LOCALITY_STEP, LOCALITY_SEGMENTS, TIER_STRIDE = 10, 10, 2048
TIERS = {"current": 4, "reachable": 3, "external": 2, "unknown": 1, "global": 0}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BOUNDARY = r"(?s)^.|(?<=_)[^_]|(?<=[a-z])[A-Z]|(?<=[A-Za-z])[0-9]"


def lower_ascii(c: Column) -> Column:
    """Lower case of the letters A to Z only."""
    return F.translate(c, _UPPER, _LOWER)


def boundary_initials(name: Column) -> Column:
    """The characters at word boundaries, in lower case, as one string."""
    return lower_ascii(F.array_join(F.regexp_extract_all(name, F.lit(_BOUNDARY), F.lit(0)), ""))


def starts_word(name: Column, at: Column) -> Column:
    """Whether the character at the 1-based place ``at`` starts a word."""
    prev, here = F.substr(name, at - 1, F.lit(1)), F.substr(name, at, F.lit(1))
    return (
        (at == 1)
        | ((prev == "_") & (here != "_"))
        | (prev.rlike("[a-z]") & here.rlike("[A-Z]"))
        | (prev.rlike("[A-Za-z]") & here.rlike("[0-9]"))
    )


def subsequence_pattern(needle: Column) -> Column:
    """Regular expression of the strings that hold the needle's characters in order."""
    return F.array_join(F.transform(F.split(needle, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*")


def match_score(needle: Column, name: Column) -> Column:
    """Score of a needle (any case) against a name; null if it does not match. Only the first place of a substring is tested for a boundary."""
    n, low = lower_ascii(needle), lower_ascii(name)
    at, pattern = F.instr(low, n), subsequence_pattern(n)
    return (
        F.when(low == n, EXACT)
        .when(F.startswith(low, n), PREFIX)
        .when((at > 0) & starts_word(name, at), BOUNDARY)
        .when(at > 0, SUBSTRING)
        .when(F.regexp_like(boundary_initials(name), pattern), INITIALS)
        .when(F.regexp_like(low, pattern), SUBSEQUENCE)
    )


def passes_short_gate(needle: Column, score: Column) -> Column:
    """Needles of fewer than three bytes need at least a match at a word boundary."""
    return (F.octet_length(needle) >= SHORT_LENGTH) | (score >= SHORT_SCORE)


def word_score(prefix: Column, word: Column, bonus: Column) -> Column:
    """Score of a word of the current file; short prefixes match inside a word only at a boundary."""
    n, low = lower_ascii(prefix), lower_ascii(word)
    at = F.instr(low, n)
    ok = (F.octet_length(n) >= 1) & (F.octet_length(low) >= 1)
    inside = (at > 0) & ((F.octet_length(n) >= SHORT_LENGTH) | starts_word(word, at))
    return F.when(ok & (low == n), WORD_EXACT + bonus).when(ok & F.startswith(low, n), WORD_PREFIX + bonus).when(ok & inside, WORD_SUBSTRING + bonus)


def shared_segments(a: Column, b: Column) -> Column:
    """Number of leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def locality(path: Column, current: Column) -> Column:
    """Bonus of ten per shared leading segment, at most a hundred; none without a current file."""
    near = F.least(shared_segments(path, current), F.lit(LOCALITY_SEGMENTS)) * LOCALITY_STEP
    return F.when(path.isNull() | current.isNull(), 0).otherwise(near).cast("int")


def tier_rank(tier: Column) -> Column:
    """Rank of a scope tier's name."""
    out = None
    for name, rank in TIERS.items():
        out = F.when(tier == name, rank) if out is None else out.when(tier == name, rank)
    return out


def pack_score(tier: Column, base: Column, local: Column) -> Column:
    """One sortable number in which the tier outranks the match and the match the locality."""
    return tier_rank(tier) * TIER_STRIDE + base + local


def match_class(prefix: Column, name: Column) -> Column:
    """2 for the whole name, 1 for its beginning, 0 otherwise, without letter case."""
    n, low = lower_ascii(prefix), lower_ascii(name)
    return F.when(n == "", 0).when(n == low, 2).when(F.startswith(low, n), 1).otherwise(0)


def trigrams(name: Column, most: int = 64) -> Column:
    """Distinct trigrams of the lower-cased name; of longer names ``most`` evenly spaced ones."""
    low = lower_ascii(name)
    n = F.length(low) - 2
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(low, i, F.lit(3)))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.substr(low, (F.floor(i * (n - 1) / (most - 1)) + 1).cast("int"), F.lit(3)))
    return F.when(n < 1, F.array().cast("array<string>")).when(n <= most, F.array_distinct(every)).otherwise(F.array_distinct(spaced))


def initial_trigrams(initials: Column, most: int = 8) -> Column:
    """Distinct triples of a string's first eight characters in order, not necessarily adjacent."""
    n = F.least(F.length(initials), F.lit(most))
    ones = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    at = lambda i: F.substr(initials, i, F.lit(1))
    triples = F.flatten(F.flatten(F.transform(ones, lambda i: F.transform(ones, lambda j: F.transform(ones, lambda k: F.when((i < j) & (j < k), F.concat(at(i), at(j), at(k))))))))
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(triples, lambda t: t.isNotNull())))


def receiver_hint(name: Column) -> Column:
    """A receiver's name without leading underscores and digits, in lower case."""
    return lower_ascii(F.regexp_replace(name, "^[_0-9]+", ""))


def prefix_bucket(prefix: Column) -> Column:
    """The first two identifier characters in lower case, ``none`` without any."""
    b = F.substring(lower_ascii(F.regexp_replace(prefix, "[^A-Za-z0-9_]", "")), 1, 2)
    return F.when(b == "", "none").otherwise(b)
