"""Fund names: family stems, fund numbers, sponsors and diagnostics.

All are Column expressions that stay inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these word lists, patterns and bounds.
ENTITY_SUFFIX = r"\s+(?:L\.?P\.?|LLC|Ltd|Fund|Partners)?\s*$"
NUMERAL_SUFFIX = r"\s+(?:[IVXLC]+|\d+)\s*$"
ENTITY_WORDS = (
    r"\b(?:L\s*\.?\s*P\s*\.?\s*\d*|LLC|LTD|LIMITED\s+PARTNERSHIP|PARTNERSHIP"
    r"|S\s*\.?\s*C\s*\.?\s*SP|SCSP|S\s*\.?\s*L\s*\.?\s*P|SLP|ILP|INC|PLC"
    r"|COOPERATIEF\s+U\s*\.?\s*A|COOPERATIEF|A\s+DELAWARE|DELAWARE"
    r"|GMBH|SARL|BV|NV|SA|AB|KG|USD|EUR|GBP)\b"
)
MAX_FUND_NUMBER = 60
SPONSOR_STOPWORD = "THE"


def roman(n: int) -> str:
    """Roman numeral of 1 to 89."""
    tens, ones = divmod(n, 10)
    low = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][ones]
    return ("XL" if tens == 4 else "L" * (tens >= 5) + "X" * (tens % 5)) + low


def roman_value(token: Column) -> Column:
    """1 to 60 for a well-formed numeral, else null."""
    numerals = F.array(*(F.lit(roman(n)) for n in range(1, MAX_FUND_NUMBER + 1)))
    return F.nullif(F.array_position(numerals, token), F.lit(0)).cast("int")


def without_punctuation(name: Column) -> Column:
    return F.regexp_replace(name, r"[,\.]", "")


def family_stem(name: Column) -> Column:
    """First-pass family: one entity word and then one numeral off the end, upper case."""
    stem = F.regexp_replace(without_punctuation(name), ENTITY_SUFFIX, "")
    return F.upper(F.trim(F.regexp_replace(stem, NUMERAL_SUFFIX, "")))


def name_tokens(name: Column) -> Column:
    """Upper-case tokens of the name without entity words and punctuation."""
    bare = F.regexp_replace(F.upper(name), f"(?iU){ENTITY_WORDS}", " ")
    bare = F.regexp_replace(bare, r"(?U)[^\w\s-]", " ")
    return F.filter(F.split(bare, r"(?U)\s+"), lambda t: t != "")


def token_number(token: Column) -> Column:
    """The number a token spells before its first hyphen, 1 to 60, else null."""
    head = F.substring_index(token, "-", 1)
    value = F.when(head.rlike(r"^\d{1,9}$"), head.try_cast("int")).otherwise(roman_value(head))
    return F.when(value.between(1, MAX_FUND_NUMBER), value)


def _numbered(name: Column) -> Column:
    # a leading number belongs to the firm's name
    later = F.slice(name_tokens(name), 2, 1000)
    return F.filter(later, lambda t: token_number(t).isNotNull())


def fund_number(name: Column) -> Column:
    """The first number after the first token; null for an unnumbered fund."""
    return token_number(F.try_element_at(_numbered(name), F.lit(1)))


def stranded_number(name: Column) -> Column:
    """The token that carries the fund number, '' if there is none."""
    return F.coalesce(F.substring_index(F.try_element_at(_numbered(name), F.lit(1)), "-", 1), F.lit(""))


def orphan_number(stem: Column) -> Column:
    """The first token after the stem's first that still carries a number, '' if there is none."""
    later = F.filter(F.slice(F.split(F.trim(stem), r"\s+"), 2, 1000), lambda t: token_number(t).isNotNull())
    return F.coalesce(F.try_element_at(later, F.lit(1)), F.lit(""))


def dangling(stem: Column) -> Column:
    """Whether a stem ends in a separator or a connective."""
    return F.trim(stem).rlike(r"(?:[-&/]|\bNO|\bTHE|\bAND|\bOF)\s*$")


def removed_tail(name: Column) -> Column:
    """What the stem leaves off the end of the upper-case name without punctuation."""
    whole, stem = F.upper(F.trim(without_punctuation(name))), family_stem(name)
    return F.when(F.startswith(whole, stem), F.trim(F.substring(whole, F.length(stem) + 1, F.length(whole)))).otherwise("")


def sponsor_token(family: Column) -> Column:
    """The family's first word, or its second after a leading THE."""
    tokens = F.split(F.trim(family), r"\s+")
    first = F.when((tokens[0] == SPONSOR_STOPWORD) & (F.size(tokens) > 1), F.try_element_at(tokens, F.lit(2))).otherwise(tokens[0])
    return F.when(family.isNull() | (F.trim(family) == ""), family).otherwise(first)


def proper_prefixes(stem: Column) -> Column:
    """The stems of fewer leading tokens."""
    tokens = F.split(stem, " ")
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " "))).otherwise(F.array().cast("array<string>"))


def any_word(name: Column, words: tuple[str, ...]) -> Column:
    upper = F.upper(name)
    return reduce(lambda a, b: a | b, (upper.contains(w) for w in words))
