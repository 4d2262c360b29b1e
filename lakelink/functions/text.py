"""Normalising tokenisation as column expressions.

Patterns run with Unicode classes, as the rule tables expect. NFKC has no built-in form, so it is one Arrow
UDF that passes ASCII through. The rule chain is long: tokenised() applies it to distinct strings only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

BOTH, UNICODE = "(?iU)", "(?U)"
KEY_SEPARATOR = "\u0001"


#: Rows whose strings are held as Python's at a time.
SLICE = 64


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    def some(part: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())

    return pa.concat_arrays([some(text.slice(i, SLICE)) for i in range(0, max(len(text), 1), SLICE)])


def rewrite(col: Column, table: Sequence[tuple[str, str]], flags: str = BOTH) -> Column:
    """The rewrites of a table, one after the other, as one nested expression."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(flags + rule[0]), F.lit(rule[1])), table, col)


def lowered(col: Column, unicode: bool = True) -> Column:
    low = F.lower(col)
    return F.replace(nfkc(low), F.lit("\u00a0"), F.lit(" ")) if unicode else low


def preprocess(col: Column, unicode: bool = True) -> Column:
    """Lower case, NFKC, fraction slash, stop words, tags, plurals; white space stays as it is.

    unicode=False leaves NFKC out, for text known to be ASCII.
    """
    text = F.replace(lowered(col, unicode), F.lit("⁄"), F.lit("/"))
    text = rewrite(text, [(rules.STOP_WORDS, ""), (rules.HTML_TAG, "")])
    text = rewrite(text, [(rules.PLURAL, ""), (rules.BIOAVAILABILITY_PLURAL, "bioavailability"), (rules.HALF_LIFE_PLURAL, "half life")], UNICODE)
    return text


def split_words(col: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(col, UNICODE + r"\s+"), lambda w: w != "")


def basic_tokens(col: Column, unicode: bool = True) -> Column:
    return split_words(preprocess(col, unicode))


def word_tokens(col: Column) -> Column:
    """Words and single marks; stands in for treebank-style tokenizers."""
    return F.regexp_extract_all(col, F.lit(UNICODE + r"\w+|[^\w\s]"), F.lit(0))


def remove_words(col: Column, words: Sequence[str]) -> Column:
    """The text's words without those of a dictionary, joined by single spaces."""
    parts = split_words(col)
    if words:
        known = F.array(*(F.lit(w) for w in words))
        parts = F.filter(parts, lambda w: ~F.array_contains(known, F.lower(w)))
    return F.array_join(parts, " ")


def remove_chemicals(col: Column, chemicals: Sequence[str] = rules.CHEMICALS) -> Column:
    """Whole words of the list go; white space is collapsed and trimmed."""
    quoted = "|".join(rf"\Q{c}\E" for c in chemicals)
    out = F.regexp_replace(col, F.lit(rf"{BOTH}\b(?:{quoted})\b"), F.lit(""))
    return F.trim(F.regexp_replace(out, F.lit(UNICODE + r"\s+"), F.lit(" ")))


def special_characters(tokens: Column) -> Column:
    """Whole tokens that are special characters, by name."""
    names = F.create_map(*(F.lit(x) for pair in rules.SPECIAL_CHARACTERS.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t))


def unique_tokens(tokens: Column) -> Column:
    """Each token once, at its first place."""
    return F.array_distinct(tokens)


def canonical_text(col: Column, drugs: Sequence[str] = (), unicode: bool = True) -> Column:
    """The text after all rewrites, before tokens are taken."""
    text = remove_chemicals(remove_words(preprocess(col, unicode), drugs))
    return rewrite(rewrite(rewrite(text, rules.GENERAL), rules.PARAMETERS), rules.TAIL)


def pk_tokens(col: Column, drugs: Sequence[str] = (), unicode: bool = True) -> Column:
    """Sorted distinct canonical tokens of a parameter mention."""
    tokens = F.regexp_extract_all(canonical_text(col, drugs, unicode), F.lit(UNICODE + rules.TOKEN), F.lit(0))
    removed = F.array(*(F.lit(w) for w in rules.TOKEN_REMOVALS))
    tokens = F.filter(special_characters(tokens), lambda t: ~F.array_contains(removed, t))
    tokens = F.transform(tokens, lambda t: rewrite(t, rules.STANDARDS, UNICODE))
    tokens = F.filter(tokens, lambda t: ~t.rlike(UNICODE + rules.NUMERIC_RANGE))
    return F.array_sort(F.array_distinct(tokens))


#: Tokenizers by name. "scispacy" and "nltk" stand for models that are not at hand: words and marks.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"basic": basic_tokens, "pk": pk_tokens, "scispacy": word_tokens, "nltk": word_tokens}


def tokenizer(name: str) -> Callable[[Column], Column]:
    try:
        return TOKENIZERS[name.lower()]
    except KeyError:
        raise NameError(f"unknown tokenizer {name!r}; there are {', '.join(sorted(TOKENIZERS))}") from None


def token_key(tokens: Column) -> Column:
    """A scalar that is equal for equal token sets."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), KEY_SEPARATOR)


def once(col: Column) -> Column:
    """The column by way of an explode of one element: filters on it stay above, so that it is made once for a row
    and never for the rows that a distinct below it has taken together."""
    return F.explode(F.array(col))


def tokenised(df: DataFrame, text: str, build: Callable[[Column], Column], name: str = "tokens") -> DataFrame:
    """df with `name` = build(text), computed once for each distinct text and joined back.

    The join is a plain one: Spark broadcasts the distinct side where it measures it to be small.
    """
    distinct = df.select(F.col(text).alias("__t")).where("__t is not null").distinct().withColumn(name, once(build(F.col("__t"))))
    return df.join(distinct, F.col(text) == F.col("__t"), "left").drop("__t")
