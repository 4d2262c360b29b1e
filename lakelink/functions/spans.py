"""Mention features of sentences. Offsets are code points, start inclusive, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks around a mention.
OPEN, CLOSE = "[MENTION]", "[/MENTION]"
#: Fixed value: the preamble of a sentence's context.
TEXT_PREAMBLE = "The following context is provided to help you. It shows the sentence from which the mention is derived with the mention tagged."


def mention(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def tagged(text: Column, start: Column, end: Column, open_: str = OPEN, close: str = CLOSE) -> Column:
    """The text with marks around the span, without spaces."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(open_), mention(text, start, end), F.lit(close), F.substring(text, end + 1, F.length(text)))


def untagged(text: Column, open_: str = OPEN, close: str = CLOSE) -> Column:
    return F.replace(F.replace(text, F.lit(open_)), F.lit(close))


def mention_feature(text: Column, start: Column, end: Column, special_tokens: bool = True) -> Column:
    return tagged(text, start, end) if special_tokens else mention(text, start, end)


def mention_window(text: Column, start: Column, end: Column, window: int = 0, special_tokens: bool = True, open_: str = OPEN, close: str = CLOSE) -> Column:
    """The mention's tokens with `window` tokens on either side; tags are tokens of their own.

    Tokens are runs of non-space and line feeds. Edge tokens stay whole. A span that starts or ends between
    tokens raises an error; without a text or a span there is no window (null).
    """
    if window == 0:
        inner = mention(text, start, end)
        return F.concat(F.lit(open_ + " "), inner, F.lit(" " + close)) if special_tokens else inner
    pattern = F.lit(r"(?U)\S+|\n")
    tokens = F.regexp_extract_all(text, pattern, F.lit(0))
    count = lambda s: F.size(F.regexp_extract_all(s, pattern, F.lit(0)))
    upto = lambda n: F.substring(text, F.lit(1), n)
    # the token that covers a character is the last one of the text up to and with it
    first, last = count(upto(start + 1)), count(upto(end))
    inside = lambda at: ~F.substring(text, at + 1, F.lit(1)).rlike(r"(?U)^[^\S\n]$") & (F.substring(text, at + 1, F.lit(1)) != "")
    ok = inside(start) & inside(end - 1) & (end > start)
    begin = F.greatest(first - window, F.lit(1))
    before = F.slice(tokens, begin, first - begin)
    middle = F.slice(tokens, first, last - first + 1)
    if special_tokens:
        middle = F.concat(F.array(F.lit(open_)), middle, F.array(F.lit(close)))
    after = F.slice(tokens, last + 1, F.lit(window))
    out = F.array_join(F.concat(before, middle, after), " ")
    given = text.isNotNull() & start.isNotNull() & end.isNotNull()
    return F.when(~given, F.lit(None).cast("string")).when(ok, out).otherwise(F.raise_error(F.lit("span does not align with tokens")).cast("string"))


def text_context(tagged_text: Column, preamble: str = TEXT_PREAMBLE) -> Column:
    return F.concat_ws("\n", F.lit(preamble), tagged_text)


def prep_text(df: DataFrame, window: int = 5, special_tokens: bool = True, open_: str = OPEN, close: str = CLOSE) -> DataFrame:
    """mention, mention_with_window, text_with_tagged_mention and text_context_llm from text and spans[0]."""
    text, start, end = F.col("text"), F.col("spans")[0]["start"], F.col("spans")[0]["end"]
    return df.withColumns({
        "mention": mention(text, start, end),
        "mention_with_window": mention_window(text, start, end, window, special_tokens, open_, close),
        "text_with_tagged_mention": tagged(text, start, end),
        "text_context_llm": text_context(tagged(text, start, end)),
    })
