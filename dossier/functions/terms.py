"""Tokens, stop words and word n-grams as array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import sql_let, sql_list, sql_name, sql_text
from .text import WORD

TOKEN_PATTERN = WORD + "{2,}"

# The English list of Spark's StopWordsRemover.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({sql_name(text)}), {sql_text(TOKEN_PATTERN)}, 0)"


def _ngrams(words: str, n: int) -> str:
    """Runs of ``n`` neighbouring words, joined by a space: shorter runs zipped with the next word."""
    if n == 1:
        return words
    count = f"greatest(size({words}) - {n - 1}, 0)"
    shorter = _ngrams(words, n - 1)
    return (
        f"zip_with(slice({shorter}, 1, {count}), slice({words}, {n}, {count}), (a, b) -> concat(a, ' ', b))"
    )


def tokens(text: str) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.expr(_tokens(text))


def terms(
    text: str,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    ngram_range: tuple[int, int] = (1, 2),
) -> Column:
    """Terms of a text column: stop words leave first, then n-grams of every size are built."""
    kept = _tokens(text)
    if stop_words:
        kept = f"filter({kept}, w -> w NOT IN {sql_list(stop_words)})"
    low, high = ngram_range
    runs = ", ".join(_ngrams("words", n) for n in range(low, high + 1))
    return F.expr(sql_let(kept, "words", f"concat({runs})"))
