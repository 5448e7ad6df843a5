"""Column functions over text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode defines it plus the four ASCII separators, with "." stopping
# at a line feed only.
_SPACE = r"[\s\x1c-\x1f]"
_FLAGS = "(?Ud)"

# Categories that are refined, and the keyword rules in order of precedence.
REFINED_CATEGORIES = ("Environmental", "Envionmental")
KEYWORD_CATEGORIES = {"heatwave": "Heatwave", "drought": "Drought", "bushfire": "Bushfire"}
OTHER_CATEGORY = "Others"


def category_of(title: Column) -> Column:
    """Text before the first whitespace-and-dash, else before the first whitespace, else null.

    Each pattern runs once: its whole match, which is never empty, tells both whether and what.
    """
    dashed = F.regexp_extract(title, f"{_FLAGS}.*?{_SPACE}-", 0)
    spaced = F.regexp_extract(title, f"{_FLAGS}.*?{_SPACE}", 0)
    return F.when(dashed != "", F.left(dashed, F.length(dashed) - 2)).when(
        spaced != "", F.left(spaced, F.length(spaced) - 1)
    )


def refined_category(
    category: Column,
    title: Column,
    refined: Sequence[str] = REFINED_CATEGORIES,
    keywords: Mapping[str, str] = KEYWORD_CATEGORIES,
    other: str = OTHER_CATEGORY,
) -> Column:
    """Replace the ``refined`` categories by the first keyword that the lower-cased title holds."""
    lowered = F.lower(title)
    choice = F
    for keyword, name in keywords.items():
        choice = choice.when(lowered.contains(keyword), F.lit(name))
    return F.when(category.isin(*refined), choice.otherwise(F.lit(other))).otherwise(category)


def leading_token(text: Column) -> Column:
    """Text before the first whitespace; empty where there is none."""
    return F.regexp_extract(text, r"^(.*?)\s", 1)


def space_tokens(line: Column) -> Column:
    """Parts between spaces, without the empty ones."""
    return F.filter(F.split(line, " "), lambda part: part != "")


def ends_joined(text: Column, first: int = 4, last: int = 2) -> Column:
    """The ``first`` leading characters followed by the ``last`` trailing ones."""
    return F.concat(F.left(text, F.lit(first)), F.right(text, F.lit(last)))
