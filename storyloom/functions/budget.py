"""Token and character budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a request is reckoned to need besides its text.
TOKENS_A_CHARACTER, SYSTEM, USER, SAFETY, CHAPTER_OUTPUT, MOST_OUTPUT = 0.55, 1500, 500, 2000, 6000, 131_072


def tokens(characters: Column) -> Column:
    return F.floor(characters * F.lit(TOKENS_A_CHARACTER)).cast("int")


def output_budget(context: Column, characters: Column, before: Column) -> Column:
    """Tokens left for an answer: at least 4,096, at most MOST_OUTPUT; 8,192 where the context length is unknown."""
    left = context - (tokens(before) + tokens(characters) + SYSTEM) - SAFETY
    return F.when(context <= 0, 8192).otherwise(F.greatest(F.lit(4096), F.least(left, F.lit(MOST_OUTPUT))))


def context_budget(context: Column, chapter: Column, history: Column) -> Column:
    """struct(budget, compress): tokens left for knowledge in a question; below 4,000 the history has to be compressed."""
    left = context - (SYSTEM + chapter + history + USER + F.greatest(F.lit(2000), F.floor(context / 16)) + F.floor(context / 20))
    return F.struct(F.greatest(F.lit(4000), left).cast("bigint").alias("budget"), (left < 4000).alias("compress"))


def most_chapters(context: Column) -> Column:
    """Chapters read at once."""
    return F.when(context < 16000, 1).otherwise(F.greatest(F.lit(2), F.floor((F.floor(context * 0.9) - 4000) / 7500))).cast("int")


def context_before(context: Column) -> Column:
    """Tokens for what came before."""
    return F.when(context <= 0, 4000).otherwise(F.greatest(F.lit(2500), F.least(F.lit(12000), F.floor(context / 20)))).cast("int")


def batch_fits(context: Column, before: Column, characters: Column, chapters: Column) -> Column:
    needed = tokens(before) + tokens(characters) + SYSTEM + chapters * CHAPTER_OUTPUT + SAFETY
    return (context > 0) & (needed <= F.floor(context * 0.9))
