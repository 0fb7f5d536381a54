"""Lexicon scores, the rule classifier's columns, the urgency blend, bands and priorities.

Word presence is a sum of ``contains`` terms: generated code, in which ``lower`` and the words that several lists
share are evaluated once per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siren import lexicons as L
from siren.functions.text import _col, text_or_empty


def present_words(text: str | Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text as substrings. The text must be lower case already."""
    hits = [F.contains(_col(text), F.lit(word)).cast("int") for word in words]
    return reduce(lambda a, b: a + b, hits, F.lit(0))


def any_word(text: str | Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs; stops at the first hit."""
    return reduce(lambda a, b: a | b, [F.contains(_col(text), F.lit(word)) for word in words], F.lit(False))


def keyword_score(
    text: str | Column, urgent: Sequence[str] = L.URGENT_WORDS, medium: Sequence[str] = L.MEDIUM_WORDS
) -> Column:
    """0-100 score of a raw text: urgent words weigh 8, medium words 3.

    The lambda binds the lower-case text, so that it is made once. It also keeps this projection out of the stage's
    one generated method, which the JVM would stop compiling at 8,000 bytecodes.
    """

    def hits(lowered: Column, words: Sequence[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(word) for word in words]), lambda word: F.contains(lowered, word)))

    def score(lowered: Column) -> Column:
        total = hits(lowered, urgent) * L.URGENT_WEIGHT + hits(lowered, medium) * L.MEDIUM_WEIGHT
        return F.least(total, F.lit(100)).cast("double")

    return F.get(F.transform(F.array(F.lower(text_or_empty(text))), score), 0)


def urgency_keyword_score(text: str | Column, words: Sequence[str] = L.BLEND_WORDS) -> Column:
    """0-100 score of a text, urgent words only: the keyword part of the blend."""
    hits = present_words(F.lower(text_or_empty(text)), words)
    return F.least(hits * L.URGENT_WEIGHT, F.lit(100)).cast("double")


def rule_category(help_hits: Column, damage_hits: Column, information_hits: Column) -> Column:
    asks_help = (help_hits > 0) & (help_hits >= damage_hits) & (help_hits >= information_hits)
    tells_damage = (damage_hits > 0) & (damage_hits > information_hits)
    return F.when(asks_help, L.LABELS[1]).when(tells_damage, L.LABELS[2]).otherwise(L.LABELS[0])


def rule_help_probability(category: Column, help_hits: Column) -> Column:
    """The rules' stand-in for a model's probability of a help request."""
    return (
        F.when(category == L.LABELS[1], F.least(help_hits * 0.12 + 0.3, F.lit(0.95)))
        .when(category == L.LABELS[2], F.lit(0.1))
        .otherwise(F.lit(0.05))
    )


def rule_probs(category: Column, help_probability: Column) -> Column:
    """Class probabilities the rules report. They need not add up to 1 for a certain help request."""
    return (
        F.when(
            category == L.LABELS[1],
            probability_map(F.greatest(F.lit(1.0) - help_probability - 0.1, F.lit(0.0)), help_probability, F.lit(0.1)),
        )
        .when(category == L.LABELS[2], probability_map(F.lit(0.15), F.lit(0.1), F.lit(0.75)))
        .otherwise(probability_map(F.lit(0.75), F.lit(0.1), F.lit(0.15)))
    )


def probability_map(*probabilities: Column) -> Column:
    entries: list[Column] = []
    for label, probability in zip(L.LABELS, probabilities):
        entries += [F.lit(label), F.round(probability, 4)]
    return F.create_map(*entries)


def urgency_blend(help_probability: Column, keyword_part: Column) -> Column:
    """80% probability of a help request, 20% keywords, on a 0-100 scale."""
    return F.round(help_probability * 100 * 0.8 + keyword_part * 0.2, 2)


def priority_label(urgency: str | Column, source: str | Column) -> Column:
    """Priority from urgency and from where the location came."""
    urgency, source = _col(urgency), _col(source)
    high = urgency > L.HIGH_URGENCY
    return (
        F.when(high & (source == "tweet"), "HIGHEST")
        .when(high & source.isin("hashtag", "profile_location"), "HIGH")
        .when(high & (source == "bio"), "MEDIUM")
        .when(high & (source == "none"), "CRITICAL_REVIEW")
        .when(urgency > L.MEDIUM_URGENCY, "MEDIUM")
        .otherwise("LOW")
    )


def priority_rank(priority: str | Column) -> Column:
    """1 is the most pressing; for ordering by meaning rather than by text."""
    priority = _col(priority)
    ranked = ["HIGHEST", "HIGH", "CRITICAL_REVIEW", "MEDIUM", "LOW"]
    rank = F.lit(len(ranked) + 1)
    for position, label in reversed(list(enumerate(ranked, 1))):
        rank = F.when(priority == label, position).otherwise(rank)
    return rank


def urgency_band(urgency: str | Column) -> Column:
    """Display band. Exactly 40 is medium here and LOW by priority."""
    urgency = _col(urgency)
    return (
        F.when(urgency > L.HIGH_URGENCY, "high").when(urgency >= L.MEDIUM_URGENCY, "medium").otherwise("low")
    )


def is_critical(urgency: str | Column = "urgency_score", location: str | Column = "location") -> Column:
    """Urgent, but nobody knows where."""
    return (_col(urgency) > L.HIGH_URGENCY) & (_col(location) == "unknown")
