"""Default word lists, labels and thresholds.

Everything in this file is a fixed value: results depend on it. Each scoring function takes its list as an
argument, so a deployment can pass its own; ``words_of`` reads one from a (lexicon, word) table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# -- fixed values ------------------------------------------------------------------------------------

URGENT_WORDS = [
    "urgent", "help", "rescue", "trapped", "emergency", "sos", "dying", "stranded", "buried", "flood",
    "earthquake", "fire", "critical", "save", "need help", "please help", "now", "immediately", "disaster",
    "evacuate", "collapse", "injured", "missing",
]
MEDIUM_WORDS = [
    "damage", "destroyed", "alert", "warning", "update", "report", "shelter", "relief", "aid", "victims",
    "displaced", "affected", "power outage", "blocked", "cut off", "closed",
]
# The urgency blend uses the urgent list without "now".
BLEND_WORDS = [word for word in URGENT_WORDS if word != "now"]

HELP_WORDS = [
    "urgent", "help", "rescue", "trapped", "sos", "emergency", "stranded", "dying", "please help", "send help",
]
DAMAGE_WORDS = [
    "destroyed", "collapsed", "damage", "ruins", "burning", "washed away", "demolished", "devastated",
]
INFORMATION_WORDS = [
    "update", "report", "shelter", "teams deployed", "fema", "volunteers", "hotline", "closed", "reopening",
]

RELEVANCE_WORDS = [
    "flood", "earthquake", "hurricane", "cyclone", "tornado", "wildfire", "disaster", "rescue", "emergency",
    "evacuate", "tsunami", "landslide", "storm", "relief", "trapped", "damage", "collapse", "help", "urgent",
    "missing", "injured", "casualt", "victim", "displaced", "crisis",
]

LOCATION_NOISE = ["worldwide", "global", "earth", "everywhere", "internet", "web", "online"]

HAZARD_SUFFIXES = [
    "Flood", "Quake", "Fire", "Storm", "Hurricane", "Cyclone", "Typhoon", "Disaster", "Earthquake",
]

LABELS = ["Information", "Help Request", "Damage Report"]

LOCATION_CONFIDENCE = {
    "tweet": "high",
    "hashtag": "medium",
    "profile_location": "medium",
    "bio": "low",
    "none": "none",
}

URGENT_WEIGHT = 8
MEDIUM_WEIGHT = 3
HIGH_URGENCY = 70
MEDIUM_URGENCY = 40

# -- end of fixed values -----------------------------------------------------------------------------

LEXICONS = {
    "urgent": (URGENT_WORDS, URGENT_WEIGHT),
    "medium": (MEDIUM_WORDS, MEDIUM_WEIGHT),
    "blend": (BLEND_WORDS, URGENT_WEIGHT),
    "help": (HELP_WORDS, 1),
    "damage": (DAMAGE_WORDS, 1),
    "information": (INFORMATION_WORDS, 1),
    "relevance": (RELEVANCE_WORDS, 1),
}

MAX_LEXICON_WORDS = 1000


def lexicon_table(spark: SparkSession) -> DataFrame:
    """The default lists as a table (lexicon, word, weight), to be saved, edited and read back."""
    rows = [(name, word, weight) for name, (words, weight) in LEXICONS.items() for word in words]
    return spark.createDataFrame(rows, "lexicon string, word string, weight int")


def words_of(table: DataFrame, lexicon: str) -> list[str]:
    """One list of a lexicon table. Words become part of the expression, hence the size check."""
    rows = table.where(F.col("lexicon") == lexicon).select("word").distinct().limit(MAX_LEXICON_WORDS + 1).collect()
    if len(rows) > MAX_LEXICON_WORDS:
        raise ValueError(f"lexicon {lexicon!r} has more than {MAX_LEXICON_WORDS} words")
    return sorted(row.word for row in rows)
