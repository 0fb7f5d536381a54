"""Enrichment: preprocess, classify, locate, prioritise, geocode."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siren import lexicons as L
from siren.functions import scoring
from siren.functions.places import first_usable, location_columns, location_steps
from siren.functions.text import clean_text, extract_hashtags, hashtags_str
from siren.operators.gazetteer import Places, attach_coordinates, gazetteer_match, prepare
from siren.operators.lookup import computed_once, lookup_join, row_hash, written
from siren.schemas import ensure_columns

#: What enriching reads of a report; all that it adds follows from these.
TEXT_COLUMNS = ("content", "user_bio", "user_location")
#: Different texts up to which they are enriched once each and joined back, and the texts a report must repeat on average.
MAX_REPEATED, MIN_COPIES = 100_000, 4
#: Rows of a piece that answers are joined to: so few large files do not make few long tasks, nor streams many small files.
ROWS_PER_JOIN_TASK = 1_000_000

ScoreFn = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
EntityFn = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def preprocess(df: DataFrame) -> DataFrame:
    """Add clean_text, keyword_score, hashtags and hashtags_str."""
    return (
        ensure_columns(df)
        .withColumns({
            "clean_text": clean_text("content"),
            "keyword_score": scoring.keyword_score("content"),
            "hashtags": extract_hashtags("content"),
        })
        .withColumn("hashtags_str", hashtags_str("hashtags"))
    )


def rule_classify(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """Add category, urgency_score and all_probs by word rules.

    The word counts are columns of their own, so that each is computed once however often the rules, or later
    filters on the results, refer to it.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    counted = computed_once(df, {
        "_help": scoring.present_words(lowered, L.HELP_WORDS),
        "_damage": scoring.present_words(lowered, L.DAMAGE_WORDS),
        "_information": scoring.present_words(lowered, L.INFORMATION_WORDS),
        "_keywords": scoring.urgency_keyword_score(text),
    })
    decided = counted.withColumn(
        "category", scoring.rule_category(F.col("_help"), F.col("_damage"), F.col("_information"))
    ).withColumn("_probability", scoring.rule_help_probability(F.col("category"), F.col("_help")))
    return decided.withColumns({
        "urgency_score": scoring.urgency_blend(F.col("_probability"), F.col("_keywords")),
        "all_probs": scoring.rule_probs(F.col("category"), F.col("_probability")),
    }).drop("_help", "_damage", "_information", "_keywords", "_probability")


def probability_classify(df: DataFrame, probabilities: Column, text: str = "clean_text") -> DataFrame:
    """Add category, urgency_score and all_probs from an array of the three class probabilities.

    The category is the most probable class, the first of them on a tie.
    """
    labels = F.array(*[F.lit(label) for label in L.LABELS])
    # A filter on the result must not run the scorer a second time.
    scored = computed_once(df, {"_probabilities": probabilities})
    best = F.array_position("_probabilities", F.array_max("_probabilities")).cast("int")
    probability = [F.get("_probabilities", index) for index in range(len(L.LABELS))]
    return scored.withColumns({
        "category": F.element_at(labels, best),
        "urgency_score": scoring.urgency_blend(probability[1], scoring.urgency_keyword_score(text)),
        "all_probs": scoring.probability_map(*probability),
    }).drop("_probabilities")


def model_classify(df: DataFrame, model: PipelineModel, text: str = "clean_text") -> DataFrame:
    """Classify with a fitted pipeline that reads column ``text`` and writes ``probability``."""
    scored = model.transform(df.withColumn("text", F.col(text)))
    result = probability_classify(scored, vector_to_array("probability"), text)
    return result.select(*df.columns, "category", "urgency_score", "all_probs")


def _batchwise(function: ScoreFn) -> ScoreFn:
    """A user's function under the hints by which Spark knows it takes batches, whatever it is written as."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from function(batches)

    return run


def classify(
    df: DataFrame, model: PipelineModel | None = None, score_fn: ScoreFn | None = None, text: str = "clean_text"
) -> DataFrame:
    """Classify with a model or a user's scorer when there is one, else by rules; ``model_mode`` tells which.

    ``score_fn`` takes an iterator of text batches and yields series of three probabilities per text; it runs in
    Arrow batches and can load its model once per task.
    """
    if model is not None:
        return model_classify(df, model, text).withColumn("model_mode", F.lit("model"))
    if score_fn is not None:
        scorer = F.pandas_udf(_batchwise(score_fn), T.ArrayType(T.DoubleType()))
        return probability_classify(df, scorer(text), text).withColumn("model_mode", F.lit("model"))
    return rule_classify(df, text).withColumn("model_mode", F.lit("rule-based"))


def extract_location(
    df: DataFrame, gazetteer: DataFrame | Places | None = None, entity_fn: EntityFn | None = None, **sizes: int
) -> DataFrame:
    """Add location, location_source and location_confidence.

    Places in text and bio come from the gazetteer or from a user's ``entity_fn`` (text batches to place names or
    NULL, an empty name counts as none); without either only patterns, hashtags and the profile are used.
    """
    text_place = bio_place = None
    prepared = df
    if entity_fn is not None:
        finder = F.pandas_udf(_batchwise(entity_fn), T.StringType())
        prepared = computed_once(df, {"_text_place": finder("content"), "_bio_place": finder("user_bio")})
    elif gazetteer is not None:
        prepared = gazetteer_match(df, gazetteer, {"content": "_text_place", "user_bio": "_bio_place"}, **sizes)
    if prepared is not df:
        text_place, bio_place = F.col("_text_place"), F.col("_bio_place")
    steps = location_steps("content", "hashtags_str", "user_location", "user_bio", text_place, bio_place)
    located = computed_once(prepared, {"_found": first_usable(steps)})
    return located.withColumns(location_columns("_found")).drop("_found", "_text_place", "_bio_place")


def prioritise(df: DataFrame) -> DataFrame:
    return df.withColumn("priority", scoring.priority_label("urgency_score", "location_source"))


def enrich(
    df: DataFrame,
    gazetteer: DataFrame | Places | None = None,
    model: PipelineModel | None = None,
    score_fn: ScoreFn | None = None,
    entity_fn: EntityFn | None = None,
    geocode: bool = True,
) -> DataFrame:
    """Raw reports to enriched reports; with a short gazetteer and the word rules no Python runs on the rows."""
    places = None if gazetteer is None else prepare(gazetteer)
    located_reports = extract_location(classify(preprocess(df), model, score_fn), places, entity_fn)
    result = prioritise(located_reports)
    if geocode and places is not None:
        return attach_coordinates(result, places)
    return result.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})


def enrich_repeated(df: DataFrame, gazetteer: DataFrame | Places | None = None, **options) -> DataFrame:
    """The same as ``enrich``, where each different (content, bio, profile) is worked on once if reports repeat them."""
    places = None if gazetteer is None else prepare(gazetteer)
    geocode = options.pop("geocode", True)

    def few(texts: DataFrame) -> DataFrame:
        if not geocode or places is None:
            return enrich(texts, places, geocode=geocode, **options)
        # Coordinates are looked up for the written texts, which are few however large the gazetteer is.
        found = written(enrich(texts, places, geocode=False, **options), "enriched-texts")
        return attach_coordinates(found.drop("lat", "lon"), places, rows_are_written=True)

    return once_each(df, few, lambda rows: enrich(rows, places, geocode=geocode, **options))


def once_each(
    df: DataFrame, work: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The columns that ``work`` adds to reports, where it sees each different (content, bio, profile) once if these repeat.

    Equal texts have equal answers. A sketch counts the different ones; if they are few and come often, they are worked on,
    written, and joined to the reports where these are. Otherwise every report is worked on as it stands.
    """
    rows = ensure_columns(df, TEXT_COLUMNS)
    seen = rows.withColumn("_piece", F.spark_partition_id()).agg(
        F.approx_count_distinct(F.xxhash64(*TEXT_COLUMNS), 0.02).alias("different"), F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct("_piece").alias("pieces"),
    ).first()
    if seen["different"] > MAX_REPEATED or seen["n"] < MIN_COPIES * seen["different"]:
        return (otherwise or work)(df)
    texts = written(work(rows.select(*TEXT_COLUMNS).distinct()), "texts-once")
    columns = [name for name in texts.columns if name not in TEXT_COLUMNS]
    rows = rows.select(*[name for name in rows.columns if name not in columns])
    wanted = -(-seen["n"] // ROWS_PER_JOIN_TASK)
    # Pieces of up to twice the rows stay where they are: moving all rows costs more.
    if 2 * seen["pieces"] < wanted:
        rows = rows.repartition(wanted, row_hash(rows))
    joined = lookup_join(
        rows.withColumn("_texts", F.struct(*TEXT_COLUMNS)),
        texts.select(F.struct(*TEXT_COLUMNS).alias("_texts"), *columns), "_texts", row_hash(rows),
    )
    return joined.select(*rows.columns, *columns)
