"""The engines on streams. They are stateless maps, so a stream takes the same plan as a table; counts take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classifier import Classifier
from ..operators.converter import Converter
from ..operators.validator import Validator


def classify(stream: DataFrame, text: str, classifier: Classifier) -> DataFrame:
    return classifier.rows(stream, text)


def validate(stream: DataFrame, json_col: str, validator: Validator) -> DataFrame:
    return validator.transform(stream, json_col)


def convert(stream: DataFrame, json_col: str, converter: Converter) -> DataFrame:
    return converter.transform(stream, json_col)


def hits_per_window(stream: DataFrame, text: str, time: str, classifier: Classifier, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits by rule and window, once the watermark has passed it."""
    hits = classifier.rows(stream.withWatermark(time, late), text)
    return hits.groupBy(F.window(time, window), "rule_id").count()
