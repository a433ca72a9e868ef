"""The stateless cleaning stages and exact deduplication on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import judged
from ..operators.quality import Quality


def clean_stream(stream: DataFrame, text: str, config: Quality = Quality(), event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Valid rows with ``clean``, each cleaned text once.

    Without ``event_time`` the state keeps a digest of every text seen; with it,
    digests are forgotten ``delay`` after the watermark has passed them.
    """
    valid = judged(stream, text, config).where("reject_reason is null").drop("reject_reason").withColumn("digest", F.sha2("clean", 256))
    if event_time is None:
        return valid.dropDuplicates(["digest"])
    return valid.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])
