"""Stopword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default English stopwords.
ENGLISH = """
a about above after again against all am an and any are aren't as at be because been before being
below between both but by can't cannot could couldn't did didn't do does doesn't doing don't down
during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's
its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than
that that's the their theirs them themselves then there there's these they they'd they'll they're
they've this those through to too under until up very was wasn't we we'd we'll we're we've were
weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """The distinct words of a whitespace-separated list; an empty path means no stopwords.

    A leading margin bar on a line is removed.
    """
    if not path:
        return spark.createDataFrame([], "term STRING")
    line = F.regexp_replace("value", r"^\s*\|", "")
    return (spark.read.text(path)
            .select(F.explode(F.split(line, r"\s+")).alias("term"))
            .filter(F.col("term") != "").distinct())


def default_stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ENGLISH], "term STRING")
