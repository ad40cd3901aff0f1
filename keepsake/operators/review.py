"""Reviews over captured thoughts: statistics, daily digest, weekly review, gaps and themes.

``thoughts``: ``id, created_at, type, source, topics, people, action_items``.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions.dates import moment
from keepsake.operators.retrieval import novelty, usable_vectors


def _within(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.where((F.col("created_at") >= start) & (F.col("created_at") < end))


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def thought_stats(thoughts: DataFrame, n: int | None = None) -> DataFrame:
    """Counts by facet: ``facet, value, thoughts`` for the total, types, sources, topics and people.

    One pass: every thought lists its (facet, value) pairs, which are counted with a map-side combine.
    ``n`` keeps the most frequent values of each facet, ties by name.
    """
    text = lambda c: F.array(F.col(c))
    facet = lambda name, values: F.transform(
        F.array_distinct(F.array_compact(F.coalesce(values, F.array().cast("array<string>")))),
        lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
    pairs = F.concat(facet("total", F.array(F.lit("all"))), facet("type", text("type")),
                     facet("source", text("source")), facet("topic", F.col("topics")),
                     facet("person", F.col("people")))
    counts = (thoughts.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value")
              .agg(F.count("*").alias("thoughts")))
    if n is None:
        return counts
    order = Window.partitionBy("facet").orderBy(F.col("thoughts").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def topic_counts(thoughts: DataFrame) -> DataFrame:
    """Thoughts per topic."""
    return (thoughts.select("id", F.explode(F.array_distinct("topics")).alias("topic"))
            .groupBy("topic").agg(F.count("*").alias("thoughts")))


def themes(thoughts: DataFrame, start=None, end=None, n: int = 5) -> DataFrame:
    """The ``n`` topics with most thoughts in a window, ties by name."""
    rows = thoughts
    if start is not None:
        rows = rows.where(F.col("created_at") >= moment(start))
    if end is not None:
        rows = rows.where(F.col("created_at") < moment(end))
    return topic_counts(rows).orderBy(F.col("thoughts").desc(), F.col("topic").asc()).limit(n)


def vector_themes(thoughts: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """Thoughts with the theme their vector falls into (k-means by cosine): ``id, theme``. Zero vectors have none."""
    rows = usable_vectors(thoughts).select(
        "id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n, seed=seed, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("theme"))


def daily_digest(thoughts: DataFrame, as_of, topics: int = 5, highlights: int = 3) -> DataFrame:
    """The last 24 hours as rows ``section, rank, label, value``.

    Sections: ``count`` (number of thoughts), ``topic`` (most frequent topics), ``highlight`` (the
    most unusual thoughts; only when the thoughts carry embeddings).
    """
    day = _within(thoughts, moment(as_of) - _days(1), moment(as_of))
    count = day.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("count").alias("section"), F.lit(1).alias("rank"), F.lit("thoughts").alias("label"), "value")
    order = Window.partitionBy("section").orderBy(F.col("thoughts").desc(), F.col("topic").asc())
    top = themes(day, n=topics).withColumn("section", F.lit("topic")).select(  # at most ``topics`` rows
        "section", F.row_number().over(order).alias("rank"),
        F.col("topic").alias("label"), F.col("thoughts").cast("double").alias("value"))
    out = count.unionByName(top)
    if "embedding" in thoughts.columns:
        odd = novelty(day, n=highlights).withColumn("section", F.lit("highlight"))
        order = Window.partitionBy("section").orderBy(F.col("novelty").desc(), F.col("id").asc())
        out = out.unionByName(odd.select(
            "section", F.row_number().over(order).alias("rank"),
            F.col("id").cast("string").alias("label"), F.col("novelty").alias("value")))
    return out


def weekly_review(thoughts: DataFrame, as_of) -> DataFrame:
    """Topics of the last 7 days against the 7 days before: ``topic, this_week, last_week, trend``.

    Trend is new, growing, steady, shrinking or dropped. Both weeks come from one scan and one
    aggregate.
    """
    end = moment(as_of)
    middle = end - _days(7)
    rows = _within(thoughts, end - _days(14), end).select(
        (F.col("created_at") >= middle).alias("now"), F.explode(F.array_distinct("topics")).alias("topic"))
    counts = rows.groupBy("topic").agg(F.count_if("now").alias("this_week"),
                                       F.count_if(~F.col("now")).alias("last_week"))
    a, b = F.col("this_week"), F.col("last_week")
    trend = (F.when(b == 0, "new").when(a == 0, "dropped").when(a > b, "growing")
             .when(a < b, "shrinking").otherwise("steady"))
    return counts.withColumn("trend", trend)


def weekly_trend(thoughts: DataFrame) -> DataFrame:
    """Captures per topic and ISO week with the previous captured week's number beside it.

    The window runs over weekly totals, a few rows per topic.
    """
    week = F.to_date(F.date_trunc("week", "created_at")).alias("week")
    counts = (thoughts.select(week, F.explode(F.array_distinct("topics")).alias("topic"))
              .groupBy("topic", "week").agg(F.count("*").alias("captures")))
    order = Window.partitionBy("topic").orderBy("week")
    return counts.withColumn("previous", F.lag("captures").over(order))


def people_review(thoughts: DataFrame, as_of, n: int = 5) -> DataFrame:
    """The ``n`` people named most in the last 7 days: ``person, mentions``, ties by name."""
    week = _within(thoughts, moment(as_of) - _days(7), moment(as_of))
    return (week.select(F.explode(F.array_distinct("people")).alias("person")).groupBy("person")
            .agg(F.count("*").alias("mentions"))
            .orderBy(F.col("mentions").desc(), F.col("person").asc()).limit(n))


def open_loops(thoughts: DataFrame, completions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Tasks and thoughts with action items of the last days that no completion (``thought_id``)
    closes."""
    week = _within(thoughts, moment(as_of) - _days(days), moment(as_of))
    asks = week.where((F.col("type") == "task") | (F.size(F.coalesce("action_items", F.array())) > 0))
    return asks.join(completions.select(F.col("thought_id").alias("id")), "id", "left_anti")


def topic_gaps(thoughts: DataFrame, as_of, weeks: int = 4) -> DataFrame:
    """Topics of the ``weeks`` weeks before this one that have no capture in the last 7 days:
    ``topic, earlier``."""
    end = moment(as_of)
    rows = _within(thoughts, end - _days(7 * (weeks + 1)), end).select(
        (F.col("created_at") >= end - _days(7)).alias("now"), F.explode(F.array_distinct("topics")).alias("topic"))
    return (rows.groupBy("topic").agg(F.count_if("now").alias("_now"), F.count("*").alias("earlier"))
            .where("_now = 0").drop("_now"))
