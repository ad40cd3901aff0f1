"""Job search: applications, interviews, funnel, compensation and response times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions.dates import moment, plus_days
from keepsake.functions.order import pg_asc
from keepsake.sources.tables import APPLICATION_STATUSES


def upcoming_interviews(interviews: DataFrame, applications: DataFrame, postings: DataFrame,
                        companies: DataFrame, as_of, days: int = 14) -> DataFrame:
    """Scheduled interviews of the next ``days`` days (0 means 14) with application, posting and
    company, by time.

    The interviews are filtered first; the chain of joins then starts from the small side.
    """
    now = moment(as_of)
    soon = interviews.where((F.col("status") == "scheduled") & (F.col("scheduled_at") >= now)
                            & (F.col("scheduled_at") <= plus_days(now, days or 14)))
    app = applications.select(F.col("id").alias("application_id"), "job_posting_id",
                              F.col("status").alias("application_status"))
    post = postings.select(F.col("id").alias("job_posting_id"), "company_id",
                           F.col("title").alias("posting_title"))
    firm = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return (soon.join(app, "application_id").join(post, "job_posting_id").join(firm, "company_id")
            .orderBy(pg_asc("scheduled_at"), pg_asc("id")))


def application_overview(applications: DataFrame, interviews: DataFrame, postings: DataFrame,
                         companies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per user: applications in total and by status, and upcoming interviews (0 days means 7)."""
    by_status = applications.groupBy("user_id").agg(
        F.count("*").alias("total_applications"),
        *[F.count_if(F.col("status") == s).alias(s) for s in APPLICATION_STATUSES])
    soon = upcoming_interviews(interviews, applications, postings, companies, as_of, days or 7)
    per_user = soon.groupBy("user_id").agg(F.count("*").alias("upcoming_interviews"))
    return by_status.join(per_user, "user_id", "left").withColumn(
        "upcoming_interviews", F.coalesce("upcoming_interviews", F.lit(0)))


def funnel(interviews: DataFrame, stages: list[str]) -> DataFrame:
    """Applications that reached each stage, and the share that also reached the next one.

    Columns: ``stage_no, stage, reached, converted, rate``.
    """
    flags = interviews.groupBy("application_id").agg(
        *[F.coalesce(F.bool_or(F.col("interview_type") == s), F.lit(False)).alias(f"s{i}")
          for i, s in enumerate(stages)])
    sums = []
    for i, _ in enumerate(stages):
        nxt = F.col(f"s{i}") & F.col(f"s{i + 1}") if i + 1 < len(stages) else F.lit(None).cast("boolean")
        sums += [F.count_if(F.col(f"s{i}")).alias(f"r{i}"), F.count_if(nxt).alias(f"c{i}")]
    totals = flags.agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), F.col(f"r{i}").alias("reached"),
                 (F.col(f"c{i}") if i + 1 < len(stages) else F.lit(None).cast("bigint")).alias("converted"))
        for i, s in enumerate(stages)])
    return totals.select(F.inline(rows)).withColumn("rate", F.try_divide("converted", "reached"))


def interview_performance(interviews: DataFrame) -> DataFrame:
    """Number and average rating of completed interviews by type."""
    return interviews.where(F.col("status") == "completed").groupBy("interview_type").agg(
        F.count("*").alias("interviews"), F.avg("rating").alias("avg_rating"))


def compensation(postings: DataFrame, bucket: int = 1000) -> DataFrame:
    """Salary midpoint per posting, and its rank within the currency (1 is the best paid).

    A currency may hold most postings, so nothing is sorted per currency as a whole: equal midpoints
    are counted first, ranked inside salary buckets, and each bucket is offset by the size of the
    better buckets.
    """
    low, high = F.col("salary_min"), F.col("salary_max")
    mid = ((F.coalesce(low, high) + F.coalesce(high, low)) / 2).cast("double")
    priced = postings.select("*", mid.alias("midpoint"))
    counted = (priced.where("midpoint is not null").groupBy("salary_currency", "midpoint")
               .agg(F.count("*").alias("n"))
               .withColumn("bucket", F.floor(F.col("midpoint") / bucket)))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counted.withColumn("ahead", before(
        Window.partitionBy("salary_currency", "bucket").orderBy(F.col("midpoint").desc())))
    offsets = counted.groupBy("salary_currency", "bucket").agg(F.sum("n").alias("n")).withColumn(
        "better", before(Window.partitionBy("salary_currency").orderBy(F.col("bucket").desc())))
    ranks = inside.join(offsets.drop("n"), ["salary_currency", "bucket"]).select(
        "salary_currency", "midpoint", (F.col("ahead") + F.col("better") + 1).alias("rank_in_currency"))
    return priced.join(ranks, ["salary_currency", "midpoint"], "left")


def response_times(applications: DataFrame) -> DataFrame:
    """Days from application to response by user: answers, average, median and 90th percentile.

    Exact percentiles over day counts, of which there are few distinct ones; partial results of a
    user with very many applications stay small.
    """
    waited = F.datediff("response_date", "applied_date")
    answered = applications.where(waited.isNotNull()).select("user_id", waited.alias("d"))
    return answered.groupBy("user_id").agg(
        F.count("*").alias("answers"), F.avg("d").alias("avg_days"),
        F.percentile("d", 0.5).alias("median_days"), F.percentile("d", 0.9).alias("p90_days"))
