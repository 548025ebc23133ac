"""Lookup replies that outlive a session. A store asks a service only for what it lacks and keeps all generations.

A reply is answered (it has something), empty (the service knows nothing, which is an answer too) or failed. The newest
answer of a key counts; a failure never replaces an answer, and failed keys are asked again by a later run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "service string, key string, state string, body string, error string, generation long"


class ReplyStore:
    """A folder of generations, one for each time that a service was asked."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(f"{path}/replies")

    def all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/replies")

    def latest(self, service: str) -> DataFrame:
        """key, state, body and error of the reply that counts for each key of a service."""
        order = F.struct((F.col("state") != "failed").alias("known"), F.col("generation").alias("g"))
        newest = self.all().filter(F.col("service") == service).groupBy("key").agg(F.max_by(F.struct("state", "body", "error"), order).alias("r"))
        return newest.select("key", "r.*")

    def replies(self, service: str) -> DataFrame:
        """key and body of all that was answered, as the operators take them."""
        return self.latest(service).filter("state = 'answered'").select("key", "body")

    def missing(self, service: str, requests: DataFrame) -> DataFrame:
        """Requests (key, url), one a key, whose key has no answer yet."""
        known = self.all().filter((F.col("service") == service) & (F.col("state") != "failed")).select("key")
        return requests.filter("key is not null").select("key", "url").dropDuplicates(["key"]).join(known, "key", "left_anti")

    def ask(self, service: str, requests: DataFrame, fetch: Callable[[DataFrame, str], DataFrame], has_something: Column) -> int:
        """Asks for what is missing and keeps the replies (fetch: key, body, error); how many keys were asked.

        has_something tells by `body` whether a reply is more than empty. The new generation is written before anything
        is read from it, so a lost session repeats at most its last call.
        """
        wanted = self.missing(service, requests)
        generation = (self.all().agg(F.max("generation")).first()[0] or 0) + 1
        state = F.when(F.col("body").isNull(), "failed").when(F.coalesce(has_something, F.lit(False)), "answered").otherwise("empty")
        told = fetch(wanted, service).select(F.lit(service).alias("service"), "key", state.alias("state"), "body", "error", F.lit(generation).cast("long").alias("generation"))
        told.write.mode("append").parquet(f"{self.path}/replies")
        return self.all().filter((F.col("service") == service) & (F.col("generation") == generation)).count()


def joined_in(replies: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """A fetch for replies that are a table already (key, body): what isn't there failed."""
    return lambda wanted, service: wanted.join(replies.select("key", "body"), "key", "left").withColumn("error", F.when(F.col("body").isNull(), F.lit("not found")))
