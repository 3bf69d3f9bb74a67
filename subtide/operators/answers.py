"""Model calls whose answers are kept.

A request is known by a digest of what decides its answer. Requests without an
answer are dealt to small tasks, and a task's answers are in the store as soon as
the task ends, whatever becomes of the job: after a lost executor or a stopped job
only what lacks an answer is asked. Requests meet the answers in a second step, so
a plan that reads them twice asks nobody twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import store as S

KIND = "digest string, response string, lane int, asked_at double"


class Overloaded(Exception):
    """A model's service asks to wait a little."""


def patiently(call: Callable[[], list[str]], retries: int, sleep: Callable[[float], None]) -> list[str]:
    """``call()``, tried again ``min(5 * attempt, 65)`` seconds after a lost connection and 2 after an overload; other errors are raised."""
    for attempt in range(1, retries + 1):
        try:
            return call()
        except Overloaded:
            if attempt == retries:
                raise
            sleep(2)
        except ConnectionError:
            if attempt == retries:
                raise
            sleep(min(5 * attempt, 65))
    return []


class AnswerStore:
    """Answers by request digest, in a folder that the driver and all executors share.

    ``call(rows)`` gets a list of dicts with the key columns and returns as many
    texts. With ``interval_sec`` each of ``lanes`` callers waits so long between
    the starts of its calls: requests go out in waves of one call a lane, also
    over several runs, as the store knows when a lane last called.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("prompt",), *, per_call: int = 16, retries: int = 20, lanes: int = 1, interval_sec: float = 0.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.per_call, self.retries, self.lanes, self.interval_sec = per_call, retries, lanes, interval_sec
        self.sleep, self.clock = sleep, clock

    def with_digest(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("digest", F.sha2(F.to_json(F.struct(*self.keys)), 256))

    def answers(self) -> DataFrame:
        """(digest, response, lane, asked_at); if two tasks gave one answer each, the first counts."""
        if not S.exists(self.spark, self.path):
            return self.spark.createDataFrame([], KIND)
        kept = self.spark.read.schema(KIND).parquet(self.path)
        return kept.groupBy("digest").agg(F.min_by(F.struct("response", "lane", "asked_at"), F.struct("asked_at", "response")).alias("a")).select("digest", "a.*")

    def missing(self, requests: DataFrame) -> DataFrame:
        """Distinct requests (digest and keys) without an answer."""
        if not S.exists(self.spark, self.path):
            return self.with_digest(requests).select("digest", *self.keys).dropDuplicates(["digest"])
        return self.with_digest(requests).select("digest", *self.keys).dropDuplicates(["digest"]).join(self.answers(), "digest", "left_anti")

    def _asked(self, rows: DataFrame, call: Callable[[list[dict]], list[str]], asked_at: float | None) -> None:
        """Ask rows (lane, digest, keys), of which each partition is one task, and append the answers."""
        keys, retries, size, sleep = self.keys, self.retries, self.per_call, self.sleep if asked_at is None else time.sleep

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), size):
                    some = part.iloc[at : at + size]
                    now = time.time() if asked_at is None else asked_at
                    said = patiently(lambda some=some: call(some[keys].to_dict("records")), retries, sleep)
                    yield pd.DataFrame({"digest": some["digest"].tolist(), "response": said, "lane": some["lane"].tolist(), "asked_at": now})

        # the second algorithm puts a task's file in place when the task ends, not when the job does
        rows.mapInPandas(run, KIND).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)

    def fill(self, requests: DataFrame, call: Callable[[list[dict]], list[str]]) -> None:
        """Ask for every answer that is missing."""
        left = self.missing(requests)
        if not self.interval_sec:
            n = left.count()
            if n:
                self._asked(left.withColumn("lane", F.lit(0)).repartition(-(-n // self.per_call), "digest"), call, None)
            return
        last = {r["lane"]: r["at"] for r in self.answers().groupBy("lane").agg(F.max("asked_at").alias("at")).collect()}
        while wave := left.orderBy("digest").limit(self.lanes * self.per_call).collect():
            n_lanes = -(-len(wave) // self.per_call)
            free = max((last.get(k, float("-inf")) for k in range(n_lanes)), default=float("-inf")) + self.interval_sec
            if free > self.clock():
                self.sleep(free - self.clock())
            now = self.clock()
            rows = self.spark.createDataFrame([(i // self.per_call, *r) for i, r in enumerate(wave)], f"lane int, {', '.join(f'{c} {t}' for c, t in left.dtypes)}")
            self._asked(rows.repartitionByRange(n_lanes, "lane"), call, now)
            last |= dict.fromkeys(range(n_lanes), now)
            left = self.missing(requests)

    def ask(self, requests: DataFrame, call: Callable[[list[dict]], list[str]]) -> DataFrame:
        """requests with ``response``, all of them answered."""
        self.fill(requests, call)
        return self.with_digest(requests).join(self.answers().select("digest", "response"), "digest", "left").select(*requests.columns, "response")
