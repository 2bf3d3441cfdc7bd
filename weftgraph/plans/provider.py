"""Language models behind one interface: batches of prompts to responses.

No model is called here. ``ReplayProvider`` answers from recorded rows, so every stage
around a model runs and is tested offline.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import materialize

#: Seconds to wait after each rate limit, and the least answer that isn't asked again.
BACKOFF = (15, 30, 60)
RETRY_CHARS = 100
RESPONSES = "key string, response string, input_tokens long, output_tokens long, error string"
STORED = f"{RESPONSES}, print string, at timestamp"


class RateLimited(Exception):
    """The model asks to wait."""


class Provider(Protocol):
    """Answers prompts; picklable, since it runs where the partitions are."""

    def answer(self, key: str, prompt: str) -> tuple[str, int, int]: ...


class ReplayProvider:
    """Recorded answers by key."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def answer(self, key: str, prompt: str) -> tuple[str, int, int]:
        text = self.answers[key]
        return text, len(prompt) // 4, len(text) // 4


def with_retry(call: Callable[[], tuple[str, int, int]], wait: Callable[[float], None] = time.sleep) -> tuple[str, int, int]:
    """Call again after rate limits only, a bounded number of times."""
    for pause in BACKOFF:
        try:
            return call()
        except RateLimited:
            wait(pause)
    return call()


class Pace:
    """At most so many calls a second; what tasks share is dealt to them in equal parts."""

    def __init__(self, per_second: float | None, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep):
        self.gap, self.now, self.wait, self.next = (1 / per_second if per_second else 0.0), now, wait, 0.0

    def take(self) -> None:
        if self.gap:
            pause = self.next - self.now()
            if pause > 0:
                self.wait(pause)
            self.next = max(self.next, self.now()) + self.gap


def ask(prompts: DataFrame, provider: Provider, concurrency: int = 2, per_second: float | None = None) -> DataFrame:
    """``prompts``: key, prompt. One row each; a failure is an error, never a lost row.

    ``concurrency`` tasks call at once, ``per_second`` bounds the calls of all together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second and per_second / concurrency)

        def call(key: str, prompt: str) -> tuple[str, int, int]:
            pace.take()
            return provider.answer(key, prompt)

        for b in batches:
            rows = []
            for key, prompt in zip(b["key"], b["prompt"], strict=True):
                try:
                    text, read, wrote = with_retry(lambda k=key, p=prompt: call(k, p))
                    rows.append((key, text, read, wrote, None))
                except Exception as e:
                    rows.append((key, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in RESPONSES.split(",")])

    return prompts.select("key", "prompt").repartition(concurrency, "key").mapInPandas(run, RESPONSES)


class AnswerStore:
    """Answers by key and prompt in a folder, so that a run that broke off asks only what is missing.

    Prompts are asked in waves, and each wave is written before the next one is asked: what a
    killed run loses is the wave at hand. A prompt that changed is another prompt. Failures
    are rows as well; they are asked again by the next run, and what ``answers`` shows of a
    prompt is its answer, else its last failure.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        known = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(STORED).parquet(f"{self.path}/wave=*") if known else self.spark.createDataFrame([], STORED)

    def add(self, answered: DataFrame, name: str | None = None) -> None:
        """Keep rows of ``key``, ``prompt`` and RESPONSES."""
        rows = answered.withColumn("print", F.sha2("prompt", 256)).withColumn("at", F.current_timestamp())
        rows.select(*(x.strip().split(" ")[0] for x in STORED.split(","))).write.parquet(f"{self.path}/wave={name or uuid.uuid4().hex}")

    def missing(self, prompts: DataFrame) -> DataFrame:
        """The prompts without an answer."""
        done = self._rows().filter("error is null").select("key", "print").distinct()
        return prompts.select("key", "prompt").withColumn("print", F.sha2("prompt", 256)).join(done, ["key", "print"], "left_anti").select("key", "prompt")

    def ask(self, prompts: DataFrame, provider: Provider, concurrency: int = 2, per_second: float | None = None, wave: int = 1000) -> DataFrame:
        """The answers of all prompts, after asking those that are missing, ``wave`` of them at a time, about."""
        # written, so that what is missing doesn't change while waves are added
        left = materialize(self.missing(prompts), "prompts-left")
        waves = -(-left.count() // wave)
        for k in range(waves):
            some = left.filter(F.pmod(F.xxhash64("key", "prompt"), F.lit(waves)) == k)
            self.add(ask(some, provider, concurrency, per_second).join(some, "key"))
        return self.answers(prompts)

    def answers(self, prompts: DataFrame) -> DataFrame:
        """RESPONSES of each prompt; ``error`` is ``not asked`` where the store has nothing of it."""
        best = F.max_by(F.struct("response", "input_tokens", "output_tokens", "error"), F.struct(F.col("error").isNull(), "at"))
        known = self._rows().groupBy("key", "print").agg(best.alias("a"), F.lit(True).alias("known"))
        asked = prompts.select("key", F.sha2("prompt", 256).alias("print")).join(known, ["key", "print"], "left")
        error = F.when(F.col("known").isNull(), "not asked").otherwise(F.col("a.error"))
        return asked.select("key", "a.response", "a.input_tokens", "a.output_tokens", error.alias("error"))


def replay(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded answers as a join: for recordings too large for one process."""
    return prompts.join(recorded.select("key", "response"), "key", "left").select(
        "key", "response", (F.length("prompt") / 4).cast("long").alias("input_tokens"),
        F.coalesce((F.length("response") / 4).cast("long"), F.lit(0).cast("long")).alias("output_tokens"),
        F.when(F.col("response").isNull(), "no recording").alias("error"),
    )


def thinking_budget(entities, low: int = 1024, high: int = 16_000, each: int = 100):
    """A budget that grows with the entities, within bounds."""
    return F.least(F.greatest(entities * each, F.lit(low)), F.lit(high))
