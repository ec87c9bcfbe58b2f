"""Pairs that need a model: asked within a budget, concurrently, with retries; every pair comes back with its outcome."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a model is told of each place beside its id, and the column of silver that says it.
RECORD = (
    ("name", "name_original"),
    ("address", "address_normalized"),
    ("address_components", "address_components"),
    ("phone", "phone_e164"),
    ("website", "website"),
    ("website_domain", "website_domain"),
    ("brand", "brand"),
    ("category", "openooh_category"),
    ("subcategory", "openooh_subcategory"),
)
#: Days that an answer stays valid; calls at a time in a task, tries of a pair, seconds before the first new try and for a whole pair.
CACHE_DAYS, CONCURRENT, TRIES, WAIT_S, LIMIT_S = 7, 8, 3, 0.5, 60.0
ANSWER = "lo_id long, hi_id long, same boolean, confidence double, reason string, outcome string, tries int"
Resolver = Callable[[dict, dict], tuple[bool, float, str]]


def _asked(pairs: DataFrame, records: DataFrame | None) -> DataFrame:
    """Pairs with what a model is told of both places, as JSON."""
    for side in ("lo", "hi"):
        told = F.lit(None).cast("string").alias(f"{side}_record")
        if records is None:
            pairs = pairs.select("*", told)
        else:
            has = [F.col(c).alias(k) for k, c in RECORD if c in records.columns]
            told = F.to_json(F.struct("id", *has), {"ignoreNullFields": "false"}).alias(f"{side}_record")
            pairs = pairs.join(records.select(F.col("id").alias(f"{side}_id"), told), f"{side}_id", "left")
    return pairs


def _ask(resolver: Resolver, a: dict, b: dict, tries: int, wait_s: float, until: float) -> tuple:
    """same, confidence, reason, outcome, tries of one pair."""
    for i in range(1, tries + 1):
        try:
            same, confidence, reason = resolver(a, b)
            return bool(same), float(confidence), str(reason)[:500], "hit", i
        except Exception as e:  # noqa: BLE001: whatever a resolver raises is the pair's outcome
            pause = wait_s * 2 ** (i - 1)
            if i == tries or time.monotonic() + pause > until:
                return None, None, f"{type(e).__name__}: {e}"[:500], "error", i
            if pause > 0:
                time.sleep(pause)
    raise AssertionError


def _calls(resolver: Resolver, concurrent: int, tries: int, wait_s: float, limit_s: float):
    def places(ids: pa.Array, records: pa.Array) -> list[dict]:
        told = None if records.null_count == len(records) else records.to_pylist()
        return [{"id": i} for i in ids.to_numpy(zero_copy_only=False).tolist()] if told is None else [json.loads(r) if r else {"id": i} for i, r in zip(ids.to_pylist(), told, strict=True)]

    def answered(lo: list[dict], hi: list[dict]) -> list[tuple]:
        out: list[tuple | None] = [None] * len(lo)
        todo = iter(range(len(lo)))  # shared: a step of it is never given to two threads
        ended: queue.SimpleQueue = queue.SimpleQueue()
        begun: dict[int, tuple[int, float]] = {}  # by thread that is waited for: its pair, and since when

        def work(me: int) -> None:
            for i in todo:
                since = time.monotonic()
                begun[me] = i, since
                answer = _ask(resolver, lo[i], hi[i], tries, wait_s, since + limit_s)
                if out[i] is not None:  # too late: another thread has its place
                    return
                out[i] = answer
            ended.put(me)

        def start() -> None:
            me = len(started)
            started.append(me)
            running.add(me)
            threading.Thread(target=work, args=(me,), daemon=True).start()

        started: list[int] = []
        running: set[int] = set()
        for _ in range(min(concurrent, len(lo))):
            start()
        while running:
            try:
                running.discard(ended.get(timeout=0.05))
                continue
            except queue.Empty:
                pass
            for me in list(running):
                i, since = begun.get(me, (None, 0.0))
                if i is not None and out[i] is None and time.monotonic() - since > limit_s:  # its thread may never come back: another takes its place
                    out[i] = None, None, f"no answer in {limit_s:g} s", "timeout", 1
                    running.discard(me)
                    start()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                answers = zip(*answered(*(places(batch.column(f"{n}_id"), batch.column(f"{n}_record")) for n in ("lo", "hi"))), strict=True)
                made = [pa.array(v, t) for v, t in zip(answers, (pa.bool_(), pa.float64(), pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("lo_id"), batch.column("hi_id"), *made], names=["lo_id", "hi_id", "same", "confidence", "reason", "outcome", "tries"])

    return run


def resolve_all(
    pairs: DataFrame,
    resolver: Resolver,
    cache: DataFrame | None = None,
    records: DataFrame | None = None,
    budget: int | None = None,
    as_of: Column | None = None,
    tasks: int | None = None,
    concurrent: int = CONCURRENT,
    tries: int = TRIES,
    wait_s: float = WAIT_S,
    limit_s: float = LIMIT_S,
    unique: bool = False,
) -> DataFrame:
    """lo_id, hi_id, same, confidence, reason, outcome, tries for every different pair that needs a model. unique: pairs are known to
    come once each, so they needn't be brought together.

    outcome: 'cached' (the cache has an answer: its resolved_at, if it has that column, is at most CACHE_DAYS before as_of), 'hit', 'error'
    (each try raised; the last error is the reason), 'timeout', or 'over_budget' (not asked: of more pairs than `budget` those of
    the highest score are asked, ties by ids). same and confidence are null without an answer. At most `tasks` times `concurrent` calls
    run at once. The result is to be written once and read from there: a plan that runs again asks again.
    """
    now = F.current_timestamp() if as_of is None else as_of
    asked = pairs.filter("decision = 'needs_llm'").select(F.least("a_id", "b_id").alias("lo_id"), F.greatest("a_id", "b_id").alias("hi_id"), "score")
    if not unique:
        asked = asked.groupBy("lo_id", "hi_id").agg(F.max("score").alias("score"))
    known = None
    if cache is not None:
        fresh = cache.filter(F.col("resolved_at") >= now - F.make_dt_interval(days=F.lit(CACHE_DAYS))) if "resolved_at" in cache.columns else cache
        fresh = fresh.filter("same IS NOT NULL").dropDuplicates(["lo_id", "hi_id"])
        known = asked.select("lo_id", "hi_id").join(fresh.select("lo_id", "hi_id", "same", "confidence", "reason"), ["lo_id", "hi_id"]).select("*", F.lit("cached").alias("outcome"), F.lit(0).alias("tries"))
        asked = asked.join(fresh.select("lo_id", "hi_id"), ["lo_id", "hi_id"], "left_anti")
    left = None
    if budget is not None:
        chosen = asked.orderBy(F.desc("score"), "lo_id", "hi_id").limit(budget)
        rest = asked.join(chosen.select("lo_id", "hi_id"), ["lo_id", "hi_id"], "left_anti")
        none = lambda kind: F.lit(None).cast(kind)
        left = rest.select("lo_id", "hi_id", none("boolean").alias("same"), none("double").alias("confidence"), none("string").alias("reason"), F.lit("over_budget").alias("outcome"), F.lit(0).alias("tries"))
        asked = chosen
    asked = _asked(asked.drop("score"), records)
    if tasks is not None:
        asked = asked.repartition(tasks)
    out = asked.select(F.col("lo_id").cast("long"), F.col("hi_id").cast("long"), "lo_record", "hi_record").mapInArrow(_calls(resolver, concurrent, tries, wait_s, limit_s), ANSWER)
    for more in (known, left):
        out = out if more is None else out.unionByName(more)
    return out


def next_cache(answers: DataFrame, as_of: Column | None = None, cache: DataFrame | None = None) -> DataFrame:
    """lo_id, hi_id, same, confidence, reason, resolved_at: new answers, and of the old cache what is still valid and not asked again."""
    now = F.current_timestamp() if as_of is None else as_of
    columns = ("lo_id", "hi_id", "same", "confidence", "reason", "resolved_at")
    new = answers.filter("outcome = 'hit'").withColumn("resolved_at", now).select(*columns)
    if cache is None:
        return new
    valid = cache.filter(F.col("resolved_at") >= now - F.make_dt_interval(days=F.lit(CACHE_DAYS)))
    return new.unionByName(valid.join(new.select("lo_id", "hi_id"), ["lo_id", "hi_id"], "left_anti").select(*columns))


def outcome_counts(answers: DataFrame) -> DataFrame:
    """outcome, pairs, calls."""
    return answers.groupBy("outcome").agg(F.count("*").alias("pairs"), F.sum("tries").alias("calls"))
