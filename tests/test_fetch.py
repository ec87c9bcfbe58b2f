"""Details by id and scrape jobs against a local server that fails now and then; the resolver; counters of jobs while they run."""

import collections
import datetime as dt
import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from terrane.operators import kpi
from terrane.operators.observed import Counters, ingest_counts, observed_ingest
from terrane.operators.resolve import next_cache, outcome_counts, resolve_all
from terrane.plans.scratch import materialize
from terrane.sources.fetch import Client, FetchError, ScrapeSource, fetch_details, healthy, run_detail_jobs


class Stub(BaseHTTPRequestHandler):
    """Places p<n> exist but for those divisible by 3; flaky ones answer the third time, slow ones ask for a pause, broken ones never."""

    calls: collections.Counter = collections.Counter()
    jobs: dict = {}
    deleted: list = []
    lock = threading.Lock()

    def log_message(self, *a) -> None: ...

    def say(self, code: int, body: str, **headers: str) -> None:
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body.encode())))
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self) -> None:
        path = urllib.parse.unquote(self.path)
        with self.lock:
            Stub.calls[path] += 1
            n = Stub.calls[path]
        name = path.rpartition("/")[2]
        if path.startswith("/places/"):
            if name.startswith("flaky") and n < 3:
                return self.say(503, "later")
            if name.startswith("slow") and n < 2:
                return self.say(429, "too many", Retry_After="0.01")
            if name.startswith("broken"):
                return self.say(500, "no")
            if name.startswith("denied"):
                return self.say(403, "key")
            if name.startswith("odd"):
                return self.say(200, "<html>")
            if name.startswith("p") and int(name[1:]) % 3 == 0:
                return self.say(404, "gone")
            return self.say(200, json.dumps({"id": name, "displayName": {"text": f"Quán {name}"}, "location": {"latitude": 21.0, "longitude": 105.5}}))
        if path == "/status":
            return self.say(200, "2 slots available now.")
        if path == "/api/v1/jobs":
            with self.lock:
                for j in Stub.jobs.values():
                    j["polls"] += 1
                listed = [{"id": k, "status": j["ends"] if j["polls"] > 2 else "working"} for k, j in Stub.jobs.items() if not (j["ends"] == "vanish" and j["polls"] > 1)]
            return self.say(200, json.dumps(listed))
        if path.endswith("/download"):
            job = Stub.jobs[path.split("/")[4]]
            if job["body"]["keywords"] == ["nothing"]:
                return self.say(404, "")
            return self.say(200, 'title,place_id,latitude,longitude,address\n"Cà phê, A",x1,21.5,105.5,"1 ""A"" St"\nB,,,,\n')
        return self.say(404, "")

    def do_POST(self) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
        if self.path == "/interpreter":
            return self.say(200, json.dumps({"elements": [{"type": "node", "id": 7, "lat": 21.1, "lon": 105.6, "tags": {"name": "N"}}] if "node(7)" in body else []}))
        if self.path.endswith("/places:searchNearby"):
            return self.say(403 if "refused" in self.path else 400, "empty request")
        body = json.loads(body)
        with self.lock:
            number = f"j{len(Stub.jobs) + 1}"
            Stub.jobs[number] = {"body": body, "polls": 0, "ends": {"bad": "failed", "lost": "vanish"}.get(body["keywords"][0], "ok")}
        return self.say(200, json.dumps({"id": number}))

    def do_DELETE(self) -> None:
        Stub.deleted.append(self.path.rpartition("/")[2])
        self.say(200, "")


@pytest.fixture(scope="module")
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_address[1]}"
    http.shutdown()


def options(url):
    return {c: {"base_url": url, "per_second": 1000.0, "wait_s": 0.01} for c in ("google_places", "osm_overpass", "gosom_scraper")}


ASKED = [(1, "google_places", "p1"), (2, "google_places", "p3"), (3, "google_places", "flaky1"), (4, "google_places", "slow1"), (5, "google_places", "broken1"), (6, "google_places", "denied"), (7, "google_places", "odd"), (8, "osm_overpass", "osm-node-7"), (9, "osm_overpass", "osm-way-7"), (10, "osm_overpass", "node 7"), (11, "gosom_scraper", "x"), (12, "elsewhere", "x"), (13, "google_places", None), (14, "google_places", "a/b c")]


def test_details(spark, server):
    Stub.calls.clear()
    rows = {r.id: r for r in fetch_details(spark.createDataFrame(ASKED, "id long, source_code string, source_poi_id string"), options(server), 3).collect()}
    assert {i: r.status for i, r in rows.items()} == {1: "found", 2: "missing", 3: "found", 4: "found", 5: "error", 6: "error", 7: "error", 8: "found", 9: "missing", 10: "error", 11: "missing", 12: "error", 13: "found", 14: "found"}
    assert Stub.calls["/places/flaky1"] == 3 and Stub.calls["/places/slow1"] == 2 and Stub.calls["/places/broken1"] == 4 and Stub.calls["/places/denied"] == 1
    assert "500" in rows[5].error and "4 tries" in rows[5].error and json.loads(rows[14].raw_payload)["id"] == "b c"


def test_health(server):
    """A bad request is an answer; a refused key, a missing page and a dead port are not."""
    assert healthy("google_places", base_url=server) and healthy("osm_overpass", base_url=server) and healthy("gosom_scraper", base_url=server)
    assert not healthy("google_places", base_url=f"{server}/refused") and not healthy("osm_overpass", base_url=f"{server}/gone")
    assert not any(healthy(c, base_url="http://127.0.0.1:9") for c in ("google_places", "osm_overpass", "gosom_scraper"))


def test_waits_grow_and_pace_is_kept():
    waits = []
    with pytest.raises(FetchError, match="3 tries"):
        Client("http://127.0.0.1:9", per_second=1e9, tries=3, wait_s=1.0, sleep=waits.append).send("GET", "/x")
    assert waits == [1.0, 2.0]


def test_detail_jobs_end_to_end(spark, server):
    sources = spark.createDataFrame([(1, "google_places"), (2, "osm_overpass")], "id int, code string")
    params = lambda i: json.dumps({"source_poi_id": i})
    jobs = spark.createDataFrame(
        [(1, 1, "detail_enrich", params("p1"), "pending", None, None), (2, 1, "detail_enrich", params("p3"), "pending", None, None), (3, 1, "detail_enrich", params("broken2"), "pending", None, None), (4, 2, "detail_enrich", params("osm-node-7"), "pending", None, None), (5, 1, "area_sweep", "{}", "pending", None, None), (6, 1, "detail_enrich", params("p5"), "completed", None, None), (7, 1, "detail_enrich", params("p1"), "pending", None, None)],
        "id long, source_id int, job_type string, params string, status string, completed_at timestamp_ntz, error_message string",
    )
    bronze = spark.createDataFrame([], "source_id int, source_poi_id string, content_hash string")
    at = F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'")
    done, fresh = run_detail_jobs(jobs, sources, bronze, options(server), at, 2, materialize)
    assert {r.id: (r.status, r.error_message is None, r.completed_at is None) for r in done.collect()} == {1: ("completed", True, False), 2: ("completed", True, False), 3: ("failed", False, False), 4: ("completed", True, False), 5: ("pending", True, True), 6: ("completed", True, True), 7: ("completed", True, False)}
    assert sorted((r.source_id, r.source_poi_id, r.lat, r.fetched_at) for r in fresh.collect()) == [(1, "p1", 21.0, dt.datetime(2024, 1, 20, 12)), (2, "osm-node-7", 21.1, dt.datetime(2024, 1, 20, 12))]
    again = run_detail_jobs(jobs, sources, fresh, options(server), at, 2, materialize)[1]
    assert again.count() == 0


def test_scrape_jobs(spark, server):
    spark.dataSource.register(ScrapeSource)
    Stub.deleted.clear()
    jobs = [{"id": i, "lat": 21, "lng": 105, "radius_m": 500, "category": c} for i, c in enumerate(["cafe", "nothing", "bad", "lost", None])]
    rows = spark.read.format("scrape_jobs").option("base_url", server).option("jobs", json.dumps(jobs)).option("poll_s", "0.01").option("per_second", "1000").load().collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.job_id].append(r)
    assert [len(by[i]) for i in range(5)] == [2, 0, 1, 1, 2]
    assert json.loads(by[0][0].raw_payload) == {"title": "Cà phê, A", "place_id": "x1", "latitude": "21.5", "longitude": "105.5", "address": '1 "A" St'}
    assert "ended as failed" in by[2][0].error and "gone" in by[3][0].error and len(Stub.deleted) == 5


# --------------------------------------------------------------------------- resolver


def test_no_pair_is_lost(spark):
    """Failing, flaky and hanging calls, a cache with old rows, and a budget: each pair comes back once, with its outcome."""
    pairs = spark.range(60).select(F.col("id").alias("a_id"), (F.col("id") + 1000).alias("b_id"), (F.lit(0.65) + F.col("id") / 1000).alias("score"), F.lit("needs_llm").alias("decision"))
    pairs = pairs.unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "score", "decision")).unionByName(pairs.limit(5).withColumn("decision", F.lit("distinct")))

    def resolver(a, b):
        i = a["id"]
        if i % 10 == 1:
            raise RuntimeError("down")
        if i % 10 == 2:
            seen[i] = seen.get(i, 0) + 1
            if seen[i] < 3:
                raise TimeoutError("not yet")
        if i == 55:
            time.sleep(30)
        return i % 2 == 0, 0.9, f"of {i}" + "x" * 600

    seen: dict[int, int] = {}
    at = F.expr("TIMESTAMP '2024-01-20 12:00:00'")
    cache = spark.createDataFrame([(50, 1050, True, 0.7, "kept", dt.datetime(2024, 1, 18)), (51, 1051, False, 0.7, "too old", dt.datetime(2024, 1, 2)), (7, 9999, True, 0.5, "other", dt.datetime(2024, 1, 19)), (52, 1052, None, None, "no answer", dt.datetime(2024, 1, 19))], "lo_id long, hi_id long, same boolean, confidence double, reason string, resolved_at timestamp")
    began = time.monotonic()
    answers = materialize(resolve_all(pairs, resolver, cache, budget=40, as_of=at, tasks=2, wait_s=0.01, limit_s=2.0), "answers")
    assert time.monotonic() - began < 25
    got = {r.lo_id: r for r in answers.collect()}
    assert answers.count() == len(got) == 60 and all(r.hi_id == i + 1000 for i, r in got.items())
    want = {i: "over_budget" if i < 19 else "error" if i % 10 == 1 else "timeout" if i == 55 else "hit" for i in range(60)} | {50: "cached"}
    assert {i: r.outcome for i, r in got.items()} == want
    assert got[32].tries == 3 and got[31].tries == 3 and "down" in got[31].reason and got[31].same is None and got[40].same and len(got[40].reason) == 500 and got[50].reason == "kept"
    counts = {r.outcome: (r.pairs, r.calls) for r in outcome_counts(answers).collect()}
    assert counts["cached"] == (1, 0) and counts["over_budget"] == (19, 0) and counts["error"][1] == 12 and sum(n for n, _ in counts.values()) == 60
    kept = {(r.lo_id, r.hi_id): r.reason for r in next_cache(answers, at, cache).collect()}
    assert kept[(50, 1050)] == "kept" and kept[(7, 9999)] == "other" and (51, 1051) not in kept and (31, 1031) not in kept and (40, 1040) in kept
    assert resolve_all(pairs.limit(0), resolver).count() == 0


def test_many_quick_answers_cost_little(spark):
    """Pairs known to come once each: nothing is shuffled, no thread is started for every few pairs, and hanging calls don't end the others."""
    n = 30_000
    pairs = spark.range(n, numPartitions=2).select(F.col("id").alias("a_id"), (F.col("id") + n).alias("b_id"), F.lit(0.7).alias("score"), F.lit("needs_llm").alias("decision"))
    started = spark.sparkContext.accumulator(0)

    def resolver(a, b):
        if getattr(threading.current_thread(), "seen", None) is None:
            threading.current_thread().seen = True
            started.add(1)
        if a["id"] % 10_000 == 77:
            time.sleep(20)
        return a["id"] % 2 == 0, 0.9, "even"

    asked = resolve_all(pairs, resolver, limit_s=1.0, unique=True)
    assert "Exchange" not in asked._jdf.queryExecution().executedPlan().toString()
    answers = materialize(asked, "answers")
    assert answers.filter("same = (lo_id % 2 = 0) AND hi_id = lo_id + 30000 AND outcome = 'hit'").count() == n - 3 and answers.filter("outcome = 'timeout'").select("lo_id").distinct().count() == 3
    assert started.value <= 8 * 4 + 3


# --------------------------------------------------------------------------- counters


def test_ingest_is_counted_in_one_job(spark):
    rows = [("a", "1", "h"), ("a", "1", "h"), ("a", "2", "h"), ("b", "3", "g"), ("b", None, "g"), ("b", "x" * 256, "g"), ("c", "9", None), ("d", "4", "k"), ("b", "5", "old")]
    incoming = spark.createDataFrame(rows, "source_code string, source_poi_id string, content_hash string").repartition(4)
    existing = spark.createDataFrame([("b", "5", "old")], incoming.schema)
    counters, scans = Counters(), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    keys = ("source_code", "source_poi_id", "content_hash")
    fresh = observed_ingest(incoming.mapInArrow(count, incoming.schema), existing, counters, ["a", "b", "c"], keys=keys)
    fresh = materialize(fresh, "bronze")
    assert fresh.count() == 4 and scans.value == len(rows)
    got = {r.source: tuple(r)[1:] for r in ingest_counts(spark, counters, ["a", "b", "c"]).collect()}
    assert got == {"a": (3, 2, 1, 0), "b": (4, 1, 1, 2), "c": (1, 0, 0, 1), "": (1, 1, 0, 0)}
    materialize(observed_ingest(incoming, fresh.select(*keys).unionByName(existing), counters, ["a", "b", "c"], keys=keys), "bronze")
    assert {r.source: (r.fetched, r.new) for r in ingest_counts(spark, counters, ["a", "b", "c"]).collect()}["a"] == (6, 2)
    lines = {r.line for r in kpi.metric_lines(counters.frame(spark)).collect()}
    assert 'terrane_new{source="b"} 1' in lines and 'terrane_errors{source="c"} 2' in lines and "terrane_fetched 2" in lines


def test_streams_are_counted_too(spark, tmp_path):
    counters = Counters()
    listener = counters.listener()
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        for k in range(3):
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"source": s, "ok": i % 2 == 0}) for i, s in enumerate(["a", "a", "b", "z"])))
        stream = spark.readStream.schema("source string, ok boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        seen = counters.watch_stream(stream, "landing", F.col("source"), ["a", "b"], fetched=F.lit(True), ok=F.col("ok"))
        query = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):
            if counters.sums().get(("fetched", "a")) == 6:
                break
            time.sleep(0.1)
        sums = counters.sums()
        assert sums[("fetched", "a")] == 6 and sums[("fetched", "")] == 3 and sums[("ok", "a")] == 3 and sums[("ok", "b")] == 3 and sums[("ok", "")] == 0
    finally:
        spark.streams.removeListener(listener)
