"""Details by id and scrape jobs over HTTP, on the executors: bounded retries with back-off, and every failure a row."""

from __future__ import annotations

import csv
import io
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrane.operators.bronze import finish_job, new_records, with_hash
from terrane.operators.jobs import start_jobs

from .adapters import ADAPTERS

#: Tries of a request, seconds before the first new one (doubled each time, at most MOST_WAIT_S), seconds of one request.
TRIES, WAIT_S, MOST_WAIT_S, REQUEST_S = 4, 0.5, 30.0, 30.0
#: Status codes after which a request may be tried again.
AGAIN = frozenset({408, 425, 429, 500, 502, 503, 504})
# Fields of a detail request, states of a scrape job, and what is searched for without a category.
DETAIL_FIELDS = "id,displayName,formattedAddress,location,types,primaryType,nationalPhoneNumber,internationalPhoneNumber,websiteUri,rating,userRatingCount"
DONE, FAILED = frozenset({"ok", "completed", "done", "finished"}), frozenset({"failed", "error", "cancelled", "canceled"})
KEYWORDS = ("restaurant", "cafe", "convenience store", "shop")


class FetchError(Exception):
    """A request that failed for good, with the status if a server gave one."""

    def __init__(self, said: str, status: int | None = None) -> None:
        super().__init__(said)
        self.status = status


class Client:
    """Requests of one worker: no two begin within 1 / per_second seconds; a new try waits longer each time, or as the server says."""

    def __init__(self, base_url: str, headers: dict[str, str] | None = None, per_second: float = 10.0, tries: int = TRIES, wait_s: float = WAIT_S, sleep: Callable[[float], None] = time.sleep) -> None:
        self.base_url, self.headers, self.tries, self.wait_s, self.sleep = base_url.rstrip("/"), headers or {}, tries, wait_s, sleep
        self.between, self.next_at, self.sent = 1 / per_second, 0.0, 0

    def send(self, method: str, path: str, body: str | None = None, kind: str = "application/json", headers: dict[str, str] | None = None) -> tuple[int, str]:
        """Status and text; statuses that may pass are tried again, 404 is an answer, other statuses over 399 are errors."""
        said = ""
        for i in range(self.tries):
            wait = self.next_at - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.next_at = time.monotonic() + self.between
            self.sent += 1
            pause = min(MOST_WAIT_S, self.wait_s * 2**i)
            request = urllib.request.Request(self.base_url + path, None if body is None else body.encode(), {"Content-Type": kind, **self.headers, **(headers or {})}, method=method)
            try:
                with urllib.request.urlopen(request, timeout=REQUEST_S) as reply:
                    return reply.status, reply.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                text = e.read().decode("utf-8", "replace")
                if e.code == 404:
                    return 404, text
                said = f"{method} {path}: {e.code} {text[:200]}"
                if e.code not in AGAIN:
                    raise FetchError(said, e.code) from e
                after = e.headers.get("Retry-After", "")
                pause = min(MOST_WAIT_S, float(after)) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", after) else pause
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                said = f"{method} {path}: {e}"
            if i + 1 < self.tries:
                self.sleep(pause)
        raise FetchError(f"{said} ({self.tries} tries)")


def place_detail(client: Client, source_poi_id: str) -> dict | None:
    """A place by its id; None where the server has none."""
    status, text = client.send("GET", f"/places/{urllib.parse.quote(source_poi_id, safe='')}", headers={"X-Goog-FieldMask": DETAIL_FIELDS})
    return None if status == 404 else json.loads(text)


def element_detail(client: Client, source_poi_id: str) -> dict | None:
    """An element of the map by its id osm-kind-number; None where there is none, an error where that is no such id."""
    parts = re.fullmatch(r"osm-(node|way|relation)-([0-9]+)", source_poi_id)
    if not parts:
        raise FetchError(f"not an id of an element: {source_poi_id}")
    status, text = client.send("POST", "/interpreter", f"[out:json][timeout:30];{parts[1]}({parts[2]});out body center tags;", "text/plain")
    found = [] if status == 404 else json.loads(text).get("elements") or []
    return found[0] if found else None


def no_detail(client: Client, source_poi_id: str) -> dict | None:
    """Scrape servers look nothing up by id."""
    return None


#: How each source looks a place up; can be added to.
DETAILS: dict[str, Callable[[Client, str], dict | None]] = {"google_places": place_detail, "osm_overpass": element_detail, "gosom_scraper": no_detail}
DETAIL_ROW = "id long, source_code string, source_poi_id string, raw_payload string, status string, error string"


def healthy(source_code: str, **options) -> bool:
    """Whether a source answers and takes the key: a bad request is an answer, a refused key is none, and so is silence."""
    method, path, body = {"google_places": ("POST", "/places:searchNearby", "{}"), "osm_overpass": ("GET", "/status", None)}.get(source_code, ("GET", "/api/v1/jobs", None))
    try:
        status = Client(**{"tries": 1, **options}).send(method, path, body)[0]
    except FetchError as e:
        status = e.status
    return status is not None and (status not in (401, 403) if source_code == "google_places" else status == 200)


def fetch_details(asked: DataFrame, servers: dict[str, dict], tasks: int, client: Callable[..., Client] = Client) -> DataFrame:
    """A row for each row of asked (id, source_code, source_poi_id): raw_payload, status ('found', 'missing' or 'error') and error.

    servers: options of Client by source. At most `tasks` requests run at once, each in its own pace, so a source sees at most
    tasks * per_second of them. Nothing raises: a server that fails, a bad id and an unknown source are rows with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Client] = {}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                payload, status, error = None, "missing", None
                try:
                    if r.source_code not in DETAILS or r.source_code not in servers:
                        raise FetchError(f"unknown source {r.source_code}")
                    if r.source_code not in clients:
                        clients[r.source_code] = client(**servers[r.source_code])
                    found = DETAILS[r.source_code](clients[r.source_code], r.source_poi_id or "")
                    if found is not None:
                        payload, status = json.dumps(found, ensure_ascii=False), "found"
                except (FetchError, ValueError) as e:
                    status, error = "error", str(e)[:2000]
                out.append((r.id, r.source_code, r.source_poi_id, payload, status, error))
            yield pd.DataFrame(out, columns=["id", "source_code", "source_poi_id", "raw_payload", "status", "error"])

    return asked.select(F.col("id").cast("long"), "source_code", "source_poi_id").repartition(tasks).mapInPandas(run, DETAIL_ROW)


def detail_records(fetched: DataFrame) -> DataFrame:
    """source_code, source_poi_id, raw_payload, lat, lng of what was found, read as the source's other payloads are."""
    found = fetched.filter("status = 'found'")
    out = None
    for code, read in ADAPTERS.items():
        some = read(found.filter(F.col("source_code") == code).select("raw_payload")).select(F.lit(code).alias("source_code"), "source_poi_id", "raw_payload", "lat", "lng")
        out = some if out is None else out.unionByName(some)
    return out


def run_detail_jobs(jobs: DataFrame, sources: DataFrame, bronze: DataFrame, servers: dict[str, dict], as_of: Column, tasks: int, keep: Callable[[DataFrame, str], DataFrame], client: Callable[..., Client] = Client) -> tuple[DataFrame, DataFrame]:
    """(jobs, new bronze rows) after the pending detail_enrich jobs: each is started, its place looked up, what is new appended and the
    job completed, also where the place is gone, or failed with its error. Other jobs stay as they are.

    keep(df, name) writes a step once and reads it again (such as scratch.materialize), so that no server is asked twice.
    """
    detail = F.col("job_type") == "detail_enrich"
    started = start_jobs(jobs, as_of, jobs.filter(detail & (F.col("status") == "pending")).select("id"))
    mine = jobs.filter(detail & (F.col("status") == "pending")).join(F.broadcast(sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))), "source_id", "left")
    fetched = keep(fetch_details(mine.select("id", "source_code", F.get_json_object("params", "$.source_poi_id").alias("source_poi_id")), servers, tasks, client), "details")
    records = with_hash(detail_records(fetched).join(F.broadcast(sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))), "source_code"))
    fresh = keep(new_records(records, bronze), "fresh")
    outcome = fetched.select(F.col("id").alias("job_id"), F.lit(None).cast("long").alias("new"), "error")
    return finish_job(started, outcome, as_of), fresh.withColumn("fetched_at", as_of)


class ScrapeJob(InputPartition):
    def __init__(self, job: dict) -> None:
        self.job = job


class ScrapeReader(DataSourceReader):
    """One partition for each job: submit, poll until it ends, download its rows, delete it."""

    def __init__(self, options: dict[str, str]) -> None:
        self.base_url, self.jobs = options["base_url"], json.loads(options["jobs"])
        self.poll_s, self.most_s = float(options.get("poll_s", "5")), float(options.get("most_s", "600"))
        self.per_second, self.wait_s = float(options.get("per_second", "2")), float(options.get("wait_s", str(WAIT_S)))
        self.missing_polls = int(options.get("missing_polls", "6"))

    def partitions(self) -> list[ScrapeJob]:
        return [ScrapeJob(j) for j in self.jobs]

    def read(self, partition: ScrapeJob) -> Iterator[tuple]:
        number, job = partition.job["id"], partition.job
        client = Client(self.base_url, per_second=self.per_second, wait_s=self.wait_s)
        try:
            for row in self._rows(client, job):
                yield number, json.dumps({k: v for k, v in row.items() if k and v}, ensure_ascii=False), None
        except (FetchError, ValueError) as e:
            yield number, None, str(e)[:2000]

    def _rows(self, client: Client, job: dict) -> Iterator[dict]:
        words = job.get("keywords") or ([job["category"]] if job.get("category") else list(KEYWORDS))
        body = {"name": f"terrane-{job['id']}", "keywords": words, "lang": "vi", "depth": 1, "zoom": job.get("zoom", 15), "lat": str(job["lat"]), "lon": str(job["lng"]), "radius": job["radius_m"], "fast_mode": True, "max_time": int(self.most_s)}
        said = json.loads(client.send("POST", "/api/v1/jobs", json.dumps(body))[1])
        remote = said.get("id") or said.get("ID")
        if not remote:
            raise FetchError("the server gave the job no id")
        try:
            self._wait(client, remote)
            status, text = client.send("GET", f"/api/v1/jobs/{remote}/download")
            if status != 404:  # nothing was found
                yield from csv.DictReader(io.StringIO(text))
        finally:
            try:
                client.send("DELETE", f"/api/v1/jobs/{remote}")
            except FetchError:
                pass

    def _wait(self, client: Client, remote: str) -> None:
        end, missing, seen = time.monotonic() + self.most_s, 0, False
        while True:
            listed = json.loads(client.send("GET", "/api/v1/jobs")[1]) or []
            ours = next((j for j in listed if (j.get("id") or j.get("ID")) == remote), None)
            if ours is None:
                missing += 1
                if seen or missing >= self.missing_polls:
                    raise FetchError(f"job {remote} is gone from the server's list")
            else:
                seen, missing = True, 0
                status = str(ours.get("status") or ours.get("Status") or "").lower()
                if status in FAILED:
                    raise FetchError(f"job {remote} ended as {status}")
                if status in DONE:
                    return
            if time.monotonic() > end:
                raise FetchError(f"job {remote} did not end in {self.most_s:g} s")
            time.sleep(self.poll_s)


class ScrapeSource(DataSource):
    """Rows of scrape jobs: job_id and raw_payload, or job_id and the error of a job that failed.

    spark.read.format("scrape_jobs").option("base_url", ...).option("jobs", '[{"id": 1, "lat": ..., "lng": ..., "radius_m": ...}]')
    """

    @classmethod
    def name(cls) -> str:
        return "scrape_jobs"

    def schema(self) -> str:
        return "job_id long, raw_payload string, error string"

    def reader(self, schema) -> ScrapeReader:
        return ScrapeReader(self.options)
