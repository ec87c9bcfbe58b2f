"""The pipeline against a plain version, and the registered queries against their SQL."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terrane.llm import queries as llm
from terrane.llm.secret_scan import ADDED, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS

SMALL = "/root/testdata/sf0.001"


def oracle(sql: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = con.execute(sql).df()
    return cells(frame)


def cells(frame) -> list[tuple]:
    """Rows as sorted text, nulls alike, whole numbers alike whatever their type."""

    def cell(x) -> str:
        if x is None or str(x) in ("nan", "<NA>", "None"):
            return "-"
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = llm.queries()[name](spark, SMALL).toPandas()
    assert cells(got) == oracle(llm.oracle_sql()[name], SMALL)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


def sets_of(text: str) -> frozenset:
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (9003, 'api_key = "Zx9kQ2mW7rT4yU8iO1pA3sD6"', "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("id", F.lit(1)).withColumn("sha", F.lit(2))
    good = corpus_pipeline.quality(spark, docs, SMALL)
    scores = {r.doc_id: r.predicted for r in llm.score_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert good.columns == docs.columns and Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in docs.collect() if scores[r.doc_id])

    single = corpus_pipeline.exact_copies(spark, docs, SMALL)
    keep = {}
    for r in docs.collect():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        keep[t] = max(keep.get(t, -1), r.doc_id)
    rows = single.collect()
    assert single.columns == docs.columns and Counter(r.doc_id for r in rows) == Counter(keep.values())

    near = corpus_pipeline.near_copies(spark, docs, SMALL)
    every = {r.doc_id: sets_of(r.text or "") for r in docs.collect()}
    label = {i: i for i in every}
    for _ in range(4):
        for i, a in every.items():
            for j, b in every.items():
                if i < j and a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in near.collect()} == {i for i, c in label.items() if i == c} and near.columns == docs.columns

    masked = corpus_pipeline.secrets(spark, docs, SMALL)
    assert masked.count() == docs.count() and masked.columns == docs.columns
    assert masked.filter(F.contains("text", F.lit("[SECRET]"))).count() > 0


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Twenty words more: 96 of 116 runs of five words are shared, but only 97 of 117 of four, under op3's 85 %. And one under 80 %."""
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows = [(1, base), (2, base + [f"x{i}" for i in range(20)]), (3, other), (4, other + [f"y{i}" for i in range(25)])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SMALL).collect()) == [1, 3, 4]


def test_secrets_of_rows_without_id(spark):
    rows = [(None, "first Zx9kQ2mW7rT4yU8iO1pA3sD6 end", "en", "s", 0), (None, "second Qm3nB7vC1xZ5aS9dF2gH6jK4 end", "en", "s", 0), (None, None, None, None, 0), (7, "third Lp8oI4uY2tR6eW1qA5sD9fG3 end", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [(None, "first [SECRET] end"), (None, "second [SECRET] end"), (None, None), (7, "third [SECRET] end")]
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.secrets(spark, docs, SMALL).collect()) == Counter(want)


def plain_secrets(rows: list[tuple]) -> dict[int, str]:
    """Texts with live secrets masked: candidates by pattern, judged by their owners and repositories over all rows."""
    found = []
    for i, text, lang, source in rows:
        for ord_, (_, pattern, group, least) in enumerate((*KINDS, ADDED)):
            for m in re.finditer(pattern, text):
                value = m.group(group)
                if len(value) >= least and (ord_ < len(KINDS) or all(re.search(c, value) for c in ("[A-Z]", "[a-z]", "[0-9]"))):
                    found.append((i, value, source or "", "/".join(x for x in (source, lang) if x is not None)))
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, value, owner, repository in found:
        owners[value].add(owner)
        repositories[value].add((owner, repository))
    live = defaultdict(set)
    for i, value, *_ in found:
        if len(owners[value]) < EXAMPLE_OWNERS and len(repositories[value]) < EXAMPLE_REPOSITORIES:
            live[i].add(value)
    out = {}
    for i, text, *_ in rows:
        for value in sorted(live[i], key=len, reverse=True):
            text = text.replace(value, "[SECRET]")
        out[i] = text
    return out


def plain_chain(docs: list[tuple], good: set[int]) -> dict[int, str]:
    """The first four stages one after another, each on what the one before has kept; `good` is the classifier's verdict."""
    rows = [(i, t or "", lang, source) for i, t, lang, source in docs if i in good]
    keep = {}
    for r in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        keep[t] = max(keep.get(t, r), r)
    rows = list(keep.values())
    n, percent = corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT
    every = {}
    for i, t, *_ in rows:
        w = t.encode().lower().split()
        every[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links = [(i, j) for i, a in every.items() for j, b in every.items() if i < j and a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b)]
    label = {i: i for i in every}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    return plain_secrets([r for r in rows if label[r[0]] == r[0]])


def test_run_equals_the_plain_stages_in_a_row(spark):
    """Every piece of what the plain chain keeps, with its tokens, and no other; sequences without gaps."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    good = {r.doc_id for r in llm.score_quality(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.predicted}
    kept = plain_chain(docs, good)
    assert len(kept) < len(good) < len(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in kept.items():
        ids = np.asarray([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
