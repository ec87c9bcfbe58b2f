"""Token counts, ranked search and fill-in-middle against plain versions."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import lexical_search
from terrane.llm.fill_in_middle import count_units, cut_places, restore, transform, transform_digest
from terrane.llm.lexical_search import Index, rank
from terrane.llm.sentencepiece_codec import Codec
from terrane.llm.token_counts import TokenCounter, count_tokens

SCHEMA = "doc_id long, text string, lang string, n long, n_tokens long, h1 long, cut string, form string, output string, terms string, counts long, item long, rank int, score long"
JSON, WORDS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def words(seed: int, n: int, of: int = 500) -> str:
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, of, n))


TEXTS = [
    (1, "It's a test: don't stop 123abc!\n\nNew  line\t\ttab  hard space 　wide x  y  z"), (2, None), (3, ""), (4, " "), (5, "   \n "), (6, "one"), (7, "a <|endoftext|> b<|endoftext|>c  <|endoftext|>"),
    (8, "x" * 100_000), (9, "汉字，没有空格。" * 9000), (10, "ab1!" * 20_000), (11, words(1, 40_000)), (12, "naïve café \U0001f600\U0001f600 ÄÖ\n" * 50), (12, "another text of the same id"), (None, "no id here, w1 w2 w3"), (None, None),
    (13, "w1 w2 w3 W1 W2-w3"), (13, "w1 w2 w3 W1 W2-w3"), (14, "W1 w2 w3 w1 w2 w3"), (15, "holds <P> a mark"), (16, "<S"), (17, "a<M>"), (18, "tail   "), (19, "a b\x1cc \x85 d  e \x00 f"), (20, "</s> <s> <unk> ▁ ▁▁x  y"),
    *((100 + i, words(i + 2, 5 + 7 * i)) for i in range(40)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x", "plain", "o", "t", 4, 5, 6, 7) for i, t in TEXTS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --------------------------------------------------------------------------- token counts


def by_library(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [JSON, WORDS, MODEL])
@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_counts_equal_the_librarys(path, chunk):
    some = [t for _, t in TEXTS if chunk > 64 or len(t or "") < 5000]
    counter = TokenCounter(path, chunk, kept=100)
    want = by_library(path, [t or "" for t in some])
    assert counter.counts(pa.array(some)).tolist() == want
    assert counter.counts(pa.array(some, pa.large_string()).slice(3)).tolist() == want[3:]
    assert counter.counts(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_counts_of_random_texts(path):
    """Any mix of white space, marks, letters and special strings, in chunks of a few bytes."""
    random = np.random.default_rng(5)
    parts = ["a", "Bc", "'s", "'", "12", ".", " ", "  ", "\n", "\t", " ", "　", " ", "é", "漢", "😀", "<|endoftext|>", "</s>", "\x85", "\x1f", "▁"]
    some = ["".join(parts[i] for i in random.integers(0, len(parts), random.integers(0, 40))) for _ in range(400)]
    assert TokenCounter(path, chunk=16).counts(pa.array(some)).tolist() == by_library(path, some)


def test_long_words_merge_in_seconds():
    """Words of up to a million characters: ids of the library, in time that grows about as the word."""
    codec, library = Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    random = np.random.default_rng(4)
    letters = lambda n, of: "".join(random.choice(list(of), n))
    for word in (letters(3000, "ab"), "a" * 5000, letters(20_000, "etaoinshrdlu"), letters(5000, "aé漢😀▁"), "=" * 4099, letters(3000, "0123456789abcdef")):
        assert np.frombuffer(codec.encode([word])[0], dtype="<u4").tolist() == library.encode(word)
    began = time.monotonic()
    whole = letters(1_000_000, "etaoinshrdlu")
    ids = codec.encode([whole])
    assert time.monotonic() - began < 60 and codec.decode(ids) == [whole.encode()]


def test_count_tokens(docs, none):
    want = Counter((i, len((t or "").encode()), n) for (i, t), n in zip(TEXTS, by_library(JSON, [t or "" for _, t in TEXTS]), strict=True))
    got = count_tokens(docs, JSON, 1024).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and {r.over_limit for r in got} == {True, False}
    assert count_tokens(none, JSON).count() == 0


# --------------------------------------------------------------------------- fill in the middle


def plain_middle(doc_id: int | None, text: str) -> tuple:
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, none):
    want = Counter(plain_middle(i, t or "") for i, t in TEXTS)
    rows = transform(docs)
    assert Counter(tuple(r) for r in rows.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(r[0] for r in rows.select(restore(F.col("output"), F.col("form"))).collect()) == Counter(t or "" for _, t in TEXTS)
    digests = Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in transform_digest(docs).collect())
    assert digests == Counter((w[0], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, (_, t) in zip([plain_middle(i, t or "") for i, t in TEXTS], TEXTS, strict=True))
    assert transform(none).count() == 0 and transform_digest(none).count() == 0


def test_marks_cut_in_two_are_told_apart(spark):
    """Parts that end or begin like a mark, cut anywhere."""
    rows = [(i, t) for i, t in enumerate(["<<S", "<S<P<M", "P><S", "<P\n>", ">S<", "<" * 9] * 40)]
    out = transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows
    assert out.filter("form <> 'plain'").count() > 100


def test_matcher_stops_at_the_second_rank():
    text = "ab, cd\né😀 " * 3
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    assert count_units(text) == len(units) and count_units("") == 0
    for low in range(len(units) + 1):
        for high in range(low, len(units) + 1):
            assert cut_places(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


# --------------------------------------------------------------------------- ranked search


def terms_of(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def plain_search(docs, items, k=10):
    held = [(i, c, sum(c.values())) for i, t in docs if (c := Counter(terms_of(t)))]
    n, length = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, c, size in held:
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


ITEMS = [(1, "w1 w2 w3"), (2, words(11, 60)), (3, None), (4, "nothing that is there"), (5, "W1, w1; w1"), (6, words(4, 19)), (None, "w7 w9 café"), (6, words(4, 19)), (7, "ÄÖ 汉字 naïve"), (8, words(12, 400)), (8, "w5 another text of one id")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id long, terms string")


@pytest.mark.parametrize("k", [1, 3, 10, 1000])
def test_search(docs, items, k):
    assert Counter(tuple(r) for r in rank(docs, items, k).collect()) == plain_search(TEXTS, ITEMS, k)


def test_search_in_blocks(docs, items, none, monkeypatch):
    """Items in several blocks, texts in slices."""
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 50)
    assert Counter(tuple(r) for r in rank(docs, items, 10, item_bytes=300).collect()) == plain_search(TEXTS, ITEMS)
    assert rank(none, items).count() == 0 and rank(docs, items.limit(0)).count() == 0


def test_search_ties_over_many_copies(spark):
    """A third of the rows are one text: equal scores in every task, ranked by id."""
    rows = [(i, "alpha beta gamma" if i % 3 == 0 else words(i, 30)) for i in range(3000)]
    found = [tuple(r) for r in rank(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([(0, "beta w3")], "item_id long, text string")).collect()]
    assert Counter(found) == plain_search(rows, [(0, "beta w3")])


def test_search_stops_early_and_stays_exact():
    """Ten documents that hold a rare passage are proven long before the lists of common words end."""
    random, n = np.random.default_rng(3), 5000
    lists = [np.unique(np.concatenate((random.integers(0, 20, 15), np.arange(20, 40) if i % 500 == 7 else []))).astype(np.int64) for i in range(n)]
    sizes = np.array([len(x) for x in lists])
    terms, counts = np.concatenate(lists), random.integers(1, 4, sizes.sum())
    df = np.bincount(terms, minlength=40)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    index = Index(np.arange(n), sizes, sizes, terms, counts, weights, n, int(sizes.sum()))
    at, scores = index.top(np.arange(40), 10, 0)
    want = np.zeros(n, dtype=np.int64)
    np.add.at(want, np.repeat(np.arange(n), sizes), index.doc_impacts)
    assert sorted(at.tolist()) == [i for i in range(n) if i % 500 == 7] and scores.tolist() == want[at].tolist()
    assert index.read < 0.2 * len(terms)
    assert not len(index.top(np.arange(40), 10, int(want.max()) + 1)[0])
    for item in (np.arange(3), np.array([39]), np.array([0, 25]), np.array([], dtype=np.int64)):
        at, scores = index.top(item, 10, 0)
        full = np.zeros(n, dtype=np.int64)
        chosen = np.isin(terms, item)
        np.add.at(full, np.repeat(np.arange(n), sizes)[chosen], index.doc_impacts[chosen])
        assert sorted(scores.tolist())[::-1][:10] == [x for x in sorted(full.tolist())[::-1][:10] if x]
        assert full[at].tolist() == scores.tolist()
