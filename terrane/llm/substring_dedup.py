"""Removal of repeated passages by suffix automata of reference shards.

A passage is repeated if a window of WINDOW consecutive words occurs earlier in the corpus. A suffix automaton of reference
passages gives, for each word of a streamed text, the length of the longest match that ends there: the matching statistics.
Spans where it reaches the window are removed.

`remove_known` broadcasts automata of a bounded reference. `remove_repeats` takes the corpus itself as the reference, which
no broadcast may hold. So its shards are routed, not broadcast: the smallest of the hashed 4-grams in a window (its anchor)
depends on the window alone, so equal windows share an anchor. A run of windows with one anchor is a piece. Anchors that
occur once have no repeats; pieces of the other anchors are dealt to shards by anchor, each different piece is once streamed
through its shard's automaton of all earlier pieces, and then added to it. An anchor with many different pieces is spread
further: its windows are dealt one by one, by a hash of the window. Of equal ones only the first remains, chosen by partial minima
before anything is grouped, so a phrase of all documents is one row; what remains streams through the automata of its shards
all the same. The verdict on a piece holds for all its copies: a copy that isn't the first is repeated as a whole.

Places are known by doc_id, start and a hash of the piece, so rows that share a doc_id don't take each other's verdicts. What
is listed for a document (its repeated anchors, its pieces) is bounded by the words of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _POWERS, as_bytes, chunks, materialize, mix64, signed, word_hashes

WINDOW, GRAM = 20, 4
#: Pieces of a shard; the windows of an anchor with more different pieces than HOT are dealt to shards one by one.
SHARD_PIECES, HOT = 1000, 400
#: Words that a broadcast reference may have.
MAX_REFERENCE_WORDS = 400_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


class SuffixAutomaton:
    """All substrings of the passages added so far, over any hashable tokens."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.length, self.link = [0], [-1]

    def add(self, tokens: list) -> None:
        """Add a passage; matches never run over the end of a passage."""
        nexts, length, link = self.next, self.length, self.link
        last = 0
        for token in tokens:
            there = nexts[last].get(token)
            if there is not None and length[there] == length[last] + 1:
                last = there
                continue
            if there is not None:
                last = self._clone(last, there, token)
                continue
            state = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at != -1 and token not in nexts[at]:
                nexts[at][token] = state
                at = link[at]
            if at != -1:
                there = nexts[at][token]
                link[state] = there if length[there] == length[at] + 1 else self._clone(at, there, token)
            last = state

    def _clone(self, at: int, there: int, token) -> int:
        nexts, length, link = self.next, self.length, self.link
        state = len(length)
        nexts.append(dict(nexts[there]))
        length.append(length[at] + 1)
        link.append(link[there])
        link[there] = state
        while at != -1 and nexts[at].get(token) == there:
            nexts[at][token] = state
            at = link[at]
        return state

    def matches(self, tokens: list) -> list[int]:
        """For each token the length of the longest match that ends with it."""
        nexts, length, link = self.next, self.length, self.link
        state = matched = 0
        out = []
        for token in tokens:
            there = nexts[state].get(token)
            while there is None and state:
                state = link[state]
                matched = length[state]
                there = nexts[state].get(token)
            if there is not None:
                state, matched = there, matched + 1
            out.append(matched)
        return out


def _pieces(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, hash of the words, first word, windows. Words are of several texts."""
    none = np.zeros(0, dtype=np.int64)
    windows = len(hashes) - window + 1
    if windows < 1:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = np.zeros(len(hashes) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * _STEP + hashes[k : len(grams) + k]
    grams = mix64(grams)
    # The leftmost smallest gram of each window, by doubling.
    span, least, place = 1, grams, np.arange(len(grams))
    wanted = window - GRAM + 1
    while span < wanted:
        step = min(span, wanted - span)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    whole = owner[window - 1 :] == owner[:windows]
    place = np.where(whole, place[:windows], -1)
    fresh = whole.copy()
    fresh[1:] &= place[1:] != place[:-1]
    first = np.flatnonzero(fresh)
    # A run ends where the next begins or the text has no further window.
    change = np.ones(windows, dtype=bool)
    change[1:] = place[1:] != place[:-1]
    bounds = np.append(np.flatnonzero(change), windows)
    count = bounds[np.searchsorted(bounds, first) + 1] - first
    up, down = _POWERS.upto(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(hashes)])))
    words = mix64((sums[first + count + window - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    return grams[place[first]], words, first, count


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = as_bytes(batch.column(1))
        for a, b in chunks(texts):
            hashes, owner, *_ = word_hashes(texts[a:b], lower=False)
            anchor, _, first, _ = _pieces(hashes, owner)
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(ids[a:b][owner[first]], pa.int64())], names=["anchor", "doc_id"])


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t) for t in as_bytes(batch.column(1))], pa.binary())], names=["doc_id", "z"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents without repeated anchors; the others keep their text."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        counts, digests, kept = [], [], []
        for z, lone in zip(batch.column("z").to_pylist(), batch.column("anchors").is_null().to_pylist(), strict=True):
            words = unpress.decompress(z).split()
            counts.append(len(words))
            digests.append(_digest(words) if lone else None)
            kept.append(None if lone else z)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), batch.column("anchors")], names=["doc_id", "n_words", "digest", "z", "anchors"])


def _parts(batch: pa.RecordBatch):
    """The documents of a batch in chunks: first row, texts, hashes of all words, text of each word, first word of each text."""
    unpress = zstandard.ZstdDecompressor()
    texts = [unpress.decompress(z) for z in batch.column("z").to_pylist()]
    for a, b in chunks(texts):
        hashes, owner, *_ = word_hashes(texts[a:b], lower=False)
        yield a, texts[a:b], hashes, owner, np.searchsorted(owner, np.arange(b - a + 1))


def _repeated(column: pa.Array, first: int, count: int, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of a chunk whose anchors are among those listed for their document: anchor, words, first word, windows."""
    anchor, words, start, windows = _pieces(hashes, owner)
    lists = column.slice(first, count)
    sizes = np.diff(np.asarray(lists.offsets))
    tag = lambda a, of: mix64(a + (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    listed = np.sort(tag(np.asarray(lists.flatten(), dtype=np.int64).view(np.uint64), np.repeat(np.arange(count), sizes)))
    wanted = tag(anchor, owner[start])
    at = np.minimum(np.searchsorted(listed, wanted), max(0, len(listed) - 1))
    has = listed[at] == wanted if len(listed) else np.zeros(len(wanted), dtype=bool)
    return anchor[has], words[has], start[has], windows[has]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for a, texts, hashes, owner, begin in _parts(batch):
            anchor, words, start, windows = _repeated(batch.column("anchors"), a, len(texts), hashes, owner)
            of = owner[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor)), pa.array(signed(words)), pa.array(ids[a + of]), pa.array(start - begin[of], pa.int64()), pa.array(windows, pa.int32())], names=["anchor", "piece", "doc_id", "start", "windows"]
            )


def _here(of: np.ndarray, at: np.ndarray, piece: np.ndarray, owner: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which listed pieces (text, first word, hash) are among the pieces of the chunk: another row of the doc_id may hold them."""
    if not len(start):
        return np.zeros(len(at), dtype=bool)
    near = np.minimum(np.searchsorted(start, at), len(start) - 1)
    return (start[near] == at) & (words[near].view(np.int64) == piece) & (owner[start[near]] == of)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted pieces; of hot anchors of each window, dealt by a hash of its own."""
    for batch in batches:
        ids, wanted = batch.column("doc_id").to_pylist(), batch.column("wanted")
        for a, texts, hashes, owner, begin in _parts(batch):
            raw = hashes.tobytes()
            lists = wanted.slice(a, len(texts))
            of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
            anchor, starts, counts, pieces, hot = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5))
            at = begin[of] + starts
            _, words, first, _ = _pieces(hashes, owner)
            there = _here(of, at, pieces, owner, first, words)
            rows = []
            for i, key, start, count, piece, spread, place in zip(*(x[there].tolist() for x in (of, anchor, starts, counts, pieces, hot, at)), strict=True):
                if not spread:
                    rows.append((key, ids[a + i], start, count, piece, 0, raw[8 * place : 8 * (place + count + WINDOW - 1)], False))
                    continue
                for k in range(count):
                    window = raw[8 * (place + k) : 8 * (place + k + WINDOW)]
                    rows.append((int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), ids[a + i], start, count, piece, k, window, True))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_CONTENTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTENTS.types, strict=True)], schema=_CONTENTS)


_CONTENTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("piece", pa.int64()), ("shift", pa.int32()), ("words", pa.binary()), ("single", pa.bool_())])


def _shard(pieces: pa.Table) -> pa.Table:
    """Stream each piece through the automaton of all earlier ones; own: the windows met for the first time, as bits."""
    pieces = pieces.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("shift", "ascending")])
    automaton, own = SuffixAutomaton(), []
    for raw, shift in zip(pieces["words"].to_pylist(), pieces["shift"].to_pylist(), strict=True):
        tokens = np.frombuffer(raw, dtype=np.uint64).tolist()
        bits = 0
        for i, matched in enumerate(automaton.matches(tokens)[WINDOW - 1 :]):
            if matched < WINDOW:
                bits |= 1 << i + shift
        own.append(bits)
        automaton.add(tokens)
    return pa.table([pieces["doc_id"].combine_chunks(), pieces["start"].combine_chunks(), pieces["windows"].combine_chunks(), pieces["piece"].combine_chunks(), pa.array(own, pa.int64())], names=["doc_id", "start", "windows", "piece", "own"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts, hashes, owner, begin in _parts(batch):
            _, words, start, windows = _repeated(batch.column("anchors"), a, len(texts), hashes, owner)
            marks = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(marks, start, 1)
            np.add.at(marks, start + windows, -1)
            repeated = np.cumsum(marks)[: len(hashes)] > 0
            lists = batch.column("owned").slice(a, len(texts))
            of = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            first, count, piece, own = (np.asarray(flat.field(k), dtype=np.int64) for k in range(4))
            there = _here(of, begin[of] + first, piece, owner, start, words)
            of, first, count, own = (x[there] for x in (of, first, count, own))
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            kept = np.repeat(own, count) >> step & 1 == 1
            repeated[(np.repeat(begin[of] + first, count) + step)[kept]] = False
            at = np.flatnonzero(repeated)
            cover = np.bincount(at, minlength=len(hashes) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(hashes) + WINDOW + 1)
            keep = np.cumsum(cover)[: len(hashes)] == 0
            digests = [_digest(list(compress(t.split(), keep[i:j]))) for t, i, j in zip(texts, begin[:-1], begin[1:], strict=True)]
            removed = np.bincount(owner[~keep], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), pa.array(np.diff(begin), pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _first_windows(windows: DataFrame) -> DataFrame:
    """Of equal windows, told by all their words, the first in the order of the corpus."""
    first = windows.groupBy("key", "words").agg(F.min(F.struct("doc_id", "start", "shift", "windows", "piece")).alias("first"))
    return first.select("key", "first.doc_id", "first.start", "first.windows", "first.piece", "first.shift", "words")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove every word covered by a window that starts earlier too (smaller doc_id, or same document, earlier start).

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), a row for each input row. Null
    and empty texts have no words; a row without doc_id has no place in the order: it is kept whole and removes nothing.
    Rows that repeat are one document met twice and don't remove each other; of rows of one doc_id with different texts a
    window that starts at a smaller word counts as the earlier one. An empty table gives an empty result. Other columns are
    not looked at. Windows are judged on the input, not on what is left.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    placed = plain.filter("doc_id IS NOT NULL")
    anchors = placed.mapInArrow(_anchors, "anchor long, doc_id long")
    repeated = materialize(anchors.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    by_doc = anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    pressed = plain.mapInArrow(_pressed, "doc_id long, z binary")
    judged = materialize(pressed.join(by_doc, "doc_id", "left").mapInArrow(_plain, "doc_id long, n_words long, digest string, z binary, anchors array<long>"), "judged")
    some = judged.filter("z IS NOT NULL").select("doc_id", "z", "anchors")
    found = some.mapInArrow(_found, "anchor long, piece long, doc_id long, start long, windows int")
    different = found.groupBy("anchor", "piece").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("windows").alias("windows"))
    different = materialize(different.select("anchor", "piece", "first.doc_id", "first.start", "windows"), "pieces")
    kinds = materialize(different.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    ranked = materialize(different.join(kinds, "anchor"), "ranked")
    whole = ranked.filter("kinds = 1").select("doc_id", "start", "windows", "piece", F.lit(-1).cast("long").alias("own"))
    wanted = ranked.filter("kinds > 1").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "piece", (F.col("kinds") > HOT).alias("hot"))).alias("wanted"))
    contents = materialize(some.select("doc_id", "z").join(wanted, "doc_id").mapInArrow(_contents, "key long, doc_id long, start long, windows int, piece long, shift int, words binary, single boolean"), "contents")
    contents = contents.filter("NOT single").drop("single").unionByName(materialize(_first_windows(contents.filter("single")), "windows"))
    shards = max(1, -(-contents.count() // SHARD_PIECES))
    judged_pieces = contents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: _shard(t), "doc_id long, start long, windows int, piece long, own long")
    owned = whole.unionByName(judged_pieces).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "piece", "own")).alias("owned"))
    changed = some.join(owned, "doc_id", "left").mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return changed.unionByName(judged.filter("z IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")))


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space) after removing what `reference` (text) holds.

    The reference's words are counted first; beyond MAX_REFERENCE_WORDS it is refused, since its automata are broadcast.
    """
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    if (reference.agg(F.sum(words)).first()[0] or 0) > MAX_REFERENCE_WORDS:
        raise ValueError(f"the reference has more than {MAX_REFERENCE_WORDS} words; use remove_repeats")
    automaton = SuffixAutomaton()
    for (text,) in reference.select("text").filter("text IS NOT NULL").collect():
        automaton.add(text.encode().split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for text in as_bytes(batch.column(1)):
                tokens = text.split()
                keep = np.ones(len(tokens), dtype=bool)
                for end, matched in enumerate(automaton.matches(tokens)):
                    if matched >= window:
                        keep[end + 1 - matched : end + 1] = False
                for column, value in zip(out, (len(tokens), int((~keep).sum()), b" ".join(compress(tokens, keep)).decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
