"""SentencePiece encoding and decoding in numpy batches.

A model file is read without its library. Words (a run of spaces and what follows it) are worked out once for each batch,
equal lengths together: the hashes of all their substrings, up to the longest piece, come from sums over code points and
are looked up in the sorted hashes of the pieces. A unigram model is decoded by Viterbi: all words of a length advance
together and vectorised maxima store backpointers. A byte-pair model ranks merges, and the best-scored segmentation is not
what it means, so for such a model the same tables drive its merges instead: each round merges, in every word of a length,
the best-scored leftmost pair. Characters that no piece has become bytes. Ids equal those of the library.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _POWERS, mix64

SPACE = "▁"
#: Words kept from one batch to the next, and bytes of them and their ids; starts in a block of merges; words of a length taken
#: at a time; characters from which a word's merges are queued, each merge at the cost of a heap's depth.
CACHED_WORDS, CACHED_BYTES, BLOCK, STEP, LONG_WORD = 150_000, 32 << 20, 64, 8192, 2048
_LOW = np.uint64((1 << 20) - 1)


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            out.append((key >> 3, data[i : i + size]))
            i += size
    return out


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, data: bytes, cached: int = CACHED_WORDS) -> None:
        top = _fields(data)
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only models without normalization, which escape spaces, can be read")
        self.prefix = bool(normal.get(3, 1))
        self.merges = trainer.get(3, 1) == 2
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.scores = np.array([struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces] + [-np.inf])  # the last: no piece
        self.unknown = kinds.index(2)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 6}
        plain = [i for i, k in enumerate(kinds) if k == 1]
        self.longest = max(len(names[i]) for i in plain)
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model has pieces over several words")
        self.ids = {names[i]: i for i in plain}
        self.penalty = float(self.scores[plain].min()) - 10
        keys = np.concatenate([self._hashes(self._codes([names[i]], len(names[i])), len(names[i]))[0] for i in plain])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(plain, dtype=np.int64)[order]
        self.likely = np.zeros(int(_LOW) + 1, dtype=bool)
        self.likely[self.keys & _LOW] = True
        shown = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_size = np.array([len(s) for s in shown])
        self.shown_at = np.concatenate(([0], np.cumsum(self.shown_size)))
        places = {score: i for i, score in enumerate(sorted({self.scores[i] for i in plain}, reverse=True))}
        self.place = {names[i]: places[self.scores[i]] for i in plain}
        self.cached, self.words, self.before, self.held = cached, {}, {}, 0

    @staticmethod
    def _codes(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64)

    @staticmethod
    def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
        """Hash of each substring of a length: words by starts."""
        up, down = _POWERS.upto(codes.shape[1] + 1)
        sums = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        np.cumsum(mix64(codes + np.uint64(1)) * up[: codes.shape[1]], axis=1, out=sums[:, 1:])
        return mix64((sums[:, size:] - sums[:, : sums.shape[1] - size]) * down[: sums.shape[1] - size] + np.uint64(size))

    def _table(self, codes: np.ndarray) -> np.ndarray:
        """Id of the piece from each start for each length, -1 where there is none."""
        n, length = codes.shape
        widest = min(self.longest, length)
        table = np.full((n, length + 1, widest + 1), -1, dtype=np.int32)
        for size in range(1, widest + 1):
            hashes = self._hashes(codes, size)
            row, start = np.nonzero(self.likely[hashes & _LOW])  # few others pass, and a binary search decides
            wanted = hashes[row, start]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            table[row, start, size] = np.where(self.keys[at] == wanted, self.key_ids[at], -1)
        return table

    def viterbi(self, table: np.ndarray) -> np.ndarray:
        """Best-scored segmentation of words of one length: end of the piece at each start, 0 inside pieces."""
        n, length, widest = len(table), table.shape[1] - 1, table.shape[2] - 1
        scores = self.scores[table]
        single = scores[:, :length, 1]
        scores[:, :length, 1] = np.where(np.isneginf(single), self.penalty, single)
        best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), dtype=np.int64)
        best[:, 0] = 0
        for end in range(1, length + 1):
            sizes = np.arange(1, min(widest, end) + 1)
            paths = best[:, end - sizes] + scores[:, end - sizes, sizes]
            back[:, end] = sizes[paths.argmax(axis=1)]
            best[:, end] = paths.max(axis=1)
        ends = np.zeros((n, length + 1), dtype=np.int64)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            start = at[rows] - back[rows, at[rows]]
            ends[rows, start] = at[rows]
            at[rows] = start
            rows = rows[start > 0]
        return ends

    def merge(self, table: np.ndarray) -> np.ndarray:
        """Segmentation by merges of words of one length: end of the piece at each start, 0 inside pieces.

        What a merge at each start gains is kept with the most of each BLOCK starts, so a merge in a long word looks at one
        block and at the blocks' maxima.
        """
        n, length, widest = len(table), table.shape[1] - 1, table.shape[2] - 1
        ends = np.tile(np.arange(1, length + 2), (n, 1))
        ends[:, length] = 0
        before = np.tile(np.arange(-1, length), (n, 1))
        size = min(BLOCK, length)
        gain = np.full((n, -(-length // size), size), -np.inf)
        flat = gain.reshape(n, -1)

        def pair(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
            middle = ends[rows, starts]
            wide = np.where(middle < length, ends[rows, np.minimum(middle, length)], length + widest + 1) - starts
            good = wide <= widest
            return np.where(good, self.scores[np.where(good, table[rows, starts, np.minimum(wide, widest)], -1)], -np.inf)

        every = np.arange(n)
        for s in range(length - 1):
            flat[:, s] = pair(every, np.full(n, s))
        most = gain.max(axis=2)

        def put(rows: np.ndarray, starts: np.ndarray, value: np.ndarray | float) -> None:
            flat[rows, starts] = value
            most[rows, starts // size] = gain[rows, starts // size].max(axis=1)

        rows = every
        while len(rows):
            block = most[rows].argmax(axis=1)
            at = block * size + gain[rows, block].argmax(axis=1)
            open_ = ~np.isneginf(flat[rows, at])
            rows, at = rows[open_], at[open_]
            if not len(rows):
                break
            middle = ends[rows, at]
            stop = ends[rows, middle]
            ends[rows, at], ends[rows, middle] = stop, 0
            put(rows, middle, -np.inf)
            before[rows, stop] = at
            put(rows, at, pair(rows, at))
            left = before[rows, at]
            has = left >= 0
            put(rows[has], left[has], pair(rows[has], left[has]))
        return ends

    def merge_long(self, word: str) -> list[str]:
        """The pieces of one long word: the same merges, by a queue of (place of the score, start). An entry whose pair has changed
        since is passed over."""
        n, place, longest, low = len(word), self.place.get, self.longest, (1 << 40) - 1
        after, before, open_ = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), bytearray(b"\x01") * n
        todo = [p << 40 | i for i in range(n - 1) if (p := place(word[i : i + 2])) is not None]
        heapify(todo)
        while todo:
            key = heappop(todo)
            i = key & low
            middle = after[i]
            if not open_[i] or middle >= n:
                continue
            stop = after[middle]
            if stop - i > longest or place(word[i:stop]) != key >> 40:
                continue
            open_[middle], after[i] = 0, stop
            if stop < n:
                before[stop] = i
                if after[stop] - i <= longest and (p := place(word[i : after[stop]])) is not None:
                    heappush(todo, p << 40 | i)
            left = before[i]
            if left >= 0 and stop - left <= longest and (p := place(word[left:stop])) is not None:
                heappush(todo, p << 40 | left)
        out, i = [], 0
        while i < n:
            out.append(word[i : after[i]])
            i = after[i]
        return out

    def _piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if self.merges and len(w) >= LONG_WORD:
                self.words[w] = array("I", [x for piece in self.merge_long(w) for x in self._piece_ids(piece)]).tobytes()
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, all_ in by_length.items():
            step = max(1, STEP * 8 // length)
            for i in range(0, len(all_), step):
                some = all_[i : i + step]
                table = self._table(self._codes(some, length))
                ends = self.merge(table) if self.merges else self.viterbi(table)
                row, start = np.nonzero(ends)
                size = ends[row, start] - start
                ids = table[row, start, size]
                where = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(some)))))
                blob, where = ids.astype("<u4").tobytes(), (4 * where).tolist()
                self.words.update(zip(some, [blob[a:b] for a, b in zip(where[:-1], where[1:], strict=True)], strict=True))
                for j in set(row[ids < 0].tolist()):
                    a, b = where[j] // 4, where[j + 1] // 4
                    self.words[some[j]] = np.array([x for k in range(a, b) for x in self._piece_ids(some[j][start[k] : start[k] + size[k]])], dtype="<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        parts = text.split(SPACE)
        if not parts[0] and parts[-1] and SPACE + SPACE not in text:
            return [SPACE + p for p in parts[1:]]
        words, spaces = ([parts[0]] if parts[0] else []), ""
        for part in parts[1:]:
            spaces += SPACE
            if part:
                words.append(spaces + part)
                spaces = ""
        return [*words, spaces] if spaces else words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > self.cached or self.held > CACHED_BYTES:
            self.before, self.words, self.held = self.words, {}, 0
        split = [self._split(t) for t in texts]
        missing: set[str] = set()
        for words in split:
            missing.update(words)
        missing -= self.words.keys()
        again = missing & self.before.keys()
        self.words.update((w, self.before[w]) for w in again)
        self._learn(missing - again)
        self.held += sum(4 * len(w) + len(self.words[w]) for w in missing)
        return [b"".join([self.words[w] for w in words]) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 of each sequence of ids."""
        sizes = [len(i) // 4 for i in ids]
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        size = self.shown_size[flat]
        after = np.cumsum(size)
        take = np.repeat(self.shown_at[flat] - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)
        text = self.shown[take].tobytes()
        bounds = np.concatenate(([0], after))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
        cut = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [c[1:] if self.prefix and c[:1] == b" " else c for c in cut]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text.

    A null text gives null ids, an empty text none; a null doc_id stays null; rows that repeat are encoded each; an empty
    table gives an empty result. The map is narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(open(model_path, "rb").read())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(1).to_pylist()
                ids = [np.frombuffer(i, dtype="<u4").astype(np.int32) if t is not None else None for t, i in zip(texts, codec.encode([t or "" for t in texts]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of every sequence of ids; null ids give a null text; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(open(model_path, "rb").read())
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = codec.decode([np.asarray(i or [], dtype="<u4").tobytes() for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") if i is not None else None for t, i in zip(texts, ids, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """What `encode` and `decode` give for every whole text, as digests: doc_id, n_ids, ids_crc32, text_sha256, round_trip.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers, text_sha256 of the decoded text, round_trip whether
    it is the text itself. A row for each input row: a null text counts as empty, a null doc_id stays null, rows that repeat are
    encoded each, an empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(open(model_path, "rb").read())
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = codec.encode(texts)
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                        pa.array([b == t.encode() for b, t in zip(back, texts, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "text_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_sha256 string, round_trip boolean")
