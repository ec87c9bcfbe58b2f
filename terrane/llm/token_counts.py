"""Token counts: lengths only, in Arrow batches.

The texts of an Arrow batch lie one after another in a single buffer. It is worked on in chunks of about equal bytes, whatever
the texts' sizes; chunks end at text starts or at safe boundaries inside a text, where no token can lie on both sides. The
segments between boundaries are gathered by value, and only those not met before are encoded, in one batch call of the
tokenizer's own library. What is kept and returned is their number of tokens, never ids.

Safe boundaries: before white space that follows no white space. A byte-level BPE with the usual pattern begins a token there
(its look-ahead only reaches into white space), and a sentencepiece model whose pieces hold spaces only in front begins a piece
there. Segments that are still long (texts without spaces) are cut where a run of letters or digits ends. For tokenizers of any
other kind each text is one segment.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sentencepiece_codec import SPACE, Codec

#: Bytes of a chunk; segments kept from one chunk to the next, and their bytes; from how many bytes a segment is cut further.
CHUNK, KEPT, KEPT_BYTES, LONG = 4 << 20, 400_000, 32 << 20, 1 << 15

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Last bytes of characters that may stand in front of a boundary: printed ASCII, or part of a longer character.
_BEFORE = np.zeros(256, dtype=bool)
_BEFORE[0x21:0x7F] = True
_BEFORE[0x80:] = True
#: A run of letters or of digits has ended, and no white space follows.
_RUN_ENDS = regex.compile(r"(?<=\p{L})[^\p{L}\s]|(?<=\p{N})[^\p{N}\s]")


class Json:
    """A tokenizer file of the tokenizers library."""

    #: Whether a segment counts otherwise at a text's start than inside.
    places_differ = False

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(open(path, encoding="utf-8").read())
        before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.special = [t["content"] for t in added]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)
        self.white = _WHITE if usual and plain and said["model"]["type"] == "BPE" else None

    def cut_long(self, segment: str) -> list[str]:
        if self.white is None or any(s in segment for s in self.special):
            return [segment]
        starts = [0, *(m.start() for m in _RUN_ENDS.finditer(segment))]
        return [segment[a:b] for a, b in zip(starts, [*starts[1:], len(segment)], strict=True)]

    def lengths(self, segments: list[str], inner: list[bool]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Model:
    """A model file of the sentencepiece library."""

    places_differ = True

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.white = None
        try:
            # Refuses models that normalize or have pieces over several words; a lone space has to be a piece.
            splits = Codec(open(path, "rb").read()).prefix and self.model.piece_to_id(SPACE) != self.model.unk_id()
        except ValueError:
            splits = False
        if splits:
            self.white = np.zeros(256, dtype=bool)
            self.white[0x20] = True

    def cut_long(self, segment: str) -> list[str]:
        return [segment]

    def lengths(self, segments: list[str], inner: list[bool]) -> list[int]:
        """A segment inside a text begins with spaces, one of which the library puts there by itself."""
        bare = [s[1:] if i else s for s, i in zip(segments, inner, strict=True)]
        return [len(x) if b or not i else 1 for x, b, i in zip(self.model.encode(bare, num_threads=1), bare, inner, strict=True)]


class TokenCounter:
    """Numbers of tokens of whole texts, with a bounded memory of segments."""

    def __init__(self, path: str, chunk: int = CHUNK, kept: int = KEPT) -> None:
        self.library = Model(path) if path.endswith(".model") else Json(path)
        self.chunk, self.kept = chunk, kept
        self.known: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}
        self.bytes = 0

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Safe boundaries within data; the first three bytes are taken as inside."""
        if self.library.white is None or len(data) < 4:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.library.white[data[3:]] & _BEFORE[data[2:-1]]) + 3
        one, two, three = data[at - 1], data[at - 2], data[at - 3]
        # White space beyond ASCII (with its neighbours in the same block) and sentencepiece's sign of a space are no end of a word.
        odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81) | (two == 0x96)) | (three == 0xE3) & (two == 0x80)
        return at[~odd]

    def segments(self, data: np.ndarray, texts: np.ndarray) -> Iterator[np.ndarray]:
        """Starts of segments and the end of the last, chunk by chunk. texts: ascending starts of the texts in data."""
        first, last = 0, len(data)
        while first < last:
            size = self.chunk
            while True:
                end = min(first + size, last)
                inside = texts[np.searchsorted(texts, first, "right") : np.searchsorted(texts, end)]
                starts = np.concatenate(([first], first + self.boundaries(data[first:end]), inside))
                starts.sort(kind="stable")  # runs that are sorted, so a merge
                starts = starts[np.concatenate(([True], starts[1:] != starts[:-1]))]
                if end == last:
                    starts = np.append(starts, last)
                    break
                if len(starts) > 1:
                    break
                size *= 2
            yield starts
            first = int(starts[-1])

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        _, offsets, buffer = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
        out = np.zeros(n, dtype=np.int64)
        if not n or offsets[0] == offsets[-1]:
            return out
        data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
        texts = offsets - offsets[0]
        for starts in self.segments(data, np.unique(texts[:-1])):
            owner = np.searchsorted(texts, starts[:-1], "right") - 1
            array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int64)), pa.py_buffer(data)])
            every = np.ones(len(owner), dtype=bool)
            inner = texts[owner] != starts[:-1] if self.library.places_differ else ~every
            for some in (inner, ~inner):
                if not some.any():
                    continue
                values = (array if some.all() else array.filter(pa.array(some))).dictionary_encode()
                sizes = self.sizes(values.dictionary.to_pylist(), bool(some is inner))
                out += np.bincount(owner[some], sizes[values.indices.to_numpy()], n).astype(np.int64)
        return out

    def sizes(self, segments: list[bytes], inner: bool) -> np.ndarray:
        """Tokens of different segments; those not known are encoded in one batch."""
        mark = b"\xff" if inner else b""  # no byte of UTF-8; one segment can stand at a text's start and inside
        keys = [mark + s for s in segments] if inner else segments
        known, before = self.known, self.before
        found = list(map(known.get, keys))
        missing = [i for i, size in enumerate(found) if size is None]
        fresh = []
        for i in missing:
            size = found[i] = before.get(keys[i])
            if size is None:
                fresh.append(i)
        brief = [i for i in fresh if len(keys[i]) <= LONG]
        for i, size in zip(brief, self.library.lengths([segments[i].decode() for i in brief], [inner] * len(brief)), strict=True):
            found[i] = size
        for i in fresh:
            if len(keys[i]) > LONG:
                parts = self.library.cut_long(segments[i].decode())
                found[i] = sum(sum(self.library.lengths(some, [inner and not k] + [False] * (len(some) - 1))) for k in range(0, len(parts), 4096) if (some := parts[k : k + 4096]))
        for i in missing:
            if len(keys[i]) <= LONG:
                known[keys[i]] = found[i]
                self.bytes += len(keys[i])
        if len(known) > self.kept or self.bytes > KEPT_BYTES:
            self.known, self.before, self.bytes = {}, known, 0
        return np.array(found, dtype=np.int64)


@lru_cache(maxsize=4)
def _counter(path: str) -> TokenCounter:
    """One in each worker process: files are read and segments known from one task to the next."""
    return TokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Number of tokens (long) of a text by a tokenizer file: .json by tokenizers, .model by sentencepiece.

    No begin, end or other added token, no truncation, no padding; special strings inside a text are handled as the library
    does by default. Null counts as empty. The whole text counts, however long.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(path)
        for batch in batches:
            yield pa.array(counter.counts(batch))

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    A null or empty text has no bytes and no tokens; a null doc_id stays null; rows that repeat are counted each; an empty table
    gives an empty result; other columns, whatever their names, are not looked at. The map is narrow.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
