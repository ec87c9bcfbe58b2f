"""Packing of tokenized documents into fixed-length sequences.

Documents are tokenized in Arrow batches and cut into pieces of at most the sequence length. Pieces are packed first-fit
decreasing, with a tournament tree over the free space of all bins, in each of many randomised groups of documents, so no
task sees more than one group and the groups know nothing of each other. A piece that fills a sequence is one as it is. The
others are dealt to groups by the number of their row in the written table of pieces, so neither repeated rows, nor rows without
an id, nor one very long document make a group large.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tokens of a sequence, pieces of a group, words and bytes of the cache, where the ids of sequences of one full piece begin.
SEQUENCE, GROUP_PIECES, CACHED_WORDS, CACHED_BYTES, FULL = 2048, 2048, 150_000, 32 << 20, 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Words(dict):
    """Word to ids, worked out when first met; the generation before the present one is kept for words met again. Both are
    bounded by their words and by the bytes of words and ids."""

    def __init__(self, encode, limit: int) -> None:
        super().__init__()
        self.encode, self.limit, self.before, self.bytes = encode, limit, {}, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                raise KeyError(word)
            ids = self.encode(" " + word)
        self.bytes += 4 * len(word) + len(ids)
        if len(self) >= self.limit or self.bytes > CACHED_BYTES:
            self.before = dict(self)
            self.clear()
            self.bytes = 4 * len(word) + len(ids)
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts, by a tokenizer file and a bounded cache of words.

    A space between two characters that are no white space always begins a token of a byte-level BPE with the usual
    pattern, so texts are cut there and each word with its space is looked up; any other text is encoded whole. Where the
    file's ids are in the order of its merges, tiktoken's core does the merging; else the tokenizers library does. Texts
    with a special token go to the library as they are. Results equal those of the library on the whole text.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        merged = _merge_order(path)
        if merged is None:
            self.encode_one = self._by_library
        else:
            self.encode_one = lambda text: array("I", merged(text)).tobytes()
        self.words = _Words(self.encode_one, cached)

    def _by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words, one, out = self.words, self.encode_one, []
        for text in texts:
            if any(s in text for s in self.special):
                out.append(self._by_library(text))
                continue
            parts = text.split(" ")
            try:
                if not parts[0] or parts[0][-1].isspace():
                    raise KeyError
                out.append(one(parts[0]) + b"".join([words[w] for w in parts[1:]]))
            except KeyError:
                out.append(one(text))
        return out


def _merge_order(path: str):
    """An encoder by tiktoken's core, if the file is a byte-level BPE of the usual pattern whose ids follow its merges."""
    import public_tokenizers
    import tiktoken

    said = json.loads(open(path, encoding="utf-8").read())
    model, before = said["model"], said.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or said.get("normalizer") or sys.byteorder != "little":
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printed)]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}
    added = {t["content"] for t in said.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _cut(path: str, end_id: int, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(ids), 256):
                rows = []
                for doc_id, encoded in zip(ids[first : first + 256], tokenizer.encode([t or "" for t in texts.slice(first, 256).to_pylist()]), strict=True):
                    encoded += end
                    total = len(encoded) // 4
                    for start in range(0, total, sequence):
                        piece = encoded[4 * start : 4 * (start + sequence)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the first bin with room.

    The tree's leaves are the free spaces of the bins in order and each inner node the most of its two children, so the
    first bin with room is found on one way down and one way up.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def _pack(sequence: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents: one row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (group and bin), offset. A null or empty text is
    the closing id alone; a repeated row is packed again; a null doc_id is packed like another; an empty table gives an
    empty result. A piece ends where the sequence length is reached, never elsewhere. Other columns are not looked at.
    """
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, end_id, sequence), PIECES)
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == sequence).withColumn("sequence_id", F.lit(FULL) + F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    rest = pieces.filter(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_pieces))
    packed = rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(groups))).groupBy("group").applyInPandas(_pack(sequence), PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)
