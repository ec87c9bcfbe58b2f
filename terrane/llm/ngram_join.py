"""Near-duplicate join on word n-grams by exact Jaccard similarity.

Documents with equal sets form one class. A set can only link to another if all but a few of its n-grams are shared (at 85 %
at most 15 % are its own), so two exact filters come first. A class with more n-grams of its own than that is closed. And in
any order of all n-grams, two linked sets share one of their first few (their prefixes); in the order taken here the n-grams
of a fixed share of the hash space come first, from rare to frequent, then all others by hash. That share is a little larger
than a prefix, so it serves for both filters, and no n-gram outside of it travels but for a few of short texts.

A tile holds the sets of one band of sizes (and of the band below, where partners may be) that have one n-gram in their
prefixes. In a tile, sizes, places in the prefix and hashed bit signatures bound each overlap from above, since every bit in
which two differ needs an element that only one has; what the bounds leave is decided by intersecting the sorted hash arrays.
The signatures grow with the sets, so that they bound long sets as well as short ones.

Tiles are met in rounds: first each class against the hub that it shares most tiles with, then members of tiles that still
hold several components against their likeliest partners, and what is then still apart in full, across components only: a link
inside a component would change nothing. Large tiles are dealt in blocks. No step drops a pair that may link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.components import connected_components
from terrane.plans.scratch import discard_since, mark

from .common import as_bytes, chunks, materialize, mix64, signed, sorted_side, unused, word_hashes

#: Words of an n-gram, and a link: 100 * intersection >= PERCENT * union.
N, PERCENT = 4, 85
#: Share of the hash space that is looked at for own n-grams, in units of the largest share that a set may have of its own.
LOOK = 1.5
#: Bits of a signature: at least LEAST_BITS, at most MOST_BITS, and BITS_EACH for an element in between; a brief one, for the first
#: look at tiles, has a quarter of them.
LEAST_BITS, MOST_BITS, BITS_EACH = 1024, 1 << 17, 4
#: Partners a member of a block is first checked against: those with the highest bounds. What is left is checked in full.
NEAREST = 1
#: Bytes of sets compared with one hub at a time, and members of a block of a large tile.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 512
_STEP = np.uint64(0x9FB21C651E98DF25)


def sets_of(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, ascending, joined, and where each text's begin (one more at the end)."""
    hashes, owner, *_ = word_hashes(texts, lower=True)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    grams, owners = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(hashes) >= n:
        whole = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])
        grams = np.zeros(len(whole), dtype=np.uint64)
        for k in range(n):
            grams = grams * _STEP + hashes[whole + k]
        owners = owner[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    rest = np.zeros(len(short), dtype=np.uint64)
    for k in range(n - 1):
        has = count[short] > k
        rest[has] = rest[has] * _STEP + hashes[first[short[has]] + k]
    rest += count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    grams, owners = mix64(np.concatenate((grams, rest))), np.concatenate((owners, short))
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[fresh], np.concatenate(([0], np.cumsum(np.bincount(owners[fresh], minlength=len(texts)))))


def _hashes_of_sets(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two hashes of each set; zero for an empty one."""
    out = np.zeros((2, len(at) - 1), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            out[i, full] = mix64(np.add.reduceat(mix64(grams ^ np.uint64(salt)), at[:-1][full]))
    return out


def _limit(percent: int) -> int:
    """Hashes below it (unsigned) are the share of the hash space that is looked at."""
    return int(min(1.0, LOOK * (100 - percent) / 100) * (2**64 - 2**11))


def _prints(n: int, percent: int):
    """doc_id, h, size of the set of n-grams, two hashes of the set, how many of its n-grams are in the share looked at, and the
    n-grams of smallest hash: those, or as many as the prefix has."""
    limit = np.uint64(_limit(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for first, last in chunks(texts):
                grams, at = sets_of(texts[first:last], n)
                prints, size = _hashes_of_sets(grams, at), np.diff(at)
                looked = np.diff(np.concatenate(([0], np.cumsum(grams < limit)))[at])
                take = np.minimum(size, np.maximum(looked, (100 - percent) * size // 100 + 1))
                where = np.concatenate(([0], np.cumsum(take)))
                some = grams[np.arange(where[-1]) + np.repeat(at[:-1] - where[:-1], take)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("h").slice(first, last - first), pa.array(size), pa.array(signed(prints[0])), pa.array(signed(prints[1])), pa.array(looked), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(signed(some)))],
                    names=["doc_id", "h", "n", "f1", "f2", "looked", "some"],
                )

    return run


def signature(grams: np.ndarray) -> bytes:
    """Bits of a set, one for each hash value; the width is a power of two that grows with the set."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(grams) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(grams % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sets(n: int):
    """Two hashes and size of the set, sorted hashes of the n-grams, bit signature and a brief one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for first, last in chunks(texts):
                grams, at = sets_of(texts[first:last], n)
                prints = _hashes_of_sets(grams, at)
                each = [grams[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                wide = [signature(g) for g in each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(prints[0])), pa.array(signed(prints[1])), pa.array(np.diff(at)), pa.array([g.tobytes() for g in each], pa.binary()), pa.array(wide, pa.binary()), pa.array([fold([w], len(w) // 4).tobytes() for w in wide], pa.binary())], names=["f1", "f2", "n", "grams", "bits", "brief"]
                )

    return run


def fold(blobs: list[bytes], width: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, wider ones folded to `width` bytes: an element's bit is its hash modulo the width."""
    sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))
    out = np.zeros((len(blobs), width // 8), dtype=np.uint64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        words = np.frombuffer(b"".join([blobs[i] for i in rows]), dtype=np.uint64)
        out[rows] = np.bitwise_or.reduce(words.reshape(len(rows), size // width, width // 8), axis=1)
    return out


def may_link(n_a: np.ndarray, n_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs the sizes and bit counts leave; bits as rows of 64-bit words."""
    both = n_a + n_b
    left = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    differ = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return left & ((100 + percent) * ((both - differ) // 2) >= percent * both)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("an", pa.int64()), ("more", pa.int64())])


def _against_hub(percent: int):
    """Links between hubs and members: rows come sorted by hub and block, the hub itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = block = own = own_bits = None
        for batch in batches:
            a, blocks, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "block", "hub"))
            ids, sets, bits = batch.column("id").to_numpy(), batch.column("grams"), batch.column("bits")
            found_a, found_b = [], []
            for i in range(len(ids)):
                if first[i]:
                    hub, block, own, own_bits = a[i], blocks[i], np.frombuffer(sets[i].as_py(), dtype=np.uint64), bits[i].as_py()
                    continue
                if a[i] != hub or blocks[i] != block:
                    raise ValueError("a member came without its hub")
                other, its_bits = np.frombuffer(sets[i].as_py(), dtype=np.uint64), bits[i].as_py()
                pair = fold([own_bits, its_bits], min(len(own_bits), len(its_bits)))
                if not may_link(np.int64(len(own)), np.int64(len(other)), pair[0], pair[1], percent):
                    continue
                at = np.searchsorted(own, other)
                common = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if (100 + percent) * common >= percent * (len(own) + len(other)):
                    found_a.append(hub)
                    found_b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=_LINK)

    return run


def _unit_pairs(rows: dict[str, np.ndarray], blobs: list[bytes], nearest: int | None, percent: int) -> tuple[list[np.ndarray], bool]:
    """Pairs (a, b, size of a) of one tile, or of one pair of its blocks, in different components that all bounds leave; and
    whether some were left out because a probe has nearer ones."""
    ids, n, parts, place, home = (rows[c] for c in ("id", "n", "component", "place", "home"))
    bits = fold(blobs, min(map(len, blobs)))
    others = np.flatnonzero(rows["member"])
    found, cut = [], False
    for i in np.flatnonzero(rows["probe"]):
        both = n[others] + n[i]
        # With this n-gram as the first that both prefixes share, no more than what follows it can be common.
        most = np.minimum(n[others] - place[others], n[i] - place[i])
        near = others[(parts[others] != parts[i]) & (home[others] | home[i]) & ((100 + percent) * most >= percent * both)]
        near = near[may_link(n[i], n[near], bits[i], bits[near], percent)]
        if nearest is not None and len(near) > nearest:
            near, cut = near[np.argpartition(np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64), nearest)[:nearest]], True
        if len(near):
            less = ids[near] < ids[i]
            found.append(np.stack((np.where(less, ids[near], ids[i]), np.where(less, ids[i], ids[near]), np.where(less, n[near], n[i]))))
    return found, cut


def _across(nearest: int | None, percent: int):
    """Pairs of all units, and (as rows without a pair) the keys of the tiles where some were left out. Rows come sorted by
    unit, and at most one unit is held back between batches."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        rows = {c: table[c].to_numpy() for c in ("unit", "key", "id", "n", "component", "place", "home", "probe", "member")}
        blobs, units = table["bits"].to_pylist(), rows["unit"]
        edges = np.concatenate(([0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]))
        found, more = [], set()
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some, cut = _unit_pairs({c: v[x:y] for c, v in rows.items()}, blobs[x:y], nearest, percent)
            found += some
            if cut:
                more.add(int(rows["key"][x]))
        a, b, size = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        gap = [None] * len(more)
        return pa.RecordBatch.from_arrays([pa.array([*c.tolist(), *gap], pa.int64()) for c in (a, b, size)] + [pa.array([None] * len(a) + sorted(more), pa.int64())], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column("unit").to_numpy()
            last = int(np.flatnonzero(units == units[-1])[0])
            if last:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif held and held[0].column("unit")[0].as_py() != units[-1]:
                yield pairs(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _fresh(*names: str):
    """Columns of the same names that a join of two frames of one origin can tell apart."""
    return [F.col(c).alias(c) for c in names]


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a: hub, b; an: size of a): each hub's set travels once for each block of its members."""
    each = F.greatest(F.max("an") * (800 / percent / BLOCK_BYTES), F.lit(1 / BLOCK_ROWS))
    blocks = materialize(pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * each)).cast("int").alias("blocks")), "blocks")
    hubs = blocks.join(sets, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("hub"), *_fresh("id", "grams", "bits"))
    members = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).join(sets.withColumnRenamed("id", "b"), "b").select(*_fresh("a", "block"), F.lit(False).alias("hub"), F.col("b").alias("id"), *_fresh("grams", "bits"))
    dealt = hubs.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.desc("hub"))
    return dealt.mapInArrow(_against_hub(percent), "a long, b long")


def _open_pairs(tiles: DataFrame, labels: DataFrame, sets: DataFrame, nearest: int | None, percent: int) -> DataFrame | None:
    """Pairs (a, b, an) of the tiles that still hold several components: all members outside the most frequent one meet all
    others. Rows with `more` instead name the tiles of which only the nearest pairs are here."""
    placed = materialize(tiles.join(labels, "id").select("key", "id", "n", "place", "home", "component"), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("times"))
    open_tiles = parts.groupBy("key").agg(F.max_by("component", F.struct("times", -F.col("component"))).alias("most"), F.count("*").alias("parts"), F.sum("times").alias("members"), F.max("times").alias("top")).filter("parts > 1")
    open_tiles = materialize(open_tiles, "open")
    if open_tiles.isEmpty():
        return None
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(BLOCK_ROWS))).cast("int")
    inside = placed.join(open_tiles, "key").join(sets.select("id", F.col("bits" if nearest is None else "brief").alias("bits")), "id").withColumn("pb", blocks(F.col("members") - F.col("top"))).withColumn("mb", blocks(F.col("members")))
    place = lambda c: F.pmod(F.xxhash64("id", F.lit(7)), c).cast("int")
    what = _fresh("key", "id", "n", "place", "home", "component", "bits")
    unit = F.xxhash64("key", "p", "m").alias("unit")
    is_probe = F.col("component") != F.col("most")
    # A small tile is one unit, in which each member comes once; of a large one each block of probes meets each block of members.
    small = inside.filter("mb = 1").select(F.xxhash64("key", F.lit(0), F.lit(0)).alias("unit"), *what, is_probe.alias("probe"), F.lit(True).alias("member"))
    large = inside.filter("mb > 1")
    probes = large.filter(is_probe).withColumn("p", place(F.col("pb"))).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select(unit, *what, F.lit(True).alias("probe"), F.lit(False).alias("member"))
    members = large.withColumn("m", place(F.col("mb"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).select(unit, *what, F.lit(False).alias("probe"), F.lit(True).alias("member"))
    dealt = small.unionByName(probes).unionByName(members).repartition("unit").sortWithinPartitions("unit")
    return materialize(dealt.mapInArrow(_across(nearest, percent), "a long, b long, an long, more long").distinct(), "pairs")


def _prefix_tiles(reps: DataFrame, percent: int) -> DataFrame:
    """key, id, n, place, home: the n-grams of each set's prefix that others have too, by band of sizes.

    Of the share looked at a set's own n-grams come first, then the others from rare to frequent; what lies outside comes after
    them by hash, at the place that it has in the list.
    """
    inside = F.shiftrightunsigned("gram", 1) < (_limit(percent) >> 1)
    grams = reps.select("id", "n", "looked", F.posexplode("some").alias("at", "gram"))
    times = materialize(grams.groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1"), "shared")
    of_set = Window.partitionBy("id")
    ranked = grams.withColumn("inside", inside).join(times, "gram").withColumn("rank", F.row_number().over(of_set.orderBy(F.desc("inside"), "times", "gram"))).withColumn("shared", F.count_if("inside").over(of_set))
    place = F.when(F.col("inside"), F.col("looked") - F.col("shared") + F.col("rank") - 1).otherwise(F.col("at"))
    prefix = ranked.withColumn("place", place.cast("long")).filter(F.col("place") <= F.floor((100 - percent) * F.col("n") / 100))
    # A little wider than the greatest ratio of linked sizes, so rounding cannot part two bands that may link.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent * 1.001))).cast("long")
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home"))))
    return prefix.select("id", "n", "gram", "place", both.alias("in")).select(F.xxhash64("gram", "in.band").alias("key"), "id", "n", "place", "in.home")


def components_of_rows(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """A row for each input row: doc_id, h (hash of the text), n (size of the set), component (null where there is no set or
    no doc_id), component_id.

    Sets, not doc_ids, are what is linked: rows of one doc_id with different texts are different nodes.
    """
    since = mark()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    prints = materialize(plain.withColumn("h", F.xxhash64("text")).mapInArrow(_prints(n, percent), "doc_id long, h long, n long, f1 long, f2 long, looked long, some array<long>"), "prints")
    linked = prints.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(linked.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id()), "classes")
    # N-grams that one class alone has, by the hash of the class.
    owners = linked.select("f1", F.explode(F.slice("some", F.lit(1), F.col("looked").cast("int"))).alias("gram")).groupBy("gram").agg(F.min("f1").alias("f1"), F.max("f1").alias("other")).filter("f1 = other")
    own = owners.groupBy("f1").agg(F.count("*").alias("own"))
    opened = materialize(classes.join(sorted_side(own), "f1", "left").filter(F.coalesce("own", F.lit(0)) * 100 <= (100 - percent) * F.col("n")).select("id", "f1", "f2", "n", "first"), "opened")
    reps = linked.join(sorted_side(opened), ["f1", "f2", "n"]).filter(F.col("doc_id") == F.col("first")).select("id", "n", "looked", "some").dropDuplicates(["id"])
    every = materialize(_prefix_tiles(materialize(reps, "reps"), percent), "prefixes")
    # At the first n-gram that two linked sets share, the smaller one can be no further in its order than this.
    early = (100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")
    shared = every.groupBy("key").agg(F.count("*").alias("members"), F.count_if("home").alias("homes"), F.min(F.when(early, F.struct("id", "n"))).alias("hub"), F.min(F.when(early, F.col("n"))).alias("least"))
    shared = materialize(shared.filter("members > 1 AND homes > 0 AND least IS NOT NULL").select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "least"), "hubs")
    tiles = materialize(every.join(shared, "key").filter(early | (F.col("n") >= F.col("least"))).drop("least"), "tiles")
    wanted = materialize(tiles.select("id").distinct(), "wanted")
    met = materialize(opened.join(wanted, "id"), "met")
    texts = plain.join(sorted_side(met.select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(n), "f1 long, f2 long, n long, grams binary, bits binary, brief binary").join(met.select("id", "f1", "f2", "n"), ["f1", "f2", "n"])
    sets = materialize(sets.select("id", "n", "grams", "bits", "brief").dropDuplicates(["id"]), "sets")
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    hubs = tiles.filter(fits & (F.col("id") != F.col("hub"))).groupBy("id", "hub", "hub_n").agg(F.count("*").alias("times"))
    first = hubs.groupBy(F.col("id").alias("b")).agg(F.max_by(F.struct("hub", "hub_n"), F.struct("times", -F.col("hub"))).alias("to")).select(F.col("to.hub").alias("a"), "b", F.col("to.hub_n").alias("an"))
    links = materialize(_verify(materialize(first, "first"), sets, percent), "links")
    labels = _labels(wanted, links)
    for nearest in (NEAREST, None):
        found = _open_pairs(tiles, labels, sets, nearest, percent)
        if found is None:
            break
        pairs = found.filter("more IS NULL").select("a", "b", "an")
        if not pairs.isEmpty():
            more = materialize(_verify(pairs, sets, percent), "links")
            if not more.isEmpty():
                links = links.unionByName(more)
                labels = _labels(wanted, links)
        left = found.filter("more IS NOT NULL").select(F.col("more").alias("key")).distinct()
        if left.isEmpty():
            break
        tiles = tiles.join(left, "key", "left_semi")
    named = classes.join(labels, "id", "left").select("f1", "f2", "n", "first", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least, "component").select("f1", "f2", "n", "component", "component_id"), "named")
    discard_since(docs.sparkSession, since, prints, named)
    has = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = prints.select("doc_id", "h", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", "h", "n", F.when(has, F.col("component")).alias("component"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    found = connected_components(links)
    return materialize(ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "parts")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose sets of n words in a row have a Jaccard similarity of at least percent.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), a row for each
    input row. A document without words has no n-grams and links with nothing; one with fewer than n words has its
    whole sequence as one. Null texts count as empty; a null doc_id links with nothing and keeps a null component. Rows
    that repeat fall into one class; rows of one doc_id with different texts are judged each by its own text. An empty
    table gives an empty result. Other columns are not looked at.
    """
    return components_of_rows(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without near copies: of each component one row stays, of its smallest doc_id.

    Where several texts of that doc_id are in the component, the one of the smallest hash stays; where the row itself
    repeats, one of its copies. Rows without words or without doc_id all stay.
    """
    rows = components_of_rows(docs, n, percent).filter("component IS NOT NULL")
    rows = materialize(rows.groupBy("component", "component_id", "doc_id", "h").agg(F.count("*").alias("times")), "members")
    keep = rows.filter("doc_id = component_id").groupBy("component").agg(F.min("h").alias("kept"))
    judged = rows.join(keep, "component").select("doc_id", "h", "times", ((F.col("doc_id") == F.col("component_id")) & (F.col("h") == F.col("kept"))).alias("stays"))
    judged = materialize(judged.filter("NOT stays OR times > 1"), "judged")
    of, hash_ = unused(docs, "of"), unused(docs, "hash")
    same: Column = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(hash_))
    named = lambda rows: rows.select(F.col("doc_id").alias(of), F.col("h").alias(hash_)).distinct()
    left = docs.join(sorted_side(named(judged.filter("NOT stays"))), same, "left_anti")
    again = judged.filter("stays")
    if again.isEmpty():
        return left
    once = left.join(named(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(named(again), same, "left_anti").unionByName(once)
