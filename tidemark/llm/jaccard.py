"""Exact Jaccard similarity join of documents' word shingles.

Documents are dealt into tiles by size band and by the contents of one part of their
shingle set; within a tile, hashed bitmaps bound the overlap from above, and pairs that
pass are settled by intersecting the sorted shingle arrays.

No link can be missed.  Two sets that reach the threshold have sizes in a known ratio,
and differ in at most d shingles, where d follows from the larger size of the smaller
one's band.  Hash space is cut into d + slack parts: at least `slack` of them hold the
same shingles in both sets.  A tile is (band, part, contents of the part).  Parts of at
most `light` shingles make no tile, as passages that many documents share would fill
them; a set with `slack` such parts or more makes tiles of them after all.

Equal sets are one node, so copies cost nothing.  In each tile all nodes are first
compared with one of them; that settles large groups of near copies in time linear in
their size.  What is left are tiles whose nodes are still in several components: their
nodes are compared across components, in blocks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, fresh, kept, map_arrow, map_batches, stash

#: A bitmap has the power of two from so many bits a shingle on, so that it stays sparse at any size, and so many at least.
BITS_EACH, LEAST_BITS = 4, 256
#: Upper end of a size band over its lower end.
RATIO = 1.25
#: Nodes in a block of a tile.
BLOCK = 256
#: A pair that shares tiles among this many lowest keys of each node is handed on from the lowest of them only.
LOWEST = 16
#: Nodes that a task remembers, so that copies beside each other make one row.
SEEN = 1_000_000
#: Word hashes that a Python worker remembers.
CACHE_WORDS = 200_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers (splitmix64's last steps)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _WordHashes()
kept(_word_hashes.clear)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words of a whole text.

    A-Z are lower-cased; words are separated by space and \\x09-\\x0D.  With fewer words
    (but at least one) the whole sequence is one shingle.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_word_hashes.__getitem__, words), _U, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, _U)
    for i in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits in proportion to the size, that of each shingle's hash set."""
    size = max(LEAST_BITS, 1 << (BITS_EACH * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & _U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to size bytes: what a shorter bitmap of the same set holds."""
    words = np.frombuffer(b"".join(bitmaps), _U).reshape(len(bitmaps), -1)
    while words.shape[1] * 8 > size:
        half = words.shape[1] // 2
        words = words[:, :half] | words[:, half:]
    return words


@dataclass(frozen=True)
class Threshold:
    """Links are pairs with intersection / union >= part / whole."""

    part: int
    whole: int

    def linked(self, a: int, b: int, shared: int) -> bool:
        return self.whole * shared >= self.part * (a + b - shared) and shared > 0

    def difference(self, smaller: int) -> int:
        """The most shingles in which a linked pair differs, whose smaller set has so many."""
        return smaller * (self.whole - self.part) // self.part

    def least_partner(self, n: int) -> int:
        return -(-n * self.part // self.whole)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    parts: int
    slack: int
    light: int


@lru_cache(maxsize=8)
def _bands(threshold: Threshold) -> list[Band]:
    return []


def bands_upto(threshold: Threshold, n: int) -> list[Band]:
    """The size bands, as far as size n."""
    bands = _bands(threshold)
    while not bands or bands[-1].high < n:
        low = bands[-1].high + 1 if bands else 1
        bands.append(_band(threshold, len(bands), low, max(low, int(low * RATIO))))
    return bands


def _band(threshold: Threshold, number: int, low: int, high: int) -> Band:
    """Parts and slack for sets of low to high shingles: slack exceeds the light parts that a set is likely to have."""
    d = threshold.difference(high)
    if not d:
        return Band(number, low, high, 0, 0, 0)
    for light in (2, 1, 0):
        slack = 1
        while d + slack <= 2 * d + 4:
            parts = d + slack
            share = sum(math.comb(low, k) * (1 / parts) ** k * (1 - 1 / parts) ** (low - k) for k in range(light + 1)) if low < 1000 else math.exp(-low / parts) * sum((low / parts) ** k / math.factorial(k) for k in range(light + 1))
            mean = parts * share
            if slack > mean + 3 * math.sqrt(mean) + 0.5:
                return Band(number, low, high, parts, slack, light)
            slack += 1
    return Band(number, low, high, d + 1, 1, -1)


def tile_keys(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of the tiles of a set: of its own band, and of lower bands that can hold a partner."""
    n = len(shingles)
    bands = bands_upto(threshold, n)
    own = next(b.number for b in reversed(bands) if b.low <= n)
    least = threshold.least_partner(n)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(shingles))])
    out = []
    for band in bands[own::-1]:
        if band.high < least:
            break
        if not band.parts:
            continue
        # Part of a shingle: the upper 32 bits of its hash, scaled; ascending as the hashes are.
        part = ((shingles >> _U(32)) * _U(band.parts) >> _U(32)).astype(np.int64)
        ends = np.searchsorted(part, np.arange(band.parts + 1))
        held = np.diff(ends)
        heavy = held > band.light
        if np.count_nonzero(~heavy) >= band.slack:
            heavy[:] = True
        at = np.flatnonzero(heavy)
        contents = sums[ends[at + 1]] - sums[ends[at]]
        out.append(mix(contents + mix(at.astype(_U) + (_U(band.number) << _U(32)))))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingled(docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """doc_id, node, n, key, bits, tiles of every row of docs(doc_id, text, key): node is a hash of its set (null if empty).

    bits and tiles are given with the first document of a node in each task, else null.
    """

    def make():
        seen: set[int] = set()

        def step(batch):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(text, width)
                if not len(s):
                    rows.append((doc_id, None, 0, None, None))
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                if node in seen:
                    rows.append((doc_id, node, len(s), None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                rows.append((doc_id, node, len(s), bitmap(s), tile_keys(s, threshold).view(np.int64)))
            doc_ids, nodes, sizes, bits, tiles = zip(*rows, strict=True)
            nodes = pa.array([None if x is None else x - (x >> 63 << 64) for x in nodes], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), nodes, pa.array(sizes, pa.int64()), batch.column(2), pa.array(bits, pa.binary()), pa.array(tiles, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "key", "bits", "tiles"])

        return step

    return map_arrow(docs, make, "doc_id long, node long, n long, key long, bits binary, tiles array<long>")


def _membership(nodes: DataFrame) -> DataFrame:
    """tile, node, centre of the tiles that hold several nodes; the centre is the least of them.

    Dealt by tile once: the count and the join read the same exchange.  Nearly every tile
    has one row, so counting before the shuffle would only widen its rows.
    """
    members = nodes.select(F.explode("tiles").alias("tile"), "node").repartition("tile")
    shared = members.groupBy("tile").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre < last")
    return members.join(shared.select("tile", "centre"), "tile")


def _possible(pairs: DataFrame, facts: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps allow: what one bitmap has and the other lacks is no shared shingle."""
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def make():
        def step(batch):
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            a, b = (batch.column(k).to_pylist() for k in (4, 5))
            lengths = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
            keep = np.zeros(len(a), bool)
            for pair in np.unique(lengths, axis=0):
                at = np.flatnonzero((lengths == pair).all(axis=1))
                x, y = (folded([side[i] for i in at], pair.min()) for side in (a, b))
                keep[at] = bound(n_a[at], n_b[at], x, y, threshold)
            return pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

        return step

    return map_arrow(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), make, "a long, b long")


def bound(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Whether the overlap that bitmaps a and b (rows of 64-bit words) leave possible reaches the threshold."""
    most = np.minimum(n_a - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), n_b - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return threshold.whole * most >= threshold.part * (n_a + n_b - most)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _exact(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b) whose sorted shingle arrays intersect enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def make():
        def step(batch):
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), _U) for x in (a, b))
                keep.append(threshold.linked(len(a), len(b), shared_count(a, b)))
            return batch.filter(pa.array(keep)).select(["a", "b"])

        return step

    return map_arrow(pairs.select("a", "b", "set_a", "set_b"), make, "a long, b long")


#: The filter of _sets has so many bits at most, whatever the number of nodes.
FILTER_BITS = 1 << 26


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingles binary (sorted) of the wanted (node, key), from another pass over docs(text, key).

    key is a hash of the whole text.  A bitmap of the wanted keys, of bounded size, spares
    most other texts the shingling and the shuffle; the join of nodes is what decides.
    """
    count = wanted.count()
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    words = wanted.groupBy(F.shiftright(F.col("key").bitwiseAND(size - 1), 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toPandas()
    mask = np.zeros(size // 64, np.int64)
    mask[words["at"].to_numpy(int)] = words["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(mask.view(_U))

    def make():
        words = shared.value
        seen: set[tuple[int, int]] = set()

        def step(batch):
            keys = batch.column(1).to_numpy()
            at = keys.view(_U) & _U(size - 1)
            asked = np.flatnonzero(words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1))
            nodes, raws = [], []
            for key, text in zip(keys[asked].tolist(), batch.column(0).take(pa.array(asked)).to_pylist(), strict=True):
                copy = (key, len(text or ""))
                if copy in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(copy)
                s = shingle_hashes(text, width)
                if len(s):
                    raws.append(s.tobytes())
                    node = xxhash.xxh3_64_intdigest(raws[-1])
                    nodes.append(node - (node >> 63 << 64))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(raws, pa.binary())], names=["node", "shingles"])

        return step

    found = map_arrow(docs.select("text", "key"), make, "node long, shingles binary")
    return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _residual(members: DataFrame, component: DataFrame, facts: DataFrame, threshold: Threshold) -> DataFrame:
    """Possible pairs (a, b) of a tile whose nodes lie in different components; blocks bound what a task holds.

    Near copies share many tiles.  So that each of those does not name the same pairs, a
    pair is left to the lowest tile that its nodes share, where their lists of lowest
    tiles tell; where they do not, every shared tile names it.
    """
    placed = members.select("tile", "node").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_tiles = placed.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x < y")
    rows = placed.join(open_tiles.select("tile", "size"), "tile")
    lowest = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, LOWEST).alias("lowest"))
    rows = rows.join(facts.join(lowest, "node"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    others = F.sequence(F.lit(0), blocks - 1)
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    dealt = rows.select("tile", "i", "j", "block", "node", "component", "n", "bits", "lowest").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def run(batches):
        held: list[tuple] = []
        key = None

        def pairs():
            if len(held) < 2:
                return None
            block, node, component, n = (np.array([r[k] for r in held], np.int64) for k in range(4))
            shortest = min(len(r[4]) for r in held)
            words = np.concatenate([folded([r[4]], shortest) for r in held])
            lowest = [frozenset(r[5]) for r in held]
            out = []
            for x in range(len(held) - 1):
                y = np.arange(x + 1, len(held))
                # Off the diagonal, pairs within a block belong to the diagonal tiles.
                y = y[(component[y] != component[x]) & ((key[1] == key[2]) | (block[y] != block[x]))]
                y = y[bound(n[x], n[y], words[x], words[y], threshold)]
                out += [(min(node[x], node[k]), max(node[x], node[k])) for k in y if min(lowest[x] & lowest[k], default=key[0]) == key[0]]
            if not out:
                return None
            a, b = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    if (found := pairs()) is not None:
                        yield found
                    held, key = [], row[:3]
                held.append(row[3:])
        if (found := pairs()) is not None:
            yield found

    return map_batches(dealt, run, "a long, b long").distinct()


#: Up to so many links are connected by one task; more by rounds over all executors.
LOCAL_LINKS = 300_000


def _forest(batches, star: bool):
    """Links of a partition that connect as all of its links (a, b) do; with star, each node's component instead."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root) if star else [x for x, r in root.items() if x != r]
    for at in range(0, len(nodes), 65536):
        part = nodes[at : at + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of links(a, b).

    Each partition first reduces its links to a forest.  What is left is connected in one
    task if it is no more than LOCAL_LINKS, else by alternating large and small stars:
    each round is kept in the shared folder; it ends when the links no longer change.
    """
    edges = stash(map_batches(links, lambda batches: _forest(batches, False), "u long, v long"), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= LOCAL_LINKS:
            return map_batches(edges.coalesce(1), lambda batches: _forest(batches, True), "u long, v long").toDF("node", "component")
        if state == before:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        edges = stash(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) whose nodes lie in different components."""
    for side in "ab":
        pairs = pairs.join(component.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def link_components(docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """doc_id, key, node, n_shingles, group of every row of docs(doc_id, text).

    key is a hash of the text, node the same for equal shingle sets and group for all documents
    that links connect; these two are null for an empty set, which is linked with nothing.  Null ids and
    repeated rows are documents like any other; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key"))
    shingled_docs = stash(shingled(docs, width, threshold), "shingled")
    base = stash(shingled_docs.select("doc_id", "key", "node", "n"), "documents")
    facts = shingled_docs.filter("bits is not null").select("node", "n", "key", "bits", "tiles")
    members = stash(_membership(facts), "tiles").distinct()
    wanted = stash(members.select("node").distinct(), "wanted")
    single = stash(facts.select("node", "n", "key", "bits").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "facts")
    # Tiles are the largest data: they are not kept longer than needed.
    discard(shingled_docs)
    free_shuffles(docs.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        possible = stash(_possible(pairs, single, threshold), "possible")
        free_shuffles(docs.sparkSession)
        # Most nodes are in no pair that bitmaps leave possible: sets are made, from the texts, of the others alone.
        paired = possible.select("a").union(possible.select("b")).distinct().toDF("node")
        paired = stash(single.select("node", "key").join(paired, "node", "left_semi"), "paired")
        sets = stash(_sets(docs, paired, width), "sets")
        links = stash(_exact(possible, sets, threshold), "links")
        discard(sets)
        free_shuffles(docs.sparkSession)
        return links

    def more(found: DataFrame, links: DataFrame) -> DataFrame:
        # Components so far, as stars, and the links between them.
        return stash(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "components")

    stars = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    stars = stash(stars.groupBy("b").agg(F.min("a").alias("first"), F.collect_set("a").alias("centres")), "stars")
    found = stash(components(linked(stars.select(F.col("first").alias("a"), "b"))), "components")
    others = stars.select(F.explode("centres").alias("a"), "b", "first").filter("a <> first").select("a", "b")
    found = more(found, linked(_apart(others, found)))
    found = more(found, linked(_residual(members, found, single.drop("key"), threshold)))
    return base.select("doc_id", "key", "node", F.col("n").alias("n_shingles")).join(found, "node", "left").select("doc_id", "key", "node", "n_shingles", F.coalesce("component", "node").alias("group"))


def join_documents(docs: DataFrame, width: int = 3, threshold: Threshold = Threshold(90, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (the least known id that links reach) of every row of docs(doc_id, text).

    A document without shingles is its own component; so component_id is null only where
    all ids of a component are.
    """
    grouped = stash(link_components(docs, width, threshold), "groups")
    least = grouped.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, threshold: Threshold = Threshold(80, 100)) -> DataFrame:
    """The rows of docs, all columns as they are, with one document of each linked group.

    Of a group stays the row of the least id (a null id only if it has no other; of rows
    alike in id, the one whose text hashes lowest, once).  Documents without shingles all
    stay, each repeated row once for each time it occurs.
    """
    grouped = link_components(docs, width, threshold)
    # A null id comes last; of rows alike in id that of the least key.
    ident, key = fresh(docs.columns, "_id"), fresh(docs.columns, "_key")
    first = grouped.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("kept"))
    kept = first.select(_known_id(F.col("kept.doc_id")).alias(ident), F.col("kept.key").alias(key))
    bare = F.coalesce(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0, F.lit(True))
    # Rows go by (id, hash of the text) once, for the join and for dropping repeated rows alike.
    full = docs.filter(~bare).withColumns({ident: _known_id(F.col("doc_id")), key: text_key()}).join(kept, [ident, key], "left_semi")
    return full.dropDuplicates([ident, key]).select(*docs.columns).unionByName(docs.filter(bare))


def text_key() -> Column:
    """A hash of a whole text."""
    return F.xxhash64("text")


def _known_id(doc_id: Column) -> Column:
    """An id to join by: null ids are alike."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63) + 1))
