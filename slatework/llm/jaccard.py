r"""Jaccard self-join of documents on word n-grams (shingles) with adaptive multi-match prefixes.

Words: ASCII letters lower-cased, `[^\x20\x09-\x0D]+`; a document's set: its distinct shingles of `width` words, with fewer
words the whole sequence, without words nothing. Two documents link when 100 * intersection >= percent * union. Shingles
are 64-bit hashes; documents with equal sets are one node from the start, known by 128 bits of hash.

Prefixes. All sets are ordered alike, rare shingles first (by a count sketch over the whole corpus, then by hash). Of n
shingles, a document posts the first n - ceil(percent * n / 100) + l: two linked documents share at least min(l, l') of what
they post. Each document takes the l that its estimated cost is lowest for: postings, plus candidates (by the sketch) over
l. Pairs that share enough are verified on whole sets.

Groups of near copies. Before that, documents that share a min-hash are verified against the smallest node of their group
only, in linear number, and the components of those links are found. The prefix join then makes only pairs of different
components, which are all that can still change the result: a shingle whose documents lie in one component makes no pair
at all, and in any other the documents outside its largest component meet the rest.

Frequent shingles. A shingle that would make more than FREQUENT ** 2 pairs makes none. The documents that post one lengthen
their prefixes further, to an l of about the prefix itself, and post runs of two shingles: linked documents share so many
that somewhere two shared ones follow each other closely in both prefixes, so runs of a few places' span are enough (see
spans()), and their number stays linear in the prefix. A run is far rarer than a shingle. What is still frequent goes on to
runs of three. Only the documents that still post frequent runs of three form canopies, by the frequent shingles that they share;
any pair that shares one is decided inside
its canopy: a walk over the documents compares each with those that no walk has reached yet, by an inverted index in memory,
and gives back a spanning forest of the links instead of the pairs. A canopy larger than a block is first walked as its
first block with each other block, then what that left outside the largest component is walked with every block. So no
group's pairs are ever rows, and no link is lost.

Pairs are tested twice before whole sets travel: by size, and by a profile of each set (how many shingles fall into each of
64 hash classes), which bounds the intersection from above.

Null, empty and blank texts have the empty set, link with nothing and are components of their own. Equal rows share their
node. A null id is passed over when the smallest id of a component is taken. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, forget, limit_arrow, materialize, per_process, tasks
from .components import components

#: Counters of the sketch at most, and for each document (powers of two); the slices in which it travels.
SKETCH, SKETCH_SHARE, SLICES = 1 << 23, 8, 32
#: Bits of a filter of wanted nodes for each of them, and at most.
FILTER_SHARE, FILTER_BITS = 16, 1 << 30
#: Root of the pairs that a shingle may make; runs of how many shingles are tried; documents and shingles of a canopy's block.
FREQUENT, LONGEST_RUN, BLOCK_NODES, BLOCK_SHINGLES = 32, 3, 1_024, 2_000_000
#: Nodes whose 64 bits stand for several sets, at most (1e12 documents make about 3e4).
MOST_COLLISIONS = 1_000_000
#: Classes of a profile.
PROFILE = 64
#: Min-hashes per document for the groups; largest l; cost of verifying one candidate, in postings; words kept hashed.
MINHASHES, MOST_MATCHES, VERIFY_COST, CACHE_WORDS = 4, 8, 20.0, 120_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Shingler:
    def __init__(self, width: int):
        self.width, self.hashes = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.hashes
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words).difference(known))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        n = len(words) - k + 1
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x ^= h[i : i + n]
            x *= _ODD[i & 3]
            x ^= x >> np.uint64(31)
        x *= _ODD[0]
        x ^= x >> np.uint64(29)
        x.sort()
        return x[np.r_[True, x[1:] != x[:-1]]]


class Nodes:
    """The node of a set: 64 bits of a hash, or the other 64 where the first stand for several sets (collided)."""

    def __init__(self, bits: int = 64, collided: frozenset[int] = frozenset()):
        self.mask, self.collided = (1 << bits) - 1, collided

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(shingles.tobytes())
        return (h & self.mask) - (1 << 63), (h >> 64) - (1 << 63)

    def of(self, shingles: np.ndarray) -> int:
        first, second = self.both(shingles)
        return second if first in self.collided else first


def min_hashes(shingles: np.ndarray) -> list[int]:
    return [int(((shingles ^ odd) * odd).min() >> np.uint64(1)) for odd in _ODD[:MINHASHES]]


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each hash class."""
    at = ((shingles * _ODD[1]) >> np.uint64(40)).astype(np.int64) & (PROFILE - 1)
    return np.bincount(at, minlength=PROFILE).astype(np.uint32).tobytes()


def power_of_two(least: int, most: int) -> int:
    return min(most, 1 << max(16, (max(1, least) - 1).bit_length()))


class NodeFilter:
    """A Bloom filter over nodes or text hashes; what it lets through is checked by a join."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, size = nodes.astype(np.int64).view(np.uint64), 8 * len(self.bits)
        return (x % np.uint64(size)).astype(np.int64), ((x >> np.uint64(32)) * _ODD[0] >> np.uint64(20)).astype(np.int64) % size

    def add(self, nodes: np.ndarray) -> None:
        for at in self.places(nodes):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, nodes: np.ndarray) -> np.ndarray:
        a, b = (self.bits[at >> 3] >> (at & 7) & 1 for at in self.places(nodes))
        return (a & b).astype(bool)

    def __contains__(self, node: int) -> bool:
        return bool(self.has(np.array([node], np.int64))[0])


def _add_up(parts: DataFrame, kind: str, slices: int) -> np.ndarray:
    """The sum (or union, for uint8) of sliced, compressed arrays: rows (part int, data binary). Of fixed size."""
    dtype = np.dtype(kind)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["part"], batch["data"]):
                x = np.frombuffer(zlib.decompress(data), dtype)
                sums[k] = x if k not in sums else sums[k] | x if kind == "u1" else sums[k] + x
        yield pd.DataFrame([(k, zlib.compress(x.tobytes(), 1)) for k, x in sums.items()], columns=["part", "data"])

    rows = parts.repartition(min(slices, tasks(parts.sparkSession)), "part").mapInPandas(add, "part int, data binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(bytes(r[1])), dtype) for r in sorted(rows)]) if rows else np.zeros(0, dtype)


def _sliced(x: np.ndarray) -> list[tuple[int, bytes]]:
    return [(k, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(x, SLICES))]


def _node_filter(nodes: DataFrame) -> NodeFilter:
    """nodes: one long column of a written table; the filter's size follows its rows."""
    size = power_of_two(FILTER_SHARE * nodes.count(), FILTER_BITS) // 8

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, some = NodeFilter(np.zeros(size, np.uint8)), False
        for batch in batches:
            own.add(batch.iloc[:, 0].to_numpy(np.int64))
            some = some or len(batch) > 0
        yield pd.DataFrame(_sliced(own.bits) if some else [], columns=["part", "data"])

    bits = _add_up(nodes.mapInPandas(collect, "part int, data binary"), "u1", SLICES)
    return NodeFilter(bits if len(bits) else np.zeros(size, np.uint8))


def _survey(docs: DataFrame, width: int, size: int, nodes: Nodes) -> DataFrame:
    """Rows of two kinds: (id, hash, node, other, n, mins, profile) for each document, and slices of the count sketch of
    `size` counters (part, data). other: the second half of the node's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, sketch, held, total = per_process(("shingler", width), lambda: Shingler(width)), None, [], 0
        for batch in batches:
            rows = []
            for ident, text, h in zip(batch["id"], batch["text"], batch["hash"]):
                s = shingler(text)
                rows.append((ident, h, *nodes.both(s), len(s), min_hashes(s) if len(s) else None, profile(s) if len(s) else None, None, None))
                held.append((s & np.uint64(size - 1)).astype(np.int64))
                total += len(s)
            if total > 2_000_000:
                counts = np.bincount(np.concatenate(held), minlength=size)
                sketch, held, total = counts if sketch is None else sketch + counts, [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})
        if held or sketch is not None:
            counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=size)
            sketch = counts if sketch is None else sketch + counts
            yield pd.DataFrame([(*[None] * 7, k, data) for k, data in _sliced(sketch.astype(np.uint64))], columns=columns)

    columns = ["id", "hash", "node", "other", "n", "mins", "profile", "part", "data"]
    return docs.mapInPandas(run, "id bigint, hash bigint, node bigint, other bigint, n bigint, mins array<bigint>, profile binary, part int, data binary")


def first_places(n: int, percent: int) -> int:
    """Places of the shortest prefix of n shingles in which linked sets share at least one."""
    return n - (percent * n + 99) // 100 + 1


def long_prefix(n: int, percent: int, run: int) -> tuple[int, int]:
    """The places of the prefix for runs of so many shingles, and how many of them linked sets share at least."""
    base = first_places(n, percent)
    places = min(n, 2 * base + run - 2)
    return places, places - base + 1


def longest_run(percent: int, most: int = LONGEST_RUN) -> int:
    """The longest runs that any two different linked sets share for certain."""
    for run in range(2, most + 1):
        for n in range(1, 64):
            if long_prefix(n, percent, run)[1] < run and 100 * n >= percent * (n + 1):
                return run - 1
    return most


def span(n: int, percent: int, run: int) -> int:
    """The largest distance of the ends of a run that a document of n shingles has to post.

    Two linked sets share m places of their long prefixes, in the same order. The m - run + 1 runs of neighbours among them
    span together at most run - 1 times each prefix, so some run spans no more than the mean of that in both.
    """
    places, shared = long_prefix(n, percent, run)
    most = 0
    for other in range(-(-percent * n // 100), 100 * n // percent + 1):
        places2, shared2 = long_prefix(other, percent, run)
        runs = min(shared, shared2) - run + 1
        if runs > 0:
            most = max(most, (run - 1) * (places + places2 - 2) // runs - (run - 1))
    return min(most, places - 1)


def runs_of(prefix: np.ndarray, run: int, most: int) -> np.ndarray:
    """A hash of each run of two or three shingles of a prefix whose ends are at most `most` places apart."""
    out = []
    with np.errstate(over="ignore"):
        for far in range(run - 1, most + 1):
            ends = (prefix[: len(prefix) - far] * _ODD[0]) ^ (prefix[far:] * _ODD[1])
            ends ^= ends >> np.uint64(31)
            for mid in range(1, far) if run == 3 else [0]:
                out.append((ends ^ (prefix[mid : len(prefix) - far + mid] * _ODD[2] if mid else np.uint64(run))) * _ODD[3])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def matches_for(rank: np.ndarray, base: int) -> int:
    """The l of lowest estimated cost. rank: estimated other documents of each shingle, in order; base: the shortest prefix."""
    most = min(MOST_MATCHES, len(rank) - base + 1)
    spread = np.cumsum(rank)
    ways = np.arange(1, most + 1)
    cost = base + ways + VERIFY_COST * spread[base + ways - 2] / ways
    return int(ways[cost.argmin()])


def _first(s: np.ndarray, places: int, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `places` shingles of a set in the common order, and their counts by the sketch."""
    counts = sketch[(s & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.int64)
    at = np.argpartition(counts, places - 1)[:places] if places < len(s) else np.arange(len(s))
    at = np.flatnonzero(counts <= counts[at].max())
    at = at[np.lexsort((s[at], counts[at]))][:places]
    return s[at], counts[at]


def _post(docs: DataFrame, width: int, percent: int, sketch: np.ndarray, wanted: NodeFilter, nodes: Nodes) -> DataFrame:
    """Rows of two kinds: postings (node, n, l, token), and whole sets (node, n, shingles) of the wanted nodes."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch, wanted.bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = per_process(("shingler", width), lambda: Shingler(width))
        sketch, wanted = shared.value[0], NodeFilter(shared.value[1])
        noise = int(sketch.sum()) // max(1, len(sketch))
        done: set[int] = set()
        for batch in batches:
            posts, sets = [], []
            for text in batch["text"]:
                s = shingler(text)
                n = len(s)
                if not n:
                    continue
                node = nodes.of(s)
                if node in done:  # a copy within this task adds nothing
                    continue
                if len(done) < 1_000_000:
                    done.add(node)
                if node in wanted:
                    sets.append((node, n, s.tobytes()))
                if n * (100 - percent) < percent and percent * (n + 1) > 100 * n:
                    continue  # too few for any set but its equal
                base = first_places(n, percent)
                first, counts = _first(s, min(n, base + MOST_MATCHES - 1), sketch)
                l = matches_for(np.maximum(counts - 1 - noise, 0), base)
                posts.append((node, n, l, first[: base + l - 1]))
            if posts:
                sizes = [len(p[3]) for p in posts]
                yield pd.DataFrame({"node": np.repeat([p[0] for p in posts], sizes), "n": np.repeat([p[1] for p in posts], sizes), "l": np.repeat(np.array([p[2] for p in posts], np.int32), sizes), "token": np.concatenate([p[3] for p in posts]).view(np.int64), "shingles": None})
            if sets:
                yield pd.DataFrame({"node": [x[0] for x in sets], "n": [x[1] for x in sets], "l": np.int32(0), "token": 0, "shingles": [x[2] for x in sets]})

    return docs.mapInPandas(run, "node bigint, n bigint, l int, token bigint, shingles binary")


def _post_runs(docs: DataFrame, width: int, percent: int, run: int, sketch: np.ndarray, wanted: NodeFilter, nodes: Nodes) -> DataFrame:
    """Postings (node, n, l, token) of runs of shingles, of the documents whose text hash is wanted; l is 1."""
    shared = docs.sparkSession.sparkContext.broadcast((sketch, wanted.bits))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, done, spans = per_process(("shingler", width), lambda: Shingler(width)), set(), {}
        sketch, wanted = shared.value[0], NodeFilter(shared.value[1])
        for batch in batches:
            for text in batch["text"][wanted.has(batch["hash"].to_numpy(np.int64))]:
                s = shingler(text)
                n, node = len(s), nodes.of(s)
                if not n or node in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(node)
                if n not in spans:
                    spans[n] = span(n, percent, run)
                keys = runs_of(_first(s, long_prefix(n, percent, run)[0], sketch)[0], run, spans[n])
                yield pd.DataFrame({"node": node, "n": n, "l": np.int32(1), "token": keys.view(np.int64)})

    return docs.mapInPandas(post, "node bigint, n bigint, l int, token bigint")


def _sets(docs: DataFrame, width: int, wanted: NodeFilter, nodes: Nodes) -> DataFrame:
    """node, shingles of the documents whose text hash is wanted (and, rarely, of others)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted.bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, wanted, done = per_process(("shingler", width), lambda: Shingler(width)), NodeFilter(shared.value), set()
        for batch in batches:
            rows = []
            for text in batch["text"][wanted.has(batch["hash"].to_numpy(np.int64))]:
                s = shingler(text)
                node = nodes.of(s)
                if len(s) and node not in done:
                    if len(done) < 1_000_000:
                        done.add(node)
                    rows.append((node, s.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    return docs.mapInPandas(run, "node bigint, shingles binary")


def possible(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose profiles (node, n, profile) allow a link."""

    @F.pandas_udf("boolean")
    def may(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            x, y = (np.frombuffer(b"".join(c), np.uint32).reshape(-1, PROFILE).astype(np.int64) for c in (left, right))
            both = np.minimum(x, y).sum(axis=1)
            yield pd.Series(100 * both >= percent * (x.sum(axis=1) + y.sum(axis=1) - both))

    met = pairs.join(profiles.toDF("a", "pa"), "a").join(profiles.toDF("b", "pb"), "b")
    return met.filter(may("pa", "pb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, shingles; one row a node) link."""

    @F.pandas_udf("boolean")
    def link(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return met.filter(link("sa", "sb")).select("a", "b")


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets. Each set meets those that no walk has reached."""
    total = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, total)
    _, token = np.unique(np.concatenate(sets), return_inverse=True) if total else (None, np.zeros(0, np.int64))
    own = np.split(token, np.cumsum(sizes)[:-1])
    left = np.arange(total)  # those not reached yet
    links: list[tuple[int, int]] = []

    def index() -> tuple[np.ndarray, np.ndarray]:
        docs = np.repeat(np.arange(len(left)), sizes[left])
        tokens = np.concatenate([own[i] for i in left]) if len(left) else np.zeros(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        return np.searchsorted(tokens[order], np.arange(token.max(initial=-1) + 2)), docs[order]

    starts, docs = index()
    fresh = np.ones(total, bool)
    waiting: list[int] = []
    for seed in range(total):
        if not fresh[seed]:
            continue
        fresh[seed] = False
        waiting.append(seed)
        while waiting:
            x = waiting.pop()
            if 2 * int(fresh.sum()) < len(left):
                left = np.flatnonzero(fresh)
                starts, docs = index()
            if not len(left):
                continue
            a, b = starts[own[x]], starts[own[x] + 1]
            sizes_of = b - a
            at = np.repeat(a - np.cumsum(sizes_of) + sizes_of, sizes_of) + np.arange(sizes_of.sum())
            both = np.bincount(docs[at], minlength=len(left))
            hit = left[(100 * both >= percent * (sizes[x] + sizes[left] - both)) & fresh[left]]
            fresh[hit] = False
            waiting += hit.tolist()
            links += [(x, y) for y in hit.tolist()]
    return links


def _walk(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of a forest for each group of rows (keys, node, shingles)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        nodes = group["node"].to_numpy()
        links = forest([np.frombuffer(x, np.uint64) for x in group["shingles"]], percent)
        return pd.DataFrame([(nodes[x], nodes[y]) for x, y in links], columns=["a", "b"])

    return rows.groupBy(*keys).applyInPandas(run, "a bigint, b bigint")


def _canopies(frequent: DataFrame, block_nodes: int, block_shingles: int) -> DataFrame:
    """node, canopy, blocks, block: canopies of postings (token, node, n) of frequent shingles, and their blocks."""
    spark = frequent.sparkSession
    first = materialize(spark, frequent.groupBy("token").agg(F.min("node").alias("b")), "firsts")
    found = components(frequent.select("token", F.col("node").alias("a")).join(first, "token").select("a", "b"))
    sized = frequent.select("node", "n").distinct().join(found, "node").select("node", "n", F.col("component").alias("canopy"))
    sized = materialize(spark, sized, "canopies")
    blocks = F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") / block_shingles)).cast("int")
    whole = sized.groupBy("canopy").agg(blocks.alias("blocks"))
    out = sized.join(whole, "canopy").select("node", "canopy", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    return materialize(spark, out, "blocks")


def _canopy_links(canopies: DataFrame, sets: DataFrame, links: DataFrame, percent: int, block_nodes: int) -> DataFrame:
    """Links that connect what links inside canopies. links: those known before."""
    spark = canopies.sparkSession
    # the first block with each other block
    mine = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = canopies.select("node", "canopy", F.explode(mine).alias("with")).join(sets, "node")
    found = materialize(spark, _walk(rows, ["canopy", "with"], percent), "walked")
    large = canopies.filter("blocks > 2")
    if large.isEmpty():
        return found
    # what is outside the largest component, with every block
    known = components(links.union(found))
    placed = large.join(known, "node", "left").select("node", "canopy", "blocks", "block", F.coalesce("component", "node").alias("class"))
    placed = materialize(spark, placed, "placed")
    most = placed.groupBy("canopy", "class").count().groupBy("canopy").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
    placed = placed.join(most, "canopy")
    outside = placed.filter("class != largest")
    counts = outside.groupBy("canopy").agg(F.ceil(F.count("*") / block_nodes).cast("int").alias("outer"))
    outside = outside.join(counts, "canopy").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("outer")).cast("int"))
    left = outside.select("canopy", "node", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    right = placed.join(counts, "canopy").select("canopy", "node", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("part"), F.col("block").alias("with"))
    rows = left.select("canopy", "node", "part", "with").union(right.select("canopy", "node", "part", "with")).join(sets, "node")
    return found.union(materialize(spark, _walk(rows, ["canopy", "part", "with"], percent), "walked"))


def _live(posts: DataFrame, found: DataFrame) -> DataFrame:
    """posts (token, node, n, l) of tokens that more than one class posts, with class, top (the largest class of the token),
    posts and outside (postings, and those outside the largest class). found: node, component."""
    spark = posts.sparkSession
    posts = posts.repartition(tasks(spark), "token").distinct()
    beside = Window.partitionBy("token").orderBy("node")
    shared = posts.withColumn("_near", F.coalesce(F.lag("node").over(beside), F.lead("node").over(beside))).filter("_near IS NOT NULL").drop("_near")
    shared = materialize(spark, shared, "shared")
    placed = shared.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("token", "node", "n", "l", F.coalesce("component", "node").alias("class"))
    tokens = placed.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi").select("token")
    live = materialize(spark, placed.join(materialize(spark, tokens, "tokens"), "token"), "live")
    sizes = live.groupBy("token", "class").agg(F.count("*").alias("c")).groupBy("token")
    sizes = sizes.agg(F.sum("c").alias("posts"), F.max(F.struct("c", "class")).alias("most"))
    sizes = sizes.select("token", "posts", (F.col("posts") - F.col("most.c")).alias("outside"), F.col("most.class").alias("top"))
    out = materialize(spark, live.join(materialize(spark, sizes, "tokens"), "token"), "live")
    discard(spark, shared)
    discard(spark, live)
    forget(spark)
    return out


def _pairs(rare: DataFrame, fits: str) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that share enough of the tokens of these live postings."""
    few = rare.filter("class != top").select("token", F.col("node").alias("a"), "n", "l", F.col("class").alias("ca"))
    met = few.join(rare.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("class").alias("cb"), "top"), "token")
    met = met.filter("ca != cb AND (cb = top OR a < b)").filter(fits)
    met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("shared"), F.first(F.least("l", "k")).alias("enough"))
    return met.filter("shared >= enough").select("a", "b")


def classes(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, block_nodes: int = BLOCK_NODES,
    most_run: int = LONGEST_RUN, node_bits: int = 64,
) -> DataFrame:
    """id, hash (xxhash64 of the text), n_shingles, node, class long for every row of df: a class is a connected component,
    and null for empty sets. Rows of one node have equal sets."""
    spark = df.sparkSession
    limit_arrow(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.xxhash64(text_col).alias("hash"))
    survey = materialize(spark, _survey(docs, width, power_of_two(SKETCH_SHARE * df.count(), SKETCH), Nodes(node_bits)), "survey")
    sketch = _add_up(survey.filter("part IS NOT NULL").select("part", "data"), "u8", SLICES)
    told = survey.filter("part IS NULL").drop("part", "data")
    collided = told.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo != hi").select("node")
    collided = frozenset(r[0] for r in collided.limit(MOST_COLLISIONS + 1).collect())
    if len(collided) > MOST_COLLISIONS:
        raise RuntimeError("too many sets share 64 bits of their hashes")
    nodes = Nodes(node_bits, collided)
    if collided:
        met = spark.createDataFrame([(n,) for n in collided], "_n long")
        told = told.join(met, F.col("node") == F.col("_n"), "left").withColumn("node", F.when(F.col("_n").isNull(), F.col("node")).otherwise(F.col("other")))
        told = materialize(spark, told.drop("_n"), "survey")
    members = told.select("id", "hash", "node", "n", "mins")
    profiles = materialize(spark, told.filter("n > 0").groupBy("node").agg(F.first("profile").alias("profile")), "profiles")

    # groups by min-hash, each document against the least node of its group, where the sizes allow a link
    fits = "100 * least(n, m) >= {0} * greatest(n, m)".format(percent)
    mins = members.filter("n > 0").select("node", "n", F.posexplode("mins").alias("k", "v"))
    groups = mins.groupBy("k", "v").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("top")).filter("c.node != top")
    groups = materialize(spark, groups.select("k", "v", F.col("c.node").alias("center"), F.col("c.n").alias("m")), "groups")
    stars = mins.join(groups, ["k", "v"]).filter("node != center").filter(fits).select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = materialize(spark, possible(stars, profiles, percent), "stars")
    posted = materialize(spark, _post(docs, width, percent, sketch, _node_filter(stars.select(F.explode(F.array("a", "b")))), nodes), "posted")
    sets = materialize(spark, posted.filter("shingles IS NOT NULL").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    links = materialize(spark, verified(stars, sets, percent), "links")
    found = materialize(spark, components(links), "classes")
    live = _live(posted.filter("shingles IS NULL").select("token", "node", "n", "l"), found)
    discard(spark, posted)
    discard(spark, sets)

    # shingles, then runs of two and three where these are frequent; what stays frequent makes canopies
    last, pairs, often = longest_run(percent, most_run), None, None
    for run in range(1, last + 1):
        if run > 1:
            hard = materialize(spark, members.join(often.select("node").distinct(), "node", "left_semi").select("hash"), "hard")
            live = _live(_post_runs(docs, width, percent, run, sketch, _node_filter(hard), nodes).select("token", "node", "n", "l"), found)
        rare = F.col("posts") * F.col("outside") <= frequent * frequent
        new = _pairs(live.filter(rare), fits)
        pairs = new if pairs is None else pairs.union(new)
        often = live.filter(~rare).select("token", "node", "n")
        often_shingles = often if run == 1 else often_shingles
        if often.isEmpty():
            often = None
            break
    if often is not None:  # an undecided pair shares a frequent shingle, and each of the two has frequent runs
        often = often_shingles.join(materialize(spark, often.select("node").distinct(), "hard"), "node", "left_semi")
    pairs = materialize(spark, possible(pairs.distinct(), profiles, percent), "pairs")
    canopies = None if often is None else _canopies(often, block_nodes, BLOCK_SHINGLES)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = wanted if canopies is None else wanted.union(canopies.select("node"))
    if not wanted.isEmpty():
        texts = materialize(spark, members.join(wanted.distinct(), "node", "left_semi").select("hash"), "wanted")
        sets = _sets(docs, width, _node_filter(texts), nodes).groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets = materialize(spark, sets, "sets")
        more = links.union(verified(pairs, sets, percent))
        if canopies is not None:
            more = more.union(_canopy_links(canopies, sets, links, percent, block_nodes))
        found = materialize(spark, components(materialize(spark, more, "links")), "classes")
        discard(spark, sets)
    forget(spark)
    out = members.join(found.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left")
    return out.select("id", "hash", F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))


def smallest_ids(found: DataFrame) -> DataFrame:
    """id, n_shingles, component_id: the smallest id of each row's class."""
    found = materialize(found.sparkSession, found, "members")
    least = found.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    # written, so that the join reads it as it is and can split the rows of a large class
    least = materialize(found.sparkSession, least.select(F.col("class").alias("_class"), "least"), "least")
    out = found.join(least, F.col("class") == F.col("_class"), "left")
    return out.select("id", "n_shingles", F.coalesce("least", "id").alias("component_id"))
