"""Exact n-gram Jaccard self-join with skipping by set relations, and the classes its links form.

A text's set holds the hashes (64 bits) of its distinct word shingles. Equal sets are one node, whatever their number.

Global order of shingles. By hash, except that shingles frequent over the whole corpus come last, so that common passages stay out
of prefixes. The frequent ones are counted over all texts (each task reports those it meets REPORT times or more) and the HOT
most frequent are broadcast (4 MB at most). Any order gives the same links; this one keeps index lists short.

Set relations. Nodes that agree on a band of minima name a leader, the one with the fewest shingles of its own (those that are not
frequent): in a large group of near copies, the original. The pair is verified exactly, and a node whose set is within the threshold of
a leader answers through the nearest: its answers are among the pairs of its leader, because Jaccard distance is a metric. Index
lists (one for each shingle of some prefix) then yield pairs of leaders only. Lists are ordered by set size and position, and blocks of
entries are skipped by the bound that a shared shingle at positions i and j leaves an overlap of at most
min(i, j) + min(|X| - i, |Y| - j). Two sets without leader or followers must also share as many prefix shingles as their sizes ask
for: of |X| shingles the first p show all they share up to the smaller of the two prefixes' ends, so the overlap is at most
(shared so far) + max(|X| - p(X), |Y| - p(Y)).

A pair of leaders is verified exactly. Where it is no link and the distances of their followers leave room for one
(d(A, B) <= 1 - threshold + d(Y, A) + d(Z, B)), pairs of followers are derived from it: those that share enough shingles of their
own in their prefixes, from index lists, and those that may link by their frequent ones, from blocks of followers of like distance and
size that are skipped whole by both sides' bounds. They are verified too. So no link between different classes is lost and
no list or group of copies is expanded into all its pairs.

Every verified link goes into connected components by alternating large and small stars, on the executors.

Number of links. A set is in the group of its leader, or alone in its own, and what it differs by from the group's leader (the symmetric
difference) is kept from verification. Any two linked sets are in one group or in two whose leaders were verified, and their symmetric
difference follows from the kept ones: |Y ^ Z| = |(Y ^ A) ^ (A ^ C) ^ (Z ^ C)|. Blocks of members are compared as matrices, so the links
inside classes are counted one by one and exactly without becoming rows; blocks whose sizes decide are not compared. Time is quadratic
in the sets of a group that sizes leave open.

Result: one row per document row, with its class and its number of links: the other rows whose set links to its own, copies too. A null, empty or wordless text has no shingles and is alone in its class. Repeated rows and ids
are further copies. Texts of any length are read whole, hashed in pieces of about a megabyte. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HOT, REPORT = 1 << 19, 2
BINS, BANDS = 32, 4
SLACK = 1e-9
WIDE = 25_000  # rows a file of tables with prefixes


# ---- signatures --------------------------------------------------------------------------------------------------


def _reporter(k: int):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def reported():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= REPORT
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for s in common.shingle_sets(common.texts_of(batch.column(0)), k):
                held.append(s)
                size += len(s)
                if size > 3 << 20:
                    yield reported()
                    held, size = [], 0
        if held:
            yield reported()
        held.clear()
        common.freed()

    return run


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The HOT most frequent shingles, sorted."""
    counts = docs.select("text").mapInArrow(_reporter(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= 3 * REPORT).orderBy(F.desc("n"), "token").limit(HOT).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


class Known:
    """A sorted array of hashes with a coarse table before it, as most lookups miss."""

    MASK = np.uint64((1 << 22) - 1)

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.coarse = hashes, np.zeros(1 << 22, bool)
        self.coarse[hashes & self.MASK] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.coarse[x & self.MASK]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.hashes[np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)] == x[at]
        return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def prefix_of(s: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles in the global order (those that are often last): so many that two linked sets share one of them."""
    p = prefix_length(len(s), num, den)
    rare = s[~often][:p]
    return rare if len(rare) == p else np.concatenate((rare, s[often][: p - len(rare)]))


_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))


def bands_of(s: np.ndarray) -> list[int]:
    """Keys of groups of one-permutation minima; bins without a shingle count as such, all-empty bands are left out."""
    at = np.searchsorted(s, _EDGES)
    ends = np.append(at[1:], len(s))
    least = np.where(at < ends, s[np.minimum(at, len(s) - 1)], np.uint64(0))
    out = []
    for b in range(BANDS):
        part = least[b::BANDS]
        if part.any():
            raw = part.tobytes() + bytes([b])
            out.append(int.from_bytes(common.hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
    return out


def _signer(k: int, num: int, den: int, hot):
    def run(batches):
        known = Known(hot.value)
        for batch in batches:
            ids, texts = batch.column(0), common.texts_of(batch.column(1))
            n, rare, digests, bands, prefixes = [], [], [], [], []
            for s in common.shingle_sets(texts, k):
                often = known.has(s)
                n.append(len(s))
                rare.append(len(s) - int(often.sum()))
                digests.append(common.digest(s))
                bands.append(bands_of(s) if len(s) else [])
                prefixes.append(prefix_of(s, often, num, den).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int32()), pa.array(rare, pa.int32()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prefixes, pa.binary())],
                names=["doc_id", "n", "rare", "digest", "bands", "prefix"],
            )
        common.freed()

    return run


# ---- exact verification ------------------------------------------------------------------------------------------


def _packer(k: int, bits):
    """Texts of the wanted ids, compressed, with their digests."""

    def run(batches):
        for batch in batches:
            keep = np.flatnonzero(common.in_filter(bits.value, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(keep):
                continue
            some = batch.take(pa.array(keep))
            texts = common.texts_of(some.column(2))
            digests = [common.digest(s) for s in common.shingle_sets(texts, k)]
            packed = [zlib.compress(t.lower(), 1) for t in texts]
            columns = [some.column(0), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "packed"])
        common.freed()

    return run


def _verifier(k: int, reach: float):
    """Rows (key, salt, role, digest, packed) in order: a leader (role 0), then its followers (role 1). delta: the symmetric difference
    of pairs at most reach apart."""

    def run(batches):
        lead, own = None, None
        for batch in batches:
            a, b, d, deltas = [], [], [], []
            keys, roles, digests = (batch.column(i).to_pylist() for i in (0, 2, 3))
            texts = [zlib.decompress(x) for x in batch.column(4).to_pylist()]
            for key, role, digest, s in zip(keys, roles, digests, common.shingle_sets(texts, k)):
                if role == 0:
                    lead, own = key, s
                elif key == lead:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    a.append(key)
                    b.append(digest)
                    either = len(own) + len(s) - both
                    d.append((both, either))
                    deltas.append(np.setxor1d(own, s, assume_unique=True).tobytes() if either - both <= reach * either else None)
            columns = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(deltas, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "both", "either", "delta"])
        common.freed()

    return run


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, reach: float = -1.0) -> DataFrame:
    """(a, b, both, either, delta) of each distinct pair of digests: sizes of intersection and union, from the texts themselves, and
    the symmetric difference where they are at most reach apart. A table."""
    spark = docs.sparkSession
    pairs = common.settled(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")  # null ids too have texts
    wanted = common.held(ids.join(nodes.select("digest", key), "digest"))
    words = common.filter_words(2 * pairs.rows)
    bits = spark.sparkContext.broadcast(common.id_filter(wanted, "doc_id", words))
    rows = docs.select(key, "text").select("doc_id", common.spot_column("doc_id", words).alias("spot"), "text")
    packed = rows.mapInArrow(_packer(k, bits), "doc_id long, digest binary, packed binary")
    # a digest that several rows share comes once
    packed = packed.join(wanted.withColumnRenamed("digest", "want"), "doc_id").filter(F.col("digest") == F.col("want"))
    packed = common.held(packed.groupBy("digest").agg(F.min("packed").alias("packed")))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("salts"))
    each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    leaders = salts.join(packed, salts["a"] == packed["digest"]).select("a", each, F.lit(0).alias("role"), "digest", "packed")
    followers = pairs.join(salts, "a").join(packed, F.col("b") == packed["digest"])
    salt = F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")
    followers = followers.select("a", salt, F.lit(1).alias("role"), "digest", "packed")
    both = leaders.unionByName(followers).repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "digest")
    out = common.settled(both.mapInArrow(_verifier(k, reach), "a binary, b binary, both long, either long, delta binary"), "verified")
    packed.unpersist(), wanted.unpersist()
    common.dropped(pairs)
    return out


# ---- index lists -------------------------------------------------------------------------------------------------


ENTRIES = "token long, leader long, place long, often long"


def _lister(batches):
    """Explodes prefixes of rows (n, leader, prefix, tied, own_rare, hots): place = size << 32 | position << 1 | (0 for a set without leader
    or followers); often = the number of frequent shingles in the prefix, as -1 - that number in lists of frequent shingles."""
    for batch in batches:
        n, leaders, tied, rare, hots = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3, 4, 5))
        prefixes = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        sizes = np.array([len(p) for p in prefixes], np.int64)
        if not sizes.sum():
            continue
        tokens = np.concatenate(prefixes).view(np.int64)
        position = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        often = np.repeat(hots, sizes)
        often = np.where(position >= np.repeat(rare, sizes), -1 - often, often)
        place = np.repeat((n << 32) | tied, sizes) | (position << 1)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(leaders, sizes)), pa.array(place), pa.array(often)], names=["token", "leader", "place", "often"])


def least_shared(x, y, num: int, den: int):
    """How many prefix shingles two sets of sizes x <= y must share to link."""
    return -(-num * (x + y) // (num + den)) - np.maximum(-(-num * x // den), -(-num * y // den)) + 1


def list_pairs(leaders: np.ndarray, n: np.ndarray, pos: np.ndarray, tied: np.ndarray, often: np.ndarray, num: int, den: int):
    """Pairs (x, y, size of x, size of y, tied, slack) of different leaders of one index list, whose entries may still link. Sizes are 0
    where the pair is tied: a leader stands for more than one set. Tied entries of one leader and size are one entry with a range of
    positions, so a group of near copies adds a few entries.

    Entries of one size form a block in order of position. Two blocks can hold linked sets only if num * larger <= den * smaller.
    A shingle shared at positions i and j leaves an overlap of at most min(i, j) + min(x - i, y - j), so entries link only
    where j - i <= y - need and i - j <= x - need; blocks, and parts of blocks, beyond that are skipped whole.

    In the list of a frequent shingle, two free sets form a pair only if frequent shingles alone may do for them (it then counts as
    tied); all other linked pairs share a shingle that is not frequent, and slack says how many frequent ones they may share besides."""
    hot = len(often) and often[0] < 0
    often = np.where(often < 0, -1 - often, often)
    free = np.flatnonzero(tied == 0)
    rows = [(leaders[free], n[free], pos[free], pos[free], tied[free], often[free])]
    if len(free) < len(n):
        bound = np.flatnonzero(tied)
        order = bound[np.lexsort((pos[bound], n[bound], leaders[bound]))]
        same = (leaders[order][1:] == leaders[order][:-1]) & (n[order][1:] == n[order][:-1])
        at = np.flatnonzero(np.concatenate(([True], ~same)))
        end = np.append(at[1:], len(order)) - 1
        rows.append((leaders[order][at], n[order][at], pos[order][at], pos[order][end], tied[order][at], often[order][at]))
    leaders, n, low, high, tied, often = (np.concatenate([r[i] for r in rows]) for i in range(6))
    order = np.lexsort((low, n))
    leaders, n, low, high, tied, often = leaders[order], n[order], low[order], high[order], tied[order], often[order]
    sizes, first = np.unique(n, return_index=True)
    last = np.append(first[1:], len(n))
    for i, x in enumerate(sizes.tolist()):
        for j in range(i, len(sizes)):
            y = int(sizes[j])
            if num * y > den * x:
                break
            need = -(-num * (x + y) // (num + den))
            a0, a1, b0, b1 = first[i], last[i], first[j], last[j]
            if low[b0] - high[a0:a1].max() > y - need or low[a0] - high[b0:b1].max() > x - need:
                continue
            for at in range(a0, a1, 512):
                to = min(at + 512, a1)
                stop = b0 + np.searchsorted(low[b0:b1], high[at:to].max() + y - need, side="right")
                one, two = slice(at, to), slice(b0, stop)
                near = (low[two][None, :] - high[one][:, None] <= y - need) & (low[one][:, None] - high[two][None, :] <= x - need) & (leaders[one][:, None] != leaders[two][None, :])
                if x == y:
                    near &= np.arange(b0, stop)[None, :] > np.arange(at, to)[:, None]
                if hot:
                    enough = np.minimum(often[one][:, None], often[two][None, :]) >= least_shared(x, y, num, den)
                    near &= enough | ((tied[one][:, None] | tied[two][None, :]) == 1)
                p, q = np.nonzero(near)
                if len(p):
                    p, q = at + p, b0 + q
                    yield _oriented(leaders[p], leaders[q], n[p], n[q], np.full(len(p), 1) if hot else tied[p] | tied[q], np.minimum(often[p], often[q]))


def _oriented(a, b, x, y, tied, slack):
    flip = a > b
    free = 1 - tied
    return np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x) * free, np.where(flip, x, y) * free, tied, slack * free


def _pairer(num: int, den: int):
    """Pairs of leaders with the number of lists they share, from lists in order of (token, place); a list may span batches."""

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 4

        def pairs(cols, final: bool):
            token, leader, place, often = cols
            n, pos, tied = place >> 32, (place & 0xFFFFFFFF) >> 1, place & 1
            begins = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            ends = np.append(begins[1:], len(token))
            stop = len(token) if final or not len(begins) else begins[-1]
            found = []
            two = begins[(ends - begins == 2) & (ends <= stop)]  # most lists of more than one entry
            if len(two):
                x, y = n[two], n[two + 1]
                need = -(-num * (x + y) // (num + den))
                apart = pos[two + 1] - pos[two]
                fits = (num * y <= den * x) & (apart <= y - need) & (-apart <= x - need) & (leader[two] != leader[two + 1])
                hot, slack, bound = often[two] < 0, np.minimum(*(np.where(o < 0, -1 - o, o) for o in (often[two], often[two + 1]))), tied[two] | tied[two + 1]
                fits &= ~hot | (bound == 1) | (slack >= least_shared(x, y, num, den))
                a = two[fits]
                found.append(_oriented(leader[a], leader[a + 1], n[a], n[a + 1], (bound | hot)[fits], slack[fits]))
            longer = (ends - begins > 2) & (ends <= stop)
            for a, b in zip(begins[longer].tolist(), ends[longer].tolist()):
                if (leader[a:b] != leader[a]).any():
                    found += list_pairs(leader[a:b], n[a:b], pos[a:b], tied[a:b], often[a:b], num, den)
            out = np.stack([np.concatenate([f[i] for f in found]) for i in range(6)], 1) if found else np.zeros((0, 6), np.int64)
            out, shared = np.unique(out, axis=0, return_counts=True)
            names = ["x", "y", "nx", "ny", "tied", "slack", "shared"]
            return pa.RecordBatch.from_arrays([*[pa.array(out[:, i]) for i in range(6)], pa.array(shared.astype(np.int64))], names=names), [c[stop:] for c in cols]

        for batch in batches:
            cols = [np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False))) for i, r in enumerate(rest)]
            if len(cols[0]) and cols[0][0] == cols[0][-1]:
                rest = cols  # one list so far
                continue
            out, rest = pairs(cols, False)
            yield out
        yield pairs(rest, True)[0]
        common.freed()

    return run


PAIRS = "x long, y long, nx long, ny long, tied long, slack long, shared long"


def enough_shared(num: int, den: int, shared=None, tied=None):
    """Whether two sets of sizes nx and ny that share so many prefix shingles may link; tied pairs always may."""
    nx, ny = F.col("nx"), F.col("ny")
    shared, tied = F.col("shared") if shared is None else shared, F.col("tied") if tied is None else tied
    need = F.ceil(num * (nx + ny) / F.lit(num + den) - 1e-9)
    rest = lambda n: F.ceil(num * n / F.lit(den) - 1e-9) - 1  # noqa: E731  n - p(n)
    return (tied == 1) | (shared >= need - F.greatest(rest(nx), rest(ny)))


# ---- pairs of followers ------------------------------------------------------------------------------------------

MEMBERS = "lids array<bigint>, fars array<double>, ns array<int>, hots array<bigint>"


def members_in_blocks(own: DataFrame, block: int = 512) -> DataFrame:
    """Blocks of about `block` sets of one leader, of like distance from it and like size, as arrays with their bounds. A large
    group's blocks are dealt by salt, so none gathers the group."""
    bins = ["leader", "far_bin", "size_bin"]
    binned = own.select("*", F.floor(F.col("far") * 64).alias("far_bin"), F.floor(F.log(F.col("n").cast("double")) * 8).alias("size_bin"))
    counts = binned.groupBy(*bins).agg(F.ceil(F.count("*") / block).alias("salts"))
    salted = binned.join(counts, bins).withColumn("salt", F.pmod(F.col("lid"), F.col("salts")))
    one = F.struct("lid", "far", "n", "hot")
    blocks = salted.groupBy(*bins, "salt").agg(F.collect_list(one).alias("m"), F.max("far").alias("far"), F.min("n").alias("least"), F.max("n").alias("most"))
    return blocks.select("leader", "far", "least", "most", F.col("m.lid").alias("lids"), F.col("m.far").alias("fars"), F.col("m.n").alias("ns"), F.col("m.hot").alias("hots"))


def _crosser(num: int, den: int, room: float):
    """(x, y) of those members of two blocks that distances, sizes and shared frequent shingles still allow to link; rows are a gap
    and the two blocks' arrays. Arrays are compared as a whole, and only what passes both sides' bounds becomes a row."""

    def run(batches):
        for batch in batches:
            gaps = batch.column(0).to_numpy()
            sides = [[[np.array(v) for v in batch.column(i).to_pylist()] for i in range(at, at + 4)] for at in (1, 5)]
            found = []
            for r, gap in enumerate(gaps.tolist()):
                (a, fa, na, ha), (b, fb, nb, hb) = ([c[r] for c in side] for side in sides)
                small, large = np.minimum(na[:, None], nb[None, :]), np.maximum(na[:, None], nb[None, :])
                fits = (gap <= room + fa[:, None] + fb[None, :]) & (den * small >= num * large)
                fits &= np.minimum(ha[:, None], hb[None, :]) >= least_shared(small, large, num, den)
                i, j = np.nonzero(fits & (a[:, None] != b[None, :]))
                found.append(np.stack((a[i], b[j]), 1))
            out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["x", "y"])

    return run


def follower_pairs(open_: DataFrame, chosen: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of sets that may link though their leaders (a, b of open_, `gap` apart) do not."""
    room = 1 - num / den + SLACK
    length = F.col("n") - F.ceil(num * F.col("n") / F.lit(den) - SLACK) + 1
    own_rare = F.least(F.col("rare").cast("long"), length)
    heads = open_.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    members = chosen.join(heads, "leader", "left_semi").select("leader", "digest", "far")
    members = members.unionByName(heads.select("leader", F.col("leader").alias("digest"), F.lit(0.0).alias("far")))
    sized = full.select("digest", "n", "lid", "prefix", own_rare.alias("own_rare"), (length - own_rare).alias("hot"))
    own = common.settled(members.join(sized, "digest"), "members", WIDE)
    # (1) sets that share a shingle that is not frequent, from its list
    none = F.lit(0).cast("long")
    rare = F.expr("substring(prefix, 1, cast(8 * own_rare as int))").alias("prefix")
    part = own.dropDuplicates(["digest"]).select("n", "lid", rare, none.alias("tied"), "own_rare", none.alias("hots"))
    lists = part.mapInArrow(_lister, ENTRIES).repartition("token").sortWithinPartitions("token", "place", "leader")
    counted = lists.mapInArrow(_pairer(num, den), PAIRS).groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared"))
    named = own.select("lid", "digest", "hot").distinct()
    side = lambda i, d: named.select(F.col("lid").alias(i), F.col("digest").alias(d), F.col("hot").alias(f"h{d}"))
    counted = counted.join(side("x", "a"), "x").join(side("y", "b"), "y").withColumn("shared", F.col("shared") + F.least("ha", "hb"))
    listed = counted.filter(enough_shared(num, den, tied=F.lit(0))).select("a", "b")
    # (2) sets with so many frequent shingles in their prefixes that those alone may do: blocks of members, skipped whole by bounds
    blocks = members_in_blocks(own.filter("hot > 0").select("leader", "far", "n", "lid", "hot"))
    of = lambda c: blocks.select(*[F.col(x).alias(f"{c}_{x}") for x in blocks.columns])
    left, right = of("l"), of("r")
    near = open_.join(left, (F.col("a") == F.col("l_leader")) & (F.col("gap") <= room + F.col("l_far") + F.col("rb")))
    sizes = (den * F.col("l_most") >= num * F.col("r_least")) & (den * F.col("r_most") >= num * F.col("l_least"))
    near = near.join(right, (F.col("b") == F.col("r_leader")) & (F.col("gap") <= room + F.col("l_far") + F.col("r_far")) & sizes)
    arrays = [f"{c}_{x}" for c in "lr" for x in ("lids", "fars", "ns", "hots")]
    crossed = near.select("gap", *arrays).mapInArrow(_crosser(num, den, room), "x long, y long")
    crossed = crossed.join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    return listed.unionByName(crossed).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# ---- numbers of links --------------------------------------------------------------------------------------------


def _common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of one with each of two."""
    out = np.zeros((len(one), len(two)), np.float32)
    flats = [np.concatenate(side) for side in (one, two)]
    both = np.intersect1d(*flats)
    if not len(both):
        return out
    at = []
    for side, flat in zip((one, two), flats):
        column = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        fits = both[column] == flat
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])[fits]
        order = np.argsort(column[fits], kind="stable")
        at.append((row[order], column[fits][order]))
    for first in range(0, len(both), 2048):
        parts = []
        for side, (row, column) in zip((one, two), at):
            a, b = np.searchsorted(column, (first, first + 2048))
            dense = np.zeros((len(side), min(2048, len(both) - first)), np.float32)
            dense[row[a:b], column[a:b] - first] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def linked_members(one: list[np.ndarray], two: list[np.ndarray], n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of sizes n and m link, from their symmetric differences with one and the same set."""
    a, b = (np.array([len(x) for x in side], np.int64) for side in (one, two))
    sizes = n[:, None] + m[None, :]
    near = lambda x: den * (sizes - x) >= num * (sizes + x)  # noqa: E731  x: size of the symmetric difference
    most, least = a[:, None] + b[None, :], np.abs(a[:, None] - b[None, :])
    sure, possible = near(most), near(least)
    if (sure == possible).all():
        return sure
    return near(most - 2 * _common_counts(one, two).astype(np.int64))


def _counter(num: int, den: int):
    """(lid, links) from rows of two blocks of members: whether they are one block, the difference of their leaders, and both blocks."""

    def run(batches):
        common.one_blas_thread()
        for batch in batches:
            lids, links = [], []
            for r in range(batch.num_rows):
                same, delta, *sides = (batch.column(i)[r] for i in range(10))
                (i, n, c), (j, m, d) = ([np.array(x.as_py(), np.int64) for x in sides[at : at + 3]] for at in (0, 4))
                one, two = ([np.frombuffer(x, np.uint64) for x in sides[at].as_py()] for at in (3, 7))
                apart = np.frombuffer(delta.as_py(), np.uint64)
                if len(apart):
                    two = [np.setxor1d(x, apart, assume_unique=True) for x in two]
                link = linked_members(one, two, n, m, num, den)
                if same.as_py():
                    np.fill_diagonal(link, False)
                else:
                    lids.append(j)
                    links.append(c @ link)
                lids.append(i)
                links.append(link @ d)
            lids, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lids, links))
            yield pa.RecordBatch.from_arrays([pa.array(lids[links > 0]), pa.array(links[links > 0])], names=["lid", "links"])
        common.freed()

    return run


def link_counts(full: DataFrame, chosen: DataFrame, met: DataFrame, num: int, den: int, block: int = 512, most_bytes: int = 4 << 20) -> DataFrame:
    """(digest, links): the rows of other sets that link to each set, of sets that have any. met: the verified pairs of leaders."""
    room = 1 - num / den + SLACK
    reach = chosen.groupBy("leader").agg(F.max("far").alias("radius"))
    radius = lambda c: reach.select(F.col("leader").alias(c), F.col("radius").alias(f"r{c}"))
    pairs = met.join(radius("a"), "a", "left").join(radius("b"), "b", "left")
    alone = F.col("ra").isNull() & F.col("rb").isNull()
    direct = pairs.filter(alone & (den * F.col("both") >= num * F.col("either"))).select("a", "b")
    gap = 1 - F.col("both") / F.col("either")
    zero = F.lit(0.0)
    crossed = pairs.filter(~alone & (gap <= room + F.coalesce("ra", zero) + F.coalesce("rb", zero))).select("a", "b", "delta")
    crossed = common.settled(crossed, "crossed", WIDE)
    # members of the groups, their leaders too where they follow no other
    none = F.lit(b"")
    heads = reach.select("leader").unionByName(crossed.select(F.explode(F.array("a", "b")).alias("leader"))).distinct()
    own = heads.join(chosen.select("digest"), F.col("leader") == F.col("digest"), "left_anti").select("leader", F.col("leader").alias("digest"), none.alias("delta"))
    members = chosen.select("leader", "digest", "delta").unionByName(own).join(full.select("digest", "lid", "n", "copies"), "digest")
    size = F.octet_length("delta")
    counts = members.groupBy("leader").agg((F.count("*") > block).alias("many"))
    bins = F.when(F.col("many"), F.floor(F.log2(size + 1))).otherwise(0).cast("int").alias("bin")
    binned = members.join(counts, "leader").select("leader", "lid", "n", "copies", "delta", bins)
    salts = binned.groupBy("leader", "bin").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(size) / most_bytes)).alias("salts"))
    part = (F.col("bin") + 64 * F.pmod(F.col("lid"), F.col("salts"))).alias("part")
    parted = binned.join(salts, ["leader", "bin"]).select("leader", part, F.struct("lid", "n", "copies", "delta").alias("m"))
    fields = ["lid", "n", "copies", "delta"]
    blocks = parted.groupBy("leader", "part").agg(F.collect_list("m").alias("m")).select("leader", "part", *[F.col(f"m.{f}").alias(f"{f}s") for f in fields])
    blocks = common.settled(blocks, "blocks", 500)
    parts = lambda g, i: blocks.select(F.col("leader").alias(g), F.col("part").alias(i))
    within = parts("a", "i").join(parts("b", "j"), (F.col("a") == F.col("b")) & (F.col("i") <= F.col("j"))).withColumn("delta", none)
    across = crossed.join(parts("a", "i"), "a").join(parts("b", "j"), "b")
    columns = ["a", "i", "b", "j", "delta"]
    side = lambda c, g, i: blocks.select(F.col("leader").alias(g), F.col("part").alias(i), *[F.col(f"{f}s").alias(f"{c}_{f}") for f in fields])
    both = within.select(columns).unionByName(across.select(columns)).join(side("x", "a", "i"), ["a", "i"]).join(side("y", "b", "j"), ["b", "j"])
    one = ((F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))).alias("same")
    sides = [f"{c}_{f}" for c in "xy" for f in fields]
    counted = both.select(one, "delta", *sides).mapInArrow(_counter(num, den), "lid long, links long")
    sized = full.select("digest", "lid", "copies")
    ends = direct.unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(sized.select(F.col("digest").alias("b"), "copies"), "b").select(F.col("a").alias("digest"), F.col("copies").alias("links"))
    counted = counted.groupBy("lid").agg(F.sum("links").alias("links")).join(sized, "lid").select("digest", "links")
    out = common.settled(counted.unionByName(ends).groupBy("digest").agg(F.sum("links").alias("links")), "counts")
    common.dropped(crossed, blocks)
    return out


# ---- classes -----------------------------------------------------------------------------------------------------


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its component. Alternating large and small
    stars; each round's links are a table in the shared folder. Not to settle in so many rounds is an error."""
    now = common.settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    before, state = None, (now.rows,)
    for _ in range(rounds):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = common.staged(small.filter(F.col("u") != F.col("v")).distinct(), "links", rows=state[0])
        now, before, state, last = after, state, tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()), now
        common.dropped(last)
        if state == before:
            break
    else:
        raise RuntimeError(f"the classes did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


# ---- the join ----------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Each row's set (doc_id, n, digest), and the distinct sets with words (nodes) with what the search needs. Both are tables."""
    hot = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))
    schema = "doc_id long, n int, rare int, digest binary, bands array<bigint>, prefix binary"
    wide = common.held(docs.mapInArrow(_signer(k, num, den, hot), schema))
    firsts = [F.first(c).alias(c) for c in ("n", "rare", "bands", "prefix")]
    named = wide.filter("n > 0").withColumn("lid", F.xxhash64("digest")).groupBy("digest", "lid")
    full = common.settled(named.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *firsts), "nodes", WIDE)
    sets = common.staged(wide.select("doc_id", "n", "digest"), "sets", wide.count(), 2 * WIDE)
    wide.unpersist()
    return sets, full


def leaders_of(full: DataFrame, docs: DataFrame, k: int, num: int, den: int, reach: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """Verified links from nodes to the heads of their bands, and the nearest head of each (digest, leader, far, delta). The second is a table."""
    banded = full.select("digest", "n", "rare", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min(F.struct("rare", "digest", "n")).alias("head"), F.count("*").alias("c")).filter("c > 1").select("band", "head")
    sizes = den * F.least("n", "head.n") >= num * F.greatest("n", "head.n")
    near = banded.join(heads, "band").filter((F.col("digest") != F.col("head.digest")) & sizes)
    stars = verified(near.select(F.col("head.digest").alias("a"), F.col("digest").alias("b")), full, docs, k, reach)
    stars = stars.filter(den * F.col("both") >= num * F.col("either"))
    nearest = F.min(F.struct((1 - F.col("both") / F.col("either")).alias("far"), "a", "delta")).alias("l")
    chosen = stars.groupBy("b").agg(nearest).select(F.col("b").alias("digest"), F.col("l.a").alias("leader"), F.col("l.far").alias("far"), F.col("l.delta").alias("delta"))
    return stars, common.settled(chosen, "leaders")


def leader_pairs(full: DataFrame, chosen: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of leaders from the index lists that may link, or whose followers may."""
    length = F.col("n") - F.ceil(num * F.col("n") / F.lit(den) - SLACK) + 1
    own_rare = F.least(F.col("rare").cast("long"), length)
    follows = full.join(chosen, "digest", "left").select("digest", "n", "leader", "prefix", own_rare.alias("own_rare"), (length - own_rare).alias("hots"))
    heads = chosen.select(F.col("leader").alias("digest")).distinct().withColumn("leads", F.lit(True))
    tied = (F.col("leader").isNotNull() | F.col("leads").isNotNull()).cast("long")
    led = follows.join(heads, "digest", "left").select("n", F.xxhash64(F.coalesce("leader", "digest")).alias("lid"), "prefix", tied.alias("tied"), "own_rare", "hots")
    lists = led.mapInArrow(_lister, ENTRIES).repartition("token").sortWithinPartitions("token", "place", "leader")
    counted = lists.mapInArrow(_pairer(num, den), PAIRS).groupBy("x", "y", "nx", "ny", "tied", "slack").agg(F.sum("shared").alias("shared"))
    pairs = counted.filter(enough_shared(num, den, F.col("shared") + F.col("slack"))).select("x", "y").distinct()
    of = full.select("lid", "digest")
    pairs = pairs.join(of.select(F.col("lid").alias("x"), F.col("digest").alias("a")), "x").join(of.select(F.col("lid").alias("y"), F.col("digest").alias("b")), "y")
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def join(docs: DataFrame, k: int = 3, threshold: Fraction = Fraction(9, 10), links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, n_links of each row of docs. Without links: the same classes, and no n_links."""
    num, den = threshold.numerator, threshold.denominator
    room = 1 - num / den + SLACK
    reach = lambda times: times * room if links else -1.0
    linked = den * F.col("both") >= num * F.col("either")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clean = lambda: common.cleaned(docs.sparkSession)
    sets, full = signatures(docs, k, num, den)
    clean()
    stars, chosen = leaders_of(full, docs, k, num, den, reach(1))
    clean()
    met = verified(leader_pairs(full, chosen, num, den), full, docs, k, reach(3))
    clean()

    # what the followers' distances leave open between leaders that do not link
    reach = chosen.groupBy(F.col("leader").alias("of")).agg(F.max("far").alias("radius"))
    radius = lambda c: reach.select(F.col("of").alias(c), F.col("radius").alias(f"r{c}"))
    apart = met.filter(~linked).join(radius("a"), "a", "left").join(radius("b"), "b", "left")
    apart = apart.select("a", "b", (1 - F.col("both") / F.col("either")).alias("gap"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ra", "rb")])
    open_ = common.settled(apart.filter((F.col("ra") + F.col("rb") > 0) & (F.col("gap") <= room + F.col("ra") + F.col("rb"))), "open")
    roots = components(stars.select("a", "b").unionByName(met.filter(linked).select("a", "b")))
    clean()
    if open_.rows:
        # leaders that other links join already need no more
        root = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
        still = open_.join(root("a", "sa"), "a", "left").join(root("b", "sb"), "b", "left").filter(F.coalesce("sa", "a") != F.coalesce("sb", "b"))
        still = common.settled(still.select(open_.columns), "open")
        more = verified(follower_pairs(still, chosen, full, num, den), full, docs, k).filter(linked)
        clean()
        if not more.isEmpty():
            roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more.select("a", "b")))

    classes = roots.join(full.select(F.col("digest").alias("node"), "doc_id"), "node")
    ids = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = classes.select("root", F.col("node").alias("digest")).join(ids, "root").select("digest", F.col("component_id").alias("joined"))
    labelled = full.select("digest", "doc_id", "copies").join(of_node, "digest", "left").select("digest", F.coalesce("joined", "doc_id").alias("class_id"), "copies")
    if links:
        others = link_counts(full, chosen, met, num, den)
        labelled = labelled.join(others, "digest", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        clean()
    labelled = common.settled(labelled, "classes")
    common.dropped(full)
    size = F.col("n").cast("long").alias("n_shingles")
    extra = lambda c: [c.cast("long").alias("n_links")] if links else []
    out = sets.filter("n > 0").join(labelled, "digest", "left")
    out = out.select("doc_id", size, F.col("class_id").alias("component_id"), F.col("copies").alias("n_copies"), *extra(F.col("links")))
    wordless = sets.filter("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), *extra(F.lit(0)))
    return out.unionByName(wordless)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))
