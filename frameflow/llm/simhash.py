"""SimHash near-duplicates through vantage-point trees, sharded over the cluster.

1. One pass turns each whole text into 64 bits; equal fingerprints become one.
2. Two fingerprints at most 3 bits apart are at most 1 bit apart in their upper or in their lower half. So there are two
   trees, over the halves' Hamming distance with radius 1, where a boundary cuts through few fingerprints; over all 64
   bits with radius 3 most of them lie on a boundary. The top of each tree is built on the driver from a sample of
   bounded size; a node splits by the distance from its vantage point, at the distance that leaves the least work.
3. A fingerprint is stored in the leaf (a shard) where it belongs, and sent as a query to every later leaf that the
   triangle inequality can't rule out.
4. In a shard the tree goes on, down to blocks that are compared outright with all 64 bits. A shard returns each linked
   member with the smallest member of its group there, never pairs, so a large group costs as many rows as members.
5. Groups of shards are joined by connected components over the smallest doc_ids.

Defined results: a null, empty or blank text has fingerprint 0; a row with a null doc_id joins its fingerprint's group
but links nothing; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import claim, materialise
from frameflow.llm.graph import connected_components

HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)
ALL = 0xFFFFFFFFFFFFFFFF
SHARD = 4096  # fingerprints a shard is meant to store
MAX_SHARDS = 1 << 16
SAMPLE_PER_SHARD = 32
MAX_SAMPLE = 1 << 20
BRUTE = 1 << 20  # comparisons that a local tree makes outright
PIECE = 4 << 20  # bytes of a text that are split into words at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _hashes(text: bytes, n: int, seed: int):
    """Arrays of the hashes of all shingles of ``n`` words, piece by piece of the text."""
    import xxhash

    h, carry, at, any_ = partial(xxhash.xxh64_intdigest, seed=seed), [], 0, False
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
            end = m.start()
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= n:
            any_ = True
            yield np.fromiter(map(h, map(b" ".join, zip(*[words[k:] for k in range(n)]))), np.uint64, len(words) - n + 1)
            words = words[len(words) - n + 1 :] if n > 1 else []
        carry = words
    if not any_ and carry:
        yield np.array([h(b" ".join(carry))], np.uint64)


def simhash(text: str | None, n: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    return majority(_hashes((text or "").encode("utf-8", "surrogatepass"), n, seed))


def majority(hashes) -> int:
    """The fingerprint of arrays of hashes."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in hashes:
        total += len(h)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def _distance(fps: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def _split(fps: np.ndarray, mask: int, radius: int, rng: np.random.Generator, tries: int = 6) -> tuple | None:
    """The best (vantage, threshold) of a few: inside is distance <= threshold. None if no split saves work."""
    best, n = None, len(fps)
    for v in rng.choice(fps, min(tries, n), replace=False):
        counts = np.bincount(_distance(fps, int(v), mask), minlength=66)
        upto = np.concatenate([np.zeros(radius + 1, np.int64), np.cumsum(counts), np.full(radius + 1, n)])
        at = lambda d: upto[d + radius + 1]  # noqa: B023, E731  how many are at distance d or less
        mu = np.arange(65)
        inside, outside = at(mu), n - at(mu)
        work = inside * at(np.minimum(mu + radius, 65)) + outside * outside
        work[(inside == 0) | (outside == 0)] = n * n
        k = int(work.argmin())
        if work[k] < 0.9 * n * n and (best is None or work[k] < best[0]):
            best = (work[k], int(v), k)
    return best and best[1:]


def build_tree(sample: np.ndarray, mask: int, radius: int, all_radius: int, leaf: int, seed: int = 7) -> list:
    """Nodes (mask, radius, vantage, threshold, inside, outside); a child below 0 is leaf number -child - 1."""
    rng, nodes, leaves = np.random.default_rng(seed), [], [0]

    def grow(fps: np.ndarray, mask: int, radius: int) -> int:
        found = _split(fps, mask, radius, rng) if len(fps) > leaf else None
        if len(fps) > leaf and not found and mask != ALL:
            mask, radius = ALL, all_radius
            found = _split(fps, mask, radius, rng)
        if not found:
            leaves[0] += 1
            return -leaves[0]
        v, mu = found
        inside, k = _distance(fps, v, mask) <= mu, len(nodes)
        nodes.append(None)
        nodes[k] = (mask, radius, v, mu, grow(fps[inside], mask, radius), grow(fps[~inside], mask, radius))
        return k

    root = grow(sample, mask, radius)
    return nodes if root >= 0 else []


def route(nodes: list, fps: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices stored there, indices of queries that must look there, from earlier leaves)."""
    out, none = [], np.zeros(0, np.int64)

    def go(k: int, home: np.ndarray, guests: np.ndarray) -> None:
        if not len(home) and not len(guests):
            return
        if k < 0:
            out.append((-k - 1, home, guests))
            return
        mask, radius, v, mu, inside, outside = nodes[k]
        dh, dg = _distance(fps[home], v, mask), _distance(fps[guests], v, mask)
        go(inside, home[dh <= mu], guests[dg <= mu + radius])
        near = home[(dh <= mu) & (dh > mu - radius)]  # of the inside, those that can have a partner outside
        go(outside, home[dh > mu], np.concatenate([guests[dg > mu - radius], near]))

    go(0 if nodes else -1, np.arange(len(fps)), none)
    return out


class Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        p = np.array(self.parent, np.int64)
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p.tolist()
        return p


def link(fps: np.ndarray, stored: np.ndarray, guests: np.ndarray, mask: int, radius: int, bits: int, groups: Groups, rng: np.random.Generator) -> None:
    """Unite all of ``stored`` with each other and with ``guests`` that are at most ``bits`` apart."""
    if not len(stored):
        return
    if len(stored) * (len(stored) + len(guests)) > BRUTE:
        pick = fps[stored] if len(stored) <= 4096 else fps[rng.choice(stored, 4096, replace=False)]
        found = _split(pick, mask, radius, rng, 3)
        if not found and mask != ALL:
            return link(fps, stored, guests, ALL, bits, bits, groups, rng)
        if found:
            v, mu = found
            ds, dg = _distance(fps[stored], v, mask), _distance(fps[guests], v, mask)
            inside, near = ds <= mu, (ds <= mu) & (ds > mu - radius)
            link(fps, stored[inside], guests[dg <= mu + radius], mask, radius, bits, groups, rng)
            return link(fps, stored[~inside], np.concatenate([guests[dg > mu - radius], stored[near]]), mask, radius, bits, groups, rng)
    left = np.concatenate([stored, guests])
    rows = max(1, min(128, (1 << 22) // len(stored)))
    for k in range(0, len(left), rows):
        part = left[k : k + rows]
        close = np.bitwise_count(fps[part][:, None] ^ fps[stored][None, :]) <= bits
        close &= part[:, None] != stored[None, :]
        hit = np.flatnonzero(close.any(1))
        if len(hit):
            roots = groups.roots()
            for r in hit:
                i = int(part[r])
                for j in np.unique(roots[stored[close[r]]]):
                    groups.union(i, int(j))
    return None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed bigint, for every row."""

    def work(batches):
        import pyarrow as pa

        claim("near")
        for batch in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id bigint, fp bigint")


def shard_links(distinct: DataFrame, n: int, bits: int = 3, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) of representatives: each member that has a link in a shard, with its group's smallest there."""
    shards = max(1, min(MAX_SHARDS, -(-n // shard)))
    want = min(MAX_SAMPLE, shards * SAMPLE_PER_SHARD)
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, 2 * want / max(1, n)) * (1 << 30))).select("fp").limit(4 * want)
    sample = np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64)
    sample.sort()
    leaf = max(1, -(-len(sample) // shards))
    trees = [build_tree(sample, half, bits // 2, bits, leaf) if len(sample) > 1 else [] for half in HALVES]

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            ids, reps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fps = ids.astype(np.int64).view(np.uint64)
            for t, nodes in enumerate(trees):
                for leaf_no, home, guests in route(nodes, fps):
                    at = np.concatenate([home, guests])
                    cols = [np.full(len(at), 2 * leaf_no + t, np.int64), ids[at], reps[at], np.arange(len(at)) < len(home)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "fp", "rep", "home"])

    def join(table):
        import pyarrow as pa

        shard_no = table.column("shard")[0].as_py()
        fps = table.column("fp").to_numpy().view(np.uint64)
        reps, home = table.column("rep").to_numpy(), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(reps, kind="stable")  # so that the smallest position of a group is its smallest representative
        fps, reps, home = fps[order], reps[order], home[order]
        groups = Groups(len(fps))
        link(fps, np.flatnonzero(home), np.flatnonzero(~home), HALVES[shard_no % 2], bits // 2, bits, groups, np.random.default_rng(7))
        roots = groups.roots()
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        return pa.table({"a": reps[linked], "b": reps[roots[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return distinct.select("fp", "rep").mapInArrow(send, "shard bigint, fp bigint, rep bigint, home boolean").groupBy("shard").applyInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, shard: int = SHARD) -> DataFrame:
    """Per row: doc_id, fp and component_id, the smallest doc_id reachable by links of at most ``bits`` differing bits."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    groups = connected_components(shard_links(distinct, distinct.count(), bits, shard))
    named = distinct.join(groups, distinct["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(F.col("doc_id").alias(id_col), "fp", "component_id")
