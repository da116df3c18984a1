"""Near copies by the exact similarity of word shingles, with candidates from SimHash groups and bands of minima.

Fingerprints of 64 bits alone can't give this: at a similarity of 0.8 two of them differ in some ten bits, a radius at
which a vantage-point tree's triangle bounds rule nothing out. So the groups that the trees of ``simhash`` find (3 bits)
are candidates here, as are bands of minima.

1. One pass turns each text into its set of hashed shingles, of which it keeps a 128-bit digest, the SimHash fingerprint
   and 20 bands of 5 minima (of 100 hash functions). Texts with equal sets become one. Two sets with similarity 0.8 share
   no band in 0.04 % of all cases; more alike ones in fewer. Fingerprints go through the vantage-point trees of
   ``simhash``; those that a shard links (at most ``bits`` bits apart) share one more band.
2. Sets that share a band are candidates. Their whole shingle sets are compared, and only pairs with a Jaccard
   similarity of ``least`` or more are links; so nothing is a copy because its minima, bands or fingerprint say so.
3. The smallest id of a band is its hub. A set is first compared with the smallest of its bands' hubs, then with each
   other hub that isn't known to be in its group by then. So a large group of copies costs few comparisons a member.
4. The others of a band are compared in blocks. Members of the band's largest group aren't compared with each other, but
   with all others, and those with each other; a band with one group is left out. A wide band is dealt into blocks of
   about ``BLOCK`` sets, and each two blocks meet once, where a matrix product counts what their sets share. Pairs are
   never rows: a set goes to as many places as it meets blocks, and two blocks return at most a link for each member, to
   the smallest one it hangs together with. So any two sets that share a band are compared, or are in one group already;
   no comparison is capped.
5. Groups are the connected components of the links.

Defined results: a text with fewer words than a shingle is one shingle of all its words; null, empty and blank texts are
one group; a very long text is hashed piece by piece, and its set is held whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import claim, materialise
from frameflow.llm.graph import connected_components
from frameflow.llm.simhash import Groups, _hashes, majority, shard_links

BANDS, ROWS = 20, 5
MEMBERS = 64  # pairs that share one copy of a hub's set
SLICE = 2048
BLOCK = 128  # sets of a block
BLOCK_HASHES = 1 << 16  # hashes of a block's sets
COLUMNS = 4096  # hashes that a matrix of two blocks spans at once
_FACTORS = np.random.default_rng(2024).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, n: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    parts = list(_hashes((text or "").encode("utf-8", "surrogatepass"), n, seed))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """Signed 64-bit hashes of the bands of minima; none for an empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), SLICE):
        np.minimum(least, (found[None, k : k + SLICE] * _FACTORS[:, None]).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) + 1e-9 < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared + 1e-9 >= least * (len(a) + len(b) - shared)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batches):
        import pyarrow as pa
        import xxhash

        claim("near")
        for batch in batches:
            sigs, fps, ns, keys = [], [], [], []
            for t in batch.column(1):
                parts = list(_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"), shingle, 42))
                s = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                fps.append(majority(parts))
                ns.append(len(s))
                keys.append(bands(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "sig", "fp", "n", "bands"])

    return docs.mapInArrow(work, "row bigint, sig binary, fp bigint, n bigint, bands array<bigint>")


def _simhash_bands(distinct: DataFrame, bits: int) -> DataFrame:
    """(id, n, band): sets whose fingerprints are equal, or linked in a shard of the trees, in a band with their smallest."""
    alike = distinct.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"))
    alike = materialise(alike, "prints")
    links = shard_links(alike, alike.count(), bits).select(F.col("a").alias("id"), F.col("b").alias("hub"))
    equal = distinct.where("n > 0").join(alike, "fp").where("id <> rep").select("id", F.col("rep").alias("hub"))
    pairs = materialise(links.unionByName(equal).distinct(), "prints")
    both = pairs.unionByName(pairs.select(F.col("hub").alias("id"), "hub")).distinct()
    return both.join(distinct.select("id", "n"), "id").select("id", "n", F.xxhash64(F.lit("print"), "hub").alias("band"))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [shingles(t.as_py(), shingle).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["id", "s"])

    return docs.mapInArrow(work, "id bigint, s binary")


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose sets are similar.

    A hub's set is copied once for MEMBERS pairs or so; rows with one set each are sorted by copy, the hub first."""

    def work(batches):
        import pyarrow as pa

        now, hub = None, None
        for batch in batches:
            found = []
            for a, copy, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    now, hub = (a, copy), own.copy()
                elif now == (a, copy) and similar(hub, own, least):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("copies"))
    dealt = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"), "b")
    members = dealt.join(sets.select(F.col("id").alias("b"), "s"), "b").select("a", "copy", "b", "s")
    hubs = copies.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")).join(sets.select(F.col("id").alias("a"), "s"), "a")
    rows = members.unionByName(hubs.select("a", "copy", F.lit(None).cast("bigint").alias("b"), "s"))
    return rows.repartition("a", "copy").sortWithinPartitions("a", "copy", F.asc_nulls_first("b")).mapInArrow(work, "a bigint, b bigint")


def _proposals(distinct: DataFrame, more: DataFrame, least: float) -> DataFrame:
    """Per id with a partner in any band, of its own or in ``more`` (id, n, band): the smaller hubs that fit its size, and
    the bands where it is no hub itself.

    The join keeps a row for each set and band, whether or not the band is shared."""
    banded = distinct.select("id", "n", F.explode("bands").alias("band")).unionByName(more)
    hubs = banded.groupBy("band").agg(F.count(F.lit(1)).alias("width"), F.min(F.struct("id", "n")).alias("hub")).where("width > 1")
    met = banded.join(hubs.select("band", "hub"), "band", "left")
    fits = F.least("hub.n", "n") + 1e-9 >= F.greatest("hub.n", "n") * least
    smaller = F.col("hub.id") < F.col("id")
    met = met.select("id", "n", F.when(smaller & fits, F.col("hub.id")).alias("near"), F.when(smaller, F.col("band")).alias("open"), F.col("hub").isNotNull().alias("shared"))
    each = met.groupBy("id").agg(F.max("n").alias("size"), F.max("shared").alias("any"), F.array_sort(F.collect_set("near")).alias("hubs"), F.collect_list("open").alias("bands"))
    return each.where("any").select("id", F.col("size").alias("n"), "hubs", "bands")


def shared_hashes(sets: list[np.ndarray], first: int) -> np.ndarray:
    """How many hashes the sets before position ``first`` share with those from there on, or, if none come after, with
    each other (the diagonal doesn't count)."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = seen > 1
    rows, at = rows[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((first, len(sets) - first or first))
    for k in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [k, k + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[rows[lo:hi], at[lo:hi] - k] = 1
        out += has[:first] @ has[first if first < len(sets) else 0 :].T
    return out


def block_links(ids: np.ndarray, sets: list[np.ndarray], first: int, least: float) -> list[tuple[int, int]]:
    """Links (a, b) of two blocks, a the smallest id that b hangs together with; the second begins at ``first``, and a
    block with no second is compared with itself."""
    if not 0 < first or len(sets) < 2:
        return []
    shared, n = shared_hashes(sets, first), np.array([len(x) for x in sets])
    other = first if first < len(sets) else 0
    close = shared + 1e-9 >= least * (n[:first, None] + n[None, other:] - shared)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    groups = Groups(len(ids))
    for i, j in zip(*np.nonzero(close)):
        groups.union(int(rank[i]), int(rank[j + other]))
    roots, ordered = groups.roots(), np.sort(ids)
    return [(int(ordered[r]), int(ordered[k])) for k, r in enumerate(roots) if r != k]


def _in_blocks(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) among the sets (id, n, bands, component) that share a band and have different components so far."""

    def work(table):
        import pyarrow as pa

        table = table.sort_by("second")
        ids, found = table.column("id").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        first = int(len(ids) - np.count_nonzero(table.column("second").to_numpy(zero_copy_only=False)))
        # A key of two blocks of which one is empty has nothing to compare.
        alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        links = block_links(ids, found, first, least) if alone or 0 < first < len(ids) else []
        return pa.table({"a": [x for x, _ in links], "b": [y for _, y in links]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    banded = members.select("id", "n", "component", F.explode("bands").alias("band"))
    each = banded.groupBy("band", "component").agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("hashes"))
    wide = each.groupBy("band").agg(F.max(F.struct("width", "hashes", "component")).alias("main"), F.sum("width").alias("width"), F.sum("hashes").alias("hashes")).where("width > main.width")
    blocks = lambda width, hashes: F.least(F.ceil(F.greatest(width / BLOCK, hashes / BLOCK_HASHES)), width).cast("bigint")
    # Blocks 0 to others - 1 hold all but the main component's members, and those from others to all - 1 the main ones.
    others, main = blocks(F.col("width") - F.col("main.width"), F.col("hashes") - F.col("main.hashes")), blocks(F.col("main.width"), F.col("main.hashes"))
    wide = wide.select("band", F.col("main.component").alias("main"), others.alias("others"), main.alias("mains"), (F.col("width") - F.col("main.width") == 1).alias("single"))
    dealt = banded.join(wide, "band").withColumn("is_main", F.col("component") == F.col("main"))
    own = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("id", "band"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("id", "band"), F.col("others")))
    first, last = F.when(F.col("single") & ~F.col("is_main"), F.col("others")).otherwise(F.lit(0).cast("bigint")), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    places = dealt.select("id", "band", own.alias("own"), F.explode(F.sequence(first, last)).alias("with"))
    keyed = places.select("id", "band", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") > F.col("with")).alias("second"))
    return keyed.join(sets, "id").select("band", "lo", "hi", "second", "id", "s").groupBy("band", "lo", "hi").applyInArrow(work, "a bigint, b bigint")


def _groups(distinct: DataFrame, texts: DataFrame, shingle: int, least: float, bits: int) -> DataFrame:
    """(id, component) for each id that shares a band with another one."""
    met = materialise(_proposals(distinct.select("id", "n", "bands"), _simhash_bands(distinct, bits), least), "proposals")
    wanted = materialise(met.select(F.col("id").alias("row")), "wanted")  # small enough, it is broadcast by its size, and no text is shuffled
    sets = materialise(_sets(texts.join(wanted, "row", "left_semi"), shingle), "sets")
    to_smallest = met.where("size(hubs) > 0").select(F.col("hubs")[0].alias("a"), F.col("id").alias("b"))
    links = materialise(_verify(to_smallest, sets, least), "links")
    parent = links.select(F.col("b").alias("id"), F.col("a").alias("parent"))  # one each
    rest = met.where("size(hubs) > 1").join(parent, "id", "left").select(F.explode(F.slice("hubs", 2, F.size("hubs"))).alias("a"), F.col("id").alias("b"), F.coalesce("parent", "id").alias("root"))
    rest = rest.join(parent.select(F.col("id").alias("a"), F.col("parent").alias("of_hub")), "a", "left").where(F.coalesce("of_hub", "a") != F.col("root")).select("a", "b")
    links = links.unionByName(materialise(_verify(rest, sets, least), "links"))
    named = lambda groups: groups.select(F.col("node").alias("id"), "component")
    so_far = materialise(met.select("id", "n", "bands").join(named(connected_components(links)), "id", "left").withColumn("component", F.coalesce("component", "id")), "so_far")
    blocks = materialise(_in_blocks(so_far.where("size(bands) > 0"), sets, least), "links")
    of = lambda end: so_far.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
    bridges = blocks.join(of("a"), "a").join(of("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    met_again = named(connected_components(bridges)).select(F.col("id").alias("component"), F.col("component").alias("last"))
    return so_far.select("id", "component").join(met_again, "component", "left").select("id", F.coalesce("last", "component").alias("component"))


def near_copies(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, least: float = 0.8, bits: int = 3) -> DataFrame:
    """Per row its ``id_col``, which is unique and not null (see ``common.numbered``), and component: the smallest one of
    its group by links of similarity ``least`` or more."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("row"), F.col(text_col).alias("text"))
    seen = materialise(_signatures(texts, shingle), "signatures")
    distinct = materialise(seen.groupBy("sig").agg(F.min("row").alias("id"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct")
    groups = _groups(distinct, texts, shingle, least, bits)
    named = distinct.select("sig", "id").join(groups, "id", "left").select("sig", F.coalesce("component", "id").alias("component"))
    return seen.select("row", "sig").join(named, "sig", "left").select(F.col("row").alias(id_col), "component")
