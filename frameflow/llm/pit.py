"""Point-in-time joins by a priority-ordered pruning tree.

Each ask (key, t) looks for the version of its key that is usable at t (event <= t, arrival <= t < expiry) and comes first
in the winning order: the latest event, then the earliest arrival, then the largest version. The leaves of the tree are
the versions in (key, winning order), which Spark sorts by ranges, so a key of any size is spread over many. ``FAN``
leaves make a node, as many nodes make one of the next level, up to a root for each key. A node stores the least start
(the later of event and arrival) and the largest expiry of what lies below.

Asks go down level by level, by joins on nodes, and each keeps the nodes that are still open to it, best first. A node
that can hold no usable leaf by its bounds is pruned. A usable leaf bounds the search: whatever comes after it is dropped,
and the ask ends when nothing before it is open. At first an ask opens its best node only; those that go on past the
depth of the tree open twice as many in each further round. So rounds grow with the logarithm of what an ask has to
visit, and its visits are at most twice those of a descent that opens one node at a time.

Where many asks meet at a node, its row is copied and they are dealt over the copies: more than a ``HOT``-th of all asks
never share one. The nodes concerned, at most ``HOT``, are the only broadcast; the driver gets counts. Tables between
rounds lie in the shared folder.

Defined results: an ask whose key or t is null, or whose key has no version, gets nulls; versions with a null key or
time, or that expire before they start, are never usable; null versions (ids) come last among ties; equal versions give
equal results; each ask, repeated or not, gets one row; empty tables are fine; columns besides those named are payload
and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import materialise, numbered, unused

BITS = 6  # a node has 2^BITS children
HOT = 512
INDEX = (1 << 33) - 1  # of a row within its partition, in monotonically_increasing_id


def meet(asks: DataFrame, rows: DataFrame, keys: list[str], row: str, n: int) -> DataFrame:
    """``asks``, of which there are ``n`` and ``row`` is a number, left-joined with ``rows``, which are unique by ``keys``.

    A key that more than a HOT-th of all asks has gets copies in ``rows``, over which these asks are dealt."""
    crowd = asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > n // HOT).select(*keys, F.ceil(F.col("__n") / max(1, n // HOT)).cast("int").alias("__copies"))
    crowd = F.broadcast(crowd)  # fewer than HOT + 1 rows
    at_random = F.pmod(F.xxhash64(row), F.lit(1 << 20)).cast("int")  # null keys meet nothing, and lie anywhere
    dealt = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), at_random).otherwise(F.pmod(F.xxhash64(row), F.coalesce("__copies", F.lit(1))).cast("int"))
    left = asks.join(crowd, keys, "left").withColumn("__copy", dealt).drop("__copies")
    right = rows.join(crowd, keys, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return left.join(right.hint("merge"), [*keys, "__copy"], "left").drop("__copy")


def _leaves(versions: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """(key, code, leaf), codes rising in the winning order of each key, and how many bits they have."""
    lo = F.greatest("event", "arrival")
    usable = versions.where("key is not null and event is not null and arrival is not null").withColumn("lo", lo).where(F.col("lo") < F.col("expiry"))
    order = [F.col("key"), F.desc("event"), F.col("arrival"), F.desc_nulls_last("version")]
    leaf = F.struct("lo", F.col("expiry").alias("hi"), "event", "version", "payload")
    placed = materialise(usable.repartitionByRange(*order).sortWithinPartitions(*order).select("key", leaf.alias("leaf"), F.monotonically_increasing_id().alias("at")), "leaves")
    most = placed.agg(F.max(F.col("at").bitwiseAND(F.lit(INDEX))).alias("index"), F.max(F.shiftright("at", 33)).alias("part")).first()
    within = int(most["index"] or 0).bit_length()
    code = F.shiftleft(F.shiftright("at", 33), within).bitwiseOR(F.col("at").bitwiseAND(F.lit(INDEX)))
    return placed.select("key", code.alias("code"), "leaf"), within + int(most["part"] or 0).bit_length()


def build_tree(versions: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """The nodes (level, key, id, leaves, kids) of all trees and their height. Level 1 has leaves, the others have kids
    (id, lo, hi), in the winning order; a root has id 0. ``versions``: key, event, arrival, expiry, version, payload."""
    leaves, width = _leaves(versions, bits)
    height = max(1, -(-width // bits))
    up = F.shiftright("code", bits)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("code", "leaf"))), lambda x: x["leaf"])
    blocks = materialise(leaves.groupBy("key", up.alias("id")).agg(listed.alias("leaves")), "blocks")
    bound = lambda f, c, k: f(F.transform(c, lambda x: x[k]))
    below = blocks.select("key", F.col("id").alias("code"), bound(F.array_min, "leaves", "lo").alias("lo"), bound(F.array_max, "leaves", "hi").alias("hi"))
    no_kids, no_leaves = F.lit(None).cast("array<struct<id:bigint,lo:bigint,hi:bigint>>"), F.lit(None).cast(blocks.schema["leaves"].dataType)
    nodes = blocks.select(F.lit(1).alias("level"), "key", "id", "leaves", no_kids.alias("kids"))
    for level in range(2, height + 1):
        kids = F.array_sort(F.collect_list(F.struct(F.col("code").alias("id"), F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))))
        tier = materialise(below.groupBy("key", up.alias("id")).agg(kids.alias("kids")), "nodes")
        below = tier.select("key", F.col("id").alias("code"), bound(F.array_min, "kids", "lo").alias("lo"), bound(F.array_max, "kids", "hi").alias("hi"))
        nodes = nodes.unionByName(tier.select(F.lit(level).alias("level"), "key", "id", no_leaves.alias("leaves"), "kids"))
    return nodes, height


def _usable(x: Column) -> Column:
    return (x["lo"] <= F.col("t")) & (F.col("t") < x["hi"])


def _step(state: DataFrame, nodes: DataFrame, width: int, n: int) -> DataFrame:
    """Each ask opens its ``width`` best nodes."""
    one = state.select("row", "key", "t", "best", F.posexplode(F.slice("open", 1, width)).alias("pos", "node"), F.slice("open", width + 1, F.size("open")).alias("rest"))
    met = meet(one.select("row", "key", "t", "best", "pos", "rest", "node.level", "node.id"), nodes, ["level", "key", "id"], "row", n)
    found = F.get(F.filter("leaves", _usable), F.lit(0))
    more = F.coalesce(F.transform(F.filter("kids", _usable), lambda x: F.struct((F.col("level") - 1).alias("level"), x["id"].alias("id"))), F.array())
    seen = met.select("row", "key", "t", "best", "rest", "pos", found.alias("found"), more.alias("more"))
    if width == 1:
        return seen.select("row", "key", "t", F.coalesce("found", "best").alias("best"), F.when(F.col("found").isNull(), F.concat("more", "rest")).otherwise(F.array()).alias("open"))
    got = seen.groupBy("row").agg(*[F.first(c).alias(c) for c in ("key", "t", "best", "rest")], F.array_sort(F.collect_list(F.struct("pos", "more", F.col("found").isNotNull().alias("hit")))).alias("got"), F.min(F.when(F.col("found").isNotNull(), F.struct("pos", "found"))).alias("first"))
    before = F.flatten(F.transform(F.filter("got", lambda x: F.col("first").isNull() | (x["pos"] < F.col("first.pos"))), lambda x: x["more"]))
    return got.select("row", "key", "t", F.coalesce("first.found", "best").alias("best"), F.when(F.col("first").isNull(), F.concat(before, "rest")).otherwise(before).alias("open"))


def winners(versions: DataFrame, asks: DataFrame, bits: int = BITS) -> DataFrame:
    """(row, event, version, payload) of the winner of each ask (row, key, t) that has one; row is unique."""
    nodes, height = build_tree(versions, bits)
    root = F.array(F.struct(F.lit(height).alias("level"), F.lit(0).cast("bigint").alias("id")))
    best = nodes.schema["leaves"].dataType.elementType
    state = asks.where("key is not null and t is not null").select("row", "key", "t", F.lit(None).cast(best).alias("best"), root.alias("open"))
    n, done, k = state.count(), [], 0
    while n:
        at = nodes.where(F.col("level") == height - k) if k < height else nodes
        now = materialise(_step(state, at, 1 << max(0, k - height), n), "asks")
        done.append(now.where("size(open) = 0 and best is not null").select("row", "best"))
        state, k = now.where("size(open) > 0"), k + 1
        n = state.count()
    empty = state.select("row", "best").where("false")
    out = done[0] if done else empty
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "best.event", "best.version", "best.payload")


def point_in_time(versions: DataFrame, asks: DataFrame, key: str, t: str, event: str, arrival: str, expiry: str, version: str, bits: int = BITS) -> DataFrame:
    """All columns of ``asks``, and ``winner``: a struct (event, version, payload), or null. payload has all columns of
    ``versions``. ``key`` names a column of both tables, ``t`` one of asks, the others are of versions; times are whole
    numbers."""
    taken, c = asks.columns, lambda name: F.col(f"`{name}`")
    row, winner = unused("__row", taken), unused("winner", taken)
    rows = numbered(asks, row, "asks")
    told = versions.select(c(key).alias("key"), c(event).cast("bigint").alias("event"), c(arrival).cast("bigint").alias("arrival"), c(expiry).cast("bigint").alias("expiry"), c(version).alias("version"), F.struct(*[c(x) for x in versions.columns]).alias("payload"))
    won = winners(told, rows.select(F.col(row).alias("row"), c(key).alias("key"), c(t).cast("bigint").alias("t")), bits)
    won = won.select(F.col("row").alias(row), F.struct("event", "version", "payload").alias(winner))
    return rows.join(won.hint("merge"), row, "left").drop(row)


def feature_asks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The versions (source, event, arrival, expiry, version and payload) that ``docs`` stand for, and an ask (doc_id, source,
    t) for each row of ``labels``, about the source of its document: the first in order, where an id has several."""

    def parts(doc_id: str) -> list[Column]:
        digest = F.sha2(F.col(doc_id).cast("string"), 256)
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]

    a, b, c, d = parts("doc_id")
    versions = docs.select("source", "doc_id", "n_chars", "lang", (a % 20000).alias("event"), b.alias("b"), c.alias("c"))
    versions = versions.select("source", "doc_id", "n_chars", "lang", "event", (F.col("event") - 60 + F.col("b") % 300).alias("arrival"), (F.col("event") + F.col("c") % 900).alias("expiry"))
    rows = numbered(labels.select("doc_id"), "row", "labels")
    sources = docs.where("source is not null and doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    return versions, meet(rows, sources, ["doc_id"], "row", rows.count()).select("doc_id", "source", (d % 20000).alias("t"))


def features_at(docs: DataFrame, labels: DataFrame, fresh: int = 60) -> DataFrame:
    """Per label: doc_id, t, version_id, age, status, n_chars, lang; the last two only where the winner is at most ``fresh`` seconds old."""
    versions, asks = feature_asks(docs, labels)
    done = point_in_time(versions, asks, "source", "t", "event", "arrival", "expiry", "doc_id")
    done = done.select("doc_id", "t", F.col("winner.version").alias("version_id"), (F.col("t") - F.col("winner.event")).alias("age"), F.col("winner.payload").alias("row"))
    status = F.when(F.col("age").isNull(), "none").when(F.col("age") > fresh, "stale").otherwise("fresh")
    is_fresh = F.col("age") <= fresh
    return done.select("doc_id", "t", "version_id", "age", status.alias("status"), F.when(is_fresh, F.col("row.n_chars")).alias("n_chars"), F.when(is_fresh, F.col("row.lang")).alias("lang"))
