"""Prefix tries of conversations by an LCP-aware mergesort.

A conversation is a sequence of turns, a turn a 128-bit digest of its role and text. Sequences are range-partitioned by
(turns, conversation), so equal ones are spread too. A task sorts what it gets into runs. Each row of a run carries its
LCP, the number of leading turns that it shares with the row before; a loser tree merges the runs by these and compares
only turns that two rows don't share with the last one put out. The merged stream goes over a stack of the open path:
a row closes all nodes below its LCP, which are finished, and opens those of its further turns.

A node may lie in several ranges only if it is on the path of a range's first or last row. These nodes leave as partial
ones, are summed up by digest of their path, and hand their sums on to the nodes above them. All others are final.

Conversations of any length: a sequence is cut into chunks of ``CHUNK`` turns, and the trie into levels of as many. A
chunk's row carries a digest of all turns before it (two 64-bit XORs of hashes of place and turn), by which a level's
tries are told apart. Chunks that no other conversation shares are chains, and are made without a sort. Levels are
merged from the deepest shared one upwards; each hands its roots' sums to the level above.

Defined results: null roles and texts are empty; rows with a null conv_id belong to no conversation; rows that share a
turn number stand in the order of their digests, and repeated ones all count; null turns come first; very long texts are
hashed and counted as a whole; a conversation without turns is a member of the root; an empty table has no nodes; further
columns are ignored. Members' ids are hashed in order, as SHA-256 demands, so those of one node's whole members are
streamed through one task where they span ranges, at some ten bytes a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.llm.common import BLANKS, materialise

CHUNK = 64
RANGE_ROWS = 50_000  # rows of a range, which a task holds
RUN = 4096
DIGEST = 16  # bytes
PIECE = 1 << 16  # bytes of a piece of a list of members
NONE = hashlib.sha256(b"").hexdigest()
GROUP = 4096  # chunks whose prefix digests are summed up in one task


def run_of(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Rows (key, conv, ...) in order, and each one's LCP with the one before, in digests."""
    rows.sort(key=lambda r: r[:2])
    return rows, [0] + [lcp(a[0], b[0], 0) for a, b in zip(rows, rows[1:])]


def lcp(a: bytes, b: bytes, known: int) -> int:
    """Leading digests that two keys share; ``known`` of them are known to be equal."""
    most, k = min(len(a), len(b)) // DIGEST, known
    if a[k * DIGEST : most * DIGEST] == b[k * DIGEST : most * DIGEST]:
        return most
    while k < most and a[k * DIGEST : (k + 1) * DIGEST] == b[k * DIGEST : (k + 1) * DIGEST]:
        k += 1
    return k


class LoserTree:
    """Merges runs of (rows, LCPs) into (row, LCP with the row before). Digests that are known to be shared with the last
    row put out aren't compared again; ``compared`` counts those that are."""

    def __init__(self, runs: list[tuple[list[tuple], list[int]]]):
        self.runs, self.at, self.compared = runs, [0] * len(runs), 0
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.shared = [0] * self.size  # of each run's head, with the last row put out or the winner that beat it
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._duel(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _head(self, run: int):
        return self.runs[run][0][self.at[run]] if run < len(self.runs) and self.at[run] < len(self.runs[run][0]) else None

    def _duel(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:  # what shares more with the last row comes next
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        known = self.shared[a]
        both = lcp(x[0], y[0], known)
        self.compared += both - known + 1
        next_ = slice(both * DIGEST, (both + 1) * DIGEST)  # empty where a key ends, which comes first
        winner, loser = (a, b) if (x[0][next_], x[1]) <= (y[0][next_], y[1]) else (b, a)
        self.shared[loser] = both
        return winner, loser

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        while (row := self._head(run := self.winner)) is not None:
            yield row, self.shared[run]
            self.at[run] += 1
            if self.at[run] < len(self.runs[run][0]):
                self.shared[run] = self.runs[run][1][self.at[run]]
            node = (run + self.size) // 2
            while node:
                run, self.losers[node] = self._duel(run, self.losers[node])
                node //= 2
            self.winner = run


NODE, PARTIAL, MEMBERS, ROOT = range(4)
FIELDS = {
    "kind": "int", "part": "int", "id": "binary", "path": "array<binary>", "parent": "binary", "depth": "bigint", "conv": "bigint", "parent_conv": "bigint", "n_convs": "bigint",
    "n_children": "bigint", "n_leaves": "bigint", "saved": "bigint", "ends": "string", "words": "bigint", "portal": "boolean", "piece": "binary",
}


class _Frame:
    """An open node: members that end here and below, what its finished children sum up to, and those children."""

    __slots__ = ("children", "conv", "edge", "first", "hash", "kids", "leaves", "n", "piece", "portal", "saved", "words")

    def __init__(self, words: int, edge: bool):
        self.words, self.edge, self.conv, self.n, self.children, self.leaves, self.saved = words, edge, None, 0, 0, 0, 0
        self.hash, self.piece, self.first, self.kids, self.portal = None, [], None, [], None

    def member(self, conv: int) -> None:
        self.n += 1
        self.conv = conv if self.conv is None else min(self.conv, conv)


class OpenPath:
    """The stack of a range's merged stream. ``add`` and ``close`` give finished nodes, partial ones, and members of those.

    A key is a group's digest and those of the turns; so frame 0 is a group's root, whose own text counts elsewhere."""

    def __init__(self, part: int, level: int, chunk: int):
        self.part, self.level, self.chunk, self.stack, self.key = part, level, chunk, [], None

    def _id(self, size: int) -> bytes:
        return hashlib.blake2b(self.key[: size * DIGEST], digest_size=16, salt=self.level.to_bytes(8, "little")).digest()

    def _row(self, kind: int, **values) -> tuple:
        return tuple(values.get(f, self.part if f == "part" else kind if f == "kind" else None) for f in FIELDS)

    def add(self, row: tuple, shared: int) -> Iterator[tuple]:
        key, conv, words, portal = row
        first = self.key is None
        yield from self._pop(shared)
        self.key = key
        for k in range(len(self.stack), len(key) // DIGEST):
            self.stack.append(_Frame(words[k - 1] if k else 0, first))
        top = self.stack[-1]
        top.member(conv)
        if portal is not None and len(self.stack) == self.chunk + 1:
            top.portal = portal  # its members are told by the level below
            return
        if top.first is None:
            top.first = conv
            top.hash = hashlib.sha256()
        text = (b"," if top.n > 1 else b"") + str(conv).encode()
        if top.edge:
            top.piece.append(str(conv).encode())
            if len(top.piece) > PIECE // 8:
                yield self._members(len(self.stack))
        else:
            top.hash.update(text)
            top.piece.append(str(conv).encode())

    def _members(self, size: int) -> tuple:
        frame = self.stack[size - 1]
        out = self._row(MEMBERS, id=self._id(size), conv=frame.first, piece=b",".join(frame.piece))
        frame.piece, frame.first = [], None
        return out

    def _pop(self, shared: int) -> Iterator[tuple]:
        while len(self.stack) > shared:
            yield from self._finish()

    def _finish(self) -> Iterator[tuple]:
        size, frame = len(self.stack), self.stack[-1]
        above = self.stack[-2] if size > 1 else None
        if frame.edge:  # popped, but its range's first row lies in it: it may have begun before
            yield from self._partial(size)
            self.stack.pop()
            return
        self.stack.pop()
        portal = frame.portal
        children, leaves, saved, ends = portal if portal is not None else (frame.children, frame.leaves or 1, frame.saved, frame.hash.hexdigest() if frame.hash else NONE)
        own = (frame.n - 1) * frame.words
        for kid in frame.kids:
            yield self._row(NODE, **kid, parent_conv=frame.conv)
        if above is None:  # a whole group
            yield self._row(ROOT, id=self.key[:DIGEST], conv=frame.conv, n_convs=frame.n, n_children=children, n_leaves=leaves, saved=saved, ends=ends)
            return
        kid = {"depth": self.level * self.chunk + size - 1, "conv": frame.conv, "n_convs": frame.n, "n_children": children, "n_leaves": leaves, "saved": saved + own, "ends": ends}
        above.n += frame.n
        above.conv = frame.conv if above.conv is None else min(above.conv, frame.conv)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved + own
        if above.edge:
            yield self._row(NODE, **kid, parent=self._id(size - 1))
        else:
            above.kids.append(kid)

    def _partial(self, size: int) -> Iterator[tuple]:
        """Frame ``size - 1`` as a partial node: sums of its finished children alone, members of all."""
        frame, path = self.stack[size - 1], [self._id(k) for k in range(1, size)]
        for kid in frame.kids:
            yield self._row(NODE, **kid, parent=self._id(size))
        if frame.piece:
            yield self._members(size)
        children, leaves, saved, ends = frame.portal if frame.portal is not None else (frame.children, frame.leaves, frame.saved, None)
        yield self._row(PARTIAL, id=self._id(size), path=path, parent=path[-1] if path else self.key[:DIGEST], depth=self.level * self.chunk + size - 1, conv=frame.conv, n_convs=frame.n, n_children=children, n_leaves=leaves, saved=saved, ends=ends, words=frame.words, portal=frame.portal is not None)
        if size > 1:
            above = self.stack[size - 2]
            above.n += frame.n
            above.conv = frame.conv if above.conv is None else min(above.conv, frame.conv)

    def close(self) -> Iterator[tuple]:
        while self.stack:
            yield from self._partial(len(self.stack))
            self.stack.pop()


def _merged(rows: DataFrame, level: int, chunk: int, ranges: int) -> DataFrame:
    """FIELDS from rows (key, conv, words, portal)."""
    names = list(FIELDS)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx, runs = TaskContext.get(), []
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
        for batch in batches:
            for k in range(0, batch.num_rows, RUN):
                cut = batch.slice(k, RUN)
                portals = [tuple(p.values()) if p is not None else None for p in cut.column(3).to_pylist()]
                runs.append(run_of(list(zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), cut.column(2).to_pylist(), portals, strict=True))))
        path, out = OpenPath(ctx.partitionId() if ctx else 0, level, chunk), []

        def table():
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[FIELDS[f]]) for f, c in zip(names, columns, strict=True)], names=names)

        for row, shared in LoserTree(runs):
            out.extend(path.add(row, shared))
            if len(out) >= RUN:
                yield table()
                out = []
        out.extend(path.close())
        yield table()

    return rows.repartitionByRange(ranges, "key", "conv").mapInArrow(work, ", ".join(f"{f} {t}" for f, t in FIELDS.items()))


def _hashed(pieces: DataFrame) -> DataFrame:
    """(id, told): SHA-256 of each id's pieces in the order of their first members, streamed."""

    def work(batches):
        import pyarrow as pa

        now, digest = None, None
        for batch in batches:
            done = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = name, hashlib.sha256(piece)
                else:
                    digest.update(b"," + piece)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["id", "told"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["id", "told"])

    return pieces.select("id", "conv", "piece").repartition("id").sortWithinPartitions("id", "conv").mapInArrow(work, "id binary, told string")


OUT = ["depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]


def _level(rows: DataFrame, level: int, chunk: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a level (OUT; its groups' roots aren't among them but at level 0), and its roots by group."""
    out = materialise(_merged(rows, level, chunk, ranges), "trie")
    partial = out.where(F.col("kind") == PARTIAL)
    told = _hashed(out.where(F.col("kind") == MEMBERS))
    sums = [F.first(c, ignorenulls=True).alias(c) for c in ("depth", "path", "parent", "words", "portal")] + [F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs")]
    # a portal's sums are the same in each range; others' are shares
    shares = [F.when(F.first("portal"), F.max(c)).otherwise(F.sum(c)).alias(c) for c in ("n_children", "n_leaves", "saved")]
    edges = materialise(partial.groupBy("id").agg(*sums, *shares, F.max("ends").alias("ends")).join(told, "id", "left").withColumn("ends", F.coalesce("ends", "told", F.lit(NONE))).drop("told"), "edges")
    below = edges.where("size(path) > 0").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("edge_children"))
    whole = edges.join(below, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0)))
    whole = whole.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    whole = materialise(whole.select("id", "path", "parent", "depth", "conv", "n_convs", "n_children", "n_leaves", "saved", "own", "ends"), "whole")
    lines = whole.select(F.explode(F.concat("path", F.array("id"))).alias("id"), "n_leaves", (F.col("saved") + F.col("own")).alias("saved")).groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    summed = whole.drop("n_leaves", "saved").join(lines, "id")
    names = whole.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    at_edges = summed.where("size(path) > 0").join(names, "parent").select(OUT)
    # a closed node's partial parent is met within the node's range, so that no parent is a hot key
    parents = partial.select("part", F.col("id").alias("parent")).join(names, "parent")
    nodes, closed = out.where(F.col("kind") == NODE), [c for c in OUT if c != "parent_conv"]
    hung = nodes.where("parent is not null").select("part", "parent", *closed).join(parents, ["part", "parent"]).select(OUT)
    roots = summed.where("size(path) = 0").select(F.col("parent").alias("group"), "conv", "n_convs", "n_children", "n_leaves", "saved", "ends")
    roots = roots.unionByName(out.where(F.col("kind") == ROOT).select(F.col("id").alias("group"), "conv", "n_convs", "n_children", "n_leaves", "saved", "ends"))
    return nodes.where("parent is null").select(OUT).unionByName(hung).unionByName(at_edges), roots


def _chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """(conv, k, key, words, x, y): each conversation's turns in chunks, with two digests of a chunk's turns in their places."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "d", "words")))
    mixed = lambda seed: F.bit_xor(F.xxhash64("pos", "d", F.lit(seed)))
    done = turns.groupBy("conv", F.floor((F.col("pos") - 1) / chunk).cast("int").alias("k")).agg(listed.alias("l"), mixed(1).alias("x"), mixed(2).alias("y"))
    # concat over an array of binaries, one after the other
    key = F.unhex(F.array_join(F.transform("l", lambda e: F.hex(e["d"])), ""))
    return done.select("conv", "k", key.alias("key"), F.transform("l", lambda e: e["words"]).alias("words"), "x", "y")


def _prefixes(chunks: DataFrame) -> DataFrame:
    """(conv, k, px, py): digests of all chunks before k, summed up by GROUP chunks and then by group."""
    before = lambda w: [F.coalesce(F.bit_xor(c).over(w), F.lit(0)).alias(f"p{c}") for c in ("x", "y")]
    rows = chunks.select("conv", "k", "x", "y", F.floor(F.col("k") / GROUP).alias("g"))
    some = rows.groupBy("conv", "g").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    some = some.select("conv", "g", *before(Window.partitionBy("conv").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))).withColumnsRenamed({"px": "gx", "py": "gy"})
    own = rows.select("conv", "k", "g", *before(Window.partitionBy("conv", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(some, ["conv", "g"]).select("conv", "k", F.col("px").bitwiseXOR(F.col("gx")).alias("px"), F.col("py").bitwiseXOR(F.col("gy")).alias("py"))


def _bytes(x: str, y: str):
    """Two digests as 16 bytes."""
    return F.unhex(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))


def prefix_trie(turns: DataFrame, lengths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes (OUT, depth from 0) of all conversations. ``turns``: conv, pos (from 1), d (16 bytes), words; ``lengths``:
    conv, n (0 too), unique by conv."""
    spark = turns.sparkSession
    chunks = materialise(_chunks(turns, chunk), "chunks")
    plain = chunks.where("k = 0").join(lengths.select("conv", "n"), "conv", "right").select("conv", F.lit(0).alias("k"), F.coalesce("key", F.lit(b"")).alias("key"), F.coalesce("words", F.array()).alias("words"), "n", F.lit(0).cast("bigint").alias("px"), F.lit(0).cast("bigint").alias("py"), F.coalesce("x", F.lit(0)).alias("nx"), F.coalesce("y", F.lit(0)).alias("ny"))
    long = lengths.where(F.col("n") >= chunk)
    levels, deeper = 0, None
    if not long.isEmpty():
        of_long = chunks.join(long, "conv")
        placed = of_long.join(_prefixes(of_long), ["conv", "k"])
        nx, ny = F.col("x").bitwiseXOR(F.col("px")).alias("nx"), F.col("y").bitwiseXOR(F.col("py")).alias("ny")
        ends = placed.where((F.col("k") + 1) * chunk == F.col("n")).select("conv", (F.col("k") + 1).alias("k"), F.lit(b"").alias("key"), F.lit(None).cast("array<bigint>").alias("words"), "n", nx.alias("px"), ny.alias("py"))
        ends = ends.select("*", F.col("px").alias("nx"), F.col("py").alias("ny")).withColumn("words", F.coalesce("words", F.array()))
        deeper = placed.where("k > 0").select("conv", "k", "key", "words", "n", "px", "py", nx, ny).unionByName(ends)
        shared = deeper.groupBy("k", "px", "py").agg(F.count(F.lit(1)).alias("sharers"))
        deeper = materialise(deeper.join(shared, ["k", "px", "py"]), "deeper")
        levels = deeper.where("sharers > 1").agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    single = F.struct((F.col("n") > F.col("until")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved"), F.sha2(F.when(F.col("n") == F.col("until"), F.col("conv").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("ends"))
    nodes, roots = None, None
    for level in range(levels, -1, -1):
        rows = (deeper.where((F.col("k") == level) & (F.col("sharers") > 1)).drop("sharers") if level else plain).withColumn("until", F.lit((level + 1) * chunk).cast("bigint"))
        rows = rows.withColumn("next", _bytes("nx", "ny"))
        told = single
        if roots is not None:
            below = roots.select(F.col("group").alias("next"), F.struct("n_children", "n_leaves", "saved", "ends").alias("told"))
            rows, told = rows.join(below, "next", "left"), F.coalesce("told", single)
        rows = rows.select(F.concat(_bytes("px", "py"), F.col("key")).alias("key"), "conv", "words", F.when(F.col("n") >= F.col("until"), told).alias("portal"))
        rows = materialise(rows, "sequences")
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
        made, roots = _level(rows, level, chunk, ranges)
        nodes = made if nodes is None else nodes.unionByName(made)
    top = roots.select(F.lit(0).cast("bigint").alias("depth"), "conv", F.lit(None).cast("bigint").alias("parent_conv"), "n_convs", "n_children", "n_leaves", "saved", "ends")
    nodes = nodes.unionByName(top)
    if deeper is not None:
        alone = deeper.where("sharers = 1").select("conv", "n", "k", F.posexplode("words").alias("i", "w")).withColumn("depth", F.col("k").cast("bigint") * chunk + F.col("i") + 1)
        last = F.col("depth") == F.col("n")
        one = lambda v, name: F.lit(v).cast("bigint").alias(name)
        nodes = nodes.unionByName(alone.select("depth", "conv", F.col("conv").alias("parent_conv"), one(1, "n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one(1, "n_leaves"), one(0, "saved"), F.sha2(F.when(last, F.col("conv").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("ends")))
    return nodes


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, d, words): each conversation's turns in order, from 1. Places come from sorted ranges and the numbers of
    rows in the ranges before, so that a conversation may span many."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv"), "turn", digest.alias("d"), F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("bigint").alias("words"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("d")]
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "d", "words", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "turns")
    runs = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = materialise(runs.select("conv", "part", "first", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "runs")
    return ranged.join(runs, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "d", "words")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): each conversation c gets the first h turns of conversation c - c % ``every`` (h is a checksum of c
    modulo ``most``) and its own after its first h."""
    own = materialise(ordered_turns(conversations), "own")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    convs = materialise(convs, "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    told = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    told = materialise(told.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    heads = told.where("taken > 0").join(own.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "d", "words"), "base").where("pos <= taken").select("conv", "pos", "d", "words")
    bodies = own.join(told.select("conv", "h", "taken"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d", "words")
    return heads.unionByName(bodies), told.select("conv", "n")


def conversation_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the rebuilt conversations' trie, by their contract's names."""
    nodes = prefix_trie(*rebuilt(conversations), chunk)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
