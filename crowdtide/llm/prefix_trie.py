"""Prefix trie of conversations: every distinct opening of d turns is a node of depth d.

Conversations are sorted by the digests of their turns, so that common openings lie side by side and a node is an
interval. The longest common prefix (LCP) of two neighbours is an edge between them. Inside a block of sorted
conversations the edges are taken in descending depth, and union-find joins what they connect: a component that an edge
of depth d makes or extends is a branching node of depth d, and each component it takes in closes the chain of nodes
below it. Everything a node reports is a sum over its interval, so it adds up under unions:

* tokens saved in the subtree of a node of depth d: sum over inner edges of (words up to the edge's depth), less
  (members - 1) x (words up to depth d - 1);
* leaves: members that end and that the next neighbour neither equals nor extends;
* children: components taken in at that depth.

Nodes that hold the first or last conversation of their block are pending: the block hands on just those (its contracted
forest), under a digest of their turns. The edge between two blocks corrects the sums on its left side, and pending
nodes of one digest are added up. There are at most two of a depth for each block.

A conversation is cut into segments of at most ``segment`` turns; a segment is sorted among those with the same turns
before it, so no row grows with a conversation. What deeper segments add to subtrees is booked on each node's smallest
member and reaches the nodes above through that member's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import fresh_path, settle

WORD = "[^\\x20\\x09-\\x0D]+"
#: Turns in a segment, sorted conversations (and bytes of their digests) in a block, characters of ids in a row.
SEGMENT, BLOCK, BLOCK_BYTES, CHUNK = 1024, 8192, 1 << 23, 1 << 14
D = 16  # bytes of a turn's digest

PIECE = pa.schema(
    [("conv_id", pa.int64()), ("slice", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()), ("n", pa.int64()), ("digests", pa.binary()), ("words", pa.list_(pa.int64()))]
)
FOREST = pa.schema(
    [
        ("kind", pa.string()), ("block", pa.int64()), ("slot", pa.int32()), ("above", pa.int32()), ("id", pa.binary()), ("above_id", pa.binary()),
        ("own", pa.bool_()), ("right", pa.bool_()), ("k", pa.int32()), ("rel", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("below", pa.int64()), ("ends", pa.string()), ("seq", pa.int32()),
        ("s1", pa.int64()), ("s2", pa.int64()), ("key", pa.binary()), ("sums", pa.list_(pa.int64())), ("ended", pa.bool_()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


# --- turns to segments ------------------------------------------------------


def _pieces(segment: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of at most ``segment`` turns of one conversation from sorted turns."""
        slice_id = TaskContext.get().partitionId()
        current, cut_before, first, number = None, False, True, 0
        digests: list[bytes] = []
        words: list[int] = []
        rows: list[tuple] = []

        def flush(whole: bool) -> None:
            nonlocal digests, words, number
            rows.append((current, slice_id, number, whole, len(words), b"".join(digests), words))
            digests, words, number = [], [], number + 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE, strict=True)], schema=PIECE)
            rows.clear()
            return batch

        for batch in batches:
            for conv, digest, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")), strict=True):
                if conv != current:
                    if words:
                        flush(not first and not cut_before)
                        first, cut_before = False, False
                    current = conv
                elif len(words) >= segment:
                    flush(False)
                    cut_before = True
                digests.append(digest)
                words.append(n)
            if rows:
                yield out()
        if words:
            flush(False)  # may go on in the next slice
            yield out()

    return cut


def numbered_pieces(turns: DataFrame, segment: int) -> DataFrame:
    """Pieces of conversations: conv_id, before (turns in front of it), total (turns of the conversation), n, digests, words.

    ``turns``: conv_id, turn, digest, words. Sorted slices are cut in place; only conversations that cross a slice border
    or are longer than a segment are numbered by a window, over pieces instead of turns.
    """
    order = ["conv_id", "turn", "digest"]
    cut = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(segment), _ddl(PIECE))
    cut = settle(cut, "turn_pieces")
    whole = cut.where("whole").select("conv_id", F.lit(0).cast("long").alias("before"), F.col("n").alias("total"), "n", "digests", "words")
    w = Window.partitionBy("conv_id")
    earlier = w.orderBy("slice", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rest = cut.where(~F.col("whole")).select("conv_id", "slice", "piece", "n")
    rest = rest.select("conv_id", "slice", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(w).alias("total"))
    rest = cut.where(~F.col("whole")).join(rest, ["conv_id", "slice", "piece"])
    return whole.unionByName(rest.select(whole.columns))


def _bytes(array: str, field: str) -> Column:
    return F.reduce(array, F.lit(b""), lambda a, x: F.concat(a, x[field]))


def segments(parts: DataFrame, segment: int) -> DataFrame:
    """Rows to be sorted: conv_id, k, s1, s2 (digest of all turns before), key, base (words before), words, total, ended.

    ``parts``: conv_id, at, total, digests, words; the parts of a conversation cover its turns from 0 to total. Segment k
    has the turns from k x segment on, and one more that tells nodes at its end apart. It exists from that many turns on.
    """
    n = F.size("words")
    alone = (F.col("at") == 0) & (n == F.col("total")) & (F.col("total") < segment)
    zero = F.lit(0).cast("long")
    short = parts.where(alone).select(
        "conv_id", F.lit(0).alias("k"), zero.alias("s1"), zero.alias("s2"), F.col("digests").alias("key"), zero.alias("base"), "words", "total", F.lit(True).alias("ended"),
    )
    end = F.col("at") + n
    ks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - 1) / segment)), F.floor(end / segment))
    some = parts.where(~alone).withColumn("k", F.explode(ks)).withColumn("end", F.col("at") + F.size("words"))
    low = F.greatest("at", F.col("k") * segment)
    high = F.least("end", (F.col("k") + 1) * segment + 1)
    some = some.withColumn("skip", (low - F.col("at")).cast("int")).withColumn("take", F.greatest(F.lit(0), high - low).cast("int"))
    some = some.where((F.col("take") > 0) | (F.col("total") == F.col("k") * segment)).select(
        "conv_id", F.col("k").cast("int").alias("k"), "total",
        F.struct("at", F.substring("digests", F.col("skip") * D + 1, F.col("take") * D).alias("d"), F.slice("words", F.col("skip") + 1, F.col("take")).alias("w")).alias("p"),
    )
    joined = some.groupBy("conv_id", "k").agg(F.max("total").alias("total"), F.sort_array(F.collect_list("p")).alias("p"))
    joined = joined.select("conv_id", "k", "total", _bytes("p", "d").alias("key"), F.flatten("p.w").alias("words"))
    joined = settle(joined, "long_segments")
    mine = F.substring("key", F.lit(1), F.lit(segment * D))
    heads = joined.select("conv_id", "k", mine.alias("d"), F.reduce(F.slice("words", 1, segment), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))
    heads = heads.select("conv_id", "k", F.xxhash64("k", "d").alias("h1"), F.xxhash64(F.md5("d"), F.lit(1), "k").alias("h2"), "sum")
    earlier = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = {"s1": F.bit_xor("h1"), "s2": F.bit_xor("h2"), "base": F.sum("sum")}
    heads = heads.select("conv_id", "k", *[F.coalesce(f.over(earlier), zero).alias(c) for c, f in before.items()])
    long = joined.join(heads, ["conv_id", "k"]).withColumn("ended", F.col("total") <= (F.col("k") + 1) * segment)
    return short.unionByName(long.select(short.columns))


# --- the forest of a block --------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // D
    if a[: n * D] == b[: n * D]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[: mid * D] == b[: mid * D]:
            low = mid
        else:
            n = mid
    return low


class Row:
    """A sorted segment; ``sums`` are words of the conversation up to each of its depths."""

    __slots__ = ("k", "part", "key", "conv", "sums", "size", "ended", "saved", "leaves")

    def __init__(self, r: dict, segment: int):
        self.k, self.part, self.key, self.conv = r["k"], (r["k"], r["s1"], r["s2"]), r["key"], r["conv_id"]
        self.sums = list(accumulate(r["words"][:segment], initial=r["base"]))
        self.size, self.ended, self.saved, self.leaves = len(r["key"]) // D, r["ended"], r["deep_saved"], r["deep_leaves"]

    def edge(self, other: "Row") -> int:
        """Depth of the edge to the next row, from the segment's start; -1 if another part of the trie begins."""
        return common_turns(self.key, other.key) if self.part == other.part else -1

    def names(self) -> list[bytes]:
        """Digest of each prefix."""
        h = hashlib.md5(repr(self.part).encode())
        found = [h.digest()]
        for at in range(0, len(self.key), D):
            h.update(self.key[at : at + D])
            found.append(h.copy().digest())
        return found


class Forest:
    """Union-find over the edges of a block, deepest first."""

    def __init__(self, rows: list[Row], block: int, segment: int):
        n = len(rows)
        self.rows, self.block, self.segment = rows, block, segment
        self.edges = [rows[i - 1].edge(rows[i]) for i in range(1, n)]
        self.up = list(range(n))
        self.low, self.high = list(range(n)), list(range(n))
        self.depth = [r.size for r in rows]
        self.conv = [r.conv for r in rows]
        self.saved = [r.saved for r in rows]
        self.kids = [0] * n
        #: members that end at the component's depth: first row and number
        self.ends = [(i, 1 if r.ended else 0) for i, r in enumerate(rows)]
        self.leaves = [r.leaves for r in rows]
        for i, depth in enumerate(self.edges):
            if rows[i].ended and depth < rows[i].size:
                self.leaves[i] += 1
        #: nodes whose parent is the component's branching node
        self.open: list[list[dict]] = [[] for _ in rows]
        self.out: list[dict] = []
        self.slots = 0
        self.first_names, self.last_names = rows[0].names(), rows[-1].names()
        for i in sorted((i for i, depth in enumerate(self.edges) if depth >= 0), key=lambda i: -self.edges[i]):
            self.join(self.find(i), self.find(i + 1), self.edges[i], i)
        for i in range(n):
            if self.up[i] == i:
                self.close(i, -1)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int, depth: int, at: int) -> None:
        for c in (a, b):
            if self.depth[c] > depth:
                self.open[c] = self.close(c, depth)
                self.kids[c], self.ends[c], self.depth[c] = 1, (0, 0), depth
        small, big = (a, b) if len(self.open[a]) < len(self.open[b]) else (b, a)
        self.open[big].extend(self.open[small])
        self.open[small] = []
        row = self.rows[at]
        ends = [e for e in (self.ends[a], self.ends[b]) if e[1]]
        self.up[small] = big
        self.ends[big] = (ends[0][0], sum(e[1] for e in ends)) if ends else (0, 0)
        self.low[big], self.high[big] = self.low[a], self.high[b]
        self.conv[big] = min(self.conv[a], self.conv[b])
        self.saved[big] = self.saved[a] + self.saved[b] + row.sums[min(depth, self.segment, len(row.sums) - 1)]
        self.leaves[big] = self.leaves[a] + self.leaves[b]
        self.kids[big] = self.kids[a] + self.kids[b]

    def close(self, c: int, depth: int) -> list[dict]:
        """Nodes of a component from its own depth up to, not including, ``depth``; returns the topmost."""
        low, high = self.low[c], self.high[c]
        row, members = self.rows[low], high - low + 1
        pending = low == 0 or high == len(self.rows) - 1
        names = self.first_names if low == 0 else self.last_names
        below, kids, ends = self.open[c], self.kids[c], self.ends[c]
        start = row.k * self.segment
        for rel in range(self.depth[c], depth, -1):
            if rel <= self.segment:
                own = rel > 0 or row.k == 0
                node = {
                    "kind": "node", "block": self.block, "slot": None, "above": None, "own": own, "k": row.k, "rel": rel, "depth": start + rel, "conv_id": self.conv[c],
                    "parent_conv_id": None, "n_convs": members, "n_children": kids, "n_leaves": self.leaves[c], "below": row.sums[max(0, rel - 1)], "saved": self.saved[c],
                }
                if pending:
                    node |= {"kind": "pending", "slot": self.slots, "id": names[rel], "above_id": names[rel - 1] if rel else None, "right": high == len(self.rows) - 1}
                    self.slots += 1
                    self.out.append(node)
                    if ends[1]:
                        self.list_ends(node, ends)
                else:
                    node["saved"] -= (members - 1) * node["below"]
                    node["ends"] = hashlib.sha256(self.text(ends).encode()).hexdigest()
                    if own:
                        self.out.append(node)
                for child in below:
                    if pending:
                        child["above"] = node["slot"]
                    else:
                        child["parent_conv_id"] = node["conv_id"]
                below = [node]
            kids, ends = 1, (0, 0)
        return below

    def text(self, ends: tuple[int, int]) -> str:
        return ",".join([str(self.rows[i].conv) for i in range(ends[0], ends[0] + ends[1])])

    def list_ends(self, node: dict, ends: tuple[int, int]) -> None:
        step = CHUNK // 8
        for seq, at in enumerate(range(0, ends[1], step)):
            part = (ends[0] + at, min(step, ends[1] - at))
            self.out.append({"kind": "ends", "block": self.block, "id": node["id"], "ends": self.text(part), "seq": seq})

    def meet(self, depth: int) -> None:
        """Correct the nodes at the right side for an edge of that depth to the next block."""
        row = self.rows[-1]
        for node in self.out:
            if node.get("right"):
                node["n_leaves"] += row.ended and depth < row.size
                if depth >= node["rel"]:
                    node["saved"] += row.sums[min(depth, self.segment, len(row.sums) - 1)]
                    node["n_children"] -= depth > node["rel"]
                node["right"] = False


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in FOREST], schema=FOREST)


def _forests(segment: int, block: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows: list[Row] = []
        held: Forest | None = None
        count = size = 0

        def side(kind: str, row: Row, number: int) -> dict:
            k, s1, s2 = row.part
            return {"kind": kind, "block": number, "k": k, "s1": s1, "s2": s2, "key": row.key, "sums": row.sums, "ended": row.ended}

        def turn_over() -> list[dict]:
            nonlocal rows, held, count, size
            number = (task << 32) + count
            ready = [side("first", rows[0], number)] if not count else []
            forest = Forest(rows, number, segment)
            if held:
                held.meet(held.rows[-1].edge(rows[0]))
                ready += held.out
            rows, held, count, size = [], forest, count + 1, 0
            return ready

        for batch in batches:
            for r in batch.to_pylist():
                row = Row(r, segment)
                rows.append(row)
                size += len(row.key)
                if len(rows) >= block or size >= BLOCK_BYTES:
                    if ready := turn_over():
                        yield _batch(ready)
        if rows:
            if ready := turn_over():
                yield _batch(ready)
        if held:
            yield _batch([*held.out, side("last", held.rows[-1], held.block)])

    return grow


def _meeting_edges(segment: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out: dict[str, list] = {"block": [], "edge": [], "words": [], "leaf": []}
            for r in rows:
                same = r["next_k"] is not None and (r["k"], r["s1"], r["s2"]) == (r["next_k"], r["next_s1"], r["next_s2"])
                depth = common_turns(r["key"], r["next_key"]) if same else -1
                out["block"].append(r["block"])
                out["edge"].append(depth)
                out["words"].append(r["sums"][min(depth, segment, len(r["sums"]) - 1)] if same else 0)
                out["leaf"].append(int(r["ended"] and depth < len(r["key"]) // D))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return measure


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's ids, from its sorted rows; holds one row at a time."""
    current, h = None, hashlib.sha256()
    for batch in batches:
        ids, digests = [], []
        for node, text in zip(batch.column("id").to_pylist(), batch.column("ends"), strict=True):
            if node != current:
                if current is not None:
                    ids.append(current)
                    digests.append(h.hexdigest())
                current, h = node, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(digests, pa.string())], ["id", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["id", "ends_sha256"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def forest_nodes(rows: DataFrame, segment: int, block: int) -> DataFrame:
    """Nodes of the trie of segments, with sums over subtrees inside a segment plus deep_saved and deep_leaves of its members."""
    spark = rows.sparkSession
    order = ["k", "s1", "s2", "key", "conv_id"]
    path = fresh_path(spark, "forest")
    grown = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_forests(segment, block), _ddl(FOREST))
    grown.write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(_ddl(FOREST)).parquet(path)
    nodes = stored.where("kind = 'node'")
    # the edges between the last block of a slice and the first of the next one; a row or two for each slice
    task = F.shiftright("block", 32)
    places = stored.where("kind = 'first'").select(task.alias("task")).withColumn("place", F.row_number().over(Window.orderBy("task")))
    first = stored.where("kind = 'first'").withColumn("task", task).join(places, "task")
    first = first.select((F.col("place") - 1).alias("place"), *[F.col(c).alias(f"next_{c}") for c in ("k", "s1", "s2", "key")])
    last = stored.where("kind = 'last'").withColumn("task", task).join(places, "task").join(first, "place", "left")
    last = last.select("block", "k", "s1", "s2", "key", "sums", "ended", "next_k", "next_s1", "next_s2", "next_key")
    edges = last.mapInArrow(_meeting_edges(segment), "block long, edge int, words long, leaf long")
    pending = stored.where("kind = 'pending'")
    done = pending.where("not right").select("id", "above_id", "own", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "below")
    met = pending.where("right").join(edges, "block").withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.col("leaf"),
            "saved": F.col("saved") + F.when(F.col("edge") >= F.col("rel"), F.col("words")).otherwise(0),
            "n_children": F.col("n_children") - F.when(F.col("edge") > F.col("rel"), 1).otherwise(0),
        }
    )
    both = done.unionByName(met.select(done.columns))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = both.groupBy("id").agg(F.max("above_id").alias("above_id"), *[F.max(c).alias(c) for c in ("own", "depth", "below")], F.min("conv_id").alias("conv_id"), *sums)
    merged = settle(merged, "merged_nodes")
    listed = stored.where("kind = 'ends'").select("id", "block", "seq", "ends")
    hashed = listed.repartition("id").sortWithinPartitions("id", "block", "seq").mapInArrow(_hash_ends, "id binary, ends_sha256 string")
    convs = merged.select(F.col("id").alias("above_id"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.where("own").join(hashed, "id", "left").join(convs, "above_id", "left")
    saved = F.col("saved") - (F.col("n_convs") - 1) * F.col("below")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    top = top.withColumn("saved_tokens", saved).withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(NODE)
    # parents that were pending, found block by block
    nodes = nodes.withColumnRenamed("saved", "saved_tokens").withColumnRenamed("ends", "ends_sha256")
    known = nodes.where("above is null").select(NODE)
    found = pending.select("id", "block", F.col("slot").alias("above")).join(merged.select("id", F.col("conv_id").alias("found")), "id").drop("id")
    waiting = nodes.where("above is not null").join(found, ["block", "above"]).drop("parent_conv_id").withColumnRenamed("found", "parent_conv_id").select(NODE)
    return known.unionByName(waiting).unionByName(top)


def trie_nodes(parts: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of sequences given in parts, see ``segments`` and ``build_trie``."""
    rows = settle(segments(parts, segment), "segments")
    zero = F.lit(0).cast("long")
    deep = rows.where("k > 0")
    if deep.limit(1).count():
        # nodes beyond the first segment, booked on their smallest member, for the nodes above them
        below = forest_nodes(deep.withColumns({"deep_saved": zero, "deep_leaves": zero}), segment, block)
        words = deep.select("conv_id", "k", F.posexplode(F.slice("words", 1, segment)).alias("at", "w"))
        words = words.select("conv_id", (F.col("k") * segment + F.col("at") + 1).alias("depth"), "w")
        sums = below.join(words, ["conv_id", "depth"]).groupBy("conv_id", F.floor((F.col("depth") - 1) / segment).cast("int").alias("k"))
        sums = sums.agg(F.sum((F.col("n_convs") - 1) * F.col("w")).alias("s"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("l"))
        deeper = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
        every = rows.where("k > 0").select("conv_id").distinct().join(rows.select("conv_id", "k"), "conv_id").join(sums, ["conv_id", "k"], "left")
        totals = every.select("conv_id", "k", *[F.coalesce(F.sum(c).over(deeper), zero).alias(d) for c, d in (("s", "deep_saved"), ("l", "deep_leaves"))])
        rows = rows.join(totals, ["conv_id", "k"], "left").fillna(0, ["deep_saved", "deep_leaves"])
    else:
        rows = rows.withColumns({"deep_saved": zero, "deep_leaves": zero})
    return forest_nodes(rows, segment, block)


def _turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and digest of role and text; rows without a conv_id take no part."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumn("digest", digest)


def digested_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, words of the text."""
    return _turn_rows(conversations).select("conv_id", "turn", "digest", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def build_trie(conversations: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Nodes of the prefix trie of conversations as they are: the columns of ``NODE``.

    A node is named by its smallest member and its depth. Turns are ordered by ``turn``, null first; rows of one turn by
    their digest, a fixed order without meaning. Null role or text counts as empty. Rows that repeat are turns of their
    own. Rows without a conv_id take no part; an empty table has no nodes, not even a root. Other columns are ignored.
    """
    pieces = numbered_pieces(digested_turns(conversations), segment)
    return trie_nodes(pieces.select("conv_id", F.col("before").alias("at"), "total", "digests", "words"), segment, block)


def with_last_turn(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of ``build_trie`` with role and text of their last turn, null for the root."""
    rows = _turn_rows(conversations)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "digest")).cast("long")
    return nodes.join(rows.select("conv_id", place.alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def rebuilt_parts(pieces: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Parts of conversations whose first h turns are taken from the first conversation of their group of ids.

    h is the crc32 of the id modulo ``most``: the first h original turns of that conversation (all if fewer, none if it is
    absent), then the conversation's own turns after its first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    take = (F.lit(most - 1) - F.col("before")).cast("int")
    heads = pieces.where((F.col("conv_id") % group == 0) & (F.col("before") < most - 1))
    part = F.struct("before", F.substring("digests", F.lit(1), take * D).alias("d"), F.slice("words", F.lit(1), take).alias("w"))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(part)).alias("p"))
    heads = heads.select("base", _bytes("p", "d").alias("head"), F.flatten("p.w").alias("head_words"))
    both = pieces.withColumn("base", base).withColumn("h", h.cast("int")).join(heads, "base", "left")
    both = both.withColumn("head", F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), F.col("h") * D))
    both = both.withColumn("head_words", F.slice(F.coalesce("head_words", F.array().cast("array<long>")), F.lit(1), F.col("h")))
    got = F.size("head_words")
    skip = F.greatest(F.lit(0), F.col("h") - F.col("before")).cast("int")
    rest, rest_words = F.substring("digests", skip * D + 1, F.length("digests")), F.slice("words", skip + 1, F.greatest(F.lit(0), F.size("words") - skip))
    first = F.col("before") == 0
    return both.select(
        "conv_id", F.when(first, F.lit(0)).otherwise(got + F.greatest("before", "h") - F.col("h")).cast("long").alias("at"),
        (got + F.greatest(F.lit(0), F.col("total") - F.col("h"))).cast("long").alias("total"),
        F.when(first, F.concat("head", rest)).otherwise(rest).alias("digests"), F.when(first, F.concat("head_words", rest_words)).otherwise(rest_words).alias("words"),
    )


#: crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLE = f"""
WITH g AS (SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p FROM g),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
head AS (SELECT c.conv_id, t.p, t.digest, t.words FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h),
taken AS (SELECT conv_id, count(*) AS n FROM head GROUP BY 1),
r AS (SELECT * FROM head UNION ALL SELECT t.conv_id, t.p - c.h + coalesce(taken.n, 0), t.digest, t.words FROM t JOIN c USING (conv_id) LEFT JOIN taken USING (conv_id) WHERE t.p > c.h),
m AS (SELECT conv_id, 0 AS d, '' AS k, 0 AS words FROM c UNION ALL SELECT conv_id, p, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY p)), words FROM r),
sized AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS n FROM m),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM sized GROUP BY d, k),
above AS (SELECT v.d, v.k, m.k AS ak FROM nodes v JOIN m ON m.conv_id = v.conv_id AND m.d = v.d - 1),
kids AS (SELECT d - 1 AS d, ak AS k, count(*) AS kids FROM above GROUP BY ALL),
sub AS (SELECT a.d, a.k, sum((v.n_convs - 1) * v.words) AS saved, count(*) FILTER (kids IS NULL) AS leaves
        FROM nodes v LEFT JOIN kids USING (d, k) JOIN m a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sub USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN above USING (d, k) LEFT JOIN nodes pn ON pn.d = n.d - 1 AND pn.k = above.ak
"""


@register("op12_prefix_trie", ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = numbered_pieces(digested_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), SEGMENT)
    return trie_nodes(rebuilt_parts(pieces))
