"""Exact n-gram Jaccard self-join with a token-group matrix.

A document's set is its distinct `size`-word shingles (64-bit hashes). Documents with equal sets are one node. Two
nodes link when 100 * intersection >= percent * union. Steps, all on tables:

1. Order. Shingles are ordered by (number of sets that hold it, hash), where only the `heavy` commonest shingles with
   at least `heavy_min` sets have a number other than 0; any order is right, this one keeps shared passages out of
   prefixes. Numbers come from all documents: first for shingles whose hash is in the lowest `LOW` part, then, for the
   documents whose prefix reaches beyond it, for their other shingles.
2. Prefixes. Sets that link share at least DEPTH of their first n - ceil(p * n) + DEPTH shingles in that order (all of
   them in very small sets). Shingles that one node alone has in its prefix are dropped.
3. Groups. Each prefix shingle has a pivot, the node whose prefix is the most common; every node is verified against
   the best pivot among its shingles', and the components of these links are the groups of similar documents:
   thousands of near copies are one group after as many verifications.
4. Token-group matrix. A row per shingle and group (the groups' unions), with the ranges of set sizes and places in
   the group. Only groups are opened that share DEPTH shingles with a node, each where some member could stand at such
   places and in the size range that a link needs. What stands behind the last shared shingle bounds an overlap with
   one node only, so this is asked of lone nodes and of an opened group's members, one by one.
5. Verification compares whole sets. A pivot's partners are split into chunks, the pivot's text going to each.
   Pairs inside a group aren't listed, as its members are linked already; components of the groups over the links
   between them give the result.

Hot shingles: those that more than `hot` sets hold are known from the first step, if they are among the `heavy`
commonest. Their rows are dealt over SALTS tasks, and what is counted of them is put together in a table of `heavy`
rows at most.

Broadcast: the numbers of the `heavy` commonest shingles at most, counts of hot ones (as many), and the destinations
of candidate documents while they are at most `broadcast_rows` (about 30 bytes each), else the join is shuffled.

Defined results: null or blank texts have n_shingles 0 and are linked with nothing; copies are linked with each other;
a null doc_id counts as larger than all others and is given back as null; repeated rows each get a row; other columns
are ignored. Set hashes of 64 bits name nodes, and a second one must agree, else the join is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import lean, stash, tune
from ._text import SOLID, Words, buffer, mix, shingles, slices
from .components import components

U64 = np.uint64
LOW = 0.3
DEPTH = 3
CHUNK = 256
SALTS = 256
#: Bytes of text in a batch that is dealt.
DEALT = 4 << 20
NO_ID = 2**63 - 1


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; quicker than np.unique on short arrays."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def sets(part: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    w = Words(*buffer(part.column("text")), SOLID)
    h, first = w.hashes(), w.first
    g, n = shingles(h, size), np.diff(first)
    short = {k: shingles(h, k) for k in set(n[(n > 0) & (n < size)].tolist())}
    out = []
    for a, k in zip(first.tolist(), n.tolist(), strict=False):
        out.append(_distinct(g[a : a + k - size + 1]) if k >= size else short[k][a : a + 1] if k else g[:0])
    return out


def node(s: np.ndarray) -> int:
    """The set's first hash; as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([s.sum(dtype=U64) + U64(len(s))]))[0].view(np.int64))


def _second(s: np.ndarray) -> int:
    return int(mix(s ^ U64(0x5BF03635F0935AD1)).sum(dtype=U64).view(np.int64))


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


class _Order:
    """Numbers of the commonest shingles (ascending shingles)."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts
        self.bits = np.zeros(1 << 20, bool)
        self.bits[tokens >> U64(44)] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        at = np.flatnonzero(self.bits[s >> U64(44)])
        if len(at):
            k = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[k] == s[at], self.counts[k], 0)
        return out

    def hot(self, s: np.ndarray, more_than: int) -> np.ndarray:
        return self.of(s) > more_than

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The set's prefix, in order."""
        n = len(s)
        p = min(n, n - need(n, percent) + DEPTH)
        c = self.of(s)
        if not c.any():
            return s[:p]
        light = s[c == 0]
        if len(light) >= p:
            return light[:p]
        at = np.flatnonzero(c)
        return np.concatenate((light, s[at[np.lexsort((s[at], c[at]))]]))[:p]


def _no_order() -> _Order:
    return _Order(np.zeros(0, U64), np.zeros(0, np.int64))


def _commonest(rows: DataFrame, heavy: int, heavy_min: int) -> _Order:
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_min).orderBy(F.desc("n"), "token").limit(heavy).toArrow()
    token, n = (top.column(c).to_numpy() for c in ("token", "n"))
    token = token.view(U64) if len(token) else np.zeros(0, U64)
    o = np.argsort(token)
    return _Order(token[o], n[o].astype(np.int64))


def _new_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, set) of the distinct sets of a task that aren't empty."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch):
            for s in sets(part, size):
                if len(s) and (k := node(s)) not in seen:
                    seen.add(k)
                    yield k, s


def _order(docs: DataFrame, size: int, percent: int, heavy: int, heavy_min: int) -> _Order:
    spark = docs.sparkSession
    edge = U64(int(LOW * 2**64))

    def emit(found: list[np.ndarray]) -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

    def pieces(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in found:
            held.append(x)
            n += len(x)
            if n > 500_000:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pieces(s[: np.searchsorted(s, edge)] for _, s in _new_sets(batches, size))

    first = _commonest(docs.select("text").mapInArrow(lean(low), "token long, n int"), heavy // 2, heavy_min)
    shared = spark.sparkContext.broadcast(first)

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = shared.value
        yield from pieces(s[np.searchsorted(s, edge) :] for _, s in _new_sets(batches, size) if o.prefix(s, percent).max() >= edge)

    second = _commonest(docs.select("text").mapInArrow(lean(high), "token long, n int"), heavy // 2, heavy_min)
    return _Order(np.concatenate((first.tokens, second.tokens)), np.concatenate((first.counts, second.counts)))


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, *, size: int = 5, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. b's partners are dealt in chunks; b should be the more frequent side."""
    spark, size_ = docs.sparkSession, size
    pairs = stash(pairs.select("a", "b"), "pairs")
    chunks = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("c", F.ceil(F.col("c") / CHUNK).cast("int"))
    chunks = stash(chunks, "chunks")
    many = chunks.where("c > 1")
    spoke = pairs.join(many, "b", "left").select(F.col("a").alias("node"), F.col("b").alias("hub"), F.coalesce(F.pmod(F.xxhash64("a"), F.col("c")), F.lit(0)).cast("int").alias("chunk"), F.lit(1).alias("role"))
    hub = chunks.select(F.col("b").alias("node"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk"), F.lit(0).alias("role"))
    # A node's destinations, dealt over 64 rows. `row` names a row of docs with the node's text.
    places = spoke.unionByName(hub).withColumn("part", F.pmod(F.xxhash64("hub", "chunk"), F.lit(64)))
    places = places.groupBy("node", "part").agg(F.collect_list(F.struct("hub", "chunk", "role")).alias("to"))
    places = stash(places.join(nodes.select("node", "row"), "node").select("node", F.col("row").alias("_row"), "to"), "places")
    small = places.agg(F.coalesce(F.sum(F.size("to")), F.lit(0)).alias("n")).first().n <= broadcast_rows
    texts = docs.select(_row().alias("_row"), "text").join(F.broadcast(places) if small else places, "_row").select("node", "text", "to")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, sent = [], 0, set()

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["hub", "chunk", "role", "node", "text"])

        for batch in batches:
            for part in slices(batch):
                for want, s, text, to in zip(part.column("node").to_pylist(), sets(part, size_), part.column("text"), part.column("to").to_pylist(), strict=True):
                    key = (want, to[0]["hub"], to[0]["chunk"])
                    if not len(s) or node(s) != want or key in sent:  # repeated rows are dealt once for each task
                        continue
                    sent.add(key)
                    text = text.as_py()
                    for t in to:
                        rows.append((t["hub"], t["chunk"], t["role"], want, text))
                        size += len(text)
                        if size > DEALT:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in batches:
            for part in slices(batch):
                found = []
                for hub, chunk, role, k, s in zip(*(part.column(c).to_pylist() for c in ("hub", "chunk", "role", "node")), sets(part, size), strict=True):
                    if role == 0:
                        at, mine = (hub, chunk), s
                    elif at == (hub, chunk):
                        both = len(np.intersect1d(mine, s, assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(s) - both):
                            found.append((k, hub))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = texts.mapInArrow(lean(deal), "hub long, chunk int, role int, node long, text string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stash(dealt.repartition(n, "hub", "chunk").sortWithinPartitions("hub", "chunk", "role").mapInArrow(lean(compare), "a long, b long").distinct(), "links")


def similar(docs: DataFrame, *, size: int = 5, percent: int = 80, heavy: int = 1 << 20, heavy_min: int = 8, hot: int = 20_000, broadcast_rows: int = 500_000, key: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; with `key`, that column (a long) and `group`, a number of each
    component of more than one row, null for other rows."""
    tune(docs.sparkSession)
    spark = docs.sparkSession
    extra = [] if key is None else [key]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = sets(part, size)
                cols = [part.column("doc_id"), part.column("row"), pa.array([len(x) for x in s], pa.int64()), pa.array([node(x) if len(x) else None for x in s], pa.int64()), pa.array([_second(x) for x in s], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(c) for c in extra)], ["doc_id", "row", "n", "node", "second", *extra])

    schema = "doc_id long, row long, n long, node long, second long" + "".join(f", `{c}` long" for c in extra)
    named = stash(docs.withColumn("row", _row()).mapInArrow(lean(name), schema), "sets")
    rep = F.min(F.coalesce(F.col("doc_id"), F.lit(NO_ID)))
    nodes = named.where("n > 0").groupBy("node").agg(rep.alias("rep"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("second").alias("s0"), F.max("second").alias("s1"))
    nodes = stash(nodes, "nodes")
    if not nodes.where("s0 <> s1").isEmpty():
        raise ValueError("two different sets have one hash")

    order = spark.sparkContext.broadcast(_order(docs, size, percent, heavy, heavy_min))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["token", "node", "n", "pos", "hot"])

        for k, s in _new_sets(batches, size):
            p = order.value.prefix(s, percent)
            held.append((p.view(np.int64), np.full(len(p), k), np.full(len(p), len(s), np.int32), np.arange(1, len(p) + 1, dtype=np.int32), order.value.hot(p, hot)))
            total += len(p)
            if total > 200_000:
                yield batch_of()
                held, total = [], 0
        if held:
            yield batch_of()

    n, least = F.col("n"), F.least(F.lit(DEPTH), F.ceil(F.ceil(F.col("n") * percent / 100) * percent / 100))

    def fits(n: Column, m: Column) -> Column:
        return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))

    def overlap(n: Column, m: Column) -> Column:
        """The least overlap of linked sets of these sizes."""
        return F.ceil(percent * (n + m) / (100 + percent))

    def within(pos: Column, n: Column, m: Column) -> Column:
        """Sets of n and m that link share DEPTH shingles at such places of n's order; any bound holds by these alone."""
        return pos <= n - overlap(n, m) + DEPTH

    smallest = F.greatest(F.col("lo"), F.ceil(n * percent / 100))

    def able(rows: DataFrame) -> DataFrame:
        """Rows at places where a link with one of the shingle's nodes can have them, of nodes with enough; lo: the smallest of these nodes."""
        rows = rows.where(within(F.col("pos"), n, smallest))
        enough = rows.groupBy("node", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
        return rows.join(enough.select("node"), "node", "left_semi")

    by = Window.partitionBy("token", "salt")  # a column: windows by an expression each have a shuffle of their own

    def shared(rows: DataFrame, name: str) -> DataFrame:
        """Rows of shingles that more than one node has, with df, their number, and lo, the smallest of these nodes."""
        salt = F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(0))
        rows = rows.select("token", "node", "n", "pos", "hot", salt.alias("salt"))
        rows = stash(rows.withColumn("df", F.count(F.lit(1)).over(by)).withColumn("lo", F.min("n").over(by)).where("hot or df > 1").drop("salt"), name)
        whole = rows.where("hot").groupBy("token").agg(F.count(F.lit(1)).alias("_df"), F.min("lo").alias("_lo"))
        rows = rows.join(F.broadcast(whole), "token", "left")  # `heavy` rows at most
        return rows.withColumns({"df": F.coalesce("_df", "df"), "lo": F.coalesce("_lo", "lo")}).drop("_df", "_lo").where("df > 1")

    def with_token(rows: DataFrame, one: DataFrame) -> DataFrame:
        """Join with a table that has one row for each shingle: hot ones are no key of a shuffle."""
        cold = rows.where("not hot").join(one.where("not hot").drop("hot"), "token")
        return cold.unionByName(rows.where("hot").join(F.broadcast(one.where("hot").drop("hot")), "token"))

    posts = able(shared(docs.select("text").mapInArrow(lean(prefixes), "token long, node long, n int, pos int, hot boolean"), "prefixes"))
    posts = stash(shared(posts, "able").drop("lo"), "shared")

    # Pivots: a text that others were made from has few shingles of its own, so common ones fill its prefix.
    score = posts.groupBy("node").agg((F.sum("df") * 1.0).alias("score"))
    scored = stash(posts.select("token", "node", "hot").join(score, "node"), "scored")
    pivots = scored.groupBy("token", "hot").agg(F.max(F.struct("score", "node")).alias("p"))
    first = with_token(scored, pivots).where("p.node <> node").groupBy("node").agg(F.max("p").alias("p"))
    first = stash(first.select(F.col("node").alias("a"), F.col("p.node").alias("b")), "first")
    groups = components(verify(docs, nodes, first, size=size, percent=percent, broadcast_rows=broadcast_rows))

    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("s"))
    groups = stash(groups.join(sizes, "comp").select("node", "comp", "s"), "groups")
    mine = posts.select("token", "node", "n", "pos", "hot").join(groups, "node", "left")
    mine = mine.select("token", "node", "n", "pos", "hot", F.struct(F.coalesce("s", F.lit(1)).alias("s"), F.coalesce("comp", "node").alias("id")).alias("g"))
    for k in range(2):  # shingles in more than one group, of nodes that can link beyond their own
        mixed = mine.groupBy("token", "hot").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("n").alias("lo")).where("g0 <> g1").select("token", "hot", "lo")
        mine = stash(able(with_token(mine, mixed)).drop("lo"), f"mixed{k}")
    matrix = mine.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("pos").alias("far"), F.max(n - F.col("pos")).alias("rest"))

    # Each pair of groups is met once, from the smaller group's nodes. A row's bounds hold for whichever member shares
    # it; the last shared shingle may be another member's, so it bounds overlaps with groups of one node alone.
    in_range = (100 * F.col("hi") >= percent * n) & (percent * F.col("lo") <= 100 * n)
    placed = within(F.col("pos"), n, smallest) & (F.col("rest") + DEPTH >= overlap(n, smallest))
    placed = placed & (F.least(F.col("pos"), F.col("far")) + F.least(n - F.col("pos"), F.col("rest")) >= overlap(n, smallest))
    met = mine.join(matrix, "token").where((F.col("g") < F.col("h")) & in_range & placed)
    met = met.groupBy("node", "n", "h").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("last"), F.min("lo").alias("lo"), F.min("rest").alias("rest"))
    behind = F.col("c") + F.least(n - F.col("last"), F.col("rest")) >= overlap(n, F.col("lo"))
    opened = stash(met.where((F.col("c") >= least) & ((F.col("h.s") > 1) | behind)).select("node", "h"), "opened")
    member = mine.select("token", F.col("node").alias("m"), F.col("n").alias("mn"), F.col("pos").alias("mpos"), F.col("g").alias("h"))
    near = F.least(F.col("pos"), F.col("mpos")) + F.least(n - F.col("pos"), F.col("mn") - F.col("mpos")) >= overlap(n, F.col("mn"))
    pairs = mine.join(opened, "node").join(member, ["token", "h"]).where(fits(n, F.col("mn")) & within(F.col("pos"), n, F.col("mn")) & within(F.col("mpos"), F.col("mn"), n) & near)
    pairs = pairs.groupBy("node", "m", "n", "mn").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("last"), F.max("mpos").alias("mlast"))
    pairs = pairs.where((F.col("c") >= least) & (F.col("c") + F.least(n - F.col("last"), F.col("mn") - F.col("mlast")) >= overlap(n, F.col("mn"))))
    tried = first.unionByName(first.select(F.col("a").alias("b"), F.col("b").alias("a")))
    pairs = pairs.select(F.col("m").alias("a"), F.col("node").alias("b")).join(tried, ["a", "b"], "left_anti")
    links = verify(docs, nodes, pairs, size=size, percent=percent, broadcast_rows=broadcast_rows)

    # The links between groups, as links of the groups' smallest nodes.
    for side in ("a", "b"):
        links = links.join(groups.select(F.col("node").alias(side), "comp"), side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    met = components(links).withColumnRenamed("comp", "c")
    lone = met.join(groups, "node", "left_anti").select("node", F.col("node").alias("comp"))
    found = groups.select("node", "comp").unionByName(lone).join(met.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("c", "comp").alias("c"))
    joined = nodes.join(found, "node")
    low = joined.groupBy("c").agg(F.min("rep").alias("component"))
    linked = joined.join(low, "c").select("node", "component", F.col("c").alias("group"))
    copied = nodes.where("copies > 1").join(found, "node", "left_anti").select("node", F.col("rep").alias("component"), F.col("node").alias("group"))
    known = stash(linked.unionByName(copied), "components")
    more = [] if key is None else [key, "group"]
    out = named.join(known, "node", "left").select("doc_id", *more, F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("component_id") != NO_ID, F.col("component_id")).cast(T.LongType()))
