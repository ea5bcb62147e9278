"""N-gram Jaccard join: shingle sets that overlap by a share, found with signature trees.

1. Frequencies. Buckets of documents ask shards how many documents hold each shingle (keyed.py). In the order rarest
   first, two sets of Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each: its prefix. A
   prefix without a shared shingle ends a document's part. Frequencies only choose the order, so 48 bits of a hash do.
2. Blocks. Documents with a prefix shingle in common are tied to the least of them; the components of these ties are blocks. Linked
   documents lie in one block.
3. Trees. A block's sets become a signature tree: nodes hold the OR of their token bitmaps and their range of sizes. The dual
   traversal of the tree with itself drops node pairs whose largest possible overlap is too small, and those that
   are one component already; leaf pairs left are counted exactly.
4. Blocks too large for a task are cut into chunks that share a few documents of the block. What their trees leave unlinked is finished
   in the cheaper of two exact ways, both counted first: documents outside the block's main component visit all its chunks (any pair
   not compared so far has one of them); or the documents under each prefix shingle are compared, once for each set of documents
   that is not one component yet (ties chain: a block of a large corpus can be most of it, with little to link).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import keyed
from ..plans.ship import ship
from .common import buckets_for, materialize
from .graph import Sets, components

LEAF, FAN = 8, 8
#: Shingles a task holds of one or more blocks (8 bytes each).
LOT = 1_500_000


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's width-word shingles; of the whole sequence where it is shorter; none without words."""
    w = keyed.Words(texts, lower=True)
    grams, out = keyed.windows(w.hashes, width), []
    for s, e in zip(w.at[:-1].tolist(), w.at[1:].tolist()):
        out.append(np.unique(grams[s : e - width + 1]) if e - s >= width else keyed.windows(w.hashes[s:e], e - s)[:1] if e > s else np.zeros(0, np.uint64))
    return out


# ---- signature trees


class Node:
    __slots__ = ("bits", "low", "high", "surplus", "members", "children", "uniform")


class Tree:
    """Sets of one block: bitmaps of their hashes, in leaves of like sizes, under nodes that hold ORs and ranges."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        width = 256
        while width < 2 * int(np.median(self.n)) and width < 1 << 16:
            width *= 2
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for i, s in enumerate(sets):
            flags = np.zeros(width, bool)
            flags[(s & np.uint64(width - 1)).astype(np.int64)] = True
            self.bits[i] = np.packbits(flags).view(np.uint64)
        self.surplus = self.n - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.union = Sets(len(sets))
        order = np.argsort(self.n, kind="stable")
        level = [self._node(order[i : i + LEAF], []) for i in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._node(np.concatenate([c.members for c in level[i : i + FAN]]), level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.top = level[0]

    def _node(self, members, children) -> Node:
        x = Node()
        x.members, x.children, x.uniform = members, children, False
        x.bits = np.bitwise_or.reduce(self.bits[members] if not children else np.array([c.bits for c in children]), axis=0)
        x.low, x.high, x.surplus = int(self.n[members].min()), int(self.n[members].max()), int(self.surplus[members].max())
        return x

    def enough(self, overlap, sizes):
        """Jaccard >= num / den for an overlap and the sum of both sizes."""
        return (self.num + self.den) * overlap >= self.num * sizes

    def _one(self, x: Node) -> bool:
        if not x.uniform:
            first = self.union.root(int(x.members[0]))
            x.uniform = all(self.union.root(m) == first for m in x.members.tolist())
        return x.uniform

    def overlap(self, i: int, j: int) -> int:
        both = np.concatenate([self.sets[i], self.sets[j]])
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())

    def gather(self, rounds: int = 4) -> list[tuple[int, int]]:
        """Links of a few members with all others at once: in a group of near copies they leave little to traverse."""
        out = []
        if len(self.sets) < 16:
            return out
        every, cut = np.concatenate(self.sets), np.concatenate([[0], np.cumsum(self.n)[:-1]])
        for _ in range(rounds):
            roots = np.array([self.union.root(i) for i in range(len(self.sets))])
            names, sizes = np.unique(roots, return_counts=True)
            if len(names) == 1:
                break
            pivot = int(np.nonzero(roots == names[np.argmax(sizes)])[0][len(out) % int(sizes.max())])
            s = self.sets[pivot]
            at = np.minimum(np.searchsorted(s, every), len(s) - 1)
            same = np.add.reduceat((s[at] == every).astype(np.int64), cut)
            for j in np.nonzero(self.enough(same, self.n + len(s)))[0].tolist():
                if self.union.join(pivot, j):
                    out.append((pivot, j))
        return out

    def join(self, foreign: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join all linked sets (a spanning forest); with foreign, pairs of two foreign ones are not looked at."""
        out, stack = self.gather() if foreign is None else [], [(self.top, self.top)]
        while stack:
            a, b = stack.pop()
            if self.den * a.high < self.num * b.low or self.den * b.high < self.num * a.low:
                continue
            if self._one(a) and self._one(b) and self.union.root(int(a.members[0])) == self.union.root(int(b.members[0])):
                continue
            if a is not b and not self.enough(int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.surplus, b.surplus), a.low + b.low):
                continue
            if a is b and a.children:
                c = a.children
                stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i + 1, len(c))]
                stack += [(x, x) for x in c]
            elif a.children and (not b.children or len(a.members) >= len(b.members)):
                stack += [(x, b) for x in a.children]
            elif b.children:
                stack += [(a, x) for x in b.children]
            else:
                out += self._leaves(a.members, b.members, a is b, foreign)
        return out

    def _leaves(self, p, q, same: bool, foreign) -> list[tuple[int, int]]:
        x, y = self.bits[p][:, None], self.bits[q][None]
        only_p = np.bitwise_count(x & ~y).sum(axis=2).astype(np.int64)
        only_q = np.bitwise_count(y & ~x).sum(axis=2).astype(np.int64)
        n, m = self.n[p][:, None], self.n[q][None]
        may = self.enough(np.minimum(n - only_p, m - only_q), n + m)
        if same:
            may &= np.arange(len(p))[:, None] < np.arange(len(q))[None]
        if foreign is not None:
            may &= ~(foreign[p][:, None] & foreign[q][None])
        out = []
        for i, j in zip(*np.nonzero(may)):
            u, v = int(p[i]), int(q[j])
            if self.union.root(u) != self.union.root(v) and self.enough(self.overlap(u, v), int(self.n[u] + self.n[v])):
                self.union.join(u, v)
                out.append((u, v))
        return out


# ---- the join


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, text: str = "text", id_col: str = "doc_id", lot: int = LOT, direct: int = 8192, way: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: sets link at Jaccard >= num / den, components by links.

    A-Z are lowered. Null and empty texts, and those without words, have empty sets and link with nothing; texts shorter than width have one
    shingle. Equal sets link. Rows with equal ids are one node. Rows with a null id are in no component. An empty table gives
    no rows. Only the id (an integer) and the text are read. way: how blocks of more than lot shingles are finished, by visits or by
    groups; None takes what deals fewer rows.
    """
    ship(docs.sparkSession)
    n = buckets_for(docs, text)
    d = keyed.bucketed(docs, id_col, text, n)
    top = np.uint64(16)

    ex = keyed.Exchange(n, {1: keyed.Total}, direct, {1: 48})

    def load(t: pa.Table):
        sets = shingle_sets(t["text"].to_pylist(), width)
        keys, at, back = keyed.distinct(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> top)
        return sets, keys, (np.diff(np.append(at, len(back))),), back

    def ask(t: pa.Table) -> pa.Table:
        _, keys, counts, _ = load(t)
        return ex.ask(t["bucket"][0].as_py(), {1: (keys, counts)})

    def finish(t: pa.Table, got: pa.Table) -> pa.Table:
        sets, keys, counts, back = load(t)
        df = ex.learn(got, 1, keys, counts)[0][0][back]
        raw, prefix, at = [], [], 0
        for s in sets:
            f = df[at : at + len(s)]
            at += len(s)
            first = len(s) - -(-num * len(s) // den) + 1
            alone = int((f == 1).sum())
            if not len(s) or alone >= first:
                raw.append(None), prefix.append(None)
                continue
            many = np.nonzero(f > 1)[0]
            take = many[np.argsort(f[many], kind="stable")][: first - alone]
            raw.append(s.tobytes()), prefix.append(s[take].tobytes())
        return pa.Table.from_arrays([t["id"].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(raw, pa.binary()), pa.array(prefix, pa.binary())], ["id", "n", "keys", "prefix"])

    heard = ex.answer(d.groupBy("bucket").applyInArrow(ask, keyed.ASK))
    every = materialize(d.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(finish, "id long, n long, keys binary, prefix binary"))
    left = every.where("keys is not null and id is not null")
    ids = left.select("id", "n", F.xxhash64("keys").alias("h1"), F.xxhash64("keys", F.lit(1)).alias("h2"))
    reps = ids.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    reps = materialize(reps)
    copies = materialize(ids.join(reps.drop("n"), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst")).distinct())
    blocks = components(_ties(left))
    # Sizes by block, of one document for each distinct set.
    member = materialize(reps.select(F.col("rep").alias("node"), "n").join(blocks, "node").select(F.col("node").alias("id"), "n", F.col("component").alias("block")))
    size = member.groupBy("block").agg(F.sum("n").alias("all"), F.count("*").alias("docs"))
    size = materialize(size.where("docs > 1").withColumn("chunks", F.ceil(F.col("all") / lot)))
    lots = max(1, -(-(size.where("chunks = 1").agg(F.sum("all")).first()[0] or 0) // lot)) * 2
    plan = member.join(size, "block").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    name = lambda: F.when(F.col("chunks") == 1, F.concat_ws(":", F.lit("lot"), F.pmod(F.xxhash64("block"), F.lit(int(lots))))).otherwise(F.concat_ws(":", "block", "chunk")).alias("lot")
    plan = materialize(plan.select("id", "block", "chunks", "chunk"))
    cut = plan.where("chunks > 1")
    deal = plan.select("id", "block", F.lit(False).alias("foreign"), name())
    big = not cut.isEmpty()
    if big:
        pivots = cut.where("chunk < 8").groupBy("block", "chunk", "chunks").agg(F.min("id").alias("id")).withColumnRenamed("chunk", "home")
        pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).where("chunk <> home")
        deal = deal.union(pivots.select("id", "block", F.lit(False), name()))
    found = materialize(_trees(left, deal, num, den).union(copies))
    labels = components(found)
    if big:
        main = materialize(cut.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))
        most = main.groupBy("block", "label").agg(F.count("*").alias("c")).groupBy("block").agg(F.max_by("label", F.struct("c", "label")).alias("most"))
        outside = main.join(most, "block").where("label <> most")
        groups = materialize(_groups(left, main, lot))
        visits = outside.groupBy("block").agg(F.sum("chunks").alias("visits"))
        works = groups.groupBy("block").agg(F.sum(F.col("size") * F.col("parts")).alias("works"))
        ways = materialize(visits.join(works, "block").select("block", (F.col("visits") <= F.col("works") if way is None else F.lit(way == "visits")).alias("visit")))
        outside = outside.join(ways.where("visit"), "block").withColumnRenamed("chunk", "home")
        outside = outside.withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).where("chunk <> home")
        deal = main.join(ways.where("visit"), "block").select("id", "block", F.lit(False).alias("foreign"), name(), "label").union(outside.select("id", "block", F.lit(True), name(), "label"))
        deal = deal.union(_by_groups(left, main, groups.join(ways.where("not visit"), "block"), lot))
        labels = components(materialize(_trees(left, deal, num, den)).union(found))
    kind = docs.schema[id_col].dataType
    out = every.select("id", F.col("n").alias("n_shingles")).join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id"))


def _ties(left: DataFrame) -> DataFrame:
    """Edges (src, dst) that tie each document to the least one with a prefix shingle in common.

    A batch ties its own documents first and sends one document for each shingle: a shingle of very many documents
    is a row a batch.
    """
    schema = pa.schema([("key", pa.int64()), ("src", pa.int64()), ("dst", pa.int64())])

    def local(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
            if not sets:
                continue
            keys, low, ties = least(np.concatenate(sets), batch.column("id").to_numpy().repeat([len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(low), pa.nulls(len(keys), pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ties[0]), pa.int64()), pa.array(ties[0]), pa.array(ties[1])], schema=schema)

    sent = materialize(left.select("id", "prefix").mapInArrow(local, "key long, src long, dst long"))
    across = sent.where("key is not null").select(F.min("src").over(Window.partitionBy("key")).alias("src"), F.col("src").alias("dst")).where("src <> dst")
    return across.distinct().union(sent.where("key is null").select("src", "dst"))


def _held(left: DataFrame, main: DataFrame) -> DataFrame:
    """(key, id, block, label, n) for each prefix shingle of the documents of main."""

    def explode(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
            at = pa.array(np.arange(len(sets)).repeat([len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])), *(b.column(c).take(at) for c in ("id", "block", "label", "n"))], ["key", "id", "block", "label", "n"])

    return left.join(main.select("id", "block", "label"), "id").select("prefix", "id", "block", "label", "n").mapInArrow(explode, "key long, id long, block long, label long, n long")


def _groups(left: DataFrame, main: DataFrame, lot: int) -> DataFrame:
    """(block, key, size, parts) of each prefix shingle whose documents are not one component, once for each set of documents."""
    sums = [F.count("*").alias("size"), F.sum("n").alias("all"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2")]
    g = _held(left, main).groupBy("block", "key").agg(*sums).where("low <> high")
    return g.groupBy("block", "size", "all", "h1", "h2").agg(F.min("key").alias("key")).select("block", "key", "size", F.ceil(F.col("all") / lot).alias("parts"))


def _by_groups(left: DataFrame, main: DataFrame, groups: DataFrame, lot: int) -> DataFrame:
    """Documents dealt by group; one of more than lot shingles is cut in parts, and each pair of these is a task."""
    rows = _held(left, main).join(groups.select("block", "key", "parts"), ["block", "key"])
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    task = F.concat_ws(":", F.lit("group"), "key", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.select("id", F.col("key").alias("block"), F.lit(False).alias("foreign"), task.alias("lot"), "label")


def least(keys: np.ndarray, ids: np.ndarray):
    """Distinct sorted keys, the least id of each, and distinct (least, id) pairs of different ids under one key."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    low = i[np.nonzero(first)[0]]
    mine = low[np.cumsum(first) - 1] if len(k) else low
    other = mine != i
    pairs = np.unique(np.stack([mine[other], i[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return k[first], low, (np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))


def _trees(left: DataFrame, deal: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst): links found by the signature trees of each lot's blocks; documents of one label are linked already."""

    def work(t: pa.Table) -> pa.Table:
        block, ids = t["block"].to_numpy(), t["id"].to_numpy()
        labels = t["label"].to_numpy()
        foreign, raw = t["foreign"].to_numpy(zero_copy_only=False).astype(bool), t["keys"]
        src, dst = [], []
        order = np.lexsort((ids, block))
        for part in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1):
            if len(part) > 1:
                tree = Tree([np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in part], num, den)
                known = {}
                for k, label in enumerate(labels[part].tolist()):
                    tree.union.join(k, known.setdefault(label, k))
                for a, b in tree.join(foreign[part] if foreign[part].any() else None):
                    src.append(ids[part[a]]), dst.append(ids[part[b]])
        return pa.Table.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    deal = deal if "label" in deal.columns else deal.withColumn("label", F.col("id"))
    rows = left.select("id", "keys").join(deal, "id").select("lot", "block", "id", "foreign", "label", "keys")
    return rows.groupBy("lot").applyInArrow(work, "src long, dst long")


def op9(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)
