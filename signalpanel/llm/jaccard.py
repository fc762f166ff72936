"""N-gram Jaccard join with a prefix tree.

Each text is the set of its word n-grams; two texts link where
100 |x and y| >= percent |x or y|. The join is exact and returns the components of the
links, never pairs.

1. One counting exchange gives every n-gram the number of documents that hold it
   (hashed to 32 bits within a bucket, so it may be too high, never too low). It defines
   the global order: rare n-grams first, ties by hash. A text of which fewer than
   `percent` of a hundred n-grams occur elsewhere can link with nothing and is done.
2. Equal sets become one node. Two sets that link share one of their first
   n - ceil(percent n / 100) + 1 n-grams (prefix filter). Every such n-gram hooks its
   nodes to the smallest of them; the components of these hooks are *groups*, and
   nodes of different groups cannot link.
3. A group is joined in one task by a prefix tree: its sets, frequent n-grams first, share
   the paths of equal beginnings. A set is looked up by walking the tree with the overlap
   counted so far; a subtree is left where overlap plus what remains of the set and of the
   subtree's longest set cannot reach the bound for the subtree's shortest set, and where
   all of its sets are known to be in the component of the one that is looked up.
4. A group of more than `limit` nodes is split. Each node is compared with the group's most
   typical one, whose n-grams are the most frequent on average: of a family of near copies that
   is the text they come from. Those that link with it are one component already. The others
   are looked up, at most `limit` at once, in blocks of at most `limit` nodes that together
   hold the whole group, so nothing is lost and no task holds more than two blocks.
5. Components of all links found.

Words are runs of bytes other than white space, A-Z lower-cased; a text of fewer words
than n is one n-gram of all its words; texts without words and null texts are empty and
link with nothing. Component ids are the smallest doc_id of a component (nulls only
where there is no other); rows of equal id are documents of their own; an empty table
gives no rows; further columns are ignored. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SETS = "doc_id long, n_shingles long, key long, grams binary, ranks binary, typical double, digest long"


class Sets:
    """Distinct n-grams of each document of a chunk, ordered by document and hash."""

    def __init__(self, c: C.Chunk, n: int):
        w = C.Words(c, lower=True)
        gram, ok = w.grams(n)
        doc = w.doc[ok]
        gram = gram[ok]
        words = np.diff(w.first)
        short = np.flatnonzero((words > 0) & (words < n))
        if len(short):
            doc = np.concatenate([doc, short])
            gram = np.concatenate([gram, C.span_hashes(w.hash, w.first[short], w.first[short + 1])])
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        self.doc, self.gram = doc[new], gram[new]
        self.cut = np.searchsorted(self.doc, np.arange(len(c) + 1))

    def request(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.gram, return_counts=True)


def need(x: int, y: int, percent: int) -> int:
    """The least overlap at which sets of x and y members link."""
    return -(-percent * (x + y) // (100 + percent))


def least(x: int, percent: int) -> int:
    """The least size of a set that links with one of x members, and the least overlap with any."""
    return -(-percent * x // 100)


class Node:
    __slots__ = ("seg", "members", "kids", "short", "longest", "owner", "ends")

    def __init__(self, seg, size, length, owner):
        self.seg, self.members, self.kids = seg, frozenset(seg), {}
        self.short, self.longest, self.owner, self.ends = size, length, owner, []


class Tree:
    """A prefix tree of sets (ascending lists of ranks) whose links are found while their components grow."""

    def __init__(self, percent: int):
        self.percent, self.top, self.parent, self.sizes = percent, Node([], 1 << 60, 0, None), {}, {}

    def find(self, v):
        parent = self.parent
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def link(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def insert(self, name, ranks: list[int], size: int) -> None:
        """size counts members beyond `ranks` too: those that no other set has."""
        node, at, total = self.top, 0, len(ranks)
        while True:
            node.short, node.longest = min(node.short, size), max(node.longest, total)
            if node.owner is not None and self.find(node.owner) != self.find(name):
                node.owner = None
            if at == total:
                node.ends.append((name, size))
                return
            kid = node.kids.get(ranks[at])
            if kid is None:
                kid = node.kids[ranks[at]] = Node(ranks[at:], size, total, name)
                kid.ends.append((name, size))
                return
            seg = kid.seg
            same = len(seg)
            if ranks[at : at + same] != seg:
                same = next(i for i, (a, b) in enumerate(zip(seg, [*ranks[at : at + same], None])) if a != b)
                upper = Node(seg[:same], kid.short, kid.longest, kid.owner)
                kid.seg, kid.members = seg[same:], frozenset(seg[same:])
                upper.kids[kid.seg[0]] = kid
                node.kids[ranks[at]] = kid = upper
            node, at = kid, at + same

    def links(self, name, ranks: list[int], size: int):
        """Yields a set that links with the one given, for every component of such sets but its own."""
        own, percent = set(ranks), self.percent
        low = least(size, percent)
        high = size * 100 // percent
        stack = [(kid, 0, 0) for kid in self.top.kids.values()]
        mine = self.find(name)
        while stack:
            node, overlap, depth = stack.pop()
            if node.short > high or (node.owner is not None and self.find(node.owner) == mine):
                continue
            overlap += len(own & node.members)
            depth += len(node.seg)
            rest = min(len(ranks) - bisect_right(ranks, node.seg[-1]), node.longest - depth)
            if overlap + rest < need(size, max(low, node.short), percent):
                continue
            for other, other_size in node.ends:
                if low <= other_size <= high and overlap >= need(size, other_size, percent) and self.link(name, other):
                    yield other
                    mine = self.find(name)
            stack.extend((kid, overlap, depth) for kid in node.kids.values())


def _ranked(grams: list[np.ndarray], ranks: list[np.ndarray]) -> list[list[int]]:
    """Each set as ascending numbers in the global order, frequent n-grams first."""
    gram, cls = np.concatenate(grams), np.concatenate(ranks)
    order = np.lexsort((gram, 255 - cls.astype(np.int64)))
    new = np.ones(len(gram), np.int64)
    new[1:] = gram[order][1:] != gram[order][:-1]
    number = np.empty(len(gram), np.int64)
    number[order] = np.cumsum(new) - 1
    return [sorted(x.tolist()) for x in np.split(number, np.cumsum([len(g) for g in grams])[:-1])]


EDGES = "a long, b long"


def _join_group(percent: int):
    def run(t: pa.Table) -> pa.Table:
        """Links of one block: `member` rows are in the tree, `asks` rows are looked up."""
        key, size = t.column("key").to_pylist(), t.column("n_shingles").to_pylist()
        member, asks, start = (t.column(c).to_pylist() for c in ("member", "asks", "start"))
        sets = _ranked([np.frombuffer(x.as_py(), C.U64) for x in t.column("grams")], [np.frombuffer(x.as_py(), np.uint8) for x in t.column("ranks")])
        tree, a, b = Tree(percent), [], []
        for k, s in zip(key, start):
            tree.parent.setdefault(k, k)
            tree.parent.setdefault(s, s)
        for k, s in zip(key, start):
            tree.link(k, s)
        # those that only stand in the tree first; then by set, so that neighbours meet early
        order = sorted(range(len(key)), key=lambda i: (asks[i], not member[i], sets[i]))
        for i in order:
            if asks[i]:
                for other in tree.links(key[i], sets[i], size[i]):
                    a.append(key[i])
                    b.append(other)
            if member[i]:
                tree.insert(key[i], sets[i], size[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets(df: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, key of its set (null: empty), Spark's xxhash64 of the text, and, of texts that can link with another set, the n-grams that
    occur in two documents or more (rare first) and their frequency classes."""
    n_buckets = C.buckets(df.sparkSession)
    chunks = C.pack(df, id_col, text_col)

    def ask(batches):
        for c in C.each_chunk(batches):
            yield C.request_rows(c.chunk, *Sets(c, n).request(), n_buckets, narrow=True)

    def finish(c, replies):
        s = Sets(c, n)
        keys, inverse = np.unique(s.gram, return_inverse=True)
        count = C.read_reply(replies, keys, n_buckets)[inverse]
        cls = np.ceil(np.log2(np.maximum(count, 1)) * 4).astype(np.uint8)
        size = np.diff(s.cut)
        name = np.zeros(len(size), C.U64)
        full = np.flatnonzero(size)
        if len(full):
            name[full] = C.mix(np.add.reduceat(C.mix(s.gram), s.cut[full]) + size[full].astype(C.U64))
        total = np.concatenate([[0], np.cumsum(cls, dtype=np.int64)])[s.cut]
        grams, ranks = [], []
        for lo, hi in zip(s.cut[:-1], s.cut[1:]):
            many = np.flatnonzero(count[lo:hi] > 1) + lo
            if hi == lo or len(many) < least(hi - lo, percent):
                grams.append(None)
                ranks.append(None)
                continue
            many = many[np.argsort(cls[many], kind="stable")]  # by class; hashes ascend already
            grams.append(s.gram[many].tobytes())
            ranks.append(cls[many].tobytes())
        return pa.table({
            "doc_id": C.id_array(c.ids), "n_shingles": pa.array(size.astype(np.int64)), "key": pa.array(name.view(np.int64), mask=size == 0),
            "grams": pa.array(grams, pa.binary()), "ranks": pa.array(ranks, pa.binary()),
            "typical": pa.array(np.diff(total) / np.maximum(size, 1)),
            "digest": pa.array(np.array([xxhash.xxh64_intdigest(c.text(i), 42) for i in range(len(c))], C.U64).view(np.int64)),
        })

    replies = C.exchange_counts(chunks.mapInArrow(ask, C.REQUEST), narrow=True)
    return C.with_replies(chunks, replies, finish, SETS)


def set_links(nodes: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between distinct sets that connect exactly the sets that Jaccard links connect."""

    def prefix(batches):
        for batch in batches:
            key, gram = [], []
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "n_shingles", "grams"))):
                g = np.frombuffer(raw, np.int64)
                g = g[: max(0, n - least(n, percent) + 1 - (n - len(g)))]  # n-grams of this document alone come first
                key.append(np.full(len(g), k))
                gram.append(g)
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gram)), pa.array(np.concatenate(key).astype(np.int64))], ["gram", "key"])

    postings = C.saved(nodes.select("key", "n_shingles", "grams").mapInArrow(prefix, "gram long, key long"))
    first = postings.groupBy("gram").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    hooks = postings.join(first, "gram").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    group = C.saved(components(hooks).withColumnRenamed("component", "grp"))
    sizes = group.groupBy("grp").agg(F.count("*").alias("size"))
    rows = nodes.join(group.join(sizes, "grp"), nodes["key"] == group["node"]).drop("node")
    small = rows.where(F.col("size") <= limit).withColumn("start", F.col("key")).withColumn("asks", F.lit(True)).withColumn("block", F.lit(0))

    large = C.saved(rows.where(F.col("size") > limit))
    # the group's most typical set, to every node of the group: a join, not one task
    head = large.groupBy("grp").agg(F.min_by(F.struct("key", "n_shingles", "grams"), F.struct(-F.col("typical"), "key")).alias("head"))

    def beside_head(batches):
        for batch in batches:
            linked = []
            for n, raw, h in zip(*(batch.column(c).to_pylist() for c in ("n_shingles", "grams", "head"))):
                both = len(np.intersect1d(np.frombuffer(raw, C.U64), np.frombuffer(h["grams"], C.U64), assume_unique=True))
                linked.append(both >= need(n, h["n_shingles"], percent))
            start = [h["key"] if hit else k for k, h, hit in zip(batch.column("key").to_pylist(), batch.column("head").to_pylist(), linked)]
            names = ["key", "n_shingles", "grams", "ranks", "grp", "size"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(start, pa.int64()), pa.array([not hit for hit in linked], pa.bool_())], [*names, "start", "asks"])

    schema = "key long, n_shingles long, grams binary, ranks binary, grp long, size long, start long, asks boolean"
    large = large.join(head, "grp").select("key", "n_shingles", "grams", "ranks", "grp", "size", "head").mapInArrow(beside_head, schema)
    large = C.saved(large)
    asking = large.where("asks").groupBy("grp").agg(F.ceil(F.count("*") / limit).cast("int").alias("askers"))
    dealt = large.join(asking, "grp").withColumns({"blocks": F.ceil(F.col("size") / limit).cast("int")})  # groups without askers are done
    of = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "block", "asker", "key", "n_shingles", "grams", "ranks", "start", "asks", "member"]
    members = dealt.withColumns({"block": of("blocks", 1), "asker": every("askers"), "asks": F.lit(False), "member": F.lit(True)})
    askers = dealt.where("asks").withColumns({"block": every("blocks"), "asker": of("askers", 2), "member": F.lit(False)})
    dealt = small.withColumns({"asker": F.lit(0), "member": F.lit(True)}).select(columns).unionByName(members.select(columns)).unionByName(askers.select(columns))
    found = dealt.groupBy("grp", "block", "asker").applyInArrow(_join_group(percent), EDGES)
    return found.unionByName(large.where("start <> key").select(F.col("key").alias("a"), F.col("start").alias("b")))


def _named(df: DataFrame, n: int, percent: int, limit: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows, and key, component of every set."""
    sets = C.saved(_sets(df, n, percent, id_col, text_col))
    C.release(df.sparkSession)  # the packed texts and the exchange have served
    nodes = C.saved(sets.where("grams IS NOT NULL").select("key", "n_shingles", "grams", "ranks", "typical").dropDuplicates(["key"]))
    linked = components(C.saved(set_links(nodes, percent, limit)))
    keys = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"))
    return sets, keys.join(linked, keys["key"] == linked["node"], "left").withColumn("component", F.coalesce("component", "key"))


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 75, limit: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets, by_set = _named(df, n, percent, limit, id_col, text_col)
    by_component = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
    names = by_set.select("key", "component").join(by_component, "component").select("key", "component_id")
    out = sets.select("doc_id", "n_shingles", "key").join(names, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, percent: int = 75, limit: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: of each component the one of smallest id (nulls last), then smallest hash of the text; texts
    without words stay; rows equal in id and text stay once."""
    sets, by_set = _named(df, n, percent, limit, id_col, text_col)
    first = by_set.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    stay = first.unionByName(sets.where("key IS NULL").select("doc_id", "digest")).select(F.col("doc_id").alias("__keep_id"), F.col("digest").alias("__keep_digest"))
    marked = df.withColumn("__keep_hash", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("__keep_hash") == F.col("__keep_digest"))
    return marked.join(stay, same, "left_semi").dropDuplicates([id_col, "__keep_hash"]).select(*df.columns)
