"""Near-duplicates by a chosen-path set similarity join over MinHash values.

Documents are sets of word shingles. Equal sets are one class, represented by the
smallest doc_id. Classes descend independent trees: a tree's root splits them by
one of its minwise tokens; a node of more than `leaf` classes or `bound` shingles
branches on two more minwise tokens, so that a pair of similarity 0.8 or more
survives any depth with a probability of 0.75 a tree, and the number of trees
follows from the target recall. Nodes are told by a hash of their path, counted,
and branched level by level in Spark; only large nodes take part in the next
level.

A small node is first split by its members' counts of shingles in a few bins: the
counts of two sets differ in all by at most the shingles that one of them alone
has, and so tell most members that only share a minwise token apart from all others
without their texts, and never two that link. Of groups with the same members one
is kept.

Groups are compared exhaustively on full shingle sets. In a group, members that
share no token among the rarest ones, of which two similar sets must share one, are
told apart first; of the others a pivot is compared with all, and, by the triangle
inequality of Jaccard distance, only members near enough to the pivot's matches are
compared with these. What comes out is a spanning set of links of each group's
components, never all pairs, so that a group of copies costs as much as it has
members.

A large node is first compared, in blocks of about `bound`, with one pivot. What
links with it are its hosts, one component, which go no further. Others that the
triangle inequality lets link with a host are guests: each block of a node's guests
is compared with each block of its hosts. All but the hosts branch on, and so each
level costs two comparisons, whatever the data. What is still large at the last
level is compared two blocks at a time. No node, partner or candidate that could
link is dropped.

Texts are read twice: once for the roots' tokens, once for the candidates' sets,
which are shuffled once and kept by id for all comparisons and branches.
Links become components by label propagation (see components).

Nulls: a null text, or one without words, has an empty set, links with nothing and
is kept. A null doc_id links with nothing, has a null component and is kept. Rows
of one doc_id are one document, whose texts are linked. doc_ids are integers. An
empty table gives an empty result; other columns of docs are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from ._words import map_texts, mix, separators, shingles, texts
from .components import components

SIMILARITY = 0.8
RECALL = 0.99999
DEPTH = 5
BRANCH = 2
LEAF = 4096
BOUND = 1 << 21
#: Nodes of fewer members are compared at once, without looking for rare tokens.
FEW = 24
#: Bins of the shingle counts that split small nodes; a count is kept modulo 16.
BINS = 128


def trees_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Trees that find a pair of this similarity with probability recall at the greatest depth."""
    g = 1.0
    for _ in range(DEPTH):
        g = 1 - (1 - similarity * g) ** BRANCH
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * g))


def _binned(x: np.ndarray, size: np.ndarray) -> pa.Array:
    """Counts of each set's shingles (x, end to end) in BINS bins, modulo 16, two in a byte."""
    at = np.repeat(np.arange(len(size)), size) * BINS + (x & np.uint64(BINS - 1)).astype(np.int64)
    low = (np.bincount(at, minlength=len(size) * BINS) & 15).astype(np.uint8).reshape(-1, 2)
    packed = (low[:, 0] | low[:, 1] << 4).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS // 2), len(size), [None, pa.py_buffer(packed)]).cast(pa.binary())


def _sketcher(n: int, trees: int, level: int, fold: bool):
    """Set sizes, two checksums, and minwise tokens: one of each tree and the binned counts at level 0, else BRANCH of each."""
    seps = separators()
    count = trees * (BRANCH if level else 1)
    r = np.random.default_rng([20, level])
    mul = (r.integers(0, 1 << 31, count).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
    add = r.integers(0, 1 << 32, count).astype(np.uint32)

    def kernel(column):
        sizes, sums, xors, least, bins = [], [], [], [], []
        for t in texts(column, seps, fold):
            x, bounds = shingles(t, t.hashes(), n)
            size = np.diff(bounds)
            some = size > 0
            a, b, m = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64), np.zeros((len(size), count), np.uint32)
            if some.any():
                at = bounds[:-1][some]
                a[some] = np.add.reduceat(mix(x, 91), at)
                b[some] = np.bitwise_xor.reduceat(mix(x, 17), at)
                low = (x >> np.uint64(32)).astype(np.uint32)
                v = np.empty_like(low)
                for i in range(count):
                    np.multiply(low, mul[i], out=v)
                    v += add[i]
                    v ^= v >> np.uint32(15)
                    m[some, i] = np.minimum.reduceat(v, at)
            sizes.append(size)
            sums.append(a.view(np.int64))
            xors.append(b.view(np.int64))
            least.append(m.view(np.int32).ravel())
            if not level:
                bins.append(_binned(x, size))
        rows = sum(map(len, sizes))
        values = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * count), pa.array(np.concatenate(least)))
        out = [pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(sums)), pa.array(np.concatenate(xors)), values]
        return out if level else [*out, pa.concat_arrays(bins)]

    return kernel


SKETCH = {"n": "bigint", "sa": "bigint", "sb": "bigint", "mh": "array<int>"}
ROOT_SKETCH = SKETCH | {"bins": "binary"}


def may_link(n: np.ndarray, bins: np.ndarray, percent: int) -> list[np.ndarray]:
    """Members, in ascending order of their sizes n, in groups between which no two are linked; those that link with none are left out.

    Two linked sets differ in at most (100 - percent) / (100 + percent) of their sizes'
    sum; their counts, and so these modulo 16 on a circle, differ by no more in all.
    """
    counts = np.stack((bins & 15, bins >> 4), 2).reshape(len(n), -1)
    label, end = np.arange(len(n)), np.searchsorted(n * percent, n * 100, "right")
    for i in range(len(n) - 1):
        among = np.flatnonzero(label[i + 1 : end[i]] != label[i]) + i + 1
        d = (counts[among] - counts[i]) & 15
        apart = np.minimum(d, 16 - d).sum(1, dtype=np.uint16).astype(np.int64)
        met = label[among[(100 + percent) * apart <= (100 - percent) * (n[i] + n[among])]]
        if len(met):
            label[np.isin(label, met) | (label == label[i])] = min(met.min(), label[i])
    order = np.argsort(label, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    return [g for g in groups if len(g) > 1]


#: A group of a small node's members that may link; who and members tell equal ones.
GROUP = "key bigint, block bigint, id bigint, who bigint, members bigint"


def _splitter(similarity: float):
    """Rows (key, id, n, w, bins), a key's together by n, to rows of GROUP."""
    percent = round(similarity * 100)
    names = [c.split()[0] for c in GROUP.split(", ")]

    def node(key: int, t: pa.Table) -> Iterator[tuple]:
        ids, w, n = (t[c].to_numpy() for c in ("id", "w", "n"))
        bins = np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint8).reshape(len(n), -1)
        for block, g in enumerate(may_link(n, bins, percent)):
            same = np.ones(len(g), np.int64)
            yield same * key, same * block, ids[g], same * np.bitwise_xor.reduce(w[g]), same * len(g)

    def solved(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        key = t["key"].to_numpy()
        out = [x for lo, hi in zip(cuts[:-1], cuts[1:]) for x in node(key[lo], t.slice(lo, hi - lo))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            cuts = [0, *(np.flatnonzero(np.diff(t["key"].to_numpy())) + 1).tolist()]
            held = t.slice(cuts[-1])
            yield from solved(t, cuts)
        if held is not None and len(held):
            yield from solved(held, [0, len(held)])

    return run


class Sets:
    """Some members' shingle sets under small codes, for passes of one member against others."""

    def __init__(self, parts: list[np.ndarray]):
        self.size = np.array([len(p) for p in parts])
        values, codes = np.unique(np.concatenate(parts), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.bounds = np.concatenate(([0], np.cumsum(self.size)))
        self.flag = np.zeros(len(values), bool)

    def common(self, i: int, among: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of member i with those of the index array."""
        own = self.codes[self.bounds[i] : self.bounds[i + 1]]
        self.flag[own] = True
        if len(among) * 2 > len(self.size):
            out = np.add.reduceat(self.flag[self.codes], self.bounds[:-1], dtype=np.int64)[among]
        elif len(among):
            n = self.size[among]
            at = np.repeat(self.bounds[:-1][among] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out = np.add.reduceat(self.flag[self.codes[at]], np.cumsum(n) - n, dtype=np.int64)
        else:
            out = np.zeros(0, np.int64)
        self.flag[own] = False
        return out

    def near(self, i: int, among: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(linked with member i, Jaccard distance) of those of the index array."""
        inter = self.common(i, among)
        union = self.size[i] + self.size[among] - inter
        return 100 * inter >= percent * union, 1 - inter / union

    def apart(self, percent: int) -> list[np.ndarray]:
        """Members in groups between which no two are linked; members that link with none are left out.

        A set linked with another shares more than its size less percent of it with
        it, and so has one of its rarest tokens, that many and one more, in common with
        the other's: groups are what such tokens connect.
        """
        rare = np.empty(len(self.flag), np.int64)
        rare[np.argsort(np.bincount(self.codes, minlength=len(rare)), kind="stable")] = np.arange(len(rare))
        base = np.arange(len(self.size)) * len(rare)
        token = rare[self.codes] + np.repeat(base, self.size)
        token.sort()  # each member's, the rarest first
        length = self.size - -(-percent * self.size // 100) + 1
        owner = np.repeat(np.arange(len(length)), length)
        code = token[np.repeat(self.bounds[:-1] - (np.cumsum(length) - length), length) + np.arange(len(owner))] - base[owner]
        label = np.arange(len(self.size))
        while True:
            least = np.full(len(self.flag), len(label))
            np.minimum.at(least, code, label[owner])
            new = label.copy()
            np.minimum.at(new, owner, least[code])
            new = new[new]
            if (new == label).all():
                break
            label = new
        order = np.argsort(label, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        return [g for g in groups if len(g) > 1]


def roots_of(sets: Sets, similarity: float) -> np.ndarray:
    """Each member's component root (a member)."""
    n, percent = len(sets.size), round(similarity * 100)
    root = np.arange(n)
    done = np.zeros(n, bool)

    def component(p: int, left: np.ndarray) -> np.ndarray:
        """Root what is p's component to p; the members of left that are not."""
        done[p] = True
        linked, d = sets.near(p, left, percent)
        core, far = np.concatenate(([p], left[linked])), left[~linked]
        root[core], done[core] = p, True
        if not linked.any():
            return far
        for u in far[d[~linked] <= 1 - similarity + d[linked].max() + 1e-9]:
            if not done[u] and sets.near(u, core, percent)[0].any():
                root[u], done[u], queue = p, True, [u]
                while queue:  # followed in full, as it may link beyond the pivot's reach
                    v, rest = queue.pop(), far[~done[far]]
                    more = rest[sets.near(v, rest, percent)[0]]
                    root[more], done[more] = p, True
                    queue += list(more)
        return far[~done[far]]

    for left in sets.apart(percent) if n > FEW else [root.copy()]:
        while len(left) > 1:
            left = component(left[0], left[1:])
    return root


#: What a solver's rows hold besides their member's text.
MEMBER = "key bigint, block bigint, side int, id bigint, tree int, n bigint, w bigint, alt int"


def _solver(n: int, similarity: float, fold: bool, kind: str):
    """Rows of MEMBER and text, a group's (key, block) together by side, to rows of MEMBER and root, d.

    kind "pivot": side 0 is the one pivot; each of side 1 has a row with root, the
    pivot or itself, and its distance. "hosts": each of side 1 that links with one of
    side 0 has a row with that one as root. "all": members that are not their
    component's root have a row.
    """
    seps, percent = separators(), round(similarity * 100)
    schema = pa.schema([(c.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in MEMBER.split(", ")] + [("root", pa.int64()), ("d", pa.float64())])

    def solved(rows: list[tuple], parts: list[np.ndarray]) -> Iterator[tuple]:
        split = sum(r[2] == 0 for r in rows)
        if len(rows) < 2 or kind != "all" and not 0 < split < len(rows):
            return
        sets = Sets(parts)
        if kind == "pivot":
            linked, d = sets.near(0, np.arange(split, len(rows)), percent)
            for r, near, far in zip(rows[split:], linked, d):
                yield *r, rows[0][3] if near else r[3], float(far)
        elif kind == "hosts":
            for g in sets.apart(percent):
                hosts = g[g < split]
                for i in g[g >= split] if len(hosts) else ():
                    linked, d = sets.near(i, hosts, percent)
                    if linked.any():
                        k = int(np.flatnonzero(linked)[0])
                        yield *rows[i], rows[hosts[k]][3], float(d[k])
        else:
            for i, p in enumerate(roots_of(sets, similarity)):
                if p != i:
                    yield *rows[i], rows[p][3], 0.0

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], schema=schema)

    def run(batches):
        now, rows, parts, out = None, [], [], []
        for b in batches:
            own = list(zip(*(b.column(i).to_pylist() for i in range(len(schema) - 2))))
            for t in texts(b.column(len(schema) - 2), seps, fold):
                x, bounds = shingles(t, t.hashes(), n)
                for i in range(len(t.counts)):
                    r = own[t.first + i]
                    if r[:2] != now:
                        out += solved(rows, parts)
                        now, rows, parts = r[:2], [], []
                        if len(out) >= 20_000:
                            yield batch(out)
                            out = []
                    if bounds[i + 1] > bounds[i]:
                        rows.append(r)
                        parts.append(x[bounds[i] : bounds[i + 1]].copy())
        out += solved(rows, parts)
        if out:
            yield batch(out)

    return run


class Join:
    """The similarity join of the classes reps (n, sa, sb, rep, mh, bins), whose texts are in docs (doc_id, text)."""

    def __init__(self, reps: DataFrame, docs: DataFrame, s: Scratch, shingle: int, similarity: float, recall: float, fold: bool, leaf: int, bound: int):
        self.reps, self.docs, self.s, self.shingle, self.similarity, self.fold, self.leaf, self.bound = reps, docs, s, shingle, similarity, fold, leaf, bound
        self.trees = trees_for(recall, similarity)
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.found: list[DataFrame] = []

    def compare(self, members: DataFrame, kind: str, name: str) -> DataFrame:
        """Solve the groups of members (MEMBER); the links go to found."""
        full = members.join(self.texts, F.col("id") == F.col("doc_id")).select(*(c.split()[0] for c in MEMBER.split(", ")), "text")
        dealt = full.repartition(self.parts, "key", "block").sortWithinPartitions("key", "block", "side", "id")
        out = self.s.written(dealt.mapInArrow(_solver(self.shingle, self.similarity, self.fold, kind), MEMBER + ", root bigint, d double"), name)
        self.found.append(out.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        return out

    def links(self) -> DataFrame:
        """(a, b): a spanning set of the links between classes."""
        tree = F.sequence(F.lit(0), F.lit(self.trees - 1))
        token = lambda t: F.get("mh", t % self.trees)
        roots = F.transform(tree, lambda t: F.struct(t.alias("tree"), F.xxhash64(t, token(t)).alias("key"), token(t + 1).alias("alt")))
        rows = self.s.written(self.reps.select(F.col("rep").cast("bigint").alias("id"), "n", F.xxhash64("rep", "sa", "sb").alias("w"), F.explode(roots).alias("r")).select("r.key", "id", "r.tree", "n", "w", "r.alt"), "nodes")
        small = []
        for level in range(1, DEPTH + 2):
            counts = self.s.written(rows.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor("w").alias("who"), F.sum("n").alias("sum")).where("members > 1"), "counts")
            large = (F.col("members") > self.leaf) | (F.col("sum") > self.bound)
            small.append(self.split(rows.join(counts.where(~large), "key", "left_semi")))
            big = counts.where(large).select("key", F.ceil(F.col("sum") / self.bound).alias("blocks"))
            none = big.isEmpty()
            if level == 1:
                ids = small[0].select("id")
                self._fetch((ids if none else ids.unionByName(rows.join(big, "key", "left_semi").select("id"))).distinct())
            if none:
                break
            rest = self.settle(rows.join(big, "key"))
            if level > DEPTH:
                self.by_blocks(rest)
                break
            rows = self.s.written(self.branch(rest, level), "nodes")
        self.nodes(small)
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out

    def _fetch(self, candidates: DataFrame) -> None:
        """Candidates' texts, shuffled once and kept by id, so that no comparison shuffles them by id again."""
        wanted = self.docs.repartition(self.parts, "doc_id").join(candidates.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        self.texts = self.s.bucketed(wanted.dropDuplicates(["doc_id", "text"]), "near_texts", self.parts, "doc_id")

    def split(self, rows: DataFrame) -> DataFrame:
        """Small nodes' members in groups (GROUP) that may link."""
        bins = self.reps.select(F.col("rep").cast("bigint").alias("id"), "bins")
        full = rows.select("key", "id", "n", "w").join(bins, "id").select("key", "id", "n", "w", "bins")
        dealt = full.repartition(self.parts, "key").sortWithinPartitions("key", "n", "id")
        return self.s.written(dealt.mapInArrow(_splitter(self.similarity), GROUP), "groups")

    def settle(self, big: DataFrame) -> DataFrame:
        """Compare large nodes' members with a pivot each, and those that may link with what it links with; returns the others' rows.

        The pivot is a member of the node's largest group by a minwise token that its path doesn't use.
        """
        groups = big.groupBy("key", "blocks", "alt").agg(F.count("*").alias("size"), F.min_by("id", F.xxhash64("key", "id")).alias("lead"))
        leads = groups.groupBy("key", "blocks").agg(F.max_by("lead", F.struct("size", "alt")).alias("id"))
        none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in MEMBER.split(", ")[4:])]
        pivots = leads.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "id", *none)
        members = big.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(1).alias("side"), "id", "tree", "n", "w", "alt")
        state = self.compare(pivots.unionByName(members), "pivot", "pivots")
        host = (F.col("id") != F.col("root")) | (F.col("d") == 0)
        hosts, rest = state.where(host), state.where(~host)
        sums = lambda rows, name: rows.groupBy("key").agg(F.ceil(2 * F.sum("n") / self.bound).alias(name))
        several = sums(hosts.where("id <> root"), "hb")
        guests = rest.where(F.col("d") <= 2 * (1 - self.similarity) + 1e-9)
        both = self.s.written(several.join(sums(guests, "gb"), "key"), "met")
        if not both.isEmpty():
            own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n))
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            placed = lambda rows, side, a, b: rows.drop("block", "side").join(both, "key").withColumn("hx", a).withColumn("gx", b).select("key", (F.col("hx") * F.col("gb") + F.col("gx")).alias("block"), F.lit(side).alias("side"), "id", "tree", "n", "w", "alt")
            self.compare(placed(hosts, 0, own("hb"), every("gb")).unionByName(placed(guests, 1, every("hb"), own("gb"))), "hosts", "guests")
        return rest.select("key", "id", "tree", "n", "w", "alt")

    def branch(self, rest: DataFrame, level: int) -> DataFrame:
        """Children of the nodes of rest by two more minwise tokens each, which are computed from the members' texts."""
        own = rest.groupBy("id", "n", "w").agg(F.collect_list(F.struct("tree", "key")).alias("nodes"))  # at most trees * BRANCH ** level
        full = own.join(self.texts, F.col("id") == F.col("doc_id")).select("id", F.col("n").alias("own_n"), "w", "nodes", "text")
        like = (self.shingle, self.trees, level, self.fold)
        made = map_texts(full, lambda: _sketcher(*like), SKETCH, carry=["id", "own_n", "w", "nodes"]).where("n = own_n")
        at = lambda x, i: F.get("mh", x["tree"] * BRANCH + i)
        child = lambda x, i: F.struct(x["tree"].alias("tree"), F.xxhash64(x["key"], F.lit(i), at(x, i)).alias("key"), at(x, BRANCH - 1 - i).alias("alt"))
        children = F.flatten(F.transform("nodes", lambda x: F.array(*(child(x, i) for i in range(BRANCH)))))
        return made.select("id", "n", "w", F.explode(children).alias("r")).select("r.key", "id", "r.tree", "n", "w", "r.alt")

    def by_blocks(self, rest: DataFrame) -> None:
        """Compare what large nodes of the last level still hold, every two blocks of a node."""
        size = rest.groupBy("key").agg(F.ceil(2 * F.sum("n") / self.bound).alias("halves"))
        rest = rest.join(size, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("halves")))
        other = F.explode(F.sequence(F.lit(0), F.col("halves") - 1))
        pairs = rest.withColumn("other", other).where((F.col("halves") == 1) | (F.col("own") != F.col("other")))
        self.compare(pairs.select("key", (F.least("own", "other") * F.col("halves") + F.greatest("own", "other")).alias("block"), F.lit(1).alias("side"), "id", "tree", "n", "w", "alt"), "all", "blocks")

    def nodes(self, small: list[DataFrame]) -> None:
        """Compare the small nodes' groups (GROUP), one for each set of members."""
        every = small[0]
        for more in small[1:]:
            every = every.unionByName(more)
        chosen = every.groupBy("who", "members").agg(F.min(F.struct("key", "block")).alias("one")).select("one.*")
        none = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in MEMBER.split(", ")[4:])]
        self.compare(every.join(chosen, ["key", "block"], "left_semi").select("key", "block", F.lit(1).alias("side"), "id", *none), "all", "compared")


def own_links(sketch: DataFrame, reps: DataFrame, s: Scratch) -> DataFrame:
    """(a, b): links between the representatives of all classes that one doc_id's rows belong to.

    Only doc_ids of several rows are shuffled with their classes.
    """
    valid = sketch.where("n > 0 and doc_id is not null").select("doc_id", "n", "sa", "sb")
    several = valid.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    classes = valid.join(several, "doc_id", "left_semi").distinct().join(reps.select("n", "sa", "sb", "rep"), ["n", "sa", "sb"])
    held = s.written(classes.select("doc_id", "rep"), "owned")
    first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = SIMILARITY, recall: float = RECALL, fold: bool = True, leaf: int = LEAF, bound: int = BOUND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; kept marks each group's smallest doc_id."""
    trees = trees_for(recall, similarity)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as s:
        sketch = s.written(map_texts(base, lambda: _sketcher(shingle, trees, 0, fold), ROOT_SKETCH, carry=["doc_id"]), "sketch", keep=True)
        reps = s.written(sketch.where("n > 0 and doc_id is not null").groupBy("n", "sa", "sb").agg(F.min("doc_id").alias("rep"), F.min_by("mh", "doc_id").alias("mh"), F.min_by("bins", "doc_id").alias("bins")), "reps", keep=True)
        join = Join(reps, base, s, shingle, similarity, recall, fold, leaf, bound)
        label = s.written(components(join.links().unionByName(own_links(sketch, reps, s)), s), "label", keep=True)
    group = reps.select("n", "sa", "sb", "rep").join(label, F.col("rep") == F.col("v"), "left").select("n", "sa", "sb", F.coalesce("label", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n", "sa", "sb").join(group, ["n", "sa", "sb"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
