"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

The plan:

1. One pass over the texts makes each document's set size and a 128-bit digest of its set, and counts
   shingles. Documents with equal sets are one class.
2. A second pass leaves the frequent shingles (passages that many texts share) out of each class's set and
   cuts the rest into parts by hash range, some more than the shingles in which two linked sets of that
   size range can differ: linked sets agree on a known number of whole parts at least. Only the parts that
   several classes have are kept, each with its smallest class, the leader.
3. The sketch of a class is the list of its kept parts. Classes meet in groups of a common leader, where the
   product of the class by part incidence counts the parts that two classes share; pairs below their
   bound are dropped. What is left ties classes to candidate components, which are true clusters for most.
4. Components are cut by size band (a set can only reach sets whose size is at least threshold times its
   own) and, where a band with the next one has many shingles, into hash blocks. Each pair of blocks is one
   task group of bounded bytes. A group multiplies its incidence matrix with itself, row by row, drops
   partners below the size bounds, and keeps exact links: per class its degree and its root.
5. Roots and classes are joined to components over all groups.

Pairs never become rows, no group grows with a hot shingle or a large group of copies, and every pair
at or above the threshold is compared.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, id_text, release, release_memory, tidy, without, written
from .components import connected_components
from .textkernel import U, mix, runs, shingle_sets

#: Sets whose sizes are within this factor are cut into the same number of parts.
RANGE = 1.5
#: Linked sets agree on two parts and one more for each SURE shingles in which they may differ.
SURE = 8
#: Shingles of distinct sets that a task counts at a time ...
COUNTED = 2_000_000
#: ... those that so many sets have are reported ...
REPEATS = 4
#: ... and are frequent if so many reports add up, over all tasks.
FREQUENT = 12
#: The frequent shingles go to every task if there are at most this many (8 bytes each); beyond it the
#: rarest are left out, which costs time and no result: the parts may leave out any shingles.
MAX_FREQUENT = 400_000
#: Shingles of one block; a task group has two blocks of two size bands at most, some 60 MB with its product.
BLOCK = 400_000
#: A smaller set counts as so many there: no block has more than BLOCK / LEAST rows.
LEAST = 200
#: Sketches of one block of a leader's classes; a group has two blocks.
SKETCHES = 500
#: Rows of a sorted table that one sparse product takes at a time, if the group at their end is no longer.
ROWS = 20_000


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(width: int):
    """(kind 0: doc_id, n, d1, d2) per document and (kind 1: shingle, count) per shingle that repeats."""

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        keep = counts >= REPEATS
        m = int(keep.sum())
        return pa.record_batch({"kind": pa.array(np.ones(m, np.int32)), "doc_id": pa.nulls(m, pa.int64()), "key": pa.nulls(m, pa.int64()), "n": pa.array(counts[keep].astype(np.int64)), "d1": pa.array(values[keep].view(np.int64)), "d2": pa.array(np.zeros(m, np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for r in runs(batch.column(1)):
                n, digests = [], []
                for _, s in shingle_sets(r, width):
                    n.append(len(s))
                    d = _digest(s)
                    digests.append(d)
                    if d not in seen:
                        seen.add(d)
                        sets.append(s)
                        held += len(s)
                    if held >= COUNTED:
                        yield repeated(sets)
                        seen, sets, held = set(), [], 0
                d = np.array(digests, np.int64).reshape(-1, 2)
                yield pa.record_batch({"kind": pa.array(np.zeros(len(n), np.int32)), "doc_id": batch.column(0).slice(r.first, len(n)), "key": batch.column(2).slice(r.first, len(n)), "n": pa.array(n, pa.int64()), "d1": pa.array(d[:, 0]), "d2": pa.array(d[:, 1])})
        if held:
            yield repeated(sets)

    return run


def size_range(n: int) -> int:
    """The range k of a set size: RANGE ** k <= n < RANGE ** (k + 1)."""
    k = int(math.log(n) / math.log(RANGE))
    return k + 1 if RANGE ** (k + 1) <= n else k - 1 if RANGE**k > n else k


def parts_of(s: np.ndarray, rare: np.ndarray, k: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """Keys of the parts of a sorted set s, for pairs whose smaller set is in size range k, and a bound.

    Linked sets x and y, |x| <= |y|, have |y| <= |x| / t, so they differ in at most
    (1 - t) / (1 + t) * (|x| + |y|) <= (1 - t) / t * |x| shingles, and of that many parts and sure more they
    agree on sure at least. Leaving the same shingles out of all sets (rare: those of s that are not
    frequent) only makes them differ less. A part on which both are empty tells nothing: x with e empty
    parts shares sure - e keys at least, if that is any. Where it is none for both, both are cut
    once more with all their shingles, and keep their empty parts if there are still sure or more.
    Two linked sets share at least the smaller of their bounds of keys.
    """
    differ = (den - num) * (math.ceil(RANGE ** (k + 1)) - 1) // num
    if not differ:
        return np.zeros(0, np.uint64), 0  # such sets link only if they are equal
    sure = 2 + differ // SURE
    n = differ + sure
    keys, filled = _part_keys(rare, n, U(2 * k))
    if n - len(filled) < sure:
        return keys, sure - (n - len(filled))
    whole, filled = _part_keys(s, n, U(2 * k + 1))
    keys = np.concatenate([keys, whole])
    if n - len(filled) < sure:
        return keys, sure - (n - len(filled))
    return np.concatenate([keys, mix(np.setdiff1d(np.arange(n, dtype=np.uint64), filled) + (U(n) << U(32)) + (U(k) << U(57)))]), sure


def _part_keys(s: np.ndarray, n: int, kind: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of the parts of s that hold shingles."""
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = ((s >> U(32)) * U(n)) >> U(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    content = np.add.reduceat(mix(s + U(0x51ED270B)), first)
    return mix(content ^ mix(part[first] + (U(n) << U(32)) + (kind << U(56)))), part[first]


def _parts(width: int, num: int, den: int, frequent: np.ndarray):
    """(part, class, mark) for each set; a set repeated within a task comes once.

    mark: the size range, whether it is that of the set itself, and the bound of shared parts.
    """
    frequent = np.sort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for r in runs(batch.column(0)):
                parts, classes, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for _, s in shingle_sets(r, width):
                    if not len(s):
                        continue
                    d = _digest(s)
                    if d in seen:
                        continue
                    seen.add(d)
                    rare = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s] if len(frequent) else s
                    own = size_range(len(s))
                    # as the smaller set of a pair in its own range, as the larger one in those of sets it reaches
                    for k in range(size_range(max(1, -(-num * len(s) // den))), own + 1):
                        keys, bound = parts_of(s, rare, k, num, den)
                        parts.append(keys)
                        classes.append(np.full(len(keys), d[0], np.int64))
                        marks.append(np.full(len(keys), (k << 17) | ((k == own) << 16) | min(bound, 65535), np.int32))
                yield pa.record_batch({"part": pa.array(np.concatenate(parts).view(np.int64)), "class": pa.array(np.concatenate(classes)), "mark": pa.array(np.concatenate(marks))})

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (part, class, mark) sorted by part and class: those of parts with several classes, each once.

    part is cut to 32 bits (two that become equal make a pair look closer, never less close).
    """
    part, leader, last, held = None, 0, 0, None  # held: the leader's mark until the part has another class
    for batch in batches:
        if not batch.num_rows:
            continue
        s, c, m = (batch.column(k).to_numpy() for k in range(3))
        new = np.concatenate([[s[0] != part], s[1:] != s[:-1]])
        lead = np.concatenate([[leader], c[new]])[np.cumsum(new)]
        once = new | np.concatenate([[c[0] != last], c[1:] != c[:-1]])
        s, c, m, lead, new = s[once], c[once], m[once], lead[once], new[once]
        if not len(s):
            continue
        others = ~new
        first = np.concatenate([others[1:], [False]]) & new  # leaders followed by another class
        keep = others | first
        out = [s[keep], c[keep], m[keep], lead[keep]]
        if held is not None and others[0]:
            out = [np.concatenate([[x], y]) for x, y in zip((part, leader, held, leader), out)]
        if others[0] or len(new) > 1 or new[0]:
            held = int(m[-1]) if new[-1] else None
        part, leader, last = int(s[-1]), int(lead[-1]), int(c[-1])
        yield pa.record_batch({"class": pa.array(out[1].astype(np.int64)), "mark": pa.array(out[2].astype(np.int32)), "leader": pa.array(out[3].astype(np.int64)), "part": pa.array((out[0].astype(np.int64).view(np.uint64) & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32))})


def _incidence(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by columns and back, of values that several rows have: columns of row x are column[row_at[x]:row_at[x + 1]], rows of column c posting[column_at[c]:column_at[c + 1]]."""
    by_value = np.argsort(value, kind="stable")
    v = value[by_value]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    length = np.diff(np.concatenate([np.flatnonzero(new), [len(v)]]))
    shared = np.repeat(length > 1, length) if len(v) else np.zeros(0, bool)
    posting = row[by_value[shared]]
    column_at = np.concatenate([[0], np.cumsum(length[length > 1])]).astype(np.int64)
    column = np.repeat(np.arange(len(column_at) - 1), np.diff(column_at))
    by_row = np.argsort(posting, kind="stable")
    return column[by_row], np.searchsorted(posting[by_row], np.arange(n + 1)), posting, column_at


class Product:
    """The product of an incidence matrix with its transpose, a row at a time."""

    def __init__(self, row: np.ndarray, value: np.ndarray, n: int):
        self.n = n
        self.column, self.row_at, self.posting, self.column_at = _incidence(row, value, n)

    def row(self, x: int, lo: int = 0, hi: int | None = None) -> np.ndarray | None:
        """How many values each of the rows lo..hi shares with row x; None if x shares none with any."""
        mine = self.column[self.row_at[x] : self.row_at[x + 1]]
        if not len(mine):
            return None
        begin = self.column_at[mine]
        length = self.column_at[mine + 1] - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        p = self.posting[at]
        hi = self.n if hi is None else hi
        if hi - lo < self.n:
            p = p[(p >= lo) & (p < hi)]
        return np.bincount(p - lo, minlength=hi - lo)


class Forest:
    """Union-find; a root is the least member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def join(self, x: int, ys: np.ndarray) -> None:
        for r in {self.find(int(y)) for y in self.parent[ys]}:
            a, b = self.find(x), self.find(r)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        return np.array([self.find(x) for x in range(lo, len(self.parent) if hi is None else hi)], np.int64)


def rows_to_compare(forest: Forest, lo: int, hi: int, compare) -> None:
    """Calls compare for the rows lo..hi that are needed to know their components.

    After some rows of the middle most are in one component, if they are copies of each other: within that
    nothing is left to find, and each of the other rows is compared with all.
    """
    n = hi - lo
    first = sorted({lo, lo + n // 4, lo + n // 2, lo + 3 * n // 4}) if n > 8 else [lo]
    for x in first:
        compare(x)
    roots = forest.roots(lo, hi)
    values, counts = np.unique(roots, return_counts=True)
    main = values[np.argmax(counts)]
    for x in np.flatnonzero(roots != main) + lo:
        if x not in first:
            compare(int(x))


def _sketch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by leader's group: each class with the least one of its group that it is tied to, if another."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        group, ids, mark = t.column("group").to_numpy(), t.column("class").to_numpy(), t.column("mark").to_numpy()
        home, bound = (mark >> 16) & 1 == 1, mark & 0xFFFF
        sketch = t.column("sketch").combine_chunks()
        n = len(ids)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        number = np.cumsum(new) - 1
        rows = np.repeat(np.arange(n), pc.list_value_length(sketch).to_numpy())
        product = Product(rows, sketch.flatten().to_numpy().view(np.uint32).astype(np.uint64) | (number[rows].astype(np.uint64) << U(32)), n)
        forest = Forest(n)
        at = np.concatenate([np.flatnonzero(new), [n]])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            if hi - lo > 1:

                def compare(x: int, lo: int = lo, hi: int = hi) -> None:
                    overlap = product.row(x, lo, hi)
                    if overlap is not None:
                        ys = np.flatnonzero((overlap >= np.minimum(bound[x], bound[lo:hi])) & (home[x] | home[lo:hi])) + lo
                        if len(ys) > 1 or (len(ys) and ys[0] != x):
                            forest.join(x, ys)

                rows_to_compare(forest, lo, hi, compare)
        root = ids[forest.roots()]
        some = root != ids
        return pa.record_batch({"class": pa.array(ids[some]), "root": pa.array(root[some])})

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            g = t.column("group").to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if g[0] <= g[-1] else 0
            if cut:
                yield solved(t.slice(0, cut).combine_chunks())
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield solved(pa.Table.from_batches(held).combine_chunks())


def _sets(width: int):
    """Puts the set in place of the text; rows whose doc_id stands for another text, or again, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            wanted = batch.column("d1").to_pylist()
            at, sets = [], []
            for r in runs(batch.column("text")):
                for i, s in shingle_sets(r, width):
                    if wanted[i] not in seen and _digest(s)[0] == wanted[i]:
                        seen.add(wanted[i])
                        at.append(i)
                        sets.append(s.tobytes())
            rest = batch.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], [*rest.schema.names, "shingles"])

    return run


def _group(num: int, den: int, degrees: bool):
    """Links of a pair of blocks, by the product of their incidence matrix with itself.

    home marks rows of the group's size band (others are of the next band and pair with home rows alone); a
    pair of two blocks belongs to the group of both. Without degrees only components are looked for.
    """
    schema = pa.schema([("class", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("copies_linked", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cross = key[2].as_py() != key[3].as_py()
        t = t.take(pa.array(np.unique(t.column("class").to_numpy(), return_index=True)[1]))  # a class that several tasks sent
        ids, home, block, copies = (t.column(c).to_numpy(zero_copy_only=False) for c in ("class", "home", "block", "copies"))
        n = len(ids)
        sizes = pc.divide(pc.binary_length(t.column("shingles")), 8).to_numpy().astype(np.int64)
        flat = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles")])
        product = Product(np.repeat(np.arange(n, dtype=np.int32), sizes), flat, n)
        del flat, t
        forest, links, reached = Forest(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

        def compare(x: int) -> None:
            overlap = product.row(x)
            if overlap is None:
                return
            linked = den * overlap >= num * (sizes[x] + sizes - overlap)
            linked &= home | home[x]
            linked[x] = False
            if cross and degrees:
                linked &= block != block[x]
            ys = np.flatnonzero(linked)
            if len(ys):
                links[x], reached[x] = len(ys), copies[ys].sum()
                forest.join(x, ys)

        if degrees:
            for x in range(n):
                compare(x)
        else:
            rows_to_compare(forest, 0, n, compare)
        roots = forest.roots()
        if len(product.posting) > BLOCK // 4:
            del product
            release_memory()
        some = (links > 0) | (roots != np.arange(n))
        return pa.table([ids[some], ids[roots[some]], links[some], reached[some]], schema=schema)

    return run


def _bounded(df: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """df joined to keys (a row a k and leader), which go to every task while they are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, ["k", "leader"], how)


def _hot(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaders with more than SKETCHES classes (met: k, leader, blocks, class, mark, sketch): ties to the leader, and groups.

    Classes that are tied to the leader itself are in one component. Only the rest, few where the classes are
    near copies, is compared with all: each block of classes meets each block of the rest in a group.
    """
    met = written(met, "ngram-hot-sketches")  # so that Spark can split the rows of one leader in the join
    lead = met.where(F.col("class") == F.col("leader")).select("k", "leader", F.col("sketch").alias("l_sketch"), F.col("mark").alias("l_mark"))
    bound, home = (lambda m: F.col(m).bitwiseAND(65535)), (lambda m: F.col(m).bitwiseAND(65536) > 0)
    # parts that became equal when they were cut count once here: a class may join the rest for that, none is lost
    tied = (F.size(F.array_intersect("sketch", "l_sketch")) >= F.least(bound("mark"), bound("l_mark"))) & (home("mark") | home("l_mark"))
    met = written(met.join(lead, ["k", "leader"], "left").withColumn("tied", F.coalesce(tied, F.lit(False))).drop("l_sketch", "l_mark"), "ngram-hot-ties")
    rest = met.groupBy("k", "leader").agg(F.ceil(F.count_if(~F.col("tied")) / SKETCHES).cast("int").alias("rests"), F.bool_or(home("mark")).alias("any_home"))
    rest = written(rest.where("rests > 0 and any_home").drop("any_home"), "ngram-hot-rests")  # of a pair one must be at home
    among = _bounded(met, rest)
    deal, numbers = F.xxhash64("class"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_of = among.withColumn("i", F.pmod(deal, F.col("blocks")).cast("int")).withColumn("j", numbers("rests"))
    the_rest = among.where(~F.col("tied")).withColumn("j", F.pmod(deal, F.col("rests")).cast("int")).withColumn("i", numbers("blocks"))
    group = F.xxhash64("k", "leader", "i", "j").alias("group"), "class", "mark", "sketch"
    return met.where("tied and class <> leader").select("class", F.col("leader").alias("root")), all_of.select(*group).union(the_rest.select(*group))


def _candidates(keys: DataFrame) -> DataFrame:
    """node, component: classes that may be linked, from the keys of their parts."""
    spark = keys.sparkSession
    shared = written(keys.repartition("part").sortWithinPartitions("part", "class").mapInArrow(tidy(_shared), "class long, mark int, leader long, part int"), "ngram-shared-parts")
    del keys
    release(spark)  # the shuffled parts
    units = shared.groupBy("class", "mark").agg(F.collect_list("part").alias("sketch"), F.collect_set("leader").alias("leaders"))  # a part of a set each
    units = written(units.where(F.size("sketch") >= F.col("mark").bitwiseAND(65535)), "ngram-sketches")
    size_class = F.shiftright("mark", 17).alias("k")
    # few leaders have more than a block of sketches: those of all classes together are as many as the shared parts at most
    hot = written(units.select(size_class, F.explode("leaders").alias("leader")).groupBy("k", "leader").agg(F.ceil(F.count("*") / SKETCHES).cast("int").alias("blocks")).where("blocks > 1"), "ngram-hot-leaders")
    met = units.select("class", "mark", "sketch", size_class, F.explode("leaders").alias("leader"))
    groups = _bounded(met, hot, "left_anti").select(F.xxhash64("k", "leader").alias("group"), "class", "mark", "sketch")
    ties = None
    if not hot.isEmpty():
        ties, more = _hot(_bounded(met, hot))
        groups = groups.union(more)
    found = groups.repartition("group").sortWithinPartitions("group").mapInArrow(tidy(_sketch_links), "class long, root long")
    return connected_components(found if ties is None else found.union(ties), "class", "root", "ngram-candidates")


def _linked(d: DataFrame, width: int, num: int, den: int, degrees: bool = True) -> DataFrame:
    """doc_id, key, n, component (a class), component_id (its least doc_id) of each row of d (doc_id, text, key), and with degrees n_links."""
    profile = written(d.select("doc_id", "text", "key").mapInArrow(tidy(_profile(width)), "kind int, doc_id long, key long, n long, d1 long, d2 long"), "ngram-profile")
    often = profile.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "d1").limit(MAX_FREQUENT)
    frequent = often.select("d1").toPandas()["d1"].to_numpy(np.int64).view(np.uint64)
    per_doc = profile.where("kind = 0").select("doc_id", "key", "n", "d1", "d2")
    classes = written(per_doc.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("least"), F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("least_key"), F.count("*").alias("copies")), "ngram-classes")

    parts = _candidates(d.select("text").mapInArrow(tidy(_parts(width, num, den, frequent)), "part long, class long, mark int"))

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num)))
    cand = written(classes.join(parts.withColumnRenamed("node", "d1"), "d1").select("least", "least_key", "d1", "d2", "n", "copies", "component", band.cast("int").alias("band")), "ngram-candidates")
    # written before it is joined to the rows of a component: Spark can then split a component of very many rows
    sizes = cand.groupBy("component", "band").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("n")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("sizes"))  # a few dozen bands at most
    sizes = written(sizes, "ngram-bands")
    blocks = lambda at: F.ceil((F.try_element_at("sizes", at) + F.coalesce(F.try_element_at("sizes", at + 1), F.lit(0))) / F.lit(BLOCK)).cast("int")
    # blocks of the group of a band, for the class at home there and as a guest of the band below, if that has any
    dealt_out = cand.join(sizes, "component").select("least", "least_key", "d1", "copies", "component", "band", F.xxhash64("d1", "d2").alias("deal"), blocks(F.col("band")).alias("at_home"), blocks(F.col("band") - 1).alias("as_guest"))
    cand = written(dealt_out, "ngram-candidates-dealt")
    # a broadcast while the candidates are few (about 60 bytes each), else a shuffle of the texts
    few = cand.count() <= BROADCAST_ROWS
    texts = d.join(F.broadcast(cand) if few else cand.hint("shuffle_hash"), d["doc_id"].eqNullSafe(cand["least"]) & (d["key"] == cand["least_key"]))
    with_sets = texts.select("d1", "copies", "component", "band", "deal", "at_home", "as_guest", "text").mapInArrow(
        tidy(_sets(width)), "d1 long, copies long, component long, band int, deal long, at_home int, as_guest int, shingles binary"
    )
    role = lambda below, blocks: F.struct((F.col("band") - below).alias("band"), F.lit(not below).alias("home"), F.col(blocks).alias("blocks"), F.pmod("deal", blocks).cast("int").alias("block"))
    roles = F.when(F.col("as_guest").isNotNull(), F.array(role(0, "at_home"), role(1, "as_guest"))).otherwise(F.array(role(0, "at_home")))
    pair = F.transform(F.sequence(F.lit(0), F.col("b.blocks") - 1), lambda k: F.struct(F.least(k, F.col("b.block")).alias("i"), F.greatest(k, F.col("b.block")).alias("j")))
    dealt = with_sets.withColumn("b", F.explode(roles)).withColumn("p", F.explode(pair)).withColumnRenamed("d1", "class")
    dealt = dealt.select("component", F.col("b.band").alias("band"), F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("b.home").alias("home"), F.col("b.block").alias("block"), "class", "copies", "shingles")
    links = written(dealt.groupBy("component", "band", "i", "j").applyInArrow(_group(num, den, degrees), "class long, root long, links long, copies_linked long"), "ngram-links")

    linked = connected_components(links.where("class <> root"), "class", "root", "ngram-components")
    named = classes.join(linked.withColumnRenamed("node", "d1"), "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    names = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-names")
    per_class = named.join(names, "component")
    if degrees:
        degree = links.groupBy("class").agg(F.sum("copies_linked").alias("others")).withColumnRenamed("class", "d1")
        per_class = per_class.join(degree, "d1", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1)
    per_class = per_class.select("d1", "d2", "component", "component_id", *["n_links"] * degrees)
    return per_doc.join(per_class, ["d1", "d2"], "left").select("doc_id", "key", "n", "component", "component_id", *["n_links"] * degrees)


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by the Jaccard similarity of their distinct word shingles.

    Words are runs of characters other than 0x20, 0x09-0x0D, A-Z lower-cased; a shingle is width words
    (all words, where fewer). Two documents link if den * intersection >= num * union.

    Returns one row per input row: doc_id, n_shingles (set size), component_id (the smallest doc_id
    reachable over links, itself included), n_links (documents it links to). Null or wordless texts have
    n_shingles 0, link to nothing and are their own component; equal texts link; a row without doc_id
    counts as a document but never names a component. Extra columns are left out. An empty table gives
    no rows.
    """
    d = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    return _linked(d, width, num, den).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents stays, with all its columns: the one of least doc_id.

    Rows without doc_id come after all others. Of equal rows (doc_id and text) one stays, unless the text
    has no words: those are linked with nothing and all stay. An empty table stays empty.
    """
    d = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    linked = written(_linked(d, width, num, den, degrees=False), "ngram-members").where("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    keepers = written(linked.groupBy("component").agg(F.min(order).alias("o")).select("component", F.col("o.doc_id").alias("k_id"), F.col("o.key").alias("k_key")), "ngram-keeper")
    mine = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key"))
    members = written(linked.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n")), "ngram-distinct-members")
    rows = members.join(keepers, "component").select("doc_id", "key", "n", mine.alias("keeper"))
    rows = written(rows, "ngram-keepers")
    repeated = rows.where(F.col("keeper") & (F.col("n") > 1)).select("doc_id", "key").distinct()
    if repeated.isEmpty():
        return without(docs, rows.where(~F.col("keeper")).select("doc_id", "key").distinct(), id_col, text_col)
    # names that no table has
    own_id, own_key, its_id, its_key = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "key", "id", "key"))
    again = docs.withColumns({own_id: docs[id_col].cast("long"), own_key: F.xxhash64(F.coalesce(docs[text_col], F.lit("")))})
    marked = repeated.select(F.col("doc_id").alias(its_id), F.col("key").alias(its_key))
    once = again.join(marked, F.col(own_id).eqNullSafe(F.col(its_id)) & (F.col(own_key) == F.col(its_key)), "left_semi").dropDuplicates([own_id, own_key])
    gone = rows.where(~F.col("keeper")).select("doc_id", "key").union(repeated).distinct()
    return without(docs, gone, id_col, text_col).union(once.drop(own_id, own_key))
