"""Jaccard self-join on word n-grams by adaptive multi-match prefixes.

A document's set holds its distinct ``k``-word shingles (lower-cased A-Z; fewer words: the whole sequence
as one; no words: the empty set, linked with nothing). Two documents link when ``den * |A & B| >= num *
|A | B|``. The result is each document's class under links and the size of its set; every link between
different sets is found.

1. *Classes.* Equal sets are one class, found by a signature of the set, so copies meet only once.
2. *Order.* Shingles are ordered by how common they are, then by hash: tasks count the shingles in their documents'
   hash-order prefixes, and the common ones (at most ``MOST_COMMON``, a bounded broadcast) rank last by
   magnitude. Any order is correct; a good one keeps prefixes rare.
3. *Adaptive prefixes.* Sets that link share at least ``l`` shingles within their ``l``-prefixes, the first
   ``n - ceil(t n) + l`` shingles. Each document picks the ``l`` of least estimated cost: probes plus
   verification of the candidates that ``l`` shared shingles still allow. Every document is indexed to the largest
   ``l`` with the level at which a shingle enters; the larger set of a pair probes with its own ``l``.
4. *Candidates.* Shingles that more than ``LIST`` sets of one task share are known to be hot before anything is dealt, and their
   rows are never brought together in a task. The other index rows are dealt by shingle. Lists of at most ``LIST`` sets give pairs, and pairs
   with ``l`` shared shingles are verified exactly on the sets. Longer lists and hot shingles give no pairs but members, whatever their ``l``.
5. *Long lists.* A task intersects two blocks of sets (at most about ``BLOCK`` sets and ``SHINGLES`` shingles each) and emits stars of links.
   First every set goes to the list of its first long shingle, where each block meets the first block: near copies, however many, become one
   component in linear work. Then, in each list that still holds several components, blocks meet unless both lie in one component: no link
   between components is lost, and links inside one change nothing. Only a long list of sets that are *not* alike costs work that grows with the square of its blocks.
6. *Components* of the links by alternating stars; a class takes the least doc_id that it reaches.

Sets are compared by 64-bit shingle hashes, classes by 128-bit signatures. Null text is an empty set; a null doc_id is
never the least; repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, materialise, table
from .components import components
from .textarrays import U, Block, blocks, mix, rolling

WORDS, NUM, DEN = 4, 85, 100
#: Largest ``l``; list length from which a shingle counts as common; common shingles broadcast at most.
LEVELS, COMMON, MOST_COMMON = 4, 4, 1_000_000
#: Longest list that gives pairs; sets and shingles in a block of a longer one; index rows that a task looks at together for hot shingles.
LIST, BLOCK, SHINGLES, LOOK = 48, 1024, 1 << 20, 1 << 21
#: Rows that a hinted broadcast may have; above, the join shuffles.
SMALL = 500_000
_S1, _S2 = U(0x243F6A8885A308D3), U(0x13198A2E03707344)


def sets(block: Block, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = block.words()
    h, first, n = w.hashes(), w.first, w.counts
    grams = rolling(h, k)
    short = {m: mix(rolling(h, m) ^ U(0xA5A5A5A5)) for m in set(n[(n > 0) & (n < k)].tolist())}
    out = []
    for a, m in zip(first[:-1].tolist(), n.tolist()):
        out.append(np.unique(grams[a : a + m - k + 1]) if m >= k else short[m][a : a + 1] if m else grams[:0])
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s ^ _S1).sum(dtype=U).astype(np.int64)), int(mix(s + _S2).sum(dtype=U).astype(np.int64))


def _ceil(num: int, den: int, n: int) -> int:
    return -(-num * n // den)


def can_link(n: int, num: int, den: int) -> bool:
    """Whether a set of ``n`` can link with a different one."""
    return n * den >= num * (n + 1)


def prefix(s: np.ndarray, num: int, den: int, common: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of the largest prefix in order, the level of each, and the chosen ``l``."""
    n = len(s)
    need = _ceil(num, den, n)
    base, top = n - need + 1, min(LEVELS, need)
    size = min(n, base + top - 1)
    rank = mix(s)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        grade = np.where(common[0][at] == s, common[1][at], 0)
    else:
        grade = np.zeros(n, np.uint8)
    if grade.any():
        order = np.lexsort((rank, grade))[:size]
    else:
        order = np.argpartition(rank, size - 1)[:size] if size < n else np.arange(n)
        order = order[np.argsort(rank[order])]
    weight = np.where(grade[order] > 0, float(COMMON) * 2.0 ** grade[order], 1.0)
    probes = np.cumsum(weight)[base - 1 : base + top - 1]
    level = np.arange(1, len(probes) + 1)
    cost = probes + (1 + n / 64) * probes / level
    return s[order], np.maximum(np.arange(size) - base + 2, 1), int(np.argmin(cost)) + 1


_DIGEST = "doc_id {id}, tk long, n long, s1 long, s2 long"


def _digests(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(len(s), *signature(s)) for block in blocks(b.column(2)) for s in sets(block, k)]
            n, s1, s2 = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())], ["doc_id", "tk", "n", "s1", "s2"])

    return docs.select("doc_id", "tk", "text").mapInArrow(run, _DIGEST.format(id=kind))


def _tidied(run):
    """``run`` over the batches of a task, which gives its memory back at the end."""

    def all_of(batches):
        yield from run(batches)
        give_back()

    return all_of


class _Seen:
    """Signatures met in a task; forgetting them costs repeated rows, nothing else."""

    def __init__(self, most: int = 500_000):
        self.have, self.most = set(), most

    def again(self, key) -> bool:
        if key in self.have:
            return True
        if len(self.have) >= self.most:
            self.have.clear()
        self.have.add(key)
        return False


def _prefix_counts(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(token, count) of shingles in hash-order prefixes, from those that a task meets twice within about ``LOOK`` of them; copies within a task count once."""

    def run(batches):
        def told():
            token, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["token", "c"])

        seen, held, n = _Seen(), [], 0
        for b in batches:
            for block in blocks(b.column(0)):
                for s in sets(block, k):
                    if len(s) and can_link(len(s), num, den) and not seen.again(signature(s)):
                        held.append(prefix(s, num, den, None)[0])
                        n += len(held[-1])
                if n > LOOK:
                    yield told()
                    held, n = [], 0
        if held:
            yield told()

    return docs.select("text").mapInArrow(_tidied(run), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _common(docs: DataFrame, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with their magnitudes; never more than MOST_COMMON."""
    counted = materialise(_prefix_counts(docs, k, num, den).filter(F.col("c") >= COMMON), "common")
    by = counted.groupBy(F.floor(F.log2("c")).cast("int").alias("g")).count().collect()
    least, total = None, 0
    for g, c in sorted(map(tuple, by), reverse=True):
        total += c
        if total > MOST_COMMON:
            break
        least = g
    if least is None:
        return np.empty(0, U), np.empty(0, np.uint8)
    rows = counted.filter(F.col("c") >= 2**least).select("token", F.floor(F.log2("c")).cast("int").alias("g")).toArrow()
    token = rows.column(0).to_numpy().view(U)
    order = np.argsort(token)
    return token[order], (rows.column(1).to_numpy()[order] - least + 1).astype(np.uint8)


_INDEX = "token long, s1 long, s2 long, meta long"


def _index(docs: DataFrame, k: int, num: int, den: int, common) -> DataFrame:
    """Index rows; ``meta`` packs the set's size, its ``l`` and the shingle's level."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen = _Seen()
        for b in batches:
            for block in blocks(b.column(0)):
                cols: list[list] = [[], [], [], []]
                for s in sets(block, k):
                    if not len(s) or not can_link(len(s), num, den):
                        continue
                    sig = signature(s)
                    if seen.again(sig):
                        continue
                    token, level, ell = prefix(s, num, den, shared.value)
                    cols[0].append(token)
                    cols[1].append(np.full(len(token), sig[0]))
                    cols[2].append(np.full(len(token), sig[1]))
                    cols[3].append((len(s) << 8) | (ell << 4) | level)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(U).view(np.int64) if i == 0 else np.concatenate(c).astype(np.int64)) for i, c in enumerate(cols)], ["token", "s1", "s2", "meta"])

    return docs.select("text").mapInArrow(_tidied(run), _INDEX)


_FOUND = "kind int, token long, x1 long, x2 long, y1 long, y2 long, l int"


def _pairs_of(a: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Pairs within runs of equal tokens. ``a``: rows (token, s1, s2, meta), distinct and sorted by token."""
    out = []
    run = np.cumsum(np.r_[0, a[1:, 0] != a[:-1, 0]])
    for d in range(1, LIST):
        i = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else run[:0]
        if not len(i):
            break
        p, q = a[i], a[i + d]
        flip = (p[:, 3] >> 8, p[:, 1], p[:, 2]), (q[:, 3] >> 8, q[:, 1], q[:, 2])
        less = (flip[0][0] < flip[1][0]) | (flip[0][0] == flip[1][0]) & ((flip[0][1] < flip[1][1]) | (flip[0][1] == flip[1][1]) & (flip[0][2] < flip[1][2]))
        x, y = np.where(less[:, None], q, p), np.where(less[:, None], p, q)
        nx, ny, ell = x[:, 3] >> 8, y[:, 3] >> 8, (x[:, 3] >> 4) & 15
        ok = (ny * den >= nx * num) & ((x[:, 3] & 15) <= ell) & ((y[:, 3] & 15) <= ell)
        if ok.any():
            x, y, ell = x[ok], y[ok], ell[ok]
            out.append(np.column_stack([np.zeros(len(x), np.int64), x[:, 0], x[:, 1], x[:, 2], y[:, 1], y[:, 2], ell]))
    return out


def _hot(index: DataFrame) -> DataFrame:
    """(token) of the shingles that more than ``LIST`` rows have among about ``LOOK`` rows of a task."""

    def run(batches):
        def told():
            token, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[c > LIST])], ["token"])

        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n > LOOK:
                yield told()
                held, n = [], 0
        if held:
            yield told()

    return index.select("token").mapInArrow(_tidied(run), "token long").distinct()


def _lists(index: DataFrame, num: int, den: int) -> DataFrame:
    """Kind 0: pairs of short lists, once for each shared shingle. Kind 1: members of long lists, the size of the set in y1."""

    def emit(parts):
        if parts:
            m = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(m[:, c])) for c in range(1, 6)), pa.array(m[:, 6].astype(np.int32))],
                ["kind", "token", "x1", "x2", "y1", "y2", "l"],
            )

    def long(a):
        z = np.zeros(len(a), np.int64)
        return np.column_stack([z + 1, a[:, 0], a[:, 1], a[:, 2], a[:, 3] >> 8, z, z])

    def work(a, num=num, den=den):
        """Whole runs."""
        keep = np.r_[True, (a[1:, :3] != a[:-1, :3]).any(axis=1)]  # rows are sorted by token and signature
        a = a[keep]
        start = np.flatnonzero(np.r_[True, a[1:, 0] != a[:-1, 0]])
        size = np.repeat(np.diff(np.r_[start, len(a)]), np.diff(np.r_[start, len(a)]))
        parts = [long(a[size > LIST])] if (size > LIST).any() else []
        short = a[(size > 1) & (size <= LIST)]
        return parts + (_pairs_of(short, num, den) if len(short) else [])

    def run(batches):
        held, over = np.empty((0, 4), np.int64), None
        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if over is not None:  # the rest of a long list passes by
                cut = int(np.searchsorted(a[:, 0] != over, True))
                if cut:
                    yield from emit([long(a[:cut])])
                a = a[cut:]
                if not len(a):
                    continue
                over = None
            a = np.concatenate([held, a])
            last = int(np.flatnonzero(a[:, 0] != a[-1, 0])[-1]) + 1 if (a[:, 0] != a[-1, 0]).any() else 0
            done, held = a[:last], a[last:]
            if len(done):
                yield from emit(work(done))
            if len(np.unique(held[:, 1:3], axis=0)) > LIST:
                yield from emit([long(held)])
                over, held = held[-1, 0], held[:0]
        if len(held):
            yield from emit(work(held))

    return index.repartition("token").sortWithinPartitions("token", "s1", "s2").mapInArrow(run, _FOUND)


def _sets_of(docs: DataFrame, need: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(s1, s2, tokens) of the classes in ``need``."""
    ids = need.join(classes, ["s1", "s2"]).select("rep").filter("rep is not null").distinct()
    ids = materialise(ids, "ids")  # small, and read by what is written below
    few = ids.count() <= SMALL
    own = docs.join((F.broadcast(ids) if few else ids).withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))

    def run(batches):
        seen = _Seen()
        for b in batches:
            for block in blocks(b.column(0)):
                rows = [(sig, s) for s in sets(block, k) if len(s) and not seen.again(sig := signature(s))]
                if rows:
                    at = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
                    flat = np.concatenate([s for _, s in rows]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g[0] for g, _ in rows], pa.int64()), pa.array([g[1] for g, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                        ["s1", "s2", "tokens"],
                    )

    found = own.select("text").mapInArrow(_tidied(run), "s1 long, s2 long, tokens array<long>")
    out = materialise(found.join(need, ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(F.first("tokens").alias("tokens")), "sets")
    discard(ids)
    return out


def link_block(s1, s2, tokens: list[np.ndarray], num: int, den: int) -> list[tuple[int, int, int, int]]:
    """Stars of the links among a block of sets: (s1, s2) of a set and of its root."""
    m = len(tokens)
    n = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(m), n)
    _, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    inter, part = np.zeros((m, m), np.float32), np.empty((m, m), np.float32)
    width = 1024
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        a = np.zeros((m, width), np.float32)
        a[owner[lo:hi], column[lo:hi] - c] = 1
        inter += np.matmul(a, a.T, out=part)
    # inter * den >= num * (n + n' - inter), in whole numbers that doubles hold exactly
    linked = np.empty((m, m), bool)
    for i in range(0, m, 256):
        linked[i : i + 256] = inter[i : i + 256].astype(float) * (den + num) >= float(num) * (n[i : i + 256, None] + n[None, :])
    del inter, part
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        new = np.concatenate([np.where(linked[i : i + 256], label[None, :], m).min(axis=1) for i in range(0, m, 256)])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(s1[i]), int(s2[i]), int(s1[r]), int(s2[r])) for i, r in enumerate(label) if i != r]


def _met(dealt: DataFrame, sets_: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the sets of each (token, lo, hi)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t.column("tokens").chunk(0) if t.num_rows else None
        rows = []
        if t.num_rows > 1:
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            rows = link_block(t.column("s1").to_numpy(), t.column("s2").to_numpy(), [values[a:b] for a, b in zip(at[:-1], at[1:])], num, den)
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        give_back()
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("x1", "x2", "y1", "y2"), cols)})

    own = dealt.select("token", "lo", "hi", "s1", "s2").join(sets_, ["s1", "s2"])
    return own.groupBy("token", "lo", "hi").applyInArrow(run, "x1 long, x2 long, y1 long, y2 long")


def _blocks(count, shingles):
    """Blocks that so many sets with so many shingles make."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / SHINGLES)).cast("int")


def _first_links(members: DataFrame, sets_: DataFrame, num: int, den: int) -> DataFrame:
    """Links found in the list of each set's first long shingle, where every block meets the first one."""
    first = members.groupBy("s1", "s2", "n").agg(F.min(F.struct(F.xxhash64("token").alias("h"), "token")).alias("f")).select("f.token", "s1", "s2", "n")
    first = materialise(first, "first")
    size = materialise(first.groupBy("token").agg(F.count("*").alias("c"), _blocks(F.count("*"), F.sum("n")).alias("nb")).filter("c > 1").drop("c"), "first-sizes")
    dealt = first.join(size, "token").withColumn("b", F.pmod(F.xxhash64("s1", "s2"), F.col("nb")).cast("int"))
    last = F.col("nb") - 1
    dealt = dealt.withColumn("hi", F.explode(F.when(F.col("b") == 0, F.sequence(F.least(F.lit(1), last), last)).otherwise(F.array("b")))).withColumn("lo", F.lit(0))
    out = materialise(_met(dealt, sets_, num, den), "first-links")
    discard(first), discard(size)
    return out


def _rest_links(members: DataFrame, stars: DataFrame, sets_: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of the lists that hold several."""
    own = stars.select(F.col("u.a").alias("s1"), F.col("u.b").alias("s2"), F.col("v.a").alias("v1"), F.col("v.b").alias("v2"))
    placed = materialise(members.join(own, ["s1", "s2"], "left").select("token", "s1", "s2", "n", F.coalesce("v1", "s1").alias("c1"), F.coalesce("v2", "s2").alias("c2")), "placed")
    size = placed.groupBy("token", "c1", "c2").agg(_blocks(F.count("*"), F.sum("n")).alias("nb"), F.count("*").alias("c"), F.sum("n").alias("w"))
    size = materialise(size.withColumn("large", F.col("nb") > 1), "placed-sizes")
    rest = lambda x: F.sum(F.when(F.col("large"), 0).otherwise(F.col(x)))
    block = lambda large, c1, c2, i: F.struct(large.alias("large"), c1.alias("c1"), c2.alias("c2"), i.cast("int").alias("i"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own_blocks = F.when(F.col("large"), F.transform(numbers(F.col("nb")), lambda i: block(F.lit(True), F.col("c1"), F.col("c2"), i)))
    # a block is a part of one large component, or several small ones: a list has about as many as its sets fill
    several = size.groupBy("token").agg(F.count("*").alias("k"), _blocks(rest("c"), rest("w")).alias("ns"), F.flatten(F.collect_list(own_blocks)).alias("lb")).filter("k > 1")
    zero = F.lit(0).cast("long")
    several = several.select("token", "ns", F.concat("lb", F.transform(numbers(F.col("ns")), lambda i: block(F.lit(False), zero, zero, i))).alias("all"))
    several = materialise(several, "several")
    out = None
    if not several.isEmpty():
        dealt = placed.join(several, "token").join(size.select("token", "c1", "c2", "nb", "large"), ["token", "c1", "c2"])
        mine = F.when(F.col("large"), block(F.lit(True), F.col("c1"), F.col("c2"), F.pmod(F.xxhash64("s1", "s2"), F.col("nb")))).otherwise(block(F.lit(False), zero, zero, F.pmod(F.xxhash64("c1", "c2"), F.greatest("ns", F.lit(1)))))
        dealt = dealt.withColumn("b", mine).withColumn("o", F.explode("all"))
        dealt = dealt.filter(~(F.col("b.large") & F.col("o.large") & (F.col("b.c1") == F.col("o.c1")) & (F.col("b.c2") == F.col("o.c2"))))
        out = materialise(_met(dealt.withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o")), sets_, num, den), "rest-links")
    for gone in (placed, size, several):
        discard(gone)
    return out


def _short_links(pairs: DataFrame, sets_: DataFrame, num: int, den: int) -> DataFrame:
    x = sets_.select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), F.col("tokens").alias("a"))
    y = sets_.select(F.col("s1").alias("y1"), F.col("s2").alias("y2"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    return pairs.join(x, ["x1", "x2"]).join(y, ["y1", "y2"]).filter(both * den >= num * (F.size("a") + F.size("b") - both)).select("x1", "x2", "y1", "y2")


def link_documents(df: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, tk (hash of its text), n_shingles and component_id (null where no reachable id is known)."""
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("tk"))
    digests = materialise(_digests(docs, words), "digests")
    classes = materialise(digests.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    index = materialise(_index(docs, words, num, den, _common(docs, words, num, den)), "index")
    hot = materialise(_hot(index), "hot")
    listed = F.broadcast(hot) if hot.count() <= SMALL else hot
    found = materialise(_lists(index.join(listed, "token", "left_anti"), num, den), "lists")
    many = index.join(listed, "token").select("token", "s1", "s2", F.shiftright("meta", 8).alias("n"))
    many = many.unionByName(found.filter("kind = 1").select("token", F.col("x1").alias("s1"), F.col("x2").alias("s2"), F.col("y1").alias("n")))
    members = materialise(many.distinct(), "members")
    pairs = found.filter("kind = 0").groupBy("x1", "x2", "y1", "y2").agg(F.count("*").alias("c"), F.max("l").alias("l")).filter("c >= l").drop("c", "l")
    pairs = materialise(pairs, "pairs")
    need = pairs.select(F.col("x1").alias("s1"), F.col("x2").alias("s2")).unionByName(pairs.select(F.col("y1").alias("s1"), F.col("y2").alias("s2"))).unionByName(members.select("s1", "s2"))
    need = materialise(need.distinct(), "need")
    for gone in (index, hot, found):
        discard(gone)
    sets_ = _sets_of(docs, need, classes, words)
    node = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    tied = lambda links: links.select(node("x1", "x2").alias("u"), node("y1", "y2").alias("v"))
    first = _first_links(members, sets_, num, den)
    stars = components(tied(_short_links(pairs, sets_, num, den)).unionByName(tied(first)))
    rest = _rest_links(members, stars, sets_, num, den)
    if rest is not None:
        before, stars = stars, components(stars.unionByName(tied(rest)))
        discard(before), discard(rest)
    roots = classes.withColumn("u", node("s1", "s2")).join(stars, "u", "left").withColumn("root", F.coalesce("v", "u"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component"))
    grouped = materialise(roots.join(least, "root").select("s1", "s2", "component"), "grouped")
    for gone in (classes, members, pairs, need, sets_, first, stars):
        discard(gone)
    full, none = digests.filter("n > 0"), digests.filter("n = 0")
    return (
        full.join(grouped, ["s1", "s2"], "left")
        .select("doc_id", "tk", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
        .unionByName(none.select("doc_id", "tk", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def keep_one(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies: that of the least doc_id.

    Of rows equal in id and text one stays. Rows without an id go where a row with an id is in their group;
    otherwise one for each text stays. Documents without words are no copies of each other and stay, but for repeated rows.
    """
    found = link_documents(df, words, num, den, key, text)
    found = materialise(found.select("doc_id", "tk", "component_id"), "linked")
    k, t = F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))
    gone = found.filter((F.col("doc_id") != F.col("component_id")) | F.col("doc_id").isNull() & F.col("component_id").isNotNull()).select(F.col("doc_id").alias("__i"), F.col("tk").alias("__t")).distinct()
    # the least id of a group may stand for several texts of that group
    twice = found.filter("doc_id <=> component_id").groupBy("component_id").agg(F.count("*").alias("c"), F.min("tk").alias("m")).filter("c > 1")
    gone, twice = materialise(gone, "gone"), materialise(twice, "twice")
    small = gone.count() <= SMALL
    stay = df.withColumn("__t", t)
    stay = stay.join(F.broadcast(gone) if small else gone, k.eqNullSafe(F.col("__i")) & (stay["__t"] == gone["__t"]), "left_anti")
    if twice.isEmpty():
        return stay.drop("__t")
    ids = twice.select(F.col("component_id").alias("__c"))
    few = ids.count() <= SMALL
    ids = F.broadcast(ids) if few else ids
    single = stay.join(ids, k.eqNullSafe(F.col("__c")), "left_anti")
    several = stay.join(ids, k.eqNullSafe(F.col("__c")), "left_semi").dropDuplicates([key, "__t"])
    return single.unionByName(several).drop("__t")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[][] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS s FROM w
), t AS (SELECT doc_id, md5(array_to_string(s, ' ')) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d WHERE r.m < e.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
