"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are word sequences: runs of ASCII letters and digits and of other characters, lower-cased; ASCII marks and white space
only separate. A passage of a document leaks an item when the word edit distance between them is at most ``RATE`` of the
item's words, rounded down (items of fewer than five words must occur exactly).

The CGK random walk turns edit distance into Hamming distance: it copies the word at its pointer to the output and advances when a
random bit of (step, word) says so, so walks over two sequences fall into step again after an edit. Windows are short, as at ``RATE``
only about four words in a row are sure to be left untouched, however long the item: an item belongs to the largest size of at most ``FIT`` of
its words. Items are indexed from every start at which a window fits and documents are walked from every word, so an untouched run
is met wherever it lies. Each of ``REPEATS`` independent walks samples ``BITS`` output coordinates into a key; a shared key is
a candidate. A walk may linger, so that its key holds one or two words only and matches everywhere: such keys are left out of the index
unless the item has no other in that repeat. A candidate whose surroundings lack more of the item's words than may be edited cannot leak and goes; for the others the edit
distance of the item to the text around the diagonal decides. Copies are always found; for edited passages recall depends on the
repeats (``tests/llm/test_decontaminate.py`` measures it against brute force, up to ``RATE`` itself and for items of 5 to 220 words).

The items are the query set: they travel to tasks in blocks of about at most ``ITEMS`` items and ``ITEM_BYTES`` bytes, and every document, whole,
is searched for each block; nothing is joined. Null or wordless texts and items match nothing; repeated documents get equal rows, and items with
equal words a row each; of places of an item that are equally near, the first to end counts, then the latest to start. Other columns of the two tables are not read and may
have any names; ``drop_leaks`` passes them through. Very long items take time in proportion to their words and those around a candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textarrays import U, Block, blocks, mix, starts_of

RATE, FIT = 0.2, 0.6
SIZES = (1, 2, 3, 4, 6, 8)
REPEATS, BITS, LEAST = 4, 5, 3
#: Items of a block that travels to tasks, and bytes of their texts.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def folded(column: pa.Array) -> pa.Array:
    """Lower case, code point by code point, so places in code points stay."""
    return pc.utf8_lower(column)


def edits(item, text, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of ``text`` nearest to ``item``, or None if over ``most``. Of equal ones the first to end, then the latest to start.

    A row of the table is one array: its cells hold the distance and, below it, how far from the end of the text the part starts, so
    that the least cell is the nearest part; steps along the row are a running minimum.
    """
    item, text = np.asarray(item), np.asarray(text)
    n = len(text)
    one = n + 1  # an edit outweighs any start
    kind = np.int32 if one * (n + len(item) + 2) < 1 << 31 else np.int64
    along = np.arange(n + 1, dtype=kind) * kind(one)
    row = (n - np.arange(n + 1)).astype(kind)
    new = np.empty(n + 1, kind)
    for i, w in enumerate(item, 1):
        np.add(row, one, out=new)
        np.minimum(new[1:], row[:-1] + (text != w) * kind(one), out=new[1:])
        new -= along
        np.minimum.accumulate(new, out=row)
        row += along
        if i > most and row.min() // one > most:
            return None
    cost = row // one
    j = int(cost.argmin())
    return (int(cost[j]), n - int(row[j] % one), j) if cost[j] <= most else None


class Index:
    """Keys of a block of items; travels to tasks."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, repeats: int = REPEATS, bits: int = BITS, seed: int = 1):
        self.rate, self.repeats = rate, repeats
        self.ids, self.words = [], []
        for block in blocks(folded(pa.array([t for _, t in items], pa.string()))):
            w = block.words(space=_APART)
            h = w.hashes()
            for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                if b > a:
                    self.ids.append(items[block.rows.start + k][0])
                    self.words.append(h[a:b].tolist())
        rnd = np.random.default_rng(seed)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by_size.setdefault(max(s for s in SIZES if s <= max(1, len(w) * FIT) or s == 1), []).append(k)
        self.tables = []
        for size, members in sorted(by_size.items()):
            steps = max(1, size * 3 // 2)
            flat = np.concatenate([np.r_[np.array(self.words[k], U), np.zeros(steps, U)] for k in members])
            begin = np.cumsum([0] + [len(self.words[k]) + steps for k in members])[:-1]
            fits = [len(self.words[k]) - size + 1 for k in members]
            where = np.concatenate([b + np.arange(n) for b, n in zip(begin, fits)])
            what = np.concatenate([np.column_stack([np.full(n, k), np.arange(n)]) for k, n in zip(members, fits)])
            for r in range(repeats):
                at = np.sort(rnd.choice(steps, min(bits, steps), replace=False))
                salt = U(rnd.integers(1, 1 << 62))
                keys, told = walk(flat, where, at, salt, True)
                good = told >= min(LEAST, max(1, size - 1))
                good |= ~np.isin(what[:, 0], what[good, 0])
                keys, mine = keys[good], what[good]
                order = np.argsort(keys, kind="stable")
                mask = (1 << max(12, int(len(keys)).bit_length() + 5)) - 1
                hit = np.zeros(mask + 1, bool)
                hit[(keys & U(mask)).astype(np.int64)] = True
                self.tables.append((size, at, salt, keys[order], mine[order], U(mask), hit))

    def search(self, block: Block) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, edits, item words, start byte, end byte), the nearest place of each item in each text."""
        w = block.words(space=_APART)
        h, first = w.hashes(), w.first
        if not len(h) or not self.tables:
            return []
        found: dict[tuple[int, int], set[int]] = {}
        owner = w.owners()
        for size, at, salt, keys, what, mask, hit in self.tables:
            where = np.arange(0, len(h) - size + 1)
            where = where[where + size <= first[owner[where] + 1]]
            mine = walk(h, where, at, salt)
            maybe = np.flatnonzero(hit[(mine & mask).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(keys, mine[maybe], "left"), np.searchsorted(keys, mine[maybe], "right")
            for k, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                p = int(where[k])
                for item, s in what[a:b].tolist():
                    found.setdefault((int(owner[p]), item), set()).add(p - s)
        out = []
        for (text, item), diagonals in found.items():
            words = self.words[item]
            m, best = len(words), None
            most = int(self.rate * m)
            left, right = int(first[text]), int(first[text + 1])
            near = sorted(diagonals)
            k = 0
            while k < len(near) and (best is None or best[0] > 0):
                d = e = near[k]  # diagonals that lie close together share the text around them
                while k < len(near) and near[k] - e <= 2 * most and near[k] - d <= m:
                    e = near[k]
                    k += 1
                lo, hi = max(left, d - most), min(right, e + m + 2 * most)
                around = h[lo:hi]
                held = set(around.tolist())
                if sum(x in held for x in words) < m - most:
                    continue
                got = edits(np.array(words, U), around, most)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1], lo + got[2])
            if best and best[2] > best[1]:
                base = int(block.at[text])
                out.append((text, item, best[0], m, int(w.starts[best[1]]) - base, int(w.ends[best[2] - 1]) - base))
        return out


def walk(words: np.ndarray, where: np.ndarray, at: np.ndarray, salt, tell: bool = False):
    """Keys of the sampled coordinates ``at`` of the CGK embeddings that start at ``where``; with ``tell`` also the number of places that each samples."""
    coin = mix(words ^ salt)
    pos, last = where.copy(), len(words) - 1
    key = np.full(len(where), salt, U)
    sampled = set(at.tolist())
    places, before = np.zeros(len(where), np.int64), np.full(len(where), -1)
    for j in range(int(at[-1]) + 1):
        here = np.minimum(pos, last)
        if j in sampled:
            if tell:
                places += pos != before
                before = pos.copy()
            key = (key ^ words[here]) * U(0x9FB21C651E98DF25)
            key ^= key >> U(29)
        if j and j % 60 == 0:
            coin = mix(coin)
        pos += ((coin[here] >> U(j % 60)) & U(1)).astype(np.int64)
    return (key, places) if tell else key


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", most: int = ITEMS, most_bytes: int = ITEM_BYTES, **how):
    """The items as indexes, one after another, each of about at most ``most`` items and ``most_bytes`` bytes of text (or one longer item)."""
    own = benchmark.select(F.col(f"`{key}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).filter(F.col("t").isNotNull())
    count, size = own.agg(F.count("*"), F.sum(F.octet_length("t").cast("long"))).first()
    n = max(-(-count // most), -(-(size or 0) // most_bytes))
    for b in range(n):
        rows = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect() if n > 1 else own.collect()
        yield Index(sorted(((r.i, r.t) for r in rows), key=lambda r: (r[0] is None, r)), **how)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each (document, item) that leaks: doc_id, item_id, edits, item_words, start, end (code points of the text)."""
    kind = docs.schema[key].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item}, edits int, item_words int, start long, end long"
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, **how):
        part = own.mapInArrow(_finder(docs.sparkSession, index), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _finder(spark: SparkSession, index: Index):
    shared = spark.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for b in batches:
            rows, which = [], []
            for block in blocks(folded(b.column(1))):
                for k, item, d, m, s, e in ix.search(block):
                    text = block.data[block.at[k] : block.at[k + 1]]
                    which.append(block.rows.start + k)
                    rows.append((ix.ids[item], d, m, int(starts_of(text[:s]).sum()), int(starts_of(text[:e]).sum())))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "edits", "item_words", "start", "end"],
                )

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that leak an item. One pass for each block of items, no shuffle."""
    for index in indexes(benchmark, **how):
        docs = docs.filter(_clean(docs.sparkSession, index)(F.col(f"`{text}`").cast("string")))
    return docs


def _clean(spark: SparkSession, index: Index):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        for block in blocks(folded(texts)):
            for k, *_ in shared.value.search(block):
                out[block.rows.start + k] = False
        return pa.array(out)

    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
