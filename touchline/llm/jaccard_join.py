"""Exact similarity join of shingle sets, down to classes of linked documents.

Two sets link if 100 * |x & y| >= percent * |x | y|.  Every set is sorted by one
global order, rare shingles first; linked sets then share a shingle of their
prefixes (n - ceil(n * percent / 100) + 1 shingles), so an index of the prefixes
has every linked pair in one of its lists.  Equal sets are one from the start.

Set relations keep the lists from being paired out:

* *Answers of a similar set.*  First every list ties its members to leaders of
  nearly their size, a few pairs a member.  Leaders are the sets with the fewest
  rarer shingles, as the source of many copies has none of their changes.  A
  member that links to its leader shares its class, so members of a class are
  never compared with one another.  Every member is then known as the leader
  with shingles added and removed, and overlaps of members follow from these
  alone: with removed parts R and S and added parts A and B of a leader of n
  shingles, one is n - |R u S| + |A n B|.  Only pairs that no leader has met both
  of are left, and their overlaps are derived from those of their leaders, too.
* *Blocks of positions.*  A list is cut into blocks of sizes and prefix
  positions.  Pairs of blocks whose bounds rule out the required overlap are
  skipped whole, the other ones are tested pair by pair.

Shingles are ordered by the number of sets that have them, counted over all
documents; any order is right, and this one keeps lists short.  Counts of two
and more are sorted arrays in the shared folder, mapped by the workers, and
shingles of one set never enter the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import byteblocks
from touchline.llm.components import components, local_roots
from touchline.llm.shared import append_columns, blob_rows, mix64
from touchline.llm.shared_files import mapped, write_arrays
from touchline.runtime import fits, scratch_path, written_table

WORDS = 5
PERCENT = 80
#: Prefix entries that meet in one bucket of the index, about.
BUCKET_ENTRIES = 250_000
#: Entries that a task gathers before it passes them on.
FLUSH_ENTRIES = 400_000
#: Bits of the filter by which a scan picks documents.
MAX_FILTER_BITS = 1 << 27
#: Leaders of a list.
LEADERS = 3
#: Members of a leader outside of its class, and members at all, that are compared at once; shingles at once.
OPEN_BLOCK = 512
MEMBER_BLOCK = 2048
INCIDENCE_WIDTH = 4096
#: Members of a list in one block.
LIST_BLOCK = 256

_SALT = np.uint64(0x9E3779B97F4A7C15)
_ENTRY = np.dtype([("k", "<u8"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4")])


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text is one shingle, one without words has none."""
    factors = [pow(0xD6E8FEB86659FD93, words - 1 - i, 1 << 64) for i in range(words)]
    for block in byteblocks.blocks(column):
        found = byteblocks.words(block, byteblocks.SPACE_ENDED)
        h = found.hashes
        count = max(0, len(h) - words + 1)
        sums = np.zeros(count, np.uint64)
        for i, factor in enumerate(factors):
            sums += h[i: i + count] * np.uint64(factor)
        sums = mix64(sums)
        rows = found.rows.tolist()
        for a, b in zip(rows[:-1], rows[1:]):
            if b - a >= words:
                yield np.unique(sums[a: b - words + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for i in range(a, b):
                    short = mix64(short * _SALT + h[i: i + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    total = mix64(shingles ^ _SALT).sum(dtype=np.uint64, keepdims=True)
    return int(mix64(total + np.uint64(len(shingles))).view(np.int64)[0])


def set_names(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Adds n_shingles and set_name (null for an empty set), without the text."""

    def start():
        def compute(column: pa.Array) -> list:
            sizes, names = [], []
            for shingles in shingle_sets(column, words):
                sizes.append(len(shingles))
                names.append(signature(shingles) if len(shingles) else None)
            return [pa.array(sizes, pa.int64()), pa.array(names, pa.int64())]

        return compute

    return append_columns(docs, text, [("n_shingles", "long"), ("set_name", "long")], start, keep_text=False)


def _distinct_sets(batches, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(name, shingles) of every non-empty set of a task, each once."""
    seen: set[int] = set()
    for batch in batches:
        for shingles in shingle_sets(batch.column("text"), words):
            if len(shingles):
                name = signature(shingles)
                if name not in seen:
                    seen.add(name)
                    yield name, shingles


def _bucket(hashes: np.ndarray, extra: int) -> np.ndarray:
    """The leading 8 + ``extra`` bits."""
    return (hashes >> np.uint64(56 - extra)).astype(np.int64)


def _blob_batches(keys: np.ndarray, items: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = list(blob_rows(keys, items))
    for at in range(0, len(rows), 256):
        part = rows[at: at + 256]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([b for _, b in part], pa.binary())], names=["bucket", "items"])


def count_shingles(texts: DataFrame, folder: str, extra: int, words: int = WORDS) -> None:
    """Write, for each bucket, the bits 24 to 55 of shingles that two or more sets have, and how many."""

    def emit(batches):
        held, size = [], 0
        for _, shingles in _distinct_sets(batches, words):
            held.append(shingles)
            size += len(shingles)
            if size >= FLUSH_ENTRIES:
                yield from pass_on(held)
                held, size = [], 0
        if held:
            yield from pass_on(held)

    def pass_on(held):
        h = np.concatenate(held)
        yield from _blob_batches(_bucket(h, extra), _middle(h))

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(b.as_buffer(), "<u4") for chunk in table["items"].chunks for b in chunk]))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        often = counts > 1
        write_arrays(f"{folder}/counts-{table['bucket'][0].as_py()}", [keys[first[often]], counts[often].astype("<u4")])
        return pa.table({"n": [int(often.sum())]})

    texts.mapInArrow(emit, "bucket long, items binary").groupBy("bucket").applyInArrow(count, "n long").agg(F.sum("n")).collect()


def _middle(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype("<u4")


class Counts:
    """Look-ups in what ``count_shingles`` has written."""

    def __init__(self, folder: str, extra: int):
        self.folder, self.extra, self.files = folder, extra, {}

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The counts of sorted hashes, at least 1."""
        out = np.ones(len(hashes), np.int64)
        bucket = _bucket(hashes, self.extra)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for at, part in zip(np.concatenate([[0], cuts]), np.split(hashes, cuts)):
            if len(part):
                b = int(bucket[at])
                if b not in self.files:
                    self.files[b] = mapped(f"{self.folder}/counts-{b}").view("<u4")
                keys, counts = np.split(self.files[b], 2)
                if len(keys):
                    wanted = _middle(part)
                    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    out[at: at + len(part)] = np.where(keys[place] == wanted, counts[place], 1)
        return out


def _entries(sets: list[tuple[int, np.ndarray]], counts: Counts, percent: int) -> np.ndarray:
    """Index entries of the prefixes of some sets; shingles that only one set has are left out."""
    distinct, which = np.unique(np.concatenate([shingles for _, shingles in sets]), return_inverse=True)
    count = counts.of(distinct)[which]
    out, at = [], 0
    for name, shingles in sets:
        n = len(shingles)
        mine = count[at: at + n]
        at += n
        order = np.argsort(mine, kind="stable")[: n + percent * n // -100 + 1]
        shared = np.flatnonzero(mine[order] > 1)
        entries = np.empty(len(shared), _ENTRY)
        entries["k"], entries["s"], entries["n"], entries["p"] = shingles[order[shared]], name, n, shared
        out.append(entries)
    return np.concatenate(out)


def least_overlap(n, m, percent: int):
    """The smallest overlap with which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_lists(texts: DataFrame, folder: str, extra: int, percent: int, words: int) -> DataFrame:
    """(bucket, k, s, n, p): index entries of shingles that lie in the prefixes of two or more sets."""

    def emit(batches):
        counts = Counts(folder, extra)
        held, size = [], 0
        for name, shingles in _distinct_sets(batches, words):
            held.append((name, shingles))
            size += len(shingles)
            if size >= FLUSH_ENTRIES:
                yield from pass_on(held, counts)
                held, size = [], 0
        if held:
            yield from pass_on(held, counts)

    def pass_on(held, counts):
        entries = _entries(held, counts, percent)
        yield from _blob_batches(_bucket(entries["k"], extra), entries)

    def shared_only(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(b.as_buffer(), _ENTRY) for chunk in table["items"].chunks for b in chunk])
        entries = entries[np.lexsort((entries["s"], entries["k"]))]
        new_k = np.concatenate([[True], entries["k"][1:] != entries["k"][:-1]])
        entries = entries[new_k | np.concatenate([[True], entries["s"][1:] != entries["s"][:-1]])]
        new_k = np.concatenate([[True], entries["k"][1:] != entries["k"][:-1]])
        sizes = np.diff(np.append(np.flatnonzero(new_k), len(entries)))
        entries = entries[np.repeat(sizes > 1, sizes)]
        return pa.table({"bucket": pa.array(np.full(len(entries), table["bucket"][0].as_py())), "k": pa.array(np.ascontiguousarray(entries["k"]).view(np.int64)),
                         "s": pa.array(np.ascontiguousarray(entries["s"])), "n": pa.array(entries["n"].astype(np.int64)), "p": pa.array(entries["p"].astype(np.int64))})

    lists = texts.mapInArrow(emit, "bucket long, items binary").groupBy("bucket").applyInArrow(shared_only, "bucket long, k long, s long, n long, p long")
    return written_table(lists, "lists")


def _lists(table: pa.Table, *names: str) -> Iterator[list[np.ndarray]]:
    """The columns of each list of a bucket."""
    k = table["k"].to_numpy()
    order = np.argsort(k, kind="stable")
    cuts = np.flatnonzero(np.diff(k[order])) + 1
    columns = [table[name].to_numpy()[order] for name in names]
    yield from zip(*[np.split(c, cuts) for c in columns])


def _leaders(s, n, p, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of a list's leaders, and which sets are of nearly their size."""
    for leader in np.lexsort((s, p))[:LEADERS].tolist():
        yield leader, (n * 100 >= n[leader] * percent) & (n[leader] * 100 >= n * percent)


def leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): in every list a few leaders, each with the members of nearly its size."""

    def pairs(table: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        for s, n, p in _lists(table, "s", "n", "p"):
            for leader, near in _leaders(s, n, p, percent):
                near[leader] = False
                out.append(np.stack([np.full(int(near.sum()), s[leader]), s[near]]))
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return lists.groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of one list and different classes that no leader of the list has met both of.

    Those that size and positions rule out are left out; lists have a column c.
    """

    def pairs(table: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        for s, n, p, c in _lists(table, "s", "n", "p", "c"):
            if (c == c[0]).all():
                continue
            met = np.zeros((len(s), LEADERS), bool)
            for number, (_, near) in enumerate(_leaders(s, n, p, percent)):
                met[:, number] = near
            if met.all(axis=0).any():
                continue
            order = np.lexsort((p, n))
            out += _pairs_of_list(s[order], n[order], p[order], c[order], percent, met[order])
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": both[0], "b": both[1]})

    return lists.groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def _pairs_of_list(s, n, p, c, percent: int, met) -> list[np.ndarray]:
    """Pairs of a list sorted by size and position, block by block; ``met`` tells which leaders have met a set."""
    out = []
    begins = list(range(0, len(s), LIST_BLOCK))
    bounds = [(n[i: i + LIST_BLOCK].min(), n[i: i + LIST_BLOCK].max(), p[i: i + LIST_BLOCK].min(), p[i: i + LIST_BLOCK].max()) for i in begins]
    for x, i in enumerate(begins):
        a = slice(i, i + LIST_BLOCK)
        n1, n2, p1, p2 = bounds[x]
        for y in range(x, len(begins)):
            m1, m2, q1, q2 = bounds[y]
            if m1 * percent > n2 * 100:
                break  # larger sets from here on
            if min(p2, q2) + 1 + min(n2 - p1, m2 - q1) - 1 < least_overlap(n1, m1, percent):
                continue
            b = slice(begins[y], begins[y] + LIST_BLOCK)
            small, large = np.minimum(n[a][:, None], n[b]), np.maximum(n[a][:, None], n[b])
            reach = np.minimum(p[a][:, None], p[b]) + np.minimum((n[a] - p[a])[:, None], n[b] - p[b])
            good = (c[a][:, None] != c[b]) & (small * 100 >= large * percent) & (reach >= least_overlap(small, large, percent))
            good &= ~(met[a][:, None, :] & met[b]).any(axis=2)
            left, right = np.nonzero(good)
            left, right = s[a][left], s[b][right]
            out.append(np.stack([np.minimum(left, right), np.maximum(left, right)]))
    return out


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (id, text) of ``docs`` with the wanted ids (doc), and of a few more.

    A filter of bounded size makes the scan pass on little else; where it is
    full, all texts are passed on, and joins with them stay right.
    """
    wanted = written_table(wanted.distinct(), "wanted")
    bits = 1 << 16
    rows = wanted.count()
    while bits < min(MAX_FILTER_BITS, 16 * rows):
        bits *= 2
    # One bit a document: the low bits of its hash say which.
    place = F.pmod(F.xxhash64("doc"), F.lit(bits))
    found = wanted.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc), 64) as int))")).alias("b")).toPandas()
    mask = np.zeros(bits // 64, np.int64)
    mask[found["w"]] = found["b"]
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def pick(batches):
        mask = shared.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            yield batch.take(pa.array(np.flatnonzero((mask[place >> 6] >> (place & 63)) & 1))).select(["id", "text"])

    tested = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("place"))
    return written_table(tested.mapInArrow(pick, "id long, text string"), "texts")


def _array(blob) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), "<u8") if blob.is_valid else np.zeros(0, np.uint64)


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


class _Sets:
    """The shingles of texts by the name of their set, those met last."""

    def __init__(self, words: int):
        self.words, self.held, self.size = words, {}, 0

    def get(self, name: int, text: pa.Scalar) -> np.ndarray | None:
        """None if the text is not of that set: its document has several texts."""
        if name not in self.held:
            shingles = next(shingle_sets(pa.array([text.as_py()], pa.string()), self.words))
            if not len(shingles) or signature(shingles) != name:
                return None  # not held: the right text may follow
            if self.size + len(shingles) > FLUSH_ENTRIES:
                self.held, self.size = {}, 0
            self.held[name] = shingles
            self.size += len(shingles)
        return self.held[name]


def with_texts(pairs: DataFrame, names: DataFrame, texts: DataFrame, sides: dict[str, str]) -> DataFrame:
    """Adds the text (value) of the set that a column (key) names."""
    for column, new in sides.items():
        of = names.select(F.col("set_name").alias(column), F.col("doc").alias("__doc"))
        pairs = pairs.join(of, column).join(texts.select(F.col("id").alias("__doc"), F.col("text").alias(new)), "__doc").drop("__doc")
    return pairs


_RELATION = "a long, b long, n long, linked boolean, added binary, removed binary"


def relations(pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """For (a, b, x, y): the size of the set a of text x, whether b of text y links to it, what b adds and what it lacks."""

    def compare(batches):
        sets = _Sets(words)
        for batch in batches:
            rows = []
            for a, b, text, other in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = sets.get(a, text), sets.get(b, other)
                if x is None or y is None:
                    continue
                inside = _inside(y, x)
                common = int(inside.sum())
                linked = 100 * common >= percent * (len(x) + len(y) - common)
                rows.append((a, b, len(x), linked, y[~inside].tobytes(), x[~_inside(x, y)].tobytes()))
            columns = list(zip(*rows)) or [[] for _ in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "n", "linked", "added", "removed"])

    return pairs.select("a", "b", "x", "y").mapInArrow(compare, _RELATION)


def links_by_leader(related: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) that tie together what links among the members of a leader, for members that are not of its class.

    A leader's members are compared in blocks, the ones outside of its class
    with all; a leader of any number of members is as many tasks as it takes.
    """
    of = classes.select(F.col("node"), F.col("component"))
    known = related.join(of.select(F.col("node").alias("b"), F.col("component").alias("c")), "b", "left").withColumn("c", F.coalesce("c", "b"))
    known = known.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").withColumn("open", F.col("c") != F.coalesce("ca", "a"))
    sizes = known.groupBy("a").agg(F.count(F.lit(1)).alias("m"), F.count_if("open").alias("u")).filter("u > 0 AND m > 1")
    known = known.join(sizes.selectExpr("a", f"1 + (u - 1) div {OPEN_BLOCK} AS us", f"1 + (m - 1) div {MEMBER_BLOCK} AS ms"), "a")
    mine = [F.pmod(F.xxhash64("b"), F.col(x)) for x in ("us", "ms")]
    every = [F.sequence(F.lit(0).cast("long"), F.col(x) - 1) for x in ("us", "ms")]
    columns = ["a", "b", "n", "c", "added", "removed"]
    asking = known.filter("open").select(*columns, F.lit(True).alias("asks"), mine[0].alias("i"), F.explode(every[1]).alias("j"))
    asked = known.select(*columns, F.lit(False).alias("asks"), F.explode(every[0]).alias("i"), mine[1].alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, c = table["b"].to_numpy(), table["c"].to_numpy()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        z, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = np.zeros((2, 0), np.int64)
        if len(z) and len(y):
            n = table["n"][0].as_py()
            added, removed = ([_array(v) for chunk in table[name].chunks for v in chunk] for name in ("added", "removed"))
            more, less = (np.array([len(x) for x in part]) for part in (added, removed))
            size = n + more - less
            need = least_overlap(size[z][:, None], size[y], percent)
            open_ = (c[z][:, None] != c[y]) & (n - np.maximum(less[z][:, None], less[y]) + np.minimum(more[z][:, None], more[y]) >= need)
            z, y, open_, need = z[open_.any(axis=1)], y[open_.any(axis=0)], open_[open_.any(axis=1)][:, open_.any(axis=0)], need[open_.any(axis=1)][:, open_.any(axis=0)]
            if len(z):
                common = n - less[z][:, None] - less[y] + _common([removed[i] for i in z], [removed[i] for i in y]) \
                    + _common([added[i] for i in z], [added[i] for i in y])
                left, right = np.nonzero(open_ & (common >= need))
                nodes, place = np.unique(np.concatenate([ids[z][left], ids[y][right]]), return_inverse=True)
                root = local_roots(place[: len(left)], place[len(left):], len(nodes))
                tied = root != np.arange(len(nodes))
                out = np.stack([nodes[tied], nodes[root[tied]]])
        return pa.table({"a": out[0], "b": out[1]})

    # Both sides lie by leader already, which would do for the grouping and leave all blocks of one in a task.
    return asking.unionByName(asked).repartition("a", "i", "j").groupBy("a", "i", "j").applyInArrow(compare, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of incidence tables of a bounded width."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for part in (left, right):
        sides.append((np.concatenate([np.zeros(0, np.uint64), *part]), np.repeat(np.arange(len(part)), [len(x) for x in part])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for at in range(0, len(shared), INCIDENCE_WIDTH):
        part = shared[at: at + INCIDENCE_WIDTH]
        tables = []
        for (values, row), count in zip(sides, out.shape):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            table = np.zeros((count, len(part)), np.float32)
            table[row[hit], place[hit]] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def with_leaders(pairs: DataFrame, led: DataFrame) -> DataFrame:
    """(z, y) and for both the leader and what is added and removed; a set without a leader is its own."""
    one = led.groupBy(F.col("b").alias("s")).agg(F.min(F.struct("a", "added", "removed")).alias("l"))
    rows = pairs.select(F.col("a").alias("z"), F.col("b").alias("y"))
    for side in ("z", "y"):
        mine = one.select(F.col("s").alias(side), F.col("l.a").alias(f"{side}_lead"), F.col("l.added").alias(f"{side}_added"), F.col("l.removed").alias(f"{side}_removed"))
        rows = rows.join(mine, side, "left").withColumn(f"{side}_lead", F.coalesce(f"{side}_lead", side))
    return rows


def derived_links(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Those (a, b) that link, of pairs with leaders and their texts; overlaps are derived from those of the leaders."""

    def verify(batches):
        sets, base = _Sets(words), {}
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            ids = {name: columns[name].to_pylist() for name in ("z", "y", "z_lead", "y_lead")}
            out = []
            for i in range(batch.num_rows):
                leaders = ids["z_lead"][i], ids["y_lead"][i]
                x, w = sets.get(leaders[0], columns["z_text"][i]), sets.get(leaders[1], columns["y_text"][i])
                if x is None or w is None:
                    continue
                z_added, z_removed, y_added, y_removed = (_array(columns[n][i]) for n in ("z_added", "z_removed", "y_added", "y_removed"))
                if leaders not in base:
                    if len(base) > 100_000:
                        base.clear()
                    base[leaders] = int(_inside(x, w).sum())
                n, m = len(x) + len(z_added) - len(z_removed), len(w) + len(y_added) - len(y_removed)
                if base[leaders] + len(z_added) + len(y_added) < least_overlap(n, m, percent):
                    continue  # no way from the leaders' overlap to the required one
                in_y = lambda v: (_inside(v, w) & ~_inside(v, y_removed)) | _inside(v, y_added)
                common = base[leaders] - int(_inside(y_removed, x).sum()) + int(_inside(y_added, x).sum())  # of the leader x and y
                common += int(in_y(z_added).sum()) - int(in_y(z_removed).sum())
                if 100 * common >= percent * (n + m - common):
                    out.append((ids["z"][i], ids["y"][i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    columns = ["z", "y", *[f"{s}_{n}" for s in ("z", "y") for n in ("lead", "text", "added", "removed")]]
    return rows.select(columns).mapInArrow(verify, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
            bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row.

    A row without a key has a null component and links with nothing; so does,
    apart from its own key, a null text and one without words.  Rows of one key
    and different texts link their classes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    named = written_table(set_names(base, "text", words), "named")
    rows, shingles = named.agg(F.count("id"), F.sum("n_shingles")).first()
    spread = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (shingles or 0) // (5 * bucket_entries))
    extra = max(0, min(24, (spread - 1).bit_length() - 8))
    base = base.filter("id IS NOT NULL")
    folder = scratch_path(spark, "shingles")
    count_shingles(base.select("text"), folder, extra, words)
    lists = prefix_lists(base.select("text"), folder, extra, percent, words)
    names = written_table(named.filter("id IS NOT NULL AND set_name IS NOT NULL").groupBy("set_name").agg(F.min("id").alias("doc")), "names")
    # Within classes: each member with its leader.
    led_pairs = written_table(leader_pairs(lists, percent), "leaders")
    members = lists.select(F.col("s").alias("set_name")).distinct()
    texts = texts_of(base, members.join(names, "set_name").select("doc"))
    related = written_table(relations(with_texts(led_pairs, names, texts, {"b": "y", "a": "x"}), percent, words), "related")
    led = related.filter("linked")
    first = written_table(components(led.select("a", "b")), "first")
    derived = written_table(links_by_leader(related, first, percent), "derived")
    # Across classes, the pairs that no leader has met both of.
    open_lists = lists.join(first.select(F.col("node").alias("s"), "component"), "s", "left") \
        .select("bucket", "k", "s", "n", "p", F.coalesce("component", "s").alias("c"))
    rest = written_table(cross_pairs(open_lists, percent).join(led_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    edges = led.select("a", "b").unionByName(derived)
    if not rest.isEmpty():
        pairs = with_texts(with_leaders(rest, led), names, texts, {"z_lead": "z_text", "y_lead": "y_text"})
        edges = edges.unionByName(written_table(derived_links(pairs, percent, words), "links"))
    # From sets to documents; a key with several texts ties its sets together.
    twice = named.filter("id IS NOT NULL AND set_name IS NOT NULL").groupBy("id").agg(F.min("set_name").alias("a"), F.max("set_name").alias("b")).filter("a <> b") \
        if rows and named.select("id").distinct().count() < rows else None
    if twice is not None:
        low = twice.select("id", "a")
        edges = edges.unionByName(named.join(low, "id").filter("set_name <> a").select("a", F.col("set_name").alias("b")))
    parts = components(edges)
    linked = names.join(parts, names["set_name"] == parts["node"], "left")
    linked = linked.select("set_name", "doc", F.coalesce("component", "set_name").alias("c"))
    smallest = linked.groupBy("c").agg(F.min("doc").alias("component_id"))
    of_set = linked.join(smallest, "c").select("set_name", "component_id")
    out = named.join(of_set, "set_name", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = 1_000_000, **options) -> DataFrame:
    """The documents whose key is the smallest of their class, all columns; one row of each key."""
    found = written_table(classes(docs, key, text, **options), "classes")
    gone = written_table(found.filter(f"component_id <> `{key}`").select(key).distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if fits(gone, max_broadcast) else gone, key, "left_anti")
    rows, keys = found.agg(F.count(key), F.countDistinct(key)).first()
    return kept if rows == keys else kept.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.filter(F.col(key).isNull()))
