"""Near-duplicate vectors by product quantisation over inverted lists.

A coarse quantiser and, on its residuals, codebooks for eight subspaces are
fitted on a bounded sample of the unit vectors.  Every vector goes to the list
of its nearest centroid with its codes and the length ``e`` of what the codes
miss.  For a pair at distance at most r (cosine >= threshold),

* the lists to probe follow from a bound, not a number: if y is nearest to c_j
  and x to c_h, then |x - c_j|^2 - |x - c_h|^2 <= 2 r |c_j - c_h|;
* the table-lookup distance of x to the codes of y is at most r + e.

So no linked pair is lost: both tests only leave out what cannot be linked, and
the exact cosine in double precision decides about the rest.

Equal vectors are compared once, with their number.  Lists that follow each other
form a group of bounded size, so that a vector is sent once to all lists of a
group that it must visit; a list larger than that is a group of several blocks,
and visitors come in blocks, too, so a list with a third of all vectors is many
tasks.  Tasks return counts and one edge per linked vector, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components, local_roots
from touchline.llm.shared import mix64
from touchline.runtime import checkpointed, fits, written_table

THRESHOLD = 0.95
#: Vectors that the quantisers are fitted on: those with the smallest hashes of their ids.
MAX_SAMPLE = 10_000
SUBSPACES = 8
CODES = 256
ROUNDS = 6
MAX_LISTS = 4096
#: Members and visitors of one comparison take so much memory, as numbers of 8 bytes.
BLOCK_BYTES = 8 << 20
#: Vectors with more copies are looked up by broadcast; there is one for so many rows at most.
HOT_COPIES = 100_000
#: Vectors whose distances from all lists are held at once.
HOME_ROWS = 1024
#: Visitors whose distances are held at once.
STRIP = 256
#: Distances and cosines of the filters are trusted up to this; the exact cosine is not rounded.
SLACK = 1e-5


@dataclass
class Index:
    width: int
    centroids: np.ndarray
    bounds: list[tuple[int, int]]
    codebooks: list[np.ndarray]
    radius: float

    def home(self, unit: np.ndarray) -> np.ndarray:
        """The nearest list."""
        return np.concatenate([np.zeros(0, np.int64), *[self._distances(x, slice(None)).argmin(axis=1) for x in _strips(unit)]])

    def near(self, unit: np.ndarray, home: np.ndarray, first: int, last: int) -> np.ndarray:
        """Whether each list from ``first`` to before ``last`` is the home or a later one that may hold linked vectors."""
        own = self.centroids[home]
        from_home = (unit ** 2).sum(axis=1) - 2 * (unit * own).sum(axis=1) + (own ** 2).sum(axis=1)
        gaps = np.sqrt(np.maximum(_distances(own, self.centroids[first:last]), 0.0))
        near = self._distances(unit, slice(first, last)) - from_home[:, None] <= 2 * self.radius * gaps + SLACK
        lists = np.arange(first, last)
        return near & (lists > home[:, None]) | (lists == home[:, None])

    def _distances(self, unit: np.ndarray, lists: slice) -> np.ndarray:
        return _distances(unit, self.centroids[lists])

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        rest = unit - self.centroids[home]
        codes, missed = np.zeros((len(unit), len(self.codebooks)), np.uint8), np.zeros(len(unit))
        for m, (a, b) in enumerate(self.bounds):
            d = _distances(rest[:, a:b], self.codebooks[m])
            codes[:, m] = d.argmin(axis=1)
            missed += ((rest[:, a:b] - self.codebooks[m][codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)


def _strips(x: np.ndarray, rows: int = HOME_ROWS) -> list[np.ndarray]:
    return [x[at: at + rows] for at in range(0, len(x), rows)]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)


def _centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced rows; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(centres))
        for column in range(x.shape[1]):
            total = np.bincount(nearest, x[:, column], len(centres))
            centres[size > 0, column] = total[size > 0] / size[size > 0]
    return centres


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def fit(vectors: DataFrame, rows: int, threshold: float, max_sample: int = MAX_SAMPLE) -> Index:
    """Quantisers from about ``max_sample`` of the (id, vector) rows."""
    spread = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 30)) / float(1 << 30)
    got = vectors.filter(spread < min(1.0, max_sample / max(rows, 1))).select("id", "vector").toPandas().sort_values("id")
    if got.empty:
        got = vectors.orderBy("id").limit(max_sample).toPandas()
    sample = _units(np.array(got["vector"].tolist(), dtype=np.float64))
    width = sample.shape[1]
    lists = max(1, min(MAX_LISTS, len(sample) // 4, round(rows ** 0.5 / 8)))
    centroids = _centres(sample, lists)
    rest = sample - centroids[_distances(sample, centroids).argmin(axis=1)]
    edges = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
    bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Index(width, centroids, bounds, [_centres(rest[:, a:b], CODES) for a, b in bounds], float(np.sqrt(max(0.0, 2 - 2 * threshold))))


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of copies, and vectors as they are stored."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(), batch.column("copies").to_numpy(), values.reshape(batch.num_rows, -1)


@dataclass
class Deal:
    """Groups of consecutive lists, and how many blocks of members and of visitors each has."""

    first: np.ndarray  # list of each group, and the number of lists at the end
    members: np.ndarray
    visitors: np.ndarray

    def group_of(self, lists: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lists, side="right") - 1


def _deal(members: np.ndarray, visitors: np.ndarray, block_members: int, block_visitors: int) -> Deal:
    """Groups of at most ``block_members`` members, or of one list."""
    first, held = [0], 0
    for j, size in enumerate(members.tolist()):
        if held and held + size > block_members:
            first.append(j)
            held = 0
        held += size
    own = np.add.reduceat(members, first)
    # A visitor comes once to a group, and only from this list or an earlier one.
    guests = np.minimum(np.add.reduceat(visitors, first), np.cumsum(own))
    return Deal(np.array([*first, len(members)]), np.maximum(1, -(-own // block_members)), np.maximum(1, -(-guests // block_visitors)))


def linked_counts(vectors: DataFrame, index: Index, threshold: float, block_members: int | None = None,
                  block_visitors: int | None = None) -> DataFrame:
    """(id, n, root): vectors, copies counted, linked to one in one comparison, and the smallest id it reaches there.

    ``vectors`` are different ones: id, vector, and copies, how many have it.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    lists = len(index.centroids)
    block = max(256, BLOCK_BYTES // (8 * index.width))
    block_members, block_visitors = block_members or block, block_visitors or block

    def count(batches):
        index, total = shared.value, np.zeros((2, lists), np.int64)
        for batch in batches:
            for raw in _strips(_batch(batch)[2]):
                unit = _units(raw)
                home = index.home(unit)
                total += [np.bincount(home, minlength=lists), index.near(unit, home, 0, lists).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists)), pa.array(total[0]), pa.array(total[1])], names=["list", "m", "v"])

    sizes = vectors.mapInArrow(count, "list long, m long, v long").groupBy("list").agg(F.sum("m").alias("m"), F.sum("v").alias("v")).orderBy("list").toPandas()
    plan = _deal(sizes["m"].to_numpy(), sizes["v"].to_numpy(), block_members, block_visitors)
    kind = np.dtype("<f4" if vectors.schema["vector"].dataType.elementType.typeName() == "float" else "<f8")

    def deal(batches):
        index = shared.value
        for batch in batches:
            ids, copies, raw = _batch(batch)
            raw = raw.astype(kind)
            units = _units(raw)
            home = index.home(units)
            codes, missed = index.encode(units, home)
            visits = np.concatenate([np.zeros((0, len(plan.members)), bool)] + [
                np.logical_or.reduceat(index.near(unit, own, 0, lists), plan.first[:-1], axis=1) for unit, own in zip(_strips(units), _strips(home))])
            group = plan.group_of(home)
            block, visit = mix64(ids.view(np.uint64)), mix64(ids.view(np.uint64) + np.uint64(1))
            out = []
            for g in np.flatnonzero(visits.any(axis=0)).tolist():  # every member visits its own group
                members, visitors = np.flatnonzero(group == g), np.flatnonzero(visits[:, g])
                of_member, of_visitor = block[members] % np.uint64(plan.members[g]), visit[visitors] % np.uint64(plan.visitors[g])
                own = [members[of_member == b] for b in range(plan.members[g])]
                guests = [visitors[of_visitor == v] for v in range(plan.visitors[g])]
                for b, mine in enumerate(own):
                    for v, others in enumerate(guests):
                        if len(mine):
                            out.append((g, b, v, True, ids[mine], copies[mine], raw[mine], codes[mine], missed[mine], home[mine]))
                        if len(others):
                            out.append((g, b, v, False, ids[others], copies[others], raw[others], codes[:0], missed[:0], home[others]))
            for part in (out[i:i + 64] for i in range(0, len(out), 64)):
                columns = list(zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns[:4]] + [pa.array([a.tobytes() for a in c], pa.binary()) for c in columns[4:]],
                    names=["group", "b", "v", "member", "ids", "copies", "vectors", "codes", "missed", "homes"])

    dealt = vectors.mapInArrow(deal, "group long, b long, v long, member boolean, ids binary, copies binary, vectors binary, codes binary, missed binary, homes binary")
    pieces = int((plan.members * plan.visitors).sum())
    spread = dealt.repartition(pieces, "group", "b", "v") if pieces > 1 else dealt

    def compare(table: pa.Table) -> pa.Table:
        g = table["group"][0].as_py()
        ids, n, root = _compare(shared.value, int(plan.first[g]), int(plan.first[g + 1]), _side(table, False, shared.value, kind), _side(table, True, shared.value, kind), threshold)
        some = n > 0
        return pa.table({"id": ids[some], "n": n[some], "root": ids[root[some]]})

    return spread.groupBy("group", "b", "v").applyInArrow(compare, "id long, n long, root long")


@dataclass
class _Side:
    ids: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    missed: np.ndarray
    homes: np.ndarray


def _side(table: pa.Table, member: bool, index: Index, kind: np.dtype) -> _Side:
    """One side of a comparison by home list, and in the order of its ids."""
    mask = table["member"].to_numpy(zero_copy_only=False) == member
    rows = table.filter(pa.array(mask))
    kinds = (("ids", np.int64, 0), ("copies", np.int64, 0), ("vectors", kind, index.width), ("codes", np.uint8, len(index.codebooks)), ("missed", np.float64, 0), ("homes", np.int64, 0))
    parts = [np.frombuffer(b"".join(rows[name].to_pylist()), kind) for name, kind, _ in kinds]
    order = np.lexsort((parts[0], parts[-1]))
    parts = [p.reshape(-1, wide) if wide else p for p, (_, _, wide) in zip(parts, kinds)]
    side = _Side(*[p[order] if len(p) == len(order) else p for p in parts])
    side.vectors = _units(side.vectors)
    return side


def _compare(index: Index, first: int, last: int, guests: _Side, own: _Side, threshold: float):
    """Ids of both sides, links of each, and the place of the smallest id that each reaches."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near = np.concatenate([np.zeros((0, last - first), bool)] + [index.near(unit, home, first, last) for unit, home in zip(_strips(guests.vectors), _strips(guests.homes))])
    cuts = np.searchsorted(own.homes, np.arange(first, last + 1))
    for j in range(first, last):
        begin, end = cuts[j - first: j - first + 2].tolist()
        visitors = np.flatnonzero(near[:, j - first])
        if begin < end and len(visitors):
            for x, y in _list_links(index, j, guests.vectors, visitors, own.vectors[begin:end], own.codes[begin:end], own.missed[begin:end], threshold):
                other = guests.ids[x] != own.ids[y + begin]
                left.append(x[other])
                right.append(y[other] + begin)
    left, right = np.concatenate(left), np.concatenate(right)
    n = np.zeros(len(guests.ids) + len(own.ids), np.int64)
    np.add.at(n, left, own.copies[right])
    # A guest of a member's own list is a member, too, and counts its links as a guest.
    other = guests.homes[left] != own.homes[right]
    np.add.at(n, right[other] + len(guests.ids), guests.copies[left[other]])
    ids = np.concatenate([guests.ids, own.ids])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = local_roots(rank[left], rank[right + len(guests.ids)], len(ids))
    return ids, n, order[root[rank]]


def _list_links(index: Index, j: int, units: np.ndarray, visitors: np.ndarray, own: np.ndarray, codes: np.ndarray, missed: np.ndarray, threshold: float):
    """(visitor, member) of all pairs of the list at or above the threshold, strip by strip."""
    limit = ((index.radius + missed) ** 2 + SLACK).astype(np.float32)
    columns = [np.ascontiguousarray(codes[:, m]) for m in range(codes.shape[1])]
    for some in _strips(visitors, STRIP):
        rest = units[some] - index.centroids[j]
        lookup = np.zeros((len(rest), len(own)), np.float32)
        for (a, b), book, column in zip(index.bounds, index.codebooks, columns):
            lookup += np.take(np.maximum(_distances(rest[:, a:b], book), 0).astype(np.float32), column, axis=1)
        x, y = np.nonzero(lookup <= limit)
        for cut in range(0, len(x), 1 << 16):  # the exact cosines, a bounded number at a time
            gx, gy = some[x[cut: cut + (1 << 16)]], y[cut: cut + (1 << 16)]
            linked = np.einsum("ij,ij->i", units[gx], own[gy]) >= threshold
            yield gx[linked], gy[linked]


def _looked_up(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with groups that are a row for each key, with their number of rows, ``copies``: hot ones by broadcast, all if they are few."""
    groups = checkpointed(groups)
    if fits(groups):
        return rows.join(F.broadcast(groups), keys, "left")
    hot = groups.filter(F.col("copies") > HOT_COPIES)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(groups.filter(F.col("copies") <= HOT_COPIES), keys, "left")
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def with_copies(vectors: DataFrame) -> DataFrame:
    """id and vector with rep, the smallest id of an equal vector, and copies, the number of ids with it.

    Only vectors that repeat are looked up, by two 64-bit hashes.
    """
    hashed = vectors.withColumn("h", F.xxhash64("vector")).withColumn("k", F.xxhash64(F.lit(1), "vector"))
    groups = hashed.groupBy("h", "k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return _looked_up(hashed, groups, ["h", "k"]).select("id", "vector", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    max_sample: int = MAX_SAMPLE, block_members: int | None = None, block_visitors: int | None = None) -> DataFrame:
    """key, n_links, component_id and kept, one row for each id; other columns are left out, an empty table gives none.

    Rows of one id count as one vector, the largest as arrays compare; a row
    without an id is left out.  Vectors of different lengths do not link; each
    length that occurs more than once has its own index.
    """
    base = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.max(vector).alias("vector"))
    base = written_table(base, "vectors")
    good = base.filter(usable(F.col("vector")))
    widths = good.groupBy(F.size("vector").alias("w")).count().filter("count > 1").orderBy("w").collect()
    if not widths:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    known = written_table(with_copies(good), "copies")
    links = []
    for width in widths:
        different = known.filter((F.size("vector") == width["w"]) & (F.col("id") == F.col("rep"))).select("id", "vector", "copies")
        index = fit(different, width["count"], threshold, max_sample)
        links.append(written_table(linked_counts(different, index, threshold, block_members, block_visitors), "links"))
    found = reduce(DataFrame.unionByName, links)
    counts = found.groupBy("id").agg(F.sum("n").alias("n")).select(F.col("id").alias("rep"), "n")
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    reps = known.filter(F.col("id") == F.col("rep")).select("rep", "copies")
    about = counts.join(parts, "rep", "full").join(reps, "rep")
    member = _looked_up(known.select("id", "rep", F.col("copies").alias("equal")), about, ["rep"])
    member = member.select("id", (F.coalesce("n", F.lit(0)) + F.col("equal") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = base.select("id").join(member, "id", "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), (component == F.col("id")).alias("kept"))
