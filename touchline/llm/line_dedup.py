"""Reversible dedup of lines: exact reference counts behind sharded cuckoo filters.

The index has three tables in the shared folder.  ``refs`` has one row for each
document and key of a line; ``counts`` says for each key how many references it
has and which are the first and the last document with it; ``filters`` has one
cuckoo filter for each shard of the keys, with one copy of a key that one
document holds and two of a key that several do.  A new document's key that its
filter does not know is new, and a line whose key is in less than twice is no
duplicate: only what passes a filter is joined with the exact counts, which
decide.  As references are counted, documents can be taken out again, and lines
that only they repeated come back.

Keys are dealt to shards by their hashes.  A key with so many references that
its shard would stand out is among at most a million and is joined by broadcast
instead, so a line that a third of all documents share stays in the map tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.cuckoo import CuckooFilter, Full
from touchline.llm.shared import mix64
from touchline.runtime import written_table

#: What is stripped off a line, and the least length of a key in code points.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_POINTS = 10
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: References that one shard has on average.
SHARD_REFS = 200_000
#: A key is frequent beyond this many references, or beyond a millionth of all if that is more.
FREQUENT = 10_000
MOST_FREQUENT_KEYS = 1_000_000

KEY = ["k1", "k2"]


def lines_of(text: Column) -> Column:
    """A text's lines; a null or empty one has one, empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Without blanks at both ends and with small letters for A-Z."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Lower-casing is faster than translating and the same where all is ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def _first_hash(key: Column) -> Column:
    return F.when(F.char_length(key) >= LEAST_POINTS, F.xxhash64(key))


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, k1, k2): each document row's different keys as 128-bit hashes; rows without an id have none."""
    keys = F.filter(F.transform(lines_of(F.col(f"`{text}`")), line_key), lambda k: F.char_length(k) >= LEAST_POINTS)
    rows = docs.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc"), F.explode(F.array_distinct(keys)).alias("key"))
    return rows.select("doc", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))


def _copies(refs: Column, first: Column, last: Column) -> Column:
    """Copies of a key in its filter: none, one for one document, two for more."""
    return F.when(F.coalesce(refs, F.lit(0)) == 0, 0).when(first == last, 1).otherwise(2).cast("byte")


def _filter_keys(table: pa.Table) -> np.ndarray:
    k1, k2 = (table[name].to_numpy().view(np.uint64) for name in KEY)
    return mix64(k1 ^ mix64(k2))


def _renewed(keys: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's filter after its keys have changed from ``before`` to ``after`` copies."""
    shard = (keys if keys.num_rows else old)["shard"][:1]
    hashes, before, after = _filter_keys(keys), keys["before"].to_numpy().astype(np.int64), keys["after"].to_numpy().astype(np.int64)
    filter_ = None
    if old.num_rows:
        filter_ = CuckooFilter.loaded(old["filter"][0].as_py())
        try:
            less, more = before > after, after > before
            filter_.delete(hashes[less], (before - after)[less])
            filter_.insert(hashes[more], (after - before)[more])
        except Full:
            filter_ = None
    if filter_ is None:
        filter_ = CuckooFilter.built(hashes, after)
    return pa.table({"shard": shard, "filter": pa.array([filter_.blob()], pa.binary())})


@dataclass(frozen=True)
class LineIndex:
    """The tables of an index; inserting and deleting give a new one and leave this as it is."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def of(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index of the documents of a table."""
        refs = written_table(references(docs, key, text), "line-refs")
        return cls._fresh(refs, refs.count())

    @classmethod
    def _fresh(cls, refs: DataFrame, n: int) -> LineIndex:
        counts = _counted(refs).withColumns({"before": F.lit(0).cast("byte"), "after": _copies(F.col("refs"), F.col("first"), F.col("last"))})
        return cls._stored(refs, counts, None, max(1, -(-n // SHARD_REFS)))

    @classmethod
    def _stored(cls, refs: DataFrame, counts: DataFrame, old: DataFrame | None, shards: int) -> LineIndex:
        """Writes counts with their changes, then brings the filters up to date."""
        counts = written_table(counts, "line-counts")
        changes = counts.select(_shard(shards), *KEY, "before", "after")
        if old is None:
            old = changes.limit(0).select("shard", F.lit(b"").alias("filter"))
        filters = changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_renewed, "shard long, filter binary")
        filters = written_table(filters, "line-filters")
        return cls(refs, counts.filter("refs > 0").select(*KEY, "refs", "first", "last"), filters, shards)

    def passing(self, keys: DataFrame, copies: int) -> DataFrame:
        """``keys`` with ``passes``: whether the filter of its shard has a key so many times.  Never false if it was put in as often."""
        names, schema = keys.columns, keys.schema.add("passes", "boolean")

        def probe(rows: pa.Table, filter_: pa.Table) -> pa.Table:
            if not rows.num_rows or not filter_.num_rows:
                found = np.zeros(rows.num_rows, bool)
            else:
                found = CuckooFilter.loaded(filter_["filter"][0].as_py()).count(_filter_keys(rows)) >= copies
            return rows.select(names).append_column("passes", pa.array(found))

        dealt = keys.select("*", _shard(self.shards))
        return dealt.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, schema)

    def inserted(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with the documents of another table, too."""
        new = written_table(references(docs, key, text), "line-refs")
        refs = self.refs.unionByName(new)
        n = refs.count()
        if n > 4 * SHARD_REFS * self.shards:  # outgrown: deal the keys to more shards
            return self._fresh(refs, n)
        probed = written_table(self.passing(_counted(new), 1), "line-probes")
        known = probed.filter("passes").select(*KEY, *[F.col(c).alias(f"new_{c}") for c in ("refs", "first", "last")])
        merged = self.counts.join(known, KEY, "full").select(
            *KEY, (F.coalesce("refs", F.lit(0)) + F.coalesce("new_refs", F.lit(0))).alias("refs"),
            F.least("first", "new_first").alias("first"), F.greatest("last", "new_last").alias("last"),
            _copies(F.col("refs"), F.col("first"), F.col("last")).alias("before"))
        unknown = probed.filter("NOT passes").select(*KEY, "refs", "first", "last", F.lit(0).cast("byte").alias("before"))
        counts = merged.unionByName(unknown).withColumn("after", _copies(F.col("refs"), F.col("first"), F.col("last")))
        return self._stored(refs, counts, self.filters, self.shards)

    def deleted(self, docs: DataFrame, key: str = "doc_id") -> LineIndex:
        """The index without the documents of these ids; ids that it does not have change nothing."""
        ids = docs.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc")).distinct()
        gone = _counted(self.refs.join(ids, "doc", "left_semi"))
        refs = written_table(self.refs.join(ids, "doc", "left_anti"), "line-refs")
        less = gone.select(*KEY, *[F.col(c).alias(f"gone_{c}") for c in ("refs", "first", "last")])
        rest = F.col("refs") - F.coalesce("gone_refs", F.lit(0))
        counts = written_table(self.counts.join(less, KEY, "left").select(
            *KEY, rest.alias("refs"), "first", "last", _copies(F.col("refs"), F.col("first"), F.col("last")).alias("before"),
            ((rest > 0) & ((F.col("gone_first") == F.col("first")) | (F.col("gone_last") == F.col("last")))).alias("open")), "line-counts")
        # Only keys that lost their first or last document need a look at the references left.
        ends = refs.join(counts.filter("open").select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(
            F.min("doc").alias("new_first"), F.max("doc").alias("new_last"))
        counts = counts.join(ends, KEY, "left").select(
            *KEY, "refs", F.coalesce("new_first", "first").alias("first"), F.coalesce("new_last", "last").alias("last"), "before")
        counts = counts.withColumn("after", _copies(F.col("refs"), F.col("first"), F.col("last")))
        return self._stored(refs, counts, self.filters, self.shards)

    def repeats(self) -> DataFrame:
        """(doc, dropped): first hashes of the keys that a document holds and one with a smaller id holds, too."""
        total = self.refs.count()
        frequent = max(FREQUENT, total // MOST_FREQUENT_KEYS)
        repeated = self.counts.filter("first < last").select(*KEY, "first", "refs")
        often = repeated.filter(F.col("refs") > frequent).drop("refs")  # at most total / frequent keys, a million
        tagged = self.refs.join(F.broadcast(often), KEY, "left")
        here = tagged.filter("first IS NOT NULL AND doc > first").select("doc", "k1")
        rare = self.refs.join(F.broadcast(often.select(*KEY)), KEY, "left_anti")
        maybe = self.passing(rare, 2).filter("passes").drop("passes")
        there = maybe.join(repeated.filter(F.col("refs") <= frequent), KEY).filter("doc > first").select("doc", "k1")
        return here.unionByName(there).groupBy("doc").agg(F.collect_set("k1").alias("dropped"))

    def kept(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """All columns, and n_lines, n_dropped and kept, which replace columns of these names.

        ``kept`` is the text without the lines whose keys (of ten code points or
        more) an indexed document with a smaller id holds; all lines of a key
        stay in the smallest one.  Rows of one id are one document.  Rows that
        the index does not have, or without an id, keep all lines and make no
        other row lose any.  A null or empty text is one empty line.
        """
        new = ["n_lines", "n_dropped", "kept"]
        rows = docs.drop(*new)
        repeats = self.repeats().select(F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped"))
        joined = rows.join(repeats.hint("shuffle_hash"), F.col(f"`{key}`") == F.col("__doc"), "left")
        lines = lines_of(F.col(f"`{text}`"))
        hashes = F.when(F.col("__dropped").isNotNull(), F.transform(lines, lambda x: _first_hash(line_key(x))))
        marked = joined.withColumn("__flags", _members(hashes, F.col("__dropped")))
        flags = F.col("__flags")
        rest = F.array_join(F.filter(lines, lambda x, i: ~F.get(flags, i)), "\n")
        return marked.select(
            *[f"`{c}`" for c in rows.columns], F.size(lines).cast("long").alias("n_lines"),
            F.when(flags.isNull(), 0).otherwise(F.size(F.filter(flags, lambda x: x))).cast("long").alias("n_dropped"),
            F.when(flags.isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(rest).alias("kept"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("k1"), F.lit(shards).cast("long")).alias("shard")


def _members(values: Column, wanted: Column) -> Column:
    """Which values of an array are in another; null where that is null."""
    @F.arrow_udf("array<boolean>")
    def search(values: pa.Array, wanted: pa.Array) -> pa.Array:
        counts, sizes = values.value_lengths().fill_null(0).to_numpy(), wanted.value_lengths().fill_null(0).to_numpy()
        flat = values.flatten()
        row = mix64(np.arange(len(values), dtype=np.uint64))
        have = mix64(flat.fill_null(0).to_numpy().view(np.uint64)) ^ np.repeat(row, counts)
        want = mix64(wanted.flatten().to_numpy().view(np.uint64)) ^ np.repeat(row, sizes)
        found = np.isin(have, want) & flat.is_valid().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], counts.cumsum()]).astype(np.int32), mask=np.concatenate([values.is_null().to_numpy(zero_copy_only=False), [False]]))
        return pa.ListArray.from_arrays(offsets, pa.array(found))

    return search(values, wanted)


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``LineIndex.kept`` of documents that are indexed themselves, and of no others."""
    return LineIndex.of(docs, key, text).kept(docs, key, text)
