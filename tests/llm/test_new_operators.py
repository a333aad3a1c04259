"""Whitening, periodic runs and reversible line dedup against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import line_dedup, periodic_runs, queries, whitening
from touchline.llm.cuckoo import CuckooFilter, Full
from touchline.llm.shared import ship_package

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# Spectral divide-and-conquer

def turned(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("v", [
    np.zeros((4, 4)), np.eye(7), np.array([[2.5]]), turned([5.0] * 20 + [1.0] * 20), turned(10.0 ** -np.arange(30)),
    turned(1 + 1e-13 * np.arange(20)), turned([3, 3, 3, 2] + [0] * 20), turned(np.linspace(-1, 1, 33)), turned(np.random.default_rng(2).random(90)),
], ids=["zero", "unit", "one", "two values", "wide", "nearly one value", "rank 4", "signed", "random"])
def test_components_of_symmetric_matrices(v):
    values, vectors = whitening.spectral_components(v)
    size = max(np.abs(v).sum(axis=0).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-14 * size)
    assert np.abs(vectors.T @ vectors - np.eye(len(v))).max() < 1e-14
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-14 * size


def test_polar_factor_has_the_signs():
    v = turned([4, 1e-6, -1e-9, -2])
    w, q = np.linalg.eigh(v)
    assert np.allclose(whitening.polar_sign(v), (q * np.sign(w)) @ q.T, atol=1e-7)


# Whitening

def brute_whitening(rows, components=16):
    good = [(i, np.floor(64 * np.array(v, float)).astype(object) + 1_000_000) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for width in {len(x) for _, x in good}:
        same = [(i, [int(e) for e in x]) for i, x in good if len(x) == width]
        fit = sorted({tuple(x) for _, x in same})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        away = np.array([[(n * e - s) / n for e, s in zip(x, sums)] for x in fit])
        v = away.T @ away / n
        e, q = np.linalg.eigh(v)
        e, q = e[::-1], q[:, ::-1]
        for i, x in same:
            shifted = [n * a - s for a, s in zip(x, sums)]
            z = (np.array(shifted) / n) @ q
            out += [(i, width, k + 1, n, sum(a * a for a in shifted), z[k] / np.sqrt(e[k]) if e[k] > 1e-9 else None, e[k] / max(np.trace(v), 1e-300)) for k in range(min(components, width))]
    return out


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 20)) * np.linspace(0.2, 9, 20) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(150)] + [(0, base[3].tolist()), (None, base[4].tolist())]
    rows += [(2000 + i, rng.normal(size=3).tolist()) for i in range(9)] + [(3000, None), (3001, []), (3002, [float("nan")] * 20), (3003, [float("inf"), 1.0]), (3004, [1.0, None])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, whitened string").repartition(5)
    got = whitening.by_component(whitening.whitened(table).withColumn("vec_id", F.struct("vec_id", F.size("whitened").alias("w")))).collect()
    assert got and all(r.identity_error < 1e-10 for r in got)
    want = defaultdict(list)
    for i, width, component, *rest in brute_whitening(rows):
        want[i, min(width, 16), component].append(rest)
    have = defaultdict(list)
    for r in got:
        have[r.vec_id.vec_id, r.vec_id.w, r.component].append([r.n, r.deviation, r.whitened, r.explained])
    assert have.keys() == want.keys() and sum(map(len, have.values())) == sum(map(len, want.values()))
    signs = {}
    for place in sorted(want, key=repr):
        for (n, dev, z, share), (m, dev2, z2, share2) in zip(sorted(have[place]), sorted(want[place])):
            assert (n, dev) == (m, dev2) and abs(share - share2) < 1e-12
            sign = signs.setdefault(place[1:], np.sign(z * z2))
            assert abs(z - sign * z2) < 1e-9


@pytest.mark.parametrize("rows, n", [([], None), ([(1, [0.5, 0.5])], 1), ([(1, [0.0, 2.0]), (2, [0.0, 3.0]), (3, [0.0, 3.0])], 2), ([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], 2)])
def test_whitening_without_variance(spark, rows, n):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows) and all(r.n == n and len(r.whitened) == 2 for r in got)
    if n == 1:
        assert got[0].whitened == [None, None] and got[0].explained == [0.0, 0.0] and got[0].deviation == 0 and got[0].identity_error is None
    if n == 2:
        assert all(abs(abs(r.whitened[0]) - 1) < 1e-12 and r.whitened[1] is None for r in got)


def test_codes_keep_vectors_apart():
    x = np.array([[1, -128, 127], [1, -129, 0], [2**40, 0, 0], [0, 32767, -32768], [0, 0, 40000]]) + whitening.OFFSET
    packed = whitening._packed(x)
    assert [len(c) for c in packed] == [3, 6, 24, 6, 12]
    assert (whitening._unpacked(packed, 3) == x).all()


# Periodic runs

def brute_runs(words):
    """All lags, word by word; a stretch counts if no smaller period fits it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(words[t] == words[t + r] for t in range(i, i + length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = max(i + 1, j)
    found.sort(key=lambda r: (r[0], r[2]))
    drop = {t for s, length, q in found for t in range(s + q, s + length)}
    return found, " ".join(w for t, w in enumerate(words) if t not in drop)


def periodic_texts():
    rng = random.Random(9)
    texts = [None, "", "  ", "a", " a\n", "a a a a a", "a a a a a a", "A a A a A a A a", "ä ö " * 4, "x\x85y " * 7, "a\x0bb\x0c" * 9]
    for _ in range(1200):
        letters, words = rng.choice(["ab", "abc", "a", "abcdefgh"]), []
        while len(words) < rng.choice([3, 10, 40, 90]):
            words += [rng.choice(letters) for _ in range(rng.randint(1, 8))] * rng.choice([1, 1, rng.randint(1, 7)])
        texts.append(rng.choice([" ", "\n", "  \t"]).join(words))
    return texts


def test_runs_match_brute_force(spark):
    texts = periodic_texts()
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n int")
    got = periodic_runs.with_runs(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_runs(SPACE.findall(texts[r.doc_id] or ""))
        assert ([tuple(x) for x in r.runs], r.collapsed) == want, texts[r.doc_id]
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0


def test_runs_do_not_cross_rows_or_blocks(monkeypatch):
    texts = ["a b a b", "a b a b", "c " * 5, "c", "c c", "a b " * 4, None, "x " * 300000, " ".join(str(i % 5000) for i in range(200000))]
    got = periodic_runs._runs_and_rest(pa.array(texts)).to_pylist()
    assert [[tuple(x.values()) for x in r["runs"]] for r in got] == [[], [], [], [], [], [(0, 8, 2)], [], [(0, 300000, 1)], [(0, 200000, 5000)]]
    assert got[7]["collapsed"] == "x" and got[8]["collapsed"] == " ".join(map(str, range(5000)))


def planted(doc_id, words):
    digest, n = zlib.crc32(str(doc_id).encode()), len(words)
    if digest % 10 or not n:
        return words
    g = digest // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(texts) and any(r.n_runs for r in got)
    seen = Counter()
    for r in got:
        words = planted(r.doc_id, SPACE.findall(texts[r.doc_id] or ""))
        if len(words) > 3000:
            continue  # slow by brute force
        seen[r.n_runs > 0] += 1
        runs, rest = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
    assert min(seen[True], seen[False]) > 5


# Cuckoo filters

def test_filter_never_misses_and_forgets_what_is_deleted():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 500, 40_000):
        keys, copies = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 3, n)
        filter_ = CuckooFilter.built(keys, copies)
        assert (filter_.count(keys) >= copies).all() and (filter_.table != 0).sum() == copies.sum()
        half = rng.random(n) < 0.5
        filter_ = CuckooFilter.loaded(filter_.blob())
        filter_.delete(keys[half], copies[half])
        assert (filter_.count(keys[~half]) >= copies[~half]).all() and (filter_.table != 0).sum() == copies[~half].sum()
        filter_.insert(keys[half], copies[half])
        assert (filter_.count(keys) >= copies).all()
        strangers = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
        assert (filter_.count(strangers) > 0).mean() < 0.001
    with pytest.raises(Full):
        CuckooFilter.sized(4).insert(rng.integers(0, 2**64, 50, dtype=np.uint64), np.ones(50, np.int64))


# Line dedup

def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for key in map(line_key, (text or "").split("\n")):
            if i is not None and len(key) >= 10:
                holders[key].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(line_key(x)) < 10 or i == min(holders[line_key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_rows():
    rng = random.Random(3)
    pool = ["a common line of words", "Another Common LINE", "  another common line\t\r", "short", "ten points", "nine chrs", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", "", " ", "\x0b\x0ctrimmed both ends\x0c", "trimmed both ends"]
    rows = [(i, "\n".join(rng.choice(pool + [f"line {rng.randrange(300)} of its own"]) for _ in range(rng.randint(1, 9)))) for i in range(250)]
    rows += [(i, "the hot line of a third\n" + f"and own line {i}") for i in range(250, 330)]
    return rows + [(331, None), (332, ""), (333, "\n"), (334, "\n\n" + "x" * 10), (335, "y" * 10 + "\n" + "Y" * 10), (7, rows[8][1]), (7, rows[8][1]), (None, pool[0] + "\nonly without id"), (None, "only without id"), (336, "z" * 200_000 + "\n" + "z" * 200_000)]


def kept(index, docs):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in index.kept(docs).collect())


def test_lines_match_brute_force(spark, monkeypatch):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, kept int").repartition(7)
    want = brute_lines(rows)
    assert kept(line_dedup.LineIndex.of(docs), docs) == want
    monkeypatch.setattr(line_dedup, "SHARD_REFS", 50)
    monkeypatch.setattr(line_dedup, "FREQUENT", 20)
    assert kept(line_dedup.LineIndex.of(docs), docs) == want
    empty = line_dedup.LineIndex.of(docs.limit(0))
    assert kept(empty, docs.limit(0)) == Counter() and kept(empty, docs.filter("doc_id = 331")) == Counter([(331, 1, 0, "")])


def test_lines_come_back_when_documents_go(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_REFS", 100)
    monkeypatch.setattr(line_dedup, "FREQUENT", 30)
    rows = line_rows()

    def frame(part):
        return spark.createDataFrame(part, "doc_id long, text string")

    first, second = rows[:180], rows[180:]
    index = line_dedup.LineIndex.of(frame(first))
    whole = index.inserted(frame(second))
    assert kept(whole, frame(rows)) == brute_lines(rows)
    gone = {i for i, _ in rows if i is not None and i % 3 == 0} | {7}
    rest = [(i, t) for i, t in rows if i not in gone]
    less = whole.deleted(frame([(i, None) for i in gone] + [(None, None), (99999, None)]))
    assert kept(less, frame(rest)) == brute_lines(rest)
    fresh = line_dedup.LineIndex.of(frame(rest))
    assert sorted(map(tuple, less.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    # Filters hold one copy of every key of one document and two of others, and nothing else.
    copies = sum(1 if r["first"] == r["last"] else 2 for r in fresh.counts.collect())
    assert sum((CuckooFilter.loaded(r["filter"]).table != 0).sum() for r in less.filters.collect()) == copies
    back = less.inserted(frame([(i, t) for i, t in rows if i in gone]))
    assert kept(back, frame(rows)) == brute_lines(rows)
    assert kept(whole.deleted(frame(rows)), frame(rows[:20])) == Counter((i, t.count("\n") + 1, 0, t) for i, t in rows[:20])


def test_an_outgrown_index_gets_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_REFS", 10)
    rows = line_rows()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    small = line_dedup.LineIndex.of(frame(rows[:4]))
    grown = small.inserted(frame(rows[4:]))
    assert grown.shards > 4 * small.shards and kept(grown, frame(rows)) == brute_lines(rows)
