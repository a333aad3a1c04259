"""Operators that look at the whole table: copies, statistics, shards, hosts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import components, decontaminate, jaccard_join, kneser_ney, sharding, url_trust, vector_dedup
from touchline.llm.shared import ship_package

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Components

def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == {n: c for n, c in roots({n for p in pairs for n in p}, pairs).items() if n in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Near-duplicate vectors

def brute_vectors(rows, threshold=0.95):
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows.items()
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    n = Counter(x for p in pairs for x in p)
    return {i: (n[i], c, i == c) for i, c in roots(rows, pairs).items()}


@pytest.mark.parametrize("blocks", [(2048, 8192), (7, 11)])
def test_vectors_match_brute_force(spark, blocks):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 12))
    near = [(base[rng.integers(60)] + rng.normal(size=12) * s).tolist() for s in (0.05, 0.1, 0.2, 0.3) for _ in range(60)]
    hot = [(base[0] * k + rng.normal(size=12) * 0.05).tolist() for k in range(1, 80)]
    rows = dict(enumerate([*base.tolist(), *near, *hot, base[1].tolist(), base[1].tolist(), None, [0.0] * 12, [1.0] * 11 + [float("nan")],
                           [1.0] * 11 + [float("inf")], [1.0] * 11 + [None], [1.0, 2.0], []]))
    table = spark.createDataFrame([(i, v, 1) for i, v in rows.items()] + [(0, rows[0], 2), (None, rows[0], 3)], "vec_id long, embedding array<double>, n_links int")
    got = vector_dedup.near_duplicates(table, block_members=blocks[0], block_visitors=blocks[1]).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)
    assert len(got) == len(rows)


def test_vectors_of_every_length_link(spark):
    rng = np.random.default_rng(3)
    rows = dict(enumerate(v.tolist() for width in (12, 5, 1, 20) for v in rng.normal(size=(20 + width, width))))
    rows |= {i + 1000: [x * 2 for x in v] for i, v in rows.items() if i % 3 == 0}
    rows[2000] = [1.0, 2.0]
    got = vector_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)


def test_a_third_of_all_vectors_equal(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "fits", lambda groups: False)
    monkeypatch.setattr(vector_dedup, "HOT_COPIES", 20)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    near = [(base[i % 40] + rng.normal(size=16) * 0.15).astype(np.float32).tolist() for i in range(120)]
    rows = dict(enumerate([*near, *[base[0].tolist()] * 100, *[base[1].tolist()] * 5, *base.tolist()]))
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = vector_dedup.near_duplicates(table, block_members=30, block_visitors=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)
    groups = vector_dedup._deal(np.array([5, 20, 9, 90, 3]), np.array([5, 25, 34, 120, 127]), 30, 50)
    assert groups.first.tolist() == [0, 2, 3, 4, 5] and groups.members.tolist() == [1, 1, 3, 1] and groups.visitors.tolist() == [1, 1, 3, 3]


def test_vectors_without_any_usable(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_dedup.near_duplicates(table).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0


# Similarity join

def shingles(text):
    words = SPACE.findall(low(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def brute_classes(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and a is not None and b is not None and a != b and 100 * len(x & y) >= 80 * len(x | y)]
    root = roots({i for i, _ in rows if i is not None}, pairs)
    return Counter((i, len(s), root.get(i)) for i, s in sets)


def copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(20, 120))]
        if rng.random() < 0.5:
            text[5:5] = passage
        for _ in range(rng.randrange(1, 6)):
            rows.append(list(text))
            for _ in range(rng.randrange(4)):  # each copy drifts away from the first one
                text[rng.randrange(len(text))] = word()
    many = [word() for _ in range(60)]
    rows += [many[:rng.randrange(52, 60)] for _ in range(60)] + [many] * 40
    texts = [" ".join(r) for r in rows] + [None, "", "  ", "a b", "A  b", "a b c", "one two three four five", "ONE two three four five", "x " * 9000]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"bucket_entries": 50}])
def test_classes_match_brute_force(spark, options, monkeypatch):
    if options:
        for name, size in (("OPEN_BLOCK", 3), ("MEMBER_BLOCK", 4)):
            monkeypatch.setattr(jaccard_join, name, size)
    rows = copies()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("n_shingles", F.lit("old"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, **options).collect())
    assert got == brute_classes(rows)


def test_classes_with_repeated_and_missing_keys(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v"), (None, "a b c d e f"), (4, None), (4, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(1, 2, 1): 2, (2, 2, 1): 2, (3, 2, 1): 1, (None, 2, None): 1, (4, 0, 4): 2})
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "None"]
    assert jaccard_join.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_a_repeated_key_keeps_near_texts():
    right, wrong = pa.scalar("a b c d e f g"), pa.scalar("q r s t u v w")
    shingles = next(jaccard_join.shingle_sets(pa.array([right.as_py()]), 5))
    sets = jaccard_join._Sets(5)
    assert sets.get(jaccard_join.signature(shingles), wrong) is None
    assert sets.get(jaccard_join.signature(shingles), right).tolist() == shingles.tolist()


def test_classes_with_near_texts_under_repeated_keys(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 80, 2):  # each key has two texts; each text has near copies under other keys
        for text in ([f"{side}{i}w{k}" for k in range(40)] for side in "xy"):
            rows += [(i, " ".join(text)), (i + 1000 + (text[0][0] == "y"), " ".join([*text[:-1], "end"])), (i + 2000 + (text[0][0] == "y"), " ".join(["start", *text[1:]]))]
    rng.shuffle(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, DOCS).repartition(2)).collect())
    assert got == brute_classes(rows)


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(jaccard_join, "INCIDENCE_WIDTH", 5)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.uint64) for _ in range(k)] for k in (7, 9))
    assert jaccard_join._common(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_pairs_of_a_list_skip_nothing_that_links():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(5, 400, 900))
    p = (rng.random(900) * 0.2 * n).astype(int)
    s, c = np.arange(900), rng.integers(0, 700, 900)
    met = rng.random((900, 2)) < 0.3
    got = {tuple(x) for part in jaccard_join._pairs_of_list(s, n, p, c, 80, met) for x in part.T.tolist()}
    for a in range(900):
        for b in range(a):
            reach = min(p[a], p[b]) + min(n[a] - p[a], n[b] - p[b])
            want = c[a] != c[b] and not (met[a] & met[b]).any() and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and 180 * reach >= 80 * (n[a] + n[b])
            assert want == ((b, a) in got)


# Benchmark passages

def brute_passages(rows, items, window):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(low(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i:i + size])].add(str(item))
    out = []
    for i, text in rows:
        words = ALNUM.findall(low(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k:k + size]) in windows:
                    found |= windows[tuple(words[k:k + size])]
                    hit |= set(range(k, k + size))
        out.append((i, len(words), len(hit), sorted(found)))
    return Counter(map(str, out))


@pytest.mark.parametrize("options", [{}, {"max_item_bytes": 60}])
@pytest.mark.parametrize("window", [1, 3, 4])
def test_passages_match_brute_force(spark, window, options):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.randrange(1, 12))) for i in range(9)] + [(20, "a"), (21, ""), (22, None), (None, "b c"), (23, "É x-Y z"), (23, "z é x y")]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(70, None), (71, ""), (72, "...é X, y; Z!"), (72, "w " * 30000), (None, "a b c d")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("old"))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_passages(docs, table, window=window, **options).withColumn("n_hit", decontaminate.words_hit()).collect()
    usable = [(i, t) for i, t in items if i is not None]
    assert Counter(str((r.doc_id, r.n_words, r.n_hit, list(r.item_ids))) for r in found) == brute_passages(rows, usable, window)
    for r in found:
        for span, place in zip(r.word_spans, r.byte_spans):
            cut = r.text.encode()[place.begin: place.end].decode()
            assert ALNUM.findall(low(cut)) == ALNUM.findall(low(r.text))[span.begin: span.end]


def test_passages_of_items_in_many_parts(spark):
    rng = random.Random(12)
    vocabulary = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 5, 30, 60]))) for i in range(300)]
    items += [(400, items[5][1]), (401, items[5][1]), (400, items[5][1]), *[(500, text(40)) for _ in range(60)]]  # an id with a fifth of all items
    longs = [t for _, t in items if len(t.split()) >= 30]
    rows = [(i, " ".join([text(20), *(x for _ in range(rng.randrange(3)) for x in (" ".join(rng.choice(longs).split()[3:20]), text(3)))])) for i in range(120)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_passages(docs, table, max_item_bytes=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Scan parquet" not in plan  # one pass, however many parts
    got = found.withColumn("n_hit", decontaminate.words_hit()).collect()
    want = brute_passages(rows, items, 10)
    assert Counter(str((r.doc_id, r.n_words, r.n_hit, list(r.item_ids))) for r in got) == want
    assert sum(len(r.item_ids) > 1 for r in got) > 20


def test_decontaminated_texts(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows = [(1, "Before, One two; three FOUR after it all goes on."), (2, "one two three four!"), (3, "clean text"), (4, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_ids", F.lit("mine"))
    got = {r.doc_id: r for r in decontaminate.decontaminated(docs, items, window=3).collect()}
    assert {r.item_ids for r in got.values()} == {"mine"}
    assert {i: r.text for i, r in got.items()} == {1: "Before,  after it all goes on.", 3: "clean text", 4: None}
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0
    nothing = decontaminate.find_passages(docs, items.limit(0)).collect()
    assert all(r.item_ids == [] and r.word_spans == [] for r in nothing)


# Language model

def brute_scores(rows, learn):
    tokens = [(i, SPACE.findall(low(t)) + [None]) for i, t in rows]
    counts, pairs = Counter(), Counter()
    for i, words in tokens:
        if learn(i):
            counts.update(words)
            pairs.update(zip(["BEGIN", *[("w", w) for w in words[:-1]]], words))

    def discount(values):
        n = Counter(values)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    n, v = sum(counts.values()), len(counts)
    before = Counter(w for _, w in pairs)
    high, lower = discount(pairs.values()), discount(before.values())
    rest = sum(lower[min(c, 3)] for c in before.values()) / len(pairs)
    total, passed = Counter(), Counter()
    for (c, _), k in pairs.items():
        total[c] += k
        passed[c] += high[min(k, 3)]

    def p(c, w):
        single = max(before[w] - lower[min(before[w], 3)], 0) / len(pairs) + rest / (v + 1)
        return max(pairs[c, w] - high[min(pairs[c, w], 3)], 0) / total[c] + passed[c] / total[c] * single if total[c] else single

    out = {}
    for i, words in tokens:
        contexts = ["BEGIN", *[("w", w) for w in words[:-1]]]
        out[i] = (len(words), sum(w in counts for w in words), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words),
                  sum(math.log10(p(c, w)) for c, w in zip(contexts, words)))
    return n, out, p, counts


@pytest.mark.parametrize("chunk", [2_000_000, 30])
def test_scores_match_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", chunk)
    rng = random.Random(6)
    words = ["the", "The", "of", "a", "end", "é", *("w%d" % i for i in range(40))]
    rows = [(i, " ".join(rng.choices(words, [30, 5, 20, 9, 3, 2, *[1] * 40], k=rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "never met words"), (203, "the " * 20000)]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    n, want, p, counts = brute_scores(rows, learn)
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old")).repartition(3)
    model = kneser_ney.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    assert (model.tokens, model.types) == (n, len(counts))
    got = kneser_ney.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][2:], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens), rel=1e-9)
    for context in ("BEGIN", ("w", "the"), ("w", "w7")):
        assert sum(p(context, w) for w in counts) + p(context, "unknown") == pytest.approx(1)


def brute_orders(rows, learn, order):
    """log10 of each text: counts of n-grams of the full order or from the begin, else numbers of different tokens before."""
    texts = {i: ["BEGIN", *[("w", w) for w in SPACE.findall(low(t))], "END"] for i, t in rows}
    raw = {k: Counter() for k in range(1, order + 1)}
    for i, words in texts.items():
        if learn(i):
            for k in raw:
                raw[k].update(tuple(words[at: at + k]) for at in range(len(words) - k + 1))
    counts = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in raw[k + 1])
        if k > 1:
            counts[k].update({g: n for g, n in raw[k].items() if g[0] == "BEGIN"})

    def discount(values):
        n = Counter(values)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    cut = {k: discount(counts[k].values()) for k in counts}
    total, passed = Counter(), Counter()
    for k in counts:
        for g, n in counts[k].items():
            total[g[:-1]] += n
            passed[g[:-1]] += cut[k][min(n, 3)]
    types = len(counts[1])

    def p(h, w):
        lower = p(h[1:], w) if h else 1 / (types + 1)
        n, k = counts[len(h) + 1][(*h, w)], len(h) + 1
        return max(n - cut[k][min(n, 3)], 0) / total[h] + passed[h] / total[h] * lower if total[h] else lower

    return {i: sum(math.log10(p(tuple(words[max(0, at - order + 1): at]), words[at])) for at in range(1, len(words))) for i, words in texts.items()}


@pytest.mark.parametrize("order, chunk", [(2, 2_000_000), (3, 2_000_000), (3, 30), (4, 30)])
def test_scores_of_any_order_match_brute_force(spark, order, chunk, monkeypatch):
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", chunk)
    rng = random.Random(8)
    words = ["the", "of", "a", *("w%d" % i for i in range(12))]
    rows = [(i, " ".join(rng.choices(words, [30, 20, 9, *[2] * 12], k=rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "never the of a met of the"), (203, "the of " * 1000), (204, "a never")]
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2 and i not in (202, 204)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = kneser_ney.train(docs.filter("doc_id NOT IN (202, 204)"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order)
    got = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    assert got == pytest.approx(brute_orders(rows, learn, order), rel=1e-9)


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], DOCS)
    assert kneser_ney.train(docs, F.lit(False)) is None
    assert {(r.n_tokens, r.n_known, r.score) for r in kneser_ney.score(docs, None).collect()} == {(3, 0, 0.0), (2, 0, 0.0)}
    model = kneser_ney.train(docs, F.lit(True))
    assert kneser_ney.score(docs.limit(0), model).count() == 0
    assert len({r.score for r in kneser_ney.score(docs, model).filter("doc_id = 1").collect()}) == 1


def test_unmixing():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (kneser_ney._unmixed(kneser_ney.mix64(x)) == x).all()


# Shards

def smallest_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("hot", [0, 120])
def test_shards_are_minimax(spark, hot):
    rng = random.Random(hot)
    rows = [(i, "x" * rng.randrange(0, 90) + str(rng.randrange(60))) for i in range(200)] + [(300 + i, "copy") for i in range(hot)]
    rows += [(None, "no key"), (900, None), (901, ""), (902, "é" * 700), (902, "é" * 700)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("old"))
    got = sharding.assign_shards(docs, 5).collect()
    assert len(got) == len(rows)
    text_of = defaultdict(set)
    for i, t in rows:
        text_of[i].add(t)
    by_crc, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        text = next(iter(text_of[r.doc_id])) or ""
        assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
        by_crc[r.text_crc32].add(r.shard)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_crc.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ends = sharding.atoms(sharding.sized_rows(docs), 5, sharding.GRAIN).collect()
    atoms = sorted(ends, key=lambda a: (not a.heavy, -a.bytes if a.heavy else 0, a.key))
    assert max(load.values()) == smallest_capacity([a.bytes for a in atoms], 5)
    assert len(load) == 5 or hot


def test_shards_of_small_tables(spark):
    assert sharding.assign_shards(spark.createDataFrame([], DOCS), 24).count() == 0
    one = sharding.assign_shards(spark.createDataFrame([(1, "a")], DOCS), 24).collect()
    assert [(r["size"], r.slot) for r in one] == [(9, 0)]
    assert {r.shard for r in sharding.assign_shards(spark.createDataFrame([(1, "a"), (2, "b")], DOCS), 1).collect()} == {0}


# Hosts

RULES = [url_trust.Rule("net", "/", "block"), url_trust.Rule("example.net", "/en/", "allow"), url_trust.Rule("org", "/fr/", "allow")]


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "block"),  # no rule fits, but half of the host's pages are blocked
        "https://x.org/fr/?q=://": ("x.org", "/fr/", "org/fr/", "allow"),
        "x.org/fr/": ("", "", None, "allow"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "http://org?/fr/": ("org", "", None, "allow"),
        "ftp://É.org:80#a/fr/": ("É.org:80", "", None, "allow"),
        "http://a/b://c/d": ("a", "/b://c/d", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "mine") for i, u in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judged(pages, RULES).collect()}
    assert got == cases


def random_links(rng, hosts, n):
    links = Counter((rng.choice(hosts[: len(hosts) * 3 // 4]), rng.choice(hosts)) for _ in range(n))
    return {k: v for k, v in links.items() if k[0] != k[1]}


def brute_ranks(links, seeds, steps):
    """PageRank with jumps to the seeds; hosts without links pass nothing on."""
    out, rank = Counter(), Counter({h: 0.15 * w for h, w in seeds.items()})
    for (a, _), n in links.items():
        out[a] += n
    for _ in range(steps):
        new = Counter({h: 0.15 * w for h, w in seeds.items()})
        for (a, b), n in links.items():
            new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    return rank


def test_ranks_match_power_iteration(spark):
    links = random_links(random.Random(9), [f"h{i}" for i in range(12)], 60)
    seeds = {"h1": 1.0, "h3": 0.25, "alone": 0.5}
    edges = spark.createDataFrame([(*k, v) for k, v in links.items()], "src string, dst string, links long")
    rows = spark.createDataFrame([(h, w, 1.0) for h, w in seeds.items()] + [("h3", 0.0, 1.0)], "host string, a double, b double")
    got = url_trust.propagate(edges, rows, ["a", "b"], tolerance=1e-9, max_iterations=100).collect()
    for name, weights in (("a", seeds), ("b", {"h1": 1.0, "h3": 2.0, "alone": 1.0})):
        assert {r.host: r[name] for r in got if r[name] > 0} == pytest.approx({h: r for h, r in brute_ranks(links, weights, 300).items() if r > 0}, abs=1e-7)


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_match_power_iteration(spark, seed):
    """At production defaults, on hosts of all kinds; distrust is what the surfer who starts at a host meets."""
    rng = random.Random(seed)
    hosts = [f"{i}.{top}" for i in range(8) for top in ("net", "org", "com", "info", "example.net")]
    rng.shuffle(hosts)
    links = random_links(rng, hosts, 90)
    rows = [(f"http://{a}/{rng.choice(['en/', 'fr/', 'x'])}", f'<a href="https://{b}/y">' * n) for (a, b), n in links.items()]
    rows += [(f"http://{h}{rng.choice(['/en/', '/fr/', '/x', ''])}", None) for h in hosts[:30] for _ in range(3)]
    rows += rows[:7]
    edges, verdicts = Counter(), defaultdict(list)
    for url, html in rows:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        verdicts[host].append(max(fits, key=lambda r: len(r.name)).verdict if fits else None)
        for to in re.findall(r"https://([^/]*)", html or ""):
            edges[host, to] += 1
    everyone = set(verdicts) | {h for pair in edges for h in pair}
    share = {v: {h: verdicts[h].count(v) / len(verdicts[h]) if verdicts[h] else 0.0 for h in everyone} for v in ("allow", "block")}
    rest = {h: 1 - share["allow"][h] - share["block"][h] for h in everyone}
    steps = 25
    trusted, uniform = brute_ranks(edges, share["allow"], steps), brute_ranks(edges, dict.fromkeys(everyone, 1.0), steps)
    by_links = {h: (trusted[h] - 0.15 * share["allow"][h]) / (uniform[h] - 0.15) if uniform[h] > 0.15 + 1e-9 else 0.0 for h in everyone}
    trust = {h: share["allow"][h] + rest[h] * 0.85 * by_links[h] for h in everyone}
    out, distrust = Counter(), dict(share["block"])
    for (a, _), n in edges.items():
        out[a] += n
    for _ in range(200):
        met = Counter()
        for (a, b), n in edges.items():
            met[a] += n / out[a] * distrust[b]
        distrust = {h: share["block"][h] + rest[h] * 0.85 * met[h] for h in everyone}
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    seen = Counter()
    for r in url_trust.judged(pages, RULES).collect():
        assert r.trust == pytest.approx(trust[r.host], abs=2e-3) and r.distrust == pytest.approx(distrust[r.host], abs=2e-3)
        if r.rule is None:
            assert r.verdict == ("block" if distrust[r.host] >= 0.5 and distrust[r.host] > trust[r.host] else "allow")
            seen[r.verdict] += 1
    assert min(seen["allow"], seen["block"]) > 0


def test_long_pages_and_repeated_rows(spark):
    filler = "<p>no link here</p>" * 20_000
    rows = [("http://far.com/", filler + '<a href="//bad.net/">' + filler)] * 3 + [("http://bad.net/", None)] * 2
    got = url_trust.judged(spark.createDataFrame(rows, "url string, html string"), RULES).collect()
    assert Counter((r.host, r.verdict) for r in got) == {("far.com", "block"): 3, ("bad.net", "block"): 2}


def test_links_spread_trust_and_distrust(spark):
    page = lambda host, *to: (f"http://{host}/p", "".join(f'<a HREF = "//{t}/x">' for t in to) + '<a href="/own">')
    rows = [page("bad.net"), page("farm.com", "bad.net"), page("good.com", "plain.com"), page("plain.com"), page("farm.com", "bad.net", "BAD.net"),
            ("http://mixed.org/fr/a", '<a href="http://good.com/">'), (None, None), ("http://farm.com/q", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.verdict) for r in url_trust.judged(pages, RULES, block_at=0.1).collect()}
    assert got[1] == ("farm.com", "block") and got[7] == ("farm.com", "block")
    assert got[2] == ("good.com", "allow") and got[3] == ("plain.com", "allow") and got[6] == ("", "allow")
    assert url_trust.judged(pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("linkers", [1, 2, 40])
def test_verdicts_do_not_depend_on_the_number_of_linkers(spark, linkers):
    page = lambda url, *to: (f"http://{url}", "".join(f'<a href="http://{t}/">' for t in to))
    rows = [page(f"farm{i}.com/p", "bad.net") for i in range(linkers)] + [page(f"half{i}.com/p", "bad.net", "plain.com") for i in range(linkers)]
    rows += [page(f"far{i}.com/p", f"farm{i}.com") for i in range(linkers)]
    rows += [page("bad.net/p", "plain.com"), page("plain.com/p", "plain.com"), page("x.org/fr/", "liked.com"), page("liked.com/p", "bad.net")]
    rows += [page(f"example.net/{i}", "plain.com") for i in range(9)] + [page("example.net", "plain.com")]  # 90 % blocked by rules, one page open
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.url[7:]: r for r in url_trust.judged(pages, RULES).collect()}
    for i in range(linkers):
        assert (got[f"farm{i}.com/p"].verdict, got[f"half{i}.com/p"].verdict, got[f"far{i}.com/p"].verdict) == ("block", "allow", "block")
        assert got[f"farm{i}.com/p"].distrust == pytest.approx(0.85) and got[f"far{i}.com/p"].distrust == pytest.approx(0.85 ** 2)
    assert (got["example.net"].verdict, got["example.net"].distrust) == ("block", pytest.approx(0.9))
    assert got["liked.com/p"].verdict == "allow" and got["liked.com/p"].trust == pytest.approx(got["liked.com/p"].distrust) == pytest.approx(0.85)
    assert got["plain.com/p"].verdict == "allow"
