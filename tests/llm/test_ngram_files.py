"""Files of the language model: small, exact, and without shuffle files left beside them."""

import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import kneser_ney


def test_files_take_few_bytes_for_an_ngram(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(200))) for i in range(600)]
    model = kneser_ney.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.lit(True), order=3)
    size = {k: sum(os.path.getsize(f) for f in Path(model.folder.removeprefix("file:")).glob(f"{k}-*")) for k in ("grams2", "after2", "grams3")}
    pairs, triples = model.bigrams, int(model.first_gram[3][-1])
    assert pairs == len({p for _, t in rows for w in [["^", *t.split(), "$"]] for p in zip(w, w[1:])})
    assert triples == len({p for _, t in rows for w in [["^", *t.split(), "$"]] for p in zip(w, w[1:], w[2:])})
    assert size["grams2"] + size["after2"] + size["grams3"] < 7 * (pairs + triples)  # 11 before


def test_shuffle_setting_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError):
        with kneser_ney.shuffles_removed(spark):
            assert spark.conf.get(name) == "true"
            raise KeyError
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("bits", [12, 13, 41, 63, 64])
def test_scrambling_is_a_bijection(bits):
    x = np.random.default_rng(0).integers(0, 2**bits, 1000, dtype=np.uint64)
    assert (kneser_ney._unscrambled(kneser_ney._scrambled(x, bits), bits) == x).all()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1, 1 << 50), (300, 300), (5000, 1 << 38), (5000, 1 << 62)])
def test_places_and_counts_of_a_file(tmp_path, n, top):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(top, n, replace=False)) if top < 1 << 20 else np.unique(rng.integers(0, top, n) >> rng.integers(0, 20, n))
    counts = rng.integers(1, 400, len(keys)) ** 3
    kneser_ney._write_grams(str(tmp_path / "f"), keys, top, counts)
    raw = np.fromfile(tmp_path / "f", np.uint8)
    order = rng.permutation(len(keys))
    places = kneser_ney._places(raw, keys[order])
    assert (places == order).all()
    if n:
        assert (kneser_ney._decoded(kneser_ney._gram_parts(raw)[2], places)[0] == counts[order]).all()
    others = np.setdiff1d(np.concatenate([keys + 1, keys - 1, rng.integers(0, top, 100), [top, top * 2 - 1]]), keys)
    assert (kneser_ney._places(raw, others[others >= 0]) == -1).all()


def test_codes_hold_any_number():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 9, (4, 3000)) ** rng.integers(1, 14, 3000)
    raw = np.concatenate([np.ascontiguousarray(x).reshape(-1).view(np.uint8) for x in kneser_ney._coded(list(table))])
    places = rng.permutation(3000)
    assert (kneser_ney._decoded(raw, places) == table[:, places]).all()


@pytest.mark.parametrize("top", [5, 1 << 40])
def test_distinct_rows(top):
    rng = np.random.default_rng(4)
    table = rng.integers(0, 5, (3, 400)) * (top // 5)
    rows, counts = kneser_ney._distinct(list(table), [top] * 3)
    want = np.unique(table, axis=1, return_counts=True)
    assert (np.stack(rows) == want[0]).all() and (counts == want[1]).all()
    assert [len(x) for x in kneser_ney._distinct([c[:0] for c in table], [top] * 3)[0]] == [0, 0, 0]
