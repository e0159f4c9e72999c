"""Sharding, whitening and spelling variants against brute force, and over awkward rows."""

from __future__ import annotations

import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import queries, sharding, variants, whitening
from tests.llm.fixtures import DOCS, awkward, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows as a table, as the operators ask for one that reads alike twice."""
    from tallywright.llm.common import stored

    return stored(awkward(spark), "awkward")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 11 sharding


def shards_of(rows, shard="shard", slot="slot"):
    """Rows per shard; slots are gapless from 0."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[shard]].append(r)
    for own in by.values():
        assert sorted(r[slot] for r in own) == list(range(len(own)))
    return by


def total_size(rows):
    return sum(len((r["text"] or "").encode()) + 1 for r in rows)


def test_shards_hold_equal_bytes(spark):
    r = random.Random(5)
    rows = [(i, prose(i, r.randint(1, 60)), "en", "a", 1) for i in range(3000)]
    rows += [(i, rows[7][1], "en", "b", 1) for i in range(3000, 5000)]  # one text in two fifths of all rows
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    docs.write.mode("overwrite").parquet(path := sharding.new_folder(spark, "shard-input"))
    got = sharding.write_shards(spark.read.parquet(path), shards=8).collect()
    assert sorted((x["doc_id"], x["text"], x["source"]) for x in got) == sorted((x[0], x[1], x[3]) for x in rows)
    by = shards_of(got)
    share = total_size(got) / 8
    longest = max(len(x[1]) + 1 for x in rows)
    assert sorted(by) == list(range(8))
    assert all(abs(total_size(own) - share) <= longest + 0.01 * share for own in by.values())
    texts = collections.defaultdict(set)
    for x in got:
        texts[x["text"]].add(x["shard"])
    assert sum(len(s) > 1 for s in texts.values()) <= 7 and len(texts[rows[7][1]]) >= 3


def test_full_ranges_are_cut_until_none_is(spark):
    docs = spark.createDataFrame([(i, "same text", "en", "a", 1) for i in range(4000)], DOCS)
    docs.write.parquet(path := sharding.new_folder(spark, "shard-input"))
    found = sharding.plan(spark.read.parquet(path), shards=2, ranges_a_shard=4, range_rows=50)
    rows = np.diff([*found.before, 4000])
    assert rows.max() <= 50 and rows.sum() == 4000 and found.cuts == [2000]


def test_copies_stay_together_where_that_costs_nothing(spark):
    docs = spark.createDataFrame([(i, prose(i // 3, 20), "en", "a", 1) for i in range(3000)], DOCS)
    docs.write.parquet(path := sharding.new_folder(spark, "shard-input"))
    got = sharding.write_shards(spark.read.parquet(path), shards=4).collect()
    homes = collections.defaultdict(set)
    for x in got:
        homes[x["text"]].add(x["shard"])
    assert all(len(s) == 1 for s in homes.values())


def test_shards_of_awkward_rows(spark, odd, none):
    clash = odd.withColumns({"shard": F.lit("x"), "Slot_": F.lit("y"), "part": F.lit(3), "before": F.lit(4)})
    got = sharding.write_shards(clash, shards=3)
    assert got.columns == [*clash.columns, "slot", "shard_"] or set(got.columns) == {*clash.columns, "slot", "shard_"}
    rows = got.collect()
    assert len(rows) == odd.count() and {r["shard"] for r in rows} == {"x"}
    shards_of(rows, "shard_")
    assert sharding.write_shards(none).collect() == []
    one = sharding.write_shards(odd.limit(1).filter("doc_id = 1"), shards=8).collect()
    assert len(one) <= 1


def test_shard_query(spark):
    got = queries.op11_sampled_splitters(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    by, longest = shards_of(got), max(r["size"] for r in got)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * longest


# 12 whitening


def scaled(vectors):
    return [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]


def test_whitening_query_equals_plain_algebra(spark):
    got = queries.op12_refined_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: v for r, v in zip(table, scaled([r["embedding"] for r in table]))}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(d)]
    data = np.array(list(x.values()), "f8")
    v = np.cov(data.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 8 and {r["component"] for r in got} == set(range(1, 9))
    signs = {}
    for r in got:
        own, c = x[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(own, sums))
        want = float((np.array(own) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c]))
        sign = signs.setdefault(c, np.sign(want * r["whitened"]))
        assert abs(sign * r["whitened"] - want) < 1e-7
        assert abs(r["explained"] - values[c] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-10


def residual(a, values, vectors):
    a = np.asarray(a, np.longdouble)
    eye = np.eye(len(a), dtype=np.longdouble)
    scale = float(np.abs(a).max())
    return float(np.abs(a @ vectors - vectors * values).max()) / scale, float(np.abs(vectors.T @ vectors - eye).max())


@pytest.mark.parametrize("values", [
    list(range(1, 21)), [1.0] * 20, [1.0 + 1e-9 * k for k in range(20)], [1.0 + 1e-13 * k for k in range(10)] + list(range(2, 12)),
    [1e6, 1e6 + 1e-5, 1e6 + 2e-5, *range(1, 18)], [0.0] * 10 + [1.0 + 1e-7 * k for k in range(10)]])
def test_refined_eigenvectors_of_close_values(values):
    r = np.random.default_rng(len(values))
    q = np.linalg.qr(r.normal(size=(20, 20)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(20, dtype=np.longdouble) - q.T @ q) / 2
    a = q * np.array(values, np.longdouble) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.refined_eigenvectors(a)
    assert np.abs(found - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-15 * max(values)
    off, square = residual(a, found, vectors)
    assert off < 1e-16 and square < 1e-16


def test_clustered_vectors_are_right_to_double_precision():
    """Eigenvalues 1e-9 apart: a plain double solver is off by about 1e-7, the refined vectors by far less."""
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(12, dtype=np.longdouble) - q.T @ q) / 2
    values = np.array([5 + k * 1e-9 for k in range(6)] + [1, 2, 3, 4, 6, 7], np.longdouble)
    a = q * values @ q.T
    vectors = whitening.refined_eigenvectors((a + a.T) / 2)[1]
    want = q[:, np.argsort(-values)]
    assert np.abs(np.abs(np.sum(want * vectors, axis=0)) - 1).max() < 1e-15
    assert np.abs(np.abs(vectors) - np.abs(want)).max() < 1e-9


def test_covariance_is_exact_for_large_entries(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(-(1 << 31), 1 << 31) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<bigint>")
    n, sums, v = whitening.exact_covariance(df, 3)
    means = [Fraction(s, n) for s in sums]
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(x[i]) - means[i]) * (Fraction(x[j]) - means[j]) for _, x in rows) / n
            assert abs(Fraction(int(v[i, j])) - want) <= 1
    model = whitening.fit(df)
    got = {x["vec_id"]: x["deviation"] for x in whitening.whiten(df, model).filter("component = 1").collect()}
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in rows}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()}


def test_whitening_of_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, []), (7, [1.0]),
            (8, [3e38, 1.0]), (9, [0.5, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"x_": F.lit(1), "n": F.lit(2)})
    whole = df.select("vec_id", whitening.whole_numbers(F.col("embedding")).alias("x"))
    model = whitening.fit(whole)
    got = whitening.whiten(whole, model).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 9: 2} and {r["n"] for r in got} == {4}
    assert whitening.identity_error(whole, model) < 1e-10
    alike = whole.filter("vec_id = 1")
    model = whitening.fit(alike)
    assert [r["whitened"] for r in whitening.whiten(alike, model).collect()] == [None] * 4 and whitening.identity_error(alike, model) == 0
    assert whitening.fit(whole.filter("vec_id = 6")) is None and whitening.whiten(whole.limit(0), None).collect() == []


# 13 spelling variants


def is_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def near_table(words):
    """Near words by all pairs: word -> [n_near, best n, best]."""
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and is_near(v, w)]
        if near:
            out[w] = (len(near), -min(near)[0], min(near)[1])
    return out


def made_words(seed, n, letters="abc", low=3, high=7):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(low, high))): r.randint(1, 60) for _ in range(n)}


@pytest.mark.parametrize("most", [3, 20, 20_000])
def test_near_words_equal_all_pairs(spark, most):
    words = made_words(most, 400) | {"aaaaaaa": 5, "aaaaaa": 5, "aaaaaaaa": 1, "é" * 7: 3, "é" * 8: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in variants.near_words(df, least=3, most=most).collect()}
    assert got == near_table(words)


def test_acceptor_is_minimal_and_pairs_are_found_once():
    r = random.Random(2)
    short = sorted({"".join(r.choice("ab") for _ in range(5)) for _ in range(25)})
    long = sorted({"".join(r.choice("ab") for _ in range(6)) for _ in range(40)})
    acceptors = variants.Acceptors()
    start = acceptors.add(short)
    rests = {frozenset(w[len(p):] for w in short if w.startswith(p)) for w in short for p in (w[:k] for k in range(len(w) + 1))}
    assert len(acceptors.arcs) == len(rests) and acceptors.count[start] == len(short)
    found = variants.near_pairs(short, long, True)
    assert len(found) == len(set(found))
    want = [(u, v) for a, u in enumerate(short) for v in short[a + 1 :] if is_near(u, v)] + [(u, v) for u in short for v in long if is_near(u, v)]
    assert sorted((short[i], (long if longer else short)[j]) for i, j, longer in found) == sorted(want)


def expected(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_hole = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_hole[w[:i] + "*" + w[i + 1 :]].add(w)
            by_hole[w[:i] + w[i + 1 :]].add(w)
    for w in words:
        by_hole[w].add(w)
    out = {}
    for w, n in words.items():
        beside = {v for i in range(len(w)) for v in by_hole[w[:i] + "*" + w[i + 1 :]] | by_hole[w[:i] + w[i + 1 :]]} | by_hole[w]
        near = [(-words[v], v) for v in beside if v != w and is_near(v, w)]
        best = min(near, default=None)
        strong = best is not None and -best[0] >= 10 * n
        out[w] = [best[1] if strong else None, n, len(near), -best[0] if strong else None]
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


def test_variant_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in queries.op13_spelling_variants(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(docs)


def test_forms_are_followed_to_the_root(spark):
    text = " ".join(["wordform"] * 1000 + ["wordforms"] * 100 + ["wordfrms"] * 10 + ["wodfrms"] * 1 + ["elsewhere"] * 2)
    got = {r["word"]: (r["form"], r["root"]) for r in variants.spelling_variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), least_n=1, noise=1 << 40).collect()}
    assert got == {"wordform": (None, "wordform"), "wordforms": ("wordform", "wordform"), "wordfrms": ("wordforms", "wordform"),
                   "wodfrms": ("wordfrms", "wordform"), "elsewhere": (None, "elsewhere")}


def test_variants_of_awkward_rows(spark, odd, none):
    long_run = "x" * 50_000
    more = spark.createDataFrame([(None, "Straße ÀÉÎÕÜàé ÀÉÎÕÜàé × ÷"), (3, long_run), (4, long_run), (5, long_run + "y"), (6, long_run + "y")], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.spelling_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == expected([tuple(r) for r in docs.collect()])
    assert variants.spelling_variants(none).collect() == []
    assert variants.spelling_variants(odd.withColumns({c: F.lit(1) for c in ("word", "form", "root", "d", "r", "w", "m", "lo", "hi")})).count() > 0
