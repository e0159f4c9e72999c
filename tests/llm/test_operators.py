"""Each operator against a brute-force version, and over awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallywright.llm import contamination, language, licenses, mixing, near, quality, queries, search, secrets, sentences, token_files, wavelet
from tallywright.llm.automaton import Automaton
from tallywright.llm.common import ROW
from tests.llm.fixtures import DOCS, awkward, count_of, prose, words

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 exact top-k


def nearest(rows, asked, k):
    out = []
    for q, x in asked:
        if q is None or x is None:
            continue
        best = {}
        for c, y in rows:
            if c is not None and y is not None and c != q and len(x) == len(y):
                best[c] = max(best.get(c, -(1 << 80)), sum(a * b for a, b in zip(x, y)))
        out += [(q, i + 1, c, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, (c, s) in enumerate(sorted(best.items(), key=lambda v: (-v[1], v[0]))[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.randint(-9, 9) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 420)]  # many ties
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    asked = [x for x in rows if x[0] % 20 == 0]
    got = search.top_k(df, df.filter("vec_id % 20 = 0"), k=7, block=5)
    assert sorted(tuple(x) for x in got.collect()) == nearest(rows, asked, 7)


def test_top_k_awkward(spark):
    big = 1 << 60
    rows = [(0, [1, 2]), (1, None), (None, [5, 5]), (2, [3, None]), (3, [big, big]), (4, [big, 7]), (5, [1, 2, 3]), (6, []), (7, []), (8, [0, 1]), (8, [0, 1])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    clean = [(i, v) for i, v in rows if v is None or None not in v]
    assert sorted(tuple(x) for x in search.top_k(df.withColumn("score", F.lit(1)), df, k=3).collect()) == sorted(set(nearest(clean, clean, 3)))
    assert count_of(search.top_k(df.limit(0), df)) == 0 and count_of(search.top_k(df, df.limit(0))) == 0


def test_scaled_vectors(spark):
    df = spark.createDataFrame([([0.5, -0.0001],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(search.scaled(F.col("v"))).collect()] == [[512, -1], None, None, None, None, []]


def test_segment_bound_holds():
    r = np.random.default_rng(1)
    x, y = r.integers(-50, 50, (40, 21)).astype(float), r.integers(-50, 50, (60, 21)).astype(float)
    last = None
    for s in search.LEVELS:
        bound = search.segment_features(x, s) @ search.segment_features(y, s).T
        assert (bound >= x @ y.T - 1e-6).all()
        last = bound
    assert last is not None


# 2 quality


def test_quality_separates_held_out(spark):
    good = [(i, prose(i, 60), 1) for i in range(60)]
    bad = [(100 + i, " | ".join(w.upper() + "%%" for w in words(i, 40)), 0) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    model = quality.fit(df.filter("doc_id % 3 <> 0").select("doc_id", "text"), df.filter("doc_id % 3 <> 0").select("doc_id", "quality"))
    rows = quality.score(df.filter("doc_id % 3 = 0"), model, ["doc_id", "quality"]).collect()
    assert all((r.score >= 0.3) == (r[ROW].quality == 1) for r in rows)


def test_quality_awkward(spark, odd, none):
    empty = quality.fit(none, none.select("doc_id", F.lit(1).alias("quality")))
    rows = quality.score(odd, empty, ["doc_id", "score"]).collect()
    assert len(rows) == 12 and {r.score for r in rows} == {0.5}
    labels = odd.select("doc_id", F.when(F.col("doc_id") < 5, 1).when(F.col("doc_id") < 8, 0).alias("quality"))
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model, ["doc_id", "text"]).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r[ROW].text}) == 1
    assert count_of(quality.score(none, model, ["doc_id"])) == 0


# 3 decontamination


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()


def test_leaks_with_edits_are_found():
    r = random.Random(8)
    items = [(i, prose(500 + i, 30)) for i in range(20)]
    index = contamination.Index(items, 10, 0.08)
    for _ in range(40):
        i, text = r.choice(items)
        chars = list(flat(text))
        for _ in range(int(0.08 * len(chars))):
            at, kind = r.randrange(len(chars)), r.random()
            chars[at : at + 1] = [] if kind < 0.3 else [r.choice("xyz")] if kind < 0.6 else [chars[at], "q"]
        doc = prose(r.randrange(99), 70) + " " + "".join(chars) + "\n" + prose(3, 20)
        found = [x for x in index.leaks(doc) if x["item_id"] == i]
        assert len(found) == 1
        span = re.sub(r"\s+", " ", doc[found[0]["start"] : found[0]["end"]].lower())  # a blank at its edge counts as an edit
        assert distance(span, flat(text)) == found[0]["edits"]
    assert all(index.leaks(prose(1000 + k, 300)) == [] for k in range(30))


def least_edits(item: str, text: str) -> int:
    """Fewest edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("length", [10, 12, 13, 15, 19, 20, 24, 25, 28, 29, 37, 38, 39, 49, 50, 60, 63, 100])
def test_every_length_has_its_whole_budget(length):
    """Items of all lengths are found with the promised edits, however these lie, and not with more than unbanded alignment allows."""
    r = random.Random(length)
    for _ in range(25):
        item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        chars, budget = list(item), int(0.08 * length)
        for at in sorted(r.sample(range(1, length - 1), budget), reverse=True):
            chars[at : at + 1] = r.choice(([], ["#"], [chars[at], "#"]))
        noise = lambda: "".join(r.choice("0123456789") for _ in range(r.randint(0, 40)))
        index = contamination.Index([(1, item)], 10, 0.08)
        doc = noise() + "".join(chars) + noise()
        found = index.leaks(doc)
        assert len(found) == 1 and found[0]["edits"] == least_edits(item, doc) <= budget
        far = "".join(c if i % 9 else "#" for i, c in enumerate(item))
        assert bool(index.leaks(far)) == (least_edits(item, far) <= budget)


def test_leaks_equal_unbanded_alignment(spark):
    """Every (text, short item) pair of the smallest tables: found exactly where the whole item fits within its budget."""
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    items = [(i, flat(t)[k : k + n]) for i, (t, k, n) in enumerate(zip([d for d in docs if len(d) > 200][:6], (20, 40, 60, 80, 5, 9), (13, 19, 28, 39, 45, 60)))]
    index = contamination.Index(items, 10, 0.08)
    for text in docs:
        whole = flat(text)[:1500]
        got = {x["item_id"] for x in index.leaks(whole)}
        assert got == {i for i, item in items if least_edits(flat(item), whole) <= int(0.08 * len(flat(item)))}


def test_leaks_awkward(spark, odd, none):
    items = spark.createDataFrame([(1, prose(1, 80)), (1, prose(1, 80)), (2, None), (None, "one"), (3, ""), (4, "one"), (5, prose(99, 60_000)[5000:5200])], "item_id bigint, text string")
    rows = contamination.find_leaks(odd, items, ["doc_id", "leaks", "start"]).collect()
    found = collections.Counter((r[ROW].doc_id, x.item_id) for r in rows for x in r.leaks)
    assert found == {(1, 1): 2, (6, 1): 1, (7, 4): 1, (4, 5): 1, (4, 4): prose(99, 60_000).count("one")}
    clean = contamination.find_leaks(odd, items, odd.columns, clean_only=True, block_chars=300)
    assert count_of(clean) == 7 and count_of(contamination.find_leaks(none, items, ["doc_id"])) == 0
    assert all(not r.leaks for r in contamination.find_leaks(odd, items.limit(0), ["doc_id"]).collect())


# 4 licences


def test_licenses_inherit_from_the_nearest_folder(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nReleased under the MIT License"), (2, "a/b/x.py", "print"), (3, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0"),
        (4, "a/b/c/y.py", None), (5, "z.py", ""), (6, None, "x"), (7, "a/b/h.c", "foo bar\nLicensed under CC BY-NC 4.0.\n" + prose(1, 50)), (8, "q/r", "x"), (8, "q/r", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("license", F.lit(1))
    got = sorted((r[ROW].doc_id, r.license, r.kind) for r in licenses.scan(df, ["doc_id", "license"], F.col("path")).select(ROW, F.coalesce("license", F.lit("")).alias("license"), "kind").collect())
    assert got == [(1, "MIT", "file"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "file"), (4, "Apache-2.0", "inherited"), (5, "", "none"), (6, "", "none"),
                   (7, "CC-BY-NC-4.0", "header"), (8, "", "none"), (8, "", "none")]


def cosine(line: str, template: str, idf: dict) -> float:
    a, b = (collections.Counter(re.findall("[a-z0-9]+", x.lower())) for x in (line, template))
    w = lambda c: {t: n * idf.get(t, 1.0) for t, n in c.items()}
    a, b = w(a), w(b)
    return sum(v * b.get(t, 0.0) for t, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_license_headers_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    idf, rows = licenses.weights_of(docs, "text"), docs.collect()
    seen = collections.Counter(t for r in rows for t in set(re.findall("[a-z0-9]+", (r.text or "").lower())))
    assert all(abs(idf[t] - (math.log((len(rows) + 1) / (seen[t] + 1)) + 1)) < 1e-9 for t in idf)
    got = {r[ROW].doc_id: r.license for r in licenses.scan(docs, ["doc_id"], F.lit(None).cast("string")).collect()}
    for r in rows:
        best = max((round(cosine(line, text, idf), 6), name) for line in (r.text or "").split("\n") if re.search("[a-z0-9]", line.lower()) for name, text in licenses.TEMPLATES)
        assert (got[r.doc_id] is not None) == (best[0] >= 0.6)
        assert got[r.doc_id] in (None, best[1])


def test_licenses_awkward(spark, odd, none):
    assert count_of(licenses.scan(odd, ["doc_id", "score"], F.concat_ws("/", "source", "doc_id"))) == 12
    assert count_of(licenses.scan(none, ["doc_id"], F.col("source"))) == 0


def test_license_families_and_full_texts(spark):
    """A whole text names its own licence; a notice wrapped over lines does, too, and not a neighbour."""
    texts = dict(licenses.full_texts())
    named = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "ISC")
    rows = [(i, n, "Copyright (c) 2020 Jane Doe\n\n" + texts[n]) for i, n in enumerate(named)]
    lesser = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    rows += [(20, "LGPL-2.1", "x = 1\nlicensed under the GNU Lesser General Public License, version 2.1\ny = 2"), (21, "LGPL-2.1", "import os\n" + lesser + "\n" + prose(1, 60)),
             (22, "BSD-2-Clause", "x = 1\n" + texts["BSD-2-Clause"] + "\n" + "\n".join(prose(i, 40) for i in range(9))), (23, "", prose(2, 60))]
    df = spark.createDataFrame(rows, "doc_id bigint, want string, text string")
    got = licenses.scan(df, ["doc_id", "want"], F.lit(None).cast("string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.license or "", r.kind) == (r[ROW].want, "file" if r[ROW].doc_id < 20 else "header" if r[ROW].want else "none")


# 5 sentence spans


def deduplicated(rows, least_sentences=2, least_words=15):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        pieces = sentences.cut(text)
        keys, gone, new = [tuple(text[a:b].lower().split()) for a, b, _ in pieces], set(), set()
        for i in range(len(keys)):
            for j in range(i + least_sentences, len(keys) + 1):
                if sum(map(len, keys[i:j])) >= least_words:
                    run = tuple(keys[i:j])
                    if run in seen or run in new:
                        gone.update(range(i, j))
                    new.add(run)
                    break
        seen |= new
        out[doc_id] = "".join(text[a:c] for i, (a, _, c) in enumerate(pieces) if i not in gone) if gone else text
    return out


def test_sentence_spans_equal_brute_force(spark):
    passage = prose(77, 60)
    rows = [(i, prose(i, 50) + " " + (passage + " " if i % 3 else "") + prose(40 + i, 30) + (" " + passage if i == 7 else "")) for i in range(30)]
    got = sentences.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()
    assert {r[ROW].doc_id: r.text for r in got} == deduplicated(rows)
    assert sum(passage[20:200] in r.text for r in got) == 1


def test_repeated_sentences_and_long_passages_are_removed(spark):
    """No 51-word window of a later text may be in what an earlier one keeps."""
    one = " ".join(words(3, 20)) + "."  # one sentence between changed ones
    long, shared = " ".join(words(5, 90)), " ".join(words(6, 300))
    rows = [(1, one), (2, f"{prose(8, 30)} {one} {prose(9, 30)}"), (3, long), (4, long), (5, " ".join(words(11, 70)) + " " + shared), (6, shared + " " + " ".join(words(12, 70)))]
    got = {r[ROW].doc_id: r.text for r in sentences.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}
    assert got[1] == one and one not in got[2] and got[2].startswith(prose(8, 30)) and got[3] == long and got[4] == ""
    windows = lambda t: {tuple(t.split()[i : i + 51]) for i in range(len(t.split()) - 50)}
    assert got[5] == rows[4][1] and not windows(got[5]) & windows(got[6])


def test_runs_reach_the_end_of_a_passage():
    """The last short sentences of a passage are in a run of their own that ends there."""
    a, b, c = prose(1, 7) + " " + prose(2, 4), prose(3, 5), prose(4, 3)
    ends = lambda text: {h for h, _, _ in sentences.runs(text, 2, 15, 15)}
    n = len(sentences.cut(f"{a} {b} {c}"))
    last = {h for h, i, k in sentences.runs(f"{a} {b} {c}", 2, 15, 15) if i + k == n}
    assert last and last <= ends(f"{a} {b} {c} {prose(7, 7)}")


def test_sentence_spans_awkward(odd, none):
    got = {(r[ROW].doc_id, r[ROW].text): r.text for r in sentences.deduplicate(odd, ["doc_id", "text", "spans"]).collect()}
    assert got[(6, prose(1, 80))] == "" and got[(1, prose(1, 80))] == prose(1, 80) and got[(2, None)] is None and got[(3, "")] == ""
    assert count_of(sentences.deduplicate(none, ["doc_id"])) == 0


# 6 secrets

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"), "github": re.compile(r"gh[pousr]_[A-Za-z0-9]+"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), "jwt": re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)"),
}
KEEPS = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32, "github": lambda m: len(m[0]) >= 40,
         "pem": lambda m: True, "jwt": lambda m: len(m[1]) >= 8}


def spans_of(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in p.finditer(text) if KEEPS[kind](m))


def test_secret_spans_equal_regular_expressions():
    r = random.Random(2)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "==", "abcdefgh", "a", "0123456789abcdef", "0123456789abcdef0", "AKIA",
             "AKIAABCDEFGHIJKL", "Z", "é", "ghp_", "x" * 36, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "aaaaaaaa", ".", "-", "\n", "ſ", "日", "🙂"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        data = text.encode()
        assert secrets.in_characters(data, secrets.scan(data)) == spans_of(text), text


def test_automaton_is_minimal_and_resets():
    a = Automaton([("ab|cb", False), ("b+", True)])
    assert a.states <= 8 and len(a.table) == a.states * a.width


def test_secrets_query_equals_regular_expressions(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib

    for r in queries.op6_secret_automaton(spark, SF).collect():
        found = [(list(PATTERNS)[k], s, e) for s, k, e in spans_of(docs[r.doc_id])]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in found if k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in found) for k in ("assign", "access", "hex")]


def test_secrets_awkward(odd, none):
    rows = secrets.find_secrets(odd, ["doc_id", "spans"]).collect()
    assert len(rows) == 12 and all(r.spans == [] for r in rows)
    assert count_of(secrets.find_secrets(none, ["doc_id"])) == 0


# 7 language


def test_kneser_ney_equals_the_formula():
    text = "abracadabra abrakadabra"
    codes, begins = language.characters([text])
    grams, counts = language._distinct(np.stack(language.histories(codes, begins), axis=1), np.ones(len(codes)))
    model = language.Model(["x"], *language._joined([language._kneser_ney(grams, counts)]), np.ones((1, 2)), 9.0, (0.0, 1.0))
    top = collections.Counter(tuple(g) for g in np.stack(language.histories(codes, begins), axis=1).tolist())
    tables = [top]
    for _ in range(3):
        tables.insert(0, collections.Counter(g[1:] for g in tables[0]))

    def p(gram):
        if not gram:
            return 1 / language.ALPHABET
        table = tables[len(gram) - 1]
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        follow = [v for g, v in table.items() if g[:-1] == gram[:-1]]
        if not follow:
            return p(gram[1:])
        return max(table.get(gram, 0) - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(gram[1:])

    for probe in (text, "cadabra bra", "zebra кот", "q"):
        codes, begins = language.characters([probe])
        expected = -np.mean([math.log(p(tuple(g))) for g in np.stack(language.histories(codes, begins), axis=1).tolist()])
        assert abs(language.Scorer(model).entropies([probe])[0][0, 0] - expected) < 1e-4


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op7_kneser_ney_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(odd, none):
    model = language.fit(odd)
    rows = {(r[ROW].doc_id, r[ROW].text): r for r in language.identify(odd, model, ["doc_id", "text", "score"]).collect()}
    for text, doc in (("", 3), (None, 2), ("   \n\t ", 5), ("12 34 !!", 8)):
        assert rows[(doc, text)].lang_pred == "und" and rows[(doc, text)].rejected and rows[(doc, text)].score == 0
    assert {r.lang_pred for r in rows.values()} <= {"en", "fr", "ja", "und"}
    assert count_of(language.identify(none, model, ["doc_id"])) == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none), ["doc_id"]).collect()} == {"und"}


# 8 mixing


def filled(sizes: dict, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, target, open_, rest = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}, {}, set(names), share * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= cap * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        rest -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing_meets_targets_and_repeats(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), "en", r.choice(["b", "a", "é", "Z", None, "b", "b", "b"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    target = filled(sizes)
    mixed = mixing.mix(df, bucket_rows=40, fan_in=3)
    got = [(r[ROW].doc_id, r[ROW].source, r.size, r.copies, r.target, r.source_size) for r in mixed.collect()]
    again = mixing.mix(df.repartition(7), bucket_rows=40, fan_in=3).collect()
    assert sorted((g[0], g[3]) for g in got) == sorted((r[ROW].doc_id, r.copies) for r in again)
    assert sorted(g[0] for g in got) == list(range(900)) and all(0 <= g[3] <= 2 for g in got)
    for source in sizes:
        mine = [g for g in got if g[1] == source]
        assert abs(mine[0][4] - target[source]) < 1e-6 and mine[0][5] == sizes[source]
        assert abs(sum(g[2] * g[3] for g in mine) - target[source]) <= 30
    narrow = mixing.mix(df, sized=mixing.sizes_of(df), bucket_rows=40, fan_in=3).collect()
    assert sorted((r[ROW].doc_id, r.copies) for r in narrow) == sorted((g[0], g[3]) for g in got)


def test_pair_keeps_words_and_means():
    r, total = random.Random(1), np.zeros(2)
    for _ in range(20_000):
        p, q = mixing.pair(10, 0.3, 4, 0.9, r.random())
        assert abs(10 * p + 4 * q - (3 + 3.6)) < 1e-9 and (p in (0.0, 1.0) or q in (0.0, 1.0))
        total += p, q
    assert np.allclose(total / 20_000, [0.3, 0.9], atol=0.01)


def test_mixing_awkward(odd, none):
    mixed = mixing.mix(odd, bucket_rows=1, fan_in=2)
    rows = mixed.collect()
    assert len(rows) == 12 and all(r.copies <= 2 for r in rows)
    assert mixing.copies_of(mixed, odd.columns).columns == odd.columns
    assert count_of(mixing.copies_of(mixed, odd.columns)) == sum(r.copies for r in rows)
    assert count_of(mixing.mix(none)) == 0


# 9 Jaccard join


def classes(rows, threshold=0.8):
    hashes = near.WordHashes()
    sets = [set(near.shingles(text, hashes).tolist()) for _, text in rows]
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= threshold * len(sets[i] | sets[j]):
                links[i], links[j], group[root(i)] = links[i] + 1, links[j] + 1, root(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root(i)] = min(names.get(root(i), doc_id), doc_id)
    return sorted((doc_id if doc_id is not None else -1, (names.get(root(i)) if sets[i] else doc_id) or 0, links[i]) for i, (doc_id, _) in enumerate(rows))


def test_join_equals_brute_force(spark):
    r, rows = random.Random(9), []
    for g in range(12):
        base = words(g, r.choice([3, 20, 90, 200]))
        for _ in range(r.choice([1, 2, 5, 25])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = "other%d" % r.randrange(99)
            rows.append((len(rows), " ".join(copy)))
    common = " ".join(words(500, 30))
    rows += [(len(rows) + i, common + " " + " ".join(words(600 + i, 60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    for options in ({}, {"bucket": 3, "block": 4}):
        assert sorted((r.id, r.class_id, r.n_links) for r in near.join(df, **options).collect()) == classes(rows)


def test_join_awkward(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((-1 if r.id is None else r.id, r.class_id or 0, r.n_links) for r in near.join(odd).collect())
    assert got == classes(rows)
    assert count_of(near.join(none)) == 0


def test_runs_reach_the_recall():
    assert near.runs_needed(1.6, 3, 1e-5) == 10


# 10 token files


def test_wavelet_matrix():
    r = random.Random(1)
    for width, n in ((1, 0), (1, 1), (3, 700), (49408, 3000), (1 << 20, 500)):
        ids = np.array([r.randrange(width) if r.random() < 0.5 else 0 for _ in range(n)], np.int64)
        doc_ids, lengths, m = wavelet.unpack(wavelet.pack([5, None], [n, 0], ids))
        assert doc_ids == [5, None] and lengths.tolist() == [n, 0] and (m.decode() == ids).all()
        assert [m.access(i) for i in range(n)] == ids.tolist()
        for value in {0, 1, 2, int(ids[0]) if n else 7, width + 5}:
            at = np.flatnonzero(ids == value).tolist()
            assert m.occurrences(value) == at and m.count(value) == len(at) and m.rank(value, n // 2) == sum(x < n // 2 for x in at)
            assert m.select(value, len(at)) == -1
    with pytest.raises(ValueError):
        wavelet.unpack(wavelet.pack([1], [1], np.array([3]))[:-1])


def test_word_encoder_equals_the_tokenizer():
    encoder, model = token_files.WordEncoder(TOKENIZER, kept=50), token_files.tokenizer(TOKENIZER)
    texts = [prose(1, 200), "It's  the DOG's\n\n1234 x<|endoftext|>y É été… 日本 \t tab\x0b 'll ''", "", " ", "Σίσυφος ΟΔΟΣ", "á ́b", prose(2, 300)]
    assert encoder.by_word and encoder.by_piece
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    for begin in (0, 3):  # a slice as well, as batches are cut
        ids, counts = encoder.encode(pa.array(texts, pa.string()).slice(begin))
        assert ids.tolist() == [i for x in want[begin:] for i in x] and counts.tolist() == [len(x) for x in want[begin:]]
    assert [x.tolist() for x in encoder.encode(pa.array([None, ""], pa.string()))] == [[], [0, 0]]
    byte_level = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not byte_level.by_word and byte_level.encode(pa.array(["a b  c"]))[0].tolist() == byte_level.model.encode("a b  c").ids


def test_word_encoder_merges_a_piece_once():
    """Words that differ in case and marks only share their pieces, in later texts as well; the store stays bounded."""
    encoder, model, merged, whole = token_files.WordEncoder(TOKENIZER), token_files.tokenizer(TOKENIZER), [], []

    class Counted:
        def encode_batch_fast(self, words, **kind):
            whole.extend(words)
            return model.encode_batch_fast(words, **kind)

    merge = encoder.merge
    encoder.merge, encoder.model = lambda piece: (merged.append(piece), merge(piece))[1], Counted()
    for texts in (["Haus haus*** | HAUS.\nhaus%%%,", "haus### ***"], ["Haus&&& haus", "x1y don't"]):
        ids, counts = encoder.encode(pa.array(texts))
        want = [model.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]
    assert sorted(filter(None, merged)) == sorted(["haus", "***", "|", ".", "%%%,", "###", "&&&"]) and sorted(whole) == ["don't", "x1y"]
    small = token_files.WordEncoder(TOKENIZER, kept=20)
    for seed in range(6):
        small.encode(pa.array([prose(seed, 60)]))
        assert len(small.pieces) <= 20 and len(small.older) <= 20 + 2 * 60


def test_word_encoder_on_every_letter_and_mark():
    encoder, model, r = token_files.WordEncoder(TOKENIZER), token_files.tokenizer(TOKENIZER), random.Random(7)
    assert pc.utf8_lower(pa.array(list(token_files.EACH_LETTER))).to_pylist() == [c.lower() for c in token_files.EACH_LETTER]
    pool = token_files.EACH_LETTER + 4 * token_files.MARKS + "'<>09\u0301\u0130\u0131\u200d\u017f日\t\r"
    texts = [x + c for c in token_files.EACH_LETTER for x in ("", "a")] + [x + a + b for a in token_files.MARKS for b in token_files.MARKS for x in ("", "a")]
    texts += [" ".join("".join(r.choices(pool, k=r.randint(0, 7))) for _ in range(4)) for _ in range(3000)]
    ids, counts = encoder.encode(pa.array(texts))
    want = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_token_files_round_trip(spark, odd, none):
    model = token_files.tokenizer(TOKENIZER)
    folder, files = token_files.write_ids(odd, TOKENIZER, shard_ids=150)
    rows = sorted(token_files.read_ids(spark, folder, files).collect(), key=lambda r: r.start)
    want, at = collections.Counter(), 0
    for r in odd.collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda x: (x is not None, x)) and files.count() > 3
    folder, files = token_files.write_ids(none, TOKENIZER)
    assert count_of(token_files.read_ids(spark, folder, files)) == 0
