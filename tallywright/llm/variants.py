"""Spelling variants: words of a corpus that differ by one edit, and the frequent form that each of them stands for.

The vocabulary acceptor is composed with a transducer of exactly one edit and with the acceptor again. The composition
is cut by its initial states. A pair with the shorter word's length m shares either the first half of the shorter word
(the edit comes later) or what follows that half (the edit lies before it). So an initial-state partition is: length m,
a window of positions in which the edit lies, and the shared letters before and behind the window. Each partition has
two minimised acceptors over one set of states: of its words of length m, and of those of length m + 1. A partition of
too many words is cut into windows of half the width, down to one position, where it holds few words whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallywright.llm.common import stored

LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one partition; larger ones are cut further.
PARTITION_WORDS = 20_000
FOUND = "word string, n_near bigint, best_n bigint, best string"


class Acceptors:
    """Minimal acyclic acceptors of several word lists over shared states, so that equal rests of words are one state.

    A state is its arcs, (letter, state) in order, and whether a word ends there. ``count`` has the words that a
    state accepts, which numbers the words of a list: a word's number is the count of all words sorted before it.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple] = []
        self.final: list[bool] = []
        self.count: list[int] = []

    def _state(self, final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.arcs)
            self.arcs.append(key[1])
            self.final.append(final)
            self.count.append(final + sum(self.count[s] for _, s in arcs))
        return at

    def add(self, words: list[str]) -> int:
        """Start state of the acceptor of sorted, different words; states no longer reached by new words are merged at once."""
        path: list[list] = [[False, []]]  # open states along the last word: final, arcs that are settled
        last = ""
        for word in words:
            shared = 0
            while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                shared += 1
            while len(path) > shared + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))
            path += [[False, []] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))
        return self._state(*path[0])


class OneEdit:
    """Composition of acceptors with a transducer of exactly one edit, as numbers of left and right words.

    The transducer copies letters, then replaces one by a later one of the alphabet or inserts one that differs from
    the letter to be read next, then copies to the end. So each pair of words has one path and is found once:
    replacements with the smaller word on the left, insertions with the shorter one. Composed states are made when
    they are reached; pairs of states known to share no word are not entered again.
    """

    def __init__(self, acceptors: Acceptors):
        self.a = acceptors
        self.apart: set[tuple[int, int]] = set()

    def _copied(self, x: int, i: int, y: int, j: int) -> list[tuple[int, int]]:
        """Numbers of the words that both states accept, the left ones counted from i, the right ones from j."""
        a, apart, out = self.a, self.apart, []
        if (x, y) in apart:
            return out
        todo = [(x, i, y, j)]
        while todo:
            p, i, q, j = todo.pop()
            if p == q:  # one merged state: the same words on both sides
                out += [(i + k, j + k) for k in range(a.count[p])]
                continue
            if a.final[p] and a.final[q]:
                out.append((i, j))
            i, j = i + a.final[p], j + a.final[q]
            right = {}
            for letter, state in a.arcs[q]:
                right[letter] = (state, j)
                j += a.count[state]
            for letter, state in a.arcs[p]:
                if letter in right and (state, right[letter][0]) not in apart:
                    todo.append((state, i, *right[letter]))
                i += a.count[state]
        if not out:
            apart.add((x, y))
        return out

    def _numbered(self, state: int, i: int) -> list[tuple[str, int, int]]:
        """Arcs of a state with the number of the first word behind each."""
        i, out = i + self.a.final[state], []
        for letter, to in self.a.arcs[state]:
            out.append((letter, to, i))
            i += self.a.count[to]
        return out

    def replaced(self, start: int) -> list[tuple[int, int]]:
        """Pairs of words of one acceptor that differ in one letter."""
        out, todo = [], [(start, 0)]
        while todo:
            arcs = self._numbered(*todo.pop())
            for k, (_, p, i) in enumerate(arcs):
                todo.append((p, i))
                for _, q, j in arcs[k + 1 :]:
                    out += self._copied(p, i, q, j)
        return out

    def inserted(self, short: int, long: int, at_end: bool) -> list[tuple[int, int]]:
        """Pairs of a short word and a long one that has one letter more; ``at_end``: also behind the last letter."""
        out, todo = [], [(short, 0, long, 0)]
        while todo:
            p, i, q, j = todo.pop()
            left, right = self._numbered(p, i), self._numbered(q, j)
            if at_end and self.a.final[p]:
                out += [(i, k) for _, to, k in right if self.a.final[to]]
            nexts = {letter: (to, k) for letter, to, k in right}
            for a, to, k in left:
                if a in nexts:
                    todo.append((to, k, *nexts[a]))
            for b, to, k in right:
                behind = {letter: (s, n) for letter, s, n in self._numbered(to, k)}
                for a, s, n in left:
                    if a != b and a in behind:
                        out += self._copied(s, n, *behind[a])
        return out


def near_pairs(short: list[str], long: list[str], at_end: bool) -> list[tuple[int, int, bool]]:
    """Pairs that differ by one edit, as numbers in ``short``, and in ``short`` again or (True) in ``long``; both sorted."""
    acceptors = Acceptors()
    starts = acceptors.add(short), acceptors.add(long)
    edit = OneEdit(acceptors)
    return [(i, j, False) for i, j in edit.replaced(starts[0])] + [(i, j, True) for i, j in edit.inserted(*starts, at_end)]


def _better(n: int, word: str, best: tuple[int, str] | None) -> bool:
    return best is None or n > best[0] or n == best[0] and word < best[1]


def _enumerate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and partition: near words in it and the best of them. Rows arrive sorted by partition, length and window."""
    key, sides = None, ([], [])

    def close():
        short, long = sides
        if not short or len(short) + len(long) < 2:
            return {}
        m, hi = key[0], key[2]
        found: dict[str, list] = {}
        for i, j, longer in near_pairs([x[0] for x in short], [x[0] for x in long], hi == m):
            (_, u, un), (_, v, vn) = short[i], (long if longer else short)[j]
            for word, other, n in ((u, v, vn), (v, u, un)):
                seen = found.setdefault(word, [0, None])
                seen[0] += 1
                if _better(n, other, seen[1]):
                    seen[1] = (n, other)
        return found

    def rows(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([v[1][0] for v in found.values()], pa.int64()), pa.array([v[1][1] for v in found.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        out = []
        for *own, window, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                out.append(close())
                key, sides = own, ([], [])
            sides[len(word) > own[0]].append((window, word, n))
        yield from (rows(found) for found in out if found)
    if found := close():
        yield rows(found)


def counted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, noise: int = 31) -> DataFrame:
    """(word, n): runs of letters in whole texts with A-Z lower-cased, one letter deleted where ``noise`` divides the run's hash.

    The hash is the CRC-32 of "<id>:<run>" (a null id counts as empty); it also chooses the letter. Runs under ``least`` letters
    can't give a word of that length and are not taken out of the text.
    """
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("d"), F.explode(found).alias("r"))
    runs = runs.select("d", F.translate("r", UPPER, LOWER).alias("r")).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r")))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))
    words = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("r")).alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _windows(lo: Column, hi: Column, m: Column) -> Column:
    """The two halves of a window; the first is left out where it would be empty."""
    middle = F.floor((lo + hi) / 2).cast("int")
    halves = F.array(F.struct(m.alias("m"), lo.alias("lo"), middle.alias("hi")), F.struct(m.alias("m"), middle.alias("lo"), hi.alias("hi")))
    return F.filter(halves, lambda w: w["lo"] < w["hi"])


def _placed(rows: DataFrame) -> DataFrame:
    """Shared letters before and behind the window ``w``, and the letters in it."""
    size, tail = F.length("word"), F.col("w.m") - F.col("w.hi")
    return rows.select(
        "w.m", "w.lo", "w.hi", F.substring(F.col("word"), F.lit(1), F.col("w.lo")).alias("head"),
        F.substring(F.col("word"), size - tail + 1, tail).alias("tail"),
        F.substring(F.col("word"), F.col("w.lo") + 1, size - F.col("w.lo") - tail).alias("window"), "word", "n")


CELL = ["m", "lo", "hi", "head", "tail"]


def partitions(words: DataFrame, least: int, most: int = PARTITION_WORDS) -> DataFrame:
    """Every word in the initial-state partitions that it can have a near word in; none has over ``most`` words
    unless its window is a single position."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= least)
    halves = F.flatten(F.transform(lengths, lambda m: _windows(F.lit(0), m, m)))
    placed, done = _placed(words.select("word", "n", F.explode(halves).alias("w"))), []
    while True:
        full = stored(placed.groupBy(*CELL).count().filter((F.col("count") > most) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "full-partitions")
        if full.isEmpty():
            break
        done.append(placed.join(full, CELL, "left_anti"))
        again = placed.join(full, CELL).select("word", "n", F.explode(_windows(F.col("lo"), F.col("hi"), F.col("m"))).alias("w"))
        placed = stored(_placed(again), "partition-words")
    for part in done:
        placed = placed.unionByName(part)
    return placed


def near_words(words: DataFrame, least: int = 7, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a near one: exactly one letter inserted, deleted or replaced."""
    cells = partitions(words, least, most)
    dealt = cells.repartition(*CELL).sortWithinPartitions(*CELL, "window", "word")
    found = dealt.select(*CELL, "window", "word", "n").mapInArrow(_enumerate, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``root`` beside ``word`` and ``form``: forms followed to the last; the word itself without one.

    Every round doubles the steps of those not yet at an end, so few rounds are needed; each is a table of its own.
    """
    ends = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        steps = ends.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = stored(ends.join(steps, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "to")
        if moved.filter("moved").isEmpty():
            break
    found = ends.select(F.col("word").alias("_word"), F.col("to").alias("_root"))
    return forms.join(found, F.col("word") == F.col("_word"), "left").withColumn("root", F.coalesce("_root", "word")).drop("_word", "_root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2, factor: int = 10,
                      noise: int = 31, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least`` letters that occurs ``least_n`` times.

    The form is the near word of largest n (ties: the first by code point), if its n is at least ``factor`` times the
    word's; else null. Null and empty texts hold no word; rows that repeat count again; runs of any length are words;
    an empty table gives no row; other columns are not read.
    """
    words = stored(counted_runs(docs, id_col, text_col, least, noise).filter(F.col("n") >= least_n), "words")
    near = near_words(words, least, most).select(F.col("word").alias("_word"), "n_near", "best_n", "best")
    strong = F.col("best_n") >= factor * F.col("n")
    forms = stored(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
