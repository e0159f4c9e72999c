"""Small deterministic automata from regular expressions: subset construction and minimisation.

Accepted syntax: literals, ``\\xHH`` and ``\\``-escaped characters, classes ``[a-z0-9]``, groups, ``|``, ``?``,
``*``, ``+``, ``{m}``, ``{m,}``. All of it is over bytes.
"""

from __future__ import annotations


class _Nfa:
    def __init__(self):
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.empty.append([])
        return len(self.empty) - 1


class _Parser:
    """Recursive descent; every part returns (start, end) states of a fragment."""

    def __init__(self, pattern: str, nfa: _Nfa, fold: bool):
        self.text, self.at, self.nfa, self.fold = pattern, 0, nfa, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        start, end = self.nfa.state(), self.nfa.state()
        for a, b in parts:
            self.nfa.empty[start].append(a)
            self.nfa.empty[b].append(end)
        return start, end

    def sequence(self):
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.empty[end].append(a)
            end = b
        return start, end

    def repeated(self):
        begin = self.at
        part = self.atom()
        source = self.text[begin : self.at]
        mark = self.peek()
        if mark not in ("?", "*", "+", "{"):
            return part
        self.at += 1
        if mark == "{":
            close = self.text.index("}", self.at)
            low, comma, high = self.text[self.at : close].partition(",")
            self.at = close + 1
            if high:
                raise ValueError("an upper bound of repetitions is not supported")
            least, more = int(low), bool(comma)
        else:
            least, more = (1 if mark == "+" else 0), mark in "*+"
        start = end = self.nfa.state()
        for n in range(max(least, 1)):
            a, b = part if n == 0 else _Parser(source, self.nfa, self.fold).atom()
            self.nfa.empty[end].append(a)
            last, end = (a, b), b
        if more:
            self.nfa.empty[last[1]].append(last[0])
        if least == 0:
            self.nfa.empty[start].append(end)
        return start, end

    def atom(self):
        c = self.peek()
        if c == "(":
            self.at += 1
            part = self.choice()
            self.at += 1
            return part
        return self.accepting(self.char_class() if c == "[" else {self.char()})

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def char_class(self) -> set[int]:
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found.update(range(low, self.char() + 1))
            else:
                found.add(low)
        self.at += 1
        return found

    def accepting(self, codes: set[int]):
        if self.fold:
            codes = codes | {ord(f(chr(c))) for c in codes if c < 128 for f in (str.lower, str.upper)}
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.moves[start] = (frozenset(codes), end)
        return start, end


def _reversed(nfa: _Nfa, start: int, end: int) -> tuple[_Nfa, int, int]:
    back = _Nfa()
    for _ in nfa.empty:
        back.state()
    extra: list[tuple[int, int, frozenset[int]]] = []
    for s, targets in enumerate(nfa.empty):
        for t in targets:
            back.empty[t].append(s)
        if nfa.moves[s]:
            extra.append((nfa.moves[s][1], s, nfa.moves[s][0]))
    for t, s, codes in extra:
        mid = back.state()
        back.moves[mid] = (codes, s)
        back.empty[t].append(mid)
    return back, end, start


class Automaton:
    """One table for all rules: ``table[state + symbol]`` is the next state; states are multiples of ``width``.

    A symbol is a byte's kind (``symbols`` translates bytes to kinds: bytes that no rule tells apart share one),
    or ``reset + k``, which puts rule k alone back to its start where one of its matches may end.
    ``accepts[state]`` is a bit set of the rules of which a match may end there. States below ``quiet`` end none.
    """

    def __init__(self, rules: list[tuple[str, bool]], search: bool = True, backwards: bool = False):
        nfa_of, starts, ends = [], [], []
        for pattern, fold in rules:
            nfa = _Nfa()
            start, end = _Parser(pattern, nfa, fold).choice()
            if backwards:
                nfa, start, end = _reversed(nfa, start, end)
            nfa_of.append(nfa)
            starts.append(start)
            ends.append(end)
        first = [self._closed(nfa, [start]) for nfa, start in zip(nfa_of, starts)]
        kinds = self._byte_kinds(nfa_of)
        self.reset, self.width = len(kinds), len(kinds) + len(rules)
        self.symbols = bytes(next(i for i, members in enumerate(kinds) if byte in members) for byte in range(256))
        subsets, rows, queue = {tuple(first): 0}, [], [tuple(first)]

        def number(subset: tuple[frozenset[int], ...]) -> int:
            if subset not in subsets:
                subsets[subset] = len(subsets)
                queue.append(subset)
            return subsets[subset]

        closures: dict[tuple[int, frozenset[int]], frozenset[int]] = {}

        def step(k: int, states: frozenset[int], byte: int) -> frozenset[int]:
            moves = nfa_of[k].moves
            to = frozenset(moves[q][1] for q in states if moves[q] and byte in moves[q][0])
            if (k, to) not in closures:
                closures[k, to] = self._closed(nfa_of[k], list(to)) | (first[k] if search else frozenset())
            return closures[k, to]

        for now in queue:  # grows while it is read
            row = [number(tuple(step(k, s, members[0]) for k, s in enumerate(now))) for members in kinds]
            for k in range(len(rules)):
                ended = ends[k] in now[k]
                row.append(number(tuple(first[k] if i == k and ended else s for i, s in enumerate(now))))
            rows.append(row)
        accepts = [sum(1 << k for k, e in enumerate(ends) if e in s[k]) for s in subsets]
        dead = [not any(s) for s in subsets]
        self._minimise(rows, accepts, dead)

    @staticmethod
    def _byte_kinds(nfas: list[_Nfa]) -> list[list[int]]:
        """Bytes that no rule tells apart."""
        tests = sorted({tuple(sorted(m[0])) for nfa in nfas for m in nfa.moves if m})
        tests = [frozenset(t) for t in tests]
        kinds: dict[tuple[bool, ...], list[int]] = {}
        for byte in range(256):
            kinds.setdefault(tuple(byte in t for t in tests), []).append(byte)
        return list(kinds.values())

    @staticmethod
    def _closed(nfa: _Nfa, states: list[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def _minimise(self, rows: list[list[int]], accepts: list[int], dead: list[bool]) -> None:
        """Moore's refinement: states stay together while all their moves lead to the same classes."""
        block = [(a, d) for a, d in zip(accepts, dead)]
        names = {b: i for i, b in enumerate(dict.fromkeys(block))}
        block, count = [names[b] for b in block], len(names)
        while True:
            signs = [(block[s], tuple(block[t] for t in row)) for s, row in enumerate(rows)]
            names = {x: i for i, x in enumerate(dict.fromkeys(signs))}
            block = [names[x] for x in signs]
            if len(names) == count:
                break
            count = len(names)
        sample = {b: s for s, b in reversed(list(enumerate(block)))}
        order = sorted(sample, key=lambda b: (accepts[sample[b]] != 0, sample[b] != 0, b))
        place = {b: i for i, b in enumerate(order)}
        self.states = len(order)
        self.start = place[block[0]] * self.width
        offset = [i * self.width for i in range(self.states)]
        self.table = [offset[place[block[t]]] for b in order for t in rows[sample[b]]]
        self.accepts = [accepts[sample[b]] for b in order]
        self.dead = [dead[sample[b]] for b in order]
        self.quiet = sum(a == 0 for a in self.accepts) * self.width
