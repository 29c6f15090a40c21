"""Rule regexes as one minimal deterministic automaton over bytes.

Rules become one NFA, then a DFA by subset construction, minimised by
partition refinement and stored as a flat transition array over byte classes.
Bytes are read in numpy lanes that advance together.  A rule is a regex of
literals, classes, groups, alternation and greedy repeats.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np


class _Parser:
    """Reads a rule as nested nodes: ("set", 256 booleans), ("cat", nodes), ("alt", nodes), ("rep", node, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def parse(self):
        node = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"a rule has a ) too many: {self.text}")
        return node

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"a rule ends early: {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.item()))
        return ("cat", items)

    def item(self):
        ch = self.take()
        if ch == "(":
            if self.peek() == "?":
                raise ValueError(f"a rule uses (?, which byte automata here do not cover: {self.text}")
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a rule leaves a group open: {self.text}")
            return node
        if ch == "[":
            return ("set", self.members())
        if ch in "^$.*+?{":
            raise ValueError(f"a rule uses {ch}, which byte automata here do not cover: {self.text}")
        return ("set", self.folded([self.escaped() if ch == "\\" else ord(ch)]))

    def escaped(self) -> int:
        ch = self.take()
        if ch == "x":
            return int(self.take() + self.take(), 16)
        if ch.isalnum():
            if ch not in "tnrfv":
                raise ValueError(f"a rule uses \\{ch}, which byte automata here do not cover: {self.text}")
            return ord({"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}[ch])
        return ord(ch)

    def members(self) -> np.ndarray:
        found, negate = [], self.peek() == "^"
        if negate:
            self.take()
        while self.peek() != "]" or not found:
            ch = self.take()
            low = self.escaped() if ch == "\\" else ord(ch)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                ch = self.take()
                high = self.escaped() if ch == "\\" else ord(ch)
            found += range(low, high + 1)
        self.take()
        marks = self.folded(found)
        return ~marks if negate else marks

    def folded(self, codes: list[int]) -> np.ndarray:
        if any(c > 127 for c in codes):
            raise ValueError(f"a rule names bytes beyond ASCII: {self.text}")
        marks = np.zeros(256, bool)
        marks[codes] = True
        if self.fold:
            upper, lower = slice(65, 91), slice(97, 123)
            marks[upper] = marks[lower] = marks[upper] | marks[lower]
        return marks

    def repeated(self, node):
        ch = self.peek()
        if ch in ("?", "*", "+"):
            self.take()
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[ch]
        elif ch == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            least, most = int(low or 0), (int(high) if high else None) if comma else int(low)
        else:
            return node
        if self.peek() in ("?", "+", "*", "{") and self.peek():
            raise ValueError(f"a rule repeats a repeat: {self.text}")
        return ("rep", node, least, most)


def _turned(node):
    """The node that matches the same byte strings read backward."""
    if node[0] in ("cat", "alt"):
        items = [_turned(x) for x in node[1]]
        return (node[0], items[::-1] if node[0] == "cat" else items)
    return ("rep", _turned(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[np.ndarray, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def after(self, state: int) -> int:
        """A state after ``state`` that may take its own byte step."""
        new = self.state()
        self.eps[state].append(new)
        return new

    def add(self, node, start: int) -> int:
        """Add what ``node`` matches from ``start`` on; return its end state, which has no step yet."""
        if node[0] == "set":
            end = self.state()
            self.step[start] = (node[1], end)
            return self.after(end)
        if node[0] == "cat":
            for item in node[1]:
                start = self.add(item, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for option in node[1]:
                self.eps[self.add(option, self.after(start))].append(end)
            return self.after(end)
        _, body, least, most = node
        for _ in range(least):
            start = self.add(body, start)
        end = self.after(start)
        if most is None:
            self.eps[self.add(body, self.after(end))].append(end)
        for _ in range((most or least) - least):
            start = self.add(body, self.after(start))
            self.eps[start].append(end)
        return self.after(end)

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state * classes + byte_class[byte]]`` is the next state times ``classes``; state 0 is the start."""

    byte_class: np.ndarray
    classes: int
    table: np.ndarray
    accepts: np.ndarray
    first_accept: int
    resets: np.ndarray

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_rules(rules: list[tuple[str, bool]], anchored: bool = False, backward: bool = False) -> Dfa:
    """One DFA for ``(pattern, ignore ASCII case)`` rules; bit r of ``accepts`` says that a match of rule r ends here.

    Unanchored, a match may start at any byte.  ``backward`` compiles the
    reversed patterns, for reading right to left.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for r, (pattern, fold) in enumerate(rules):
        first = nfa.state()
        nfa.eps[start].append(first)
        node = _Parser(pattern, fold).parse()
        ends[nfa.add(_turned(node) if backward else node, first)] = r
    sets = np.array([s[0] for s in nfa.step if s is not None])
    _, byte_class = np.unique(sets.T, axis=0, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    classes = int(byte_class.max()) + 1
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(classes)]
    origin = nfa.closure([start])
    number, order, rows = {origin: 0}, [origin], []
    for states in order:
        row = []
        for b in sample:
            to = [nfa.step[s][1] for s in states if nfa.step[s] is not None and nfa.step[s][0][b]]
            new = nfa.closure(to if anchored else [*to, start])
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append(number[new])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order], np.int64)
    return _minimal(table, accepts, byte_class.astype(np.uint8), classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, byte_class: np.ndarray, classes: int) -> Dfa:
    """Merge states that no input tells apart; states that accept are numbered last."""
    _, label = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    one = np.zeros(label.max() + 1, np.int64)
    one[label] = np.arange(len(label))
    order = np.lexsort((np.arange(len(one)), np.arange(len(one)) != label[0], accepts[one] != 0))
    rank = np.empty(len(one), np.int64)
    rank[order] = np.arange(len(one))
    small = rank[label[table[one[order]]]]
    acc = accepts[one[order]]
    return Dfa(byte_class, classes, (small * classes).astype(np.int32).reshape(-1), acc, int((acc == 0).sum()), (small == 0).all(axis=0))


def _lanes(dfa: Dfa, cls: np.ndarray, bounds: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends (positions after the last byte) at which the automaton accepts, in order, and the states there; it starts anew at each of ``bounds``.

    The bytes are cut after bytes that send every state to the start, so the
    pieces are independent and advance together, one byte of each at a time.
    Where no such byte comes, a piece is cut all the same and read as if it
    began in the start state; if the piece before it ends in another state, it
    is read again from that state until both ways are in the same state.
    """
    total = len(cls)
    free = np.flatnonzero(dfa.resets[cls]) + 1
    at = np.searchsorted(free, np.arange(segment, total, segment))
    cuts = np.unique(np.concatenate([bounds, free[at[at < len(free)]]]))
    forced = [np.arange(a + segment, b, segment) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 4 * segment]
    forced = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    cuts = np.union1d(cuts, forced).astype(np.int64)
    begin, size = cuts[:-1], np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    lane_begin, lane_size = begin[order], size[order]
    live = np.searchsorted(-lane_size, -np.arange(lane_size[0] if len(lane_size) else 0), side="left")
    state, last = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
    threshold = dfa.first_accept * dfa.classes
    ends, states = [], []
    for i, n in enumerate(live.tolist()):
        last[n : len(state)] = state[n:]
        state = dfa.table[state[:n] + cls[lane_begin[:n] + i]]
        if state.max() >= threshold:
            hit = np.flatnonzero(state >= threshold)
            ends.append(lane_begin[hit] + (i + 1))
            states.append(state[hit])
    last[: len(state)] = state
    ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    states = np.concatenate(states) if states else np.zeros(0, np.int32)
    if len(forced):
        final = np.empty_like(last)
        final[order] = last
        ends, states = _mended(dfa, cls, begin, size, np.isin(begin, forced), final, ends, states)
    by = np.argsort(ends, kind="stable")
    return ends[by], states[by]


def _mended(dfa: Dfa, cls, begin, size, forced, final, ends, states):
    """``ends`` and ``states`` with the beginnings of forced pieces read from the state in which the piece before them ends."""
    alone, true = final, final.copy()
    read_from = np.zeros(len(begin), np.int32)
    fixes: dict[int, tuple[int, list, list]] = {}
    threshold = dfa.first_accept * dfa.classes
    todo = np.flatnonzero(forced)
    while len(todo := todo[true[todo - 1] != read_from[todo]]):
        read_from[todo] = true[todo - 1]
        lane, a, b, i = todo, read_from[todo], np.zeros(len(todo), np.int32), 0
        found = {k: (0, [], []) for k in todo.tolist()}
        true[todo] = alone[todo]
        while len(lane):
            c = cls[begin[lane] + i]
            a, b, i = dfa.table[a + c], dfa.table[b + c], i + 1
            met = a == b
            for k in np.flatnonzero((a >= threshold) & ~met).tolist():
                found[int(lane[k])][1].append(int(begin[lane[k]]) + i)
                found[int(lane[k])][2].append(int(a[k]))
            over = ~met & (size[lane] == i)
            true[lane[over]] = a[over]
            for k in lane[met | over].tolist():
                found[k] = (i - 1 if alone[k] == true[k] and k not in lane[over] else i, *found[k][1:])
            stay = ~(met | over)
            lane, a, b = lane[stay], a[stay], b[stay]
        fixes |= found
        todo = todo + 1
        todo = todo[todo < len(begin)]
        todo = todo[forced[todo]]
    prefix = np.zeros(len(begin), np.int64)
    prefix[list(fixes)] = [f[0] for f in fixes.values()]
    lane = np.searchsorted(begin, ends - 1, side="right") - 1
    keep = ends > begin[lane] + prefix[lane]
    more = [np.array([x for f in fixes.values() for x in f[c]], np.int64) for c in (1, 2)]
    return np.concatenate([ends[keep], more[0]]), np.concatenate([states[keep], more[1].astype(np.int32)])


def scan(dfa: Dfa, body: np.ndarray, offsets: np.ndarray, segment: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Ends (byte positions after the last byte, in order) at which rules match, and their accept masks; texts are ``body[offsets[i]:offsets[i+1]]``.  One pass over the bytes."""
    base = int(offsets[0])
    ends, states = _lanes(dfa, dfa.byte_class[body[base : int(offsets[-1])]], offsets - base, segment)
    return ends + base, dfa.accepts[states // dfa.classes]


#: Bytes after which the few matches that still go on are followed one by one.
_FOLLOW = 4096


def _longest(dfa: Dfa, body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The end of the longest match of an anchored automaton from each start; its text ends at the stop."""
    cls, table, dead, first = dfa.byte_class, dfa.table, _dead(dfa), dfa.first_accept * dfa.classes
    end, lane, state, i = starts.copy(), np.arange(len(starts)), np.zeros(len(starts), np.int32), 0
    while len(lane) and i < _FOLLOW:
        inside = starts[lane] + i < stops[lane]
        lane, state = lane[inside], state[inside]
        state = table[state + cls[body[starts[lane] + i]]]
        i += 1
        end[lane[state >= first]] = starts[lane[state >= first]] + i
        go = state != dead
        lane, state = lane[go], state[go]
    steps = table.tolist() if len(lane) else []
    for k, s in zip(lane.tolist(), state.tolist()):
        at = int(starts[k]) + i
        for c in cls[body[at : int(stops[k])]].tolist():
            s = steps[s + c]
            at += 1
            if s >= first:
                end[k] = at
            elif s == dead:
                break
    return end


def spans(forward: Dfa, backward: Dfa, body: np.ndarray, texts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Leftmost-longest, non-overlapping spans of one rule, which matches at ``ends`` (ascending positions after a last byte).

    ``texts`` are the (begin, end) of the texts with matches, in order.
    Reading those backward marks all starts.  From the first start after each
    run of ends the match is followed forward, all matches in lanes; where the
    order of matches asks for another start, that one is followed as well.
    """
    size = np.diff(texts, axis=1)[:, 0]
    upto = np.cumsum(size)
    joined = np.concatenate([body[a:b] for a, b in texts.tolist()])
    at, _ = _lanes(backward, backward.byte_class[joined[::-1]], np.r_[0, np.cumsum(size[::-1])], 2048)
    starts = len(joined) - at[::-1]
    of = np.searchsorted(upto, starts, side="right")
    starts, stops = starts + (texts[:, 1] - upto)[of], texts[of, 1]
    runs = ends[np.flatnonzero(np.r_[ends[1:] != ends[:-1] + 1, True])]
    likely = np.unique(np.searchsorted(starts, np.r_[texts[:, 0], runs]))
    likely = likely[likely < len(starts)]
    known = dict(zip(likely.tolist(), _longest(forward, body, starts[likely], stops[likely]).tolist()))
    out, k, listed = [], 0, starts.tolist()
    while k < len(listed):
        if k not in known:
            known[k] = int(_longest(forward, body, starts[k : k + 1], stops[k : k + 1])[0])
        out.append((listed[k], known[k]))
        k = bisect_left(listed, known[k], k + 1)
    return out


def _dead(dfa: Dfa) -> int:
    rows = dfa.table.reshape(dfa.states, dfa.classes)
    own = np.arange(dfa.states)[:, None] * dfa.classes
    dead = np.flatnonzero((rows == own).all(axis=1) & (dfa.accepts == 0))
    return int(dead[0]) * dfa.classes if len(dead) else -1
