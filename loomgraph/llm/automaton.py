"""Regular expressions as one minimal deterministic automaton over bytes.

The syntax is that of the standard library's parser, whose tree is turned into a nondeterministic
automaton; subset construction over classes of bytes that no rule tells apart and partition refinement
give transition arrays. Supported: literals, classes, groups, alternatives, repeats, (?i) for ASCII.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from collections import defaultdict
from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.on.append(None)
        return len(self.empty) - 1


_CATEGORY = {K.CATEGORY_DIGIT: set(b"0123456789"), K.CATEGORY_SPACE: set(b" \t\n\r\x0b\x0c"), K.CATEGORY_WORD: set(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def _bytes(items, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    negate = False
    for op, x in items:
        if op is K.NEGATE:
            negate = True
        elif op is K.LITERAL:
            out.add(x)
        elif op is K.RANGE:
            out |= set(range(x[0], x[1] + 1))
        elif op is K.CATEGORY and x in _CATEGORY:
            out |= _CATEGORY[x]
        else:
            raise ValueError(f"unsupported in a class: {op}")
    if any(x > 127 for x in out):
        raise ValueError("classes hold ASCII characters")
    if fold:
        out |= {x ^ 32 for x in out if chr(x).isalpha()}
    return frozenset(set(range(256)) - out if negate else out)


def _build(nfa: _Nfa, tree, start: int, fold: bool) -> int:
    """Adds tree after start; the state it ends in."""
    at = start
    for op, x in tree:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            items = [(K.LITERAL, x)] if op is K.LITERAL else [(K.NEGATE, None), (K.LITERAL, x)] if op is K.NOT_LITERAL else [(K.NEGATE, None), (K.LITERAL, 10)] if op is K.ANY else x
            to = nfa.state()
            nfa.on[at] = (_bytes(items, fold), to)
            at = to
        elif op is K.SUBPATTERN:
            _, on, off, inner = x
            at = _build(nfa, inner, at, (fold or bool(on & K.SRE_FLAG_IGNORECASE)) and not off & K.SRE_FLAG_IGNORECASE)
        elif op is K.BRANCH:
            end = nfa.state()
            for inner in x[1]:
                first = nfa.state()
                nfa.empty[at].append(first)
                nfa.empty[_build(nfa, inner, first, fold)].append(end)
            at = end
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = x
            for _ in range(low):
                at = _build(nfa, inner, at, fold)
            if high is K.MAXREPEAT:
                first, end = nfa.state(), nfa.state()
                nfa.empty[at] += [first, end]
                last = _build(nfa, inner, first, fold)
                nfa.empty[last] += [first, end]
                at = end
            else:
                end = nfa.state()
                for _ in range(high - low):
                    nfa.empty[at].append(end)
                    first = nfa.state()
                    nfa.empty[at].append(first)
                    at = _build(nfa, inner, first, fold)
                nfa.empty[at].append(end)
                at = end
        else:
            raise ValueError(f"unsupported: {op}")
    return at


@dataclass(frozen=True, eq=False)
class Automaton:
    """step[state * classes + class_of[byte]] is the next state; state 0 is the start."""

    class_of: np.ndarray
    classes: int
    step: np.ndarray
    accepts: np.ndarray  # bit r: rule r ends here
    dead: np.ndarray  # no rule can end any more

    def resets(self) -> np.ndarray:
        """Bytes after which every state is the start: no match goes across them."""
        t = self.step.reshape(-1, self.classes)
        return np.array([bool((t[:, c] == 0).all()) for c in self.class_of])


def compile_rules(patterns: list[str], anywhere: bool) -> Automaton:
    """One automaton for all patterns. anywhere: matches may begin at any byte, else at the first."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for r, p in enumerate(patterns):
        tree = parser.parse(p)
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[_build(nfa, tree, first, bool(tree.state.flags & K.SRE_FLAG_IGNORECASE))] = r
    # bytes that no transition tells apart are one class
    kinds: dict[tuple, int] = {}
    sets = sorted({x[0] for x in nfa.on if x}, key=sorted)
    class_of = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.int32)
    members: dict[int, int] = {}
    for b in range(255, -1, -1):
        members[int(class_of[b])] = b

    def closure(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    start = closure([root])
    number, order, step = {start: 0}, [start], []
    while len(step) < len(order):
        now = order[len(step)]
        row = []
        for c in range(len(kinds)):
            to = closure([x[1] for s in now if (x := nfa.on[s]) and members[c] in x[0]])
            if anywhere:
                to |= start
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        step.append(row)
    accepts = np.array([sum({1 << ends[s] for s in x if s in ends}) for x in order], np.int64)
    return _minimal(class_of, np.array(step, np.int64), accepts)


def _minimal(class_of: np.ndarray, step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Partition refinement: states with equal rules and equally placed successors become one."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        key = np.column_stack([block, block[step]])
        finer = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # the start becomes state 0
    first = {int(b): i for i, b in reversed(list(enumerate(block)))}
    names = {int(block[0]): 0}
    for b in range(int(block.max()) + 1):
        names.setdefault(b, len(names))
    rename = np.array([names[b] for b in range(len(names))])
    new = np.zeros((len(names), step.shape[1]), np.int64)
    acc = np.zeros(len(names), np.int64)
    for b, i in first.items():
        new[names[b]] = rename[block[step[i]]]
        acc[names[b]] = accepts[i]
    live = acc != 0
    back = defaultdict(set)
    for s, row in enumerate(new):
        for t in row:
            back[int(t)].add(s)
    todo = list(np.flatnonzero(live))
    while todo:
        for s in back[int(todo.pop())]:
            if not live[s]:
                live[s] = True
                todo.append(s)
    return Automaton(class_of, step.shape[1], new.reshape(-1).astype(np.int32), acc, ~live)
