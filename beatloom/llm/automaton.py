"""Byte automata: many regexes in one table.

``compile_rules`` turns regexes over bytes into one deterministic automaton:
Thompson fragments, subset construction over byte classes, minimisation by
partition refinement. The table is a flat list indexed by ``state + byte`` with
states premultiplied by 256, ordered so that accepting states come last.
"""

from __future__ import annotations

import re._constants as C
import re._parser as regex_parser
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np


class Automaton(NamedTuple):
    table: list[int]
    start: int
    hot: int  # states from here on accept
    accepts: dict[int, tuple[int, ...]]  # state -> rules that end here
    dead: int  # state that can never accept, -1 if none


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def charset(self, items, fold: bool) -> frozenset[int]:
        out: set[int] = set()
        negate = False
        for op, arg in items:
            if op is C.NEGATE:
                negate = True
            elif op is C.LITERAL:
                out.add(arg)
            elif op is C.RANGE:
                out.update(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"unsupported class item {op}")
        if fold:
            out |= {ord(chr(c).swapcase()) for c in out if c < 128}
        return frozenset(set(range(256)) - out if negate else out)

    def build(self, tree, at: int, fold: bool, reverse: bool) -> int:
        """Add ``tree`` after node ``at``; returns the node behind it."""
        for op, arg in reversed(list(tree)) if reverse else tree:
            if op in (C.LITERAL, C.IN, C.ANY):
                items = [(op, arg)] if op is C.LITERAL else arg if op is C.IN else [(C.NEGATE, None), (C.LITERAL, 10)]
                end = self.node()
                self.arcs[at].append((self.charset(items, fold), end))
                at = end
            elif op is C.SUBPATTERN:
                at = self.build(arg[3], at, fold, reverse)
            elif op is C.BRANCH:
                end = self.node()
                for branch in arg[1]:
                    first = self.node()
                    self.eps[at].append(first)
                    self.eps[self.build(branch, first, fold, reverse)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    at = self.build(body, at, fold, reverse)
                if high is C.MAXREPEAT:
                    loop = self.node()
                    self.eps[at].append(loop)
                    self.eps[self.build(body, loop, fold, reverse)].append(loop)
                    at = loop
                else:
                    end = self.node()
                    for _ in range(high - low):
                        self.eps[at].append(end)
                        at = self.build(body, at, fold, reverse)
                    self.eps[at].append(end)
                    at = end
            else:
                raise ValueError(f"unsupported regex part {op}")
        return at


def compile_rules(rules: Sequence[tuple[str, bool]], *, anchored: bool = False, reverse: bool = False) -> Automaton:
    """One automaton for ``(regex, ignore case)`` rules over bytes.

    Unanchored automata accept wherever a match of a rule ends. ``reverse``
    reads the bytes from right to left.
    """
    nfa = _Nfa()
    start = nfa.node()
    final: dict[int, int] = {}
    for i, (pattern, fold) in enumerate(rules):
        first = nfa.node()
        nfa.eps[start].append(first)
        final[nfa.build(regex_parser.parse(pattern), first, fold, reverse)] = i

    def closure(nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in nfa.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    # bytes that no rule tells apart share a class
    sets = list({s for arcs in nfa.arcs for s, _ in arcs})
    marks = [tuple(b in s for s in sets) for b in range(256)]
    classes = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    of_byte = np.array([classes[m] for m in marks])
    sample = [marks.index(m) for m in classes]

    begin = closure([start])
    ids, rows, todo = {begin: 0}, [], [begin]
    for state in todo:
        row = []
        for b in sample:
            to = {n for s in state for chars, n in nfa.arcs[s] if b in chars}
            nxt = closure(to | (set() if anchored else {start}))
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
            row.append(ids[nxt])
        rows.append(row)
    step = np.array(rows)
    ends = [tuple(sorted({final[n] for n in s if n in final})) for s in todo]
    kinds = {e: i for i, e in enumerate(dict.fromkeys(ends))}

    # minimisation: split blocks until the successors' blocks agree
    block = np.array([kinds[e] for e in ends])
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    one = np.zeros(n, dtype=int)
    one[block] = np.arange(len(block))
    order = sorted(range(n), key=lambda b: (bool(ends[one[b]]), b))
    place = np.empty(n, dtype=int)
    place[order] = np.arange(n)
    table = place[block[step[one[order]]]][:, of_byte] * 256
    accepts = {int(place[b]) * 256: ends[one[b]] for b in range(n) if ends[one[b]]}
    dead = next((int(place[b]) * 256 for b in range(n) if not ends[one[b]] and (block[step[one[b]]] == b).all()), -1) if anchored else -1
    shared = {v: v for v in range(0, n * 256, 256)}
    return Automaton([shared[v] for v in table.reshape(-1).tolist()], int(place[block[0]]) * 256, min(accepts, default=n * 256), accepts, dead)


def longest(a: Automaton, data: bytes, at: int, to: int, step: int = 1) -> int:
    """Last accepting position when reading from ``at`` towards ``to``; -1 if none.

    Forward positions are exclusive ends; backward (``step`` -1) reads
    ``data[at - 1]`` first and returns the start of the match.
    """
    state, best, table = a.start, -1, a.table
    if step == 1:
        for i in range(at, to):
            state = table[state + data[i]]
            if state == a.dead:
                break
            if state >= a.hot:
                best = i + 1
    else:
        for i in range(at - 1, to - 1, -1):
            state = table[state + data[i]]
            if state == a.dead:
                break
            if state >= a.hot:
                best = i
    return best
