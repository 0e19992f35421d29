"""Minimal acyclic automata over sorted words, as NumPy arrays, with perfect-hash word numbers and search with one error.

A state is the chain of its edges in ascending order of their character; an edge knows the next edge of its chain and the
chain of the state it leads to. Two chains are one if character, acceptance, target and rest are equal, so equal right
languages share one state and equal tails of chains are shared as well. Building goes height by height, a few array
operations for each: no loop over words. Each edge knows how many words lie below it, and so a path counts the words that
sort before it: the number of a word is its place in the sorted list.
"""

from __future__ import annotations

import numpy as np


class Automaton:
    """The words ``chars[bounds[i]:bounds[i + 1]]``, which are distinct, not empty and in ascending order."""

    def __init__(self, chars: np.ndarray, bounds: np.ndarray):
        self.chars, self.bounds = chars, bounds
        length = np.diff(bounds)
        shared = np.zeros(len(length), np.int64)  # the common prefix with the word before
        live = np.arange(1, len(length))
        j = 0
        while len(live):
            live = live[(length[live] > j) & (length[live - 1] > j)]
            live = live[chars[bounds[live] + j] == chars[bounds[live - 1] + j]]
            j += 1
            shared[live] = j
        # the trie's edges in preorder; a word adds those beyond what it shares
        own = length - shared
        word = np.repeat(np.arange(len(length)), own)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own) + shared[word]
        letter = chars[bounds[word] + depth]
        ends = depth + 1 == length[word]
        child = np.zeros(len(word), np.int64)  # edge numbers from 1; 0 is none
        child[:-1] = np.where(depth[1:] == depth[:-1] + 1, np.arange(1, len(word)) + 1, 0)
        following = np.zeros(len(word), np.int64)
        height = np.zeros(len(word) + 1, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=-1)) + 2))
        for d in reversed(range(len(cut) - 1)):
            at = by_depth[cut[d] : cut[d + 1]]
            group = np.zeros(len(at), np.int64)
            if d:
                group = np.searchsorted(by_depth[cut[d - 1] : cut[d]], at)
            same = group[1:] == group[:-1]
            following[at[:-1][same]] = at[1:][same] + 1
            # 1 + max(height of the target, height of the next edge), for all edges of a chain at once
            i = np.arange(len(at))
            room = int(height.max(initial=0)) + len(at) + 2
            value = height[child[at]] + i + (group[-1] - group if len(at) else 0) * room
            height[at + 1] = np.maximum.accumulate(value[::-1])[::-1] - (group[-1] - group if len(at) else 0) * room - i + 1
        self._merge(letter, ends, child, following, height)

    def _merge(self, letter: np.ndarray, ends: np.ndarray, child: np.ndarray, following: np.ndarray, height: np.ndarray) -> None:
        edge = np.zeros(len(letter) + 1, np.int64)  # the merged edge of each edge of the trie
        parts, n = [], 1
        order = np.argsort(height[1:], kind="stable")
        cut = np.flatnonzero(np.diff(height[1:][order], prepend=-1))
        for at in np.split(order, cut[1:]) if len(order) else []:
            what, where = letter[at] << 1 | ends[at], edge[child[at]] << 32 | edge[following[at]]
            by = np.lexsort((where, what))
            new = np.ones(len(at), bool)
            new[1:] = (what[by][1:] != what[by][:-1]) | (where[by][1:] != where[by][:-1])
            edge[at[by] + 1] = n + np.cumsum(new) - 1
            parts.append((what[by][new], where[by][new]))
            n += int(new.sum())
        what = np.concatenate([np.zeros(1, np.int64), *(p[0] for p in parts)])
        where = np.concatenate([np.zeros(1, np.int64), *(p[1] for p in parts)])
        self.letter, self.final = what >> 1, what & 1
        self.child, self.next = where >> 32, where & 0xFFFFFFFF
        self.root = int(edge[1]) if len(letter) else 0
        self.size = n - 1
        self.words = np.zeros(n, np.int64)  # in a chain from this edge on
        self.under = np.zeros(n, np.int64)  # below this edge
        done = 1
        for p in parts:
            at = np.arange(done, done + len(p[0]))
            self.under[at] = self.final[at] + self.words[self.child[at]]
            self.words[at] = self.under[at] + self.words[self.next[at]]
            done += len(p[0])

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge with the letter (0: none), and the words that sort before it in its chain."""
        state, before = state.copy(), np.zeros(len(state), np.int64)
        go = np.flatnonzero((state > 0) & (self.letter[state] < letter))
        while len(go):
            before[go] += self.under[state[go]]
            state[go] = self.next[state[go]]
            go = go[(state[go] > 0) & (self.letter[state[go]] < letter[go])]
        return np.where((state > 0) & (self.letter[state] == letter), state, 0), before

    def numbers(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not in the list."""
        query, edge, before = self._exact(chars, bounds[:-1], np.diff(bounds))
        out = np.full(len(bounds) - 1, -1, np.int64)
        good = self.final[edge] > 0
        out[query[good]] = before[good]
        return out

    def _exact(self, chars: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, edge, words before) of those whose first ``length`` letters are the beginning of a word; edge 0 at the root."""
        out = []
        query, edge, before = np.arange(len(first)), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        state = np.full(len(first), self.root)
        j = 0
        while len(query):
            done = length[query] == j
            out.append((query[done], edge[done], before[done]))
            query, state, before, edge = query[~done], state[~done], before[~done], edge[~done]
            edge_, more = self.step(state, chars[first[query] + j])
            before = before + self.final[edge] * (edge > 0) + more
            good = edge_ > 0
            query, edge, before = query[good], edge_[good], before[good]
            state = self.child[edge]
            j += 1
        return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))

    def one_error(self, chars: np.ndarray, bounds: np.ndarray, exact: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of all words at one error beyond the first ``exact`` letters of the query, each pair once.

        The error is a replaced letter, or with ``longer`` one that the word has and the query has not. An added letter that
        equals the next one counts as added after it, so it is found in one way only.
        """
        length = np.diff(bounds)
        query, edge, before = self._exact(chars, bounds[:-1], exact)
        at = exact[query]
        wrong: list[tuple[np.ndarray, ...]] = []  # (query, edge, before, place) after the error, by hops
        found_query, found_word = [], []
        held = [np.zeros(0, np.int64)] * 4
        while len(query) or len(held[0]):
            # what has had its error goes on exactly
            if len(held[0]):
                q, e, b, p = held
                over = p == length[q]
                good = over & (self.final[e] > 0)
                found_query.append(q[good])
                found_word.append(b[good])
                q, e, b, p = q[~over], e[~over], b[~over], p[~over]
                e_, more = self.step(self.child[e], chars[bounds[q] + p])
                b = b + self.final[e] + more
                good = e_ > 0
                held = [q[good], e_[good], b[good], p[good] + 1]
            # an error here: every other edge of the state
            if len(query):
                state = np.where(edge > 0, self.child[edge], self.root)
                base = before + self.final[edge]
                open_ = at < length[query]
                here = np.full(len(query), -1, np.int64)
                here[open_] = chars[bounds[query[open_]] + at[open_]]
                q, s, b, p, c = (x if longer else x[open_] for x in (query, state, base, at, here))
                wrong = []
                while len(q):
                    alive = s > 0
                    q, s, b, p, c = q[alive], s[alive], b[alive], p[alive], c[alive]
                    other = self.letter[s] != c
                    wrong.append((q[other], s[other], b[other], p[other] + (0 if longer else 1)))
                    b, s = b + self.under[s], self.next[s]
                held = [np.concatenate([held[i], *(w[i] for w in wrong)]) for i in range(4)]
                query, state, base, at, here = (x[open_] for x in (query, state, base, at, here))
                edge, more = self.step(state, here)
                good = edge > 0
                query, edge, before, at = query[good], edge[good], (base + more)[good], at[good] + 1
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_query or none), np.concatenate(found_word or none)
