"""Byte-level BPE as a deterministic automaton (problem 8).

The merge list is compiled merge by merge. The automaton starts with one state that loops on every
byte. The gadget of merge ``a b -> ab`` takes every path ``p -a-> q -b-> r``, adds the arc
``p -ab-> r`` and redirects ``p -a->`` to a copy of ``q`` that lacks the arc ``b``. All arcs with one
label lead to one state, so a state is known by the label read last, and its arcs by the history of
merges. The arc table is therefore not written out (it would have 50k x 50k entries): ``arc(x, y)``
replays the gadgets that touched the pair, newest first, and keeps the answer.

A word has exactly one accepted path; its arc labels are the token ids. Reading left to right, the
label that ends the path of each prefix is filled in from the table, so a word of ``n`` bytes costs
``n`` times the longest token, whatever it contains.
"""

from __future__ import annotations

import json
import os

import regex

#: Fixed value: the public pattern that splits a text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
NEVER = 1 << 60


def _printable_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary file: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeAutomaton:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str = PATTERN, memory: int = 100_000):
        """``memory``: words whose ids are kept, and a tenth of the arcs, before both stores are emptied; it bounds memory, not results."""
        self.split = regex.compile(pattern).findall
        self.label = {i: b for b, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        self.width = size
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.trie: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        for word, i in vocab.items():
            if len(word) > 1 and self.born[i] < 0:
                continue  # no path ever bears this label
            node = 0
            for byte in word:
                nxt = self.trie[node].get(byte)
                if nxt is None:
                    nxt = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.final.append(-1)
                node = nxt
            self.final[node] = i
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.memory = memory

    def _gadget(self, k: int, a: int, b: int, ab: int) -> None:
        """Merge ``k``. Without a path ``-a-> -b->`` at that time it changes nothing."""
        made = all(self.born[x] >= 0 or len(self.label[x]) == 1 for x in (a, b))
        if not made or not self._replay(a, b, k):
            return
        self.pair[a * self.width + b] = k
        if self.born[ab] < 0:
            self.left[ab], self.right[ab], self.born[ab] = a, b, k

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> "BpeAutomaton":
        spec = json.load(open(os.path.join(folder, f"{name}.json"), encoding="utf-8"))
        byte = _printable_bytes()
        raw = lambda s: bytes(byte[c] for c in s)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        return cls(vocab, [(raw(a), raw(b)) for a, b in merges])

    def arc(self, x: int, y: int) -> bool:
        """Whether the finished automaton has an arc ``y`` out of the state reached by ``x``."""
        key = x * self.width + y
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._replay(x, y)
        return known

    def _replay(self, x: int, y: int, now: int = NEVER) -> bool:
        left, right, born, pair, width = self.left, self.right, self.born, self.pair, self.width
        while True:
            if pair.get(x * width + y, NEVER) < now:
                return False  # the gadget of (x, y) took this arc away
            if left[y] == x and right[y] == x:
                return False  # in a run of x the leftmost pair merges first
            bx, by = born[x], born[y]
            if bx < 0 and by < 0:
                return True
            if bx > by:
                x, now = right[x], bx  # x's state was copied from its right part's when x was made
            else:
                y, now = left[y], by  # the arc y was added wherever its left part's arc stood then

    def word(self, text: str) -> list[int]:
        ids = self.words.get(text)
        if ids is None:
            if len(self.words) >= self.memory or len(self.arcs) >= 10 * self.memory:
                self.words.clear()
                self.arcs.clear()
            ids = self.words[text] = self._walk(text.encode("utf-8", "replace"))
        return ids

    def _walk(self, data: bytes) -> list[int]:
        n, trie, final, arcs, width = len(data), self.trie, self.final, self.arcs, self.width
        last = [-1] * (n + 1)
        for i in range(n):
            x, node, e = last[i], 0, i
            while e < n:
                node = trie[node].get(data[e])
                if node is None:
                    break
                e += 1
                y = final[node]
                if y >= 0 and last[e] < 0:
                    ok = True if i == 0 else arcs.get(x * width + y)
                    if ok is None:
                        ok = self.arc(x, y)
                    if ok:
                        last[e] = y
        ids, e = [], n
        while e > 0:
            ids.append(last[e])
            e -= len(self.label[last[e]])
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have the empty list."""
        if not text:
            return []
        out: list[int] = []
        word = self.word
        for w in self.split(text):
            out += word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], BpeAutomaton] = {}


def automaton(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BpeAutomaton:
    """The compiled automaton of this process."""
    if (name, folder) not in _LOADED:
        _LOADED[name, folder] = BpeAutomaton.load(name, folder)
    return _LOADED[name, folder]
