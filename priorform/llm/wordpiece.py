"""Word-piece token counts by a linear longest-match automaton.

Greedy longest match needs to look back when a long candidate fails. Here the vocabulary is one trie with a failure
link per node: the node to go on from after the pieces that the greedy match would have popped there, and the number
of these pieces. A word is counted in one pass over its characters, and no piece is ever built.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow

WORDS = re.compile(r"\w+|[^\w\s]").findall
REMEMBERED = 500_000
NOWHERE = -1


def split_vocabulary(pieces: Iterable[str], mark: str = "▁") -> tuple[set[str], set[str]]:
    """Pieces that start a word (marked) and pieces that continue one."""
    first, inner = set(), set()
    for p in pieces:
        (first if p.startswith(mark) else inner).add(p.removeprefix(mark))
    return first - {""}, inner - {""}


class Automaton:
    """Nodes are numbers, 0 the start of a word and 1 the start of a continuation."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.next: dict[tuple[int, str], int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        ends = set()
        for root, words in ((0, first), (1, inner)):
            for word in words:
                node = root
                for ch in word:
                    to = self.next.get((node, ch))
                    if to is None:
                        to = self.next[node, ch] = len(children)
                        children[node].append((ch, to))
                        children.append([])
                    node = to
                ends.add(node)
        self.fail = [NOWHERE] * len(children)
        self.pops = [0] * len(children)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for ch, v in children[u]:
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z != NOWHERE and (z, ch) not in self.next:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != NOWHERE:
                        self.fail[v], self.pops[v] = self.next[z, ch], popped
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of the word, 0 if it cannot be matched to its end."""
        follow, fail, pops = self.next.get, self.fail, self.pops
        node = total = 0
        for ch in word:
            to = follow((node, ch))
            while to is None:
                total += pops[node]
                node = fail[node]
                if node == NOWHERE:
                    return 0
                to = follow((node, ch))
            node = to
        while node != 1:
            total += pops[node]
            node = fail[node]
            if node == NOWHERE:
                return 0
        return total


_AUTOMATA: dict[str, Automaton] = {}  # of this worker, by vocabulary


def counts(docs: DataFrame, first: set[str], inner: set[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_tokens, n_unknown`` per input row.

    Words are runs of letters, digits and underscores, and single other signs that are not white space. A word
    that the vocabulary cannot spell is one unknown token. Null and empty texts have none. The vocabulary is a
    tokenizer's, so its size is fixed; it is shipped as two sets and built into an automaton once per worker.
    """
    vocabulary = sorted(first), sorted(inner)
    name = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    memory: dict[str, int] = {}

    def run(cols):
        if name not in _AUTOMATA:
            _AUTOMATA[name] = Automaton(*shipped.value)
        machine = _AUTOMATA[name]
        words_, tokens, unknown = [], [], []
        for text in cols["text"]:
            words = WORDS(text) if text else []
            if len(memory) > REMEMBERED:
                memory.clear()
            found = []
            for w in words:
                n = memory.get(w)
                if n is None:
                    n = machine.count(w)
                    if len(w) <= 64:
                        memory[w] = n
                found.append(n)
            lost = found.count(0)
            words_.append(len(words))
            tokens.append(sum(found) + lost)
            unknown.append(lost)
        return {"id": cols["id"], "n_words": words_, "n_tokens": tokens, "n_unknown": unknown}

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)
