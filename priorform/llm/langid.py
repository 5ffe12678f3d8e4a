"""Language identification by words first, then ever shorter character n-grams.

Every word of a text is scored in every language by the logarithm of its relative frequency there. A word no
language knows backs off to the longest order of character n-grams of which some language knows one, averaged
over its known n-grams; a text's score is the mean over its words, and the best language wins.

Training may read a bounded sample: ``docs_per_lang`` whole texts per language, picked by a hash of the id, so
a dominant language or source costs no more than any other. A word or n-gram belongs to a language's model when
its relative frequency there is at least ``least``, so no order of a language has more than ``1 / least``
entries and the model may be broadcast at any size of the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow

_RUNS = re.compile(r"[^\W\d_]+").findall
UNKNOWN_LANGUAGE = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters. What the expression takes for words also holds numerals such as fractions; they are cut out."""
    words = _RUNS(text)
    if words and not "".join(words).isalpha():
        words = [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return words

REMEMBERED = 400_000


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; the whole padded word when it is shorter. No lone blank."""
    if n == 1:
        return [*word]
    padded = f" {word} "
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


class ScoreTable(Mapping):
    """Words or n-grams with a row of numbers each, all in one matrix: an array of its own per entry takes twice the memory."""

    def __init__(self, width: int):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, width))

    def row(self, gram: str, empty: float) -> np.ndarray:
        """The row of an entry, to be filled; a new one holds ``empty``."""
        at = self.place.setdefault(gram, len(self.place))
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.full((max(64, len(self.rows)), self.rows.shape[1]), empty)])
        return self.rows[at]

    def trim(self) -> None:
        self.rows = self.rows[: len(self.place)].copy()

    def __getitem__(self, gram: str) -> np.ndarray:
        return self.rows[self.place[gram]]

    def __iter__(self):
        return iter(self.place)

    def __len__(self) -> int:
        return len(self.place)


@dataclass
class LanguageModel:
    languages: list[str]
    orders: int
    tables: list[ScoreTable]  # [0] words, [n] n-grams: log10 of the relative frequency per language
    absent: list[float]  # the score of what a language does not have, per table

    def word_scores(self, word: str) -> np.ndarray | None:
        known = self.tables[0].place.get(word)
        if known is not None:
            return self.tables[0].rows[known]
        for n in range(self.orders, 0, -1):
            found = [v for v in map(self.tables[n].place.get, grams_of(word, n)) if v is not None]
            if found:
                return np.mean(self.tables[n].rows[found], axis=0)
        return None

    def predict(self, texts: list[str | None], memory: dict | None = None) -> tuple[list[str], list[float]]:
        """Language and confidence (share of the best language among all, at the mean score of a word)."""
        return self.judge(texts, memory)[:2]

    def judge(self, texts: list[str | None], memory: dict | None = None) -> tuple[list[str], list[float], list[bool]]:
        """The same, and whether a word or an n-gram of the text is known in any language."""
        memory = {} if memory is None else memory
        labels, scores, known = [], [], []
        index: dict[str, int] = memory.setdefault("index", {})
        rows: np.ndarray = memory.setdefault("rows", np.zeros((1024, len(self.languages))))  # the first stands for unknown words
        filled = memory.setdefault("filled", 1)
        for text in texts:
            words = words_of(text.lower()) if text else []
            if not words or not self.languages:
                labels.append(UNKNOWN_LANGUAGE)
                scores.append(0.0)
                known.append(False)
                continue
            if len(index) > REMEMBERED:
                index.clear()
                filled = 1
            for w in {*words}:
                if w not in index:
                    s = self.word_scores(w)
                    index[w] = 0 if s is None else filled
                    if s is not None:
                        if filled == len(rows):
                            rows = memory["rows"] = np.concatenate([rows, np.zeros_like(rows)])
                        rows[filled] = s
                        filled += 1
            memory["filled"] = filled
            ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            used = ids[ids > 0]
            mean = rows[used].mean(axis=0) if len(used) else rows[0]
            best = int(np.argmax(mean))  # of equals the first in order of name
            labels.append(self.languages[best])
            scores.append(float(1.0 / np.exp(math.log(10) * (mean - mean[best])).sum()))
            known.append(bool(len(used)))
        return labels, scores, known


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", *,
    docs_per_lang: int = 4000, orders: int = 5, least: float = 1e-5, penalty: float = 7.0,
) -> LanguageModel:
    """Learn from rows with text and language. ``penalty``: minus log10 of what is absent, as a frequency."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], orders, [ScoreTable(0) for _ in range(orders + 1)], [0.0] * (orders + 1))
    steps = 1 << 30
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(steps, steps * docs_per_lang // sizes[k])))])
    sample = rows.where(F.pmod(F.xxhash64("i", F.lit(17)), F.lit(steps)) < share[F.col("lang")]).select("lang", "text")

    def count(cols):
        words: dict[str, Counter] = {}
        for lang, text in zip(cols["lang"], cols["text"]):
            words.setdefault(lang, Counter()).update(words_of(text.lower()))
        out = {"lang": [], "n": [], "gram": [], "c": []}
        for lang, bag in words.items():
            tables = [bag] + [Counter() for _ in range(orders)]
            for w, c in bag.items():
                for n in range(1, orders + 1):
                    for g in grams_of(w, n):
                        tables[n][g] += c
            for n, t in enumerate(tables):
                out["lang"] += [lang] * len(t)
                out["n"] += [n] * len(t)
                out["gram"] += t.keys()
                out["c"] += t.values()
        return out

    counts = map_arrow(sample, count, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    kept = counts.join(F.broadcast(totals), ["lang", "n"]).where(F.col("c") >= least * F.col("total"))
    tables = [ScoreTable(len(languages)) for _ in range(orders + 1)]
    at = {k: i for i, k in enumerate(languages)}
    for lang, n, gram, c, total in kept.select("lang", "n", "gram", "c", "total").toLocalIterator():
        tables[n].row(gram, -penalty)[at[lang]] = math.log10(c / total)
    for table in tables:
        table.trim()
    return LanguageModel(languages, orders, tables, [-penalty] * (orders + 1))


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[str | Column] | None = None, text_col: str = "text", into: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default, the new ones replaced) with the columns ``into``.

    A third name gets whether anything of the text, a word or an n-gram, is known in any language.

    ``und`` and 0 for a null text, a text without a letter, or a model without languages. Repeated rows are
    repeated in the result. Texts are read whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    memory: dict = {}

    def run(cols):
        return {**{k: v for k, v in cols.items() if k != "__text"}, **dict(zip(into, shipped.value.judge(cols["__text"], memory)))}

    names = keep if keep is not None else [c for c in docs.columns if c not in into]
    kept = docs.select(*names).schema.fields
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    source = docs.select(*names, F.col(text_col).alias("__text"))
    added = ", ".join(f"`{name}` {kind}" for name, kind in zip(into, ("string", "double", "boolean")))
    return map_arrow(source, run, f"{fields}, {added}", keep=[f.name for f in kept])
