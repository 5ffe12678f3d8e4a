"""Licence scan by a positional index over the rarest words of licence templates.

A template is the word sequence of a licence line; its mandatory key phrases must stand at their places, other
words may differ. Of each template the words that are rarest in the scanned corpus (highest IDF) are its anchors:
they are looked up in a file's words, each occurrence proposes the start that the template's posting implies, the
starts of a template's anchors are intersected, and the key phrases are verified there. Files without any anchor
are done after one look at their set of words. Only columns and SQL functions, no shuffle of files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # mandatory stretches: start and end in ``words``
    base: bool = False


def line(label: str, text: str, *keys: str, base: bool = False) -> Template:
    """A template from its text; without key phrases all of it is mandatory."""
    words = tuple(text.split())
    spans = []
    for key in keys or (text,):
        k = tuple(key.split())
        spans.append(next((i, i + len(k)) for i in range(len(words)) if words[i : i + len(k)] == k))
    return Template(label, words, tuple(spans), base)


#: The lines by which licences are usually declared.
TEMPLATES = (
    line("mit", "under the mit license", base=True),
    line("apache-2", "apache license version 2", base=True),
    line("cc-by-nc", "cc by nc", base=True),
    line("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
         "permission is hereby granted", "any person obtaining a copy"),
    line("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
         "redistribution and use in source and binary forms", "are permitted"),
    line("gpl", "under the terms of the gnu general public license", "gnu general public license"),
    line("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    line("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    line("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    line("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
         "permission to use copy modify", "with or without fee"),
    line("cc-by", "creative commons attribution"),
    line("cc-by-sa", "cc by sa"),
    line("cc0", "creative commons zero"),
    line("all-rights-reserved", "all rights reserved"),
    line("spdx", "spdx license identifier"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text_col: str) -> Column:
    """Words of the text with A to Z lower-cased.

    ``lower`` also maps other letters; of these only the Kelvin sign becomes an ASCII letter, so it is
    replaced by another letter before. Words stay words either way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[str, int]:
    """In how many documents each template word stands (0 for words of none)."""
    vocabulary = sorted({w for t in templates for w in t.words})
    wanted = F.array(*map(F.lit, vocabulary))
    counts = docs.select(F.explode(F.array_intersect(words_of(text_col), wanted)).alias("w")).groupBy("w").count()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counts.collect()}


def anchors(template: Template, df: dict[str, int], n: int) -> list[tuple[str, int]]:
    """The ``n`` rarest words of the template's key phrases, each with its first place."""
    places = {}
    for start, end in template.keys:
        for i in range(start, end):
            places.setdefault(template.words[i], i)
    return sorted(places.items(), key=lambda x: (df.get(x[0], 0), x[1]))[:n]


def scan(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text",
    anchors_per_template: int = 2, df: dict[str, int] | None = None,
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per input row.

    ``n_base`` counts all places of base templates, ``first_word`` and ``last_word`` are their smallest and
    largest start. ``labels`` holds those of all verified templates. ``score`` is the largest share of a
    verified template's words that stand in place, 0 without any. Null and empty texts have no words.
    """
    df = rarity(docs, templates, text_col) if df is None else df
    index = [anchors(t, df, anchors_per_template) for t in templates]
    rare = sorted({w for a in index for w, _ in a})
    words = F.col("w")
    none = F.array().cast("array<int>")
    read = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("w"))
    seen = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))
    empty = F.array().cast("array<struct<w:string,i:int>>")
    read = read.withColumn("a", F.when(F.arrays_overlap(words, F.array(*map(F.lit, rare))), seen).otherwise(empty))

    def starts(t: Template, postings: list[tuple[str, int]]) -> Column:
        def proposed(word: str, at: int) -> Column:
            return F.transform(F.filter("a", lambda x: x["w"] == word), lambda x: x["i"] - F.lit(at))

        both = F.array_distinct(reduce(F.array_intersect, [proposed(*p) for p in postings]))

        def stands(s: Column) -> Column:
            ok = (s >= 0) & (s + len(t.words) <= F.size(words))
            for a, b in t.keys:
                ok = ok & (F.slice(words, F.greatest(s, F.lit(0)) + 1 + a, b - a) == F.array(*map(F.lit, t.words[a:b])))
            return ok

        return F.when(F.size("a") > 0, F.filter(both, stands)).otherwise(none)

    found = read.select("id", "w", *(starts(t, p).alias(f"s{k}") for k, (t, p) in enumerate(zip(templates, index))))

    def share(k: int, t: Template) -> Column:
        hit = lambda s: F.size(F.filter(F.zip_with(F.slice(words, s + 1, len(t.words)), F.array(*map(F.lit, t.words)), lambda x, y: x == y), lambda x: x))
        if sum(b - a for a, b in t.keys) == len(t.words):
            return F.when(F.size(f"s{k}") > 0, 1.0).otherwise(0.0)
        return F.coalesce(F.array_max(F.transform(f"s{k}", lambda s: hit(s) / F.lit(float(len(t.words))))), F.lit(0.0))

    def names(kinds: list[int]) -> Column:
        labels = F.array(*(F.when(F.size(f"s{k}") > 0, F.lit(templates[k].label)) for k in kinds))
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")

    base = [k for k, t in enumerate(templates) if t.base]
    places = F.flatten(F.array(*(F.col(f"s{k}") for k in base)))
    return found.select(
        F.col("id").alias(id_col), F.size("w").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(list(range(len(templates)))).alias("labels"),
        F.greatest(*(share(k, t) for k, t in enumerate(templates))).alias("score"),
    )
