"""License scan with a positional rare-token index.

The index holds licence templates as word sequences. A word's IDF is taken over the templates; each template is posted under
its ``anchors`` highest-IDF words with their positions, so that common words ("license", "the") are never looked up. For a
file, the places of its posted words are found; every place i and posting (template, p) votes for the start i - p, which
intersects the postings by relative position. A start with enough votes (all anchors of a phrase, two of a passage) is
a candidate, and it counts only if the template's mandatory key phrases stand at their relative positions: exactly for
phrases, within ``slack`` words for passages, whose coverage (share of template words in place) is the score.

Every base phrase is a template whose key phrase is itself, so each of its places is found exactly once: the anchor word
at that place votes for it, and no other start is accepted.

Defined cases: a null or empty text has no words, no labels, score 0 and null first_word and last_word; rows that repeat are
scanned each; an empty table gives an empty result; only the id and the text of the input are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidelog.llm.common import map_texts

#: Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence passages by label, and the key phrases that must stand in them; wording of the published licences.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "provided that the following conditions are met"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
]

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """Words of the text with A-Z lower-cased."""
    return WORD.findall(text.translate(UPPER) if not text.isascii() else text.lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # position in the template, words
    base: bool


class Index:
    def __init__(self, base: dict[str, str], passages: list, anchors: int = 4, slack: int = 3):
        def at(words, key):
            return next(i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key)

        self.slack = slack
        self.templates = [Template(label, w, ((0, w),), True) for phrase, label in base.items() for w in [tuple(words_of(phrase))]]
        for label, text, keys in passages:
            w = tuple(words_of(text))
            self.templates.append(Template(label, w, tuple((at(w, k), k) for k in (tuple(words_of(x)) for x in keys)), False))
        df = Counter(w for t in self.templates for w in set(t.words))
        idf = {w: math.log(1 + len(self.templates) / n) for w, n in df.items()}
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, t in enumerate(self.templates):
            rare = sorted(range(len(t.words)), key=lambda i, t=t: (-idf[t.words[i]], i))[: 1 if t.base else anchors]
            self.needed.append(1 if t.base else min(2, len(rare)))
            for i in rare:
                self.postings[t.words[i]].append((k, i))
        self.rare = frozenset(self.postings)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], set[str], float]:
        """n_words; (start, label) of each base place; all labels; score."""
        words = words_of(text)
        if self.rare.isdisjoint(words):
            return len(words), [], set(), 0.0
        votes: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.rare:
                votes.update((k, i - p) for k, p in self.postings[w])
        found, labels, score = [], set(), 0.0
        for (k, start), n in votes.items():
            t = self.templates[k]
            if n < self.needed[k] or not all(self.key(words, start + p, key, 0 if t.base else self.slack) for p, key in t.keys):
                continue
            labels.add(t.label)
            score = max(score, sum(0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words)) / len(t.words))
            if t.base:
                found.append((start, t.label))
        return len(words), found, labels, score

    @staticmethod
    def key(words: list[str], at: int, key: tuple[str, ...], slack: int) -> bool:
        return any(i >= 0 and tuple(words[i : i + len(key)]) == key for i in range(at - slack, at + slack + 1))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, passages: list | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base, passages = BASE if base is None else base, PASSAGES if passages is None else passages

    def make():
        index = Index(base, passages)

        def work(ids, texts):
            got = [index.scan(t) for t in texts]
            starts = [[s for s, _ in f] for _, f, _, _ in got]
            return {
                "doc_id": ids,
                "n_words": [g[0] for g in got],
                "n_base": [len(s) for s in starts],
                "first_word": [min(s, default=None) for s in starts],
                "last_word": [max(s, default=None) for s in starts],
                "base_labels": [",".join(sorted({x for _, x in g[1]})) for g in got],
                "labels": [",".join(sorted(g[2])) for g in got],
                "score": [g[3] for g in got],
            }

        return work

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, id_col, text_col, make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
