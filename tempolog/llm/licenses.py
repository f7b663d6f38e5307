"""License scan by a positional index of rare licence words.

Templates are short licence notices and their mandatory key phrases, each
indexed as a pattern of its own: a word has postings ``(pattern, position)``.
The words' document frequencies come from the whole corpus.  For each file and
pattern the file's rarest words of that pattern are looked up, and occurrence
minus position proposes where the pattern would start.  A key phrase stands
where all its looked-up words propose the same start and the phrase is there
word for word; since all its words stand in a file that has it, no place is
missed.  A label counts where one of its key phrases stands; the score is how
much of the notice, by weight, stands where its rare words agree most, but no
less than what the key phrase weighs.

A *base* template is one phrase that is its own key phrase: its places are
counted, exactly.

Edge cases: a null or empty text has no word, no label and score 0; ids are of
any type; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes to word bytes: A-Z lower-cased, other ASCII but letters and digits to space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """``keys``: mandatory phrases, any one is enough.  ``base``: exact phrase search."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: The phrases whose places are counted exactly.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
)

#: Notices the method recognises beyond the base phrases (public licence wording).
NOTICES = (
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3", "general public license either version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2", "general public license either version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0", "mozilla public license version 2 0")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "under the bsd license")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge to any person",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", ("may not use this file except in compliance",)),
    Template("cc0", "released under the creative commons zero public domain dedication cc0", ("creative commons zero", "cc0 1 0")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike", "cc by sa")),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


class Index:
    """Postings of licence words, with their weights."""

    def __init__(self, templates: tuple[Template, ...], docs_with: dict[bytes, int], n_docs: int, rare: int = 4):
        self.rare = rare
        self.notices = [t.text.encode().split() for t in templates]
        self.templates = templates
        #: Key phrases of all templates: exact patterns, and the template each belongs to.
        self.keys = [(i, k.encode().split()) for i, t in enumerate(templates) for k in t.keys]
        #: Postings: the places of each word, by pattern.
        self.of_key, self.of_notice = _postings([key for _, key in self.keys]), _postings(self.notices)
        self.words = self.of_key.keys() | self.of_notice.keys()
        self.needs = [len(set(key)) for _, key in self.keys]
        self.idf = {w: math.log((n_docs + 1) / (docs_with.get(w, 0) + 1)) + 1e-9 for w in self.words}
        #: By falling weight, ties by the word: the order in which a file's words are looked up.
        self.rank = {w: r for r, w in enumerate(sorted(self.words, key=lambda w: (-self.idf[w], w)))}

    def places(self, k: int, at: dict[bytes, list[int]], words: list[bytes]) -> list[int]:
        """Where a key phrase stands: the starts that its rarest words agree on, verified word for word."""
        key = self.keys[k][1]
        starts: set[int] | None = None
        for w in sorted(set(key), key=self.rank.__getitem__)[: self.rare]:
            here = {p - q for q in self.of_key[w][k] for p in at[w]}
            starts = here if starts is None else starts & here
            if not starts:
                return []
        return sorted(s for s in starts if s >= 0 and words[s : s + len(key)] == key)

    def likeness(self, i: int, at: dict[bytes, list[int]], words: list[bytes]) -> float:
        """The share, by weight, of a notice that stands where most of its rarest words in the file agree."""
        notice = self.notices[i]
        votes: dict[int, int] = defaultdict(int)
        for w in sorted({w for w in notice if w in at}, key=self.rank.__getitem__)[: self.rare]:
            for s in {p - q for q in self.of_notice[w][i] for p in at[w]}:
                votes[s] += 1
        most, best = max(votes.values(), default=0), 0.0
        for s in (s for s, n in votes.items() if n == most):
            best = max(best, sum(self.idf[w] for q, w in enumerate(notice) if 0 <= s + q < len(words) and words[s + q] == w))
        return best / sum(self.idf[w] for w in notice)

    def share(self, i: int, key: list[bytes]) -> float:
        """What a key phrase weighs beside the words of its notice: the least that it counts for."""
        weigh = lambda some: sum(self.idf[w] for w in some)
        return weigh(set(key)) / weigh({*key, *self.notices[i]})

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], set[str], float]:
        """Base places ``(label, start)``, all labels, and the best score."""
        here = self.words & set(words)
        have: dict[int, int] = defaultdict(int)
        for w in here & self.of_key.keys():
            for k in self.of_key[w]:
                have[k] += 1
        open_ = sorted(k for k, n in have.items() if n == self.needs[k])  # a phrase that lacks a word can't stand
        if not open_:
            return [], set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in here:
                at[w].append(p)
        base, labels, score = [], set(), 0.0
        seen: set[int] = set()
        for k in open_:
            if not (found := self.places(k, at, words)):
                continue
            i, key = self.keys[k]
            t = self.templates[i]
            labels.add(t.label)
            if t.base:
                base += [(t.label, s) for s in found]
                score = 1.0
            elif i not in seen and score < 1:
                seen.add(i)
                score = max(score, self.likeness(i, at, words), self.share(i, key))
        return base, labels, min(1.0, score)


def _postings(patterns: list[list[bytes]]) -> dict[bytes, dict[int, list[int]]]:
    out: dict[bytes, dict[int, list[int]]] = {}
    for k, words in enumerate(patterns):
        for q, w in enumerate(words):
            out.setdefault(w, {}).setdefault(k, []).append(q)
    return out


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many texts of the whole corpus each licence word stands, and how many texts there are.

    The result has one row for each word of the templates at most, so it is small by construction.
    """
    vocabulary = {w for t in templates for p in (t.text, *t.keys) for w in p.encode().split()}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: dict[bytes, int] = defaultdict(int)
        for t in texts(batch, "t"):
            for w in vocabulary.intersection(words_of(t)):
                n[w] += 1
        n[b""] = batch.num_rows
        return pa.record_batch({"w": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(n.values(), pa.int64())})

    rows = map_arrow(docs.select(F.col(text).alias("t")), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {r.w.encode(): r.n for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """One row per document: its words, base places, labels and score; ``places`` lists each base place."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    index = Index(templates, *document_frequencies(docs, templates, "t"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in texts(batch, "t"):
            words = words_of(t)
            base, labels, score = index.scan(words)
            places = sorted((s, label) for label, s in base)
            out.append(
                {
                    "n_words": len(words), "n_base": len(base), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
                    "base_labels": ",".join(sorted({x for x, _ in base})), "labels": ",".join(sorted(labels)), "score": score, "places": [{"label": x, "word": s} for s, x in places],
                }
            )
        made = pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], ["doc_id", *made.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, each, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long>>")


_SCHEMA = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ]
)
