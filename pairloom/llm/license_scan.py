"""License scans with a positional index of rare words.

Every template (a notice or the opening of a license text) is indexed by the positions of its highest-IDF words,
IDF being taken over all documents: the index maps a word to its postings (template, position). A document looks up its
own licence words of highest IDF, which are those that the index has. Each place of such a word and each of its postings give a vote
(template, place - position); votes are sorted, so those for the same template at the same place stand together, and a
template stands where most agree. Coverage is the share of the template's indexed positions that agree. A label is
given when coverage reaches ``COVERAGE`` and the document holds the template's mandatory key phrase word for word.

Beside that, given phrases are found wherever their words stand consecutively.

Only DataFrame functions are used, and nothing but word counts of the templates' words is shuffled: a document's words,
votes and phrases stay in its row. Postings, labels and phrases are literals, whose number grows with the templates; the
expressions do not. Only templates of which a document holds enough distinct words get votes.

Defined cases: a null text counts as empty and has no words; an empty table gives no rows; rows are independent, so
ties and repeated rows need nothing; the first of equally good places wins; texts of any length are scanned whole in their
row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.text import let
from pairloom.llm.common import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Indexed positions of a template.
INDEXED = 8
#: Share of them that must agree.
COVERAGE = 0.75

# Phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrase: str

    @property
    def words(self) -> list[str]:
        return self.text.split()


def _gnu(label: str, name: str, version: str, later: bool) -> Template:
    """The notice that files under a GNU license carry, for one version or any later one."""
    either, or_later = ("either ", " of the license or at your option any later version") if later else ("", " of the license")
    text = (
        f"this program is free software you can redistribute it and or modify it under the terms of the {name} as published "
        f"by the free software foundation {either}version {version}{or_later}"
    )
    return Template(f"{label}-{version.replace(' ', '.')}-{'or-later' if later else 'only'}", text, f"terms of the {name} as published")


def _creative(parts: str, version: str) -> Template:
    names = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    long = " ".join(names[p] for p in parts.split("-"))
    text = f"this work is licensed under the creative commons {long} {version} international license to view a copy of this license visit"
    return Template(f"cc-{parts}-{version.replace(' ', '.')}", text, f"creative commons {long} {version}")


_GNU = (
    ("gpl", "gnu general public license", ("1", "2", "3")),
    ("lgpl", "gnu library general public license", ("2",)),
    ("lgpl", "gnu lesser general public license", ("2 1", "3")),
    ("agpl", "gnu affero general public license", ("3",)),
)
_CREATIVE = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")

# Notices and openings of licenses, in lower case without punctuation.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "copy modify and or distribute"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance", "mozilla public license version 1 1"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("epl-1.0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    Template("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use", "will the authors be held liable"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("wtfpl", "this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it and or modify it under the terms of the do what the fuck you want to public license", "what the fuck you want to public license"),
    Template("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "related and neighboring rights"),
    Template("artistic-2.0", "this package is free software you can redistribute it and or modify it under the terms of the artistic license", "terms of the artistic license"),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    Template("odbl-1.0", "this database is made available under the open database license", "open database license"),
    *(_gnu(label, name, version, later) for label, name, versions in _GNU for version in versions for later in (False, True)),
    *(_creative(parts, version) for parts in _CREATIVE for version in ("3 0", "4 0")),
    *(Template(f"cc-{parts}-4.0", f"licensed under cc {parts.replace('-', ' ')} 4 0", f"cc {parts.replace('-', ' ')} 4 0") for parts in _CREATIVE if parts != "by-nc"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _literal(items: Sequence) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _places(w: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand consecutively."""
    parts = phrase.split()
    here = lambda x, i: reduce(
        lambda a, b: a & b, [x == parts[0], *[F.get(w, i + k) == p for k, p in enumerate(parts[1:], 1)]]
    )
    return F.filter(F.transform(w, lambda x, i: F.when(here(x, i), i.cast("long"))), lambda i: i.isNotNull())


def _holds(present: Column, some: Sequence[str], least: int) -> Column:
    return F.size(F.array_intersect(present, _literal(some))) >= least


def _texts(items: Sequence[str]) -> str:
    """An array literal of words, which hold nothing but letters and digits, or of labels."""
    return "array(" + ", ".join(f"'{x}'" for x in items) + ")"


def document_counts(docs: DataFrame, wanted: Sequence[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each of the wanted words, and all documents: one row a word reaches the driver."""
    held = docs.select(F.explode(F.concat(F.array_intersect(words(F.col("text")), _literal(wanted)), F.array(F.lit("")))).alias("word"))
    counts = dict(held.groupBy("word").count().collect())
    return counts, counts.get("", 0)


def index(templates: Sequence[Template], counts: dict[str, int]) -> list[list[tuple[int, str]]]:
    """The (position, word) of every template that are indexed: its highest IDF, first ones on ties."""
    return [
        sorted(sorted(enumerate(t.words), key=lambda p: (counts.get(p[1], 0), p[0]))[:INDEXED])
        for t in templates
    ]


class _Index:
    """Postings and everything else about templates as literal columns, by template number or word."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int], coverage: float):
        indexed = index(templates, counts)
        postings: dict[str, list[tuple[int, int]]] = {}
        for number, places in enumerate(indexed):
            for position, word in places:
                postings.setdefault(word, []).append((number, position))
        #: Words of the index from the highest IDF to the lowest.
        self.lexicon = sorted(postings, key=lambda w: (counts.get(w, 0), w))
        numbers = lambda values: F.expr(f"array({', '.join(map(str, values))})")
        distinct = [len({word for _, word in places}) for places in indexed]
        needed = [ceil(coverage * len(places) - 1e-9) for places in indexed]
        self.size, self.needed = numbers(map(len, indexed)), numbers(needed)
        # Fewer distinct words than this cannot reach the coverage.
        self.least = numbers(max(1, n - len(places) + d) for n, places, d in zip(needed, indexed, distinct))
        self.labels = F.expr(_texts([t.label for t in templates]))
        self.phrases = F.expr("array(" + ", ".join(_texts(t.key_phrase.split()) for t in templates) + ")")
        self.words = F.expr("array(" + ", ".join(_texts(sorted({w for _, w in places})) for places in indexed) + ")")
        votes = lambda found: "array(" + ", ".join(f"named_struct('t', {t}, 'p', {p})" for t, p in found) + ")"
        self.postings = F.expr("map(" + ", ".join(f"'{w}', {votes(found)}" for w, found in postings.items()) + ")")

    @staticmethod
    def of(literal: Column, number: Column) -> Column:
        return F.element_at(literal, number + 1)

    def possible(self, rare: Column) -> Column:
        """The templates of which a document holds enough distinct words, given its words of the index."""
        every = F.flatten(F.transform(rare, lambda w: F.array_distinct(F.transform(F.element_at(self.postings, w), lambda v: v["t"]))))
        start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("found"))

        def step(s: Column, t: Column) -> Column:
            run = F.when(s["t"] == t, s["run"] + 1).otherwise(F.lit(1))
            found = F.when(run == self.of(self.least, t), F.array_append(s["found"], t)).otherwise(s["found"])
            return F.struct(t.alias("t"), run.alias("run"), found.alias("found"))

        return F.aggregate(F.sort_array(every), start, step, lambda s: s["found"])

    def covered(self, w: Column, chosen: Column) -> Column:
        """(t, run): templates of ``chosen`` that stand in a document, with the indexed positions that agree at most."""
        wanted = F.array_distinct(F.flatten(F.transform(chosen, lambda t: self.of(self.words, t))))

        def voted(looked: Column) -> Column:
            hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(looked, x), F.struct(x.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
            votes = F.transform(
                hits,
                lambda h: F.transform(
                    F.filter(F.element_at(self.postings, h["w"]), lambda v: F.array_contains(chosen, v["t"])),
                    lambda v: F.struct(v["t"].alias("t"), (h["i"] - v["p"]).alias("at")),
                ),
            )
            return F.sort_array(F.flatten(votes))

        kind = "struct<t:int,at:int>"
        start = F.struct(F.lit(None).cast(kind).alias("v"), F.lit(0).alias("run"), F.array().cast("array<struct<t:int,run:int>>").alias("found"))

        def step(s: Column, v: Column) -> Column:
            run = F.when(s["v"] == v, s["run"] + 1).otherwise(F.lit(1))
            reached = run >= self.of(self.needed, v["t"])
            found = F.when(reached, F.array_append(s["found"], F.struct(v["t"].alias("t"), run.alias("run")))).otherwise(s["found"])
            return F.struct(v.cast(kind).alias("v"), run.alias("run"), found.alias("found"))

        runs = F.aggregate(let(wanted, voted), start, step, lambda s: s["found"])
        # The longest run of a template comes last among its own.
        return let(F.sort_array(runs), lambda r: F.filter(r, lambda x, k: F.coalesce(F.get(r, k + 1)["t"] != x["t"], F.lit(True))))

    def matches(self, w: Column, present: Column) -> Column:
        """(label, share) of the templates that stand in a document and whose key phrase it holds."""
        rare = F.array_intersect(F.expr(_texts(self.lexicon)), present)

        def verified(found: Column) -> Column:
            phrase = self.of(self.phrases, found["t"])
            return F.exists(F.sequence(F.lit(1), F.size(w)), lambda i: F.slice(w, i, F.size(phrase)) == phrase)

        named = lambda found: F.struct(
            self.of(self.labels, found["t"]).alias("label"), (found["run"] / self.of(self.size, found["t"])).alias("share")
        )
        own = lambda chosen: F.transform(F.filter(self.covered(w, chosen), verified), named)
        none = F.array().cast("array<struct<label:string,share:double>>")
        return let(self.possible(rare), lambda chosen: F.when(F.size(chosen) > 0, own(chosen)).otherwise(none))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    ``score`` is 1 where a phrase was found and else the best coverage among the labels given, or 0.
    """
    lexicon = sorted({word for t in templates for word in t.words})
    counts, _ = document_counts(docs, lexicon)
    found_by = _Index(templates, counts, coverage)
    looked_up = sorted({*found_by.lexicon, *(word for p, _ in phrases for word in p.split())})

    def base(w: Column, present: Column) -> Column:
        empty = F.array().cast("array<struct<at:bigint,label:string>>")

        def one(phrase: str, label: str) -> Column:
            named = F.transform(_places(w, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
            parts = sorted(set(phrase.split()))
            return F.when(_holds(present, parts, len(parts)), named).otherwise(empty)

        return F.concat(*[one(phrase, label) for phrase, label in phrases])

    def whole(w: Column) -> Column:
        return let(
            F.array_intersect(w, _literal(looked_up)),
            lambda present: F.struct(
                F.size(w).cast("long").alias("n_words"), base(w, present).alias("base"), found_by.matches(w, present).alias("own")
            ),
        )

    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return docs.select(F.col("doc_id"), let(words(F.col("text")), whole).alias("found")).select(
        "doc_id",
        "found.n_words",
        F.size("found.base").cast("long").alias("n_base"),
        F.array_min("found.base.at").alias("first_word"),
        F.array_max("found.base.at").alias("last_word"),
        joined(F.col("found.base.label")).alias("base_labels"),
        joined(F.concat("found.base.label", "found.own.label")).alias("labels"),
        F.when(F.size("found.base") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.own.share"), F.lit(0.0))).alias("score"),
    )
