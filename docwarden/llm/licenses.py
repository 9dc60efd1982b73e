"""Licence notices in documents: MinHash bands over windows retrieve templates, shingle containment verifies them.

Windows of a document are half as long again as a template and start every quarter of its length, so one of them
holds a whole notice.  Only windows with a shingle of a template of that length are hashed; others contain
nothing of one.  A window and a template are compared exactly if they agree in one of ``bands`` MinHash bands.  For
each length the number of bands follows from the least Jaccard similarity that a window with enough of the
template can have, such that a collision is missed with a chance of at most ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import References, prepare, reference_blocks, seed_hits
from .text_bytes import U64, mix64, row_chunks, runs, seeded, words_of

CONTAINED = 0.8
MISS = 1e-4

# Opening words of well-known public licence notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def window_shape(words: int) -> tuple[int, int]:
    """Words of a window for templates with so many words, and words between the starts of windows."""
    step = max(1, words // 4)
    return words + max(2 * step - 1, math.ceil(words / 2)), step


def bands_for(words: int, width: int, contained: float, miss: float) -> tuple[int, int]:
    """Bands and rows of a band for templates with so many words."""
    shingles, room = words - width + 1, window_shape(words)[0] - width + 1
    least = math.ceil(contained * shingles)
    similarity = least / (room + shingles - least)
    rows = 2 if similarity > 0.5 else 1
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1, rows


def _signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([mix64(shingles ^ s).min() for s in seeded(hashes, 5)], dtype=U64)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> list[tuple]:
    return [(b, *signature[b * rows : (b + 1) * rows].tolist()) for b in range(bands)]


class Templates:
    def __init__(self, refs: References, contained: float, miss: float):
        self.refs, self.contained = refs, contained
        self.sets = [np.unique(s) for s in refs.shingles]
        self.bands: dict[int, tuple[int, int]] = {}
        self.tables: dict[int, dict[tuple, list[int]]] = {}
        for i, w in enumerate(refs.words):
            n = len(w)
            bands, rows = self.bands.setdefault(n, bands_for(n, int(refs.width[i]), contained, miss))
            for key in _band_keys(_signature(self.sets[i], bands * rows), bands, rows):
                self.tables.setdefault(n, {}).setdefault(key, []).append(i)

    def find(self, name: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        """The best window of each template in the words; hits: places and seeds by width of shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        for width, (places, seed) in hits.items():
            _, first, lengths, _ = self.refs.seeds[width]
            n = first[seed + 1] - first[seed]
            place = np.repeat(places, n)
            length = lengths[np.repeat(first[seed], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
            shingles = runs(name, width)
            for words in np.unique(length).tolist():
                size, step = window_shape(words)
                bands, rows = self.bands[words]
                own = place[length == words]
                # Windows start at multiples of the step; the last ones are shorter.
                low = np.maximum(-(-(own - (size - width)) // step), 0)
                starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, own // step)])) * step
                for start in starts.tolist():
                    inside = np.unique(shingles[start : start + size - width + 1])
                    near = {i for key in _band_keys(_signature(inside, bands * rows), bands, rows) for i in self.tables[words].get(key, ())}
                    for i in near:
                        share = len(np.intersect1d(inside, self.sets[i], assume_unique=True)) / len(self.sets[i])
                        if share >= self.contained - 1e-12 and (i not in best or (-share, start) < (-best[i][0], best[i][1])):
                            best[i] = (share, start, min(size, len(name) - start))
        return [{"template": self.refs.ids[i], "containment": s, "start": start, "words": n} for i, (s, start, n) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: DataFrame, template_key: str = "template", template_text: str = "text", text: str = "text", licenses: str = "licenses", contained: float = CONTAINED, miss: float = MISS) -> DataFrame:
    """Add ``licenses``, an entry per template found: ``template, containment, start, words`` of its best window.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; ties between windows go to the
    earliest.  Null and empty texts, of documents or templates, match nothing.  Rows, also repeated ones, are
    kept one to one with all other columns; a column that has the new one's name is replaced.  Nothing is
    shuffled; templates are sent to the tasks in blocks of bounded size.
    """
    spark = docs.sparkSession
    kind = "array<struct<template:string,containment:double,start:int,words:int>>"
    spec = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
    out = docs.drop(licenses)
    columns = list(out.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    found = []
    named = templates.select(F.col(template_key).cast("string").alias("k"), F.col(template_text).alias("t"))
    for n, (ids, texts) in enumerate(reference_blocks(named, "k", "t")):
        shared = spark.sparkContext.broadcast((ids, texts))
        name = f"_licenses{n}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            known = Templates(prepare(*shared.value, plain=True), contained, miss)
            for batch in row_chunks(batches, text):
                w = words_of(batch.column(text), plain=True)
                row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
                by_row: dict[int, dict] = {}
                for width in known.refs.seeds:
                    place, seed = seed_hits(known.refs, w.name, width)
                    inside = row[place] == row[place + width - 1]
                    place, seed = place[inside], seed[inside]
                    for i in np.unique(row[place]):
                        own = row[place] == i
                        by_row.setdefault(int(i), {})[width] = (place[own] - w.first[i], seed[own])
                lists = [known.find(w.name[w.first[i] : w.first[i + 1]], by_row[i]) if i in by_row else [] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, spec)], names=[*batch.schema.names, name])

        out = out.mapInArrow(run, f"{fields}, `{name}` {kind}")
        fields += f", `{name}` {kind}"
        found.append(name)
    return out.select(*(F.col(f"`{c}`") for c in columns), F.concat(*found).alias(licenses))
