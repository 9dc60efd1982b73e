"""Language by rank order: a text's most frequent character n-grams against those of each language.

A profile is the list of the most frequent n-grams (one to three letters) by rank.  The distance of a text
from a language is the sum, over the text's own profile, of the differences of rank; an n-gram that the
language's profile lacks costs the profile's length.  The nearest language wins.

N-grams are taken from words, which are runs of letters, with a blank before and after; letters are lower-cased.
Everything else is a border between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_bytes import row_chunks, worker_cache

#: N-grams of a profile, and the most languages that may be learned (their profiles are broadcast).
PROFILE = 400
MAX_LANGUAGES = 5_000
#: Characters handled at once; a run of letters longer than this counts as several words.
WINDOW = 1 << 18
UNKNOWN = "und"
_BLANK = 32


def _letters() -> np.ndarray:
    """Per code point: its lower-case form if it is a letter, else a blank."""
    out = np.full(0x110000, _BLANK, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def text_grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers (21 bits a letter, exact), in no special order.

    A long text goes window by window; the last two characters of one go along to the next, so no n-gram is cut.
    """
    table = worker_cache("language_letters", _letters)
    found = []
    before = np.array([_BLANK], dtype=np.int64)
    for at in range(0, len(text), WINDOW):
        raw = table[np.frombuffer(text[at : at + WINDOW].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
        line = np.concatenate([before, raw, [_BLANK] if at + WINDOW >= len(text) else []]).astype(np.int64)
        old = len(before)
        # Of several blanks one stays.
        keep = line != _BLANK
        keep[1:] |= keep[:-1]
        keep[:old] = True
        line = line[keep]
        letter = line != _BLANK
        two = (line[:-1] << 21) | line[1:]
        three = (two[:-1] << 21) | line[2:]
        found += [line[old:][letter[old:]], two[old - 1 :], three[max(old - 2, 0) :][letter[1:-1][max(old - 2, 0) :]]]
        before = line[-2:]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams, return_counts=True)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n``: how often each n-gram occurs in each language's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of a task, kept sorted per language and handed on when they are many.
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(key):
            grams, n = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

        for batch in row_chunks(batches, "_text"):
            by: dict[str, list[np.ndarray]] = {}
            for key, t in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                by.setdefault(key, []).append(text_grams(t))
            for key, parts in by.items():
                grams, n = _counted(np.concatenate(parts))
                if key in held:
                    old, m = held[key]
                    both, where = np.unique(np.concatenate([old, grams]), return_inverse=True)
                    grams, n = both, np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                held[key] = grams, n.astype(np.int64)
                if len(grams) > 500_000:
                    yield rows(key)
            while len(held) > 1000:
                yield rows(next(iter(held)))
        for key in list(held):
            yield rows(key)

    known = docs.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = known.mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` (from 0): the most frequent n-grams of each language; ties go by the n-gram's number.

    Rows without a language or a text teach nothing; a language whose texts have no letters gets no profile.
    """
    counts = gram_counts(docs, text, lang).withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(16)))
    order = [F.desc("n"), F.asc("gram")]
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= size)
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= size)
    return ranked.select("lang", "gram", (F.col("_r") - 1).cast("int").alias("rank"))


def identify_language(docs: DataFrame, profiles: DataFrame, text: str = "text", prediction: str = "lang_pred", score: str = "score", size: int = PROFILE) -> DataFrame:
    """Add the nearest language of ``text`` and a score from 0 (nothing in common) to 1 (same ranks).

    Null texts and texts without letters are ``und`` with score 0, and so is all text if there are no profiles.
    Equal distances go to the language that sorts first.  Rows, also repeated ones, are kept one to one with
    all other columns; columns that have the name of a new one are replaced.
    """
    rows = profiles.limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
    ranks = np.full((len(langs), len(grams) + 1), -1, dtype=np.int32)
    place = {x: i for i, x in enumerate(langs)}
    if rows:
        at = np.searchsorted(grams, [r["gram"] for r in rows])
        ranks[[place[r["lang"]] for r in rows], at] = [r["rank"] for r in rows]
    model = docs.sparkSession.sparkContext.broadcast((langs, grams, ranks))
    kept = docs.drop(prediction, score)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{prediction}` string", f"`{score}` double"]

    def nearest(t: str | None) -> tuple[str, float]:
        langs, grams, ranks = model.value
        own = text_grams(t) if t else ()
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        found, n = _counted(own)
        top = found[np.argsort(-n, kind="stable")[:size]]
        at = np.searchsorted(grams, top)
        at[at == len(grams)] = len(grams) - 1
        at[grams[at] != top] = len(grams)  # a column of -1
        theirs = ranks[:, at]
        away = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))
        return langs[best], float(1 - away[best] / (size * len(top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, text, 1 << 22):
            found = [nearest(t) for t in batch.column(text).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, prediction, score])

    return kept.mapInArrow(run, ", ".join(fields))
