"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of the prefix's encoding.  An automaton
over the vocabulary (a trie with suffix links) reports all tokens that end at a place, longest first; a
token is the prefix's last one if the shorter prefix it leaves has an encoding and that one's last token may
stand before it.  Two tokens may stand side by side if no merge across their border would have come before
one of the merges that made them.  Back-pointers then give the ids.  No merge is ever replayed on the text.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text_bytes import row_chunks, worker_cache

#: Words whose ids a worker keeps at most, and pairs of tokens whose test it keeps; both start anew when full.
WORDS_KEPT, PAIRS_KEPT = 150_000, 150_000
_END = "\u0100"  # follows the last byte of a word; bytes are the characters below it
# The white space that the tokenizer's normaliser folds: Unicode's White_Space property.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")  # str.split() takes these for white space too
# The parts of a vocabulary file that this model follows; anything else in a file is refused.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PIECES = {"behavior": "Removed", "invert": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(d: dict) -> None:
    """Stop on a vocabulary file whose texts are prepared, split or decoded in another way than here."""
    model, splits = d["model"], d["pre_tokenizer"] or {}
    steps = splits.get("pretokenizers", [])
    found = {
        "normalizer": (d["normalizer"] or {}).get("normalizers") == NORMALIZER,
        "pre_tokenizer": len(steps) == 2 and steps[0]["type"] == "Split" and PIECES.items() <= steps[0].items() and "Regex" in steps[0]["pattern"] and steps[1] == BYTES,
        "model": all(model.get(k) == v for k, v in MODEL.items()) and bool(model.get("end_of_word_suffix")),
        "decoder": d["decoder"] is None,
        "added_tokens": not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]),
    }
    if not all(found.values()):
        raise ValueError("this vocabulary file needs another " + ", ".join(k for k, v in found.items() if not v))


@functools.cache
def _library():
    """The library's normaliser, and its letters and numbers, for characters that Python's Unicode does not assign."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    steps = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return steps.normalize_str, *(pre_tokenizers.Split(Regex(c), "isolated") for c in (r"\p{L}", r"\p{N}"))


def unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn"


@functools.lru_cache(1 << 16)
def stand_in(c: str) -> str:
    """A character that the splitting pattern takes as the library takes ``c``.

    Python, ``regex`` and the library know different versions of Unicode.  They agree on characters that the
    oldest, Python's, assigns; the others get the class that the library gives them.
    """
    if not unassigned(c):
        return c
    _, letter, number = _library()
    whole = f"-{c}-"
    return "a" if len(letter.pre_tokenize_str(whole)) > 1 else "0" if len(number.pre_tokenize_str(whole)) > 1 else "\ue000"


def normal(chunk: str, odd: bool) -> str:
    """NFC and lower case, character by character; ``odd`` text holds characters that Python does not assign."""
    if odd:
        return _library()[0](chunk)
    return "".join([c.lower() for c in unicodedata.normalize("NFC", chunk)])


class _Words(dict):
    """Ids by run of characters, computed when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        return self.make(chunk)


class WordBpe:
    """The model of one vocabulary file; ``spec`` is the file's text."""

    def __init__(self, spec: str):
        import ahocorasick

        d = json.loads(spec)
        check(d)
        model = d["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.token = [""] * (1 + max(max(vocab.values()), max(self.special.values(), default=0)))
        for text, i in (vocab | self.special).items():
            self.token[i] = text
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = [p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.split = regex.compile(split[0])
        letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for n, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.parts[made] = (vocab[a], vocab[b])
            self.rank[made] = n
            self.merged[vocab[a], vocab[b]] = made
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self.encode_chunk)
        self.pieces: dict[str, bytes] = {}
        automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            ends = text.endswith(suffix)
            raw = text[: -len(suffix)] if ends else text
            if i in self.parts and not self._stays_apart(*self.parts[i], self.rank[i]):
                continue  # its own bytes are encoded in another way, so it never occurs
            key = "".join(chr(letters[c]) for c in raw) + (_END if ends else "")
            automaton.add_word(key, (i, len(key)))
        automaton.make_automaton()
        self.automaton = automaton

    def _stays_apart(self, a: int, b: int, before: float) -> bool:
        """No merge across the border of ``a`` and ``b`` comes before rank ``before`` or before they are whole."""
        while True:
            m = self.merged.get((a, b))
            if m is not None and self.rank[m] < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # undo the later of the two merges; of equal ones the left came first
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self._stays_apart(a, b, float("inf"))
        return known

    def encode_word(self, word: str) -> bytes:
        """Ids of one piece of the splitting pattern, as 32-bit numbers."""
        key = word.encode("utf-8", "surrogatepass").decode("latin-1") + _END
        n = len(key)
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        known = self.pairs.get
        last[n - 1] = 0  # the last byte belongs to a token with the word's end
        for end, (token, size) in self.automaton.iter(key):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 20 | token)
                if fits is None:
                    fits = self._may_follow(before, token)
                if not fits:
                    continue
            last[end], back[end] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return array("i", out[::-1]).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a run of characters without white space that is not in the store."""
        words = self.words
        plain = chunk.isascii()
        # Unassigned characters are not printable, which is tested at once.
        odd = not plain and not chunk.isprintable() and any(map(unassigned, chunk))
        text = chunk.lower() if plain else normal(chunk, odd)
        if text.isalpha() and (plain or text == chunk):  # one piece
            if text != chunk:
                return words[text]
            found = self.encode_word(text)
            if len(words) >= WORDS_KEPT:
                words.clear()
            if len(text) <= 64:
                words[text] = found
            return found
        out = []
        if odd:
            pieces = [text[m.start() : m.end()] for m in self.split.finditer("".join(map(stand_in, text)))]
        else:
            pieces = self.split.findall(text)
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                out.append(words[piece])
                continue
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.encode_word(piece)
                if len(self.pieces) >= WORDS_KEPT:
                    self.pieces.clear()
                if len(piece) <= 64:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode_plain(self, text: str) -> Iterator[bytes]:
        chunks = [c for c in _SPACE.split(text) if c] if _CONTROL.search(text) else text.split()
        return map(self.words.__getitem__, chunks)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it get their own ids."""
        parts: Iterable[bytes]
        if self.special_re is not None and self.special_re.search(text):
            parts = itertools.chain.from_iterable(
                (array("i", [self.special[p]]).tobytes(),) if p in self.special else self.encode_plain(p) for p in self.special_re.split(text)
            )
        else:
            parts = self.encode_plain(text)
        return np.frombuffer(b"".join(parts), dtype=np.int32)


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file on the driver; a few MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError(f"{path} has {len(spec)} characters; a vocabulary file of under 64 MB is expected")
    return spec


def decode_lists(token: pa.Array, ids: pa.Array) -> pa.Array:
    """Texts of lists of ids: the tokens, joined by one blank (the file names no decoder)."""
    ids = ids if isinstance(ids, pa.ListArray) else ids.combine_chunks()
    flat = token.take(ids.flatten())
    bounds = np.asarray(ids.offsets) - ids.offsets[0].as_py()
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), " ")


def bpe_encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "bpe_ids", decoded: str | None = "bpe_text") -> DataFrame:
    """Add the token ids of ``text`` and, unless ``decoded`` is None, the text decoded from them.

    The file is one of the ``tokenizers`` library with a BPE model with word ends; ids are those of its
    ``encode(text, add_special_tokens=False)``.  A file with another normaliser, pattern or decoder is refused.  Null and empty texts have no ids and decode to an empty
    text.  Rows, also equal ones, are kept one to one with all other columns; columns that have the name
    of a new one are replaced.  A text of any length is encoded whole; a worker holds one text, its ids and
    a bounded store of words.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    new = [ids] + ([decoded] if decoded else [])
    kept = docs.drop(*new) if set(new) & set(docs.columns) else docs
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{ids}` array<int>"] + ([f"`{decoded}` string"] if decoded else [])

    def run(batches):
        bpe = worker_cache(("bpe", vocabulary_path), lambda: WordBpe(spec.value))
        token = pa.array(bpe.token)
        for batch in row_chunks(batches, text, 1 << 22):
            found = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
            columns = [*batch.columns, lists] + ([decode_lists(token, lists)] if decoded else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])
        bpe.words.clear(), bpe.pieces.clear()  # the worker may do other work next

    return kept.mapInArrow(run, ", ".join(fields))
