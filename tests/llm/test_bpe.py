import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from docwarden.llm.bpe import WordBpe, bpe_encode, read_vocabulary
from docwarden.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "",
    None,
    " \n\t ",
    "Hello, world! it's 2024 -- don't",
    "ÉCOLE naïve İstanbul ΣΊΣΥΦΟΣ ẞtraße",
    "é café    x　y   \x1c\x1d z\x85",
    "<|endoftext|>a <|startoftext|> b<|ENDOFTEXT|>",
    "aaaaaaaaaaaaaaaaaaaa aaa aa a" * 3,
    "日本語 テキスト 🙂🙂 🇩🇪 ‍",
    "word " * 3000,
    "x" * 5000,
    "same text",
    "same text",
]


def test_equals_the_library(spark, library):
    rng = random.Random(5)
    letters = "abcdehilnorstu'’.,!?0123éñßüAETZ 	\n"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "old", [1]) for i, t in enumerate(texts)], "doc_id long, text string, bpe_text string, bpe_ids array<int>")
    got = {r["doc_id"]: r for r in bpe_encode(df, vocabulary_path()).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["bpe_ids"] == want, repr(t)
        assert got[i]["bpe_text"] == library.decode(want, skip_special_tokens=False), repr(t)


def test_words_of_the_vocabulary(library):
    """Every token's own text, which holds all merges, is encoded as the library does."""
    bpe = WordBpe(read_vocabulary(vocabulary_path()))
    words = [t.removesuffix("</w>") for t in bpe.token[512:49406:7] if t.isascii()]
    for w in words:
        assert bpe.encode(w).tolist() == library.encode(w, add_special_tokens=False).ids, w


def test_every_code_point(library):
    """One letter before and one after every character, and characters in twos."""
    bpe = WordBpe(read_vocabulary(vocabulary_path()))
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    odd = [c for c in chars if unicodedata.category(c) not in ("Lo", "Co", "Cn")]
    for texts in ([f"a{c}b" for c in chars], [f"{c}{c}1" for c in odd]):
        for at in range(0, len(texts), 65536):
            part = texts[at : at + 65536]
            for t, want in zip(part, library.encode_batch(part, add_special_tokens=False)):
                assert bpe.encode(t).tolist() == want.ids, ascii(t)


def test_no_text_changes_the_ids_of_another(library):
    """Runs with NUL, special tokens and odd blanks, in any order, through one model with its stores."""
    rng = random.Random(8)
    bpe = WordBpe(read_vocabulary(vocabulary_path()))
    letters = ["\0", "<", "1", "a", "b", "'s", "é", "e\u0301", "\u0301", "\u0345", "<|endoftext|>", "<|endoftext|", " ", "\x1c", "\u200b", "\u2028", "\U0001e6c0", "\u1c89", "Σ", "İ", "ǅ", "ﬁ", "١", "²"]
    texts = ["1<", "\0<", "\0\0<", "\x001", "\0a"] + ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(4000)]
    for order in (texts, texts[::-1]):
        for t in order:
            assert bpe.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


@pytest.mark.parametrize("part,value", [("normalizer", None), ("normalizer", {"type": "NFC"}), ("decoder", {"type": "BPEDecoder", "suffix": "</w>"}), ("pre_tokenizer", {"type": "Whitespace"})])
def test_other_files_are_refused(part, value):
    spec = json.loads(read_vocabulary(vocabulary_path()))
    with pytest.raises(ValueError, match=part):
        WordBpe(json.dumps(spec | {part: value}))


def test_empty_table_and_no_decoding(spark):
    df = spark.createDataFrame([], "text string, n int")
    assert bpe_encode(df, vocabulary_path(), decoded=None).columns == ["text", "n", "bpe_ids"]
    assert bpe_encode(df, vocabulary_path()).count() == 0
    one = spark.createDataFrame([("a b", 1)], "text string, n int")
    assert bpe_encode(one, vocabulary_path(), decoded=None).select(F.size("bpe_ids")).collect()[0][0] == 2
