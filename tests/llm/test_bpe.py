import hashlib
import random

import pytest
from tokenizers import Tokenizer

from fieldmill.llm import op08_bpe as bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def model():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.encoder(f.read())


def test_equals_library(library, model):
    rng = random.Random(1)
    parts = list("aAbetho  \n\t.,'12é漢😀 \x85​　ſ_-\x1c\x1d²½") + ["the", "<|endoftext|>", "ing", " tion", "'ll", "  ", "\r\n", "aaaa", "=====", "________", "\x00", "٣", "Ⅷ", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "=" * 3000, "ab" * 3000, " " * 3000, "the" * 2000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = model.encode(text)
        assert memoryview(ids).cast("I").tolist() == found.ids
        assert model.decode(ids) == library.decode(found.ids, skip_special_tokens=False)


def merged(word, merges):
    """BPE by definition: the first merge of the lowest rank, again and again."""
    parts = [bytes([b]) for b in word]
    while True:
        ranks = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in merges]
        if not ranks:
            return parts
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_gadgets_equal_merging_on_small_vocabularies():
    rng = random.Random(6)
    for _ in range(60):
        tokens = [b"a", b"b", b"c"]
        merges = []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        automaton = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        for word, ids in zip(words, automaton.encode_all(words), strict=True):
            assert [tokens[i] for i in automaton.encode(word)] == merged(word, merges)
            assert memoryview(ids).cast("I").tolist() == automaton.encode(word)
        assert len(automaton.states) + len(automaton.unread) == len(merges) + 1


def test_whole_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op8_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases(odd_docs, no_docs):
    rows = bpe.encode_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and bpe.encode_documents(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in rows)


def test_vocabulary_without_a_byte():
    with pytest.raises(ValueError):
        bpe.Automaton({b"a": 0}, []).encode(b"ab")
    with pytest.raises(ValueError):
        bpe.Automaton({b"a": 0}, []).encode_all([b"a", b"ab"])


def test_long_words_read_alone_equal_those_read_side_by_side(library, model):
    rng = random.Random(2)
    words = ["".join(rng.choice("ethaoin") for _ in range(n)) for n in (1, 63, 64, 65, 200, 20_000)]
    for word in words:
        ids = library.encode(word, add_special_tokens=False).ids
        assert model.automaton.encode(word.encode()) == ids == memoryview(model.encode(word)).cast("I").tolist()
