"""BPE by backtracking, against the library that reads the same vocabulary file."""

import hashlib
import random

import pytest

pytest.importorskip("ahocorasick")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from cardamom.llm import backtrack, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return backtrack.Coder(*queries.json_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def same(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = coder.encode(text)
    assert got.tolist() == ids, text[:100]
    assert coder.decode(got) == library.decode(ids, skip_special_tokens=False).encode()


def test_random_texts(coder, library):
    rnd = random.Random(11)
    for _ in range(400):
        same(coder, library, "".join(rnd.choice("ab aeth  \n'st<|>endof\t 　") for _ in range(rnd.randint(0, 60))))
        same(coder, library, "".join(chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(0, 30))))
        same(coder, library, "".join(rnd.choice("aeioutnshr") for _ in range(rnd.randint(1, 200))))


def test_every_token_and_pairs_of_tokens(coder, library):
    tokens = list(coder._merges.tokens)
    rnd = random.Random(3)
    for t in rnd.sample(tokens, 2000):
        same(coder, library, (t + rnd.choice(tokens)).decode("utf-8", "ignore"))


@pytest.mark.parametrize("text", ["", " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext", "aaaaaaaaaaaaaaaaa", "a" * 5000, "1" * 3001 + "x", " " * 70_000 + "end", "word " * 40_000, "ͅⅠª᧚Ᲊ"])
def test_awkward_texts(coder, library, text):
    same(coder, library, text)


def test_a_megabyte_of_one_word(coder, library):
    rnd = random.Random(5)
    same(coder, library, "".join(rnd.choice("aeioutnshr") for _ in range(1_000_000)))


def test_equal_merges_go_from_the_left():
    tokens = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3, b"aaaa": 4}
    merges = backtrack.Merges(tokens, [(b"a", b"a"), (b"aa", b"b"), (b"aa", b"aa")])
    assert merges.encode(b"aaa") == (2, 0)
    assert merges.encode(b"aaab") == (2, 0, 1)
    assert merges.encode(b"aaaab") == (2, 3)
    assert merges.encode(b"aaaaa") == (4, 0)


def test_vocabularies_it_cannot_read():
    with pytest.raises(ValueError):
        backtrack.Merges({b"a": 0, b"b": 1, b"ab": 2, b"c": 3, b"abc": 4, b"bc": 5}, [(b"ab", b"c"), (b"a", b"b")])
    with pytest.raises(ValueError):
        backtrack.Merges({b"a": 0}, []).encode(b"ab")


def test_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    rows = queries.op12_backtracking_bpe(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "x <|endoftext|>", None)], "doc_id long, text string, ids int")
    rows = backtrack.encode_documents(docs, *queries.json_vocabulary(), keep=["doc_id", "ids"]).collect()
    assert sorted((r["n_tokens"], bytes(r["decoded"])) for r in rows) == [(0, b""), (0, b""), (0, b""), (3, b"x <|endoftext|>")]
    assert backtrack.encode_documents(docs.limit(0), *queries.json_vocabulary()).count() == 0
