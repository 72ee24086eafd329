"""BPE encoding and decoding against the library on whole texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import bpe, queries
from paperloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
MIXED = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "1", "'s", "'", "'r", "re", ".", "<|endoftext|>", "<|end", "of", "text|>", "字", "。", "한", "한", "!!", " the", "\x1c", "\x85", "İ", "ΑΣ", "ﬁ", "　", "😀", "<|startoftext|>", "word"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def listed(ids):
    return np.frombuffer(ids, np.int32).tolist()


def test_joins_are_repaired_wherever_chunks_end(library):
    rng = random.Random(12)
    own = bpe.Encoder(PATH)
    for _ in range(1500):
        t = "".join(rng.choices(MIXED, k=rng.randrange(1, 120)))
        ends = sorted({0, len(t), *(rng.randrange(len(t) + 1) for _ in range(rng.randrange(1, 9)))})
        parts = [t[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        held = {i: bpe.unpacked(*bpe.packed(own.encode(p))) for i, p in enumerate(parts) if rng.random() < 0.6}
        want = library.encode(t, add_special_tokens=False).ids
        assert listed(own.join(t, parts, held)) == listed(own.ids(t)) == want, (t, parts)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_runs_without_a_place_to_part(library):
    own = bpe.Encoder(PATH)
    for t in ("ab" * 3000, "字" * 2000, "." * 3000, "1" * 2000, "a字" * 900 + " end", "é" * 1500):
        parts = [t[k : k + 100] for k in range(0, len(t), 100)]
        assert listed(own.join(t, parts, {i: own.encode(p) for i, p in enumerate(parts)})) == library.encode(t, add_special_tokens=False).ids


def test_frequent_pieces_are_encoded_once_however_many_others_there_are(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    own, learned = bpe.Encoder(PATH), []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            learned.extend(texts)
            return library.encode_batch_fast(texts, **more)

    own.tokenizer = Counting()
    for i in range(60):
        t = f"often x{i} y{i} z{i}"
        assert listed(own.ids(t)) == library.encode(t, add_special_tokens=False).ids
        assert len(own.known) + len(own.older) <= 40
    assert learned.count("often") + learned.count(" often") == 1


def test_chunks_follow_the_content():
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}é" for _ in range(6000)]
    passage = " ".join(words)
    first, second = bpe.chunks("x" * 301 + passage), bpe.chunks("other start " * 77 + passage + " and an end")
    assert b"".join(first).decode() == "x" * 301 + passage
    assert len(set(first) & set(second)) > 0.8 * len(first)
    assert all(len(c) <= bpe.MOST for c in bpe.chunks("é" * 200_000)) and "".join(c.decode() for c in bpe.chunks("é" * 200_000)) == "é" * 200_000
    assert bpe.chunks("") == [b""]


def test_encoding_equals_the_librarys_on_odd_rows(spark, library):
    rng = random.Random(7)
    passages = ["".join(rng.choices(MIXED, k=150)) for _ in range(5)]
    texts = [None, "", " \n", "a", "x " * 4000, "字" * 3000, *passages]
    texts += ["".join(rng.choices(MIXED, k=rng.randrange(40))) + rng.choice(passages) + rng.choice(["", "tail", rng.choice(passages)]) for _ in range(80)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1, "x")] * 2 + [(None, passages[0], None, None)] + [(500 + i, passages[1], 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int, ids string")
    got = bpe.encode(df, PATH, columns={"ids": F.col("ids"), "text": F.col("decoded")}, mean=32, least=16)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    rows_got = got.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows_got) == want
    assert all(r.text == library.decode(r.ids, skip_special_tokens=False) for r in rows_got)
    back = bpe.decode(got.select("ids", "text").withColumnRenamed("text", "want"), PATH).collect()
    assert all(r.decoded == r.want for r in back) and len(back) == len(rows)


def test_empty_tables_and_other_tokenizers(spark):
    empty = bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.columns == ["doc_id", "ids"] and empty.count() == 0
    with pytest.raises(ValueError):
        bpe.Encoder(tokenizer_path())


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = queries.op12_bpe_round_trip(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
