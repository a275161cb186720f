import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, queries
from plumbline.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    r = random.Random(1)
    texts = ["", "a" * 1001, " \n\n  x<|endoftext|>y <|endoftext|><|endoftext|>  日本語 😀😀", "a՘b ՙ", "'s'll  \t\t x", "\x00\x01\x1c \x85"]
    texts += ["".join(r.choice("aab \n'é中0") for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randrange(0x20, 0x3000), r.randrange(0x1F000, 0x20000)])) for _ in range(50)) for _ in range(200)]
    codec = bpe.Codec(open(PATH, "rb").read())
    held = bpe.WordIds(codec)
    ids, bounds = held.gather(held.words(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids, bounds) == texts


def test_fast_split_is_used_only_where_the_tables_agree(library):
    codec = bpe.Codec(open(PATH, "rb").read())
    for c in range(bpe.SAME_TABLES_BELOW):
        text = f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}."
        assert codec.split.findall(text) == [text[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_query_against_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op1_bpe_round_trip(spark, f"{DATA}/sf0.001").collect()}
    rows = table(spark, f"{DATA}/sf0.001", "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_and_decode(odd, docs, library):
    rows = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit("a clash")), PATH), PATH).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.decoded == (r.text or "")
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.encode(docs((1, "x")).limit(0), PATH).count() == 0
    broken = docs((1, "x")).select(F.array(F.lit(447), F.lit(447)).alias("ids"))
    assert bpe.decode(broken, PATH).first().decoded == library.decode([447, 447], skip_special_tokens=False)
