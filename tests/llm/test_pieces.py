import hashlib
import random

import pytest

from lodestone.llm.pieces import SegmentTable, encode_documents, encode_text, model_path, piece_model

sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_file=model_path())


def same(library, text):
    ids, decoded = encode_text(SegmentTable(piece_model(model_path())), text)
    want = library.encode(text)
    assert ids == ",".join(map(str, want)), repr(text)
    assert decoded == library.decode(want), repr(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "   x", "a  b", "a\nb", "▁a", "\x00", "a▁▁▁b", " " * 40, "x" + " " * 37 + "y  1", "<s> </s> <0x41> <unk>", "zzzzzzzzzzz", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語 😀😀 \U0010ffff", "é �", "don't  stop\t\tnow\r\n", "0000000 1000000"])
def test_edges(library, text):
    same(library, text)


def test_random(library):
    rng = random.Random(5)
    pools = ["ab ", "the tion ing\n", "éèçñß üö", "0123456789., ", "({[;:\"'`]})=+-*/\\ \n\t", "".join(map(chr, range(32, 1200))), "aA bB 汉字かな😀"]
    for _ in range(3000):
        pool = rng.choice(pools)
        same(library, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60))))


def test_tokens_glued(library):
    rng = random.Random(7)
    n = library.get_piece_size()
    for _ in range(3000):
        same(library, "".join(library.id_to_piece(rng.randrange(259, n)) for _ in range(rng.randint(1, 6))).replace("▁", " "))


def test_query(spark, library):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "w " * 50_000, "x")], "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, model_path()).collect()
    assert len(got) == 5
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in got:
        text = {1: "", 2: "", 3: "one two", None: "w " * 50_000}[row.doc_id]
        ids = library.encode(text)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    full = encode_documents(docs.where("doc_id = 3").limit(1), model_path(), digests=False).first()
    assert full.ids == library.encode("one two") and full.decoded == "one two"
    assert encode_documents(docs.limit(0), model_path()).count() == 0
