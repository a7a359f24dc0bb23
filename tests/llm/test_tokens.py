"""Token counts, packing and token-id files against the libraries themselves."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farelake.llm import packing, token_counts, token_files
from farelake.llm.chunks import SpacedEncoder, WordEncoder
from farelake.llm.queries import _definition, _vocabulary, QUERIES
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def model():
    with open(_vocabulary("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def library(name, texts, end):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_str(_definition(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, end] for e in encoded]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_equal_the_library(odd_docs, odd_rows, model):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = sorted(((r[0], len((r[1] or "").encode()), len(processor.encode(r[1] or ""))) for r in odd_rows), key=repr)
    assert sorted(map(tuple, token_counts.count_tokens(odd_docs, model).collect()), key=repr) == want


def test_merging_where_order_matters(model):
    merger = token_counts.PieceMerger(model)
    texts = [" " * n + "a" for n in range(40)] + ["a" * n for n in range(30)] + ["aab" * 9, "=" * 70, "\n \n", "▁▁x"]
    assert merger.counts(texts) == [len(x) for x in merger.processor.encode(texts)]


@pytest.mark.parametrize("kind, name", [(SpacedEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name, odd_rows):
    texts = [r[1] or "" for r in odd_rows] + [" a", "a ", "a  ", "  a", "a\n\nb", "a \n b", "\n", "\n\n\na", "a's'll", "１２ ß ﬀ"]
    ids, sizes = kind(_definition(name)).encode(pa.array(texts), 5)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(name, texts, 5)


def test_pieces_are_powers_of_two():
    document, start, length = packing.cut(np.array([1, 4097, 12288, 7]), 4096)
    assert list(zip(document, start, length)) == [
        (0, 0, 1), (1, 0, 4096), (1, 4096, 1), (2, 0, 4096), (2, 4096, 4096), (2, 8192, 4096), (3, 0, 4), (3, 4, 2), (3, 6, 1)
    ]


def test_packing(odd_docs, odd_rows):
    rows = packing.pack(odd_docs, _definition("word_bpe_49k.json"), end=2, longest=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by_number = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_number] == sorted(r.length for r in rows)
    assert all(r.offset == 0 and r.length <= 64 and not r.length & (r.length - 1) and len(r.ids) == 4 * r.length for r in rows)
    want = library("word_bpe_49k.json", [r[1] for r in odd_rows], 2)
    assert sum(r.length for r in rows) == sum(map(len, want))
    ids = {doc: ids for (doc, *_), ids in zip(odd_rows, want)}
    for r in rows:
        if r.doc_id is not None:
            assert r.doc_tokens == len(ids[r.doc_id])
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, _definition("word_bpe_49k.json"), end=2).collect() == []


def test_blocks_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    control, data = token_files.encode_block(values)
    assert len(control) == 3 and token_files.decode_block(control, data, 9).tolist() == values.tolist()
    assert token_files.decode_block(*token_files.encode_block(values[:0]), 0).tolist() == []


def test_token_files(spark, odd_docs, odd_rows, monkeypatch):
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (doc, *_), ids in zip(order, library("byte_bpe_50k.json", [r[1] for r in order], 0)):
        want.append((doc, start, len(ids), digest(ids)))
        start += len(ids)
    folder = token_files.write(odd_docs, _definition("byte_bpe_50k.json"), end=0)
    got = token_files.read(spark, folder, digests=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    whole = token_files.read(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids").collect()
    assert sorted(map(tuple, whole), key=lambda r: r[1]) == want


def test_token_files_of_nothing(spark, no_docs):
    assert token_files.read(spark, token_files.write(no_docs, _definition("byte_bpe_50k.json"), end=0)).collect() == []


def test_document_over_several_blocks(spark):
    text = words(5, 200_000)
    docs = spark.createDataFrame([(2, text), (1, "a"), (3, None)], "doc_id long, text string")
    folder = token_files.write(docs, _definition("byte_bpe_50k.json"), end=0)
    ids = library("byte_bpe_50k.json", ["a", text, ""], 0)
    assert len(ids[1]) > token_files.BLOCK
    got = sorted(map(tuple, token_files.read(spark, folder, digests=True).collect()))
    assert got == [(1, 0, 2, digest(ids[0])), (2, 2, len(ids[1]), digest(ids[1])), (3, 2 + len(ids[1]), 1, digest([0]))]


def test_queries(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(docs)
    ids = dict(zip(order, library("byte_bpe_50k.json", [docs[d] for d in order], 0)))
    start = dict(zip(order, np.cumsum([0, *(len(ids[d]) for d in order)]).tolist()))
    got = sorted(map(tuple, QUERIES["op9_token_files"](spark, sf_dir).collect()))
    assert got == [(d, start[d], len(ids[d]), digest(ids[d])) for d in order]
    ids = dict(zip(order, library("word_bpe_49k.json", [docs[d] for d in order], 2)))
    pieces = QUERIES["op8_packing"](spark, sf_dir).collect()
    assert all(r.ids_crc32 == digest(ids[r.doc_id][r.start : r.start + r.length]) for r in pieces)
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=_vocabulary("piece_bpe_32k.model"))
    for r in QUERIES["op2_token_counts"](spark, sf_dir).collect():
        n = len(processor.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
