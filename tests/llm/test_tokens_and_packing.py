import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from talkweave.llm import packing, tokens
from talkweave.llm.encoding import Encoder
from talkweave.llm.queries import number_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library(library):
    enc = Encoder(PATH, units=50)
    rng = random.Random(5)
    signs = [*"ab é's \n\t.,!?%12<|>", "  ", " \n", "<|endoftext|>", "'ll", "’", " ", "漢", " word", " Word,"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == library(text), repr(text)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(llm_spark, table, odd_rows, library, encoding):
    path = tempfile.mkdtemp() + "/ids"
    tokens.write_tokens(table(odd_rows), path, PATH, encoding=encoding)
    rows = sorted(((i, t or "") for i, t, _ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*library(t), 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokens.token_digests(llm_spark, path).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    stored = tokens.read_tokens(llm_spark, path, ("doc_id", "source"), (4, 6))
    assert sorted(r.doc_id for r in stored.collect()) == [4, 5, 6, 6] and stored.columns == ["doc_id", "source"]
    few = tokens.read_tokens(llm_spark, path, ("ids",), (5, 5)).collect()
    assert few[0].ids == [*library("one two three four five six seven."), 0]
    assert tokens.token_digests(llm_spark, path).count() == len(rows)


def test_files_have_encodings_and_page_indexes(llm_spark, table):
    path = tempfile.mkdtemp() + "/ids"
    tokens.write_tokens(table([(i, f"text {i}", "s") for i in range(500)]), path, PATH, encoding="delta", page_rows=50)
    import glob

    chunk = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata.row_group(0).column(4)
    assert "DELTA_BINARY_PACKED" in chunk.encodings and chunk.has_offset_index


def test_empty_table(llm_spark, table):
    path = tempfile.mkdtemp() + "/ids"
    tokens.write_tokens(table([]), path, PATH)
    assert tokens.token_digests(llm_spark, path).count() == 0
    assert number_digests(packing.pack_pieces(table([]), PATH)).count() == 0


def brute_cost(positions, penalties, n):
    best = [0] + [None] * (len(positions) - 1)
    for j in range(1, len(positions)):
        options = []
        for i in range(j):
            size = positions[j] - positions[i]
            if best[i] is not None and size <= n:
                options.append(best[i] + (0 if size & (size - 1) == 0 else n - size))
        best[j] = min(options) + penalties[j] if options else None
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        positions = [0]
        for _ in range(rng.randint(1, 60)):
            positions.append(positions[-1] + rng.randint(1, 20))
        penalties = [rng.choice([0, 2, 5]) for _ in positions]
        cuts = packing.best_cuts(positions, penalties, 32)
        assert cuts[-1] == len(positions) - 1
        cost, last = 0, 0
        for c in cuts:
            size = positions[c] - positions[last]
            assert size <= 32
            cost += penalties[c] + (0 if size & (size - 1) == 0 else 32 - size)
            last = c
        assert cost == brute_cost(positions, penalties, 32)


def test_pieces_hold_every_id_once(table, odd_rows, library):
    got = number_digests(packing.pack_pieces(table(odd_rows), PATH, seq_len=256)).collect()
    sequences, documents = {}, {}
    for r in got:
        assert r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert set(sequences) == set(range(len(sequences)))
    total = padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length, padded in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256 and padded == (at if at & (at - 1) == 0 else 256)
        total, padding = total + at, padding + padded - at
    assert padding < 0.03 * total
    texts = {}
    for i, t, _ in odd_rows:
        texts.setdefault((i, len(library(t or "")) + 1), []).append(np.array([*library(t or ""), 0], dtype="<u4"))
    assert set(documents) == set(texts)
    for key, pieces in documents.items():
        copies = len(texts[key])
        assert sum(n for _, n, _ in pieces) == copies * key[1]
        for start, length, crc in pieces:
            assert crc == zlib.crc32(texts[key][0][start:start + length].tobytes())


def test_start_follows_the_file_where_ids_repeat(llm_spark, table, tmp_path):
    rows = [(1, "a rather long text of many words", "a"), (1, "b", "a"), (2, "c", "b"), (None, "null id", None), (None, "a null id", None), (1, "b", "a")]
    path = str(tmp_path / "repeated")
    tokens.write_tokens(table(rows), path, PATH)
    stored = sorted(llm_spark.read.parquet(path).collect(), key=lambda r: (r.part, r.place))
    want, at = [], 0
    for r in stored:
        want.append((r.doc_id, at, len(r.ids)))
        at += len(r.ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in tokens.token_digests(llm_spark, path).collect()), key=lambda r: r[1])
    assert got == want and [r.doc_id for r in stored] == [None, None, 1, 1, 1, 2]


def test_words_with_a_mark_are_looked_up_without_a_split():
    from array import array

    from talkweave.llm import encoding
    from talkweave.llm.queries import TOKENIZER

    enc, calls = encoding.Encoder(TOKENIZER), []
    known = enc.tokenizer
    text = "Zorb, blat; größe. (kept) don't it's, no. 12. é! end"
    assert enc.encode(text) == array("I", known.encode(text, add_special_tokens=False).ids).tobytes()
    enc._words = lambda x: calls.append(x) or b""
    assert enc.encode("first zorb, blat; größe. é!") and calls == ["first"]
