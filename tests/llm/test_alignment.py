"""Alignment of two tokenizers against the libraries run on whole texts."""

from collections import Counter, defaultdict
from functools import reduce
from hashlib import sha256

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from talkweave.llm import alignment
from talkweave.llm.alignment import Aligner, Fragment, align, align_corpus, ranges

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


@pytest.fixture(scope="module")
def plain():
    """(groups as [(a ids, b ids)]) of a text by plain loops over both libraries' whole output."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    bpe, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    bpe.encode_special_tokens = True
    byte = {}
    for b in range(256):  # a byte alone, by the library's own coding
        shown = Tokenizer.from_file(A).pre_tokenizer.pre_tokenize_str(chr(b))[0][0] if b < 128 else None
        if shown:
            byte[shown] = b
    spare = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    byte |= {chr(b): b for b in range(256) if b not in spare} | {chr(256 + k): b for k, b in enumerate(spare)}

    def groups(text):
        if not text:
            return []
        raw = b" " + text.encode()
        a = bpe.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        a_bytes = [bytes(byte[c] for c in bpe.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return []
        ends = [{}, {}]
        for side, tokens in zip(ends, (a_bytes, b_bytes)):
            at = 0
            for n, t in enumerate(tokens):
                at += len(t)
                side[at] = n + 1
        out, x, y = [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            out.append((tuple(a[x:ends[0][e]]), tuple(b[y:ends[1][e]])))
            x, y = ends[0][e], ends[1][e]
        return out

    assert decoders is not None
    return groups


def rendered(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


TEXTS = ["plain words here", "a", " ", "  two  blanks ", "x\n y\r\n\tz", "Größe naïve 漢字", "<|endoftext|> <s> </s> <0x0A>", "don't  stop", "a　b c", "\x00a b", "Ａ ｂ 𝔘 🤝 é",
         "слово за слово", "a b   c", "1234567 89 $%&/() x_y", "ab ▁ cd", "▁", "trailing \n", "ß" * 40 + " " + "word " * 30]


def test_texts_equal_whole_tokenization(aligner, plain):
    for text in TEXTS:
        want = plain(text)
        got = aligner.whole(aligner.fragment(text))
        assert got.closed.decode() == rendered(want), text
        assert got.same == bool(want)
        assert (got.n_a, got.n_b) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want))
        assert len(got.links) // 4 == len(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é漢\n \t.1▁🤝e", max_size=40), st.integers(1, 12))
def test_ranges_compose_in_any_order(aligner, plain, text, size):
    if not text:
        return
    parts = [aligner.fragment(*r) for r in ranges(text, size)]
    if not plain(text):
        assert not all(p.same for p in parts)
        return
    left = reduce(aligner.compose, parts)
    right = reduce(lambda x, y: aligner.compose(y, x), reversed(parts))
    assert left == right
    assert aligner.whole(left).closed.decode() == rendered(plain(text))
    assert aligner.compose(Fragment(), left) == left == aligner.compose(left, Fragment())


def test_pair_numbers_are_bounded_by_the_vocabularies(aligner):
    v = aligner.vocabularies
    assert len(v.pairs) <= sum(map(len, v.a.values())) + sum(map(len, v.b.values()))
    assert (v.keys()[1:] > v.keys()[:-1]).all()


def expected(docs, plain):
    aligned = [(i, plain(t)) for i, t in docs]
    count = Counter((a[-1], b[-1]) for _, groups in aligned for a, b in groups)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for i, groups in aligned:
        links = [(a[-1], b[-1]) for a, b in groups]
        rows.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links),
                     sum(count[x] for x in links), sha256(rendered(groups).encode()).hexdigest() if groups else ""))
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_odd_rows_equal_plain_python(table, odd_rows, plain, size):
    rows = [*odd_rows, (9, "ab ▁ cd", "a"), (10, "x" * 500, "a"), (11, " ".join(TEXTS[:8]) * 9, None)]
    got = align_corpus(table(rows), A, B, range_bytes=size).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected([(i, t) for i, t, _ in rows], plain)


def test_groups_of_long_texts_stay_whole(table, plain):
    text = " ".join(f"w{i} größe,x{i % 7}\n" for i in range(2000))
    row = align(table([(1, text, "a")]), A, B, range_bytes=512).first()
    assert row.groups.decode() == rendered(plain(text))
    assert row.n_groups == row.groups.count(b";") + 1


def test_empty_table(table):
    assert align_corpus(table([]), A, B).count() == 0


def test_translation_table(llm_spark, table, plain):
    found = align(table([(1, "the cat", "a"), (2, "the", "a")]), A, B)
    got = {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(llm_spark, found, A, B).collect()}
    assert got == Counter((a[-1], b[-1]) for t in ("the cat", "the") for a, b in plain(t))


def test_registered_query_equals_plain_python(llm_spark, plain):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in llm_spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = entry.queries()["op11_token_alignment"](llm_spark, folder).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, plain)
