import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verispark.llm import byte_bpe, chat, queries

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def bpe():
    return queries.public_tokenizer()


ODD = [
    None, "", " ", "\n\n \t", "don't we'll 'S ''s", "a" * 5000, "naïve — 東京 😀 1234", "x" + " " * 9000 + "y", " " * 9000,
    "a b\n" * 20000, "it's  fine " * 4000, "\x1c\x85\x00 z", ("w" * 40 + "'") * 2000 + " 's", "<|endoftext|> x",
]


def test_pieces_are_safe(bpe):
    for text in filter(None, ODD):
        assert "".join(p for p, _ in bpe.pieces(text, 50)) == text
        want = bpe.library.encode_ordinary(text)
        got = [i for p, whole in bpe.pieces(text, 50) for i in (bpe.library._encode_single_piece(p) if whole else bpe.library.encode_ordinary(p))]
        assert got == want and bpe.ids(text).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \n\t'.s é😀", max_size=200))
def test_any_cut_is_safe(text):
    bpe = queries.public_tokenizer()
    bpe.__dict__["_library"] = _library(bpe)
    got = [i for p, _ in bpe.pieces(text, 3) for i in bpe.library.encode_ordinary(p)]
    assert got == bpe.library.encode_ordinary(text)


_cache = {}


def _library(bpe):
    return _cache.setdefault("x", bpe.library)


def test_huge_white_run(bpe):
    text = "a" + " " * 1_000_000 + "b" + "\n" * 300_000
    ids = bpe.ids(text)
    assert bpe.library.decode_bytes(ids.tolist()).decode() == text


def test_encode_decode_frames(spark, bpe):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    ids = byte_bpe.encode(df, bpe)
    assert ids.columns == ["doc_id", "ids"]
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(ids, bpe).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert byte_bpe.encode(df.limit(0), bpe).count() == 0


def test_raw_bytes_decode(spark, bpe):
    df = spark.createDataFrame([(0, [250, 101]), (1, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, bpe).collect()}
    assert got == {0: bpe.library.decode_bytes([250, 101]), 1: b""}


def test_op2_equals_library(spark, bpe):
    got = {r.doc_id: r for r in queries.QUERIES["op2_byte_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = bpe.library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(d.text or ""))


def expected_chat(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), sha(turns), len(loss), sha(loss)


def test_op3_equals_brute_force(spark):
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_format"](spark, SF).collect()}
    convs = {-1: [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)]}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(convs)
    for c, rows in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected_chat(rows)
    assert got[-1].valid and got[-1].loss_chars == len(queries.CONTROL_TEXT)


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a<|im_end|>\n<|im_start|>user\n"), (2, 0, None, "x"), (2, 1, "we\\ird\n<|im_end|>", "<\\|b"),
        (3, 0, "assistant", "no question"), (4, 0, "user", "same"), (4, 0, "user", "same"), (None, None, "user", ""), (5, 0, "assistant", "<|im_end|>" * 2000),
        (6, 0, "system", "s"), (6, 1, "user", "u"),
    ]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss boolean")
    segments = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in {r[0] for r in rows}:
        want = expected_chat([(r[2], r[3]) for r in rows if r[0] == c])
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want, c
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: False, 6: False}
    texts = [s.segment for s in segments.collect() if s.part == "text"]
    assert not any("<|" in t for t in texts)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_end>n\n", max_size=40))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
