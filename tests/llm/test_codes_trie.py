import hashlib
import random
import zlib

import numpy as np
import pytest

from verispark.llm import prefix_trie, queries, vector_codes
from verispark.llm.vector_codes import Settings

SF = "/root/testdata/sf0.001"


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(id, label, vector) rows of one length -> {id: (code, error)} by distances to every entry."""
    kept = sorted(((k is None, k or 0), [int(np.floor(1024 * float(x))) for x in v], at) for at, (k, _, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v))
    x = np.array([v for _, v, _ in kept], np.int64)
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    book = x[:entries].copy()
    for r in range(rounds + 1):
        dist = ((x[:, None] - book[None]) ** 2).sum(-1)  # rows, entries, parts
        best = dist.argmin(1)
        if r < rounds:
            for p in range(parts):
                for e in range(len(book)):
                    mine = x[best[:, p] == e, p]
                    if len(mine):
                        book[e, p] = mine.sum(0) // len(mine)
    error = dist.min(1).sum(1)
    out = [(rows[at][0], rows[at][1], "".join(f"{c:02x}" for c in best[k]), int(error[k])) for k, (*_, at) in enumerate(kept)]
    return out, hashlib.sha256(",".join(str(c) for p in range(parts) for e in range(len(book)) for c in book[e, p]).encode()).hexdigest()


def test_op12_equals_brute_force(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = brute_codes(rows)
    got = queries.QUERIES["op12_vector_codes"](spark, SF).collect()
    labels = {}
    for _, label, _, error in want:
        labels[label] = labels.get(label, 0) + error
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((k, code, error, labels[label]) for k, label, code, error in want)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_vectors(spark, monkeypatch):
    """Lengths that differ, blocks of few rows, ties of ids, nulls and huge components."""
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    six = [(None if k == 5 else k % 40, k % 3 or None, rng.normal(size=6).round(2).tolist()) for k in range(60)]
    odd = [(1, 0, None), (2, 0, [nan, 1.0]), (3, 0, [inf]), (4, 0, [None]), (70, 9, []), (71, 9, []), (72, 8, [1e38, 2.0])]
    schema = "vec_id long, label int, embedding array<double>, code string, row int"
    df = spark.createDataFrame([(*r, "clash", 1) for r in six + odd], schema).repartition(3)
    settings = Settings(n_parts=4, n_entries=9, rounds=3)
    found = vector_codes.compress(df, settings, keep=["label"])
    got = found.codes.collect()
    want, digest = brute_codes(six, entries=9, rounds=3)
    key = lambda r: (r[0] is None, r[0] or 0, repr(r[1:]))
    assert sorted(((r.vec_id, r.label, r.code.hex(), r.error) for r in got if r.n_dims == 6), key=key) == sorted(want, key=key)
    assert vector_codes.codebook_digest(found.codebooks[6]) == digest
    assert [(r.vec_id, r.code, r.error) for r in got if r.n_dims == 0] == [(70, b"\0\0\0\0", 0), (71, b"\0\0\0\0", 0)]
    assert [(r.vec_id, r.error) for r in got if r.n_dims == 2] == [(72, 0)]
    assert len(got) == 63
    errors = {r.label: r.label_error for r in vector_codes.with_label_errors(found.codes).collect()}
    assert errors[None] == sum(r.error for r in got if r.label is None)
    for r in found.decoded().filter("n_dims = 6").collect():
        assert len(r.vector) == 6 and r.error >= 0
    empty = vector_codes.compress(df.limit(0), settings)
    assert empty.codes.count() == 0 and empty.codebooks == {}
    with pytest.raises(ValueError):
        Settings(n_entries=300)


def rebuild(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + convs[c][h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[n] for n in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (saved + sum(s for s, _ in below), sum(n for _, n in below) if below else 1)
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children.get(node, [])), totals[node][1], totals[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    out = {}
    for c, _, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def check(df, want, share):
    got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(df, share).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def random_rows(seed):
    """Conversations that repeat each other's beginnings, some long, some whole copies."""
    rng = random.Random(seed)
    rows, made = [], []
    for c in range(-7, 90):
        length = rng.choice([1, 2, 3, 8, 9, 40, 41])
        base = rng.choice(made)[: rng.randint(0, 40)] if made and rng.random() < 0.7 else []
        turns = base + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])) for _ in range(max(0, length - len(base)))]
        made.append(turns)
        rows += [(c, None if k == 0 and c % 2 else k, r, t, "clash", 1) for k, (r, t) in enumerate(turns)]
    return rows + [(None, 0, "user", "no id", "", 0)]


@pytest.mark.parametrize("leaf, part, share", [(8, 1 << 16, True), (2, 8, True), (2, 8, False), (1, 4, False), (4, 64, True)])
def test_trie_equals_brute_force(spark, monkeypatch, leaf, part, share):
    monkeypatch.setattr(prefix_trie, "LEAF", leaf)
    monkeypatch.setattr(prefix_trie, "PART", part)
    monkeypatch.setattr(prefix_trie, "POPULAR", 3)
    monkeypatch.setattr(prefix_trie, "POPULAR_ROWS", 1000)
    monkeypatch.setattr(prefix_trie, "IDS_BYTES", 50)
    rows = random_rows(leaf + part)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string, n int")
    convs = conversations(rows)
    check(df, brute_trie(rebuild(convs) if share else convs), share)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert prefix_trie.prefix_trie(empty).count() == 0 and prefix_trie.prefix_trie(empty, True).count() == 0
    # repeated turns of one conversation are turns of their own; a text that looks like two turns is one
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "user", "x"), (3, 0, "use", "rx"), (2**63 - 1, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, schema)
    check(df, brute_trie(conversations(rows)), False)
    turnless = spark.createDataFrame([(1, 0, "user", "x"), (4, 0, "user", "y")], schema)
    check(turnless, brute_trie(rebuild(conversations([(1, 0, "user", "x"), (4, 0, "user", "y")]))), True)


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_prefix_trie"](spark, SF).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == sorted(brute_trie(rebuild(conversations(rows))), key=repr)
