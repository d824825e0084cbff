"""Token ids against direct encoding, and containers against their invariants."""

import math
import random

import pytest

from gleanmark.llm import packing, tokens

pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string, source string, ids string, _row int"


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe.load()


def test_joins_are_exact(bpe):
    r = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "1", "22", ".", "!!", "é", "中", "文", "́", "😀", "’", "abc" * 30, "\t", " "]
    for _ in range(1500):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(2, 60)))
        cuts = sorted({0, len(s)} | {r.randrange(len(s)) for _ in range(r.randint(1, 5))})
        assert bpe.tree([(s[i:j], bpe.encode(s[i:j])) for i, j in zip(cuts, cuts[1:])]) == bpe.enc.encode_ordinary(s), repr(s)


@pytest.mark.parametrize("run", ["abcdetoinsrhABC", "a", "中文字节", "0123456789", "=-/", " \n"])
def test_unsplit_runs(bpe, run):
    r = random.Random(2)
    for n in (600, 3000, 9000):
        s = "".join(r.choice(run) for _ in range(n))
        assert bpe.encode(s) == bpe.enc.encode_ordinary(s)


def test_second_library_agrees(bpe):
    from pathlib import Path

    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(Path(tokens.TOKENIZERS, "byte_bpe_50k.json")))
    other.encode_special_tokens = True
    for s in ["", " ", "<|endoftext|>", "It's 12,5 €\r\n\r\nnext", "emoji 👍🏽 é"]:
        assert bpe.encode(s) == other.encode(s, add_special_tokens=False).ids


def test_corpus_with_dirty_and_long_texts(spark, bpe):
    r = random.Random(3)
    long = " ".join(r.choice(["alpha", "beta’s", "12", "中文", "x" * 700]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "short text"), (4, "short text"), (5, long), (5, long), (6, "q" * 30_000), (None, "no id")]
    df = spark.createDataFrame([(i, t, None, "clash", 0) for i, t in rows], DOCS)
    got = tokens.encode_corpus(df, long_chars=5_000, chunk_chars=1_777).collect()
    assert len(got) == len(rows)
    want = {i: bpe.enc.encode_ordinary(t or "") for i, t in rows}
    assert all(list(g.ids) == want[g.doc_id] for g in got)
    assert tokens.encode_corpus(df.where("doc_id > 100")).count() == 0


def packed(spark, docs, capacities, **more):
    limits = spark.createDataFrame([(k, c) for k, c in enumerate(capacities)], "limit_id int, capacity int")
    return packing.pack(spark.createDataFrame([(*d, "clash", 0) for d in docs], DOCS), limits, **more).collect()


def test_containers(spark, bpe):
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "12"]) for _ in range(r.randint(0, 90))), r.choice("abc")) for k in range(900)] + [(1000, None, None), (1001, "", "a"), (1002, "word " * 700, "b")]
    sizes = {k: len(bpe.encode(t)) for k, t, _ in docs}
    for items in (100, 100_000):
        rows = packed(spark, docs, [64, 256], shard_items=items)
        for limit, capacity in ((0, 64), (1, 256)):
            own = [x for x in rows if x.limit_id == limit]
            fill, parts = {}, {}
            for x in own:
                fill[x.container_id] = fill.get(x.container_id, 0) + x.n_tokens
                parts.setdefault(x.doc_id, []).append((x.piece_no, x.first_token, x.n_tokens))
            assert max(fill.values()) <= capacity
            assert {k: sum(n for *_, n in v) for k, v in parts.items()} == sizes
            assert all(len(v) == 1 for k, v in parts.items() if sizes[k] <= capacity)
            assert all([a for _, a, _ in sorted(v)] == [k * capacity for k in range(len(v))] for v in parts.values())
            assert sum(sizes.values()) / (capacity * len(fill)) > 0.97


def test_copies_are_spread_and_hot_ones_still_fit(spark):
    one = [(k, "the same text here", "s") for k in range(300)] + [(1000 + k, f"other text number {k}", f"t{k % 7}") for k in range(600)]
    rows = packed(spark, one, [60])
    per = {}
    for x in rows:
        if x.doc_id < 1000:
            per[x.container_id] = per.get(x.container_id, 0) + 1
    containers = {x.container_id for x in rows}
    size = next(x.n_tokens for x in rows if x.doc_id == 0)
    assert max(per.values()) <= max(1, -(-2 * 60 * 300 * size // sum(x.n_tokens for x in rows)) // size)
    assert sum(x.n_tokens for x in rows) / (60 * len(containers)) > 0.95


def test_edges_of_packing(spark):
    assert packed(spark, [], [10]) == []
    assert packed(spark, [(1, "x", "s")], []) == []
    assert len(packed(spark, [(1, "x", "s"), (1, "x", "s")], [10])) == 2
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit([11], ["s"], [None], 10)
    assert sorted(packing.best_fit([5, 5, 5], ["a", "a", "a"], ["c", "c", None], 10)) in ([0, 0, 1], [0, 1, 1])


def test_large_items_stay_bounded_and_keep_their_conflicts(spark, monkeypatch):
    """Items above half the capacity close no bin: no task may gather them, and no container exceeds a quota."""
    seen = []
    best_fit = packing.best_fit

    def counting(sizes, sources, clusters, capacity, slack=packing.SLACK):
        where = best_fit(sizes, sources, clusters, capacity, slack)
        seen.append(len(sizes))
        return where

    monkeypatch.setattr(packing, "best_fit", counting)
    pdf = __import__("pandas").DataFrame({"limit_id": 0, "capacity": 256, "container_id": "", "doc_id": range(50), "copy_no": 1, "piece_no": 0, "first_token": 0, "n_tokens": [130 + k for k in range(50)], "source": "s", "cluster": None, "shard": 0, "is_open": True})
    assert packing._shard_packer(0)(pdf)["container_id"].nunique() == 50 and seen == [50]
    docs = [(k, "word " * (40 + k % 20) + str(k), "s" if k % 3 else f"t{k}") for k in range(4_000)]
    rows = packed(spark, docs, [64], shard_items=100)
    assert len(rows) == len({(x.doc_id, x.piece_no) for x in rows}) and {x.doc_id for x in rows} == {d[0] for d in docs}
    # About 40 shards of 100 items: an id names level and shard, so the items of each shard can be counted.
    shards = {}
    for x in rows:
        name = x.container_id.rsplit("-", 1)[0]
        shards[name] = shards.get(name, 0) + 1
    assert len(shards) >= 30 and max(shards.values()) <= 200
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packed(spark, docs, [64], shard_items=100)))


def test_no_container_exceeds_a_quota():
    r = random.Random(9)
    sizes = [r.randint(1, 40) for _ in range(3_000)]
    sources = ["hot" if k % 3 else f"s{k % 11}" for k in range(3_000)]
    clusters = [7 if k % 3 == 1 else None for k in range(3_000)]
    where = packing.best_fit(sizes, sources, clusters, 100)
    per, fill, own = {}, {}, {}
    for b, s, so, c in zip(where, sizes, sources, clusters):
        fill[b] = fill.get(b, 0) + s
        for x in (so, c):
            per[b, x], own[x] = per.get((b, x), 0) + s, own.get(x, 0) + s
    assert max(fill.values()) <= 100
    for x in {*sources, 7}:
        assert max(n for (_, y), n in per.items() if y == x) <= max(40, math.ceil(2.0 * 100 * own[x] / sum(sizes)))
    assert sum(sizes) / (100 * len(fill)) > 0.97
