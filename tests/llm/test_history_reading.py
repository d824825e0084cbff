"""Repeats against a sequential brute force, graphs against exhaustive search, and reading levels on held-out texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleanmark.llm import history, mainbody, reading, shingles, smallworld

CONTENT = "content_id long, batch_no int, canonical_url string, platform string, title string, text string, address string, class long"
MANIFEST = "content_id long, primary_file string, file_path string, sha256 string, body long"
WORDS = "ferry bakery survey editor glass lid price list podcast garden shed harbour office tram line old bridge night market library card water filter".split()


def body(r, n=60):
    return " ".join(r.choice(WORDS) + r.choice(["s", "", "ing", "ed"]) + str(r.randrange(9)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def archive():
    r = random.Random(8)
    rows, files, texts = [], [], []
    for k in range(400):
        batch = 0 if k < 150 else 1 + (k - 150) // 60
        text, address = body(r), f"https://s.example/{k}"
        kind = r.random()
        if texts and kind < 0.15:
            old = r.choice(texts).split(" ")
            at = r.randrange(len(old))
            text = " ".join(old[:at] + ["changed"] + old[at + 1 :])
        elif texts and kind < 0.2:
            text = r.choice(texts)
        elif rows and kind < 0.28:
            address = r.choice(rows)[2].replace("https://", "http://www.") + "/?utm_source=x#top"
        elif kind < 0.31:
            text = "undefined"
        elif kind < 0.34:
            text = None
        texts += [text] if text and len(text) > 40 else []
        rows.append((k, batch, address if kind < 0.97 else None, "s", None, text))
        sha = f"{r.randrange(3000):064x}" if kind < 0.95 else None
        files += [(k, "p.html", "raw/p.html", sha and r.choice([sha, sha.upper(), "sha256:" + sha])), (k, "p.html", "raw/logo.svg", "a" * 64), (k, None, None, None)]
    rows.append((900, 3, None, None, None, None))
    return rows, files


def brute(rows, files):
    words = shingles.Words()
    accepted, out = [], set()
    known = {}
    for k, _, _, sha in [f for f in files if f[2] == "raw/p.html" and f[3]]:
        known.setdefault(k, set()).add(sha.lower()[-64:])
    for k, batch, address, _, _, text in sorted(rows, key=lambda x: (x[1], x[0])):
        if text == "undefined":
            continue
        page = address and address.split("?")[0].split("//")[1].removeprefix("www.").rstrip("/")
        hashed = words.hashes(text or "")
        hit = next((o for o in accepted if (page and o[1] == page) or (known.get(k, set()) & o[2]) or (len(hashed) and len(o[3]) and history.same_wording(hashed, o[3]))), None) if batch else None
        if hit:
            out.add((min(hit[0], k), max(hit[0], k)))
        else:
            accepted.append((k, page, known.get(k, set()), hashed))
    return out


def test_repeats(spark, archive):
    rows, files = archive
    content = spark.createDataFrame([(*x, "clash", 1) for x in rows + rows[:20]], CONTENT)
    manifest = spark.createDataFrame([(*f, 1) for f in files], MANIFEST)
    sites = spark.createDataFrame([("s", ["s.example"])], "site_id string, domains array<string>")
    got = {tuple(x) for x in history.repeats(content, manifest, sites).collect()}
    want = brute(rows, files)
    assert len(want) > 60
    assert len(got ^ want) <= 0.02 * len(want), (got - want, want - got)
    assert history.repeats(content.where("content_id < 0"), manifest.where("content_id < 0"), sites).count() == 0


def test_hot_copies(spark):
    r = random.Random(9)
    same = body(r)
    rows = [(k, 0 if k < 5 else 1, f"https://s.example/{k}", "s", None, same if k % 3 == 0 else body(r), "c", 1) for k in range(300)]
    empty = spark.createDataFrame([], MANIFEST)
    got = history.repeats(spark.createDataFrame(rows, CONTENT), empty, spark.createDataFrame([], "site_id string, domains array<string>")).collect()
    assert {tuple(x) for x in got} == {(0, k) for k in range(6, 300, 3)}


NO_SITES, NO_FILES = "site_id string, domains array<string>", MANIFEST


def added(index, spark, rows, **more):
    content = spark.createDataFrame([(*x, "clash", 1) for x in rows], CONTENT)
    return {tuple(x) for x in index.add(content, spark.createDataFrame([], NO_FILES), spark.createDataFrame([], NO_SITES), **more).collect()}


def test_batches_are_added_without_reading_the_history_again(spark, archive, tmp_path, monkeypatch):
    rows = [x for x in archive[0] if x[1] is not None]
    parsed = []
    bodies = history._bodies

    def watched(pages, model):
        parsed.append({x.content_id for x in pages.select("content_id").collect()})
        return bodies(pages, model)

    monkeypatch.setattr(history, "_bodies", watched)
    monkeypatch.setattr(history, "MOST_SEGMENTS", 3)
    found = set()
    for no in range(6):
        # Each batch is added by a new object, as a new run would.
        index = history.HistoryIndex(spark, str(tmp_path / "index"))
        found |= added(index, spark, [x for x in rows if x[1] == no], all_accepted=no == 0)
        assert len(index.segments) <= 3
        assert parsed[-1] <= {x[0] for x in rows if x[1] == no}
    assert len(parsed) == 6
    want = brute(rows, [])
    assert len(want) > 50 and len({tuple(sorted(p)) for p in found} ^ want) <= 0.02 * len(want)
    # The tables of a segment lie in the folder; a run that failed before its state was written leaves the old state.
    again = history.HistoryIndex(spark, str(tmp_path / "index"))
    assert again.version == 6 and again.segments == index.segments


def test_recall_at_four_fifths_of_the_wording(spark, tmp_path):
    """Pairs with 1 to 20 % of their words changed, at random places, against an exhaustive comparison of words."""
    r = np.random.default_rng(12)
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    share = 1 / np.arange(1, 20_001) ** 0.9
    share /= share.sum()
    old = [r.choice(vocabulary, 200, p=share) for _ in range(300)]
    new, hashed, w = [], [], shingles.Words()
    for k, words in enumerate(old):
        words, changed = words.copy(), int(200 * (0.01 + 0.19 * k / 300))
        at = r.choice(200, changed, replace=False)
        words[at] = [f"new{k}x{j}" for j in range(changed)]
        new.append(words)
    rows = [(k, 0, None, "s", None, " ".join(x) + ".") for k, x in enumerate(old)] + [(1000 + k, 1, None, "s", None, " ".join(x) + ".") for k, x in enumerate(new)]
    hashed = [w.hashes(x[5]) for x in rows]
    want = {(1000 + k, j) for k in range(300) for j in range(300) if history.same_wording(hashed[300 + k], hashed[j])}
    index = history.HistoryIndex(spark, str(tmp_path / "recall"))
    added(index, spark, rows[:300], all_accepted=True)
    got = added(index, spark, rows[300:])
    by_change = [sum((1000 + k, k) in got for k in range(a, a + 100)) / sum((1000 + k, k) in want for k in range(a, a + 100)) for a in (0, 100, 200)]
    print("recall by share of words changed (1-7, 7-14, 14-20 %)", by_change)
    assert len(want) >= 290 and len(got & want) / len(want) >= 0.95 and min(by_change) >= 0.9


def test_hot_keys_lose_no_pair(spark, monkeypatch, tmp_path):
    """Near copies of one page, all by hot keys that are spread over cells and tasks: every one is found."""
    r = random.Random(10)
    old = body(r, 100).split(" ")
    rows = []
    for k in range(160):
        words = list(old)
        for at in r.sample(range(100), 3):
            words[at] = f"other{k}x{at}"
        rows.append((k, 0 if k < 80 else 1, f"https://s.example/{k}", "s", None, " ".join(words)))
    monkeypatch.setattr(history, "HOT_KEY", 15)
    monkeypatch.setattr(history, "SHARD_NODES", 30)
    monkeypatch.setattr(history, "VISITORS", 20)
    index = history.HistoryIndex(spark, str(tmp_path / "hot"))
    added(index, spark, rows[:80], all_accepted=True)
    assert {k for k, _ in added(index, spark, rows[80:])} == set(range(80, 160))
    w = shingles.Words()
    hashed = {x.body: w.hashes(rows[x.content_id][5]) for x in history._bodies(spark.createDataFrame(rows, "content_id long, batch_no int, u string, platform string, title string, text string").select("content_id", "batch_no", "platform", "title", "text"), spark.sparkContext.broadcast(index.model)).collect()}
    new = spark.createDataFrame([(b, len(hashed[b]), bytearray(v), k) for b, (v, k) in ((b, history.routing(h, index.model[1])) for b, h in hashed.items())], "body long, size int, vector binary, keys array<long>")
    stem = next(iter(index.segments))
    pairs = {frozenset(p) for p in index._near(new, {stem: index.segments[stem]}, "none").collect()}
    # All 160 ask among the 80 of the first segment; every word that differs is a rare one, which is the worst case.
    first = {x.body for x in spark.read.parquet(f"{index.folder}/{stem}/nodes").collect()}
    expected = {frozenset((a, b)) for a in hashed for b in first if a != b and history.same_wording(hashed[a], hashed[b])}
    assert len(hashed) == 160 and len(expected) > 5_000 and pairs <= expected and len(pairs) >= 0.9 * len(expected)


def test_common_words_are_counted_over_all_bodies(spark, monkeypatch, tmp_path):
    """Five pages train the model of bodies; which words are common all pages say, in whatever task they lie."""
    r = random.Random(14)
    sampled = mainbody.bounded_sample
    monkeypatch.setattr(mainbody, "bounded_sample", lambda df, key, rows: sampled(df, key, 5))
    monkeypatch.setattr(history, "COMMON", 0.2)
    # The first word is in a third of all pages, all of them neighbours; the second in fewer than a fifth.
    rows = [(k, 0, None, "s", None, body(r, 20)[:-1] + (" alpha" if k < 20 else "") + (" beta" if k % 6 == 0 else "") + ".") for k in range(60)]
    index = history.HistoryIndex(spark, str(tmp_path / "common"))
    added(index, spark, rows, all_accepted=True)
    stored = [np.frombuffer(x.words, np.uint32) for x in spark.read.parquet(f"{index.folder}/{index.texts[0]}").collect()]
    counts = Counter(u for w in stored for u in set(history.units(history.mixed(w)).tolist()))
    assert len(stored) == 60 and index.model[1].tolist() == sorted(u for u, n in counts.items() if n > 12)
    unit = lambda w: history.mixed(history.stored(shingles.Words().hashes(w)))[0]
    assert unit("alpha") in index.model[1] and unit("beta") not in index.model[1]


def test_graphs_find_what_an_exhaustive_search_finds():
    r = np.random.default_rng(4)
    base = r.normal(size=(260, 24))
    x = smallworld.unit(np.concatenate([base, *[base[r.integers(0, 260, 300)] + r.normal(size=(300, 24)) * s for s in (0.1, 0.3, 0.5)]]))
    x = x[r.permutation(len(x))]
    graph = smallworld.Graph(x)
    graph.tune(0.6)
    for g in (graph, smallworld.Graph.unpacked(graph.packed())):
        q, n = g.above(x[:400], 0.6)
        want = set(zip(*map(np.ndarray.tolist, np.nonzero(x[:400] @ g.x.T >= 0.6))))
        found = set(zip(q.tolist(), n.tolist()))
        assert len(want) > 1_500 and len(found & want) / len(want) >= 0.97 and len(found - want) <= 0.002 * len(want)
    assert len(smallworld.Graph(x[:0]).above(x[:3], 0.6)[0]) == 0 and smallworld.Graph(x[:1]).above(x[:1], 0.6)[1].tolist() == [0]


def test_queries_start_in_their_cells():
    r = np.random.default_rng(5)
    x = smallworld.unit(r.normal(size=(900, 48)))
    cells = np.repeat(np.arange(300), 3)
    graph = smallworld.Graph(x, cells, np.arange(900))
    near = smallworld.unit(x[:200] + 0.05 * r.normal(size=(200, 48)))
    q, n = graph.above(near, 0.8, [cells[k : k + 1] for k in range(200)])
    assert set(zip(q.tolist(), n.tolist())) >= {(k, k) for k in range(200)}


def test_beams_have_no_cap():
    x = np.ones((500, 8), dtype=np.float32) / np.sqrt(8)
    graph = smallworld.Graph(x)
    q, n = graph.above(x[:3], 0.9)
    assert all(len(set(n[q == k].tolist())) == 500 for k in range(3))


def test_bodies_are_routed_together_as_each_alone(monkeypatch):
    """Sketches and keys of a body don't depend on those beside it, and numpy takes many bodies in one step."""
    r = random.Random(6)
    w = shingles.Words()
    texts = [" ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n)) for n in (1, 4, 5, 6, 40, 300, 700, 3, 1)] + ["的一是不了人我在有他这" * 30, "山", "山水 river 山", "same " * 400]
    bodies = [history.stored(w.hashes(t)) for t in texts]
    common = np.unique(np.concatenate([history.units(history.mixed(b)) for b in (bodies[3], bodies[8])]))

    def alone(words):
        words = history.mixed(words)
        han = words & np.uint64(1) == 1
        pairs = [int(a) * 0x9E3779B97F4A7C15 % 2**64 ^ int(b) for a, b, x, y in zip(words[:-1], words[1:], han[:-1], han[1:]) if x and y]
        rare = np.array(sorted({*words[~han].tolist(), *pairs} - set(common.tolist())), np.uint64)
        parts = shingles.shingles(words)
        least = np.concatenate([shingles.signature(parts, 14), shingles.signature(rare, 10) if len(rare) else parts[:0]])
        halves = []
        for hashes, weight in ((rare, 0.6), (parts, 0.8)):
            signs = np.array([[1 if byte >> (7 - bit) & 1 else -1 for byte in int(h).to_bytes(8, "little")[:6] for bit in range(8)] for h in hashes]).reshape(-1, 48).sum(axis=0)
            halves.append(weight * signs / (np.sqrt((signs**2).sum()) or 1.0))
        return np.clip(np.round(np.concatenate(halves) * 400), -127, 127).astype(np.int8).tolist(), sorted(set(shingles.bands(least, 2).tolist()))

    want = [alone(b) for b in bodies]
    steps, mixed = [], history.mixed
    monkeypatch.setattr(history, "mixed", lambda x: steps.append(len(x)) or mixed(x))
    vectors, keys = history.routings(np.concatenate(bodies), np.array(list(map(len, bodies))), common)
    assert [(v, sorted(set(k))) for v, k in zip(vectors.tolist(), keys.tolist())] == want
    assert len(steps) == 1 and any(len(k) == 7 for _, k in want) and any(len(k) == 12 for _, k in want)


def test_shards_of_a_task_are_built_and_searched_together(monkeypatch):
    """Pairs are those that each shard finds alone, wherever Arrow batches are cut; shards of one batch share their steps."""
    r = np.random.default_rng(7)
    x = np.clip(np.round(smallworld.unit(r.normal(size=(600, 96))) * 400), -127, 127).astype(np.int8)
    asking = np.clip(x[::3] + r.integers(-20, 21, (200, 96)), -127, 127).astype(np.int8)
    rows = sorted((k % 2, k % 12, k // 2, k, 100, x[k].tobytes()) for k in range(600)) + [(2, 0, 0, 5, 100, x[5].tobytes())]
    members = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names="segment shard cell body size vector".split())
    steps, search = [], smallworld.Joined.search
    monkeypatch.setattr(smallworld.Joined, "search", lambda self, queries, *more: steps.append(len(queries)) or search(self, queries, *more))
    answers = []
    for cut in (10_000, 37):
        steps.clear()
        shards = [s for b in history._built(iter(members.to_batches(max_chunksize=cut))) for s in b.to_pylist()]
        assert [(s["segment"], s["shard"]) for s in shards] == sorted({x[:2] for x in rows})
        together = []
        for s in shards:
            own = {"segment": s["segment"], "shard": s["shard"], "crowd": 0}
            near = [{**own, "body": 1_000 + k, "size": 100, "cell": 3 * k // 2, "vector": asking[k].tobytes()} for k in range(200) if (3 * k % 2, 3 * k % 12) == (s["segment"], s["shard"])]
            together += [{**own, **{c: s[c] for c in ("bodies", "sizes", "graph")}}, *(near or [{**own, "body": 5, "size": 100, "cell": 0, "vector": x[5].tobytes()}])]
        types = {"segment": pa.int32(), "shard": pa.int32(), "crowd": pa.int32(), "body": pa.int64(), "size": pa.int32(), "cell": pa.int64(), "vector": pa.binary(), "bodies": pa.binary(), "sizes": pa.binary(), "graph": pa.binary()}
        table = pa.Table.from_pylist(together, schema=pa.schema(list(types.items())))
        answers.append({(a, b) for part in history._visited(iter(table.to_batches(max_chunksize=cut))) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist())})
        # Building and searching are a step for each width of beam, not for each shard.
        assert cut < 10_000 or len(steps) < len(shards) == 13
    assert answers[0] == answers[1] and {(1_000 + k, 3 * k) for k in range(200)} <= answers[0]
    for s in shards:
        graph = smallworld.Graph.unpacked(s["graph"])
        assert graph.near.min() >= -1 and np.frombuffer(s["bodies"], np.int64).tolist() == sorted(k for a, b, _, k, _, _ in rows if (a, b) == (s["segment"], s["shard"]))


EASY, PLAIN, HARD = "cat dog sun park big runs goes home egg tea".split(), "ferry bakery follows covers checks survey under number market until".split(), "stoichiometric epistemological jurisprudential multicollinearity substantiates presupposes notwithstanding heteroscedasticity irrespective residual".split()


def texts(r, words, n, length=80):
    return [" ".join(r.choice(words + ["the", "of", "and", "a"]) for _ in range(length)) + "." for _ in range(n)]


def test_levels(spark):
    r = random.Random(5)
    graded = [(g, t, "x") for g, w in ((1, EASY), (2, PLAIN), (3, HARD)) for t in texts(r, w[:7], 12)] + [(None, "no grade", "x"), (3, None, "x")]
    # Words that no graded text has are learned from the corpus.
    docs = [(1000 * g + k, t, 2) for g, w in ((1, EASY), (2, PLAIN), (3, HARD)) for k, t in enumerate(texts(r, w, 60))]
    docs += [(4000 + k, a + " " + b[: len(b) // 4], 2) for k, (a, b) in enumerate(zip(texts(r, PLAIN, 30), texts(r, HARD, 30)))]
    docs += [(9000, None, 1), (9001, "", 1), (9002, " \n", 1), (9003, "12 34", 1), (9004, "中文的文章没有级别。" * 30, 1), (9005, "epistemological " * 200_000, 1), docs[-1], docs[0]]
    samples = spark.createDataFrame(graded, "grade int, text string, level string")
    df = spark.createDataFrame(docs, "doc_id long, text string, words int")
    levels = {x.doc_id: x.level for x in reading.reading_levels(df, samples).collect()}
    assert all(levels[k] is None for k in range(9000, 9005))
    right = [abs(levels[1000 * g + k] - g) < 0.5 for g in (1, 2, 3) for k in range(60)]
    assert sum(right) / len(right) > 0.95
    hard = {x.doc_id for x in reading.demanding(df, samples).collect()}
    assert hard == {3000 + k for k in range(60)} | {9005}
    assert reading.demanding(df.where("doc_id < 0"), samples).count() == 0
    assert reading.reading_levels(df, samples.where("grade > 9")).where("level is not null").count() == 0


def test_held_out_samples(spark):
    pd = pytest.importorskip("pandas")
    try:
        graded = pd.read_parquet("/root/testdata/sf0.001/reading_samples.parquet")
    except FileNotFoundError:
        pytest.skip("no test tables")
    held = graded[graded["sample_id"] % 4 == 0]
    samples = spark.createDataFrame(graded[graded["sample_id"] % 4 != 0][["grade", "text", "lang"]])
    docs = spark.createDataFrame(held[["sample_id", "text"]].rename(columns={"sample_id": "doc_id"}))
    levels = {x.doc_id: x.level for x in reading.reading_levels(docs, samples).collect()}
    assert all((levels[i] > 2.5) == (g == 3) for i, g in zip(held["sample_id"], held["grade"]))


def test_signatures():
    w = shingles.Words()
    a, b = w.hashes(" ".join(f"w{k}" for k in range(200))), w.hashes(" ".join(f"w{k}" if k != 77 else "x" for k in range(200)))
    x, y = shingles.signature(shingles.shingles(a), 128), shingles.signature(shingles.shingles(b), 128)
    assert abs((x == y).mean() - 191 / 201) < 0.08
    assert len(shingles.shingles(w.hashes(""))) == 0 and len(shingles.shingles(w.hashes("one two"))) == 1
    assert len(np.unique(shingles.bands(x, 2))) == 64


def test_newton_finds_the_difficulties_of_a_drawn_model():
    r = np.random.default_rng(3)
    a, d = r.normal(0, 1, 200), r.normal(0, 1.5, 200)
    d -= d.mean()
    count, level_sum, mass = np.zeros(200), np.zeros(200), np.zeros(len(reading.GRID))
    for k, t in enumerate(reading.GRID):
        if 0 <= t <= 1:
            p = np.exp(a + d * t)
            n = r.multinomial(40_000, p / p.sum())
            count += n
            level_sum += n * t
            mass[k] = 40_000
    base, found = reading.newton(count, level_sum, mass, np.full(200, -np.inf), np.zeros(200), 30)
    assert np.corrcoef(found, d)[0, 1] > 0.98
    log_z, expected = reading.tabulated(base, found)
    assert (np.diff(expected) > 0).all()
    # A text drawn at a level is given back that level.
    for t in (0.25, 0.75):
        p = np.exp(base + found * t)
        words = r.choice(200, 4_000, p=p / p.sum())
        assert abs(np.interp(found[words].mean(), expected, reading.GRID) - t) < 0.08
