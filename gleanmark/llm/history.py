"""New batches against all that was accepted before.

A record repeats an earlier one by its page address, by the hash of its page source or by its main body. The archive is a
set of tables in a folder that grows by one segment per batch: the distinct bodies (words, sketch, routing keys), the
directory of routing keys, the graph shards, and the earliest accepted record of every address, source and body. A batch
is parsed once, when it comes; the text of what was accepted before is never read again.

Near bodies are found by graph index shards. A body has a few routing keys: its least hashes among the words that few
pages have, and among its shingles of five words. The bodies of a segment that share keys lie in the same shards of a
bounded number of nodes, each a navigable small-world graph over signed sketches. A new body visits the shards of every
segment that its keys lead to, starts at the nodes of its keys, and searches with a beam that was widened when the shard was
built until it matched an exhaustive search. What it finds is reranked exactly on the words of both bodies. When there are
more than ``MOST_SEGMENTS`` segments, the smaller ones are compacted into one from their stored sketches.

Which records of a batch are accepted depends on earlier ones of the same batch: records that repeat nothing older are
decided in rounds, of which each reads only what the last one left open.
"""

from __future__ import annotations

import itertools
import math
import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmark.functions.url import with_page_address
from gleanmark.llm.mainbody import train
from gleanmark.llm.residue import residue
from gleanmark.llm.shingles import WIDTH, Words, bands, runs, signatures
from gleanmark.llm.smallworld import Graph, Joined, unit
from gleanmark.session import shared_folder, staged

#: Share of the words of both bodies that makes a repeat.
WORDING = 0.8
#: Routing keys by rare words and by shingles, and the least hashes that each is made of. Bodies with each fifth word changed
#: share two thirds of their rare words, and so a key with probability 0.94; those with 0.6 of their shingles in common share
#: one with 0.96 by these alone. Unrelated bodies share one by chance with about the square of the few shingles they share.
RARE_KEYS, SHINGLE_KEYS, KEY_ROWS = 5, 7, 2
#: Words that more of all bodies of the first batch than this share have aren't rare.
COMMON = 0.005
#: Weights of the halves of a sketch (rare words; shingles), and the cosine from which a pair is reranked: unrelated bodies
#: have 0 with a deviation of 0.1, those with each fifth word changed 0.5, and 0.38 if a tenth changed and all of it is rare.
WEIGHTS, FLOOR = (0.6, 0.8), 0.3
#: Dimensions of each half.
DIMENSIONS = 48
#: Cosine from which a pair without a key in common is reranked as well, and down to which beams match an exhaustive search;
#: nodes below it are met from those of the same key, where a search starts.
FAR_FLOOR = 0.45
#: Nodes of a shard, and bodies of one key from which they are spread over cells of so many.
SHARD_NODES, HOT_KEY = 600, 600
#: Bodies that visit a shard in one task.
VISITORS = 4_000
MOST_SEGMENTS = 4
#: Bodies whose words numpy takes at once.
AT_ONCE = 250
#: Memberships of a task, which takes many shards one after the other.
TASK_NODES = 40_000
MOST_PARTITIONS = 20_000


#: The eight bits of a byte, most significant first, as eight bytes.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _sums(parts: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of the hashes of each set have each of the first ``DIMENSIONS`` bits."""
    # As many bytes are added in one word as can't overflow.
    runs = -(-sizes // 255)
    at = np.repeat(first - 255 * (np.cumsum(runs) - runs), runs) + 255 * np.arange(runs.sum())
    bits = _BITS[parts.view(np.uint8).reshape(-1, 8)[:, : DIMENSIONS // 8]]
    counts = np.add.reduceat(bits, at, axis=0).view(np.uint8)
    return np.add.reduceat(counts, np.cumsum(runs) - runs, axis=0, dtype=np.int64)


def sketches(*halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Signed sums of the hashes of each set, scaled to its weight, as bytes: inner products estimate shared elements.

    The sets of a half lie one after the other; its second array has their sizes.
    """
    out = []
    for (parts, sizes), weight in zip(halves, WEIGHTS):
        total, some = np.zeros((len(sizes), DIMENSIONS)), sizes > 0
        if some.any():
            total[some] = 2.0 * _sums(parts, (np.cumsum(sizes) - sizes)[some], sizes[some]) - sizes[some, None]
        norm = np.sqrt((total**2).sum(axis=1, keepdims=True))
        out.append(weight * total / np.where(norm > 0, norm, 1.0))
    return np.clip(np.round(np.concatenate(out, axis=1) * 400), -127, 127).astype(np.int8)


def _distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each set, sorted, and their numbers; ``values`` holds the sets one after the other."""
    stop = np.cumsum(sizes)
    for a, b in zip((stop - sizes).tolist(), stop.tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[(stop - sizes)[sizes > 0]] = True
    return values[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], stop])])


def _kept(keep: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each set are kept."""
    return np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])])


def units_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the words of each body that may be rare, and their numbers; two neighbours stand for Han
    characters, which are few."""
    han = words & np.uint64(1) == 1
    if not han.any():
        return _distinct(words.copy(), sizes)
    pairs, follows = words.copy(), np.zeros(len(words), bool)
    pairs[:-1] = (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]
    follows[:-1] = han[1:]
    follows[np.cumsum(sizes)[sizes > 0] - 1] = False
    keep = ~han | follows
    return _distinct(np.where(han, pairs, words)[keep], _kept(keep, sizes))


def units(words: np.ndarray) -> np.ndarray:
    """The units of one body."""
    return units_of(words, np.array([len(words)]))[0]


def stored(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash as a body is stored: the last one says whether it is a Han character."""
    return ((words >> np.uint64(33) << np.uint64(1)) | (words & np.uint64(1))).astype(np.uint32)


def mixed(words: np.ndarray) -> np.ndarray:
    """64 bits from the 32 of each stored word, spread over all bits; the last one is kept."""
    wide = words.astype(np.uint64)
    spread = (wide >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    spread *= np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(29)
    return (spread & ~np.uint64(1)) | (wide & np.uint64(1))


def routings(words: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and routing keys (one row a body) of bodies, from the hashes of their words as stored, those of one body after
    the other, and the common units (sorted). A body without rare words repeats a key of its shingles instead."""
    words = mixed(words)
    rare, rare_sizes = units_of(words, sizes)
    if len(common):
        keep = common[np.minimum(np.searchsorted(common, rare), len(common) - 1)] != rare
        rare, rare_sizes = rare[keep], _kept(keep, rare_sizes)
    # A body that is shorter than a shingle is one.
    stop, n = np.cumsum(sizes), np.maximum(sizes - WIDTH + 1, 1)
    every = runs(words) if len(words) >= WIDTH else words
    parts = every[np.minimum(np.repeat(stop - sizes - (np.cumsum(n) - n), n) + np.arange(n.sum()), len(every) - 1)]
    for k in np.flatnonzero(sizes < WIDTH).tolist():
        parts[n[:k].sum()] = runs(words[stop[k] - sizes[k] : stop[k]])[0]
    parts, part_sizes = _distinct(parts, n)
    own = signatures(parts, part_sizes, SHINGLE_KEYS * KEY_ROWS)
    keys = bands(own, KEY_ROWS)
    out = np.concatenate([keys, np.repeat(keys[:1], RARE_KEYS, axis=0)])
    some = rare_sizes > 0
    if some.any():
        least = np.concatenate([own[:, some], signatures(rare, rare_sizes[some], RARE_KEYS * KEY_ROWS)])
        out[:, some] = bands(least, KEY_ROWS)
    return sketches((rare, rare_sizes), (parts, part_sizes)), out.T


def routing(words: np.ndarray, common: np.ndarray) -> tuple[bytes, list[int]]:
    """Sketch and routing keys of one body, from the hashes of its words, whole or as stored, and the common units (sorted)."""
    vectors, keys = routings(words if words.dtype == np.uint32 else stored(words), np.array([len(words)]), common)
    return vectors[0].tobytes(), np.unique(keys[0]).tolist()


def same_wording(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two bodies, as hashes of their words, share enough of the wording of both."""
    most = max(len(a), len(b))
    if not most or min(len(a), len(b)) < WORDING * most:
        return False
    words, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    in_a = np.bincount(np.searchsorted(words, a), minlength=len(words))
    return bool(np.minimum(in_a, counts - in_a).sum() >= WORDING * most)


def _bodies(pages: DataFrame, model) -> DataFrame:
    """``content_id, batch_no, body, size, words``: class, number of words and words (32 bits of the hash of each) of each body
    with words."""
    kind = dict(pages.dtypes)["content_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, body = Words(), model.value[0]
        for batch in batches:
            ids, nos, platforms, titles, texts = (batch.column(k).to_pylist() for k in range(5))
            for at in range(0, len(ids), 1_000):
                part, out = slice(at, at + 1_000), [[], [], [], [], []]
                for key, no, lines in zip(ids[part], nos[part], body.bodies(texts[part], platforms[part], titles[part])):
                    words = cache.hashes("\n".join(lines))
                    if not len(words):
                        continue
                    row = (key, no, int.from_bytes(xxhash.xxh3_64_digest(words.tobytes()), "big", signed=True), len(words), stored(words).tobytes())
                    for column, x in zip(out, row):
                        column.append(x)
                kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["content_id", "batch_no", "body", "size", "words"])

    return pages.mapInArrow(run, f"content_id {kind}, batch_no int, body long, size int, words binary")


def _words_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some bodies of a batch at a time: their rows, words one after the other, and numbers of words."""
    for a in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(a, AT_ONCE)
        words = part.column(column).to_pylist()
        yield part, np.frombuffer(b"".join(words), np.uint32), np.array(list(map(len, words)), np.int64) // 4


def _routed(bodies: DataFrame, common: np.ndarray) -> DataFrame:
    """``body, batch_no, size, vector, keys`` of ``body, batch_no, size, words``."""
    shared = bodies.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _words_of(batch, 3):
                vectors, keys = routings(words, sizes, shared.value)
                columns = [*part.columns[:3], pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([sorted(set(k)) for k in keys.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["body", "batch_no", "size", "vector", "keys"])

    return bodies.select("body", "batch_no", "size", "words").mapInArrow(run, "body long, batch_no int, size int, vector binary, keys array<long>")


def common_units(bodies: DataFrame) -> np.ndarray:
    """Sorted hashes of the units that more than ``COMMON`` of all bodies have, exactly.

    A unit that is common over all bodies is common in those of at least one task. Each task names such units, and only they
    are counted over all bodies.
    """
    context = bodies.sparkSession.sparkContext
    words = bodies.select("words")

    def counts(batch: pa.RecordBatch, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        own = [units_of(mixed(words), sizes)[0] for _, words, sizes in _words_of(batch, 0)]
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        if known is not None:
            every = every[known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every]
        return np.unique(every, return_counts=True)

    def table(values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["unit", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            more, times = counts(batch)
            values, at = np.unique(np.concatenate([values, more]), return_inverse=True)
            n, total = np.bincount(at, np.concatenate([n, times]), len(values)).astype(np.int64), total + batch.num_rows
        yield table(values[n > COMMON * total], n[n > COMMON * total])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table(*counts(batch, shared.value))

    candidates = np.array([r.unit for r in words.mapInArrow(named, "unit long, n long").select("unit").distinct().collect()], np.int64).view(np.uint64)
    if not len(candidates):
        return candidates
    shared = context.broadcast(np.sort(candidates))
    least = max(2, COMMON * bodies.count())
    found = words.mapInArrow(counted, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    return np.sort(np.array([r.unit for r in found], np.int64).view(np.uint64))


def _whole(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that come sorted by their first ``by`` columns, whole groups of them at a time, and the bounds of these groups."""
    held: list[pa.RecordBatch] = []
    last = None

    def grouped() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.concat_batches(held)
        keys = np.column_stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(by)])
        return rows, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(by)])
        new = np.flatnonzero((keys != np.concatenate([keys[:1] if last is None else last[None], keys[:-1]])).any(axis=1))
        last = keys[-1]
        if len(new):
            # The last group may go on in the next batch.
            held.append(batch.slice(0, int(new[-1])))
            yield grouped()
            held.clear()
            batch = batch.slice(int(new[-1]))
        held.append(batch)
    if held:
        yield grouped()


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1)


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards from their memberships (``segment, shard, cell, body, size, vector``, sorted by shard): each body is one node,
    whatever keys it has there."""
    for rows, bounds in _whole(batches, 2):
        segment, shard, cell, body, size = (rows.column(k).to_numpy() for k in range(5))
        vectors, out, graphs = unit(_vectors(rows.column(5))), [[], [], [], []], []
        for a, b in itertools.pairwise(bounds.tolist()):
            nodes, first, at = np.unique(body[a:b], return_index=True, return_inverse=True)
            graphs.append(Graph(vectors[a:b][first], cell[a:b], at))
            for column, x in zip(out, (segment[a], shard[a], nodes.tobytes(), size[a:b][first].astype(np.int32).tobytes())):
                column.append(x)
        Joined(graphs).tune(FAR_FLOOR)
        columns = [pa.array(c, t) for c, t in zip([*out, [g.packed() for g in graphs]], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "shard", "bodies", "sizes", "graph"])


def _visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``body_a, body_b``: the nodes of each shard that its visitors find, of a size that may have enough of the wording of both.

    Rows are sorted by ``segment, shard, crowd``; a shard (``bodies, sizes, graph``) comes before its visitors (``body, size,
    cell, vector``).
    """
    for rows, bounds in _whole(batches, 3):
        visitors, shards = [], []
        is_shard = rows.column("graph").is_valid().to_numpy(zero_copy_only=False)
        for a, b in itertools.pairwise(bounds.tolist()):
            if b - a < 2 or not is_shard[a]:
                continue
            body, size, cell = (rows.column(k).slice(a + 1, b - a - 1).to_numpy(zero_copy_only=False) for k in ("body", "size", "cell"))
            own, first, at = np.unique(body, return_index=True, return_inverse=True)
            cell = cell[np.argsort(at, kind="stable")]
            cells = [cell[c:d] for c, d in itertools.pairwise([0, *np.cumsum(np.bincount(at)).tolist()])]
            vectors = _vectors(rows.column("vector").slice(a + 1, b - a - 1).take(pa.array(first)))
            visitors.append((own, size[first], unit(vectors), cells))
            shards.append([rows.column(k)[a].as_py() for k in ("bodies", "sizes", "graph")])
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        graphs = [Graph.unpacked(g) for _, _, g in shards]
        found = Joined(graphs).above([v[2] for v in visitors], FLOOR, [v[3] for v in visitors]) if graphs else []
        for (body, size, vectors, cells), (bodies, sizes, _), graph, (q, n) in zip(visitors, shards, graphs, found):
            # Below the higher floor a pair must have a key in common.
            far = np.einsum("ij,ij->i", vectors[q], graph.x[n]) < FAR_FLOOR
            asking, place = np.unique(q[far], return_inverse=True)
            mate, node = graph.members([cells[k] for k in asking])
            near = ~far
            near[far] = np.isin(place * len(graph.x) + n[far], mate * len(graph.x) + node)
            q, n = q[near], n[near]
            one, other = body[q], np.frombuffer(bodies, np.int64)[n]
            both = size[q], np.frombuffer(sizes, np.int32)[n]
            keep = (one != other) & (np.minimum(*both) >= WORDING * np.maximum(*both))
            out_a.append(one[keep])
            out_b.append(other[keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["body_a", "body_b"])


def page_sources(manifest: DataFrame) -> DataFrame:
    """``content_id, source``: the hash of the page source of each archive, in one spelling; missing hashes are left out."""
    digest = F.regexp_extract(F.lower(F.trim("sha256")), "([0-9a-f]{64})$", 1)
    rows = manifest.where("content_id is not null and primary_file <> '' and endswith(file_path, primary_file)").select("content_id", digest.alias("source"))
    return rows.where("source <> ''").distinct()


def _decided(members: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """``content_id, place, partner``: which new records repeat an accepted one; ``partner`` is its place, null for accepted ones.

    ``members`` (``content_id, place, class``) holds the new records, a class of any size being one row in each step;
    ``links`` (``class, other``) each class with itself and its neighbours, ``known`` (``class, place``) the earliest record
    of each class that was accepted before, all of them earlier than the new ones.
    """

    def earliest(rows: DataFrame, c: str) -> DataFrame:
        """The least ``c`` in each class and its neighbours."""
        return links.join(rows.groupBy("class").agg(F.min("place").alias(c)).withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.min(c).alias(c))

    old = members.join(earliest(known, "a"), "class", "left").groupBy("content_id").agg(F.min("place").alias("place"), F.min("a").alias("partner"))
    old = staged(old, "against-history")
    done = [old.where("partner is not null")]
    open_rows = staged(members.join(old.where("partner is null").select("content_id"), "content_id", "left_semi"), "open")
    accepted = open_rows.limit(0)
    while open_rows.limit(1).count():
        seen = open_rows.join(earliest(open_rows, "v"), "class", "left").join(earliest(accepted, "a"), "class", "left").groupBy("content_id").agg(F.min("place").alias("place"), F.min("v").alias("v"), F.min("a").alias("partner"))
        is_case = F.coalesce(F.col("partner") < F.col("place"), F.lit(False))
        state = staged(seen.select("content_id", "place", F.when(is_case, F.col("partner")).alias("partner"), (is_case | F.coalesce(F.col("v") >= F.col("place"), F.lit(True))).alias("decided")), "round")
        done.append(state.where("decided").select("content_id", "place", "partner"))
        new = open_rows.join(state.where("decided and partner is null").select("content_id"), "content_id", "left_semi")
        # Classes of records accepted in earlier rounds stay; they are aggregated, so a class is one row.
        accepted = staged(accepted.unionByName(new).groupBy("class").agg(F.min("place").alias("place"), F.min("content_id").alias("content_id")).select("content_id", "place", "class"), "accepted")
        open_rows = staged(open_rows.join(state.where("not decided").select("content_id"), "content_id", "left_semi"), "open")
    return reduce(DataFrame.unionByName, done)


def _parts(shards: dict[int, int]) -> int:
    """Partitions for the shards of a segment table."""
    return min(MOST_PARTITIONS, max(8, math.ceil(sum(shards.values()) * SHARD_NODES / TASK_NODES)))


class HistoryIndex:
    """The archive of what was accepted, kept in ``folder`` between runs and batches.

    ``add`` takes the next batches and returns the records that repeat accepted ones. A folder that holds an index is
    opened, an empty one is begun with the first batch: the model of main bodies is trained on a bounded sample of its pages,
    common words are counted over all of its bodies.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        try:
            stored = self._read("state").orderBy(F.desc("version")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            stored = None
        # Segments by name, with their number of shards and of bodies; a new state is written after all its tables are.
        self.version, self.segments, self.accepted, self.texts, self.model = pickle.loads(stored.value) if stored else (0, {}, [], [], None)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def _save(self) -> None:
        self.version += 1
        value = pickle.dumps((self.version, self.segments, self.accepted, self.texts, self.model))
        self.spark.createDataFrame([(self.version, bytearray(value))], "version int, value binary").coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    def add(self, content: DataFrame, manifest: DataFrame, sites: DataFrame, cases: DataFrame | None = None, all_accepted: bool = False) -> DataFrame:
        """``content_id, earlier``: the new records that repeat an accepted one, and the earliest such one.

        ``content`` (``content_id, batch_no, canonical_url, platform, title, text``) and ``manifest`` hold the new batches
        only; ``cases`` (``content_id``) are records that take no part, those with residue unless given. With
        ``all_accepted`` the records are a history that is taken as it is.
        """
        if cases is None:
            cases = residue(content.select("content_id", "text"), ("text",)).select("content_id")
        part = content.select("content_id", "batch_no", "canonical_url", "platform", "title", "text").join(staged(cases.select("content_id"), "left-out"), "content_id", "left_anti")
        first = self.model is None
        if first:
            self.model = train(part), np.zeros(0, np.uint64)
        shared = self.spark.sparkContext.broadcast(self.model)
        stem = f"v{self.version + 1}-{uuid.uuid4().hex[:8]}"
        bodies = self._write(_bodies(part.where("text is not null and text <> ''").select("content_id", "batch_no", "platform", "title", "text"), shared), f"{stem}/bodies")
        self.texts.append(f"{stem}/bodies")
        if first:
            self.model = self.model[0], common_units(bodies)
        older = dict(self.segments)
        new = self._index(stem, _routed(bodies, self.model[1]).groupBy("body").agg(F.min("batch_no").alias("segment"), F.first("size").alias("size"), F.first("vector").alias("vector"), F.first("keys").alias("keys")))
        near = None if all_accepted else staged(self._near(new, older, stem), "near")
        members = self._members(part, bodies, manifest, sites)
        if all_accepted:
            accepted = members.groupBy("class").agg(F.min("place").alias("place"))
            found = part.limit(0).select("content_id", F.col("content_id").alias("earlier"))
        else:
            body_class = lambda c: F.xxhash64(F.lit("body"), F.col(c))
            edges = near.select(body_class("body_a").alias("class"), body_class("body_b").alias("other"))
            edges = edges.unionByName(edges.select(F.col("other").alias("class"), F.col("class").alias("other")))
            own = members.select("class").distinct()
            links = staged(edges.unionByName(own.select("class", F.col("class").alias("other"))).distinct(), "links")
            known = reduce(DataFrame.unionByName, [self._read(name) for name in self.accepted]) if self.accepted else members.limit(0).select("class", "place")
            decided = staged(_decided(members, links, known.select("class", "place")), "decided")
            accepted = members.join(decided.where("partner is null").select("content_id"), "content_id", "left_semi").groupBy("class").agg(F.min("place").alias("place"))
            found = decided.where("partner is not null").select("content_id", F.col("partner.content_id").alias("earlier"))
        self._write(accepted, f"{stem}/accepted")
        self.accepted.append(f"{stem}/accepted")
        if len(self.segments) > MOST_SEGMENTS:
            self.compact()
        self._save()
        return found

    def _members(self, part: DataFrame, bodies: DataFrame, manifest: DataFrame, sites: DataFrame) -> DataFrame:
        """``content_id, place, class`` of the records by address, source and body, each once."""
        addresses = with_page_address(part.select("content_id", "batch_no", "canonical_url"), "canonical_url", sites).where("address is not null")
        sources = page_sources(manifest).join(part.select("content_id", "batch_no").distinct(), "content_id")
        every = part.select("content_id", "batch_no", F.xxhash64(F.lit("record"), F.col("content_id").cast("string")).alias("class"))
        rows = (
            addresses.select("content_id", "batch_no", F.xxhash64(F.lit("address"), "address").alias("class"))
            .unionByName(sources.select("content_id", "batch_no", F.xxhash64(F.lit("source"), "source").alias("class")))
            .unionByName(bodies.select("content_id", "batch_no", F.xxhash64(F.lit("body"), "body").alias("class")))
            .unionByName(every)
        )
        return staged(rows.groupBy("content_id", "class").agg(F.min("batch_no").alias("batch_no")).select("content_id", F.struct("batch_no", "content_id").alias("place"), "class"), "members")

    def _index(self, stem: str, bodies: DataFrame) -> DataFrame:
        """Adds segments of ``segment, body, size, vector, keys``: tables of nodes and keys and the graph shards."""
        stored = self._write(bodies.select("segment", "body", "size", "vector", "keys"), f"{stem}/nodes")
        routed = stored.select("segment", "body", "size", "vector", F.explode("keys").alias("key"))
        # How many cells a key has in its segment: one, unless very many bodies share it.
        sizes = routed.groupBy("segment", "key").agg(F.count("*").alias("n")).withColumn("cells", F.ceil(F.col("n") / HOT_KEY).cast("int"))
        keys = self._write(sizes, f"{stem}/keys")
        totals = {r.segment: r.n for r in keys.groupBy("segment").agg(F.sum("n").alias("n")).collect()}
        shards = {s: max(1, math.ceil(n / SHARD_NODES)) for s, n in totals.items()}
        if shards:
            of_segment = F.element_at(F.create_map(*[F.lit(v) for s, n in shards.items() for v in (s, n)]), F.col("segment"))
            # Only hot keys need their number of cells looked up; all others have one.
            hot = keys.where("cells > 1").select("segment", "key", "cells")
            placed = routed.join(hot, ["segment", "key"], "left").withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("body", F.lit("cell")), F.coalesce("cells", F.lit(1))).cast("int")))
            placed = placed.select("segment", F.pmod("cell", of_segment).cast("int").alias("shard"), "cell", "body", "size", "vector")
            sorted_rows = placed.repartition(_parts(shards), "segment", "shard").sortWithinPartitions("segment", "shard")
            built = sorted_rows.mapInArrow(_built, "segment int, shard int, bodies binary, sizes binary, graph binary")
            self._write(built, f"{stem}/graphs")
            self.segments[stem] = (shards, sum(totals.values()))
        return stored

    def _near(self, new: DataFrame, older: dict, stem: str) -> DataFrame:
        """``body_a, body_b``: new bodies with older ones and with each other, where both share enough of their wording."""
        none = new.select(F.col("body").alias("body_a"), F.col("body").alias("body_b")).limit(0)
        asking = new.select("body", "size", "vector", F.explode("keys").alias("key"))
        found = []
        for name in [*older, stem]:
            if name not in self.segments:
                continue
            shards = self.segments[name][0]
            of_segment = F.element_at(F.create_map(*[F.lit(v) for s, n in shards.items() for v in (s, n)]), F.col("segment"))
            directory = self._read(f"{name}/keys")
            if name == stem:
                # A key that a single new body has leads to no other one.
                directory = directory.join(directory.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key"), "key", "left_semi")
            visits = asking.join(directory.select("segment", "key", "cells"), "key").select("body", "size", "vector", "segment", F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: F.xxhash64("key", c.cast("int")))).alias("cell"))
            visits = visits.withColumn("shard", F.pmod("cell", of_segment).cast("int"))
            # A shard with very many visitors is searched in several tasks, each with a copy of its graph.
            crowds = staged(visits.groupBy("segment", "shard").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("groups")), "crowds")
            graphs = self._read(f"{name}/graphs").join(crowds, ["segment", "shard"]).select("segment", "shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("crowd"), "bodies", "sizes", "graph")
            several = crowds.where("groups > 1")
            visits = visits.join(several, ["segment", "shard"], "left").select("segment", "shard", F.pmod(F.xxhash64("body", F.lit("crowd")), F.coalesce("groups", F.lit(1))).cast("int").alias("crowd"), "body", "size", "vector", "cell")
            by = ["segment", "shard", "crowd"]
            rows = graphs.unionByName(visits, allowMissingColumns=True).select(*by, "body", "size", "cell", "vector", "bodies", "sizes", "graph")
            found.append(rows.repartition(_parts(shards), *by).sortWithinPartitions(*by, F.col("body").asc_nulls_first()).mapInArrow(_visited, "body_a long, body_b long"))
        pairs = reduce(DataFrame.unionByName, found) if found else none
        # A pair of two new bodies may be found from both sides.
        pairs = staged(pairs.distinct(), "candidates")
        words = reduce(DataFrame.unionByName, [self._read(name).select("body", "words") for name in self.texts])
        wanted = pairs.select(F.col("body_a").alias("body")).union(pairs.select("body_b")).distinct()
        words = staged(words.join(wanted, "body", "left_semi").dropDuplicates(["body"]), "body-words")

        def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [same_wording(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)) for a, b in zip(batch.column(2), batch.column(3))]
                yield batch.select(["body_a", "body_b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(words.select(F.col("body").alias("body_a"), F.col("words").alias("wa")), "body_a").join(words.select(F.col("body").alias("body_b"), F.col("words").alias("wb")), "body_b")
        return both.select("body_a", "body_b", "wa", "wb").mapInArrow(reranked, "body_a long, body_b long")

    def compact(self) -> None:
        """Makes one segment of the smaller ones, from their stored sketches and keys; the largest stay as they are.

        A body is rebuilt a logarithmic number of times, since segments grow with each compaction.
        """
        by_size = sorted(self.segments, key=lambda s: -self.segments[s][1])
        small = by_size[MOST_SEGMENTS // 2 :]
        rows = reduce(DataFrame.unionByName, [self._read(f"{s}/nodes") for s in small]).dropDuplicates(["body"]).withColumn("segment", F.lit(0))
        for s in small:
            del self.segments[s]
        self._index(f"c{self.version + 1}-{uuid.uuid4().hex[:8]}", rows)


def repeats(content: DataFrame, manifest: DataFrame, sites: DataFrame, folder: str | None = None) -> DataFrame:
    """``content_id_a, content_id_b``: each repeated record with the earliest accepted record that it repeats, smaller id first.

    Records are taken by ``batch_no``, then ``content_id``; a null ``batch_no`` counts as history. Records whose text is
    residue take no part. Null and empty addresses, hashes and bodies repeat nothing; records that arrived twice count
    once; extra columns are ignored. ``folder`` is that of the index, which is begun there; a new one in the shared folder
    unless given.
    """
    spark = content.sparkSession
    base = content.where("content_id is not null").select("content_id", F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), "canonical_url", "platform", "title", "text")
    cases = staged(residue(base.select("content_id", "text"), ("text",)).select("content_id"), "residue")
    index = HistoryIndex(spark, folder or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    index.add(base.where("batch_no <= 0"), manifest, sites, cases, all_accepted=True)
    found = index.add(base.where("batch_no > 0"), manifest, sites, cases)
    return found.select(F.least("content_id", "earlier").alias("content_id_a"), F.greatest("content_id", "earlier").alias("content_id_b")).distinct()
