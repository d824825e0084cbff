"""Items of varying length into containers of fixed capacity.

Conflict-constrained best-fit: items come longest first; the open bins are ordered by their residual capacity, and
from the tightest residual that holds the item the successor search goes on until it meets a bin whose source and
duplicate-cluster bitmaps allow it. A bit is set when the bin holds its quota of that source or cluster. A quota is the
share of all tokens that the source or cluster has, with a slack, of a container, and one item at least, so that a source
or a text with a third of all rows has room in every container. Where no open bin is compatible a new one is opened: no item ever
lies in conflict.

Each shard of at most about ``SHARD_ITEMS`` items is packed on its own. Bins that stay underfull are opened again and packed
with those of other shards, again in shards of that size, as long as a level closes at least ``LEAST_CLOSED`` of its items;
what is left then stays as it is. So no task sees more items than a shard has, whatever their sizes.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.tokens import TOKENIZERS, ByteBpe, _shared
from gleanmark.session import staged

SHARD_ITEMS = 25_000
#: Share of the items of a level that must come into closed bins for another level to follow.
LEAST_CLOSED = 0.05
#: A container may hold so many times the share of all tokens that a source or cluster has.
SLACK = 2.0
#: A bin at least so full is closed at once; others go to the next level.
CLOSED_FILL = 0.98


class Bins:
    """Open bins ordered by residual, with bitmaps of the sources and clusters that are at their quota."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []  # distinct residuals of open bins, ascending
        self.at: dict[int, list[int]] = {}  # residual -> bins
        self.held: list[list[int]] = []  # bin -> items
        self.left: list[int] = []
        self.full_source: list[int] = []
        self.full_cluster: list[int] = []
        self.used: list[dict] = []  # tokens by source, and by cluster

    def _file(self, b: int) -> None:
        r = self.left[b]
        if r not in self.at:
            bisect.insort(self.residuals, r)
            self.at[r] = []
        self.at[r].append(b)

    def successors(self, size: int) -> Iterator[int]:
        """Bins that hold ``size``, tightest first."""
        k = bisect.bisect_left(self.residuals, size)
        while k < len(self.residuals):
            yield from self.at[self.residuals[k]]
            k += 1

    def open(self) -> int:
        self.held.append([])
        self.left.append(self.capacity)
        self.full_source.append(0)
        self.full_cluster.append(0)
        self.used.append(defaultdict(int))
        self._file(len(self.left) - 1)
        return len(self.left) - 1

    def put(self, b: int, items: list[int], size: int, source: int, cluster: int, source_quota: int, cluster_quota: int) -> None:
        old = self.left[b]
        self.at[old].remove(b)
        if not self.at[old]:
            del self.at[old]
            del self.residuals[bisect.bisect_left(self.residuals, old)]
        self.left[b] = old - size * len(items)
        self.held[b] += items
        self.used[b][source] += size * len(items)
        if self.used[b][source] >= source_quota:
            self.full_source[b] |= 1 << source
        if cluster >= 0:
            self.used[b][~cluster] += size * len(items)
            if self.used[b][~cluster] >= cluster_quota:
                self.full_cluster[b] |= 1 << cluster
        self._file(b)


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, slack: float = SLACK) -> list[int]:
    """The bin of each item. No bin exceeds ``capacity`` or a quota; an item longer than the capacity raises ``ValueError``.

    ``clusters``: None for items that can't conflict. Equal items are placed in one pass over the successors.
    """
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity; split it first")
    share = slack * capacity / max(1, sum(sizes))
    number = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    of_source, of_cluster, n_cluster = defaultdict(int), defaultdict(int), defaultdict(int)
    for n, s, c in zip(sizes, sources, clusters):
        of_source[s] += n
        of_cluster[c] += n
        n_cluster[c] += 1
    repeated = {c: k for k, c in enumerate(c for c, n in n_cluster.items() if n > 1 and c is not None)}
    alike = defaultdict(list)
    for i, key in enumerate(zip(sizes, sources, clusters)):
        alike[key if key[2] in repeated else (*key, i)].append(i)
    bins, where = Bins(capacity), [0] * len(sizes)

    def allowed(used: int, quota: int, size: int) -> int:
        """Items of ``size`` that a bin with ``used`` tokens of their source or cluster may take: one at least, if it has none."""
        return max((quota - used) // size, int(not used))

    for key, items in sorted(alike.items(), key=lambda kv: (-kv[0][0], kv[1][0])):
        size, source, cluster = key[0], number[key[1]], repeated.get(key[2], -1)
        source_quota = math.ceil(share * of_source[key[1]])
        cluster_quota = math.ceil(share * of_cluster[key[2]]) if cluster >= 0 else capacity
        waiting = list(items)

        def put(b: int, most: int, size=size, source=source, cluster=cluster, source_quota=source_quota, cluster_quota=cluster_quota) -> None:
            nonlocal waiting
            own, waiting = waiting[:most], waiting[most:]
            bins.put(b, own, size, source, cluster, source_quota, cluster_quota)

        # One pass over the successors, tightest first; each takes as many of the equal items as it may.
        chosen, left = [], len(waiting)
        for b in bins.successors(size):
            if not left:
                break
            if bins.full_source[b] >> source & 1 or (cluster >= 0 and bins.full_cluster[b] >> cluster & 1):
                continue
            room = left if not size else min(bins.left[b] // size, allowed(bins.used[b].get(source, 0), source_quota, size))
            if size and cluster >= 0:
                room = min(room, allowed(bins.used[b].get(~cluster, 0), cluster_quota, size))
            if room > 0:
                chosen.append((b, min(room, left)))
                left -= min(room, left)
        for b, n in chosen:
            put(b, n)
        while waiting:
            put(bins.open(), min(allowed(0, source_quota, size), allowed(0, cluster_quota, size), capacity // size) if size else len(waiting))
    for b, own in enumerate(bins.held):
        for i in own:
            where[i] = b
    return where


def _sized(documents: DataFrame, folder: str, name: str) -> DataFrame:
    """``doc_id, source, cluster, n``: tokens of each whole text; exact copies share a cluster."""
    ranks = _shared(documents, folder, name)
    kind = dict(documents.dtypes)["doc_id"]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(ranks.value)
        for batch in batches:
            n = pa.array(bpe.counts(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n], names=["doc_id", "source", "cluster", "n"])

    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.when(F.length("text") > 0, F.xxhash64("text")).alias("cluster"), "text")
    return rows.mapInArrow(sizes, f"doc_id {kind}, source string, cluster long, n int")


def _shard_packer(level: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy_no", "piece_no"], ignore_index=True)
        capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
        bins = pd.Series(best_fit(pdf["n_tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity))
        filled = pdf["n_tokens"].groupby(bins).transform("sum")
        pdf["container_id"] = f"{pdf['limit_id'].iloc[0]}-{level}-{shard}-" + bins.astype(str)
        pdf["is_open"] = filled < CLOSED_FILL * capacity
        return pdf

    return packed  # the columns come in as the schema names them


def pack(documents: DataFrame, limits: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every document in containers of each capacity: ``limit_id, capacity, container_id, doc_id, piece_no, first_token, n_tokens``.

    A text is split only if it alone exceeds the capacity: into full pieces and a rest. Null and empty texts have 0
    tokens and come out as one piece. Containers are numbered by what they hold, so the same table gives the same ids. ``limits`` holds one row per capacity (``limit_id``, ``capacity`` of at least 1;
    rows with nulls are left out) and is small by its nature; more than 100 are refused. Repeated documents are items of
    their own. Other columns are ignored, and an empty table gives none.
    """
    kind = dict(documents.dtypes)["doc_id"]
    wanted = sorted({(r.limit_id, r.capacity) for r in limits.select("limit_id", "capacity").where("limit_id is not null and capacity >= 1").limit(101).collect()})
    if len(wanted) > 100:
        raise ValueError("more than 100 capacities")
    # Repeated rows are counted and numbered, so that each copy has its own place in the shards.
    alike = _sized(documents, folder, name).groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("copies"))
    sized = staged(alike.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no")), "sizes")
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in wanted]) if wanted else F.array().cast("array<struct<limit_id:int,capacity:int>>")
    pieces = (
        sized.select("*", F.explode(each).alias("l"))
        .select("doc_id", "copy_no", "source", "cluster", "n", "l.limit_id", "l.capacity")
        .select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1))).alias("piece_no"))
        .withColumn("first_token", F.col("piece_no") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity"), F.col("n") - F.col("first_token")))
        .withColumn("cluster", F.when(F.col("n") <= F.col("capacity"), F.col("cluster")))
    )
    out = ["limit_id", "capacity", "container_id", "doc_id", "piece_no", "first_token", "n_tokens"]
    whole = pieces.where("n_tokens = capacity").withColumn("container_id", F.concat_ws("-", "limit_id", F.lit("full"), F.hex(F.xxhash64("doc_id", "cluster", "source")), "copy_no", "piece_no"))
    done = [whole.select(*out)]
    rest = pieces.where("n_tokens < capacity")
    schema = f"limit_id int, capacity int, container_id string, doc_id {kind}, copy_no int, piece_no int, first_token int, n_tokens int, source string, cluster string, shard int, is_open boolean"
    keep = ["limit_id", "capacity", "container_id", "doc_id", "copy_no", "piece_no", "first_token", "n_tokens", "source", "cluster"]
    # Clusters travel as decimals, since pandas would turn a column of longs with nulls into floats.
    items, level = rest.withColumn("container_id", F.lit("")).withColumn("cluster", F.col("cluster").cast("string")).select(*keep), 0
    waiting = _per_limit(items)
    while True:
        # Items of one bin stay together only by chance: each level packs anew what the last one left open.
        shards = F.create_map(*[F.lit(v) for i, n in waiting.items() for v in (i, max(1, math.ceil(n / shard_items)))]) if waiting else F.create_map(F.lit(0), F.lit(1))
        shard = F.pmod(F.xxhash64("doc_id", "copy_no", "piece_no", F.lit(level)), F.try_element_at(shards, F.col("limit_id"))).cast("int")
        level_rows = staged(items.select(*keep, shard.alias("shard"), F.lit(True).alias("is_open")).groupBy("limit_id", "shard").applyInPandas(_shard_packer(level), schema), f"packed-{level}")
        left = _per_limit(level_rows.where("is_open"))
        go_on = [i for i, n in left.items() if waiting[i] > shard_items and n <= (1 - LEAST_CLOSED) * waiting[i]]
        if not go_on:
            return _union([*done, level_rows.select(*out)])
        again = F.col("is_open") & F.col("limit_id").isin(*go_on)
        done.append(level_rows.where(~again).select(*out))
        items, level, waiting = level_rows.where(again).select(*keep), level + 1, {i: left[i] for i in go_on}


def _per_limit(items: DataFrame) -> dict[int, int]:
    """Items of each capacity; there are at most 100."""
    return {r.limit_id: r.n for r in items.groupBy("limit_id").agg(F.count("*").alias("n")).collect()}


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
