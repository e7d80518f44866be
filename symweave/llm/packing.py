"""Filling fixed-capacity containers along a space-filling curve (problem 7).

Each text becomes the mean of hashed vectors of its words, projected to three dimensions, and a place on a Hilbert
curve. The curve is range-sorted; neighbours on it are packed together, window by window, the largest first and each
into the fullest container that still has room. Containers stay open over the following windows, so that each range
leaves hardly any unused space.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm import tokens
from symweave.session import cut

#: Items that are sorted by size together, and containers that stay open at most.
WINDOW, OPEN = 1024, 512
DIMENSIONS, BITS = 3, 16
#: Word centroids lie within this distance of zero in each dimension; further ones count as at the border.
REACH = 0.25


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates below 2 ** bits.

    The coordinates are turned into the transposed index by undoing the curve's rotations from the highest bit
    down, then their bits are interleaved.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swapped = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swapped)
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    gray = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        gray = np.where((x[-1] >> level) & 1 == 1, gray ^ ((np.int64(1) << level) - 1), gray)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ gray) >> level) & 1)
    return key


def _word_vectors(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hashed vector of each word, and whether it counts: only words with a letter do."""
    hashes = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)
    parts = [((hashes >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.float32) / 0xFFFF - 0.5 for i in range(DIMENSIONS)]
    return np.stack(parts, axis=1), pc.match_substring_regex(distinct, r"\pL").to_numpy(zero_copy_only=False).astype(bool)


def measured(docs: DataFrame, names: list[str], folder: str = tokens.FOLDER) -> DataFrame:
    """(doc_id, sizes, key, cell): the tokens of each text under each named tokenizer, and its place on the curve and in space.

    Null and empty texts have no tokens; they and texts without letters lie in the middle, and have no cell.
    """
    other = [n for n in names if n not in tokens.WORD_LEVEL]
    text = F.coalesce("text", F.lit("")) if other else F.lit("")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = tokens._list_parts(b.column("words"))
            coded = values.dictionary_encode()
            at, distinct = coded.indices.to_numpy(), coded.dictionary
            total = lambda of: np.diff(np.concatenate((np.zeros((1, *of.shape[1:]), of.dtype), np.cumsum(of, axis=0)))[offsets], axis=0)
            sizes = []
            for name in names:
                encode = tokens.encoder(name, folder)
                if name in other:
                    sizes.append(np.array([len(ids) for ids in encode(b.column("text").to_pylist())], dtype=np.int32))
                else:
                    per_word = np.array([len(ids) for ids in encode(distinct.to_pylist())], dtype=np.int64)
                    sizes.append(total(per_word[at]).astype(np.int32))
            vectors, counts = _word_vectors(distinct)
            n = np.maximum(total(counts.astype(np.int64)[at]), 1)[:, None]
            centre = np.concatenate([total((vectors[:, i] * counts).astype(np.float64)[at])[:, None] for i in range(DIMENSIONS)], axis=1) / n
            cells = np.clip((centre + REACH) / (2 * REACH), 0, 1) * ((1 << BITS) - 1)
            flat = np.stack(sizes, axis=1).reshape(-1) if sizes else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(names), pa.int32()), pa.array(flat, pa.int32()))
            worded = total(counts.astype(np.int64)[at]) > 0
            place = pa.array([c if w else None for c, w in zip(cells.astype(np.int32).tolist(), worded.tolist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(hilbert_key(cells.astype(np.int64))), place], ["doc_id", "sizes", "key", "cell"])

    columns = docs.select("doc_id", tokens.words("text").alias("words"), text.alias("text"))
    return columns.mapInArrow(measure, "doc_id bigint, sizes array<int>, key bigint, cell array<int>")


class _Packer:
    """The open containers of one budget within one range of the curve."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.room, self.waiting = capacity, first, [], []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc: int, size: int) -> list[tuple]:
        """Takes one text; gives rows (pack, doc, piece, start, end) of what is placed already."""
        rows, piece, start = [], 0, 0
        while size - start > self.capacity:
            rows.append((self._new(), doc, piece, start, start + self.capacity))
            piece, start = piece + 1, start + self.capacity
        self.waiting.append((size - start, doc, piece, start))
        return rows + (self.flush() if len(self.waiting) >= WINDOW else [])

    def flush(self) -> list[tuple]:
        """Places what waits, the largest first, each where the least room is left."""
        rows = []
        for size, doc, piece, start in sorted(self.waiting, key=lambda w: (-w[0], w[1])):
            at = bisect_left(self.room, (size, -1))
            left, pack = self.room.pop(at) if at < len(self.room) else (self.capacity, self._new())
            if left > size or not size:
                insort(self.room, (left - size, pack))
            rows.append((pack, doc, piece, start, start + size))
        self.waiting = []
        del self.room[: max(0, len(self.room) - OPEN)]
        return rows


def pack(sized: DataFrame) -> DataFrame:
    """(budget_id, pack_id, doc_id, piece, start_token, end_token) from rows (budget_id, capacity, doc_id, size, key).

    Each text lies whole in one pack, unless it is larger than the capacity: then all its pieces but the last one fill
    a pack each, and the last is packed like a small text. Texts without tokens take no space and still get a pack.
    Texts at the same place of the curve, such as copies, are spread by a hash, so no range grows with one of them.
    """
    spread = sized.withColumn("spread", F.xxhash64("doc_id"))
    ranged = spread.repartitionByRange("budget_id", "key", "spread").sortWithinPartitions("budget_id", "key", "spread", "doc_id")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        packers: dict[int, _Packer] = {}
        frame = lambda budget, rows: pd.DataFrame([(budget, *r) for r in rows], columns=["budget_id", "pack_id", "doc_id", "piece", "start_token", "end_token"])
        for b in batches:
            for budget, part in b.groupby("budget_id", sort=False):
                packer = packers.setdefault(budget, _Packer(int(part["capacity"].iloc[0]), first))
                rows = [r for doc, size in zip(part["doc_id"].tolist(), part["size"].tolist()) for r in packer.add(doc, size)]
                yield frame(budget, rows)
        for budget, packer in packers.items():
            yield frame(budget, packer.flush())

    return ranged.drop("spread").mapInPandas(fill, "budget_id bigint, pack_id bigint, doc_id bigint, piece int, start_token int, end_token int")


def pack_corpus(docs: DataFrame, budgets: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """The packs of all texts for each budget. Budgets (a table that doesn't grow) without a positive capacity are left out.

    The texts are measured once: sizes and keys are kept, which is little, and what follows reads only them.
    """
    limits = [(r.budget_id, r.tokenizer, r.capacity_tokens) for r in budgets.where("capacity_tokens > 0").select("budget_id", "tokenizer", "capacity_tokens").distinct().collect()]
    names = sorted({tokenizer for _, tokenizer, _ in limits})
    sizes = cut(measured(docs, names, folder).drop("cell"))
    one = lambda budget, tokenizer, capacity: F.struct(F.lit(budget).cast("bigint").alias("budget_id"), F.lit(capacity).cast("int").alias("capacity"), F.get("sizes", F.lit(names.index(tokenizer))).alias("size"))
    each = F.array(*(one(*b) for b in limits)) if limits else F.array().cast("array<struct<budget_id: bigint, capacity: int, size: int>>")
    return pack(sizes.select("doc_id", "key", F.explode(each).alias("b")).select("b.budget_id", "b.capacity", "doc_id", "b.size", "key"))


def fill_report(packs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: packs, tokens, the least possible number of packs, and the unused share of the capacity used."""
    per = packs.groupBy("budget_id", "pack_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"))
    total = per.groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_packs"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    joined = total.join(F.broadcast(budgets.select("budget_id", "capacity_tokens")), "budget_id")
    return joined.select(
        "budget_id", "capacity_tokens", "n_packs", "n_tokens", "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_packs"),
        (1 - F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens"))).alias("unused_share"),
    )


def check_report(packs: DataFrame, docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: texts, texts without a pack, with gaps between their pieces or split without need, and packs above the capacity.

    docs have distinct doc_ids. Budgets come from a table that doesn't grow.
    """
    limits = F.broadcast(budgets.where("capacity_tokens > 0").select("budget_id", F.col("capacity_tokens").alias("capacity")))
    size = F.col("end_token") - F.col("start_token")
    texts = packs.groupBy("budget_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.min("start_token").alias("first"), F.max("end_token").alias("last"), F.max("piece").alias("piece"))
    least = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1))
    per_text = texts.join(limits, "budget_id").groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("n_packed"), F.count_if((F.col("first") != 0) | (F.col("last") != F.col("size")) | (F.col("piece") != F.col("n") - 1)).alias("n_gaps"), F.count_if(F.col("n") > least).alias("n_split")
    )
    full = packs.groupBy("budget_id", "pack_id").agg(F.sum(size).alias("used")).join(limits, "budget_id").groupBy("budget_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_above"))
    unknown = packs.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    n = docs.agg(F.count(F.lit(1)).alias("n_texts"))
    # The counts are one row each; the budgets are few.
    return limits.join(per_text, "budget_id", "left").join(full, "budget_id", "left").join(F.broadcast(n)).join(F.broadcast(unknown)).select(
        "budget_id", "n_texts", (F.col("n_texts") - F.coalesce("n_packed", F.lit(0)) + F.col("n_unknown")).alias("n_missing"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"),
        F.coalesce("n_split", F.lit(0)).alias("n_split"), F.coalesce("n_above", F.lit(0)).alias("n_above"),
    )


def locality_report(packs: DataFrame, docs: DataFrame) -> DataFrame:
    """(budget_id, n_texts, spread): how far the texts of a pack lie apart, as a share of how far all texts do.

    Packs filled at random have a spread of about 1 less one pack's share. Only texts with letters, packed whole, count.
    """
    cells = measured(docs, []).where("cell IS NOT NULL").select("doc_id", *(F.col("cell")[i].cast("double").alias(f"c{i}") for i in range(DIMENSIONS)))
    placed = packs.where("piece = 0").select("budget_id", "pack_id", "doc_id").join(cells, "doc_id")
    axes = [f"c{i}" for i in range(DIMENSIONS)]
    per_pack = placed.groupBy("budget_id", "pack_id").agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(c).alias(f"v_{c}") for c in axes), *(F.sum(c).alias(f"s_{c}") for c in axes), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in axes))
    within = sum((F.sum(F.col("n") * F.col(f"v_{c}")) for c in axes), F.lit(0.0))
    total = sum((F.sum(f"q_{c}") - F.sum(f"s_{c}") * F.sum(f"s_{c}") / F.sum("n") for c in axes), F.lit(0.0))
    return per_pack.groupBy("budget_id").agg(F.sum("n").alias("n_texts"), (within / total).alias("spread"))
