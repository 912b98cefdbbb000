"""Byte-level BPE encoding and decoding with a given vocabulary of ranks.

A text is cut into words by the vocabulary's pattern. A word's bytes are merged pair by pair, always the pair of least rank
first; ids are the ranks of what remains. The most frequent distinct words of all texts (a fixed number at most) are merged by a fold of Spark's higher-order functions over their
bytes with the ranks as a literal map, once for the whole table, and their ids go to all tasks; each task merges the other distinct words that it meets the same way and keeps
the outcome for the rest of its rows. Decoding concatenates the binary pieces of ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, saved, sliced, with_text
from .lmscore import most_counted

#: Distinct words that a task keeps before it forgets them all and begins anew.
KEPT_WORDS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string, from a file with a base64 string and a rank in each line. Read by the driver; the table has a fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: folds ranked merges over its bytes. Every single byte must have a rank.

    Long words have their pairs in a heap over a linked list, so the work grows as n log n."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return merged_long(word, ranks)
    get, none = ranks.get, 1 << 60
    at = [*range(len(word) + 1)]  # where pieces begin
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del pairs[i], at[i + 1]
        if i:
            pairs[i - 1] = get(word[at[i - 1] : at[i + 1]], none)
        if i < len(pairs):
            pairs[i] = get(word[at[i] : at[i + 2]], none)
    return [ranks[word[i:j]] for i, j in pairwise(at)]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    import heapq

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        j = end[i]
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
            if (r := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Words(dict):
    """Comma-joined ids by word: the known ones', others' made when first asked for."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, str]):
        super().__init__(known)
        self.ranks, self.known = ranks, known

    def begin_anew(self) -> None:
        self.clear()
        self.update(self.known)

    def __missing__(self, word: str) -> str:
        ids = ",".join(map(str, merged(word.encode("utf-8", "surrogatepass"), self.ranks)))
        if len(word) <= 64:
            self[word] = ids
        return ids


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, known: dict[str, str] = {}):  # noqa: B006
        self.words, self.find = Words(ranks, known), regex.compile(pattern).findall
        self.piece = {str(i): b for b, i in ranks.items()}

    def encode(self, text: str | None) -> str:
        """Decimal ids, comma-joined."""
        if len(self.words) > KEPT_WORDS:
            self.words.begin_anew()
        return ",".join(map(self.words.__getitem__, self.find(text or "")))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids.split(","))) if ids else b""


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] = ["doc_id"], *, ids: bool = True, digests: bool = False) -> DataFrame:  # noqa: B006
    """The columns in keep and n_tokens; with ids, ids (array of int) and decoded (binary: the ids decoded again); with digests,
    ids_sha256 and decoded_sha256 (lower-case hexadecimal, of comma-joined decimal ids and of the decoded bytes).

    A null text is empty and has no ids. Whole texts of any length are encoded; repeated rows give repeated results. Special tokens have no part: their strings are text."""
    chosen, name = with_text(docs, keep)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(ranks)  # a vocabulary's fixed table
    known = context.broadcast(frequent_words(docs.select("text"), ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, pattern, known.value)
        for batch in sliced(batches):
            made = [coder.encode(t.as_py()) for t in batch.column(name)]
            columns, names = [batch.column(c) for c in keep], [*keep, "n_tokens"]
            columns.append(pa.array([s.count(",") + 1 if s else 0 for s in made], pa.int64()))
            if ids:
                each = [np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32) for s in made]
                offsets = np.cumsum([0, *map(len, each)], dtype=np.int32)
                columns += [pa.ListArray.from_arrays(offsets, np.concatenate([*each, np.zeros(0, np.int32)])), pa.array(map(coder.decode, made), pa.binary())]
                names += ["ids", "decoded"]
            if digests:
                columns += [pa.array([hashlib.sha256(s.encode()).hexdigest() for s in made]), pa.array([hashlib.sha256(coder.decode(s)).hexdigest() for s in made])]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ["n_tokens long", *["ids array<int>", "decoded binary"] * ids, *["ids_sha256 string", "decoded_sha256 string"] * digests]
    return chosen.mapInArrow(run, ddl(docs.select(*keep), *more))


#: Cells of the literal rank map, and the longest word (in bytes) that is folded.
CELLS, FOLDED_BYTES = 1 << 16, 64
NONE = (1 << 31) - 1


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: an array of cells, by hash, of the few byte strings (in hexadecimal) that fall into each, so that a look-up reads one cell and not the whole map."""
    cells: list[list] = [[] for _ in range(CELLS)]
    for piece, rank in ranks.items():
        cells[xxhash.xxh64_intdigest(piece.hex(), 42) % CELLS].append({"k": piece.hex(), "r": rank})
    return F.from_json(F.lit(json.dumps(cells)), "array<array<struct<k:string,r:int>>>")


def folded(word: Column, table: Column) -> Column:
    """Ids (array of int) of a word (a string of FOLDED_BYTES at most): a fold of higher-order functions that merges the pair of least rank at each step."""

    def rank(k: Column) -> Column:
        cell = F.get(table, F.pmod(F.xxhash64(k), F.lit(CELLS)).cast("int"))
        return F.coalesce(F.get(F.filter(cell, lambda e: e["k"] == k), F.lit(0))["r"], F.lit(NONE))

    hexed = F.lower(F.hex(F.encode(word, "UTF-8")))
    n = (F.length(hexed) / 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)))
    pairs = F.transform(F.slice(parts, F.lit(1), n - 1), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]
        least = F.array_min(r)

        def merge(i: Column) -> Column:  # the pair's place, from 1
            new = F.concat(F.get(p, i - 1), F.get(p, i))
            left = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), new)))).otherwise(F.array().cast("array<int>"))
            right = F.when(i < F.size(r), F.array(rank(F.concat(new, F.get(p, i + 1))))).otherwise(F.array().cast("array<int>"))
            rest = lambda a, at: F.slice(a, at, F.greatest(F.size(a) - at + 1, F.lit(0)))
            return F.struct(F.concat(F.slice(p, F.lit(1), i - 1), F.array(new), rest(p, i + 2)).alias("p"), F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, rest(r, i + 2)).alias("r"))

        return F.when((F.size(r) == 0) | (least == NONE), acc).otherwise(F.get(F.transform(F.array(F.array_position(r, least).cast("int")), merge), F.lit(0)))

    start = F.struct(parts.alias("p"), F.when(n > 1, pairs).otherwise(F.array().cast("array<int>")).alias("r"))
    ids = F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)["p"], rank)
    return F.when(rank(hexed) != NONE, F.array(rank(hexed))).otherwise(ids)


def frequent_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str) -> dict[str, str]:
    """Comma-joined ids of the most frequent words of texts (text) that are no single id and not longer than FOLDED_BYTES: as many as lmscore.FREQUENT at most, whatever the table's size."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, single, total = regex.compile(pattern).findall, shared.value, Counter()

        def flush() -> pa.RecordBatch:
            some = [(w, c) for w, c in total.items() if len(b := w.encode("utf-8", "surrogatepass")) <= FOLDED_BYTES and b not in single]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([c for _, c in some], pa.int64())], names=["item", "c"])

        for batch in sliced(batches):
            for t in batch.column("text"):
                total.update(find(t.as_py() or ""))
            if len(total) > KEPT_WORDS:
                yield flush()
        yield flush()

    most = most_counted(saved(texts.mapInArrow(run, "item string, c long").groupBy("item").agg(F.sum("c").alias("c")))).select("item")
    ids = F.get(F.transform(F.array(rank_map(ranks)), lambda table: folded(F.col("item"), table)), F.lit(0))  # a lambda's variable, so the plan holds the literal once
    words = most.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism).select("item", F.array_join(ids, ",").alias("ids"))
    return {r["item"]: r["ids"] for r in words.collect()}
