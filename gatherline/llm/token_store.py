"""Token ids in files: canonical length-limited Huffman codes from global counts, in independent blocks with bit-offset checkpoints.

Format of a store (a folder): `codebook` is a Parquet table of id and bits (its code's length; canonical codes follow from these), `blocks` one of
shard, block, first (ids of the shard before it), n_ids, docs (doc_id, n_tokens, in order), checkpoints (the bit in payload at which every EVERY-th id's code begins) and payload. A document's codes begin
at a whole byte and lie in one block, so blocks can be put together from coded documents and each block, or any stretch from a checkpoint on, is read by itself.
Ascending (shard, block, place in docs) is ascending doc_id.

Texts are encoded once, to a table of plain ids that goes when the store is written. Ids are counted over all of it, the code book (as large as the vocabulary) is made by package-merge on the driver, and one shuffle by ranges of doc_id carries coded documents only.
Readers turn bits to ids by one table look-up a code, for all stretches of a block at once.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ddl, portions, sliced

#: Longest code in bits (a vocabulary that needs more gets more), ids between checkpoints, ids after which a block ends.
LONGEST, EVERY, BLOCK_IDS = 18, 128, 1 << 17
#: Distinct words and pieces that a task keeps (those that it meets first), and the longest that it keeps (in bytes).
KEPT_WORDS, KEPT_PIECES, KEPT_BYTES = 800_000, 400_000, 64
#: Bytes of texts that a task encodes at once (a longer text is alone).
PORTION = 8 << 20
#: Words that are cut into pieces here, and how: as the vocabulary's own pattern does. Other words may hold white space or letters on which two versions of Unicode differ.
PLAIN = regex.compile(r"[!-~\u00a1-\u052f]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What stands for each byte in a byte-level vocabulary: printable ones of Latin-1 for themselves, the others, in order, the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = [chr(b) if b in PRINTABLE else chr(256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)]
#: Shards, at most; boundaries between them are quantiles of doc_id, which an estimate of bounded size gives.
MOST_SHARDS = 4096


class Encoder:
    """Ids by a tokenizer file of the tokenizers library, equal to those of whole texts.

    Texts are cut at ASCII white space, which the vocabulary drops and over which nothing is merged, and a task encodes a distinct word once. A word of plain letters, digits and signs (ASCII, or up to Cyrillic, by the library's normalizer) is
    cut into pieces as the file's pattern does, and a distinct piece goes to the library's model once; any other word goes to the library as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalize, self.merge = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.number: dict[bytes, int] = {}
        self.piece: dict[str, tuple[int, ...]] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids_of_piece(self, piece: str) -> tuple[int, ...]:
        found = self.piece.get(piece)
        if found is None:
            found = tuple(t.id for t in self.merge("".join(map(BYTE_LETTERS.__getitem__, piece.encode()))))
            if len(self.piece) < KEPT_PIECES and len(piece) <= KEPT_BYTES:
                self.piece[piece] = found
        return found

    def ids_of(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if b"<|" in word or not PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        text = text.lower() if word.isascii() else self.normalize(text)
        return [i for piece in PIECES.findall(text) for i in self.ids_of_piece(piece)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array."""
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()  # distinct ones, and which one stands in each place
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missed = np.flatnonzero(numbers < 0)
        new = [distinct[i] for i in missed]
        found = list(map(self.ids_of, new))
        first = len(self.ends) - 1
        numbers[missed] = np.arange(first, first + len(new))
        ids, ends = self.joined(found)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        of_words = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]))
        every = of_words.take(words.indices)
        keep = [i for i, w in enumerate(new) if len(w) <= KEPT_BYTES][: max(0, KEPT_WORDS - len(self.number))]
        self.number.update(zip((new[i] for i in keep), range(first, first + len(keep))))
        self.ids, self.ends = (ids, ends) if len(keep) == len(new) else self.joined([found[i] for i in keep])
        cuts = every.offsets.to_numpy()[split.offsets.to_numpy()[1:-1] - split.offsets[0].as_py()]
        return np.split(every.flatten().to_numpy(), cuts)

    def joined(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids that are kept and those found, and where each word's end."""
        ends = self.ends[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)
        return np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)]), np.concatenate([self.ends, ends])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file: what it knows of words serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """docs (with a column text) with ids (binary: little-endian numbers of two bytes each, or four where the vocabulary needs them) in place of text: the text's and then end."""
    width = width_of(path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in portions(batches, "text", 2048, PORTION):
            made = [np.append(ids, end).astype(width).tobytes() for ids in e.encode(batch.column("text"))]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(made, pa.binary())], names=[*rest, "ids"])

    return docs.mapInArrow(run, ddl(docs.drop("text"), "ids binary"))


def width_of(path: str, end: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def counts(coded: DataFrame, width: str) -> DataFrame:
    """id, c: how often each id occurs in all rows (ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in portions(batches, "ids", 2048, PORTION):
            total = added(total, np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "c"])

    return coded.select("ids").mapInArrow(run, "id int, c long").groupBy("id").agg(F.sum("c").alias("c"))


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short, long = sorted((a, b), key=len)
    out = long.copy()
    out[: len(short)] += short
    return out


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Bits of each id's code, longest at most, so that the sum of counts times bits is least (package-merge)."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    if len(ids) < 2:
        return dict.fromkeys(ids, 1)
    longest = max(longest, (len(ids) - 1).bit_length())
    weights = np.array([counts[i] for i in ids], np.float64)
    # Level by level: pairs of the level below are packed and merged with the leaves. of[n] tells whether the n-th lightest is a leaf.
    levels, packed = [], np.zeros(0)
    for _ in range(longest):
        all_ = np.concatenate([weights, packed])
        order = np.argsort(all_, kind="stable")
        levels.append(order < len(ids))
        merged = all_[order]
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    bits, take = np.zeros(len(ids), np.int64), 2 * len(ids) - 2
    for leaves in reversed(levels):  # the lightest `take` entries: their leaves count once more, their packs stand for two entries below
        n = int(np.count_nonzero(leaves[:take]))
        bits[:n] += 1
        take = 2 * (take - n)
    return dict(zip(ids, bits.tolist()))


class Codes:
    """Canonical codes: ascending by (bits, id)."""

    def __init__(self, lengths: dict[int, int]):
        self.longest = max(lengths.values(), default=1)
        self.code, self.bits = np.zeros(max(lengths, default=0) + 1, np.uint64), np.zeros(max(lengths, default=0) + 1, np.int64)
        ordered = sorted(lengths, key=lambda i: (lengths[i], i))
        widths = np.array([lengths[i] for i in ordered], np.int64)
        spans = 1 << (self.longest - widths)
        firsts = np.cumsum(spans) - spans
        self.code[ordered], self.bits[ordered] = (firsts >> (self.longest - widths)).astype(np.uint64), widths
        self.symbols, self.widths = np.repeat(np.array(ordered, np.int32), spans), np.repeat(widths.astype(np.uint8), spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of all ids, filled up to a byte, and the bit at which every EVERY-th code begins."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        window = self.code[ids] << (64 - (starts & 31) - bits).astype(np.uint64)  # a code touches two words of 32 bits at most
        at, n = starts >> 5, int(ends[-1]) if len(ends) else 0
        words = np.bincount(at, (window >> np.uint64(32)).astype(np.float64), (n >> 5) + 2)  # sums below 2^32 are exact
        words[1:] += np.bincount(at, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), (n >> 5) + 2)[:-1]
        return words.astype(">u4").tobytes()[: (n + 7) // 8], starts[::EVERY]

    def decode(self, payload: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of stretches, one after another: each begins at a bit of payload and has a size, EVERY at most. All stretches go on by one code at a time."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out, order = np.zeros((len(starts), int(sizes.max(initial=0))), np.int32), np.argsort(-sizes, kind="stable")
        at, left = starts[order].astype(np.int64), -sizes[order]
        for j in range(out.shape[1]):
            n = int(np.searchsorted(left, -j, "left"))  # stretches of more than j ids
            p = at[:n]
            index = (windows[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.longest)
            out[:n, j] = self.symbols[index]
            at[:n] += self.widths[index]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back][np.arange(out.shape[1]) < sizes[:, None]]


def stretches(n_ids: np.ndarray) -> np.ndarray:
    """Sizes of the stretches between checkpoints of documents with so many ids."""
    return np.concatenate([np.zeros(0, np.int64), *([EVERY] * (n // EVERY) + [n % EVERY] * (n % EVERY > 0) for n in n_ids.tolist())]).astype(np.int64)


def shard_of(docs: DataFrame, shards: int) -> DataFrame:
    """docs with shard, ascending with doc_id (null first, as the least long); rows of an id that fills several shards are spread over them by a hash."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(key, [i / shards for i in range(1, shards)], 100 * shards)).first()[0] if shards > 1 else []
    bounds = F.array(*map(F.lit, cuts or [])).cast("array<long>")
    below, upto = F.size(F.filter(bounds, lambda b: b < F.col("key"))), F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    more = F.greatest(upto - below, F.lit(1))
    return docs.withColumn("key", key).withColumn("shard", (below + F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), more)).cast("int"))


def write(docs: DataFrame, path: str, folder: str, end: int, *, shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encodes docs (doc_id integer, text; others ignored) with the tokenizer file at path and writes a store to folder: a document's ids and then end, by ascending doc_id (null first).

    A null or empty text has the end alone. Whole texts of any length are encoded; rows that repeat an id follow each other in any order. An empty table gives an empty store."""
    spark, kind, width = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString(), width_of(path, end)
    shards = shards or min(MOST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = f"{folder}/tokens"
    tokenized(shard_of(docs.select("doc_id", "text"), shards), path, end).write.option("compression", "zstd").parquet(tokens)
    ids = spark.read.schema(f"doc_id {kind}, key long, shard int, ids binary").parquet(tokens)
    lengths = code_lengths({r["id"]: r["c"] for r in counts(ids, width).toLocalIterator()})  # as many ids as the vocabulary has
    spark.createDataFrame([(i, b) for i, b in sorted(lengths.items())], "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast(Codes(lengths))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in portions(batches, "ids"):
            ids = [np.frombuffer(b, width) for b in batch.column("ids").to_pylist()]
            made = [codes.encode(i) for i in ids]
            arrays = [pa.array(map(len, ids), pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[0] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "key", "doc_id")), *arrays], names=["shard", "key", "doc_id", "n_tokens", "checkpoints", "payload"])

    coded = ids.mapInArrow(code, f"shard int, key long, doc_id {kind}, n_tokens long, checkpoints array<long>, payload binary")
    ordered = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "key", "n_tokens", "payload")
    blocks = ordered.mapInArrow(partial(assembled, block_ids=block_ids), f"shard int, block int, first long, n_ids long, docs array<struct<doc_id:{kind},n_tokens:long>>, checkpoints array<long>, payload binary")
    blocks.write.parquet(f"{folder}/blocks")
    where = spark._jvm.org.apache.hadoop.fs.Path(tokens)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def assembled(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    """Coded documents, in order, put together to blocks of block_ids ids and what the last one's document has more."""
    shard, block, first, n = None, 0, 0, 0
    ids, sizes, points, parts, at = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        docs = pa.StructArray.from_arrays([pa.array(ids, kind), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (docs, pa.array(np.concatenate(points)))]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), *lists, pa.array([b"".join(parts)], pa.binary())],
            names=["shard", "block", "first", "n_ids", "docs", "checkpoints", "payload"],
        )

    for batch in portions(batches, "payload"):
        kind = batch.schema.field("doc_id").type
        for row in zip(*(batch.column(c) for c in ("shard", "doc_id", "n_tokens", "checkpoints", "payload"))):
            if ids and (row[0].as_py() != shard or n >= block_ids):
                yield flush()
                block, first = (block + 1, first + n) if row[0].as_py() == shard else (0, 0)
                n, at = 0, 0
                ids, sizes, points, parts = [], [], [], []
            shard = row[0].as_py()
            ids.append(row[1].as_py())
            sizes.append(row[2].as_py())
            points.append(row[3].values.to_numpy() + 8 * at)
            parts.append(row[4].as_py())
            n, at = n + sizes[-1], at + len(parts[-1])
    if ids:
        yield flush()


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, before: ids of all shards before it. A row a shard, MOST_SHARDS at most."""
    sums = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids")).collect())
    starts = np.cumsum([0, *(r["ids"] for r in sums)]).tolist()
    return blocks.sparkSession.createDataFrame([(r["shard"], before) for r, before in zip(sums, starts)], "shard int, before long")


def read(spark: SparkSession, folder: str, *, ids: bool = True, digests: bool = False) -> DataFrame:
    """A row per document of a store: doc_id, start (ids of all documents before it), n_tokens; with ids, ids (array of int); with digests, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{folder}/codebook").toLocalIterator()}
    shared = spark.sparkContext.broadcast(Codes(lengths))
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in sliced(batches, 1):
            docs = batch.column("docs").flatten()
            sizes = docs.field("n_tokens").to_numpy()
            found = codes.decode(batch.column("payload")[0].as_py(), batch.column("checkpoints").flatten().to_numpy(), stretches(sizes))
            ends = np.cumsum(sizes)
            columns, names = [docs.field("doc_id"), pa.array(ends - sizes + batch.column("first")[0].as_py()), docs.field("n_tokens")], ["doc_id", "start", "n_tokens"]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found)))
                names.append("ids")
            if digests:
                raw = found.astype("<u4")
                columns.append(pa.array([zlib.crc32(raw[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.int64()))
                names.append("ids_crc32")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard").withColumn("first", F.col("before") + F.col("first")).select("docs", "checkpoints", "payload", "first")
    return placed.mapInArrow(run, ", ".join([f"doc_id {kind}, start long, n_tokens long", *["ids array<int>"] * ids, *["ids_crc32 long"] * digests]))
