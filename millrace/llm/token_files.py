"""Token ids in binary files: frequent ids in one byte, lengths in control bytes of their own.

Every id of the corpus is counted, and the most frequent one becomes number 0, the next
number 1 and so on. Numbers take one to four bytes, as many as they need. The lengths of
four numbers stand in one control byte, two bits each, and all control bytes of a block
stand before its data bytes. A reader looks each control byte up in a table of 256 rows
of four lengths, sums them to the place of every number and gathers the bytes.

A block holds whole documents, up to about a million ids, behind a header with its place
in the order of the files. Blocks are written by Spark's own text writer, one block a
line, so that files appear whole or not at all, whatever happens to an executor, in any
store Spark reaches; a block's lengths, not the newline after it, tell where it ends.

Texts are encoded with the tokenizers library. White space only parts words, so a text is
cut there, and further into the pieces that the model sees where plain letters allow it.
Each distinct piece of a batch is encoded once and remembered.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from millrace import session
from millrace.llm.arrow import arrow_schema

# Fixed value of this format: the first eight bytes of a block.
MAGIC = int.from_bytes(b"MILLTOK1", "little")
#: A header: magic, partition, block in the partition, documents, ids, data bytes, checksum of all behind the header.
HEADER = 7

#: Ids of a block, about: it ends with the document that reaches them.
BLOCK_IDS = 1_000_000
#: Blocks of a file.
FILE_BLOCKS = 16

#: Pieces that a worker remembers, and the bytes of the longest of them: memory is bounded by their product.
REMEMBERED_WORDS, LONGEST_WORD = 500_000, 64
#: Characters that are encoded at once, about.
RUN_CHARS = 4_000_000

#: Lengths of the four numbers of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of numbers below 2^32; the last control byte is filled up with zeros."""
    n = numbers.astype("<u4")
    lengths = 1 + (n >= 1 << 8) + (n >= 1 << 16) + (n >= 1 << 24)
    codes = np.pad(lengths - 1, (0, -len(n) % 4)).reshape(-1, 4).astype(np.uint8)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = n.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8), data[np.arange(4) < lengths[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The numbers again."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths) - lengths
    numbers = data[starts].astype(np.uint32)
    for byte in range(1, 4):
        longer = np.flatnonzero(lengths > byte)
        if not len(longer):
            break
        numbers[longer] |= data[starts[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return numbers


# Fixed values of the tokenizer format: the steps before the model for which plain bytes are cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

# Kinds of bytes in plain words, which are printable ASCII without the apostrophe, and À to ÿ, whose
# first byte is LATIN. These letters are whole under NFC, and no mark of another word joins them.
SPACE, LETTER, DIGIT, SYMBOL = range(4)
LATIN = 0xC3
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[list(b" \t\n\v\f\r")] = SPACE
KINDS[list(range(ord("A"), ord("Z") + 1)) + list(range(ord("a"), ord("z") + 1)) + list(range(0x80, 0x100))] = LETTER
KINDS[list(range(ord("0"), ord("9") + 1))] = DIGIT
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Bytes that a plain word cannot have; those behind another first byte than LATIN need no mark of their own.
ODD = np.array([not (0x20 <= b < 0x7F or 0x80 <= b < 0xC0 or b == LATIN or KINDS[b] == SPACE) or b == ord("'") for b in range(256)])
PLAIN = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xDF, 0x100))]


def id_type(tokenizer: Tokenizer) -> np.dtype:
    """The unsigned type that holds every id of a tokenizer."""
    return np.dtype("<u2" if max(tokenizer.get_vocab().values()) < 1 << 16 else "<u4")


_GAP = re.compile(rb"[ \t\n\v\f\r]")


def _sections(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts as they are, but one alone cut at the first white space behind every RUN_CHARS bytes."""
    if len(texts) != 1 or texts.null_count:
        yield texts
        return
    data, start, gap = texts[0].as_buffer(), 0, True
    while gap:
        gap = _GAP.search(data, start + RUN_CHARS)
        size = (gap.start() if gap else len(data)) - start
        yield pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, size])), data.slice(start, size)])
        start += size


class Encoder:
    """Ids of texts by a tokenizer file (its JSON text), with a bounded memory of pieces."""

    def __init__(self, text: str):
        # One thread: Spark gives the worker one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = id_type(self.tokenizer)
        spec = json.loads(text)
        known = (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self._odd = ODD.copy() if known else KINDS != SPACE
        for token in spec["added_tokens"]:  # words that may hold one are left to the library
            self._odd[[x.encode()[0] for x in (token["content"][0].lower(), token["content"][0].upper())]] = True
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in PLAIN}
        self._know({}, np.zeros(1, np.int64), np.zeros(0, self.dtype))

    def _know(self, place: dict[bytes, int], borders: np.ndarray, ids: np.ndarray) -> None:
        """Know these pieces only; ids of place i lie between borders i and i + 1."""
        self._place, self._borders, self._ids = place, borders, ids
        self._met = np.zeros(len(borders) - 1, np.int32)  # batches that had the piece

    def _shrink(self) -> None:
        """Keep the pieces that more than one batch had, if those are not too many."""
        again = [(w, i) for w, i in self._place.items() if self._met[i] > 1]
        again = again if len(again) <= REMEMBERED_WORDS // 2 else []
        lists = pa.LargeListArray.from_arrays(self._borders, self._ids).take(pa.array([i for _, i in again], pa.int64()))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self._know({w: i for i, (w, _) in enumerate(again)}, np.r_[0, np.cumsum(sizes)].astype(np.int64),
                   lists.flatten().to_numpy(zero_copy_only=False))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of all texts, which of them are words left to the library, and how many each text has.

        A plain word is cut at every change of kind and behind every digit, in small letters. Others stay as
        they are: they hold a byte that no plain word has, so that no piece of one kind equals one of the other.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        kind, odd = KINDS[data], self._odd[data]
        small = LOWER[data]
        latin = np.flatnonzero(data[:-1] == LATIN)
        after = data[latin + 1]
        odd[latin] |= (after == 0x97) | (after == 0xB7)  # the signs of multiplication and division
        small[latin + 1] += 0x20 * ((after >= 0x80) & (after < 0x9F)).astype(np.uint8)
        solid = kind != SPACE
        first, cut = np.ones(len(data), bool), np.ones(len(data), bool)
        first[1:] = ~solid[:-1]
        cut[1:] = kind[1:] != kind[:-1]
        cut |= kind == DIGIT
        starts = starts[starts < len(data)]
        first[starts] = cut[starts] = True
        first &= solid
        cut &= solid
        # Bytes inside of the words left to the library are neither cut nor made small.
        words = np.flatnonzero(first)
        left = np.unique(np.searchsorted(words, np.flatnonzero(odd), side="right")) - 1
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words[left]] += 1
        inside[np.r_[words, len(data)][left + 1]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        cut = np.where(inside, first, cut)
        small = np.where(inside, data, small)
        at = np.flatnonzero(cut)
        borders = np.r_[np.flatnonzero(cut[solid]), np.count_nonzero(solid)]
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(small[solid])])
        return pieces, inside[at], np.diff(np.r_[0, np.searchsorted(at, ends)])

    def _learn(self, pieces: list[bytes], left: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Sizes and ids of pieces, by the library: its model alone, or the whole of it for those left to it."""
        ids: list[list[int]] = [[]] * len(pieces)
        plain, other = np.flatnonzero(~left).tolist(), np.flatnonzero(left).tolist()
        tokenize = self.tokenizer.model.tokenize
        spelled = b"\n".join([pieces[i] for i in plain]).decode().translate(self._letters).split("\n")
        for i, piece in zip(plain, spelled if plain else [], strict=True):
            ids[i] = [t.id for t in tokenize(piece)]
        for at in range(0, len(other), 5_000):
            part = other[at : at + 5_000]
            e = self.tokenizer.encode([pieces[i].decode() for i in part], is_pretokenized=True, add_special_tokens=False)
            flat, end = e.ids, 0
            for i, n in zip(part, np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)).tolist(), strict=True):
                ids[i], end = flat[end : end + n], end + n
        return np.fromiter(map(len, ids), np.int64, len(ids)), list(itertools.chain.from_iterable(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. Null: none."""
        ids, counts = zip(*map(self._encode, _sections(texts)), strict=True)
        return np.concatenate(ids), sum(counts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, left, counts = self._cut(texts)
        distinct = pieces.dictionary_encode()
        words = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._place) > REMEMBERED_WORDS:
            self._shrink()
        # A new piece's place is behind the known ones; the places of pieces met again stay empty.
        known = len(self._met)
        at = np.fromiter(map(self._place.setdefault, words, range(known, known + len(words))), np.int64, len(words))
        new = np.flatnonzero(at >= known)
        to_library = np.zeros(len(words), bool)
        to_library[distinct.indices.to_numpy()[left]] = True
        sizes = np.zeros(len(words), np.int64)
        sizes[new], ids = self._learn([words[i] for i in new.tolist()], to_library[new])
        self._borders = np.r_[self._borders, self._borders[-1] + np.cumsum(sizes)]
        self._ids = np.r_[self._ids, np.array(ids, self.dtype)]
        self._met = np.r_[self._met, np.zeros(len(words), np.int32)]
        self._met[at] += 1
        by_word = pa.LargeListArray.from_arrays(self._borders, self._ids).take(pa.array(at))
        by_piece = by_word.take(distinct.indices)
        ends = np.r_[0, np.cumsum(pc.list_value_length(by_piece).to_numpy(zero_copy_only=False))]
        long = pc.binary_length(distinct.dictionary).to_numpy(zero_copy_only=False) > LONGEST_WORD
        for i in new[long[new]].tolist():
            del self._place[words[i]]
        return by_piece.flatten().to_numpy(zero_copy_only=False), np.diff(np.r_[0, ends[np.cumsum(counts)]])


@functools.lru_cache(maxsize=2)
def encoder_of(text: str) -> Encoder:
    """The encoder of a vocabulary, kept with its words while the worker lives."""
    return Encoder(text)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about RUN_CHARS characters, of a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + RUN_CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, vocabulary: str, end: int, key: str, text: str) -> DataFrame:
    """(key, row, n, ids): the ids of every text as bytes of ``id_type``, an end id behind them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size
    ddl = "key long, row long, n long, ids binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for whole in batches:
            for batch in _runs(whole, 2):
                flat, counts = encoder.encode(batch.column(2))
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, encoder.dtype.type(end))
                ends = ends + np.arange(1, len(ends) + 1)
                starts = (flat.itemsize * np.r_[0, ends]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(starts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts + 1), ids], schema=schema)
                pa.default_memory_pool().release_unused()  # what a run took, an idle worker would keep

    return docs.select(
        F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string")
    ).mapInArrow(run, ddl)


def frequencies(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, count) of every id that occurs."""
    schema = arrow_schema("id long, count long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for part in _runs(batch, 0):
                now = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype), minlength=len(counts))
                now[: len(counts)] += counts
                counts = now
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], schema=schema)

    return tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def _blocks(batches: Iterator[pa.RecordBatch], rank: np.ndarray, dtype: np.dtype, block_ids: int) -> Iterator[bytes]:
    """Blocks of (key, ids) rows in their order."""
    keys, ids, size, number = [], [], 0, 0

    def block() -> bytes:
        flat = np.frombuffer(b"".join(ids), dtype)
        control, data = pack(rank[flat])
        known = np.array([k is not None for k in keys], np.uint8)
        named = np.array([0 if k is None else k for k in keys], "<i8")
        counts = np.array([len(x) // dtype.itemsize for x in ids], "<u8")
        body = b"".join(x.tobytes() for x in (named, counts, known, control, data))
        head = (MAGIC, TaskContext.get().partitionId(), number, len(keys), len(flat), len(data), crc32(body))
        return np.array(head, "<u8").tobytes() + body

    for batch in batches:
        for k, x in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            keys.append(k)
            ids.append(x)
            size += len(x) // dtype.itemsize
            if size >= block_ids:
                yield block()
                keys, ids, size, number = [], [], 0, number + 1
    if keys:
        yield block()


def write(
    docs: DataFrame, folder: str, vocabulary: str, end: int = 1, key: str = "doc_id", text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of all texts below ``folder``, in ascending order of the key.

    ``blocks``: the files, in the order of their names. ``ranking``: (number, id, count), at
    most as many rows as the vocabulary. ``manifest``: (part, block, docs, ids, start) of
    every block, start being the number of ids before it.

    Null texts are empty texts: their end id only. Null keys come first; equal keys go by
    number and checksum of their ids (as stored); repeated rows are documents of their own. An empty
    table gives files without blocks. Other columns are not read. A text may have any
    length up to what fits a row.
    """
    spark = docs.sparkSession
    path = session.scratch_path(spark, "tokens")
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    dtype = id_type(Tokenizer.from_str(spec))
    coded = encode(docs, spec, end, key, text)
    coded.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(coded.schema).parquet(path)

    counted = frequencies(tokens, dtype).toPandas().sort_values(["count", "id"], ascending=[False, True])  # the vocabulary at most
    ids = counted["id"].to_numpy(np.int64)
    spark.createDataFrame(pa.table({
        "number": np.arange(len(ids)), "id": ids, "count": counted["count"].to_numpy(np.int64)})).coalesce(1).write.parquet(f"{folder}/ranking")
    rank = np.zeros(ids.max(initial=0) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    sent = spark.sparkContext.broadcast(rank)
    schema = arrow_schema("block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, sent.value, dtype, block_ids):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], schema=schema)

    order = ["key", "n", F.crc32("ids"), "row"]  # the row splits the copies of one document
    blocks = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids").mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{folder}/blocks")

    heads = _read(spark, folder, lambda head, _: [(int(head[1]), int(head[2]), int(head[3]), int(head[4]))],
                  "part long, block long, docs long, ids long")
    heads = heads.withColumn("within", F.sum("ids").over(
        Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition.
    parts = heads.groupBy("part").agg(F.sum("ids").alias("whole")).select("part", F.sum("whole").over(before).alias("before"))
    heads.join(parts, "part").select(
        "part", "block", "docs", "ids", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("start")
    ).write.parquet(f"{folder}/manifest")


def _read(spark: SparkSession, folder: str, derive: Callable[[np.ndarray, memoryview], list[tuple]], ddl: str) -> DataFrame:
    """Rows that ``derive`` makes of header and body of every block. A damaged block is an error."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file, at = memoryview(content.as_buffer()), 0
                while at < len(file):
                    head = np.frombuffer(file, "<u8", HEADER, at)
                    docs, ids, data = (int(x) for x in head[3:6])
                    size = 17 * docs + -(-ids // 4) + data
                    body = file[at + 8 * HEADER : at + 8 * HEADER + size]
                    if head[0] != MAGIC or len(body) != size or crc32(body) != head[6]:
                        raise ValueError(f"damaged block at byte {at}")
                    columns = zip(*derive(head, body), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    at += 8 * HEADER + size + 1  # the writer's newline

    files = spark.read.format("binaryFile").load(f"{folder}/blocks")
    return files.select("content").mapInArrow(run, ddl)


def read(
    spark: SparkSession, folder: str, derive: Callable[[np.ndarray], tuple], schema: str, key: str = "doc_id",
) -> DataFrame:
    """(key, start, n_tokens, ...) of every document in the files below ``folder``.

    ``derive(ids)`` gives the values of the columns that ``schema`` lists from a document's
    ids, unsigned 32-bit numbers in little-endian order with the end id. start: the number of
    ids of all documents before it.
    """
    # The vocabulary at most.
    ranking = spark.read.parquet(f"{folder}/ranking").orderBy("number").toPandas()["id"].to_numpy("<u4")
    sent = spark.sparkContext.broadcast(ranking)

    def rows(head: np.ndarray, body: memoryview) -> list[tuple]:
        docs, count = int(head[3]), int(head[4])
        keys, counts = np.frombuffer(body, "<i8", docs), np.frombuffer(body, "<u8", docs, 8 * docs).astype(np.int64)
        known = np.frombuffer(body, np.uint8, docs, 16 * docs)
        control = np.frombuffer(body, np.uint8, -(-count // 4), 17 * docs)
        numbers = unpack(control, np.frombuffer(body, np.uint8, offset=17 * docs + len(control)), count)
        ids, ends = sent.value[numbers], np.cumsum(counts)
        place = (int(head[1]), int(head[2]))
        return [
            (*place, name if is_known else None, end - n, n, *derive(ids[end - n : end]))
            for name, is_known, end, n in zip(keys.tolist(), known.tolist(), ends.tolist(), counts.tolist(), strict=True)]

    found = _read(spark, folder, rows, f"part long, block long, __key long, __inner long, n_tokens long, {schema}")
    starts = spark.read.schema("part long, block long, start long").parquet(f"{folder}/manifest")
    more = [c for c in found.columns[5:]]
    return found.join(starts, ["part", "block"]).select(
        F.col("__key").alias(key), (F.col("start") + F.col("__inner")).alias("start"), "n_tokens", *more)
