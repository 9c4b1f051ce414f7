"""Token ids in files, compressed by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole
documents and is coded on its own: its tokens are dealt to interleaved lanes, which a step
codes together. Every so many steps a checkpoint keeps the states of all lanes and the place
in the stream, so that a decoder may begin there; each checkpoint's tokens and the whole block
have checksums.

A folder holds ``table`` (the frequencies), ``blocks`` (binary files, a block after the other,
each followed by a line feed) and ``index`` (Parquet: tokens before each part). Parts are
ranges of document ids, in ascending order.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.llm.common import tokenizer_path
from vitrina.session import input_bytes, materialize, shuffle_partitions, spread

LANES = 1024
# Steps between checkpoints: as many tokens as this times the lanes.
STEPS = 128
# Tokens after which a block ends with the document it is in.
BLOCK_TOKENS = 1 << 19
BLOCKS_PER_FILE = 16
PART_BYTES = 256 << 20
# Words whose ids a task remembers.
CACHED_WORDS = 1 << 19

# Fixed value: the pieces of a word in lower case, for the tokenizer with word ends.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
# Signs between a letter or digit and white space: a piece of their own in any text.
_LAST_SIGNS = r"([a-z0-9])([!-&(-/:-@\[-`{-~]+)([\x20\x09-\x0D])"
# States lie between 2**31 and 2**63; a lane gives or takes 32 bits at a time.
_LOWEST = np.uint64(1 << 31)
_WORD_BITS = np.uint64(32)
_MAGIC = b"RANSTOK1"
# Magic, bytes of the block, part, number in the part, documents, tokens, tokens before it in the part, words, table checksum.
_HEAD = struct.Struct("<8sQIIIQQQI")


class Words:
    """Ids of whole texts from the lower-casing tokenizer with word ends, which never joins text across white space.

    The words of a batch are looked up once each; the library encodes those not met before.
    A word of printable ASCII and letters of Latin-1, without an added token, is cut into its
    pieces here for the library's model; other words go through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        added = "|".join(map(re.escape, self._added)) or "(?!)"
        self._plain = re.compile(rf"(?!.*(?:{added}))[!-~À-ÖØ-öø-ÿ]*")
        # The printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on.
        visible = sorted(map(ord, ByteLevel.alphabet()))
        own = {c for c in visible if c < 256}
        others = iter(c for c in visible if c >= 256)
        self._shown = [chr(b if b in own else next(others)) for b in range(256)]
        self.vocabulary = self._library.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[str, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._ends = np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        plain, cut, model = self._plain.fullmatch, _PIECE.findall, self._model.tokenize
        found = []
        for word in words:
            if plain(word):
                word = word.lower()
                shown = word if word.isascii() else None
                found.append([
                    t.id for piece in cut(word)
                    for t in model(piece if shown else "".join(self._shown[b] for b in piece.encode()))
                ])
            else:
                found.append(self._library.encode(word, add_special_tokens=False).ids)
        return found

    def _slots(self, words: list[str]) -> np.ndarray:
        """Place of each word's ids."""
        if len(self._slot) > CACHED_WORDS:
            self._forget()
        slot = self._slot
        fresh = [w for w in words if w not in slot]
        if fresh:
            ids = self._encoded(fresh)
            slot.update(zip(fresh, range(len(slot), len(slot) + len(fresh))))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
            self._ids = np.concatenate([self._ids, flat])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(i) for i in ids])])
        return np.array([slot[w] for w in words], np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end); every text ends with ``end_id``."""
        whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
        if not any(pc.any(pc.match_substring(whole, t[:2])).as_py() for t in self._added):
            # Fewer different words: in lower case, and parted from the signs that end them.
            whole = pc.replace_substring_regex(pc.ascii_lower(whole), _LAST_SIGNS, r"\1 \2\3")
        parts = pc.ascii_split_whitespace(whole)
        coded = parts.flatten().dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        first, size = self._ends[slots], self._ends[slots + 1] - self._ends[slots]
        before = np.concatenate([[0], np.cumsum(size)])
        ends = before[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])]
        n = len(ends) - 1
        # Each text's ids move on by the end ids before them.
        ends += np.arange(n + 1)
        out = np.empty(int(ends[-1]), np.uint32)
        own = np.ones(len(out), bool)
        own[ends[1:] - 1] = False
        out[~own] = end_id
        out[own] = self._ids[np.arange(before[-1]) + np.repeat(first - before[:-1], size)]
        return out, ends


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids): the ids of every whole text, little-endian, two bytes each if the vocabulary allows."""
    kind = id_type(Words(path).vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            ids, bounds = words.encode(batch.column(1), end_id)
            raw = pa.py_buffer(ids.astype(kind).tobytes())
            places = pa.py_buffer((bounds * np.dtype(kind).itemsize).astype(np.int64).tobytes())
            blobs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, places, raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds), pa.int64()), blobs.cast(pa.binary())], names=["doc_id", "n", "ids"]
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, n long, ids binary")


class Table:
    """Frequencies of the ids, as shares of a power of two; every id that occurs has one."""

    def __init__(self, shares: np.ndarray) -> None:
        self.shares = shares.astype(np.uint64)
        self.bits = int(self.shares.sum()).bit_length() - 1
        self.before = np.concatenate([[0], np.cumsum(shares)])[:-1].astype(np.uint64)
        self.checksum = zlib.crc32(shares.astype("<u4").tobytes())

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        bits = max(16, (len(counts) - 1).bit_length() + 4)
        present, total = int((counts > 0).sum()), int(counts.sum())
        if not total:
            return cls(np.array([1 << bits]))
        # Rounded down beside one for each id that occurs; the most frequent takes the rest.
        room = (1 << bits) - present
        shares = np.array([int(c) * room // total + 1 if c else 0 for c in counts.tolist()], np.int64)
        shares[int(np.argmax(counts))] += (1 << bits) - int(shares.sum())
        return cls(shares)

    @property
    def slots(self) -> np.ndarray:
        """The id of every slot."""
        if not hasattr(self, "_slots"):
            self._slots = np.repeat(np.arange(len(self.shares), dtype=np.uint32), self.shares.astype(np.int64))
        return self._slots


def compress(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place of each checkpoint, states of each checkpoint); decoding runs forward."""
    n = len(ids)
    steps = -(-n // LANES)
    share, before = table.shares[ids], table.before[ids]
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    states = np.full(LANES, _LOWEST)
    given: list[np.ndarray] = []
    total, places, kept = 0, [], []
    for step in range(steps - 1, -1, -1):
        a, b = step * LANES, min((step + 1) * LANES, n)
        x, f = states[:b - a], share[a:b]
        full = x >= f << room
        if full.any():
            given.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            total += len(given[-1])
            x = np.where(full, x >> _WORD_BITS, x)
        high, low = np.divmod(x, f)
        states[:b - a] = (high << bits) + low + before[a:b]
        if step % STEPS == 0:
            places.append(total)
            kept.append(states.copy())
    words = np.concatenate(given[::-1]) if given else np.zeros(0, "<u4")
    return words, total - np.array(places[::-1], np.int64), np.array(kept[::-1], np.uint64).reshape(-1, LANES)


def expand(words: np.ndarray, place: int, states: np.ndarray, n: int, table: Table) -> np.ndarray:
    """``n`` ids from a checkpoint on."""
    bits, mask, slots = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), table.slots
    out = np.empty(n, np.uint32)
    states = states.astype(np.uint64)
    for a in range(0, n, LANES):
        b = min(a + LANES, n)
        x = states[:b - a]
        slot = x & mask
        ids = slots[slot]
        out[a:b] = ids
        x = table.shares[ids] * (x >> bits) + slot - table.before[ids]
        low = x < _LOWEST
        k = int(np.count_nonzero(low))
        if k:
            x[low] = (x[low] << _WORD_BITS) | words[place:place + k]
            place += k
        states[:b - a] = x
    return out


class Block:
    """Documents of a block, and its ids in pieces of one checkpoint each."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        magic, size, self.part, self.number, docs, self.tokens, self.first, words, self.table = _HEAD.unpack_from(data, at)
        if magic != _MAGIC or zlib.crc32(data[at:at + size - 4]) != struct.unpack_from("<I", data, at + size - 4)[0]:
            raise ValueError("a block of token ids is damaged")
        self.size, at = size, at + _HEAD.size
        checkpoints = -(-self.tokens // (LANES * STEPS))

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, n, at)
            at += values.nbytes
            return values

        self.doc_ids, self.present, self.sizes = column("<i8", docs), column("u1", docs).astype(bool), column("<i8", docs)
        self.places, self.checksums = column("<i8", checkpoints), column("<u4", checkpoints)
        self.states = column("<u8", checkpoints * LANES).reshape(-1, LANES)
        self.words = column("<u4", words)

    @staticmethod
    def packed(part: int, number: int, first: int, doc_ids: list, sizes: list[int], ids: np.ndarray, table: Table) -> bytes:
        words, places, states = compress(ids, table)
        sums = [zlib.crc32(ids[i:i + LANES * STEPS].astype("<u4").tobytes()) for i in range(0, len(ids), LANES * STEPS)]
        body = b"".join(x.tobytes() for x in (
            np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is not None for i in doc_ids], "u1"), np.array(sizes, "<i8"),
            places.astype("<i8"), np.array(sums, "<u4"), states.astype("<u8"), words.astype("<u4"),
        ))
        head = _HEAD.pack(_MAGIC, _HEAD.size + len(body) + 4, part, number, len(doc_ids), len(ids), first, len(words), table.checksum)
        return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))

    def piece(self, checkpoint: int, table: Table) -> np.ndarray:
        """The ids from one checkpoint to the next."""
        if table.checksum != self.table:
            raise ValueError("a block of token ids was written with another table")
        n = min(LANES * STEPS, self.tokens - checkpoint * LANES * STEPS)
        ids = expand(self.words, int(self.places[checkpoint]), self.states[checkpoint], n, table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.checksums[checkpoint]:
            raise ValueError("token ids of a block are damaged")
        return ids

    def between(self, start: int, stop: int, table: Table) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block; decoding begins at the checkpoint before them."""
        piece = LANES * STEPS
        found = [self.piece(c, table) for c in range(start // piece, -(-stop // piece))]
        first = start // piece * piece
        return np.concatenate(found)[start - first:stop - first] if found else np.zeros(0, np.uint32)

    def ids(self, table: Table) -> np.ndarray:
        return self.between(0, self.tokens, table)


def blocks_of(data: bytes) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at += block.size + 1


def _counts(stored: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; a task gives one row for each id it has, the driver gets one for each of the vocabulary."""
    kind = id_type(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            counts += np.bincount(ids, minlength=vocabulary)
        present = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), pa.array(counts[present], pa.int64())], names=["id", "n"])

    found = stored.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for i, n in found.collect():
        counts[i] = n
    return counts


def _binary_files(rows: DataFrame, path: str, per_file: int) -> None:
    """Write a column of bytes as files; Spark's text writer copies bytes as they are and adds a line feed to each row."""
    value = F.col(rows.columns[0]).cast("string").alias("value")
    rows.select(value).write.option("maxRecordsPerFile", per_file).text(path)


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the ids in ascending order of document ids.

    A null or empty text is a document of the end id alone. Rows without an id come first;
    rows with one id follow each other by number of ids and checksum, and a third of all rows
    may share an id, as ranges cut between rows. Other columns are ignored whatever their
    names; an empty table gives a folder without documents. Strings of added tokens in a text
    are those tokens, as the library has it. Texts are read and encoded once, into a table of
    ids; only ids are shuffled, once, by ranges. No row may exceed Spark's limit of 2 GB.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    vocabulary = Words(tokenizer).vocabulary
    kind = id_type(vocabulary)
    found = encoded(docs, tokenizer, end_id, key, text)
    stored = materialize(
        found.withColumn("crc", F.crc32("ids")).withColumn("at", F.monotonically_increasing_id()), "token-ids"
    )
    shares = Table.of(_counts(stored, vocabulary)).shares
    blob = shares.astype("<u4").tobytes()
    _binary_files(spark.createDataFrame([(bytearray(blob),)], "shares binary").coalesce(1), f"{path}/table", 1)
    parts = max(shuffle_partitions(spark), -(-input_bytes(stored) // PART_BYTES))
    order = ["doc_id", "n", "crc", "at"]
    ranged = stored.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table(shares), TaskContext.get().partitionId()
        number = first = waiting = 0
        doc_ids: list = []
        blobs: list[bytes] = []

        def closed() -> pa.RecordBatch:
            nonlocal number, first, waiting, doc_ids, blobs
            ids = np.frombuffer(b"".join(blobs), kind)
            block = Block.packed(part, number, first, doc_ids, [len(b) // ids.itemsize for b in blobs], ids, table)
            number, first, waiting, doc_ids, blobs = number + 1, first + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                doc_ids.append(doc_id)
                blobs.append(blob)
                waiting += len(blob) // np.dtype(kind).itemsize
                if waiting >= BLOCK_TOKENS:
                    yield closed()
        if blobs:
            yield closed()

    _binary_files(ranged.mapInArrow(run, "block binary"), f"{path}/blocks", BLOCKS_PER_FILE)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [(b.part, b.tokens) for b in blocks_of(content.as_py())]
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "tokens"])

    # One row per part: as many as the range shuffle has partitions.
    sums = _content(spark, f"{path}/blocks").mapInArrow(checked, "part long, tokens long").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a written folder, checksums compared.

    ``start`` is the number of ids of all documents before it, ``ids`` are little-endian
    unsigned 32-bit integers. Files are decoded independently of each other.
    """
    content = _content(spark, f"{path}/table").first()[0]
    shares = np.frombuffer(bytes(content)[:-1], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shares)
        for batch in batches:
            for content in batch.column(0):
                for block in blocks_of(content.as_py()):
                    raw = pa.py_buffer(block.ids(table).astype("<u4").tobytes())
                    ends = np.concatenate([[0], np.cumsum(block.sizes)])
                    places = pa.py_buffer((4 * ends).astype(np.int64).tobytes())
                    n = len(block.sizes)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, block.part), pa.int64()), pa.array(block.doc_ids, pa.int64(), mask=~block.present),
                        pa.array(block.first + ends[:-1], pa.int64()), pa.array(block.sizes, pa.int64()),
                        pa.Array.from_buffers(pa.large_binary(), n, [None, places, raw]).cast(pa.binary()),
                    ], names=["part", "doc_id", "inside", "n_tokens", "ids"])

    found = _content(spark, f"{path}/blocks").mapInArrow(run, "part long, doc_id long, inside long, n_tokens long, ids binary")
    index = spark.read.schema("part long, before long").parquet(f"{path}/index")
    # One row per part is broadcast.
    return found.join(F.broadcast(index), "part").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )
