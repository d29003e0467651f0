"""Token ids in a compact block format: patched frame of reference.

Documents are sorted by id over ranges, encoded, and packed into segments of whole documents. A
segment is one binary value; a token file is a Parquet file of segments, so Spark's own commit
protocol makes writing safe against lost executors on any file system. A segment holds

    header   magic, number of documents, of ids, of blocks, of exceptions (5 x u32)
    doc ids  i64 each, preceded by one validity byte each; number of ids of each document, u32
    index    per block: minimum u32, width u8, byte offset of the packed values u32,
             number of the first exception u32 (both with a closing entry)
    packed   per block: 128 values less the minimum, `width` bits each, lowest bit first
    patches  per exception: place in its block u8, value less the minimum u32

The width of a block is that of the value at a percentile; larger values are exceptions, whose
low bits are packed and whose full value is patched in. The index lets any block be read alone.

Results: a null or empty text is a document without ids besides the end id. Rows with a null
doc_id come first; rows with equal doc_id follow each other in the order of their texts' hashes.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pantryline.llm.bpe import LETTERS, NUMBERS, byte_characters, vocabulary_path
from pantryline.llm.common import batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 128
PERCENTILE = 0.9
#: A segment is closed once it holds this many ids; a document is never split.
SEGMENT_IDS = 1 << 18
#: Entries of each half of the two caches of a worker.
CHUNK_CACHE, PIECE_CACHE = 400_000, 100_000
#: Bytes of texts that are encoded together.
ENCODED_BYTES = 8 << 20
MAGIC = 0x31524650

#: Texts of these characters only are split here by the same classes as in the library.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-į]*")
WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"
)
#: What often follows a word; not the apostrophe, which may begin an ending.
MARKS = ".,;:!?"
#: A space next to other white space.
WHITE = " \t\n\r"
SPACE_RUNS = [" " + c for c in WHITE] + [c + " " for c in WHITE[1:]]


# --- the block format ---------------------------------------------------------------------------


def widths_of(values: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def pack(columns: np.ndarray, width: int) -> np.ndarray:
    """(128, n) values of `width` bits as (n, 4 * width) words of 32 bits, lowest bit first."""
    words = np.zeros((4 * width, columns.shape[1]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 32)
        value = columns[i] << np.uint64(shift)
        words[word] |= value & np.uint64(0xFFFFFFFF)
        if shift + width > 32:
            words[word + 1] |= value >> np.uint64(32)
    return np.ascontiguousarray(words.astype("<u4").T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of `pack`: (n, 4 * width) words as (128, n) values."""
    columns = words.T.astype(np.uint64)
    out = np.zeros((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 32)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 32:
            value |= columns[word + 1] << np.uint64(32 - shift)
        out[i] = value & mask
    return out


def encode_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, int, int]:
    """(index, packed values and patches) of unsigned 32-bit ids, the number of blocks and of exceptions."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return b"", 0, 0
    full = np.full(n_blocks * BLOCK, ids[-1], np.uint32)  # the last block is filled up with its last id
    full[: len(ids)] = ids
    full = full.reshape(n_blocks, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = widths_of(np.partition(rest, at, axis=1)[:, at])
    over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width >= 32] = False
    block, place = np.nonzero(over)
    offsets = np.concatenate([[0], np.cumsum(16 * width.astype(np.int64))])
    if offsets[-1] >= 1 << 32:
        raise ValueError("too many ids for one segment")
    packed = np.zeros(offsets[-1] // 4, "<u4")
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            words = pack((rest[which] & np.uint32((1 << int(w)) - 1)).T.astype(np.uint64), int(w))
            packed[(offsets[which] // 4)[:, None] + np.arange(4 * int(w))] = words
    first = np.concatenate([[0], np.cumsum(over.sum(axis=1))])
    parts = [
        least.astype("<u4"), width, offsets.astype("<u4"), first.astype("<u4"),
        packed, place.astype(np.uint8), rest[block, place].astype("<u4"),
    ]
    return b"".join([p.tobytes() for p in parts]), n_blocks, len(block)


def decode_ids(data: memoryview, n: int, n_blocks: int, n_over: int, blocks: slice = slice(None)) -> np.ndarray:
    """The ids, or those of a slice of blocks."""
    take = _Taker(data)
    least, width = take("<u4", n_blocks), take(np.uint8, n_blocks)
    offsets, first = take("<u4", n_blocks + 1 if n_blocks else 0), take("<u4", n_blocks + 1 if n_blocks else 0)
    if not n_blocks:
        return np.zeros(0, np.uint32)
    packed = take("<u4", int(offsets[-1]) // 4)
    place, value = take(np.uint8, n_over), take("<u4", n_over)
    start, stop, _ = blocks.indices(n_blocks)
    wide = width[start:stop]
    rest = np.zeros((stop - start, BLOCK), np.uint32)
    for w in np.unique(wide):
        if w:
            which = np.nonzero(wide == w)[0]
            words = packed[(offsets[start + which] // 4).astype(np.int64)[:, None] + np.arange(4 * int(w))]
            rest[which] = unpack(words, int(w)).T.astype(np.uint32)
    counts = np.diff(first[start : stop + 1].astype(np.int64))
    some = slice(int(first[start]), int(first[stop]))
    rest[np.repeat(np.arange(stop - start), counts), place[some]] = value[some]
    ids = (rest + least[start:stop, None]).reshape(-1)
    return ids[: max(0, n - start * BLOCK)]


class _Taker:
    """Takes arrays from a buffer one after another."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def __call__(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out


def encode_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    body, n_blocks, n_over = encode_ids(ids)
    header = np.array([MAGIC, len(doc_ids), len(ids), n_blocks, n_over], "<u4")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([header.tobytes(), known.tobytes(), numbers.tobytes(), np.array(counts, "<u4").tobytes(), body])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, all ids)."""
    take = _Taker(memoryview(data))
    magic, n_docs, n, n_blocks, n_over = map(int, take("<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    known, numbers, counts = take(np.uint8, n_docs), take("<i8", n_docs), take("<u4", n_docs)
    ids = decode_ids(take.data[take.at :], n, n_blocks, n_over)
    return [int(d) if k else None for k, d in zip(known, numbers, strict=True)], counts, ids


# --- encoding texts -----------------------------------------------------------------------------


class Recent:
    """What was met lately: when the new half is full it becomes the old one, and what is met there moves back.

    So frequent words stay, and at most twice `size` entries are held.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, word: str) -> bytes | None:
        known = self.new.get(word)
        if known is None and (known := self.old.get(word)) is not None:
            self.keep(word, known)
        return known

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids


class ByteBpe:
    """Ids of texts from the tokenizers library, as little-endian unsigned 32-bit integers.

    The file splits a text by a pattern and merges within the pieces only, and no piece goes on past a
    single space. So texts of common Latin characters are cut at those, the chunks looked up, and new
    pieces merged by the library's model; any other text, or one with a special token in it, goes to
    the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {i: c for i, c in enumerate(byte_characters())}
        self.chunks, self.pieces = Recent(CHUNK_CACHE), Recent(PIECE_CACHE)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, marks: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(marks)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.find(piece)
        if known is None:
            known = self.pieces.keep(piece, self._merged(piece.encode().decode("latin-1").translate(self.letters)))
        return known

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it."""
        known = self.chunks.find(chunk)
        if known is not None:
            return known
        word = chunk.rstrip(MARKS)
        if not (word.isascii() and word.isalpha()):
            ids = self._pieces(" " + chunk)
        elif len(word) < len(chunk):  # the marks after a word are a piece of their own
            ids = self._chunk(word) + self._piece(chunk[len(word) :])
        else:  # letters are one piece, and ASCII letters stand for themselves
            ids = self._merged(self.letters[ord(" ")] + chunk)
        return self.chunks.keep(chunk, ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in WORDS.findall(text)])

    def _unsplit(self, text: str) -> bytes | None:
        """Ids of a text that can't be cut at its spaces; None for one that can."""
        if not text:
            return b""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        if text[0] in WHITE or text[-1] in WHITE or any(run in text for run in SPACE_RUNS):
            return self._pieces(text)
        return None

    def encode(self, text: str | None) -> bytes:
        known = self._unsplit(text or "")
        if known is not None:
            return known
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join([self._chunk(c) for c in rest])

    def encode_all(self, texts: list[str | None], last: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids in a row); `last` is appended to every text.

        Arrow cuts the texts at their spaces and numbers the different chunks, so each is looked up
        once, and numpy puts their ids in place. What comes before a text's first space, or a text that
        can't be cut, is a chunk of its own.
        """
        alone = [self._unsplit(t or "") for t in texts]
        cut = pa.array([t if ids is None else "" for t, ids in zip(texts, alone, strict=True)], pa.large_string())
        listed = pc.split_pattern(cut, " ")
        numbered = listed.values.dictionary_encode()
        chunks = numbered.dictionary.to_pylist()
        starts = np.asarray(listed.offsets)[:-1]
        leading = listed.values.take(pa.array(starts)).to_pylist()
        own = [self._pieces(word) if ids is None else ids for word, ids in zip(leading, alone, strict=True)]
        places = np.array(numbered.indices, np.int64)
        places[starts] = len(chunks) + np.arange(len(texts))
        # A chunk that only begins texts has no space before it and isn't looked up.
        used = np.zeros(len(chunks) + len(texts) + 1, bool)
        used[places] = True
        found = [self._chunk(c) if u else b"" for c, u in zip(chunks, used.tolist())] + own + [last]
        places = np.insert(places, np.asarray(listed.offsets)[1:], len(found) - 1)
        sizes = np.array([len(f) for f in found], np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        counts = sizes[places]
        ends = np.cumsum(counts)
        at = np.repeat(begins[places] - (ends - counts), counts)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        until = np.concatenate([[0], ends])[np.asarray(listed.offsets)[1:] + np.arange(1, len(texts) + 1)]
        return np.diff(until, prepend=0), ids


@functools.cache
def byte_bpe(name: str = VOCABULARY) -> ByteBpe:
    """One encoder per worker process and file."""
    return ByteBpe(vocabulary_path(name))


# --- files --------------------------------------------------------------------------------------


def _stretches(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Neighbouring rows of about `limit` bytes together, a longer text by itself."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    cuts = [0]
    while cuts[-1] < len(ends):
        before = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, before + limit, "right"))))
    return list(zip(cuts, cuts[1:]))


def write_tokens(
    docs: DataFrame, path: str, ranges: int, vocabulary: str = VOCABULARY, end_id: int = END_ID,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Write the ids of all documents in ascending doc_id order to token files below `path`.

    Columns: part (number of the range), seq, first (ids of the range before the segment), n_ids, data.
    One shuffle by ranges of doc_id; the row number in the scan only spreads rows equal otherwise.
    """

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe, end = byte_bpe(vocabulary), int(end_id).to_bytes(4, "little")
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, pieces, n = [], [], [], 0
        for batch in parts:
            for a, b in _stretches(batch.column(1), ENCODED_BYTES):
                some = batch.slice(a, b - a)
                numbers, own = some.column(0).to_pylist(), bpe.encode_all(some.column(1).to_pylist(), end)
                at, ends = 0, np.cumsum(own[0])
                while at < len(numbers):
                    before = int(ends[at - 1]) if at else 0
                    # Up to the document that closes the segment, or all of them.
                    to = min(int(np.searchsorted(ends, before + segment_ids - n)) + 1, len(numbers))
                    doc_ids += numbers[at:to]
                    counts += own[0][at:to].tolist()
                    pieces.append(own[1][before : int(ends[to - 1])])
                    n += len(pieces[-1])
                    at = to
                    if n >= segment_ids:
                        yield part, seq, first, n, encode_segment(doc_ids, counts, np.concatenate(pieces))
                        seq, first = seq + 1, first + n
                        doc_ids, counts, pieces, n = [], [], [], 0
        if doc_ids:
            yield part, seq, first, n, encode_segment(doc_ids, counts, np.concatenate(pieces))

    order = ["doc_id", "__hash", "__row"]
    sorted_docs = (
        docs.select("doc_id", "text")
        .withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
        .repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    names = ["part", "seq", "first", "n_ids", "data"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    sorted_docs.mapInArrow(
        lambda parts: batches(segments(parts), names, types, 4), "part int, seq int, first long, n_ids long, data binary"
    ).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of the token files: doc_id, start, n_tokens, ids (binary, on request), ids_crc32.

    Ranges are summed up to where each begins: one row per range. Segments know their place in the
    range, so no order over all segments is needed.
    """
    schema = "part int, seq int, first long, n_ids long, data binary"
    segments = spark.read.schema(schema).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        segments.groupBy("part")
        .agg(F.sum("n_ids").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    # At most one row per range, of which there are as many as `write_tokens` was told.
    placed = segments.join(F.broadcast(starts), "part").select((F.col("base") + F.col("first")).alias("start"), "data")

    def documents(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in parts:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, counts, ids = decode_segment(data.as_py())
                raw, at = ids.astype("<u4").tobytes(), 0
                for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
                    own = raw[4 * at : 4 * (at + n)]
                    yield doc_id, start + at, n, own if with_ids else None, zlib.crc32(own)
                    at += n

    names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    out = placed.mapInArrow(
        lambda parts: batches(documents(parts), names, types, 512 if with_ids else 4096),
        "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long",
    )
    return out if with_ids else out.drop("ids")
