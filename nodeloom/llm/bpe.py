"""BPE encoding and decoding through a table of distinct words.

Texts are split once, where they lie, a block of documents at a time: what leaves the task is the block's distinct words
and, per text, their numbers in place. The words go to the partition that owns them, where every distinct word is
encoded once for all blocks; a block gets its words' ids back, and the pieces of these ids by a join with the id-to-piece
table; the numbers of each text pick them up.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodeloom.llm._shared import give_back, n_partitions, trimmed, written

#: The byte-level pre-tokenizer's pattern (fixed value), white space spelled out as the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
BLOCK_BYTES = 24 << 20
PAGE = 1024  # ids of one row of the piece table, where blocks join it


class Splitter:
    """A tokenizer's words; all that splitting needs of its file are the special strings (string -> id)."""

    def __init__(self, special: dict[str, int]):
        import regex

        self.special = special
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None

    def split(self, text: str) -> list[str]:
        if self.cut and any(x in text for x in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.words.findall(part))]
        return self.words.findall(text)


class Encoder:
    """The tokenizers library's encoder of a file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]


class Vocabulary:
    """A byte-level BPE tokenizer file: its special strings, and the table id -> piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        to_byte = {c: b for b, c in byte_letters().items()}
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()


def byte_letters() -> dict[int, str]:
    """byte -> the letter that stands for it: printable bytes for themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pack(values: list[bytes]) -> bytes:
    """Byte strings as one compressed cell: their number, their lengths, their bytes."""
    lengths = np.fromiter(map(len, values), np.uint32, len(values))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(values)).tobytes() + lengths.tobytes() + b"".join(values))


def _unpack(cell: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    out, start = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[start:end])
        start = end
    return out


def _split(special: dict[str, int], owners: int):
    """Per block of texts (whole rows, about BLOCK_BYTES): one row per owner of words, with the block's distinct ones and
    their numbers (differences), and one row per text, with the numbers in place. A word's number is its rank by frequency.

    Ids are copied out of their batch, as a column of it would keep the texts too."""

    def rows(block: int, kind: pa.DataType, ids: list[pa.Array], texts: list[np.ndarray], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(len(words), np.int64)
        for t in texts:
            np.add.at(often, t, 1)
        number = np.empty(len(words), np.uint32)  # by frequency, which packs best
        number[np.argsort(-often, kind="stable")] = np.arange(len(words), dtype=np.uint32)
        listed = list(words)
        words.clear()
        owner = np.fromiter((zlib.crc32(w.encode()) for w in listed), np.uint32, len(listed)) % owners
        order = np.lexsort((number, owner))
        cut = np.searchsorted(owner[order], np.arange(owners + 1))
        some = [o for o in range(owners) if cut[o + 1] > cut[o]]
        own = [order[cut[o] : cut[o + 1]] for o in some]
        yield _rows(pa.nulls(len(some), kind), block, pa.array(some, pa.int32()), [_pack([listed[n].encode() for n in x.tolist()]) for x in own], [_pack_numbers(np.diff(number[x], prepend=np.uint32(0))) for x in own])
        del listed, owner, order, own
        at = 0
        for given in ids:
            cells = [_pack_numbers(number[t]) for t in texts[at : at + len(given)]]
            at += len(given)
            yield _rows(given, block, pa.nulls(len(given), pa.int32()), cells, [None] * len(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, block = Splitter(special), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        texts: list[np.ndarray] = []
        words: dict[str, int] = _Numbers()
        size, kind = 0, None
        for batch in batches:
            given, start = _copied(batch.column(0)), 0
            kind = given.type
            give_back()  # the batch before
            for n, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                found = voc.split(text)
                texts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                size += len(text)
                if size >= BLOCK_BYTES:
                    ids.append(given.slice(start, n + 1 - start))
                    yield from rows(block, kind, ids, texts, words)
                    ids, texts, words, size, start, block = [], [], _Numbers(), 0, n + 1, block + 1
                    give_back()
            if start < len(given):
                ids.append(given.slice(start))
            batch = text = None
        if texts:
            yield from rows(block, kind, ids, texts, words)

    return run


def _copied(column: pa.Array) -> pa.Array:
    """The column in memory of its own."""
    return column.take(pa.array(np.arange(len(column))))


class _Numbers(dict):
    """A number for each new key."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _rows(ids: pa.Array, block: int, owner: pa.Array, cells: list[bytes], numbers: list[bytes | None]) -> pa.RecordBatch:
    columns = [ids, pa.array([block] * len(cells), pa.int64()), owner, pa.array(cells, pa.binary()), pa.array(numbers, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["i", "block", "owner", "cell", "numbers"])


def _pack_numbers(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, byte by byte of all, as one compressed cell."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_numbers(cell: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _split that hold words. (A task of Spark's own would push the filter below the exchange, and undo its reuse.)"""
    for batch in batches:
        kept = batch.filter(batch.column(2).is_valid())
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in (2, 1, 3)], names=["owner", "block", "cell"])


_ANSWER = "block long, owner int, ends binary, ids binary, used array<int>"


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, page): the pages of the piece table that a block uses, from the rows of _encode, which a task has all of for its
    blocks; a task of its own for the same reason."""
    pages: dict[int, set[int]] = {}
    for batch in batches:
        for block, used in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            pages.setdefault(block, set()).update(used)
    rows = [(b, p) for b, own in pages.items() for p in sorted(own)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32()))], names=["b", "page"])


def _encode(path: str, special: dict[str, int]):
    """Per owner and block: the ids of the words that the block asked for, in its order, and the pages that these are on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, known = encoder(path), {}
        owner = None
        for batch in batches:
            for own, block, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if own != owner:
                    owner, known = own, {}
                words = _unpack(cell.as_py())
                new = [w for w in words if w not in known]
                plain = [w.decode() for w in new]
                for w, s, x in zip(new, plain, voc.encode(plain)):
                    known[w] = [special[s]] if s in special else x
                found = [known[w] for w in words]
                ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                ids = np.fromiter((i for x in found for i in x), np.uint32, int(ends[-1]) if len(ends) else 0)
                cells = ([block], [owner], [_pack_numbers(np.diff(ends, prepend=0))], [_pack_numbers(ids)], [np.unique(ids // PAGE).astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())))], names=["block", "owner", "ends", "ids", "used"])

    return run


def _assemble(kind: pa.DataType, keep_ids: bool):
    """A block's texts from the numbers of their words, the words' ids, and the ids' pieces."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if keep_ids else 4]
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        piece: dict[int, bytes] = {}
        for row in answers.column("pieces"):
            for page in row.as_py() or ():
                piece.update(enumerate(page["piece"], PAGE * page["page"]))
        mine = texts.filter(texts.column("owner").is_valid())
        numbers = {o: np.cumsum(_unpack_numbers(x.as_py()), dtype=np.int64).tolist() for o, x in zip(mine.column("owner").to_pylist(), mine.column("numbers"))}
        coded: list[bytes] = [b""] * sum(map(len, numbers.values()))
        decoded = coded.copy()
        asked = answers.filter(answers.column("owner").is_valid())
        for owner, lengths, packed in zip(asked.column("owner").to_pylist(), asked.column("ends"), asked.column("ids")):
            ids, start = _unpack_numbers(packed.as_py()), 0
            raw, bits = ids.tobytes(), [piece[i] for i in ids.tolist()]
            for n, end in zip(numbers[owner], np.cumsum(_unpack_numbers(lengths.as_py())).tolist()):
                coded[n] = raw[4 * start : 4 * end]
                decoded[n] = b"".join(bits[start:end])
                start = end
        out: list[list] = [[], [], [], [], []]
        for i, owner, cell in zip(texts.column("i").to_pylist(), texts.column("owner").to_pylist(), texts.column("cell")):
            if owner is None:
                places = _unpack_numbers(cell.as_py()).tolist()
                ids = b"".join(map(coded.__getitem__, places))
                text = b"".join(map(decoded.__getitem__, places)).decode("utf-8", "replace").encode()
                for c, v in zip(out, (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), np.frombuffer(ids, np.int32) if keep_ids else None)):
                    c.append(v)
        found = pa.table([pa.array(c, t) for c, t in zip(out, kinds)][: len(names)], names=names)
        del coded, decoded, numbers, piece, out
        give_back()
        return found

    return run


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a tokenizer file: one row per entry of its vocabulary."""
    return spark.createDataFrame(list(enumerate(map(bytearray, vocabulary(path).pieces))), "id int, piece binary")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> if keep_ids).

    ids are those of the tokenizers library without special tokens added (a special token's string inside a text
    still is that token); ids_sha256 is over little-endian unsigned 32-bit ids, decoded_sha256 over the UTF-8 of
    the decoded text.

    Texts don't move. A block is what one task reads, up to about 24 MB of text; its distinct words, packed, and the
    numbers in place of its words go through one exchange, which both the encoding and the assembly read. No key is hot:
    words are dealt by their hash after a block has made them distinct, and blocks, which are alike in size, by theirs,
    over so many partitions that few meet. The id-to-piece table is of the vocabulary's size and broadcast; a block joins
    it by pages of PAGE ids, once for each that it uses.

    Defined cases: null text is empty text (no tokens); repeated rows and null doc_ids each give a row; a text over a
    block's size is a block of its own; an empty table gives an empty result; other columns are ignored.
    """
    spark, parts, special = docs.sparkSession, n_partitions(docs.sparkSession), vocabulary(path).special
    given = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("x"))
    kind = given.schema["i"].dataType
    split = given.mapInArrow(trimmed(_split(special, parts)), f"i {kind.simpleString()}, block long, owner int, cell binary, numbers binary").repartition(4 * parts, "block")
    asked = split.mapInArrow(_words, "owner int, block long, cell binary").repartition(parts, "owner").sortWithinPartitions("owner", "block")
    coded = asked.mapInArrow(trimmed(_encode(path, special)), _ANSWER).repartition(4 * parts, "block")
    table = piece_table(spark, path).groupBy(F.floor(F.col("id") / PAGE).cast("int").alias("page"))
    table = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"]).alias("piece"))
    used = coded.mapInArrow(_used, "b long, page int").join(F.broadcast(table), "page")
    pieces = used.groupBy("b").agg(F.collect_list(F.struct("page", "piece")).alias("pieces"))
    none = lambda kind: F.lit(None).cast(kind)
    answers = coded.select(F.col("block").alias("b"), "owner", "ends", "ids", "used", none(pieces.schema["pieces"].dataType).alias("pieces"))
    answers = answers.union(pieces.select("b", none("int"), none("binary"), none("binary"), none("array<int>"), "pieces"))
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return split.groupBy("block").cogroup(answers.groupBy("b")).applyInArrow(_assemble(to_arrow_type(kind), keep_ids), schema)


def decode_ids(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of a table of id arrays, by joining each id with the id-to-piece table (one row per vocabulary entry).

    Null or empty arrays give empty text; ids that are not in the vocabulary add nothing; each row gives a row, also if
    it repeats a doc_id or has none.
    """
    rows = written(rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"), F.monotonically_increasing_id().alias("row")), "ids")
    at = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("p", "id"))
    joined = at.join(F.broadcast(piece_table(rows.sparkSession, path)), "id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", F.hex("piece").alias("h")))), lambda x: F.coalesce(x["h"], F.lit("")))
    return joined.groupBy("row", "doc_id").agg(F.decode(F.unhex(F.concat_ws("", ordered)), "UTF-8").alias("text")).drop("row")
