"""Operator 2, token-id files: one shared zstandard dictionary, every document compressed by itself.

Encoding.  A text is cut into units of white space plus the characters up to the next white space; no pre-token of
the byte-level pattern crosses such a unit, so the ids of a text are the ids of its units in order.  Units are
encoded by the tokenizers library and remembered in a bounded table.  With added_tokens, texts that quote one of the
tokenizer's added tokens go to the library whole, which gives such a token its own id; without, it is text like any other.

File format of one shard (`shard-NNNNNN.ids`), integers little-endian:

    magic 8 bytes | dictionary hash 8 bytes | bytes an id 4
    frames, one zstandard frame a document, of its ids (uint16, or uint32 beyond 65,536 ids)
    index: for each document start (ids before it in this shard), n_tokens, offset, length, doc_id, each int64
    index offset 8 bytes | documents 8 bytes | magic 8 bytes

The dictionary lies beside the shards as `dictionary-<hash>`.  It is trained; a sample too small for that (some kilobytes) is itself the
dictionary, as raw content.  A reader needs the index and one frame for one document.

Shards are ranges of ids of about `shard_bytes` of text: rows are range-partitioned by (id, text hash), so a repeated id can be split, and
each task writes its range under a temporary name and renames it, so a lost executor's task can run again; what such a task
left is deleted at the end.  The manifest names files by their whole URI, as the path was given.  Its rows, one a shard, come back to
the driver, which lists the shards anyway: for every file that Spark's own writer makes on a local or mounted path, an executor starts
`chmod` several times, and each such process shares (and is counted with) the executor's whole memory until it runs.

Null texts are empty (the end id alone).  Null ids sort first and read back as null.  Repeated ids are ordered by their
text's hash.  An empty table gives no shards and an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _UNIT, WHITE, Memo, fresh_path, heaps_collected, small_batches, text_or_empty, units

MAGIC = b"PLXIDS01"
NULL_ID = -(2**63)
INDEX = np.dtype([("start", "<i8"), ("n_tokens", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("doc_id", "<i8")])


# The pattern of byte-level pre-tokenizers, and which character stands for which byte (printable
# bytes for themselves, the others in order from U+0100).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # an apostrophe may begin a pre-token of its own
#: White space followed by a space or a line feed: such a text can't be cut at these two alone.
ODD_BREAK = re.compile(f"[{WHITE}][ \n]")
BYTE_CHARS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class UnitEncoder:
    """Ids of texts as bytes, by way of a bounded table of units.

    Units that a task hasn't met go to the library's model pre-token by pre-token; its own pre-tokenizer gives the same
    pre-tokens, but offsets with them, at several times the cost.  It is asked for units beyond the Latin, Greek and Cyrillic
    letters, whose classes have been the same in every version of Unicode's tables that is in use."""

    def __init__(self, tokenizer_path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        pre = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or type(pre).__name__ != "ByteLevel" or pre.add_prefix_space:
            raise ValueError("only a byte-level tokenizer without normaliser can be encoded unit by unit")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Memo(self.unit, most=600_000)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def unit(self, unit: str) -> bytes:
        if not unit.isascii() and max(unit) >= "\u0530":
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)
            return array(self.code, [t.id for p, _ in found for t in self.model.tokenize(p)]).tobytes()
        body = unit[1:] if unit[0] in " \n" else unit
        if unit[0] == "\n" and body and not body[0].isspace():  # a line feed and the word after it
            return self.known["\n"] + self.known[body]
        if body.isalpha():
            return self.piece(unit)
        word = body.rstrip(MARKS)
        if word.isalpha():  # a word and the marks after it
            end = len(unit) - len(body) + len(word)
            return self.known[unit[:end]] + self.known[unit[end:]]
        if len(unit.split()) > 1:
            parts = _UNIT.findall(unit)
            if len(parts) > 1:
                return b"".join([self.known[p] for p in parts])
        return b"".join([self.piece(p) for p in PATTERN.findall(unit)])

    def encode(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, line_units(text)))


def line_units(text: str) -> list[str]:
    """units(), by a faster way for texts whose white space is single spaces and line feeds: words around a line feed are then units too."""
    if "\0" in text or ODD_BREAK.search(text):
        return units(text)
    found = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return found if found[0] else found[1:]


@lru_cache(maxsize=2)
def encoder_of(tokenizer_path: str, added_tokens: bool = False) -> UnitEncoder:
    """One encoder a worker process, whose table outlives a task."""
    return UnitEncoder(tokenizer_path, added_tokens)


def dictionary_hash(dictionary: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(dictionary).digest()[:8]


def _filesystem(uri: str):
    """The store of a URI (or of a local path) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{uri}")


def train_dictionary(
    df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, size: int = 65536, sample_documents: int = 2000, sample_pieces: int = 2048,
    added_tokens: bool = False, total: int | None = None,
) -> bytes:
    """Dictionary fitted on a bounded sample: about `sample_documents` documents by hash of their ids, and of
    their serialized ids at most `sample_pieces` pieces of 4 KB.  It changes sizes only, never what is read back."""
    import zstandard

    total = df.count() if total is None else total
    if not total:
        return b""
    share = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_documents / total) * (1 << 30)) + 1)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path, added_tokens)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                ids = encoder.encode(text) + np.array([end_id], dtype=encoder.dtype).tobytes()
                out += [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
            yield pd.DataFrame({"piece": out, "h": [zlib.crc32(x) for x in out]})

    sample = df.filter(share).select(text_or_empty(text_col).alias("text")).mapInPandas(pieces, "piece binary, h long")
    got = [bytes(r["piece"]) for r in sample.orderBy("h", "piece").limit(sample_pieces).collect()]
    try:
        return zstandard.train_dictionary(size, got).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b"".join(got)[-size:]


def write_token_files(
    df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, level: int = 1,
    added_tokens: bool = False, shard_bytes: int = 1 << 27,
) -> DataFrame:
    """Write shards and dictionary under `path`; the manifest has a row a shard: shard, file, documents, n_tokens, bytes, start.

    With added_tokens the ids are those of the library's encode(text, add_special_tokens=False) at its default setting."""
    spark = df.sparkSession
    path = path.rstrip("/")
    total, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    dictionary = train_dictionary(df, tokenizer_path, id_col, text_col, end_id, added_tokens=added_tokens, total=total)
    name = dictionary_hash(dictionary)
    store, root = _filesystem(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary-{name.hex()}") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # at most `size` bytes

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        encoder, out, index, start, offset = None, None, array("q"), 0, 20
        shard = TaskContext.get().partitionId()
        where, base = _filesystem(path)
        temporary, final = f"{base}/.{shard:06d}-{uuid.uuid4().hex}", f"shard-{shard:06d}.ids"
        for pdf in batches:
            if out is None:
                encoder, out = encoder_of(tokenizer_path, added_tokens), where.open_output_stream(temporary, buffer_size=1 << 20)
                out.write(MAGIC + name + struct.pack("<I", encoder.dtype.itemsize))
                zdict = zstandard.ZstdCompressionDict(shared.value)
                pack = zstandard.ZstdCompressor(level=level, dict_data=zdict).compress
                end = np.array([end_id], dtype=encoder.dtype).tobytes()
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = encoder.encode(text) + end
                frame, n = pack(ids), len(ids) // encoder.dtype.itemsize
                out.write(frame)
                index.extend((start, n, offset, len(frame), doc_id))
                start, offset = start + n, offset + len(frame)
        if out is not None:
            documents = len(index) // 5
            out.write(np.frombuffer(index, dtype="=i8").astype("<i8").tobytes() + struct.pack("<QQ", offset, documents) + MAGIC)
            out.close()
            where.move(temporary, f"{base}/{final}")
            yield pd.DataFrame({"shard": [shard], "file": [f"{path}/{final}"], "documents": [documents], "n_tokens": [start], "bytes": [offset]})

    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_or_empty(text_col).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    # shards by size, and smaller ones while there are fewer than the cores can share
    shards = max(1, -(-size // shard_bytes), min(4 * spark.sparkContext.defaultParallelism, -(-size // (1 << 22))))
    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with small_batches(spark):
        found = dealt.mapInPandas(write, "shard int, file string, documents long, n_tokens long, bytes long").collect()
    heaps_collected(spark)  # what reads the files and writes its rows begins with small executors
    from pyarrow import fs

    for left in store.get_file_info(fs.FileSelector(root)):  # of tasks that were run again
        if left.base_name.startswith("."):
            store.delete_file(left.path)
    manifest, start = [], 0
    for row in sorted(found):
        manifest.append((*row, start))
        start += row["n_tokens"]
    return spark.createDataFrame(manifest, "shard int, file string, documents long, n_tokens long, bytes long, start long")


class TokenFile:
    """Reader of one shard: its index, and any document's ids from one frame."""

    def __init__(self, path: str):
        import zstandard

        self.store, self.path = _filesystem(path)
        self.file = self.store.open_input_file(self.path)
        size = self.file.size()
        head, tail = self.file.read_at(20, 0), self.file.read_at(24, size - 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.dictionary, (self.width,) = head[8:16], struct.unpack("<I", head[16:20])
        at, self.documents = struct.unpack("<QQ", tail[:16])
        self.index = np.frombuffer(self.file.read_at(size - 24 - at, at), dtype=INDEX)
        if len(self.index) != self.documents:
            raise ValueError(f"a cut token file: {path}")
        with self.store.open_input_stream(f"{self.path.rpartition('/')[0]}/dictionary-{self.dictionary.hex()}") as f:
            raw = f.read()
        if dictionary_hash(raw) != self.dictionary:
            raise ValueError("the dictionary isn't the one that the shard was written with")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))

    def ids(self, row: int) -> np.ndarray:
        entry = self.index[row]
        raw = self.unpack.decompress(self.file.read_at(int(entry["length"]), int(entry["offset"])))
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"], strict=True):
                shard = TokenFile(file)
                for i in range(0, len(shard.index), 4096):
                    part = shard.index[i : i + 4096]
                    crc = [zlib.crc32(shard.ids(i + k).tobytes()) for k in range(len(part))]
                    ids = pd.array(part["doc_id"], dtype="Int64")
                    ids[part["doc_id"] == NULL_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": part["start"] + start, "n_tokens": part["n_tokens"], "ids_crc32": crc})

    files = manifest.select("file", "start")
    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4)).mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_path(spark: SparkSession) -> str:
    return fresh_path(spark, "token-files")
