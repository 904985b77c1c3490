"""Token-ID files: one zstandard frame a document, a trailing seek table and a checksum for each frame.

A file is a sequence of independent zstandard frames, each the ids of one document as little-endian unsigned 32-bit
integers; a skippable frame with the documents' ids; and the seek table of the public seekable format (a skippable
frame: compressed size, size and the low half of XXH64 of each frame; number of frames, a flag byte, a magic number).
Any zstandard reader can decompress the whole; with the seek table a reader decompresses only the documents it wants.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, blocks, read_table, small_batches

SKIPPABLE, INDEX, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_CACHE = 500_000  # words whose ids a task keeps

#: Latin letters, for which small letters and composition are the same to every library, then punctuation without ';
#: or else anything.
_WORD = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)$|^(.+)$", re.M)


class WordCache:
    """Ids of whole texts, put together from the ids of the pieces between spaces and line ends.

    The tokenizer's pieces never span white space, so this gives what encoding the whole text gives. When it
    holds too many words, the half that came up least goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lean = Tokenizer(self.tokenizer.model)
        # for words of plain small letters alone, which normalising and splitting leave as they are
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.lean.get_vocab_size(), bool)  # ids that end a word
        self.ends[[i for piece, i in self.lean.get_vocab().items() if piece.endswith("</w>")]] = True
        self.at: dict[str, int] = {"": 0}  # number of a word as written
        self.part: dict[str, int] = {"": 0}  # number of a part: small letters, or punctuation, or any other word
        self.first, self.second = array("i", [0]), array("i", [0])  # a word's parts
        self.start, self.flat = array("q", [0, 0]), array("I")  # a part's ids
        self.hits = np.zeros(0, np.int32)

    def _halve(self) -> None:
        """Keeps the half of the words that came up most, and their parts."""
        keep = np.zeros(len(self.at), bool)
        keep[np.argsort(self.hits, kind="stable")[len(self.at) // 2 :]] = True
        keep[0] = True
        new = (np.cumsum(keep) - 1).tolist()
        held = keep.tolist()
        self.at = {w: new[i] for w, i in self.at.items() if held[i]}
        first, second = np.array(self.first)[keep], np.array(self.second)[keep]
        own = np.zeros(len(self.part), bool)
        own[0] = own[first] = own[second] = True
        move, held = np.cumsum(own) - 1, own.tolist()
        size = np.diff(np.array(self.start))
        self.part = {x: i for i, x in enumerate(x for x, k in zip(self.part, held, strict=True) if k)}
        self.flat = array("I", np.array(self.flat, np.uint32)[np.repeat(own, size)].tobytes())
        self.start = array("q", np.concatenate(([0], np.cumsum(size[own]))).tobytes())
        self.first, self.second = (array("i", move[x].astype(np.int32).tobytes()) for x in (first, second))
        self.hits = self.hits[keep] // 2

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of small letters, one after another, and how many each has."""
        lines = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.lean.encode_batch_fast(lines, add_special_tokens=False)])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("this vocabulary does not mark the ends of words")
        return ids, np.diff(stop, prepend=0)

    def _add(self, words: list[str]) -> None:
        """Numbers new words; one of letters and punctuation behind them is put together from the two parts."""
        part = self.part
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        letters, marks, others = zip(*_WORD.findall("\n".join(words)), strict=True)
        small = "\n".join(letters).lower().split("\n")
        lean = list(set(small) - part.keys())
        part.update(zip(lean, range(len(part), len(part) + len(lean)), strict=True))
        full = list((set(marks) | set(others)) - part.keys())
        part.update(zip(full, range(len(part), len(part) + len(full)), strict=True))
        if lean:
            self._extend(*self._letters(lean))
        if full:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(full, add_special_tokens=False)]
            self._extend(np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))
        first = [x or y for x, y in zip(small, others, strict=True)]
        self.first.frombytes(np.fromiter(map(part.__getitem__, first), np.int32, len(words)).tobytes())
        self.second.frombytes(np.fromiter(map(part.__getitem__, marks), np.int32, len(words)).tobytes())

    def _extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.start.frombytes((np.cumsum(sizes) + len(self.flat)).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        counts = pc.list_value_length(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        if not len(words.dictionary):
            return [np.zeros(0, np.uint32)] * len(texts)
        own = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), "\n")[0].as_py().split("\n")
        if len(self.at) > _CACHE:
            self._halve()
        if new := list(set(own) - self.at.keys()):
            self._add(new)
        at, which = np.fromiter(map(self.at.__getitem__, own), np.int32, len(own)), words.indices.to_numpy()
        hits = np.bincount(at, np.bincount(which, minlength=len(own)), minlength=len(self.at))
        hits[: len(self.hits)] += self.hits
        self.hits = hits.astype(np.int32)
        # the ids of each different word, then of all words
        parts = np.column_stack((np.array(self.first)[at], np.array(self.second)[at])).ravel()
        start = np.array(self.start)
        flat, size = _gather(np.array(self.flat, np.uint32), start[parts], np.diff(start)[parts])
        size = size.reshape(-1, 2).sum(axis=1)
        flat, size = _gather(flat, (np.cumsum(size) - size)[which], size[which])
        return np.split(flat, np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)[:-1]])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat, one after another, and their sizes."""
    stop = np.cumsum(size)
    place = np.repeat((start - stop + size).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], size


def _seek_frame(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class TokenFile:
    """A reader of one file."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self._read(end - 9 - 12 * n, 12 * n), np.uint32).reshape(n, 3)
        self.sizes, self.sums = table[:, :2].astype(np.int64), table[:, 2]
        self.starts = np.concatenate(([0], np.cumsum(self.sizes[:, 0])))
        self.ids = np.frombuffer(self._read(self.starts[n - 1] + 8, self.sizes[n - 1, 0] - 8), np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def document(self, i: int) -> bytes:
        """The ids of the file's i-th document; only its frame is read and decompressed."""
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(self._read(self.starts[i], self.sizes[i, 0]), max_output_size=int(self.sizes[i, 1]))
        if len(raw) != self.sizes[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"document {self.ids[i]} fails its checksum")
        return raw

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of all documents with this doc_id (they stand in ascending order)."""
        return [self.document(i) for i in range(*np.searchsorted(self.ids, [doc_id, doc_id + 1]))]


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, rows: int = 8192) -> DataFrame:
    """Writes documents (doc_id, text) in ascending doc_id order, about `rows` a file; returns (file, part, n_docs, n_tokens).

    A null or empty text is the end id alone; rows with the same doc_id all stay, in any order among themselves; rows
    with a null doc_id go (no place in the order is defined for them). A text of any length is one frame; a task holds
    eight megabytes of texts, or one longer text, at a time. Without documents there is no file. Other columns are not read. A file gets its name when it
    is complete, so a task that is run again, or twice at once, leaves one whole file.
    """
    small_batches(spark, 2000)
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, -(-held.count() // rows))
    ordered = held.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        part, files, out, tokens = TaskContext.get().partitionId(), None, None, 0
        ids, entries = array("q"), []
        cache, press = WordCache(tokenizer), zstandard.ZstdCompressor(level=3)
        for b in batches:
            sizes = pc.coalesce(pc.binary_length(b.column(1)), 0).to_pylist()
            for s in blocks(sizes, 1 << 23):
                part_ids, part_texts = (x.slice(s.start, s.stop - s.start) for x in (b.column(0), b.column(1)))
                for doc_id, own in zip(part_ids.to_pylist(), cache.encode(part_texts), strict=True):
                    if out is None:
                        files, name = fs.FileSystem.from_uri(folder)
                        files.create_dir(name, recursive=True)
                        final = f"{name}/tokens-{part:06d}.zst"
                        part_name = f"{name}/.tokens-{part:06d}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(part_name)
                    raw = own.astype("<u4").tobytes() + struct.pack("<I", end_id)
                    frame = press.compress(raw)
                    out.write(frame)
                    ids.append(doc_id)
                    entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    tokens += len(raw) // 4
        if out is not None:
            index = struct.pack("<II", INDEX, 8 * len(ids)) + ids.tobytes()
            entries.append((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
            out.write(index + _seek_frame(entries))
            out.close()
            files.move(part_name, final)
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/tokens-{part:06d}.zst"], "part": [part], "n_docs": [len(ids)], "n_tokens": [tokens]}, schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(write, "file string, part long, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents in the files of a manifest; ids is the binary of the document's frame.

    `start` is the number of ids in all documents before. Files are summed up in groups of 1,024, and groups in order;
    each task reads about four files. An empty manifest gives no rows.
    """
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "part", "n_tokens", F.floor(F.col("part") / 1024).alias("block"))
    groups = files.groupBy("block").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", before("n", Window.orderBy("block"))).drop("n")
    placed = files.join(groups, "block").select("file", (F.col("ahead") + before("n_tokens", Window.partitionBy("block").orderBy("part"))).alias("before"))

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file, rows, held = TokenFile(name), ([], [], []), 0
                for i, doc_id in enumerate(file.ids.tolist()):
                    raw = file.document(i)
                    for column, x in zip(rows, (doc_id, start, raw), strict=True):
                        column.append(x)
                    start, held = start + len(raw) // 4, held + len(raw)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                        rows, held = ([], [], []), 0
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return placed.repartition(max(1, -(-manifest.count() // 4)), "file").mapInArrow(read, "doc_id long, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids of every document, read back from the files."""
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = scratch.save(write_token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json"), scratch.path("files")), "manifest")
    out = read_token_files(manifest)
    return out.select("doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
