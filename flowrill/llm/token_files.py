"""Token-ID output: binary files of independent zstd frames with seek table and checksums.

A file holds documents in ascending ``doc_id`` order (nulls first; equal ids by text hash), file
after file. A frame is a header (number of documents, bytes per id), one entry per document
(``doc_id``, null flag, first id counted from the file's start, number of ids) and the ids, all
little-endian. An index row per document names its file, frame and slot, so a reader decompresses
only the frames of the documents it wants.

Null and empty texts have only the end id. Repeated rows are written repeatedly. Very long texts
make a frame of their own. An empty table gives no files and an empty index.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from flowrill.llm.frames import kept
from flowrill.llm.seekable import FrameCache, SeekableWriter, new_file

_HEAD = "<IB"
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<i8"), ("n", "<i8")])
_INDEX = "doc_id long, part int, file string, frame int, slot int, n_ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_MARKS = ".,;:!?"


class Slots(dict):
    """Numbers texts in the order they are first asked for; ``new`` lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        slot = self[text] = len(self)
        self.new.append(text)
        return slot


# How a tokenizer file normalises and cuts for which texts are cut at blanks here.
_NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]
_CUTS = [
    {
        "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        "behavior": "Removed", "invert": True,
    },
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def cuts_at_blanks(path: str) -> bool:
    """Whether the ids of a text are those of its chunks between blanks, one after the other.

    Holds for byte-level tokenizers that lower-case, cut words from marks, drop white space and let
    no token span it. Of any other file nothing is assumed.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    own = [(spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")]
    plain = all(
        not any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word")) and not any(map(str.isspace, token["content"]))
        for token in spec.get("added_tokens") or []
    )
    model = spec["model"]
    bpe = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback"))
    return own == [_NORMALIZERS, _CUTS] and plain and bpe


class ChunkEncoder:
    """Ids of texts by the tokenizers library, each distinct chunk between blanks encoded once.

    Texts are encoded whole where :func:`cuts_at_blanks` does not hold. Beyond ``limit`` chunks those
    used once are forgotten, and of the others all but the most used half; that changes no result.
    """

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = cuts_at_blanks(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.tokenizer.model
        self.limit = limit
        self.slots = Slots()
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.starts = np.zeros(1024, np.int64)
        self.counts = np.zeros(1024, np.int64)
        self.uses = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        """Keep the chunks that were used most."""
        names, uses = list(self.slots), self.uses[: len(self.slots)]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: self.limit // 2]])
        counts = self.counts[kept]
        ends = np.cumsum(counts)
        self.ids = self.ids[np.arange(int(counts.sum())) + np.repeat(self.starts[kept] - (ends - counts), counts)]
        self.used = len(self.ids)
        self.ids = _room(self.ids, 4096)
        self.starts, self.counts, self.uses = (_room(x, 1024) for x in (ends - counts, counts, uses[kept] // 2))
        self.slots = Slots()
        for slot, at in enumerate(kept.tolist()):
            dict.__setitem__(self.slots, names[at], slot)

    def _piece(self, text: str) -> list[int]:
        """Ids of a word or of a run of marks. What is only letters after normalising is one
        pre-token, so the model may take its bytes directly."""
        plain = text if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if not plain.isalpha():
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            mapped = plain if plain.isascii() else self.as_bytes.pre_tokenize_str(plain)[0][0]
            found = [t.id for t in self.model.tokenize(mapped)]
        return found

    def _known(self, text: str) -> list[int]:
        """Ids of a piece; pieces not asked for in a generation are forgotten."""
        found = self.pieces.get(text)
        if found is None:
            found = self.older.get(text)
            if found is None:
                found = self._piece(text)
            if len(self.pieces) > self.limit // 2:
                self.older, self.pieces = self.pieces, {}
            self.pieces[text] = found
        return found

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk: of its word and the marks behind it if it is of that form."""
        word = chunk.rstrip(_MARKS)
        if not word.isalpha():
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        found = self._known(word.lower() if word.isascii() else word)
        return found + self._known(chunk[len(word) :]) if len(word) < len(chunk) else found

    def _learn(self) -> None:
        """Encode the chunks not met before and append them to the arrays."""
        slots = self.slots
        ids = [self._chunk(chunk) for chunk in slots.new]
        first, end = len(slots) - len(ids), len(slots)
        slots.new = []
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum()))
        self.starts, self.counts, self.uses = (_room(x, end) for x in (self.starts, self.counts, self.uses))
        self.ids = _room(self.ids, self.used + flat.size)
        self.starts[first:end] = self.used + np.cumsum(counts) - counts
        self.counts[first:end] = counts
        self.ids[self.used : self.used + flat.size] = flat
        self.used += flat.size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.by_chunk:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(x.ids, np.uint32) for x in found]
        if len(self.slots) > self.limit:
            self._forget()
        chunks = [text.split(" ") for text in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(
            map(self.slots.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum())
        )
        if self.slots.new:
            self._learn()
        self.uses[: len(self.slots)] += np.bincount(at, minlength=len(self.slots))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if ends.size else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[at] - (ends - counts), counts)]
        return np.split(ids, ends[np.cumsum(sizes) - 1][:-1]) if texts else []


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with space for ``size`` numbers, at least doubled if it has not."""
    if len(array) >= size:
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def encoder(path: str) -> ChunkEncoder:
    """The encoder of a tokenizer file, kept in a worker process from task to task."""
    return kept(f"encoder {path}", lambda: ChunkEncoder(path))


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in blocks of about so many characters."""
    for batch in batches:
        doc_ids, texts, held = [], [], 0
        for doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids.append(doc_id)
            texts.append(scalar.as_py() or "")
            held += len(texts[-1])
            if held >= chars:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
        if texts:
            yield doc_ids, texts


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, frame_bytes: int = 1 << 20
) -> DataFrame:
    """Lazy index of the files written below ``folder``; write it before use, then read it.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. One range exchange puts
    documents in order. A retried task writes a new file, and only files in the index count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        kind = np.dtype(f"<u{width}")
        end = np.array([end_id], kind)
        writer, file, start = None, "", 0
        entries: list[tuple[int, int, int, int]] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal writer, file, entries, arrays, held
            if writer is None:
                file = new_file(folder, part, ".ids.zst")
                writer = SeekableWriter(file, level=1)
            table = np.array(entries, _DOC)
            data = struct.pack(_HEAD, len(table), width) + table.tobytes() + b"".join(a.tobytes() for a in arrays)
            frame = writer.write_frame(data)
            n = len(table)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(table["doc_id"], pa.int64(), mask=table["null"].astype(bool)),
                    pa.array(np.full(n, part), pa.int32()),
                    pa.array([file] * n, pa.string()),
                    pa.array(np.full(n, frame), pa.int32()),
                    pa.array(np.arange(n), pa.int32()),
                    pa.array(table["n"], pa.int64()),
                ],
                names=["doc_id", "part", "file", "frame", "slot", "n_ids"],
            )
            entries, arrays, held = [], [], 0
            return out

        for doc_ids, texts in _blocks(batches):
            for doc_id, found in zip(doc_ids, encode.encode(texts)):
                ids = found.astype(kind)
                entries.append((doc_id or 0, doc_id is None, start, len(ids) + 1))
                arrays += [ids, end]
                start += len(ids) + 1
                held += ids.nbytes + _DOC.itemsize
                if held >= frame_bytes:
                    yield flush()
        if entries:
            yield flush()
        if writer is not None:
            writer.close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(write, _INDEX)
    )


def read_token_files(index: DataFrame) -> DataFrame:
    """Per index row, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``index`` is what :func:`write_token_files` gave, or a selection of its rows together with the
    ``base`` of :func:`with_base`. Frames without a wanted document are not decompressed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = FrameCache()
        head = struct.calcsize(_HEAD)
        for batch in batches:
            files, frames = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            slots, bases = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ids_of, starts, sizes, sums, nulls = [], [], [], [], []
            cuts = [i for i in range(len(files)) if not i or files[i] != files[i - 1] or frames[i] != frames[i - 1]]
            for low, high in zip(cuts, [*cuts[1:], len(files)]):
                data = cache.get(files[low], int(frames[low]))
                n, width = struct.unpack_from(_HEAD, data)
                table = np.frombuffer(data, _DOC, n, head)
                ids = memoryview(np.frombuffer(data, f"<u{width}", -1, head + table.nbytes).astype("<u4")).cast("B")
                ends = np.cumsum(table["n"])
                own = slots[low:high]
                docs = table[own]
                ids_of.append(docs["doc_id"])
                nulls.append(docs["null"].astype(bool))
                starts.append(docs["start"] + bases[low:high])
                sizes.append(docs["n"])
                stops = ends[own]
                sums += [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((stops - docs["n"]).tolist(), stops.tolist())]
            if not cuts:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(ids_of), pa.int64(), mask=np.concatenate(nulls)),
                    pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(sizes), pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return (
        index.select("file", "frame", "slot", "base")
        .repartition("file", "frame").sortWithinPartitions("file", "frame", "slot")
        .mapInArrow(read, _READ)
    )


def with_base(index: DataFrame) -> DataFrame:
    """Adds ``base``: the ids of all files before the row's file (one row per file is summed)."""
    files = index.groupBy("part", "file").agg(F.sum("n_ids").alias("n_file"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("n_file").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "file")


def token_id_output(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files and their index (``folder/index``), and read every document back."""
    write_token_files(docs, f"{folder}/files", tokenizer, end_id).write.parquet(f"{folder}/index")
    index = docs.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")
    return read_token_files(with_base(index))
