"""Token ids as flat files of unsigned integers with 64-bit document offsets, memory-mapped on reading.

Spark's range partitioning lays the documents in ascending id order; each partition streams its documents into one shard.
A shard is three files: NNNNN.bin holds the ids of its documents one after the other (uint16 if the vocabulary allows it, else
uint32, little-endian), NNNNN.idx holds uint64 offsets, one more than it has documents, counted in ids from the start of the
whole set, NNNNN.doc holds the documents' int64 ids and then a byte each that is 1 for a null id. The shards' .bin files laid
end to end are one flat array. A shard's first offset (its base) is the prefix sum of the partitions before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, slices, written

_CACHE: dict[str, WordEncoder] = {}
#: Entries a worker remembers between batches.
REMEMBERED = 600_000
#: Letters of ASCII and Latin-1 with ASCII marks behind them, some or none. Each of these letters is one letter before and after
#: NFC and lower-casing, so a run of them is one piece for the pre-tokeniser and the marks are the next. Other letters may
#: decompose into marks that join what follows; words with them are encoded whole.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Encodes words (runs without ASCII white space) with a tokenizers file that brings texts to NFC and lower case, drops white
    space, and takes runs of letters apart from runs of marks. A file that does otherwise is refused."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(file), {}
        probe = "Áb c.\n\tÀB,  C.."
        apart = [i for w in ("áb", "c", ".", "àb", ",", "c", "..") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != apart:
            raise ValueError("this tokenizer doesn't take words, letters and marks apart, or keeps their case")

    def _remembered(self, entries: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in entries if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {}
            new = entries
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, np.uint32).tobytes()
        return [known[w] for w in entries]

    def __call__(self, words: pa.Array) -> list[bytes]:
        """The uint32 ids of each word. A plain word's letters, in lower case, and its marks are entries of their own, which many words share."""
        found = pc.extract_regex(words, PLAIN)
        cores = pc.dictionary_encode(pc.coalesce(pc.utf8_lower(pc.struct_field(found, "core")), words))
        tails = pc.dictionary_encode(pc.coalesce(pc.struct_field(found, "tail"), pa.scalar("", words.type)))
        ids, ends = self._remembered(cores.dictionary.to_pylist()), self._remembered(tails.dictionary.to_pylist())
        return [ids[c] + ends[t] for c, t in zip(cores.indices.to_pylist(), tails.indices.to_pylist(), strict=True)]


def encoder(file: str) -> WordEncoder:
    if file not in _CACHE:
        _CACHE[file] = WordEncoder(file)
    return _CACHE[file]


def encode(texts: pa.Array, encode_words: WordEncoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts (uint32), each text followed by `end`, and how many each text has. Each distinct word is encoded once."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, counts = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(words)
    ids = encode_words(coded.dictionary)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    starts = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy()
    per_word = sizes[which]
    word_end = np.cumsum(per_word)
    per_text = np.diff(np.concatenate([[0], word_end])[np.concatenate([[0], np.cumsum(counts)])])
    total = int(per_word.sum())
    ids = flat[np.repeat(starts[which] - (word_end - per_word), per_word) + np.arange(total)]
    out = np.full(total + len(counts), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(per_text + 1) - 1] = False
    out[keep] = ids
    return out, per_text + 1


class _Put:
    """A file that gets its final name only when it is complete: a repeated task leaves the same file."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.part, self.path = f"{root}/.{name}.{os.getpid()}.{os.urandom(4).hex()}", f"{root}/{name}"
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _put(folder: str, name: str, data: bytes) -> None:
    file = _Put(folder, name)
    file.write(data)
    file.close()


def _mapped(folder: str, name: str, kind: type) -> np.ndarray:
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", kind, "r") if os.path.getsize(f"{root}/{name}") else np.zeros(0, kind)
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_buffer(), kind)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 2, vocabulary: int = 49_408, shard_chars: int = 32 << 20) -> DataFrame:
    """Write docs in ascending id order into folder; gives the manifest (shard, base, n_docs, n_tokens), one row per shard that has documents.

    Null texts count as empty and get the end id alone. Rows with a null id come first; rows with the same id are ordered by a
    hash of their text, so repeated rows are all written and the order is settled. Shards are ranges of (id, hash, row), cut by
    Spark so that they hold about equally many rows, shard_chars characters on average; a task streams its shard, whatever its
    size, and an id that holds many rows is cut like any other. Other columns are ignored; an empty table gives an empty
    manifest and no files. An id beyond the vocabulary is an error.
    """
    folder, kind = _uri(folder), np.uint16 if max(vocabulary, end + 1) <= 1 << 16 else np.uint32
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 8)).first()[0] or 0
    n = max(1, -(-chars // shard_chars))
    order = ["id", "tie", "row"]
    ordered = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, words, file, sizes, names = TaskContext.get().partitionId(), encoder(tokenizer), None, [], []
        for whole in batches:
            for batch in slices(whole, most=8 << 20):
                file = file or _Put(folder, f"{shard:05d}.bin")
                ids, counts = encode(batch.column("text"), words, end)
                if int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
                file.write(ids.astype(np.dtype(kind).newbyteorder("<")).tobytes())
                sizes.append(counts)
                names.append(batch.column("id"))
        if file:
            file.close()
            offsets, ids = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8"), pa.chunked_array(names)
            _put(folder, f"{shard:05d}.len", offsets.tobytes())
            _put(folder, f"{shard:05d}.doc", pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy().astype(np.uint8).tobytes())
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], ["shard", "n_docs", "n_tokens"])

    parts = written(ordered.mapInArrow(write, "shard int, n_docs long, n_tokens long"), "token-shards")
    # one row per shard: the prefix sums over them are the bases
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                local = _mapped(folder, f"{row['shard']:05d}.len", np.uint64)
                _put(folder, f"{row['shard']:05d}.idx", (np.asarray(local) + np.uint64(row["base"])).astype("<u8").tobytes())
            yield batch

    spread = bases.select("shard", "base", "n_docs", "n_tokens").repartitionByRange(n, "shard")
    return written(spread.mapInArrow(place, "shard int, base long, n_docs long, n_tokens long"), "token-manifest")


#: Documents in a batch that read_token_files() gives.
READ_DOCS = 65_536


def read_token_files(manifest: DataFrame, folder: str, vocabulary: int = 49_408, end: int = 2) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from the memory-mapped files; a task per shard."""
    folder, kind = _uri(folder), np.uint16 if max(vocabulary, end + 1) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                ids, offsets, names = (_mapped(folder, f"{shard:05d}.{x}", k) for x, k in (("bin", kind), ("idx", np.uint64), ("doc", np.uint8)))
                base, n = int(offsets[0]), len(offsets) - 1
                for i in range(0, n, READ_DOCS):
                    j = min(n, i + READ_DOCS)
                    ends = np.asarray(offsets[i : j + 1]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((ends[:-1] - base).tolist(), (ends[1:] - base).tolist(), strict=True)]
                    doc, null = np.frombuffer(names[8 * i : 8 * j].tobytes(), "<i8"), np.asarray(names[8 * n + i : 8 * n + j]).astype(bool)
                    yield pa.record_batch([pa.array(doc, mask=null), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())
    return manifest.select("shard").repartitionByRange(shards, "shard").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Write docs as token files (a new folder of the shared one unless given) and read them back: (id_col, start, n_tokens, ids_crc32)."""
    folder = folder or new_path(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, id_col, text_col, end, vocabulary)
    return read_token_files(manifest, folder, vocabulary, end).withColumnRenamed("id", id_col)
