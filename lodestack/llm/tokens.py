"""Token ids of a corpus in seekable Zstandard files, in the order of the document ids.

Documents are dealt to range partitions by id (nulls first), tokenised there and packed into files of a
bounded number of ids. Spark's own writer commits the files, so a lost or repeated task leaves no half or
double file, and any file system of Spark will do. A null text is encoded as an empty one; equal ids keep a
fixed order; a document is never split over frames or files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import memory
from lodestack.llm.store import in_order, require
from lodestack.llm.tokenfile import FOOTER_MAGIC, Reader, Writer

#: Words that a worker remembers twice over (a new and an old generation), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 200_000, 40
#: Bytes of text encoded together, at most, unless one text is longer.
CHUNK_BYTES = 1_000_000
#: A letter, then marks up to the end of the word: the tokenizer always parts them.
TAIL = r"([a-zß-öø-ÿ])([.,;:!?&%*#$]+)( |$)"
#: What opens a special token; texts with it are left as they are.
SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes: printable ones stand for themselves, the others for 256 and on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: How a tokenizer must be set up so that words can be encoded one by one; read from its file.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(tokenizer) -> bool:
    """Whether the tokenizer lowers case, drops white space and splits there and between letters and marks, before anything else."""
    said = json.loads(tokenizer.to_str())
    return all(said.get(k) == v for k, v in BY_WORDS.items()) and not said["model"].get("dropout")


class TextEncoder:
    """Encodes whole texts by any tokenizer file, batch by batch."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer
        self.width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.kind = f"<u{self.width}"

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (null: those of an empty text), without special tokens, and where each text ends among them."""
        found = self._tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array(e.ids, self.kind) for e in found]
        return np.concatenate(ids) if ids else np.empty(0, self.kind), np.cumsum([len(x) for x in ids])


class WordEncoder:
    """Encodes texts by a byte-level tokenizer that never joins what a blank or line feed parts, and lower-cases.

    Such a tokenizer drops white space and splits there before anything else, so the ids of a text are those of
    its words, one after the other; words recur, and the ids of recent ones are remembered. So that they recur more
    often, ASCII letters are lowered and marks parted from the letter before them, which the tokenizer does too.
    """

    def __init__(self, tokenizer):
        """tokenizer: a tokenizer or its file; it must be by_words()."""
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer) if isinstance(tokenizer, str) else tokenizer
        if not by_words(self._tokenizer):
            raise ValueError("this tokenizer can't encode words one by one")
        self._model = self._tokenizer.model
        self.width = 2 if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.kind = f"<u{self.width}"
        self._letters = _byte_letters()
        self._new: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes | None:
        """The ids of a word from the old generation, or by the model alone for plain letters; None: ask the tokenizer."""
        if (found := self._old.get(word)) is not None:
            return found
        if not word.isalpha() or max(word) > "\xff":  # beyond, lower case and composition are the tokenizer's
            return None
        return self._pack([t.id for t in self._model.tokenize(word.lower().encode().decode("latin-1").translate(self._letters))])

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self._new) > CACHE_WORDS:
            self._old, self._new = self._new, {"": b""}
            self._model._clear_cache()
        found = list(map(self._new.get, words))
        hard = []
        for k, ids in enumerate(found):
            if ids is None:
                w = words[k]
                if len(w) > CACHE_CHARS:
                    found[k] = self._pack(self._tokenizer.encode(w, add_special_tokens=False).ids)
                elif (ids := self._word(w)) is not None:
                    self._new[w] = found[k] = ids
                else:
                    hard.append(k)
        for k, e in zip(hard, self._tokenizer.encode_batch_fast([words[k] for k in hard], add_special_tokens=False), strict=True):
            self._new[words[k]] = found[k] = self._pack(e.ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (null: none), without special tokens, and where each text ends among them."""
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        if not pc.any(pc.match_substring(plain, SPECIAL)).as_py():
            plain = pc.replace_substring_regex(pc.ascii_lower(plain), TAIL, r"\1 \2\3")
        pieces = pc.split_pattern(plain, " ")
        words = pieces.flatten().dictionary_encode()
        known = self._words(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        flat, starts = np.frombuffer(b"".join(known), self.kind), np.cumsum(lengths) - lengths
        word = words.indices.to_numpy(zero_copy_only=False)
        n = lengths[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[word] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = pieces.offsets.to_numpy(zero_copy_only=False)
        return ids, ends[offsets[1:] - offsets[0]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | TextEncoder:
    """A worker's encoder, which outlives its tasks: by words where the tokenizer allows that, else by whole texts."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    return WordEncoder(tokenizer) if by_words(tokenizer) else TextEncoder(tokenizer)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a batch, about CHUNK_BYTES of text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at)
        at = to


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 8_000_000, frame_ids: int = 65536) -> None:
    """Write docs as token files under path. tokenizer: any tokenizer file, present on every worker.

    end_id follows each document unless None. A file ends once it holds file_ids ids, a frame at frame_ids.
    Other columns of docs are not written. An empty table writes no token file.
    """
    require(docs, id_col, text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], f"<u{encode.width}")
        out = Writer(part, number, encode.width, frame_ids)
        for batch in batches:
            for ids, texts in _chunks(batch):
                found, ends = encode.encode(texts)
                for doc_id, a, b in zip(ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out.add(doc_id, np.concatenate([found[a:b], end]))
                    if out.ids >= file_ids:
                        yield pa.RecordBatch.from_arrays([pa.array([out.bytes()], pa.binary())], names=["content"])
                        number += 1
                        out = Writer(part, number, encode.width, frame_ids)
        if len(out._rows):
            yield pa.RecordBatch.from_arrays([pa.array([out.bytes()], pa.binary())], names=["content"])

    ordered = in_order(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), F.col("id"))
    files = ordered.mapInArrow(memory.batches(run), "content binary")
    # The text writer puts bytes as they are and a separator after each row: here the last four bytes of a file,
    # its magic number, are that separator, and each row becomes a file.
    magic = FOOTER_MAGIC.to_bytes(4, "little").decode("latin-1")
    whole = files.select(F.expr("substring(content, 1, length(content) - 4)").cast("string").alias("value"))
    whole.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", magic).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files under path, checked against the checksums.

    part, number, at (its place: partition, file, row), doc_id, n_tokens, ids_crc32 (unsigned, over the ids as
    little-endian unsigned 32-bit integers). Corrupt files raise.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = Reader.of(content.as_py())
                ids, ns, crcs = [], [], []
                for doc_id, found in reader.documents():
                    ids.append(doc_id)
                    ns.append(len(found))
                    crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([reader.part] * n, pa.int64()), pa.array([reader.number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part", "number", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0)
    return files.mapInArrow(memory.batches(run), "part long, number long, at long, doc_id long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids array<long>) of the wanted documents; of each file only the frames that hold them are unpacked."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                found = list(Reader.of(content.as_py()).documents(wanted))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x.astype("i8") for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").where(F.length("content") > 0).mapInArrow(run, "doc_id long, ids array<long>")
