"""Operator 7: token ids in independent zstandard frames with a trailing seek table.

A part file holds, in ascending document order:

* one zstandard frame per document: its token ids as little-endian unsigned 32-bit integers;
* a skippable frame with the document ids (8 bytes each, little-endian) and a byte each: 1, or 0 for a null id;
* a skippable frame with the seek table of the public "zstd seekable format": per frame compressed
  size, size, and the low 32 bits of the ids' XXH64 as checksum, then the number of frames, a
  descriptor byte and the magic number.

Parts are ranges of document ids. The manifest has each part's first and last id, so readers open the parts that can hold
a document, find its place in the directory, and decompress its frame only.

Defined results: a null or empty text is the end id alone; repeated rows are
documents of their own, beside each other; null ids come first; an empty
table gives no file and no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casekit.llm.common import WORKER_CACHES, new_folder, one_task_each, open_fs, small_batches, write_parts

#: Fixed values of the zstandard formats.
SKIPPABLE_DIRECTORY, SKIPPABLE_SEEK_TABLE, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Distinct words and pre-tokens whose ids a worker remembers before it starts anew, by default:
#: together about 230 MB. A smaller ``memo`` costs time.
MEMO = 700_000
#: Characters of text that are split at once.
BATCH_CHARS = 1 << 20
#: Fixed value: pre-tokenizer that drops white space and treats the words between on their own.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters and then ASCII punctuation: two pre-tokens of that pattern.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_ENCODERS: dict[str, "Encoder"] = WORKER_CACHES.setdefault("tokens", {})


def _folded(text: str) -> str:
    """The text in lower case, where that changes no id: the tokenizer lowers each character of Latin-1
    alike, but looks for special tokens before."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Texts to packed ids. If the tokenizer treats words between white space on their own, ids are
    looked up per word and the library sees each new word once; else it gets whole texts."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (steps[0].get("pattern") == {"Regex": WORD_PATTERN} and steps[0].get("invert") is True
                        and spec["model"].get("end_of_word_suffix") == "</w>"
                        and '"Lowercase"' in json.dumps(spec.get("normalizer")))
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = memo
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learned(self, found: set[str]) -> dict[str, bytes]:
        """The memo of words, with a batch's distinct words in it. Words are put together from pre-tokens, which
        are remembered too."""
        if len(self.parts) > self.memo:
            self.parts = {"": b""}
        if len(self.words) > self.memo:
            self.words = {}
        simple, rest, letters, marks, parts, words = [], [], set(), set(), self.parts, self.words
        for w in found.difference(words.keys()) if len(found) > len(words) else [w for w in found if w not in words]:
            a = w.rstrip(_MARKS)
            if a.isascii() and a.isalpha():
                b, a = w[len(a):], a.lower()
                if b and b not in parts:
                    marks.add(b)
            elif m := _SIMPLE.fullmatch(w):
                a, b = m[1].lower(), m[2]
                if b not in parts:
                    marks.add(b)
            else:
                rest.append(w)
                continue
            simple.append((w, a, b))
            if a not in parts:
                letters.add(a)
        if letters:  # each is one pre-token, whose last id is an end of word
            letters = list(letters)
            ids = np.array(self.tok.encode(" ".join(letters), add_special_tokens=False).ids, "<u4")
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cut) == len(letters):
                data = ids.tobytes()
                parts.update(zip(letters, [data[x:y] for x, y in zip([0, *cut], cut)]))
            else:
                parts.update(zip(letters, self._library(letters)))
        marks = list(marks)
        parts.update(zip(marks, self._library(marks)))
        for w, a, b in simple:
            words[w] = parts[a] + parts[b] if b else parts[a]
        words.update(zip(rest, self._library(rest)))
        return words

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        some, size = [], 0
        for i, t in enumerate(texts):
            some.append(t)
            size += len(t)
            if size < BATCH_CHARS and i + 1 < len(texts):
                continue
            if self.by_word:
                split = [_folded(x).replace("\n", " ").split(" ") for x in some]
                words = self._learned(set().union(*split))
                for x in split:
                    yield b"".join(map(words.__getitem__, x))
            else:
                yield from self._library(some)
            some, size = [], 0


def encoder(path: str, memo: int = MEMO) -> Encoder:
    known = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
    known.memo = memo
    return known


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


def write_frames(out, docs: Iterable[tuple[int | None, bytes]], level: int = 1) -> tuple[int, int, int | None, int | None, int]:
    """Writes documents (id, packed ids) as one part file. Returns documents and ids
    written, the least and greatest document id (None without any), and how many ids are null."""
    pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
    ids, valid, seek, total = [], bytearray(), [], 0
    for doc_id, data in docs:
        frame = pack.compress(data)
        out.write(frame)
        ids.append(doc_id or 0)
        valid.append(doc_id is not None)
        seek.append(struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        total += len(data) // 4
    out.write(_skippable(SKIPPABLE_DIRECTORY, np.array(ids, "<i8").tobytes() + bytes(valid)))
    foot = struct.pack("<IBI", len(seek), HAS_CHECKSUMS, SEEK_MAGIC)
    out.write(_skippable(SKIPPABLE_SEEK_TABLE, b"".join(seek) + foot))
    known = [i for i, v in zip(ids, valid) if v]
    return len(ids), total, min(known, default=None), max(known, default=None), len(ids) - len(known)


def read_frames(file, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes | None]]:
    """Documents of one part file: id, number of ids, packed ids (None for those not in ``wanted``,
    whose frames are neither read nor decompressed). Checks each frame's checksum."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
        raise ValueError("no seek table at the end of the file")
    table = size - 9 - 12 * n
    file.seek(table)
    seek = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
    file.seek(table - 8 - 9 * n)
    where = file.read(9 * n)
    ids, valid = np.frombuffer(where[: 8 * n], "<i8"), where[8 * n:]
    unpack, at = zstandard.ZstdDecompressor(), 0
    for i, (packed, length, checksum) in enumerate(seek.tolist()):
        doc_id = int(ids[i]) if valid[i] else None
        data = None
        if wanted is None or doc_id in wanted:
            file.seek(at)
            data = unpack.decompress(file.read(packed), max_output_size=length)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"wrong checksum in the frame of document {doc_id}")
        at += packed
        yield doc_id, length // 4, data


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, memo: int = MEMO) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` with the tokenizer file (same path on all executors), appends
    ``end_id`` to each document and writes the parts. Returns the manifest: ``part, path, n_docs,
    n_tokens, first_id, last_id, n_null`` (documents without an id) and ``base``, the ids in the parts before."""
    end = struct.pack("<I", end_id)

    def part(out, batches):
        enc = encoder(tokenizer, memo)

        def rows():
            for b in batches:
                texts = [t or "" for t in b.column("text").to_pylist()]
                for doc_id, data in zip(b.column("doc_id").to_pylist(), enc.encode(texts)):
                    yield doc_id, data + end

        return write_frames(out, rows())

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    d = small_batches(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange(*key).sortWithinPartitions(*key)
    m = write_parts(d, folder, ".ids.zst", part, "n_docs long, n_tokens long, first_id long, last_id long, n_null long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return m.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Reads the parts of a manifest back: ``doc_id, start, n_tokens, ids_crc32, ids``, of the
    documents ``wanted`` only if given (``ids`` is the packed frame content). Parts that can hold none of them
    are not opened."""
    if wanted is not None:
        wanted = set(wanted)
        held = F.lit(None in wanted) & (F.col("n_null") > 0)
        for i in wanted - {None}:
            held = held | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        manifest = manifest.where(held)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                       ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def task(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, path = open_fs(row["path"])
                start, rows, held = row["base"], [], 0
                with fs.open_input_file(path) as file:
                    for doc_id, n, data in read_frames(file, wanted):
                        if data is not None:
                            rows.append((doc_id, start, n, zlib.crc32(data), data))
                            held += len(data)
                        start += n
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)],
                                                             schema=kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)],
                                                     schema=kinds)

    return one_task_each(manifest).mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None,
              memo: int = MEMO) -> DataFrame:
    """Writes the token files (into ``folder``, or a new one below the shared checkpoint folder) and
    returns one row per document as read back from them."""
    folder = folder or new_folder(docs.sparkSession, "token-ids")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, memo)).drop("ids")
