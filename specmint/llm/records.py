"""Token ids in length-delimited binary records with a separate offset index.

File format, all integers little-endian. A data file is a run of frames:

    u64 payload length | u32 masked CRC of those 8 bytes | payload | u32 masked CRC of the payload

The payload is ``i64 doc_id, u8 flags (1: doc_id is null, 2: ids are u32, else u16), ids``.
The index file holds the u64 offset of each frame and, last, the data file's length,
so a reader can take frames in any order. A masked checksum is the CRC-32 rotated
right by 15 bits plus a constant, so that checksums of data holding checksums stay sound.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmint.llm.common import bound_batches, slices, table
from specmint.storage import materialize, new_path

MASK_DELTA = 0xA282EAD8
_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<qB")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at offset `at` and the next offset; ValueError on any damage."""
    if at + 12 > len(data):
        raise ValueError("truncated record length")
    size, crc = _FRAME.unpack_from(data, at)
    if masked_crc(bytes(data[at : at + 8])) != crc:
        raise ValueError("damaged record length")
    end = at + 12 + size
    if end + 4 > len(data):
        raise ValueError("truncated record")
    payload = data[at + 12 : end]
    if masked_crc(bytes(payload)) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("damaged record")
    return payload, end + 4


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a qualified URI as Hadoop prints it (file:/x or scheme://host/x)."""
    scheme, _, rest = uri.partition(":")
    return pyarrow.fs.FileSystem.from_uri(uri if rest.startswith("//") else f"{scheme}://{rest}")


def record(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return frame(_HEAD.pack(doc_id or 0, (doc_id is None) | 2 * wide) + ids)


#: The normalizer and pre-tokenizer under which a text's ids are those of its blank-separated pieces.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What str.split() takes for blanks and the tokenizer for symbols.
_FALSE_BLANKS = "\x1c\x1d\x1e\x1f"
#: Letters below this are letters in every version of Unicode that a library may hold.
_LATIN_END = "\u0250"
#: Words that the normalizer leaves as letters: below U+0180 nothing but U+0130 turns into anything else than one letter.
_PLAIN_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class WordEncoder:
    """Ids of whole texts, encoded by the tokenizers library, piece by piece with a cache where that is the same.

    It is the same for a tokenizer that drops white space and never merges over it: its normalizer
    and pre-tokenizer are read from its file and compared with the two above, and no added token may hold a
    blank or be taken for a word or a run of punctuation. Any other tokenizer gets whole texts, and so does a text with U+001C to U+001F, which only Python
    takes for blanks. Texts in Latin-1 are in NFC and are lower-cased at once, so that a word is one piece
    in either case, unless they then hold an added token. A piece of Latin letters followed by ASCII punctuation splits once more, as the
    pre-tokenizer does, if what the normalizer makes of the letters is Latin letters alone. Lower-case ASCII
    words go straight to the library's BPE model; other words of letters are encoded many to a call;
    anything else is encoded alone. Beyond `limit` entries the caches take no more: that costs time,
    never a result.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        odd = any(a != "".join(a.split()) or a.rstrip(string.punctuation).isalpha() or not a.strip(string.punctuation) for a in self.added)
        odd = odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.piecewise = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not odd
        self.limit = limit
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.pieces: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'I' if self.wide else 'H'}", *ids)

    def _folded(self, text: str) -> str:
        """A Latin-1 text in lower case, as the normalizer has it; any other text as it is."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(a in low for a in self.added) else low

    def _letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters, non-ASCII ones included: one pre-token each, or else encoded alone."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.asarray(got.ids, self.dtype), np.asarray(got.word_ids)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)) * self.dtype.itemsize
            if len(owner) and owner[-1] + 1 == len(part):
                packed, cuts = ids.tobytes(), cuts.tolist()
                yield from ((w, packed[cuts[i] : cuts[i + 1]]) for i, w in enumerate(part))
            else:
                yield from self._alone(part)

    def _alone(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for piece, got in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
            yield piece, self._pack(got.ids)

    def _stay_letters(self, core: str) -> bool:
        """Whether the normalizer leaves nothing but Latin letters; it may set a mark free that joins what follows."""
        if _PLAIN_LATIN.fullmatch(core):
            return True
        plain = self.tokenizer.normalizer.normalize_str(core)
        return plain.isalpha() and max(plain) < _LATIN_END

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks."""
        cores, split, plain, letters, odd = self.cores, [], set(), set(), set()
        for piece in missing:
            core = piece.rstrip(string.punctuation)
            tail = piece[len(core) :]
            if not core.isalpha():
                odd.add(piece)
                continue
            if core.isascii():
                core = core.lower()
                if core not in cores:
                    plain.add(core)
            elif core not in cores and core not in letters:
                if not self._stay_letters(core):
                    odd.add(piece)
                    continue
                letters.add(core)
            if tail:
                odd.add(tail)
            split.append((piece, core, tail))
        tokenize, pack = self.model.tokenize, self._pack
        known = {w: pack([t.id for t in tokenize(w)]) for w in plain}
        known.update(self._letters(sorted(letters)))
        alone = dict(self._alone(sorted(odd)))
        for piece, core, tail in split:
            ids = known.get(core) or cores[core]
            alone[piece] = ids + alone[tail] if tail else ids
        if len(cores) < self.limit:
            cores.update(known)
        if len(self.pieces) < self.limit:
            self.pieces.update(alone)
        return alone

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; its distinct pieces are looked up, and what the cache lacks is learned, for all texts at once."""
        whole = [i for i, t in enumerate(texts) if t and (not self.piecewise or any(c in t for c in _FALSE_BLANKS))]
        given = dict(zip(whole, (ids for _, ids in self._alone([texts[i] for i in whole])), strict=True)) if whole else {}
        words = [self._folded(t).split() if t and i not in given else [] for i, t in enumerate(texts)]
        distinct: set[str] = set()
        for w in words:
            distinct.update(w)
        missing = distinct.difference(self.pieces)
        known = distinct - missing
        ids = dict(zip(known, map(self.pieces.__getitem__, known), strict=True))
        if missing:
            ids.update(self._learn(missing))
        return [given[i] if i in given else b"".join(map(ids.__getitem__, w)) for i, w in enumerate(words)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process; workers are reused, so its cache lasts over tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write every row's ids, in ascending doc_id order, and return the manifest.

    Rows are range-partitioned by doc_id (nulls first), hash of the text and place in the input, so that
    even rows without an id, or with one and the same, are spread; one data file and one index file
    per partition. File names carry a random part, and the manifest
    names those of the attempt that Spark committed: a retried or speculative task
    leaves an unnamed file at worst, never a half-written one that is read.
    Columns: part int, data string, index string, n_records long, n_tokens long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        offsets, at, tokens, out = [], 0, 0, None
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.rec")
            for some in slices(batch):
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    framed = record(doc_id, ids + end, enc.wide)
                    out.write(framed)
                    offsets.append(at)
                    at += len(framed)
                    tokens += len(ids) // enc.dtype.itemsize + 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.asarray([*offsets, at], "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [f"{folder}/{name}.rec"], "index": [f"{folder}/{name}.idx"], "n_records": [len(offsets)], "n_tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "text_hash", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(run, "part int, data string, index string, n_records long, n_tokens long"), "records-manifest")


def _read_file(data: str, index: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record of a file by its index, a few MB at a time; ids as u32."""
    fs, path = open_fs(data)
    index_fs, index_path = open_fs(index)
    with index_fs.open_input_stream(index_path) as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with fs.open_input_file(path) as f:
        k, n = 0, len(offsets) - 1
        while k < n:
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (4 << 20), side="right")) - 1)
            f.seek(int(offsets[k]))
            block = memoryview(f.read(int(offsets[stop] - offsets[k])))
            for i in range(k, stop):
                payload, end = unframe(block, int(offsets[i] - offsets[k]))
                if end != offsets[i + 1] - offsets[k]:
                    raise ValueError("the index doesn't match the records")
                doc_id, flags = _HEAD.unpack_from(payload)
                yield None if flags & 1 else doc_id, np.frombuffer(payload[_HEAD.size :], "<u4" if flags & 2 else "<u2").astype("<u4")
            k = stop


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record: one task per file, read by its index.

    The manifest has one row per file; only its running token count passes the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    rows, start = [], 0
    for r in files:
        rows.append((r["data"], r["index"], start))
        start += r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out: list[tuple] = []
                for doc_id, ids in _read_file(data, index):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(out) == 8192:
                        yield _digests(out)
                        out = []
                if out:
                    yield _digests(out)

    source = spark.createDataFrame(rows, "data string, index string, start long").repartition(max(1, len(rows)))
    return source.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all rows as token records below the shared folder and read them back.

    A null or empty text is a record of the end id alone; repeated rows are repeated
    records; a null doc_id comes first and stays null; an empty table gives no file and
    no row; columns other than doc_id and text are ignored.
    """
    manifest = write_records(docs, new_path(spark, "tokens"), tokenizer or default_tokenizer())
    return read_records(spark, manifest)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"))


def token_records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of `encode_documents` for what is left."""
    bound_batches(spark)
    return encode_documents(spark, docs)
