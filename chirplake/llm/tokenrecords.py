"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A shard is a run of records: length of the payload (uint64), masked crc32 of those eight bytes (uint32), payload, masked
crc32 of the payload (uint32), all little-endian. A payload is: bytes of an id (2 or 4), whether there is a document id
(0 or 1), the document id (int64), the token ids. A checksum c is masked as rotate-right(c, 15) + 0xa282ead8.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chirplake.llm.shared import new_path, pieces

END_ID = 2
WORDS_HELD, STEMS_AT_ONCE, DOCS_AT_ONCE = 600_000, 2000, 500
MARKS = ".,;:!?%$&#*"
INDEX = "shard int, path string, offset long, length long, before long, n_tokens long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; ValueError where a length or checksum is wrong."""
    size, check = record[:8], struct.unpack("<I", record[8:12])[0]
    if masked(size) != check or struct.unpack("<Q", size)[0] != len(record) - 16:
        raise ValueError("damaged record length")
    payload = record[12:-4]
    if masked(payload) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("damaged record")
    return payload


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<BBq", wide, doc_id is not None, doc_id or 0) + ids.astype(f"<u{wide}").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    wide, known, doc_id = struct.unpack("<BBq", payload[:10])
    return doc_id if known else None, np.frombuffer(payload, f"<u{wide}", offset=10)


def stem(word: str) -> str:
    """A word without the marks at its end; the word itself if what is left would not end in a letter or digit, for the
    tokenizer takes marks in a row together."""
    short = word.rstrip(MARKS)
    return short if short[-1:].lower()[-1:].isalnum() else word


def plain_case(word: str) -> str:
    """Lower case, which the tokenizer makes too, for words that can't hold a special token and where it is one to one."""
    return word.lower() if word.isascii() and "<" not in word else word


#: What a tokenizer must do before its model to be taken apart by words: fixed values, as its file has them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(tokenizer: Tokenizer) -> bool:
    """Whether nothing that the tokenizer does crosses a blank, and marks at the end of a word are apart from it."""
    spec = json.loads(tokenizer.to_str())
    normal, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    if normal.get("normalizers") != NORMALIZERS or spec["truncation"] or spec["padding"] or spec["model"].get("dropout"):
        return False
    first, *rest = split.get("pretokenizers") or [{}]
    ways = first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")
    if ways != ("Split", {"Regex": SPLIT}, "Removed", True) or [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] != [("ByteLevel", False, False)]:
        return False
    added = spec["added_tokens"]
    return all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or set(t["content"]) & set(" \n")) for t in added)


class WordEncoder:
    """Ids of whole texts from a tokenizer; where it works by words (:func:`parts_words`), each word is encoded once.

    Other tokenizers get whole texts. Words that were seen lately are held, at most WORDS_HELD of them, and so are their stems, without the marks at their
    end, which the tokenizer parts as well. Stems of letters a-z, which its normaliser and pre-tokeniser leave as they
    are, go to its model; the others go to it as one text, apart by a special token, which makes fewer objects than texts
    of their own would.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = parts_words(self.tokenizer)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.specials = [c for _, c in special]
        self.cut_id, self.cut = max(special) if special else (-1, "")
        self.held: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        words = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.held) > WORDS_HELD:
            self.held.clear()
        if len(self.stems) > WORDS_HELD:
            self.stems.clear()
        held, stems = self.held, self.stems
        parts = {w: stem(w) for w in set(chain.from_iterable(words)).difference(held)}
        tails = {w: w[len(s) :] for w, s in parts.items()}
        parts = {w: plain_case(s) for w, s in parts.items()}
        new = sorted({*parts.values(), *tails.values()}.difference(stems))
        tokenize = self.tokenizer.model.tokenize
        for w in [w for w in new if w.isascii() and w.isalpha() and w.islower()]:
            stems[w] = np.array([t.id for t in tokenize(w)], "<u4").tobytes()
        new = [w for w in new if w not in stems]
        plain = [w for w in new if self.cut and not any(c in w for c in self.specials)]
        for part in pieces(plain, STEMS_AT_ONCE):
            self.encode_joined(part)
        for part in pieces([w for w in new if w not in stems], STEMS_AT_ONCE):
            for word, got in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                stems[word] = np.array(got.ids, "<u4").tobytes()
        for w, s in parts.items():
            held[w] = stems[s] + stems[tails[w]]
        return [np.frombuffer(b"".join(map(held.__getitem__, x)), "<u4") for x in words]

    def encode_joined(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(self.cut.join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == self.cut_id)
        if len(cuts) != len(words) - 1:
            return  # left for the tokenizer one by one
        data = ids.tobytes()
        for word, a, b in zip(words, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)], strict=True):
            self.stems[word] = data[a:b]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The folder may be a plain path or the URI of any store that Arrow knows."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_records(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as shards to ``folder``, by ascending doc_id over all shards; gives the index (INDEX) as a table.

    Ranges of ids make the shards, and each task writes one, under another name until it is whole; a task that runs
    again writes the same bytes. The index, in ``folder``/index, has for each record its place, its length, its number of
    ids, and the ids before it in its shard. A null text has the end id only; null ids come last; rows of the same id are
    in order of their text. An empty table gives an empty index. Other columns aren't read.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, out, stream, at, before = context.partitionId(), None, None, 0, 0
        fs, root = filesystem(folder)
        final = f"{root}/shard-{shard:06d}.rec"
        own = f"{final}.{context.taskAttemptId()}.tmp"
        encode = encoder(tokenizer).encode
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(i, DOCS_AT_ONCE)
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(own, compression=None)
                rows = []
                for one, ids in zip(part.column("id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    record = frame(serialize(one, np.append(ids, np.uint32(end_id))))
                    stream.write(record)
                    rows.append((shard, final, at, len(record), before, len(ids) + 1))
                    at, before = at + len(record), before + len(ids) + 1
                out = [pa.array(c) for c in zip(*rows, strict=True)]
                out[0] = out[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(out, names=["shard", "path", "offset", "length", "before", "n_tokens"])
        if stream is not None:
            stream.close()
            fs.move(own, final)

    x = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    x = x.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    index = x.mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def read_records(index: DataFrame, use: Callable[[int | None, np.ndarray], tuple], schema: str, folder: str) -> DataFrame:
    """``use`` of each record of ``index``, in any order that the index is in; ``schema`` names what it gives.

    Columns of the index stay. Records are checked as they are read.
    """
    kept = index.columns
    kind = ", ".join(f"`{n}` {t}" for n, t in index.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        file, name = None, None
        for batch in batches:
            got = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    file, name = fs.open_input_file(path), path
                file.seek(offset)
                got.append(use(*deserialize(unframe(file.read(length)))))
            columns = zip(*got, strict=True) if got else [[]] * len(added)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names=[*kept, *added]
            )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    added, kinds = arrow.names, arrow.types
    return index.mapInArrow(run, f"{kind}, {schema}")


def digest(doc_id: int | None, ids: np.ndarray) -> tuple:
    return doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def encode_corpus(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files that it is written to.

    start counts the ids of all documents before it: those in its shard, from the index, and those of the shards before,
    whose sums are one row a shard. Cases as in :func:`write_records`.
    """
    folder = folder or new_path(docs.sparkSession, "records")
    index = write_records(docs, folder, tokenizer)
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    read = read_records(index.drop("n_tokens"), digest, "doc_id long, n_tokens long, ids_crc32 long", folder)
    return read.join(F.broadcast(sums), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


