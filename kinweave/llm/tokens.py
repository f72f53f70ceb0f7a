"""Token-id files of length-delimited records, with a separate offset index.

Each document is one record: its length (8 bytes), the masked CRC-32C of those, the packed little-endian
token ids, and their masked CRC-32C. This is the framing of the common record files, so their readers open it.
The index file beside a shard holds, for each record, document id, offset, number of tokens and tokens
before it in the shard, so that readers may visit records in any order.

Texts are dealt out once, by ranges of document ids; a task encodes its range as a stream and writes a shard. A
task's files have names of its attempt, and only finished tasks are in the manifest.

Decisions: a null text is empty and its record holds the end id alone. Missing ids come first, ties by a hash of the text.
Ids take two bytes if the vocabulary and the end id fit, else four. An empty table makes no shard. A checksum or
index that does not match raises.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .checksums import crc32c, masked
from .common import (
    AttemptFile,
    arrow_schema,
    as_batch,
    map_batches,
    new_folder,
    open_folder,
    read_file,
    shuffle_partitions,
    spread,
    text_slices,
)
from .units import REMEMBERED, forget

END_ID = 2

#: Characters encoded together: bounds the work arrays.
ENCODED_CHARS = 1 << 22
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("offset", "<i8"), ("tokens", "<i8"), ("start", "<i8")])
_MANIFEST = "part int, file string, index string, width int, records long, tokens long"


class LibraryEncoder:
    """The tokenizers library; for byte-level files each distinct piece is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        cut = found["pre_tokenizer"] or {}
        self.by_piece = (
            found["normalizer"] is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True)
        )
        self.added = [t["content"] for t in found["added_tokens"]]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        # a byte-level token has one letter for each byte
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.code).tobytes() for x in got]

    def _encoded(self, fresh: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(pieces, their ids one after the other, where each piece ends) for new pieces.

        Those that begin a word at a blank are encoded as one long text and cut again
        where the bytes of the tokens reach the ends of the pieces; that spares an object for each piece.
        """
        joined, rest = [], []
        for p in fresh:
            (joined if p[:1] == " " and p != " " and not p[1].isspace() else rest).append(p)
        for low in range(0, len(joined), 50_000):
            part = joined[low : low + 50_000]
            ids = np.array(
                self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype=self.code
            )
            upto = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum(pc.binary_length(pa.array(part, type=pa.string())).to_numpy(), dtype=np.int64)
            at = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] >= ends[-1] and (upto[at] == ends).all():
                yield part, ids, at + 1
            else:  # a token reaches over the end of a piece: these pieces are encoded one by one
                rest += part
        if rest:
            got = self._whole(rest)
            yield rest, np.frombuffer(b"".join(got), dtype=self.code), np.cumsum([len(x) // self.code.itemsize for x in got])

    def _learn(self, fresh: list[str]) -> None:
        for part, ids, upto in self._encoded(fresh):
            cuts = (upto * self.code.itemsize).tolist()
            packed = ids.tobytes()
            self.known.update(zip(part, map(packed.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Distinct pieces of plain texts: (piece numbers, pieces, number of pieces of each text).

        Cut in Arrow before every blank and between a Latin letter and a full stop or comma, where the
        tokenizer's pattern also begins a new word.
        """
        marked = pc.replace_substring(pa.array(texts, type=pa.large_string()), " ", "\0 ")
        marked = pc.replace_substring_regex(marked, r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF])([.,])", "\\1\0\\2")
        lists = pc.split_pattern(marked, "\0")
        coded = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), sizes

    def _packed(self, texts: list[str]) -> list[bytes]:
        """The packed ids of plain texts: those of their pieces one after the other."""
        number, distinct, sizes = self._cut(texts)
        self.known = known = forget(self.known)
        of_piece = list(map(known.get, distinct))
        if fresh := [p for p, x in zip(distinct, of_piece, strict=True) if x is None]:
            self._learn(fresh)
            of_piece = [known[p] if x is None else x for p, x in zip(distinct, of_piece, strict=True)]
        table = np.frombuffer(b"".join(of_piece), dtype=self.code)
        length = np.fromiter(map(len, of_piece), dtype=np.int64, count=len(of_piece)) // self.code.itemsize
        start = np.cumsum(length) - length
        n = length[number]
        total = np.cumsum(n)
        at = np.repeat(start[number] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        packed = table[at].tobytes()
        ends = (np.concatenate(([0], total))[np.cumsum(sizes)] * self.code.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        """Number of ids of each text; only the counts of pieces are remembered."""
        out = [0] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        for low, high in text_slices([texts[i] for i in plain], ENCODED_CHARS):
            part = plain[low:high]
            number, distinct, sizes = self._cut([texts[i] for i in part])
            self.counts = counts = forget(self.counts, REMEMBERED // 2)
            each = list(map(counts.get, distinct))
            if new := [p for p, n in zip(distinct, each, strict=True) if n is None]:
                for fresh, _, until in self._encoded(new):
                    counts.update(zip(fresh, np.diff(until, prepend=0).tolist(), strict=True))
                each = [counts[p] if n is None else n for p, n in zip(distinct, each, strict=True)]
            each = np.array(each, dtype=np.int64)
            upto = np.concatenate(([0], np.cumsum(each[number])))
            ends = np.cumsum(sizes)
            for i, n in zip(part, (upto[ends] - upto[ends - sizes]).tolist(), strict=True):
                out[i] = n
        odd = sorted(set(range(len(texts))).difference(plain))
        for i, x in zip(odd, self._whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = len(x) // self.code.itemsize
        return out

    def _plain(self, text: str) -> bool:
        return self.by_piece and "  " not in text and "\0" not in text and not any(t in text for t in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._plain(t)]
        for low, high in text_slices([texts[i] for i in plain], ENCODED_CHARS):
            part = plain[low:high]
            for i, x in zip(part, self._packed([texts[i] for i in part]), strict=True):
                out[i] = x
        odd = sorted(set(range(len(texts))).difference(plain))
        for i, x in zip(odd, self._whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = x
        return out


_LOADED: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and n_tokens of every text; no shuffle."""
    kept = docs.select(*keep).schema
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def work(batch):
        own = library_encoder(path)
        carried = {f.name: batch.column(k + 1) for k, f in enumerate(kept)}
        return carried | {"n_tokens": own.count([t or "" for t in batch.column(0).to_pylist()])}

    read = docs.select(F.col("text").alias("_text"), *keep)
    return map_batches(read, work, f"{types}n_tokens long")


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record with its length and checksums."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    of_head = masked(crc32c(heads)).astype("<u4").tobytes()
    of_data = masked(crc32c(payloads)).astype("<u4").tobytes()
    return [
        b"".join((h, of_head[4 * i : 4 * i + 4], p, of_data[4 * i : 4 * i + 4]))
        for i, (h, p) in enumerate(zip(heads, payloads, strict=True))
    ]


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes (doc_id, text) in ascending id order; the manifest, one row for each shard."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # ranges are sampled on the driver, so their key holds a hash and not the text
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    n = shuffle_partitions(docs.sparkSession)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = arrow_schema(_MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = library_encoder(path)
        code = own.code if end_id < 1 << 16 else np.dtype("<u4")
        end = np.array([end_id], dtype=code).tobytes()
        data = index = None
        tokens = records = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                data, index = AttemptFile(folder, "shard"), AttemptFile(folder, "shard-index")
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            coded = own.encode(texts)
            if code != own.code:
                coded = [np.frombuffer(x, dtype=own.code).astype(code).tobytes() for x in coded]
            made = frames([x + end for x in coded])
            rows = np.zeros(len(made), dtype=_INDEX)
            rows["has_id"] = [i is not None for i in ids]
            rows["doc_id"] = [i or 0 for i in ids]
            sizes = np.array([len(x) for x in made])
            rows["tokens"] = (sizes - 16) // code.itemsize
            rows["offset"] = data.size + np.cumsum(sizes) - sizes
            rows["start"] = tokens + np.cumsum(rows["tokens"]) - rows["tokens"]
            data.write(b"".join(made))
            index.write(rows.tobytes())
            tokens += int(rows["tokens"].sum())
            records += len(made)
        if data is not None:
            data.close()
            index.close()
            values = (TaskContext.get().partitionId(), data.name, index.name, code.itemsize, records, tokens)
            yield as_batch({f.name: [v] for f, v in zip(fields, values, strict=True)}, fields)

    return stage(placed.mapInArrow(run, _MANIFEST), "token-manifest")


def _read_index(folder: str, name: str) -> np.ndarray:
    with read_file(folder, name) as stream:
        return np.frombuffer(stream.read(), dtype=_INDEX)


def check_record(head: bytes, payload: bytes, tail: bytes) -> bool:
    want = masked(crc32c([head[:8], payload]))
    return int.from_bytes(head[8:12], "little") == want[0] and int.from_bytes(tail, "little") == want[1]


def read_at(folder: str, manifest_row: dict, places: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records at the given places of a shard, in that order, by the offset index."""
    index = _read_index(folder, manifest_row["index"])
    fs, root = open_folder(folder)
    with fs.open_input_file(f"{root}/{manifest_row['file']}") as f:
        for k in places:
            row = index[k]
            f.seek(int(row["offset"]))
            size = int(row["tokens"]) * manifest_row["width"]
            raw = f.read(size + 16)
            if not check_record(raw[:12], raw[12:-4], raw[-4:]):
                raise ValueError(f"{manifest_row['file']}: record {k} does not match its checksums")
            ids = np.frombuffer(raw[12:-4], dtype=f"<u{manifest_row['width']}")
            yield (int(row["doc_id"]) if row["has_id"] else None), ids


#: Records read and checked together.
_TOGETHER = 256


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, in checked sequential reads of each shard.

    The manifest has one row for each shard; only its running sum of tokens is a window over one task.
    """
    upto = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("first", F.coalesce(upto, F.lit(0)).cast("long"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                index = _read_index(folder, shard["index"])
                if len(index) != shard["records"]:
                    raise ValueError(f"{shard['index']}: {len(index)} entries of {shard['records']}")
                with read_file(folder, shard["file"]) as stream:
                    for low in range(0, len(index), _TOGETHER):
                        yield as_batch(_read_some(stream, index[low : low + _TOGETHER], shard), fields)

    return spread(manifest.sparkSession, shards).mapInArrow(run, schema)


def _read_some(stream, index: np.ndarray, shard: dict) -> dict:
    payloads, heads, tails = [], [], []
    for row in index:
        head = stream.read(12)
        size = int.from_bytes(head[:8], "little")
        if size != int(row["tokens"]) * shard["width"]:
            raise ValueError(f"{shard['file']}: a record of {size} bytes, the index says otherwise")
        heads.append(head)
        payloads.append(stream.read(size))
        tails.append(stream.read(4))
    want_head = masked(crc32c([h[:8] for h in heads])).astype("<u4").tobytes()
    want_data = masked(crc32c(payloads)).astype("<u4").tobytes()
    if want_head != b"".join(h[8:] for h in heads) or want_data != b"".join(tails):
        raise ValueError(f"{shard['file']}: a record does not match its checksums")
    code = f"<u{shard['width']}"
    return {
        "doc_id": [int(r["doc_id"]) if r["has_id"] else None for r in index],
        "start": (index["start"] + shard["first"]).tolist(),
        "n_tokens": [len(p) // shard["width"] for p in payloads],
        "ids_crc32": [zlib.crc32(np.frombuffer(p, dtype=code).astype("<u4").tobytes()) for p in payloads],
    }


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_records(write_records(docs, path, folder, end_id), folder)
