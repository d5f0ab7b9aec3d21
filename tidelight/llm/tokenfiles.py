"""Token-id files with Elias-Fano document boundaries.

A shard file holds the ids of consecutive documents, concatenated, then the boundaries and
the document ids as two Elias-Fano sequences, then a fixed trailer that says where they start:

    ids (u16 or u32, little endian) | boundaries | document ids | trailer

An Elias-Fano sequence of n values below u takes n * (2 + log2(u / n)) bits: the low bits of
each value packed, the high bits in unary. ``select(i)`` finds value i from a directory of the
position of every 256th set bit, so no table of 64-bit offsets is needed.

Documents are dealt to shards by ranges of their id and sorted there, so shard order and the
order inside a shard are the ascending order of ids. The bounds of the ranges come from a
sample, the rows all go through. Files are written to a name of the attempt and then renamed;
a repeated task writes the same bytes.

Defined cases: a null or empty text has the end id alone; rows with a null id come first;
repeated rows and equal ids are all written, in the order of their texts; an empty table gives
no shards and no rows; other columns are not read. Ids of documents are any 64-bit integers.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, collector_off, partitions, shared_dir, worker_value

MAGIC = b"TLTOKEF1"
TRAILER = np.dtype([("docs", "<u8"), ("nulls", "<u8"), ("ids", "<u8"), ("ends_at", "<u8"), ("keys_at", "<u8"),
                    ("least", "<i8"), ("width", "<u8"), ("magic", "S8")])
SELECT_STEP = 256
CACHE_WORDS = 450_000
TEXTS_AT_ONCE = 1000
LINES_AT_ONCE = 20_000
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class EliasFano:
    """Non-decreasing sequence of unsigned integers."""

    HEAD = np.dtype([("n", "<u8"), ("low", "<u8"), ("low_bytes", "<u8"), ("high_bytes", "<u8"), ("samples", "<u8")])

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"),
                   at[::SELECT_STEP].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = np.array([(self.n, self.low, len(self.lows), len(self.highs), len(self.samples))], self.HEAD)
        return head.tobytes() + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        h, at = np.frombuffer(data, cls.HEAD, 1)[0], cls.HEAD.itemsize
        lows = np.frombuffer(data, np.uint8, int(h["low_bytes"]), at)
        highs = np.frombuffer(data, np.uint8, int(h["high_bytes"]), at + len(lows))
        samples = np.frombuffer(data, "<u8", int(h["samples"]), at + len(lows) + len(highs))
        return cls(int(h["n"]), int(h["low"]), lows, highs, samples)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.highs, bitorder="little")).astype(np.uint64)
        values = (at - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        for k in range(self.low):
            values |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return values

    def select(self, i: int) -> int:
        """Value ``i``, touching one directory entry and the few bytes behind it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        byte = at // 8
        first = int(self.highs[byte]) >> (at % 8) << (at % 8)
        left += 1
        while (ones := first.bit_count()) < left:
            left -= ones
            byte += 1
            first = int(self.highs[byte])
        for _ in range(left - 1):
            first &= first - 1
        pos = byte * 8 + (first & -first).bit_length() - 1
        start = i * self.low
        chunk = int.from_bytes(self.lows[start // 8 : (start + self.low + 7) // 8].tobytes(), "little")
        return (pos - i) << self.low | chunk >> (start % 8) & ((1 << self.low) - 1)


class _Words(dict):
    """Number of each word, given when it is first asked for."""

    def __init__(self, known=()):
        super().__init__(zip(known, range(len(known))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of whole texts. Between a word and the single space before the next one the
    byte-level pre-tokenizer always splits, so the parts between such places are encoded once
    and their ids reused; a text where a space stands inside a run of white space, or that holds
    a special token, is encoded as it is. New parts are encoded many at a time, as lines of one
    text: a line end between two words is a token of its own."""

    UNSAFE = re.compile(r"\s \s|\s \Z")
    LINE = re.compile(r" ?\S+")
    TWO_LINES = re.compile(r" ?\S+\n\S+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.line_end = self.tok.encode("\n", add_special_tokens=False).ids
        self.by_part = self._splits_before_spaces() and len(self.line_end) == 1
        self._clear()

    def _splits_before_spaces(self) -> bool:
        import json

        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space") and pre.get("use_regex", True))

    def _clear(self):
        self.words = _Words()
        self.flat = np.empty(0, np.uint32)
        self.starts, self.sizes, self.uses = (np.empty(0, np.int64) for _ in range(3))

    def _trim(self):
        """Keep the words that were met again, half of the room at most."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > CACHE_WORDS // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: CACHE_WORDS // 2]])
        names = list(self.words)
        self.flat, self.sizes = self._gather(keep)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.uses = np.ones(len(keep), np.int64)
        self.words = _Words([names[i] for i in keep.tolist()])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray):
        self.starts[numbers] = len(self.flat) + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.flat = np.concatenate([self.flat, ids])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[numbers] - (ends - n), n) + np.arange(n.sum())], n

    def _learn(self):
        """Ids of the words that have a number and no ids yet. A word with a full stop or comma
        behind a letter, and two words around a line end, are put together from their parts."""
        words, new = self.words, self.words.new
        if not new:
            return
        stops = {c: words[" " + c] for c in ".,\n"}
        lines, odd, stopped, joined = [], [], [], []
        number = len(self.starts)
        for w in new:  # grows by the parts
            if "\n" in w and self.TWO_LINES.fullmatch(w):
                left, right = w.split("\n")
                joined.append((number, words[left], stops["\n"], words[" " + right]))
            elif w[-1:] in ".," and w[-2:-1].isalpha() and "\n" not in w:
                stopped.append((number, words[w[:-1]], stops[w[-1]]))
            else:
                text = w[1:] if w[:1] == " " else " " + w
                (lines if self.LINE.fullmatch(text) else odd).append((number, text))
            number += 1
        words.new = []
        grown = np.zeros(number - len(self.starts), np.int64)
        self.starts, self.sizes, self.uses = (np.concatenate([x, grown]) for x in (self.starts, self.sizes, self.uses))
        for at in range(0, len(lines), LINES_AT_ONCE):
            part = lines[at : at + LINES_AT_ONCE]
            ids = self._plain(["\n".join(t for _, t in part)])[0]
            ends = np.flatnonzero(np.append(ids, self.line_end) == self.line_end[0])
            self._add([k for k, _ in part], ids[ids != self.line_end[0]], np.diff(ends, prepend=-1) - 1)
        if odd:
            got = self._plain([t for _, t in odd])
            self._add([k for k, _ in odd], np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))
        for made in (stopped, joined):
            if made:
                table = np.array(made, np.int64)
                ids, sizes = self._gather(table[:, 1:].ravel())
                self._add(table[:, 0].tolist(), ids, sizes.reshape(len(table), -1).sum(axis=1))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and how many each has."""
        if self.by_part:
            whole = [self.UNSAFE.search(t) is not None or any(s in t for s in self.special) for t in texts]
        else:
            whole = [True] * len(texts)
        if any(whole):
            plain = dict(zip((i for i, w in enumerate(whole) if w), self._plain([t for t, w in zip(texts, whole) if w])))
            rest = [t for t, w in zip(texts, whole) if not w]
            ids, sizes = self.encode_flat(rest) if rest else (np.empty(0, np.uint32), np.empty(0, np.int64))
            cuts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            out = [plain[i] if w else next(cuts) for i, w in enumerate(whole)]
            return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))
        if len(self.words) > CACHE_WORDS:
            self._trim()
        parts: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            p = t.split(" ")
            p[0] = " " + p[0]  # no space before it; no other part begins with one
            counts[i] = len(p)
            parts += p
        at = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        self._learn()
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, n = self._gather(at)
        return ids, np.add.reduceat(n, np.cumsum(counts) - counts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.encode_flat(texts)
        return np.split(ids, np.cumsum(sizes)[:-1])


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode every text of ``docs`` and write shard files into ``folder``.

    Returns the manifest: shard number, path, documents and ids of each file. It is written as
    a table beside the files, from what the tasks return: a row for each file.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("k"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes), partitions(spark) if size > shard_bytes // 8 else 1)
    dealt = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = sink = None
        keys, ends, total = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = worker_value(("encoder", tokenizer), lambda: Encoder(tokenizer))
                kind = np.dtype("<u4" if encoder.wide else "<u2")
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/shard-{task.partitionId():06d}"
                temp = f"{name}.{task.taskAttemptId()}.tmp"
                sink = store.open_output_stream(temp)
            keys += batch.column(0).to_pylist()
            texts = batch.column(1)
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                got, sizes = encoder.encode_flat(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
                sizes = sizes + 1
                flat = np.full(int(sizes.sum()), end_id, kind)
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(sizes) - 1] = False
                flat[keep] = got
                sink.write(flat.tobytes())
                ends.append(total + np.cumsum(sizes))
                total += len(flat)
        if sink is None:
            return
        given = np.array([k for k in keys if k is not None], np.int64)
        least = int(given[0]) if len(given) else 0
        bounds = EliasFano.of(np.concatenate([[0], *ends])).to_bytes()
        ids = EliasFano.of(given.astype(np.uint64) - np.int64(least).astype(np.uint64)).to_bytes()
        at = total * kind.itemsize
        sink.write(bounds + ids)
        sink.write(np.array([(len(keys), len(keys) - len(given), total, at, at + len(bounds), least, kind.itemsize, MAGIC)],
                            TRAILER).tobytes())
        sink.close()
        store.move(temp, f"{name}.bin")
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/shard-{task.partitionId():06d}.bin"]),
                               pa.array([len(keys)], pa.int64()), pa.array([total], pa.int64())],
                              names=["shard", "path", "n_docs", "n_tokens"])

    dealt.mapInArrow(collector_off(write, keep_values=True), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Shard:
    """Random access to one file."""

    def __init__(self, path: str):
        store, name = _store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        self.meta = np.frombuffer(self.file.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)[0]
        if self.meta["magic"] != MAGIC:
            raise ValueError(f"{path} is no token file")
        ends, keys = int(self.meta["ends_at"]), int(self.meta["keys_at"])
        self.bounds = EliasFano.from_bytes(self.file.read_at(keys - ends, ends))
        self.keys = EliasFano.from_bytes(self.file.read_at(size - TRAILER.itemsize - keys, keys))
        self.kind = np.dtype("<u2" if self.meta["width"] == 2 else "<u4")

    def read(self, start: int, stop: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * w, start * w), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.read(self.bounds.select(i), self.bounds.select(i + 1))

    def doc_ids(self) -> list[int | None]:
        return [None] * int(self.meta["nulls"]) + (self.keys.all().astype(np.int64) + self.meta["least"]).tolist()


def read_files(spark: SparkSession, manifest: DataFrame, block: int = 1 << 22) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row for each file of many megabytes, so one window over them is small
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    spread = based.repartitionByRange(max(1, manifest.count()), "shard")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = Shard(path)
                keys, bounds = shard.doc_ids(), shard.bounds.all().astype(np.int64)
                i = 0
                while i < len(keys):
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, "right")) - 1)
                    ids = shard.read(int(bounds[i]), int(bounds[j])).astype("<u4")
                    cut = bounds[i : j + 1] - bounds[i]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.record_batch([pa.array(keys[i:j], pa.int64()), pa.array(base + bounds[i:j]), pa.array(np.diff(cut)),
                                           pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files and return what they hold for each document."""
    spark = docs.sparkSession
    return read_files(spark, write_files(docs, tokenizer, folder or shared_dir(spark), **options))
