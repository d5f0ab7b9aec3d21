"""Documents that contain test items, found by BM25 retrieval and confirmed word by word.

Index: for each item, BM25 weights of its words (document frequencies over all items), divided by
the item's own score, so that a passage with all its words scores 1. Items stand in blocks of 4;
a block keeps its weights and, for each word, their maximum.

Query: every passage of every document, two stretches of words that overlap by one, a stretch
being the longest item; so each item lies in one passage whole. The test of block-max WAND is
made for all passages of many documents at once: the maxima of a stretch's words are summed for
each block, two stretches bound a passage, and only blocks that reach the threshold are looked
at again with the passage's own words, then scored item by item. All items at or over the threshold are retrieved.

Check: of the five-word runs of the item's question, and of those of its answer, a share of
``overlap`` at least must stand in the passage. The answer is what follows the last question
mark; a part shorter than five words is one run. An item without a marked answer is all question,
and its answer overlap is 1. A changed word breaks five runs, too many for a short item; so the
first three quarters of its words and the last one may each reach ``overlap`` instead, where only
runs across their border are broken. The overlaps are then those of these two parts.

Items are few next to documents. They go to the tasks in groups of at most ``group_bytes`` of
text, one pass over the documents for each group, so what is sent is bounded; documents are never
shuffled.

Defined cases: null or empty texts and items match nothing; repeated rows and equal ids are rows
of their own, in documents and items; empty tables give no hits; other columns are not read by
``matches`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, collector_off, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
K1, B = 1.2, 0.75
BLOCK = 4
WORDS_AT_ONCE = 40_000
GRAM = 5
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item, as words; no answer where the item marks none."""
    head, mark, tail = text.rpartition("?")
    if mark and split_words(head) and split_words(tail):
        return split_words(head), split_words(tail)
    return split_words(text), []


def ways(text: str) -> list[tuple[list[tuple], list[tuple]]]:
    """Runs of two parts of an item; all of any pair must be confirmed. The first is question and answer."""
    question, answer = parts(text)
    pairs = [(question, answer)]
    if not answer and len(question) > 1:
        n = len(question) - max(1, len(question) // 4)
        pairs.append((question[:n], question[n:]))
    return [(runs(a), runs(b)) for a, b in pairs]


def runs(words: list[bytes]) -> list[tuple]:
    n = min(GRAM, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def postings(items: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """row, item_id, text, dl, words: an array of (word, weight) for each item with a word."""
    rows = items.select(col(id_col).cast("long").alias("item_id"), col(text_col).alias("text"))
    rows = rows.withColumn("ws", F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)))
    rows = stage(rows.where(F.size("ws") > 0).withColumn("dl", F.size("ws")).withColumn("row", F.monotonically_increasing_id()))
    n, length = rows.agg(F.count("*"), F.avg("dl")).first()
    tf = rows.select("row", "dl", F.explode("ws").alias("word")).groupBy("row", "dl", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(length or 1.0))
    weighed = tf.join(df, "word").withColumn("w", idf * F.col("tf") * (K1 + 1) / norm)
    words = weighed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "w"))).alias("words"))  # of one item
    return stage(rows.drop("ws").join(words, "row"))


class _Vocab(dict):
    """Number of each word of the items; of any other word, the number after the last."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


class Index:
    """Blocks of items, their weights and the greatest weight of each word in each block."""

    def __init__(self, rows: list, stretch: int, threshold: float, overlap: float):
        rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.row))
        self.stretch, self.threshold, self.overlap = stretch, threshold - 1e-9, overlap
        self.items, self.blocks = [], []
        vocab: dict[bytes, int] = {}
        for at in range(0, len(rows), BLOCK):
            terms: dict[int, dict[int, float]] = {}
            for k, r in enumerate(rows[at : at + BLOCK]):
                own = sum(w for _, w in r.words)
                for word, w in r.words:
                    terms.setdefault(vocab.setdefault(word.encode(), len(vocab)), {})[k] = w / own
                self.items.append((r.item_id, ways(r.text)))
            ids = np.array(sorted(terms))
            table = np.zeros((len(ids), min(BLOCK, len(rows) - at)))
            for i, term in enumerate(ids.tolist()):
                for k, w in terms[term].items():
                    table[i, k] = w
            self.blocks.append((ids, table))
        self.vocab = _Vocab(vocab)
        self.bounds = np.zeros((len(vocab) + 1, len(self.blocks)), np.float32)
        for k, (ids, table) in enumerate(self.blocks):
            self.bounds[ids, k] = table.max(axis=1)

    def retrieve(self, docs: list[list[bytes]]):
        """(document, item number, score, first, last word) of all items at or over the threshold in ``docs``."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter(map(self.vocab.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        stretches = np.maximum(-(-sizes // self.stretch), 1)
        bases = np.cumsum(stretches) - stretches
        of = np.repeat(np.arange(len(docs)), sizes)
        known = np.flatnonzero(ids < len(self.vocab))
        if not len(known):
            return
        where = bases[of[known]] + (known - begins[of[known]]) // self.stretch
        keys = np.unique(where << 32 | ids[known])
        where, words = keys >> 32, keys & 0xFFFFFFFF
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        # one row more than there are stretches: what follows the only stretch of a document
        sums = np.zeros((int(stretches.sum()) + 1, len(self.blocks)), np.float32)
        sums[where[first]] = np.add.reduceat(self.bounds[words], first, axis=0)
        count = np.maximum(stretches - 1, 1)
        doc = np.repeat(np.arange(len(docs)), count)
        p = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = bases[doc] + p
        reach = sums[at] + sums[np.where(stretches[doc] > 1, at + 1, len(sums) - 1)] >= self.threshold - 1e-4
        seen, own = -1, None
        for i, k in zip(*(x.tolist() for x in np.nonzero(reach))):
            d = int(doc[i])
            a = int(p[i]) * self.stretch
            b = min(a + 2 * self.stretch, int(sizes[d]))
            if i != seen:
                seen, own = i, np.unique(ids[begins[d] + a : begins[d] + b])
            if self.bounds[own, k].sum() < self.threshold - 1e-4:
                continue
            terms, table = self.blocks[k]
            scores = table[np.isin(terms, own, assume_unique=True)].sum(axis=0)
            for j in np.flatnonzero(scores >= self.threshold):
                yield d, k * BLOCK + int(j), float(scores[j]), a, b

    def hits(self, texts: list[str | None]) -> list[tuple]:
        """(text number, item_id, score, question overlap, answer overlap): the best confirmed passage of each item."""
        out, docs, start, size = [], [], 0, 0
        for t in texts:
            docs.append(split_words(t))
            size += len(docs[-1])
            if size >= WORDS_AT_ONCE:
                out += self._confirmed(docs, start)
                docs, start, size = [], start + len(docs), 0
        return out + self._confirmed(docs, start)

    def _confirmed(self, docs: list[list[bytes]], start: int) -> list[tuple]:
        best: dict[tuple, tuple] = {}
        for d, item, score, a, b in self.retrieve(docs) if docs else ():
            passage = docs[d][a:b]
            there: dict[int, set] = {}
            for way in self.items[item][1]:
                shares = []
                for part in way:
                    if part:
                        n = len(part[0])
                        if n not in there:
                            there[n] = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                        shares.append(sum(r in there[n] for r in part) / len(part))
                    else:
                        shares.append(1.0)
                if min(shares) >= self.overlap:
                    best[d, item] = max(best.get((d, item), (0.0,)), (score, *shares))
                    break
        return [(start + d, self.items[i][0], *v) for (d, i), v in sorted(best.items())]


def _groups(items: DataFrame, group_bytes: int, id_col: str, text_col: str):
    """Rows of the index, group by group, and the words of the longest item of all."""
    made = postings(items, id_col, text_col)
    size, longest = made.agg(F.sum(F.octet_length("text")), F.max("dl")).first()
    n = -(-(size or 0) // group_bytes)
    for k in range(n):
        yield made.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).collect(), longest


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, id_col="doc_id", text_col="text",
            item_id_col="item_id", item_text_col="text", group_bytes: int = 256 << 10) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every document and item it holds."""
    rows = docs.select(col(id_col).cast("long"), col(text_col))
    out = docs.sparkSession.createDataFrame([], HITS)
    for group, longest in _groups(items, group_bytes, item_id_col, item_text_col):
        index = Index(group, longest, threshold, overlap)

        @collector_off
        def find(batches, index=index):
            for batch in batches:
                keys, texts = (c.to_pylist() for c in batch.columns)
                found = [(keys[i], *h) for i, *h in index.hits(texts)]
                cols = list(zip(*found)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in HITS.split(", ")])

        out = out.unionByName(rows.mapInArrow(find, HITS))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, text_col="text", item_id_col="item_id",
          item_text_col="text", group_bytes: int = 256 << 10) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text_col)
    for group, longest in _groups(items, group_bytes, item_id_col, item_text_col):
        index = Index(group, longest, threshold, overlap)

        @collector_off
        def keep(batches, index=index):
            for batch in batches:
                bad = {i for i, *_ in index.hits(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
