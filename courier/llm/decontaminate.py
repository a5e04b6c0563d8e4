"""Benchmark decontamination: an FM-index for each shard of training text, searched for the benchmark's phrases.

The phrases are all windows of 13 consecutive words of an item (an item of fewer words is one). A shard is a stretch
of one partition's documents. Its words are numbered by the benchmark's vocabulary; other words, and stretches too
short for any phrase, can't be part of an occurrence and become separators, so the index holds what could match. All
phrases are searched backwards at once through wavelet-matrix ranks, their places are found from sampled suffix
positions and merged into removal spans. Words are numbered by their bytes, so every match is exact.

The benchmark is read by the driver only while it is within `max_bytes`; a larger one is searched in blocks of
items, and the spans of the blocks are merged by document.

Nulls: null texts have no words. Null item texts have no windows; a null item id is left out. Items that repeat an id
count once. A null document id keeps its row. Rows with equal ids each have a row, except with several benchmark
blocks, where a row is known by a number of its own. Empty tables: no windows, nothing hit. Columns besides id and
text pass through `remove` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, cut_table
from .fm_index import FmIndex
from .words import ALNUM, Words, slices, utf8

WINDOW = 13
SHARD_BYTES = 1 << 20
#: Bytes of benchmark text that the driver reads and sends out at once.
MAX_BYTES = 32 << 20
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, cut string, places array<struct<start:int,end:int,first:int,last:int>>"


class Phrases:
    """The windows of benchmark items over the vocabulary of these items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, offsets, ALNUM)
        number, vocabulary = words.distinct()
        self.symbols = {w: i for i, w in enumerate(vocabulary, 1)}
        number = number + 1
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for (name, _), a, b in zip(items, words.first.tolist(), words.first[1:].tolist()):
            n = min(window, b - a)
            for i in range(a, b - n + 1) if n else ():
                owners[tuple(number[i : i + n].tolist())].add(name)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in owners:
            by_length[len(w)].append(w)
        self.groups = [(n, np.array(ws, np.int64), [sorted(owners[w]) for w in ws]) for n, ws in sorted(by_length.items())]
        self.least = min(by_length, default=0)

    def scan(self, column: pa.Array) -> list[tuple[int, int, list[str], list[tuple[int, int]], list[tuple[int, int]]]]:
        """For each text: words, words hit, items, merged spans of words, the same spans in bytes."""
        data, offsets = utf8(column)
        words = Words(data, offsets, ALNUM)
        n = len(offsets) - 1
        counts = np.diff(words.first)
        empty: list = [(int(c), 0, [], [], []) for c in counts]
        if not self.groups or not len(words):
            return empty
        number, vocabulary = words.distinct()
        symbol = np.fromiter((self.symbols.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))[number]
        known = symbol > 0
        head = np.zeros(len(words) + 1, bool)
        head[words.first] = True
        head = head[:-1]
        # stretches of known words within one document, at least as long as the shortest phrase
        begins = np.flatnonzero(known & (head | ~np.append(False, known[:-1])))
        ends = np.flatnonzero(known & np.append(head[1:] | ~known[1:], True)) + 1
        long = ends - begins >= self.least
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return empty
        sizes = ends - begins + 1
        stop = np.cumsum(sizes)
        word_at = np.repeat(begins - (stop - sizes), sizes) + np.arange(stop[-1])
        symbols = symbol[np.minimum(word_at, len(symbol) - 1)]
        symbols[stop - 1] = 0
        index = FmIndex(symbols, len(self.symbols))
        cover = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        row_of = words.rows()
        for length, phrases, owners in self.groups:
            low, high = index.search(phrases)
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            places = word_at[index.locate(rows)]
            np.add.at(cover, places, 1)
            np.add.at(cover, places + length, -1)
            rows = row_of[places]
            for key in np.unique(rows * len(phrases) + np.repeat(hit, many)).tolist():
                items[key // len(phrases)].update(owners[key % len(phrases)])
        hit = np.cumsum(cover[:-1]) > 0
        # spans end with their document: occurrences of neighbours in the array are cut at its first word
        opens = np.flatnonzero(hit & (head | ~np.append(False, hit[:-1])))
        closes = np.flatnonzero(hit & np.append(head[1:] | ~hit[1:], True)) + 1
        for row in sorted(items):
            a, b = np.searchsorted(opens, [words.first[row], words.first[row + 1]])
            spans = [(int(x), int(y)) for x, y in zip(opens[a:b], closes[a:b])]
            base, byte = int(words.first[row]), int(offsets[row])
            empty[row] = (int(counts[row]), sum(y - x for x, y in spans), sorted(items[row]), [(x - base, y - base) for x, y in spans], [(int(words.starts[x]) - byte, int(words.ends[y - 1]) - byte) for x, y in spans])
        return empty


def blocks(benchmark: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of a bounded size: one list if the benchmark is small enough, else one for each hash bucket."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id")), F.lit(0))).first()[0]
    n = 1 + size // max_bytes
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        yield sorted((r["id"], r["text"]) for r in part.collect())


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without these spans of bytes."""
    if not spans:
        return text
    data, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def scan(docs: DataFrame, phrases: Phrases, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns of each row and, in one struct `__found`, what Phrases.scan() finds, the text without it, and in
    `places` the spans of words with the same spans in bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    at = columns.index(text_col)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField("__found", T.StructType.fromDDL(FOUND))])
    names = [f"c{i}" for i in range(len(columns))] + ["found"]
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("cut", pa.string()), ("places", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "first", "last")])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), SHARD_BYTES):
                part = batch.slice(a, b - a)
                texts = part.column(at)
                found = [
                    {"n_words": w, "n_hit": h, "items": i, "spans": [{"start": x, "end": y} for x, y in s], "cut": without(texts[r].as_py(), cut) if cut else None, "places": [{"start": x, "end": y, "first": p, "last": q} for (x, y), (p, q) in zip(s, cut)]}
                    for r, (w, h, i, s, cut) in enumerate(sent.value.scan(texts))
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names)

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    inner = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return plain.mapInArrow(run, inner).toDF(*[*columns, "__found"])


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, cut) for each document; `cut` is the text without the spans, if any."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lists = list(blocks(benchmark, item_col, item_text, max_bytes))
    if len(lists) == 1:
        return scan(plain, Phrases(lists[0], window), ["doc_id", "text"]).select("doc_id", *[f"__found.{c}" for c in ("n_words", "n_hit", "items", "spans", "cut")])
    numbered = cut_table(plain.withColumn("row", F.monotonically_increasing_id()))
    parts = [scan(numbered, Phrases(items, window), ["row", "doc_id", "text"]) for items in lists]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    every = F.flatten(F.collect_list("__found.spans"))
    merged = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("__found.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__found.items")))).alias("items"), F.array_sort(F.array_distinct(every)).alias("raw"))
    joined = F.expr(
        "aggregate(raw, cast(array() as array<struct<start:int,end:int>>), (acc, s) -> if(size(acc) > 0 and s.start <= element_at(acc, -1).end,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))), concat(acc, array(s))))"
    )
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))
    return merged.select("doc_id", "n_words", "n_hit", "items", "spans", F.lit(None).cast("string").alias("cut"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: at least a twentieth of a document's words lie in occurrences."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def report(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Contaminated documents go; documents hit below the rule's share stay, without the spans; others stay as they are.

    Each block of a benchmark of several is searched in the original texts; the rule and the cut are for all blocks' spans.
    """
    lists, columns = blocks(benchmark, item_col, item_text, max_bytes), docs.columns
    one, two = next(lists), next(lists, None)
    if two is None:
        found = scan(docs, Phrases(one, window), columns, text_col).where(~contaminated("__found.n_hit", "__found.n_words"))
        return found.select(*[F.coalesce("__found.cut", f"`{c}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
    names = [f"c{i}" for i in range(len(columns))]
    text = names[columns.index(text_col)]
    numbered = cut_table(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    parts = [cut(scan(numbered.select("row", text), Phrases(items, window), ["row", text], text).where("__found.n_hit > 0").select("row", "__found.n_words", "__found.places")) for items in chain([one, two], lists)]
    merged = reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("raw"))
    joined = F.expr(
        "aggregate(raw, cast(array() as array<struct<start:int,end:int,first:int,last:int>>), (acc, s) -> if(size(acc) > 0 and s.start <= element_at(acc, -1).end,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end), 'first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, s.last)))), concat(acc, array(s))))"
    )
    merged = merged.withColumn("places", joined).withColumn("n_hit", F.expr("aggregate(places, 0L, (n, s) -> n + s.end - s.start)"))
    merged = merged.select("row", "places", contaminated().alias("goes"))
    data = f"cast({text} as binary)"
    left = F.expr(
        f"cast(aggregate(places, named_struct('at', 0, 'out', cast('' as binary)), (a, s) -> named_struct('at', s.last, 'out', concat(a.out, substring({data}, a.at + 1, s.first - a.at))),"
        f" a -> concat(a.out, substring({data}, a.at + 1, octet_length({text}) - a.at))) as string)"
    )
    kept = numbered.join(merged, "row", "left").where("goes is null or not goes")
    return kept.select(*[F.when(F.col("places").isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in names]).toDF(*columns)
