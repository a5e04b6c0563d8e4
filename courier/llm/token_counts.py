"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie in one ragged numpy array of symbols. In each round every sequence finds its own
lowest-rank pair and all sequences apply theirs at the same time, from left to right; sequences without a pair drop
out. The symbols that survive are counted. Each distinct piece of text between white space is merged once per batch,
and a bounded memory of such pieces spares later batches the work. Pieces are told apart by their bytes, so the
memory changes no count.

The vocabulary is read from a tokenizer file (BPE with word ends). Nulls: a null text is empty and has 0 bytes and 0
tokens; a null id keeps its row. Equal rows each get a row, an empty table gives an empty one, and columns other
than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .words import NOT_SPACE, Words, pieces, slices, utf8

# The white space that the tokenizer's patterns mean, and its pattern of pre-tokens.
BLANK = r"\t-\r \x85\xa0  -     　"
WITH_SPACES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+| ")
UNUSUAL = regex.compile(r"[^\x00-\x7f\p{L}]")
KINDS = np.full(256, 3, np.uint8)  # 0: space, 1: letter, 2: digit, 3: other
KINDS[0x20], KINDS[0x30:0x3A], KINDS[0x61:0x7B], KINDS[0x80:] = 0, 2, 1, 1
LOWER_NONE = np.arange(256, dtype=np.uint8)
#: Pieces of text that a Python worker remembers, and their bytes.
MEMORY, MEMORY_BYTES = 600_000, 16 << 20
#: Bytes of text that are merged at once; longer texts are taken in parts that end with white space.
PART_BYTES = 1 << 20
LIMIT = 2048


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Byte-pair merging of many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        names = byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + end] for c in names], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.marks = tuple({s[:2].encode() for s in self.specials})
        left, right = zip(*(m if isinstance(m, list) else m.split(" ") for m in model["merges"]))
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in zip(left, right)], np.int64)
        made = np.array([vocab[a + b] for a, b in zip(left, right)], np.int64)
        if max(vocab.values()) >= 1 << 20:
            raise ValueError("token ids beyond 2^20 aren't supported")
        size = 1 << max(10, (2 * len(keys)).bit_length())
        self.slot_mask = size - 1
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        todo = np.arange(len(keys))
        at, self.probes = self._slot(keys), 0
        while len(todo):
            free = self.slot_key[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(todo), bool)
            put[one] = free[one]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[todo[put]], todo[put]
            todo, at = todo[~put], (at[~put] + 1) & self.slot_mask
            self.probes += 1
        self.made = made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x5851F42D4C957F2D)) >> np.int64(40)) & np.int64(self.slot_mask)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; a large number where there is none."""
        keys = left << 20 | right
        out = np.full(len(keys), np.iinfo(np.int32).max, np.int32)
        at, todo = self._slot(keys), None
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == keys
            if todo is None:
                out[hit] = self.slot_rank[at[hit]]
                todo = np.flatnonzero(~hit & (found >= 0))
            else:
                out[todo[hit]] = self.slot_rank[at[hit]]
                todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            keys, at = keys[~hit & (found >= 0)], (at[~hit & (found >= 0)] + 1) & self.slot_mask
        return out

    def merge(self, data: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of pre-tokens, which are the last of theirs, and the pre-token of each -> surviving symbols, in order, and theirs."""
        none = np.iinfo(np.int32).max
        symbols = np.where(last, self.final[data], self.inner[data])
        rank = np.full(len(symbols), none, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(heads, len(owner)))
            lowest = np.minimum.reduceat(rank, heads)
            alive = np.repeat(lowest != none, sizes)
            at = np.flatnonzero((rank == np.repeat(lowest, sizes)) & alive)
            if len(at) > 1 and (at[1:] - at[:-1] == 1).any():  # runs of one symbol: every other pair, from the left
                order = np.arange(len(at))
                starts = np.append(True, at[1:] - at[:-1] != 1)
                at = at[(order - np.maximum.accumulate(np.where(starts, order, 0))) % 2 == 0]
            done.append((symbols[~alive], owner[~alive]))
            symbols[at] = self.made[rank[at]]
            stay = alive
            stay[at + 1] = False
            moved = (np.cumsum(stay) - 1)[at]
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            rank[fresh] = none
            fresh = fresh[fresh + 1 < len(owner)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self.ranks(symbols[fresh], symbols[fresh + 1])
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.uint32), owner[order]

    def encode(self, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n pieces with a space after each -> token ids, and the end of each piece among them."""
        if self.marks and any(m in raw for m in self.marks):
            return self._encode_marked(raw.decode("utf-8", "replace").split(" ")[:n])
        text = raw.decode("utf-8", "replace")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if "'" in text or UNUSUAL.search(text):
            found = WITH_SPACES.findall(text)
            data = np.frombuffer(" ".join(found).encode("utf-8", "replace"), np.uint8)
            blank = data == 0x20
            starts = ~blank & np.append(True, blank[:-1])
            gaps = np.cumsum(blank)
            # k separators between two tokens are 2k + 1 spaces; before the first token, 2k
            heads = np.flatnonzero(starts)
            spaces = gaps[heads]
            step = np.diff(spaces, prepend=0)
            piece = np.cumsum(np.where(np.arange(len(step)) > 0, (step - 1) // 2, step // 2))
        else:
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            kind = KINDS[data]
            blank = kind == 0
            starts = ~blank & np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))
            piece = np.cumsum(blank)[np.flatnonzero(starts)]
        last = np.append(starts[1:] | blank[1:], True)[~blank]
        owner = (np.cumsum(starts) - 1).astype(np.int32)[~blank]
        ids, owner = self.merge(data[~blank], last, owner)
        return ids, np.cumsum(np.bincount(piece[owner], minlength=n)[:n]) if len(ids) else np.zeros(n, np.int64)

    def _encode_marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), where special tokens may stand in the pieces."""
        parts, kinds = [], []
        for i, piece in enumerate(pieces):
            own = self.split.split(piece)
            for text, mark in zip(own[::2], [*own[1::2], None]):
                kinds.append((i, len(parts) if text else None, self.specials.get(mark)))
                if text:
                    parts.append(text)
        saved, self.marks = self.marks, ()
        try:
            ids, ends = self.encode("".join(p + " " for p in parts).encode("utf-8"), len(parts)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        finally:
            self.marks = saved
        heads = np.append(0, ends)
        out, sizes = [], np.zeros(len(pieces), np.int64)
        for i, part, mark in kinds:
            own = ids[heads[part] : heads[part + 1]] if part is not None else ids[:0]
            out += [own] if mark is None else [own, np.array([mark], np.uint32)]
            sizes[i] += len(own) + (mark is not None)
        return np.concatenate(out), np.cumsum(sizes)


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of the source, one after another."""
    ends = np.cumsum(sizes)
    return source[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Token ids of whole text columns, with a bounded memory of pieces, each known by its bytes."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held, self.ends, self.ids = 0, np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        ids, ends = self.merger.encode(b"".join(p + b" " for p in pieces), len(pieces))
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.held += sum(map(len, pieces))
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the n + 1 offsets of the rows among them."""
        data, offsets = utf8(column)
        found, ends = [np.zeros(0, np.uint32)], np.zeros(len(offsets), np.int64)
        for a, b in pieces(data, NOT_SPACE, PART_BYTES):
            ids, own = self._encode(data[a:b], np.clip(offsets, a, b) - a)
            found.append(ids)
            ends += own
        return np.concatenate(found), ends

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, offsets, NOT_SPACE)
        of, found = words.distinct(LOWER_NONE)
        new = [p for p in found if p not in self.number]
        if len(self.number) + len(new) > MEMORY or self.held > MEMORY_BYTES:
            self._forget()
            new = found
        if new:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))[of]
        sizes = self.ends[at + 1] - self.ends[at]
        ends = np.append(0, np.cumsum(sizes))
        return gather(self.ids, self.ends[at], sizes), ends[words.first]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column(1), "")
                n = np.diff(encoder(path).encode(texts)[1])
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
