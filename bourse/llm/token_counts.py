"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol per byte (the last one marked as word end).  A heap
holds the mergeable adjacent pairs by (rank, position); the symbols form a
doubly linked list.  Popping the lowest pair joins two symbols, so the count is
the number of initial symbols minus the number of merges; no identifier list is
ever built.  Counts of words are remembered per worker up to a fixed number of
entries (an eviction costs time, never a result).
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bourse.llm.common import col, pieces

#: texts remembered by a worker, twice (the newer ones and those before)
REMEMBERED = 500_000
#: white space for Python's split, but not for the library
ODD = re.compile("[\x1c-\x1f]")
#: fixed values: letters whose lower case the library takes one by one, or from a newer Unicode than Python's
CASE = (("Σ", "σ"), ("\ua7cb", "\u0264"), ("\ua7dc", "\u019b"))


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    keep = set(shown)
    return [chr(b) if b in keep else chr(next(hidden)) for b in range(256)]


def merges_left(sym: list[int], rank_of: dict[int, int], made: list[int]) -> int:
    """How many symbols are left when no adjacent pair can be merged.

    `rank_of` maps a pair (left << 20 | right) to its rank, `made` a rank to the
    new symbol.  Heap entries are rank << 32 | position.
    """
    n, get = len(sym), rank_of.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(sym[i] << 20 | sym[i + 1])) is not None]
    if not heap:
        return n
    heapify(heap)
    nxt, prv, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        x = heappop(heap)
        rank, i = x >> 32, x & 0xFFFFFFFF
        if sym[i] < 0 or (j := nxt[i]) >= n or get(sym[i] << 20 | sym[j]) != rank:
            continue  # one of the two has been merged since
        merges += 1
        sym[i] = new = made[rank]
        sym[j] = -1
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            if (r := get(new << 20 | sym[k])) is not None:
                heappush(heap, r << 32 | i)
        if (h := prv[i]) >= 0 and (r := get(sym[h] << 20 | new)) is not None:
            heappush(heap, r << 32 | h)
    return n - merges


def merge_table(model: dict) -> tuple[dict[int, int], list[int]]:
    """(pair -> rank, rank -> new symbol) of a vocabulary file's merges"""
    vocab, rank_of, made = model["vocab"], {}, []
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        rank_of[vocab[a] << 20 | vocab[b]] = rank
        made.append(vocab[a + b])
    return rank_of, made


class WordCounts(dict):
    """A text without white space -> number of tokens"""

    def __init__(self, spec: dict):
        super().__init__()
        vocab, end = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        shown = byte_symbols()
        self.inner, self.last = [vocab[c] for c in shown], [vocab[c + end] for c in shown]
        self.rank_of, self.made = merge_table(spec["model"])
        self.older: dict[str, int] = {}
        # White_Space as the library has it: the separators U+001C to U+001F are none
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))

    def word(self, word: str) -> int:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return merges_left(symbols, self.rank_of, self.made)

    def __missing__(self, text: str) -> int:
        if (n := self.older.get(text)) is None:
            found = self.split.findall(text)
            n = self.word(text) if found == [text] else sum(map(self.__getitem__, found))
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = n
        return n


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = WordCounts(spec)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: only NFC, blanks to one space, lower case is supported")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path}: the splitter must keep its matches")

    def part(self, text: str) -> int:
        # white space separates words and is dropped, so the text may be cut at all of it
        text = unicodedata.normalize("NFC", text)
        for upper, lower in CASE:
            text = text.replace(upper, lower)
        text = text.lower()
        if not ODD.search(text):
            return sum(map(self.words.__getitem__, text.split()))
        found, n = self.words.split.finditer(text), 0
        while block := [m.group() for m in islice(found, 1 << 16)]:
            n += sum(map(self.words.__getitem__, block))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not (cuts := [m.span() for m in self.special.finditer(text)]):
            return self.part(text)
        n, at = len(cuts), 0
        for a, b in [*cuts, (len(text), 0)]:
            if a > at:
                n += self.part(text[at:a])
            at = b
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of `docs`.

    `tokenizer` is the path of the vocabulary file on every machine.  NULL and
    empty texts have 0 bytes and 0 tokens; a NULL id stays NULL; repeated rows
    give repeated results; other columns are ignored.  One narrow pass, no shuffle.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in pieces(batches):
            texts = b.column(1).to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
