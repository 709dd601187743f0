"""Byte-pair encoding and decoding with forced boundaries.

A merge can only ever join two bytes that stand side by side inside some token
of the vocabulary.  Where a pair of neighbouring bytes occurs in no token, every
encoding has a boundary, so the text falls into fragments there that are
encoded independently and concatenated.  The vocabulary's own word splitter
gives further certain cuts.  Fragments repeat a lot; their identifiers are
remembered per worker up to a fixed number of entries.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bourse.llm.common import col, pieces
from bourse.llm.token_counts import byte_symbols, merge_table

#: chunks remembered by a worker, twice (the newer ones and those before)
REMEMBERED = 500_000
#: above every rank
NONE = 1 << 60
#: fixed value: the byte-level splitter that such vocabularies imply (White_Space as the library has it)
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


class Unclear(Exception):
    """A space with white space beside it: the text is not cut there."""


class Codec(dict):
    """A text without a space -> identifiers of a space and it, as little-endian unsigned 32-bit integers"""

    def __init__(self, path: str, remember: int = REMEMBERED):
        super().__init__()
        self.remember = remember
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: only plain byte-level vocabularies are supported")
        vocab, of = model["vocab"], {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = {s: array("I", [i]).tobytes() for s, i in added.items()}
        self.single = [vocab[c] for c in byte_symbols()]
        self.rank_of, self.made = merge_table(model)
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in added}
        #: joined[a << 8 | b]: some token holds byte a followed by byte b
        self.joined = bytearray(1 << 16)
        for t in self.bytes_of.values():
            for a, b in zip(t, t[1:], strict=False):
                self.joined[a << 8 | b] = 1
        self.bytes_of |= {i: s.encode() for s, i in added.items()}
        self.split = regex.compile(SPLITTER)
        self.first = [self.rank_of.get(a << 20 | b, NONE) for a in self.single for b in self.single]
        self.older: dict[str, bytes] = {}

    def cuts(self, raw: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        joined, out, start, i = self.joined, [], 0, 0
        for a, b in pairwise(raw):
            i += 1
            if not joined[a << 8 | b]:
                out.append(raw[start:i])
                start = i
        out.append(raw[start:])
        return out

    def fragment(self, raw: bytes) -> list[int]:
        """Identifiers of one fragment, lowest rank first, leftmost among equals."""
        sym = [self.single[b] for b in raw]
        if len(raw) > 64:
            return self.long_fragment(sym)
        get, made, first = self.rank_of.get, self.made, self.first
        ranks = [first[a << 8 | b] for a, b in pairwise(raw)]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            sym[i] = new = made[best]
            del sym[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | sym[i + 1], NONE)
            if i:
                ranks[i - 1] = get(sym[i - 1] << 20 | new, NONE)
        return sym

    def long_fragment(self, sym: list[int]) -> list[int]:
        """The same with a heap, for fragments where rescanning would be quadratic."""
        n, get, made = len(sym), self.rank_of.get, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(sym[i] << 20 | sym[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if sym[i] < 0 or (j := nxt[i]) >= n or get(sym[i] << 20 | sym[j]) != rank:
                continue
            sym[i] = new = made[rank]
            sym[j] = -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (r := get(new << 20 | sym[k])) is not None:
                    heappush(heap, (r, i))
            if (h := prv[i]) >= 0 and (r := get(sym[h] << 20 | new)) is not None:
                heappush(heap, (r, h))
        return [s for s in sym if s >= 0]

    def words(self, text: str) -> Iterator[bytes]:
        """Identifiers of a text, cut at the vocabulary's words and then at forced boundaries."""
        if len(text) < 1 << 16:
            blocks = [[text]] if text[text[:1] == " ":].isalpha() else [self.split.findall(text)]
        else:
            found = self.split.finditer(text)
            blocks = iter(lambda: [m.group() for m in islice(found, 1 << 16)], [])
        for block in blocks:
            ids = []
            for word in block:
                for raw in self.cuts(word.encode()):
                    ids += self.fragment(raw)
            yield array("I", ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.older.get(chunk)) is None:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                raise Unclear
            out = b"".join(self.words(f" {chunk}"))
        if len(chunk) <= 64:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def part(self, text: str) -> Iterator[bytes]:
        """A space between two characters that are no white space begins a word, and no token
        holds anything before such a space: there the text is cut, and each chunk remembered."""
        head, *rest = text.split(" ")
        if rest and not head[-1:].isspace():
            try:
                out = b"".join(map(self.__getitem__, rest))
            except Unclear:
                pass
            else:
                yield from self.words(head)
                yield out
                return
        yield from self.words(text)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Identifiers of a text, as blocks of little-endian 32-bit integers."""
        if not text:
            return
        at = 0
        if self.special is not None and any(s in text for s in self.added):
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield from self.part(text[at:m.start()])
                yield self.added[m.group()]
                at = m.end()
        if at < len(text):
            yield from self.part(text[at:] if at else text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids)))


@functools.lru_cache(maxsize=2)
def codec(path: str, remember: int = REMEMBERED) -> Codec:
    return Codec(path, remember)


def utf8(raw: bytes) -> bytes:
    """Bytes of the decoded text: what is no UTF-8 becomes U+FFFD."""
    return raw.decode("utf-8", errors="replace").encode()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
           remember: int = REMEMBERED) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of `docs`.

    `tokenizer` is the path of a byte-level BPE file on every machine.  Strings of
    added tokens become those tokens.  `remember` bounds the chunks a worker keeps
    (twice, about 220 bytes each): fewer cost time, never a result.  NULL texts count as empty: no identifiers, the
    digests of nothing.  A NULL id stays NULL, repeated rows give repeated results,
    other columns are ignored.  One narrow pass, no shuffle.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, remember)
        for b in pieces(batches):
            n, ids_sha, out_sha, ids = [], [], [], []
            for text in b.column(1).to_pylist():
                blocks = list(c.encode(text))
                total = sum(map(len, blocks)) // 4
                digest = hashlib.sha256()
                for x in blocks:
                    digest.update(x)
                raw = b"".join(map(c.decode, blocks))
                n.append(total)
                ids_sha.append(digest.hexdigest())
                out_sha.append(hashlib.sha256(utf8(raw)).hexdigest())
                if with_ids:
                    ids += blocks
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), np.int32)
                cols.append(pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, array of identifiers); a NULL array gives an empty text."""
    kind = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in pieces(batches):
            texts = [utf8(b"".join(map(c.bytes_of.__getitem__, ids or ()))).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(col(id_col).alias("id"), col(ids_col).alias("ids")).mapInArrow(
        run, f"id {kind}, text string").withColumnRenamed("id", id_col)
