"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import narrow, steps
from weftline.runtime import table

#: Words whose pieces a worker remembers in each of two generations: when the young
#: one is full it becomes the old one, and what is used again moves back.
CACHE_WORDS = 300_000
#: Stands for a symbol that a merge has used up.
GONE = 0xFFFFF
#: str.split() also splits at these; the tokenizer's white space leaves them out.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r\x85\p{Z}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    itself where it is printable Latin-1, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Bpe:
    """Encoder and decoder of one vocabulary file (a tokenizers JSON of kind BPE with
    a word-end suffix, NFC, lower case, white space dropped)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        numbers: dict[str, int] = {}
        number = lambda s: numbers.setdefault(s, len(numbers))
        letters = byte_letters()
        #: Symbol of each byte, and of each such symbol at the end of a word.
        self.start = [number(x) for x in letters]
        self.last = {number(x): number(x + self.end) for x in letters}
        #: Rank (from 1) and result of merging two symbols, packed, by both symbols packed.
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[number(left) << 20 | number(right)] = rank + 1 << 20 | number(left + right)
        #: Vocabulary id of each symbol; the file has one for every byte, with and
        #: without the word's end, so no symbol is unknown.
        self.ids = [self.vocab[s] for s in numbers]
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.marks = {s: (pack([i]), s) for s, i in self.special.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: a heap of merge ranks over a doubly linked list of
        symbols. An entry packs rank, result and position; it is stale, and skipped,
        once the pair now at that position is another."""
        get = self.pairs.get
        symbols = [self.start[b] for b in word.encode("utf-8")]
        symbols[-1] = self.last[symbols[-1]]
        n = len(symbols)
        heap = [r << 32 | i for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if (r := get(x << 20 | y))]
        if heap:
            before, after = list(range(-1, n - 1)), [*range(1, n), 0]
            heapify(heap)
            while heap:
                entry = heappop(heap)
                i, merged = entry & 0xFFFFFFFF, entry >> 32
                j = after[i]
                if not j or get(symbols[i] << 20 | symbols[j]) != merged:
                    continue
                symbols[i] = new = merged & 0xFFFFF
                symbols[j] = GONE
                after[i] = k = after[j]
                if k:
                    before[k] = i
                    if r := get(new << 20 | symbols[k]):
                        heappush(heap, r << 32 | i)
                h = before[i]
                if h >= 0 and (r := get(symbols[h] << 20 | new)):
                    heappush(heap, r << 32 | h)
        ids = self.ids
        return [ids[s] for s in symbols if s != GONE]

    def chunk(self, text: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a stretch without white space."""
        if (found := self.old.get(text)) is None:
            if text.isalpha():
                return self.word(text)
            parts = [self.known.get(w) or self.word(w) for w in self.cut.findall(text)]
            found = b"".join([x for x, _ in parts]), " ".join([x for _, x in parts])
        return self.keep(text, found)

    def word(self, text: str) -> tuple[bytes, str]:
        if (found := self.old.get(text)) is None:
            ids = self.merge(text)
            found = pack(ids), self.decode(ids)
        return self.keep(text, found)

    def keep(self, text: str, found: tuple[bytes, str]) -> tuple[bytes, str]:
        if len(self.known) >= CACHE_WORDS:
            self.old, self.known = self.known, {}
        if len(text) <= 64:
            self.known[text] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as a tokenizer without a decoder does."""
        return " ".join([self.strings[i] for i in ids])

    def both(self, text: str | None) -> tuple[bytes, str]:
        """Ids, packed as little-endian unsigned 32-bit integers, and their decoded text."""
        parts: list[tuple[bytes, str]] = []
        for piece in self.cut_special.split(text or ""):
            if piece in self.special:
                parts.append(self.marks[piece])
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece = piece.lower()
            words = SPACE.split(piece) if SEPARATORS.search(piece) else piece.split()
            chunk = self.chunk
            parts += [self.known.get(w) or chunk(w) for w in words if w]
        return b"".join([x for x, _ in parts]), " ".join([x for _, x in parts if x])


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string): every whole text encoded, and decoded again.

    ids holds little-endian unsigned 32-bit integers (4 bytes each; numpy.frombuffer
    or struct reads them). A null or empty text gives no ids and an empty string.
    Rows come out as they went in, repeated ones too; a null key is kept; other
    columns, whatever their names, are left out. No shuffle: each task reads its rows
    in bounded steps, remembers at most CACHE_WORDS words, and writes bounded
    batches. The vocabulary file is read by the driver and sent with the tasks
    (its size does not depend on the data)."""
    rows = narrow(df, key=key, text=text)
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in steps(batches):
            found = [bpe.both(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)


_held: dict[int, Bpe] = {}


def _loaded(content: str) -> Bpe:
    """One encoder for each worker process and vocabulary."""
    if (mark := zlib.crc32(content.encode())) not in _held:
        _held[mark] = Bpe(content)
    return _held[mark]


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    found = encode(table(spark, sf_dir, "documents"), path)
    return found.select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
