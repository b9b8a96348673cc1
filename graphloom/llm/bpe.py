"""BPE encoding and decoding of whole texts.

Encoding merges the pair of least rank first, the leftmost of equals: a priority queue holds candidate merges over a doubly
linked list of symbols; entries whose symbols have changed since are skipped when they surface. Decoding concatenates the
vocabulary strings of the ids, as the vocabulary's file says (no decoder: joined by spaces).

Cases: null or empty text has no ids and decodes to the empty text; a special token's string in a text is that token;
a symbol that the vocabulary lacks is left out, as no unknown token is defined; a very long text is encoded whole; repeated rows and rows with a
null id are encoded each; an empty table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require
from .tokens import CACHE, byte_letters, vocabulary

BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeBPE:
    """A vocabulary file of the tokenizers library: byte-level alphabet, optional end-of-word suffix, no unknown token."""

    def __init__(self, name: str) -> None:
        with open(vocabulary(name), encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in (*self.vocab.items(), *self.special.items())}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            self.ranks.setdefault(tuple(pair if isinstance(pair, list) else pair.split(" ", 1)), rank)
        splits = [p for p in (file["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"] if splits else BYTE_PATTERN).findall
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.lower, self.spaces = "NFC" in kinds, "Lowercase" in kinds, not splits
        self.byte_decoder = bool(file["decoder"])
        self.letters = byte_letters()
        self.back = {c: b for b, c in self.letters.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.words: dict[str, list[int]] = {}

    def merge(self, piece: str) -> list[str]:
        """The symbols of one piece, given in the byte-level alphabet, after all merges."""
        symbols = list(piece)
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (rank, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (rank, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def piece_ids(self, piece: str) -> list[int]:
        symbols = self.merge(piece.encode().decode("latin-1").translate(self.letters))
        return [i for s in symbols if (i := self.vocab.get(s)) is not None]

    def word(self, piece: str) -> list[int]:
        """The ids of one piece of the pre-tokenizer; the ids of short ones are kept."""
        ids = self.words.get(piece)
        if ids is None:
            ids = self.piece_ids(piece)
            if len(piece) <= 64:
                if len(self.words) > CACHE:
                    self.words.clear()
                self.words[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.cut(text) if "<" in text else (text,)):
            if k % 2:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part) if self.nfc else part
                part = "".join([c.lower() for c in part]) if self.lower else part
            elif self.lower:
                part = part.lower()
            for piece in self.pieces(part):
                ids += self.word(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        strings = [self.strings[i] for i in ids if i in self.strings]
        if not self.byte_decoder:
            return " ".join(strings)
        out = bytearray()
        for s in strings:
            out += s.encode() if s in self.special else bytes(self.back[ord(c)] for c in s)
        return out.decode("utf-8", "replace")


Digest = tuple[bytes, bytes, int]  #: ids as decimal text, decoded text, number of ids


class Digests(dict):
    """The digest of each unit between ASCII white space; for vocabularies that drop white space.

    A unit's digest is joined from those of its pieces, which are kept too: a new unit often has known pieces."""

    def __init__(self, name: str) -> None:
        self.bpe = MergeBPE(name)
        assert not self.bpe.spaces and not self.bpe.byte_decoder
        self.parts: dict[str, Digest] = {}

    def digest(self, ids: list[int]) -> Digest:
        return " ".join(map(str, ids)).encode(), self.bpe.decode(ids).encode(), len(ids)

    def part(self, piece: str) -> Digest:
        out = self.digest(self.bpe.piece_ids(piece))
        if len(piece) <= 64:
            if len(self.parts) > CACHE:
                self.parts.clear()
            self.parts[piece] = out
        return out

    def __missing__(self, unit: bytes) -> Digest:
        if unit.isascii() and b"<" not in unit:
            text, parts = unit.decode(), self.parts
            found = [x for p in self.bpe.pieces(text.lower() if self.bpe.lower else text) if (x := parts.get(p) or self.part(p))[2]]
            out = found[0] if len(found) == 1 else (b" ".join([x[0] for x in found]), b" ".join([x[1] for x in found]), sum(x[2] for x in found))
        else:
            out = self.digest(self.bpe.encode(unit.decode()))
        if len(unit) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[unit] = out
        return out

    def of(self, text: str | None) -> tuple[int, str, str]:
        found = [x for x in map(self.__getitem__, (text or "").encode("utf-8", "replace").split()) if x[2]]
        return sum(x[2] for x in found), hashlib.sha256(b" ".join([x[0] for x in found])).hexdigest(), hashlib.sha256(b" ".join([x[1] for x in found])).hexdigest()


_digests: dict[str, Digests] = {}


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, sha256 of the decimal ids joined by a space, sha256 of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tokenizer not in _digests:
                _digests[tokenizer] = Digests(tokenizer)
            of = _digests[tokenizer].of
            rows = [of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, decoded: the operator's own output."""
    kept: dict[str, MergeBPE] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tokenizer not in kept:
                kept[tokenizer] = MergeBPE(tokenizer)
            ids = [kept[tokenizer].encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([kept[tokenizer].decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
