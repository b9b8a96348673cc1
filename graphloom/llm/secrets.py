"""Secret scans: known patterns, and strings that a token vocabulary finds hard to spell.

A tokenizer trained on ordinary text spells ordinary strings in few tokens. A run of letters, digits and base64 marks that takes
many tokens for its characters is random, so it is reported, unless it is a digest of a known length in hexadecimal, a UUID or a
number. What the known patterns and these leave of a run is judged as a whole, and, where that is efficient, by its inefficient
stretches, so that a random string glued to ordinary text is found.

Cases: a null or empty text has no spans (the digest of the empty string); a very long text is scanned whole; repeated rows are scanned each; spans
that begin at one place come in the order of kinds; an empty table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, tidy
from .tokens import vocabulary

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}")
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
#: Hexadecimal digits of common digests: 128, 160, 224, 256, 384 and 512 bits.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: Digests, UUIDs and long numbers that stand by themselves within a run.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|[0-9]{{8,}}|" + "|".join(f"[0-9a-fA-F]{{{n}}}" for n in sorted(DIGESTS)) + r")(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
#: Characters of the shortest run or stretch that is judged. Below LONG the ratio says less, so it must be lower: of ordinary strings
#: of 16 to 19 characters some come near 1.75.
LEAST, LONG, SHORT_RATIO = 16, 20, 1.6
#: Longer runs are judged by pieces of so many characters, as the cost of encoding one run is not linear.
PIECE = 4096

Span = tuple[int, int, int]  #: start, index of the kind, end


class TokenEfficiency:
    """Characters per token of a string under a tiktoken vocabulary."""

    def __init__(self, name: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = {b: len(a) for a, b in ranks.items()}
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, s: str) -> float:
        return len(s) / max(1, len(self.lengths(s)))

    def lengths(self, s: str) -> list[int]:
        """The bytes of each token."""
        return [self.size[x] for i in range(0, len(s), PIECE) for x in self.encode(s[i : i + PIECE])]


_efficiency: dict[str, TokenEfficiency] = {}


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def ordinary(s: str) -> bool:
    """Known digests, identifiers and numbers, which look random but give nothing away."""
    return bool(UUID.fullmatch(s) or HEXADECIMAL.fullmatch(s) and (len(s) in DIGESTS or len(s) < LONG)) or not any(c.isalpha() for c in s)


def limit(n: int, max_ratio: float) -> float:
    """The ratio below which a string of n characters is random."""
    return max_ratio if n >= LONG else min(SHORT_RATIO, max_ratio)


def inefficient(lengths: list[int], max_ratio: float) -> list[tuple[int, int]]:
    """All maximal stretches of tokens with fewer than max_ratio characters a token, as character offsets; linear in the tokens.

    A token scores max_ratio less its length; a stretch is one that no extension or shortening gives a higher sum."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last one before with a lower sum before
    at, total = 0, 0.0
    for n in lengths:
        score = max_ratio - n
        if score > 0:
            start, low, high, j = at, total, total + score, len(found) - 1
            while True:
                while j >= 0 and found[j][2] >= low:
                    j = found[j][4]
                if j < 0 or found[j][3] >= high:
                    break
                start, low = found[j][0], found[j][2]
                before = found[j][4]
                del found[j:]
                j = before
            found.append((start, at + n, low, high, j))
        at += n
        total += score
    return [(a, b) for a, b, *_ in found]


def random_stretches(s: str, efficiency: TokenEfficiency, max_ratio: float) -> list[tuple[int, int]]:
    """The inefficient part of a run: all of it, or its inefficient stretches, each with all of the parts between marks that it touches."""
    lengths = efficiency.lengths(s)
    if len(s) < limit(len(s), max_ratio) * len(lengths):
        return [] if ordinary(s) else [(0, len(s))]
    out: list[tuple[int, int]] = []
    parts, k = None, 0
    for a, b in inefficient(lengths, max_ratio):
        if parts is None:
            parts = [m.span() for m in PART.finditer(s)]
        while parts[k][1] <= a:
            k += 1
        j = k
        while parts[j][1] < b:
            j += 1
        x, y = parts[k][0], parts[j][1]
        if y - x >= LEAST and not ordinary(s[x:y]) and (b - a >= LONG or efficiency(s[x:y]) < limit(y - x, max_ratio)):
            if out and x < out[-1][1]:
                x = out.pop()[0]
            out.append((x, y))
    return out


def random_spans(text: str, efficiency: TokenEfficiency, base: list[Span], max_ratio: float) -> list[Span]:
    out, k = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][2] <= at:
            k += 1
        cuts = [(a, b) for a, b in ((x.start(), x.end()) for x in KNOWN.finditer(text, at, end))]
        i = k
        while i < len(base) and base[i][0] < end:
            cuts.append((base[i][0], base[i][2]))
            i += 1
        for a, b in [*sorted(cuts), (end, end)]:
            if a - at >= LEAST:
                out += [(at + x, 3, at + y) for x, y in random_stretches(text[at:a], efficiency, max_ratio)]
            at = max(at, b)
    return out


def spans_of(text: str, efficiency: TokenEfficiency, max_ratio: float) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + random_spans(text, efficiency, base, max_ratio))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with every stretch that spans cover, overlaps taken together, replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0, mark: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every text; with `mark`, also the redacted text."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", redacted string" * (mark is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tokenizer not in _efficiency:
                _efficiency[tokenizer] = TokenEfficiency(tokenizer)
            counts, digests, spans, texts = [[], [], [], []], [], [], []
            for x in batch.column(1):
                t = x.as_py()
                base, found = spans_of(t or "", _efficiency[tokenizer], max_ratio)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in found))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
                if mark is not None:
                    texts.append(redacted(t, found, mark) if found else t)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())] + [pa.array(texts, pa.string())] * (mark is not None), names=[f.split()[0] for f in schema.split(", ")])

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", tokenizer: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets replaced in the text and the count of characters to match."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tokenizer not in _efficiency:
                _efficiency[tokenizer] = TokenEfficiency(tokenizer)
            columns = list(batch.columns)
            t = names.index(text)
            texts = [x.as_py() for x in columns[t]]
            new = [x and redacted(x, spans_of(x, _efficiency[tokenizer], max_ratio)[1], mark) for x in texts]
            columns[t] = pa.array(new, columns[t].type)
            if n_chars in names:
                n = names.index(n_chars)
                columns[n] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, columns[n].to_pylist(), strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
