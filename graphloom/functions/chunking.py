"""Cutting documents into chunks: plain Python over one text, called in batches by the ingest operators.

Sizes are in characters. Chunks of a document are numbered 0, 1, ... in their order."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

MAX, MIN = 4096, 100
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
FENCE = re.compile(r"^\s*(```|~~~)")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
DECLARATION = re.compile(r"^(?:export\s+|default\s+|public\s+|private\s+|static\s+|pub\s+|async\s+)*(?:func|function|class|def|type|interface|struct|enum|trait|impl|fn|const|var|let)\b\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")


@dataclass
class Chunk:
    text: str
    kind: str
    path: list[str] = field(default_factory=list)


def max_size(max_bytes: int | None) -> int:
    """The size that suits an embedder's limit: a quarter of its bytes, held to 1200..4096; 8192 if it has none."""
    return min(MAX, max(1200, max_bytes // 4)) if max_bytes else 8192


def is_table_line(line: str) -> bool:
    return line.count("|") >= 2


def by_sentences(text: str, most: int) -> list[str]:
    """Sentences gathered up to the size; a sentence that is longer is cut."""
    out, held = [], ""
    for s in SENTENCE.split(text):
        if held and len(held) + 1 + len(s) > most:
            out.append(held)
            held = ""
        held = f"{held} {s}" if held else s
        while len(held) > most:
            out.append(held[:most])
            held = held[most:]
    return [*out, held] if held else out


def by_paragraphs(text: str, most: int) -> list[str]:
    out, held = [], ""
    for p in text.split("\n\n"):
        if held and len(held) + 2 + len(p) > most:
            out.append(held)
            held = ""
        if len(p) > most:
            out += by_sentences(p, most)
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def by_structure(text: str, most: int) -> list[str]:
    """Cut at blank lines once half the size is reached, but never inside a fence or a table."""
    out, held, size, fenced = [], [], 0, False
    for line in text.split("\n"):
        fenced ^= bool(FENCE.match(line))
        held.append(line)
        size += len(line) + 1
        if not fenced and not line.strip() and size >= most // 2 and not (len(held) > 1 and is_table_line(held[-2])):
            out.append("\n".join(held))
            held, size = [], 0
    return [*out, "\n".join(held)] if held else out


def split_large(chunks: list[Chunk], most: int, least: int = MIN) -> list[Chunk]:
    out: list[Chunk] = []
    for c in chunks:
        if len(c.text) <= most:
            out.append(c)
            continue
        for part in by_structure(c.text, most):
            out += [Chunk(p, c.kind, c.path) for p in ([part] if len(part) <= most else by_paragraphs(part, most)) if len(p.strip()) >= least]
    return out


def markdown(text: str, most: int = MAX, least: int = MIN) -> list[Chunk]:
    """Sections under headings outside fences; what a heading ends is a chunk if it exceeds the least size, else it goes on under the next."""
    out: list[Chunk] = []
    path: list[str] = []
    held: list[str] = []
    fenced = False

    def flush() -> None:
        body = "\n".join(held)
        if len(body) > least:
            out.append(Chunk(body, "markdown_section", list(path)))
            held.clear()

    for line in text.split("\n"):
        fenced ^= bool(FENCE.match(line))
        m = None if fenced else HEADING.match(line)
        if m:
            flush()
            path = [*path[: len(m[1]) - 1], m[2]]
        held.append(line)
    flush()
    return split_large(out, most, least)


def code(text: str, language: str = "", most: int = MAX) -> list[Chunk]:
    """Top-level declarations: by the syntax tree for Python, else by lines that open a declaration."""
    lines = text.split("\n")
    starts: list[tuple[int, str]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            tree = None
        if tree:
            starts = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1, n.name) for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    starts = starts or [(i, m[1]) for i, line in enumerate(lines) if (m := DECLARATION.match(line))]
    cuts = [(0, "")] + starts if not starts or starts[0][0] else starts
    out = []
    for (a, name), (b, _) in zip(cuts, [*cuts[1:], (len(lines), "")], strict=True):
        body = "\n".join(lines[a:b]).strip("\n")
        if body.strip():
            out.append(Chunk(body, "code_declaration" if name else "code_preamble", [name] if name else []))
    return [part for c in out for part in ([c] if len(c.text) <= most else descend(c, language, most))]


def descend(chunk: Chunk, language: str, most: int) -> list[Chunk]:
    """A declaration that is too large, cut at the methods of a Python class, else at the lines that open a declaration within it, else at
    line ends; only a line that is too long itself is cut."""
    lines = chunk.text.split("\n")
    starts: list[tuple[int, str]] = []
    if language == "python":
        try:
            body = ast.parse(chunk.text).body
        except (SyntaxError, ValueError):
            body = []
        inner = body[0].body if len(body) == 1 and isinstance(body[0], ast.ClassDef) else []
        starts = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1, n.name) for n in inner if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    starts = starts or [(i, m[1]) for i, line in enumerate(lines) if i and (m := DECLARATION.match(line.strip())) and line[:1].isspace()]
    out: list[Chunk] = []
    for (a, name), (b, _) in zip([(0, ""), *starts], [*starts, (len(lines), "")], strict=True):
        path, held = [*chunk.path, name] if name else chunk.path, ""
        for line in lines[a:b]:
            if held and len(held) + 1 + len(line) > most:
                out.append(Chunk(held, chunk.kind, path))
                held = ""
            held = f"{held}\n{line}" if held else line
            while len(held) > most:
                out.append(Chunk(held[:most], chunk.kind, path))
                held = held[most:]
        if held.strip():
            out.append(Chunk(held, chunk.kind, path))
    return out


def chunks_of(text: str | None, node_type: str | None, language: str | None = "", most: int = MAX) -> list[Chunk]:
    if not text or not text.strip():
        return []
    if (node_type or "").startswith("code:"):
        return code(text, language or "", most)
    if node_type in ("fact", "entity"):
        return [Chunk(text, "conversation_fact")]
    found = markdown(text, most)
    return found or [Chunk(text, "text")]
