"""From nodes to chunks and vectors, and from conversations to facts. Python runs in Arrow batches, and only here."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.chunking import MAX, chunks_of
from ..functions.embedding import Embedder


def chunk_documents(nodes: DataFrame, most: int = MAX) -> DataFrame:
    """(id, parent_node_id, chunk_index, chunk_type, heading_path, content) of nodes (id, node_type, content, and language if there is one)."""
    language = F.col("language") if "language" in nodes.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f"{i}/chunk/{k}", i, k, c.kind, c.path, c.text) for i, t, x, lang in zip(*(col.to_pylist() for col in batch.columns), strict=True) for k, c in enumerate(chunks_of(x, t, lang, most))]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "parent_node_id", "chunk_index", "chunk_type", "heading_path", "content"])

    return nodes.select("id", "node_type", "content", language.alias("language")).mapInArrow(run, "id string, parent_node_id string, chunk_index int, chunk_type string, heading_path array<string>, content string")


def changed(new: DataFrame, before: DataFrame, chunks: DataFrame) -> DataFrame:
    """New nodes whose content differs from that before this write, or that have no chunks yet."""
    same = before.select("id", "content_hash").join(chunks.select(F.col("parent_node_id").alias("id")).distinct(), "id", "left_semi")
    return new.join(same, ["id", "content_hash"], "left_anti")


def embed(rows: DataFrame, embedder: Embedder, kind: str = "node", batch_size: int = 32) -> DataFrame:
    """Vectors of (id, content); empty contents have none. A batch that the embedder fails on is logged and left out, so that one text doesn't end a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                part = batch.slice(i, batch_size)
                try:
                    v = embedder.embed([t[: embedder.max_chars] for t in part.column(1).to_pylist()])
                except Exception:
                    logging.getLogger(__name__).exception("a batch of %d texts is left without vectors", part.num_rows)
                    continue
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), part.column(0), pa.array([embedder.model_id] * n, pa.string()), pa.array(list(v.astype("float32")), pa.list_(pa.float32()))], ["owner_kind", "owner_id", "model_id", "embedding"])

    return rows.where(F.trim("content") != "").select("id", "content").mapInArrow(run, "owner_kind string, owner_id string, model_id string, embedding array<float>")


STATEMENT = re.compile(r"(?:^|(?<=[.!?])\s+)([A-Z][^.!?]{15,300}[.!?])")


def rule_extractor(conversation: str) -> str:
    """A stand-in for a language model: the statements of a conversation that decide or prefer something, as a reply in JSON."""
    import json

    found = [s.strip() for s in STATEMENT.findall(conversation or "")]
    wanted = [s for s in found if re.search(r"\b(decid|prefer|always|never|must|should|use[sd]?|is|are)\w*\b", s, re.I)]
    return json.dumps([{"kind": "fact", "title": s[:80], "content": s, "importance": 0.5} for s in wanted])


def retried(extractor: Callable[[str], str], text: str, tries: int) -> str | None:
    """The reply, or null once so many tries have failed."""
    for _ in range(tries):
        try:
            return extractor(text)
        except Exception:
            logging.getLogger(__name__).exception("an extraction failed")
    return None


def extract_facts(conversations: DataFrame, extractor: Callable[[str], str] = rule_extractor, most: int = 3, least_importance: float = 0.0, tries: int = 2) -> DataFrame:
    """(id, place, kind, title, content, importance) of the facts in conversations (id, text); replies are parsed in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([retried(extractor, t, tries) for t in batch.column(1).to_pylist()], pa.string())], ["id", "reply"])

    replies = conversations.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, reply string")
    facts = replies.select("id", F.slice(F.filter(S.parse_facts(F.col("reply")), lambda f: f["importance"] >= least_importance), 1, most).alias("facts"))
    return facts.select("id", F.posexplode("facts").alias("place", "f")).select("id", "place", "f.*")
