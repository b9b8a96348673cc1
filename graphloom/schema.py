"""Schemas of the memory graph's tables, as DDL strings for readers, and the values their columns take."""

from __future__ import annotations


STATUSES = ("current", "stale", "superseded")
TIERS = ("PROPOSED", "INFERRED", "EXTRACTED")  #: in rising order
IMPACT_TYPES = ("implements", "tests", "specifies", "depends-on")
#: Edge types by what they are served as.
STRUCTURAL_TYPES = ("specifies", "implements", "tests", "calls", "defines", "imports", "convention-member")
INFERRED_TYPES = ("auto-linked",)
CROSS_PROJECT_TYPES = ("cross-project-call", "depends_on", "auto-linked")
PROJECT_GRAPH_TYPES = (*STRUCTURAL_TYPES, "auto-linked", "cross-project-call", "depends_on", "references")
GRAPH_DATA_TYPES = (*PROJECT_GRAPH_TYPES, "proposed", "contains")

NODES = "id string, project_id string, node_type string, title string, content string, content_hash string, status string, source_adapter string, source_path string, importance double, language string, created_at timestamp, updated_at timestamp, access_count long, last_accessed_at timestamp, row_seq long"
EDGES = "from_id string, to_id string, edge_type string, confidence double, confidence_tier string, bidirectional boolean, created_at timestamp"
CHUNKS = "id string, parent_node_id string, chunk_index int, chunk_type string, heading_path array<string>, content string, language string, source_adapter string, prev_chunk_id string, next_chunk_id string, created_at timestamp"
VECTORS = "owner_kind string, owner_id string, model_id string, embedding array<float>"
ACCESS_LOG = "project_id string, node_id string, session_id string, accessed_at timestamp"
PROJECTS = "project_id string, project_name string, repository_url string, updated_at timestamp"
EMBED_CONFIG = "project_id string, model_id string, status string, created_at timestamp"
RAW_CALLS = "callee_name string, caller_node_id string, source_file string, source_loc string, lang string, is_member_call boolean, is_new_call boolean, receiver string"
FACTS = "array<struct<kind:string,title:string,content:string,importance:double>>"
