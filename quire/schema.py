"""Spark types of the data model."""

from __future__ import annotations

# fixed values: the two enumerations and the order of the fields
CONTENT_TYPES = ["paragraph", "table", "boxed_section", "footnote", "figure", "mixed"]
CONTINUATION = ["new", "continues", "partial"]
METADATA_FIELDS = {
    "document_id": "string", "source": "string", "source_url": "string", "page_start": "int", "page_end": "int", "level_1_heading": "string",
    "level_2_heading": "string", "level_3_heading": "string", "content_type": "string", "continuation_status": "string",
}
METADATA = "struct<" + ",".join(f"{k}:{t}" for k, t in METADATA_FIELDS.items()) + ">"
CHUNK_FIELDS = {"chunk_id": "string"} | METADATA_FIELDS | {
    "chunk_text": "string", "table_markdown": "string", "keywords": "array<string>", "entities": "array<string>", "source_notes": "string",
    "embedding_text": "string", "metadata": METADATA,
}
CHUNK = ", ".join(f"{k} {t}" for k, t in CHUNK_FIELDS.items())
#: What a model may answer for a chunk; page numbers as text, so that wrong types show in validation.
RAW_CHUNK = "struct<chunk_text:string,page_start:string,page_end:string,level_1_heading:string,level_2_heading:string,level_3_heading:string,content_type:string,continuation_status:string,table_markdown:string,keywords:array<string>,entities:array<string>,source_notes:string>"
BATCH_RESULT = f"struct<document_id:string,source:string,page_range:string,batch_summary:string,chunks:array<{RAW_CHUNK}>>"
HEADING_HIERARCHY = "struct<level_1:string,level_2_candidates:array<string>,level_3_candidates:array<string>>"
