"""tessera: retrieval-style document analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
functions  Column -> Column expressions (text cleanup, URLs, tokens, parsing)
sources    readers for folders of files, CSV tables and the fixture tables
operators  DataFrame -> DataFrame operators (chunking, sections, embedding,
           retrieval, routing, prompts, store, dialog state, keyed scans)
plans      compositions of operators (ingest, ask, web assist, fallback)
streaming  Structured Streaming forms of ingestion and session state
"""

from tessera.session import get_session, work_dir

__all__ = ["get_session", "work_dir"]
