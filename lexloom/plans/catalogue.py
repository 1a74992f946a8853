"""All registries of the core."""

from __future__ import annotations

from lexloom.plans import Registry, corpus, documents, readers, records


def registries() -> list[Registry]:
    return [records.R, corpus.R, documents.R, readers.R]
