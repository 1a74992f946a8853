"""Facade over a snapshot on disk: what a service would ask, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import ids as I
from lexloom.operators import graph, rules, search, store, summaries

KINDS = ("code-section", "code-definition", "code-cross-reference", "code-amendment", "code-edition", "jurisdiction-corpus")
POLICIES = ("public-free", "public-paid", "platform-internal", "tenant-private")


class Engine:
    """``atoms``: did, entity_type, entity_id, jurisdiction_tenant, section_number, snippet, seq,
    content_hash. ``links``: from_did, to_did, link_type. ``status``: one row per tenant."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self.atoms, self.links, self.status = tables["atoms"], tables["links"], tables["status"]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        """Raises ValueError when the folder holds no snapshot of this format."""
        return cls(store.read_snapshot(spark, path))

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> tuple[int, dict]:
        try:
            self.atoms.limit(1).count()
            return 200, {"status": "ready"}
        except Exception as e:
            return 503, {"status": "not-ready", "error": str(e)}

    def search(self, q: str = "", tenant: str | None = None, kind: str | None = None, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        if kind is not None and kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if not 1 <= limit <= search.MOST:
            raise ValueError(f"limit must be 1 to {search.MOST}")
        return search.search(self.atoms, q, tenant, kind, limit)

    def retrieve(self, q: str = "", tenant: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
        """The results of ``search`` with ``total_candidates``."""
        return search.with_total(self.search(q, tenant, kind, search.clamp(limit)))

    def atom(self, did: str) -> DataFrame:
        """The record and its outgoing links; no rows when there is none."""
        out = graph.traverse(self.links, self.atoms, did)
        held = out.groupBy("from_did").agg(F.collect_list(F.struct("link_type", "to_did", "found")).alias("composition"))
        return self.atoms.where(F.col("did") == did).limit(1).join(held, F.col("did") == F.col("from_did"), "left").drop("from_did")

    def atom_by_id(self, kind: str, entity_id: str) -> DataFrame:
        return self.atoms.where(F.col("did") == I.did(F.lit(kind), F.lit(entity_id))).limit(1)

    def sections_by_number(self, tenant: str, number: str) -> DataFrame:
        return self.atoms.where((F.col("entity_type") == "code-section") & (F.col("jurisdiction_tenant") == tenant) & (F.col("section_number") == number))

    def jurisdictions(self, policies: str | None = None, passing_only: bool = False) -> DataFrame:
        return store.visible(self.status, policies, POLICIES, passing_only)

    def jurisdiction(self, tenant: str, topic: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """A tenant's status, and the best records on a topic."""
        return self.status.where(F.col("jurisdiction_tenant") == tenant), (self.search(topic, tenant) if topic else None)

    def traverse(self, did: str, link_type: str | None = None) -> DataFrame:
        return graph.traverse(self.links, self.atoms, did, link_type)

    def effective_rules(self, bases: DataFrame, amendments: DataFrame) -> DataFrame:
        return rules.effective_rules(bases, amendments)

    def summary(self, records: DataFrame, kind: str, audience: str = "ai", asked: DataFrame | None = None) -> DataFrame:
        return summaries.summarize(records, kind, audience, asked)
