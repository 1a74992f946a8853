"""Edges between records: traversal, composition, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of link.
LINK_TYPES = (
    "cites", "adjudicates", "applies-to", "derives-from", "precedent-of", "interprets", "contains", "instance-of", "amends", "supersedes", "defines",
    "uses-term", "see-also", "subject-to", "as-defined-in",
)


def unknown_links(links: DataFrame) -> DataFrame:
    """Links whose kind is none of the taxonomy; a null kind is none."""
    return links.where(~F.coalesce(F.col("link_type").isin(*LINK_TYPES), F.lit(False)))


def traverse(links: DataFrame, atoms: DataFrame, start: str | None = None, link_type: str | None = None) -> DataFrame:
    """Outgoing links with the record they point at, null where it does not exist. Without a start
    all links are followed."""
    if start is not None:
        links = links.where(F.col("from_did") == start)
    if link_type is not None:
        links = links.where(F.col("link_type") == link_type)
    to = atoms.select(F.col("did").alias("_did"), F.col("content_hash").alias("to_hash"))
    return links.join(to, F.col("to_did") == F.col("_did"), "left").withColumn("found", F.col("_did").isNotNull()).drop("_did")


def dangling(links: DataFrame, atoms: DataFrame) -> DataFrame:
    return links.join(atoms.select(F.col("did").alias("to_did")).distinct(), "to_did", "left_anti")


def resolve_labels(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``refs (ref, bucket, probe_1, probe_2, probe_3)`` against ``targets (bucket, label, id)``: the
    id under the first probe that is known, else null. All probes are joined at once and the
    smallest one that hit is kept, in one shuffle of the references."""
    probes = refs.select("*", F.posexplode(F.array("probe_1", "probe_2", "probe_3")).alias("_p", "_label"))
    hit = probes.join(targets.select(F.col("bucket").alias("_b"), F.col("label").alias("_l"), F.col("id").alias("_id")), (F.col("bucket") == F.col("_b")) & (F.col("_label") == F.col("_l")), "left")
    best = F.min_by(F.col("_id"), F.when(F.col("_id").isNotNull(), F.col("_p")))
    return hit.groupBy(*refs.columns).agg(best.alias("to_id"))


def shares(edges: DataFrame, workspace: str | None = None, user: str | None = None) -> DataFrame:
    """Share edges ``(did, workspace_did, from_user_did, to_user_did, shared_at)`` of a workspace, of a
    user on either side, or of both; newest first, of equal times by id."""
    if workspace is not None:
        edges = edges.where(F.col("workspace_did") == workspace)
    if user is not None:
        edges = edges.where((F.col("from_user_did") == user) | (F.col("to_user_did") == user))
    return edges.orderBy(F.desc("shared_at"), "did")
