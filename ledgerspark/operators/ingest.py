"""The path of claims into an archive, composed of its steps (inventory E2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.aggregates import graph_edges, person_profiles
from ledgerspark.operators.graph import canonical_relationship
from ledgerspark.operators.ordering import apply_conflict_state, idempotent_append
from ledgerspark.operators.predicates import GROUNDED

TRUSTED = ("active", "accepted")


def ingest_claims(archive: DataFrame, batch: DataFrame, conflicts: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """Claims: the archive's with the batch's new ones, each id once, in the states
    that the conflicts give them; edges: canonical relationships that trusted, grounded
    claims tell; profiles: what such claims tell of each person. Nothing is written: the
    caller stores the three, claims first."""
    new = idempotent_append(archive, batch, "claim_id")
    claims = apply_conflict_state(archive.unionByName(new), conflicts)
    sound = claims.where(F.col("status").isin(*TRUSTED) & F.col("evidence_class").isin(*GROUNDED) & F.col("subject_person_id").isNotNull())
    related = canonical_relationship(sound.where(F.col("object_person_id").isNotNull()))
    return {"claims": claims, "edges": graph_edges(related), "profiles": person_profiles(sound, people)}
