"""Best representative of each duplicate group: survivorship by field, and a two-sided source quality model.

``survivors`` builds the one surviving record of a group field by field: the most recent confirmed canonical name and the
most complete mention. These are fixed orders of preference, which a quality model cannot return, hence
the record comes from ordered aggregates. ``true_values`` is the latent two-sided model for
fields with several values: every source has a sensitivity (how often it states a true value) and a specificity (how
rarely a false one), found by expectation-maximisation; every value judged true is retained.

Scale. Both are partial aggregates with a bounded state (``max_by``); a hot group leaves each task as one row. In
the model the sources of a group that do NOT state a value are never listed: their evidence is the group's total
minus that of the stating sources, so a round is linear in the claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amphora.llm.components import decision_nodes
from amphora.session import blank, forget, materialize


def survivors(grouped: DataFrame, resolutions: DataFrame, extractions: DataFrame) -> DataFrame:
    """(group, canonical, mention_id) for groups of at least two nodes; either may be null.

    canonical: of the rows with ``same = true`` and a non-blank canonical the newest (then highest decision_id; a null
    date is oldest), without the spaces (U+0020) at both ends. mention_id: of the mentions bearing exactly a node's name and type the one with the
    longest description (null counts as 0), then the newest (null oldest), then the smallest id.
    """
    members = grouped.where("id <> group").select("group").distinct().join(grouped, "group").select("group", "name", "type")
    named = decision_nodes(resolutions).where("same").where(~blank(F.col("canonical")))
    # first shrink the decisions to the best of each first node, so that a hot node is one row in the join
    order = F.struct(F.coalesce(F.col("decided_at"), F.lit("0001-01-01").cast("timestamp")), F.col("decision_id"), F.col("canonical"))
    best = named.groupBy("an", "at").agg(F.max(order).alias("o"))
    canonical = (
        members.join(best, F.col("name").eqNullSafe(F.col("an")) & F.col("type").eqNullSafe(F.col("at")))
        .groupBy("group").agg(F.max("o").alias("o")).select("group", F.trim("o.canonical").alias("canonical"))
    )
    order = F.struct(F.coalesce(F.length("description"), F.lit(0)), F.coalesce(F.col("extracted_at"), F.lit("0001-01-01").cast("timestamp")), -F.col("mention_id"))
    best = extractions.groupBy(F.col("name").alias("en"), F.col("type").alias("et")).agg(F.max(order).alias("o"))
    mention = (
        members.join(best, F.col("name").eqNullSafe(F.col("en")) & F.col("type").eqNullSafe(F.col("et")))
        .groupBy("group").agg(F.max("o").alias("o")).select("group", (-F.col("o.col3")).alias("mention_id"))
    )
    return canonical.join(mention, "group", "full")


def claims(grouped: DataFrame, extractions: DataFrame) -> DataFrame:
    """(group, value, source): the place or office, that is the description, that an article gives for a group's node."""
    members = grouped.select("group", "name", "type")
    e = extractions.where(~blank(F.col("description"))).select("name", "type", F.col("description").alias("value"), F.coalesce("title", F.lit("")).alias("source")).distinct()
    return e.join(members, ["name", "type"]).select("group", "value", "source").distinct()


def true_values(stated: DataFrame, rounds: int = 20, prior: float = 0.5, tolerance: float = 0.005) -> DataFrame:
    """(group, value, p_true) of (group, value, source) claims by expectation-maximisation.

    The rounds end when no probability moves by more than ``tolerance``, at the latest after ``rounds``. Beta pseudo-counts (9:1 for specificity, 1:1 for sensitivity) keep sources with few claims near the prior. Null values
    or sources must be removed before; an empty table gives no rows.
    """
    stated = materialize(stated.select("group", "value", "source").where("value is not null and source is not null").distinct(), "claims")
    pairs = materialize(stated.select("group", "source").distinct(), "covered")
    votes = stated.groupBy("group", "value").agg(F.count(F.lit(1)).alias("n"))
    cover = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("s"))
    p = votes.join(cover, "group").select("group", "value", ((F.col("n") + F.lit(0.5)) / (F.col("s") + F.lit(1.0))).alias("p_true"))
    p = materialize(p, "p")
    for _ in range(rounds):
        # M: expected true and false values of the groups a source covers, and those among them that it states
        g = p.groupBy("group").agg(F.sum("p_true").alias("t"), F.count(F.lit(1)).alias("v"))
        seen = pairs.join(g, "group").groupBy("source").agg(F.sum("t").alias("t"), F.sum("v").alias("v"))
        said = stated.join(p, ["group", "value"]).groupBy("source").agg(F.sum("p_true").alias("tp"), F.count(F.lit(1)).alias("k"))
        sens = (F.col("tp") + F.lit(1.0)) / (F.col("t") + F.lit(2.0))
        fpr = (F.col("k") - F.col("tp") + F.lit(1.0)) / (F.col("v") - F.col("t") + F.lit(10.0))
        q = materialize(
            said.join(seen, "source").select("source", sens.alias("se"), fpr.alias("fp"))
            .select("source", F.log(F.col("se") / F.col("fp")).alias("pos"), F.log((F.lit(1.0) - F.col("se")) / (F.lit(1.0) - F.col("fp"))).alias("neg")),
            "quality",
        )
        # E: the silence of all sources of the group, corrected where a source speaks
        silent = pairs.join(q, "source").groupBy("group").agg(F.sum("neg").alias("silent"))
        spoken = stated.join(q, "source").groupBy("group", "value").agg(F.sum(F.col("pos") - F.col("neg")).alias("spoken"))
        logit = F.log(F.lit(prior / (1 - prior))) + F.col("silent") + F.col("spoken")
        after = spoken.join(silent, "group").select("group", "value", (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("p_true"))
        both = materialize(after.join(p.withColumnRenamed("p_true", "before"), ["group", "value"]), "p")
        moved = both.agg(F.max(F.abs(F.col("p_true") - F.col("before")))).first()[0] or 0.0
        forget(p)
        forget(q)
        p = both.drop("before")
        p._amphora_path = both._amphora_path
        if moved <= tolerance:
            break
    return p
