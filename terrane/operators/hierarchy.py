"""Administrative units as a tree of any depth: which are whole, which hang in the air, which go in a circle; and their import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.scratch import materialize


def resolve_parents(units: DataFrame) -> DataFrame:
    """code, root, depth (0 for a unit without a parent), problem: null, 'orphan' (a parent up the chain is not there) or 'cycle'.

    units: code (once each), parent_code. Every unit's pointer goes to its parent and then twice as far each round, so the rounds are
    as many as the depth has binary digits; units whose pointers no longer arrive anywhere new are in a circle, or below one.
    """
    known = units.select(F.col("code").alias("known"))
    start = units.select("code", F.nullif("parent_code", F.lit("")).alias("up")).join(known, F.col("up") == F.col("known"), "left")
    # A chain ends at a unit without parent, or at one whose parent is missing.
    ended = F.when(F.col("up").isNull(), "root").when(F.col("known").isNull(), "orphan")
    state = materialize(start.select("code", ended.alias("end"), F.when(ended.isNotNull(), F.col("code")).otherwise(F.col("up")).alias("at"), F.when(ended.isNotNull(), 0).otherwise(1).alias("depth")), "chains")
    left = state.filter("end IS NULL").count()
    while left:
        above = state.select(F.col("code").alias("at"), F.col("end").alias("_end"), F.col("at").alias("_at"), F.col("depth").alias("_depth"))
        moved = state.join(above, "at", "left")
        state = materialize(moved.select("code", F.coalesce("end", "_end").alias("end"), F.when(F.col("end").isNull(), F.col("_at")).otherwise(F.col("at")).alias("at"), (F.col("depth") + F.when(F.col("end").isNull(), F.col("_depth")).otherwise(0)).alias("depth")), "chains")
        still = state.filter("end IS NULL").count()
        if still == left:
            break
        left = still
    whole = F.col("end") == "root"
    return state.select("code", F.when(whole, F.col("at")).alias("root"), F.when(whole, F.col("depth")).alias("depth"), F.when(F.col("end") == "orphan", "orphan").when(F.col("end").isNull(), "cycle").alias("problem"))


BOX = ("lng_min", "lat_min", "lng_max", "lat_max")


def import_units(current: DataFrame, incoming: DataFrame, skip_existing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(units, report) after an import of code, name, parent_code, level and the box of units.

    A parent that has units of the same level already is left alone if skip_existing; a unit that exists gets name and box of the incoming
    one and keeps its parent and level; units without a name or a box, or whose box is inverted, are 'missed'; units whose chain of
    parents is broken or circular are not taken. report: code, outcome ('inserted', 'updated', 'skipped', 'missed', 'orphan',
    'cycle') for every incoming row; of rows that repeat a code the first by name counts.
    """
    one = incoming.groupBy("code").agg(F.min(F.struct("name", "parent_code", "level", *BOX)).alias("u")).select("code", "u.*")
    full = (F.coalesce("name", F.lit("")) != "") & (F.col("lng_min") < F.col("lng_max")) & (F.col("lat_min") < F.col("lat_max"))
    parents = current.filter("parent_code IS NOT NULL").select("parent_code", "level", F.lit(True).alias("_has")).distinct()
    old = current.select("code", F.lit(True).alias("_old"))
    asked = one.join(parents, ["parent_code", "level"], "left").join(old, "code", "left")
    skip = F.col("_has").isNotNull() if skip_existing else F.lit(False)
    outcome = F.when(skip, "skipped").when(~F.coalesce(full, F.lit(False)), "missed").when(F.col("_old").isNotNull(), "updated").otherwise("inserted")
    judged = materialize(asked.select("code", "name", "parent_code", "level", *BOX, outcome.alias("outcome")), "judged")
    new = judged.filter("outcome = 'inserted'")
    tree = resolve_parents(current.select("code", "parent_code").unionByName(new.select("code", "parent_code")))
    bad = materialize(tree.filter("problem IS NOT NULL"), "bad")
    report = judged.join(bad.select("code", "problem"), "code", "left").select("code", F.when(F.col("outcome") == "inserted", F.coalesce("problem", "outcome")).otherwise(F.col("outcome")).alias("outcome"))
    fresh = judged.filter("outcome = 'updated'").select("code", F.col("name").alias("_name"), *[F.col(c).alias(f"_{c}") for c in BOX])
    kept = current.join(fresh, "code", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in ("name", *BOX) else F.col(c) for c in current.columns])
    added = new.join(bad, "code", "left_anti")
    return kept.unionByName(added.select(*[F.col(c) if c in added.columns else F.lit(None).alias(c) for c in current.columns])), report
