"""Silver to gold: spatial clusters, pair scores, components, canonical records, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import similarity as sim
from terrane.functions.geo import geodesic_m, mercator_x, mercator_y
from terrane.functions.refdata import SOURCES, UNKNOWN_PRIORITY
from terrane.functions.text import pair_key
from terrane.plans.scratch import materialize

from .cells import linked_cells
from .components import connected_components
from .dense import dense_pairs, place_scores
from .pairs import given_pairs, pairs_of, reachable_pairs, score_found, scored_classes, self_score, twins
from .resolve import RECORD, Resolver, resolve_all

EPS_M, MIN_WEIGHT = 55.0, 0.01
CHANGED_FIELDS = ("canonical_name", "canonical_address", "canonical_phone", "canonical_website", "location", "openooh_category", "brand")


def neighbour_links(points: DataFrame, eps_m: float = EPS_M, metric: str = "mercator") -> DataFrame:
    """Links (a, b) that connect the same components as the graph "distance at most eps".

    Points fall into cells of side eps / sqrt 2, so all points of one cell are within eps and link to its smallest id: no
    pair inside a cell is looked at. Two cells near enough get one link between their smallest ids; see `cells` for how they are found.
    """
    scale = F.lit(1.0) if metric == "mercator" else F.cos(F.radians("lat"))
    side = eps_m / 2**0.5
    flat = points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id", "lat", "lng", (mercator_x(F.col("lng")) * scale).alias("x"), mercator_y(F.col("lat")).alias("y"))
    if metric != "mercator":
        flat = flat.withColumn("y", F.radians("lat") * 6371008.8)
    cells = flat.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    heads = cells.groupBy("cx", "cy").agg(F.min("id").alias("head"))
    inside = cells.join(heads, ["cx", "cy"]).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    head = lambda n: heads.select(F.col("cx").alias(f"{n}x"), F.col("cy").alias(f"{n}y"), F.col("head").alias(n))
    across = linked_cells(cells, eps_m).join(head("a"), ["ax", "ay"]).join(head("b"), ["bx", "by"]).select("a", "b")
    return inside.unionByName(across)


def spatial_clusters(points: DataFrame, eps_m: float = EPS_M, metric: str = "mercator") -> DataFrame:
    """id, cluster_id for every point with coordinates: DBSCAN with one point to a core, so the components of the eps graph.

    cluster_id is the smallest id of the cluster. Distances are those of Web Mercator, which stretches by 1/cos(latitude),
    unless metric is 'ground'.
    """
    linked = connected_components(neighbour_links(points, eps_m, metric))
    all_ = points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id")
    return all_.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def cluster(silver: DataFrame, eps_m: float = EPS_M, only_pending: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """id, cluster_id of the pending rows, of all rows, or of those of a table of ids, which then decides alone."""
    if ids is not None:
        chosen = silver.join(ids.select("id").distinct(), "id", "left_semi")
    else:
        chosen = silver.filter("merge_status = 'pending'") if only_pending else silver
    return spatial_clusters(chosen, eps_m)


#: Columns of silver that pair scoring reads.
SCORED = ("id", "name_embedding", "address_normalized", "phone_e164", "website_domain", "brand")


#: Left rows of a cluster that are met by its right rows at a time.
BLOCK_MEMBERS = 64


def candidate_pairs(members: DataFrame, cluster: str = "cluster_id", block: int = BLOCK_MEMBERS) -> DataFrame:
    """All pairs a.id < b.id of a cluster. The left rows of a cluster are dealt into blocks of about `block`, to each of which its
    right rows are copied, so a dense cluster is many groups. What a task does grows with pairs, not with bytes, so the number of
    tasks is given and adaptive execution doesn't merge them by their bytes."""
    spark = members.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size")).filter("size > 1").select(cluster, F.ceil(F.col("size") / block).cast("long").alias("salts"))
    sized = members.join(sizes, cluster)
    left = sized.select(F.col(cluster), F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.struct(*SCORED).alias("a"))
    right = sized.select(F.col(cluster), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.struct(*SCORED).alias("b"))
    return left.repartition(tasks, cluster, "salt").join(right.repartition(tasks, cluster, "salt"), [cluster, "salt"]).filter("a.id < b.id").drop("salt")


def may_reach(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose score can be `least` or more: with phone, website and brand as they are, and name and address at their
    best. It leaves out no pair that scores so much, and needs neither vectors nor token sets."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    best = lambda x, y, none: F.when(none(x) | none(y), sim.NEUTRAL).otherwise(1.0)
    parts = {
        "name": best(a("name_embedding"), b("name_embedding"), lambda c: c.isNull() | (F.size(c) == 0)),
        "address": best(a("address_normalized"), b("address_normalized"), lambda c: F.coalesce(c, F.lit("")) == ""),
        **{k: sim.equal_or_neutral(a(c), b(c)) for k, c in (("phone", "phone_e164"), ("website", "website_domain"), ("brand", "brand"))},
    }
    return pairs.filter(sim.composite(parts) >= least)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """a_id, b_id, the five parts, score and decision."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    parts = pairs.select(
        a("id").alias("a_id"),
        b("id").alias("b_id"),
        sim.cosine_batches(a("name_embedding"), b("name_embedding")).alias("name"),
        sim.token_set_ratio(a("address_normalized"), b("address_normalized")).alias("address"),
        sim.equal_or_neutral(a("phone_e164"), b("phone_e164")).alias("phone"),
        sim.equal_or_neutral(a("website_domain"), b("website_domain")).alias("website"),
        sim.equal_or_neutral(a("brand"), b("brand")).alias("brand"),
    )
    scored = parts.withColumn("score", sim.composite({k: F.col(k) for k, _ in sim.WEIGHTS}))
    return scored.withColumn("decision", sim.decision(F.col("score")))


def score_all(members: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """All pairs a_id < b_id of a cluster, as score_pairs has them of candidate_pairs, without a row that carries two places."""
    rows = members.select(F.col(cluster).alias("grp"), *SCORED)
    parts = dense_pairs(rows, place_scores, ", ".join(f"{k} double" for k in (*dict(sim.WEIGHTS), "score")))
    return parts.withColumn("decision", sim.decision(F.col("score")))


def resolve(pairs: DataFrame, resolver: Resolver, cache: DataFrame | None = None, records: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """lo_id, hi_id, same, confidence, reason of the pairs that got an answer, from the cache or the resolver; see resolve_all, which
    also tells of the others. The resolver gets two dicts with id and, of `records` (rows of silver), those fields of RECORD that they
    have; without records, or for an id that they lack, id alone. unique: each pair comes once."""
    return resolve_all(pairs, resolver, cache, records, unique=unique).filter("same IS NOT NULL").select("lo_id", "hi_id", "same", "confidence", "reason")


def agreed(resolutions: DataFrame) -> DataFrame:
    """lo_id, hi_id of the resolutions that call a pair the same with enough confidence."""
    return resolutions.filter(F.col("same") & (F.col("confidence") >= sim.LLM_ACCEPT)).select("lo_id", "hi_id")


def resolved_edges(classes: DataFrame, of: DataFrame, resolver: Resolver) -> DataFrame:
    """a, b: the pairs to merge of scored classes: sure ones, and asked ones where the answer agrees. Each answer stands with its pair,
    so nothing is looked up."""
    sure, asked = (pairs_of(classes.filter(F.col("decision") == d).select("a_id", "b_id", "score", "decision"), of) for d in ("auto_merge", "needs_llm"))
    said = agreed(resolve(asked, resolver, unique=True))
    return sure.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(said.select(F.col("lo_id").alias("a"), F.col("hi_id").alias("b")))


def accepted_edges(scored: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Pairs to merge: sure ones, and asked ones that the resolutions call the same with enough confidence."""
    sure = scored.filter("decision = 'auto_merge'").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    if resolutions is None:
        return sure
    said = agreed(resolutions).select(pair_key(F.col("lo_id"), F.col("hi_id")).alias("key"))
    asked = scored.filter("decision = 'needs_llm'").withColumn("key", pair_key(F.col("a_id"), F.col("b_id")))
    return sure.unionByName(asked.join(said, "key", "left_semi").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def assign_components(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members with component: the smallest id that edges reach, or the own."""
    found = connected_components(edges)
    return members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def priority_of(source: Column) -> Column:
    made = F.create_map(*[x for s in SOURCES for x in (F.lit(s[1]), F.lit(s[3]))])
    return F.coalesce(F.try_element_at(made, source), F.lit(UNKNOWN_PRIORITY))


def best_field(field: str, order: Column) -> Column:
    """The field of the row that ranks highest among those that have it."""
    value = F.col(field)
    there = value.isNotNull() & (value.cast("string") != "")
    return F.max_by(value, F.when(there, order))


def modes(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key and for each field its most frequent value, nulls aside, ties to the value seen first by id. One pass: the fields
    are stacked, counted and picked together."""
    long = rows.select(key, "id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("f")).select(key, "id", "f.field", "f.value").filter("value IS NOT NULL")
    counted = long.groupBy(key, "field", "value").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counted.groupBy(key).agg(*[F.max_by("value", F.when(F.col("field") == f, F.struct("n", -F.col("first")))).alias(f) for f in fields])


def build_masters(members: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One canonical record for each component, by one aggregation on it (and one of the administrative codes).

    members: silver columns with component, source_code, source_poi_id, raw_poi_id. A field is taken from the row of the
    highest quality, then of the most trusted source, then of the smallest id, that has it; the point is the mean weighted
    by quality; codes are the most frequent ones.
    """
    now = F.current_timestamp() if as_of is None else as_of
    quality = F.coalesce(F.col("quality_score").cast("double"), F.lit(0.0))
    order = F.struct(quality, -priority_of(F.col("source_code")), -F.col("id"))
    weight = F.greatest(quality, F.lit(MIN_WEIGHT))
    ref = F.struct(F.col("source_code").alias("source"), "source_poi_id", "raw_poi_id")
    codes = ("province_code", "district_code", "ward_code")
    made = members.groupBy("component").agg(
        best_field("name_original", order).alias("canonical_name"),
        best_field("address_normalized", order).alias("canonical_address"),
        best_field("phone_e164", order).alias("canonical_phone"),
        best_field("website", order).alias("canonical_website"),
        (F.sum(F.col("lat") * weight) / F.sum(weight)).alias("lat"),
        (F.sum(F.col("lng") * weight) / F.sum(weight)).alias("lng"),
        best_field("openooh_category", order).alias("openooh_category"),
        best_field("openooh_subcategory", order).alias("openooh_subcategory"),
        best_field("brand", order).alias("brand"),
        F.sort_array(F.collect_list(F.struct("raw_poi_id", ref.alias("r")))).alias("_refs"),
        F.sort_array(F.collect_list("id")).alias("merged_processed_ids"),
        F.countDistinct("source_code").alias("distinct_sources"),
        F.round(F.max(quality), 3).cast("decimal(3,2)").alias("quality_score"),
    )
    frequent = modes(members, "component", codes)
    made = made.join(frequent, "component", "left")
    return made.select(
        F.sha2(F.array_join(F.transform("merged_processed_ids", lambda i: i.cast("string")), ","), 256).alias("id"),
        "component",
        *[c for c in made.columns if c.startswith("canonical_")],
        "lat",
        "lng",
        "openooh_category",
        "openooh_subcategory",
        "brand",
        *codes,
        F.transform("_refs", lambda r: r["r"]).alias("source_refs"),
        "merged_processed_ids",
        F.size("_refs").alias("sources_count"),
        "distinct_sources",
        F.col("quality_score").alias("confidence"),
        "quality_score",
        F.lit("active").alias("status"),
        F.lit(1).alias("version"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def initial_history(masters: DataFrame) -> DataFrame:
    """History rows of new masters."""
    values = F.struct("canonical_name", "canonical_address", "canonical_phone", "canonical_website", "lat", "lng", "openooh_category", "brand", "merged_processed_ids")
    return masters.select(
        F.col("id").alias("master_poi_id"),
        F.lit(1).alias("version"),
        F.array(*[F.lit(f) for f in CHANGED_FIELDS]).alias("changed_fields"),
        F.lit(None).cast("string").alias("previous_values"),
        F.to_json(values).alias("new_values"),
        F.when(F.size("merged_processed_ids") > 1, "initial_merge").otherwise("singleton_master").alias("change_reason"),
        F.col("created_at").alias("changed_at"),
    )


def mark_merged(silver: DataFrame, masters: DataFrame) -> DataFrame:
    """Silver with merged_into and merge_status of the members of new masters."""
    of = masters.select(F.col("id").alias("_master"), F.explode("merged_processed_ids").alias("_member"))
    joined = silver.join(of, silver["id"] == of["_member"], "left")
    keep = [c for c in silver.columns if c not in ("merged_into", "merge_status")]
    old = F.col("merged_into") if "merged_into" in silver.columns else F.lit(None).cast("string")
    return joined.select(*keep, F.coalesce("_master", old).alias("merged_into"), F.when(F.col("_master").isNotNull(), "merged").otherwise(F.col("merge_status")).alias("merge_status"))


def reject(silver: DataFrame, ids: list[int], reason: str) -> DataFrame:
    """Pending rows among the ids become rejected, with the reason."""
    hit = F.col("id").isin(*ids) & (F.col("merge_status") == "pending") if ids else F.lit(False)
    out = silver if "merge_reason" in silver.columns else silver.withColumn("merge_reason", F.lit(None).cast("string"))
    return out.withColumn("merge_reason", F.when(hit, F.lit(reason)).otherwise(F.col("merge_reason"))).withColumn("merge_status", F.when(hit, "rejected").otherwise(F.col("merge_status")))


def manual_merge(silver: DataFrame, ids: list[int], as_of: Column | None = None) -> DataFrame:
    """The master of the pending rows among 1 to 100 ids; no row where none is pending."""
    if not 1 <= len(ids) <= 100:
        raise ValueError("1 to 100 ids")
    return build_masters(silver.filter(F.col("id").isin(*ids) & (F.col("merge_status") == "pending")).withColumn("component", F.lit(min(ids)).cast("long")), as_of)


def review_queue(silver: DataFrame, eps_m: float = EPS_M) -> DataFrame:
    """Pending rows in clusters of two or more, by cluster and quality."""
    pending = silver.filter("merge_status = 'pending'")
    placed = pending.join(spatial_clusters(pending, eps_m), "id")
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    return placed.withColumn("cluster_size", size).filter("cluster_size > 1").orderBy("cluster_id", F.desc_nulls_last("quality_score"), "id")


def merging_edges(placed: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """a, b: edges with the components of all pairs to merge (sure ones, and asked ones that the resolutions call the same) of a cluster.

    Rows that are alike in all that is scored are one row in the search for pairs; they hang together if they merge by themselves or
    with another row. Resolved pairs are looked up, not searched for.
    """
    placed_twins = materialize(twins(placed), "twins")
    heads = materialize(placed.join(placed_twins.filter("id = twin_of").select("id"), "id", "left_semi"), "heads")
    found = score_found(reachable_pairs(heads, sim.AUTO_MERGE), heads, sim.AUTO_MERGE)
    edges = materialize(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "sure")
    drawn = edges.select(F.explode(F.array("a", "b")).alias("twin_of")).unionByName(heads.filter(self_score() >= sim.AUTO_MERGE).select(F.col("id").alias("twin_of"))).distinct()
    alike = placed_twins.filter("id <> twin_of").join(drawn, "twin_of", "left_semi").select(F.col("twin_of").alias("a"), F.col("id").alias("b"))
    edges = edges.unionByName(alike)
    if resolutions is None:
        return edges
    said = agreed(resolutions).select(F.col("lo_id").alias("a_id"), F.col("hi_id").alias("b_id"))
    asked = score_found(given_pairs(said, placed), placed, sim.NEEDS_LLM)
    return edges.unionByName(asked.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def pairs_to_ask(placed: DataFrame) -> DataFrame:
    """The scored pairs of a cluster that need a model, each once, a_id < b_id. All pairs of a cluster are looked at only where phone,
    website and brand may all be missing or different, which at this threshold leaves name and address to decide."""
    classes, of = scored_classes(placed, sim.NEEDS_LLM)
    return pairs_of(classes.filter("decision = 'needs_llm'"), of)


def dedupe(silver: DataFrame, resolutions: DataFrame | None = None, eps_m: float = EPS_M, as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masters, history, silver) after a pass over the pending rows. Every pending row ends in exactly one master."""
    pending = materialize(silver.filter("merge_status = 'pending'"), "pending")
    placed = materialize(pending.join(spatial_clusters(pending, eps_m), "id"), "placed")
    masters = materialize(build_masters(assign_components(placed, merging_edges(placed, resolutions)), as_of), "masters")
    return masters, initial_history(masters), mark_merged(silver, masters)


def dedupe_stats(placed: DataFrame, masters: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """clusters, masters_created, members_merged, llm_calls."""
    calls = resolutions.count() if resolutions is not None else 0
    return placed.agg(F.countDistinct("cluster_id").alias("clusters")).join(F.broadcast(masters.agg(F.count("*").alias("masters_created"), F.coalesce(F.sum(F.size("merged_processed_ids")), F.lit(0)).alias("members_merged")))).withColumn("llm_calls", F.lit(calls).cast("long"))


__all__ = ["RECORD", "build_masters", "candidate_pairs", "dedupe", "geodesic_m", "manual_merge", "merging_edges", "neighbour_links", "pairs_of", "pairs_to_ask", "reachable_pairs", "reject", "resolve", "review_queue", "score_all", "score_found", "score_pairs", "scored_classes", "spatial_clusters"]
