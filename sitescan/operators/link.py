"""Assets linked to products, documents and a register by nearest position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def link_products(rows: DataFrame, products: DataFrame, name: str = "product") -> DataFrame:
    """`rows` with manufacturer, description, documents of their product; null and an empty list where it is unknown."""
    p = products.select(F.col("name").alias(name), "manufacturer", "description", F.col("documents").alias("_d"))
    empty = F.array().cast(products.schema["documents"].dataType)
    return rows.join(p, name, "left").withColumn("documents", F.coalesce("_d", empty)).drop("_d")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, order: str, most: float, strict: bool = False) -> DataFrame:
    """site_id, left_id, right_id, distance: the nearest right row of each left row, if within `most`; of equals the first by `order`.

    Positions are put into cells of side `most`; a right row is listed under its 27 neighbours, so an equi-join finds every pair
    within reach, and what is farther is no match anyway. Rows at one place are looked up once, and of right rows there only the first by `order` can
    be nearest. Spark takes the listed rows for no larger than their table, so they are kept from being broadcast.
    """
    cell = lambda d, a: F.floor(F.col(d + a) / most)
    at = lambda d: ["site_id", *(d + a for a in AXES)]
    l_ = left.select("site_id", left_id, *(F.col(a).cast("double").alias("l" + a) for a in AXES))
    r_ = right.select("site_id", right_id, F.col(order).alias("_order"), *(F.col(a).cast("double").alias("r" + a) for a in AXES))
    r_ = r_.groupBy(*at("r")).agg(F.min(F.struct("_order", right_id)).alias("_first"))
    places = l_.select(*at("l")).distinct().withColumns({"c" + a: cell("l", a) for a in AXES})
    for a in AXES:
        r_ = r_.withColumn("c" + a, F.explode(F.array(*(cell("r", a) + k for k in (-1, 0, 1)))))
    pairs = places.join(r_.hint("merge"), ["site_id", *("c" + a for a in AXES)])
    pairs = pairs.withColumn("distance", F.sqrt(sum((F.col("l" + a) - F.col("r" + a)) ** 2 for a in AXES)))
    pairs = pairs.filter(F.col("distance") < most if strict else F.col("distance") <= most)
    best = pairs.groupBy(*at("l")).agg(F.min(F.struct("distance", "_first")).alias("b"))
    rows = l_.join(best, at("l")).groupBy("site_id", left_id).agg(F.min("b").alias("b"))
    return rows.select("site_id", left_id, F.col(f"b._first.{right_id}").alias(right_id), "b.distance")


def link_register(assets: DataFrame, register: DataFrame, most: float = 0.3) -> DataFrame:
    """`assets` (asset_id, product, x, y, z) with entry_id, distance, registered, title.

    The nearest of all entries counts (of equals the first in the register's file, if it has entry_order, else by entry_id), if within `most`
    and not taken by an earlier asset (by asset_no, if there is one, else by asset_id); who loses it does not get its second nearest and
    becomes 'Unregistered <product>'.
    """
    got = nearest(assets, register, "asset_id", "entry_id", "entry_order" if "entry_order" in register.columns else "entry_id", most)
    if "asset_no" in assets.columns:
        got = got.join(assets.select("site_id", "asset_id", F.col("asset_no").alias("_by")), ["site_id", "asset_id"])
    else:
        got = got.withColumn("_by", F.col("asset_id"))
    first = F.row_number().over(W.partitionBy("site_id", "entry_id").orderBy("_by"))
    won = got.withColumn("_n", first).filter("_n = 1").drop("_n", "_by")
    names = register.select("site_id", "entry_id", "tag_name")
    out = assets.join(won, ["site_id", "asset_id"], "left").join(names, ["site_id", "entry_id"], "left")
    title = F.coalesce("tag_name", F.concat(F.lit("Unregistered "), F.col("product")))
    return out.withColumn("registered", F.col("entry_id").isNotNull()).withColumn("title", title)


def entries_not_found(register: DataFrame, linked: DataFrame) -> DataFrame:
    used = linked.filter("registered").select("site_id", "entry_id")
    return register.join(used, ["site_id", "entry_id"], "left_anti")


def compare_to_truth(assets: DataFrame, objects: DataFrame, most: float = 0.2) -> DataFrame:
    """`assets` with object_id and error_cm of the nearest object within `most` metres, verdict 'NOT A RELAY' where there is none."""
    got = nearest(assets, objects, "asset_id", "object_id", "object_id", most, strict=True)
    out = assets.join(got, ["site_id", "asset_id"], "left").withColumn("error_cm", F.col("distance") * 100).drop("distance")
    return out.withColumn("verdict", F.when(F.col("object_id").isNull(), "NOT A RELAY").otherwise("match"))


def unlocated(objects: DataFrame, compared: DataFrame) -> DataFrame:
    """Objects that no asset matches."""
    return objects.join(compared.filter("object_id is not null").select("site_id", "object_id"), ["site_id", "object_id"], "left_anti")


def build_tags(linked: DataFrame, register: DataFrame) -> DataFrame:
    """Nested tag records: asset, register entry (maintenance is null where unregistered), product and detection.

    nx, ny, nz (a surface's normal), best_photo and crop of `linked` are taken where it has them, else null."""
    note = F.struct("last_inspection", "next_inspection", F.col("maintenance_note").alias("note"))
    extra = register.select("site_id", "entry_id", "panel", "panel_function", "cabinet", note.alias("m"))
    rows = linked.join(extra, ["site_id", "entry_id"], "left")
    own = lambda name: F.col(name) if name in linked.columns else F.lit(None).cast("string").alias(name)
    normal = F.when(F.col("nx").isNotNull(), F.array("nx", "ny", "nz")) if "nx" in linked.columns else F.lit(None).cast("array<double>")
    return rows.select(
        "site_id", F.col("asset_id").alias("id"), "title", "registered", "panel", "panel_function", "cabinet", "product", "manufacturer", "description", "documents",
        F.when(F.col("registered"), F.col("m")).alias("maintenance"), F.array("x", "y", "z").alias("position_xyz"), normal.alias("normal_xyz"),
        F.struct("sightings", F.size("sweeps").alias("scan_positions"), "mean_confidence", own("best_photo")).alias("detection"), own("crop"),
    )


def find_document(products: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id with product and the document's fields; the first product and place wins where an id is used twice."""
    docs = products.select(F.col("product_id"), F.posexplode("documents").alias("pos", "d")).select("product_id", "pos", "d.*")
    found = docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("product_id", "pos"))
    return found.withColumn("_n", n).filter("_n = 1").drop("_n", "pos")


def site_report(linked: DataFrame, register: DataFrame, compared: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """One record per site of a run: assets, registered ones, register_entries_not_found (tag names in order of the file, if it has entry_order, else of
    entry_id) and, where objects are known, objects, located and missing (object ids in order). Lists hold what is missing, never what was found."""
    order = F.col("entry_order") if "entry_order" in register.columns else F.col("entry_id")
    lost = entries_not_found(register, linked).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "tag_name"))).alias("e"))
    sites = linked.select("site_id").union(register.select("site_id")).distinct()
    counts = linked.groupBy("site_id").agg(F.count("*").alias("assets"), F.count_if("registered").alias("registered"))
    none = F.array().cast("array<string>")
    out = sites.join(counts, "site_id", "left").join(lost, "site_id", "left")
    out = out.select("site_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("assets", "registered")), F.coalesce(F.transform("e", lambda x: x.tag_name), none).alias("register_entries_not_found"))
    if objects is None:
        return out
    gone = unlocated(objects, compared).groupBy("site_id").agg(F.array_sort(F.collect_list(F.col("object_id").cast("string"))).alias("missing"))
    total = objects.groupBy("site_id").agg(F.count("*").alias("objects"))
    out = out.join(total, "site_id", "left").join(gone, "site_id", "left").withColumns({"objects": F.coalesce("objects", F.lit(0).cast("long")), "missing": F.coalesce("missing", none)})
    return out.withColumn("located", F.col("objects") - F.size("missing"))
