"""What a document's pages say of the whole: one row of structure for each, and the manifest of its assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.shared import written
from . import rollup
from .ordered import numbered
from .publish import structure_counts

#: Profiles of pages that a document's layout profile keeps.
PROFILE_PAGES = 120


def page_profile() -> Column:
    """The profile of an observed page with its flow and columns."""
    return F.struct(
        F.col("dominant_flow"), F.col("column_count").alias("column_count_estimate"), F.col("line_count"),
        F.col("avg_line_length").alias("average_line_length"), (F.col("running_header") != "").alias("has_running_header"),
        (F.col("page_marker") != "").alias("has_page_marker"), F.col("has_figure_marker"),
        (F.size("footnotes") > 0).alias("has_footnotes"), F.array_contains("content_features", "contents_entries").alias("has_contents_entries"),
    )


def page_profiles(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, page_profiles): the profiles of each document's first pages, in order; others are never gathered."""
    slim = pages.select(*keys, F.col(order).alias("_order"), page_profile().alias("_profile"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_order"))
    first = slim.withColumn("_place", place).where(F.col("_place") <= PROFILE_PAGES)
    listed = F.array_sort(F.collect_list(F.struct("_place", "_profile")))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["_profile"]).alias("page_profiles"))


def assets_manifest(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, index, asset): the assets of all chunks, flattened in order and numbered from 1; none is dropped.

    `chunks` has an array of structs, `assets`. Chunks are numbered by a scan over their counts of assets.
    """
    known = written(chunks.where(F.size("assets") > 0).select(*keys, order, "assets").withColumn("_id", F.monotonically_increasing_id()), "assets")
    counts = numbered(known.select(*keys, order, "_id", F.size("assets").alias("_n")), keys, [order, "_id"], "_before", F.col("_n"))
    spots = counts.select(F.col("_id").alias("_spot"), "_before")
    exploded = known.join(spots, F.col("_id") == F.col("_spot")).select(*keys, "_before", F.posexplode("assets").alias("_pos", "asset"))
    return exploded.select(*keys, (F.col("_before") + F.col("_pos") + 1).alias("index"), "asset")


def structure_record(observed: DataFrame, keys: list[str], order: str, chunks: DataFrame | None = None, kind: str = "document_type") -> DataFrame:
    """One row for each document: lists and counts, roles and features, headers, layout profile and assets.

    The pages are observed once and written, without their texts. `chunks` (keys, assets) count the assets.
    """
    read = {
        *keys, order, kind, "table_rows", "chart_signals", "role", "layout", "content_features", "footnotes", "contents_entries", "page_marker",
        "title_candidates", "section_headings", "contributors", "publishers", "running_header", "line_count", "avg_line_length", "has_figure_marker",
    }
    native = [c for c in ("native_flow", "native_columns") if c in observed.columns]
    pages = written(rollup.with_profile(observed).select(*sorted(read), *native, "dominant_flow", "column_count"), "observed")
    heads = rollup.frequent(pages, keys, "running_header", order)
    headers = F.transform(F.array_sort(F.collect_list(F.struct("place", "running_header"))), lambda x: x["running_header"])
    kinds = pages.groupBy(*keys).agg(F.min(kind).alias("document_type"))
    profile = rollup.layout_profile(pages, keys).join(page_profiles(pages, keys, order), keys)
    profile = profile.select(*keys, F.struct("dominant_flow", "column_count_estimate", "page_flow_counts", "page_profiles", "notes").alias("layout_profile"))
    parts = [
        rollup.document_structure(pages, keys, order), structure_counts(pages, keys), profile,
        heads.groupBy(*keys).agg(headers.alias("running_headers")),
    ]
    if chunks is not None:
        parts.append(chunks.groupBy(*keys).agg(F.sum(F.greatest(F.size("assets"), F.lit(0))).alias("asset_count")))
    whole = reduce(lambda a, b: a.join(b, keys, "left"), parts, kinds)
    count = F.coalesce("asset_count", F.lit(0)) if chunks is not None else F.lit(0)
    return whole.withColumns({"asset_count": count.cast("long"), "running_headers": F.coalesce("running_headers", F.array().cast("array<string>"))})


#: What a manifest's structure must have to be taken as it is.
STRUCTURE_PARTS = ("semantic_units", "layout_tree", "layout_profile")


def with_structure(manifests: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Manifests (key, structure) with the structure that they have, or the computed one where a part is missing or empty.

    Structures are JSON; `computed` has (key, structure) for the manifests that need one.
    """

    def there(part: str) -> Column:
        value = F.get_json_object("structure", f"$.{part}")
        return F.coalesce(~value.isin("", "[]", "{}", "null"), F.lit(False))

    whole = reduce(lambda a, b: a & b, [there(p) for p in STRUCTURE_PARTS])
    made = computed.select(F.col(key).alias("_key"), F.col("structure").alias("_made"))
    joined = manifests.join(made, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({"backfilled": ~whole & F.col("_made").isNotNull(), "structure": F.when(whole, F.col("structure")).otherwise(F.coalesce("_made", "structure"))}).drop("_key", "_made")
