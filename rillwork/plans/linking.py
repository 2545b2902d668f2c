"""Composed plans: link samples to hazards and watersheds, score watersheds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.operators import health as H
from rillwork.operators.nearest import attach_nearest, nearest_overall
from rillwork.operators.within import within_join
from rillwork.session import broadcast_if_small, checkpoint


def link_sites(
    sites: DataFrame,
    key: str,
    layers: dict[str, DataFrame | None],
    basins: DataFrame | None = None,
    watersheds: DataFrame | None = None,
    max_m: float | None = S.LINK_RADIUS_M,
) -> DataFrame:
    """Watershed codes, distance to every layer and the nearest of all, once per site."""
    linked = sites.select(key, "x_m", "y_m")
    if basins is not None:
        linked = within_join(linked, basins, {"huc10": "HUC10_ID", "name": "HUC10_NAME"})
    if watersheds is not None:
        linked = within_join(linked, watersheds, {"huc12": "HUC12_ID", "name": "HUC12_NAME"})
    linked = attach_nearest(linked, layers, max_m=max_m)
    linked = nearest_overall(linked, [name for name, layer in layers.items() if layer is not None])
    # Scores pass over the samples several times; the spatial work is stored, not repeated.
    return checkpoint(linked)


def link_samples(samples: DataFrame, linked_sites: DataFrame, key: str) -> DataFrame:
    """Give every sample the links of its site, without a shuffle of the samples where the links
    are small; otherwise adaptive execution splits a site that has very many samples."""
    links = broadcast_if_small(linked_sites.drop("x_m", "y_m"), stored=True)
    return samples.join(links, key, "left")


def watershed_health_v1(joined: DataFrame, chemistry: list[str], distance: str, huc: str) -> DataFrame:
    """Mean chemistry, distance and index per watershed with its rank."""
    scored = H.sickness_v1(joined, chemistry, distance, huc)
    means = {"Fe": "Mean_Fe", "ResultMeasureValue": "Mean_Analyte", "Temperatur": "Mean_Temp"}
    means |= {distance: "Mean_Dist_M", "Sickness_Index": "Sickness_Index"}
    return _ranked(scored, huc, means)


def watershed_health_v2(joined: DataFrame, merged: list[str], distance: str | None, huc: str) -> DataFrame:
    """The same from merged inlet/outlet analytes with the proximity factor."""
    # Three passes over the scored columns alone; the samples are read and linked once.
    wanted = dict.fromkeys([huc, *merged, *S.HEALTH_WEIGHTS, *([distance] if distance else [])])
    narrow = checkpoint(joined.select(*[c for c in wanted if c in joined.columns]))
    scored = H.sickness_v2(narrow, distance=distance)
    means = {c: c for c in [*merged, "Sickness_Index", *([distance] if distance else [])]}
    return _ranked(scored, huc, means)


def _ranked(scored: DataFrame, huc: str, means: dict[str, str]) -> DataFrame:
    """Ranking reads the summary twice, so the summary is stored, not the samples scored again."""
    return H.rank_dense(checkpoint(H.aggregate_health(scored, huc, means)), "Sickness_Index")


def map_center(polygons: DataFrame) -> DataFrame:
    """Mean of the polygon centroids."""
    from rillwork.functions.geometry import centroid

    polygon_of = F.col("polygon_of") if "polygon_of" in polygons.columns else None
    middles = polygons.where("parts IS NOT NULL").select(centroid(F.col("parts"), polygon_of).alias("c"))
    return middles.agg(F.avg("c.x").alias("center_x"), F.avg("c.y").alias("center_y"))
