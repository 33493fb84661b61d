"""Feature documents: archived GeoJSON pages, CityJSON pages, tagged elements, nested places.

Each function takes text lines (``spark.read.text`` or a column of another table) and parses with a given schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.places import PROMOTED_TAGS, coarse_class, primary_key, sorted_json

PAGE = "features ARRAY<STRUCT<id: STRING, properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: {coords}>>>"
POINT_COORDS = "ARRAY<DOUBLE>"
POLYGON_COORDS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"


def read_pages(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One page per line, or one document per file."""
    return spark.read.text(path, wholetext=whole_files)


def features(pages: DataFrame, coords: str) -> DataFrame:
    """One row per feature of each page, with or without geometry."""
    page = F.from_json("value", PAGE.format(coords=coords))
    return pages.select(F.explode(page["features"]).alias("f")).select("f.id", "f.properties", "f.geometry")


def with_geometry(rows: DataFrame) -> DataFrame:
    return rows.filter("geometry IS NOT NULL AND geometry.coordinates IS NOT NULL")


def rejected(rows: DataFrame) -> DataFrame:
    """How many features came and how many had no geometry."""
    return rows.agg(F.count("*").alias("features"), F.count_if(F.expr("geometry IS NULL OR geometry.coordinates IS NULL")).alias("rejected"))


def as_rings(coords: Column) -> Column:
    """Nested coordinate lists to rings of points."""
    return F.transform(coords, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


CITY_PAGE = """transform STRUCT<scale: ARRAY<DOUBLE>, translate: ARRAY<DOUBLE>>, features ARRAY<STRUCT<id: STRING,
    boundaries: ARRAY<ARRAY<ARRAY<INT>>>, vertices: ARRAY<ARRAY<BIGINT>>>>"""


def city_footprints(pages: DataFrame) -> DataFrame:
    """``(id, surface, rings)``: integer vertices times the page's scale plus its offset.

    The first ring of a surface is its outline, further rings are holes; rings of fewer than three points
    are dropped, and with the outline its surface.
    """
    p = pages.select(F.from_json("value", CITY_PAGE).alias("p")).select("p.transform", F.explode("p.features").alias("f"))
    s, t = F.col("transform.scale"), F.col("transform.translate")
    rows = p.select("transform", F.col("f.id").alias("id"), F.col("f.vertices").alias("v"), F.posexplode("f.boundaries").alias("surface", "b"))

    def ring(ix: Column) -> Column:
        return F.transform(ix, lambda i: F.struct(
            (F.element_at("v", i + 1)[0] * s[0] + t[0]).alias("x"), (F.element_at("v", i + 1)[1] * s[1] + t[1]).alias("y")))

    usable = F.filter("b", lambda r: F.size(r) >= 3)
    return rows.filter(F.size(F.col("b")[0]) >= 3).select("id", "surface", F.transform(usable, ring).alias("rings"))


ELEMENT = "type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, center STRUCT<lat: DOUBLE, lon: DOUBLE>, tags MAP<STRING, STRING>"


def tagged_elements(lines: DataFrame) -> DataFrame:
    """Points of elements (a way takes its centre), primary tag, class, promoted tags, tag count and sorted tag text."""
    e = lines.select(F.from_json("value", ELEMENT).alias("e")).select("e.*")
    key = primary_key(F.col("tags"))
    out = e.withColumns({
        "lat": F.coalesce("lat", "center.lat"), "lon": F.coalesce("lon", "center.lon"), "primary_key": key,
        "primary_value": F.try_element_at("tags", key), "n_tags": F.size("tags"), "tags_json": sorted_json(F.col("tags")),
    }).filter("lat IS NOT NULL AND lon IS NOT NULL AND primary_key IS NOT NULL")
    out = out.withColumn("poi_class", coarse_class(F.col("primary_key"), F.col("primary_value")))
    return out.withColumns({t: F.try_element_at("tags", F.lit(t)) for t in PROMOTED_TAGS}).drop("center")


def flat_places(places: DataFrame) -> DataFrame:
    """Nested places to flat rows: first address, distinct sorted sources, nested parts as JSON text."""
    first = F.try_element_at("addresses", F.lit(1))
    sources = F.array_sort(F.array_distinct(F.filter(F.transform("sources", lambda s: s["dataset"]), lambda d: d.isNotNull() & (d != ""))))
    joined = F.array_join(sources, ",")
    as_json = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return places.select(
        "id", F.col("names.primary").alias("name_primary"), F.col("categories.primary").alias("category_primary"), "confidence",
        first["freeform"].alias("address_freeform"), first["locality"].alias("address_locality"),
        F.when(joined != "", joined).alias("source_datasets"), as_json("addresses").alias("addresses_json"), as_json("sources").alias("sources_json"),
    )
