"""Coarse classes and tag handling of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Precedence of the primary tag, most specific purpose first
PRIMARY_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "public_transport")

# Tags promoted to columns
PROMOTED_TAGS = (
    "opening_hours", "cuisine", "outdoor_seating", "website", "phone", "wheelchair", "addr:street", "addr:housenumber",
)

# Amenity values per coarse class
AMENITY_CLASSES = {
    "food&drink": (
        "restaurant", "cafe", "bar", "pub", "fast_food", "ice_cream", "biergarten", "food_court", "juice_bar",
    ),
    "culture&leisure": (
        "theatre", "cinema", "arts_centre", "library", "community_centre", "place_of_worship", "nightclub", "casino",
        "studio", "music_venue", "exhibition_centre", "events_venue", "gallery", "public_bookcase",
    ),
    "health": (
        "pharmacy", "doctors", "dentist", "hospital", "clinic", "veterinary", "nursing_home", "social_facility",
    ),
    "transport": (
        "parking", "parking_entrance", "parking_space", "bicycle_parking", "bicycle_rental", "bicycle_repair_station",
        "motorcycle_parking", "car_rental", "car_sharing", "car_wash", "charging_station", "fuel", "taxi",
        "ferry_terminal", "bus_station", "boat_rental", "boat_sharing",
    ),
    "services": (
        "bank", "atm", "bureau_de_change", "post_office", "post_box", "post_depot", "police", "fire_station",
        "townhall", "courthouse", "embassy", "prison", "driving_school", "language_school", "music_school", "school",
        "college", "university", "kindergarten", "childcare", "research_institute", "coworking_space",
        "internet_cafe", "funeral_hall", "crematorium", "lawyer", "notary", "veterinary_pharmacy",
    ),
    "shop": ("marketplace", "vending_machine"),
}

# Class of every other key
KEY_CLASSES = {
    "shop": "shop", "craft": "services", "office": "services", "healthcare": "health", "tourism": "culture&leisure",
    "leisure": "culture&leisure", "public_transport": "transport",
}

# Label class of the drawn places
LABEL_CLASSES = {"services": 1, "culture&leisure": 1, "health": 1, "shop": 2, "food&drink": 3}


def coarse_class(key: Column, value: Column) -> Column:
    """Amenities by value, everything else by key; what is not known stays visible as ``other``."""
    case = F.when(F.lit(False), F.lit("other"))
    for name, values in AMENITY_CLASSES.items():
        case = case.when((key == "amenity") & value.isin(*values), F.lit(name))
    for tag, name in KEY_CLASSES.items():
        case = case.when(key == tag, F.lit(name))
    return case.otherwise(F.lit("other"))


def label_class(poi_class: Column) -> Column:
    """Class painted into the label raster; null means not drawn."""
    case = F.when(F.lit(False), F.lit(0))
    for name, cls in LABEL_CLASSES.items():
        case = case.when(poi_class == name, F.lit(cls))
    return case


def primary_key(tags: Column) -> Column:
    """First key of the precedence list that the tag map holds."""
    return F.coalesce(*[F.when(F.map_contains_key(tags, F.lit(k)), F.lit(k)) for k in PRIMARY_KEYS])


def sorted_json(tags: Column) -> Column:
    """Tag map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def name_key(name: Column) -> Column:
    """Trimmed, case-folded name; blank names give null."""
    key = F.lower(F.trim(name))
    return F.when(key != "", key)
