"""Fixed values of the contribution data model.

Every value list, label and output-column suffix below has to equal the published
definition of the feature tables, otherwise the counts differ.  The module holds
data only; ``expressions`` turns it into Spark columns.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TagTest:
    """One condition on the value of a tag key.

    ``values`` restricts the value to a list, ``excluded`` forbids one value, and
    with neither of the two the key only has to be present.
    """

    key: str
    values: tuple[str, ...] | None = None
    excluded: str | None = None


# --------------------------------------------------------------------------
# Tag value lists
# --------------------------------------------------------------------------
WATER_BODIES = ("pond", "lake", "reservoir", "basin", "oxbow", "lagoon", "fishpond")
EDUCATION = ("kindergarten", "school", "college", "university")
FINANCE = ("atm", "bank", "money_transfer", "bureau_de_change", "mobile_money_agent", "payment_terminal")
HEALTH = ("doctors", "dentist", "clinic", "hospital", "pharmacy")
NATURAL_COVER = (
    "bare_rock", "beach", "dune", "fell", "glacier", "grassland", "heath", "landslide", "mud",
    "rock", "sand", "scree", "scrub", "shingle", "water", "wetland", "wood",
)
WATERWAY_AREAS = ("boatyard", "dam", "dock", "riverbank")
PLACES = (
    "country", "state", "region", "province", "district", "county", "municipality", "city",
    "borough", "suburb", "quarter", "neighbourhood", "town", "village", "hamlet", "isolated_dwelling",
)
SOCIAL = ("shelter", "social_facility", "refugee_site")
WASH_AMENITIES = ("toilets", "shower", "drinking_water", "water_point")
WASH_STRUCTURES = (
    "water_tap", "borehole", "water_works", "pumping_station", "pump", "wastewater_plant",
    "storage_tank", "water_well", "water_tower", "reservoir_covered", "water_tank",
)
WATERWAYS = ("river", "canal", "stream", "brook", "drain", "ditch")
POI_KEYS = ("amenity", "shop", "craft", "office", "leisure", "aeroway")

# --------------------------------------------------------------------------
# Feature flags, in output order (this is also the tie order of
# the top feature type)
# --------------------------------------------------------------------------
FEATURE_FLAGS: dict[str, tuple[TagTest, ...]] = {
    "building": (TagTest("building", excluded="no"),),
    "road": (TagTest("highway"),),
    "amenity": (TagTest("amenity"),),
    "body_of_water": (TagTest("water", WATER_BODIES),),
    "shop": (TagTest("shop"),),
    "educational_institution": (TagTest("amenity", EDUCATION), TagTest("building", EDUCATION)),
    "financial_service": (TagTest("amenity", FINANCE),),
    "healthcare_facility": (TagTest("healthcare"), TagTest("amenity", HEALTH)),
    "land_use": (TagTest("landuse"), TagTest("natural", NATURAL_COVER), TagTest("waterway", WATERWAY_AREAS)),
    "place": (TagTest("place", PLACES),),
    "point_of_interest": tuple(TagTest(key) for key in POI_KEYS),
    "social_facility": (TagTest("social_facility"), TagTest("amenity", SOCIAL)),
    "wash_facility": (TagTest("amenity", WASH_AMENITIES), TagTest("man_made", WASH_STRUCTURES)),
    "waterway": (TagTest("waterway", WATERWAYS),),
}
FEATURES = tuple(FEATURE_FLAGS)

# --------------------------------------------------------------------------
# Category of an added key.  The first matching test wins, and the
# order matters: a plain `amenity` test shadows the later amenity value lists.
# --------------------------------------------------------------------------
ADDED_KEY_CATEGORIES: tuple[tuple[str, TagTest], ...] = (
    ("building", TagTest("building", excluded="no")),
    ("road", TagTest("highway")),
    ("amenity", TagTest("amenity")),
    ("body_of_water", TagTest("water", WATER_BODIES)),
    ("shop", TagTest("shop")),
    ("educational_institution", TagTest("amenity", EDUCATION)),
    ("educational_institution", TagTest("building", EDUCATION)),
    ("financial_service", TagTest("amenity", FINANCE)),
    ("healthcare_facility", TagTest("healthcare")),
    ("healthcare_facility", TagTest("amenity", HEALTH)),
    ("land_use", TagTest("landuse")),
    ("land_use", TagTest("natural", NATURAL_COVER)),
    ("land_use", TagTest("waterway", WATERWAY_AREAS)),
    ("place", TagTest("place", PLACES)),
    *(("point_of_interest", TagTest(key)) for key in POI_KEYS),
    ("social_facility", TagTest("social_facility")),
    ("social_facility", TagTest("amenity", SOCIAL)),
    ("wash_facility", TagTest("amenity", WASH_AMENITIES)),
    ("wash_facility", TagTest("man_made", WASH_STRUCTURES)),
    ("waterway", TagTest("waterway", WATERWAYS)),
)
REMOVED_KEY_CATEGORIES: tuple[tuple[str, TagTest], ...] = (
    ("building", TagTest("building", excluded="no")),
)
OTHER = "other"

# Key categories counted per day, with their column suffix
CATEGORY_SUFFIX = {name: ("poi" if name == "point_of_interest" else name) for name in (*FEATURES, OTHER)}

# --------------------------------------------------------------------------
# Editors.  Case-insensitive patterns, first match wins.
# --------------------------------------------------------------------------
EDITOR_PATTERNS = (("%josm%", "JOSM"), ("iD%", "iD"), ("%streetcomplete%", "Streetcomplete"))
EDITOR_COLUMNS = {"JOSM": "josm", "iD": "id", "Streetcomplete": "streetcomplete", OTHER: "other_id"}

# --------------------------------------------------------------------------
# Contribution types -> (suffix of the daily total, suffix in the
# feature x type matrix)
# --------------------------------------------------------------------------
EDIT_TYPES = {
    "CREATION": ("created", "created"),
    "DELETION": ("deleted", "deleted"),
    "TAG": ("tag_only", "tag_only"),
    "GEOMETRY": ("geom_only", "geometry_only"),
    "TAG_GEOMETRY": ("tag_and_geom", "tag_and_geometry"),
    "": ("none", "none"),
}
OBJECT_TYPES = ("node", "way", "relation")

# --------------------------------------------------------------------------
# Pseudo countries, disputed-area codes, world bounds, dates
# --------------------------------------------------------------------------
STATELESS = "STATELESS"
SPECIAL_REGIONS = "SPECIAL_REGIONS"
SPECIAL_REGION_CODES = (
    "CP", "XA", "XB", "XC", "XD", "XE", "XG", "XH", "XI", "XJ", "XK", "XL", "XM", "XN", "XO",
    "XP", "XQ", "XR", "XS", "XT", "XU", "XW", "XX", "XY", "XZ",
)
WORLD_BOUNDS = (-180.0, -90.0, 180.0, 90.0)
RANGE_START = "2007-01-01 00:00:00"
RANGE_END = "2025-07-29 00:00:00"
VALIDITY_SNAPSHOT = "2025-07-29 23:59:59"
COHORT_SNAPSHOT = "2025-07-28"

# --------------------------------------------------------------------------
# Column lists of the modelling steps
# --------------------------------------------------------------------------
MODEL_ID_COLUMNS = ("left_early", "user_id", "first_edit", "full_last_edit", "active_duration")
ENCODED_CATEGORIES = {"top_country": "top_country_encoded", "top_feature_type_name": "top_feature_type_encoded"}
SENTINEL_COLUMNS = (
    "pause_after_first_edit", "mean_days_between_edits_true", "pause_after_first_editing_day",
    "burstiness_score", "days_to_50", "days_to_100",
)
SENTINEL_VALUE = 9999
MEDIAN_COLUMNS = ("top_feature_ratio", "comment_length_ratio")
# `streetccomplete_...` is misspelt in the published list, so the real column stays in.
GROUPING_DROPPED = (
    "days_to_100", "active_week_ratio", "edits_per_span_day", "changesets_per_edit_day",
    "entropy_country_distribution", "max_country_edits", "social_facility_ratio",
    "body_of_water_ratio", "financial_service_ratio", "wash_facility_ratio", "place_ratio",
    "waterway_ratio", "activity_ratio_true", "josm_changeset_ratio",
    "streetccomplete_changeset_ratio", "user_id", "first_edit", "full_last_edit",
    "first_edit_year", "first_edit_month", "top_country", "top_feature_type_name", "left_early",
)
ZERO_FILLED = ("burstiness_score", "comment_length_ratio", "top_feature_ratio")
