"""Category codes, tag rules and class lists. All tables here are fixed values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

WEATHER_MAIN_CODE = {
    "Clear": 0, "Clouds": 1, "Rain": 2, "Drizzle": 3, "Thunderstorm": 4, "Snow": 5, "Mist": 6,
    "Fog": 7, "Haze": 8, "Smoke": 9, "Dust": 10, "Sand": 11, "Squall": 12, "Tornado": 13,
}
WEATHER_UNKNOWN_CODE = 15

WEATHER_KEEP = [
    "temp", "dew_point", "pressure", "humidity", "wind_speed", "wind_deg", "rain_1h", "snow_1h",
    "clouds_all", "weather_id", "weather_main",
]

WEATHER_ID_RANGES = [
    (200, 299, "雷暴"), (300, 399, "毛毛雨"), (500, 599, "雨"), (600, 699, "雪"),
    (700, 799, "雾/霾"), (800, 800, "晴"), (801, 899, "多云"),
]
WEATHER_ID_UNKNOWN = "未知"

POI_CLASSES = [
    "food", "shopping", "entertainment", "office", "residential", "education", "healthcare",
    "government", "tourism", "sports", "religious",
]

# class -> [(tag key, values)]; no values means any value of that key.
POI_RULES: dict[str, list[tuple[str, list[str]]]] = {
    "food": [
        ("amenity", ["restaurant", "cafe", "fast_food", "bar", "pub", "food_court", "ice_cream",
                     "biergarten"]),
        ("shop", ["bakery", "butcher", "deli", "seafood"]),
    ],
    "shopping": [
        ("shop", ["supermarket", "mall", "department_store", "clothes", "shoes", "electronics",
                  "furniture", "convenience", "hardware", "books", "florist", "jewelry", "gift",
                  "sports", "toy", "optician", "mobile_phone"]),
    ],
    "entertainment": [
        ("leisure", ["cinema", "theatre", "nightclub", "arcade", "amusement_arcade",
                     "escape_game", "bowling_alley"]),
        ("amenity", ["cinema", "theatre", "nightclub", "arts_centre", "community_centre",
                     "events_venue"]),
    ],
    "office": [
        ("office", []),
        ("amenity", ["bank", "atm", "bureau_de_change", "post_office", "coworking_space",
                     "conference_centre"]),
    ],
    "residential": [
        ("landuse", ["residential", "apartments"]),
        ("building", ["apartments", "residential", "house", "detached", "semidetached_house",
                      "terrace"]),
    ],
    "education": [
        ("amenity", ["school", "university", "college", "kindergarten", "language_school",
                     "library", "research_institute", "driving_school"]),
    ],
    "healthcare": [
        ("amenity", ["hospital", "clinic", "pharmacy", "dentist", "doctors", "veterinary",
                     "nursing_home", "social_facility"]),
    ],
    "government": [
        ("amenity", ["townhall", "courthouse", "police", "fire_station", "embassy",
                     "immigration", "prison", "public_bath"]),
        ("office", ["government", "administrative"]),
    ],
    "tourism": [("tourism", []), ("amenity", ["place_of_interest"])],
    "sports": [
        ("leisure", ["sports_centre", "stadium", "swimming_pool", "fitness_centre", "pitch",
                     "track", "gym"]),
        ("sport", []),
    ],
    "religious": [("amenity", ["place_of_worship"]), ("religion", [])],
}

ROAD_GROUPS = {
    "highway": ["motorway", "trunk", "primary", "secondary"],
    "local": ["tertiary", "unclassified", "residential"],
    "service": ["service"],
    "active": ["footway", "path", "cycleway", "pedestrian", "steps"],
}
ROAD_TYPES = [t for types in ROAD_GROUPS.values() for t in types]


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def weather_code(main: Column) -> Column:
    """Weather name to integer code, unknown or null to 15 (P-10)."""
    return F.coalesce(lookup(WEATHER_MAIN_CODE)[main], F.lit(WEATHER_UNKNOWN_CODE))


def weather_text(code: Column) -> Column:
    """Numeric weather id to its description (P-11)."""
    out = F.when(F.lit(False), "")
    for lo, hi, text in WEATHER_ID_RANGES:
        out = out.when(code.between(lo, hi), text)
    return out.otherwise(WEATHER_ID_UNKNOWN)


def tag_rules() -> dict[str, str]:
    """``key=value`` and ``key=*`` to class."""
    rules = {}
    for cls, parts in POI_RULES.items():
        for key, values in parts:
            for v in values or ["*"]:
                rules[f"{key}={v}"] = cls
    return rules


def poi_class(tags: Column) -> Column:
    """Class of a tag map (P-28): the first tag that matches decides, and for one tag
    the exact value goes before the any-value rule. One set test per class and tag."""
    by_class: dict[str, list[str]] = {}
    for tag, cls in tag_rules().items():
        by_class.setdefault(cls, []).append(tag)
    keys = sorted({tag.split("=")[0] for tag in tag_rules()})

    def classify(e: Column) -> Column:
        tag = F.concat(e["key"], F.lit("="), e["value"])
        out = F.when(F.lit(False), F.lit(""))
        for cls, listed in by_class.items():
            out = out.when(tag.isin([x for x in listed if not x.endswith("=*")]), cls)
        for x, cls in tag_rules().items():
            if x.endswith("=*"):
                out = out.when(e["key"] == x[:-2], cls)
        return out

    ruled = F.filter(F.map_entries(tags), lambda e: e["key"].isin(keys))
    return F.get(F.filter(F.transform(ruled, classify), lambda h: h.isNotNull()), F.lit(0))


def road_group(kind: Column) -> Column:
    return lookup({t: g for g, types in ROAD_GROUPS.items() for t in types})[kind]


def transit_class(tags: Column) -> Column:
    """Station before entrance before bus stop (P-30)."""
    return (
        F.when(tags["station"] == "subway", "subway_station")
        .when(tags["railway"] == "subway_entrance", "subway_entrance")
        .when(tags["highway"] == "bus_stop", "bus_stop")
    )


# Street furniture by tag key and value.
STREET_TAGS = {"crossing": ("highway", "crossing"), "signals": ("highway", "traffic_signals"), "bicycle_rental": ("amenity", "bicycle_rental")}


def street_class(tags: Column) -> Column:
    """Class of street furniture, null for other points."""
    return F.coalesce(*[F.when(tags[key] == value, F.lit(name)) for name, (key, value) in STREET_TAGS.items()])


def one_hot_code(flags: Column) -> Column:
    """Index of the set flag, null unless exactly one is set (P-41)."""
    total = F.aggregate(flags, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(total == 1, F.array_position(flags, F.lit(1)) - 1)
