"""Column expressions with the rules of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins of the affected share, open below and closed above.
SEVERE = 15.0
#: Classes of the settlement raster.
URBAN, RURAL, WATER, NO_CLASS = (21, 22, 23, 30), (11, 12, 13), (10,), 128


def cell_id(iso3: Column, number: Column) -> Column:
    """Country code and at least five digits; longer numbers are not cut."""
    return F.format_string("%s_%05d", iso3, number)


def cell_index(degrees: Column, start: float, step: float = 0.1) -> Column:
    """Index of the cell that holds a coordinate; edges belong to the cell above them."""
    return F.floor(F.round((degrees - start) / step, 9)).cast("int")


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


#: Fixed value: the radius of the sphere of web maps, in metres.
SPHERE = 6_378_137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres (EPSG:3857) of degrees (EPSG:4326)."""
    return F.radians(lon) * SPHERE, F.log(F.tan(F.radians(45 + lat / 2))) * SPHERE


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SPHERE), 2 * F.degrees(F.atan(F.exp(y / SPHERE))) - 90


def crosses_zero(low: Column, high: Column) -> Column:
    return (low < 0) & (high > 0)


def name_part(name: Column, suffix: str, part: int) -> Column:
    """A part of a file name between underscores, counted from 1, without its suffix."""
    return F.split_part(F.replace(name, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(part))


def year_of_storm(sid: Column) -> Column:
    """The year that a storm's key starts with."""
    return F.substring(sid, 1, 4).try_cast("int")


def named_storm(name: Column, sid: Column) -> Column:
    return F.concat(name, F.substring(sid, 1, 4))


def has_form(name: Column, prefix: str, suffix: str) -> Column:
    return name.startswith(prefix) & name.endswith(suffix)


def same_name(a: Column, b: Column) -> Column:
    """Whether two names are equal without regard to case and blanks around them."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def share(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0).cast("double"))


def category(value: Column) -> Column:
    """0 up to zero, 1 up to SEVERE, 2 above."""
    return F.when(value <= 0, 0).when(value <= SEVERE, 1).when(value > SEVERE, 2)


def day_of(year: Column, month: Column, day: Column) -> Column:
    """A date from parts; the day defaults to 1 and impossible dates are null."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), F.coalesce(day.cast("int"), F.lit(1)))
    return F.when(year.isNotNull() & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def tile_corner(name: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a tile from its file name, south and west negative; null where the name has another form."""
    pattern = r"^ID\d+_([NS])(\d+)_([EW])(\d+)_RP10"
    part = lambda k: F.regexp_extract(name, pattern, k)
    number = lambda k: part(k).try_cast("int")
    lat = F.when(part(1) == "S", -number(2)).otherwise(number(2))
    lon = F.when(part(3) == "W", -number(4)).otherwise(number(4))
    return lat, lon


def admin_units(text: Column) -> tuple[Column, Column]:
    """Level and codes of a reported list of units, written as a literal with single quotes.

    One first-level code makes the report first-level; a report without any code, or one that cannot be read, is national.
    """
    json = text
    for literal, same in (("None", "null"), ("True", "true"), ("False", "false")):  # where a value stands, not inside a string
        json = F.regexp_replace(json, rf":\s*{literal}\s*(?=[,}}])", f": {same}")
    read = F.from_json(json, "array<struct<adm1_code:string,adm2_code:string>>", {"allowSingleQuotes": "true"})
    number = lambda c: c.try_cast("double").try_cast("int")  # noqa: E731  # 12.0 is a code like 12
    units = F.transform(read, lambda u: F.struct(number(u["adm1_code"]).alias("adm1_code"), number(u["adm2_code"]).alias("adm2_code")))
    codes = lambda field: F.filter(F.transform(units, lambda u: u[field]), lambda c: c.isNotNull())
    first = codes("adm1_code")
    second = F.transform(F.filter(units, lambda u: u["adm1_code"].isNull() & u["adm2_code"].isNotNull()), lambda u: u["adm2_code"])
    level = F.when(F.size(first) > 0, "ADM1").when(F.size(second) > 0, "ADM2").otherwise("ADM0")
    none = F.array().cast("array<int>")
    return level, F.when(level == "ADM1", first).when(level == "ADM2", second).otherwise(none)


#: Tropical cyclone basins of UN regions.
BASINS: dict[str, str] = {
    "Caribbean": "North Atlantic",
    "Central America": "North Atlantic",
    "South America": "North Atlantic",
    "Northern America": "North Atlantic",
    "Australia and New Zealand": "Australian Region",
    "Southern Asia": "North Indian",
    "Eastern Asia": "Western Pacific",
    "South-eastern Asia": "Western Pacific",
    "Western Asia": "North Indian",
    "Eastern Africa": "South-West Indian",
    "Southern Africa": "South-West Indian",
    "Melanesia": "South Pacific",
    "Micronesia": "Western Pacific",
    "Polynesia": "South Pacific",
    "Southern Europe": "Europe",
}


def basin(region: Column, basins: dict[str, str] | None = None) -> Column:
    """The basin of a region; null for regions without one."""
    table = F.create_map(*(F.lit(x) for pair in (basins or BASINS).items() for x in pair))
    return F.try_element_at(table, region)
