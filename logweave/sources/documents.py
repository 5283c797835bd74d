"""Whole logbook documents in XML: sites, gas mixes, tanks and dives of one file, which refer to one another by its own ids.

A file is gone through once, element by element; sites, mixes, tanks and dives are rows of their own, each parsed by itself,
and what a dive refers to is joined to it by file and id: ids mean something within their file only. Tanks stand anywhere in
the tree; they are read by their tag, at any depth.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import offsets, units
from logweave.functions.parsing import wall_clock
from logweave.functions.text import clean_number, once
from logweave.operators.sheets import ISSUES, checked, issue, no_sentinel, opaque_name
from logweave.sources.files import waypoints_series
from logweave.sources.pieces import XmlScanner, elements
from logweave.sources.shared import written

_LINK = "link:array<struct<_ref:string>>"
_SITE = "struct<_id:string,name:string,geography:struct<latitude:string,longitude:string,altitude:string>>"
_MIX = "struct<_id:string,name:string,o2:string,he:string>"
_POINT = "struct<divetime:string,depth:string,temperature:string,switchmix:array<struct<_ref:string>>>"
_BEFORE = f"struct<{_LINK},datetime:string>"
_AFTER = "struct<greatestdepth:string,averagedepth:string,diveduration:string,lowesttemperature:string,equipmentused:struct<leadquantity:string>>"
_DIVE = f"struct<_id:string,informationbeforedive:{_BEFORE},tankdata:array<struct<{_LINK}>>,samples:struct<waypoint:array<{_POINT}>>,informationafterdive:{_AFTER}>"
_TANK = f"struct<_id:string,{_LINK}>"
#: The elements of a document that are parsed, by their path. All values are text: what a file wrote is told from what it did
#: not, and numbers are cleaned here.
PATHS = {"uddf/divesite/site": "site", "uddf/gasdefinitions/mix": "mix", "uddf/profiledata/repetitiongroup/dive": "dive"}


class Documents(NamedTuple):
    """files (file, code: what is wrong with the file as a whole, or null), and (file, ...) tables of what sound files hold."""

    files: DataFrame
    sites: DataFrame
    mixes: DataFrame
    tanks: DataFrame
    dives: DataFrame


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _site(s: Column) -> list[Column]:
    """Columns of a site: opaque names are none, altitudes out of range neither."""
    height = clean_number(s["geography"]["altitude"])
    return [
        _text(s["_id"]).alias("id"),
        opaque_name(_text(s["name"]), _text(s["_id"])).alias("name"),
        clean_number(s["geography"]["latitude"]).alias("lat"),
        clean_number(s["geography"]["longitude"]).alias("lon"),
        F.when(height.between(-50, 6000), height).alias("altitude_m"),
    ]


def _mix(m: Column) -> list[Column]:
    """Columns of a mix, without an id for one that has no oxygen share; helium of 0 is none."""
    o2, he = clean_number(m["o2"]), clean_number(m["he"])
    return [F.when(o2.isNotNull(), _text(m["_id"])).alias("id"), o2.alias("o2"), F.when(he != 0, he).alias("he"), _text(m["name"]).alias("label")]


def _first_ref(links: Column) -> Column:
    return _text(F.get(links, 0)["_ref"])


def _gas_refs(dive: Column) -> Column:
    """What a dive's tanks link to or are filled with (tank), and its waypoints switch to, in this order, each once."""
    ref = lambda tank: lambda links: F.struct(F.lit(tank).alias("tank"), _first_ref(links).alias("ref"))
    own = F.transform(_list(dive["tankdata"], f"struct<{_LINK}>"), lambda t: ref(True)(t["link"]))
    switched = F.transform(_list(dive["samples"]["waypoint"], _POINT), lambda p: ref(False)(p["switchmix"]))
    return F.array_distinct(F.filter(F.concat(own, switched), lambda r: r["ref"].isNotNull()))


def _series(dive: Column) -> Column:
    """The waypoints that have a time and a depth, as a series; null without any."""
    points = F.transform(_list(dive["samples"]["waypoint"], _POINT), lambda p: F.struct(clean_number(p["divetime"]).alias("divetime"), clean_number(p["depth"]).alias("depth"), units.kelvin_to_celsius(clean_number(p["temperature"])).alias("temperature")))
    return once(waypoints_series(points), lambda s: F.when(F.size(s["time_s"]) > 0, s))


def _referred(dives: DataFrame, sites: DataFrame, mixes: DataFrame, tanks: DataFrame) -> DataFrame:
    """(file, at, site, gases) of dives (file, at, links, refs) that have any: the first site that a link names, and the mixes that
    tanks hold, by way of their own links, and waypoints switch to; ids that name nothing are dropped."""
    whole = lambda df, name: df.select("file", F.col("id").alias("ref"), F.struct("id", *df.columns[2:]).alias(name))
    named = dives.select("file", "at", F.posexplode("links").alias("pos", "ref")).join(whole(sites, "site"), ["file", "ref"])
    held = dives.select("file", "at", F.posexplode("refs").alias("pos", "r")).select("file", "at", "pos", "r.tank", F.col("r.ref").alias("ref"))
    filled = tanks.select("file", F.col("id").alias("ref"), "mix", F.lit(True).alias("tank"))
    held = held.join(filled, ["file", "ref", "tank"], "left").select("file", "at", "pos", F.coalesce("mix", "ref").alias("ref")).join(whole(mixes, "mix"), ["file", "ref"])
    both = named.select("file", "at", "pos", "site").unionByName(held.select("file", "at", "pos", "mix"), allowMissingColumns=True)
    mix = F.when(F.col("mix").isNotNull(), F.struct("pos", "mix"))
    found = both.groupBy("file", "at").agg(F.min_by("site", F.when(F.col("site").isNotNull(), F.col("pos"))).alias("site"), F.array_sort(F.collect_list(mix)).alias("gases"))
    return found.withColumn("gases", F.array_distinct(F.transform("gases", lambda g: g["mix"])))


def read_documents(spark: SparkSession, path: str) -> Documents:
    """The documents under a path as tables; every table has `file`, which is part of each key.

    Codes of files: unparseable_xml (also a file that ends early), not_uddf (another root, or none), no_dives. A damaged file
    has no rows but in files. Ids that are missing or empty name nothing; of equal ids in a file the last one counts. Spark
    passes over files of no bytes. A file is gone through by one task, which holds one of its elements at a time.
    """
    found = written(elements(spark, path, ">", lambda: XmlScanner(PATHS, ("tankdata",))))
    root = F.col("text")
    with_dives = found.where("kind = 'dive'").select("file").distinct().withColumn("dived", F.lit(True))
    code = F.when(root.isNull(), "unparseable_xml").when(root != "uddf", "not_uddf").when(F.col("dived").isNull(), "no_dives")
    files = written(found.where("kind = 'file'").join(with_dives, "file", "left").select("file", code.alias("code")))
    sound = files.where("code is null or code = 'no_dives'").select("file")
    parsed = lambda kind, schema: found.where(F.col("kind") == kind).join(sound, "file", "left_semi").select("file", "at", F.from_xml("text", schema, {"mode": "PERMISSIVE"}).alias("x"))
    x = F.col("x")

    def last(rows: DataFrame) -> DataFrame:
        """(file, id, ...) of rows (file, at, id, ...), written small, so that joins know their size."""
        rest = F.struct(*rows.columns[3:])
        return written(rows.where("id is not null").groupBy("file", "id").agg(F.max_by(rest, "at").alias("v")).select("file", "id", "v.*"))

    sites = last(parsed("site", _SITE).select("file", "at", *_site(x)))
    mixes = last(parsed("mix", _MIX).select("file", "at", *_mix(x)))
    tanks = last(parsed("tankdata", _TANK).select("file", "at", _text(x["_id"]).alias("id"), _first_ref(x["link"]).alias("mix")).where("mix is not null"))
    before, after = x["informationbeforedive"], x["informationafterdive"]
    # written once: what they refer to is found apart from them
    dives = written(parsed("dive", _DIVE).select(
        "file", F.col("at").cast("int").alias("at"), _text(x["_id"]).alias("source_ref"), _text(before["datetime"]).alias("written_time"),
        F.transform(_list(before["link"], "struct<_ref:string>"), lambda l: _text(l["_ref"])).alias("links"), _gas_refs(x).alias("refs"),
        clean_number(after["greatestdepth"]).alias("max_depth_m"), clean_number(after["averagedepth"]).alias("avg_depth_m"), clean_number(after["diveduration"]).alias("duration_s"),
        units.kelvin_to_celsius(clean_number(after["lowesttemperature"])).alias("water_temp_c"), clean_number(after["equipmentused"]["leadquantity"]).alias("weight_kg"), _series(x).alias("series"),
    ))
    whole = dives.join(_referred(dives, sites, mixes, tanks), ["file", "at"], "left")
    no_gas = F.array().cast(f"array<{mix_type(mixes)}>")
    whole = whole.select("file", "at", "source_ref", "written_time", "site", F.coalesce("gases", no_gas).alias("gases"), "max_depth_m", "avg_depth_m", "duration_s", "water_temp_c", "weight_kg", "series")
    return Documents(files, sites, mixes, tanks, whole)


def mix_type(mixes: DataFrame) -> str:
    return mixes.select(F.struct("id", *mixes.columns[2:]).alias("m")).schema["m"].dataType.simpleString()


def dive_observations(documents: Documents) -> DataFrame:
    """The dives of read documents as observations: (file, at, source_ref, start_local, offset_minutes, start_utc,
    offset_suspect, site, gases, measurements, series, issues).

    A start that is missing or cannot be read is an error; offsets under an hour that no zone has are marked; a lead weight
    of 0, which such files write for none, and values out of range are dropped, each with an issue.
    """
    dives = documents.dives
    when = wall_clock(F.col("written_time"))
    rows = dives.withColumn("when", when)
    local, minutes = F.col("when.local"), F.col("when.offset_minutes")
    rows = rows.select(
        "file", "at", "source_ref", local.alias("start_local"), minutes.alias("offset_minutes"), (local - F.make_dt_interval(mins=minutes)).alias("start_utc"), offsets.suspect(minutes).alias("offset_suspect"),
        "site", "gases", "max_depth_m", "avg_depth_m", "duration_s", "water_temp_c", "weight_kg", "series",
        F.array_compact(F.array(issue(local.isNull(), "unreadable_datetime", "start_local", "error"))).cast(ISSUES).alias("issues"),
    )
    return checked(no_sentinel(rows, "weight_kg", 0.0), ["max_depth_m", "avg_depth_m", "duration_s", "water_temp_c", "weight_kg"])
