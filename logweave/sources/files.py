"""Log files as tables: what a file is, delimited sheets, XML logs and JSON logs, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import once
from logweave.operators import running
from logweave.sources.pieces import JsonScanner, elements
from logweave.sources.shared import written

DELIMITERS = [",", "\t", ";", "|"]
XML_LOG = (
    "id string, datetime string, greatestdepth double, diveduration double, "
    "link array<struct<_ref:string>>, leadquantity double, notes string, "
    "waypoint array<struct<divetime:double,depth:double,temperature:double>>"
)


def sniffed(name: Column, content: Column, form: str = "logbook") -> Column:
    """What kind of log a file is by its first 4,096 characters, and only then by its name: zip, uddf, subsurface, json (one
    that declares a format beginning with `form`), csv (a first line with two separators or more, of any kinds) or unknown.

    Nothing known of the content: by the name's ending alone; only .xlsx, .uddf and .xml say something by themselves.
    """
    head = F.coalesce(F.substring(content, 1, 4096), F.lit(""))
    line = F.regexp_extract(head, r"^[^\r\n]*+", 0)
    separators = F.length(line) - F.length(F.translate(line, "".join(DELIMITERS), ""))
    extension = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    return (
        F.when(F.startswith(head, F.lit("PK\x03\x04")), "zip")
        .when(head.rlike(r"(?i)<uddf[\s>]"), "uddf")
        .when(head.rlike(r"(?i)<divelog[\s>]") & F.contains(F.lower(head), F.lit("subsurface")), "subsurface")
        .when(head.rlike(rf'"format"\s*:\s*"{form}'), "json")
        .when((separators >= 2) & ~F.startswith(F.ltrim(line), F.lit("<")), "csv")
        .when(extension == "xlsx", "zip")
        .when(extension.isin("uddf", "xml"), "uddf")
        .otherwise("unknown")
    )


def delimiter(line: str) -> str:
    """The delimiter that cuts a header line into the most fields, quoted ones left whole; the first of equal ones."""
    outside = "".join(part for k, part in enumerate(line.split('"')) if k % 2 == 0)
    return max(DELIMITERS, key=lambda d: (outside.count(d), -DELIMITERS.index(d)))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Sheets with a header line as text columns: quoted fields may hold separators, line ends and doubled quotes.

    Headers are trimmed and lose a byte order mark; rows without any value are left out; missing cells are null. What does
    not fit the header stays in column _ragged, null for sound rows. An empty file has no columns.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "_ragged string")
    line = first[0].value.lstrip("﻿")
    separator = separator or delimiter(line)
    options = {"sep": separator, "header": True, "multiLine": True, "escape": '"', "quote": '"'}
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in [*names, "_ragged"])
    df = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_ragged", enforceSchema=True).schema(schema).csv(path)
    df = df.toDF(*[n.lstrip("﻿").strip() for n in names], "_ragged")
    blank = F.lit(True)
    for n in df.columns[:-1]:
        blank = blank & (F.coalesce(F.trim(f"`{n}`"), F.lit("")) == "")
    return df.where(~blank)


def parse_xml_log(text: Column) -> Column:
    """One dive element of an XML log as a struct (XML_LOG); null where it cannot be read."""
    return F.from_xml(text, XML_LOG, {"mode": "PERMISSIVE"})


def read_xml_log(spark: SparkSession, path: str, row: str = "dive") -> DataFrame:
    """Dives of XML logs, one row for each element."""
    return spark.read.option("rowTag", row).schema(XML_LOG).xml(path)


def waypoints_series(points: Column) -> Column:
    """(time_s, depth_m, temp_c) arrays of waypoints: those without time or depth are left out; a temperature holds until the
    next one and the first one also before it; no temperature at all gives a null array."""

    def series(sound: Column) -> Column:
        known = F.filter(F.transform(sound, lambda p, i: F.struct(i.alias("i"), p["temperature"].alias("t"))), lambda x: x["t"].isNotNull())
        # each known value as often as it holds, so that no array is built up value by value
        stretch = lambda known: lambda x, k: F.array_repeat(x["t"], F.coalesce(F.get(known, k + 1)["i"], F.size(sound)) - x["i"])
        temps = once(known, lambda known: F.when(F.size(known) > 0, F.concat(F.array_repeat(F.get(known, 0)["t"], F.get(known, 0)["i"]), F.flatten(F.transform(known, stretch(known))))))
        return F.struct(F.transform(sound, lambda p: p["divetime"]).alias("time_s"), F.transform(sound, lambda p: p["depth"]).alias("depth_m"), temps.alias("temp_c"))

    return once(F.filter(points, lambda p: p["divetime"].isNotNull() & p["depth"].isNotNull()), series)


def dives_of_xml(dives: DataFrame, sites: DataFrame, mixes: DataFrame) -> DataFrame:
    """(id, start_local, offset_minutes, max_depth_m, duration_s, site_id, o2, lead_kg, n_points) of read dives.

    Links are looked up among sites (id) and mixes (id, o2), the first hit of each; unknown references are dropped. A lead
    weight of 0, which such files write for none, is null.
    """
    from logweave.functions.parsing import wall_clock

    when = wall_clock(F.col("datetime"))
    refs = dives.select("id", F.posexplode(F.array_distinct(F.transform("link", lambda x: x["_ref"]))).alias("at", "ref"))
    site = refs.join(sites.select(F.col("id").alias("ref")).distinct(), "ref").groupBy("id").agg(F.min_by("ref", "at").alias("site_id"))
    gas = refs.join(mixes.select(F.col("id").alias("ref"), "o2").dropDuplicates(["ref"]), "ref").groupBy("id").agg(F.min_by("o2", "at").alias("o2"))
    own = dives.select("id", when["local"].alias("start_local"), when["offset_minutes"].alias("offset_minutes"), F.col("greatestdepth").alias("max_depth_m"), F.col("diveduration").alias("duration_s"), F.when(F.col("leadquantity") != 0, F.col("leadquantity")).alias("lead_kg"), F.size(F.coalesce("waypoint", F.array().cast("array<struct<divetime:double,depth:double,temperature:double>>"))).cast("long").alias("n_points"))
    return own.join(site, "id", "left").join(gas, "id", "left")


def parse_json_log(text: Column, schema: str, form: str) -> Column:
    """A JSON log entry as a struct of a schema with field format; null where its format is another one or it is no JSON."""
    found = F.from_json(text, schema)
    return F.when(found["format"] == form, found)


#: What a JSON logbook holds of each dive; other members are passed over.
JSON_DIVE = (
    "struct<ref:string,diveNumber:long,startTimeLocal:string,startTimeUtc:string,tzOffsetMinutes:int,durationS:double,maxDepthM:double,avgDepthM:double,waterTempMinC:double,airTempC:double,"
    "visibilityM:double,weightKg:double,waterType:string,rating:double,notes:string,site:struct<name:string,lat:double,lon:double,altitudeM:double,regionHint:string>,tags:array<string>,buddies:array<string>,"
    "gases:array<struct<o2Fraction:double,heFraction:double>>,gear:string,sources:array<struct<sourceKind:string,sourceRef:string,recordedAt:string>>>"
)


def read_json_logbooks(spark: SparkSession, path: str, form: str) -> tuple[DataFrame, DataFrame]:
    """(files, dives) of JSON logbooks, each one document: files (file, code), dives (file, at, source_ref, dive).

    Codes: unparseable_json, not_logbook (another format, or none); null for a sound file, also one without dives. A dive's
    own id is its source_ref, else the first id that one of its sources has. Spark passes over files of no bytes. A file is
    gone through dive by dive and never held.
    """
    found = written(elements(spark, path, "}", lambda: JsonScanner("dives")))
    text = F.col("text")
    # of what is left of a document without its dives, and of each dive by itself
    rest = found.where("kind = 'file'").select("file", F.try_parse_json(text).isNotNull().alias("sound"), F.from_json(text, "format string")["format"].alias("format"))
    entries = found.where("kind = 'entry'")
    broken = entries.where(F.try_parse_json(text).isNull()).select("file").distinct().withColumn("broken", F.lit(True))
    code = F.when(~F.col("sound") | F.col("broken").isNotNull(), "unparseable_json").when(~F.col("format").eqNullSafe(F.lit(form)), "not_logbook")
    held = written(rest.join(broken, "file", "left").select("file", code.alias("code")))
    dives = entries.where(F.startswith(text, F.lit("{"))).join(held.where("code is null").select("file"), "file", "left_semi")
    dives = dives.select("file", F.col("at").cast("int").alias("at"), F.from_json(text, JSON_DIVE).alias("dive"))
    refs = F.transform("dive.sources", lambda s: s["sourceRef"])
    first = F.get(F.filter(refs, lambda r: r.isNotNull()), F.lit(0))
    return held, dives.select("file", "at", F.coalesce("dive.ref", first).alias("source_ref"), "dive")


def first_uploads(files: DataFrame, most: int = running.MOST) -> DataFrame:
    """(owner, batch, duplicate_of) of files (owner, batch, at, content, failed): the newest earlier batch of the owner with the
    same content that has not failed, of several at one time the largest, null if there is none
    or the file has no time.

    One value runs along the times of equal files, so they are never joined with each other.
    """
    named = files.select("owner", "batch", "at", F.when(~F.col("failed") & F.col("at").isNotNull(), F.col("batch")).alias("sound"), F.struct("owner", F.sha2("content", 256).alias("sum")).alias("file"))
    times = named.groupBy("file", "at").agg(F.max("sound").alias("sound"))
    before = running.Ordered(times, "file", ["at"], most).add(duplicate_of=running.last(F.col("sound"), False)).rows()
    same = F.col("n.file").eqNullSafe(F.col("b.file")) & F.col("n.at").eqNullSafe(F.col("b.at"))
    found = named.alias("n").join(before.alias("b"), same, "left")
    return found.select("n.owner", "n.batch", F.when(F.col("n.at").isNotNull() & F.col("n.file.sum").isNotNull(), F.col("b.duplicate_of")).alias("duplicate_of"))


def together(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several imports as one table with column import; columns that one of them lacks are null there."""
    found = None
    for name, rows in parts.items():
        one = rows.withColumn("import", F.lit(name))
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if found is None:
        raise ValueError("at least one import is needed")
    return found
