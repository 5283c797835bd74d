"""Logbooks as files: sheets with units of choice, XML and JSON, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import offsets, units
from logweave.operators import running
from logweave.sources.shared import written

IMPERIAL = {"depth": ("ft", lambda c: c / units.METRES_PER_FOOT), "temp": ("F", lambda c: c * 9 / 5 + 32), "weight": ("lb", lambda c: c / units.KILOGRAMS_PER_POUND)}
METRIC = {"depth": ("m", lambda c: c), "temp": ("C", lambda c: c), "weight": ("kg", lambda c: c)}
#: Bytes of a dictionary of sites or mixes, its keys and some 64 for each entry, that are broadcast at the most.
BROADCAST_BYTES = 16 << 20


def four_places(c: Column) -> Column:
    """Rounded to four decimals, halves up."""
    return F.floor(c * 10_000 + 0.5) / 10_000


def sheet(dives: DataFrame, key: str, columns: dict[str, tuple[str, str | None]], imperial: bool = False) -> DataFrame:
    """One text column for each of columns: header to (column, kind of unit or None); numbers with four decimals at the most.

    Headers of a unit get it in brackets; null stays an empty cell. Sorted by the key within each file.
    """
    system = IMPERIAL if imperial else METRIC
    out = []
    for header, (column, kind) in columns.items():
        if kind is None:
            out.append(F.col(column).cast("string").alias(header))
        else:
            unit, convert = system[kind]
            out.append(F.regexp_replace(four_places(convert(F.col(column).cast("double"))).cast("decimal(18,4)").cast("string"), r"\.?0+$", "").alias(f"{header} ({unit})"))
    return dives.sortWithinPartitions(key).select(*out)


def logbook_sheet(dives: DataFrame, key: str, imperial: bool = False) -> DataFrame:
    """The columns of a logbook as a sheet that this library reads back: see the headers below.

    dives: dive_number, start_local, duration_s, max_depth_m, air_temp_c, water_temp_c, visibility_m, site (region, name, lat,
    lon), water_type, tags, gases (o2, he), gear, weight_kg, buddies, rating, notes. Times are the clock's, to the minute;
    durations whole minutes; the first gas is oxygen in percent; lists are parted by commas. Null is an empty cell.
    """
    system = IMPERIAL if imperial else METRIC
    number = lambda c: F.regexp_replace(four_places(c.cast("double")).cast("decimal(18,4)").cast("string"), r"\.?0++$", "")
    half_up = lambda c: F.floor(c.cast("double") + 0.5).cast("long").cast("string")
    site, gas = F.col("site"), F.get("gases", F.lit(0))
    measure = {"Max Depth": ("max_depth_m", "depth"), "Air Temperature": ("air_temp_c", "temp"), "Water Temperature": ("water_temp_c", "temp"), "Visibility": ("visibility_m", "depth"), "Weight": ("weight_kg", "weight")}
    shown = {}
    for header, (column, kind) in measure.items():
        unit, convert = system[kind]
        shown[header] = number(convert(F.col(column).cast("double"))).alias(f"{header} ({'lbs' if unit == 'lb' else unit})")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    cells = [
        text("dive_number").alias("Dive Number"), F.date_format("start_local", "yyyy-MM-dd").alias("Date"), F.date_format("start_local", "HH:mm").alias("Time In"), half_up(F.col("duration_s") / 60).alias("Duration (min)"),
        shown["Max Depth"], shown["Air Temperature"], shown["Water Temperature"], shown["Visibility"],
        text(site["region"]).alias("Location"), text(site["name"]).alias("Dive Site"), number_text(site["lat"]).alias("Latitude"), number_text(site["lon"]).alias("Longitude"),
        text("water_type").alias("Water Type"), F.array_join("tags", ", ").alias("Dive Type"), half_up(gas["o2"] * 100).alias("EAN %"), text("gear").alias("Equipment"), shown["Weight"],
        F.array_join("buddies", ", ").alias("Buddies"), number_text(F.col("rating").cast("double")).alias("Rating"), text("notes").alias("Notes"),
    ]
    return dives.sortWithinPartitions(key).select(*cells)


def write_sheet(rows: DataFrame, path: str) -> None:
    """CSV with a header in each part file; cells are quoted where they must be, quotes doubled."""
    rows.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)


def escaped(c: Column) -> Column:
    """Text for XML: & < > and both quotes as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def xml_dive(fields: dict[str, Column]) -> Column:
    """A dive element with one element for each field that is not null, in order."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), escaped(c.cast("string")), F.lit(f"</{name}>"))) for name, c in fields.items()]
    return F.concat(F.lit("<dive>"), F.array_join(F.array_compact(F.array(*parts)), ""), F.lit("</dive>"))


def dictionary(dives: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(first, columns...): the different combinations of columns without nulls, each named by the order value of its first use."""
    return dives.na.drop(subset=columns).groupBy(*columns).agg(F.min(order).alias("first")).select("first", *columns)


def number_text(c: Column) -> Column:
    """A number as people write it: no exponent, and no decimals where it is whole."""
    plain = F.when(F.abs(c).between(1e-3, 1e7 - 1), c.cast("double").cast("string")).otherwise(c.cast("decimal(38,15)").cast("string"))
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0++$", "")).otherwise(plain)


def _element(name: str, c: Column) -> Column:
    """An element with some content, null for null."""
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "")


def _within(name: str, *parts: Column) -> Column:
    """An element around its parts, null where all of them are null."""
    return F.when(F.coalesce(*parts).isNotNull(), _element(name, _joined(*parts)))


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def documents(dives: DataFrame, owner: str, order: list[str], made: str, most: int = running.MOST) -> DataFrame:
    """Each owner's logbook as the lines of one XML document: (owner as text, section, place, line).

    dives: owner, order, start_local (without zone), offset_minutes, site (name, lat, lon, altitude_m), gases (o2, he),
    max_depth_m, avg_depth_m, duration_s, water_temp_c, weight_kg, series (time_s, depth_m, temp_c). Sites that have a name
    are one by it, others by their place; sites and mixes get numbers by the first dive, in `order`, that has them, and dives
    refer to them. What is null is left out, a section without entries too. A null owner writes to `null`.
    """
    whose = F.coalesce(F.col(owner).cast("string"), F.lit("null")).alias("owner")
    site, gas = F.col("site"), F.get(F.col("gases"), 0)
    site_key = F.when(site["name"].isNotNull(), F.concat(F.lit("name:"), site["name"])).otherwise(F.concat(F.lit("geo:"), number_text(site["lat"]), F.lit(","), number_text(site["lon"])))
    mix_key = lambda g: F.concat(number_text(g["o2"]), F.lit(":"), number_text(F.coalesce(g["he"], F.lit(0.0))))
    rows = running.Ordered(dives.withColumns({"owner": whose, "_site_key": site_key, "_mix_key": mix_key(gas)}), "owner", order, most).add(_n=running.count()).rows()
    # numbered once: the dictionaries and the dives are all made from these rows
    rows = written(rows)

    def dictionary_of(entries: DataFrame, name: str) -> DataFrame:
        """(owner, key, value, id) of (owner, place, key, value): each different key once, numbered by its first place."""
        first = entries.groupBy("owner", "key").agg(F.min("place").alias("place"), F.min_by("value", "place").alias("value"))
        # written, as it is read four times: each reading would group all rows again
        return written(running.Ordered(first, "owner", ["place"], most).add(id=running.count()).rows().withColumn("id", F.concat(F.lit(f"{name}_"), F.col("id").cast("string"))))

    def looked_up(left: DataFrame, entries: DataFrame, name: str) -> DataFrame:
        """left with the ids of its keys; dives are not dealt by the few keys of a small dictionary."""
        size = entries.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
        ids = entries.select("owner", F.col("key").alias(f"_{name}_key"), F.col("id").alias(f"_{name}"))
        return left.join(F.broadcast(ids) if size <= BROADCAST_BYTES else ids, ["owner", f"_{name}_key"], "left")

    sites = dictionary_of(rows.where("_site_key is not null").select("owner", F.struct("_n", F.lit(0).alias("i")).alias("place"), F.col("_site_key").alias("key"), F.col("site").alias("value")), "site")
    each = rows.select("owner", "_n", F.posexplode("gases").alias("i", "g"))
    mixes = dictionary_of(each.select("owner", F.struct("_n", "i").alias("place"), mix_key(F.col("g")).alias("key"), F.col("g").alias("value")).where("key is not null"), "mix")

    v = F.col("value")
    place = _within("geography", *[_element(tag, number_text(v[c])) for tag, c in (("latitude", "lat"), ("longitude", "lon"), ("altitude", "altitude_m"))])
    site_line = F.concat(F.lit('<site id="'), F.col("id"), F.lit('">'), _joined(_element("name", escaped(F.coalesce(v["name"], F.col("id")))), place), F.lit("</site>"))
    label = F.when((v["o2"] == 0.21) & (F.coalesce(v["he"], F.lit(0.0)) == 0), "air").otherwise(F.concat(F.lit("ean"), F.floor(v["o2"] * 100 + 0.5).cast("string")))
    mix_line = F.concat(F.lit('<mix id="'), F.col("id"), F.lit('">'), _joined(_element("name", label), _element("o2", number_text(v["o2"])), _element("he", number_text(v["he"]))), F.lit("</mix>"))

    known = looked_up(looked_up(rows, sites, "site"), mixes, "mix")
    reference = lambda tag, c: F.concat(F.lit(f'<{tag} ref="'), c, F.lit('"/>'))
    stamp = F.concat(F.date_format("start_local", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.coalesce(offsets.formatted(F.col("offset_minutes")), F.lit("")))
    kelvin = lambda c: number_text(F.round(c + units.KELVIN_AT_ZERO_CELSIUS, 2))
    s = F.col("series")
    point = lambda t, i: _element(
        "waypoint",
        _joined(
            _element("divetime", number_text(t)),
            _element("depth", number_text(F.coalesce(F.get(s["depth_m"], i), F.lit(0.0)))),
            _element("temperature", kelvin(_known(F.get(s["temp_c"], i)))),
            F.when(i == 0, reference("switchmix", F.col("_mix"))),
        ),
    )
    samples = F.when(F.size(s["time_s"]) > 0, _element("samples", F.array_join(F.transform(s["time_s"], point), "\n")))
    after = _within(
        "informationafterdive", _element("lowesttemperature", kelvin(F.col("water_temp_c"))), _element("greatestdepth", number_text(F.col("max_depth_m"))), _element("averagedepth", number_text(F.col("avg_depth_m"))),
        _element("diveduration", number_text(F.col("duration_s"))), _element("equipmentused", _element("leadquantity", number_text(F.col("weight_kg")))),
    )
    body = F.array_join(F.array_compact(F.array(_within("informationbeforedive", reference("link", F.col("_site")), _element("datetime", stamp)), samples, after)), "\n")
    dive_line = F.concat(F.lit('<repetitiongroup><dive id="dive_'), F.col("_n").cast("string"), F.lit('">'), body, F.lit("</dive></repetitiongroup>"))

    # places within sections: entries of the dictionaries by their first use, dives by their number
    no_place = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"))
    line = lambda df, section, text, at=no_place: df.select("owner", F.lit(section).alias("section"), at.alias("place"), text.alias("line"))
    of = lambda c: F.struct(c["_n"].alias("n"), c["i"].cast("int").alias("i"))
    owners, with_sites, with_mixes = (df.select("owner").distinct() for df in (rows, sites, mixes))
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<uddf version="3.2.0" xmlns="http://www.streit.cc/uddf/3.2/">\n<generator><name>logweave</name><datetime>{made}</datetime></generator>')
    parts = [
        line(owners, 0, head),
        line(with_sites, 1, F.lit("<divesite>")), line(sites, 2, site_line, of(F.col("place"))), line(with_sites, 3, F.lit("</divesite>")),
        line(with_mixes, 4, F.lit("<gasdefinitions>")), line(mixes, 5, mix_line, of(F.col("place"))), line(with_mixes, 6, F.lit("</gasdefinitions>")),
        line(owners, 7, F.lit("<profiledata>")), line(known, 8, dive_line, F.struct(F.col("_n").alias("n"), F.lit(0).alias("i"))), line(owners, 9, F.lit("</profiledata>\n</uddf>")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_documents(lines: DataFrame, path: str) -> None:
    """Writes documents() as one file for each owner, owner=.../part-*.txt.

    Lines are sorted by Spark, on disk if need be, and written one by one: no document is held in memory.
    """
    # dealt by a hash of their own: lines whose parts were dealt by owner already are not dealt by it again, and what such parts
    # are combined to while running can have an owner in several tasks
    one_file = lines.repartition(F.xxhash64("owner")).sortWithinPartitions("owner", "section", "place")
    one_file.select("owner", "line").write.partitionBy("owner").option("maxRecordsPerFile", 0).text(path)


def json_dive(columns: list[str]) -> Column:
    """A row as JSON; what is null is left out."""
    return F.to_json(F.struct(*columns))


def json_logbooks(dives: DataFrame, owner: str, order: list[str], columns: list[str], form: str, most: int = running.MOST) -> DataFrame:
    """Each owner's logbook as the lines of one JSON document (owner as text, section, place, line), see write_documents().

    columns: what is written of each dive, under these names; what is null is left out.
    """
    whose = F.coalesce(F.col(owner).cast("string"), F.lit("null"))
    rows = running.Ordered(dives.withColumn("owner", whose), "owner", order, most).add(_n=running.count()).rows()
    owners = rows.select("owner").distinct()
    line = lambda df, section, place, text: df.select("owner", F.lit(section).alias("section"), place.cast("long").alias("place"), text.alias("line"))
    comma = F.when(F.col("_n") > 1, ",").otherwise("")
    parts = line(owners, 0, F.lit(0), F.lit(f'{{"format": "{form}", "dives": ['))
    return parts.unionByName(line(rows, 1, F.col("_n"), F.concat(comma, json_dive(columns)))).unionByName(line(owners, 2, F.lit(0), F.lit("]}")))


def profile_key(record: Column, blob: Column) -> Column:
    """The name under which a profile is stored: its record and the first 32 digits of its content's sha256, so equal content
    is stored once; null for no content."""
    return F.concat(F.lit("profiles/"), record.cast("string"), F.lit("/"), F.substring(F.sha2(blob, 256), 1, 32))
