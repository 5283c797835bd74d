"""Places that observations name or locate: found among an owner's sites, or made, one row after the other.

What a row finds depends on the rows before it: a row may make a site, give it coordinates, give an unnamed one its name, or
add a spelling, and the next row sees that. So an owner's rows are read in their order by one task. They are never held:
Spark sorts them, on disk if need be, and a task keeps only the sites of the owner it is at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.geo import EARTH_M
from logweave.operators.linking import NAME_ONLY, NEARBY_M, NEARBY_NAME, SAME_M
from logweave.sources.shared import written

#: Fixed value: what a site is called until a source names it.
UNNAMED = "Unnamed site"
_PLACED = pa.schema([("owner", pa.string()), ("row", pa.int64()), ("site_id", pa.string()), ("rule", pa.string()), ("name", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("aliases", pa.list_(pa.string()))])


@lru_cache(100_000)
def plain(name: str) -> str:
    """The slug of a name, as functions.text.slug() has it."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not 0x300 <= ord(c) <= 0x36F).lower()
    return re.sub("[^a-z0-9]+", "-", bare).strip("-")


@lru_cache(100_000)
def alike(x: str, y: str) -> float:
    """The similarity of two slugs, as functions.text.name_similarity() has it."""
    if not x or not y or x == y:
        return float(bool(x) and x == y)
    longest = max(len(x), len(y))
    if x in y or y in x:
        return 0.8 + 0.15 * (min(len(x), len(y)) / longest)
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return 1 - row[-1] / longest


def sound(lat: float | None, lon: float | None) -> bool:
    return lat is not None and lon is not None and -90 <= lat <= 90 and -180 <= lon <= 180 and (lat, lon) != (0, 0)


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half = lambda d: math.sin(math.radians(d) / 2) ** 2
    h = half(lat2 - lat1) + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


class Sites:
    """One owner's sites, in the order in which they came to be."""

    def __init__(self):
        self.all: list[dict] = []
        #: What a row's place led to while nothing has changed since.
        self.found: dict[tuple, tuple[dict, str] | None] = {}

    def add(self, key: str, name: str, lat: float | None, lon: float | None, aliases: list[str]) -> dict:
        self.all.append({"site_id": key, "name": name, "lat": lat, "lon": lon, "aliases": aliases})
        self.found.clear()
        return self.all[-1]

    def match(self, name: str | None, lat: float | None, lon: float | None) -> tuple[dict, str] | None:
        """The site that a place is, and by which rule (see linking.site_matches())."""
        slug = None if name is None else plain(name)
        if sound(lat, lon):
            near = [(metres(lat, lon, s["lat"], s["lon"]), s) for s in self.all if sound(s["lat"], s["lon"])]
            near.sort(key=lambda x: x[0])
            if near and near[0][0] <= SAME_M:
                return near[0][1], "coordinates"
            for m, s in near:
                if slug is not None and m <= NEARBY_M and alike(slug, plain(s["name"])) > NEARBY_NAME:
                    return s, "coordinates-and-name"
        if slug is None:
            return None
        best = max(self.all, key=lambda s: alike(slug, plain(s["name"])), default=None)
        if best is not None and alike(slug, plain(best["name"])) >= NAME_ONLY:
            return best, "name"
        other = next((s for s in self.all if any(plain(a) == slug for a in s["aliases"])), None)
        return None if other is None else (other, "alias")

    def resolve(self, key: str, name: str | None, lat: float | None, lon: float | None) -> tuple[str | None, str | None]:
        """(site_id, rule) of one row, and what the row changes; rule `made` for a new site."""
        if name is None and lat is None:
            return None, None
        place = (name, lat, lon)
        if place not in self.found:
            self.found[place] = self.match(name, lat, lon)
        hit = self.found[place]
        if hit is None:
            return self.add(key, UNNAMED if name is None else name, lat, lon, [])["site_id"], "made"
        site, rule = hit
        changed = False
        if sound(lat, lon) and not sound(site["lat"], site["lon"]):
            site["lat"], site["lon"], changed = lat, lon, True
        if name is not None and site["name"] == UNNAMED:
            site["name"], changed = name, True
        if name is not None and plain(name) != plain(site["name"]) and name not in site["aliases"]:
            site["aliases"], changed = [*site["aliases"], name], True
        if changed:
            self.found.clear()
        return site["site_id"], rule


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites (row null) and then rows of each owner to rows with their site, and to the owner's sites after the last row."""
    whose, sites = None, Sites()
    after = lambda: [{"owner": whose, "row": None, "rule": None} | s for s in sites.all]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["owner"] != whose:
                out += after()
                whose, sites = r["owner"], Sites()
            if r["row"] is None:
                sites.add(r["site_id"], UNNAMED if r["name"] is None else r["name"], r["lat"], r["lon"], r["aliases"] or [])
            else:
                site, rule = sites.resolve(f"{whose}/{r['row']}", r["name"], r["lat"], r["lon"])
                out.append({"owner": whose, "row": r["row"], "site_id": site, "rule": rule, "name": None, "lat": None, "lon": None, "aliases": None})
        yield pa.RecordBatch.from_pylist(out, _PLACED)
    yield pa.RecordBatch.from_pylist(after(), _PLACED)


def resolved_places(observed: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sites) after a batch: rows (owner, row, site_id, rule) of every observation, and the owners' sites (owner,
    site_id, name, lat, lon, aliases) as the batch leaves them.

    observed: (owner, row, name, lat, lon), in the order of row; sites: (owner, site_id, name, lat, lon, aliases), in the
    order of site_id. A row finds a site by the rules of linking.site_matches() or makes one, named `owner/row`; one
    without a name is called UNNAMED until a row names it, once. The first valid coordinates stay; a name with another slug
    becomes an alias. Rows without name and latitude have no site. Owners and site ids come out as text, null owners as null.
    """
    own = F.col("owner").cast("string").alias("owner")
    known = sites.select(own, F.lit(None).cast("long").alias("row"), F.col("site_id").cast("string").alias("site_id"), "name", "lat", "lon", "aliases", F.struct(F.lit(0).alias("k"), "site_id").alias("first"), F.lit(None).cast("long").alias("then"))
    rows = observed.select(own, F.col("row").cast("long").alias("row"), F.lit(None).cast("string").alias("site_id"), "name", "lat", "lon", F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast(known.schema["first"].dataType).alias("first"), F.col("row").cast("long").alias("then"))
    # sites have no `then` and sort before rows, among each other by their own id
    order = [F.col("then").asc_nulls_first(), "first"]
    sorted_ = known.unionByName(rows).repartition("owner").sortWithinPartitions("owner", *order)
    found = written(sorted_.drop("first", "then").mapInArrow(_fold, "owner string, row long, site_id string, rule string, name string, lat double, lon double, aliases array<string>"))
    return found.where("row is not null").select("owner", "row", "site_id", "rule"), found.where("row is null").select("owner", "site_id", "name", "lat", "lon", "aliases")
