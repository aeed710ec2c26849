"""Column -> Column helpers (inventory H1-H17). All of them are built-in Spark expressions, so they stay inside
whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Closed value sets of the data model.
URL_STATUSES = ["pending", "submitted", "validated", "error", "duplicate", "not relevant", "404 not found",
                "individual record"]
COLLECTOR_STRATEGIES = ["example", "auto_googler", "common_crawler", "muckrock_simple_search",
                        "muckrock_county_search", "muckrock_all_search", "ckan", "manual"]
BATCH_STATUSES = ["ready to label", "in-process", "error", "aborted"]
SUGGESTED_STATUSES = ["relevant", "not relevant", "individual record", "broken page/404 not found"]
SUGGESTION_TYPES = ["Auto Suggestion", "User Suggestion", "Unknown", "New Agency", "Confirmed"]
HTML_CONTENT_TYPES = ["Title", "Description", "H1", "H2", "H3", "H4", "H5", "H6", "Div"]
TASK_TYPES = ["HTML", "Relevancy", "Record Type", "Agency Identification", "Misc Metadata",
              "Submit Approved URLs", "Duplicate Detection", "Idle", "404 Probe", "Sync Agencies"]
REJECTION_REASONS = ["not relevant", "broken page/404 not found", "individual record"]
RECORD_TYPES = [
    "Accident Reports", "Arrest Records", "Calls for Service", "Car GPS", "Citations", "Dispatch Logs",
    "Dispatch Recordings", "Field Contacts", "Incident Reports", "Misc Police Activity", "Officer Involved Shootings",
    "Stops", "Surveys", "Use of Force Reports", "Vehicle Pursuits", "Complaints & Misconduct",
    "Daily Activity Logs", "Training & Hiring Info", "Personnel Records", "Annual & Monthly Reports",
    "Budgets & Finances", "Contact Info & Agency Meta", "Geographic", "List of Data Sources", "Policies & Contracts",
    "Crime Maps & Reports", "Crime Statistics", "Media Bulletins", "Records Request Info", "Resources",
    "Sex Offender Registry", "Wanted Persons", "Booking Reports", "Court Cases", "Incarceration Records", "Other",
]
# Catalogue-portal record formats: the known types, and the aliases folded onto them.
CKAN_DATA_TYPES = ["CSV", "PDF", "XLS", "XML", "JSON", "Other", "RDF", "GIS / Shapefile", "HTML text",
                   "DOC / TXT", "Video / Image"]
CKAN_TYPE_CONVERSION_MAPPING = {
    "XLSX": "XLS", "Microsoft Excel": "XLS", "KML": "GIS / Shapefile", "GeoJSON": "GIS / Shapefile",
    "application/vnd.geo+json": "GIS / Shapefile", "ArcGIS GeoServices REST API": "GIS / Shapefile",
    "Esri REST": "GIS / Shapefile", "SHP": "GIS / Shapefile", "OGC WMS": "GIS / Shapefile",
    "QGIS": "GIS / Shapefile", "gml": "GIS / Shapefile", "WFS": "GIS / Shapefile", "WMS": "GIS / Shapefile",
    "API": "GIS / Shapefile", "HTML": "HTML text", "HTML page": "HTML text", "": "HTML text",
    "TEXT": "DOC / TXT", "JPEG": "Video / Image", "Api": "JSON", "CSV downloads": "CSV", "csv file": "CSV",
}
PLACEHOLDER_AGENCY_NAME = "PLACEHOLDER_AGENCY_NAME"
PAGE_SIZE = 100
# ---------------------------------------------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


KEY_BUCKETS = 4096  # buckets of natural keys; a surrogate key ends in its bucket's number


def key_bucket(key: Column | str, buckets: int = KEY_BUCKETS) -> Column:
    """Bucket of a natural key, from its hash; ``buckets`` divides ``KEY_BUCKETS``."""
    return F.pmod(F.xxhash64(_c(key)), F.lit(buckets))


def surrogate_key(key: Column | str, width: int, seed: int = 0) -> Column:
    """Id of a natural key from 2^width up to 2^(width+1) - 1: hash bits, then the key's bucket. Ids of different
    widths never meet, and two keys with one id lie in one bucket."""
    bits = F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit((1 << width) // KEY_BUCKETS))
    return F.lit(1 << width) + bits * F.lit(KEY_BUCKETS) + key_bucket(key)


def squeeze_ws(s: Column | str) -> Column:
    """H1: collapse whitespace runs to one space and trim (str.split semantics: all Unicode whitespace)."""
    return F.trim(F.regexp_replace(_c(s), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def add_https(url: Column | str) -> Column:
    """H2: prefix ``https://`` unless the URL already starts with ``http``."""
    u = _c(url)
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))


def url_path(url: Column | str) -> Column:
    """H3: path without the leading ``/`` and without one trailing ``/`` (after :func:`add_https`)."""
    full = add_https(url)
    after_host = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(after_host.startswith("/"), F.substring(after_host, 2, 1 << 30)).otherwise(after_host)
    return F.regexp_replace(path, "/$", "")


def root_url(url: Column | str) -> Column:
    """H4: ``scheme://netloc`` of a URL."""
    return F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def encode_query(s: Column | str) -> Column:
    """URL-encode a query value."""
    return F.url_encode(_c(s))


def add_url_param(url: Column | str, key: str, value: Column | str) -> Column:
    """Append ``?k=v`` or ``&k=v`` depending on whether the URL already has a query."""
    u = _c(url)
    sep = F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(u, sep, F.lit(f"{key}="), _c(value) if not isinstance(value, str) else F.lit(value))


def month_start(ts: Column | str) -> Column:
    """``date_trunc('month')`` as a timestamp."""
    return F.date_trunc("month", _c(ts)).cast("timestamp_ntz")


def month_label(ts: Column | str) -> Column:
    """E.g. ``January 2024``."""
    return F.date_format(month_start(ts), "MMMM yyyy")


def days_ago(as_of: Column | str, days: int) -> Column:
    """H7: threshold ``as_of - n days``."""
    a = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return a - F.make_dt_interval(F.lit(days))


def reformat_portal_date(s: Column | str, day_first: bool = False) -> Column:
    """H8: portal dates ``January 05, 2024`` -> ISO ``yyyy-MM-dd`` (``day_first`` reproduces year-day-month)."""
    d = F.to_date(_c(s), "MMMM dd, yyyy")
    return F.date_format(d, "yyyy-dd-MM" if day_first else "yyyy-MM-dd")


def iso_day(s: Column | str) -> Column:
    """H9: first 10 characters of a timestamp string."""
    return F.substring(_c(s), 1, 10)


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def normalize_record_formats(formats: Column | str) -> Column:
    """Alias -> known type; known types kept once in first-seen order; every unknown appends ``Other``."""
    mapping = _literal_map(CKAN_TYPE_CONVERSION_MAPPING)
    known = F.array(*[F.lit(t) for t in CKAN_DATA_TYPES])
    converted = F.transform(_c(formats), lambda f: F.coalesce(F.element_at(mapping, f), f))

    def step(acc, f):
        is_known = F.array_contains(known, f)
        return F.when(is_known & ~F.array_contains(acc, f), F.array_append(acc, f)).when(
            ~is_known, F.array_append(acc, F.lit("Other"))
        ).otherwise(acc)

    return F.aggregate(converted, F.array().cast("array<string>"), step)


def extra_value(extras: Column | str, key: str) -> Column:
    """First ``value`` of an ``extras`` array<struct<key,value>> entry with the given key (null if none)."""
    return F.get(F.filter(_c(extras), lambda e: e["key"] == F.lit(key)), 0)["value"]


def ckan_supplying_entity(pkg: Column | str) -> Column:
    """The ``publisher`` extra if present, else the organization title."""
    p = _c(pkg)
    return F.coalesce(extra_value(p["extras"], "publisher"), p["organization"]["title"])


def ckan_source_url(pkg: Column | str) -> Column:
    """struct(url, record_format, data_portal_type, error) for a catalogue package."""
    p = _c(pkg)
    formats = normalize_record_formats(F.transform(p["resources"], lambda r: r["format"]))
    n_res = F.size(p["resources"])
    landing = F.filter(p["extras"], lambda e: e["key"] == F.lit("landingPage"))
    one_link = (n_res == 1) & (formats == F.array(F.lit("HTML text")))
    none = n_res == 0
    url = (F.when(one_link, F.get(p["resources"], 0)["url"])
           .when(none, F.get(landing, 0)["value"])
           .otherwise(F.concat(p["base_url"], F.lit("dataset/"), p["name"])))
    fmt = F.when(none, F.array(F.lit("HTML text"))).otherwise(formats)
    portal = F.when(~one_link & ~none, F.lit("CKAN")).otherwise(F.lit(""))
    err = F.when(none & (F.size(landing) > 1), F.lit("Multiple landing pages found")).when(
        none & (F.coalesce(F.size(landing), F.lit(0)) <= 0), F.lit("No landing page found"))
    return F.struct(url.alias("url"), fmt.alias("record_format"), portal.alias("data_portal_type"), err.alias("error"))


def ckan_parse(pkg: Column | str) -> Column:
    """Package -> struct(source_url, submitted_name, agency_name, description, supplying_entity,
    record_format, data_portal_type, source_last_updated, error)."""
    p = _c(pkg)
    src = ckan_source_url(p)
    return F.struct(
        src["url"].alias("source_url"),
        p["title"].alias("submitted_name"),
        p["organization"]["title"].alias("agency_name"),
        p["notes"].alias("description"),
        ckan_supplying_entity(p).alias("supplying_entity"),
        src["record_format"].alias("record_format"),
        src["data_portal_type"].alias("data_portal_type"),
        iso_day(p["metadata_modified"]).alias("source_last_updated"),
        src["error"].alias("error"),
    )


def count_when(cond: Column) -> Column:
    """Conditional count (``count(case when .. then 1 end)``)."""
    return F.count(F.when(cond, F.lit(1)))


def coalesce0(c: Column | str) -> Column:
    """Null -> 0."""
    return F.coalesce(_c(c), F.lit(0))


def update_if_not_none(old: Column | str, new: Column | str) -> Column:
    """Overlay a new value when it is not null."""
    return F.coalesce(_c(new), _c(old))


def as_enum(c: Column | str, allowed: Iterable[str]) -> Column:
    """struct(value, error) — value when inside the closed set, else an error message."""
    col = _c(c)
    ok = col.isin(list(allowed))
    return F.struct(F.when(ok, col).alias("value"),
                    F.when(~ok | col.isNull(), F.concat(F.lit("invalid value: "), F.coalesce(col, F.lit("null")))).alias("error"))


def metadata_field(metadata: Column | str, key: str) -> Column:
    """struct(value, error) for a key of the collector-metadata JSON; a missing key is an error."""
    m = _c(metadata)
    v = F.get_json_object(m, f"$.{key}")
    has = F.json_object_keys(m)
    present = F.array_contains(F.coalesce(has, F.array().cast("array<string>")), F.lit(key))
    return F.struct(v.alias("value"), F.when(~present, F.lit(f"missing key: {key}")).alias("error"))
