"""Alert packages: texts are selected and filled, never composed; names are verified; entries are appended once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} gives way to its value; a name without one stays as it stands."""
    for name, value in values.items():
        template = F.when(value.isNotNull(), F.replace(template, F.lit("{" + name + "}"), value)).otherwise(template)
    return template


def unresolved(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), F.lit(1)))


def xml_clean(text: Column) -> Column:
    """Characters that XML does not allow are taken out."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFE\\uFFFF]", "")


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def polygon_text(ring: Column) -> Column:
    ok = F.filter(ring, lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180))
    return F.array_join(F.transform(ok, lambda p: F.format_string("%.6f,%.6f", p["lat"], p["lon"])), " ")


def fingerprint(*columns: str) -> Column:
    """16 hex digits of the columns in order of name; nulls are left out."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def resolve(candidates: DataFrame, places: DataFrame, ways: DataFrame) -> DataFrame:
    """candidates (cid, name) with the place or way of that name, case and outer spaces aside: places first, then least
    id. kind and target are null where there is none. An empty name matches nothing."""
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    table = places.select(key("name").alias("k"), F.lit(0).alias("rank"), F.lit("place").alias("kind"), F.col("id").alias("target")).union(ways.select(key("name"), F.lit(1), F.lit("way"), F.col("id")))
    first = table.filter("k is not null").groupBy("k").agg(F.min(F.struct("rank", "target", "kind")).alias("m"))
    return candidates.withColumn("k", key("name")).join(first, "k", "left").select("cid", "name", F.col("m.kind").alias("kind"), F.col("m.target").alias("target"))


def instruction(reached: Column, usable: Column, earliest_s: Column, slowest: Column, cursor_s: int) -> Column:
    shut = ~F.coalesce(usable, F.lit(False)) | earliest_s.isNull() | (earliest_s < cursor_s)
    return F.when(~reached, "no_action").when(shut, "no_verified_action").when(slowest.isin("track", "service"), "evacuate_alternate").otherwise("evacuate_primary")


def certainty(earliest_s: Column, latest_s: Column, window_end_s: int) -> Column:
    return F.when(earliest_s.isNull(), "Possible").when(latest_s.isNull(), F.when(earliest_s == window_end_s, "Likely").otherwise("Possible")).when(latest_s - earliest_s <= 7200, "Likely").otherwise("Possible")


def append_new(ledger: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("cursor_s", "fingerprint", "pocket")) -> DataFrame:
    """Entries that the ledger hasn't; of equal ones among themselves that of the least seq."""
    w = Window.partitionBy(*keys).orderBy("seq")
    new = entries.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    return new.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def tail(ledger: DataFrame, n: int) -> DataFrame:
    """The last n entries in recorded order."""
    return ledger.orderBy(F.desc("seq")).limit(max(0, n)).orderBy("seq")


def cap_documents(packages: DataFrame) -> DataFrame:
    """(pocket, xml): one alert per pocket with its languages in order. packages: pocket, sent, lang, headline, area."""
    info = F.concat(F.lit("<info><language>"), xml_escape(F.col("lang")), F.lit("</language><headline>"), xml_escape(xml_clean(F.col("headline"))), F.lit("</headline><area><polygon>"), F.col("area"), F.lit("</polygon></area></info>"))
    infos = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", info.alias("x")))), lambda s: s["x"]), "")
    g = packages.groupBy("pocket", "sent").agg(infos.alias("infos"))
    ident = F.concat(F.lit("pocket-"), F.col("pocket").cast("string"), F.lit("-"), F.regexp_replace("sent", "[^0-9T]", ""))
    return g.select("pocket", F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>'), ident, F.lit("</identifier><sent>"), F.col("sent"), F.lit("</sent>"), F.col("infos"), F.lit("</alert>")).alias("xml"))
