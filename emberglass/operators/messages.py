"""Messages from routes: for each pocket the route to name, the sentence in each language, its check, the alert document and
the entry for the ledger. Sentences are chosen and filled, never composed, and one that cannot be verified is not sent."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.operators import alerts, routes
from emberglass.operators.routes import settlement_area, severity

#: instruction: what to do, how soon, whether a road is named, and the sentence by language.
SENTENCES = {
    "evacuate_primary": ("Evacuate", "Immediate", True, {"en": "Go now from {pocket} to {destination}, along {road} only.", "es": "Vaya ya de {pocket} a {destination}, solo por {road}.", "ca": "Aneu ara de {pocket} a {destination}, només per {road}."}),
    "evacuate_alternate": ("Evacuate", "Immediate", True, {"en": "Go from {pocket} to {destination} along {road}; part of the way is a track.", "es": "Vaya de {pocket} a {destination} por {road}; parte del camino es de tierra.", "ca": "Aneu de {pocket} a {destination} per {road}; part del camí és de terra."}),
    "no_verified_action": ("Prepare", "Immediate", False, {"en": "No way out of {pocket} is verified. Wait for the emergency services.", "es": "Ninguna salida de {pocket} está verificada. Espere a los servicios de emergencia.", "ca": "Cap sortida de {pocket} no està verificada. Espereu els serveis d'emergència."}),
    "no_action": ("Monitor", "Future", False, {"en": "Nothing needs to be done in {pocket} now.", "es": "Ahora no hay que hacer nada en {pocket}.", "ca": "Ara no cal fer res a {pocket}."}),
}
LANGUAGES = ("es", "en")
SENDER = {"sender": "operator@example.org", "status": "Exercise", "scope": "Private", "addresses": "exercise"}
#: South, north, west and east of where alerts may lie.
BOUNDS = (35.0, 44.0, -10.0, 4.0)
DATE = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[-+]\d\d:\d\d$"


def _texts(sentences: dict) -> Column:
    """Map of instruction to (response, urgency, names_road, map of language to sentence)."""
    pairs = []
    for name, (response, urgency, road, text) in sentences.items():
        by_lang = F.create_map(*[F.lit(x) for kv in text.items() for x in kv])
        pairs += [F.lit(name), F.struct(F.lit(response).alias("response"), F.lit(urgency).alias("urgency"), F.lit(road).alias("names_road"), by_lang.alias("text"))]
    return F.create_map(*pairs)


def recommended(found: DataFrame, verdicts: DataFrame, places: DataFrame, ways: DataFrame, cursor_s: int, window_end_s: int, sentences: dict = SENTENCES) -> DataFrame:
    """A row a pocket: pocket, name, instruction, response, urgency, names_road, severity, certainty, area, languages, road,
    and of the route chosen (nulls without one) route, destination, edges, km, travel_min, slowest, open_s, latest_s, basis,
    worst_min.

    found, verdicts: as of evacuation(); places: sid, name, lat, lon, outline, languages (null: LANGUAGES; ones without
    sentences are left out, the first language stands in for none), reached (null: not known, so it is); ways: edge, name,
    highway. The route is the usable one with the latest earliest departure.
    """
    best = routes.chosen(found.withColumnRenamed("basis", "basis_"), "pocket")
    best = best.select("pocket", "route", "destination", "edges", "km", "travel_min", "slowest", "open_s", "latest_s", F.col("basis_").alias("basis"), "worst_min", "usable")
    along = best.select("route", F.posexplode("edges").alias("ord", "edge")).join(ways, "edge", "left")
    named = routes.road_name(along).select("route", F.col("name").alias("road"))
    known = [k for k in next(iter(sentences.values()))[3]]
    spoken = F.filter(F.coalesce("languages", F.array(*[F.lit(x) for x in LANGUAGES])), lambda x: x.isin(*known))
    p = places.select(F.col("sid").alias("pocket"), "name", F.coalesce("reached", F.lit(True)).alias("reached"), settlement_area(F.col("outline"), F.col("lat"), F.col("lon")).alias("area"), F.when(F.size(spoken) > 0, spoken).otherwise(F.array(F.lit(LANGUAGES[0]))).alias("languages"))
    rows = verdicts.select("pocket", "verdict").join(p, "pocket").join(best, "pocket", "left").join(named, "route", "left")
    choice = alerts.instruction(F.col("reached"), F.col("usable"), F.col("open_s"), F.col("slowest"), cursor_s)
    rows = rows.withColumn("instruction", F.when(F.col("verdict") == "not_yet_observed", "no_verified_action").otherwise(choice))
    rows = rows.withColumn("s", F.element_at(_texts(sentences), F.col("instruction")))
    return rows.select(
        "pocket", "name", "verdict", "instruction", "s.response", "s.urgency", "s.names_road", "s.text", severity(F.col("reached")).alias("severity"),
        alerts.certainty(F.col("open_s"), F.col("latest_s"), window_end_s).alias("certainty"), "area", "languages", F.coalesce("road", F.lit("")).alias("road"),
        "route", "destination", "edges", "km", "travel_min", "slowest", "open_s", "latest_s", "basis", "worst_min",
    )


def spoken(rows: DataFrame, places: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, rejected) of recommended() rows, one for each language.

    A pocket whose sentence would name a road that has no name is rejected once, uncomposed. A sentence with a gap left is
    an incomplete_template; one whose names are no place or way, or whose way is not on the route, is rejected by
    verified() of routes.py. places: sid, name; ways: edge, name.
    """
    nameless = F.col("names_road") & (F.trim("road") == "")
    mute = rows.filter(nameless).select("pocket", "instruction", F.get("languages", F.lit(0)).alias("language"), F.lit(None).cast("string").alias("text"), F.lit("unresolved_name").alias("reason"), F.lit("").alias("detail"))
    said = rows.filter(~nameless).withColumn("language", F.explode("languages")).withColumn("text", F.element_at("text", F.col("language")))
    said = said.withColumn("text", alerts.fill(F.col("text"), {"pocket": F.col("name"), "road": F.col("road"), "destination": F.coalesce("destination", F.lit(""))}))
    said = said.withColumns({"gaps": F.array_join(alerts.unresolved(F.col("text")), ","), "sentence": F.struct("pocket", "language")})
    names = said.filter("names_road").select("sentence", F.posexplode(F.array("road", "destination")).alias("ord", "name")).filter("name <> ''")
    on = said.select("sentence", F.explode("edges").alias("edge"))
    checked = routes.verified(names, places.select(F.col("sid").cast("string").alias("id"), "name"), ways.filter("name is not null").select(F.col("edge").cast("string").alias("id"), "name", "edge"), on)
    fault = checked.select("sentence", "reason", F.col("name").alias("detail")).filter("reason is not null")
    judged = said.join(fault, "sentence", "left")
    gap = F.col("gaps") != ""
    judged = judged.withColumns({"reason": F.when(gap, "incomplete_template").otherwise(F.col("reason")), "detail": F.when(gap, F.col("gaps")).otherwise(F.col("detail"))})
    sent = judged.filter("reason is null").drop("reason", "detail", "gaps", "sentence", "names_road", "languages", "verdict")
    return sent, judged.filter("reason is not null").select("pocket", "instruction", "language", "text", "reason", "detail").union(mute)


def entries(rows: DataFrame, cursor_s: int, fingerprint: str) -> DataFrame:
    """Ledger entries (seq, cursor_s, fingerprint, pocket, payload) of recommended() rows whose sentence could be composed:
    what was recommended and on what evidence, as JSON. seq is by pocket."""
    km = F.format_string("%s: %s km, %s min, worst road %s", F.col("destination"), F.col("km"), F.col("travel_min"), F.col("slowest"))
    why = (
        F.when(F.col("instruction") == "no_action", "the fire does not reach this place within the window")
        .when(F.col("verdict") == "not_yet_observed", "no detection had arrived, so no route could be judged")
        .when(F.col("route").isNull(), "no route is usable")
        .when(F.col("instruction") == "no_verified_action", F.concat(F.lit("departure has passed for "), km))
        .otherwise(km)
    )
    payload = F.to_json(F.struct(F.col("instruction").alias("recommendation"), why.alias("evidence"), F.col("basis"), F.col("worst_min").alias("clearance_min")))
    kept = rows.filter(~(F.col("names_road") & (F.trim("road") == "")))
    seq = F.xxhash64("pocket").bitwiseAND(F.lit(2**53 - 1)).alias("seq")
    return kept.select(seq, F.lit(cursor_s).cast("long").alias("cursor_s"), F.lit(fingerprint).alias("fingerprint"), F.col("pocket").cast("string").alias("pocket"), payload.alias("payload"))


def _element(tag: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"<{tag}>"), alerts.xml_escape(alerts.xml_clean(value.cast("string"))), F.lit(f"</{tag}>"))


def documents(packages: DataFrame, sent: str, sender: dict = SENDER, event: str = "Wildfire") -> DataFrame:
    """(pocket, identifier, xml, problems): a CAP 1.2 alert for each pocket, an info for each language in order, and what is
    wrong with it (empty: nothing). packages: as of spoken(); sent: the time with its zone's offset."""
    info = F.concat(
        F.lit("<info>"), _element("language", F.col("language")), _element("category", "Fire"), _element("event", event), _element("responseType", F.col("response")),
        _element("urgency", F.col("urgency")), _element("severity", F.col("severity")), _element("certainty", F.col("certainty")), _element("headline", F.col("text")), _element("description", F.col("text")),
        F.lit("<area>"), _element("areaDesc", F.col("name")), F.lit("<polygon>"), alerts.polygon_text(F.col("area")), F.lit("</polygon></area></info>"),
    )
    g = packages.groupBy("pocket").agg(F.array_sort(F.collect_list(F.struct("language", info.alias("x")))).alias("infos"), F.min("instruction").alias("instruction"), F.first("area").alias("area"))
    ident = F.concat(F.lit("emberglass:"), F.col("pocket").cast("string"), F.lit(":"), F.regexp_replace(F.lit(sent), "[-:]", ""), F.lit(":"), F.col("instruction"))
    head = [_element("identifier", ident), _element("sender", sender["sender"]), _element("sent", sent), _element("status", sender["status"]), _element("msgType", "Alert"), _element("scope", sender["scope"])]
    head += [_element("addresses", sender["addresses"])] if sender.get("addresses") else []
    xml = F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), *head, F.array_join(F.transform("infos", lambda i: i["x"]), ""), F.lit("</alert>"))
    out = g.select("pocket", ident.alias("identifier"), xml.alias("xml"), "area", F.size("infos").alias("n"))
    return out.select("pocket", "identifier", "xml", problems(F.col("xml"), F.col("area"), F.col("n"), sender).alias("problems"))


def problems(xml: Column, area: Column, n_infos: Column, sender: dict = SENDER, bounds: tuple = BOUNDS) -> Column:
    """What a schema does not say: rings closed, where they should be and not turned about, no markup in closed words, dates
    of the alert's form, an info a language and at least one, addresses where the scope asks for them."""
    south, north, west, east = bounds
    first, last = F.get(area, 0), F.get(area, F.size(area) - 1)
    astray = F.exists(area, lambda p: ~((p["lat"] > south) & (p["lat"] < north) & (p["lon"] > west) & (p["lon"] < east)))
    found = lambda tag: F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    count = lambda text: F.regexp_count(xml, F.lit(text))
    words = ("status", "scope", "responseType", "urgency", "severity", "certainty")
    rules = [
        (F.size(area) < 4, "the ring has fewer than four points"),
        ((first["lat"] != last["lat"]) | (first["lon"] != last["lon"]), "the ring is not closed"),
        (astray, "a point lies outside the region"),
        *[(F.exists(found(t), lambda x: x.rlike("[<>&\"']")), f"{t} holds markup") for t in words],
        *[(count(f"<{t}>") != count(f"</{t}>"), f"{t} is not closed") for t in words],
        *[(F.exists(found(t), lambda x: ~x.rlike(DATE)), f"{t} is no date of an alert") for t in ("sent", "effective", "onset", "expires")],
        (F.regexp_replace(xml, "<[^>]*>", "").rlike("<[a-zA-Z/]"), "markup outside tags"),
        (count("<info>") != n_infos, "an info is missing or there are too many"),
        (count("<info>") == 0, "there is no info"),
        (F.lit(sender["scope"] in ("Private", "Restricted")) & (count("<addresses>") == 0), "the scope asks for addresses"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(text)) for rule, text in rules]))


def fingerprint_of(inputs: dict) -> str:
    """16 hex digits of what a recommendation rests on, in order of name."""
    import hashlib

    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]
