"""Product registrations: nested records (JSON) to products and uses.

Everything is expressions: the fields of a record are read with a schema, and the trees of crops and organisms, which have
no fixed depth, are walked by recursive SQL over variants, all trees of a table at once, a level a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

_DOSE = "STRUCT<ratio: DOUBLE, measure: STRUCT<unit: STRING>>"
_NAMED = "ARRAY<STRUCT<description: STRING>>"
#: Fixed: the fields of a use and of a record.
USE = (
    f"STRUCT<nameOfUse: STRUCT<name: STRING, usesSummary: STRING>, targetCrops: VARIANT, targetOrganisms: VARIANT, targetLocations: {_NAMED}, applicationMethods: {_NAMED}, maximumProductDose: {_DOSE}, maximumProductDosePerCropSeason: {_DOSE}, "
    "amountOfApplications: STRUCT<perCropSeason: DOUBLE, perUse: DOUBLE>, minimumIntervalBetweenApplications: INT, phiDays: INT, applicationTiming: STRUCT<fromMonth: INT, toMonth: INT>, growthStage: STRUCT<from: STRING, to: STRING>, "
    "watervolumeScale: STRUCT<min: DOUBLE, max: DOUBLE>, minorUse: STRUCT<type: STRING>, remarks: STRING, restrictions: ARRAY<VARIANT>>"
)
RECORD = (
    "STRUCT<id: STRING, name: STRING, authorisation: STRUCT<registrationNumber: STRUCT<nl: STRING>, actual: ARRAY<STRUCT<wCodings: ARRAY<STRUCT<expirationDate: STRING, instructionOfUse: STRUCT<document: STRUCT<link: STRING>>>>>>>, "
    "authorisationHolder: STRUCT<companyName: STRING>, categoryType: STRUCT<description: STRING>, compositions: STRUCT<substances: ARRAY<STRUCT<function: STRUCT<isActiveSubstance: BOOLEAN>, concentrationUnit: STRUCT<description: STRING, unit: STRING>, substance: STRUCT<name: STRING>, concentration: STRING>>, "
    f"formulationType: STRUCT<description: STRING>>, components: ARRAY<STRUCT<labelling: ARRAY<STRUCT<signalWord: STRUCT<description: STRING>>>>>, decisions: ARRAY<STRUCT<document: STRUCT<link: STRING>>>, uses: ARRAY<{USE}>>"
)
#: Fixed: summaries that stand for fruit growing.
FRUIT_GROUP = "vruchtbom|steenvrucht|fruitgewas"

#: Fixed: deeper trees are an error.
MOST_LEVELS = 100
_NODES = "ARRAY<STRUCT<path: ARRAY<INT>, node: VARIANT, whole: BOOLEAN>>"


def _below(v: Column, path: str) -> Column:
    """The elements of an array in ``v``, or the values of an object."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.map_values(F.try_variant_get(v, path, "map<string,variant>")))


def tree_nodes(tree: Column) -> Column:
    """All nodes of a variant array of nodes with ``items`` below, a level after the other: path (places from the root), node and whether a node above is complete. A node without ``items`` has nothing below."""
    none = F.array().cast(_NODES)
    nodes = lambda below, path, whole: F.coalesce(F.transform(below, lambda v, i: F.struct(path(i).alias("path"), v.alias("node"), whole.alias("whole"))), none)

    def children(n: Column) -> Column:
        return nodes(_below(n["node"], "$.items"), lambda i: F.concat(n["path"], F.array(i)), n["whole"] | F.coalesce(_field(n["node"], "complete", "boolean"), F.lit(False)))

    def step(acc: Column, _: Column) -> Column:
        more = F.struct(F.concat(acc["done"], acc["level"]).alias("done"), F.flatten(F.transform(acc["level"], children)).alias("level"))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(more)

    start = F.struct(none.alias("done"), nodes(_below(tree, "$"), lambda i: F.array(i), F.lit(False)).alias("level"))
    deep = F.raise_error(F.lit(f"a tree has more than {MOST_LEVELS} levels")).cast(_NODES)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_LEVELS)), start, step, lambda acc: F.when(F.size(acc["level"]) > 0, deep).otherwise(acc["done"]))


def _field(node: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def crop_names(nodes: Column) -> Column:
    """By name the selected leaves, groups marked complete, and everything below these."""

    def named(n: Column) -> Column:
        v = n["node"]
        own = F.coalesce(_field(v, "complete", "boolean"), F.lit(False))
        chosen = F.when(F.variant_get(v, "$.items", "variant").isNotNull(), own).otherwise(n["whole"] | F.coalesce(_field(v, "selected", "boolean"), F.lit(False)))
        return F.when(chosen, F.coalesce(_filled(_field(v, "crop")), _filled(_field(v, "group"))))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(nodes, named))))


def organism_labels(nodes: Column) -> Column:
    """Labels of selected organisms and groups in the order of the tree, each once."""

    def labelled(n: Column) -> Column:
        v = n["node"]
        scientific = F.coalesce(_filled(_field(v, "organism")), _field(v, "organismScientific"))
        diseases = F.array_join(F.try_variant_get(v, "$.diseases", "array<string>"), ", ")
        organism = F.when(F.coalesce(diseases, F.lit("")) != "", F.concat(diseases, F.lit(" ("), scientific, F.lit(")"))).otherwise(scientific)
        is_organism = F.variant_get(v, "$.organismScientific", "variant").isNotNull()
        label = F.when(is_organism, organism).otherwise(F.coalesce(_filled(_field(v, "group")), _filled(_field(v, "groupScientific"))))
        return F.struct(n["path"].alias("path"), F.when(F.coalesce(_field(v, "selected", "boolean"), F.lit(False)), label).alias("label"))

    found = F.filter(F.transform(nodes, labelled), lambda x: x["label"].isNotNull())
    return F.array_distinct(F.transform(F.array_sort(found), lambda x: x["label"]))


def _records(records: DataFrame, payload: str) -> DataFrame:
    """``d`` for each record that can be read."""
    read = lambda schema: F.from_json(F.col(payload), schema)
    text = F.trim(F.coalesce(F.col(payload), F.lit("")))
    good = records.where(F.startswith(text, F.lit("{")) & F.try_parse_json(F.col(payload)).isNotNull())
    return good.select(F.coalesce(read(f"STRUCT<data: {RECORD}>")["data"], read(RECORD)).alias("d"))


def _restriction(r: Column) -> Column:
    """A restriction as text: itself, or the first filled of its fields, or its JSON."""
    get = lambda n: _filled(F.trim(F.try_variant_get(r, f"$.{n}", "string")))
    return F.coalesce(*[get(n) for n in ("description", "text", "name", "value")], F.trim(F.try_variant_get(r, "$", "string")))


def _codings(d: Column) -> Column:
    return F.get(d["authorisation"]["actual"], F.lit(0))["wCodings"]


def _expiration(d: Column) -> Column:
    return F.array_max(F.transform(_codings(d), lambda c: D.utc_evening_date(c["expirationDate"])))


def products(records: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each record that can be read: id, name, registration_number, holder, expires, category, active_substances, formulation, signal_word, manual_url, decision_url and n_uses."""
    d = F.col("d")
    unit = lambda s: F.coalesce(_filled(s["concentrationUnit"]["description"]), s["concentrationUnit"]["unit"], F.lit(""))
    amount = lambda s: F.coalesce(F.replace(F.replace(s["concentration"], F.lit(","), F.lit(".")).try_cast("double").cast("string"), F.lit("."), F.lit(",")), F.lit("-"))
    active = F.filter(d["compositions"]["substances"], lambda s: F.coalesce(s["function"]["isActiveSubstance"], F.lit(False)))
    names = F.transform(active, lambda s: F.trim(F.concat_ws(" ", F.coalesce(s["substance"]["name"], F.lit("?")), amount(s), unit(s))))
    link = lambda xs: F.get(F.filter(xs, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0))
    return _records(records, payload).select(
        F.coalesce(d["id"], F.lit("")).alias("product_id"), F.coalesce(_filled(d["name"]), F.lit("?")).alias("product"), F.coalesce(d["authorisation"]["registrationNumber"]["nl"], F.lit("")).alias("registration_number"),
        F.coalesce(d["authorisationHolder"]["companyName"], F.lit("")).alias("holder"), _expiration(d).alias("expires"), F.coalesce(d["categoryType"]["description"], F.lit("")).alias("category"),
        F.coalesce(names, F.array().cast("array<string>")).alias("active_substances"), F.coalesce(d["compositions"]["formulationType"]["description"], F.lit("")).alias("formulation"),
        F.coalesce(F.get(F.get(d["components"], F.lit(0))["labelling"], F.lit(0))["signalWord"]["description"], F.lit("")).alias("signal_word"),
        link(F.transform(_codings(d), lambda c: c["instructionOfUse"]["document"]["link"])).alias("manual_url"),
        link(F.transform(d["decisions"], lambda x: x["document"]["link"])).alias("decision_url"), F.coalesce(F.size(d["uses"]), F.lit(0)).alias("n_uses"),
    )


def product_uses(records: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each use of each record (JSON), and one with a null use for a record without any; what can't be read is left out."""
    d = F.col("d")
    rows = _records(records, payload).select(F.coalesce(d["id"], F.lit("")).alias("product_id"), F.coalesce(_filled(d["name"]), F.lit("?")).alias("product"), _expiration(d).alias("expires"), F.posexplode_outer(d["uses"]).alias("use_no", "u"))
    u = F.col("u")
    none = F.array().cast("array<string>")
    described = lambda xs: F.coalesce(F.transform(xs, lambda x: F.coalesce(x["description"], F.lit(""))), none)
    name = F.trim(F.regexp_replace(F.trim(F.coalesce(u["nameOfUse"]["name"], F.lit(""))), "^#+", ""))
    return rows.select(
        "product_id", "product", "expires", "use_no", F.when(u.isNotNull(), name).alias("use_name"), F.when(u.isNotNull(), F.coalesce(u["nameOfUse"]["usesSummary"], F.lit(""))).alias("summary"),
        crop_names(tree_nodes(u["targetCrops"])).alias("crops"), organism_labels(tree_nodes(u["targetOrganisms"])).alias("organisms"), described(u["targetLocations"]).alias("locations"), described(u["applicationMethods"]).alias("methods"),
        u["maximumProductDose"]["ratio"].alias("dose"), u["maximumProductDose"]["measure"]["unit"].alias("dose_unit"), u["maximumProductDosePerCropSeason"]["ratio"].alias("season_dose"), u["maximumProductDosePerCropSeason"]["measure"]["unit"].alias("season_dose_unit"),
        u["amountOfApplications"]["perCropSeason"].alias("per_season"), u["amountOfApplications"]["perUse"].alias("per_use"), u["minimumIntervalBetweenApplications"].alias("least_gap"), u["phiDays"].alias("wait_days"),
        u["applicationTiming"]["fromMonth"].alias("month_from"), u["applicationTiming"]["toMonth"].alias("month_to"), u["growthStage"]["from"].alias("stage_from"), u["growthStage"]["to"].alias("stage_to"),
        u["watervolumeScale"]["min"].alias("water_min"), u["watervolumeScale"]["max"].alias("water_max"), F.coalesce(u["minorUse"]["type"] == "Ja", F.lit(False)).alias("minor_use"),
        F.trim(F.coalesce(u["remarks"], F.lit(""))).alias("remarks"), F.coalesce(F.transform(u["restrictions"], _restriction), none).alias("restrictions"),
    )


def for_crop(uses: DataFrame, names: list[str]) -> DataFrame:
    """Uses that name one of the crops, whole names only."""
    return uses.where(F.arrays_overlap(F.transform("crops", lambda c: F.lower(c)), F.array(*[F.lit(n.lower()) for n in names])))


def named_for(uses: DataFrame, names: list[str], own: str, group: str = FRUIT_GROUP) -> DataFrame:
    """``uses`` with explicit (the summary names the crop itself) and applies: the crop is among a use's crops and the summary names it or a group of fruits.

    A broad group, as of tree nurseries, lists a crop that it isn't grown for.
    """
    summary = T.fold(F.coalesce("summary", F.lit("")))
    listed = F.exists("crops", lambda c: T.fold(c).isin([n.lower() for n in names]))
    return uses.withColumn("explicit", F.regexp(summary, F.lit(rf"\b{own}\b"))).withColumn("applies", listed & (F.col("explicit") | F.regexp(summary, F.lit(group))))


def model_facts(uses: DataFrame) -> DataFrame:
    """What a model may see of a use: never a dose."""
    return uses.drop("dose", "dose_unit", "season_dose", "season_dose_unit")


def status(uses: DataFrame, as_of: str) -> DataFrame:
    return uses.withColumn("expired", F.coalesce(F.col("expires") < F.lit(as_of).cast("date"), F.lit(False)))
