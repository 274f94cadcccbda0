"""Records of products against walks in Python."""

import json
import random

from fieldmill.operators import registrations as reg


def crops_by_walk(nodes, inherited=False):
    found = set()
    for n in nodes or []:
        name = n.get("crop") or n.get("group")
        if "items" in n:
            if n.get("complete") and name:
                found.add(name)
            found |= crops_by_walk(n["items"], inherited or bool(n.get("complete")))
        elif (inherited or n.get("selected")) and name:
            found.add(name)
    return found


def labels_by_walk(nodes):
    found = []
    for n in nodes or []:
        if n.get("selected"):
            if "organismScientific" in n:
                name, common = n.get("organism") or n["organismScientific"], ", ".join(n.get("diseases") or [])
                found.append(f"{common} ({name})" if common else name)
            elif n.get("group") or n.get("groupScientific"):
                found.append(n.get("group") or n["groupScientific"])
        found += labels_by_walk(n.get("items"))
    return list(dict.fromkeys(found))


def random_tree(rng, depth, leaf, letters="abcdefgh"):
    nodes = []
    for _ in range(rng.randrange(1, 5)):
        n = {} if rng.random() < 0.1 else leaf(rng, rng.choice(letters))
        if depth and rng.random() < 0.6:
            n = {"group": "G" + rng.choice(letters), "complete": rng.random() < 0.3, "selected": rng.random() < 0.3, "items": random_tree(rng, depth - 1, leaf, letters)}
        nodes.append(n)
    return nodes


def test_trees_equal_walks(spark):
    rng = random.Random(1)
    crop = lambda r, x: {"crop": x, "selected": r.random() < 0.4}
    organism = lambda r, x: {"organismScientific": x, "organism": r.choice([None, "", "o" + x]), "diseases": r.choice([None, [], ["d", "e"]]), "selected": r.random() < 0.5}
    records = [{"id": i, "uses": [{"targetCrops": random_tree(rng, 4, crop), "targetOrganisms": random_tree(rng, 3, organism)} for _ in range(rng.randrange(0, 3))]} for i in range(60)]
    records.append({"id": 99, "uses": [{"targetCrops": None}, {"targetCrops": [{"group": "deep", "complete": True, "items": [{"group": "e", "items": [{"group": "f", "items": [{"group": "g", "items": [{"crop": "leaf"}]}]}]}]}]}]})
    payloads = [json.dumps({"data": r} if i % 2 else r) for i, r in enumerate(records)]
    found = reg.product_uses(spark.createDataFrame([(p,) for p in payloads + payloads[:5]], "payload string").repartition(4)).collect()
    by_use = {}
    for r in found:
        by_use.setdefault((r["product_id"], r["use_no"]), []).append((r["crops"], r["organisms"]))
    wanted = {}
    for r in records:
        for k, u in enumerate(r["uses"] or []):
            wanted[str(r["id"]), k] = (sorted(crops_by_walk(u.get("targetCrops"))), labels_by_walk(u.get("targetOrganisms")))
        if not r["uses"]:
            wanted[str(r["id"]), None] = ([], [])
    assert {k: v[0] for k, v in by_use.items()} == wanted
    assert wanted["99", 1][0] == ["deep", "leaf"]
    assert all(len(v) == (2 if int(k[0]) < 5 else 1) and len(set(map(str, v))) == 1 for k, v in by_use.items())


def test_fields_of_a_record(spark):
    use = {
        "nameOfUse": {"name": " ## Pruim ", "usesSummary": "Kers en pruim"}, "targetCrops": [{"crop": "Kers", "selected": True}], "targetLocations": [{"description": "buiten"}, {}], "maximumProductDose": {"ratio": 0.5, "measure": {"unit": "l/ha"}},
        "amountOfApplications": {"perCropSeason": 2, "perUse": 1}, "phiDays": 14, "growthStage": {"from": "51", "to": "69"}, "watervolumeScale": {"min": 200}, "minorUse": {"type": "Ja"}, "remarks": " x ", "restrictions": ["a ", {"text": "b"}, {"value": ""}, 3],
    }
    record = {
        "id": 7, "name": "P", "authorisation": {"registrationNumber": {"nl": "123"}, "actual": [{"wCodings": [{"expirationDate": "2030-01-01T21:00:00Z"}, {"expirationDate": "2030-01-01T22:00:00Z", "instructionOfUse": {"document": {"link": "m"}}}, {"expirationDate": "bad"}]}]},
        "compositions": {"substances": [{"function": {"isActiveSubstance": True}, "substance": {"name": "S"}, "concentration": "2,5", "concentrationUnit": {"unit": "%"}}, {"substance": {"name": "water"}}]}, "components": [{"labelling": [{"signalWord": {"description": "Let op"}}]}],
        "decisions": [{}, {"document": {"link": "d"}}], "uses": [use, {"nameOfUse": {"usesSummary": "Boomkwekerij"}, "targetCrops": [{"crop": "Kers", "selected": True}]}],
    }
    rows = spark.createDataFrame([(json.dumps(record),), ("[1, 2]",), ("bad",), (None,), ("{}",)], "payload string")
    p = {r["product_id"]: r for r in reg.products(rows).collect()}
    assert set(p) == {"7", ""} and (str(p["7"]["expires"]), p["7"]["registration_number"], p["7"]["active_substances"], p["7"]["signal_word"], p["7"]["manual_url"], p["7"]["decision_url"], p["7"]["n_uses"]) == ("2030-01-02", "123", ["S 2,5 %"], "Let op", "m", "d", 2)
    found = sorted(reg.named_for(reg.product_uses(rows), ["kers"], "kers").where("product_id = '7'").collect(), key=lambda r: r["use_no"])
    u = found[0]
    assert (u["use_name"], u["crops"], u["locations"], u["dose"], u["dose_unit"], u["per_season"], u["wait_days"], u["stage_to"], u["water_min"], u["water_max"], u["minor_use"], u["remarks"], u["restrictions"][:2], u["restrictions"][3]) == ("Pruim", ["Kers"], ["buiten", ""], 0.5, "l/ha", 2.0, 14, "69", 200.0, None, True, "x", ["a", "b"], "3")
    assert [(r["explicit"], r["applies"]) for r in found] == [(True, True), (False, False)]
    assert [r["expired"] for r in reg.status(reg.product_uses(rows), "2031-01-01").where("product_id = '7'").collect()] == [True, True]
    assert not {"dose", "season_dose"} & set(reg.model_facts(reg.product_uses(rows)).columns)
    assert reg.product_uses(rows.where("false")).count() == 0


def test_deep_trees_in_few_rows(spark):
    node = {"crop": "leaf"}
    for k in range(40):
        node = {"group": f"g{k}", "complete": k == 20, "items": [node]}
    found = reg.product_uses(spark.createDataFrame([(json.dumps({"id": 1, "uses": [{"targetCrops": [node]}]}),)], "payload string")).first()
    assert found["crops"] == ["g20", "leaf"]


def test_trees_are_walked_in_their_row(spark):
    uses = reg.product_uses(spark.createDataFrame([('{"id": 1, "uses": [{"targetCrops": [{"crop": "a", "selected": true}]}]}',)], "payload string"))
    assert "Exchange" not in uses._jdf.queryExecution().executedPlan().toString()
    assert [r["crops"] for r in uses.collect()] == [["a"]]
