import json

import pytest

from namesmith.operators import hierarchy
from namesmith.plans import jobs
from namesmith.sources import readers


@pytest.fixture
def mentions(spark, tmp_path):
    rows = []
    for e in range(6):
        for k in range(3):
            rows.append({"mentionId": f"{e}-{k}", "goldEntityId": f"g{e}", "self": {"firstName": ["Maria", "Jo Ann"][e % 2], "lastName": "Lopez", "emails": [f"e{e}@x.y"]}, "coauthors": [{"firstName": "Q", "lastName": "Co" + "abcdef"[e] * 3}], "title": "a title"})
    path = tmp_path / "m.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    jobs.ingest_json(spark, str(path), str(tmp_path / "store"))
    return spark.read.parquet(str(tmp_path / "store"))


@pytest.mark.parametrize("rule", ["baseline", "deterministic", "hierarchical"])
def test_experiment(spark, mentions, tmp_path, rule):
    options = jobs.Options(rule=rule, canopies=("firstAndLast", "lastAndFirst1ofFirst"), model=hierarchy.Model(greedy=True))
    scores = jobs.experiment(mentions, str(tmp_path / rule), options, html=True).first()
    assert scores.gold_entities == 6
    assert scores.f1 == 1.0 if rule != "hierarchical" else scores.f1 > 0.7
    again = jobs.score_files(spark, str(tmp_path / rule / "predicted"), str(tmp_path / rule / "gold")).first()
    assert again.tp == scores.tp
    assert readers.tsv_pairs(spark, str(tmp_path / rule / "predicted")).count() == 18


def test_tasks(mentions):
    got = jobs.make_tasks(mentions, jobs.Options(canopies=("lastAndFirst1ofFirst",))).collect()
    assert [(r.canopy, r.n) for r in got] == [("LAST_lopez_FIRST_j", 9), ("LAST_lopez_FIRST_m", 9)]
