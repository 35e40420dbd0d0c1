"""The command lines end to end on small files."""

import json
import random

import pytest

from sparktriage import cli
from sparktriage.sources import files

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


@pytest.fixture
def files_in(spark, tmp_path):
    rows = [f"2022/01/01 0{i}:00,B,A,B,r{i},8950,USD,8950,USD,Wire,1\n" for i in range(4)] + ["2022/01/02 00:00,B,q,B,A,10,USD,10,USD,Wire,0\n"]
    (tmp_path / "tx.csv").write_text(HEAD + "".join(rows))
    (tmp_path / "patterns.txt").write_text("BEGIN LAUNDERING ATTEMPT - STACK\n2022,B,A,B,r0,1\nEND LAUNDERING ATTEMPT\n")
    name = lambda text: f'<DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">{text}</NamePartValue></DocumentedNamePart></DocumentedName>'
    (tmp_path / "list.xml").write_text(f'<S><PartySubType ID="4" PartyTypeID="1"/><DistinctParty FixedRef="7"><Profile PartySubTypeID="4"><Identity><Alias Primary="true">{name("Carl Dunn")}</Alias></Identity></Profile></DistinctParty></S>')
    spark.createDataFrame([("A", "anna bell", "US", "low"), ("q", "Dunn CARL", "DE", "low")], "account_id string, name string, country string, kyc_risk string").write.parquet(f"{tmp_path}/overlay")
    case = lambda c, a, g: json.dumps({"case_id": c, "account_id": a, "gold_label": g, "case_type": "ibm_labeled"})
    (tmp_path / "cases.jsonl").write_text(f"{case('1', 'A', 'ESCALATE')}\n{case('2', 'q', 'CLEAR')}\n")
    return tmp_path


def test_commands(spark, files_in, capsys):
    at = lambda n: str(files_in / n)
    cli.main(["validate", "--transactions", at("tx.csv"), "--rows", "5", "--accounts", "6", "--ratio", "0.8"], spark)
    with pytest.raises(ValueError, match="row_count"):
        cli.main(["validate", "--transactions", at("tx.csv"), "--rows", "6", "--accounts", "6", "--ratio", "0.8"], spark)
    cli.main(["freeze", "--manifest", at("sums"), "--root", str(files_in), at("cases.jsonl")])
    cli.main(["verify", "--manifest", at("sums"), "--root", str(files_in)])
    run = ["baseline", "--cases", at("cases.jsonl"), "--transactions", at("tx.csv"), "--overlay", at("overlay"), "--patterns", at("patterns.txt"), "--watchlist", at("list.xml"), "--second", at("none.xml"), "--manifest", at("sums"), "--root", str(files_in), "--out", at("results")]
    cli.main([*run, "--expected", "2"], spark)
    got = {r.case_id: r for r in spark.read.parquet(at("results")).collect()}
    assert (got["1"].disposition, got["1"].sev3_ids, got["1"].pattern_label) == ("ESCALATE", ["STRUCT_001"], "STACK")
    assert (got["2"].disposition, got["2"].max_hit) == ("ESCALATE", 1.0)
    with pytest.raises(ValueError, match="wanted"):
        cli.main([*run, "--expected", "3"], spark)
    cli.main(["metrics", "--cases", at("cases.jsonl"), "--results", at("results"), "--out", at("metrics.json")], spark)
    assert json.loads((files_in / "metrics.json").read_text())["accuracy"] == 0.5
    cli.main(["compare", "--results", at("results"), "--cases", at("cases.jsonl"), "--expected", "2"], spark)
    cli.main(["triage", "--results", at("results")], spark)
    cli.main(["inspect", "--transactions", at("tx.csv")], spark)
    assert "Account_duplicated_0" in capsys.readouterr().out
    (files_in / "cases.jsonl").write_text("changed")
    with pytest.raises(ValueError, match="changed"):
        cli.main(["verify", "--manifest", at("sums"), "--root", str(files_in)])


def test_identities_cases_and_phase(spark, tmp_path):
    """Ground truth and overlay from a list, the evaluation set from them, and the metrics of a policy over a baseline."""
    at = lambda n: str(tmp_path / n)
    name = lambda text: f'<DocumentedName><DocumentedNamePart><NamePartValue ScriptID="215">{text}</NamePartValue></DocumentedNamePart></DocumentedName>'
    rng, syllables = random.Random(4), [a + b for a in "b d f g k l m n r s t v".split() for b in ("a", "e", "i", "o", "ai", "ou")]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()
    party = lambda k: f'<DistinctParty FixedRef="{k}"><Profile PartySubTypeID="4"><Identity><Alias Primary="true">{name(f"{word(2)}\u00e9 {word(2)} {word(3)}")}</Alias></Identity></Profile></DistinctParty>'
    (tmp_path / "list.xml").write_text(f'<S><PartySubType ID="4" PartyTypeID="1"/>{"".join(map(party, range(400)))}</S>')
    days = lambda k: f"2022/01/{1 + k % 20:02} {k % 24:02}:00"
    rows = [f"{days(k)},B,a{k % 200:03},B,a{k * 7 % 200:03},{8950 if k % 3 else 12},USD,{8950 if k % 3 else 12},USD,Wire,{k % 2}\n" for k in range(1500)]
    (tmp_path / "tx.csv").write_text(HEAD + "".join(rows))
    (tmp_path / "patterns.txt").write_text("BEGIN LAUNDERING ATTEMPT - FAN-OUT\n" + "".join(f"2022,B,a{k:03},B,a{k + 1:03},1\n" for k in range(0, 190, 2)) + "END LAUNDERING ATTEMPT\n")
    spark.createDataFrame([(f"a{k:03}",) for k in range(200)], "account_id string").write.parquet(at("accounts"))
    given = ",".join(word(2) for _ in range(60))
    kept = ["--manifest", at("sums"), "--root", str(tmp_path)]
    cli.main(["identities", "--accounts", at("accounts"), "--watchlist", at("list.xml"), "--given", given, "--family", "Keller,Moreau,Brandt", "--countries", "US,DE", "--overlay-out", at("overlay"), "--truth-out", at("truth.csv"), *kept], spark)
    truth = files.read_ground_truth(spark, at("truth.csv")).collect()
    named = {r.account_id: r.name for r in spark.read.parquet(at("overlay")).collect()}
    assert len(named) == 200 and [sum(r.gold_is_match for r in truth), len(truth)] == [20, 50] and all(named[r.account_id] == r.assigned_name for r in truth)
    targets = {"hit": 3, "near_miss": 1, "band": 2, "typologies": {"fan_out": 2}, "conflicts": {"rule3_no_anomaly": 1}}
    make = ["cases", "--transactions", at("tx.csv"), "--overlay", at("overlay"), "--truth", at("truth.csv"), "--patterns", at("patterns.txt"), "--out", at("eval.jsonl"), *kept]
    cli.main([*make, "--targets", json.dumps(targets | {"near_miss": 0, "band": 0, "conflicts": {}})], spark)
    with pytest.raises(ValueError, match="frozen"):
        cli.main([*make, "--targets", json.dumps(targets | {"near_miss": 0, "band": 0, "conflicts": {}})], spark)
    with pytest.raises(ValueError, match="wanted"):
        cli.main(make, spark)
    files.Manifest(tmp_path / "sums", tmp_path).verify()
    made = files.json_lines(spark, at("eval.jsonl"), files.EVAL).collect()
    assert sorted(r.case_type for r in made) == ["sanctions_hit"] * 3 + ["typology"] * 2 and all(r.relevant_txn_ids for r in made)
    told = [(r.case_id, "ESCALATE" if k else "CLEAR", 1.5 * k, k == 1, k < 2, 0.0, 0) for k, r in enumerate(made)]
    spark.createDataFrame(told, "case_id string, disposition string, latency_ms double, agent_override boolean, human_review boolean, cost_usd double, tokens_used long").write.parquet(at("policy"))
    (tmp_path / "base.json").write_text('{"accuracy": 0.5, "weighted_false_clear": 0.25}\n')
    cli.main(["phase", "--cases", at("eval.jsonl"), "--results", at("policy"), "--baseline", at("base.json"), "--out", at("phase.json")], spark)
    got = json.loads((tmp_path / "phase.json").read_text())
    assert (got["accuracy"], got["delta_accuracy"], got["review_rate"], got["override_rate"], got["baseline_accuracy"], got["eval_size"]) == (0.8, 0.3, 0.4, 0.2, 0.5, 5)
