import hashlib
import json
import random
import re
from datetime import datetime
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktriage.functions import names
from sparktriage.functions.names import common_length, jaro_winkler, token_sort_ratio
from sparktriage.functions.quantiles import exact_medians
from sparktriage.operators import baseline, decisions, evaluation, features, graph, scoring, screening, slices, strategies, validation
from sparktriage.sources import files, transactions


def test_csv_source(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    p = tmp_path / "t.csv"
    p.write_text(head + "2022/01/01 00:00,BankA,ACC001,BankB,0002,500.0,USD,NA,USD,Wire,0\n")
    r = transactions.read_csv(spark, str(p)).first()
    assert (r.from_account, r.to_account, r.amount_paid, r.timestamp) == ("ACC001", "0002", None, datetime(2022, 1, 1))
    p.write_text(head)
    with pytest.raises(ValueError):
        transactions.read_csv(spark, str(p))


def test_csv_rows_are_numbered_in_file_order(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    for k in (1, 0):
        (tmp_path / f"{k}.csv").write_text(head + "".join(f"2022/01/01 00:00,B,{k * 3000 + i},B,X,1.0,USD,1.0,USD,Wire,0\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = transactions.read_csv(spark, str(tmp_path)).select("row_nr", "from_account").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.row_nr, int(r.from_account)) for r in got) == [(i, i) for i in range(6000)]
    seen = transactions.inspect(spark, str(tmp_path / "0.csv"), 2)
    assert seen["renamed"] == [("Account", "Account_duplicated_0")] and len(seen["rows"]) == 2 and len(seen["columns"]) == 11


def test_patterns_and_manifest(spark, tmp_path):
    p = tmp_path / "p.txt"
    p.write_text("BEGIN LAUNDERING ATTEMPT - FAN-OUT: max 3\n2022/01/01 00:00,B,A1,B,A2,1\n2022/01/01 00:00,B,A1,B,A3,1\nEND LAUNDERING ATTEMPT - FAN-OUT\nbegin  laundering attempt -  stack\r\n2022,B,Q,B,R,1\r\nEnd Laundering  Attempt\nBEGIN LAUNDERING ATTEMPT - CYCLE\n2022,B,Z,B,Y,1\n")
    assert sorted(map(tuple, files.block_patterns(spark, str(p)).collect())) == [("FAN-OUT", "A1"), ("FAN-OUT", "A2"), ("FAN-OUT", "A3"), ("stack", "Q"), ("stack", "R")]
    p.write_text("# note\n  # indented\nfan z, b\n\tring q\nfan c a\nlone\n\n")
    with pytest.warns(UserWarning, match="6"):
        got = {r.typology: r.account_ids for r in files.line_patterns(spark, str(p)).collect()}
    assert got == {"fan": ["z", "b", "c", "a"], "ring": ["q"]} and files.line_count(spark, str(p)) == 6
    m = files.Manifest(tmp_path / "sums", tmp_path)
    m.freeze(p)
    m.verify()
    with pytest.raises(ValueError):
        m.freeze(p)
    p.write_text("changed")
    with pytest.raises(ValueError):
        m.verify()
    m.freeze(p, force=True)
    m.verify()
    assert files.content_hashes(spark, str(p)).first().sha256 == next(iter(m.entries().values()))


def test_sinks(spark, tmp_path):
    rows = [(i, f"a{i}", "n", "u", "c", "exact", 1.0, 1.0, i < 20) for i in range(50)]
    truth = spark.createDataFrame(rows, files.GROUND_TRUTH.replace("gold_is_match string", "gold_is_match boolean"))
    m = files.Manifest(tmp_path / "sums", tmp_path)
    files.write_ground_truth(truth, tmp_path / "t.csv", m)
    m.verify()
    assert sorted(map(tuple, files.read_ground_truth(spark, str(tmp_path / "t.csv")).collect())) == rows
    with pytest.raises(ValueError):
        files.write_ground_truth(truth.where("row_id > 0"), tmp_path / "u.csv")
    cases = spark.createDataFrame([("c2", "a", None), ("c1", "b", ["1"])], "case_id string, account_id string, relevant_txn_ids array<string>")
    files.write_json_file(cases, tmp_path / "e.jsonl", "case_id")
    assert [json.loads(x)["case_id"] for x in (tmp_path / "e.jsonl").read_text().splitlines()] == ["c1", "c2"]
    assert sorted(r.case_id for r in files.json_lines(spark, str(tmp_path / "e.jsonl"), files.EVAL).collect()) == ["c1", "c2"]
    files.write_json(cases, f"{tmp_path}/d")
    files.write_parquet(cases, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == files.json_lines(spark, f"{tmp_path}/d", files.EVAL).count() == 2


def test_sanctions_xml(spark, tmp_path):
    name = lambda text, script: f'<DocumentedName><DocumentedNamePart><NamePartValue ScriptID="{script}">{text}</NamePartValue></DocumentedNamePart></DocumentedName>'
    p = tmp_path / "s.xml"
    p.write_text(f'<S><PartySubType ID="4" PartyTypeID="1"/><DistinctParty FixedRef="7"><Profile PartySubTypeID="4"><Identity><Alias Primary="true">{name("Ana Bell", 215)}</Alias><Alias Primary="false">{name("A. Bell", 215)}{name("x", 999)}</Alias></Identity></Profile></DistinctParty></S>')
    r = files.sanctions_xml(spark, str(p)).collect()
    assert [(x.uid, x.canonical_name, x.aka_names, x.entry_type) for x in r] == [("7", "Ana Bell", ["A. Bell"], "Individual")]
    assert {x.list_name for x in files.load_records(spark, str(p), str(p)).collect()} == {"SDN", "Consolidated"}
    assert files.load_records(spark, str(p), str(tmp_path / "none.xml")).count() == 1
    assert {x.name for x in files.raw_names(files.sanctions_xml(spark, str(p))).collect()} == {"Ana Bell", "A. Bell"}
    with pytest.raises(ValueError):
        screening.build_index(files.sanctions_xml(spark, str(p)).where("false"))


def test_names(spark):
    assert token_sort_ratio("keller anna maria", "anna maria keller") == 1.0
    assert round(jaro_winkler("anna bell", "anna bel"), 6) == round(0.9629629629629629 + 0.4 * (1 - 0.9629629629629629), 6)
    assert common_length("abcde", "ace") == 3
    c = spark.createDataFrame([("o'neil 3rd ann",)], "n string").select(names.title_case(F.col("n")).alias("t"), names.replace_at(F.col("n"), F.lit(1), F.lit("u")).alias("r"), names.swap_adjacent(F.col("n"), 3).alias("s")).first()
    assert (c.t, c.r, c.s) == ("O'Neil 3Rd Ann", "u'neil 3rd ann", "o'enil 3rd ann")


def test_many_pairs_at_once():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, n))).strip()
    pairs = [(word(12), word(14)) for _ in range(600)] + [("", ""), ("a", ""), ("ab " * 40, "ba " * 41), ("same", "same"), ("a" * 63, "a" * 64), ("a" * 64, "b" + "a" * 63)]
    a, b = zip(*pairs, strict=True)
    assert np.allclose(names.jaro_winkler_pairs(a, b), [jaro_winkler(x, y) for x, y in pairs])
    assert names.common_lengths(a, b).tolist() == [common_length(x, y) for x, y in pairs]
    assert np.allclose(names.token_sort_pairs(a, b), [token_sort_ratio(x, y) for x, y in pairs])
    clean = sorted({" ".join(x.split()) for p in pairs for x in p} - {""})
    clean += ["b" * 256 + "xd", "b" * 256 + "dx", "ab " * 90 + "c"]  # more equal letters than a byte counts
    alphabet = {ord(c): i for i, c in enumerate("abcde ")}  # one letter is left to the last column
    count, size = names.letter_counts(clean, alphabet), np.array([len(x) for x in clean])
    bound = names.score_bounds(count, size, names.starts(clean, -1), count, size, names.starts(clean, -2))
    some = [*range(120), *range(len(clean) - 3, len(clean))]
    for i in some:
        score = names.best_of_both([clean[i]] * len(clean), clean)
        assert (bound[i] >= score).all()
        assert (names.pair_bounds([clean[i]] * len(clean), clean) >= score).all()


def invented(rng, n):
    """Names of two or three words of two or three syllables."""
    part = lambda: "".join(rng.choice("b d f g h k l m n r s t v z sh kr".split()) + rng.choice("a e i o u an en ar er al".split()) for _ in range(rng.choice([2, 2, 3])))
    given, family = [part() for _ in range(150)], [part() for _ in range(600)]
    return [" ".join([rng.choice(given) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(family)]) for _ in range(n)]


def spoiled(rng, x):
    """One to three letters swapped, dropped, doubled or replaced, or the words turned."""
    for _ in range(rng.randrange(1, 4)):
        k, how = rng.randrange(len(x) - 1), rng.randrange(5)
        x = (x[:k] + x[k + 1] + x[k] + x[k + 2 :], x[:k] + x[k + 1 :], x[:k] + x[k] + x[k:], x[:k] + rng.choice("aeiosz") + x[k + 1 :], " ".join(reversed(x.split())))[how]
    return " ".join(x.split()) or "a"


@pytest.mark.parametrize(("limit", "share", "n"), [(0.85, 0.02, 250), (0.72, 1, 40)])
def test_near_names_lose_no_pair(spark, limit, share, n):
    """Candidates are a small part of all pairs, and hold every pair within the limit."""
    rng = random.Random(6)
    listed = invented(rng, n)
    own = invented(rng, n // 2) + [spoiled(rng, rng.choice(listed)) for _ in range(n)] + listed[:10] + ["a", "ab", "ba", "\u00e9l\u00e4"]
    listed += ["a", "b", "ab", "abc", "\u00e9la", "x" * 30, "mary " * 12 + "jo", "mary " * 13 + "jo", "q" * 300]
    own += ["x" * 29, "mary " * 12 + "oj", "jo " + "mary " * 11 + "mary", "q" * 280 + "r" * 40, "xy" * 40]
    own, listed = sorted({x.strip() for x in own}), sorted({x.strip() for x in listed})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    want = {(x, y) for x in own for y, s in zip(listed, names.best_of_both([x] * len(listed), listed).tolist(), strict=True) if s >= limit}
    got = screening.near_names(frame(own * 2, "norm"), frame(listed, "other"), limit).collect()
    assert {(r.norm, r.other) for r in got} == want and len(got) == len(want) > n
    assert share == 1 or screening.candidate_pairs(frame(own, "norm"), frame(listed, "other"), limit).count() <= share * len(own) * len(listed)


def test_best_scores_by_branch_and_bound(spark):
    rng = random.Random(8)
    listed = invented(rng, 200)
    records = spark.createDataFrame([(f"U{k % 150:03}", x, [listed[k - 1]], "SDN") for k, x in enumerate(listed)] + [(None, "null uid", None, "SDN")], "uid string, canonical_name string, aka_names array<string>, list_name string")
    own = [spoiled(rng, x) for x in listed[:60]] + invented(rng, 60) + listed[:5] + ["0", "zzz 123", "null uid"]
    index = screening.build_index(records).select("norm", "uid").collect()
    names_ = spark.createDataFrame([(x,) for x in own], "norm string")
    for floor, most in ((0.0, 50_000), (0.0, 37), (0.8, 50_000)):
        got = {r.norm: (r.score, r.uid) for r in screening.best_scores(names_, records, floor, most).collect()}
        assert set(got) == set(own)
        for x in own:
            score = names.best_of_both([x] * len(index), [r.norm for r in index])
            top = score.max()
            if top < floor:
                assert got[x] == (0.0, None)
            else:
                assert got[x] == (top, min((r.uid is None, r.uid or "") for r, v in zip(index, score, strict=True) if v == top)[1] or None)


def test_medians(spark):
    rng = random.Random(7)
    rows = [(float(rng.choice([0, 0, 1, rng.random() * 100])), rng.random() if i % 3 else None, None) for i in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = {"a": median(r[0] for r in rows), "b": median(r[1] for r in rows if r[1] is not None), "c": None}
    for at_once in (1 << 20, 10):
        got = exact_medians(df, ["a", "b", "c"], at_once)
        assert got["c"] is None and all(abs(got[k] - want[k]) < 1e-12 for k in "ab")


def test_leak_guard(tmp_path):
    with pytest.raises(ValueError, match="pattern_label"):
        features.guard(["amount_mean", "pattern_label"])
    at = tmp_path / "new" / "x.log"
    assert len(features.log_excluded(at)) == 11 == len(at.read_text().splitlines()) and at.read_text()[:2] == "20"


def test_leak_guard_looks_at_the_input(spark):
    tx = spark.createDataFrame([("A", "B", 1.0, 1.0, 0, 5)], "from_account string, to_account string, amount_paid double, amount_received double, is_laundering int, row_nr long").withColumn("timestamp", F.lit("2022-01-01 10:00:00").cast("timestamp_ntz"))
    assert "is_laundering" not in features.clean_input(tx).columns
    with pytest.raises(ValueError, match="kyc_risk"):
        features.feature_matrix(tx.withColumn("kyc_risk", F.lit("low")), tx.select(F.col("from_account").alias("account_id")))


def test_features_in_one_aggregate(spark):
    """One scan gives what the four parts give; hubs, self-transfers, null counterparties and accounts without outbound legs are there."""
    rng = random.Random(9)
    rows = [(k, f"2022-01-{rng.randrange(1, 28):02} {rng.randrange(24):02}:{rng.randrange(60):02}:00", rng.choice(["hub", "a", "b", "c", None]), rng.choice(["hub", "x", "y", "a", "z", None]), rng.choice([1000.0, 12.5, 3000.4, 7.0])) for k in range(400)]
    tx = spark.createDataFrame(rows, "row_nr long, t string, from_account string, to_account string, amount_paid double").select("row_nr", F.col("t").cast("timestamp_ntz").alias("timestamp"), "from_account", "to_account", "amount_paid", (F.col("amount_paid") * 2).alias("amount_received"))
    one = features.account_aggregates(tx).where("account_id is not null")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    got = {r.account_id: r.asDict() for r in one.collect()}
    for part in (features.outbound(tx), features.inbound(tx), features.timing(tx), features.hour_entropy(tx)):
        for r in part.where("account_id is not null").collect():
            for k, v in r.asDict().items():
                if k in got[r.account_id]:
                    w = got[r.account_id][k]
                    assert v == w or abs(v - w) < 1e-9 or v != v and w != w, (r.account_id, k, v, w)
    assert got["z"]["outbound_count"] == 0 and got["z"]["amount_mean"] is None


def test_percentiles(spark):
    p = lambda xs: [r.percentile for r in scoring.percentiles(spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(xs)], "account_id string, score double")).orderBy("account_id").collect()]
    assert p([2, 0, 0]) == [1.0, 0.5, 0.5]
    assert p([5]) == [1.0]
    assert p([]) == []


def test_hop2_keeps_fifty(spark):
    rows = [("HUB", f"R{i}") for i in range(5)] + [(f"R{i}", f"L{i}{j:02d}") for i in range(5) for j in range(15)]
    tx = spark.createDataFrame(rows, "from_account string, to_account string")
    far = graph.hop2(graph.edges(tx), spark.createDataFrame([("HUB",)], "account_id string"))
    assert sorted(r.cp for r in far.collect()) == sorted(t for _, t in rows[5:])[:50]


def test_hop2_by_plain_sets(spark):
    rng = random.Random(9)
    rows = [(f"N{int(rng.paretovariate(0.6)) % 60:02d}", f"N{rng.randrange(60):02d}") for _ in range(260)]
    e = {(a, b) for x, y in rows if x != y for a, b in ((x, y), (y, x))}
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(b)
    want = {(a, c) for a in near for c in sorted({c for b in near[a] for c in near[b]} - near[a] - {a})[:4]}
    tx = spark.createDataFrame(rows, "from_account string, to_account string")
    got = graph.hop2(graph.edges(tx), spark.createDataFrame([(a,) for a in near], "account_id string"), 4)
    assert {(r.account, r.cp) for r in got.collect()} == want


def cases_of(spark):
    rows = [("SH", 0.95, None, None), ("R3", None, 3, None), ("AN", None, 2, 0.92), ("EL", None, None, 0.87), ("CL", None, None, None), ("B9", 0.90, None, 0.5), ("B8", None, 2, 0.89)]
    schema = "case_id string, account_id string, max_hit double, max_sev int, sev3_ids array<string>, percentile double, score double, is_flagged boolean, latency_ms double"
    return spark.createDataFrame([(c, f"a{c}", h, s, ["X", "Y"] if s == 3 else [], p, 1.0, False, 1.0) for c, h, s, p in rows], schema)


def test_policy_branches_and_strategies(spark):
    cases = cases_of(spark)
    got = {r.case_id: (r.disposition, r.decision_reason, r.human_review) for r in decisions.policy(cases).collect()}
    assert got["SH"] == got["R3"] == got["B9"] == ("ESCALATE", "sanctions_or_critical_rule", False)
    assert got["AN"] == ("ESCALATE", "agent_anomaly_plus_elevated_rule", True)
    assert got["EL"] == got["B8"] == ("CLEAR", "clear", True) and got["CL"] == ("CLEAR", "clear", False)
    base = decisions.decision_table(cases)
    assert {r.case_id for r in decisions.overrides(decisions.policy(cases), base).where("agent_override").collect()} == {"AN"}
    with pytest.raises(Exception, match="no baseline"):
        decisions.overrides(decisions.policy(cases), base.where("case_id <> 'EL'")).select("case_id").collect()
    ready = base.withColumnRenamed("disposition", "baseline_disposition").drop("decision_reason")
    results, errors = strategies.run_all(ready)
    row = strategies.agreement(results, 3, errors).first()
    assert row.passed and not errors and len(row) == 10 and strategies.disagreements(results).isEmpty()
    assert {r.bad for r in strategies.invariants(results, ready).collect()} == {0}

    class Broken:
        framework_name = "broken"

        def run(self, cases):
            return cases.where(F.raise_error(F.lit("late")).cast("boolean"))

    results, errors = strategies.run_all(ready, [*strategies.REGISTRY, Broken])
    assert list(errors) == ["broken"] and results.count() == 21 and not strategies.agreement(results, 3, errors).first().passed
    assert strategies.agreement(results.where("false"), 3).first().passed


def test_agreement_and_invariants_name_what_is_wrong(spark):
    ready = decisions.decision_table(cases_of(spark)).withColumnRenamed("disposition", "baseline_disposition").drop("decision_reason")
    good = strategies.run_one(strategies.ColumnStrategy, ready)
    other = strategies.run_one(strategies.SqlStrategy, ready)
    odd = lambda on, c, v: other.withColumn(c, F.when(F.col("case_id") == on, F.lit(v)).otherwise(F.col(c)))
    flag = lambda df: {k for k, v in strategies.agreement(good.unionByName(df), 2).first().asDict().items() if v is False}
    assert flag(odd("CL", "reasoning", None)) == {"reasoning_agree", "passed"} and flag(odd("CL", "agent_override", True)) == {"override_agree", "passed"}
    assert flag(odd("CL", "cost_usd", 0.1)) == {"costs_zero", "passed"} and flag(odd("CL", "tokens_used", 5)) == {"tokens_zero", "passed"}
    assert flag(other.where("case_id <> 'CL'")) == {"case_ids_agree", "case_order_agree", "passed"}
    assert flag(other.unionByName(other.where("case_id = 'CL'"))) == {"case_order_agree", "passed"}
    assert [tuple(r)[:2] for r in strategies.disagreements(good.unionByName(odd("CL", "disposition", "?"))).collect()] == [("CL", "disposition")]
    broken = lambda df: {r.check for r in strategies.invariants(df, ready, "columns").where("bad > 0").collect()}
    assert broken(good.where("case_id <> 'CL'")) == {"count", "missing"} and broken(good.unionByName(good.where("case_id = 'CL'"))) == {"count", "duplicates"}
    assert broken(good.withColumn("account_id", F.lit(" "))) == {"empty"} and broken(good.withColumn("framework", F.lit("x"))) == {"framework"}
    assert broken(good.withColumn("case_id", F.when(F.col("case_id") == "CL", "new").otherwise(F.col("case_id")))) == {"missing", "extra"}
    with pytest.raises(ValueError, match="columns: tokens"):
        strategies.require_invariants(good.withColumn("tokens_used", F.lit(1)), ready, "columns")
    assert strategies.versions(("pyspark", "no-such-package"))["no-such-package"] == "unknown"


def test_baseline_run(spark):
    tx = spark.createDataFrame([(i, datetime(2022, 1, 1, i), "A", f"r{i}", 8950.0, 8950.0, 0) for i in range(4)], "row_nr long, timestamp timestamp_ntz, from_account string, to_account string, amount_paid double, amount_received double, is_laundering int")
    own = spark.createDataFrame([("A", "anna bell", "US", "low"), ("r0", "carl  DUNN", "IR", "low")], "account_id string, name string, country string, kyc_risk string")
    index = screening.build_index(spark.createDataFrame([("7", "Carl Dunn", [], "SDN")], "uid string, canonical_name string, aka_names array<string>, list_name string"))
    labels = spark.createDataFrame([("A", "STACK")], "account_id string, label string")
    cases = spark.createDataFrame([("1", "A"), ("2", "r0")], "case_id string, account_id string")
    got = {r.case_id: r for r in baseline.run_baseline(cases, tx, own, index, labels).collect()}
    assert (got["1"].max_sev, got["1"].sev3_ids, got["1"].max_hit, got["1"].pattern_label, got["1"].disposition) == (3, ["STRUCT_001"], None, "STACK", "ESCALATE")
    assert (got["2"].max_hit, got["2"].hits[0].uid, got["2"].max_sev, got["2"].hop1) == (1.0, "7", 1, ["A"])
    with pytest.raises(Exception, match="no identity"):
        baseline.run_baseline(cases, tx, own.where("account_id = 'A'"), index).select("case_id").collect()
    with pytest.raises(ValueError):
        baseline.require_results(cases.limit(1), cases)


def records_of(spark):
    given, family = ["Ahmad", "José", "Khalil", "Phoebe", "Ulrich", "Soumaya", "Rachel", "Olga"], ["Bakhoury", "Müller", "Ouellet", "Philips", "Castellano", "Brandt"]
    return spark.createDataFrame([(f"u{i}{j}", f"{g} {f}", [], "Individual", "SDN") for i, g in enumerate(given) for j, f in enumerate(family)], "uid string, canonical_name string, aka_names array<string>, entry_type string, list_name string")


def test_derived_names(spark):
    records = records_of(spark)
    raw = {r.canonical_name for r in records.collect()}
    norm = {" ".join(names.plain(x).lower().split()) for x in raw}
    got = slices.true_positives(records).collect()
    assert {r.flavor for r in got} == set(slices.BOUNDS)
    for r in got:
        x, y = (" ".join(names.plain(s).lower().split()) for s in (r.spelling, r.canonical_name))
        assert abs(r.score - max(jaro_winkler(x, y), token_sort_ratio(x, y))) < 1e-9 and r.score >= slices.BOUNDS[r.flavor] and r.spelling not in raw
        assert r.flavor in ("exact", "partial_reorder") or x not in norm
        assert r.flavor != "exact" or (r.spelling == names.plain(r.canonical_name) != r.canonical_name)
    given = ["karl", "achim", "anna", "olaf", "rahel", "uli", "jos", "phil", "khaled", "sumaya", "elga", "alrich"]
    for r in slices.near_misses(records, given).collect():
        x = " ".join(names.plain(r.spelling).lower().split())
        every = [max(jaro_winkler(x, n), token_sort_ratio(x, n)) for n in norm]
        assert 0.80 <= r.score <= 0.88 and max(every) < 0.90 and r.spelling.split()[-1].lower() == names.plain(r.canonical_name).lower().split()[-1]
    accounts = spark.createDataFrame([(f"a{i}",) for i in range(60)], "account_id string")
    truth = slices.fixtures(accounts, records, given, each=2, near=3)
    assert [truth.where("gold_is_match").count(), truth.count(), truth.select("account_id").distinct().count()] == [8, 11, 11]
    own = slices.identity_overlay(accounts, ["Olga", "Karl"], ["Brandt", "Maier"], ["US", "DE"], "s", records, truth).collect()
    fixed = {r.account_id: r.assigned_name for r in truth.collect()}
    assert len(own) == 60 and all(r.name == fixed.get(r.account_id, r.name) for r in own)
    assert all("Brandt" not in r.name or r.account_id in fixed for r in own if r.name.startswith("Olga")) and len({r.name for r in own}) > 3
    with pytest.raises(ValueError, match="on the list"):
        screening.require_disjoint(spark.createDataFrame([("Olga Brandt",)], "name string"), files.raw_names(records))


def test_overlay_redraws_and_fixtures(spark):
    """Accounts draw until their name is clear of the list; fixtures of any number keep theirs."""
    given, family = [f"Anna{c}" for c in "bdfgk"], ["Keller", "Moreau", "Brandt"]
    records = spark.createDataFrame([("U1", "Annab Keller", ["Annad Moreau"], "SDN"), ("U2", "Annaf Keler", None, "SDN")], "uid string, canonical_name string, aka_names array<string>, list_name string")
    index = screening.build_index(records)
    accounts = spark.range(0, 20_000).select(F.col("id").cast("string").alias("account_id"))
    truth = accounts.where("cast(account_id as int) % 5 < 3").select("account_id", F.concat(F.lit("Fixture "), "account_id").alias("assigned_name"))
    got = {r.account_id: r.name for r in slices.identity_overlay(accounts, given, family, ["US"], "s", records, truth).collect()}
    assert len(got) == 20_000 and all((got[str(k)] == f"Fixture {k}") == (k % 5 < 3) for k in range(20_000))
    bad = {r.name for r in slices.colliding_names(spark.createDataFrame([(f"{g} {f}",) for g in given for f in family], "name string"), index).collect()}
    assert {"Annab Keller", "Annad Moreau"} <= bad and 2 < len(bad) < 15
    drawn = lambda k, i: " ".join(xs[int(hashlib.md5(f"{k}|s{c}{i}".encode()).hexdigest()[:8], 16) % len(xs)] for c, xs in (("g", given), ("f", family)))
    for k in range(3, 20_000, 5):
        assert got[str(k)] == next(x for i in range(200) if (x := drawn(k, i)) not in bad)
    none = slices.drawn_names(accounts.limit(3), ["Annab"], ["Keller"], "s", index, draws=5).collect()
    assert all(re.fullmatch(r"Annab Keller \d{4}", r.name) for r in none)
    with pytest.raises(ValueError, match="fixtures"):
        slices.identity_overlay(accounts, given, family, ["US"], "s", records, truth.union(truth))


def test_small_helpers(spark, tmp_path):
    cases = spark.createDataFrame([("c1", "ESCALATE"), ("c2", "CLEAR")], "case_id string, gold_label string")
    results = spark.createDataFrame([("c1", "CLEAR", 1.0)], "case_id string, disposition string, latency_ms double")
    assert {tuple(r) for r in evaluation.joined_leniently(cases, results).select("case_id", "disposition").collect()} == {("c1", "CLEAR"), ("c2", None)}
    pair = spark.createDataFrame([("  \u00c9va  Keller", "keller eva")], "a string, b string").select(names.score_names(F.col("a"), F.col("b")).alias("s")).first()
    assert pair.s == 1.0
    (tmp_path / "m.json").write_text('{"accuracy": 0.75}')
    assert strategies.prior_accuracy(tmp_path / "m.json") == 0.75 and strategies.prior_accuracy(tmp_path / "none.json") == 0.0


def test_eval_set_refuses_short_pools(spark):
    state = spark.createDataFrame([(f"a{i}", [0, 1, 2, 3][i % 4], "R", i % 5 == 0, 0.5) for i in range(40)], "account_id string, max_sev int, top_rule string, is_flagged boolean, percentile double")
    truth = spark.createDataFrame([(i, f"a{i}", "exact", 0.95, 1.0, i < 3) for i in range(6)], "row_id int, account_id string, match_flavor string, expected_score_min double, expected_score_max double, gold_is_match boolean")
    senders, recent = state.select("account_id"), spark.createDataFrame([("a0", "1;2")], "account string, txn_ids string")
    patterns = spark.createDataFrame([("FAN-OUT", f"a{i}") for i in range(40)], "typology string, account_id string")
    t = slices.Targets(2, 2, 2, {"fan_out": 2}, {"anomaly_no_rule": 1, "rule_no_anomaly": 1, "rule3_no_anomaly": 1})
    got = slices.eval_set(truth, state, senders, patterns, recent, t)
    slices.require_eval_set(got, state, t.total)
    assert got.select("account_id").distinct().count() == t.total == 15 and got.where("case_type = 'sanctions_hit'").first().relevant_txn_ids == "1;2"
    with pytest.raises(ValueError, match="without an identity"):
        slices.require_eval_set(got, state.where("account_id <> 'a0'"), t.total)
    with pytest.raises(ValueError, match="sanctions_hit"):
        slices.eval_set(truth, state, senders, patterns, recent, slices.Targets())


def test_metrics_and_join(spark):
    schema = "case_id string, gold_label string, case_type string, severity_band int, conflict_type string"
    cases = spark.createDataFrame([("a", "ESCALATE", "ibm_labeled", 3, None), ("b", "ESCALATE", "ibm_labeled", 1, None)], schema)
    res = lambda **k: spark.createDataFrame([(c, d, 1.0) for c, d in k.items()], "case_id string, disposition string, latency_ms double")
    m = lambda r: evaluation.metrics(evaluation.joined(cases, r)).first().weighted_false_clear
    assert m(res(a="CLEAR", b="ESCALATE")) == 0.75 and m(res(a="ESCALATE", b="CLEAR")) == 0.25
    with pytest.raises(Exception, match="one to one"):
        m(res(a="CLEAR"))
    with pytest.raises(Exception, match="one to one"):
        evaluation.joined(cases, res(a="CLEAR")).select("case_id").collect()
    few = evaluation.framework_metrics(res(a="CLEAR").withColumn("framework", F.lit("f")), cases).first()
    assert (few.accuracy, few.weighted_false_clear, few.eval_size) == (0.0, 0.75, 1)


def test_gate_names_every_failure(spark):
    tx = spark.createDataFrame([("a", None, 1.0, 0)], "from_account string, to_account string, amount_received double, is_laundering int")
    acc = spark.createDataFrame([("a",)], "account_id string")
    report = validation.validation_report(tx, acc, required=("from_account", "x"), rows=2, n_accounts=1, tolerance=0, ratio=0.0, ratio_tolerance=0.1)
    with pytest.raises(ValueError) as e:
        validation.gate(report)
    assert [x.split(":")[0] for x in str(e.value).split("; ")] == ["schema", "no_nulls_in_keys", "null_counts", "row_count"]


def test_streaming_fan_out(spark, tmp_path):
    from sparktriage.streaming.rules import streaming_fan_out

    rows = [{"timestamp": f"2022-01-01T00:0{i}:00", "from_account": "S", "to_account": f"r{i}"} for i in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    s = spark.readStream.schema("timestamp timestamp_ntz, from_account string, to_account string").json(str(tmp_path / "in"))
    q = streaming_fan_out(s).writeStream.outputMode("update").format("memory").queryName("fan").start()
    q.processAllAvailable()
    q.stop()
    assert {r.receivers for r in spark.table("fan").collect()} == {6}
