"""Evaluation slices by seeded hash order, conflict pools, derived names, ground truth and a synthetic identity overlay."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import last_token, normalize_name, replace_at, replace_first, reversed_tokens, score_udf, strip_marks, title_case
from ..sources.files import raw_names
from ..sources.tables import written
from .decisions import inline_gold
from .screening import build_index, near_names, surname_collisions


def draw_key(c: Column, seed: str) -> Column:
    """An order that any engine can repeat: md5 of id and seed."""
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def sample(pool: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement in seeded hash order; a short pool is the caller's to notice."""
    return pool.orderBy(draw_key(F.col(key), seed), key).limit(n)


def conflict_pools(cases: DataFrame) -> DataFrame:
    """account_id, conflict_type of accounts whose rules and score disagree; a null severity is 0."""
    sev, flag = F.coalesce("max_sev", F.lit(0)), F.coalesce("is_flagged", F.lit(False))
    kind = F.when(flag & (sev < 2), "anomaly_no_rule").when(~flag & (sev == 2), "rule_no_anomaly").when(~flag & (sev >= 3), "rule3_no_anomaly")
    return cases.withColumn("conflict_type", kind).where("conflict_type is not null").select("account_id", "conflict_type")


def stratified(pool: DataFrame, by: str, key: str, targets: dict[str, int], seed: str) -> DataFrame:
    """The first targets[v] rows of each stratum v in seeded hash order."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(draw_key(F.col(key), seed), key))
    want = F.create_map(*[F.lit(x) for v in targets.items() for x in v])
    return pool.withColumn("__k", k).where(F.col("__k") <= F.coalesce(F.element_at(want, F.col(by)), F.lit(0))).drop("__k")


def typology_key(c: Column) -> Column:
    return F.lower(F.translate(F.trim(c), "- ", "__"))


# fixed values: how many cases of each kind
TYPOLOGIES = {"fan_out": 3, "fan_in": 3, "cycle": 3, "scatter_gather": 3, "bipartite": 2, "stack": 2, "gather_scatter": 2, "random": 2}
CONFLICTS = {"anomaly_no_rule": 4, "rule_no_anomaly": 4, "rule3_no_anomaly": 2}


@dataclass(frozen=True)
class Targets:
    hit: int = 15
    near_miss: int = 15
    band: int = 10
    typologies: Mapping[str, int] = field(default_factory=lambda: dict(TYPOLOGIES))
    conflicts: Mapping[str, int] = field(default_factory=lambda: dict(CONFLICTS))

    @property
    def total(self) -> int:
        return self.hit + self.near_miss + 3 * self.band + sum(self.typologies.values()) + sum(self.conflicts.values())


EVAL_COLUMNS = "case_id string, account_id string, gold_label string, case_type string, typology string, severity_band int, conflict_type string, notes string"
_TAKEN = "slice int, " + EVAL_COLUMNS


def slice_plan(t: Targets) -> list[tuple[str, int]]:
    """What is taken, in order: names of the slices with their targets."""
    bands = [(f"ibm_labeled band {b}", t.band) for b in (3, 2, 1)]
    return [("sanctions_hit", t.hit), ("sanctions_near_miss", t.near_miss), *bands, *[(f"typology {k}", n) for k, n in t.typologies.items()], *[(f"conflict {k}", n) for k, n in t.conflicts.items()]]


def _pools(truth: DataFrame, state: DataFrame, senders: DataFrame, patterns: DataFrame, t: Targets, seed: str) -> DataFrame:
    """Every account that a slice may take, with the case it would make: slice, first and then (the order inside the slice), and the case's columns."""
    sev, flag, top = F.coalesce("max_sev", F.lit(0)), F.coalesce("is_flagged", F.lit(False)), F.coalesce("top_rule", F.lit("none"))
    at = {name: k for k, (name, _) in enumerate(slice_plan(t))}
    numbered = lambda kind, c, names: F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, at[f"{kind} {n}"])]), c)
    none = lambda kind: F.lit(None).cast(kind)

    def pool(df, number, salt, prefix, gold, kind, notes, typology=none("string"), band=none("int"), conflict=none("string"), first=F.lit(0)):
        return df.select(
            number.cast("int").alias("slice"), first.cast("long").alias("first"), F.md5(F.concat("account_id", F.lit("|"), salt).cast("binary")).alias("then"), F.concat(prefix, F.lit("_"), "account_id").alias("case_id"), "account_id",
            gold.alias("gold_label"), F.lit(kind).alias("case_type"), typology.alias("typology"), band.alias("severity_band"), conflict.alias("conflict_type"), notes.alias("notes"),
        ).where("slice is not null")

    hits = truth.where("gold_is_match AND expected_score_min >= 0.90")
    out = [pool(hits, F.lit(at["sanctions_hit"]), F.lit(seed), F.lit("SH"), F.lit("ESCALATE"), "sanctions_hit", F.format_string("match of kind %s, score from %.2f", "match_flavor", "expected_score_min"), first=F.col("row_id"))]
    clear = truth.where("NOT gold_is_match").join(state, "account_id", "left").where(inline_gold(F.lit(0.0), F.col("max_sev"), F.col("is_flagged")) == "CLEAR")
    out.append(pool(clear, F.lit(at["sanctions_near_miss"]), F.lit(f"{seed}|near"), F.lit("SNM"), F.lit("CLEAR"), "sanctions_near_miss", F.format_string("shares a surname, score %.2f to %.2f", "expected_score_min", "expected_score_max")))
    band = F.when(sev >= 3, 3).when(sev == 2, 2).otherwise(1)
    own = senders.distinct().join(state, "account_id", "left")
    out.append(pool(own, at["ibm_labeled band 3"] + 3 - band, F.concat(F.lit(f"{seed}|band"), band.cast("string")), F.lit("IBM"), F.lit("ESCALATE"), "ibm_labeled", F.concat(F.lit("labelled sender, band "), band.cast("string"), F.lit(", top rule "), top), band=band))
    known = patterns.select(typology_key(F.col("typology")).alias("typology"), "account_id").distinct().join(senders.distinct(), "account_id", "left_semi")
    if t.typologies:
        name = F.col("typology")
        out.append(pool(known, numbered("typology", name, t.typologies), F.concat(F.lit(f"{seed}|"), name), F.lit("TYP"), F.lit("ESCALATE"), "typology", F.concat(F.lit("in the pattern list as "), name), typology=name))
    if t.conflicts:
        kind = F.col("conflict_type")
        both = state.drop("conflict_type").join(conflict_pools(state), "account_id")
        prefix = F.when(kind == "rule3_no_anomaly", "CONF_R3NA").when(kind == "anomaly_no_rule", "CONF_ANR").otherwise("CONF_RNA")
        notes = F.concat(F.lit("top rule "), top, F.lit(", flagged "), F.when(F.coalesce("is_flagged", F.lit(False)), "yes").otherwise("no"))
        out.append(pool(both, numbered("conflict", kind, t.conflicts), F.concat(F.lit(f"{seed}|"), kind), prefix, F.when(kind == "rule3_no_anomaly", "ESCALATE").otherwise("CLEAR"), "rules_anomaly_conflict", notes, conflict=kind))
    return reduce(DataFrame.unionByName, out)


def _taker(wanted: list[int]):
    def take(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Slice by slice, the first accounts in order that no slice before has taken."""
        used, kept = set(), []
        for k, own in rows.sort_values(["slice", "place"]).groupby("slice"):
            free = own[~own["account_id"].isin(used)].head(wanted[k])
            used |= set(free["account_id"])
            kept.append(free)
        return pd.concat(kept)[[c.split(" ")[0] for c in _TAKEN.split(", ")]]

    return take


def eval_set(truth: DataFrame, state: DataFrame, senders: DataFrame, patterns: DataFrame, recent: DataFrame, t: Targets = Targets(), seed: str = "eval") -> DataFrame:
    """The evaluation cases, slice by slice; an account serves once, and a pool that is short stops the build.

    truth(row_id, account_id, match_flavor, expected_score_min, expected_score_max, gold_is_match), state(account_id, max_sev,
    top_rule, is_flagged, percentile), senders(account_id) of labelled transactions, patterns(typology, account_id),
    recent(account, txn_ids).

    One plan: slices before can take no more accounts from a pool than all targets together, so that many of each pool, ranked, decide. They are at
    most slices times total rows, whatever the pools hold; one small task excludes and takes. The cases are written; it runs jobs at once.
    """
    wanted = slice_plan(t)
    rows = _pools(truth, state, senders, patterns, t, seed).withColumn("again", F.row_number().over(Window.partitionBy("slice", "account_id").orderBy("first", "then", "notes"))).where("again = 1")
    place = F.row_number().over(Window.partitionBy("slice").orderBy("first", "then", "account_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= max(1, t.total))
    taken = written(rows.groupBy(F.lit(0).alias("all")).applyInPandas(_taker([n for _, n in wanted]), _TAKEN), "evaluation")
    spark = truth.sparkSession
    due = spark.createDataFrame([(k, what, n) for k, (what, n) in enumerate(wanted)], "slice int, what string, wanted int")
    short = due.join(taken.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), "slice", "left").where(F.coalesce("n", F.lit(0)) < F.col("wanted")).orderBy("slice").first()
    if short is not None:
        raise ValueError(f"{short.what}: {short.wanted} accounts are wanted, {short.n or 0} are there")
    own = F.broadcast(taken).join(recent.withColumnRenamed("account", "account_id"), "account_id", "left")  # as many rows as the targets say
    return own.select(*[c.split(" ")[0] for c in EVAL_COLUMNS.split(", ")], F.coalesce("txn_ids", F.lit("")).alias("relevant_txn_ids"))


def not_in_overlay(cases: DataFrame, overlay: DataFrame) -> DataFrame:
    """account_id of cases that the overlay lacks."""
    return cases.select("account_id").distinct().join(overlay, "account_id", "left_anti")


def require_eval_set(cases: DataFrame, overlay: DataFrame, size: int) -> None:
    """ValueError unless there are so many cases, ids of cases and accounts are unique, and every account has an identity."""
    n = cases.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("c"), F.count_distinct("account_id").alias("a")).first()
    if n["n"] != size:
        raise ValueError(f"{n['n']} cases; {size} are wanted")
    if n["c"] != size or n["a"] != size:
        raise ValueError("an account or a case id occurs twice")
    if lost := [r.account_id for r in not_in_overlay(cases, overlay).limit(5).collect()]:
        raise ValueError(f"accounts without an identity: {lost}")


# fixed values: romanisation variants, and letters that scans confuse
TRANSLIT = (
    ("mohammed", "mohamed"), ("hussain", "husain"), ("ahmad", "ahmed"), ("usama", "osama"), ("mukhtar", "mokhtar"), ("khoury", "khouri"),
    ("ou", "u"), ("ph", "f"), ("ae", "a"), ("kh", "k"), ("ai", "ei"), ("ii", "i"), ("uu", "u"),
)
OCR = (("o", "0"), ("i", "1"), ("l", "1"), ("e", "3"), ("s", "5"), ("a", "4"), ("g", "9"), ("b", "6"))
BOUNDS = {"exact": 1.0, "transliteration": 0.90, "typo_ocr": 0.85, "partial_reorder": 0.90}
NEAR, CUT = (0.80, 0.88), 0.90


def spellings(records: DataFrame) -> DataFrame:
    """uid, canonical_name, flavor, late, key, spelling: every derived spelling of a record; late ones are tried after all others."""
    raw = F.col("canonical_name")
    r = records.select("uid", "canonical_name", normalize_name(raw).alias("base"), strip_marks(raw).alias("plain"))
    key = lambda x: F.md5(F.concat_ws("|", "uid", x).cast("binary"))
    made = lambda flavor, late, k, c: F.struct(F.lit(flavor).alias("flavor"), F.lit(late).alias("late"), k.alias("key"), c.alias("spelling"))
    swaps = lambda flavor, subs: [F.when(F.contains("base", F.lit(a)), made(flavor, False, key(F.lit(a)), title_case(replace_first(F.col("base"), a, b)))) for a, b in subs]
    at = F.sequence(F.lit(4), F.greatest(F.length("base") - 1, F.lit(4)))
    letter = lambda i: F.substr("base", i, F.lit(1))
    turned = F.transform(at, lambda i: F.when(~F.contains(F.substr("base", i, F.lit(2)), F.lit(" ")) & (letter(i) != letter(i + 1)), made("typo_ocr", True, F.lpad(i.cast("string"), 6, "0"), title_case(F.concat(F.substr("base", F.lit(1), i - 1), letter(i + 1), letter(i), F.substr("base", i + 2))))))
    vowel = lambda i: F.translate(letter(i), "aeiou", "eioua")
    late = lambda i: letter(i).isin(*"aeiou") & ~F.contains(F.substr("base", i - 3, F.lit(3)), F.lit(" ")) & (F.locate(" ", F.concat(F.substr("base", i + 1, F.lit(3)), F.lit(" "))) <= 3)
    changed = F.transform(F.sequence(F.lit(4), F.greatest(F.length("base"), F.lit(4))), lambda i: F.when(late(i), made("transliteration", True, F.lpad(i.cast("string"), 6, "0"), title_case(replace_at(F.col("base"), i, vowel(i))))))
    one = F.array(
        F.when(F.col("plain") != raw, made("exact", False, F.lit(""), F.col("plain"))), F.when(F.size(F.split("plain", r"\s+")) > 1, made("partial_reorder", False, F.lit(""), reversed_tokens(F.regexp_replace(F.trim("plain"), r"\s+", " ")))),
        *swaps("transliteration", TRANSLIT), *swaps("typo_ocr", OCR),
    )
    return r.select("uid", "canonical_name", F.explode(F.array_compact(F.concat(one, turned, changed))).alias("m")).select("uid", "canonical_name", "m.*")


def true_positives(records: DataFrame) -> DataFrame:
    """uid, canonical_name, flavor, spelling, score: the first spelling of each record and flavor that reaches the flavor's
    score and isn't itself, raw or in normal form, on the list."""
    listed = raw_names(records)
    s = spellings(records).withColumn("norm", normalize_name(F.col("spelling")))
    s = s.join(listed.select(F.col("name").alias("spelling")), "spelling", "left_anti")
    same = listed.select(normalize_name(F.col("name")).alias("norm")).distinct()
    free = s.where("flavor NOT IN ('transliteration', 'typo_ocr')").unionByName(s.where("flavor IN ('transliteration', 'typo_ocr')").join(same, "norm", "left_anti"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in BOUNDS.items() for x in kv]), F.col("flavor"))
    fit = free.withColumn("score", score_udf("norm", normalize_name(F.col("canonical_name")))).where(F.col("score") >= least)
    first = Window.partitionBy("uid", "flavor").orderBy("late", "key", "spelling")
    return fit.withColumn("k", F.row_number().over(first)).where("k = 1").select("uid", "canonical_name", "flavor", "spelling", "score")


def near_misses(records: DataFrame, given: list[str], seed: str = "near") -> DataFrame:
    """uid, canonical_name, spelling, score: a given name with the record's surname (four letters or more), of score 0.80 to
    0.88 to the record and under 0.90 to every name of the list; the first in seeded order."""
    r = records.select("uid", "canonical_name", normalize_name(F.col("canonical_name")).alias("base"))
    r = r.withColumn("last", last_token(F.col("base"))).where("length(last) >= 4")
    each = r.select("*", F.explode(F.array(*map(F.lit, given))).alias("given")).withColumn("norm", F.lower(F.concat_ws(" ", "given", "last"))).where("norm <> base")
    fit = each.withColumn("score", score_udf("norm", "base")).where(F.col("score").between(*NEAR))
    fit = written(fit, "near")
    close = near_names(fit, build_index(records).select(F.col("norm").alias("other")), CUT).select("norm").distinct()
    first = Window.partitionBy("uid").orderBy(draw_key(F.concat_ws("|", "uid", "given"), seed), "given")
    out = fit.join(close, "norm", "left_anti").withColumn("k", F.row_number().over(first)).where("k = 1")
    return out.select("uid", "canonical_name", title_case(F.col("norm")).alias("spelling"), "score")


def fixtures(accounts: DataFrame, records: DataFrame, given: list[str], seed: str = "overlay", each: int = 5, near: int = 30) -> DataFrame:
    """Ground-truth rows: `each` matches of every flavor, of distinct records, and `near` near misses, on accounts drawn by seed."""
    own = records.where("entry_type = 'Individual'")
    match, used, rows = written(true_positives(own), "matches"), [], []
    for flavor, least in BOUNDS.items():
        pool = match.where((F.col("flavor") == flavor) & ~F.col("uid").isin(used or [""]))
        got = pool.orderBy(draw_key(F.col("uid"), f"{seed}|{flavor}"), "uid").limit(each).collect()
        if len(got) < each:
            raise ValueError(f"{flavor}: {each} records are wanted, {len(got)} fit")
        used += [r.uid for r in got]
        rows += [(r.spelling, r.uid, r.canonical_name, flavor, least, 1.0, True) for r in got]
    got = near_misses(own, given, seed).orderBy(draw_key(F.col("uid"), f"{seed}|near"), "uid").limit(near).collect()
    if len(got) < near:
        raise ValueError(f"near misses: {near} are wanted, {len(got)} fit")
    rows += [(r.spelling, r.uid, r.canonical_name, "hard_negative", *NEAR, False) for r in got]
    drawn = [r.account_id for r in sample(accounts, "account_id", len(rows), seed).collect()]
    if len(drawn) < len(rows):
        raise ValueError("there are fewer accounts than fixtures")
    held = [(i, a, *r) for i, (a, r) in enumerate(zip(sorted(drawn), rows, strict=True))]
    return accounts.sparkSession.createDataFrame(held, "row_id int, account_id string, assigned_name string, ofac_uid string, ofac_canonical_name string, match_flavor string, expected_score_min double, expected_score_max double, gold_is_match boolean")


DRAWS = 200
MOST_FIXTURES = 100_000


def _drawn(c: Column, salt: Column | str, n: int) -> Column:
    """0 to n - 1 from the md5 of an id and a salt: the same in any engine."""
    digest = F.md5(F.concat(c, F.lit("|"), salt if isinstance(salt, Column) else F.lit(salt)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def colliding_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """name: those that in normal form are on the list, or score 0.90 or more against a listed name with the same last token."""
    every = names.select("name").distinct().withColumn("norm", normalize_name(F.col("name")))
    hit = every.join(index.select("norm").distinct(), "norm", "left_semi").select("norm").unionByName(surname_collisions(every, index)).distinct()
    return every.join(hit, "norm", "left_semi").select("name")


def drawn_names(accounts: DataFrame, given: list[str], family: list[str], seed: str, index: DataFrame | None = None, draws: int = DRAWS) -> DataFrame:
    """account_id, name: the first of `draws` names drawn by hash that doesn't collide with the list, or else a number after the last draw.

    The names that can be drawn are made and screened once, on the executors. Accounts whose draw collides, and they alone, draw again: one name in
    the first round, then eight, 64 and the rest. A round's accounts are a written table. It runs jobs at once.
    """
    a = F.col("account_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i + 1)
    name = lambda k: F.concat_ws(" ", pick(given, _drawn(a, F.concat(F.lit(f"{seed}g"), k), len(given))), pick(family, _drawn(a, F.concat(F.lit(f"{seed}f"), k), len(family))))
    drawn = lambda df, lo, hi: df.select("account_id", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("i")).withColumn("name", name(F.col("i").cast("string")))
    left, out, lo, step = accounts.select("account_id"), None, 0, 1
    if index is None:
        return drawn(left, 0, 1).select("account_id", "name")
    spark = accounts.sparkSession
    first = spark.createDataFrame([(x,) for x in dict.fromkeys(given)], "a string").repartition(8)
    every = first.withColumn("b", F.explode(F.lit(list(dict.fromkeys(family))))).select(F.concat_ws(" ", "a", "b").alias("name"))
    bad = written(colliding_names(every, index), "colliding-names")
    while lo < draws:
        hi = min(draws, lo + step)
        now = drawn(left, lo, hi)
        free = written(now.join(bad, "name", "left_anti").groupBy("account_id").agg(F.min_by("name", "i").alias("name")), "drawn")
        out = free if out is None else out.unionByName(free)
        left = written(left.join(free, "account_id", "left_anti"), "colliding")
        if left.isEmpty():
            return out
        lo, step = hi, step * 8
    number = (_drawn(a, f"{seed}n", 9000) + 1000).cast("string")
    return out.unionByName(left.select("account_id", F.concat_ws(" ", name(F.lit(str(draws - 1))), number).alias("name")))


def identity_overlay(accounts: DataFrame, given: list[str], family: list[str], countries: list[str], seed: str, records: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """account_id, name, country, kyc_risk: the fixtures in truth (account_id, assigned_name) keep their names, all others draw one by hash.

    Any number of fixtures is joined whole; an account with two fixtures is an error. It runs jobs at once.
    """
    a = F.col("account_id")
    accounts, index = accounts.select("account_id"), None if records is None else build_index(records)
    if truth is None:
        named = drawn_names(accounts, given, family, seed, index)
    else:
        truth = truth.select("account_id", F.col("assigned_name").alias("name"))
        n = truth.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("k")).first()
        if n.n != n.k:
            raise ValueError(f"{n.n} fixtures are of {n.k} accounts")
        held = F.broadcast(truth) if n.n <= MOST_FIXTURES else truth
        rest = written(accounts.join(held, "account_id", "left_anti"), "unnamed")
        named = accounts.join(held, "account_id").unionByName(drawn_names(rest, given, family, seed, index))
    k = _drawn(a, f"{seed}kyc", 100)
    risk = F.when(k < 85, "low").when(k < 97, "medium").otherwise("high")
    country = F.element_at(F.array(*map(F.lit, countries)), _drawn(a, f"{seed}c", len(countries)) + 1)
    return named.select("account_id", "name", country.alias("country"), risk.alias("kyc_risk"))
