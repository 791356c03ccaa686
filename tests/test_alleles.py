"""Lists of Number A, R and G in step with their alleles, against versions that walk them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import alleles as L
from lociframe.operators import cohort, joins, transforms

SAMPLE = "array<struct<sample_id:string,GT:string,DP:int,AD:array<int>,PL:array<int>>>"
SCHEMA = f"CHROM string, POS long, ID string, REF string, ALT array<string>, QUAL double, FILTER array<string>, INFO_DP int, INFO_AF array<double>, INFO_AD array<int>, samples {SAMPLE}"


def record(rng, names, pos, ref, alts):
    n = len(alts) + 1
    gts = [f"{rng.choice('.' + '0123456789'[:n])}{rng.choice('/|')}{rng.choice('.' + '0123456789'[:n])}" for _ in names]
    gts = [rng.choice("." + "0123456789"[:n]) if rng.random() < 0.2 else g for g in gts]
    pl = lambda g: [rng.randrange(99) for _ in range(n if len(g) == 1 else n * (n + 1) // 2)]
    samples = [(s, g, rng.randrange(50), None if rng.random() < 0.1 else [rng.randrange(40) for _ in range(n)], pl(g)) for s, g in zip(names, gts, strict=True)]
    return ("c", pos, rng.choice([None, f"rs{pos}"]), ref, alts, rng.choice([None, float(pos)]), rng.choice([["PASS"], ["q1"], []]), rng.choice([None, pos]), [x / 10 for x in range(n - 1)], [rng.randrange(9) for _ in range(n)], samples)


def pick(values, number, order, n_old):
    """reordered, one value at a time."""
    if values is None:
        return None
    at = lambda i: values[i]
    if number == "A":
        return [None if o is None else at(o - 1) for o in order[1:]] if len(values) == n_old - 1 else None
    if number == "R" or len(values) == n_old:
        return [None if o is None else at(o) for o in order] if len(values) == n_old else None
    if len(values) != n_old * (n_old + 1) // 2:
        return None
    out = []
    for j, b in enumerate(order):
        for a in order[: j + 1]:
            out.append(None if a is None or b is None else at(max(a, b) * (max(a, b) + 1) // 2 + min(a, b)))
    return out


def retold(gt, new):
    return "".join(x if x in "/|." else str(new[int(x)]) if new.get(int(x)) is not None else "." for x in gt)


def check(got, want):
    assert (got.GT, got.AD, got.PL) == want


def test_split_trim_and_swap(spark):
    rng = random.Random(2)
    rows = [record(rng, ["a", "b", "é"], p, "A", alts) for p, alts in enumerate([["C"], ["C", "G"], ["C", "GT", "T"], ["C", "<*>"], []] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    source = {r[1]: r for r in rows}
    split = L.split_records(df, old_record="OLD", keep_sum=()).collect()
    assert len(split) == sum(max(1, len(r[4])) for r in rows)
    for r in split:
        s, k = source[r.POS], r.allele
        n, order = len(s[4]) + 1, [0] if k is None else [0, k]
        assert r.ALT == ([] if k is None else [s[4][k - 1]]) and r.INFO_AF == pick(s[8], "A", order, n) and r.INFO_AD == pick(s[9], "R", order, n)
        assert r.OLD == (f"c|{r.POS}|A|{','.join(s[4])}|{k}" if n > 2 else None)
        for x, y in zip(r.samples, s[10], strict=True):
            check(x, (retold(y[1], {o: j for j, o in enumerate(order)}), pick(y[3], "R", order, n), pick(y[4], "G", order, n)))
    for r in L.split_records(df, keep_sum=("AD",)).where("allele is not null").collect():
        for x, y in zip(r.samples, source[r.POS][10], strict=True):
            assert x.AD == (None if y[3] is None else [sum(y[3]) - y[3][r.allele], y[3][r.allele]])
    for unseen in (False, True):
        for r in L.trim_records(df, unseen=unseen).collect():
            s = source[r.POS]
            kept = [i for i, a in enumerate(s[4], 1) if (a != "<*>" if unseen else any(str(i) in g[1] for g in s[10]))]
            order = [0, *kept]
            assert r.ALT == [s[4][i - 1] for i in kept] and r.INFO_AF == pick(s[8], "A", order, len(s[4]) + 1)
            for x, y in zip(r.samples, s[10], strict=True):
                check(x, (retold(y[1], {o: j for j, o in enumerate(order)}), pick(y[3], "R", order, len(s[4]) + 1), pick(y[4], "G", order, len(s[4]) + 1)))
    for r in L.swap_records(df, F.col("POS") % 2 == 0).collect():
        s = source[r.POS]
        order = [1, 0] if r.POS % 2 == 0 and len(s[4]) == 1 else [*range(len(s[4]) + 1)]
        assert (r.REF, r.ALT) == (("C", ["A"]) if order == [1, 0] else ("A", s[4]))
        for x, y in zip(r.samples, s[10], strict=True):
            check(x, (retold(y[1], {o: j for j, o in enumerate(order)}), pick(y[3], "R", order, len(order)), pick(y[4], "G", order, len(order))))
    assert transforms.without_unused_alts(df).count() == len(rows) and transforms.split_genotypes(df).where("ALT = 'GT'").count() == 8
    assert L.wrong_lengths(df).count() == 0
    wrong = df.withColumn("INFO_AF", F.array(F.lit(1.0), F.lit(2.0))).where("size(ALT) = 1")
    assert {tuple(r) for r in L.wrong_lengths(wrong).select("field", "found", "expected").collect()} == {("INFO_AF", 2, 1)}


def brute_merge(sets, policy, missing_rules=None):
    """Merged records by place and key: (REF, ALTs, per-sample (GT, AD, PL))."""

    def key(r):
        exact = r[3] + ">" + ",".join(sorted(r[4]))
        sizes = [len(a) - len(r[3]) for a in r[4] if a[0] != "<"]
        longer, shorter = any(x > 0 for x in sizes), any(x < 0 for x in sizes)
        kind = "indel" if longer or shorter else "snp"
        fine = "indel" if longer and shorter else "ins" if longer else "del" if shorter else "snp"
        return {"none": exact, "all": "", "both": kind, "snp-ins-del": fine, "snps": "snp" if kind == "snp" else exact, "indels": "indel" if kind == "indel" else exact, "id": r[2] or exact}[policy]

    groups = {}
    for i, rows in enumerate(sets):
        count = {}
        for r in sorted(rows, key=lambda r: (r[3], r[4])):
            k = (r[1], key(r))
            groups.setdefault((*k, count.setdefault(k, 0)), {})[i] = r
            count[k] += 1
    out = []
    for (pos, _, _), recs in groups.items():
        ref = max((r[3] for r in recs.values()), key=len)
        ext = {i: [a + ref[len(r[3]) :] if set(a.upper()) <= set("ACGTN") else a for a in r[4]] for i, r in recs.items()}
        alts = list(dict.fromkeys(a for i in sorted(recs) for a in ext[i]))
        calls = []
        for i, rows in enumerate(sets):
            if i not in recs:
                calls += [("./.", None, None)] * len(rows[0][10])
                continue
            new = {0: 0} | {j: alts.index(a) + 1 for j, a in enumerate(ext[i], 1)}
            order = [0] + [ext[i].index(a) + 1 if a in ext[i] else None for a in alts]
            n = len(ext[i]) + 1
            for _, g, _, ad, pl in recs[i][10]:
                lists = [pick(ad, "R", order, n), pick(pl, "G", order, n)]
                if missing_rules:
                    lists[0] = lists[0] and [0 if v is None else v for v in lists[0]]
                    lists[1] = lists[1] and [max(x for x in lists[1] if x is not None) if v is None else v for v in lists[1]]
                calls.append((retold(g, new), *lists))
        out.append((pos, ref, alts, calls))
    return sorted(out, key=str)


def sets_of(rng):
    kinds = [("A", ["C"]), ("A", ["G"]), ("A", ["C", "G"]), ("AG", ["A"]), ("AGG", ["A", "AG"]), ("A", ["AT"]), ("AG", ["CG"]), ("A", ["<DEL>"]), ("A", [])]
    out = []
    for names in (["s1", "s2"], ["s2", "x"], ["y"]):
        rows = []
        for pos in range(1, 25):
            for ref, alts in rng.sample(kinds, rng.choice([0, 1, 1, 2, 3])):
                rows.append(record(rng, names, pos, ref, alts))
        out.append(rows)
    return out


@pytest.mark.parametrize("policy", L.POLICIES)
def test_merge_policies(spark, policy):
    sets = sets_of(random.Random(4))
    frames = [spark.createDataFrame(s, SCHEMA).repartition(2) for s in sets]
    got = sorted(((r.POS, r.REF, r.ALT, [(x.GT, x.AD, x.PL) for x in r.samples]) for r in L.merge_calls(*frames, policy=policy).collect()), key=str)
    assert got == brute_merge(sets, policy)


def test_merge_missing_rules_names_and_info(spark):
    sets = sets_of(random.Random(5))
    sets[0].append(record(random.Random(5), ["s1", "s2"], 99, "A", ["C", "T"]))
    frames = [spark.createDataFrame(s, SCHEMA) for s in sets]
    rows = L.merge_calls(*frames, missing_rules={"AD": 0, "PL": "max"}, info_rules={"INFO_DP": "sum", "INFO_AD": "sum", "INFO_AF": "max"}, names=True).collect()
    assert sorted(((r.POS, r.REF, r.ALT, [(x.GT, x.AD, x.PL) for x in r.samples]) for r in rows), key=str) == brute_merge(sets, "all", True)
    assert {tuple(x.sample_id for x in r.samples) for r in rows} == {("s1", "s2", "2:s2", "x", "y")}
    at = next(r for r in rows if sum(x[1] == r.POS for s in sets for x in s) == 1)
    own = next(x for s in sets for x in s if x[1] == at.POS)
    assert (at.INFO_DP, at.INFO_AF or [], at.INFO_AD, at.QUAL, at.ID) == (own[7], own[8], own[9], own[5], own[2])
    for r in rows:
        dps = [x[7] for s in sets for x in s if x[1] == r.POS]
        if len(dps) == len({i for i, s in enumerate(sets) for x in s if x[1] == r.POS}):  # one record a set
            assert r.INFO_DP == (sum(d for d in dps if d is not None) if any(d is not None for d in dps) else None)


def test_merge_local_alleles(spark):
    rng = random.Random(6)
    a, b = [record(rng, ["a"], 1, "A", ["C"]), record(rng, ["a"], 2, "A", ["C"])], [record(rng, ["b"], 1, "A", ["G", "C"]), record(rng, ["b"], 3, "A", ["T"])]
    rows = {r.POS: r for r in L.merge_calls(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), local=1).collect()}
    x, y = rows[1].samples
    assert rows[1].ALT == ["C", "G"] and (x.LAA, x.LPL, x.PL, x.AD) == ([1], a[0][10][0][4], None, None) and (y.LAA, y.LPL) == ([2, 1], b[0][10][0][4])
    assert rows[2].samples[0].LAA is None and rows[2].samples[0].PL == a[1][10][0][4] and rows[2].samples[1].GT == "./."


def test_merge_of_long_refs_makes_one_record(spark):
    schema = "CHROM string, POS long, REF string, ALT array<string>, QUAL double, FILTER array<string>, samples array<struct<sample_id:int,GT:string>>"
    a = spark.createDataFrame([("c", 5, "A", ["T"], 1.0, None, [(0, "0/1")])], schema)
    b = spark.createDataFrame([("c", 5, "AG", ["A"], None, ["PASS"], [(0, "1|0/1")])], schema)
    (r,) = joins.merge_records(a, b).collect()
    assert (r.REF, r.ALT, [x.GT for x in r.samples], r.FILTER) == ("AG", ["TG", "A"], ["0/1", "2|0/2"], ["PASS"])
    twice = a.unionByName(a.withColumn("ALT", F.array(F.lit("C"))))
    assert sorted(x.ALT for x in joins.merge_records(twice, b).collect()) == [["C", "CG"], ["TG", "A"]] or joins.merge_records(twice, b).count() == 2


def test_join_undoes_split(spark):
    rng = random.Random(8)
    rows = [record(rng, ["a", "b"], p, "A", alts) for p, alts in enumerate([["C"], ["C", "G"], ["CT", "CTT", "ATTT"], ["T", "G", "C"]] * 5)]
    rows = [(*r[:10], [(s, g.replace(".", "0"), d, ad, pl) for s, g, d, ad, pl in r[10]]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    back = {r.POS: r for r in L.join_records(L.split_records(df).drop("allele"), policy="all", info_rules={"INFO_DP": "max"}).collect()}
    for r in rows:
        got = back[r[1]]
        order = [0, *(1 + r[4].index(a) for a in got.ALT)]
        assert sorted(got.ALT) == sorted(r[4]) and got.REF == r[3] and got.INFO_AF == pick(r[8], "A", order, len(order))
        for x, y in zip(got.samples, r[10], strict=True):
            assert x.sample_id == y[0] and x.GT == retold(y[1], {o: j for j, o in enumerate(order)}) and x.AD == pick(y[3], "R", order, len(order))


def test_renumbered_keeps_every_separator(spark):
    gts = ["0|1/2", "/0|1", "2", ".", "./2", "10/1", "0/0", None]
    df = spark.createDataFrame([(g,) for g in gts], "gt string").select(L.renumbered(F.col("gt"), F.array(F.lit(0), F.lit(3), F.lit(None))))
    assert [r[0] for r in df.collect()] == ["0|3/.", "/0|3", ".", ".", "./.", "./3", "0/0", None]


def test_empty_sets(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([record(random.Random(1), ["a"], 1, "A", ["C"])], SCHEMA)
    assert L.merge_calls(none, none).count() == 0 and len(L.merge_calls(one, none).first().samples) == 1 and L.join_records(none).count() == 0


def test_checked_reference_swaps_genotypes(spark):
    rows = [("c", 1, "A", "C", [("a", "0|1", 5, [7, 2], [0, 3, 9])]), ("c", 2, "A", "C", [("a", "0/0", 5, [7, 2], [0, 3, 9])]), ("c", 3, "A", "C", [("a", "1/1", 5, None, [1])])]
    df = spark.createDataFrame(rows, f"CHROM string, POS long, REF string, ALT string, samples {SAMPLE}")
    base = spark.createDataFrame([("c", 1, "A"), ("c", 2, "C"), ("c", 3, "G")], "CHROM string, POS long, base string")
    got = {r.POS: r for r in cohort.checked_ref(df, base, ["CHROM", "POS"], "s").collect()}
    assert [(r.REF, r.ALT, r.samples[0].GT, r.samples[0].AD, r.samples[0].PL) for _, r in sorted(got.items())] == [("A", "C", "0|1", [7, 2], [0, 3, 9]), ("C", "A", "1/1", [2, 7], [9, 3, 0]), ("G", "C", "1/1", None, None)]
