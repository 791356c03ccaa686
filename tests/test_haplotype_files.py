"""Round trips through files of probabilities and haplotypes, in splits of any size."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import sequence
from lociframe.sources import haplotypes as H

SCHEMA = "CHROM string, POS long, ID string, REF string, ALT array<string>, samples array<struct<sample_id:string,GT:string,GP:array<double>>>"
NAMES = ["a", "b", "ç"]


@pytest.fixture(scope="module")
def sites(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        calls = []
        for n in NAMES:
            gp = rng.choice([[1.0, 0.0, 0.0], [0.0, 0.875, 0.125], [0.25, 0.25, 0.5], [0.0, 0.0, 1.0]])
            calls.append((n, rng.choice(["0|1", "1|0", "0/1", "1/1", "./.", "0|0", "1", "0"]), gp))
        rows.append(("c1" if i < 70 else "c2", i * 7 + 1, f"rs{i}" if i % 3 else None, "A", ["CT" if i % 5 else "G"], calls))
    rows.append(("c2", 5000, None, "A", ["C", "G"], [(n, "1|2", None) for n in NAMES]))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def put(spark, tmp_path, name, lines, first=None):
    (tmp_path / name).write_text("\n".join([*([first] if first else []), *lines]) + "\n")
    return str(tmp_path / name)


@pytest.mark.parametrize("split", [300, 10_000_000])
def test_round_trips(spark, sites, tmp_path, split):
    own = lambda df: [r[0] for r in df.collect()]
    sample = put(spark, tmp_path, "x.sample", H.sample_lines(NAMES))
    legend_sample = put(spark, tmp_path, "y.sample", H.sample_lines(NAMES, True))
    hap_lines, legend_lines = H.hap_legend_lines(sites)
    hap, legend = put(spark, tmp_path, "y.hap", own(hap_lines)), put(spark, tmp_path, "y.legend", own(legend_lines), "id position a0 a1")
    haps, gen = put(spark, tmp_path, "x.haps", own(H.haps_lines(sites))), put(spark, tmp_path, "x.gen", own(H.gen_lines(sites, "GP")))
    want = {(r.CHROM, r.POS): r for r in sites.where(F.size("ALT") == 1).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert [(r.n, r.value) for r in H.numbered_lines(spark, hap).orderBy("n").collect()] == list(enumerate(own(hap_lines)))
        back = H.read_hap_legend(spark, hap, legend, legend_sample).collect()
        assert len(back) == len(want) == 120
        # without the separator of genotypes that miss an allele
        for r in back + H.read_haps(spark, haps, sample).collect():
            w = want[r.CHROM, r.POS]
            assert (r.REF, r.ALT, [(s.sample_id, s.GT) for s in r.samples]) == (w.REF, w.ALT, [(s.sample_id, s.GT) for s in w.samples])
            assert "ID" not in r or r.ID == w.ID
        for r in H.read_gen(spark, gen, sample).collect():
            w = want[r.CHROM, r.POS]
            assert [(s.sample_id, s.GP) for s in r.samples] == [(s.sample_id, s.GP) for s in w.samples] and r.ID == w.ID
            assert [s.GT for s in r.samples] == [next((g for g, p in zip(("0/0", "0/1", "1/1"), s.GP, strict=True) if p > 0.5), "./.") for s in w.samples]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_probabilities_of_genotypes(spark):
    df = spark.createDataFrame([("c", 1, None, "A", ["C"], [("a", "0/1", None), ("b", "./.", None), ("d", "1", None)])], SCHEMA)
    assert H.gen_lines(df).first()[0] == "c:1_A_C c:1_A_C 1 A C 0 1 0 0.33 0.33 0.33 0 0 1"
    pl = df.withColumn("samples", F.transform("samples", lambda s: F.struct(s["sample_id"].alias("sample_id"), F.array(F.lit(0), F.lit(10), F.lit(10)).alias("PL"))))
    assert H.gen_lines(pl, "PL").first()[0].split()[5:8] == ["0.833333", "0.083333", "0.083333"]


def test_personal_table(spark, tmp_path):
    reference = sequence.in_pieces(spark.createDataFrame([("1", 0, "ACGTACGTAA")], "CHROM string, begin long, bases string"), 4)
    path = put(spark, tmp_path, "me.txt", ["# a comment", "rs1\t1\t1\tAA", "rs2\t1\t2\tCT", "rs3\t1\t3\tTA", "rs4\t1\t5\t--", "i5\t1\t6\tII", "rs6\t1\t9\tG", "rs7\t2\t1\tAA", "rs8\t1\t40\tAA"])
    got = sorted((r.ID, r.REF, r.ALT, r.samples[0].GT) for r in H.read_personal(spark, path, "me", reference, 4).collect())
    assert got == [("rs1", "A", [], "0/0"), ("rs2", "C", ["T"], "0/1"), ("rs3", "G", ["A", "T"], "2/1"), ("rs4", "A", [], "./."), ("rs6", "A", ["G"], "1")]
