"""Formats made of several columns, values in every entry point, headers, and records of all layouts."""

import pytest
from pyspark.sql import functions as F

from lociframe.functions import expression, formatting, variants
from lociframe.operators import aggregates, joins
from lociframe.sources import vcf

HEADER = """##fileformat=VCFv4.2
##contig=<ID=c2,length=50>
##contig=<ID=c1>
##FILTER=<ID=q1,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="b">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts 1\tS²"""
ROWS = ["c2\t5\trs7\tA\tC,G\t30\tPASS\tDP=7;AF=0.5,0.25;DB\tGT:AD\t0/1:1,2,3\t1|2:4,5,6", "c2\t9\t.\tAT\tA\t.\tq1\tDP=3\tGT:AD\t./.:.\t0/0:7,8", "c1\t2\t.\tG\t.\t1.5\t.\t.\tGT:AD\t0/0:3\t0/0:."]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("calls") / "a.vcf"
    p.write_text(HEADER + "\n" + "\n".join(ROWS) + "\n")
    return str(p)


def test_every_layout_writes_the_file_again(spark, path):
    h = vcf.read_header(spark, path)
    for layout, write in (("wide", lambda df: vcf.wide_records(df, h, h.samples)), ("tidy", lambda df: vcf.as_records(df, h, h.samples)), ("nested", lambda df: vcf.nested_records(df, h))):
        assert [r[0] for r in write(vcf.read_vcf(spark, path, layout=layout)).collect()] == ROWS, layout


def test_wide_parquet_round_trip(spark, path, tmp_path):
    h = vcf.read_header(spark, path)
    vcf.write_parquet(vcf.read_vcf(spark, path), str(tmp_path / "p"), h)
    back = spark.read.parquet(str(tmp_path / "p"))
    own = vcf.parse_header([*vcf.stored_header(back).split("\n"), HEADER.split("\n")[-1]])
    assert [r[0] for r in vcf.wide_records(back, own, own.samples).collect()] == ROWS
    columns, n = vcf.parquet_info(spark, str(tmp_path / "p"))
    assert n == 3 and ("INFO_AF", "array<float>") in {(r.column, r.type) for r in columns.collect()}


def test_whole_fields(spark, path):
    t = vcf.read_vcf(spark, path, layout="nested")
    show = lambda text, **more: [r[0] for r in t.select(formatting.formatted(text, {"GT", "AD"}, t, **more)).collect()]
    assert show("%LINE") == ROWS
    assert show("%INFO") == [r.split("\t")[7] for r in ROWS] and show("%FORMAT") == ["\t".join(r.split("\t")[8:]) for r in ROWS]
    assert show("%RSX") == ["00000007", ".", "."]
    assert show("%SUM(INFO/AF) %MAX(AD)")[0] == "0.75 6"
    masked = t.withColumn("mask", F.lit(5))
    assert masked.select(formatting.formatted("%MASK", set(), masked, n_sets=4)).first()[0] == "1010"
    for text in ("%INFO", "%LINE", "%MASK"):
        with pytest.raises(ValueError, match="needs"):
            formatting.formatted(text, set())


def test_samples_that_fail(spark, path):
    t = expression.with_result(vcf.read_vcf(spark, path, layout="nested"), 'GT = "alt"')
    out = lambda **more: t.select(formatting.formatted("%POS[ %SAMPLE:%GT@%POS]", {"GT"}, t, passing="pass_samples", **more)).first()[0]
    assert out() == "5 s 1:0/1@5 S²:1|2@5"
    rest = t.where("POS = 9")
    assert rest.select(formatting.formatted("%POS[ %SAMPLE:%GT@%POS]", {"GT"}, t, passing="pass_samples", instead="?")).first()[0] == "9 ?:?@9 ?:?@9"
    assert rest.select(formatting.formatted("%POS[ %GT]", {"GT"}, t, passing="pass_samples")).first()[0] == "9"
    assert formatting.header("%POS[ %GT]", ["a"], numbered=False) == "#POS\ta:GT"


def test_given_values_everywhere(spark, path):
    t = vcf.read_vcf(spark, path, layout="nested")
    assert [r.POS for r in expression.exclude(t, "POS > {}", 4).collect()] == [2]
    assert {r.POS: r.FILTER for r in expression.soft_filter(t, "POS < {}", "near", given=(6,)).collect()}[5] == ["near"]
    assert [r.x for r in expression.with_value(t, "x", "POS + {}", 1).orderBy("POS").collect()] == [3, 6, 10]
    assert expression.with_result(t, "INFO/DP = {}", given=(7,)).where("pass_site").first().POS == 5


def test_headers(spark, path):
    h = vcf.read_header(spark, path)
    assert vcf.reheadered(h, {"s 1": "x"}).samples == ["x", "S²"]
    other = vcf.reheadered(h, ["p", "q"], {"c1": 9, "c2": None})
    assert other.samples == ["p", "q"] and other.lines[-2:] == ["##contig=<ID=c1,length=9>", "##contig=<ID=c2>"] and list(other.contigs) == ["c1", "c2"]
    for bad in (["p"], ["p", "p"]):
        with pytest.raises(ValueError, match="sample names"):
            vcf.reheadered(h, bad)
    for layout in ("wide", "tidy", "nested"):
        t = vcf.with_samples(vcf.read_vcf(spark, path, layout=layout), h.samples, ["p", "q"])
        text = str(t.columns) + str(t.collect())
        assert "q" in text and "S²" not in text
    t, new = vcf.with_annotations(vcf.read_vcf(spark, path, layout="nested"), h, {"INFO/DP": "DEPTH", "FORMAT/AD": "READS", "FILTER/q1": "low"})
    assert "INFO_DEPTH" in t.columns and t.first().samples[0].READS == [1, 2, 3] and t.where("POS = 9").first().FILTER == ["low"] and '##INFO=<ID=DEPTH,Number=1,Type=Integer,Description="d">' in new.lines
    assert [r[0] for r in vcf.nested_records(t, new).collect()] == [r.replace("DP=", "DEPTH=").replace("GT:AD", "GT:READS").replace("\tq1\t", "\tlow\t") for r in ROWS]
    with pytest.raises(ValueError, match="no such field"):
        vcf.with_annotations(t, h, {"X/y": "z"})


def test_variant_keys(spark):
    rows = [("chr1", 1, "A", "C"), ("1", 1, "A", "C"), ("1", 1, "A", "G"), ("1", 1, "A" * 20, "C"), ("1", 1, "A" * 20, "G"), ("X", 5, "ac", "t"), ("odd", 5, "A", "<DEL>"), ("2", 1, "A", None), ("22", 2**28, "A", "C")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, p long, r string, a string").select(variants.variant_key(F.col("c"), F.col("p"), F.col("r"), F.col("a"))).collect()]
    assert got[0] == got[1] and len(set(got)) == len(rows) - 1
    unsigned = [x % 2**64 for x in got]
    assert unsigned[0] == (1 << 59) | (1 << 27) | (1 << 23) | (0b0001 << 18 << 1)
    assert all(x & 1 == (i in (3, 4, 6)) for i, x in enumerate(unsigned)) and unsigned[8] >> 59 == 22 and (unsigned[8] >> 31) % 2**28 == 2**28 - 1


def test_fisher_in_one_pass(spark):
    tables = [(0, 0, 0, 0), (1, 0, 0, 1), (3, 1, 1, 3), (10, 2, 3, 15), (0, 20, 20, 0), (200, 3, 5, 180), (5, 5, 5, 5), (40, 0, 0, 0)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    got = [r[0] for r in df.select(variants.fisher(*map(F.col, "abcd"))).collect()]
    for g, t in zip(got, tables, strict=True):
        assert g == pytest.approx(aggregates._fisher(*t), rel=1e-9)


def test_linkage_brute(spark):
    import random

    rng = random.Random(3)
    rows, sites = [], []
    for p in (1, 1, 5, 9, 30, 31, 31, 60, 64, 95, 130):
        alt = rng.choice(["C", "G", "T"]) + str(len(sites))
        calls = {s: rng.choice([0, 1, 2, None]) for s in rng.sample(range(12), 9)}  # samples are missing at some sites
        sites.append((p, alt, calls))
        rows += [("c", p, "A", alt, s, d) for s, d in calls.items()]
    got = sorted((r.pos1, r.pos2, r.n, None if r.r2 is None else round(r.r2, 9)) for r in joins.linkage(spark.createDataFrame(rows, "CHROM string, POS long, REF string, ALT string, sample_id int, d int"), F.col("d"), 30).collect())
    want = []
    for i, (p, _, x) in enumerate(sites):
        for q, _, y in sites[i + 1 :]:
            if 0 < q - p <= 30:
                both = [(x[s], y[s]) for s in x if s in y and x[s] is not None and y[s] is not None]
                n = len(both)
                sx, sy, xy, xx, yy = (sum(f(a, b) for a, b in both) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * b, lambda a, b: a * a, lambda a, b: b * b))
                vx, vy = n * xx - sx * sx, n * yy - sy * sy
                want.append((p, q, n, round((n * xy - sx * sy) ** 2 / (vx * vy), 9) if vx > 0 and vy > 0 else None))
    assert sorted(got, key=str) == sorted(want, key=str)
