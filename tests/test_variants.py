import pytest
from pyspark.sql import functions as F

from lociframe.functions import annotation, expression, variants
from lociframe.operators import lake, transforms
from lociframe.sources import vcf


@pytest.mark.parametrize(
    "ref, alt, kind",
    [("A", "C", "snp"), ("A", "a", "ref"), ("A", ".", "ref"), ("A", "*", "overlap"), ("A", "<DEL>", "other"), ("A", "<*>", "ref"), ("A", "AT", "ins"), ("AT", "A", "del"), ("AC", "GT", "mnp"), ("ACG", "ATG", "snp"), ("A", "A[chr1:5[", "bnd"), ("ACGT", "AT", "del"), ("CAT", "GC", "other")],
)
def test_allele_type(spark, ref, alt, kind):
    assert spark.createDataFrame([(ref, alt)], "r string, a string").select(variants.allele_type(F.col("r"), F.col("a"))).first()[0] == kind


def test_genotype_classes(spark):
    rows = {"0/0": "hom_ref", "0|1": "het_ref", "1/2": "het_alt", "1/1": "hom_alt", "./1": "mis", ".": "mis", "1": "hap_alt", "0": "hap_ref"}
    df = spark.createDataFrame([(k,) for k in rows], "g string")
    assert {r[0]: r[1] for r in df.select("g", variants.genotype_class(F.col("g"))).collect()} == rows


def test_binomial(spark):
    df = spark.createDataFrame([(0, 0), (3, 3), (0, 5), (8, 2)], "a int, b int")
    got = [r[0] for r in df.select(variants.binomial_test(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and got[1] == 1.0 and abs(got[2] - 2 / 32) < 1e-12 and abs(got[3] - 2 * (45 + 10 + 1) / 1024) < 1e-12


def nested(spark):
    return spark.createDataFrame([(1, "A", ["C"], 30.0, [(0, "0/1", 5, [3, 2]), (1, "./.", 50, [40, 10])]), (2, "A", ["C", "AT"], None, [(0, "0/0", None, [1, 0]), (1, "1/2", 9, [0, 9])])], "site_id int, REF string, ALT array<string>, QUAL double, samples array<struct<sample_id:int,GT:string,DP:int,AD:array<int>>>")


@pytest.mark.parametrize(
    "text, sites, masks",
    [
        ("DP > 4 & DP < 6", [1], [[True, False]]), ("DP = 5 && DP = 50", [1], [[True, True]]), ('GT = "mis" || QUAL > 100', [1], [[True, True]]), ('DP = "."', [2], [[True, False]]), ("QUAL = 30", [1], None), ("QUAL != 30", [2], None),
        ('TYPE = "snp"', [1], None), ('TYPE ~ "indel"', [2], None), ("N_ALT = 2 && AC > 0", [2], None), ("MAX(AD) >= 40", [1], None), ("AD[1:0] > 39", [1], [[True]]), ("ILEN = 1", [2], None), ("(DP + 1) * 2 = 12", [1], [[True, False]]), ("N_PASS(DP > 8) = 1", [1, 2], None),
    ],
)
def test_expressions(spark, text, sites, masks):
    rows = [r for r in expression.with_result(nested(spark), text).orderBy("site_id").collect() if r.pass_site]
    assert [r.site_id for r in rows] == sites
    assert masks is None or [r.pass_samples for r in rows] == masks


@pytest.mark.parametrize("text", ["QUAL >", "NOPE > 1", "QUAL ? 2", "(QUAL > 1", "FOO(QUAL)"])
def test_bad_expressions(spark, text):
    with pytest.raises(ValueError):
        expression.Compiler(nested(spark)).compile(text)


def test_trim_and_annotation(spark):
    df = spark.createDataFrame([("TGACA", "TGCCA", "missense|G|x|0.5,,synonymous|.||")], "r string, a string, c string")
    t = df.select(transforms.trimmed(F.col("r"), F.col("a")).alias("t")).first()["t"]
    assert (t["shift"], t["REF"], t["ALT"]) == (2, "A", "C")
    names = annotation.fields('Consequence annotations from x. Format: Consequence|SYMBOL|STRAND|AF">')
    assert names == ["Consequence", "SYMBOL", "STRAND", "AF"]
    trs = df.select(annotation.transcripts(F.col("c"), names).alias("t")).first()["t"]
    assert [tuple(x) for x in trs] == [("missense", "G", None, 0.5), ("synonymous", None, None, None)]


VCF = """##fileformat=VCFv4.2
##contig=<ID=2,length=100>
##contig=<ID=10,length=100>
##INFO=<ID=DP,Number=2,Type=Integer,Description="Depth, total">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS²
10\t7\trs1\tA\tC,G\t50\tPASS\tDP=9;AF=0.5,.;DB\tGT:AD\t0/1:3,.,1\t./.
2\t5\t.\tAT\t.\t.\t.\tDP=.\tGT\t0|0\t1
"""


def test_vcf_layouts_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.vcf")
    (tmp_path / "x.vcf").write_text(VCF)
    h = vcf.read_header(spark, path)
    assert h.samples == ["S1", "S²"] and h.warnings == ["INFO/DP: Number=2 corrected to 1"] and list(h.contigs) == ["2", "10"]
    wide = vcf.read_vcf(spark, path)
    assert wide.columns[-1] == "FORMAT_AD_S²"
    a, b = wide.collect()
    assert (a.CHROM, a.POS, a.ALT, a.QUAL, a.FILTER, a.INFO_DP, a.INFO_AF, a.INFO_DB) == ("10", 7, ["C", "G"], 50.0, ["PASS"], 9, [0.5], True)
    assert (b.ID, b.ALT, b.QUAL, b.FILTER, b.INFO_DP, b.INFO_DB, b.FORMAT_GT_S1, b.FORMAT_AD_S1) == (None, [], None, [], None, False, "0|0", None)
    tidy = vcf.read_vcf(spark, path, layout="tidy")
    assert tidy.count() == 4 and tidy.where("SAMPLE_ID = 'S1' AND POS = 7").first().FORMAT_AD == [3, 1]
    assert [r.POS for r in vcf.read_vcf(spark, path, region="2:6-9").collect()] == [5] and vcf.read_vcf(spark, path, region="X").count() == 0
    vcf.write_parquet(tidy, str(tmp_path / "p"), h, ["SAMPLE_ID"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert "##contig=<ID=2" in vcf.stored_header(back)
    lines = [r.value for r in vcf.as_records(back, h, h.samples).collect()]
    assert lines[0].split("\t")[:2] == ["2", "5"] and lines[1].split("\t")[7:] == ["DP=9;AF=0.5;DB", "GT:AD", "0/1:3,1", "./.:."]


def test_snapshots(spark, tmp_path):
    t = lake.SnapshotTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert t.append(one) == 1
    with pytest.raises(ValueError):
        t.append(one.withColumn("w", F.lit(1)))
    t.append(spark.createDataFrame([(3, "c", 7)], "k int, v string, w int"), evolve=True, message="more")
    assert t.read().where("k = 1").first().w is None and t.read(1).columns == ["k", "v"]
    t.merge(spark.createDataFrame([(1, "A", 0), (9, "z", 1)], "k int, v string, w int"), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(1, "A", 0), (2, "b", None), (3, "c", 7), (9, "z", 1)] and t.read(2).count() == 3 and t.snapshot(2)["message"] == "more"
