"""From a variant file to expressions, formats, families and SQL."""

import pytest
from pyspark.sql import functions as F

from lociframe.functions import expression, formatting
from lociframe.operators import selection, transforms, trios
from lociframe.sources import vcf

VCF = """##fileformat=VCFv4.2
##contig=<ID=2,length=100>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations from a tool. Format: Allele|Consequence|SYMBOL|STRAND|AF">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="a">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tkid\tdad\tmum
2\t5\trs1\tA\tC\t50\tPASS\tDP=9;DP=4;CSQ=C|missense|G1|1|0.5,C|intron|G2|-1|;DB\tGT:DP:AD\t0/1:7:3,4\t0|1:9:5,4\t0/0:8:8,0
2\t9\t.\tAT\tA,G\t.\tq10\tXDP=3\tGT:DP\t1/2:3\t0/0:.\t./.:2
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "x.vcf"
    p.write_text(VCF)
    return str(p)


def test_repeated_info_keys(spark, path):
    a, b = vcf.read_vcf(spark, path).orderBy("POS").collect()
    assert (a.INFO_DP, a.INFO_DB, b.INFO_DP, b.INFO_DB) == (9, True, None, False)


@pytest.mark.parametrize("text, want", [("INFO/DP > 1", [5]), ('GT = "het"', [5, 9]), ("FMT/DP > 8", [5]), ('INFO/DB = 1 && FMT/DP[1] > 8', [5]), ('TYPE ~ "indel"', [9]), ("N_PASS(FMT/DP < 5) = 2", [9]), ('FILTER = "q10"', [9]), ("AD[0:1] > 3", [5]), ("FISHER(AD, AD) < 2", [5])])
def test_expressions_on_a_file(spark, path, text, want):
    df = vcf.read_vcf(spark, path, "nested")
    assert [r.POS for r in expression.include(df, text).orderBy("POS").collect()] == want


def test_files_of_names_and_given_values(spark, path, tmp_path):
    (tmp_path / "ids").write_text("rs1\nrs7\n")
    (tmp_path / "people").write_text("dad\nmum\n")
    df = vcf.read_vcf(spark, path, "nested")
    ids, people = f"@{tmp_path / 'ids'}", f"@{tmp_path / 'people'}"
    where = lambda text, *given: [r.POS for r in expression.include(df, text, *given).orderBy("POS").collect()]
    assert where(f"ID = {ids}") == [5] and where(f"ID != {ids}") == [9]
    assert where(f"FMT/DP[{people}] = 7") == [] and where(f"FMT/DP[{people}] = 9") == [5]
    assert where("QUAL > {FLOAT} && FILTER = {STR}", 10, "PASS") == [5] and where("QUAL > {}", 60) == []
    with pytest.raises(ValueError):
        where("QUAL > {}")


def test_formats_families_and_selection(spark, path):
    df = vcf.read_vcf(spark, path, "nested")
    lines = [r[0] for r in df.orderBy("POS").select(formatting.formatted(r"%CHROM:%POS[ %SAMPLE=%GT]", {"GT", "DP"})).collect()]
    assert lines[0] == "2:5 kid=0/1 dad=0|1 mum=0/0"
    assert [r.n_good for r in trios.mendelian_counts(df, [("kid", "dad", "mum")]).collect()] == [1]
    assert [r.POS for r in df.where(selection.known()).collect()] == [5] and [r.POS for r in df.where(selection.allele_number(3)).collect()] == [9]
    split = transforms.split_genotypes(df).where("POS = 9").orderBy("allele").collect()
    assert [(r.ALT, r.samples[0].GT, r.samples[1].GT) for r in split] == [("A", "1/.", "0/0"), ("G", "./1", "0/0")]


def test_vep_columns(spark, path):
    every = vcf.read_vcf(spark, path, vep="all").orderBy("POS").collect()
    assert every[0].VEP_Consequence == ["missense", "intron"] and every[0].VEP_STRAND == [1, -1] and every[1].VEP_AF is None
    first = vcf.read_vcf(spark, path, vep="first", vep_fields=["SYMBOL", "AF"]).orderBy("POS")
    assert [c for c in first.columns if c.startswith("VEP_")] == ["VEP_SYMBOL", "VEP_AF"] and first.first().VEP_SYMBOL == "G1"


def test_several_files_views_and_text(spark, path, tmp_path):
    other = tmp_path / "y.vcf"
    other.write_text(VCF.replace("\n2\t5", "\n2\t6").replace("\n2\t9", "\n2\t99"))
    both = vcf.read_vcf(spark, [path, str(other)])
    assert sorted(r.POS for r in both.collect()) == [5, 6, 9, 99]
    vcf.lazy_view(spark, "calls", [path, str(other)], layout="tidy")
    assert spark.sql("SELECT count(*) FROM calls WHERE SAMPLE_ID = 'dad'").first()[0] == 4
    h = vcf.read_header(spark, path)
    tidy = vcf.read_vcf(spark, path, "tidy", keep_missing=True)
    vcf.write_vcf(tidy, str(tmp_path / "out"), h, h.samples)
    back = spark.read.text(str(tmp_path / "out"))
    lines = [r[0] for r in back.collect()]
    assert sum(x.startswith("##") for x in lines) == len(h.lines) and sum(x.startswith("#CHROM") for x in lines) == 1 and sum(not x.startswith("#") for x in lines) == 2
    vcf.split_by_sample(tidy, str(tmp_path / "people"))
    assert spark.read.parquet(str(tmp_path / "people" / "SAMPLE_ID=mum")).count() == 2


@pytest.mark.parametrize("number, allele, want", [("A", 2, [20]), ("R", 1, [10, 20]), ("G", 1, [10, 20, 30]), ("G", 2, [10, 40, 60])])
def test_lists_of_one_allele(spark, number, allele, want):
    df = spark.createDataFrame([([10, 20, 30, 40, 50, 60], allele)], "v array<int>, a int")
    assert df.select(transforms.values_of_allele(F.col("v"), number, F.col("a"))).first()[0] == want
