"""The splitting source: every split size gives the file's records, once each."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lociframe.sources import blocks, vcf

HEADER = '##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="g">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1'


def lines():
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    out = [f"chr{1 + i // 700}\t{i * 3}\t{'.' if i % 3 else f'rs{i}'}\t{'A' * (1 + i % 4)}\t{'C,G' if i % 5 else '.'}\t{i % 50 if i % 7 else '.'}\tPASS\tDP={i};X={noise(rng.randrange(300))}\tGT\t0/{i % 2}" for i in range(2000)]
    out[1000] = out[1000].replace("DP=", "Y=" + noise(300_000) + ";DP=")  # a line of several blocks
    return [*out, "chrX\tx\t.\tA\tC\t1\tq\t.", "chrX\t5"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    top, text = tmp_path_factory.mktemp("blocks"), "\n".join([HEADER, *lines()]) + "\n"
    rows = spark.createDataFrame(list(enumerate(lines())), "i int, value string").repartitionByRange(3, "i").sortWithinPartitions("i").select("value")
    blocks.register(spark)
    rows.write.format("variant_lines").mode("append").option("path", str(top / "parts")).option("header", HEADER).save()
    whole = b"".join(p.read_bytes() for p in sorted((top / "parts").glob("part-*")))
    assert gzip.decompress(whole).decode() == text  # any gzip reader takes it
    (top / "one.vcf.gz").write_bytes(whole)
    (top / "plain.vcf").write_text(text)
    (top / "windows.vcf").write_text(text.replace("\n", "\r\n"), newline="")
    (top / "stream.vcf.gz").write_bytes(gzip.compress(text.encode()))
    (top / "no_end.vcf.gz").write_bytes(whole.removesuffix(blocks.END))
    (top / "open.vcf").write_text(text.removesuffix("\n"))
    (top / "empty.vcf.gz").write_bytes(blocks.END)
    return top


def load(spark, path, **options):
    return spark.read.format("variant_lines").options(**options).load(str(path))


@pytest.mark.parametrize("name", ["one.vcf.gz", "no_end.vcf.gz", "plain.vcf", "windows.vcf", "open.vcf", "stream.vcf.gz", "parts"])
@pytest.mark.parametrize("split", [20_011, 70_000, 400_000, 10**9])
def test_any_split(spark, files, name, split):
    df = load(spark, files / name, splitbytes=split)
    got = [r.value for r in df.select("value").collect()]
    assert got == lines() if name != "parts" else sorted(got) == sorted(lines())
    if split == 70_000 and name in ("one.vcf.gz", "plain.vcf"):
        assert df.rdd.getNumPartitions() > 5


def test_tiny_splits_of_a_piece(files):
    """Every border that a block or a line can have, without Spark: ranges of one byte up."""
    data = blocks.block(b"ab\nc") + blocks.block(b"\n") + blocks.block(b"de") + blocks.block(b"") + blocks.block(b"f\n\ng\n") + blocks.END
    (files / "tiny.gz").write_bytes(data)
    for step in range(1, len(data) + 1, 3):
        reader = blocks.LineReader([str(files / "tiny.gz")], ["value"], step)
        assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column(0).to_pylist()] == ["ab", "c", "def", "g"]


def test_magic_bytes_inside_a_block(files):
    held = b"x\n" + blocks.block(b"inner") * 3 + b"\n"
    packed = blocks.zlib.compressobj(0, blocks.zlib.DEFLATED, -15)
    body = packed.compress(held) + packed.flush()
    outer = blocks.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + blocks.struct.pack("<H", len(body) + 25) + body + blocks.struct.pack("<II", blocks.zlib.crc32(held), len(held))
    assert gzip.decompress(outer) == held
    (files / "inner.gz").write_bytes(outer + blocks.block(b"y\n") + blocks.END)
    with (files / "inner.gz").open("rb") as f:
        assert blocks.first_block(f, 1, (files / "inner.gz").stat().st_size) == len(outer)


def test_damaged_blocks_are_errors(spark, files):
    data = bytearray((files / "one.vcf.gz").read_bytes())
    (files / "short.vcf.gz").write_bytes(data[: len(data) // 2])
    data[len(data) // 3] ^= 0xFF
    (files / "bad.vcf.gz").write_bytes(data)
    for name in ("short.vcf.gz", "bad.vcf.gz"):
        with pytest.raises(Exception, match="damaged|checksum|no block begins|invalid|Error -3"):
            load(spark, files / name).count()
    whole = (files / "one.vcf.gz").read_bytes()
    (files / "short.vcf.gz").write_bytes(whole[:-40])
    for split in (len(whole) - 41, len(whole) - 2000, 30_000):  # the last partition has only the cut block
        with pytest.raises(Exception, match="damaged|no block begins"):
            load(spark, files / "short.vcf.gz", splitbytes=split).count()


def test_filters_are_pushed(spark, files):
    df = load(spark, files / "one.vcf.gz", splitbytes=70_000)
    near = df.where("CHROM IN ('chr2', 'chr9') AND POS <= 4000 AND LAST >= 3000 AND QUAL > 10")
    plan = near._jdf.queryExecution().executedPlan().toString()
    left = next(x for x in plan.split("\n") if "Filter" in x)
    assert "QUAL" in left and "<= 4000" not in left and ">= 3000" not in left and "chr9" not in left
    want = [x for x in map(blocks.record, lines()) if x[0] == "chr2" and x[1] <= 4000 and x[2] >= 3000 and (x[6] or 0) > 10]
    assert sorted(r.value for r in near.collect()) == sorted(x[-1] for x in want) and want
    assert df.where("POS < 0").count() == 0 and df.where("CHROM = 'chrX' AND POS = 5").count() == 1
    assert load(spark, files / "empty.vcf.gz").count() == 0


def test_sql_using(spark, files):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW calls USING variant_lines OPTIONS (path '{files / 'one.vcf.gz'}', splitbytes '60000', columns 'CHROM,POS,REF,ALT,QUAL,FILTER,INFO,ID')")
    r = spark.sql("SELECT count(*) AS n, count(ID) AS ids, count(QUAL) AS quals, sum(size(ALT)) AS alts, max(POS) AS last FROM calls WHERE CHROM <> 'chrX'").first()
    assert tuple(r) == (2000, sum(i % 3 == 0 for i in range(2000)), sum(i % 7 > 0 for i in range(2000)), 2 * sum(i % 5 > 0 for i in range(2000)), 5997)
    with pytest.raises(Exception, match="no such columns"):
        load(spark, files / "one.vcf.gz", columns="POS,NAME").count()


def test_read_vcf_is_the_plain_file_at_any_split(spark, files):
    for options in ({}, {"region": "chr2:3000-4000"}, {"region": "chr3"}, {"layout": "tidy", "region": "chr1:9"}):
        want = sorted(map(str, vcf.read_vcf(spark, str(files / "plain.vcf"), **options).collect()))
        for split in (30_000, 200_000):
            df = vcf.read_vcf(spark, str(files / "one.vcf.gz"), split=split, **options)
            assert sorted(map(str, df.collect())) == want
    assert vcf.read_vcf(spark, str(files / "one.vcf.gz"), split=30_000).rdd.getNumPartitions() > 5


def test_block_output_round_trip(spark, files, tmp_path):
    header = vcf.read_header(spark, str(files / "plain.vcf"))
    tidy = vcf.read_vcf(spark, str(files / "plain.vcf"), layout="tidy").where(F.col("POS").between(1, 900) & (F.col("CHROM") != "chrX"))
    vcf.write_vcf(tidy, str(tmp_path / "out"), header, ["s1"], "blocks")
    again = vcf.read_vcf(spark, [str(p) for p in sorted((tmp_path / "out").glob("part-*"))], layout="tidy")
    assert sorted(map(str, again.collect())) == sorted(map(str, tidy.collect()))
    with pytest.raises(Exception, match="FileExists|exists"):
        spark.range(1).selectExpr("'x' AS value").write.format("variant_lines").mode("append").option("path", str(files / "one.vcf.gz")).save()
