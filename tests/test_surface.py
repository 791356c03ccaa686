"""What SQL can't compare: sketches within their errors, header lines, checks that raise, field removal."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lociframe.functions import formatting
from lociframe.operators import cohort, joins, transforms, windows
from lociframe.plans.derive import rich, sites

DIR = "/root/testdata/sf0.01"


def test_sketches_are_near(spark):
    s = sites(spark, DIR)
    exact = {r.CHROM: r for r in s.groupBy("CHROM").agg(F.countDistinct("POS").alias("n_pos"), F.countDistinct("site_id").alias("n_sites"), F.array(*(F.expr(f"percentile(QUAL, {q})") for q in (0.25, 0.5, 0.75))).alias("quartiles")).collect()}
    for r in entry.queries()["approximate_aggregates"](spark, DIR).collect():
        want = exact[r.CHROM]
        assert abs(r.n_pos / want.n_pos - 1) < 0.1 and abs(r.n_sites / want.n_sites - 1) < 0.1
        assert all(abs(a - b) < 0.02 * max(want.quartiles) for a, b in zip(r.quartiles, want.quartiles, strict=True))


def test_header_line():
    assert formatting.header(r"%CHROM\t%N_PASS(GQ > 5)[ %GT %PBINOM(AD)]", ["a", "b"]) == "#[1]CHROM\t[2]N_PASS(GQ > 5)\t[3]a:GT\t[4]a:PBINOM(AD)\t[5]b:GT\t[6]b:PBINOM(AD)"


def test_check_ref_raises(spark):
    df = spark.createDataFrame([("c", 1, "A", "C"), ("c", 2, "G", "T")], "CHROM string, POS int, REF string, ALT string")
    good, bad = (spark.createDataFrame([("c", 1, "A"), ("c", 2, x)], "CHROM string, POS int, base string") for x in "GT")
    assert cohort.checked_ref(df, good, ["CHROM", "POS"], "e").count() == 2
    with pytest.raises(Exception, match="REF differs from the reference at c:2"):
        cohort.checked_ref(df, bad, ["CHROM", "POS"], "e").collect()
    for f in (lambda: cohort.checked_ref(df, good, ["CHROM", "POS"], "z"), lambda: joins.with_match(df, "z"), lambda: transforms.without_fields(df, "NOPE")):
        with pytest.raises(ValueError):
            f()


def test_fields_of_samples_and_all_filters(spark):
    t = transforms.without_fields(rich(spark, DIR), "FORMAT/GT", "FILTER", "QUAL")
    assert t.schema["samples"].dataType.elementType.names == ["sample_id"]
    assert t.where("size(FILTER) > 0 or QUAL is not null").count() == 0


def test_merge_filters(spark):
    schema = "CHROM string, POS int, REF string, ALT array<string>, QUAL double, FILTER array<string>, samples array<struct<sample_id:int,GT:string>>"
    a = spark.createDataFrame([("c", 1, "A", ["C"], 5.0, ["PASS"], [(0, "0/1")]), ("c", 2, "A", ["C"], None, ["low"], [(0, "1|0")])], schema)
    b = spark.createDataFrame([("c", 1, "A", ["G"], 9.0, ["low"], [(0, "1")]), ("c", 2, "A", ["T", "C"], 1.0, ["x"], [(0, "2|1")])], schema)
    x, y = joins.merge_records(a, b).orderBy("POS").collect()
    assert (x.ALT, x.QUAL, x.FILTER, [s.GT for s in x.samples]) == (["C", "G"], 9.0, ["PASS"], ["0/1", "2"])
    assert (y.ALT, y.FILTER, [s.GT for s in y.samples]) == (["C", "T"], ["low", "x"], ["1|0", "1|2"])
    assert joins.merge_records(a, b, filters="+").orderBy("POS").first().FILTER == ["low"]


@pytest.mark.parametrize("rule", ["1st", "maxAF"])
def test_prune_sliding_brute(spark, rule):
    rows = sorted((r.CHROM, r.POS, r.QUAL, r.site_id) for r in sites(spark, DIR).collect())
    want, window = set(), []
    for c, p, q, i in rows:
        window = [x for x in window if x[0] == c and p - x[1] < 100] + [(c, p, -1.0 if q is None else q, i)]
        want.add(i)
        if len(window) > 2:
            gone = window[-1] if rule == "1st" else min(window, key=lambda x: (x[2], -x[1]))
            window.remove(gone)
            want.discard(gone[3])
    got = {r.site_id for r in windows.prune_sliding(sites(spark, DIR), 100, 2, rule, "QUAL", block=500).collect()}
    assert got == want and len(got) < len(rows)
