"""Joins of call sets by site, interval and nearness."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.alleles import merge_calls
from lociframe.operators.windows import first_of_duplicates, neighbour

SITE_KEY = ["CHROM", "POS", "REF", "ALT"]


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = 1024, tasks: int | None = None) -> DataFrame:
    """Pairs of left (c, b, e, ...) and right (c2, b2, e2, ...) rows whose closed intervals overlap on a contig.

    Both sides are cut into bins of bin_size positions and meet by (contig, bin); a pair is kept in the first bin that both
    touch, so it comes once. Bins split a large contig over many tasks. bin_size should be near the common interval length:
    a row is repeated once per bin that it touches. tasks: bins are dealt to so many; else their number follows the bytes of the
    two sides, of which the pairs may be many times as much.
    """
    cut = lambda df, b, e: F.explode(F.sequence(F.floor(F.col(b) / bin_size), F.floor(F.col(e) / bin_size)))
    l, r = left.withColumn("_bin", cut(left, "b", "e")), right.withColumn("_bin2", cut(right, "b2", "e2"))  # noqa: E741
    if tasks:
        l, r = l.repartition(tasks, "c", "_bin"), r.repartition(tasks, "c2", "_bin2")  # noqa: E741
    first = F.floor(F.greatest("b", "b2") / bin_size)
    on = (F.col("c") == F.col("c2")) & (F.col("_bin") == F.col("_bin2")) & (F.col("b") <= F.col("e2")) & (F.col("b2") <= F.col("e")) & (F.col("_bin") == first)
    return l.join(r, on).drop("_bin", "_bin2")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, bin_size: int = 64, tasks: int | None = None) -> DataFrame:
    """key and the columns of right (c2, b2, e2, ...) for all rows of left (key, c, b, e) that overlap them. Rows of left at one span travel as
    one array and meet the other side once; the pairs are written out only behind the join, and are neither shuffled nor sorted."""
    spans = left.groupBy("c", "b", "e").agg(F.collect_list(key).alias("_keys"))
    return overlap_join(spans, right, bin_size, tasks).select(F.explode("_keys").alias(key), *right.columns)


LEVELS = 32  # positions are below 2^31


def stretches(b: Column, e: Column) -> Column:
    """(k, i) of the fewest stretches [i 2^k, (i + 1) 2^k) that the positions b to e fall into: two a level at most, none if e < b."""

    def of(k: Column) -> Column:
        l, r = F.call_function("shiftright", b + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", e + 1, k)  # noqa: E741
        stretch = lambda x, i: F.when((l < r) & (x.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(k.alias("k"), i.alias("i")))
        return F.array(stretch(l, l), stretch(r, r - 1))

    # a level more than the length has, as its logarithm may be rounded down
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(e - b + 1, F.lit(1)))).cast("int") + 1), of)))


def overlap_aggregates(spans: DataFrame, regions: DataFrame, combine: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Distinct spans (c, b, e) that a row of regions (c2, b2, e2, ...) overlaps, with columns of regions combined over those rows: for
    each a function as F.sum or F.min, for which parts may be combined first.

    No pairs are made. An interval over a span holds its first position, or begins after that and within it. For the first case intervals
    are combined by the stretches they fall into (see stretches), of which a position lies in one a level; for the second, by the
    stretches their beginning lies in, of which a span's other positions fall into few. Both grow with each side by itself.
    """
    own = [f(F.col(n)).alias(n) for n, f in combine.items()]
    b, e, b2, e2 = (F.col(x).cast("long") for x in ("b", "e", "b2", "e2"))
    above = lambda x: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("k"), F.call_function("shiftright", x, k).alias("i")))
    held = regions.select("*", F.inline(stretches(b2, e2))).groupBy(F.col("c2").alias("c"), "k", "i").agg(*own)
    first = spans.select("c", "b").distinct().select("c", "b", F.inline(above(b))).join(held, ["c", "k", "i"]).groupBy("c", "b").agg(*own)
    begins = regions.where("b2 <= e2").groupBy("c2", "b2").agg(*own)
    begun = begins.select("*", F.inline(above(b2))).groupBy(F.col("c2").alias("c"), "k", "i").agg(*own)
    later = spans.where("e > b").select("c", "b", "e", F.inline(stretches(b + 1, e))).join(begun, ["c", "k", "i"])
    both = spans.join(first, ["c", "b"]).select("c", "b", "e", *combine).unionByName(later.select("c", "b", "e", *combine))
    return both.groupBy("c", "b", "e").agg(*own)


def in_region(sites: DataFrame, chrom: str, begin: int, end: int, overlap: str = "record") -> DataFrame:
    """Sites in a region. record: the REF allele overlaps it; pos: POS lies in it. Both reach the Parquet scan as ranges."""
    if overlap == "pos":
        return sites.where((F.col("CHROM") == chrom) & F.col("POS").between(begin, end))
    return sites.where((F.col("CHROM") == chrom) & (F.col("POS") <= end) & (F.col("POS") + F.length("REF") - 1 >= begin))


def compared(*call_sets: DataFrame, keys: list[str] | None = None, counted: bool = False) -> DataFrame:
    """keys and mask: bit i is set if call set i has the site; counted: and _n, its records in each. One shuffle however many sets there are."""
    keys = keys or SITE_KEY
    tagged = [df.select(*keys, F.lit(1 << i).alias("bit")) for i, df in enumerate(call_sets)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    counts = [F.array(*(F.count_if(F.col("bit") == 1 << i) for i in range(len(call_sets)))).alias("_n")] if counted else []
    return rows.groupBy(*keys).agg(F.bit_or("bit").alias("mask"), *counts)


COMPATIBLE = ("none", "all", "some", "snps", "indels", "both", "id")


def with_match(sites: DataFrame, mode: str) -> DataFrame:
    """Sites with _match, which sites of one contig and POS share if they count as the same. ALT is an array.

    none: equal REF and ALTs; all: any alleles; snps, indels, both: any alleles of that type, others as for none; some: one
    ALT in common, a row for each; id: equal ID, whatever the place (sites without one have no match).
    """
    exact = F.concat_ws(">", "REF", F.array_join(F.array_sort("ALT"), ","))
    one = lambda a: F.when(F.length(a) != F.length("REF"), "indels").when(F.length(a) == 1, "snps").otherwise("others")
    if mode in ("snps", "indels", "both"):
        kinds = F.array_distinct(F.transform("ALT", one))
        wanted = ["snps", "indels"] if mode == "both" else [mode]
        kind = F.get(F.array_intersect(kinds, F.array(*map(F.lit, wanted))), F.lit(0))
        return sites.withColumn("_match", F.coalesce(kind, exact))
    if mode == "some":
        return sites.withColumn("_match", F.explode(F.transform("ALT", lambda a: F.concat_ws(">", F.col("REF"), a))))
    match = {"none": lambda: exact, "all": lambda: F.lit(""), "id": lambda: F.col("ID")}
    if mode not in match:
        raise ValueError(f"no such mode: {mode}")
    return sites.withColumn("_match", match[mode]())


def compatible(first: DataFrame, second: DataFrame, mode: str = "none", inside: bool = True) -> DataFrame:
    """Sites of first that second has (or lacks) in the sense of mode; see with_match. Neither side needs unique places."""
    keys, how = ["_match"] if mode == "id" else ["CHROM", "POS", "_match"], "left_semi" if inside else "left_anti"
    having = with_match(second, mode).select(*keys).distinct()
    if mode != "some":  # a row for each record, which says by itself whether it is met
        return with_match(first, mode).join(having, keys, how).select(*first.columns)
    own = F.struct("CHROM", "POS", "REF", "ALT")
    hit = with_match(first.withColumn("_id", own), mode).join(having, keys, "left_semi").select("_id").distinct()
    return first.withColumn("_id", own).join(hit, "_id", how).drop("_id")


def intersection(*call_sets: DataFrame, count: str, keys: list[str] | None = None, repeated: bool = False) -> DataFrame:
    """Sites by how many sets have them: count is "=2", "+2" (or more), "-2" (or fewer) or "~101" (exactly those sets). repeated:
    a site comes once for every choice of one record from each set that has it, as in a join, and else once."""
    mode, n = count[0], count[1:]
    sites = compared(*call_sets, keys=keys, counted=repeated)
    if repeated:
        several = F.aggregate("_n", F.lit(1).cast("long"), lambda a, x: a * F.greatest(x, F.lit(1)))
        sites = sites.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), several))).drop("_n")
    have = F.bit_count("mask")
    if mode == "~":
        return sites.where(F.col("mask") == sum(1 << i for i, b in enumerate(n) if b == "1"))
    return sites.where({"=": have == int(n), "+": have >= int(n), "-": have <= int(n)}[mode])


MERGE_RULES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def merge_sites(*call_sets: DataFrame, rules: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Union of sites; columns of one site are combined by rule: sum, avg, min, max, or join (sorted, comma between)."""
    keys = keys or SITE_KEY
    rows = call_sets[0].select(*keys, *rules)
    for df in call_sets[1:]:
        rows = rows.unionByName(df.select(*keys, *rules), allowMissingColumns=True)
    agg = [F.array_join(F.array_sort(F.collect_list(F.col(c).cast("string"))), ",").alias(c) if r == "join" else MERGE_RULES[r](c).alias(c) for c, r in rules.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_sets"), *agg)


def annotate(sites: DataFrame, notes: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Columns of notes by key. Modes: "=" overwrite, "+" only where missing, "." overwrite even with missing, ".+" only where
    the site has none and even with missing, "-" only where the site has a value, "&" append to the site's text. A name DST:=SRC takes the
    notes' column SRC for the sites' DST."""
    source = {c.partition(":=")[0]: c.partition(":=")[2] or c for c in columns}
    taken = notes.select(*keys, *(F.col(s).alias(f"_{c}") for c, s in source.items()), F.lit(True).alias("_hit"))
    out = sites.join(taken, keys, "left")
    for c, mode in zip(source, columns.values(), strict=True):
        own = F.col(c) if c in sites.columns else F.lit(None)
        new = F.col(f"_{c}")
        value = {"=": F.coalesce(new, own), "+": F.coalesce(own, new), ".+": F.coalesce(own, new), ".": F.when(F.col("_hit"), new).otherwise(own), "-": F.when(own.isNotNull(), F.coalesce(new, own)), "&": F.nullif(F.concat_ws(",", own.cast("string"), new.cast("string")), F.lit(""))}[mode]
        out = out.withColumn(c, value).drop(f"_{c}")
    return out.drop("_hit")


def marked(sites: DataFrame, notes: DataFrame, keys: list[str], name: str, present: bool = True) -> DataFrame:
    """Flag `name` at the sites that notes have, or that they lack."""
    hit = notes.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return sites.join(hit, keys, "left").withColumn(name, F.col("_hit").isNotNull() == F.lit(present)).drop("_hit")


COLLECT = {
    "first": lambda v, order: F.min_by(v, order), "append": lambda v, _: F.array_join(F.array_sort(F.collect_list(v.cast("string"))), ","),
    "unique": lambda v, _: F.array_join(F.array_sort(F.collect_set(v.cast("string"))), ","),
    "sum": lambda v, _: F.sum(v), "avg": lambda v, _: F.avg(v), "min": lambda v, _: F.min(v), "max": lambda v, _: F.max(v),
}


# columns whose parts can be combined, how, and the value that comes of them
PARTS = {
    "first": lambda v, order: ({"_p": (F.struct(order.alias("o"), v.alias("v")), F.min)}, F.col("_p.v")), "sum": lambda v, _: ({"_p": (v, F.sum)}, F.col("_p")),
    "avg": lambda v, _: ({"_p": (v, F.sum), "_n": (v.isNotNull().cast("long"), F.sum)}, F.try_divide("_p", "_n")),
    "min": lambda v, _: ({"_p": (v, F.min)}, F.col("_p")), "max": lambda v, _: ({"_p": (v, F.max)}, F.col("_p")),
}


def annotate_intervals(sites: DataFrame, regions: DataFrame, value: Column, logic: str, key: str = "site_id", order: str = "p_partkey", bin_size: int = 64, of_region: float = 0.0, of_site: float = 0.0, tasks: int | None = None) -> DataFrame:
    """key and note: what the intervals over a site say, combined by first, append, unique, sum, avg, min or max. The overlap
    must be a share of_region of the interval and of_site of the REF allele at least. key tells sites apart. Sites of one span meet
    the intervals once, and in no pairs where neither texts nor shares of overlaps are asked for."""
    span = [F.col("CHROM").alias("c"), F.col("POS").alias("b"), (F.col("POS") + F.length("REF") - 1).alias("e")]
    left = sites.select(*span).distinct()
    right = regions.select(F.col("c").alias("c2"), F.col("b").alias("b2"), F.col("e").alias("e2"), value.alias("_v"), F.col(order).alias("_o"))
    if logic in PARTS and not (of_region or of_site):
        parts, whole = PARTS[logic](F.col("_v"), F.col("_o"))
        given = right.select("c2", "b2", "e2", *(c.alias(n) for n, (c, _) in parts.items()))
        notes = overlap_aggregates(left, given, {n: f for n, (_, f) in parts.items()}).select("c", "b", "e", whole.alias("note"))
        return sites.select(key, *span).join(notes, ["c", "b", "e"]).select(key, "note")
    both = overlap_join(left, right, bin_size, tasks)
    if of_region or of_site:
        shared = F.least("e", "e2") - F.greatest("b", "b2") + 1
        both = both.where((shared >= of_region * (F.col("e2") - F.col("b2") + 1)) & (shared >= of_site * (F.col("e") - F.col("b") + 1)))
    notes = both.groupBy("c", "b", "e").agg(COLLECT[logic](F.col("_v"), F.col("_o")).alias("note"))
    return sites.select(key, *span).join(notes, ["c", "b", "e"]).select(key, "note")


def overlap_counts(left: DataFrame, right: DataFrame, key: str, bin_size: int = 1024) -> DataFrame:
    """key and n: how many rows of left (c, b, e) overlap a row of right (key, c2, b2, e2), for those that any does. Rows of left at
    one span are counted before they meet the other side."""
    spans = left.groupBy("c", "b", "e").agg(F.count("*").alias("_n"))
    return overlap_join(spans, right, bin_size).groupBy(key).agg(F.sum("_n").alias("n"))


def nearest(sites: DataFrame) -> DataFrame:
    """CHROM, POS, rev, fwd, nearest: distances to the previous and next distinct position of the contig; null without one."""
    pos = sites.select("CHROM", "POS").distinct()
    out = neighbour(neighbour(pos, "_before", F.col("POS"), -1), "_after", F.col("POS"), 1)
    out = out.select("CHROM", "POS", (F.col("POS") - F.col("_before")).alias("rev"), (F.col("_after") - F.col("POS")).alias("fwd"))
    return out.withColumn("nearest", F.least("rev", "fwd"))


PAIRS, LEAST_BIN, TOGETHER = 1 << 20, 1 << 12, 256  # pairs and sites whose sums a task takes at once; positions in a bin


def linkage(tidy: DataFrame, dosage: Column, window: int) -> DataFrame:
    """Squared correlation of dosages for pairs of sites of a contig at most `window` positions apart, over the samples called at
    both; records of one position with different alleles are sites each, and make no pair with each other. Rows without alleles are
    of one site by position: where a sample has several dosages at a site, each is paired with each of the other site's.

    A site's dosages travel as one array, to its own bin of positions and the next if that is near; pairs meet in the later site's. A site has a
    row a sample, with the number, sum and sum of squares of its dosages, however many records it has. A bin's counts and sums over samples
    are products of matrices, of some rows at a time with all sites within reach, and leave the task as they come.
    """
    own = [c for c in ("REF", "ALT") if c in tidy.columns]
    d = dosage.cast("double")
    each = tidy.groupBy("CHROM", "POS", *own, F.col("sample_id").cast("string").alias("s")).agg(F.count(d).cast("double").alias("n"), F.coalesce(F.sum(d), F.lit(0.0)).alias("x"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("q"))
    s = each.groupBy("CHROM", "POS", *own).agg(F.collect_list(F.struct("s", "n", "x", "q")).alias("g"))
    width = max(window, LEAST_BIN)
    at = F.floor(F.col("POS") / width)
    binned = s.select("CHROM", F.col("POS").cast("long").alias("POS"), "g", at.alias("at"), F.explode(F.sequence(at, F.floor((F.col("POS") + window) / width))).alias("bin"))

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.take(pa.array(np.argsort(table.column("POS").to_numpy(), kind="stable")))
        pos, late = table.column("POS").to_numpy(), table.column("at").to_numpy() == key[1].as_py()
        g = table.column("g").combine_chunks()
        row, items = np.repeat(np.arange(len(g)), g.value_lengths().to_numpy()), g.flatten()
        _, sample = np.unique(items.field("s").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        m, x, q = (np.zeros((len(g), int(sample.max(initial=-1)) + 1)) for _ in range(3))
        for v, name in ((m, "n"), (x, "x"), (q, "q")):
            v[row, sample] = items.field(name).to_numpy(zero_copy_only=False)
        later = np.flatnonzero(late)
        step = max(1, min(TOGETHER, PAIRS // max(1, len(pos))))
        for i in range(0, len(later), step):
            j = later[i : i + step]
            lo, hi = np.searchsorted(pos, pos[j[0]] - window), np.searchsorted(pos, pos[j[-1]])
            k = slice(lo, hi)
            n, sx, sy, xy = m[j] @ m[k].T, m[j] @ x[k].T, x[j] @ m[k].T, x[j] @ x[k].T
            xx, yy = m[j] @ q[k].T, q[j] @ m[k].T
            b, a = np.nonzero((pos[j][:, None] > pos[k][None]) & (pos[j][:, None] - pos[k][None] <= window))
            n, sx, sy, xy, xx, yy = (v[b, a] for v in (n, sx, sy, xy, xx, yy))
            cov, vx, vy = n * xy - sx * sy, n * xx - sx * sx, n * yy - sy * sy
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where((vx > 0) & (vy > 0), cov * cov / (vx * vy), np.nan)
            yield pa.record_batch({"CHROM": pa.array([key[0].as_py()] * len(a), pa.string()), "pos1": pos[k][a], "pos2": pos[j][b], "n": n.astype(np.int32), "r2": pa.array(r2, mask=np.isnan(r2))})

    return binned.groupBy("CHROM", "bin").applyInArrow(pairs, "CHROM string, pos1 long, pos2 long, n int, r2 double")


def merge_records(*call_sets: DataFrame, filters: str = "x", by: Sequence[str] = ()) -> DataFrame:
    """Call sets in the nested layout as one, with genotypes: CHROM, POS, REF, ALT, QUAL, FILTER, samples. All records of a
    place become one, several of a set the n-th with the n-th; see alleles.merge_calls for the rules, for by and for other fields."""
    bare = [df.withColumn("samples", F.transform("samples", lambda s: F.struct(s["sample_id"].alias("sample_id"), s["GT"].alias("GT")))) for df in call_sets]
    plain = [df.drop(*(c for c in df.columns if c.startswith("INFO_"))) for df in bare]
    return merge_calls(*plain, filters=filters, by=by).drop("ID")


def concatenated(*call_sets: DataFrame, duplicates: str | None = None) -> DataFrame:
    """All records of sets with the same samples; duplicates "none" drops records that an earlier set has with equal alleles,
    "all" those at a position that an earlier set has."""
    if duplicates is None:
        out = call_sets[0]
        for df in call_sets[1:]:
            out = out.unionByName(df)
        return out
    keys = SITE_KEY if duplicates == "none" else ["CHROM", "POS"]
    out = None
    for i, df in enumerate(call_sets):
        t = df.withColumn("_i", F.lit(i))
        out = t if out is None else out.unionByName(t)
    first = out.groupBy(*keys).agg(F.min("_i").alias("_first"))
    return out.join(first, keys).where(F.col("_i") == F.col("_first")).drop("_i", "_first")


def first_matching(sites: DataFrame, mode: str, order: str) -> DataFrame:
    """Of the records of a position that count as the same in the sense of mode (see with_match) the first by order."""
    return first_of_duplicates(with_match(sites, mode), ["CHROM", "POS", "_match"], order).drop("_match")
