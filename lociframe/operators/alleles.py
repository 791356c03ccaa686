"""Alleles in step: genotypes and lists of Number A, R and G follow their alleles through splitting, joining, trimming,
swapping and merging of records. All work on the nested layout: a row per record, with ALT and samples as arrays.

A record's new alleles are given by `order`: for every new allele, REF first, its number among the old ones, or null where the
record lacks it. Everything is computed from a record's own arrays; only records of one place meet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lociframe.functions import variants as V
from lociframe.sources.vcf import FORMAT_NUMBER, INFO_NUMBER

BY_ALLELE = ("A", "R", "G")
PLAIN = "(?i)^[ACGTN]+$"


def renumbered(gt: Column, new: Column) -> Column:
    """Genotype with new[a] for each allele number a, missing where that is null; every separator stays."""
    number = lambda t: F.coalesce(F.get(new, t.try_cast("int")).cast("string"), F.lit("."))
    separator = lambda t: t.isin("/", "|")
    at = [F.substring(gt, i, 1) for i in (1, 2, 3)]
    # the usual texts, of one or two alleles of one digit, are taken apart by place; only others are split
    one = (F.length(gt) == 1) & ~separator(gt)
    two = (F.length(gt) == 3) & separator(at[1]) & ~separator(at[0]) & ~separator(at[2])
    token = lambda t: F.when(separator(t) | (t == "."), t).otherwise(number(t))
    whole = F.array_join(F.transform(F.split(gt, "(?<=[/|])|(?=[/|])"), token), "")
    same = gt.isin("./.", ".") | gt.isin("0/0", "0|0") & (F.get(new, F.lit(0)) == 0)
    return F.when(same, gt).when(two, F.concat(number(at[0]), at[1], number(at[2]))).when(one, number(gt)).otherwise(whole)


def pair_places(order: Column) -> Column:
    """For every unphased pair (i, j) of new alleles, i <= j in their order, the place of the pair among the old ones, j (j + 1) / 2 + i; or null."""
    place = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b) * (F.greatest(a, b) + 1) / 2 + F.least(a, b)).cast("int")
    return F.flatten(F.transform(order, lambda b, j: F.transform(F.slice(order, F.lit(1), j + 1), lambda a: place(a, b))))


def reordered(values: Column, number: str, order: Column, n_old: Column, pairs: Column | None = None) -> Column:
    """A list of Number A, R or G by the new alleles; null for those the record lacks. Number G counts unphased pairs by pair_places,
    or alleles where the list is as long as a haploid one; pairs: those places, where they are at hand. A list of another length is null."""
    get = lambda i: F.get(values, i.cast("int"))
    if number == "A":
        return F.when(F.size(values) == n_old - 1, F.transform(F.slice(order, F.lit(2), F.size(order)), lambda o: get(o - 1)))
    by_allele = F.transform(order, get)
    if number == "R":
        return F.when(F.size(values) == n_old, by_allele)
    if number != "G":
        raise ValueError(f"no list by alleles: {number}")
    by_pair = F.transform(pair_places(order) if pairs is None else pairs, get)
    return F.when(F.size(values) == n_old, by_allele).when(F.size(values) == (n_old * (n_old + 1) / 2).cast("int"), by_pair)


def list_fields(rows: DataFrame, numbers: Mapping[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """The columns INFO_<tag> and the sample fields that are lists by alleles, with their Number: by `numbers` (INFO_<tag> or
    field), else by the reserved tags."""
    numbers = numbers or {}
    info = {f.name: numbers.get(f.name, INFO_NUMBER.get(f.name.removeprefix("INFO_"))) for f in rows.schema if f.name.startswith("INFO_") and isinstance(f.dataType, ArrayType)}
    fields = rows.schema["samples"].dataType.elementType if "samples" in rows.columns else StructType()
    fmt = {f.name: numbers.get(f.name, FORMAT_NUMBER.get(f.name)) for f in fields if isinstance(f.dataType, ArrayType)}
    keep = lambda found: {k: n for k, n in found.items() if n in BY_ALLELE}
    return keep(info), keep(fmt)


def new_numbers(order: Column, n_old: Column) -> Column:
    """For every old allele its new number, or null."""
    return F.transform(F.sequence(F.lit(0), n_old - 1), lambda o: F.nullif(F.array_position(order, o.cast("int")), F.lit(0)) - 1)


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are evaluated once a row, however often and in whatever lambda they are used after."""
    return rows.select(*(c for c in rows.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_alleles(rows: DataFrame, order: str, n_old: str, numbers: Mapping[str, str] | None = None) -> DataFrame:
    """rows whose genotypes and lists follow the columns order and n_old (alleles before); these two are dropped."""
    info, fmt = list_fields(rows, numbers)
    o, n, names = F.col(order), F.col(n_old), rows.columns
    rows = fixed(fixed(rows, **{order: o, n_old: n}), _new=new_numbers(o, n), _pairs=pair_places(o))
    rows = rows.withColumns({c: reordered(F.col(c), number, o, n, F.col("_pairs")) for c, number in info.items()})
    if "samples" in rows.columns:

        def one(s: Column) -> Column:
            s = s.withField("GT", renumbered(s["GT"], F.col("_new")))
            return reduce(lambda x, f: x.withField(f[0], reordered(x[f[0]], f[1], o, n, F.col("_pairs"))), fmt.items(), s)

        rows = rows.withColumn("samples", F.transform("samples", one))
    return rows.select(*(c for c in names if c not in (order, n_old)))


def split_records(rows: DataFrame, numbers: Mapping[str, str] | None = None, old_record: str | None = None, keep_sum: tuple[str, ...] = ()) -> DataFrame:
    """A row per ALT allele with its number: its genotypes tell it (1) from REF (0), other ALTs are missing, and its lists have
    its own values. ALT is an array of one. old_record names a column for CHROM|POS|REF|ALT|number of the record split. Of Number R
    fields in keep_sum the reads of other ALTs count for REF. Records without ALT stay, with a null number."""
    t = rows.select(*[c for c in rows.columns if c != "ALT"], F.col("ALT").alias("_alt"), F.posexplode_outer("ALT").alias("_i", "_one"))
    t = t.withColumns({"allele": F.col("_i") + 1, "_n": F.size("_alt") + 1})
    if old_record:
        text = F.concat_ws("|", "CHROM", F.col("POS").cast("string"), "REF", F.array_join("_alt", ","), F.col("allele").cast("string"))
        t = t.withColumn(old_record, F.when(F.col("_n") > 2, text))
    for name in keep_sum:
        others = lambda v: F.aggregate(F.filter(v, lambda x, j: (j > 0) & (j != F.col("allele"))), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
        summed = lambda v: F.when((F.size(v) == F.col("_n")) & F.col("allele").isNotNull(), F.transform(v, lambda x, j: F.when(j == 0, x + others(v)).otherwise(x).cast("int"))).otherwise(v)
        t = t.withColumn("samples", F.transform("samples", lambda s: s.withField(name, summed(s[name]))))  # noqa: B023  used at once
    t = t.withColumn("_order", F.when(F.col("allele").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.col("allele"))))
    out = with_alleles(t, "_order", "_n", numbers)
    return out.withColumn("ALT", F.when(F.col("_one").isNull(), F.col("_alt")).otherwise(F.array("_one"))).select(*rows.columns, "allele", *([old_record] if old_record else []))


def trim_records(rows: DataFrame, numbers: Mapping[str, str] | None = None, unseen: bool = False) -> DataFrame:
    """Records without the ALTs that no genotype has, or if `unseen`, without <*>, <X> and <NON_REF> alone, at sites that have
    other ALTs too. Genotypes and lists follow; a record may be left without ALT."""
    every = F.sequence(F.lit(1), F.size("ALT"))
    if unseen:
        symbol = lambda i: F.get("ALT", i - 1).isin("<*>", "<X>", "<NON_REF>")
        kept = F.filter(every, lambda i: ~symbol(i))
        kept = F.when(F.size(kept) > 0, kept).otherwise(every)
    else:
        called = F.array_distinct(F.flatten(F.transform("samples", lambda s: F.split(s["GT"], "[/|]"))))
        kept = F.filter(every, lambda i: F.array_contains(called, i.cast("string")))
    kept = F.when(F.size("ALT") > 0, kept).otherwise(F.array().cast("array<int>"))
    t = rows.withColumns({"_order": F.concat(F.array(F.lit(0)), kept), "_n": F.size("ALT") + 1})
    t = t.withColumn("_alt", F.transform(F.slice("_order", F.lit(2), F.size("_order")), lambda i: F.get(F.col("ALT"), i - 1)))
    return with_alleles(t, "_order", "_n", numbers).withColumn("ALT", F.col("_alt")).drop("_alt")


def swap_records(rows: DataFrame, where: Column, numbers: Mapping[str, str] | None = None) -> DataFrame:
    """Records of one ALT with REF and ALT exchanged at the sites of `where`: genotypes and lists follow."""
    swap = F.coalesce(where & (F.size("ALT") == 1), F.lit(False))
    every = F.sequence(F.lit(0), F.size("ALT"))
    t = rows.withColumns({"_swap": swap, "_order": F.when(swap, F.array(F.lit(1), F.lit(0))).otherwise(every), "_n": F.size("ALT") + 1})
    t = with_alleles(t, "_order", "_n", numbers)
    return t.withColumns({"REF": F.when(F.col("_swap"), F.get("ALT", F.lit(0))).otherwise(F.col("REF")), "ALT": F.when(F.col("_swap"), F.array("REF")).otherwise(F.col("ALT"))}).drop("_swap")


# --- merging -----------------------------------------------------------------------------------------------------------

POLICIES = ("none", "snps", "indels", "both", "snp-ins-del", "all", "id")


def merge_key(policy: str) -> Column:
    """What records of one place share if they may become one. Of snps, indels, both and snp-ins-del a record without ALT counts
    as a SNP; records that a policy does not bring together need equal REF and ALTs."""
    exact = F.concat_ws(">", "REF", F.array_join(F.array_sort("ALT"), ","))
    longer, shorter = (F.exists("ALT", f) for f in (lambda a: ~a.startswith("<") & (F.length(a) > F.length("REF")), lambda a: ~a.startswith("<") & (F.length(a) < F.length("REF"))))
    kind = F.when(longer | shorter, "indel").otherwise("snp")
    fine = F.when(longer & shorter, "indel").when(longer, "ins").when(shorter, "del").otherwise("snp")
    keys = {
        "none": exact, "all": F.lit(""), "both": kind, "snp-ins-del": fine, "snps": F.when(kind == "snp", "snp").otherwise(exact),
        "indels": F.when(kind == "indel", "indel").otherwise(exact), "id": F.coalesce("ID", exact) if policy == "id" else exact,
    }
    if policy not in keys:
        raise ValueError(f"no such policy: {policy}")
    return keys[policy]


def _combined(values: Column, rule: str) -> Column:
    """One value of an array of them, nulls aside."""
    known = F.filter(values, lambda x: x.isNotNull())
    total = lambda: F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    if rule == "join":
        return F.nullif(F.array_join(F.transform(known, lambda x: x.cast("string")), ","), F.lit(""))
    if rule not in ("sum", "avg", "min", "max", "first"):
        raise ValueError(f"no such rule: {rule}")
    found = {"sum": total, "avg": lambda: total() / F.size(known), "min": lambda: F.array_min(known), "max": lambda: F.array_max(known), "first": lambda: F.get(known, F.lit(0))}[rule]()
    return F.when(F.size(known) > 0, found)


@dataclass
class Gathered:
    """Records of several sets, CHROM, POS, _g (see merge_key) and r (i: the set's number, REF, ALT, QUAL, FILTER, ID, INFO_ columns, calls),
    with the types of the fields, the lists by alleles among them, and the samples of each set."""

    rows: DataFrame
    fields: dict
    infos: dict
    tag_lists: dict[str, str]
    fmt_lists: dict[str, str]
    rosters: list[list[str]]


def gathered(call_sets: Sequence[DataFrame], policy: str, numbers: Mapping[str, str] | None = None, more: Sequence[str] = ()) -> Gathered:
    fields, infos, by_number = {}, {}, {}
    for df in call_sets:
        info, fmt = list_fields(df, numbers)
        by_number |= info | fmt
        for f in df.schema["samples"].dataType.elementType:
            fields.setdefault(f.name, f.dataType)
        infos |= {f.name: f.dataType for f in df.schema if f.name.startswith("INFO_") and f.name not in infos}
    fields.pop("sample_id")
    tag_lists = {c: by_number[c] for c in infos if c in by_number}
    fmt_lists = {c: by_number[c] for c in fields if c in by_number}

    rows, rosters, taken = None, [], set()
    for i, df in enumerate(call_sets):
        first = df.select("samples.sample_id").first()  # a set's roster, from one record
        own = [str(x) for x in (first[0] if first else [])]
        rosters.append([f"{i + 1}:{x}" if x in taken else x for x in own])
        taken |= set(own)
        have = {f.name for f in df.schema["samples"].dataType.elementType}
        calls = F.transform("samples", lambda s: F.struct(*(s[n].alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields.items())))  # noqa: B023  used at once
        col = lambda c, t, df=df: (F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
        r = F.struct(F.lit(i).alias("i"), "REF", "ALT", col("QUAL", "double"), col("FILTER", "array<string>"), col("ID", "string"), *(col(c, t) for c, t in infos.items()), calls.alias("calls"))
        t = df.withColumn("ID", F.col("ID") if "ID" in df.columns else F.lit(None).cast("string")).select("CHROM", "POS", merge_key(policy).alias("_g"), r.alias("r"), *more)
        rows = t if rows is None else rows.unionByName(t)
    return Gathered(rows, fields, infos, tag_lists, fmt_lists, rosters)


def merge_calls(
    *call_sets: DataFrame, policy: str = "all", duplicates: str = "stay", filters: str = "x", missing: str = "./.", numbers: Mapping[str, str] | None = None, info_rules: Mapping[str, str] | None = None,
    missing_rules: Mapping[str, str | float] | None = None, local: int = 0, names: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """Call sets as one: CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO_ columns and samples.

    Records of a place that `policy` brings together (see merge_key) become one: REF is the longest of theirs, which the others
    begin, shorter records' ALTs are lengthened by what they lack of it, and ALTs follow in the order of the sets. Genotypes,
    and lists of Number A, R and G, follow the new alleles. A set's samples are missing where it has no record; all records of a
    set have its samples in one order, and samples are numbered set by set, or, with `names`, keep their sample_id with the set's
    number in front where an earlier set has it.

    A set may have several records of a key at a place, as a file of split records has: they "stay", the n-th of each set
    together, by REF and ALT, or with duplicates "merge" are one record, in which an allele called in any counts, and the first known
    value of everything else.

    QUAL is the largest, ID all of them. filters "x": PASS if any record has it, else all; "+": all that failed. info_rules: sum,
    avg, min, max, join or first (the default) by column, for lists by element. missing_rules give lists by alleles, by field, what stands
    for alleles that a set lacks: a number, or "max" of the sample's others; a set with <*> or <NON_REF> has its values for them. local: where a record has more ALTs than that,
    Number R and G fields are null, and LAA (the set's own ALTs, from 1) with L<field> (the set's own list) stand for them. by names columns
    that all sets have and that stay: only records of equal values come together, as sites of one place are told apart by an id.
    """
    g = gathered(call_sets, policy, numbers, by)
    # array_sort goes by set, REF and ALT first; sample lists are never compared unless all before them is equal
    t = g.rows.groupBy("CHROM", "POS", *by, "_g").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return merged(t, g, duplicates, filters, missing, info_rules, missing_rules, local, names, by)


def merged(
    t: DataFrame, g: Gathered, duplicates: str = "stay", filters: str = "x", missing: str = "./.", info_rules: Mapping[str, str] | None = None, missing_rules: Mapping[str, str | float] | None = None,
    local: int = 0, names: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Rows CHROM, POS, r (records that become one, sorted) merged as merge_calls says; columns in keep stay."""
    if duplicates not in ("stay", "merge"):
        raise ValueError(f"no such way with duplicates: {duplicates}")
    info_rules, missing_rules = dict(info_rules or {}), dict(missing_rules or {})
    fields, infos, tag_lists, fmt_lists, rosters = g.fields, g.infos, g.tag_lists, g.fmt_lists, g.rosters
    if duplicates == "stay":
        nth = lambda x, j: F.size(F.filter(F.slice(F.col("r.i"), F.lit(1), j), lambda y: y == x["i"]))
        t = t.withColumn("_nth", F.transform("r", nth)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.array_max("_nth"))))
        t = t.withColumn("r", F.filter("r", lambda x, j: F.get("_nth", j) == F.col("_k"))).drop("_nth", "_k")
    t = t.withColumn("REF", F.array_max(F.transform("r", lambda x: F.struct(F.length(x["REF"]).alias("n"), x["REF"].alias("REF"))))["REF"])
    longer = lambda a, x: F.when(a.rlike(PLAIN), F.concat(a, F.substring(F.col("REF"), F.length(x["REF"]) + 1, F.length("REF")))).otherwise(a)
    t = fixed(t, REF=F.col("REF"))
    t = fixed(t, _alts=F.transform("r", lambda x: F.transform(x["ALT"], lambda a: longer(a, x))))
    t = fixed(t, ALT=F.array_distinct(F.flatten("_alts")))
    old = lambda alts: F.concat(F.array(F.lit(0)), F.transform("ALT", lambda a: F.coalesce(*(F.nullif(F.array_position(alts, x), F.lit(0)) for x in (a, F.lit("<*>"), F.lit("<NON_REF>")))).cast("int")))
    new = lambda alts: F.concat(F.array(F.lit(0)), F.transform(alts, lambda a: F.array_position(F.col("ALT"), a).cast("int")))
    t = fixed(t, _old=F.transform("_alts", old), _new=F.transform("_alts", new))
    many = F.size("ALT") > local if local else F.lit(False)

    def filled(name: str, values: Column) -> Column:
        rule = missing_rules.get(name)
        if rule in (None, "."):
            return values
        return F.transform(values, lambda v: F.coalesce(v, F.array_max(values) if rule == "max" else F.lit(rule).cast(fields[name].elementType)))

    def call(s: Column, j: Column) -> Column:
        o, n = F.get("_old", j), F.size(F.get("_alts", j)) + 1
        out = [renumbered(s["GT"], F.get("_new", j)).alias("GT")] if "GT" in fields else []
        for name, kind in fields.items():
            if name in fmt_lists:
                whole = filled(name, reordered(s[name], fmt_lists[name], o, n)).cast(kind)
                out.append((F.when(~many, whole) if local and fmt_lists[name] != "A" else whole).alias(name))
            elif name != "GT":
                out.append(s[name].alias(name))
        if local:
            own = F.slice(F.get("_new", j), F.lit(2), F.size(F.get("_new", j)))
            out += [F.when(many, own).alias("LAA"), *(F.when(many, s[name]).cast(fields[name]).alias(f"L{name}") for name, k in fmt_lists.items() if k != "A")]
        return F.struct(*out)

    t = t.withColumn("_calls", F.transform("r", lambda x, j: F.struct(x["i"].alias("i"), F.transform(x["calls"], lambda s: call(s, j)).alias("calls"))))
    kinds = t.schema["_calls"].dataType.elementType["calls"].dataType.elementType
    none = F.struct(*((F.lit(missing) if f.name == "GT" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds))

    def both(a: Column, b: Column) -> Column:
        """Two calls of one sample from records of one set."""

        def gt(x: Column, y: Column) -> Column:
            p, q = F.split(x, "[/|]"), F.split(y, "[/|]")
            one = lambda u, v: F.when(~F.coalesce(u, F.lit(".")).isin("0", "."), u).when(~F.coalesce(v, F.lit(".")).isin("0", "."), v).when(F.coalesce(u == "0", F.lit(False)) | F.coalesce(v == "0", F.lit(False)), "0").otherwise(".")
            joined = F.array_join(F.zip_with(p, q, one), "/")
            return F.when(x.contains("|") & (y.contains("|") | ~y.rlike("[1-9]")) | y.contains("|") & ~x.rlike("[1-9]"), F.replace(joined, F.lit("/"), F.lit("|"))).otherwise(joined)

        def field(f) -> Column:
            x, y = a[f.name], b[f.name]
            if f.name == "GT":
                return gt(x, y)
            if f.name in fmt_lists:
                return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.zip_with(x, y, lambda u, v: F.coalesce(u, v)))
            return F.coalesce(x, y)

        return F.struct(*(field(f).alias(f.name) for f in kinds))

    parts = []
    for i, roster in enumerate(rosters):
        own = F.transform(F.filter("_calls", lambda x: x["i"] == i), lambda x: x["calls"])  # noqa: B023  used at once
        if duplicates == "merge":
            first = F.get(own, F.lit(0))
            folded = F.aggregate(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), first, lambda acc, x: F.zip_with(acc, x, both))
            found = F.when(F.size(own) > 1, folded).otherwise(first)
        else:
            found = F.get(own, F.lit(0))
        parts.append(F.coalesce(found, F.array_repeat(none, F.lit(len(roster)))))
    who = F.array(*(F.lit(x) for r in rosters for x in r)) if names else None
    samples = F.transform(F.concat(*parts), lambda s, n: F.struct((F.get(who, n) if names else n).alias("sample_id"), *(s[f.name].alias(f.name) for f in kinds)))

    def info(name: str) -> Column:
        rule, kind = info_rules.get(name, "first"), infos[name]
        if name not in tag_lists:
            values = F.transform("r", lambda x: x[name])
            return (_combined(values, rule) if rule == "join" else _combined(values, rule).cast(kind)).alias(name)
        lists = F.transform("r", lambda x, j: reordered(x[name], tag_lists[name], F.get("_old", j), F.size(x["ALT"]) + 1))
        longest = F.array_max(F.transform(lists, lambda v: F.size(v)))
        return F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), lambda k: _combined(F.transform(lists, lambda v: F.get(v, k)), rule).cast(kind.elementType))).alias(name)

    every = F.array_sort(F.array_distinct(F.flatten(F.filter("r.FILTER", lambda x: x.isNotNull()))))
    failed = F.filter(every, lambda x: x != "PASS")
    ok = F.exists("r", lambda x: F.array_contains(F.coalesce(x["FILTER"], F.array().cast("array<string>")), "PASS"))
    merged = F.when(ok, F.array(F.lit("PASS"))).otherwise(failed) if filters == "x" else F.when(F.size(failed) > 0, failed).otherwise(every)
    ids = F.nullif(F.array_join(F.array_distinct(F.filter("r.ID", lambda x: x.isNotNull())), ";"), F.lit(""))
    return t.select("CHROM", "POS", *keep, ids.alias("ID"), "REF", "ALT", F.array_max("r.QUAL").alias("QUAL"), merged.alias("FILTER"), *map(info, infos), samples.alias("samples"))


def join_records(rows: DataFrame, policy: str = "both", numbers: Mapping[str, str] | None = None, info_rules: Mapping[str, str] | None = None) -> DataFrame:
    """Records of one set's places as multiallelic ones, by policy: the opposite of split_records. REF and ALT are lengthened as
    in merge_calls; an allele that any record's genotype has is called, and lists get each ALT's own values, REF's from the
    first record. Samples keep their sample_id."""
    roster = rows.select("samples.sample_id").first()
    out = merge_calls(rows, policy=policy, duplicates="merge", numbers=numbers, info_rules=info_rules, filters="+")
    ids = F.array(*map(F.lit, roster[0])) if roster else F.array().cast("array<int>")
    return out.withColumn("samples", F.transform("samples", lambda s: s.withField("sample_id", F.get(ids, s["sample_id"]))))


def expected_length(number: str, n_alleles: Column, ploidy: Column | None = None) -> Column:
    """Values that a list of Number A, R or G has at a site of n alleles; G for haploid or diploid samples."""
    if number == "G":
        diploid = n_alleles * (n_alleles + 1) / 2
        return (diploid if ploidy is None else F.when(ploidy == 1, n_alleles).otherwise(diploid)).cast("int")
    return {"A": n_alleles - 1, "R": n_alleles}[number]


def wrong_lengths(rows: DataFrame, numbers: Mapping[str, str] | None = None) -> DataFrame:
    """CHROM, POS, field, sample_id (null for INFO), found, expected: lists whose length is not what their Number says."""
    info, fmt = list_fields(rows, numbers)
    n = F.size("ALT") + 1
    whole = [F.array(F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("sample_id"), F.size(c).alias("found"), expected_length(k, n).alias("expected"), F.col(c).isNotNull().alias("has"))) for c, k in info.items()]
    ploidy = lambda s: F.size(V.alleles(s["GT"]))
    of = lambda s, c, k: F.struct(F.lit(c).alias("field"), s["sample_id"].cast("string").alias("sample_id"), F.size(s[c]).alias("found"), expected_length(k, n, ploidy(s)).alias("expected"), s[c].isNotNull().alias("has"))
    each = [F.transform("samples", lambda s: of(s, c, k)) for c, k in fmt.items()]  # noqa: B023  used at once
    if not whole + each:
        return rows.select("CHROM", "POS").where("false").selectExpr("*", "'' AS field", "'' AS sample_id", "0 AS found", "0 AS expected")
    return rows.select("CHROM", "POS", F.inline(F.concat(*whole, *each))).where("has and found <> expected").drop("has")
