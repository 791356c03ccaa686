"""Operators on a reference sequence, kept as a table of blocks: CHROM, block (from 0) and bases.

A block holds `width` bases of a contig, the last one fewer, so that a contig of any length is dealt over tasks; a site or
an interval meets the blocks that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 1 << 14
REACH = 128  # bases that a site is moved through at first
# IUPAC ambiguity codes of two bases.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def settled(df: DataFrame) -> DataFrame:
    """df written once to the checkpoint folder that all executors share: spark.checkpoint.dir, or the context's own; a local
    master without either uses /tmp/checkpoints."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(top or "/tmp/checkpoints")
    return df.checkpoint()


def in_pieces(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks from pieces of contigs in any order: CHROM, begin (from 0), bases."""
    first, last = F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.length("bases") - 1) / width)
    cut = pieces.where(F.length("bases") > 0).withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * width, "begin")
    part = F.substring("bases", (low - F.col("begin") + 1).cast("int"), (F.least((F.col("block") + 1) * width, F.col("begin") + F.length("bases")) - low).cast("int"))
    return cut.groupBy("CHROM", "block").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("text")))).alias("p")).select("CHROM", "block", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("bases"))


def read_fasta(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """Blocks of the sequences of a FASTA file of any line lengths; a contig is named by its line's first word.

    The file is read in splits. A split's own contigs and lengths are counted first; what precedes it, a row for each split
    and contig, gives every line its place."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = lines.where("value <> ''").withColumn("head", F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>\s*(\S*)", 1)))
    own = Window.partitionBy("file_path", "start").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = settled(lines.withColumn("n", F.when(F.col("head").isNull(), F.length(F.rtrim("value"))).otherwise(0)).withColumn("k", F.count("head").over(own)))
    # segment k of a split is what follows its k-th contig line; segment 0 goes on with the contig before
    sizes = lines.groupBy("file_path", "start", "k").agg(F.sum("n").alias("m"), F.max("head").alias("name"))
    order = Window.partitionBy("file_path").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("contig", F.count("name").over(order))
    earlier = Window.partitionBy("file_path", "contig").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path", "contig")
    sizes = sizes.select("file_path", "start", "k", F.max("name").over(whole).alias("CHROM"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file_path", "start", "k").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.where("head is null").withColumn("off", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sizes, ["file_path", "start", "k"])
    return in_pieces(placed.select("CHROM", (F.col("before") + F.col("off")).alias("begin"), F.rtrim("value").alias("bases")), width)


def fetched(rows: DataFrame, reference: DataFrame, begin: Column, end: Column, name: str = "bases", width: int = WIDTH) -> DataFrame:
    """rows with the reference's bases from position begin to end (1-based, closed) of CHROM in `name`, as far as the contig
    has any; null where it has none. A row meets its blocks by (CHROM, block) and takes its own bases from them at once, so
    that no block goes on with a row; its own columns are moved once more."""
    t = rows.withColumns({"_i": F.monotonically_increasing_id(), "_x": begin.cast("long"), "_y": end.cast("long")})
    t = settled(t)  # the row numbers must be the same in both uses
    near = t.where("_x <= _y and _y >= 1").select("_i", "CHROM", "_x", "_y", F.explode(F.sequence(F.floor((F.greatest("_x", F.lit(1)) - 1) / width), F.floor((F.col("_y") - 1) / width))).alias("block"))
    low = F.greatest(F.col("_x") - 1, F.col("block") * width)
    text = F.substring("bases", (low - F.col("block") * width + 1).cast("int"), (F.col("_y") - low).cast("int"))
    cut = near.join(reference, ["CHROM", "block"]).select("_i", F.struct("block", text.alias("t")).alias("p"))
    found = cut.groupBy("_i").agg(F.array_sort(F.collect_list("p")).alias("p"))
    found = found.select("_i", F.nullif(F.array_join(F.transform("p", lambda x: x["t"]), ""), F.lit("")).alias(name))
    return t.join(found, "_i", "left").drop("_i", "_x", "_y")


def filled_from_reference(sites: DataFrame, reference: DataFrame, target: str = "REF", where: Column | None = None, upper: bool = False, width: int = WIDTH) -> DataFrame:
    """target (REF, or a column to add) from the reference's bases at the site's REF; only at the sites of `where`, if given."""
    length = F.length("REF") if "REF" in sites.columns else F.lit(1)
    t = fetched(sites, reference, F.col("POS"), F.col("POS") + length - 1, "_bases", width)
    new = F.upper("_bases") if upper else F.col("_bases")
    own = F.col(target) if target in sites.columns else F.lit(None).cast("string")
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return t.withColumn(target, F.when(chosen, F.coalesce(new, own)).otherwise(own)).drop("_bases")


# --- left alignment ---------------------------------------------------------------------------------------------------


def shifted(pos: int, alleles: list[str], bases: str, first: int) -> tuple[int, list[str], bool]:
    """Position and alleles moved left while all end with the same base, and whether the window's edge stopped that.
    bases: the reference from position `first` on; positions before 1 don't exist."""
    alleles = list(alleles)
    while True:
        last = alleles[0][-1].upper()
        if any(a[-1].upper() != last for a in alleles):
            return pos, alleles, False
        if min(map(len, alleles)) == 1:
            if pos == 1:
                return pos, alleles, False
            if pos - 1 < first:
                return pos, alleles, True
            base = bases[pos - 1 - first]
            pos, alleles = pos - 1, [base + a for a in alleles]
        alleles = [a[:-1] for a in alleles]


def without_prefix(pos: int, alleles: list[str]) -> tuple[int, list[str]]:
    n, least = 0, min(map(len, alleles)) - 1
    while n < least and len({a[n].upper() for a in alleles}) == 1:
        n += 1
    return pos + n, [a[n:] for a in alleles]


def left_aligned(sites: DataFrame, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """Sites with their alleles moved to the leftmost place at which they say the same, and as short as can be. ALT is an array.

    Each round joins the sites that still move with the block of their position and the one before, and moves them through the
    last bases before their position: REACH in the first round, in which most end, 32 times as many in the next, and at last both
    blocks, so that a repeat of r blocks takes about r rounds. Sites with alleles other than bases, without ALT or
    with one length only after trimming stay where they are, as do all columns but POS, REF and ALT.
    """
    plain = F.forall(F.concat(F.array("REF"), "ALT"), lambda a: a.rlike("(?i)^[ACGTN]+$")) & (F.size("ALT") > 0)
    moves = F.coalesce(plain & F.exists("ALT", lambda a: F.length(a) != F.length("REF")), F.lit(False))
    trims = F.coalesce(plain & ~moves & (F.length("REF") > 1), F.lit(False))
    rest = sites.where(~moves & ~trims)
    schema = sites.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", _open boolean"

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, refs, alts, opens = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("POS", "REF", "ALT", "_bases", "_first")]
            for p, ref, alt, bases, first in zip(*columns, strict=True):
                p, alleles, more = shifted(p, [ref, *alt], bases or "", first)
                if not more:
                    p, alleles = without_prefix(p, alleles)
                pos.append(p)
                refs.append(alleles[0])
                alts.append(alleles[1:])
                opens.append(more)
            new = {"POS": pa.array(pos, pa.int64()), "REF": pa.array(refs, pa.string()), "ALT": pa.array(alts, pa.list_(pa.string())), "_open": pa.array(opens)}
            names = [*schema.names, "_open"]
            yield pa.record_batch([new[c] if c in new else batch.column(c) for c in names], names=names)

    def stepped(rows: DataFrame, reach: int) -> DataFrame:
        at, begin = F.floor((F.col("POS") - 1) / width), F.col("_at") * width  # the block's first position is begin + 1
        t = rows.withColumn("_at", at)
        own = reference.select("CHROM", F.col("block").alias("_at"), F.col("bases").alias("_own"))
        before = reference.select("CHROM", (F.col("block") + 1).alias("_at"), F.col("bases").alias("_before"))
        # each join leaves a row with the few bases that it may need, not with a block
        low = F.greatest(F.col("POS") - reach, begin + 1)
        t = t.join(own, ["CHROM", "_at"], "left").withColumns({"_known": F.col("_own").isNotNull(), "_tail": F.substring("_own", (low - begin).cast("int"), (F.col("POS") - low).cast("int"))}).drop("_own")
        far = F.greatest(F.col("POS") - reach, begin - width + 1)
        head = F.when(far <= begin, F.substring("_before", (far - begin + width).cast("int"), (begin - far + 1).cast("int"))).otherwise("")
        t = t.join(before, ["CHROM", "_at"], "left").withColumns({"_there": F.col("_before").isNotNull(), "_head": F.coalesce(head, F.lit(""))}).drop("_before")
        # without its block a site stays: an empty window that begins at its position
        first = F.when(~F.col("_known"), F.col("POS")).when(F.col("_there"), far).otherwise(low)
        t = t.withColumns({"_bases": F.when(F.col("_known"), F.concat("_head", "_tail")), "_first": first})
        return settled(t.drop("_at", "_known", "_there", "_head", "_tail").mapInArrow(move, kinds))

    done, left, reach = rest, sites.where(moves), REACH
    while True:
        t = stepped(left.withColumn("POS", F.col("POS").cast("long")), reach)
        reach = min(32 * reach, 2 * width)
        done = done.unionByName(t.where("not _open").drop("_open"))
        left = t.where("_open").drop("_open")
        known = left.join(reference.select("CHROM", F.col("block").alias("_b")), (left["CHROM"] == reference["CHROM"]) & (F.floor((left["POS"] - 2) / width) == F.col("_b")), "left_semi")
        if known.isEmpty():
            break
    done = done.unionByName(left)  # at the edge of what the reference has

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, ref, alt in zip(*(batch.column(c).to_pylist() for c in ("POS", "REF", "ALT")), strict=True):
                alleles = [ref, *alt]
                while min(map(len, alleles)) > 1 and len({a[-1].upper() for a in alleles}) == 1:
                    alleles = [a[:-1] for a in alleles]
                found.append(without_prefix(p, alleles))
            new = {"POS": pa.array([p for p, _ in found], pa.int64()), "REF": pa.array([a[0] for _, a in found], pa.string()), "ALT": pa.array([a[1:] for _, a in found], pa.list_(pa.string()))}
            yield pa.record_batch([new.get(c, batch.column(c)) for c in schema.names], names=schema.names)

    return done.unionByName(sites.where(trims).withColumn("POS", F.col("POS").cast("long")).mapInArrow(trim, kinds.removesuffix(", _open boolean")))


# --- consensus --------------------------------------------------------------------------------------------------------


def chosen_allele(haplotype: str, sample: str | int | None = None) -> Column:
    """The allele's text that a site (nested layout, or without samples) puts into the sequence; null leaves it as it is.

    haplotype: "alt" (the first ALT), "1" or "2" (an allele of the sample's genotype), "A" or "R" (of a heterozygous genotype the
    ALT, or REF), "I" (for SNPs the code of both alleles, else as A)."""
    alt = F.get(F.col("ALT"), F.lit(0))
    if haplotype == "alt":
        return alt
    own = F.get(F.filter("samples", lambda s: s["sample_id"] == sample), F.lit(0))["GT"]
    calls = F.split(own, "[/|]")
    of = lambda n: F.when(n.try_cast("int") > 0, F.get(F.col("ALT"), n.try_cast("int") - 1))
    if haplotype in ("1", "2"):
        return of(F.when(F.size(calls) == 1, F.get(calls, F.lit(0))).otherwise(F.get(calls, F.lit(int(haplotype) - 1))))
    known = F.filter(calls, lambda a: a != ".")
    alts = F.filter(known, lambda a: a != "0")
    some = of(F.get(alts, F.lit(0)))
    if haplotype == "A":
        return some
    if haplotype == "R":
        return F.when(~F.array_contains(known, "0"), some)
    if haplotype != "I":
        raise ValueError(f"no such haplotype: {haplotype}")
    bases = F.array_sort(F.array_distinct(F.transform(known, lambda a: F.when(a == "0", F.upper("REF")).otherwise(F.upper(of(a))))))
    table = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    code = F.when((F.size(bases) == 2) & (F.length("REF") == 1) & F.forall(bases, lambda b: F.length(b) == 1), F.try_element_at(table, F.array_join(bases, "")))
    return F.when(F.size(alts) > 0, F.coalesce(code, some))


def applied_edits(edits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of edits (CHROM, POS, REF, new) those that sequential application takes: in order of POS, REF and new, each that begins
    after the end of the last one taken; equal ones are one. Edits whose REFs chain by overlap are decided together, other chains apart."""
    from lociframe.operators.windows import islands

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("POS", "ascending"), ("REF", "ascending"), ("new", "ascending")])
        taken, end = [], None
        for p, r in zip(table.column("POS").to_pylist(), table.column("REF").to_pylist(), strict=True):
            taken.append(end is None or p > end)
            end = p + len(r) - 1 if taken[-1] else end
        return table.filter(pa.array(taken))

    t = islands(edits.select("CHROM", F.col("POS").cast("long").alias("POS"), "REF", "new").distinct(), 0, width)
    sized = t.groupBy("CHROM", "island").agg(F.count("*").alias("_n"))
    both = t.join(sized, ["CHROM", "island"])
    alone, chains = both.where("_n = 1").drop("_n", "island"), both.where("_n > 1").drop("_n")
    return alone.unionByName(chains.groupBy("CHROM", "island").applyInArrow(walk, chains.schema).drop("island"))


def consensus(edits: DataFrame, reference: DataFrame, mask: DataFrame | None = None, mask_with: str = "N", width: int = WIDTH) -> DataFrame:
    """The reference with edits (CHROM, POS, REF, new): CHROM, block, begin (where the block's text begins in the new
    sequence, from 0) and bases. Overlapping edits are resolved as by `applied_edits`. mask: CHROM, b, e (1-based, closed) whose bases
    become mask_with, or small letters for "lc"; edits that touch a mask are left out.

    An edit's new text stands in the block of its position; of a REF that goes on, later blocks lose their share.
    """
    taken = applied_edits(edits.where("new is not null and new <> REF"), width)
    end = F.col("POS") + F.length("REF") - 1
    masks = None
    if mask is not None:
        cut = mask.withColumn("block", F.explode(F.sequence(F.floor((F.col("b") - 1) / width), F.floor((F.col("e") - 1) / width))))
        masks = cut.groupBy("CHROM", "block").agg(F.collect_list(F.struct(F.col("b").cast("long").alias("b"), F.col("e").cast("long").alias("e"))).alias("masks"))
        hit = taken.withColumn("block", F.explode(F.sequence(F.floor((F.col("POS") - 1) / width), F.floor((end - 1) / width)))).join(masks, ["CHROM", "block"])
        hit = hit.where(F.exists("masks", lambda m: (m["b"] <= end) & (m["e"] >= F.col("POS")))).select("CHROM", "POS").distinct()
        taken = taken.join(hit, ["CHROM", "POS"], "left_anti")
    parts = taken.withColumn("block", F.explode(F.sequence(F.floor((F.col("POS") - 1) / width), F.floor((end - 1) / width))))
    low = F.greatest("POS", F.col("block") * width + 1)
    part = F.struct(low.alias("at"), (F.least(end, (F.col("block") + 1) * width) - low + 1).alias("n"), F.when(low == F.col("POS"), F.col("new")).otherwise("").alias("new"))
    t = reference.join(parts.groupBy("CHROM", "block").agg(F.array_sort(F.collect_list(part)).alias("edits")), ["CHROM", "block"], "left")
    t = t.join(masks, ["CHROM", "block"], "left") if masks is not None else t.withColumn("masks", F.expr("cast(null as array<struct<b:long,e:long>>)"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, bases, own, hidden in zip(*(batch.column(c).to_pylist() for c in ("block", "bases", "edits", "masks")), strict=True):
                first = block * width + 1
                for m in hidden or ():
                    a, z = max(m["b"] - first, 0), min(m["e"] - first + 1, len(bases))
                    bases = bases[:a] + (bases[a:z].lower() if mask_with == "lc" else mask_with * (z - a)) + bases[z:] if a < z else bases
                pieces, at = [], 0
                for e in own or ():
                    pieces += [bases[at : e["at"] - first], e["new"]]
                    at = e["at"] - first + e["n"]
                out.append("".join([*pieces, bases[at:]]))
            yield pa.record_batch([batch.column("CHROM"), batch.column("block"), pa.array(out, pa.string())], names=["CHROM", "block", "bases"])

    new = settled(t.select("CHROM", F.col("block").cast("long").alias("block"), "bases", "edits", "masks").mapInArrow(write, "CHROM string, block long, bases string"))
    lengths = new.select("CHROM", "block", F.length("bases").cast("long").alias("n"))
    before = Window.partitionBy("CHROM").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a number for each block
    return new.join(lengths.select("CHROM", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), ["CHROM", "block"]).select("CHROM", "block", "begin", "bases")
