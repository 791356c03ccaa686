"""Format strings compiled to one text Column: %FIELD, %FIELD{i}, and [ ... ] repeated for every sample."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V

TOKEN = re.compile(r"%(?P<call>(?!PBINOM)[A-Z_]+)\((?P<passes>(?:[^()]|\([^()]*\))*)\)|%PBINOM\((?P<binom>\w+)\)|%(?:INFO/)?(?P<name>[A-Z_0-9]+)(?:\{(?P<i>\d+)\})?|(?P<open>\[)|(?P<close>\])|(?P<text>\\n|\\t|[^%\[\]\\]+|.)")
ESCAPES = {"\\n": "\n", "\\t": "\t"}


def _site(name: str, i: str | None) -> Column:
    alts = F.col("ALT")
    known = {
        "CHROM": lambda: F.col("CHROM"), "POS": lambda: F.col("POS"), "POS0": lambda: F.col("POS") - 1, "END": lambda: V.end_position(F.col("POS"), F.col("REF")), "END0": lambda: V.end_position(F.col("POS"), F.col("REF")) - 1,
        "REF": lambda: F.col("REF"), "ALT": lambda: F.array_join(alts, ","), "FIRST_ALT": lambda: F.try_element_at(alts, F.lit(1)), "TYPE": lambda: F.array_join(F.array_distinct(V.types(F.col("REF"), alts)), ","),
        "IS_TS": lambda: V.is_transition(F.col("REF"), F.try_element_at(alts, F.lit(1))).cast("int"), "FILTER": lambda: F.array_join("FILTER", ";"), "N_ALT": lambda: F.size(alts),
    }
    if i is not None:
        return F.coalesce(F.try_element_at(F.col(name), F.lit(int(i) + 1)).cast("string"), F.lit("."))
    return F.coalesce(known.get(name, lambda: F.col(name))().cast("string"), F.lit("."))


def _text(c: Column, is_list: bool) -> Column:
    """A value as files have it."""
    whole = F.array_join(c.cast("array<string>"), ",", ".") if is_list else F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.coalesce(F.nullif(whole, F.lit("")), F.lit("."))


def info_text(df: DataFrame) -> Column:
    """The INFO column of the INFO_<tag> columns: present tags in the order of the columns, flags by name; . without any."""
    parts = []
    for f in df.schema:
        if f.name.startswith("INFO_"):
            tag, kind = f.name.removeprefix("INFO_"), f.dataType.simpleString()
            if kind == "boolean":
                parts.append(F.when(F.col(f.name), tag))
            else:
                full = F.col(f.name).isNotNull() & (F.size(f.name) > 0) if kind.startswith("array") else F.col(f.name).isNotNull()
                parts.append(F.when(full, F.concat(F.lit(f"{tag}="), _text(F.col(f.name), kind.startswith("array")))))
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit(".")) if parts else F.lit(".")


def samples_text(df: DataFrame) -> Column:
    """The FORMAT column and those of the samples: the names of the sample fields, then every sample's values, tabs between."""
    fields = [f for f in df.schema["samples"].dataType.elementType if f.name != "sample_id"]
    one = lambda s: F.concat_ws(":", *(_text(s[f.name], f.dataType.simpleString().startswith("array")) for f in fields))
    return F.concat_ws("\t", F.lit(":".join(f.name for f in fields)), F.array_join(F.transform("samples", one), "\t"))


def line_text(df: DataFrame) -> Column:
    """The record as a line of a variant file."""
    missing = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    own = lambda name, of: missing(of(F.col(name))) if name in df.columns else F.lit(".")
    fixed = [F.col("CHROM"), F.col("POS").cast("string"), own("ID", lambda c: c), F.col("REF"), own("ALT", lambda c: F.array_join(c, ",")), own("QUAL", lambda c: _text(c, False)), own("FILTER", lambda c: F.array_join(c, ";")), info_text(df)]
    return F.concat_ws("\t", *fixed, *([samples_text(df)] if "samples" in df.columns else []))


def _whole(name: str, df: DataFrame | None, n_sets: int | None) -> Column | None:
    """Fields made of several columns; null for others."""
    if name in ("INFO", "FORMAT", "LINE"):
        if df is None:
            raise ValueError(f"%{name} needs the sites")
        return {"INFO": info_text, "FORMAT": samples_text, "LINE": line_text}[name](df)
    if name == "MASK":
        if n_sets is None:
            raise ValueError("%MASK needs the number of call sets")
        return F.concat(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, "1").otherwise("0") for i in range(n_sets)))
    if name == "VKX":
        return F.lower(F.lpad(F.hex(V.variant_key(F.col("CHROM"), F.col("POS"), F.col("REF"), F.get("ALT", F.lit(0)))), 16, "0"))
    if name == "RSX":
        return F.lower(F.lpad(F.hex(F.regexp_extract("ID", r"^rs(\d+)$", 1).try_cast("long")), 8, "0"))
    return None


def _sample(name: str, i: str | None, s: Column) -> Column:
    special = {"SAMPLE": lambda: s["sample_id"], "TGT": lambda: V.translated(s["GT"], F.col("REF"), F.col("ALT")), "IUPACGT": lambda: V.iupac(s["GT"], F.col("REF"), F.col("ALT"))}
    value = special.get(name, lambda: s[name])()
    if i is not None:
        value = F.try_element_at(value, F.lit(int(i) + 1))
    return F.coalesce(value.cast("string"), F.lit("."))


def _each(parts: list, passing: str | None, instead: str | None) -> Column:
    """parts (a function of the sample, and whether it reads the sample) for every sample; of samples that don't pass, `instead`
    for what reads them, or without one nothing at all."""
    if passing is None:
        return F.array_join(F.transform("samples", lambda s: F.concat(*(p(s) for p, _ in parts))), "")
    ok = lambda i: F.coalesce(F.get(F.col(passing), i), F.lit(False))
    if instead is None:
        return F.array_join(F.transform("samples", lambda s, i: F.when(ok(i), F.concat(*(p(s) for p, _ in parts))).otherwise("")), "")
    return F.array_join(F.transform("samples", lambda s, i: F.concat(*(F.when(ok(i), p(s)).otherwise(instead) if reads else p(s) for p, reads in parts))), "")


def header(text: str, samples: list[str], numbered: bool = True) -> str:
    """A first line that names the columns of a format, and numbers them; one per sample for what stands in brackets."""
    names, inner = [], None
    for m in TOKEN.finditer(text):
        name = f"{m['call']}({m['passes']})" if m["passes"] is not None else f"PBINOM({m['binom']})" if m["binom"] else m["name"]
        if m["open"]:
            inner = []
        elif m["close"]:
            names += [f"{s}:{n}" for s in samples for n in inner or []]
            inner = None
        elif name:
            (names if inner is None else inner).append(name)
    return "#" + "\t".join(f"[{i}]{n}" if numbered else n for i, n in enumerate(names, 1))


def formatted(text: str, sample_fields: set[str], df: DataFrame | None = None, n_sets: int | None = None, passing: str | None = None, instead: str | None = None) -> Column:
    """The line for a site; names in sample_fields (and SAMPLE, TGT, IUPACGT) are read per sample inside brackets.

    With df, the sites: %NAME(...) is a function of the expression language (of a field by sample, its values over all samples), %INFO
    and %FORMAT are these columns of a file, and %LINE the whole record. %MASK needs the column mask, a bit for each of n_sets call
    sets. %VKX and %RSX are the variant's and the rs number's hexadecimal keys. %PBINOM(TAG) is the phred-scaled binomial test of a sample's
    first two values. passing names an array column of the samples that pass an expression: brackets leave the others out, or
    print `instead` for their values.
    """
    own = sample_fields | {"SAMPLE", "TGT", "IUPACGT"}
    out: list[Column] = []
    inner: list | None = None

    def put(c: Column) -> None:
        out.append(c) if inner is None else inner.append((lambda s: c, False))

    for m in TOKEN.finditer(text):
        if m["open"]:
            inner = []
        elif m["close"]:
            out.append(_each(inner or [], passing, instead))
            inner = None
        elif m["passes"] is not None:
            from lociframe.functions.expression import Compiler

            value = Compiler(df).compile(f"{m['call']}({m['passes']})").col
            put(F.coalesce(value.cast("int").cast("string") if m["call"] == "N_PASS" else F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(".")))
        elif m["binom"]:
            phred = lambda s, t=m["binom"]: F.coalesce(F.round(-10 * F.log10(V.binomial_test(F.get(s[t], F.lit(0)), F.get(s[t], F.lit(1))))).cast("int").cast("string"), F.lit("."))
            inner.append((phred, True)) if inner is not None else out.append(phred)
        elif m["name"]:
            name, i = m["name"], m["i"]
            whole = _whole(name, df, n_sets) if i is None and name not in (own if inner is not None else ()) else None
            if whole is not None:
                put(F.coalesce(whole, F.lit(".")))
            elif inner is None:
                out.append(_site(name, i))
            elif name in own:
                inner.append((lambda s, n=name, i=i: _sample(n, i, s), True))
            else:
                put(_site(name, i))
        else:
            put(F.lit(ESCAPES.get(m["text"], m["text"])))
    return F.concat(*out)
