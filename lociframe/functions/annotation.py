"""Consequence annotations: header schema, transcripts, selection by severity."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("CSQ", "BCSQ", "ANN")
# Consequence severities, mildest first; names of one line are equally severe. Matched as substrings.
SEVERITY = [
    ["intergenic"], ["feature_truncation", "feature_elongation"], ["regulatory"], ["TF_binding_site", "TFBS"], ["downstream", "upstream"], ["non_coding_transcript", "non_coding"],
    ["intron", "NMD_transcript"], ["non_coding_transcript_exon"], ["5_prime_utr", "3_prime_utr"], ["coding_sequence", "mature_miRNA"], ["stop_retained", "start_retained", "synonymous"],
    ["incomplete_terminal_codon"], ["splice_region"], ["missense", "inframe", "protein_altering"], ["transcript_amplification"], ["exon_loss"], ["disruptive"],
    ["start_lost", "stop_lost", "stop_gained", "frameshift"], ["splice_acceptor", "splice_donor"], ["transcript_ablation"],
]
INTEGERS = ("DISTANCE", "STRAND", "TSL", "GENE_PHENO", "HGVS_OFFSET", "ALLELE_NUM", "PICK", "CANONICAL")


def fields(description: str) -> list[str]:
    """Field names from an INFO description."""
    m = re.search(r"Format:\s*(.*)", description)
    return [x.strip().strip("'\"") for x in m[1].rstrip("\"'> ").split("|")] if m else []


def detect(info: dict[str, str]) -> str | None:
    """The annotation tag a header declares."""
    return next((t for t in TAGS if t in info), None)


def field_type(name: str) -> str:
    """int, float or string for an annotation field, from its name; the first matching rule holds."""
    if name in INTEGERS or name.startswith("MOTIF_POS"):
        return "int"
    if name in ("AF", "MOTIF_SCORE_CHANGE") or re.fullmatch(r"MAX_AF_.*|.*_AF|SpliceAI_pred_DS_.*", name):
        return "float"
    return "int" if name.startswith("SpliceAI_pred_DP_") else "string"


def transcripts(text: Column, names: list[str], keep: list[str] | None = None) -> Column:
    """array<struct> of the transcripts of an annotation text. Empty transcripts drop; "" and "." are null; numbers that
    cannot be read are null. Fields named in keep, or all, in schema order."""
    chosen = [(i, n) for i, n in enumerate(names) if keep is None or n in keep]

    def one(t: Column) -> Column:
        parts = F.split(t, r"\|")
        value = lambda i, n: F.nullif(F.nullif(F.trim(F.try_element_at(parts, F.lit(i + 1))), F.lit("")), F.lit("."))
        return F.struct(*(value(i, n).try_cast(field_type(n)).alias(n) for i, n in chosen))

    return F.transform(F.filter(F.split(text, ","), lambda t: t != ""), one)


def severity(consequence: Column) -> Column:
    """Place on the scale of the most severe term, 1 for the mildest; 0 for unknown ones."""
    worst = F.lit(0)
    for level, terms in enumerate(SEVERITY, 1):
        worst = F.when(reduce(lambda a, b: a | b, (consequence.contains(t) for t in terms)), level).otherwise(worst)
    return worst


def select(trs: Column, mode: str, at_least: str | None = None, field: str = "Consequence") -> Column:
    """Transcripts by mode (all, first, worst: one of the most severe, the first of equals), then by minimum severity."""
    if mode == "first":
        trs = F.slice(trs, 1, 1)
    elif mode == "worst":
        top = F.array_max(F.transform(trs, lambda t: severity(t[field])))
        trs = F.slice(F.filter(trs, lambda t: severity(t[field]) == top), 1, 1)
    elif mode != "all":
        raise ValueError(f"no such mode: {mode}")
    if at_least:
        floor = next(i for i, terms in enumerate(SEVERITY, 1) if at_least in terms)
        trs = F.filter(trs, lambda t: severity(t[field]) >= floor)
    return trs
