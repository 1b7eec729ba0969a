"""Column functions on nucleotide sequences and alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the nucleotide codes, bases that a degenerate code stands for, and the codons that
# begin and end a reading frame.
COMPLEMENT_FROM = "ATGCRMYKHBDVatgcrmykhbdv"
COMPLEMENT_TO = "TACGYKRMDVHBtacgykrmdvhb"
DEGENERATE = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}
START_CODONS = ("ATG", "ATC", "ATA", "ATT", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO))


def bases_of(code: Column) -> Column:
    """The bases of a degenerate code, as a string; null for other characters."""
    table = F.create_map(*[F.lit(x) for pair in DEGENERATE.items() for x in pair])
    return F.try_element_at(table, F.upper(code))


def cigar_ops(c: Column) -> Column:
    """``8=1X`` to an array of struct<len, op>."""
    lens = F.regexp_extract_all(c, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(1))
    ops = F.regexp_extract_all(c, F.lit("([0-9]+)([MIDNSHPX=])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))


def gapped(query: Column, reference: Column, cigar: Column) -> Column:
    """struct<query, reference>: both sequences of an alignment with gaps as dashes; operations other than ``=XID`` are an
    error."""
    zero = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit("").alias("q"), F.lit("").alias("r"))

    def add(a: Column, x: Column) -> Column:
        n, op = x["len"], x["op"]
        bad = F.raise_error(F.concat(F.lit("unsupported operation "), op)).cast("string")
        q = F.when(op.isin("=", "X", "I"), F.substring(query, a["i"], n)).when(op == "D", F.repeat(F.lit("-"), n)).otherwise(bad)
        r = F.when(op.isin("=", "X", "D"), F.substring(reference, a["j"], n)).otherwise(F.repeat(F.lit("-"), n))
        return F.struct((a["i"] + F.when(op == "D", 0).otherwise(n)).alias("i"), (a["j"] + F.when(op == "I", 0).otherwise(n)).alias("j"), F.concat(a["q"], q).alias("q"), F.concat(a["r"], r).alias("r"))

    return F.aggregate(cigar_ops(cigar), zero, add, lambda a: F.struct(a["q"].alias("query"), a["r"].alias("reference")))


def orf_lengths(s: Column, threshold: int = 200, frame: int | None = None) -> Column:
    """Lengths of the reading frames of the best of three frames (by total length, then the first). A frame opens at a
    start codon and closes at a stop codon, and only then must have ``threshold`` bases; one that the end
    leaves open is kept."""

    def of(f: int) -> Column:
        # One letter a codon, so that stop codons split the frame into stretches; each step reads the sequence once.
        codons = F.regexp_extract_all(F.substring(s, f + 1, (1 << 31) - 1), F.lit("(?s).{1,3}"), F.lit(0))
        letter = lambda c: F.when(c.isin(*STOP_CODONS), "*").when(c.isin(*START_CODONS), "M").otherwise(".")
        stretches = F.split(F.array_join(F.transform(codons, letter), ""), r"\*", -1)

        def kept(st: Column) -> Column:
            sized = F.transform(st, lambda x, i: F.struct(F.when(F.instr(x, "M") > 0, (F.length(x) - F.instr(x, "M") + 1) * 3).otherwise(0).alias("n"), (i == F.size(st) - 1).alias("open")))
            return F.transform(F.filter(sized, lambda x: (x["n"] > 0) & (x["open"] | (x["n"] >= threshold))), lambda x: x["n"])

        # Through a lambda, so that the stretches are made once and not again for each of them.
        return F.get(F.transform(F.array(stretches), kept), F.lit(0))

    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    frames = F.array(*[of(f) for f in ((0, 1, 2) if frame is None else (frame,))])
    ranked = F.transform(frames, lambda x, i: F.struct((-total(x)).alias("t"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def wrapped(s: Column, width: int) -> Column:
    """Line breaks after every ``width`` characters."""
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n") if width > 0 else s


def fastg_name(name: Column, length: Column, cov: Column) -> Column:
    return F.concat(F.lit("EDGE_"), name, F.lit("_length_"), length.cast("string"), F.lit("_cov_"), F.round(cov, 5).cast("string"))
