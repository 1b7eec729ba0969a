"""Column functions on oriented paths (arrays of ``struct<n:string, e:boolean>``; ``e`` true is forward).

All are higher-order functions, so they stay in the JVM and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step(n, e) -> Column:
    return F.struct(F.col(n).alias("n") if isinstance(n, str) else n.alias("n"), F.col(e).alias("e") if isinstance(e, str) else e.alias("e"))


def reverse_path(p: Column) -> Column:
    """The same walk on the other strand."""
    return F.transform(F.reverse(p), lambda x: F.struct(x["n"].alias("n"), (~x["e"]).alias("e")))


def canonical(p: Column) -> Column:
    """The lesser of both strands."""
    return F.array_min(F.array(p, reverse_path(p)))


def rotations(p: Column) -> Column:
    n = F.size(p)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.slice(p, i, n), F.slice(p, F.lit(1), i - 1)))


def canonical_circular(p: Column) -> Column:
    """The least of all rotations of both strands."""
    return F.when(F.size(p) == 0, p).otherwise(F.array_min(F.concat(rotations(p), rotations(reverse_path(p)))))


def canonical_strand(p: Column, circular: Column) -> Column:
    """Whether the canonical form is one of the given strand (true) or of the other."""
    return F.when(circular, F.array_contains(rotations(p), canonical_circular(p))).otherwise(canonical(p) == p)


def canonical_variant(parts: Column) -> Column:
    """A set of circular chromosomes in canonical order."""
    return F.array_sort(F.transform(parts, canonical_circular))


def fix_palindromes(p: Column, palindromic: Column) -> Column:
    """Contigs that equal their reverse complement are always written forward."""
    return F.transform(p, lambda x: F.struct(x["n"].alias("n"), (x["e"] | F.array_contains(palindromic, x["n"])).alias("e")))


def roll(p: Column) -> Column:
    """The smallest repeating unit of a path."""
    n = F.size(p)
    periods = F.filter(F.sequence(F.lit(1), n), lambda d: F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(p, i) == F.get(p, i % d)))
    return F.when(n == 0, p).otherwise(F.slice(p, F.lit(1), F.array_min(periods)))


def parse_gaf(s: Column) -> Column:
    """``>a<b`` to a path; a bare name is forward, ``name:from-to`` loses its coordinates."""
    steps = F.regexp_extract_all(s, F.lit(r"([><]?[^<>\s]+)"), F.lit(1))
    return F.transform(steps, lambda x: F.struct(F.split_part(F.regexp_replace(x, "^[><]", ""), F.lit(":"), F.lit(1)).alias("n"), (~x.startswith("<")).alias("e")))


def to_gaf(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.concat(F.when(x["e"], ">").otherwise("<"), x["n"])), "")


def parse_bandage(s: Column) -> Column:
    """``a+,b-,c(circular)`` to a path; a missing sign is forward."""
    steps = F.split(F.regexp_replace(F.regexp_replace(s, r"\(circular\)\s*$", ""), r"\s", ""), ",")
    return F.transform(steps, lambda x: F.struct(F.regexp_replace(x, r"[+-]$", "").alias("n"), (~x.endswith("-")).alias("e")))


def to_bandage(p: Column, circular: Column) -> Column:
    body = F.array_join(F.transform(p, lambda x: F.concat(x["n"], F.when(x["e"], "+").otherwise("-"))), ",")
    return F.concat(body, F.when(circular, "(circular)").otherwise(""))


def links(p: Column) -> Column:
    """The half-edges a path uses, in order: struct<v1, e1, v2, e2>."""
    n = F.size(p)
    pair = lambda i: F.struct(
        F.get(p, i)["n"].alias("v1"), F.get(p, i)["e"].alias("e1"), F.get(p, i + 1)["n"].alias("v2"), (~F.get(p, i + 1)["e"]).alias("e2")
    )
    return F.when(n < 2, F.array().cast("array<struct<v1:string,e1:boolean,v2:string,e2:boolean>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 2), pair))


def closing_link(p: Column) -> Column:
    last, first = F.element_at(p, -1), F.element_at(p, 1)
    return F.struct(last["n"].alias("v1"), last["e"].alias("e1"), first["n"].alias("v2"), (~first["e"]).alias("e2"))


def windows(p: Column, longest: Column, shortest: int = 1) -> Column:
    """All runs of ``shortest`` to ``longest`` steps, with repeats."""
    n = F.size(p)
    top = F.least(n, longest)
    none = F.slice(F.array(p), F.lit(1), F.lit(0))
    every = F.flatten(F.transform(F.sequence(F.lit(shortest), top), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(p, i, k))))
    return F.when(top < shortest, none).otherwise(every)


def suffixes(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.slice(p, F.size(p) - k + 1, k))


# --- merge history ---


def history_add(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def history_negate(a: Column) -> Column:
    return reverse_path(a)


def history_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x["n"]), "_")


def history_names(a: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(a, lambda x: x["n"])))
