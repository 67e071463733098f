"""Positions of regular-expression matches with DataFrame functions only.

Spark returns matches and the stretches between them, but no positions; laid
end to end the two give every position in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,value:string,arg:string,before:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Characters before a match that are kept as its context.
CONTEXT = 32
#: Matches whose positions are summed up one after the other; sums of such blocks carry on from block to block.
BLOCK = 256


def with_spans(df: DataFrame, text: str, rules: dict[str, tuple[str, int, Column | None]]) -> DataFrame:
    """Add, for each rule ``name: (regex, group, only_if)``, an array of its leftmost non-overlapping matches.

    An element has start and end (code points, end exclusive), the match, the
    text of ``group`` and up to ``CONTEXT`` characters before it.  Where
    ``only_if`` is false the array is empty unseen.  ``text`` must not be null.

    Work is linear in the text for regexes that the engine scans linearly, and
    in the number n of matches up to some ten million in one text: running sums
    are taken in blocks, which costs n * BLOCK / 2 + (n / BLOCK) ** 2 / 2 steps.
    """
    kept = [c for c in df.columns if c not in rules]
    none = F.array().cast("array<string>")
    found = []
    for name, (regex, group, only_if) in rules.items():
        for suffix, g in (("v", 0), *([("a", group)] if group else [])):
            hits = F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(g))
            found.append((hits if only_if is None else F.when(only_if, hits).otherwise(none)).alias(f"_{name}_{suffix}"))
    # every step reads the columns of the one before more than once: the optimizer must not move a step into a lambda
    df = df.select(*kept, *found)
    df = df.select("*", *[F.when(F.size(f"_{name}_v") > 0, F.split(text, regex, -1)).alias(f"_{name}_g") for name, (regex, _, _) in rules.items()])
    for step in (_lengths, _block_sums, _block_starts, _ends):
        df = df.select("*", *[F.expr(step(f"_{name}")).alias(f"_{name}_{step.__name__.rsplit('_')[-1]}") for name in rules])
    return df.select(*kept, *[F.expr(_spans(f"_{name}", "a" if group else "v")).alias(name) for name, (_, group, _) in rules.items()])


def _lengths(x: str) -> str:
    """Characters of each match and of the stretch before it."""
    return f"if(size({x}_v) = 0, null, transform(sequence(0, size({x}_v) - 1), i -> cast(length({x}_g[i]) + length({x}_v[i]) as bigint)))"


def _block_sums(x: str) -> str:
    d = f"{x}_lengths"
    return f"if({d} is null, null, transform(sequence(0, (size({d}) - 1) div {BLOCK}), b -> aggregate(slice({d}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0L, (acc, n) -> acc + n)))"


def _block_starts(x: str) -> str:
    s = f"{x}_sums"
    return f"if({s} is null, null, aggregate({s}, named_struct('at', 0L, 'out', cast(array() as array<bigint>)), (acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, array(acc.at))), acc -> acc.out))"


def _ends(x: str) -> str:
    """Where each match ends."""
    d, o = f"{x}_lengths", f"{x}_starts"
    within = f"aggregate(slice({d}, b * {BLOCK} + 1, {BLOCK}), named_struct('at', {o}[b], 'out', cast(array() as array<bigint>)), (acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, array(acc.at + n))), acc -> acc.out)"
    return f"if({d} is null, null, flatten(transform(sequence(0, size({o}) - 1), b -> {within})))"


def _spans(x: str, arg: str) -> str:
    v, g, e = f"{x}_v", f"{x}_g", f"{x}_ends"
    return f"""if({e} is null, {NO_SPANS}, transform(sequence(0, size({v}) - 1), i -> named_struct(
        'start', {e}[i] - length({v}[i]), 'end', {e}[i], 'value', {v}[i], 'arg', {x}_{arg}[i], 'before', right({g}[i], {CONTEXT}))))"""


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
