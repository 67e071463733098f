"""Secret scan with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams
that any match must contain.  The index holds the postings (trigram, document)
of the trigrams that the rules mention, in the order of the trigrams.  A
query's postings are read and intersected by document, and only documents that
satisfy it are scanned with the rule's expression.  Rules without mandatory
trigrams scan all documents.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hadoop_path
from .spans import hex_digest, with_spans

#: Candidate documents up to this many are broadcast (two longs each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Strings that one stretch of a regular expression may stand for before it counts as unknown.
MAX_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules, then the rules this scan adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
)

#: A conjunction of disjunctions of trigram sets: every clause needs one of its sets to be present as a whole.
Query = list[list[frozenset[str]]]


def _trigrams(text: str) -> frozenset[str]:
    """Trigrams that cover a text of three characters or more end to end: all of it is asked for, in few postings."""
    return frozenset(text[i : i + 3] for i in {*range(0, len(text) - 2, 3), len(text) - 3})


def trigram_query(regex: str) -> Query:
    """Boolean query over lower-case trigrams that holds for the lower-cased text of any match.

    An empty query means that nothing is mandatory: such a rule scans fully.
    """
    clauses: Query = []

    def flush(strings: set[str] | None) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {_trigrams(s) for s in strings}
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))

    def strings_of(items) -> set[str] | None:
        """All lower-case strings that the items stand for, if they are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                more = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL or o is sre.RANGE for o, _ in arg):
                more = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if o is sre.RANGE else [a])}
            elif op is sre.SUBPATTERN:
                more = strings_of(arg[3])
            elif op is sre.BRANCH:
                parts = [strings_of(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
                one = strings_of(arg[2])
                more = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            else:
                more = None
            if more is None or len(out) * len(more) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        known: set[str] | None = {""}
        for item in items:
            more = strings_of([item])
            # what may be absent adds nothing that is mandatory to strings that have trigrams already
            ends = item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] == 0 and all(len(k) >= 3 for k in known)
            if ends:
                more = None
            if more is not None and len(known) * len(more) <= MAX_STRINGS:
                known = {a + b for a in known for b in more}
                continue
            flush(known)
            known = {""} if more is None else more
            op, arg = item
            if more is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif more is None and op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        flush(known)

    walk(sre_parser.parse(regex))
    return clauses


def trigrams_of(queries: Iterable[Query]) -> list[str]:
    return sorted({t for q in queries for clause in q for grams in clause for t in grams})


def _any_of(words: list[str]) -> str:
    """A regular expression for any of some words of one length, as a tree over their letters."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(h) + _any_of(rest) for h, rest in heads.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


#: Rules whose candidates fit the bits of a number.
MOST_RULES = 62


class TrigramIndex:
    """Postings ``gram string, id long`` of lower-cased texts at ``path``, in the order of ``gram`` and ``id``.

    It covers ``trigrams`` only: rules that mention others need an index of
    their own.  Each append adds files that are ranges of the order, so reading
    some trigrams skips the rest, and a trigram of very many documents spreads
    over several files.
    """

    def __init__(self, path: str, trigrams: list[str]) -> None:
        self.path, self.trigrams = path.rstrip("/"), trigrams

    def append(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Add the postings of ``docs``.  One pass over the texts finds the places of all trigrams."""
        firsts = "".join(sorted({re.escape(t[0]) for t in self.trigrams}))
        pattern = f"(?=[{firsts}])(?=({_any_of(self.trigrams)}))"
        with Scratch(docs.sparkSession, "postings") as scratch:
            grams = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(pattern), F.lit(1)))
            found = scratch.write(docs.select(F.col(id_col).cast("long").alias("id"), F.explode(grams).alias("gram")).select("gram", "id"), "found")
            found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("append").parquet(f"{self.path}/postings")

    def postings(self, spark: SparkSession, trigrams: list[str]) -> DataFrame:
        path, fs = hadoop_path(spark, f"{self.path}/postings")
        if not fs.exists(path):
            return spark.createDataFrame([], "gram string, id long")
        return spark.read.schema("gram string, id long").parquet(f"{self.path}/postings").where(F.col("gram").isin(trigrams))

    def candidates(self, spark: SparkSession, queries: dict[str, Query]) -> DataFrame:
        """``id long, rules long``: bit i is set if the i-th rule's query holds for the documents of that id.

        The postings of the queries are intersected by id: each id gathers the
        trigrams of its lists in masks, on the map side first.  At most
        ``MOST_RULES`` queries are answered at once.
        """
        if len(queries) > MOST_RULES:
            raise ValueError(f"{len(queries)} rules; an index answers {MOST_RULES} at a time")
        trigrams = trigrams_of(queries.values())
        number = F.create_map(*[x for i, t in enumerate(trigrams) for x in (F.lit(t), F.lit(i))])
        lists = self.postings(spark, trigrams).select("id", number[F.col("gram")].alias("no"))
        words = range((len(trigrams) + 59) // 60)
        bit = F.expr("shiftleft(1L, no % 60)")
        masks = lists.groupBy("id").agg(*[F.bit_or(F.when((F.col("no") / 60).cast("int") == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in words])
        rules = F.lit(0).cast("long")
        for i, query in enumerate(queries.values()):
            rules = rules + F.when(_holds(query, trigrams), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        return masks.select("id", rules.alias("rules")).where("rules <> 0")


def _holds(query: Query, trigrams: list[str]) -> Column:
    """The query over the masks ``m0, m1, ...`` of 60 trigrams each."""
    place = {t: i for i, t in enumerate(trigrams)}

    def present(grams: frozenset[str]) -> Column:
        need: dict[int, int] = {}
        for t in grams:
            need[place[t] // 60] = need.get(place[t] // 60, 0) | 1 << place[t] % 60
        tests = [F.col(f"m{k}").bitwiseAND(F.lit(bits)) == bits for k, bits in sorted(need.items())]
        return _all(tests)

    return _all([_any([present(grams) for grams in clause]) for clause in query])


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of all rules in every whole text.

    Matches are leftmost and non-overlapping for each rule; one whose group is
    too short is dropped without a retry.  The index only decides which
    documents a rule's expression reads, so results do not depend on it.

    Null texts count as empty and have no spans.  Rows that share an id (or
    have none) share their candidates and are verified each on its own text.
    An empty table gives an empty result.  Columns besides the two named are
    neither read nor kept.

    Returns ``doc_id long`` and for each rule an array column, named as its
    kind, of start, end, value, arg and before (see :mod:`spans`).
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with Scratch(docs.sparkSession, "secrets") as scratch:
        index = TrigramIndex(scratch.own_path("index"), trigrams_of(queries.values()))
        index.append(texts, "doc_id", "text")
        hits = scratch.write(index.candidates(docs.sparkSession, queries), "candidates", keep=True)
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    marked = texts.join(hits, texts["doc_id"].eqNullSafe(hits["id"]), "left").select("doc_id", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    number = {kind: i for i, kind in enumerate(queries)}
    only = {r.kind: F.col("rules").bitwiseAND(F.lit(1 << number[r.kind])) != 0 if r.kind in number else None for r in rules}
    # a run shorter than the least length is no match of the repeated form either, which spares collecting it
    regex = {r.kind: rf"{r.regex[:-1]}{{{r.least},}}+" if not r.group and r.kind not in number and r.regex.endswith("]+") else r.regex for r in rules}
    found = with_spans(marked, "text", {r.kind: (regex[r.kind], r.group, only[r.kind]) for r in rules})
    long_enough = [F.expr(f"filter({r.kind}, x -> length(x.arg) >= {r.least})").alias(r.kind) for r in rules]
    return found.select("doc_id", *long_enough)


def span_text(found: DataFrame, kinds: list[str]) -> Column:
    """``kind:start:end`` of the kinds' arrays by start, then kind as listed, comma-joined."""
    tagged = [F.expr(f"transform({kind}, x -> named_struct('start', x.start, 'no', {i}, 'end', x.end))") for i, kind in enumerate(kinds)]
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    ordered = F.array_sort(F.concat(*tagged))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.expr(names)[x["no"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base rules' spans and the text of all spans, one row a document."""
    found = scan_secrets(docs, rules, id_col, text_col)
    base = [r.kind for r in rules if r.base]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, hex_digest(span_text(found, base)).alias("base_sha256"), span_text(found, [r.kind for r in rules]).alias("spans"))
