"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from the contract's expressions and always stay.  Further
candidates of valid formats (and the base matches that failed validation) are
judged: a format, a gazetteer and a context labeler vote on all of them,
expectation-maximisation estimates how reliable each labeler is, and the
resulting soft labels train a span classifier whose verdict decides which
candidates join the base spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .spans import hex_digest, with_spans

#: The base expressions.  Possessive repeats and the anchors at the start of a run
#: find the same matches and keep the scan linear; \G is the end of the previous match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

#: What else may be personal data.
MORE = {
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "localphone": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![A-Za-z])",
}

#: Words of the gazetteer labeler by kind.
GAZETTEER = {
    "email": "com org net edu gov io de fr es uk eu info".split(),
    "iban": "DE FR ES GB IT NL BE AT CH PT IE LU PL".split(),
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 62 81 82 86 90 91".split(),
    "name": "Smith Johnson Williams Brown Jones Garcia Miller Davis Martin Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Bernard Dubois Thomas Robert Richard Petit Durand Lopez Martinez Sanchez Perez Gomez Anna Maria John James Mary Peter Paul Hans Pierre Jean Juan Carlos".split(),
}

#: Words shortly before a span that speak for it, and ones that speak against any span.
CONTEXT_FOR = {
    "email": ["mail", "contact", "write", "correo", "adresse"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax", "telefon", "telefono"],
    "ssn": ["ssn", "social", "security", "taxpayer"],
    "iban": ["iban", "account", "konto", "compte", "cuenta", "bank"],
    "localphone": ["phone", "call", "tel", "mobile", "fax", "telefon", "telefono"],
    "name": ["name", "contact", "dear", "by", "from", "sincerely"],
}
CONTEXT_AGAINST = ["version", "order", "invoice", "isbn", "item", "model", "serial", "figure", "table", "section", "issue", "part"]

LABELERS = ("format", "gazetteer", "context")
#: Rounds of expectation-maximisation, and the pseudo-counts that anchor a labeler as better than chance.
ROUNDS = 25
ANCHOR = 4.0
#: Hashed features of the span classifier: its weights are a fixed-size vector.
FEATURES = 1024
#: Spans are added where the classifier's probability is at least this.
ACCEPT = 0.5

DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
LUHN = f"""(aggregate(sequence(1, length({DIGITS})), 0, (acc, i) -> acc + if(i % 2 = 1,
    cast(substring(reverse({DIGITS}), i, 1) as int),
    element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substring(reverse({DIGITS}), i, 1) as int)))) % 10 = 0)"""
#: Whether a match of a kind is valid, over the span x.
VALID = {
    "email": "true",
    "ip": r"x.value rlike '^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}$'",
    "card": f"if(length({DIGITS}) between 16 and 19, {LUHN}, false)",
    "phone": f"length({DIGITS}) between 8 and 15",
    "ssn": "x.value not rlike '^(?:000|666|9)' and substring(x.value, 5, 2) <> '00' and right(x.value, 4) <> '0000'",
    "iban": "length(replace(x.value, ' ', '')) between 15 and 34",
    "localphone": f"{DIGITS} rlike '^[2-9]..[2-9]'",
    "name": "true",
}


def _word_list(words: Iterable[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _votes(kind: str) -> str:
    """A candidate: the span with a vote of each labeler (1 for, -1 against, 0 silent) and hashed features."""
    words = "split(lower(x.before), '[^a-zà-ÿ]+')"
    if kind in GAZETTEER:
        parts = {"email": "array(element_at(split(x.value, '[.]'), -1))", "iban": "array(left(x.value, 2))", "phone": f"transform(array(1, 2, 3), n -> left({DIGITS}, n))"}.get(kind, "split(x.value, '[^A-Za-zà-ÿÀ-Ý]+')")
        gazetteer = f"if(arrays_overlap({parts}, {_word_list(GAZETTEER[kind])}), 1, -1)"
    elif kind == "card":
        gazetteer = f"if({DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)', 1, -1)"
    elif kind == "ip":
        gazetteer = "if(x.value rlike '^(?:0+|127|255)[.]', -1, 1)"
    else:
        gazetteer = "0"
    context = f"if(arrays_overlap({words}, {_word_list(CONTEXT_FOR[kind])}), 1, if(arrays_overlap({words}, {_word_list(CONTEXT_AGAINST)}), -1, 0))"
    features = ", ".join(
        [
            f"'k:{kind}'",
            f"concat('w:{kind}:', element_at({words}, -1))",
            f"concat('n:{kind}:', least(length(x.value), 40))",
            f"concat('d:{kind}:', least(length({DIGITS}), 24))",
            f"concat('s:{kind}:', left(regexp_replace(regexp_replace(regexp_replace(x.value, '[A-Z]+', 'A'), '[a-zà-ÿ]+', 'a'), '[0-9]+', '9'), 24))",
            f"concat('v:{kind}:', {VALID[kind]})",
        ]
    )
    hashed = f"transform(array_compact(array({features})), f -> cast(pmod(xxhash64(f), {FEATURES}) as int))"
    return f"named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'votes', array(if({VALID[kind]}, 1, -1), {gazetteer}, {context}), 'features', {hashed})"


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the valid base spans by kind, and ``judged``: all that the labelers vote on, with ``base``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    need = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "localphone": F.col("text").rlike(r"[0-9][ .-][0-9]{4}"), "ssn": F.col("text").rlike(r"[0-9]-[0-9]{2}-[0-9]")}
    found = with_spans(texts, "text", {k: (rx, 0, need.get(k)) for k, rx in (BASE | MORE).items()})
    valid = [F.expr(f"filter({k}, x -> {VALID[k]})").alias(k) for k in BASE]
    of_base = [F.expr(f"transform({k}, x -> named_struct('base', {VALID[k]}, 'c', {_votes(k)}))") for k in BASE]
    of_more = [F.expr(f"transform(filter({k}, x -> {VALID[k]}), x -> named_struct('base', false, 'c', {_votes(k)}))") for k in MORE]
    return found.select("doc_id", *valid, F.concat(*of_base, *of_more).alias("judged"))


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


#: Rates of a labeler's votes before anything is seen: it is right more often than wrong.
RIGHT = {v: 0.8 if v > 0 else 0.1 for v in (-1, 0, 1)}
Rates = dict[str, dict[str, dict[int, tuple[float, float]]]]


def estimate_reliability(patterns: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict[tuple[str, tuple[int, ...]], float], Rates]:
    """Two-class Dawid-Skene over vote patterns ``(kind, votes, count)``; there are at most 27 a kind.

    Labelers are as reliable as they are for a kind.  One that votes alike on
    all spans of a kind tells none of them from another and is not heard,
    unless all do: then what is assumed of them decides.  Returns the
    probability of personal data for each (kind, votes), and for each kind,
    labeler and vote its rates (among true spans, among false ones).
    """
    rates: Rates = {kind: {name: {v: (RIGHT[v], RIGHT[-v]) for v in (-1, 0, 1)} for name in LABELERS} for kind in BASE | MORE | {k: "" for k, _, _ in patterns}}
    posterior: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(votes, n) for k, votes, n in patterns if k == kind]
        prior, of = 0.5, rates[kind]
        differ = [len({votes[i] for votes, _ in own}) > 1 for i in range(len(LABELERS))]
        for name, differs in zip(LABELERS, differ):
            if any(differ) and not differs:
                of[name] = {v: (1.0, 1.0) for v in (-1, 0, 1)}
        for _ in range(ROUNDS if any(differ) else 1):
            for votes, _ in own:
                heard = sum(math.log(of[name][v][0] / of[name][v][1]) for name, v in zip(LABELERS, votes) if v)
                posterior[kind, votes] = _sigmoid(math.log(prior / (1 - prior)) + heard)
            prior = (1.0 + sum(posterior[kind, v] * n for v, n in own)) / (2.0 + sum(n for _, n in own))
            for i, name in [(i, name) for i, name in enumerate(LABELERS) if differ[i]]:
                true = {v: ANCHOR * RIGHT[v] + sum(n * posterior[kind, votes] for votes, n in own if votes[i] == v) for v in (-1, 0, 1)}
                false = {v: ANCHOR * RIGHT[-v] + sum(n * (1 - posterior[kind, votes]) for votes, n in own if votes[i] == v) for v in (-1, 0, 1)}
                of[name] = {v: (true[v] / sum(true.values()), false[v] / sum(false.values())) for v in (-1, 0, 1)}
    return posterior, rates


def train_classifier(judged: DataFrame, posterior: dict[tuple[str, tuple[int, ...]], float]) -> tuple[float, list[float]]:
    """Bias and weight of each hashed feature, by soft counts of all spans (naive Bayes).

    ``judged(kind, votes, features)``.  One aggregation; its result has at most
    ``FEATURES`` rows.
    """
    label = F.lit(0.5)
    for (kind, votes), q in sorted(posterior.items()):
        label = F.when((F.col("kind") == kind) & (F.concat_ws(",", F.transform("votes", lambda v: v.cast("string"))) == ",".join(map(str, votes))), F.lit(q)).otherwise(label)
    soft = judged.select(label.alias("q"), "features")
    total = soft.agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).first()
    yes, no = (total["yes"] or 0.0) + 1.0, (total["no"] or 0.0) + 1.0
    weights = [0.0] * FEATURES
    for row in soft.select("q", F.explode("features").alias("f")).groupBy("f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect():
        weights[row["f"]] = math.log((row["yes"] + 0.5) / (yes + 1.0)) - math.log((row["no"] + 0.5) / (no + 1.0))
    return math.log(yes / no), weights


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All personal-data spans of every whole text.

    Null texts count as empty and have no spans; repeated rows are judged each
    by itself and alike; an empty table gives an empty result.  Columns besides
    the two named are neither read nor kept.  Without any candidate nothing is
    added to the base spans; a candidate that overlaps one is left out.

    Returns ``doc_id long``, an array of base spans for each base kind and
    ``added``, an array of ``kind, start, end, probability``.
    """
    with Scratch(docs.sparkSession, "personal") as scratch:
        table = scratch.write(find_candidates(docs, id_col, text_col), "candidates", keep=True)
    judged = table.select(F.explode("judged").alias("j")).select("j.base", "j.c.*")
    counts = judged.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counts)
    posterior, rates = estimate_reliability(patterns)
    bias, weights = train_classifier(judged, posterior)
    vector = "array(" + ", ".join(f"{w!r}D" for w in weights) + ")"
    # votes count in the verdict as the reliabilities estimated for their kind say, features as the classifier has learned
    odds = lambda kind, name, v: repr(math.log(rates[kind][name][v][0] / rates[kind][name][v][1])) + "D"
    votes = lambda kind: " + ".join(f"case element_at(j.c.votes, {i + 1}) when 1 then {odds(kind, name, 1)} when -1 then {odds(kind, name, -1)} else 0D end" for i, name in enumerate(LABELERS))
    heard = "case j.c.kind " + " ".join(f"when '{kind}' then {votes(kind)}" for kind in BASE | MORE) + " end"
    score = f"({bias!r}D + {heard} + aggregate(j.c.features, 0D, (acc, f) -> acc + element_at({vector}, f + 1)) / 2D)"
    scored = F.expr(f"transform(filter(judged, j -> not j.base and element_at(j.c.votes, 1) = 1), j -> named_struct('kind', j.c.kind, 'start', j.c.start, 'end', j.c.end, 'probability', 1D / (1D + exp(-{score}))))")
    added = table.select("doc_id", *BASE, scored.alias("found")).withColumn("found", F.expr(f"filter(found, a -> a.probability >= {ACCEPT})"))
    # a base span is a run of ones in a mask as long as the text up to there; the optimizer must not move masks into the lambda
    masked = added.select("*", *[F.expr(_mask(k)).alias(f"_{k}") for k in BASE])
    covered = " or ".join(f"if(_{k} is null, false, contains(cast(substring(_{k}, cast(a.start + 1 as int), cast(a.end - a.start as int)) as string), '1'))" for k in BASE)
    return masked.select("doc_id", *BASE, F.expr(f"filter(found, a -> not ({covered}))").alias("added"))


def _mask(kind: str) -> str:
    """Bytes ``0`` and ``1`` for the characters of a text up to the last span of a kind: 1 within spans; null without work to do."""
    before = f"if(i = 0, 0, {kind}[i - 1].end)"
    runs = f"transform(sequence(0, size({kind}) - 1), i -> concat(repeat('0', cast({kind}[i].start - {before} as int)), repeat('1', cast({kind}[i].end - {kind}[i].start as int))))"
    return f"if(size({kind}) = 0 or size(found) = 0, null, cast(array_join({runs}, '') as binary))"


def _span_list(kind: str) -> str:
    return f"transform({kind}, x -> concat('{kind}:', x.start, ':', x.end))"


def personal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and the text of all spans, one row a document."""
    found = find_personal_data(docs, id_col, text_col)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    base = [F.expr(_span_list(k)) for k in BASE]
    added = [F.expr(f"transform(array_sort(filter(added, a -> a.kind = '{k}'), (l, r) -> cast(sign(l.start - r.start) as int)), a -> concat(a.kind, ':', a.start, ':', a.end))") for k in MORE]
    return found.select("doc_id", *counts, hex_digest(F.array_join(F.concat(*base), ",")).alias("base_sha256"), F.array_join(F.concat(*base, *added), ",").alias("spans"))
