"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_of, held_out, read_table
from .embeddings import embedding_groups
from .exact_dedup import dedup_once
from .filters import SPACES, filter_audit
from .language import fit_languages, with_language
from .licenses import with_licenses
from .mixing import entropy_mix
from .periodic import with_runs
from .pieces import PieceModel, with_pieces
from .pii import personal_report
from .repeats import passage_digests
from .secrets import RULES, secret_report
from .simhash import simhash_groups
from .toxicity import THRESHOLD, fit_toxicity, with_toxicity


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, its rate and the words that the mix takes of it."""
    mix = entropy_mix(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from text and language outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), fit_languages(docs), "found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.size("found.spans").alias("n_spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labels outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")), "found")
    score = F.col("found.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.size("found.passages").alias("n_passages"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.9."""
    return embedding_groups(read_table(spark, sf_dir, "embeddings"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text, the scores of its best two segmentations, and whether decoding gives it back."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pieces(docs, PieceModel.load(), "found", keep_ids=False)
    best, second = F.col("found.scores")[0], F.get("found.scores", F.lit(1))
    return found.select("doc_id", "found.n_pieces", best.alias("score"), second.alias("second_score"), "found.ids_sha256", "found.exact")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text on three-word shingles, and its group at three differing bits."""
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans by kind, and what the classifier adds."""
    return personal_report(read_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one that stays of its equal texts."""
    return dedup_once(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every whole text states."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_licenses(docs, "found")
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["wording"], x["start"].cast("string"), x["end"].cast("string"), x["missing"].cast("string"), x["foreign"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base spans by kind, and those of further rules."""
    return secret_report(read_table(spark, sf_dir, "documents"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's repeats: in every tenth document (by crc32 of its id) the words from some place on repeat with some period."""
    docs = docs.select("doc_id", "text", F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "").alias("w"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.select("doc_id", "text", "w", "h", F.size("w").cast("long").alias("n"), F.expr("h div 10").alias("g"))
    docs = docs.select("doc_id", "text", "w", "n", F.expr("if(h % 10 = 0 and n > 0, g % n, null)").alias("a"), "g")
    docs = docs.select("doc_id", "text", "w", "n", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    planted = F.expr("if(a is null, text, array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' '))")
    return docs.select("doc_id", planted.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every whole text, the one with most periods, and the text with its runs collapsed."""
    docs = _with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = with_runs(docs, "found")
    runs, best = F.col("found.runs"), F.col("found.best")
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    spelled = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.expr("1000 * found.best.length div found.best.period").alias("exponent_milli"), sha(spelled).alias("runs_sha256"), sha(F.col("found.collapsed")).alias("collapsed_sha256"))
    with batches_of(spark, 1_000), Scratch(spark, "runs") as scratch:
        return scratch.write(out, "runs", keep=True)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five text filters removes at every step of all 120 orders, by source."""
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text when bytes covered by an earlier string of 100 bytes are removed."""
    return passage_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_entropy_mixing": op1_entropy_mixing,
    "op2_language_spans": op2_language_spans,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_piece_encoding": op5_piece_encoding,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_pii_spans": op7_pii_spans,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_repeated_passages": op13_repeated_passages,
}



def _secret_sql() -> str:
    """The secret scan as SQL: every rule on every text, matches and the stretches between them laid end to end."""
    kinds, columns, laid = [r.kind for r in RULES], [], []
    for no, r in enumerate(RULES):
        regex = r.regex.replace("'", "''") if r.kind != "hex" else "[0-9a-f]{24,}"
        columns.append(f"regexp_extract_all(t, '{regex}') AS v_{r.kind}, regexp_extract_all(t, '{regex}', {r.group}) AS a_{r.kind}, string_split_regex(t, '{regex}') AS g_{r.kind}")
        start = f"coalesce(list_sum(list_transform(g_{r.kind}[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(v_{r.kind}[1:i - 1], lambda y: length(y))), 0)"
        laid.append(f"list_transform(list_filter(range(1, len(v_{r.kind}) + 1), lambda i: length(a_{r.kind}[i]) >= {r.least}), lambda i: {{'s': CAST({start} AS BIGINT), 'k': {no}, 'e': CAST({start} + length(v_{r.kind}[i]) AS BIGINT)}}) AS s_{r.kind}")
    names = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    base = [r.kind for r in RULES if r.base]
    joined = lambda ks: f"array_to_string(list_transform(list_sort(flatten([{', '.join(f's_{k}' for k in ks)}])), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(columns)} FROM d), p AS (SELECT doc_id, {', '.join(laid)} FROM m)
        SELECT doc_id, {', '.join(f'CAST(len(s_{k}) AS BIGINT) AS n_{k}' for k in base)}, sha256({joined(base)}) AS base_sha256, {joined(kinds)} AS spans FROM p"""


#: The contract's base expressions of personal data, and when a match of each is valid.
_PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"regexp_full_match(v, '(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}')"),
    "card": (r"[0-9]([ -]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, length(d) - i, 1) AS INT) ELSE (CAST(substr(d, length(d) - i, 1) AS INT) * 2) // 10 + (CAST(substr(d, length(d) - i, 1) AS INT) * 2) % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
}


def _personal_sql() -> str:
    """The base spans as SQL: matches and the stretches between them laid end to end.  No further span is in the tables' texts."""
    parts = [f"SELECT doc_id, {no} AS k, '{kind}' AS kind, regexp_extract_all(t, '{regex}') AS vs, string_split_regex(t, '{regex}') AS gs FROM d" for no, (kind, (regex, _)) in enumerate(_PERSONAL.items())]
    valid = " ".join(f"WHEN {no} THEN {test}" for no, (_, test) in enumerate(_PERSONAL.values()))
    counts = ", ".join(f"count(*) FILTER (k = {no}) AS n_{kind}" for no, kind in enumerate(_PERSONAL))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
        e AS (SELECT doc_id, k, kind, vs, gs, unnest(range(1, len(vs) + 1)) AS i FROM m),
        p AS (SELECT doc_id, k, kind, vs[i] AS v, regexp_replace(vs[i], '[^0-9]', '', 'g') AS d,
            CAST(list_sum(list_transform(gs[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s FROM e),
        f AS (SELECT doc_id, k, s, kind || ':' || s || ':' || (s + length(v)) AS span FROM p WHERE CASE k {valid} END),
        j AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY k, s) AS spans FROM f GROUP BY 1)
        SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _PERSONAL)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON j.doc_id = d.doc_id"""


ORACLE_SQL = {
    "op4_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        usable AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1),
        least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM e LEFT JOIN degree USING (vec_id) LEFT JOIN least USING (vec_id)
    """,
    "op7_pii_spans": _personal_sql(),
    "op12_filter_interactions": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
        f AS (SELECT part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
                regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        cells AS (SELECT part, [x for x in [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END] if x IS NOT NULL] AS failed, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
        orders AS (SELECT v.k || w.k || x.k || y.k || z.k AS filter_order FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
        steps AS (SELECT filter_order, step, filter_order[step] AS own, [filter_order[i] for i in range(1, step)] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        r AS (SELECT part, filter_order, step, own,
                sum(CASE WHEN NOT list_has_any(failed, before) AND NOT list_contains(failed, own) THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN NOT list_has_any(failed, before) AND list_contains(failed, own) THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN list_has_any(failed, before) AND list_contains(failed, own) THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN failed = [own] THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN good AND NOT list_has_any(failed, before) AND list_contains(failed, own) THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN toxic AND NOT list_has_any(failed, before) AND list_contains(failed, own) THEN n ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
    """,
    "op10_secret_scan": _secret_sql(),
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
