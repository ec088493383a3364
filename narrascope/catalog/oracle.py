"""The same queries in SQL over the same tables, written independently of the Spark side."""

from __future__ import annotations

from narrascope.catalog import params as P
from narrascope.functions.text import NON_WORD, STRIP_CHARS
from narrascope.functions.vectors import FLOAT32_MAX, QUADRANTS
from narrascope.operators import emotion as E


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, names: str) -> str:
    def lit(v):
        return f"{v!r}::DOUBLE" if isinstance(v, float) else q(v) if isinstance(v, str) else f"{v}::BIGINT"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({names})"


# The characters on which a white-space split of a Unicode string breaks.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
CHARS = " || ".join(f"chr({ord(c)})" for c in STRIP_CHARS)
SPLIT = rf"regexp_split_to_array(lower(text), '{NON_WORD}')"
TOKENS = f"[t FOR t IN {SPLIT} IF t <> '']"
ALPHA = f"[t FOR t IN {SPLIT} IF regexp_full_match(t, '[a-z]{{3,}}')]"
STOP = "(" + ", ".join(q(w) for w in P.STOP_WORDS) + ")"
NO_STOP = f"[t FOR t IN {ALPHA} IF t NOT IN {STOP}]"
WORDS = f"len([w FOR w IN regexp_split_to_array(text, '{WHITESPACE}') IF w <> ''])"
CLEAN = f"lower(trim(replace({{0}}, chr(10), ' '), {CHARS}))"
GRAMS = (
    "list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))], "
    "[t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)])"
)
Q = [name for name, _ in QUADRANTS]


def quadrant(x: str, y: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {y} IS NULL OR isnan({x}) OR isnan({y}) THEN NULL "
        f"WHEN {x} > 0 AND {y} > 0 THEN {q(Q[0])} WHEN {x} <= 0 AND {y} > 0 THEN {q(Q[1])} "
        f"WHEN {x} > 0 THEN {q(Q[2])} ELSE {q(Q[3])} END"
    )


def slug(c: str) -> str:
    return f"replace(replace(lower({c}), ' ', '_'), '+', 'plus')"


def label(s: str) -> str:
    return (
        f"CASE WHEN {s} >= 0.3::DOUBLE THEN {q(E.BLISSFUL)} WHEN {s} >= 0.05::DOUBLE THEN {q(E.POSITIVE)} "
        f"WHEN {s} <= -0.4::DOUBLE THEN {q(E.NIGHTMARE)} WHEN {s} <= -0.05::DOUBLE THEN {q(E.NEGATIVE)} "
        f"ELSE {q(E.NEUTRAL)} END"
    )


def hits(words) -> str:
    return "(" + " + ".join(f"contains(lower(text), {q(w)})::INT" for w in words) + ")::INT"


POINTS = (
    "p AS (SELECT vec_id, label, embedding, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y "
    "FROM embeddings)"
)
QPOINTS = f"{POINTS}, qp AS (SELECT *, {quadrant('x', 'y')} AS quadrant FROM p)"

DICT = f"""raw AS (SELECT ord, symbol, 'meaning ' || ord AS meaning FROM {values(P.DICTIONARY, 'ord, symbol')}),
dict AS (SELECT *, len(string_split(clean, ' '))::INT AS n_words FROM (
  SELECT *, {CLEAN.format('symbol')} AS clean FROM raw)
  QUALIFY row_number() OVER (PARTITION BY clean ORDER BY ord) = 1)"""
GRAM_ROWS = f"""grams AS (SELECT doc_id, unnest({GRAMS}) AS clean FROM (
  SELECT doc_id, {TOKENS} AS t FROM documents))"""
HITS = f"""{DICT}, {GRAM_ROWS},
hits AS (SELECT DISTINCT g.doc_id, g.clean, d.ord, d.n_words FROM grams g JOIN dict d USING (clean))"""
MATCH = f"""{HITS},
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, ord) = 1),
matched AS (SELECT d.doc_id, d.source, {WORDS.replace('text', 'd.text')}::INT AS word_count,
  coalesce(x.symbol, 'Uncategorized') AS matched_symbol, x.meaning AS interpretation
  FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN dict x ON x.ord = b.ord)"""
SYMBOL_SUMMARY = f"""{MATCH},
summary AS (SELECT matched_symbol, count(*) AS dreams_count, sum(word_count)::BIGINT AS total_words,
  round(avg(word_count), 4) AS avg_words, count(DISTINCT source) AS dreamers_count,
  round(count(*) * 100e0 / (SELECT count(*) FROM documents), 4) AS percent,
  CASE WHEN matched_symbol = 'Uncategorized' THEN 'No match found' ELSE max(interpretation) END AS interpretation
  FROM matched GROUP BY matched_symbol)"""
DERIVED = f"""raw AS (SELECT doc_id * 1000000 + i AS ord, lines[i + 1] AS symbol, source AS meaning
  FROM (SELECT *, unnest(range(len(lines))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))),
cleaned AS (SELECT *, {CLEAN.format('symbol')} AS clean FROM raw)"""
DEDUPED = f"""{DERIVED},
deduped AS (SELECT clean, ord, symbol, meaning,
  len([w FOR w IN regexp_split_to_array(clean, '{WHITESPACE}') IF w <> ''])::INT AS n_words,
  regexp_full_match(clean, '[\\p{{L}}\\p{{N}}_]+( [\\p{{L}}\\p{{N}}_]+){{0,2}}') AS matchable,
  count(*) OVER (PARTITION BY clean) AS n_entries
  FROM cleaned QUALIFY row_number() OVER (PARTITION BY clean ORDER BY ord) = 1)"""

VALENCE = f"""lex AS (SELECT * FROM {values(P.LEXICON, 'word, valence')}),
sums AS (SELECT t.doc_id, round(coalesce(sum(valence), 0e0), 6) AS s FROM
  (SELECT doc_id, unnest({SPLIT}) AS word FROM documents) t LEFT JOIN lex USING (word) GROUP BY t.doc_id),
base AS (SELECT doc_id, s / sqrt(s * s + 15e0) AS base_score FROM sums)"""
RULED = f"""lex AS (SELECT * FROM {values(P.LEXICON, 'word, valence')}),
rules AS (SELECT * FROM {values(P.RULES, 'word, kind, step')}),
split AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')
  FOR y IN regexp_split_to_array(text, '{WHITESPACE}')] IF x <> ''] AS ws FROM documents),
one AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
low AS (SELECT doc_id, i, lower(w) AS l,
  regexp_full_match(w, '[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*') AND length(w) > 1 AS loud FROM one),
known AS (SELECT doc_id, i, coalesce(valence, 0)::DOUBLE AS v, CASE WHEN kind = 'booster' THEN step ELSE 0 END::DOUBLE AS b,
  coalesce(kind = 'negation', false) AS neg, coalesce(kind = 'contrast', false) AS con,
  loud AND NOT bool_and(loud) OVER (PARTITION BY doc_id) AS up
  FROM low LEFT JOIN lex ON lex.word = l LEFT JOIN rules ON rules.word = l),
moved AS (SELECT doc_id, i, v + sign(v) * (CASE WHEN up THEN 0.733e0 ELSE 0e0 END + coalesce(lag(b, 1) OVER o, 0e0)
    + 0.95e0 * coalesce(lag(b, 2) OVER o, 0e0) + 0.9e0 * coalesce(lag(b, 3) OVER o, 0e0)) AS x,
  coalesce(bool_or(neg) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS turned,
  min(CASE WHEN con THEN i END) OVER (PARTITION BY doc_id) AS c FROM known WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sums AS (SELECT doc_id, round(sum(x * CASE WHEN turned THEN -0.74e0 ELSE 1e0 END
  * CASE WHEN c IS NULL OR i = c THEN 1e0 WHEN i < c THEN 0.5e0 ELSE 1.5e0 END), 6) AS s FROM moved GROUP BY doc_id),
marked AS (SELECT doc_id, coalesce(s, 0e0) + sign(coalesce(s, 0e0)) * 0.292e0
  * least(4, length(text) - length(replace(text, '!', ''))) AS s FROM documents LEFT JOIN sums USING (doc_id))"""
SCORED = f"""{VALENCE},
hit AS (SELECT doc_id, {hits(P.NEGATIVE_KEYWORDS)} AS neg_hits, {hits(P.POSITIVE_KEYWORDS)} AS pos_hits FROM documents),
moved AS (SELECT *, greatest(-1e0, least(1e0, base_score + (pos_hits * 0.15::DOUBLE - neg_hits * 0.15::DOUBLE)))
  AS sentiment_score FROM base JOIN hit USING (doc_id)),
scored AS (SELECT *, {label('sentiment_score')} AS sentiment_label FROM moved)"""
TOPICS = "topic AS (SELECT doc_id, (quality * 2 + toxic)::INT AS topic_id FROM labels)"
TOP_WORDS = f"""{TOPICS},
weights AS (SELECT topic_id, term, count(*)::DOUBLE AS weight FROM
  (SELECT topic_id, unnest({NO_STOP}) AS term FROM documents JOIN topic USING (doc_id)) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term)::INT AS rank FROM weights
  QUALIFY rank <= 10)"""
KEYWORDS = f"""{TOP_WORDS},
keywords AS (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS keywords,
  string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 3) AS short_keywords FROM top GROUP BY topic_id)"""
TERMS = f"""bag AS (SELECT doc_id, term, count(*) AS cnt FROM
  (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL)"""

ELLIPSIZED = (
    f"CASE WHEN length(trim(text, {CHARS})) > 600 THEN substring(trim(text, {CHARS}), 1, 600) || '…' "
    f"ELSE trim(text, {CHARS}) END"
)
EXTREMES = f"""axes AS (SELECT vec_id, i::INT AS axis_id, embedding[i]::DOUBLE AS raw FROM embeddings, range(1, {P.N_AXES + 1}) r(i)),
poles AS (SELECT *, 'positive' AS pole, -raw AS sort_by FROM axes UNION ALL SELECT *, 'negative', raw FROM axes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY axis_id, pole ORDER BY sort_by, vec_id)::INT AS rank FROM poles
  QUALIFY rank <= {P.PER_POLE}),
ext AS (SELECT axis_id, pole, rank, vec_id, round(raw, 4) + 0e0 AS score, {ELLIPSIZED} AS text
  FROM ranked JOIN documents ON doc_id = vec_id)"""
S = P.ROUND_SEED
ROUNDS = f"""{EXTREMES},
member AS (SELECT ext.*, r::INT AS round,
  CASE WHEN substring(md5('{S}:' || axis_id || ':' || r), 1, 1) < '8' THEN 'positive' ELSE 'negative' END AS shown,
  md5('{S}:pick:' || axis_id || ':' || r || ':' || vec_id) AS pick,
  md5('{S}:place:' || axis_id || ':' || r || ':' || vec_id) AS place
  FROM ext, range(1, {P.N_ROUNDS + 1}) x(r)),
chosen AS (SELECT * FROM member
  QUALIFY row_number() OVER (PARTITION BY axis_id, round, pole ORDER BY pick, vec_id) <=
    CASE WHEN pole = shown THEN 3 ELSE 1 END),
seated AS (SELECT *, row_number() OVER (PARTITION BY axis_id, round ORDER BY place) AS seat FROM chosen)"""

ANSWERS = """a AS (SELECT event_id, event_id AS round_id, 'm' || (user_id % 7) AS responder,
  'PC' || (event_id % 5 + 1) AS axis,
  CASE WHEN event_type IN ('click', 'view') THEN 'with_labels' ELSE 'no_labels' END AS condition,
  ((props->>'$.k')::INT % 4 + 1)::INT AS answer, (event_id % 4 + 1)::INT AS correct FROM events),
g AS (SELECT *, answer = correct AS is_correct, (answer = correct)::INT::DOUBLE AS hit FROM a)"""
BAND = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'middle' ELSE 'low' END"
ACCURACY = f"""{ANSWERS},
acc AS (SELECT responder, condition, CASE WHEN grouping(axis) = 1 THEN 'overall' ELSE axis END AS axis,
  count(*) AS n_answers, avg(hit) * 100e0 AS accuracy FROM g
  GROUP BY GROUPING SETS ((responder, condition, axis), (responder, condition)))"""
CENTRES = f"""c AS (SELECT vec_id::INT AS cluster, embedding::DOUBLE[] AS centre FROM embeddings WHERE vec_id < {P.N_CENTRES}),
assigned AS (SELECT e.vec_id, cluster FROM embeddings e, c
  QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], centre), cluster) = 1)"""


def digamma(x: str) -> str:
    """The asymptotic series ten places up, brought back by the recurrence."""
    y = f"({x} + 10)"
    series = f"1 / (12 * {y}^2) - 1 / (120 * {y}^4) + 1 / (252 * {y}^6) - 1 / (240 * {y}^8)"
    return f"(ln({y}) - 1 / (2 * {y}) - ({series}) - (" + " + ".join(f"1 / ({x} + {i})" for i in range(10)) + "))"


def _topics_step() -> str:
    """Inner steps and sums of one pass, a table per formula."""
    prior = f"(1e0 / {P.STEP_TOPICS})"
    parts = [
        f"""b AS (SELECT doc_id, term, count(*)::DOUBLE AS cnt FROM
  (SELECT doc_id, unnest({NO_STOP}) AS term FROM documents) GROUP BY ALL)""",
        f"""vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS w FROM (
  SELECT term, sum(cnt) AS n_total FROM b GROUP BY term
  HAVING count(*) >= 10 AND count(*) <= 0.9::DOUBLE * (SELECT count(*) FROM documents)
  ORDER BY n_total DESC, term LIMIT {P.STEP_TERMS}))""",
        "c AS (SELECT doc_id, w, cnt FROM b JOIN vocab USING (term))",
        f"start AS (SELECT z, w, (1 + (7 * w + 3 * z) % 5)::DOUBLE AS lam FROM vocab, (SELECT unnest(range({P.STEP_TOPICS})) AS z))",
        "tot AS (SELECT z, sum(lam) AS s FROM start GROUP BY z)",
        f"beta AS (SELECT z, w, exp({digamma('lam')} - {digamma('s')}) AS b FROM start JOIN tot USING (z))",
        f"th0 AS (SELECT doc_id, z, 1e0 AS t FROM (SELECT DISTINCT doc_id FROM c), (SELECT unnest(range({P.STEP_TOPICS})) AS z))",
    ]
    for i in range(P.STEP_INNER + 1):
        parts.append(f"m{i} AS (SELECT doc_id, w, sum(t * b) AS m FROM c JOIN th{i} USING (doc_id) JOIN beta USING (z, w) GROUP BY ALL)")
        if i < P.STEP_INNER:
            parts.append(f"""g{i} AS (SELECT doc_id, z, {prior} + sum(cnt * t * b / m) AS g FROM c JOIN m{i} USING (doc_id, w)
  JOIN th{i} USING (doc_id) JOIN beta USING (z, w) GROUP BY ALL)""")
            parts.append(f"th{i + 1} AS (SELECT doc_id, z, exp({digamma('g')}) AS t FROM g{i})")
    last = P.STEP_INNER
    return f"""WITH {", ".join(parts)}
SELECT (z + 1)::INT AS topic_id, term, round({prior} + sum(cnt * t * b / m), 4) + 0e0 AS weight FROM c JOIN m{last} USING (doc_id, w)
JOIN th{last} USING (doc_id) JOIN beta USING (z, w) JOIN vocab USING (w) GROUP BY z, term"""


MANY = f"""tb AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({ALPHA}) AS term FROM documents)),
tn AS (SELECT term, count(*) AS n_total FROM (SELECT unnest({ALPHA}) AS term FROM documents) GROUP BY term),
kw AS (SELECT term AS keyword FROM tn JOIN (SELECT term FROM tb GROUP BY term HAVING count(*) >= 2) USING (term)
  ORDER BY n_total DESC, term LIMIT {P.MANY_KEYWORDS}),
found AS (SELECT doc_id, keyword FROM documents JOIN kw ON contains(lower(text), keyword))"""


def bin_of(v: str, lo: str, hi: str) -> str:
    return (
        f"CASE WHEN {hi} > {lo} THEN least(floor(({v} - {lo}) / ({hi} - {lo}) * {P.BINS})::INT, {P.BINS - 1}) "
        f"ELSE 0 END"
    )


def colour(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {slug(q(n))} THEN {q(k)}" for n, k in QUADRANTS) + " END"


def title(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = {slug(q(n))} THEN {q(n)}" for n, _ in QUADRANTS) + " END"


def joined(tokens: str) -> str:
    return (
        f"SELECT doc_id, len(w) || ':' || array_to_string(w, ' ') AS tokens "
        f"FROM (SELECT doc_id, {tokens} AS w FROM documents)"
    )


def all_sql() -> dict[str, str]:
    sql = {
        "dataset_ids": "SELECT DISTINCT split_part(source, '.', 1) AS dataset_id FROM documents",
        "scan_folder": """SELECT doc_id, CASE WHEN lang <> 'de' THEN lang END AS lang, text AS dream FROM documents""",
        "corpus_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "corpus_by_ranges": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "one_dataset": "SELECT doc_id, text, lang FROM documents",
        "one_quadrant": f"WITH {QPOINTS} SELECT vec_id, x, y, quadrant FROM qp WHERE quadrant = {q(Q[2])}",
        "emotion_facts": f"""WITH {SCORED} SELECT doc_id, text, source, round(sentiment_score, 4) + 0e0 AS sentiment_score,
            sentiment_label FROM scored JOIN documents USING (doc_id)""",
        "mean_text_length": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, round(avg(length({c})), 4) AS mean_length FROM documents"
            for c in ("text", "lang", "source")
        ),
        "word_count": f"SELECT doc_id, {WORDS}::INT AS word_count FROM documents",
        "clean_symbols": f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents",
        "ellipsize": f"SELECT doc_id, {ELLIPSIZED} AS short_text FROM documents",
        "snippets": "SELECT doc_id, "
        + ", ".join(f"substring(text, 1, {n}) || '...' AS snippet_{n}" for n in (20, 60, 300))
        + " FROM documents",
        "quadrant_slug": f"WITH {QPOINTS} SELECT vec_id, quadrant, {slug('quadrant')} AS quadrant_slug FROM qp",
        "tokens_word": joined(TOKENS),
        "tokens_alpha3": joined(ALPHA),
        "tokens_no_stop": joined(NO_STOP),
        "ngrams": f"SELECT doc_id, array_to_string({GRAMS}, '|') AS grams FROM "
        f"(SELECT doc_id, {TOKENS} AS t FROM documents)",
        "vector_clean": f"""SELECT vec_id, (i - 1)::INT AS pos, CASE WHEN x > 0.2::DOUBLE THEN {FLOAT32_MAX!r}::DOUBLE
            WHEN x < -0.2::DOUBLE THEN -{FLOAT32_MAX!r}::DOUBLE WHEN abs(x) < 0.01::DOUBLE THEN 0e0 ELSE x END AS value
            FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)""",
        "quadrant_dim": f"""WITH {QPOINTS}, s AS (SELECT vec_id, {slug('quadrant')} AS quadrant_slug FROM qp)
            SELECT vec_id, quadrant_slug, {title('quadrant_slug')} AS title, {colour('quadrant_slug')} AS colour FROM s""",
        "median_split": f"""WITH {POINTS} SELECT vec_id, CASE WHEN x >= (SELECT median(x) FROM p)
            THEN 'High emotional / dramatic' ELSE 'Everyday / mundane' END AS split_label FROM p""",
        "quadrants": f"""WITH {POINTS}, s AS (SELECT vec_id, y, CASE WHEN label = 9 THEN 'nan'::DOUBLE
            WHEN label = 8 THEN NULL ELSE x END AS x FROM p)
            SELECT vec_id, {quadrant('x', 'y')} AS quadrant FROM s""",
        "sentiment_labels": f"WITH {POINTS} SELECT vec_id, {label('(x * 4)')} AS sentiment_label FROM p",
        "groups_with_min_size": f"""SELECT conv_id, turn FROM conversations WHERE conv_id IN
            (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= {P.MIN_TURNS})""",
        "sample_n": f"""SELECT doc_id FROM documents ORDER BY md5('{P.SAMPLE_SEED}:' || doc_id), doc_id
            LIMIT {P.SAMPLE_SIZE}""",
        "vocabulary": f"""WITH b AS (SELECT doc_id, term, count(*) AS cnt FROM
            (SELECT doc_id, unnest({NO_STOP}) AS term FROM documents) GROUP BY ALL)
            SELECT term, count(*) AS n_docs, sum(cnt)::BIGINT AS n_total FROM b GROUP BY term
            HAVING count(*) >= 10 AND count(*) <= 0.9::DOUBLE * (SELECT count(*) FROM documents)
            ORDER BY n_total DESC, term LIMIT 1500""",
        "annotated_points": f"""WITH {POINTS}, f AS (SELECT vec_id, x, y, text, row_number() OVER (ORDER BY vec_id) AS n
            FROM p JOIN documents ON doc_id = vec_id)
            SELECT vec_id, x, y, substring(text, 1, 20) || '...' AS annotation FROM f WHERE n <= 50 AND (n - 1) % 5 = 0""",
        "symbol_hits": f"WITH {HITS} SELECT doc_id, clean, ord, n_words FROM hits",
        "symbol_counts": f"""WITH {DICT}, {GRAM_ROWS} SELECT doc_id, clean, count(*) AS cnt FROM grams
            JOIN dict USING (clean) GROUP BY ALL""",
        "symbol_match": f"WITH {MATCH} SELECT doc_id, word_count, matched_symbol, interpretation FROM matched",
        "symbol_summary": f"WITH {SYMBOL_SUMMARY} SELECT * FROM summary",
        "top_symbols": f"""WITH {SYMBOL_SUMMARY} SELECT matched_symbol, dreams_count, percent,
            substring(interpretation, 1, 60) || '...' AS interpretation_snippet FROM summary
            ORDER BY dreams_count DESC, matched_symbol LIMIT 20""",
        "symbol_dedupe": f"WITH {DEDUPED} SELECT * FROM deduped",
        "unmatchable_symbols": f"WITH {DEDUPED} SELECT clean, ord, n_words FROM deduped WHERE NOT matchable",
        "duplicate_symbols": f"""WITH {DERIVED} SELECT count(*) AS n_entries, count(DISTINCT clean) AS n_symbols,
            count(*) - count(DISTINCT clean) AS n_removed FROM cleaned""",
        "keyword_hits": f"""SELECT doc_id, {hits(P.NEGATIVE_KEYWORDS)} AS neg_hits,
            {hits(P.POSITIVE_KEYWORDS)} AS pos_hits FROM documents""",
        "keyword_hits_many": f"""WITH {MANY} SELECT doc_id, count(*) AS n_hits, sum(length(keyword))::BIGINT AS letters
            FROM found GROUP BY doc_id""",
        "keyword_reports": f"WITH {MANY} SELECT keyword, count(*) AS n_reports FROM found GROUP BY keyword",
        "ruled_score": f"WITH {RULED} SELECT doc_id, round(s / sqrt(s * s + 15e0), 4) + 0e0 AS base_score FROM marked",
        "lexicon_score": f"WITH {VALENCE} SELECT doc_id, round(base_score, 4) + 0e0 AS base_score FROM base",
        "hybrid_score": f"""WITH {SCORED} SELECT doc_id, round(base_score, 4) + 0e0 AS base_score, neg_hits, pos_hits,
            round(sentiment_score, 4) + 0e0 AS sentiment_score, sentiment_label FROM scored""",
        "load_report": """SELECT CASE WHEN source = 'src0' THEN 'first' ELSE 'others' END AS folder, count(*) AS n_rows,
            0::BIGINT AS n_errors FROM documents GROUP BY 1""",
        "info_files": "SELECT source AS short_name, count(*) AS n_dreams FROM documents GROUP BY source",
        "symbol_tables": f"""WITH {SYMBOL_SUMMARY} SELECT matched_symbol, interpretation, dreams_count, dreamers_count, total_words,
            total_words AS words_in_facts FROM summary""",
        "topic_tables": f"""WITH {KEYWORDS}, w AS (SELECT doc_id, source, {WORDS} AS word_count FROM documents)
            SELECT topic_id, keywords, dreams_count, dreamers_count, total_words, total_words AS words_in_facts FROM keywords
            JOIN (SELECT topic_id, count(*) AS dreams_count, count(DISTINCT source) AS dreamers_count,
                sum(word_count)::BIGINT AS total_words FROM w JOIN topic USING (doc_id) GROUP BY topic_id) USING (topic_id)""",
        "quadrant_results": f"""WITH {QPOINTS} SELECT vec_id, quadrant, {slug('quadrant')} AS quadrant_slug, x > y AS "right"
            FROM qp WHERE quadrant IS NOT NULL""",
        "scored_table": f"""WITH {SCORED} SELECT doc_id, round(sentiment_score, 4) + 0e0 AS sentiment_score, sentiment_label
            FROM scored""",
        "axis_export_file": f"""WITH {EXTREMES} SELECT axis_id, pole,
            row_number() OVER (PARTITION BY axis_id, pole ORDER BY rank)::INT AS rank, vec_id, text FROM ext""",
        "two_datasets": f"""WITH {SCORED} SELECT d.dataset_id, doc_id, round(sentiment_score, 4) + 0e0 AS sentiment_score,
            sentiment_label FROM scored, (VALUES ('a'), ('b')) d(dataset_id)""",
        "lda_checks": """SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_bad_sums, 0::BIGINT AS n_bad_topics,
            100 AS n_topics, 0 AS n_unordered FROM documents WHERE text IS NOT NULL""",
        "pca_checks": f"""WITH {QPOINTS}, v AS (SELECT slug, count(*) OVER (PARTITION BY slug) AS n, unnest(embedding)::DOUBLE AS x,
              unnest(range(len(embedding))) AS i FROM (SELECT embedding, {slug('quadrant')} AS slug FROM qp) WHERE slug IS NOT NULL),
            s AS (SELECT slug, i, any_value(n) AS n, sum(x * x) - sum(x) * sum(x) / count(*) AS ss FROM v GROUP BY ALL)
            SELECT slug AS quadrant_slug, any_value(n) AS n, true AS centred, true AS uncorrelated,
            round(sum(ss), 3) AS sum_squares FROM s WHERE n >= 10 GROUP BY slug""",
        "topics_step": _topics_step(),
        "kmeans_step": f"""WITH {QPOINTS}, c AS (SELECT vec_id::INT AS cluster, embedding::DOUBLE[] AS centre FROM embeddings
              WHERE vec_id < {P.N_CENTRES}),
            a AS (SELECT vec_id, {slug('quadrant')} AS quadrant_slug, cluster, qp.embedding::DOUBLE[] AS e FROM qp, c WHERE quadrant IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(qp.embedding::DOUBLE[], centre), cluster) = 1),
            u AS (SELECT quadrant_slug, cluster, unnest(e) AS x, unnest(range(len(e)))::INT AS i FROM a),
            m AS (SELECT quadrant_slug, cluster, i, count(*) AS n, avg(x) AS v FROM u GROUP BY ALL),
            g AS (SELECT quadrant_slug, cluster, unnest(centre) AS x, unnest(range(len(centre)))::INT AS i FROM c,
              (SELECT DISTINCT quadrant_slug FROM a))
            SELECT quadrant_slug, cluster, i, coalesce(n, 0) AS n, round(coalesce(v, x), 4) + 0e0 AS v
            FROM g LEFT JOIN m USING (quadrant_slug, cluster, i)""",
        "kmeans_checks": f"""WITH {QPOINTS} SELECT {slug('quadrant')} AS quadrant_slug, count(*) AS n, 4::BIGINT AS n_clusters, 0::BIGINT AS n_away
            FROM qp WHERE quadrant IS NOT NULL GROUP BY quadrant HAVING count(*) > 4""",
        "sentiment_distribution": f"""WITH {SCORED}, l AS (SELECT ord::INT AS label_order, sentiment_label FROM
            {values(list(enumerate(E.LABEL_ORDER, 1)), 'ord, sentiment_label')}),
            n AS (SELECT label_order, l.sentiment_label, count(doc_id) AS n FROM l LEFT JOIN scored USING (sentiment_label)
            GROUP BY ALL), p AS (SELECT *, n * 100e0 / (SELECT sum(n) FROM n) AS pct FROM n)
            SELECT label_order, sentiment_label, n, round(pct, 4) AS percent,
            repeat('█', floor(pct / 5)::INT) AS bar FROM p""",
        "topic_emotion": f"""WITH {SCORED}, {TOPICS}, t AS (SELECT topic_id, count(*) AS total_dreams,
            avg(sentiment_score) AS m, count(*) FILTER (sentiment_label = {q(E.NIGHTMARE)}) AS nightmare_count,
            count(*) FILTER (sentiment_label = {q(E.BLISSFUL)}) AS bliss_count
            FROM scored JOIN topic USING (doc_id) GROUP BY topic_id)
            SELECT topic_id, total_dreams, round(m, 4) + 0e0 AS avg_sentiment, nightmare_count, bliss_count,
            CASE WHEN m < -0.2::DOUBLE THEN '😱' WHEN m > 0.2::DOUBLE THEN '😍' ELSE '😐' END AS mood FROM t""",
        "extreme_reports": f"""WITH {SCORED},
            ends AS ((SELECT 'happiest' AS kind, doc_id, sentiment_score FROM scored
              ORDER BY sentiment_score DESC, doc_id LIMIT 1) UNION ALL
              (SELECT 'scariest', doc_id, sentiment_score FROM scored ORDER BY sentiment_score, doc_id LIMIT 1))
            SELECT kind, doc_id, round(sentiment_score, 4) + 0e0 AS sentiment_score,
            substring(text, 1, 300) || '...' AS snippet FROM ends JOIN documents USING (doc_id)""",
        "term_stats": f"""WITH {TERMS} SELECT term, count(*) AS n_docs, sum(cnt)::BIGINT AS n_total FROM bag
            GROUP BY term""",
        "bag_of_words": f"WITH {TERMS} SELECT doc_id, term, cnt FROM bag",
        "topic_top_words": f"WITH {TOP_WORDS} SELECT topic_id, term, weight, rank FROM top",
        "topic_keywords": f"WITH {KEYWORDS} SELECT * FROM keywords",
        "topic_join_keywords": f"""WITH {KEYWORDS} SELECT doc_id, topic_id, keywords, short_keywords FROM topic
            LEFT JOIN keywords USING (topic_id)""",
        "dominant_topic": """SELECT vec_id, list_position(embedding, list_max(embedding))::INT AS topic_id
            FROM embeddings""",
        "topic_summary": f"""WITH {TOPICS}, w AS (SELECT doc_id, source, {WORDS} AS word_count FROM documents)
            SELECT topic_id, count(*) AS dreams_count, sum(word_count)::BIGINT AS total_words,
            round(avg(word_count), 4) AS avg_words, count(DISTINCT source) AS dreamers_count,
            round(count(*) * 100e0 / (SELECT count(*) FROM w JOIN topic USING (doc_id)), 4) AS percent
            FROM w JOIN topic USING (doc_id) GROUP BY topic_id""",
        "reports_with_coords": f"""WITH {POINTS} SELECT doc_id, source, text, x, y FROM documents
            JOIN p ON vec_id = doc_id""",
        "source_counts": "SELECT source, count(*) AS n, grouping(source) = 1 AS is_total FROM documents GROUP BY ROLLUP (source)",
        "union_by_name": """SELECT * FROM documents UNION ALL BY NAME SELECT * FROM conversations""",
        "quadrant_counts": f"WITH {QPOINTS} SELECT quadrant, count(*) AS n FROM qp GROUP BY quadrant",
        "feature_hash": f"""WITH {TERMS},
            h AS (SELECT doc_id, (('0x' || substring(md5(term), 1, 6))::BIGINT % {P.HASH_DIM})::INT AS slot,
              CASE WHEN substring(md5(term), 7, 1) < '8' THEN cnt ELSE -cnt END AS w FROM bag),
            s AS (SELECT doc_id, slot, sum(w)::DOUBLE AS v FROM h GROUP BY ALL),
            n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY doc_id)
            SELECT doc_id, slot, round(v / norm, 4) + 0e0 AS value FROM s JOIN n USING (doc_id) WHERE v <> 0""",
        "project_axes": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i,
              unnest(embedding)::DOUBLE AS x FROM embeddings),
            m AS (SELECT i, avg(x) AS mu FROM e GROUP BY i),
            a AS (SELECT i, max(x) FILTER (vec_id = 0) AS w1, max(x) FILTER (vec_id = 1) AS w2 FROM e GROUP BY i)
            SELECT vec_id, round(sum((x - mu) * w1), 4) + 0e0 AS a1, round(sum((x - mu) * w2), 4) + 0e0 AS a2
            FROM e JOIN m USING (i) JOIN a USING (i) GROUP BY vec_id""",
        "covariance": """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT AS i,
              unnest(embedding)::DOUBLE AS x FROM embeddings),
            m AS (SELECT i, avg(x) AS mu FROM e GROUP BY i), z AS (SELECT vec_id, i, x - mu AS x FROM e JOIN m USING (i))
            SELECT a.i, b.i AS j, round(sum(a.x * b.x) / (count(*) - 1), 6) + 0e0 AS cov
            FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
        "group_variance": f"""WITH {QPOINTS}, e AS (SELECT {slug('quadrant')} AS quadrant_slug, vec_id,
              generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM qp),
            v AS (SELECT quadrant_slug, i, count(*) AS n, var_samp(x) AS v FROM e GROUP BY ALL)
            SELECT quadrant_slug, max(n) AS n, round(sum(v), 6) AS total_variance FROM v GROUP BY quadrant_slug""",
        "kmeans_assign": f"WITH {CENTRES} SELECT vec_id, cluster FROM assigned",
        "cluster_sizes": f"WITH {CENTRES} SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster",
        "axis_extremes": f"WITH {EXTREMES} SELECT * FROM ext",
        "intruder_rounds": f"""WITH {ROUNDS} SELECT axis_id, round, shown,
            (max(seat) FILTER (pole <> shown))::INT AS correct, string_agg(vec_id::VARCHAR, ',' ORDER BY seat) AS ids,
            string_agg(text, '|' ORDER BY seat) AS texts FROM seated GROUP BY axis_id, round, shown HAVING count(*) = 4""",
        "graded_answers": f"""WITH {ANSWERS} SELECT event_id, responder, axis, condition, answer, correct, is_correct
            FROM g""",
        "accuracy": f"""WITH {ACCURACY} SELECT responder, condition, axis, n_answers, round(accuracy, 4) AS accuracy,
            {BAND.format('accuracy')} AS band FROM acc""",
        "accuracy_pivot": f"WITH {ACCURACY} SELECT responder, condition, "
        + ", ".join(f'round(max(accuracy) FILTER (axis = {q(c)}), 4) AS "{c}"' for c in (*P.AXES, "overall"))
        + " FROM acc GROUP BY responder, condition",
        "label_boost": f"""WITH {ANSWERS}, b AS (SELECT responder,
              avg(hit) FILTER (condition = 'with_labels') * 100e0 AS w, avg(hit) FILTER (condition = 'no_labels') * 100e0 AS n
              FROM g GROUP BY responder)
            SELECT responder, round(w, 4) AS with_labels, round(n, 4) AS no_labels, round(w - n, 1) + 0e0 AS boost FROM b""",
        "vs_human": f"""WITH {ANSWERS}, x AS (SELECT responder, condition, axis, avg(hit) * 100e0 AS accuracy FROM g
              GROUP BY responder, condition, axis),
            d AS (SELECT m.responder, m.condition, m.axis, m.accuracy, h.accuracy AS human, round(m.accuracy - h.accuracy, 0) + 0e0 AS diff
              FROM x m LEFT JOIN x h ON h.axis = m.axis AND h.condition = m.condition AND h.responder = {q(P.HUMAN)}
              WHERE m.responder <> {q(P.HUMAN)})
            SELECT condition, axis, responder, round(accuracy, 4) AS accuracy, round(human, 4) AS human_accuracy, diff,
            diff > 0 AS beats_human FROM d""",
        "published_accuracy": f"""WITH {ACCURACY} SELECT responder, condition, axis, round(accuracy, 4) AS percent,
            CASE WHEN responder = {q(P.HUMAN)} THEN 'human' ELSE 'model' END AS responder_type FROM acc""",
        "panel_accuracy": f"""WITH {ANSWERS}, r AS (SELECT avg(hit) AS share, count(*) AS n FROM g GROUP BY axis, correct)
            SELECT count(*) AS n_rounds, sum(n)::BIGINT AS n_answers, round(avg(share) * 100e0, 0) AS panel_percent FROM r""",
        "responder_scores": f"""WITH {ANSWERS}, r AS (SELECT responder, count(*) FILTER (is_correct) AS score,
              count(*) AS n_answers, round(avg(hit) * 100e0, 0) AS percent FROM g GROUP BY responder)
            SELECT *, CASE WHEN percent = 100 THEN 'perfect' ELSE {BAND.format('percent')} END AS band FROM r""",
        "scatter_bins": f"""WITH {POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
            SELECT {bin_of('x', 'x0', 'x1')} AS bin_x, {bin_of('y', 'y0', 'y1')} AS bin_y, label, count(*) AS n
            FROM p, b GROUP BY ALL""",
        "scatter_sample": f"""WITH {QPOINTS}, s AS (SELECT *, {slug('quadrant')} AS quadrant_slug FROM qp),
            r AS (SELECT *, row_number() OVER (PARTITION BY quadrant_slug
              ORDER BY md5('{P.SAMPLE_SEED}:' || vec_id), vec_id)::INT AS rank FROM s)
            SELECT vec_id, quadrant_slug, rank, x, y, {colour('quadrant_slug')} AS colour FROM r
            WHERE rank <= {P.PER_LABEL}""",
    }
    for name in ("symbol_counts", "symbol_match"):
        sql[f"{name}_joined"] = sql[name]
    sql["symbol_hits_joined"] = sql["symbol_hits"]
    return sql
