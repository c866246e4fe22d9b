"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from lexifold.checks.spark_queries import STOPWORDS

_PUNCTUATION = r"[!-@\[-`{-~]"
_WORD = r"[^ \t\n\x0B\f\r]+"


def _clean(column: str = "text") -> str:
    return f"lower(regexp_replace({column}, '{_PUNCTUATION}', ' ', 'g'))"


def _words(expression: str) -> str:
    return f"regexp_extract_all({expression}, '{_WORD}')"


_TOK = f"tok AS (SELECT doc_id, lang, unnest({_words(_clean())}) AS token FROM documents)"
_TF = f"{_TOK}, tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL)"
_DF = f"{_TF}, df AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY token)"
_HELD = f"""held AS (SELECT item_id AS doc_id, token, count(*) AS tf
  FROM (SELECT item_id, unnest({_words(_clean())}) AS token FROM benchmark) GROUP BY ALL)"""
_N = "(SELECT count(*) FROM documents)"


def _weight(tf: str, df: str, n: str) -> str:
    return f"round((1 + log10({tf})) * log10({n} / {df}), 6)"


def _byte_path(first: int) -> str:
    return f"lpad(bin(('0x' || substr(md5(token), {first}, 2))::INT), 8, '0')"


def _prefixes(cutoff: int) -> str:
    return f"""{_DF}, paths AS (SELECT token AS word, {_byte_path(1)} AS path FROM df),
  bridge AS (SELECT DISTINCT word, substr(path, 1, i) AS prefix
    FROM (SELECT word, path, unnest(generate_series({cutoff + 1}, 8)) AS i FROM paths))"""


def _cluster_counts(cutoff: int) -> str:
    return f"""{_prefixes(cutoff)}, cc AS (SELECT doc_id, prefix, sum(tf)::BIGINT AS n
    FROM tf JOIN bridge ON token = word GROUP BY ALL)"""


_LANGUAGE = "CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END::DOUBLE"


def _proof(label: str, source: str) -> str:
    return f"SELECT {label} AS label, count(*) AS n, true AS beats_majority, true AS converged FROM {source} GROUP BY ALL"


def _stages(label: str, source: str, k: int) -> str:
    """Rows ``(label, stage, fold)`` of a cross validation: trained, held out, and all held out together."""
    return f"""SELECT label, CASE WHEN fold = f THEN 'validation' ELSE 'train' END AS stage, f::INT AS fold
        FROM (SELECT {label} AS label, {_FOLD} % {k} AS fold FROM {source}), range({k}) AS r(f)
        UNION ALL SELECT {label}, 'cumulative', -1 FROM {source}"""


_FOLD = "(row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1)"

_LANGUAGE = "CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END"

_SENTENCES = rf"""raw AS (SELECT doc_id, string_split(regexp_replace(
      trim(text, E' \t\n\x0b\f\r'), '([.!?]+)[ \t\n\x0B\f\r]+', E'\\1\x01', 'g'), E'\x01') AS parts FROM documents),
  cut AS (SELECT doc_id, unnest(parts) AS part, (unnest(generate_series(1, len(parts))) - 1)::INT AS sentence_no FROM raw),
  sentences AS (SELECT doc_id, sentence_no, array_to_string({_words(_clean('part'))}, ' ') AS sentence FROM cut)"""

_METRICS = """counts AS (SELECT {by} cls AS class,
    sum(n) FILTER (WHERE real = cls AND predicted = cls) AS tp0,
    sum(n) FILTER (WHERE real <> cls AND predicted = cls) AS fp0,
    sum(n) FILTER (WHERE real = cls AND predicted <> cls) AS fn0,
    sum(n) AS total
  FROM (SELECT {by} real, predicted, count(*) AS n FROM pairs GROUP BY ALL) JOIN (
    SELECT DISTINCT {by} unnest([real, predicted]) AS cls FROM pairs) {using} GROUP BY ALL),
  whole AS (SELECT {by} class, coalesce(tp0, 0)::BIGINT AS tp, coalesce(fp0, 0)::BIGINT AS fp,
    coalesce(fn0, 0)::BIGINT AS fn,
    (total - coalesce(tp0, 0) - coalesce(fp0, 0) - coalesce(fn0, 0))::BIGINT AS tn FROM counts),
  ratios AS (SELECT *,
    CASE WHEN tp + fp = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fp) END AS p,
    CASE WHEN tp + fn = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fn) END AS r,
    CASE WHEN tn + fp = 0 THEN 'nan'::DOUBLE ELSE tn / (tn + fp) END AS s FROM whole)"""

_CLASS_COLUMNS = """class, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r = 0 THEN 'nan'::DOUBLE ELSE 2 * p * r / (p + r) END, 6) AS f1,
  round(s, 6) AS specificity, round(r, 6) AS sensitivity, round((s + r) / 2, 6) AS balanced_accuracy"""

_OVERALL = """SELECT {by} n, round(100.0 * ok / n, 6) AS accuracy, round(mp, 6) AS macro_precision,
  round(mr, 6) AS macro_recall,
  round(CASE WHEN mp + mr = 0 THEN 'nan'::DOUBLE ELSE 2 * mp * mr / (mp + mr) END, 6) AS macro_f1
  FROM (SELECT {by} sum(tp + fn)::BIGINT AS n, sum(tp)::BIGINT AS ok, avg(p) AS mp, avg(r) AS mr
    FROM ratios GROUP BY ALL)"""

_PAIRS = "pairs AS (SELECT quality::DOUBLE AS real, toxic::DOUBLE AS predicted FROM labels)"
_LABEL_METRICS = f"{_PAIRS}, {_METRICS.format(by='', using='ON true')}"

_VECTORS = """vec AS (SELECT d.doc_id, unnest(generate_series(1, 64)) AS position,
    unnest(coalesce(embedding::DOUBLE[], list_resize([]::DOUBLE[], 64, 0.0))) AS value
  FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id)"""

_CONTRACTED = _clean()
for _word, _contraction in (("the", "cannot"), ("la", "gimme"), ("of", "wanna"), ("der", "gotta")):
    _CONTRACTED = f"replace({_CONTRACTED}, ' {_word} ', ' {_contraction} ')"

_STOPLIST = ", ".join(f"'{word}'" for word in STOPWORDS)

_BOW_FEATURES = "SELECT doc_id, 'bow' AS family, token AS feature, {value} AS value FROM tf JOIN df USING (token)"
_BROWN_FEATURES = "SELECT doc_id, 'brown' AS family, prefix AS feature, {value} AS value FROM cc"

_ABBREVIATIONS = r"""raw AS (SELECT [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') IF x <> ''] AS ts FROM documents),
    words AS (SELECT unnest(ts) AS token FROM raw),
    counts AS (SELECT lower(regexp_replace(token, '\.$', '')) AS word, count(*) AS n,
        sum(CASE WHEN token LIKE '%.' THEN 1 ELSE 0 END)::BIGINT AS n_period
        FROM words WHERE regexp_matches(token, '\p{L}') GROUP BY 1),
    total AS (SELECT sum(n)::DOUBLE AS n, sum(n_period) / sum(n)::DOUBLE AS share FROM counts),
    measured AS (SELECT word, counts.n, n_period, length(replace(word, '.', '')) AS letters,
        2.0 * (n_period * ln(0.99::DOUBLE) + (counts.n - n_period) * ln(1 - 0.99::DOUBLE) - n_period * ln(share) - (counts.n - n_period) * ln(1 - share)) AS ll
        FROM counts, total WHERE n_period > 0),
    scores AS (SELECT word, n, n_period, ll * exp(-letters) * (length(word) - letters + 1) * pow(letters::DOUBLE, -(n - n_period)::DOUBLE) AS score FROM measured)"""

ORACLE: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean()} AS cleaned FROM documents",
    "tokenize": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {_words(_clean())} AS t FROM documents)""",
    "contraction_split": f"""WITH w AS (SELECT doc_id, {_words(_CONTRACTED)} AS t FROM documents),
        e AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(1, len(t))) AS i FROM w),
        j AS (SELECT doc_id, string_agg(CASE token WHEN 'cannot' THEN 'can not' WHEN 'gimme' THEN 'gim me'
            WHEN 'gonna' THEN 'gon na' WHEN 'gotta' THEN 'got ta' WHEN 'lemme' THEN 'lem me'
            WHEN 'wanna' THEN 'wan na' ELSE token END, ' ' ORDER BY i) AS tokens FROM e GROUP BY doc_id)
        SELECT doc_id, coalesce(tokens, '') AS tokens FROM w LEFT JOIN j USING (doc_id)""",
    "stopword_removal": f"""WITH w AS (SELECT doc_id, {_words(_clean())} AS t FROM documents),
        e AS (SELECT doc_id, unnest(t) AS token, unnest(generate_series(1, len(t))) AS i FROM w),
        j AS (SELECT doc_id, count(*) AS n, string_agg(token, ' ' ORDER BY i) AS tokens FROM e
            WHERE lower(token) NOT IN ({_STOPLIST}) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(tokens, '') AS tokens
        FROM w LEFT JOIN j USING (doc_id)""",
    "sentence_corpus": f"WITH {_SENTENCES} SELECT doc_id, sentence_no, sentence FROM sentences",
    "abbreviations": f"WITH {_ABBREVIATIONS} SELECT word, n, n_period, round(score, 4) AS score, score >= 0.3 AS abbreviation FROM scores",
    "sentence_starters": rf"""WITH {_ABBREVIATIONS},
        neighbours AS (SELECT unnest(ts) AS l, unnest(list_append(ts[2:], NULL)) AS r FROM raw),
        ends AS (SELECT lower(regexp_replace(l, '\.$', '')) AS l, lower(regexp_replace(r, '\.$', '')) AS word FROM neighbours
          WHERE l LIKE '%.' AND regexp_matches(l, '\p{{L}}') AND regexp_matches(r, '\p{{L}}')),
        behind AS (SELECT word, count(*) AS n_start FROM ends WHERE l NOT IN (SELECT word FROM scores WHERE score >= 0.3) GROUP BY 1),
        cells AS (SELECT word, c.n, n_start, n_start::DOUBLE AS a, b - n_start AS b, c.n - n_start::DOUBLE AS c, t.n - b - (c.n - n_start) AS d, t.n AS t
          FROM behind JOIN counts c USING (word), total t, (SELECT sum(n_start)::DOUBLE AS b FROM behind)),
        ratios AS (SELECT word, n, n_start, a / (a + b) > n / t AS more, 2.0 * (
            a * ln(a / (a + b)) + CASE WHEN b > 0 THEN b * ln(b / (a + b)) ELSE 0 END
            + CASE WHEN c > 0 THEN c * ln(c / (c + d)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / (c + d)) ELSE 0 END
            - (a + c) * ln((a + c) / t) - (b + d) * ln((b + d) / t)) AS ratio FROM cells)
        SELECT word, n, n_start, round(ratio, 4) AS ratio, ratio >= 30 AND more AS starter FROM ratios""",
    "paragraph_terms": f"""WITH {_TF}, j AS (SELECT doc_id, string_agg(token, ' ' ORDER BY token) AS terms
        FROM tf GROUP BY doc_id)
        SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN j USING (doc_id)""",
    "vocabulary": f"WITH {_DF} SELECT token, df, cf FROM df",
    "vocabulary_versions": f"""WITH {_DF}, {_HELD}, late AS (SELECT DISTINCT token FROM held ANTI JOIN df USING (token))
        SELECT token, row_number() OVER (ORDER BY md5(token), token) - 1 AS idx, 1 AS version FROM df
        UNION ALL SELECT token, row_number() OVER (ORDER BY md5(token), token) - 1 + (SELECT count(*) FROM df), 2 FROM late""",
    "ledger_idf": f"""WITH {_TF}, {_HELD},
        own AS (SELECT unnest([1, 2, 3]) AS batch, doc_id, token FROM tf),
        seen AS (SELECT batch, token FROM own JOIN documents USING (doc_id) WHERE batch < 3 OR lang IS DISTINCT FROM 'fr'
          UNION ALL SELECT unnest([2, 3]), token FROM held),
        n AS (SELECT 1 AS batch, {_N} AS n UNION ALL SELECT 2, {_N} + (SELECT count(*) FROM benchmark)
          UNION ALL SELECT 3, (SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM 'fr') + (SELECT count(*) FROM benchmark)),
        df AS (SELECT batch, token AS feature, count(*) AS df FROM seen GROUP BY ALL)
        SELECT batch, feature, df, round(log10(n / df), 6) AS idf FROM df JOIN n USING (batch)""",
    "corpus_stats": f"""WITH {_TF}, {_HELD}
        SELECT 'train' AS part, {_N} AS n_docs, (SELECT count(DISTINCT token) FROM tf) AS n_words
        UNION ALL SELECT 'test', (SELECT count(*) FROM benchmark), (SELECT count(DISTINCT token) FROM held)
        UNION ALL SELECT 'both', {_N} + (SELECT count(*) FROM benchmark),
          (SELECT count(*) FROM (SELECT token FROM tf UNION SELECT token FROM held))""",
    "bow_counts": f"WITH {_TF} SELECT doc_id, 'bow' AS family, token AS feature, tf AS value FROM tf",
    "bow_binary": f"WITH {_TF} SELECT doc_id, 'bow' AS family, token AS feature, 1::BIGINT AS value FROM tf",
    "bow_tfidf": f"""WITH {_DF} SELECT doc_id, token AS feature, tf, df, {_weight('tf', 'df', _N)} AS weight
        FROM tf JOIN df USING (token)""",
    "tfidf_fit_apply": f"""WITH {_DF}, {_HELD}
        SELECT held.doc_id, token AS feature, {_weight('held.tf', 'df', _N)} AS weight
        FROM held JOIN df USING (token)""",
    "tfidf_per_set": f"""WITH {_DF}, {_HELD}, hf AS (SELECT token, count(*) AS df FROM held GROUP BY token)
        SELECT 'train' AS part, doc_id, token AS feature, {_weight('tf', 'df', _N)} AS weight
        FROM tf JOIN df USING (token)
        UNION ALL SELECT 'test', doc_id, token, {_weight('tf', 'df', '(SELECT count(*) FROM benchmark)')}
        FROM held JOIN hf USING (token)""",
    "tfidf_running": f"""WITH {_DF}, {_HELD}, hf AS (SELECT token, count(*) AS df FROM held GROUP BY token),
        rf AS (SELECT token, hf.df + coalesce(df.df, 0) AS df FROM hf LEFT JOIN df USING (token))
        SELECT 'train' AS part, doc_id, token AS feature, {_weight('tf', 'df', _N)} AS weight
        FROM tf JOIN df USING (token)
        UNION ALL SELECT 'test', doc_id, token, {_weight('tf', 'df', '(SELECT count(*) FROM benchmark)')}
        FROM held JOIN rf USING (token)""",
    "train_test_union": "SELECT doc_id, lang, source FROM documents WHERE source <> 'src0' OR lang = 'en' OR source = 'src0'",
    "brown_prefixes": f"WITH {_prefixes(0)} SELECT word, prefix FROM bridge",
    "brown_prefixes_cutoff": f"WITH {_prefixes(2)} SELECT word, prefix FROM bridge",
    "brown_prefixes_two_paths": f"""WITH {_DF},
        paths AS (SELECT token AS word, {_byte_path(1)} AS path FROM df
          UNION ALL SELECT token, substr({_byte_path(3)}, 1, 6) FROM df)
        SELECT DISTINCT word, substr(path, 1, i) AS prefix
        FROM (SELECT word, path, unnest(generate_series(1, length(path))) AS i FROM paths)""",
    "brown_leaves": f"WITH {_prefixes(0)} SELECT word, path AS prefix FROM paths",
    "brown_known_words": f"""WITH {_prefixes(0)}, {_HELD}
        SELECT word, prefix FROM bridge WHERE word IN (SELECT token FROM held)""",
    "brown_partial_counts": f"""WITH {_prefixes(1)}, {_HELD}
        SELECT doc_id, 'brown' AS family, prefix AS feature, sum(tf)::DOUBLE AS value
        FROM tf JOIN bridge ON token = word WHERE token IN (SELECT token FROM held) GROUP BY ALL""",
    "cluster_paths_file": f"WITH {_prefixes(0)} SELECT path, word FROM paths",
    "brown_counts": f"WITH {_cluster_counts(0)} {_BROWN_FEATURES.format(value='n::DOUBLE')}",
    "brown_leaf_counts": f"""WITH {_prefixes(0)} SELECT doc_id, 'brown' AS family, path AS feature,
        sum(tf)::DOUBLE AS value FROM tf JOIN paths ON token = word GROUP BY ALL""",
    "brown_plus_bow": f"""WITH {_cluster_counts(0)} {_BROWN_FEATURES.format(value='n::DOUBLE')}
        UNION ALL {_BOW_FEATURES.format(value='tf::DOUBLE')}""",
    "brown_tfidf": f"""WITH {_cluster_counts(2)}, cf AS (SELECT prefix, count(*) AS df FROM cc GROUP BY prefix)
        SELECT doc_id, 'brown' AS family, prefix AS feature, {_weight('n', 'df', _N)} AS value
        FROM cc JOIN cf USING (prefix)""",
    "brown_plus_bow_tfidf": f"""WITH {_cluster_counts(0)}, cf AS (SELECT prefix, count(*) AS df FROM cc GROUP BY prefix)
        SELECT doc_id, 'brown' AS family, prefix AS feature, {_weight('n', 'df', _N)} AS value
        FROM cc JOIN cf USING (prefix)
        UNION ALL {_BOW_FEATURES.format(value=_weight('tf', 'df', _N))}""",
    "pretrained_vectors": f"WITH {_VECTORS} SELECT doc_id, position::INT AS position, value FROM vec",
    "vectors_roundtrip": """SELECT vec_id AS doc_id, unnest(generate_series(1, len(embedding)))::INT AS position,
        unnest(embedding)::DOUBLE AS value FROM embeddings""",
    "vectors_plus_bow_tfidf": f"""WITH {_DF}, {_VECTORS}
        SELECT doc_id, 'vector' AS family, position::VARCHAR AS feature, round(value, 6) AS value FROM vec
        UNION ALL {_BOW_FEATURES.format(value=_weight('tf', 'df', _N))}""",
    "subsampled_terms": f"""WITH {_DF}, f AS (SELECT token, cf / (SELECT sum(cf) FROM df) AS share FROM df)
        SELECT doc_id, token, tf FROM tf JOIN f USING (token)
        WHERE ('0x' || substr(md5('1234:' || doc_id || ':' || token), 1, 8))::BIGINT / 4294967296.0::DOUBLE
          < (sqrt(share / 0.001) + 1) * 0.001 / share""",
    "paragraph_vectors": f"SELECT ({_LANGUAGE})::DOUBLE AS label, count(*) AS n, true AS apart FROM documents GROUP BY 1",
    "reload_vectors": "SELECT item_id AS doc_id, true AS same, true AS moved FROM benchmark",
    "subsampled_positions": f"""WITH t AS (SELECT doc_id, {_words(_clean())} AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS position FROM t),
        c AS (SELECT token, count(*) AS cf FROM p GROUP BY 1),
        k AS (SELECT token, (sqrt(share / 0.001) + 1) * 0.001 / share AS keep
          FROM (SELECT token, cf / (SELECT sum(cf) FROM c) AS share FROM c))
        SELECT doc_id, position::INT AS position, token FROM p JOIN k USING (token)
        WHERE ('0x' || substr(md5('1234:' || doc_id || ':' || position), 1, 8))::BIGINT / 4294967296.0::DOUBLE < keep""",
    "labelled_lines": f"""SELECT ({_LANGUAGE}) || 'review' || doc_id AS name, ({_LANGUAGE})::DOUBLE AS label,
        array_to_string({_words(_clean())}, ' ') AS data FROM documents""",
    "labelled_line_terms": f"""WITH {_TOK} SELECT ({_LANGUAGE}) || 'review' || doc_id AS name, token, count(*) AS tf
        FROM tok GROUP BY ALL""",
    "sentence_file": f"WITH {_SENTENCES} SELECT sentence AS value, count(*) AS n FROM sentences GROUP BY ALL",
    "review_json": """SELECT doc_id, json_extract_string(j, '$.reviewText') AS "reviewText"
        FROM (SELECT doc_id, to_json({'reviewText': text}) AS j FROM documents)""",
    "review_file": 'SELECT doc_id, text AS "reviewText" FROM documents',
    "label_quarantine": """WITH raw AS (SELECT doc_id, quality::VARCHAR || CASE WHEN toxic = 1 THEN '?' ELSE '' END AS s
        FROM labels)
        SELECT doc_id, try_cast(s AS DOUBLE) AS label, try_cast(s AS DOUBLE) IS NOT NULL AS usable FROM raw""",
    "instances_roundtrip": f"""WITH {_TF}, {_HELD} SELECT doc_id, token, tf, 'train' AS part FROM tf
        UNION ALL SELECT doc_id, token, tf, 'test' FROM held""",
    "problem_roundtrip": f"""WITH {_TOK} SELECT doc_id, ({_LANGUAGE})::DOUBLE AS label, 'bow' AS family,
        token AS feature, count(*) AS value FROM tok GROUP BY ALL""",
    "libsvm_roundtrip": f"""WITH {_DF}, ix AS (SELECT token,
          row_number() OVER (ORDER BY md5('bow:' || token), token) - 1 AS idx FROM df)
        SELECT doc_id, idx, 1.0::DOUBLE AS value FROM tf JOIN ix USING (token)""",
    "predictions_file": f"WITH {_LABEL_METRICS} {_OVERALL.format(by='')}",
    "predictions_log": """SELECT doc_id, quality::DOUBLE AS real, toxic::DOUBLE AS predicted,
        'predictions' AS stage, run_id, c FROM labels,
        (VALUES ('first', 0.1::DOUBLE), ('second', 1.0::DOUBLE)) AS runs(run_id, c)""",
    "result_log": """SELECT doc_id, quality::DOUBLE AS real, toxic::DOUBLE AS predicted, run_id, c FROM labels,
        (VALUES ('first', 0.1::DOUBLE), ('second', 1.0::DOUBLE)) AS runs(run_id, c)""",
    "feature_choices": f"""WITH {_prefixes(0)}, {_VECTORS},
        cl AS (SELECT doc_id, path, sum(tf)::BIGINT AS n FROM tf JOIN paths ON token = word GROUP BY ALL),
        cf AS (SELECT path, count(*) AS df FROM cl GROUP BY path),
        f AS (SELECT doc_id, 'bow' AS family, tf::DOUBLE AS v, 'bow' AS choice FROM tf
          UNION ALL SELECT doc_id, 'bow', {_weight('tf', 'df', _N)}, unnest(['bow, weights', 'leaves, words, weights'])
          FROM tf JOIN df USING (token)
          UNION ALL SELECT doc_id, 'brown', {_weight('n', 'df', _N)}, 'leaves, words, weights' FROM cl JOIN cf USING (path)
          UNION ALL SELECT doc_id, 'vector', round(value, 6), 'vectors' FROM vec)
        SELECT doc_id, family, choice, count(*) AS n, round(sum(v::DECIMAL(28, 6)), 3)::DOUBLE AS total FROM f GROUP BY ALL""",
    "metrics_log": f"""WITH {_LABEL_METRICS} SELECT {_CLASS_COLUMNS}, 'run' AS run_id, 0.1::DOUBLE AS c, stage
        FROM ratios, (SELECT unnest(['first', 'second']) AS stage)""",
    "confusion_matrix": f"WITH {_PAIRS} SELECT predicted, real, count(*) AS n FROM pairs GROUP BY ALL",
    "confusion_grid": f"""WITH {_PAIRS} SELECT predicted, count(*) FILTER (WHERE real = 0) AS real_0,
        count(*) FILTER (WHERE real = 1) AS real_1 FROM pairs GROUP BY predicted""",
    "class_list": f"WITH {_PAIRS} SELECT real AS class FROM pairs UNION SELECT predicted FROM pairs",
    "class_metrics": f"WITH {_LABEL_METRICS} SELECT {_CLASS_COLUMNS} FROM ratios",
    "overall_metrics": f"WITH {_LABEL_METRICS} {_OVERALL.format(by='')}",
    "metrics_by_source": f"""WITH pairs AS (SELECT source, quality::DOUBLE AS real, toxic::DOUBLE AS predicted
        FROM labels JOIN documents USING (doc_id)),
        {_METRICS.format(by='source, ', using='USING (source)')} {_OVERALL.format(by='source, ')}""",
    "cv_folds": f"SELECT doc_id, ({_FOLD} % 10)::INT AS fold FROM documents",
    "cv_folds_equal": f"""WITH p AS (SELECT doc_id, {_FOLD} AS position FROM documents)
        SELECT doc_id, position, (position % 7)::INT AS fold FROM p WHERE position < {_N} - {_N} % 7""",
    "fold_filter": f"""WITH p AS (SELECT lang, {_FOLD} % 10 AS fold FROM documents)
        SELECT CASE WHEN fold = 3 THEN 'validation' ELSE 'train' END AS stage, lang, count(*) AS n
        FROM p GROUP BY ALL""",
    "running_number": """SELECT doc_id, 'en_' || (row_number() OVER (ORDER BY doc_id) - 1) AS name FROM documents""",
    "svm_binary": _proof("quality::DOUBLE", "labels JOIN documents USING (doc_id)"),
    "svm_one_vs_one": _proof(_LANGUAGE, "documents"),
    "svm_one_vs_rest": _proof(_LANGUAGE, "documents"),
    "model_reload_predict": "SELECT item_id AS doc_id, true AS same FROM benchmark",
    "cross_validation": f"""SELECT stage, fold, label, count(*) AS n, true AS beats_majority
        FROM ({_stages("(lang = 'en')::INT::DOUBLE", "documents", 10)}) GROUP BY ALL""",
    "cross_validation_refit": f"""SELECT stage, fold, label, count(*) AS n
        FROM ({_stages("quality::DOUBLE", "labels JOIN documents USING (doc_id)", 2)}) GROUP BY ALL""",
    "svm_certificate": f"""WITH l AS (SELECT ({_LANGUAGE})::DOUBLE AS label, count(*) AS n FROM documents GROUP BY 1)
        SELECT a.label AS negative, b.label AS positive, a.n + b.n AS n, true AS same, true AS within
        FROM l a JOIN l b ON a.label < b.label""",
    "tune_c_grid": f"""SELECT c, stage, fold, label, count(*) AS n, true AS beats_majority, true AS converged
        FROM ({_stages("(lang = 'en')::INT::DOUBLE", "documents", 10)}),
          (SELECT 0.1::DOUBLE * 10.0::DOUBLE ** unnest([-1, 0, 1, 2, 3]) AS c) GROUP BY ALL""",
    "tune_random": f"""SELECT trial, stage, fold, count(*) AS n
        FROM ({_stages("1", "labels JOIN documents USING (doc_id)", 2)}), (SELECT unnest([1, 2]) AS trial) GROUP BY ALL""",
    "doc_vectors": "SELECT doc_id, 16::BIGINT AS n_components, true AS finite FROM documents",
    "feature_index": f"""WITH {_DF} SELECT 'bow' AS family, token AS feature, df,
        row_number() OVER (ORDER BY md5('bow:' || token), token) - 1 AS idx FROM df""",
}
