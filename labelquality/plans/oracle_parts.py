"""SQL fragments (DuckDB) that the oracles share. Written independently of the Spark expressions."""

WS = r"\t\n\x0b\x0c\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

LABELLED = """labelled AS (
  SELECT d.doc_id AS id, d.text, l.toxic AS gold, l.quality, d.lang, d.source, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

RAW = LABELLED + """,
raw AS (
  SELECT * EXCLUDE (p, f, c, lab, j),
   CASE WHEN f<=4 THEN concat('<json>', j, '</json>')
        WHEN f=5  THEN j
        WHEN f=6  THEN concat('```json', chr(10), j, chr(10), '```')
        WHEN f=7  THEN concat('Sure! ', j, ' Hope this helps')
        WHEN f=8  THEN concat('{"label": "', lab, '"}')
        WHEN f=9  THEN concat('{"label": "', lab, '", "confidence": "certain"}')
        WHEN f=10 THEN concat('{"label": "', lab, '", "conf')
        ELSE concat('assistant', chr(10), '{"label": "',
                    CASE WHEN p=1 THEN 'TOXIC' ELSE 'Not Toxic' END, '", "confidence": "', c, '"}')
   END AS raw_text
  FROM (SELECT *, concat('{"label": "', lab, '", "confidence": "', c, '"}') AS j
        FROM (SELECT *, CASE WHEN p=1 THEN 'toxic' ELSE 'non-toxic' END AS lab
              FROM (SELECT *,
                     CASE WHEN (id*7919+13) % 10 < 2 THEN 1-gold ELSE gold END AS p,
                     (id*31+7) % 12 AS f,
                     CASE WHEN (id*17+3) % 7 < 2 THEN 'low'
                          WHEN (id*17+3) % 7 < 4 THEN 'medium' ELSE 'high' END AS c
                    FROM labelled) a) b) q)"""


def parsed(mode: str = "single", source: str = RAW) -> str:
    """CTEs ending in ``ann``: the annotation table of the labelled documents, by string functions."""
    first_line = "trim(string_split(a, chr(10))[1], ws)" if mode == "batch" else "a"
    return source + rf""",
clean AS (
  SELECT *, {first_line} AS r FROM (
    SELECT *, trim(string_split(raw_text, 'assistant')[-1], ws) AS a
    FROM raw, (SELECT concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ') AS ws) w) s),
fence AS (
  SELECT *,
   CASE WHEN contains(r, '<json>') AND contains(r, '</json>')
        THEN trim(regexp_extract(r, '(?s)^.*<json>(.*)</json>', 1), ws) ELSE '' END AS tagged,
   CASE WHEN contains(r, '```json') OR starts_with(r, '```')
        THEN regexp_extract(r, '(?s)```[^\n]*\n(.*?)(\n```|$)', 1) ELSE '' END AS fenced
  FROM clean),
slices AS (
  SELECT *, regexp_extract(rest, '(?s)(\{{[^{{]*\}})[^{{}}]*$', 1) AS narrow, regexp_extract(rest, '(?s)\{{.*\}}') AS wide
  FROM (SELECT *, CASE WHEN fenced <> '' THEN fenced ELSE r END AS rest FROM fence) x),
found AS (
  SELECT *,
   CASE WHEN tagged <> '' THEN tagged WHEN narrow NOT IN ('', '{{}}') THEN narrow
        WHEN wide NOT IN ('', '{{}}') THEN wide ELSE rest END AS js,
   CASE WHEN tagged <> '' THEN ''
        WHEN narrow NOT IN ('', '{{}}') THEN CASE WHEN length(narrow) < length(rest) OR fenced <> ''
             THEN 'parse_error_recoverable' ELSE '' END
        WHEN wide NOT IN ('', '{{}}') THEN 'parse_error_recoverable' ELSE 'parse_error' END AS how
  FROM slices),
fields AS (
  SELECT *, CASE lab WHEN 'nei' THEN 'not_enough_info' WHEN 'non_toxic' THEN 'non-toxic'
             WHEN 'nontoxic' THEN 'non-toxic' WHEN 'not_toxic' THEN 'non-toxic' ELSE lab END AS name
  FROM (SELECT *, json_valid(js) AS okjson,
         replace(lower(trim(CASE WHEN json_valid(js) THEN json_extract_string(js, '$.label') END, ws)), ' ', '_') AS lab,
         CASE WHEN json_valid(js) THEN json_extract_string(js, '$.confidence') END AS grade FROM found) y),
checked AS (
  SELECT *,
   CASE WHEN NOT okjson THEN CASE WHEN how = '' THEN 'parse_error' ELSE how END
        WHEN name IS NULL OR grade IS NULL THEN 'schema_violation'
        WHEN grade NOT IN ('low', 'medium', 'high') THEN 'schema_violation'
        WHEN name NOT IN ('toxic', 'non-toxic') THEN 'schema_violation' END AS bad,
   CASE WHEN NOT okjson THEN 'JSON parse error'
        WHEN name IS NULL THEN 'Missing required field: label'
        WHEN grade IS NULL THEN 'Missing required field: confidence'
        WHEN grade NOT IN ('low', 'medium', 'high') THEN 'Invalid confidence: ' || grade
        WHEN name NOT IN ('toxic', 'non-toxic') THEN 'Invalid label ''' || name || '''' ELSE '' END AS message
  FROM fields),
ann AS (
  SELECT id AS row_id, text, lang, source, n_chars, quality,
   gold AS gold_label, CASE gold WHEN 0 THEN 'non-toxic' WHEN 1 THEN 'toxic' END AS gold_label_str,
   CASE WHEN bad IS NULL THEN CASE name WHEN 'non-toxic' THEN 0 WHEN 'toxic' THEN 1 ELSE -1 END END AS llm_label,
   CASE WHEN bad IS NULL THEN name END AS llm_label_str,
   CASE WHEN bad IS NULL THEN grade ELSE 'low' END AS llm_confidence,
   CASE WHEN bad IS NULL THEN CASE grade WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END END
     AS llm_confidence_numeric,
   r AS raw_response, bad IS NULL AS is_valid, message AS error, coalesce(bad, how) AS error_type
  FROM checked)"""


# Two-class predictions of the labelled documents; needs LABELLED.
SUPERVISED = """zs AS (SELECT id, gold, ((n_chars % 41) - 20) / 8.0::DOUBLE AS z FROM labelled),
two AS (SELECT *, exp(-greatest(z, 0)) AS e0, exp(z - greatest(z, 0)) AS e1 FROM zs),
sup AS (SELECT id AS example_id, gold AS gold_label, z, e0/(e0+e1) AS p0, e1/(e0+e1) AS p1,
   CASE WHEN z > 0 THEN 1 ELSE 0 END AS predicted_label,
   greatest(e0, e1)/(e0+e1) AS max_prob,
   -(greatest(e0/(e0+e1), 1e-12)*ln(greatest(e0/(e0+e1), 1e-12)) + greatest(e1/(e0+e1), 1e-12)*ln(greatest(e1/(e0+e1), 1e-12))) AS entropy
  FROM two)"""

# Cells of 64 classes (id, gold, c, z, p), long form, and per-row predictions.
def classes(temperature: float = 0.05) -> str:
    return f"""cell AS (
  SELECT vec_id AS id, label AS gold, u.c - 1 AS c, embedding[u.c]::DOUBLE AS z
  FROM embeddings, (SELECT unnest(range(1, 65)) AS c) u),
powers AS (SELECT *, exp((z - max(z) OVER (PARTITION BY id)) / {temperature}::DOUBLE) AS e FROM cell),
prob AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p, 1 / (1 + exp(-z / {temperature}::DOUBLE)) AS s FROM powers),
pred AS (
  SELECT id AS example_id, any_value(gold) AS gold_label, min(c) FILTER (WHERE p = top) AS predicted_label,
   -sum(greatest(p, 1e-12) * ln(greatest(p, 1e-12))) AS entropy, max(p) AS max_prob, sum(p) AS total,
   sum((p - (c = gold)::INT) ** 2) / 64 AS sq
  FROM (SELECT *, max(p) OVER (PARTITION BY id) AS top FROM prob) t GROUP BY id)"""


SCORES = """bs AS (
  SELECT (l_quantity - 0.5::DOUBLE) / 50.0::DOUBLE AS p, (l_returnflag = 'R')::INT AS y, l_linestatus AS grp FROM lineitem)"""

PRICES = """ps AS (
  SELECT l_extendedprice / 120000.0::DOUBLE AS score, (l_returnflag = 'R')::INT AS y FROM lineitem),
g AS (SELECT score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM ps GROUP BY score),
cum AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT score, pos, neg, tp, fp, np, nn, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / np AS rec FROM cum)"""

CODERS = """coders AS (
  SELECT event_id AS id, event_type AS a, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS b, user_id FROM events)"""


def class_table(cells: str, by: str = "") -> str:
    """CTEs from ``cells`` (gold, pred, n): per-class counts ``cls`` and scores ``sc``."""
    g = f"{by}, " if by else ""
    return f"""cls AS (
  SELECT {g}label, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM (
    SELECT {g}gold AS label, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM {cells}
    UNION ALL SELECT {g}pred, 0, 0, n FROM {cells}) u GROUP BY {g}label),
sc AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS pr,
   CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS rc,
   CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END::DOUBLE AS f1 FROM cls)"""


def edges(bins: int) -> str:
    """Rows (b, lo, hi) of the bin limits, as i * (1/n)."""
    return f"""eb AS (
  SELECT i AS b, (i - 1) * (1.0::DOUBLE / {bins}) AS lo, CASE WHEN i = {bins} THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / {bins}) END AS hi
  FROM (SELECT unnest(range(1, {bins + 1})) AS i) r)"""


# ROC area of ps (score, y) in Mann-Whitney form: mean rank of the positives.
RANK_AUC = """auc AS (SELECT (sum(mid) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE)
   / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)) AS a
   FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM ps) r)"""


def bundle_rows(cells: str, group_cells: str) -> str:
    """Rows (section, group, metric, value) of classification, agreement and fairness for labels 0 and 1.

    ``cells`` has (gold, pred, n) and ``group_cells`` (grp, gold, pred, n). For two classes the linear weights leave the
    plain agreement.
    """
    def scores(source: str, by: str) -> str:
        g, on = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
        return f"""SELECT {g}sum(tp)::DOUBLE / sum(support) AS accuracy, sum(pr * support) / sum(support) AS "precision", sum(rc * support) / sum(support) AS recall,
          sum(f1 * support) / sum(support) AS f1_score, sum(support)::DOUBLE AS sample_size, 1 - sum(tp)::DOUBLE / sum(support) AS error_rate,
          sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe,
          1 - sum((support + predicted) * (support + predicted - 1.0::DOUBLE)) / (2.0::DOUBLE * sum(support) * (2.0::DOUBLE * sum(support) - 1)) AS de FROM {source} {on}"""

    def per(name: str, source: str, by: str) -> str:
        g = f"{by}, " if by else ""
        on = f" AND a.{by} IS NOT DISTINCT FROM b.{by}" if by else ""
        key = f"a.{by}, " if by else ""
        return f"""{name} AS (SELECT {g}label, tp, support, predicted, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS pr,
          CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS rc, 2.0::DOUBLE * tp / (support + predicted) AS f1 FROM (
          SELECT {key}a.l AS label, sum(CASE WHEN gold = l AND pred = l THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN gold = l THEN n ELSE 0 END)::BIGINT AS support,
            sum(CASE WHEN pred = l THEN n ELSE 0 END)::BIGINT AS predicted
          FROM (SELECT DISTINCT {g}unnest([gold, pred]) AS l FROM {source}) a JOIN {source} b ON true{on} GROUP BY ALL) q)"""

    def rows(section: str, group: str, table: str, pairs: dict[str, str]) -> str:
        return " UNION ALL ".join(f"SELECT '{section}' AS section, {group} AS \"group\", '{m}' AS metric, round(({e})::DOUBLE, 6) AS value FROM {table}" for m, e in pairs.items())

    plain = {m: f'"{m}"' for m in ("accuracy", "precision", "recall", "f1_score")}
    agree = {"accuracy": "accuracy", "cohen_kappa": "(accuracy - pe) / (1 - pe)", "krippendorff_alpha": "1 - (1 - accuracy) / de", "percentage_agreement": "accuracy", "weighted_agreement": "accuracy"}
    fair = {**plain, "sample_size": "sample_size", "error_rate": "error_rate"}
    ctes = ", ".join([per("all_cls", cells, ""), per("grp_cls", group_cells, "grp"), f"all_sc AS ({scores('all_cls', '')})", f"grp_sc AS ({scores('grp_cls', 'grp')})"])
    body = " UNION ALL ".join([rows("classification", "'all'", "all_sc", plain), rows("agreement", "'all'", "all_sc", agree), rows("fairness", "grp", "grp_sc", fair)])
    return f"{ctes}, bundle AS ({body})"
