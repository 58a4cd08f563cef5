"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Only the raw driver tables are registered in DuckDB, so each statement
carries the fixture views and the pipeline stages it needs as CTEs.  Every
double is rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

from sigwin import schemas as S

R = 6  # rounding digits of compared doubles

FEATS = S.FEATURES
BASE = S.SITE_FEATURES


def dq(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sround(expr: str) -> str:
    """Engine-neutral 6-place rounding: through DECIMAL(38,12), half up."""
    return f"coalesce(CAST(round(TRY_CAST({expr} AS DECIMAL(38,12)), {R}) AS DOUBLE), {expr})"


def rnd(expr: str, alias: str | None = None) -> str:
    return f"{sround(expr)} AS {dq(alias) if alias else expr}"


KEY = "nullif(regexp_extract({c}, '^ENST[0-9]+[.][0-9]+', 0), '')"


def key(col: str = "contig") -> str:
    return KEY.format(c=col)


EA = """ea AS MATERIALIZED (
  SELECT concat('ENST', lpad(CAST(cid AS VARCHAR), 11, '0'), '.1|', event_type) AS contig,
         CAST(user_id + user_id // 40 AS BIGINT) AS position,
         substr(repeat('GGACTAGACATTGACCA', 2), CAST(1 + (cid + user_id) % 17 AS INTEGER), 5) AS reference_kmer,
         CAST(value AS DOUBLE) AS event_level_mean,
         value / (1 + event_id % 7) AS event_stdv,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE (event_id % 1000) / CAST(100000.0 AS DOUBLE) END AS event_length,
         CASE WHEN event_id % 97 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) + event_id % 5 END AS model_stdv,
         (value - CAST(50.0 AS DOUBLE)) / CAST(49.0 AS DOUBLE) AS standardized_level,
         CAST(event_id AS BIGINT) AS ord
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                                  WHEN 'signup' THEN 4 ELSE 5 END AS cid FROM events) e)"""

CLIP = S.CLIPPED_COLUMNS
SHORT = {c: f"c{i}" for i, c in enumerate(CLIP)}


def _g() -> str:
    parts = ["count(*) AS _n"]
    for c, s in SHORT.items():
        parts += [f"count({c}) AS nn_{s}", f"median({c}) AS med_{s}", f"stddev_pop({c}) AS sd_{s}"]
    parts.append("arg_min_null(model_stdv, ord) AS model_stdv")
    return ("g AS MATERIALIZED (SELECT contig, position, " + ", ".join(parts)
            + " FROM ea WHERE contig IS NOT NULL AND position IS NOT NULL GROUP BY contig, position)")


KM = """km AS (SELECT contig, position, reference_kmer FROM (
    SELECT contig, position, reference_kmer,
           row_number() OVER (PARTITION BY contig, position ORDER BY count(*) DESC, reference_kmer) AS rn
    FROM ea WHERE reference_kmer IS NOT NULL AND contig IS NOT NULL AND position IS NOT NULL
    GROUP BY contig, position, reference_kmer) t WHERE rn = 1)"""


def _cl() -> str:
    parts = []
    for c, s in SHORT.items():
        cond = f"abs(e.{c} - g.med_{s}) <= 3 * g.sd_{s}"
        parts += [f"sum(CASE WHEN {cond} THEN e.{c} END) AS cs_{s}",
                  f"count(CASE WHEN {cond} THEN e.{c} END) AS cc_{s}"]
    return ("cl AS (SELECT e.contig, e.position, " + ", ".join(parts)
            + " FROM ea e JOIN g ON e.contig = g.contig AND e.position = g.position"
              " GROUP BY e.contig, e.position)")


def clip_expr(c: str) -> str:
    s = SHORT[c]
    return (f"CASE WHEN _n = 1 THEN med_{s} WHEN nn_{s} < _n THEN NULL "
            f"WHEN sd_{s} IS NULL OR isnan(sd_{s}) OR sd_{s} = 0 THEN med_{s} "
            f"WHEN cc_{s} > 0 THEN CAST(cs_{s} AS DOUBLE) / cc_{s} ELSE med_{s} END")


def _sites() -> str:
    clipped = ", ".join(f"{clip_expr(c)} AS {c}" for c in CLIP)
    return f"""sites AS MATERIALIZED (
  SELECT g.contig, g.position, km.reference_kmer, {clipped},
         med_c0 AS event_level_median, med_c1 AS event_stdv_median, med_c2 AS event_length_median,
         ({clip_expr('event_stdv')} - model_stdv) / nullif(model_stdv, 0) AS diff_stdv,
         model_stdv
  FROM g LEFT JOIN km ON g.contig = km.contig AND g.position = km.position
         LEFT JOIN cl ON g.contig = cl.contig AND g.position = cl.position)"""


def _win() -> str:
    cols = []
    for o in S.OFFSETS:
        for c in BASE:
            name = S.feature_name(o, c)
            if o < 0:
                cols.append(f"lag({c}, {-o}) OVER w AS {dq(name)}")
            elif o > 0:
                cols.append(f"lead({c}, {o}) OVER w AS {dq(name)}")
            else:
                cols.append(f"{c} AS {dq(name)}")
    return f"""w0 AS (SELECT contig, position, {', '.join(cols)},
         lag(reference_kmer, 2) OVER w AS motif_kmer,
         lag(position, 3) OVER w AS _lp, lead(position, 3) OVER w AS _rp
  FROM sites WINDOW w AS (PARTITION BY contig ORDER BY position)),
win AS MATERIALIZED (SELECT * EXCLUDE (_lp, _rp) FROM w0 WHERE _lp = position - 3 AND _rp = position + 3)"""


FINITE = " AND ".join(f"coalesce(isfinite({dq(f)}), false)" for f in FEATS)
MOTIF = "coalesce(length(motif_kmer) = 5 AND regexp_matches(motif_kmer, '^[AGT][AG]AC[ACT]$'), false)"

SITES_REF = f"""sites_ref AS (SELECT DISTINCT {key()} AS tx, position + 1 AS pos1 FROM ea WHERE position % 3 = 0)"""

PROFILE = f"""pl AS (SELECT {key()} AS tx, position AS pos,
         CASE WHEN position % 13 = 0 THEN 'NULL' WHEN position % 29 = 0 THEN 'nan'
              ELSE printf('%.2f', ((position * 37) % 101) / CAST(100.0 AS DOUBLE)) END AS score
  FROM (SELECT DISTINCT contig, position FROM ea) d WHERE contig NOT LIKE '%view'),
mx AS (SELECT tx, max(pos) AS mp FROM pl GROUP BY tx),
grid AS (SELECT tx, unnest(range(0, mp + 1)) AS pos FROM mx),
prof AS (SELECT g.tx, CAST(g.pos AS BIGINT) AS pos, coalesce(pl.score, 'NULL') AS score
         FROM grid g LEFT JOIN pl ON g.tx = pl.tx AND g.pos = pl.pos)"""

MWIN = f"""mwin AS MATERIALIZED (SELECT * EXCLUDE (motif_kmer) FROM win WHERE {MOTIF} AND {FINITE}),
mlab AS MATERIALIZED (SELECT m.*, CASE WHEN r.tx IS NULL THEN 0 ELSE 1 END AS label
         FROM mwin m LEFT JOIN sites_ref r ON r.tx = {key('m.contig')} AND r.pos1 = m.position + 1)"""

BIN = "CASE WHEN isnan(s) THEN NULL WHEN s <= 0.2 THEN 0 WHEN s >= 0.8 THEN 1 END"
SWIN = f"""fwin AS MATERIALIZED (SELECT * EXCLUDE (motif_kmer) FROM win WHERE {FINITE}),
plook AS (SELECT f.*, p.score FROM fwin f LEFT JOIN prof p ON p.tx = {key('f.contig')} AND p.pos = f.position),
slab AS MATERIALIZED (SELECT * EXCLUDE (score, s), CAST({BIN} AS INTEGER) AS label
         FROM (SELECT *, TRY_CAST(score AS DOUBLE) AS s FROM plook) t WHERE ({BIN}) IS NOT NULL)"""

SCORED = """sd AS (SELECT d.doc_id, CAST(l.quality AS INTEGER) AS label,
         round(d.n_chars / CAST(500.0 AS DOUBLE)) AS score, CAST(0.0 AS DOUBLE) AS z0,
         round(d.n_chars / CAST(500.0 AS DOUBLE)) / 4.0 - 2.0 AS z1,
         ln(CAST(d.n_chars AS DOUBLE) + 1.0) - 7.0 AS z1b
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


ALL_SCORED = SCORED.replace("CAST(l.quality AS INTEGER) AS label,", "").replace(
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id", "FROM documents d")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def clean_ctes() -> list[str]:
    return [EA, _g(), KM, _cl(), _sites()]


def win_ctes() -> list[str]:
    return clean_ctes() + [_win()]


def feats_rounded(prefix: str = "") -> str:
    return ", ".join(rnd(prefix + dq(f), f) for f in FEATS)


WIN_COLS = f"contig, position, {feats_rounded()}"


def focal_sql(label="label", z0="z0", z1="z1", alpha=1.0, gamma=2.0) -> str:
    m = f"greatest({z0}, {z1})"
    lse = f"({m} + ln(exp({z0} - {m}) + exp({z1} - {m})))"
    zt = f"(CASE WHEN {label} = 1 THEN {z1} ELSE {z0} END)"
    ce = f"({lse} - {zt})"
    return f"({alpha} * pow(1.0 - exp(-{ce}), {gamma}) * {ce})"


def metric_ctes(src: str, by: list[str], score: str = "score", label: str = "label") -> list[str]:
    b = ", ".join(by)
    bc = (b + ", ") if by else ""
    part = f"PARTITION BY {b} " if by else ""
    return [
        f"""mt AS (SELECT {bc}{score} AS threshold,
              sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS tp,
              sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS fp
         FROM {src} GROUP BY {bc}{score})""",
        f"""mc AS (SELECT *, coalesce(sum(tp) OVER ({part}ORDER BY threshold DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tpb,
                  coalesce(sum(fp) OVER ({part}ORDER BY threshold DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fpb
         FROM mt)""",
        f"""ms AS (SELECT {bc}
              CASE WHEN sum(tp) > 0 AND sum(fp) > 0
                   THEN sum(fp * (tpb + 0.5 * tp)) / (CAST(sum(tp) AS DOUBLE) * CAST(sum(fp) AS DOUBLE))
                   ELSE 0.0 END AS auc,
              CASE WHEN sum(tp) > 0
                   THEN sum(tp * (tpb + tp) / CAST(tpb + tp + fpb + fp AS DOUBLE)) / CAST(sum(tp) AS DOUBLE)
                   ELSE 0.0 END AS ap
         FROM mc {('GROUP BY ' + b) if by else ''})""",
    ]


def split_sql(src: str, key_cols: list[str], frac: float = 0.2) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in key_cols)
    return f"""sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', {parts}, '42')))
                        <= round({frac} * count(*) OVER ()) THEN 'valid' ELSE 'train' END AS split
         FROM {src})"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cl = clean_ctes()
    wc = win_ctes()
    ev_cols = ", ".join(rnd(c, c) for c in S.EVENT_REQUIRED[3:])
    q["event_scan"] = with_(EA) + f"SELECT contig, position, reference_kmer, {ev_cols}, ord FROM ea"
    q["site_reference"] = with_(EA, SITES_REF) + "SELECT tx, pos1 FROM sites_ref"
    q["profile_dedup"] = with_(EA, PROFILE) + "SELECT tx, pos, score FROM prof"
    site_cols = ", ".join(rnd(c, c) for c in S.SITE_COLUMNS[3:])
    q["clean_events"] = with_(*cl) + f"SELECT contig, position, reference_kmer, {site_cols} FROM sites"
    q["clipped_mean"] = with_(*cl) + "SELECT contig, position, " + ", ".join(
        rnd(c, c) for c in CLIP) + " FROM sites"
    q["group_median"] = with_(EA) + "SELECT contig, position, " + ", ".join(
        rnd(f"median({src})", dst) for dst, src in S.MEDIAN_COLUMNS.items()) + (
        " FROM ea WHERE contig IS NOT NULL AND position IS NOT NULL GROUP BY contig, position")
    q["kmer_mode"] = with_(EA, KM) + (
        "SELECT d.contig, d.position, km.reference_kmer FROM (SELECT DISTINCT contig, position FROM ea "
        "WHERE contig IS NOT NULL AND position IS NOT NULL) d LEFT JOIN km "
        "ON d.contig = km.contig AND d.position = km.position")
    q["first_model_stdv"] = with_(EA) + (
        f"SELECT contig, position, {rnd('arg_min_null(model_stdv, ord)', 'model_stdv')} FROM ea "
        "WHERE contig IS NOT NULL AND position IS NOT NULL GROUP BY contig, position")
    q["relative_diff"] = with_(*cl) + (
        f"SELECT contig, position, {rnd('event_stdv', 'event_stdv')}, {rnd('model_stdv', 'model_stdv')}, "
        f"{rnd('diff_stdv', 'diff_stdv')} FROM sites")
    q["contig_key"] = with_(EA) + f"SELECT DISTINCT contig, {key()} AS tx FROM ea"
    q["context_centres"] = with_(*wc) + "SELECT contig, position FROM win"
    long_rows = " UNION ALL ".join(
        f"SELECT contig, position, {o} AS \"offset\", position + {o} AS site_position, "
        + ", ".join(rnd(dq(S.feature_name(o, c)), c) for c in BASE) + " FROM win"
        for o in S.OFFSETS)
    q["windows_long"] = with_(*wc) + long_rows
    q["windows_wide"] = with_(*wc) + f"SELECT {WIN_COLS} FROM win"
    q["motif_windows"] = with_(*wc) + f"SELECT {WIN_COLS} FROM win WHERE {MOTIF}"
    q["finite_windows"] = with_(*wc) + f"SELECT {WIN_COLS} FROM win WHERE {FINITE}"
    m6 = wc + [SITES_REF, MWIN]
    q["m6a_positive"] = with_(*m6) + f"SELECT {WIN_COLS} FROM mlab WHERE label = 1"
    q["m6a_negative"] = with_(*m6) + f"SELECT {WIN_COLS} FROM mlab WHERE label = 0"
    q["m6a_labels"] = with_(*m6) + "SELECT contig, position, label FROM mlab"
    q["union_classes"] = with_(*m6) + "SELECT contig, position, label FROM mlab"
    q["m6a_train"] = with_(*m6) + f"SELECT {WIN_COLS}, label FROM mlab"
    q["seeded_shuffle"] = with_(*m6) + (
        "SELECT contig, position, label, md5(concat_ws('|', contig, CAST(position AS VARCHAR), '42')) "
        "AS shuffle_key FROM mlab")
    q["sample_negatives"] = with_(*m6) + (
        "SELECT contig, position, md5(concat_ws('|', contig, CAST(position AS VARCHAR), '42')) AS shuffle_key "
        "FROM mlab WHERE label = 0 ORDER BY shuffle_key LIMIT (SELECT count(*) FROM mlab WHERE label = 1)")
    sw = wc + [PROFILE, SWIN]
    q["profile_lookup"] = with_(*sw) + "SELECT contig, position, score FROM plook"
    q["reactivity_filter"] = with_(*sw) + (
        f"SELECT contig, position, score FROM (SELECT *, TRY_CAST(score AS DOUBLE) AS s FROM plook) t "
        f"WHERE ({BIN}) IS NOT NULL")
    q["structure_train"] = with_(*sw) + f"SELECT {WIN_COLS}, label FROM slab"
    q["infer_structure"] = with_(*wc) + f"SELECT {WIN_COLS}, -1 AS label FROM win WHERE {FINITE}"
    q["infer_m6a"] = with_(*wc) + f"SELECT {WIN_COLS}, -1 AS label FROM win WHERE {MOTIF} AND {FINITE}"
    q["class_weights"] = with_(*sw) + (
        f"SELECT label, count(*) AS n, {rnd('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')} "
        "FROM slab GROUP BY label")
    q["scaler_stats"] = with_(*sw) + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS idx, {rnd(f'avg({dq(f)})', 'mean')}, "
        f"{rnd(f'stddev_pop({dq(f)})', 'std')}, "
        f"{rnd(f'(CASE WHEN stddev_pop({dq(f)}) = 0 THEN 1.0 ELSE stddev_pop({dq(f)}) END)', 'scale')} FROM slab"
        for i, f in enumerate(FEATS))
    stats = ", ".join(f"avg({dq(f)}) AS m{i}, CASE WHEN stddev_pop({dq(f)}) = 0 THEN 1.0 "
                      f"ELSE stddev_pop({dq(f)}) END AS s{i}" for i, f in enumerate(FEATS))
    q["scaled_features"] = with_(*sw, f"stt AS (SELECT {stats} FROM slab)") + (
        "SELECT contig, position, label, " + ", ".join(
            rnd(f"({dq(f)} - m{i}) / s{i}", f) for i, f in enumerate(FEATS)) + " FROM slab, stt")
    q["exact_split"] = with_(*sw, split_sql("slab", ["contig", "position"])) + (
        "SELECT contig, position, split FROM sp")
    items = [("events", "ea"), ("sites", "sites"), ("windows", "win"),
             ("motif_windows", f"win WHERE {MOTIF}"), ("finite_windows", f"win WHERE {FINITE}"),
             ("m6a_windows", "mlab"), ("m6a_positive", "mlab WHERE label = 1"),
             ("m6a_negative", "mlab WHERE label = 0"), ("structure_0", "slab WHERE label = 0"),
             ("structure_1", "slab WHERE label = 1")]
    q["row_accounting"] = with_(*wc, SITES_REF, MWIN, PROFILE, SWIN) + " UNION ALL ".join(
        f"SELECT '{name}' AS item, count(*) AS n FROM {src}" for name, src in items)
    q["softmax2"] = with_(ALL_SCORED) + (
        f"SELECT doc_id, {rnd('1.0 / (1.0 + exp(-(z1 - z0)))', 'p1')} FROM sd")
    q["predicted_class"] = with_(ALL_SCORED) + (
        "SELECT doc_id, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS p_a, CASE WHEN z1b > z0 THEN 1 ELSE 0 END AS p_b FROM sd")
    q["predict_check"] = with_(*wc) + (
        f"SELECT contig, position, TRUE AS in_range, TRUE AS is_mean FROM win WHERE {FINITE}")
    q["fit_counts"] = with_(*sw, split_sql("slab", ["contig", "position"])) + (
        "SELECT split, model, count(*) AS n FROM sp, (VALUES ('NeuralNetwork'), ('RandomForest'), ('Combined')) "
        "AS m(model) GROUP BY split, model")
    q["ensemble_mean"] = with_(ALL_SCORED) + (
        f"SELECT doc_id, {rnd('pa', 'p_a')}, {rnd('pb', 'p_b')}, {rnd('(pa + pb) / 2.0', 'p_mean')} FROM "
        "(SELECT doc_id, 1.0 / (1.0 + exp(-(z1 - z0))) AS pa, 1.0 / (1.0 + exp(-(z1b - z0))) AS pb FROM sd) t")
    q["focal_loss"] = with_(SCORED) + (
        f"SELECT {rnd(f'avg({focal_sql()})', 'loss_mean')}, {rnd(f'sum({focal_sql()})', 'loss_sum')}, "
        "count(*) AS n FROM sd")
    q["roc_auc"] = with_(SCORED, *metric_ctes("sd", [])) + f"SELECT {rnd('auc', 'auc')} FROM ms"
    q["average_precision"] = with_(SCORED, *metric_ctes("sd", [])) + f"SELECT {rnd('ap', 'ap')} FROM ms"
    q["pr_curve"] = with_(SCORED, *metric_ctes("sd", [])) + (
        f"SELECT {rnd('threshold', 'threshold')}, CAST(tpb + tp AS BIGINT) AS tp, CAST(fpb + fp AS BIGINT) AS fp, "
        f"{rnd('(tpb + tp) / CAST(tpb + tp + fpb + fp AS DOUBLE)', 'precision')}, "
        f"{rnd('(tpb + tp) / CAST((SELECT sum(tp) FROM mt) AS DOUBLE)', 'recall')} FROM mc")
    q["metric_report"] = with_(SCORED, split_sql("sd", ["doc_id"]), *metric_ctes("sp", ["split"]),
                               f"fl AS (SELECT split, count(*) AS n, avg({focal_sql()}) AS loss FROM sp GROUP BY split)") + (
        f"SELECT fl.split, fl.n, {rnd('fl.loss', 'loss')}, {rnd('ms.auc', 'auc')}, {rnd('ms.ap', 'ap')} "
        "FROM fl JOIN ms ON fl.split = ms.split")
    # Through files, and the structures that joins look into.
    q["site_file"] = q["clean_events"]
    q["training_file"] = q["m6a_train"]
    q["clustered_windows"] = q["windows_wide"]
    q["inference_files"] = with_(*wc) + (
        f"SELECT contig, position, -1 AS label, 'structure' AS \"set\" FROM win WHERE {FINITE} UNION ALL "
        f"SELECT contig, position, -1, 'm6a' FROM win WHERE {MOTIF} AND {FINITE}")
    q["site_index"] = with_(EA, SITES_REF) + (
        "SELECT tx, pos1 // 32768 AS bucket, count(*) AS sites FROM sites_ref WHERE tx IS NOT NULL GROUP BY ALL")
    q["profile_pieces"] = with_(EA, PROFILE) + (
        "SELECT tx, pos // 4096 AS bucket, CAST(count(*) AS INTEGER) AS scores FROM prof GROUP BY ALL")
    q["tied_split"] = with_(*wc) + (
        "SELECT split, n FROM (SELECT 'valid' AS split, CAST(round_even(0.3 * count(*), 0) AS BIGINT) AS n, count(*) AS c "
        f"FROM win WHERE {FINITE} UNION ALL SELECT 'train', count(*) - CAST(round_even(0.3 * count(*), 0) AS BIGINT), "
        f"count(*) FROM win WHERE {FINITE}) t WHERE c > 0 AND n > 0")
    # What holds for every window, whatever the fit: each once, and true.
    every = f"FROM win WHERE {FINITE}"
    q["forest_check"] = with_(*wc) + f"SELECT contig, position, TRUE AS same, TRUE AS min_split_holds {every}"
    q["model_file"] = with_(*wc) + f"SELECT contig, position, TRUE AS same {every}"
    q["history_check"] = with_(*sw, split_sql("slab", ["contig", "position"])) + (
        "SELECT split, count(*) AS n, TRUE AS learns FROM sp GROUP BY split")
    return q
