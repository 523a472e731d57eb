"""Registered queries: each reads the driver's tables through the bridge views.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``.
Computed doubles are rounded to 6 places at this boundary only (both sides),
so engine-specific summation order cannot flip a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netpulse.functions.exprs import round_doubles
from netpulse.operators import windows
from netpulse.plans import bridge
from netpulse.plans import oracle as O
from netpulse.session import materialize, small, stored

# Fixed parameters of the bridge fixtures: one-day windows over the event month.
WINDOW_SECONDS = 86400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.load(spark, sf_dir, "events")


def features(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    return windows.sensor_feature_frame(bridge.sensor_raw(events(spark, sf_dir)), WINDOW_SECONDS, extra_keys=keys)


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window rows under ``features``, all that counts and labels need."""
    return windows.window_aggregate(bridge.sensor_raw(events(spark, sf_dir)), WINDOW_SECONDS, ("domain",))


# ------------------------------------------------------------------ §2.3 windows

_W = WINDOW_SECONDS
_FEATURE_SQL = O.with_ctes(*O.features_ctes(_W, rounded=True)) + "SELECT * FROM features"


@register("sensor_feature_frame", _FEATURE_SQL)
def q_sensor_feature_frame(spark, sf_dir):
    """Flagship: raw sensor rows -> 30 window features per (session, window)."""
    return windows.sensor_feature_frame(bridge.sensor_raw(events(spark, sf_dir)), _W)


_WA_COLS = (
    "session_id, window_start, packets_sent, packets_lost, retransmissions, resets, round(rtt_mean, 6) AS rtt_mean, "
    "round(rtt_std, 6) AS rtt_std, sample_count, label, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in windows.OPTIONAL_COLUMN_AGGREGATES)
)


@register("window_aggregate", O.with_ctes(O.sensor_raw_cte(), O.window_agg_cte("sensor_raw", _W)) + f"SELECT {_WA_COLS} FROM win")
def q_window_aggregate(spark, sf_dir):
    return windows.window_aggregate(bridge.sensor_raw(events(spark, sf_dir)), _W)


_WF_COLS = "session_id, window_start, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in windows.FEATURE_COLUMNS[:23]
) + ", label"


@register(
    "window_features",
    O.with_ctes(O.sensor_raw_cte(), O.window_agg_cte("sensor_raw", _W), O.window_features_cte("win", _W))
    + f"SELECT {_WF_COLS} FROM feat",
)
def q_window_features(spark, sf_dir):
    return windows.window_features(windows.window_aggregate(bridge.sensor_raw(events(spark, sf_dir)), _W), _W)


@register("session_baseline_features", _FEATURE_SQL)
def q_session_baseline_features(spark, sf_dir):
    wf = windows.window_features(windows.window_aggregate(bridge.sensor_raw(events(spark, sf_dir)), _W), _W)
    return windows.session_baseline_features(wf).select("session_id", "window_start", *windows.FEATURE_COLUMNS, "label")


_DOMAIN_FEATURES = O.features_ctes(_W, keys=("domain",), rounded=False)


@register("session_labels", O.with_ctes(*_DOMAIN_FEATURES) + "SELECT domain, session_id, max(label) AS label FROM features GROUP BY ALL")
def q_session_labels(spark, sf_dir):
    return windows.session_labels(window_rows(spark, sf_dir), keys=("domain", "session_id"))


@register("class_balance", O.with_ctes(*_DOMAIN_FEATURES) + "SELECT label, count(*) AS rows FROM features GROUP BY label")
def q_class_balance(spark, sf_dir):
    return windows.class_balance(window_rows(spark, sf_dir))


@register("rows_by_domain", O.with_ctes(*_DOMAIN_FEATURES) + "SELECT domain, count(*) AS rows FROM features GROUP BY domain")
def q_rows_by_domain(spark, sf_dir):
    return windows.rows_by_domain(window_rows(spark, sf_dir))


@register(
    "class_balance_by_domain",
    O.with_ctes(*_DOMAIN_FEATURES) + "SELECT domain, label, count(*) AS rows FROM features GROUP BY domain, label",
)
def q_class_balance_by_domain(spark, sf_dir):
    return windows.class_balance_by_domain(window_rows(spark, sf_dir))


@register(
    "dataset_summary",
    O.with_ctes(O.sensor_raw_cte())
    + "SELECT domain, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM sensor_raw GROUP BY domain",
)
def q_dataset_summary(spark, sf_dir):
    """Raw rows and distinct sessions per domain."""
    return windows.dataset_summary(bridge.sensor_raw(events(spark, sf_dir)))


# ------------------------------------------------------------------ §2.7 evaluation

from netpulse.operators import metrics as M  # noqa: E402
from netpulse.operators.ml import MODEL_THRESHOLD  # noqa: E402

_T = MODEL_THRESHOLD
_SCORES = O.scores_ctes(_W)


def scores(spark, sf_dir, variation="rtt_cv"):
    return bridge.scores(events(spark, sf_dir), _W, variation)


_RATIO_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "positive_rate"))


@register(
    "binary_metrics",
    O.with_ctes(*_SCORES, *O.ranking_ctes("scores", ()))
    + f"""SELECT CAST({_T} AS DOUBLE) AS threshold, {O.ratio_sql()}, tn, fp, fn, tp, round(r.roc_auc, 6) AS roc_auc,
       round(r.average_precision, 6) AS average_precision
    FROM (SELECT {O.cm_select(f"probability >= {_T}")} FROM scores) cm CROSS JOIN ranking r""",
)
def q_binary_metrics(spark, sf_dir):
    """Pooled metrics of the rule score at the trained-model default threshold."""
    return M.binary_metrics(scores(spark, sf_dir), _T)


@register(
    "roc_auc",
    O.with_ctes(*_SCORES, *O.ranking_ctes("scores", ("domain",))) + "SELECT domain, round(roc_auc, 6) AS roc_auc FROM ranking",
)
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(scores(spark, sf_dir), ["domain"])


@register(
    "average_precision",
    O.with_ctes(*_SCORES, *O.ranking_ctes("scores", ("domain",)))
    + "SELECT domain, round(average_precision, 6) AS average_precision FROM ranking",
)
def q_average_precision(spark, sf_dir):
    return M.average_precision(scores(spark, sf_dir), ["domain"])


_SWEEP_OUT = "round(threshold, 6) AS threshold, " + _RATIO_R + ", tn, fp, fn, tp"


@register(
    "threshold_sweep",
    O.with_ctes(*_SCORES, O.thresholds_cte(), O.sweep_cte("scores", ("domain",))) + f"SELECT domain, {_SWEEP_OUT} FROM sweep",
)
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(scores(spark, sf_dir), ["domain"])


@register(
    "best_threshold",
    O.with_ctes(*_SCORES, O.thresholds_cte(), O.sweep_cte("scores", ()), O.best_cte("sweep", ())) + f"SELECT {_SWEEP_OUT} FROM best",
)
def q_best_threshold(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(scores(spark, sf_dir)))


@register("probability_summary", O.with_ctes(*_SCORES) + O.summary_select(("domain",), "scores"))
def q_probability_summary(spark, sf_dir):
    return M.probability_summary(scores(spark, sf_dir), ["domain"])


_BY_DOMAIN_CTES = [
    *_SCORES,
    *O.ranking_ctes("scores", ("domain",)),
    O.thresholds_cte(),
    O.sweep_cte("scores", ("domain",)),
    O.best_cte("sweep", ("domain",)),
    f"""cmd AS (SELECT domain, count(*) AS rows, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
        CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives, {O.cm_select(f"probability >= {_T}")}
        FROM scores GROUP BY domain)""",
    f"cmr AS (SELECT *, {O.ratio_sql(rounded=False)} FROM cmd)",
    f"summ AS ({O.summary_select(('domain',), 'scores')})",
    f"""by_domain AS (SELECT c.domain, c.rows, c.negatives, c.positives, CAST({_T} AS DOUBLE) AS threshold, c.accuracy, c.precision, c.recall, c.f1, c.positive_rate,
        c.tn, c.fp, c.fn, c.tp, r.roc_auc, r.average_precision,
        b.threshold AS best_threshold, b.f1 AS best_f1, b.precision AS best_precision, b.recall AS best_recall,
        b.positive_rate AS best_positive_rate,
        s.min AS prob_min, s.p25 AS prob_p25, s.p50 AS prob_p50, s.p75 AS prob_p75, s.p95 AS prob_p95, s.max AS prob_max
        FROM cmr c JOIN ranking r ON c.domain = r.domain JOIN best b ON c.domain = b.domain JOIN summ s ON c.domain = s.domain)""",
]


def _round_all(cols: list[str], ints: set[str]) -> str:
    return ", ".join(c if c in ints else f"round({c}, 6) AS {c}" for c in cols)


_BY_DOMAIN_COLS = (
    "domain rows negatives positives threshold accuracy precision recall f1 positive_rate tn fp fn tp roc_auc "
    "average_precision best_threshold best_f1 best_precision best_recall best_positive_rate prob_min prob_p25 "
    "prob_p50 prob_p75 prob_p95 prob_max"
).split()


@register(
    "metrics_by_domain",
    O.with_ctes(*_BY_DOMAIN_CTES)
    + f"SELECT {_round_all(_BY_DOMAIN_COLS, {'domain', 'rows', 'negatives', 'positives', 'tn', 'fp', 'fn', 'tp'})} FROM by_domain",
)
def q_metrics_by_domain(spark, sf_dir):
    return M.metrics_by_domain(scores(spark, sf_dir), _T, ["domain"])


_MACRO_COLS = [*M.MACRO_METRIC_KEYS, "best_f1", "best_precision", "best_recall", "best_positive_rate", "best_threshold"]


@register(
    "macro_metrics",
    O.with_ctes(*_BY_DOMAIN_CTES)
    + "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MACRO_COLS) + ", count(*) AS domains FROM by_domain",
)
def q_macro_metrics(spark, sf_dir):
    return M.macro_metrics(M.metrics_by_domain(scores(spark, sf_dir), _T, ["domain"]))


# The three rule-score variants ranked against each other.
_RULE_VARIANTS = ("rtt_cv", "flow_iat_cv", "packet_length_cv")


def _variant_scores(spark, sf_dir):
    feats = features(spark, sf_dir)
    from netpulse.operators.ml import rule_score
    from pyspark.sql import functions as F

    parts = [
        rule_score(feats, variation_column=v).select(
            F.lit(f"rule_{v}").alias("algorithm"), "domain", "label", F.round("probability", 6).alias("probability")
        )
        for v in _RULE_VARIANTS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rank_sql() -> str:
    unions = " UNION ALL ".join(
        f"SELECT 'rule_{v}' AS algorithm, domain, label, probability FROM ({O.scores_cte(v, name='x')[len('x AS ('):-1]})"
        for v in _RULE_VARIANTS
    )
    return O.with_ctes(
        *O.features_ctes(_W, keys=("domain",)),
        f"sc AS ({unions})",
        *O.ranking_ctes("sc", ("algorithm",)),
        O.thresholds_cte(),
        O.sweep_cte("sc", ("algorithm",)),
        O.best_cte("sweep", ("algorithm",)),
    ) + """SELECT b.algorithm, round(b.f1, 6) AS best_f1, round(b.recall, 6) AS best_recall,
        round(r.roc_auc, 6) AS roc_auc, round(r.average_precision, 6) AS average_precision,
        row_number() OVER (ORDER BY b.f1 DESC, b.recall DESC, coalesce(r.average_precision, 0) DESC,
          coalesce(r.roc_auc, 0) DESC, b.algorithm) AS rank
      FROM best b JOIN ranking r ON b.algorithm = r.algorithm"""


@register("rank_models", _rank_sql())
def q_rank_models(spark, sf_dir):
    """Rank three deterministic scorers by best F1, recall, AP, AUC."""
    from pyspark.sql import functions as F

    sc = _variant_scores(spark, sf_dir)
    best = M.best_threshold(M.threshold_sweep(sc, ["algorithm"]), ["algorithm"]).select(
        "algorithm", F.col("f1").alias("best_f1"), F.col("recall").alias("best_recall")
    )
    report = best.join(M.ranking_metrics(sc, ["algorithm"]), "algorithm")
    return M.rank_models(report).select("algorithm", "best_f1", "best_recall", "roc_auc", "average_precision", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------------ §2.2 cleaning

from pyspark.sql import functions as F  # noqa: E402

from netpulse.operators import clean as C  # noqa: E402


def flows(spark, sf_dir):
    return bridge.flows_raw(events(spark, sf_dir))


@register(
    "normalize_sensor_metrics",
    O.with_ctes(O.sensor_raw_cte())
    + """SELECT session_id, "timestamp", packets_sent, packets_lost, round(rtt_ms, 6) AS rtt_ms, retransmissions,
      CAST(resets AS BIGINT) AS resets, label, round(flow_duration_ms, 6) AS flow_duration_ms, round(average_packet_size, 6) AS average_packet_size,
      domain FROM sensor_raw""",
)
def q_normalize_sensor_metrics(spark, sf_dir):
    """Alias spellings + ISO text timestamps -> the canonical sensor schema."""
    return C.normalize_sensor_metrics(bridge.sensor_aliased(events(spark, sf_dir)), passthrough=("domain",))


_INT_TEXT = ["event_id", "source", "label", "total_fwd_packets", "total_backward_packets", "rst_flag_count",
             "act_data_pkt_fwd", "packet_length_mean", "syn_flag_count"]


@register(
    "canonicalize_columns",
    O.with_ctes(O.flows_raw_cte())
    + """SELECT event_id, source, "Label" AS label, "Total Fwd Packets" AS total_fwd_packets,
      "Total Backward Packets" AS total_backward_packets, "RST Flag Count" AS rst_flag_count, act_data_pkt_fwd,
      "Packet Length Mean" AS packet_length_mean, "SYN Flag Count" AS syn_flag_count FROM flows_raw""",
)
def q_canonicalize_columns(spark, sf_dir):
    return C.canonicalize_columns(flows(spark, sf_dir)).select(*_INT_TEXT)


_NUMERIC_HEADERS = ["Total Fwd Packets", "Total Backward Packets", "Flow IAT Mean", "Flow Packets/s", "Flow Bytes/s",
                    "Down/Up Ratio", "Idle Mean"]
_ZERO_INF = ["Flow Packets/s", "Flow Bytes/s", "Down/Up Ratio"]


def _alias(h: str) -> str:
    return C.canonical_name(h)


@register(
    "coerce_numeric",
    O.with_ctes(O.flows_raw_cte())
    + "SELECT event_id, "
    + ", ".join(
        f"round(greatest({O.zinf(O.num(chr(34) + h + chr(34))) if h in _ZERO_INF else O.num(chr(34) + h + chr(34))}, 0.0), 6) AS {_alias(h)}"
        for h in _NUMERIC_HEADERS
    )
    + " FROM flows_raw",
)
def q_coerce_numeric(spark, sf_dir):
    """Dirty text ('n/a', 'Infinity', 'NaN') -> clipped doubles; chosen columns map ±inf to 0."""
    df = C.coerce_numeric(flows(spark, sf_dir), _NUMERIC_HEADERS, zero_inf=_ZERO_INF)
    return df.select("event_id", *[F.col(f"`{h}`").alias(_alias(h)) for h in _NUMERIC_HEADERS])


_RESOLVED = ["total_packets", "total_fwd_packets", "total_bwd_packets", "flow_duration_us", "flow_duration_ms",
             "flow_iat_mean_us", "retransmissions"]


@register(
    "resolve_aliases",
    O.with_ctes(O.flows_raw_cte())
    + f"""SELECT event_id, CAST(0.0 AS DOUBLE) AS total_packets, round({O.num('"Total Fwd Packets"')}, 6) AS total_fwd_packets,
      round({O.num('"Total Backward Packets"')}, 6) AS total_bwd_packets,
      round({O.num('" Flow Duration"')}, 6) AS flow_duration_us, CAST(0.0 AS DOUBLE) AS flow_duration_ms,
      round({O.num('"Flow IAT Mean"')}, 6) AS flow_iat_mean_us, CAST(0.0 AS DOUBLE) AS retransmissions FROM flows_raw""",
)
def q_resolve_aliases(spark, sf_dir):
    frame = C.canonicalize_columns(flows(spark, sf_dir))
    return frame.select("event_id", *[C.resolve_aliases(frame, k).alias(k) for k in _RESOLVED])


_FALLBACK_OUT = ["total_fwd_packets", "flow_duration_ms", "flow_iat_mean_ms", "flow_iat_std_us", "retransmissions",
                 "packet_length_mean", "labels_numeric"]


@register(
    "zero_column_fallback",
    O.with_ctes(O.flows_raw_cte(), *O.app_flow_ctes())
    + "SELECT event_id, source, "
    + ", ".join(f"round({c}, 6) AS {c}" if c != "labels_numeric" else c for c in _FALLBACK_OUT)
    + " FROM vres",
)
def q_zero_column_fallback(spark, sf_dir):
    """Per-source all-zero columns replaced by their fallbacks (flags broadcast per source)."""
    frame = C.canonicalize_columns(flows(spark, sf_dir))
    return C.zero_column_fallback(frame, "source", keep=["event_id", "source"]).select("event_id", "source", *_FALLBACK_OUT)


@register(
    "parse_mixed_timestamps",
    "SELECT event_id, ts AS ts_from_text, ts AS ts_from_number FROM events",
)
def q_parse_mixed_timestamps(spark, sf_dir):
    """ISO text and epoch-second numbers both parse to the same UTC instant."""
    from pyspark.sql.types import DoubleType, StringType

    e = events(spark, sf_dir).select(
        "event_id",
        F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t_text"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t_num"),
    )
    return e.select(
        "event_id",
        C.parse_mixed_timestamps("t_text", StringType()).alias("ts_from_text"),
        C.parse_mixed_timestamps("t_num", DoubleType()).alias("ts_from_number"),
    )


@register(
    "label_not_benign",
    O.with_ctes(O.flows_raw_cte())
    + "SELECT event_id, CASE WHEN upper(trim(coalesce(\"Label\", 'nan'))) <> 'BENIGN' THEN 1 ELSE 0 END AS label FROM flows_raw",
)
def q_label_not_benign(spark, sf_dir):
    return flows(spark, sf_dir).select("event_id", C.label_not_benign("Label").alias("label"))


def _mixed_labels(df):
    """Source f1 carries numeric 0/1 label text, f0 keeps the words."""
    numeric_text = F.when(F.col("Label").contains("PortScan"), F.lit("1")).otherwise(F.lit("0"))
    return df.withColumn("Label", F.when(F.col("source") == "f1", numeric_text).otherwise(F.col("Label")))


_PATTERN = "scan"


@register(
    "label_by_pattern",
    O.with_ctes(
        O.flows_raw_cte(),
        """ml AS (SELECT event_id, source, coalesce(CASE WHEN source = 'f1' THEN (CASE WHEN contains("Label", 'PortScan')
            THEN '1' ELSE '0' END) ELSE "Label" END, 'nan') AS t FROM flows_raw)""",
        f"mf AS (SELECT source, bool_and({O.label_numeric_ok('t')}) AS ok FROM ml GROUP BY source)",
    )
    + f"SELECT event_id, source, CAST({O.label_pattern_sql('t', 'mf.ok', _PATTERN)} AS INTEGER) AS label "
    "FROM ml JOIN mf USING (source)",
)
def q_label_by_pattern(spark, sf_dir):
    """Numeric labels where a whole source is 0/1, else substring rule (per-source flag, counted)."""
    df = _mixed_labels(flows(spark, sf_dir))
    text = F.coalesce(F.col("Label").cast("string"), F.lit("nan"))
    flags = C.source_flags(df, "source", {"ok": C._all_numeric_binary(text)})
    j = df.join(small(flags), "source")
    return j.select("event_id", "source", C.label_by_pattern(text, F.col("ok"), _PATTERN).alias("label"))


@register(
    "assign_row_ids",
    O.with_ctes(O.flows_raw_cte())
    + f"SELECT event_id, source, {O.row_id_sql()} FROM "
    "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS i FROM flows_raw)",
)
def q_assign_row_ids(spark, sf_dir):
    """Per-source 0-based positions by the distributed ordered index (no one-partition window)."""
    return C.assign_row_ids(flows(spark, sf_dir).select("event_id", "source"), "source", ["event_id"])


@register("convert_benign_attack_flows", O.cic_sql())
def q_convert_benign_attack_flows(spark, sf_dir):
    return C.convert_benign_attack_flows(flows(spark, sf_dir), "source", ["event_id"])


@register("convert_labelled_app_flows", O.app_flows_sql(_PATTERN))
def q_convert_labelled_app_flows(spark, sf_dir):
    return C.convert_labelled_app_flows(flows(spark, sf_dir), "source", ["event_id"], positive_pattern=_PATTERN)


# ------------------------------------------------------------------ §2.6 sampling, §2.5 joins

from netpulse.operators import joins as J  # noqa: E402
from netpulse.operators import sampling as S  # noqa: E402

_RATIO, _SEED = 0.2, 42
_FEAT_KEYS = "f.session_id, f.domain, f.window_start, f.label"


def _feature_keys(df):
    return df.select("session_id", "domain", "window_start", "label")


@register(
    "split_by_session",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ()))
    + f"SELECT {_FEAT_KEYS}, CASE WHEN v.is_val THEN 'validation' ELSE 'train' END AS split "
    "FROM features f JOIN v ON f.session_id = v.session_id",
)
def q_split_by_session(spark, sf_dir):
    """Stratified session-level split (quota by largest remainder, md5 order)."""
    return S.split_by_session(_feature_keys(features(spark, sf_dir)), _RATIO, _SEED)


@register(
    "split_by_session_per_domain",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ("domain",)))
    + f"SELECT {_FEAT_KEYS}, CASE WHEN v.is_val THEN 'validation' ELSE 'train' END AS split "
    "FROM features f JOIN v ON f.session_id = v.session_id AND f.domain = v.domain",
)
def q_split_by_session_per_domain(spark, sf_dir):
    return S.split_by_session_per_domain(_feature_keys(features(spark, sf_dir)), _RATIO, _SEED)


@register(
    "split_rows_by_session",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ()))
    + f"SELECT {_FEAT_KEYS} FROM features f WHERE f.session_id IN (SELECT session_id FROM v WHERE is_val)",
)
def q_split_rows_by_session(spark, sf_dir):
    """Validation rows: a left-semi join of the rows with the validation sessions."""
    feats = _feature_keys(features(spark, sf_dir))
    val = S.session_split(feats, _RATIO, _SEED).where("is_validation")
    return S.keep_sessions(feats, val)


def _hash_sql(seed: int, *cols: str) -> str:
    parts = ", ':', ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat('{seed}', ':', {parts}))"


@register(
    "balance_domains",
    O.with_ctes(*_DOMAIN_FEATURES)
    + f"""SELECT session_id, domain, window_start, label FROM (
        SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_hash_sql(_SEED, 'session_id', 'window_start')},
          session_id, window_start) - 1 AS i FROM features) b,
        (SELECT min(c) AS target, count(*) AS nd FROM (SELECT domain, count(*) AS c FROM features GROUP BY domain)) t
      WHERE t.nd < 2 OR b.i < t.target""",
)
def q_balance_domains(spark, sf_dir):
    return S.balance_domains(_feature_keys(features(spark, sf_dir)), _SEED)


_DOWNSAMPLE_N = 1000


@register(
    "downsample",
    O.with_ctes(*_DOMAIN_FEATURES)
    + f"""SELECT session_id, domain, window_start, label FROM (
        SELECT *, row_number() OVER (ORDER BY {_hash_sql(_SEED, 'session_id', 'window_start')}, session_id,
          window_start) - 1 AS i FROM features) WHERE i < {_DOWNSAMPLE_N}""",
)
def q_downsample(spark, sf_dir):
    """At most N rows in hash order (the sampling operator: the limit is the feature)."""
    return S.downsample(_feature_keys(features(spark, sf_dir)), _DOWNSAMPLE_N, _SEED)


_EXP_OUT = ("run_id, session_id, \"timestamp\", domain, application, scenario, phase_name, impairment_type, "
            "severity, capture_offset_seconds, label")


def _experiment(spark, sf_dir):
    ev = events(spark, sf_dir)
    return bridge.experiment_raw(ev), bridge.phase_table(ev), bridge.run_metadata(ev)


@register("label_by_phase", O.with_ctes(*O.experiment_ctes()) + f"SELECT {_EXP_OUT} FROM labelled")
def q_label_by_phase(spark, sf_dir):
    """Interval join of rows against run phases; overlapping phases: the later listed wins."""
    raw, phases, runs = _experiment(spark, sf_dir)
    out = J.label_by_phase(raw, phases, runs)
    return out.select(*[c.strip('"') for c in _EXP_OUT.split(", ")])


@register(
    "uncovered_rows",
    O.with_ctes(*O.experiment_ctes())
    + """SELECT run_id, session_id, "timestamp", capture_offset_seconds FROM labelled WHERE NOT covered
      ORDER BY run_id, session_id, "timestamp" LIMIT 5""",
)
def q_uncovered_rows(spark, sf_dir):
    """First five rows no phase covers (top-k; what strict mode reports)."""
    raw, phases, runs = _experiment(spark, sf_dir)
    return J.uncovered_rows(J.label_by_phase(raw, phases, runs))


@register(
    "build_experiment_dataset",
    O.with_ctes(*O.experiment_ctes())
    + f"SELECT {_EXP_OUT}, packets_sent, packets_lost, round(rtt_ms, 6) AS rtt_ms FROM labelled",
)
def q_build_experiment_dataset(spark, sf_dir):
    """All runs in one job: normalize without labels, label by phase (coverage not strict)."""
    raw, phases, runs = _experiment(spark, sf_dir)
    out = J.build_experiment_dataset(raw, phases, runs, strict_coverage=False)
    return out.select(*[c.strip('"') for c in _EXP_OUT.split(", ")], "packets_sent", "packets_lost", "rtt_ms")


@register("label_by_phase_steps", O.with_ctes(*O.experiment_ctes()) + f"SELECT {_EXP_OUT} FROM labelled")
def q_label_by_phase_steps(spark, sf_dir):
    """The interval join as it runs with too many runs to broadcast: on (run, step of time)."""
    raw, phases, runs = _experiment(spark, sf_dir)
    out = J.label_by_phase(raw, phases, runs, always_steps=True)
    return out.select(*[c.strip('"') for c in _EXP_OUT.split(", ")])


@register(
    "holdout_folds",
    O.with_ctes(*_DOMAIN_FEATURES)
    + f"""SELECT d.holdout, {_FEAT_KEYS}, CASE WHEN d.holdout = f.domain THEN 'eval' ELSE 'train' END AS role
      FROM features f CROSS JOIN (SELECT DISTINCT domain AS holdout FROM features) d""",
)
def q_holdout_folds(spark, sf_dir):
    feats = _feature_keys(features(spark, sf_dir))
    return J.holdout_folds(feats).select("holdout", "session_id", "domain", "window_start", "label", "role")


@register(
    "check_domains",
    O.with_ctes(*_DOMAIN_FEATURES)
    + """SELECT domain, count(DISTINCT label) AS classes,
      CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
      CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
      count(DISTINCT label) >= 2 AS ok FROM features GROUP BY domain""",
)
def q_check_domains(spark, sf_dir):
    return J.check_domains(window_rows(spark, sf_dir))


@register(
    "union_sources",
    O.with_ctes(O.sensor_raw_cte())
    + """SELECT session_id, "timestamp", packets_sent, round(rtt_ms, 6) AS rtt_ms, round(flow_duration_ms, 6) AS flow_duration_ms,
        CAST(NULL AS DOUBLE) AS average_packet_size, CAST(NULL AS VARCHAR) AS domain FROM sensor_raw WHERE domain = 'd0'
      UNION ALL
      SELECT session_id, "timestamp", packets_sent, round(rtt_ms, 6), CAST(NULL AS DOUBLE), round(average_packet_size, 6), domain
        FROM sensor_raw WHERE domain <> 'd0'""",
)
def q_union_sources(spark, sf_dir):
    """UNION ALL by name of two differently shaped sources (missing columns NULL)."""
    raw = bridge.sensor_raw(events(spark, sf_dir))
    a = raw.where(F.col("domain") == "d0").select("session_id", "timestamp", "packets_sent", "rtt_ms", "flow_duration_ms")
    b = raw.where(F.col("domain") != "d0").select("session_id", "timestamp", "packets_sent", "rtt_ms",
                                                  "average_packet_size", "domain")
    return J.union_sources([a, b])


# ------------------------------------------------------------------ §2.4 sequences, regression metrics

from netpulse.operators import sequences as Q  # noqa: E402

# Fixed parameters of the packet fixture: day-scale gaps, 5-step histories.
_MAX_IAT_MS = 86400000.0
_L = 5


def iat(spark, sf_dir):
    return Q.inter_arrival_times(bridge.packets(events(spark, sf_dir)), max_iat_ms=_MAX_IAT_MS)


def _round_array(c: str):
    return F.transform(F.col(c), lambda x: F.round(x, 6)).alias(c)


@register(
    "inter_arrival_times",
    O.with_ctes(*O.iat_ctes(_MAX_IAT_MS)) + "SELECT trace_id, packet_index, round(iat_ms, 6) AS iat_ms FROM iat",
)
def q_inter_arrival_times(spark, sf_dir):
    return iat(spark, sf_dir)


@register(
    "dump_inter_arrival_times",
    O.with_ctes(O.packets_cte())
    + f"""SELECT trace_id, packet_index, iat_ms FROM (
      SELECT trace_id, i AS packet_index, CAST(round(CAST(CAST((epoch - lag(epoch) OVER (PARTITION BY trace_id ORDER BY i))
        * 1000.0 AS VARCHAR) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS iat_ms FROM (SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY packet_index) - 1 AS i,
          CAST(epoch_us("timestamp") AS DOUBLE) / 1e6 AS epoch FROM packets))
      WHERE iat_ms > 0 AND iat_ms <= {_MAX_IAT_MS}""",
)
def q_dump_inter_arrival_times(spark, sf_dir):
    return Q.dump_inter_arrival_times(bridge.packet_dump_rows(events(spark, sf_dir)), max_iat_ms=_MAX_IAT_MS)


@register("iat_stats", O.with_ctes(*O.iat_ctes(_MAX_IAT_MS)) + "SELECT round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def q_iat_stats(spark, sf_dir):
    return Q.iat_stats(iat(spark, sf_dir))


_SEQ_SQL = O.with_ctes(*O.seq_ctes(_MAX_IAT_MS, _L))
_SEQ_OUT = ("trace_id, packet_index, list_transform(inputs, lambda x: round(x, 6)) AS inputs, round(target, 6) AS target, "
            "round(actual_iat_ms, 6) AS actual_iat_ms, round(mean, 6) AS mean, round(std, 6) AS std")


@register("iat_sequences", _SEQ_SQL + f"SELECT {_SEQ_OUT} FROM seq")
def q_iat_sequences(spark, sf_dir):
    s = Q.iat_sequences(iat(spark, sf_dir), _L)
    return s.select("trace_id", "packet_index", _round_array("inputs"), "target", "actual_iat_ms", "mean", "std")


@register(
    "iat_inference_frame",
    _SEQ_SQL + "SELECT trace_id, packet_index AS target_packet_index, list_transform(inputs, lambda x: round(x, 6)) AS inputs, "
    "round(target, 6) AS target, round(actual_iat_ms, 6) AS actual_iat_ms FROM seq",
)
def q_iat_inference_frame(spark, sf_dir):
    """Scoring samples with the stored normalization (here: the stats of the same data)."""
    gaps = iat(spark, sf_dir)
    st = Q.iat_stats(gaps).first()  # one row
    s = Q.iat_inference_frame(gaps, st["mean"], st["std"], _L)
    return s.select("trace_id", "target_packet_index", _round_array("inputs"), "target", "actual_iat_ms")


_TAIL_RATIO = 0.2


@register(
    "tail_split",
    _SEQ_SQL
    + f"""SELECT trace_id, packet_index, CASE WHEN {_TAIL_RATIO} > 0 AND n >= 2 AND pos >= n - greatest(1, floor(n * {_TAIL_RATIO}))
      THEN 'validation' ELSE 'train' END AS split FROM (SELECT trace_id, packet_index,
        row_number() OVER (ORDER BY trace_id, packet_index) - 1 AS pos, count(*) OVER () AS n FROM seq)""",
)
def q_tail_split(spark, sf_dir):
    """Last 20 % of samples in (trace, index) order for validation, by the distributed ordered index."""
    s = Q.iat_sequences(iat(spark, sf_dir), _L)
    return Q.tail_split(s, _TAIL_RATIO).select("trace_id", "packet_index", "split")


def _persistence(spark, sf_dir):
    """Deterministic next-gap forecast: repeat the last observed gap."""
    s = Q.iat_sequences(iat(spark, sf_dir), _L)
    last = F.element_at("inputs", -1)
    return s.select(
        "target", last.alias("pred_z"), "actual_iat_ms", (last * F.col("std") + F.col("mean")).alias("predicted_iat_ms")
    )


@register(
    "regression_metrics",
    _SEQ_SQL + """SELECT round(avg(abs(p - actual_iat_ms)), 6) AS mae, round(sqrt(avg((p - actual_iat_ms) * (p - actual_iat_ms))), 6)
      AS rmse FROM (SELECT actual_iat_ms, inputs[-1] * std + mean AS p FROM seq)""",
)
def q_regression_metrics(spark, sf_dir):
    """MAE / RMSE in ms of the repeat-last-gap forecast."""
    from netpulse.operators import metrics as M2

    return M2.regression_metrics(_persistence(spark, sf_dir), "actual_iat_ms", "predicted_iat_ms")


@register(
    "huber_loss",
    _SEQ_SQL + """SELECT round(avg(CASE WHEN abs(e) <= 1.0 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 6) AS huber_loss
      FROM (SELECT inputs[-1] - target AS e FROM seq)""",
)
def q_huber_loss(spark, sf_dir):
    """Mean Huber loss (delta 1) on normalized values of the repeat-last-gap forecast."""
    from netpulse.operators import metrics as M2

    return M2.huber_loss(_persistence(spark, sf_dir), "target", "pred_z")


# ------------------------------------------------------------------ §2.9 decision log

from datetime import datetime as _dt  # noqa: E402

from netpulse.operators import decisions as D  # noqa: E402


def decisions(spark, sf_dir):
    return bridge.decisions(events(spark, sf_dir))


_DEC = O.with_ctes(O.decisions_cte())


@register(
    "hour_features",
    _DEC + """SELECT event_id, round(sin(2 * pi() * ((hour(ts) + minute(ts) / 60.0) / 24.0)), 6) AS hour_sin,
      round(cos(2 * pi() * ((hour(ts) + minute(ts) / 60.0) / 24.0)), 6) AS hour_cos,
      CAST(hour(ts) AS INTEGER) AS hour_bucket FROM decisions""",
)
def q_hour_features(spark, sf_dir):
    return D.hour_features(decisions(spark, sf_dir).select("event_id", "ts")).select(
        "event_id", "hour_sin", "hour_cos", "hour_bucket")


@register(
    "session_outcomes",
    _DEC + """SELECT event_id, (NOT (event_type = 'error') AND value > 1.0) AS success,
      CASE WHEN NOT (event_type = 'error') AND value > 1.0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END AS reward,
      CASE WHEN NOT (event_type = 'error') AND value > 1.0 THEN 1 ELSE 0 END AS success_count,
      CASE WHEN NOT (event_type = 'error') AND value > 1.0 THEN 0 ELSE 1 END AS failure_count FROM decisions""",
)
def q_session_outcomes(spark, sf_dir):
    """Outcome of each session: degraded = error event, echoed = payload value above 1."""
    d = decisions(spark, sf_dir).select(
        "event_id", (F.col("event_type") == "error").alias("degraded"), (F.col("value") > 1.0).alias("echoed"))
    return D.session_outcomes(d).select("event_id", "success", F.col("reward").cast("double").alias("reward"),
                                        "success_count", "failure_count")


@register(
    "aggregate_sessions",
    _DEC + """SELECT isp_id, traffic_type, hour_bucket, transport, CAST(ts AS DATE) AS day,
      CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(failure_count) AS BIGINT) AS failure_count
      FROM decisions GROUP BY ALL""",
)
def q_aggregate_sessions(spark, sf_dir):
    """Daily success/failure sums per (isp, traffic type, hour, transport)."""
    return D.aggregate_sessions(decisions(spark, sf_dir), daily=True)


@register(
    "success_rate_by_context",
    _DEC + """, hist AS (SELECT isp_id, hour_bucket, traffic_type, sum(success_count) AS s, sum(failure_count) AS f
        FROM decisions GROUP BY ALL),
      ctx AS (SELECT DISTINCT isp_id, traffic_type FROM decisions),
      hrs AS (SELECT CAST(range AS INTEGER) AS hour_bucket FROM range(24))
      SELECT c.isp_id, h.hour_bucket, c.traffic_type,
        round(coalesce(CAST(s AS DOUBLE) / NULLIF(CAST(s + f AS DOUBLE), 0), 0.5), 6) AS historical_success_rate
      FROM ctx c CROSS JOIN hrs h LEFT JOIN hist ON hist.isp_id = c.isp_id AND hist.hour_bucket = h.hour_bucket
        AND hist.traffic_type = c.traffic_type""",
)
def q_success_rate_by_context(spark, sf_dir):
    return D.success_rate_by_context(decisions(spark, sf_dir))


def _arm_sum(t: str) -> str:
    return (f"coalesce(sum(CASE WHEN transport = '{t}' THEN CAST(reward AS DOUBLE) ELSE 0.0 END) OVER "
            "(PARTITION BY isp_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)")


@register(
    "choose_transport",
    _DEC + f""", sc AS (SELECT event_id, isp_id, transport, reward, 0.6 + {_arm_sum('quic')} AS score_quic,
        0.5 + {_arm_sum('webrtc')} AS score_webrtc, 0.2 + {_arm_sum('doh')} AS score_doh FROM decisions)
      SELECT event_id, isp_id, transport, reward, round(score_quic, 6) AS score_quic, round(score_webrtc, 6) AS score_webrtc,
        round(score_doh, 6) AS score_doh,
        CASE WHEN score_quic >= score_webrtc AND score_quic >= score_doh THEN 'quic'
             WHEN score_webrtc >= score_doh THEN 'webrtc' ELSE 'doh' END AS chosen_transport,
        round(greatest(score_quic, score_webrtc, score_doh), 6) AS chosen_score FROM sc""",
)
def q_choose_transport(spark, sf_dir):
    """Replay of the greedy bandit per agent over the decision log."""
    log = decisions(spark, sf_dir).select("event_id", "isp_id", "transport", "reward")
    return D.choose_transport(log)


@register(
    "recent_aggregates",
    _DEC + """SELECT event_id AS id, isp_id, traffic_type, hour_bucket, transport, success_count, failure_count
      FROM decisions ORDER BY event_id DESC LIMIT 20""",
)
def q_recent_aggregates(spark, sf_dir):
    """Newest 20 aggregates by id (the recent-list report)."""
    agg = decisions(spark, sf_dir).select(F.col("event_id").alias("id"), "isp_id", "traffic_type", "hour_bucket",
                                          "transport", "success_count", "failure_count")
    return D.recent_aggregates(agg, 20)


_INGEST_AT = _dt(2026, 1, 1)


def _incoming(spark, sf_dir):
    """Incoming aggregates; sign-up sessions report the transport in upper case (rejected)."""
    d = decisions(spark, sf_dir)
    bad = F.when(F.col("event_type") == "signup", F.upper("transport")).otherwise(F.col("transport"))
    return d.select("isp_id", "traffic_type", "hour_bucket", bad.alias("transport"), "success_count",
                    "failure_count", "event_id")


@register(
    "ingest_session_aggregates",
    _DEC + """SELECT isp_id, traffic_type, hour_bucket, transport, success_count, failure_count, event_id,
      TIMESTAMP '2026-01-01 00:00:00' AS created_at FROM decisions WHERE event_type <> 'signup'""",
)
def q_ingest_session_aggregates(spark, sf_dir):
    """Accepted rows of an ingest batch, stamped with the batch time."""
    accepted, _ = D.ingest_session_aggregates(_incoming(spark, sf_dir), created_at=_INGEST_AT)
    return accepted


# ------------------------------------------------------------------ §2.1 sources with SQL form

from netpulse.sources import io as IO  # noqa: E402


@register(
    "load_domains",
    O.with_ctes(*O.features_ctes(_W, keys=("domain",), rounded=True))
    + "SELECT * REPLACE (concat(domain, '::', session_id) AS session_id) FROM features",
)
def q_load_domains(spark, sf_dir):
    """A folder with a table for each domain, read in one scan; sessions become ``domain::session``."""
    folder = IO.fresh_folder(spark, "domains")
    bridge.sensor_raw(events(spark, sf_dir)).write.partitionBy("domain").parquet(folder)
    return IO.load_domains(spark, folder, _W)


# ------------------------------------------------------------------ §2.8 MLlib jobs (rows-only checks)

from netpulse.operators import ml as ML  # noqa: E402

def _fit_features(spark, sf_dir):
    return features(spark, sf_dir)


_RULE = "(packet_loss_ratio + rtt_cv + retransmission_ratio + reset_ratio) / 4.0"


@register("rule_score", O.with_ctes(*_DOMAIN_FEATURES) + f"""SELECT session_id, domain, window_start, label, round(p, 6) AS probability,
    p >= {ML.RULE_THRESHOLD} AS degraded FROM (SELECT *, CASE WHEN {_RULE} IS NULL THEN NULL ELSE least(greatest({_RULE}, 0.0), 1.0) END AS p FROM features)""")
def q_rule_score(spark, sf_dir):
    """Rule baseline on the window features: mean of four ratios, degraded at 0.7."""
    return ML.rule_score(features(spark, sf_dir)).select("session_id", "domain", "window_start", "label", "probability", "degraded")


@register("build_estimator")
def q_build_estimator(spark, sf_dir):
    """Fit every registry estimator once, at its full size, and score the training rows."""
    feats = materialize(features(spark, sf_dir))
    models = ML.side_by_side(spark, [lambda a=a: ML.fit_sensor_model(feats, a)[0] for a in ML.ALGORITHMS])
    parts = [ML.score(m, feats).withColumn("algorithm", F.lit(a)) for a, m in zip(ML.ALGORITHMS, models, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("calibrate_sigmoid")
def q_calibrate_sigmoid(spark, sf_dir):
    """Three-fold Platt scaling of a boosted model; calibrated scores of all rows."""
    feats = materialize(features(spark, sf_dir))
    model, _ = ML.fit_sensor_model(feats, "lightgbm_sigmoid")
    return ML.score(model, feats)


@register("train_sensor")
def q_train_sensor(spark, sf_dir):
    _, report, _ = ML.train_sensor(_fit_features(spark, sf_dir), "lightgbm")
    return report


@register("infer_sensor")
def q_infer_sensor(spark, sf_dir):
    """A model is trained, saved and loaded again, and scores raw rows that have no label."""
    model, _, meta = ML.train_sensor(_fit_features(spark, sf_dir), "logistic_regression")
    path = IO.fresh_folder(spark, "model")
    ML.save_model(model, path, meta)
    model, meta = ML.load_model(spark, path)
    raw = bridge.sensor_raw(events(spark, sf_dir)).drop("label")
    return ML.infer_sensor(model, windows.sensor_feature_frame(raw, _W, extra_keys=("domain",)), metadata=meta)


@register("train_sensor_multidomain")
def q_train_sensor_multidomain(spark, sf_dir):
    _, report, _ = ML.train_sensor_multidomain(_fit_features(spark, sf_dir), "random_forest")
    return report


_D0 = "(domain = 'd0')"


@register("evaluate_transfer")
def q_evaluate_transfer(spark, sf_dir):
    """Fit on domain d0, evaluate on the other domains."""
    feats = stored(_fit_features(spark, sf_dir))
    return ML.evaluate_transfer(feats.where(_D0), feats.where(f"NOT {_D0}"), "logistic_regression")


@register("evaluate_holdouts")
def q_evaluate_holdouts(spark, sf_dir):
    """Leave-one-domain-out over the three domains."""
    return ML.evaluate_holdouts(_fit_features(spark, sf_dir), "logistic_regression")


@register("compare_models")
def q_compare_models(spark, sf_dir):
    return ML.compare_models(_fit_features(spark, sf_dir))


@register("train_iat_forecaster")
def q_train_iat_forecaster(spark, sf_dir):
    _, report, _ = ML.train_iat_forecaster(iat(spark, sf_dir), _L)
    return report


@register("infer_iat_forecaster")
def q_infer_iat_forecaster(spark, sf_dir):
    gaps = iat(spark, sf_dir)
    model, _, meta = ML.train_iat_forecaster(gaps, _L)
    return ML.infer_iat_forecaster(model, gaps, meta)


# ------------------------------------------------------------------ §2.8 what a fit cannot change: splits, rows, classes, keys, flags

_POS = "CAST(count(*) FILTER (WHERE {0} AND label = 1) AS BIGINT)"


def _counted(train: str, held: str) -> str:
    """Row and class counts of a report's two sides, as SQL over one relation with ``label``."""
    return (f"count(*) FILTER (WHERE {held}) AS rows, CAST(count(*) FILTER (WHERE {held} AND label = 0) AS BIGINT) AS negatives, "
            f"{_POS.format(held)} AS positives, count(*) FILTER (WHERE {train}) AS train_rows, {_POS.format(train)} AS train_positive, "
            f"count(*) FILTER (WHERE {held}) AS eval_rows, {_POS.format(held)} AS eval_positive")


_REPORT_COUNTS = ("rows", "negatives", "positives", "train_rows", "train_positive", "eval_rows", "eval_positive")


def _meta_counts(report, meta):
    return report.withColumns({c: F.lit(meta[c]).cast("long") for c in _REPORT_COUNTS[3:]})


@register(
    "train_sensor_counts",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ()))
    + f"SELECT 'validation' AS scope, {_counted('NOT is_val', 'is_val')} FROM features f JOIN v ON f.session_id = v.session_id",
)
def q_train_sensor_counts(spark, sf_dir):
    """Rows and classes of both sides of a fit, as its report and metadata state them."""
    _, report, meta = ML.train_sensor(_fit_features(spark, sf_dir), "logistic_regression", _RATIO, _SEED)
    return _meta_counts(report, meta).select("scope", *_REPORT_COUNTS)


@register(
    "train_sensor_multidomain_counts",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ("domain",)), f"""sides AS (SELECT f.domain, f.label, v.is_val,
        row_number() OVER (PARTITION BY f.domain, v.is_val ORDER BY {_hash_sql(_SEED, 'f.session_id', 'f.window_start')}, f.session_id,
          f.window_start) - 1 AS i FROM features f JOIN v ON f.session_id = v.session_id AND f.domain = v.domain)""",
      "least_rows AS (SELECT min(c) AS target FROM (SELECT count(*) AS c FROM sides WHERE NOT is_val GROUP BY domain))",
      f"""all_rows AS (SELECT {_counted('NOT is_val AND i < target', 'is_val')} FROM sides, least_rows)""")
    + """SELECT domain, rows, negatives, positives, train_rows, train_positive, eval_rows, eval_positive FROM (
      SELECT '__pooled__' AS domain, rows, negatives, positives FROM all_rows
      UNION ALL SELECT domain, count(*), CAST(count(*) FILTER (WHERE label = 0) AS BIGINT), CAST(count(*) FILTER (WHERE label = 1) AS BIGINT)
      FROM sides WHERE is_val GROUP BY domain) r, (SELECT * EXCLUDE (rows, negatives, positives) FROM all_rows) a""",
)
def q_train_sensor_multidomain_counts(spark, sf_dir):
    """The balanced fit's rows and classes, and those of the pooled and of each domain's validation rows."""
    _, report, meta = ML.train_sensor_multidomain(_fit_features(spark, sf_dir), "logistic_regression", _RATIO, _SEED)
    return _meta_counts(report.where("domain <> '__macro__'"), meta).select("domain", *_REPORT_COUNTS)


@register(
    "evaluate_transfer_counts",
    O.with_ctes(*_DOMAIN_FEATURES) + f"SELECT 'target' AS scope, {_counted(_D0, 'NOT ' + _D0)} FROM features",
)
def q_evaluate_transfer_counts(spark, sf_dir):
    """Rows and classes of the fit's source and of its target."""
    return q_evaluate_transfer(spark, sf_dir).select("scope", *_REPORT_COUNTS)


@register(
    "evaluate_holdouts_counts",
    O.with_ctes(*_DOMAIN_FEATURES, f"""ranked AS (SELECT domain, label, row_number() OVER (PARTITION BY domain
        ORDER BY {_hash_sql(_SEED, 'session_id', 'window_start')}, session_id, window_start) - 1 AS i FROM features)""",
      "sizes AS (SELECT domain, count(*) AS c FROM features GROUP BY domain)",
      "holds AS (SELECT h.domain AS holdout, min(o.c) AS target FROM sizes h JOIN sizes o ON h.domain <> o.domain GROUP BY ALL)")
    + f"SELECT holdout, {_counted('domain <> holdout AND i < target', 'domain = holdout')} FROM ranked, holds GROUP BY holdout",
)
def q_evaluate_holdouts_counts(spark, sf_dir):
    """Each fold's balanced training rows and its held-out domain, with their classes."""
    return q_evaluate_holdouts(spark, sf_dir).where("holdout <> '__macro__'").select("holdout", *_REPORT_COUNTS)


@register(
    "compare_models_counts",
    O.with_ctes(*_DOMAIN_FEATURES, *O.split_ctes(_RATIO, _SEED, ()))
    + f"SELECT algorithm, {_counted('NOT is_val', 'is_val')} FROM features f JOIN v ON f.session_id = v.session_id, "
    f"(SELECT unnest({list(ML.ALGORITHMS)}) AS algorithm) GROUP BY algorithm",
)
def q_compare_models_counts(spark, sf_dir):
    """One split serves all compared estimators: a row for each, over the same rows."""
    out = ML.compare_models(_fit_features(spark, sf_dir), ML.ALGORITHMS, _RATIO, _SEED)
    return out.select("algorithm", *_REPORT_COUNTS)


@register(
    "infer_sensor_rows",
    O.with_ctes(*_DOMAIN_FEATURES) + "SELECT session_id, domain, window_start, TRUE AS is_probability, TRUE AS flag_follows FROM features",
)
def q_infer_sensor_rows(spark, sf_dir):
    """Every unlabelled window is scored once by the saved and loaded model, with a probability and the flag that follows from it."""
    out = q_infer_sensor(spark, sf_dir)
    return out.select("session_id", "domain", "window_start", F.col("probability").between(0.0, 1.0).alias("is_probability"),
                      (F.col("degraded") == (F.col("probability") >= F.lit(ML.MODEL_THRESHOLD))).alias("flag_follows"))


@register(
    "infer_iat_forecaster_rows",
    _SEQ_SQL + "SELECT trace_id, packet_index AS target_packet_index, round(actual_iat_ms, 6) AS actual_iat_ms, TRUE AS error_follows FROM seq",
)
def q_infer_iat_forecaster_rows(spark, sf_dir):
    """Every sample gets one forecast of its gap, and the error that follows from it."""
    out = q_infer_iat_forecaster(spark, sf_dir)
    error = F.abs(F.col("predicted_iat_ms") - F.col("actual_iat_ms"))
    return out.select("trace_id", "target_packet_index", "actual_iat_ms", (F.abs(F.col("abs_error_ms") - error) <= 2e-6).alias("error_follows"))


# ------------------------------------------------------------------ §2.10 streams (rows-only checks)

from netpulse.streaming import streams as ST  # noqa: E402

_DELAY = "1 hour"


def _events_stream(spark, sf_dir, max_files=None):
    return ST.stream_table(spark, sf_dir, "events", max_files_per_trigger=max_files)


def _stream_windows(spark, sf_dir) -> str:
    raw = bridge.sensor_raw(_events_stream(spark, sf_dir))
    return ST.run_available_now(ST.stream_window_features(raw, _W, _DELAY), name="windows")


@register("stream_window_features")
def q_stream_window_features(spark, sf_dir):
    """Window features of the event stream (append mode; windows closed by the watermark)."""
    return spark.read.parquet(_stream_windows(spark, sf_dir))


def _stream_baseline(spark, sf_dir) -> str:
    win_path = _stream_windows(spark, sf_dir)
    rows = spark.readStream.schema(spark.read.parquet(win_path).schema).parquet(win_path)
    return ST.run_available_now(ST.stream_session_baseline(rows, _DELAY), name="baseline")


@register("stream_session_baseline")
def q_stream_session_baseline(spark, sf_dir):
    """Session-relative features with first values held in per-session state."""
    return spark.read.parquet(_stream_baseline(spark, sf_dir))


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """Degraded windows (rule score >= 0.7) as a stateless stream over the feature stream."""
    path = _stream_baseline(spark, sf_dir)
    feats = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return spark.read.parquet(ST.run_available_now(ST.stream_alerts(feats, threshold=_T), name="alerts"))


@register("stream_alerts_model")
def q_stream_alerts_model(spark, sf_dir):
    """Alerts of a saved model: trained in batch, saved, loaded by the stream of feature rows, which have no label."""
    model, _, meta = ML.train_sensor(_fit_features(spark, sf_dir), "logistic_regression")
    saved = IO.fresh_folder(spark, "model")
    ML.save_model(model, saved, meta)
    model, meta = ML.load_model(spark, saved)
    path = _stream_baseline(spark, sf_dir)
    feats = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).drop("label")
    return spark.read.parquet(ST.run_available_now(ST.stream_alerts(feats, meta["threshold"], model), name="model-alerts"))


def _ping_lines(events_df):
    """Ping output text derived from events: errors are timeouts, others replies with RTT = value."""
    seq = F.col("event_id").cast("string")
    epoch = F.format_string("[%.6f] ", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    reply = F.concat(epoch, F.lit("64 bytes from 10.0.0.1: icmp_seq="), seq, F.lit(" ttl=57 time="),
                     F.format_string("%.3f", F.col("value")), F.lit(" ms"))
    timeout = F.concat(epoch, F.lit("no answer yet for icmp_seq="), seq)
    return events_df.select(F.when(F.col("event_type") == "error", timeout).otherwise(reply).alias("value"))


@register("stream_ping_rows")
def q_stream_ping_rows(spark, sf_dir):
    """Ping lines picked up as files arrive, parsed into probe rows."""
    src = ST.scratch(spark, "ping-src")
    _ping_lines(events(spark, sf_dir)).write.mode("overwrite").text(src)
    return spark.read.parquet(ST.run_available_now(ST.stream_ping_rows(spark, src), name="ping"))


@register("stream_ingest_aggregates")
def q_stream_ingest_aggregates(spark, sf_dir):
    """Aggregates ingested per micro-batch (validated, stamped, one folder per batch id)."""
    base = ST.scratch(spark, "ingest")
    incoming = bridge.decisions(_events_stream(spark, sf_dir)).select(
        "isp_id", "traffic_type", "hour_bucket",
        F.when(F.col("event_type") == "signup", F.upper("transport")).otherwise(F.col("transport")).alias("transport"),
        "success_count", "failure_count", "event_id")
    q = ST.stream_ingest_aggregates(incoming, f"{base}/store", f"{base}/_checkpoint", f"{base}/rejects")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/store").drop("created_at", "batch_id")


@register("stream_transport_scores")
def q_stream_transport_scores(spark, sf_dir):
    """Running bandit scores per (isp, transport): update mode into a table with a folder for each batch."""
    base = ST.scratch(spark, "scores")
    q = ST.stream_scores_to(bridge.decisions(_events_stream(spark, sf_dir)), f"{base}/scores", f"{base}/_checkpoint")
    q.awaitTermination()
    return ST.read_versioned(spark, f"{base}/scores")


@register(
    "parse_ping_log",
    """SELECT CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'reply' END AS event_type,
      round(CAST(epoch_us(ts) AS DOUBLE) / 1e6, 6) AS epoch, event_id AS icmp_seq, CAST(1 AS BIGINT) AS packets_sent,
      CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS packets_lost,
      CASE WHEN event_type = 'error' THEN CAST(0.0 AS DOUBLE) ELSE round(value, 3) END AS rtt_ms,
      CAST(0 AS BIGINT) AS retransmissions, CAST(0 AS BIGINT) AS resets FROM events""",
)
def q_parse_ping_log(spark, sf_dir):
    """Ping output lines (replies and timeouts derived from events) parsed back into probe rows."""
    return IO.parse_ping_log(_ping_lines(events(spark, sf_dir)))


_SENSOR_SCHEMA = ("session_id string, timestamp timestamp, packets_sent bigint, packets_lost bigint, rtt_ms double, "
                  "retransmissions bigint, resets int, label int")
_SENSOR_SQL = O.with_ctes(O.sensor_raw_cte()) + (
    "SELECT session_id, \"timestamp\", packets_sent, packets_lost, round(rtt_ms, 6) AS rtt_ms, retransmissions, "
    "resets, label FROM sensor_raw")


def _sensor_base(spark, sf_dir):
    return bridge.sensor_raw(events(spark, sf_dir)).select(*[f.split()[0] for f in _SENSOR_SCHEMA.split(", ")])


@register("read_table", _SENSOR_SQL)
def q_read_table(spark, sf_dir):
    """CSV round trip: write the sensor rows with a header, read them back with an explicit schema."""
    path = ST.scratch(spark, "table") + ".csv"
    IO.write_table(_sensor_base(spark, sf_dir), path)
    return IO.read_table(spark, path, _SENSOR_SCHEMA)


@register("write_table", _SENSOR_SQL)
def q_write_table(spark, sf_dir):
    """Parquet round trip of the sensor rows."""
    path = ST.scratch(spark, "table") + ".parquet"
    IO.write_table(_sensor_base(spark, sf_dir), path)
    return IO.read_table(spark, path)


@register("write_report")
def q_write_report(spark, sf_dir):
    """Per-domain report written as sorted-key JSON lines and read back as text."""
    path = ST.scratch(spark, "report")
    IO.write_report(M.metrics_by_domain(scores(spark, sf_dir), _T, ["domain"]), path)
    return spark.read.text(path)


@register("write_report_values", ORACLE["metrics_by_domain"])
def q_write_report_values(spark, sf_dir):
    """The report's JSON lines parsed again: every value of the report is in them."""
    report = M.metrics_by_domain(scores(spark, sf_dir), _T, ["domain"])
    path = ST.scratch(spark, "report")
    IO.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


def _manifest_rows(spark, sf_dir):
    """One manifest document per run found in the data, phases nested in listing order."""
    ev = events(spark, sf_dir)
    phases = bridge.phase_table(ev)
    nested = phases.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.col("phase_name").alias("name"), "start_offset_seconds",
        (F.col("end_offset_seconds") - F.col("start_offset_seconds")).alias("duration_seconds"),
        "label", "impairment_type", "severity"))).alias("_p"))
    runs = bridge.run_metadata(ev).join(nested, "run_id")
    return runs.select(
        F.lit(1).alias("schema_version"), "run_id", F.lit("2024-01-01T00:00:00Z").alias("created_at"), "domain",
        "application", "scenario", F.lit(_W).alias("window_seconds"),
        F.struct(F.lit("sensor_metrics_raw.csv").alias("raw_metrics")).alias("files"),
        F.transform("_p", lambda x: x.dropFields("pos")).alias("phases"),
    )


@register(
    "read_manifests",
    O.with_ctes(*O.experiment_ctes())
    + """SELECT run_id, CAST(pos AS INTEGER) AS pos, phase_name, start_offset_seconds, end_offset_seconds,
      CAST(label AS INTEGER) AS label, impairment_type, severity FROM phases""",
)
def q_read_manifests(spark, sf_dir):
    """Manifests of the runs written as JSON and parsed back into validated (run, phase) rows."""
    path = ST.scratch(spark, "manifests")
    _manifest_rows(spark, sf_dir).write.mode("overwrite").json(path)
    _, phases = IO.read_manifests(spark, path, multi_line=False)
    return phases


@register(
    "dataset_from_run_folders",
    O.with_ctes(*O.experiment_ctes())
    + f"SELECT {_EXP_OUT}, packets_sent, packets_lost, round(rtt_ms, 6) AS rtt_ms FROM labelled",
)
def q_dataset_from_run_folders(spark, sf_dir):
    """Run folders written from the data (a manifest and a folder of raw CSV files each), read in one scan and labelled."""
    root = IO.fresh_folder(spark, "runs")
    raw, _, _ = _experiment(spark, sf_dir)
    raw = raw.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    raw.withColumns({"run": F.col("run_id"), "kind": F.lit("raw")}).drop("run_id").write.partitionBy("run", "kind").option("header", True).csv(root)
    manifests = _manifest_rows(spark, sf_dir).withColumns({"run": F.col("run_id"), "files": F.struct(F.lit("kind=raw").alias("raw_metrics"))})
    manifests.write.mode("append").partitionBy("run").json(root)
    out = J.dataset_from_run_folders(spark, root, "run=*/*.json", strict_coverage=False, multi_line=False)
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("packets_sent", "packets_lost")})
    return out.select(*[c.strip('"') for c in _EXP_OUT.split(", ")], "packets_sent", "packets_lost", "rtt_ms")


def _arff_value(column):
    return F.concat(F.lit("'"), column, F.lit("'"))


@register(
    "read_arff",
    """SELECT concat('part=', CAST(event_id % 5 AS VARCHAR), '/flows') AS source,
      row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) - 1 AS _row, CAST(event_id AS VARCHAR) AS id,
      event_type AS kind, CASE WHEN event_id % 5 < 3 THEN CAST(user_id AS VARCHAR) END AS user FROM events""",
)
def q_read_arff(spark, sf_dir):
    """Five ARFF files of two layouts written from the events (header lines, then rows in id order) and read back."""
    folder = IO.fresh_folder(spark, "arff")
    ev = events(spark, sf_dir).select((F.col("event_id") % 5).alias("part"), "event_id", "event_type", "user_id")
    # one file's lines are one task's output, in order; a file's header comes before its rows
    head = spark.range(5).select(F.col("id").alias("part"), F.posexplode(F.when(F.col("id") < 3, F.array(*map(F.lit, (
        "@relation flows", "@attribute id numeric", "@attribute kind string", "@attribute user numeric", "@data")))).otherwise(F.array(*map(F.lit, (
            "% two columns, the other way round", "@relation flows", "@ATTRIBUTE 'kind' string", "@attribute id numeric", "", "@DATA"))))).alias("pos", "value"))
    body = F.when(F.col("part") < 3, F.concat_ws(",", F.col("event_id"), _arff_value(F.col("event_type")), F.col("user_id"))).otherwise(
        F.concat_ws(",", F.col("event_type"), F.col("event_id")))
    lines = head.select("part", (F.col("pos") - 10).cast("long").alias("at"), "value").unionByName(
        ev.select("part", F.col("event_id").alias("at"), body.alias("value")))
    lines.repartition(5, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(folder)
    out = IO.read_arff(spark, folder)
    # part files have random names: the folder tells them apart
    return out.withColumn("source", F.concat(F.regexp_extract("source", "(part=[0-9]+)", 1), F.lit("/flows"))).select("source", "_row", "id", "kind", "user")


@register(
    "read_packet_dump",
    """SELECT concat('trace=u', CAST(user_id AS VARCHAR)) AS trace_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS packet_index,
      round(CAST(epoch_us(ts) AS DOUBLE) / 1e6, 6) AS epoch FROM events""",
)
def q_read_packet_dump(spark, sf_dir):
    """Packet-dump text (epoch first, other tokens after), a folder for each trace, written from events and read back."""
    path = IO.fresh_folder(spark, "dump")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    line = F.format_string("%.6f IP 10.0.0.%d > 10.0.0.1: length %d", micros / F.lit(1e6), F.col("user_id") % 250, F.col("event_id"))
    rows = events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id")).alias("trace"), "ts", "event_id", line.alias("value"))
    # a task's time goes by its traces, each a folder to make, not by their bytes, by which adaptive execution would join tasks
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(tasks, "trace", "ts", "event_id").sortWithinPartitions("trace", "ts", "event_id")
    # tasks move their own folders in place: the driver would move them one by one
    rows.select("trace", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("trace").text(path)
    return IO.read_packet_dump(spark, path, by_folder=True).withColumn("epoch", F.round("epoch", 6))


# ------------------------------------------------------------------ oracles of the stream queries
# Append mode emits exactly the windows whose end is at or before max(ts) - delay.

_CLOSED = f"window_start + INTERVAL {_W} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
ORACLE["stream_window_features"] = (
    O.with_ctes(O.sensor_raw_cte(), O.window_agg_cte("sensor_raw", _W), O.window_features_cte("win", _W))
    + f"SELECT {_WF_COLS} FROM feat WHERE {_CLOSED}"
)
_BASE_COLS = "session_id, window_start, " + ", ".join(f"round({c}, 6) AS {c}" for c in windows.FEATURE_COLUMNS) + ", label"
ORACLE["stream_session_baseline"] = (
    O.with_ctes(*O.features_ctes(_W)) + f"SELECT {_BASE_COLS} FROM features WHERE {_CLOSED}"
)
ORACLE["stream_alerts"] = (
    O.with_ctes(*O.features_ctes(_W))
    + f"""SELECT {_BASE_COLS}, round(p, 6) AS probability, p >= {_T} AS degraded FROM (
      SELECT *, least(greatest((packet_loss_ratio + rtt_cv + retransmission_ratio + reset_ratio) / 4.0, 0.0), 1.0) AS p
      FROM features WHERE {_CLOSED}) WHERE p >= {_T}"""
)
ORACLE["stream_ping_rows"] = (
    """SELECT CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'reply' END AS event_type,
      round(CAST(epoch_us(ts) AS DOUBLE) / 1e6, 6) AS epoch, event_id AS icmp_seq, CAST(1 AS BIGINT) AS packets_sent,
      CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS packets_lost,
      CASE WHEN event_type = 'error' THEN CAST(0.0 AS DOUBLE) ELSE round(value, 3) END AS rtt_ms,
      CAST(0 AS BIGINT) AS retransmissions, CAST(0 AS BIGINT) AS resets,
      make_timestamp(CAST(trunc(CAST(round(CAST(epoch_us(ts) AS DOUBLE) / 1e6, 6) AS VARCHAR)::DOUBLE * 1e6) AS BIGINT))
        AS "timestamp" FROM events"""
)
ORACLE["stream_ingest_aggregates"] = (
    _DEC + """SELECT isp_id, traffic_type, hour_bucket, transport, success_count, failure_count, event_id
      FROM decisions WHERE event_type <> 'signup'"""
)
ORACLE["stream_transport_scores"] = (
    _DEC + """SELECT isp_id, transport, round(sum(CAST(reward AS DOUBLE)), 6) AS reward_sum, count(*) AS decisions,
      round(CASE transport WHEN 'quic' THEN 0.6 WHEN 'webrtc' THEN 0.5 WHEN 'doh' THEN 0.2 ELSE 0.0 END
        + sum(CAST(reward AS DOUBLE)), 6) AS score FROM decisions GROUP BY isp_id, transport"""
)
