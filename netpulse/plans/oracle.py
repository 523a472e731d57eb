"""DuckDB forms of the bridge views and operators (the correctness oracle).

Each ``*_cte`` returns a ``name AS (...)`` fragment over the driver's
pre-registered views; ``with_ctes`` chains them. Notes on dialect gaps:
DuckDB sums of BIGINT are HUGEINT (cast back), ``cast(double as bigint)``
rounds (``trunc`` first), plain INT multiply overflows in the window floor.
"""

from __future__ import annotations

from netpulse.operators.windows import BASELINE_FEATURES, FEATURE_COLUMNS, OPTIONAL_COLUMN_AGGREGATES

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def sensor_raw_cte(name: str = "sensor_raw") -> str:
    return f"""{name} AS (
  SELECT concat('u', CAST(user_id AS VARCHAR)) AS session_id, ts AS "timestamp",
    CAST(floor(value) AS BIGINT) + 1 AS packets_sent, k % 10 AS packets_lost, value + 1.0 AS rtt_ms,
    k % 4 AS retransmissions,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS resets,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    value * 10.0 AS flow_duration_ms, value / 2.0 AS flow_packets_per_second, value * 50.0 AS flow_bytes_per_second,
    40.0 + CAST(k AS DOUBLE) AS average_packet_size, 50.0 + CAST(k AS DOUBLE) AS packet_length_mean,
    5.0 + CAST(k % 7 AS DOUBLE) AS packet_length_std,
    CAST(k % 9 AS DOUBLE) AS fwd_packet_count, CAST(k % 5 AS DOUBLE) AS bwd_packet_count,
    CAST(k * 100 AS DOUBLE) AS fwd_byte_count, CAST(k * 60 AS DOUBLE) AS bwd_byte_count,
    CAST(k % 5 AS DOUBLE) / 4.0 AS down_up_ratio, value * 1000.0 AS flow_iat_mean_us,
    value * 100.0 AS flow_iat_std_us, value * 20.0 AS active_mean_us, value * 8.0 + 1.0 AS idle_mean_us,
    CAST(k % 2 AS DOUBLE) AS syn_flag_count, CAST(k % 11 AS DOUBLE) AS ack_flag_count,
    CAST(k % 3 AS DOUBLE) AS psh_flag_count,
    concat('d', CAST(user_id % 3 AS VARCHAR)) AS domain
  FROM (SELECT *, {K} AS k FROM events) e)"""


def window_start_sql(ts: str, seconds: int) -> str:
    w = f"({int(seconds)} * 1000000::BIGINT)"
    return f"make_timestamp((epoch_us({ts}) // {w}) * {w})"


def window_agg_cte(src: str, seconds: int, keys: tuple[str, ...] = (), name: str = "win") -> str:
    key_sql = "".join(f"{k}, " for k in keys)
    opt = []
    for c, how in OPTIONAL_COLUMN_AGGREGATES.items():
        opt.append(f"{'avg' if how == 'mean' else 'sum'}(CAST({c} AS DOUBLE)) AS {c}")
    return f"""{name} AS (
  SELECT session_id, {key_sql}{window_start_sql('"timestamp"', seconds)} AS window_start,
    CAST(coalesce(sum(packets_sent), 0) AS BIGINT) AS packets_sent,
    CAST(coalesce(sum(packets_lost), 0) AS BIGINT) AS packets_lost,
    CAST(coalesce(sum(retransmissions), 0) AS BIGINT) AS retransmissions,
    CAST(coalesce(sum(resets), 0) AS BIGINT) AS resets,
    avg(rtt_ms) AS rtt_mean, coalesce(stddev_samp(rtt_ms), 0.0) AS rtt_std,
    count("timestamp") AS sample_count, max(label) AS label,
    {", ".join(opt)}
  FROM {src} WHERE session_id IS NOT NULL AND "timestamp" IS NOT NULL
  GROUP BY ALL)"""


def window_features_cte(src: str, seconds: int, keys: tuple[str, ...] = (), name: str = "feat") -> str:
    key_sql = "".join(f"{k}, " for k in keys)
    tot = "CAST(greatest(packets_sent + packets_lost, 1) AS DOUBLE)"
    sec = float(max(int(seconds), 1))

    def o(c: str) -> str:
        return f"coalesce({c}, 0.0)"

    exprs = {
        "packet_loss_ratio": f"CAST(packets_lost AS DOUBLE) / {tot}",
        "packets_per_second": f"{tot} / {sec}",
        "packets_total_log1p": f"ln(1 + {tot})",
        "packets_lost_log1p": "ln(1 + CAST(packets_lost AS DOUBLE))",
        "rtt_mean_ms": "CAST(rtt_mean AS DOUBLE)",
        "rtt_cv": "rtt_std / CASE WHEN rtt_mean IS NULL THEN NULL ELSE greatest(rtt_mean, 1e-6) END",
        "retransmission_ratio": f"CAST(retransmissions AS DOUBLE) / {tot}",
        "retransmissions_log1p": "ln(1 + CAST(retransmissions AS DOUBLE))",
        "reset_ratio": "CAST(resets AS DOUBLE) / CAST(greatest(sample_count, 1) AS DOUBLE)",
        "sample_count": "CAST(sample_count AS DOUBLE)",
        "flow_duration_ms": o("flow_duration_ms"),
        "flow_packets_per_second": o("flow_packets_per_second"),
        "flow_bytes_per_second": o("flow_bytes_per_second"),
        "average_packet_size": o("average_packet_size"),
        "packet_length_cv": f"{o('packet_length_std')} / greatest({o('packet_length_mean')}, 1e-6)",
        "fwd_backward_packet_ratio": f"{o('fwd_packet_count')} / greatest({o('bwd_packet_count')}, 1.0)",
        "fwd_backward_byte_ratio": f"{o('fwd_byte_count')} / greatest({o('bwd_byte_count')}, 1.0)",
        "down_up_ratio": o("down_up_ratio"),
        "flow_iat_cv": f"{o('flow_iat_std_us')} / greatest({o('flow_iat_mean_us')}, 1.0)",
        "active_idle_ratio": f"{o('active_mean_us')} / greatest({o('idle_mean_us')}, 1.0)",
        "syn_flag_ratio": f"{o('syn_flag_count')} / {tot}",
        "ack_flag_ratio": f"{o('ack_flag_count')} / {tot}",
        "psh_flag_ratio": f"{o('psh_flag_count')} / {tot}",
    }
    body = ",\n    ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"""{name} AS (
  SELECT session_id, {key_sql}window_start,
    {body},
    label
  FROM {src})"""


_BASE_OUT = {
    "packet_loss_ratio": "packet_loss_ratio_delta",
    "rtt_mean_ms": "rtt_mean_ratio_to_session_start",
    "packets_per_second": "packets_per_second_ratio_to_session_start",
    "retransmission_ratio": "retransmission_ratio_delta",
    "flow_bytes_per_second": "flow_bytes_per_second_ratio_to_session_start",
    "flow_iat_cv": "flow_iat_cv_delta",
    "active_idle_ratio": "active_idle_ratio_to_session_start",
}


def baseline_cte(src: str, keys: tuple[str, ...] = (), name: str = "features", rounded: bool = False) -> str:
    """Session baseline features; output columns in the feature-frame order."""
    starts = ", ".join(f"arg_min({c}, window_start) AS s_{c}" for c in BASELINE_FEATURES)
    derived = {}
    for c, (kind, floor) in BASELINE_FEATURES.items():
        if kind == "delta":
            derived[_BASE_OUT[c]] = f"f.{c} - s.s_{c}"
        else:
            derived[_BASE_OUT[c]] = f"f.{c} / CASE WHEN s.s_{c} IS NULL THEN NULL ELSE greatest(s.s_{c}, {floor}) END"
    cols = []
    for c in FEATURE_COLUMNS:
        e = derived.get(c, f"f.{c}")
        cols.append(r6(e, c) if rounded else f"{e} AS {c}")
    key_sql = "".join(f"f.{k}, " for k in keys)
    return f"""{name} AS (
  SELECT f.session_id, {key_sql}f.window_start,
    {", ".join(cols)},
    f.label
  FROM {src} f JOIN (SELECT session_id, {starts} FROM {src} GROUP BY session_id) s
    ON f.session_id = s.session_id)"""


def features_ctes(seconds: int, keys: tuple[str, ...] = (), rounded: bool = False, raw: str = "sensor_raw") -> list[str]:
    """sensor_raw -> win -> feat -> features."""
    out = []
    if raw == "sensor_raw":
        out.append(sensor_raw_cte())
    out += [
        window_agg_cte(raw, seconds, keys),
        window_features_cte("win", seconds, keys),
        baseline_cte("feat", keys, rounded=rounded),
    ]
    return out


# ------------------------------------------------------------------ scores and metrics


def scores_cte(variation: str = "rtt_cv", src: str = "features", name: str = "scores", extra: str = "") -> str:
    score = f"(packet_loss_ratio + {variation} + retransmission_ratio + reset_ratio) / 4.0"
    return f"""{name} AS (
  SELECT session_id, domain, window_start, label{extra},
    round(CASE WHEN {score} IS NULL THEN NULL ELSE least(greatest({score}, 0.0), 1.0) END, 6) AS probability
  FROM {src})"""


def scores_ctes(seconds: int) -> list[str]:
    return [*features_ctes(seconds, keys=("domain",)), scores_cte()]


def ratio_sql(rounded: bool = True) -> str:
    def d(a: str, b: str) -> str:
        return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"

    cols = {
        "accuracy": d("tp + tn", "tp + fp + fn + tn"),
        "precision": d("tp", "tp + fp"),
        "recall": d("tp", "tp + fn"),
        "f1": d("2 * tp", "2 * tp + fp + fn"),
        "positive_rate": d("tp + fp", "tp + fp + fn + tn"),
    }
    return ", ".join(r6(e, n) if rounded else f"{e} AS {n}" for n, e in cols.items())


def cm_select(pred: str) -> str:
    return (
        f"CAST(sum(CASE WHEN label = 1 AND {pred} THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
        f"CAST(sum(CASE WHEN label <> 1 AND {pred} THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
        f"CAST(sum(CASE WHEN label = 1 AND NOT ({pred}) THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
        f"CAST(sum(CASE WHEN label <> 1 AND NOT ({pred}) THEN 1 ELSE 0 END) AS BIGINT) AS tn"
    )


def ranking_ctes(src: str, keys: tuple[str, ...], name: str = "ranking") -> list[str]:
    ks = ", ".join(keys)
    kc = f"{ks}, " if keys else ""
    part = f"PARTITION BY {ks} " if keys else ""
    join = " AND ".join(f"c.{k} = t.{k}" for k in keys) or "TRUE"
    return [
        f"""{name}_s AS (SELECT {kc}probability, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
            sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY ALL)""",
        f"""{name}_c AS (SELECT *, coalesce(sum(neg) OVER w, 0) AS nb, coalesce(sum(pos) OVER w, 0) AS pb FROM {name}_s
            WINDOW w AS ({part}ORDER BY probability ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        f"""{name}_t AS (SELECT {kc}CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM {name}_s GROUP BY ALL)""",
        f"""{name} AS (SELECT {", ".join(f"c.{k}" for k in keys)}{", " if keys else ""}
            CASE WHEN max(t.P) > 0 AND max(t.N) > 0 THEN sum(c.pos * (c.nb + c.neg / 2.0)) / (max(t.P) * max(t.N)) END AS roc_auc,
            CASE WHEN max(t.P) > 0 AND max(t.N) > 0 THEN
              sum(CASE WHEN c.pos > 0 THEN c.pos * (t.P - c.pb) / ((t.P - c.pb) + (t.N - c.nb)) ELSE 0.0 END) / max(t.P) END
              AS average_precision
            FROM {name}_c c JOIN {name}_t t ON {join} {"GROUP BY " + ", ".join(f"c.{k}" for k in keys) if keys else ""})""",
    ]


def thresholds_cte(name: str = "th") -> str:
    return f"{name} AS (SELECT i, 0.05::DOUBLE + CAST(i AS DOUBLE) * 0.05::DOUBLE AS threshold FROM range(19) r(i))"


def sweep_cte(src: str, keys: tuple[str, ...], name: str = "sweep") -> str:
    kc = "".join(f"{k}, " for k in keys)
    return f"""{name} AS (SELECT {kc}threshold, {ratio_sql(rounded=False)}, tn, fp, fn, tp FROM (
      SELECT {kc}threshold, {cm_select("probability >= threshold")} FROM {src} CROSS JOIN th GROUP BY ALL) x)"""


def best_cte(src: str, keys: tuple[str, ...], name: str = "best") -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, recall DESC,
      precision DESC, threshold ASC) AS rn FROM {src}) WHERE rn = 1)"""


def summary_select(keys: tuple[str, ...], src: str) -> str:
    kc = "".join(f"{k}, " for k in keys)
    gb = f" GROUP BY {', '.join(keys)}" if keys else ""
    qs = ", ".join(f"coalesce(quantile_cont(probability, {q}), 0.0) AS {n}" for n, q in
                   (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)))
    return (f"SELECT {kc}coalesce(min(probability), 0.0) AS min, {qs}, coalesce(max(probability), 0.0) AS max "
            f"FROM {src}{gb}")


# ------------------------------------------------------------------ flow tables


def num(x: str) -> str:
    """Lenient parse: bad text / NULL / NaN -> 0.0, infinities kept."""
    t = f"TRY_CAST({x} AS DOUBLE)"
    return f"(CASE WHEN {t} IS NULL OR isnan({t}) THEN 0.0 ELSE {t} END)"


def zinf(e: str) -> str:
    return f"(CASE WHEN isinf({e}) THEN 0.0 ELSE {e} END)"


def flows_raw_cte(name: str = "flows_raw") -> str:
    v = "CAST(value AS DOUBLE)"
    return f"""{name} AS (
  SELECT event_id, concat('f', CAST(user_id % 2 AS VARCHAR)) AS source,
    concat(' ', CASE WHEN event_type = 'error' THEN 'PortScan' ELSE 'benign ' END) AS "Label",
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS "Total Fwd Packets",
    CASE WHEN k % 13 = 0 THEN 'n/a' ELSE CAST(k % 5 AS VARCHAR) END AS "Total Backward Packets",
    CAST(k % 3 AS VARCHAR) AS "RST Flag Count",
    CAST({v} * 1000.0 AS VARCHAR) AS "Flow IAT Mean",
    CASE WHEN k % 10 = 0 THEN 'Infinity' ELSE CAST({v} * 2.0 AS VARCHAR) END AS "Flow Packets/s",
    CAST(CAST(floor(value / 2.0) AS BIGINT) AS VARCHAR) AS act_data_pkt_fwd,
    CAST(k * 100 AS VARCHAR) AS "Total Length of Fwd Packets",
    CAST(k * 60 AS VARCHAR) AS "Total Length of Bwd Packets",
    CAST({v} * 10000.0 AS VARCHAR) AS " Flow Duration",
    CASE WHEN k % 17 = 0 THEN '-Infinity' ELSE CAST({v} * 50.0 AS VARCHAR) END AS "Flow Bytes/s",
    CAST({v} * 100.0 AS VARCHAR) AS "Flow IAT Std",
    CASE WHEN user_id % 2 = 1 THEN '0' ELSE CAST(k + 50 AS VARCHAR) END AS "Packet Length Mean",
    CAST(k % 7 + 5 AS VARCHAR) AS "Packet Length Std",
    CAST(k + 40 AS VARCHAR) AS "Average Packet Size",
    CASE WHEN k % 19 = 0 THEN 'NaN' ELSE CAST(CAST(k % 5 AS DOUBLE) / 4.0 AS VARCHAR) END AS "Down/Up Ratio",
    CAST(k % 2 AS VARCHAR) AS "SYN Flag Count", CAST(k % 11 AS VARCHAR) AS "ACK Flag Count",
    CAST(k % 3 AS VARCHAR) AS "PSH Flag Count",
    CAST({v} * 20.0 AS VARCHAR) AS "Active Mean", CAST({v} * 8.0 + 1.0 AS VARCHAR) AS "Idle Mean"
  FROM (SELECT *, {K} AS k FROM events) e)"""


ROW_BASE_EPOCH = 1775433600  # 2026-04-06T00:00:00Z


def row_id_sql(source: str = "source", i: str = "i") -> str:
    return (f"printf('%s-%09d', {source}, {i}) AS session_id, "
            f"make_timestamp((CAST({ROW_BASE_EPOCH} AS BIGINT) + {i}) * 1000000) AS \"timestamp\"")


def to_long(e: str) -> str:
    return f"TRY_CAST(trunc({e}) AS BIGINT)"


SENSOR_OUT = ["packets_sent", "packets_lost", "rtt_ms", "retransmissions", "resets", *OPTIONAL_COLUMN_AGGREGATES]


def sensor_out_sql(values: dict[str, str], label: str) -> str:
    cols = []
    for c in SENSOR_OUT:
        e = values[c]
        if c in ("packets_sent", "packets_lost", "retransmissions", "resets"):
            cols.append(f"{to_long(e)} AS {c}")
        else:
            cols.append(f"round(CAST({e} AS DOUBLE), 6) AS {c}")
    cols.append(f"CAST({label} AS INTEGER) AS label")
    return ", ".join(cols)


def cic_sql() -> str:
    def n(h: str, zero_inf: bool = False) -> str:
        e = num(f'"{h}"')
        return f"greatest({zinf(e) if zero_inf else e}, 0.0)"

    fwd, bwd = n("Total Fwd Packets"), n("Total Backward Packets")
    total = f"greatest({fwd} + {bwd}, 1.0)"
    rst, iat = n("RST Flag Count"), n("Flow IAT Mean")
    values = {
        "packets_sent": total, "packets_lost": f"least({rst}, {total})",
        "rtt_ms": f"greatest({iat} / 1000.0, 1.0)",
        "retransmissions": f"greatest({fwd} - {n('act_data_pkt_fwd')}, 0.0)", "resets": rst,
        "flow_duration_ms": f"{n('Flow Duration')} / 1000.0",
        "flow_packets_per_second": n("Flow Packets/s", True), "flow_bytes_per_second": n("Flow Bytes/s", True),
        "average_packet_size": n("Average Packet Size"), "packet_length_mean": n("Packet Length Mean"),
        "packet_length_std": n("Packet Length Std"), "fwd_packet_count": fwd, "bwd_packet_count": bwd,
        "fwd_byte_count": n("Total Length of Fwd Packets"), "bwd_byte_count": n("Total Length of Bwd Packets"),
        "down_up_ratio": n("Down/Up Ratio", True), "flow_iat_mean_us": iat, "flow_iat_std_us": n("Flow IAT Std"),
        "active_mean_us": n("Active Mean"), "idle_mean_us": n("Idle Mean"), "syn_flag_count": n("SYN Flag Count"),
        "ack_flag_count": n("ACK Flag Count"), "psh_flag_count": n("PSH Flag Count"),
    }
    label = "CASE WHEN upper(trim(coalesce(\"Label\", 'nan'))) <> 'BENIGN' THEN 1 ELSE 0 END"
    return with_ctes(
        flows_raw_cte(),
        """fr AS (SELECT * RENAME (" Flow Duration" AS "Flow Duration"),
             row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS i FROM flows_raw)""",
    ) + f"SELECT {row_id_sql()}, {sensor_out_sql(values, label)} FROM fr"


def label_numeric_ok(t: str) -> str:
    v = f"TRY_CAST({t} AS DOUBLE)"
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND NOT isinf({v}) AND TRY_CAST(trunc({v}) AS BIGINT) IN (0, 1))"


def label_pattern_sql(t: str, ok: str, pattern: str) -> str:
    p = pattern.strip().lower()
    text = f"(CASE WHEN contains(lower({t}), '{p}') AND NOT contains(lower({t}), 'non{p}') THEN 1 ELSE 0 END)" if p else "0"
    return f"(CASE WHEN {ok} THEN TRY_CAST(trunc(TRY_CAST({t} AS DOUBLE)) AS BIGINT) ELSE {text} END)"


def app_flow_ctes(src: str = "flows_raw") -> list[str]:
    """Resolution + per-source fallbacks for the canonicalized bridge flows (fixture-specific aliases)."""
    return [
        f"""vf AS (SELECT event_id, source, coalesce("Label", 'nan') AS label_text,
            {num('"Total Fwd Packets"')} AS fwd0, {num('"Total Backward Packets"')} AS bwd,
            {num('"Total Length of Fwd Packets"')} AS total_fwd_bytes, {num('"Total Length of Bwd Packets"')} AS total_bwd_bytes,
            {num('"RST Flag Count"')} AS rst, {num('"SYN Flag Count"')} AS syn_flag_count,
            {num('"ACK Flag Count"')} AS ack_flag_count, {num('"PSH Flag Count"')} AS psh_flag_count,
            {num('" Flow Duration"')} AS dur_us, {num('"Flow Packets/s"')} AS flow_packets_per_second,
            {num('"Flow Bytes/s"')} AS flow_bytes_per_second, {num('"Flow IAT Mean"')} AS iat_us,
            {num('"Flow IAT Std"')} AS iat_std_us, {num('"Average Packet Size"')} AS average_packet_size,
            {num('"Packet Length Mean"')} AS pl_mean, {num('"Packet Length Std"')} AS packet_length_std,
            {num('"Down/Up Ratio"')} AS down_up_ratio, {num('"Active Mean"')} AS active_mean_us,
            {num('"Idle Mean"')} AS idle_mean_us, {num('act_data_pkt_fwd')} AS act_data
          FROM {src})""",
        f"""vflags AS (SELECT source, bool_and(fwd0 = 0) AS zf, bool_and(bwd = 0) AS zb,
            bool_and(iat_std_us = 0) AS zstd, bool_and(pl_mean = 0) AS zpl,
            bool_and({label_numeric_ok('label_text')}) AS lnum FROM vf GROUP BY source)""",
        """vres AS (SELECT vf.*, f.lnum AS labels_numeric,
            CASE WHEN f.zf AND f.zb THEN 0.0 ELSE fwd0 END AS total_fwd_packets,
            bwd AS total_bwd_packets, dur_us / 1000.0 AS flow_duration_ms, iat_us / 1000.0 AS flow_iat_mean_ms,
            CASE WHEN f.zstd THEN 0.0 * 1000.0 ELSE iat_std_us END AS flow_iat_std_us,
            greatest((CASE WHEN f.zf AND f.zb THEN 0.0 ELSE fwd0 END) - act_data, 0.0) AS retransmissions,
            CASE WHEN f.zpl THEN average_packet_size ELSE pl_mean END AS packet_length_mean,
            row_number() OVER (PARTITION BY vf.source ORDER BY vf.event_id) - 1 AS i
          FROM vf JOIN vflags f ON vf.source = f.source)""",
    ]


def app_flows_sql(pattern: str) -> str:
    c0 = lambda e: f"greatest({e}, 0.0)"
    total = "greatest(total_fwd_packets + total_bwd_packets, 1.0)"
    values = {
        "packets_sent": total, "packets_lost": f"least({c0('rst')}, {total})",
        "rtt_ms": "greatest(flow_iat_mean_ms, 1.0)", "retransmissions": c0("retransmissions"), "resets": c0("rst"),
        "flow_duration_ms": c0("flow_duration_ms"), "flow_packets_per_second": c0("flow_packets_per_second"),
        "flow_bytes_per_second": c0("flow_bytes_per_second"), "average_packet_size": c0("average_packet_size"),
        "packet_length_mean": c0("packet_length_mean"), "packet_length_std": c0("packet_length_std"),
        "fwd_packet_count": c0("total_fwd_packets"), "bwd_packet_count": c0("total_bwd_packets"),
        "fwd_byte_count": c0("total_fwd_bytes"), "bwd_byte_count": c0("total_bwd_bytes"),
        "down_up_ratio": c0("down_up_ratio"), "flow_iat_mean_us": c0("flow_iat_mean_ms * 1000.0"),
        "flow_iat_std_us": c0("flow_iat_std_us"), "active_mean_us": c0("active_mean_us"),
        "idle_mean_us": c0("idle_mean_us"), "syn_flag_count": c0("syn_flag_count"),
        "ack_flag_count": c0("ack_flag_count"), "psh_flag_count": c0("psh_flag_count"),
    }
    label = label_pattern_sql("label_text", "labels_numeric", pattern)
    return with_ctes(flows_raw_cte(), *app_flow_ctes()) + f"SELECT {row_id_sql()}, {sensor_out_sql(values, label)} FROM vres"


# ------------------------------------------------------------------ sampling


def split_ctes(ratio: float, seed: int, keys: tuple[str, ...], src: str = "features") -> list[str]:
    """Session split (quota rules of operators.sampling); yields CTE ``v(keys, session_id, is_val)``."""
    r = f"CAST({ratio!r} AS DOUBLE)"
    kc = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    part_l = f"PARTITION BY {', '.join([*keys, 'label'])} "
    on = " AND ".join([f"cnt.{k} = tot.{k}" for k in keys]) or "TRUE"
    von = " AND ".join([f"r.{k} = q2.{k}" for k in keys] + ["r.label = q2.label"])
    return [
        f"""sl AS (SELECT {kc}session_id, max(label) AS label, md5(concat('{seed}', ':', session_id)) AS h
            FROM {src} GROUP BY ALL)""",
        f"cnt AS (SELECT {kc}label, count(*) AS c FROM sl GROUP BY ALL)",
        f"tot AS (SELECT {kc}sum(c) AS n, count(*) AS k FROM cnt {'GROUP BY ' + ', '.join(keys) if keys else ''})",
        f"""q0 AS (SELECT {''.join(f'cnt.{k}, ' for k in keys)}cnt.label, cnt.c, tot.n, tot.k,
            ceil({r} * CAST(tot.n AS DOUBLE)) AS n_test,
            (tot.k >= 2 AND greatest(1.0, round_even({r} * CAST(tot.n AS DOUBLE), 0)) >= tot.k) AS strat,
            CAST(cnt.c AS DOUBLE) / CAST(tot.n AS DOUBLE) * ceil({r} * CAST(tot.n AS DOUBLE)) AS cont
            FROM cnt JOIN tot ON {on})""",
        "q1 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM q0)",
        f"""q2 AS (SELECT {kc}label, strat, n_test, n, CASE WHEN c < 2 THEN 0 ELSE fl + CASE WHEN
            row_number() OVER ({part}ORDER BY rem DESC, label ASC) <= n_test - sum(fl) OVER ({part.strip()}) THEN 1 ELSE 0 END
            END AS quota FROM q1)""",
        f"""rr AS (SELECT sl.*, row_number() OVER ({part_l}ORDER BY h, session_id) - 1 AS il,
            row_number() OVER ({part}ORDER BY h, session_id) - 1 AS ia FROM sl)""",
        f"""v AS (SELECT {''.join(f'r.{k}, ' for k in keys)}r.session_id, (q2.n >= 2 AND {ratio} > 0 AND
            CASE WHEN q2.strat THEN r.il < q2.quota ELSE r.ia < q2.n_test END) AS is_val
            FROM rr r JOIN q2 ON {von})""",
    ]


def experiment_ctes() -> list[str]:
    return [
        sensor_raw_cte(),
        """er AS (SELECT concat('r', substr(domain, 2)) AS run_id, * EXCLUDE (label, domain) FROM sensor_raw)""",
        """runs AS (SELECT DISTINCT concat('r', CAST(user_id % 3 AS VARCHAR)) AS run_id,
            concat('d', CAST(user_id % 3 AS VARCHAR)) AS domain, 'browser' AS application, 'loss-ramp' AS scenario
            FROM events)""",
        """phases AS (SELECT r.run_id, p.* FROM runs r CROSS JOIN (VALUES
            (0, 'baseline', 0.0::DOUBLE, 950400.0::DOUBLE, 0, 'none', 'none'),
            (1, 'impairment', 864000.0::DOUBLE, 1814400.0::DOUBLE, 1, 'loss', 'severe'))
            p(pos, phase_name, start_offset_seconds, end_offset_seconds, label, impairment_type, severity))""",
        """starts AS (SELECT run_id, min("timestamp") AS cs FROM er GROUP BY run_id)""",
        """ex AS (SELECT er.*, CAST(epoch_us(er."timestamp") - epoch_us(s.cs) AS DOUBLE) / 1e6 AS off
            FROM er JOIN starts s ON er.run_id = s.run_id)""",
        """ey AS (SELECT ex.*, (SELECT max(p.pos) FROM phases p WHERE p.run_id = ex.run_id
            AND ex.off >= p.start_offset_seconds AND ex.off < p.end_offset_seconds) AS hit FROM ex)""",
        """labelled AS (SELECT ey.*, ru.domain, ru.application, ru.scenario,
            coalesce(p.phase_name, 'unlabeled') AS phase_name, coalesce(p.impairment_type, 'unlabeled') AS impairment_type,
            coalesce(p.severity, 'none') AS severity, round(ey.off, 6) AS capture_offset_seconds,
            CAST(coalesce(p.label, 0) AS INTEGER) AS label, p.pos IS NOT NULL AS covered
            FROM ey LEFT JOIN phases p ON p.run_id = ey.run_id AND p.pos = ey.hit
            LEFT JOIN runs ru ON ru.run_id = ey.run_id)""",
    ]


# ------------------------------------------------------------------ sequences


def packets_cte() -> str:
    return """packets AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS trace_id, event_id AS packet_index,
        ts AS "timestamp" FROM events)"""


def iat_ctes(max_iat_ms: float) -> list[str]:
    return [
        packets_cte(),
        f"""iat AS (SELECT trace_id, packet_index, iat_ms FROM (
            SELECT trace_id, packet_index, CAST(epoch_us("timestamp") - lag(epoch_us("timestamp"))
              OVER (PARTITION BY trace_id ORDER BY packet_index) AS DOUBLE) / 1000.0 AS iat_ms FROM packets)
            WHERE iat_ms > 0 AND iat_ms <= {float(max_iat_ms)})""",
        """stats AS (SELECT avg(iat_ms) AS mean, CASE WHEN stddev_pop(iat_ms) IS NULL OR stddev_pop(iat_ms) = 0
            THEN 1.0 ELSE stddev_pop(iat_ms) END AS std FROM iat)""",
    ]


def seq_ctes(max_iat_ms: float, length: int) -> list[str]:
    return [
        *iat_ctes(max_iat_ms),
        f"""seq AS (SELECT * FROM (SELECT trace_id, packet_index, iat_ms AS actual_iat_ms, z AS target, mean, std,
            list(z) OVER (PARTITION BY trace_id ORDER BY packet_index ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)
              AS inputs
            FROM (SELECT iat.*, (iat_ms - s.mean) / s.std AS z, s.mean, s.std FROM iat, stats s))
            WHERE len(inputs) = {length})""",
    ]


# ------------------------------------------------------------------ decisions


def decisions_cte() -> str:
    return f"""decisions AS (SELECT event_id, ts, concat('isp-', CAST(user_id % 10 AS VARCHAR)) AS isp_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'purchase' THEN 'video' ELSE 'voice' END
          AS traffic_type,
        CAST(hour(ts) AS INTEGER) AS hour_bucket, (['quic', 'webrtc', 'doh'])[k % 3 + 1] AS transport,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success_count,
        1 - CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS failure_count,
        2 * CASE WHEN event_type = 'error' THEN 0 ELSE 1 END - 1 AS reward, event_type, value
      FROM (SELECT *, {K} AS k FROM events) e)"""
