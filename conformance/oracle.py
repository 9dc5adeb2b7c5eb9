"""SQL for DuckDB, written from the meaning of each table (``date < D`` self-joins),
not from the plans of the library."""

from __future__ import annotations

from txnrisk.sources.events import EVENT_TRANSACTIONS

# Named building blocks. Each lists the blocks it reads.
BLOCKS: dict[str, tuple[list[str], str]] = {
    "txn": ([], EVENT_TRANSACTIONS),
    "span": (["txn"], "SELECT min(txn_date) AS first, max(txn_date) AS last FROM txn"),
    "cal": (["span"], "SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS d FROM span"),
    "per": (["txn", "span"], """
SELECT txn.*, CASE WHEN txn_date - first < 1 THEN 'warmup' WHEN txn_date - first < 6 THEN 'train'
  WHEN txn_date - first < 8 THEN 'validation' WHEN txn_date - first < 10 THEN 'test' ELSE 'tail' END AS period
FROM txn, span"""),
    "stats": (["per"], """
SELECT payment_currency, count(*) AS n, avg(ln(1 + amount_paid)) AS mean_log, stddev_samp(ln(1 + amount_paid)) AS sd_log
FROM per WHERE period = 'train' GROUP BY payment_currency
UNION ALL
SELECT NULL, count(*), avg(ln(1 + amount_paid)), stddev_samp(ln(1 + amount_paid)) FROM per WHERE period = 'train'"""),
    "nm": (["txn"], """
SELECT bank, account, row_number() OVER (ORDER BY bank, account) - 1 AS node_id
FROM (SELECT from_bank AS bank, from_account AS account FROM txn UNION SELECT to_bank, to_account FROM txn)"""),
    "full_txn": (["per", "stats", "nm"], """
SELECT per.*, a.node_id AS src, b.node_id AS dst,
  ln(1 + amount_paid) AS t_log_amount_paid,
  CASE WHEN s.sd_log > 0 THEN (ln(1 + amount_paid) - s.mean_log) / s.sd_log
       WHEN g.sd_log > 0 THEN (ln(1 + amount_paid) - g.mean_log) / g.sd_log ELSE 0::DOUBLE END AS t_amount_z_in_currency,
  payment_format AS t_payment_format, per.payment_currency AS t_cur_paid,
  (per.payment_currency <> receiving_currency)::INTEGER AS t_is_fx,
  (from_bank = to_bank AND from_account = to_account)::INTEGER AS t_is_self_loop,
  (from_bank = to_bank)::INTEGER AS t_same_bank, hour(txn_ts)::INTEGER AS t_hour
FROM per
JOIN nm a ON per.from_bank = a.bank AND per.from_account = a.account
JOIN nm b ON per.to_bank = b.bank AND per.to_account = b.account
LEFT JOIN stats s ON per.payment_currency = s.payment_currency
CROSS JOIN (SELECT * FROM stats WHERE payment_currency IS NULL) g"""),
    "ends": (["full_txn"], """
SELECT src AS node_id, txn_date, payment_format, t_amount_z_in_currency AS z, 'o' AS side FROM full_txn
UNION ALL SELECT dst, txn_date, payment_format, t_amount_z_in_currency, 'i' FROM full_txn"""),
    "spine": (["ends"], """
SELECT node_id, txn_date AS feature_date, count(*) FILTER (side = 'o') AS n_out, count(*) FILTER (side = 'i') AS n_in,
  sum(z) FILTER (side = 'o') AS sum_z_out, sum(z) FILTER (side = 'i') AS sum_z_in, max(z) FILTER (side = 'o') AS max_z_out
FROM ends GROUP BY ALL"""),
    "hist": (["spine", "ends", "span"], """
SELECT s.node_id, s.feature_date,
  (count(*) FILTER (side = 'o'))::DOUBLE / nullif(s.feature_date - first, 0) AS n_out_rate,
  (count(*) FILTER (side = 'i'))::DOUBLE / nullif(s.feature_date - first, 0) AS n_in_rate,
  avg(z) FILTER (side = 'o') AS mean_z_out, avg(z) FILTER (side = 'i') AS mean_z_in,
  max(z) FILTER (side = 'o') AS max_z_out,
  (count(DISTINCT e.txn_date))::DOUBLE / nullif(s.feature_date - first, 0) AS days_active_frac,
  s.feature_date - max(e.txn_date) AS days_since_last,
  count(DISTINCT e.payment_format) AS fmt_diversity,
  (count(e.txn_date) > 0)::INTEGER AS has_history
FROM spine s CROSS JOIN span LEFT JOIN ends e ON e.node_id = s.node_id AND e.txn_date < s.feature_date
GROUP BY s.node_id, s.feature_date, first"""),
    "hist0": (["hist"], """
SELECT node_id, feature_date, coalesce(n_out_rate, 0) AS n_out_rate, coalesce(n_in_rate, 0) AS n_in_rate,
  coalesce(mean_z_out, 0) AS mean_z_out, coalesce(mean_z_in, 0) AS mean_z_in, coalesce(max_z_out, 0) AS max_z_out,
  coalesce(days_active_frac, 0) AS days_active_frac, coalesce(days_since_last, -1)::DOUBLE AS days_since_last,
  fmt_diversity::DOUBLE AS fmt_diversity, has_history FROM hist"""),
    "edges": (["full_txn"], """
SELECT src, dst, min(txn_date) AS first_date, count(*) AS n_txn FROM full_txn WHERE src <> dst GROUP BY src, dst"""),
    "snaps": (["edges", "cal"], "SELECT cal.d, src, dst, first_date FROM cal JOIN edges ON first_date < cal.d"),
    "snap_nodes": (["snaps"], "SELECT d, src AS v FROM snaps UNION SELECT d, dst FROM snaps"),
    "pair": (["full_txn"], """
SELECT t.txn_id,
  CASE WHEN t.src <> t.dst AND (SELECT count(*) FROM full_txn p WHERE p.src = t.src AND p.dst = t.dst AND p.txn_date < t.txn_date) > 0
       THEN 1 ELSE 0 END AS g_pair_seen_before,
  CASE WHEN t.src <> t.dst THEN ln(1 + (SELECT count(*) FROM full_txn p WHERE p.src = t.src AND p.dst = t.dst AND p.txn_date < t.txn_date))
       ELSE 0::DOUBLE END AS g_pair_prior_count_log,
  CASE WHEN t.src <> t.dst AND (SELECT count(*) FROM full_txn p WHERE p.src = t.dst AND p.dst = t.src AND p.txn_date < t.txn_date) > 0
       THEN 1 ELSE 0 END AS g_reverse_pair_seen
FROM full_txn t"""),
    "cp": (["spine", "edges"], """
SELECT s.node_id, s.feature_date, count(DISTINCT o.dst) AS n_unique_out,
  (SELECT count(DISTINCT i.src) FROM edges i WHERE i.dst = s.node_id AND i.first_date < s.feature_date) AS n_unique_in
FROM spine s LEFT JOIN edges o ON o.src = s.node_id AND o.first_date < s.feature_date
GROUP BY s.node_id, s.feature_date"""),
    "scored": (["full_txn", "pair"], """
SELECT f.*, p.g_pair_seen_before, p.g_pair_prior_count_log, p.g_reverse_pair_seen,
  round(0.3::DOUBLE * ln(1 + amount_paid) + 0.8::DOUBLE * (payment_format = 'ACH')::INTEGER + 0.2::DOUBLE * t_is_fx, 6) AS m1_score,
  round(0.3::DOUBLE * ln(1 + amount_paid) + 0.8::DOUBLE * (payment_format = 'ACH')::INTEGER + 0.2::DOUBLE * t_is_fx
        + 1::DOUBLE * (1 - p.g_pair_seen_before), 6) AS m2_score
FROM full_txn f JOIN pair p USING (txn_id)"""),
}

ITERATIONS = 20


def _pagerank_blocks() -> None:
    BLOCKS["pr_deg"] = (["snaps"], "SELECT d, src AS v, count(*) AS k FROM snaps GROUP BY d, src")
    BLOCKS["pr_n"] = (["snap_nodes"], "SELECT d, count(*)::DOUBLE AS n FROM snap_nodes GROUP BY d")
    BLOCKS["pr0"] = (["snap_nodes", "pr_n"], "SELECT d, v, 1 / n AS r FROM snap_nodes JOIN pr_n USING (d)")
    for i in range(ITERATIONS):
        BLOCKS[f"pr{i + 1}"] = ([f"pr{i}", "pr_deg", "pr_n", "snaps"], f"""
SELECT p.d, p.v, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(inflow, 0) + coalesce(lost, 0) / n) AS r
FROM pr{i} p JOIN pr_n USING (d)
LEFT JOIN (SELECT s.d, s.dst AS v, sum(q.r / k) AS inflow FROM snaps s JOIN pr{i} q ON q.d = s.d AND q.v = s.src
           JOIN pr_deg g ON g.d = s.d AND g.v = s.src GROUP BY s.d, s.dst) f ON f.d = p.d AND f.v = p.v
LEFT JOIN (SELECT q.d, sum(q.r) AS lost FROM pr{i} q ANTI JOIN pr_deg g ON g.d = q.d AND g.v = q.v GROUP BY q.d) l ON l.d = p.d""")
    BLOCKS["pr"] = ([f"pr{ITERATIONS}", "pr_n", "spine"], f"""
SELECT s.node_id, s.feature_date, coalesce(p.r, 0) AS pagerank, coalesce(ln(1 + n * p.r), 0) AS pagerank_log
FROM spine s LEFT JOIN pr{ITERATIONS} p ON p.d = s.feature_date AND p.v = s.node_id LEFT JOIN pr_n ON pr_n.d = s.feature_date""")


def _component_blocks() -> None:
    BLOCKS["both_ways"] = (["snaps"], "SELECT d, src AS a, dst AS b FROM snaps UNION SELECT d, dst, src FROM snaps")
    BLOCKS["reach"] = (["snap_nodes", "both_ways"], """
SELECT d, v, v AS w FROM snap_nodes UNION SELECT r.d, r.v, b.b FROM reach r JOIN both_ways b ON b.d = r.d AND b.a = r.w""")
    BLOCKS["comp"] = (["reach"], "SELECT d, v, min(w) AS root, count(*) AS size FROM reach GROUP BY d, v")
    BLOCKS["wcc"] = (["comp", "spine"], """
SELECT s.node_id, s.feature_date, coalesce(size, 0) AS wcc_size, ln(1 + coalesce(size, 0)) AS wcc_size_log
FROM spine s LEFT JOIN comp c ON c.d = s.feature_date AND c.v = s.node_id""")
    BLOCKS["node_day"] = (["cp", "pr", "wcc"], """
SELECT node_id, feature_date, pagerank_log, wcc_size_log, ln(1 + n_unique_out) AS n_unique_out_log,
  ln(1 + n_unique_in) AS n_unique_in_log, (n_unique_out > 0)::INTEGER AS has_sent_before,
  (n_unique_in > 0)::INTEGER AS has_received_before
FROM cp JOIN pr USING (node_id, feature_date) JOIN wcc USING (node_id, feature_date)""")


def _matrix_block() -> None:
    account = ["n_out_rate", "n_in_rate", "mean_z_out", "mean_z_in", "max_z_out", "days_active_frac",
               "days_since_last", "fmt_diversity", "has_history"]
    network = ["pagerank_log", "wcc_size_log", "n_unique_out_log", "n_unique_in_log",
               "has_sent_before", "has_received_before"]
    columns = ", ".join(
        [f"h{s}.{c} AS {s}_{c}" for s in "sr" for c in account]
        + [f"g{s}.{c} AS {s}_g_{c}" for s in "sr" for c in network]
    )
    BLOCKS["matrix"] = (["full_txn", "pair", "hist0", "node_day"], f"""
SELECT f.*, p.g_pair_seen_before, p.g_pair_prior_count_log, p.g_reverse_pair_seen, {columns}
FROM full_txn f JOIN pair p USING (txn_id)
LEFT JOIN hist0 hs ON hs.node_id = f.src AND hs.feature_date = f.txn_date
LEFT JOIN hist0 hr ON hr.node_id = f.dst AND hr.feature_date = f.txn_date
LEFT JOIN node_day gs ON gs.node_id = f.src AND gs.feature_date = f.txn_date
LEFT JOIN node_day gr ON gr.node_id = f.dst AND gr.feature_date = f.txn_date""")


_pagerank_blocks()
_component_blocks()
_matrix_block()


def sql(select: str, *blocks: str) -> str:
    """``select`` with the blocks it names and all they depend on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for needed in BLOCKS[name][0]:
                visit(needed)
            order.append(name)

    for name in blocks:
        visit(name)
    many = ("pr", "snap", "full_txn", "pair", "edges", "hist", "spine", "comp", "node_day", "scored", "matrix")
    parts = [
        f"{name} AS {'MATERIALIZED ' if name.startswith(many) else ''}({BLOCKS[name][1].strip()})"
        for name in order
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.strip()


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0::DOUBLE AS {name}"


def average_precision(source: str, score: str, by: str = "", weight: str = "1", label: str = "is_laundering") -> str:
    """Subquery with columns by, n_rows, n_positive, pr_auc."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keys}sum(n)::BIGINT AS n_rows, sum(p)::BIGINT AS n_positive,
  sum(p * cp::DOUBLE / cn) / nullif(sum(p), 0) AS pr_auc
FROM (SELECT *, sum(n) OVER ({part}ORDER BY s DESC) AS cn, sum(p) OVER ({part}ORDER BY s DESC) AS cp
      FROM (SELECT {keys}{score} AS s, sum({weight})::DOUBLE AS n, sum({weight} * {label})::DOUBLE AS p
            FROM {source} GROUP BY {keys}{score})) {group})"""
