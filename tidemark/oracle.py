"""DuckDB SQL that says the same as the queries, built from shared parts."""

from __future__ import annotations

from tidemark.sources.events import SQL as SEG

LABELS = range(6)
TIOU = "CASE WHEN least({a}.e, {b}.e) - greatest({a}.s, {b}.s) > 0 THEN (least({a}.e, {b}.e) - greatest({a}.s, {b}.s)) / (greatest({a}.e, {b}.e) - least({a}.s, {b}.s)) ELSE 0.0 END"


def tiou(a: str, b: str) -> str:
    return TIOU.format(a=a, b=b)


def matches(taus: tuple[float, ...], order: str = "g, p", group: str = "rec_id", seg: str = "seg") -> str:
    """CTEs `pairs`, `walk` and `m` (tau, rec_id, g, p, t, gb, pb): the greedy walk rank by rank."""
    values = ", ".join(f"({t!r}::DOUBLE)" for t in taus)
    return f"""
taus(tau) AS (VALUES {values}),
pairs AS (SELECT g.{group}, g.i AS g, p.i AS p, g.b AS gb, p.b AS pb, {tiou('g', 'p')} AS t FROM {seg} g JOIN {seg} p ON g.{group} = p.{group} AND g.gt AND NOT p.gt),
ranked AS (SELECT tau, pairs.*, row_number() OVER (PARTITION BY tau, {group} ORDER BY t DESC, {order}) AS n FROM pairs JOIN taus ON t >= tau),
walk AS (SELECT tau, {group}, n, g, p, t, gb, pb, true AS taken, [g] AS gs, [p] AS ps FROM ranked WHERE n = 1
  UNION ALL SELECT r.tau, r.{group}, r.n, r.g, r.p, r.t, r.gb, r.pb, x.ok, CASE WHEN x.ok THEN list_append(w.gs, r.g) ELSE w.gs END, CASE WHEN x.ok THEN list_append(w.ps, r.p) ELSE w.ps END
  FROM walk w JOIN ranked r ON r.tau = w.tau AND r.{group} = w.{group} AND r.n = w.n + 1, LATERAL (SELECT NOT list_contains(w.gs, r.g) AND NOT list_contains(w.ps, r.p) AS ok) x),
m AS (SELECT tau, {group}, g, p, t, gb, pb FROM walk WHERE taken)"""


def peeled(taus: tuple[float, ...], order: str, group: str, seg: str) -> str:
    """CTE `m` (tau, group, g, p, t): the greedy walk by rounds that take the pairs that are the best left for both ends."""
    values = ", ".join(f"({t!r}::DOUBLE)" for t in taus)
    best = lambda end: f"row_number() OVER (PARTITION BY tau, {group}, {end} ORDER BY t DESC, {order}) = 1"
    return f"""
taus(tau) AS (VALUES {values}),
pairs AS (SELECT tau, g.{group}, g.i AS g, p.i AS p, {tiou('g', 'p')} AS t FROM {seg} g JOIN {seg} p ON g.{group} = p.{group} AND g.gt AND NOT p.gt AND g.s < p.e AND p.s < g.e JOIN taus ON {tiou('g', 'p')} >= tau),
rounds AS (SELECT pairs.*, false AS taken FROM pairs
  UNION ALL SELECT tau, {group}, g, p, t, now FROM (SELECT *, bool_or(now) OVER (PARTITION BY tau, {group}, g) AS gone_g, bool_or(now) OVER (PARTITION BY tau, {group}, p) AS gone_p
    FROM (SELECT tau, {group}, g, p, t, {best('g')} AND {best('p')} AS now FROM rounds WHERE NOT taken)) WHERE now OR NOT (gone_g OR gone_p)),
m AS (SELECT tau, {group}, g, p, t FROM rounds WHERE taken)"""


def peeled_records(taus: tuple[float, ...]) -> str:
    """CTEs `pairs` and `m` as `matches` makes them, by rounds: for records of many pairs. Pairs overlap."""
    values = ", ".join(f"({t!r}::DOUBLE)" for t in taus)
    best = lambda end: f"row_number() OVER (PARTITION BY tau, rec_id, {end} ORDER BY t DESC, g, p) = 1"
    return f"""
taus(tau) AS (VALUES {values}),
pairs AS (SELECT g.rec_id, g.i AS g, p.i AS p, g.b AS gb, p.b AS pb, {tiou('g', 'p')} AS t FROM seg g JOIN seg p ON g.rec_id = p.rec_id AND g.gt AND NOT p.gt AND g.s < p.e AND p.s < g.e),
rounds AS (SELECT tau, pairs.*, false AS taken FROM pairs JOIN taus ON t >= tau
  UNION ALL SELECT tau, rec_id, g, p, gb, pb, t, now FROM (SELECT *, bool_or(now) OVER (PARTITION BY tau, rec_id, g) AS gone_g, bool_or(now) OVER (PARTITION BY tau, rec_id, p) AS gone_p
    FROM (SELECT tau, rec_id, g, p, gb, pb, t, {best('g')} AND {best('p')} AS now FROM rounds WHERE NOT taken)) WHERE now OR NOT (gone_g OR gone_p)),
m AS (SELECT tau, rec_id, g, p, t, gb, pb FROM rounds WHERE taken)"""


#: Segments of which a tenth are one record, and all segments on one axis.
SEG_HOT = SEG.replace("seg AS (", "seg0 AS (") + ", seg AS (SELECT * REPLACE (CASE WHEN i % 20 < 2 THEN -1 ELSE rec_id END AS rec_id) FROM seg0)"
SEG_LINE = SEG.replace("seg AS (", "seg0 AS (") + ", seg AS (SELECT * REPLACE (0 AS rec_id, s + shift AS s, e + shift AS e) FROM (SELECT *, 1000 * user_id + 168 * iter AS shift FROM seg0))"
#: Segments with kb, the keys that their labels have: CTE `seg`.
KEYS = " | ".join(f"CASE WHEN (k + {j}) % 4 <> 0 THEN {1 << j} ELSE 0 END" for j in LABELS)
SEG_KEYED = SEG.replace("seg AS (", "seg0 AS (") + f", seg AS (SELECT *, CASE WHEN k % 9 = 0 THEN b ELSE b | {KEYS} END AS kb FROM seg0)"


def record_metrics(taus: tuple[float, ...], policy: str, keyed: bool = False, hot: bool = False) -> str:
    """CTEs up to `rm`: one row per tau and record. keyed: a record has the labels that its segments' keys name. hot: a tenth of all segments are one record."""
    own = "JOIN (SELECT rec_id AS kr, bit_or(kb) AS ks FROM seg GROUP BY rec_id) ON kr = rec_id, range(6) AS u(j) WHERE (ks >> j) % 2 = 1" if keyed else ", range(6) AS u(j)"
    n_keys = "bit_count(bit_or(kb))" if keyed else "6"
    strict = """
  UNION ALL SELECT tau, s.rec_id, s.b, 0 FROM seg s, taus WHERE s.gt AND NOT EXISTS (SELECT 1 FROM m WHERE m.tau = taus.tau AND m.g = s.i)
  UNION ALL SELECT tau, s.rec_id, 0, s.b FROM seg s, taus WHERE NOT s.gt AND NOT EXISTS (SELECT 1 FROM m WHERE m.tau = taus.tau AND m.p = s.i)"""
    bits = {
        "tp": "(g >> j) % 2 = 1 AND (p >> j) % 2 = 1", "fp": "(g >> j) % 2 = 0 AND (p >> j) % 2 = 1",
        "fn": "(g >> j) % 2 = 1 AND (p >> j) % 2 = 0", "tn": "(g >> j) % 2 = 0 AND (p >> j) % 2 = 0",
    }
    counts = ", ".join(f"count(*) FILTER ({t}) AS {n}" for n, t in bits.items())
    return f"""WITH RECURSIVE {SEG_HOT if hot else SEG_KEYED if keyed else SEG}, {peeled_records(taus) if hot else matches(taus)},
rr(tau, rec_id, g, p) AS (SELECT tau, rec_id, gb, pb FROM m{strict if policy == 'strict' else ''}),
lc AS (SELECT tau, rec_id, j, {counts} FROM rr {own} GROUP BY ALL),
la AS (SELECT tau, rec_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn,
  coalesce(avg(2.0 * tp / (2 * tp + fp + fn)) FILTER (tp + fp + fn > 0), 1.0) AS macro_f1 FROM lc GROUP BY ALL),
ra AS (SELECT tau, rec_id, count(*) AS n_rows, count(*) FILTER (g = p) AS n_equal FROM rr GROUP BY ALL),
ma AS (SELECT tau, rec_id, count(*) AS n_matched, avg(t) AS mean_tiou FROM m GROUP BY ALL),
rec AS (SELECT rec_id, any_value(model_id) AS model_id, any_value(iter) AS iter, count(*) FILTER (gt) AS n_gt, count(*) FILTER (NOT gt) AS n_pred, bool_and(k <> 99) AS valid, {n_keys}::BIGINT AS n_keys FROM seg GROUP BY rec_id),
bg AS (SELECT rec_id, g, max(t) AS t FROM pairs GROUP BY ALL), bp AS (SELECT rec_id, p, max(t) AS t FROM pairs GROUP BY ALL),
best AS (SELECT rec.rec_id, coalesce((SELECT sum(t) FROM bg WHERE bg.rec_id = rec.rec_id) / nullif(n_gt, 0), 0.0) AS max_tiou_per_gt,
  coalesce((SELECT sum(t) FROM bp WHERE bp.rec_id = rec.rec_id) / nullif(n_pred, 0), 0.0) AS max_tiou_per_pred FROM rec),
r0 AS (SELECT tau, rec.*, coalesce(n_matched, 0) AS n_matched, coalesce(mean_tiou, 0.0) AS mean_tiou, coalesce(n_rows, 0) AS n_rows, coalesce(n_equal, 0) AS n_equal,
  coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(macro_f1, 1.0) AS macro_f1, max_tiou_per_gt, max_tiou_per_pred
  FROM rec CROSS JOIN taus LEFT JOIN ma USING (tau, rec_id) LEFT JOIN ra USING (tau, rec_id) LEFT JOIN la USING (tau, rec_id) JOIN best USING (rec_id)),
r1 AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0), 0.0) END AS micro_p,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0), 0.0) END AS micro_r FROM r0),
rm AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2 * micro_p * micro_r / nullif(micro_p + micro_r, 0), 0.0) END AS micro_f1,
  CASE WHEN n_gt = 0 THEN 1.0 ELSE n_matched / n_gt END AS gt_coverage, CASE WHEN n_pred = 0 THEN 1.0 ELSE n_matched / n_pred END AS pred_match_rate,
  coalesce(n_equal / nullif(n_rows, 0), 0.0) AS subset_acc, coalesce((fp + fn) / nullif(n_rows * n_keys, 0), 0.0) AS hamming FROM r1)"""


REAL = ("micro_p", "micro_r", "micro_f1", "macro_f1", "mean_tiou", "gt_coverage", "pred_match_rate", "subset_acc", "hamming", "max_tiou_per_gt", "max_tiou_per_pred")
WHOLE = ("n_gt", "n_pred", "n_matched", "n_rows", "n_equal", "tp", "fp", "fn", "tn")


def record_rows(taus: tuple[float, ...], policy: str, keyed: bool = False, hot: bool = False) -> str:
    return f"{record_metrics(taus, policy, keyed, hot)} SELECT tau, rec_id, {', '.join(WHOLE)}, {', '.join(f'round({c}, 6) AS {c}' for c in REAL)} FROM rm"


def summary(taus: tuple[float, ...], policy: str, keys: str, means: dict[str, str]) -> str:
    avg = ", ".join(f"round(coalesce(avg({v}), 0.0), 6) AS {k}" for k, v in means.items())
    return f"""{record_metrics(taus, policy)},
s AS (SELECT {keys}, count(*) AS n_records, count(*) FILTER (n_matched > 0) AS n_hit, round(coalesce(avg(mean_tiou) FILTER (n_matched > 0), 0.0), 6) AS mean_tiou,
  round(coalesce(avg(micro_f1) FILTER (n_matched > 0), avg(micro_f1)), 6) AS mean_micro_f1, {avg},
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS sum_{c}' for c in ('tp', 'fp', 'fn', 'tn', 'n_rows'))} FROM rm GROUP BY {keys}),
q AS (SELECT *, CASE WHEN sum_tp + sum_fp + sum_fn = 0 THEN 1.0 ELSE coalesce(sum_tp / nullif(sum_tp + sum_fp, 0), 0.0) END AS pp,
  CASE WHEN sum_tp + sum_fp + sum_fn = 0 THEN 1.0 ELSE coalesce(sum_tp / nullif(sum_tp + sum_fn, 0), 0.0) END AS pr FROM s)
SELECT * EXCLUDE (pp, pr), round(n_hit / n_records, 6) AS hit_share, round(pp, 6) AS pool_p, round(pr, 6) AS pool_r,
  round(CASE WHEN sum_tp + sum_fp + sum_fn = 0 THEN 1.0 ELSE coalesce(2 * pp * pr / nullif(pp + pr, 0), 0.0) END, 6) AS pool_f1,
  round(coalesce((sum_tp + sum_tn) / nullif(sum_tp + sum_fp + sum_fn + sum_tn, 0), 1.0), 6) AS pool_acc FROM q"""


def summary_of_usable(taus: tuple[float, ...], policy: str, keys: str, means: dict[str, str]) -> str:
    """As summary, over usable records with their own label keys, and counts of all and of skipped ones."""
    made = summary(taus, policy, keys, means).split(",\ns AS (", 1)[1].replace("FROM rm GROUP BY", "FROM rm WHERE ok GROUP BY").split("\nSELECT * EXCLUDE")
    return f"""{record_metrics(taus, policy, True)[:-len(" FROM r1)")]}, valid AND n_gt + n_pred > 0 AND n_keys > 0 AS ok FROM r1),
c AS (SELECT {keys}, count(*) AS n_files, count(*) FILTER (NOT ok) AS n_skipped FROM rm GROUP BY {keys}),
s AS ({made[0]},
z AS (SELECT * EXCLUDE{made[1]})
SELECT z.*, n_files, n_skipped, CASE WHEN n_hit > 0 THEN n_hit ELSE n_records END AS n_f1 FROM c JOIN z USING ({keys})"""


def label_pool(taus: tuple[float, ...], policy: str, keyed: bool = False) -> str:
    return f"""{record_metrics(taus, policy, keyed)},
x AS (SELECT lc.tau, model_id, CAST(j + 1 AS BIGINT) AS label, tp, fp, fn, tn FROM lc JOIN (SELECT rec_id, model_id FROM rec) USING (rec_id)),
y AS (SELECT tau, model_id, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn
  FROM x GROUP BY GROUPING SETS ((tau, model_id, label), (tau, model_id)))
SELECT *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1.0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 1.0), 6) AS accuracy FROM y"""


#: Gaps and islands of `seg` by (rec_id, gt): CTE `islands`.
ISLANDS = """
reach AS (SELECT rec_id, gt, s, e, max(e) OVER (PARTITION BY rec_id, gt ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {src} WHERE e > s),
numbered AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, gt ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM reach),
islands AS (SELECT rec_id, gt, min(s) AS s, max(e) AS e FROM numbered GROUP BY rec_id, gt, n)"""
