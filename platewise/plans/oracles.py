"""SQL of queries whose results need distribution functions or a few steps of an algorithm; see `sqlmath`."""

from __future__ import annotations

from collections.abc import Sequence

from platewise.plans import queries as Q
from platewise.plans import sqlmath as D
from platewise.plans.data import FEATURES, PAIRS
from platewise.plans.plots import SQL
from platewise.plans.queries import WC, WD, WG, WP, WW, each, rsql

# ---------------------------------------------------------------- transforms and tests

_QUANTILE = "SELECT row_id, CASE WHEN q IS NOT NULL THEN (rank() OVER (PARTITION BY plate, q IS NULL ORDER BY q) + (count(*) OVER (PARTITION BY plate, q) - 1) / 2.0 - 0.375) / (count(*) OVER (PARTITION BY plate, q IS NULL) - 2 * 0.375 + 1) END AS x FROM cells"
SQL["rank_int"] = rsql("SELECT row_id, z AS q FROM ranked LEFT JOIN mapped USING (x)", "q", prefix=f"{WC}, ranked AS ({_QUANTILE}), mapped AS (SELECT x, {D.norm_quantile('x')} AS z FROM (SELECT DISTINCT x FROM ranked WHERE x IS NOT NULL))")

_H = f"hh AS (SELECT x.feature, (12.0 / (n * (n + 1)) * ss - 3.0 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, df FROM x JOIN tie USING (feature)), hp AS (SELECT *, {D.chi2_sf_even('h', 'df')} AS pvalue FROM hh)"
SQL["feature_batch_sensitivity_pvalues"] = rsql(D.bh("hp", "", "feature"), "h pvalue qvalue", 4, f"{WC}, {Q._KW}, {_H}")

_LOO = "sh AS (SELECT cluster, sum(n) AS cn, sum(n) / (SELECT sum(n) FROM f WHERE control) AS share FROM f WHERE control GROUP BY cluster), st AS (SELECT usr, control, sum((n - e) ** 2 / e) AS chi2, count(*) - 1 AS dof FROM (SELECT f.usr, f.control, f.n, sum(f.n) OVER (PARTITION BY f.usr, f.control) * s.share AS e FROM f JOIN sh s USING (cluster)) WHERE e > 0 GROUP BY usr, control), lo AS (SELECT usr, sum((n - e) ** 2 / e) AS c, count(*) - 1 AS k FROM (SELECT f.usr, f.n, sum(f.n) OVER (PARTITION BY f.usr) * (s.cn - f.n) / sum(s.cn - f.n) OVER (PARTITION BY f.usr) AS e FROM f JOIN sh s USING (cluster) WHERE f.control) WHERE e > 0 GROUP BY usr), di AS (SELECT greatest(1.0, avg(c / k)) AS dispersion, sum(k) AS den FROM lo WHERE k > 0), ff AS (SELECT usr AS \"user\", control, chi2, dof, dispersion, chi2 / dof / dispersion AS f, den FROM st, di)"
SQL["cluster_composition_pvalues"] = rsql(f"SELECT * EXCLUDE (den), {D.f_sf_even('f', 'dof', 'den')} AS pvalue FROM ff", "chi2 dispersion f pvalue", prefix=f"{WP}, {Q._COMP}, {_LOO}")

_NN10 = "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM pairs) WHERE r <= 10), sz AS (SELECT label AS moa, count(*) AS size FROM e GROUP BY label), vt AS (SELECT i, label_j AS moa, count(*) AS votes, any_value(sz.size) - (label_i = label_j)::INT AS marked, (SELECT count(*) FROM e) - 1 AS n_other FROM nn JOIN sz ON sz.moa = label_j GROUP BY i, label_i, label_j)"
_TAIL = f"kinds AS (SELECT DISTINCT votes, n_other, marked FROM vt), tails AS (SELECT *, {D.hypergeom_sf('votes - 1', 'n_other', 'marked', '10')} AS pvalue FROM kinds), vp AS (SELECT vt.*, pvalue FROM vt JOIN tails USING (votes, n_other, marked))"
_MOA = f"mq AS ({D.bh('vp', '', 'i, moa')})"
SQL["moa_enrichment"] = rsql("SELECT * FROM mq", "pvalue qvalue", prefix=f"{PAIRS}, {_NN10}, {_TAIL}, {_MOA}")
SQL["pl_moa_enrichment"] = rsql("SELECT i, " + ", ".join(f'max(-log10(greatest(qvalue, 1e-300))) FILTER (moa = {k}) AS "{k}"' for k in range(10)) + " FROM mq GROUP BY i", " ".join(f'"{k}"' for k in range(10)), prefix=f"{PAIRS}, {_NN10}, {_TAIL}, {_MOA}")

_MWP = (
    "ag AS (SELECT grp, feature, sum(r) FILTER (NOT control) - count(*) FILTER (NOT control) * (count(*) FILTER (NOT control) + 1) / 2.0 AS u, count(*) FILTER (NOT control) AS n1, count(*) FILTER (control) AS n2, sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM (SELECT *, count(*) OVER (PARTITION BY grp, feature, value) AS t FROM r) GROUP BY grp, feature), "
    "zz AS (SELECT *, greatest(0.0, abs(u - n1 * n2 / 2.0) - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 0) AS z FROM ag), "
    f"mp AS (SELECT grp AS \"group\", feature, u, n1, n2, coalesce(least(1.0, 2.0 * {D.norm_sf('z')}), CASE WHEN z IS NULL THEN 1.0 END) AS pvalue FROM zz)"
)  # no group here is small and free of ties, so the exact distribution is not needed
SQL["mann_whitney_pvalues"] = rsql(D.bh("mp", "", '"group", feature'), "u pvalue qvalue", prefix=f"{WW}, {Q._MW}, {_MWP}")
SQL["pl_feature_volcano"] = rsql('SELECT "group", feature, 2.0 * u / (n1 * n2) - 1.0 AS effect, -log10(greatest(pvalue, 1e-300)) AS minus_log10_p FROM mp', "effect minus_log10_p", prefix=f"{WW}, {Q._MW}, {_MWP}")

_STOUFFER = f"zs AS (SELECT gene, {D.norm_quantile('p')} AS z FROM (SELECT gene, greatest(1e-12, least(1 - 1e-12, pvalue)) AS p FROM guides WHERE pvalue IS NOT NULL)), sf AS (SELECT gene, count(*) AS n, -sum(z) / sqrt(count(*)) AS statistic FROM zs GROUP BY gene)"
SQL["combine_stouffer"] = rsql(f"SELECT *, {D.norm_sf('statistic')} AS pvalue FROM sf", "statistic pvalue", prefix=f"{WG}, {_STOUFFER}")

_DOSE_P = f"dr AS (SELECT compound, feature, 10 ** min(CASE WHEN b >= 0.5 AND a IS NULL THEN x WHEN b >= 0.5 AND a < 0.5 THEN px + (0.5 - a) / (b - a) * (x - px) END) AS bmd, max(b) AS max_z, CAST(sign(max(struct_pack(b := b, x := x, z := z)).z) AS INTEGER) AS direction, CASE WHEN stddev_pop(rx) * stddev_pop(rz) > 0 THEN corr(rx, rz) END AS rho, count(*) AS n_doses FROM cr GROUP BY compound, feature), dt AS (SELECT *, CASE WHEN abs(rho) < 1 - 1e-12 AND n_doses > 2 THEN rho * sqrt((n_doses - 2) / (1 - rho * rho)) END AS t FROM dr), dp AS (SELECT * EXCLUDE (t), CASE WHEN abs(rho) >= 1 - 1e-12 THEN 0.0 WHEN t IS NOT NULL THEN {D.t_sf2('t', '(n_doses - 2)')} END AS pvalue FROM dt)"
SQL["dose_features_pvalues"] = rsql(D.bh("dp", "compound", "feature"), "bmd max_z rho pvalue qvalue", prefix=f"{WD}, {Q._DU.format(n=4)}, {Q._DZ}, {Q._DF}, {_DOSE_P}")

_ULM_P = f"us AS (SELECT \"row\", source, r * sqrt((n - 2) / (1 - r * r)) AS score, n - 2 AS df FROM rr), up AS (SELECT * EXCLUDE (df), {D.t_sf2('score', 'df')} AS pvalue FROM us)"
SQL["enrich_ulm_padj"] = rsql(D.bh("up", '"row"', "source", "padj"), "score pvalue padj", 5, f"WITH {Q._GL}, {Q._ULM}, {_ULM_P}")

_FISHER = f"od AS (SELECT grp AS \"group\", source, overlap, size, n_group, n, ln((overlap + 0.5) * (n - n_group - size + overlap + 0.5) / ((n_group - overlap + 0.5) * (size - overlap + 0.5))) AS odds_ratio, {D.fisher('overlap', '(n_group - overlap)', '(size - overlap)', '(n - n_group - size + overlap)')} AS pvalue FROM ov JOIN sz USING (source) JOIN gz USING (grp), n WHERE n_group < n)"
SQL["ora"] = rsql(D.bh("od", "", '"group", source', "padj"), "odds_ratio pvalue padj", prefix=f"WITH {Q._ORA}, {_FISHER}")
_HITS = Q._ORA.replace("SELECT DISTINCT p_brand AS grp,", "SELECT DISTINCT 'hits' AS grp,")
SQL["enrich_hits"] = rsql(D.bh("od", "", '"group", source', "padj"), "odds_ratio pvalue padj", prefix=f"WITH {_HITS}, {_FISHER}")

# ---------------------------------------------------------------- selection

_ALL = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_PR = "pr AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM cells" for a, b in _ALL) + ")"


def _gone(name: str, members: str) -> str:
    """CTEs `name`t (totals) and `name`g (what the threshold drops) of a table of members (feature, place)."""
    inside = f"pr.a IN (SELECT feature FROM {members}) AND pr.b IN (SELECT feature FROM {members})"
    return (
        f"{name}t AS MATERIALIZED (SELECT o.feature, o.place, 1.0 + coalesce(sum(abs(r)), 0) AS total FROM {members} o LEFT JOIN pr ON o.feature IN (pr.a, pr.b) AND {inside} GROUP BY o.feature, o.place), "
        f"{name}g AS MATERIALIZED (SELECT DISTINCT CASE WHEN ta.total > tb.total OR (ta.total = tb.total AND ta.place > tb.place) THEN a ELSE b END AS feature FROM pr JOIN {name}t ta ON ta.feature = a JOIN {name}t tb ON tb.feature = b WHERE r > 0.5)"
    )


def _members(names: Sequence[str], without: Sequence[str] = ()) -> str:
    values = ", ".join(f"('{f}', {i})" for i, f in enumerate(names))
    return f"SELECT feature, place FROM (VALUES {values}) v(feature, place)" + "".join(f"{' AND' if k else ' WHERE'} feature NOT IN (SELECT feature FROM {t})" for k, t in enumerate(without))


_NAMES = sorted(FEATURES)
SQL["correlation_window"] = (
    f"{WC}, {_PR}, wa AS ({_members(_NAMES[:3])}), {_gone('wa', 'wa')}, wb AS ({_members(_NAMES[1:], ['wag'])}), {_gone('wb', 'wb')}, wc AS ({_members(FEATURES, ['wag', 'wbg'])}), {_gone('wc', 'wc')} "
    "SELECT feature FROM wc WHERE feature NOT IN (SELECT feature FROM wcg)"
)

_STEPS = [f"i0 AS ({_members(FEATURES)})", "tt AS (SELECT o.feature, o.place, 1.0 + sum(abs(r)) AS total FROM i0 o JOIN pr ON o.feature IN (a, b) GROUP BY o.feature, o.place)"]
for _k in range(len(FEATURES) - 1):  # each step drops one feature at most
    _in = f"(SELECT feature FROM i{_k})"
    _STEPS.append(f"w{_k} AS MATERIALIZED (SELECT o.feature FROM i{_k} o JOIN tt USING (feature) JOIN pr ON o.feature IN (a, b) AND a IN {_in} AND b IN {_in} AND r > 0.5 GROUP BY o.feature, tt.total, tt.place ORDER BY count(*) DESC, tt.total DESC, tt.place LIMIT 1)")
    _STEPS.append(f"i{_k + 1} AS MATERIALIZED (SELECT * FROM i{_k} WHERE feature NOT IN (SELECT feature FROM w{_k}))")
SQL["correlation_iterative"] = f"{WC}, {_PR}, {', '.join(_STEPS)} SELECT feature FROM i{len(FEATURES) - 1}"


def _pivoted(names: Sequence[str], columns: dict[str, str], threshold: float, tag: str) -> str:
    """CTEs of a pivoted elimination on the correlations of complete rows; `tag`k: the features kept."""
    complete = " AND ".join(f"({columns[f]}) IS NOT NULL" for f in names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    both = ", ".join(f"corr({columns[a]}, {columns[b]})" for a, b in pairs)
    rows = f"SELECT unnest({[a for a, _ in pairs]!r}) AS a, unnest({[b for _, b in pairs]!r}) AS b, unnest([{both}]) AS v FROM cells WHERE {complete}"
    place = "CASE i " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(names)) + " END"
    ones = " UNION ALL ".join(f"SELECT '{f}', '{f}', 1.0::DOUBLE" for f in names)
    cells = f"SELECT i, j, {place} AS place, v FROM (SELECT a AS i, b AS j, v FROM ({rows}) UNION ALL SELECT b, a, v FROM ({rows}) UNION ALL {ones})"
    out, limit = [f"{tag}0 AS MATERIALIZED ({cells})"], 1.0 - threshold**2
    for k in range(len(names)):
        out.append(f"{tag}p{k} AS MATERIALIZED (SELECT i AS p FROM {tag}{k} WHERE i = j AND v > {limit!r} ORDER BY v DESC, place LIMIT 1)")
        out.append(f"{tag}{k + 1} AS MATERIALIZED (SELECT a.i, a.j, a.place, a.v - b.v * c.v / d.v AS v FROM {tag}{k} a, {tag}p{k}, {tag}{k} b, {tag}{k} c, {tag}{k} d WHERE b.i = a.i AND b.j = p AND c.i = p AND c.j = a.j AND d.i = p AND d.j = p)")
    out.append(f"{tag}k AS ({' UNION ALL '.join(f'SELECT p AS feature FROM {tag}p{k}' for k in range(len(names)))})")
    return ", ".join(out)


SQL["decorrelate"] = f"{WC}, {_pivoted(['d', 't', 'copy', 'p'], {'d': 'd', 't': 't', 'copy': 'd * 2 + 1', 'p': 'p'}, 0.9, 'g')} SELECT feature FROM gk"
_SWEEP = [0.5, 0.9, 0.99]
SQL["decorr_threshold_sweep"] = f"{WC}, {', '.join(_pivoted(FEATURES, {f: f for f in FEATURES}, t, f'g{k}x') for k, t in enumerate(_SWEEP))} " + " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, CAST(count(*) AS INTEGER) AS n_kept, count(*)::DOUBLE AS n FROM g{k}xk" for k, t in enumerate(_SWEEP)
)

_JUDGED = "ju AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS place, avg(({f} IS NULL)::INT) > 0.05 AS holes, coalesce(var_pop({f}), 0) <= 1e-6 AS flat, coalesce(max(abs({f})), 0) > 500 AS far FROM cells" for i, f in enumerate(FEATURES)) + ")"
SQL["feature_select"] = (
    f"{WC}, {_PR}, {_JUDGED}, fs AS (SELECT feature, place FROM ju WHERE NOT holes AND NOT flat), {_gone('fs', 'fs')}, fr AS (SELECT feature, place, CASE WHEN holes THEN 'drop_na_columns' WHEN flat THEN 'variance_threshold' WHEN feature IN (SELECT feature FROM fsg) THEN 'correlation_threshold' WHEN far THEN 'drop_outliers' END AS removed_by FROM ju) "
    "SELECT feature, place, removed_by, removed_by IS NULL AS selected FROM fr"
)

# ---------------------------------------------------------------- names, checks and plots' tables

SQL["validate_profiles"] = f"{WW} SELECT 'error' AS level, 'identity columns are not unique' AS message FROM (SELECT count(*) AS n, count(DISTINCT (plate, well)) AS d FROM wells) WHERE d < n"

_DIST = "pd AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, b.batch AS bj, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"
_SIL = "si AS (SELECT (avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) + 1) / 2 AS x FROM (SELECT i, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM (SELECT i, li, lj, avg(d) AS m FROM pd GROUP BY i, li, lj) GROUP BY i))"
_LISI = "ls AS (SELECT (median(x) - 1) / 4 AS x FROM (SELECT i, 1.0 / sum((n / 30.0) ** 2) AS x FROM (SELECT i, bj, count(*) AS n FROM (SELECT i, bj, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM pd) WHERE r <= 30 GROUP BY i, bj) GROUP BY i))"
_AP = "ap AS (SELECT avg(ap) AS x FROM (SELECT i, avg(k / r) AS ap FROM (SELECT i, label_i = label_j AS pos, row_number() OVER w AS r, sum((label_i = label_j)::INT) OVER w AS k FROM pairs WINDOW w AS (PARTITION BY i ORDER BY sim DESC, label_i = label_j DESC, j ROWS UNBOUNDED PRECEDING)) WHERE pos GROUP BY i))"
SQL["evaluate_integration"] = rsql(
    "SELECT unnest(['silhouette_label', 'bio', 'lisi_batch', 'batch', 'total', 'map', 'total_with_map']) AS metric, unnest([s, s, l, l, 0.4 * l + 0.6 * s, m, 0.4 * l + 0.6 * (s + m) / 2]) AS value FROM (SELECT si.x AS s, ls.x AS l, ap.x AS m FROM si, ls, ap)",
    "value", prefix=f"{PAIRS}, {_DIST}, {_SIL}, {_LISI}, {_AP}",
)

SQL["pl_metrics"] = "SELECT rep, bio, batch FROM (VALUES ('raw', 0.4::DOUBLE, 0.5::DOUBLE), ('corrected', 0.6::DOUBLE, 0.8::DOUBLE)) v(rep, bio, batch)"
SQL["pl_dose_direction"] = f"SELECT compound, dose, amplitude, cosine_to_top FROM ({SQL['dose_direction']})"
SQL["pl_pathway_coherence"] = SQL["pathway_coherence"]
SQL["pl_subpopulation_hits"] = "SELECT cluster, " + ", ".join(f'max(ks) FILTER ("group" = {k}) AS "{k}"' for k in range(1, 6)) + f" FROM ({SQL['subpopulation_hits']}) GROUP BY cluster"
_AGREE = "sc AS (SELECT plate, well, q, p / 10000 AS p, d * 100 AS d, t * 100 AS t FROM cells), md AS (SELECT plate, well, unnest(['q','p','d','t']) AS f, unnest([median(q), median(p), median(d), median(t)]) AS v FROM sc GROUP BY plate, well), rr AS (SELECT a.plate, b.plate AS other, corr(a.v, b.v) AS r FROM md a JOIN md b ON a.well = b.well AND a.f = b.f AND a.plate < b.plate GROUP BY a.plate, b.plate, a.well)"
SQL["pl_setting_agreement"] = rsql("SELECT plate, " + ", ".join(f"avg(r) FILTER (other = 'P{k}') AS P{k}" for k in range(2, 8)) + " FROM rr GROUP BY plate", "P2 P3 P4 P5 P6 P7", prefix=f"{WC}, {_AGREE}")

_OLS = (
    "fx AS (SELECT plate, row_id, p, d, t, CASE WHEN moa = (SELECT max(moa) FROM cells) THEN 1.0 ELSE 0.0 END AS m FROM cells), "
    "cf AS (SELECT plate, count(*) AS n, avg(t) AS ta, avg(m) AS ma, var_pop(t) AS tt, var_pop(m) AS mm, covar_pop(t, m) AS tm, " + each("covar_pop(t, @) AS t@, covar_pop(m, @) AS m@", ["p", "d"]) + " FROM fx GROUP BY plate), "
    "bt AS (SELECT *, " + each("(mm * t@ - tm * m@) / (tt * mm - tm * tm) AS b@, (tt * m@ - tm * t@) / (tt * mm - tm * tm) AS c@", ["p", "d"]) + " FROM cf)"
)
SQL["regress_out_several"] = rsql("SELECT row_id, " + each("fx.@ - b@ * (t - ta) - c@ * (m - ma) AS @", ["p", "d"]) + " FROM fx JOIN bt USING (plate)", "p d", 5, f"{WC}, {_OLS}")
