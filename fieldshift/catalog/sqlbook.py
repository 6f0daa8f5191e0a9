"""SQL views over the given tables, the counterparts of ``roles``."""

from __future__ import annotations

import re

# name -> (views it needs, statement)
VIEWS: dict[str, tuple[str, str]] = {
    "roster": (
        "",
        """SELECT o_orderkey AS roster_id, o_custkey AS player, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS won,
  o_orderpriority AS unit, o_custkey % (SELECT count(*) FROM embeddings) AS vec_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'tournament' ELSE 'ladder' END AS source,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  strftime(o_orderdate, '%G-W%V') AS period FROM orders""",
    ),
    "season_w": (
        "",
        """SELECT 'y' || CAST(y AS VARCHAR) AS season, make_timestamp(y, 1, 1, 0, 0, 0) AS start_ts,
  make_timestamp(y, 12, 31, 0, 0, 0) AS end_ts FROM range(1995, 2002) t(y)""",
    ),
    "seasoned": (
        "roster season_w",
        "SELECT r.*, w.season FROM roster r JOIN season_w w ON r.ts BETWEEN w.start_ts AND w.end_ts",
    ),
    "member": (
        "",
        """SELECT l_orderkey AS roster_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS slot, p_brand AS species, p_type AS item,
  l_returnflag AS ability, l_linestatus AS nature, p_name AS moves_text, CAST(l_quantity AS INTEGER) AS level
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "sized": ("member", "SELECT roster_id, count(*) AS n_members FROM member GROUP BY 1"),
    "panel": (
        "roster",
        """SELECT period, unit, count(*) AS n, sum(weight) AS weight,
  sum(weight) / sum(sum(weight)) OVER (PARTITION BY period) AS share,
  sum(CASE WHEN won THEN weight WHEN NOT won THEN 0 END) / nullif(sum(CASE WHEN won IS NOT NULL THEN weight END), 0) AS win_rate
  FROM roster GROUP BY period, unit""",
    ),
    "lagged": (
        "panel",
        """SELECT unit, period, value, value_lag1, winrate_lag1, delta,
  lag(delta) OVER (PARTITION BY unit ORDER BY period) AS delta_lag1 FROM (
  SELECT unit, period, share AS value, lag(share) OVER w AS value_lag1, lag(win_rate) OVER w AS winrate_lag1,
  share - lag(share) OVER w AS delta FROM panel WINDOW w AS (PARTITION BY unit ORDER BY period)) q""",
    ),
    # embeddings in long form: raw, statistics, standardised
    "ev": (
        "",
        """SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x
  FROM embeddings""",
    ),
    "fs": (
        "ev",
        """SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop(x) END AS s
  FROM ev GROUP BY i""",
    ),
    "sv": ("ev fs", "SELECT vec_id, label, i, (x - m) / s AS z FROM ev JOIN fs USING (i)"),
    # codebook: unit = label mean, anchor = mean per (label, vec_id % 4)
    "cb": (
        "sv",
        """SELECT 'unit' AS kind, CAST(label AS INTEGER) AS id, i, avg(z) AS c FROM sv GROUP BY label, i
  UNION ALL SELECT 'anchor', CAST(label * 4 + vec_id % 4 AS INTEGER), i, avg(z) FROM sv GROUP BY label * 4 + vec_id % 4, i""",
    ),
    "mp": (
        "cb",
        """SELECT anchor, arg_min(unit, (d, unit)) AS unit FROM (
  SELECT a.id AS anchor, u.id AS unit, sum((a.c - u.c) ** 2) AS d FROM cb a JOIN cb u USING (i)
  WHERE a.kind = 'anchor' AND u.kind = 'unit' GROUP BY 1, 2) q GROUP BY anchor""",
    ),
    "vd": (
        "sv cb",
        """SELECT vec_id, label, kind, id, sqrt(sum((z - c) ** 2)) AS d FROM sv JOIN cb USING (i)
  GROUP BY vec_id, label, kind, id""",
    ),
    "asg": (
        "vd",
        """SELECT vec_id, arg_min(id, (d, id)) FILTER (WHERE kind = 'anchor') AS anchor,
  min(d) FILTER (WHERE kind = 'anchor') AS anchor_d,
  arg_min(id, (d, id)) FILTER (WHERE kind = 'unit') AS near_unit,
  min(d) FILTER (WHERE kind = 'unit') AS unit_d FROM vd GROUP BY vec_id""",
    ),
    # rosters inside a season with their anchor
    "feats": ("seasoned asg", "SELECT s.*, a.anchor FROM seasoned s JOIN asg a USING (vec_id)"),
    "cal": (
        "feats",
        """SELECT season, period, CAST(row_number() OVER (PARTITION BY season ORDER BY period) - 1 AS INTEGER) AS period_ix
  FROM (SELECT DISTINCT season, period FROM feats) q""",
    ),
    "dom": ("", "SELECT CAST(range AS INTEGER) AS anchor FROM range((SELECT count(DISTINCT label) * 4 FROM embeddings))"),
    "pm": (
        "feats cal dom",
        """SELECT season, period, period_ix, anchor, (coalesce(w, 0) + 1) / sum(coalesce(w, 0) + 1) OVER (PARTITION BY season, period) AS p
  FROM cal CROSS JOIN dom LEFT JOIN (SELECT season, period, anchor, sum(weight) AS w FROM feats GROUP BY ALL) q
  USING (season, period, anchor)""",
    ),
    "ref": ("feats", "SELECT anchor AS ref FROM feats GROUP BY anchor ORDER BY count(*) DESC, anchor LIMIT 1"),
    "lr": (
        "pm ref",
        """SELECT season, period_ix, anchor, p,
  ln(p) - max(CASE WHEN anchor = (SELECT ref FROM ref) THEN ln(p) END) OVER (PARTITION BY season, period_ix) AS y FROM pm""",
    ),
    # forecasts at every origin
    "glide": (
        "pm",
        """SELECT season, period_ix, anchor, p, lam, b / sum(b) OVER (PARTITION BY season, period_ix, lam) AS p_hat FROM (
  SELECT season, period_ix, anchor, p, lam, (1 - lam) * p + lam * avg(p) OVER (PARTITION BY season, anchor, lam
  ORDER BY period_ix ROWS UNBOUNDED PRECEDING) AS b
  FROM pm CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5, 0.8])::DOUBLE AS lam) l) q""",
    ),
    "level": (
        "lr level_state",
        """SELECT season, period_ix, anchor, p, q, e / sum(e) OVER (PARTITION BY season, period_ix, q) AS p_hat FROM (
  SELECT l.season, l.period_ix, l.anchor, l.p, k.q, exp(k.a) AS e FROM lr l JOIN level_state k USING (season, period_ix, anchor)) z""",
    ),
    "level_state": (
        "lr",
        """SELECT season, anchor, period_ix, q, y AS a, 1.0::DOUBLE AS v FROM lr
  CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0])::DOUBLE AS q) g WHERE period_ix = 0
  UNION ALL SELECT s.season, s.anchor, l.period_ix, s.q, s.a + (s.v + s.q) / (s.v + s.q + 1) * (l.y - s.a),
  (s.v + s.q) * (1 - (s.v + s.q) / (s.v + s.q + 1)) FROM level_state s JOIN lr l
  ON l.season = s.season AND l.anchor = s.anchor AND l.period_ix = s.period_ix + 1""",
    ),
    "lrow": ("lr", "SELECT season, period_ix, list(y ORDER BY anchor) AS ys FROM lr GROUP BY season, period_ix"),
    "vol_state": (
        "lrow",
        """SELECT season, period_ix, q, g, ys AS a, 1.0::DOUBLE AS v, 1.0::DOUBLE AS vol FROM lrow
  CROSS JOIN (SELECT unnest([0.1, 0.5, 1.0, 2.0])::DOUBLE AS q) x CROSS JOIN (SELECT unnest([0.5, 0.8])::DOUBLE AS g) z
  WHERE period_ix = 0
  UNION ALL SELECT s.season, l.period_ix, s.q, s.g,
  list_transform(list_zip(s.a, l.ys), lambda t: t[1] + (s.v + s.q * s.vol) / (s.v + s.q * s.vol + 1) * (t[2] - t[1])),
  (s.v + s.q * s.vol) * (1 - (s.v + s.q * s.vol) / (s.v + s.q * s.vol + 1)),
  s.g * s.vol + (1 - s.g) * list_sum(list_transform(list_zip(s.a, l.ys), lambda t: (t[2] - t[1]) ** 2)) / (len(s.a) - 1)
  FROM vol_state s JOIN lrow l ON l.season = s.season AND l.period_ix = s.period_ix + 1""",
    ),
    "vol": (
        "vol_state pm",
        """SELECT season, period_ix, anchor, p, q, g, e / sum(e) OVER (PARTITION BY season, period_ix, q, g) AS p_hat FROM (
  SELECT k.season, k.period_ix, m.anchor, m.p, k.q, k.g, exp(k.a[m.anchor + 1]) AS e
  FROM vol_state k JOIN pm m USING (season, period_ix)) z""",
    ),
    "cands": (
        "pm glide level vol",
        """SELECT 'persistence' AS family, 0 AS cand_ix, season, period_ix, anchor, p, p AS p_hat FROM pm
  UNION ALL SELECT 'local_level', CAST(list_position([0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0], q) - 1 AS INTEGER),
    season, period_ix, anchor, p, p_hat FROM level
  UNION ALL SELECT 'shared_churn', CAST((list_position([0.1, 0.5, 1.0, 2.0], q) - 1) * 2 + list_position([0.5, 0.8], g) - 1 AS INTEGER),
    season, period_ix, anchor, p, p_hat FROM vol
  UNION ALL SELECT 'glide', CAST(list_position([0.0, 0.1, 0.2, 0.3, 0.5, 0.8], lam) - 1 AS INTEGER),
    season, period_ix, anchor, p, p_hat FROM glide
  UNION ALL SELECT 'combination', CAST((list_position([0.2, 0.5, 1.0], q) - 1) * 3 + list_position([0.25, 0.5, 0.75], w) - 1 AS INTEGER),
    season, period_ix, anchor, p, (1 - w) * p + w * p_hat FROM level
    CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS w) x WHERE q IN (0.2, 0.5, 1.0)""",
    ),
    "scores": (
        "cands pm",
        """SELECT family, cand_ix, season, period_ix,
  sum((a + 1e-9) * (log2(a + 1e-9) - log2(h + 1e-9))) / sum(a + 1e-9) - log2(sum(a + 1e-9)) + log2(sum(h + 1e-9)) AS kl
  FROM (SELECT c.family, c.cand_ix, c.season, c.period_ix, n.p AS a, c.p_hat AS h FROM cands c
  JOIN pm n ON n.season = c.season AND n.anchor = c.anchor AND n.period_ix = c.period_ix + 1) q
  GROUP BY ALL""",
    ),
    "chosen": (
        "scores",
        """SELECT family, season, arg_min(cand_ix, (tk, cand_ix)) AS cand_ix, min(tk) AS train_kl FROM (
  SELECT family, cand_ix, season, (sum(s) OVER w - s) / nullif(sum(n) OVER w - n, 0) AS tk FROM (
  SELECT family, cand_ix, season, sum(kl) AS s, count(*) AS n FROM scores GROUP BY ALL) a
  WINDOW w AS (PARTITION BY family, cand_ix)) b WHERE tk IS NOT NULL GROUP BY family, season""",
    ),
    "race": (
        "scores chosen",
        """SELECT s.family, avg(s.kl) AS mean_kl, 100 * avg(CASE WHEN s.kl < b.kl - 1e-9 THEN 1.0 ELSE 0.0 END) AS beats_pct
  FROM scores s JOIN chosen USING (family, season, cand_ix)
  JOIN scores b ON b.family = 'persistence' AND b.season = s.season AND b.period_ix = s.period_ix
  WHERE s.family <> 'persistence' GROUP BY s.family
  UNION ALL SELECT 'persistence', avg(kl), 0.0 FROM scores WHERE family = 'persistence'""",
    ),
    # the coming period: last origin of every season by glide(0.3)
    "nxt": (
        "glide",
        """SELECT season, anchor, p, p_hat FROM glide WHERE lam = 0.3
  AND (season, period_ix) IN (SELECT (season, max(period_ix)) FROM glide GROUP BY season)""",
    ),
    "shift": (
        "nxt mp",
        """SELECT season, unit, c AS current_share, n AS predicted_share, n - c AS delta,
  CASE WHEN c >= 0.01 THEN (n - c) / c END AS pct_change FROM (
  SELECT season, unit, sum(p) / sum(sum(p)) OVER (PARTITION BY season) AS c,
  sum(p_hat) / sum(sum(p_hat)) OVER (PARTITION BY season) AS n FROM nxt JOIN mp USING (anchor) GROUP BY season, unit) q""",
    ),
    # families by rules on the members
    "fam": (
        "member",
        """SELECT roster_id, CASE WHEN ab LIKE '%anr%' THEN 'Chain' WHEN sp LIKE '%brand#7%' THEN 'Seven'
  WHEN mv LIKE '%redwidget%' THEN 'Red' WHEN mv LIKE '%hot%' THEN 'Hot' WHEN sp LIKE '%brand#1 brand#2%' THEN 'Pair'
  ELSE 'Balance' END AS family FROM (
  SELECT roster_id, lower(string_agg(ability, '' ORDER BY slot)) AS ab, lower(string_agg(species, ' ' ORDER BY slot)) AS sp,
  replace(lower(string_agg(moves_text, '' ORDER BY slot)), ' ', '') AS mv FROM member GROUP BY roster_id) q""",
    ),
    # pairing strength: winners' mean minus losers' mean, per dimension
    "ww": (
        "roster sv",
        """SELECT i, sum(z * nw) / sum(nw) - sum(z * nl) / sum(nl) AS w FROM sv JOIN (
  SELECT vec_id, count(*) FILTER (WHERE won) AS nw, count(*) FILTER (WHERE NOT won) AS nl FROM roster GROUP BY vec_id) q
  USING (vec_id) GROUP BY i""",
    ),
    "st": ("sv ww", "SELECT vec_id, sum(z * w) AS s FROM sv JOIN ww USING (i) GROUP BY vec_id"),
    "pairing": (
        "roster",
        """SELECT a.roster_id // 2 AS pairing_id, a.roster_id AS roster_a, b.roster_id AS roster_b,
  a.vec_id AS vec_a, b.vec_id AS vec_b, CASE WHEN oa.o_totalprice > ob.o_totalprice THEN 1 ELSE 0 END AS label
  FROM roster a JOIN roster b ON b.roster_id = a.roster_id + 1 AND a.roster_id % 2 = 0
  JOIN orders oa ON oa.o_orderkey = a.roster_id JOIN orders ob ON ob.o_orderkey = b.roster_id
  WHERE NOT (oa.o_orderstatus = 'P' AND ob.o_orderstatus = 'P') AND oa.o_totalprice <> ob.o_totalprice""",
    ),
}

#: Windows of the median forecaster, and (decay, smoothing) of the discounted sums.
MEDIANS = (2, 3, 5)
_MEDIAN = " UNION ALL ".join(
    f"""SELECT 'median' AS family, {i} AS cand_ix, season, period_ix, anchor, p, m / sum(m) OVER (PARTITION BY season, period_ix) AS p_hat FROM (
  SELECT *, median(p) OVER (PARTITION BY season, anchor ORDER BY period_ix ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS m FROM pm) q{i}"""
    for i, w in enumerate(MEDIANS)
)
_DISCOUNTED = """SELECT 'discounted' AS family, cand_ix, season, period_ix, anchor, p,
  (coalesce(m, 0) + smoothing) / sum(coalesce(m, 0) + smoothing) OVER (PARTITION BY season, period_ix, cand_ix) AS p_hat FROM pm
  CROSS JOIN (SELECT i * 3 + j AS cand_ix, ([0.3, 0.7, 1.5][i + 1])::DOUBLE AS decay, ([0.5, 1, 5][j + 1])::DOUBLE AS smoothing FROM range(3) a(i), range(3) b(j)) g
  LEFT JOIN (SELECT c.season, c.period_ix, w.anchor, d.decay, sum(w.w * exp(d.decay * (w.period_ix - c.period_ix - 1))) AS m FROM cal c
    JOIN (SELECT season, period_ix, anchor, sum(weight) AS w FROM feats JOIN cal USING (season, period) GROUP BY ALL) w
      ON w.season = c.season AND w.period_ix <= c.period_ix
    CROSS JOIN (SELECT unnest([0.3, 0.7, 1.5])::DOUBLE AS decay) d GROUP BY ALL) z USING (season, period_ix, anchor, decay)"""
for _end, _more, _needs in (("m", _MEDIAN, "pm"), ("d", _DISCOUNTED, "pm feats cal")):
    VIEWS[f"cands_{_end}"] = (f"cands {_needs}", f"SELECT * FROM cands UNION ALL {_more}")
    for _name in ("scores", "chosen", "race"):
        _uses, _text = VIEWS[_name]
        for _part in ("cands", "scores", "chosen"):
            _uses, _text = (re.sub(rf"\b{_part}\b", f"{_part}_{_end}", x) for x in (_uses, _text))
        VIEWS[f"{_name}_{_end}"] = (_uses, _text)


def with_views(statement: str, names: list[str]) -> str:
    """Prefix the statement with the views it uses, needed ones first."""
    ordered: list[str] = []

    def need(name: str, chain: tuple[str, ...] = ()) -> None:
        if name in ordered or name in chain:
            return
        for other in VIEWS[name][0].split():
            need(other, (*chain, name))
        ordered.append(name)

    for name in names:
        need(name)
    text = statement.strip()
    if ordered:
        parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
        head = "WITH RECURSIVE " + parts
        text = f"{head}, {text[5:]}" if text.upper().startswith("WITH ") else f"{head}\n{text}"
    return re.sub(r"rnd\(([a-z_0-9.]+)\)", r"(round(\1, 6) + 0.0)", text)
