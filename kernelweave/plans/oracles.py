"""SQL that states the queries' results, for an independent engine."""

from __future__ import annotations

from ..operators.patterns import all_trees, canonical_codes, paths


def incidence(gid: str, vid: str) -> str:
    own = "CAST(c_nationkey AS BIGINT)" if gid == "nation" else "o_custkey"
    customers = " JOIN customer ON c_custkey = o_custkey" if gid == "nation" else ""
    return (
        f"inc AS (SELECT DISTINCT {own} AS gid, o_orderkey AS eid, {vid} AS vid FROM orders "
        f"JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey{customers})"
    )


A, N, T = incidence("customer", "p_brand"), incidence("nation", "p_brand"), incidence("customer", "p_type")
ADJ = (
    "adj AS (SELECT DISTINCT a.gid, a.vid AS u, b.vid AS v FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid AND a.vid < b.vid), "
    "sym AS (SELECT gid, u, v FROM adj UNION ALL SELECT gid, v AS u, u AS v FROM adj)"
)
DV = "dv AS (SELECT gid, vid, count(*) AS deg FROM inc GROUP BY gid, vid)"
DE = "de AS (SELECT gid, eid, count(*) AS deg FROM inc GROUP BY gid, eid)"


def near(table: str, keys: str, column: str, by: str, sep: str = ",") -> str:
    return (
        f"SELECT i.gid, {by}, string_agg({column}, '{sep}' ORDER BY {column}) AS near FROM inc i JOIN {table} x "
        f"ON i.gid = x.gid AND {keys} GROUP BY i.gid, {by}"
    )


def wl(rounds: int) -> str:
    """CTEs v0.., e0.., m1.. (members' labels), and feat."""
    parts = [
        DV,
        DE,
        "v0 AS (SELECT gid, vid, md5('v|' || deg) AS lbl FROM dv)",
        "e0 AS (SELECT gid, eid, md5('e|' || deg) AS lbl FROM de)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            f"m{r} AS ({near(f'v{r - 1}', 'i.vid = x.vid', 'x.lbl', 'i.eid')})",
            f"e{r} AS (SELECT e.gid, e.eid, md5('e|' || e.lbl || '|' || m.near) AS lbl FROM e{r - 1} e JOIN m{r} m ON e.gid = m.gid AND e.eid = m.eid)",
            f"a{r} AS ({near(f'e{r}', 'i.eid = x.eid', 'x.lbl', 'i.vid')})",
            f"v{r} AS (SELECT v.gid, v.vid, md5('v|' || v.lbl || '|' || a.near) AS lbl FROM v{r - 1} v JOIN a{r} a ON v.gid = a.gid AND v.vid = a.vid)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM v{r} GROUP BY gid, lbl" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


def hyperedge_feat(rounds: int) -> str:
    union = " UNION ALL ".join(
        f"SELECT gid, md5('h|' || near) AS fid, count(*) * {2 if r == 1 else 1} AS cnt FROM m{r} GROUP BY gid, near" for r in range(1, rounds + 1)
    )
    return wl(rounds).rsplit(", feat AS", 1)[0] + f", feat AS ({union})"


def list_wl(rounds: int) -> str:
    parts = [DV, "v0 AS (SELECT gid, vid, md5('v|' || deg) AS lbl FROM dv)"]
    for r in range(1, rounds + 1):
        parts += [
            f"e{r} AS (SELECT gid, eid, near AS lbl FROM ({near(f'v{r - 1}', 'i.vid = x.vid', 'x.lbl', 'i.eid')}))",
            f"a{r} AS ({near(f'e{r}', 'i.eid = x.eid', 'x.lbl', 'i.vid', ';')})",
            f"v{r} AS (SELECT v.gid, v.vid, md5('v|' || v.lbl || '|' || a.near) AS lbl FROM v{r - 1} v JOIN a{r} a ON v.gid = a.gid AND v.vid = a.vid)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM v{r} GROUP BY gid, lbl" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


def graph_wl(rounds: int) -> str:
    parts = [ADJ, "v0 AS (SELECT gid, u AS vid, md5('v|' || count(*)) AS lbl FROM sym GROUP BY gid, u)"]
    for r in range(1, rounds + 1):
        parts += [
            f"a{r} AS (SELECT s.gid, s.u AS vid, string_agg(x.lbl, ',' ORDER BY x.lbl) AS near FROM sym s JOIN v{r - 1} x ON s.gid = x.gid AND s.v = x.vid GROUP BY s.gid, s.u)",
            f"v{r} AS (SELECT v.gid, v.vid, md5('v|' || v.lbl || '|' || a.near) AS lbl FROM v{r - 1} v JOIN a{r} a ON v.gid = a.gid AND v.vid = a.vid)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM v{r} GROUP BY gid, lbl" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


FEATURES = "SELECT gid, fid, CAST(sum(cnt) AS BIGINT) AS cnt FROM feat GROUP BY gid, fid"


def gram(left: str = "feat", term: str = "a.cnt * b.cnt") -> str:
    return f"SELECT a.gid AS gid_a, b.gid AS gid_b, CAST(sum({term}) AS BIGINT) AS k FROM {left} a JOIN feat b ON a.fid = b.fid GROUP BY a.gid, b.gid"


def normal(head: str, square: str, term: str) -> str:
    return (
        f"WITH {head}, g AS ({gram(term=term)}), own AS (SELECT gid, sum({square}) AS own FROM feat GROUP BY gid) "
        "SELECT gid_a, gid_b, k / sqrt(CAST(a.own * b.own AS DOUBLE)) AS k FROM g JOIN own a ON a.gid = gid_a JOIN own b ON b.gid = gid_b"
    )


def tree(parents: tuple[int, ...]) -> str:
    """A conjunctive query: one copy of the symmetric adjacency for each tree edge."""
    joins = "sym s1" if parents else ""
    for k, parent in enumerate(parents[1:], 2):
        side = f"s{parent}.v" if parent else "s1.u"
        joins += f" JOIN sym s{k} ON s{k}.gid = s1.gid AND s{k}.u = {side}"
    return f"WITH {T}, {ADJ} SELECT s1.gid, count(*) AS hom FROM {joins} GROUP BY s1.gid"


def diagonals(p: str, steps: int) -> str:
    parts = [f"p1 AS ({p})"]
    for k in range(2, steps + 1):
        parts.append(f"p{k} AS (SELECT a.gid, a.u, b.v, sum(a.w * b.w) AS w FROM p{k - 1} a JOIN p1 b ON a.gid = b.gid AND a.v = b.u GROUP BY a.gid, a.u, b.v)")
    return ", ".join(parts)


def diagonal_rows(steps: int, value: str) -> str:
    return " UNION ALL ".join(f"SELECT gid, u AS vid, {k} AS step, {value} AS p FROM p{k} WHERE u = v" for k in range(1, steps + 1))


HYPER_P = (
    "SELECT a.gid, a.vid AS u, b.vid AS v, sum(1.0 / CAST(de.deg AS DOUBLE)) / any_value(CAST(dv.deg AS DOUBLE)) AS w FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid "
    "JOIN de ON de.gid = a.gid AND de.eid = a.eid JOIN dv ON dv.gid = a.gid AND dv.vid = a.vid GROUP BY a.gid, a.vid, b.vid"
)
GRAPH_P = "SELECT gid, u, v, 1.0 / CAST(count(*) OVER (PARTITION BY gid, u) AS DOUBLE) AS w FROM (SELECT * FROM sym UNION ALL SELECT DISTINCT gid, u, u FROM sym)"
COUNTS = "SELECT a.gid, a.vid AS u, b.vid AS v, count(*) AS w FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid GROUP BY a.gid, a.vid, b.vid"


EMB = "emb AS (SELECT vec_id AS gid, label AS y, unnest(range(64)) AS dim, unnest(embedding) AS x FROM embeddings)"
MEAN = "mean AS (SELECT CAST(y AS BIGINT) AS gid, dim, avg(CAST(x AS DOUBLE)) AS x FROM emb GROUP BY y, dim)"


def distance(p: int) -> str:
    return f"d AS (SELECT a.gid AS gid_a, b.gid AS gid_b, pow(sum(pow(abs(a.x - b.x), {p})), 1.0 / {p}) AS d FROM mean a JOIN mean b ON a.dim = b.dim GROUP BY a.gid, b.gid)"


def grid(edges: int, members: int) -> str:
    return f"(SELECT e.i AS eid, j.i AS j FROM range({edges}) e(i), range({members}) j(i))"


KNN = (
    f"WITH {EMB}, pt AS (SELECT gid, min(y) AS y FROM emb GROUP BY gid), "
    "d AS (SELECT a.vec_id AS gid_a, b.vec_id AS gid_b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d "
    "FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY gid_a ORDER BY d, gid_b) AS r FROM d), "
    "n AS (SELECT gid_a, y, count(*) AS n FROM r JOIN pt ON pt.gid = gid_b WHERE r <= 3 GROUP BY gid_a, y), "
    "knn AS (SELECT gid_a AS gid, y AS pred FROM (SELECT *, row_number() OVER (PARTITION BY gid_a ORDER BY n DESC, y) AS k FROM n) WHERE k = 1)"
)
RANKED = "SELECT o_custkey AS gid FROM orders GROUP BY 1"

ORACLES: dict[str, str] = {
    "hg_incidence": f"WITH {A} SELECT * FROM inc",
    "hg_degree_v": f"WITH {A}, {DV} SELECT * FROM dv",
    "hg_degree_e": f"WITH {A}, {DE} SELECT * FROM de",
    "label_dense_rank": f"WITH {A}, {DV} SELECT gid, vid, deg, CAST(dense_rank() OVER (ORDER BY deg) - 1 AS INTEGER) AS lbl FROM dv",
    "multi_hot_labels": "SELECT doc_id, CAST(quality = 0 AS INTEGER) AS c0, CAST(quality = 1 AS INTEGER) AS c1, CAST(toxic = 1 AS INTEGER) AS c2 FROM labels",
    "clique_expand": f"WITH {A}, {ADJ} SELECT * FROM adj",
    "graph_to_hypergraph": f"WITH {A}, {ADJ} SELECT gid, u || '-' || v AS eid, u AS vid FROM adj UNION ALL SELECT gid, u || '-' || v, v FROM adj",
    "star_expand": f"WITH {A} SELECT gid, 'v:' || vid AS u, 'e:' || eid AS v FROM inc",
    "hyperedge_overlap": f"WITH {A} SELECT a.gid, a.eid AS e1, b.eid AS e2, count(*) AS shared FROM inc a JOIN inc b ON a.gid = b.gid AND a.vid = b.vid AND a.eid <= b.eid GROUP BY ALL",
    "vertex_cooccurrence": f"WITH {A} SELECT a.gid, a.vid AS u, b.vid AS v, count(*) AS together FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid AND a.vid <= b.vid GROUP BY ALL",
    "line_expand": f"WITH {A}, l AS (SELECT a.gid, a.eid, a.vid AS a, b.vid AS b FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid AND a.vid < b.vid) "
    "SELECT x.gid, count(*) AS arcs FROM l x JOIN l y ON x.gid = y.gid AND x.b = y.a GROUP BY x.gid",
    "hg_label_histogram": f"WITH {A}, {wl(0)} {FEATURES}",
    "wl_features_r2": f"WITH {A}, {wl(2)} {FEATURES}",
    "wl_gram": f"WITH {N}, {wl(2)} {gram()}",
    "wl_gram_oa": f"WITH {N}, {wl(2)} {gram(term='least(a.cnt, b.cnt)')}",
    "wl_kernel_norm": normal(f"{N}, {wl(2)}", "cnt * cnt", "a.cnt * b.cnt"),
    "wl_transform_unseen": f"WITH {N}, {wl(2)}, train AS (SELECT DISTINCT fid FROM feat WHERE gid % 5 <> 0) "
    "SELECT gid, fid, CAST(cnt AS BIGINT) AS cnt FROM feat WHERE gid % 5 = 0 AND fid IN (SELECT fid FROM train)",
    "hyedge_features": f"WITH {A}, {hyperedge_feat(2)} SELECT gid, fid, CAST(sum(cnt) AS BIGINT) AS cnt FROM feat GROUP BY gid, fid",
    "hyedge_kernel": normal(f"{N}, {hyperedge_feat(2)}", "cnt * cnt", "a.cnt * b.cnt"),
    "list_wl_features": f"WITH {A}, {list_wl(2)} {FEATURES}",
    "graph_wl_features": f"WITH {T}, {graph_wl(2)} {FEATURES}",
    "evmn_features": f"WITH {A}, {DV} SELECT gid, vid, round(deg / sum(deg) OVER (PARTITION BY gid), 9) AS p FROM dv",
    "return_prob_hyper": f"WITH {N}, {DV}, {DE}, {diagonals(HYPER_P, 3)} {diagonal_rows(3, 'round(w + 1e-12, 6)')}",
    "return_prob_graph": f"WITH {T}, {ADJ}, {diagonals(GRAPH_P, 3)} {diagonal_rows(3, 'round(w + 1e-12, 6)')}",
    "isomo_trace_features": f"WITH {A}, {diagonals(COUNTS, 3)}, rows AS ({diagonal_rows(3, 'w')}) SELECT gid, step, CAST(sum(p) AS BIGINT) AS trace FROM rows GROUP BY gid, step",
    "hom_edge": tree((0,)),
    "hom_path3": tree((0, 1)),
    "hom_star3": tree((0, 0, 0)),
    "hom_path4": tree((0, 1, 2)),
    "hom_fork5": tree((0, 0, 1, 1)),
    "hom_cycle3": f"WITH {T}, {ADJ} SELECT a.gid, count(*) AS hom FROM sym a JOIN sym b ON a.gid = b.gid AND a.v = b.u JOIN sym c ON c.gid = a.gid AND c.u = b.v AND c.v = a.u GROUP BY a.gid",
    "triangle_count": f"WITH {T}, {ADJ} SELECT a.gid, count(*) AS triangles FROM adj a JOIN adj b ON a.gid = b.gid AND a.v = b.u JOIN adj c ON c.gid = a.gid AND c.u = a.u AND c.v = b.v GROUP BY a.gid",
    "graphlet3_counts": f"WITH {T}, {ADJ}, w AS (SELECT gid, sum(d * (d - 1) / 2) AS w FROM (SELECT gid, u, count(*) AS d FROM sym GROUP BY gid, u) GROUP BY gid), "
    "t AS (SELECT a.gid, count(*) AS t FROM adj a JOIN adj b ON a.gid = b.gid AND a.v = b.u JOIN adj c ON c.gid = a.gid AND c.u = a.u AND c.v = b.v GROUP BY a.gid) "
    "SELECT w.gid, coalesce(t, 0) AS triangles, CAST(w - 3 * coalesce(t, 0) AS BIGINT) AS paths FROM w LEFT JOIN t ON t.gid = w.gid",
    "pairwise_l1": f"WITH {EMB}, {MEAN}, {distance(1)} SELECT gid_a, gid_b, round(d, 5) AS d FROM d",
    "pairwise_l2": f"WITH {EMB}, {MEAN}, {distance(2)} SELECT gid_a, gid_b, round(d, 5) AS d FROM d",
    "exp_median_kernel": f"WITH {EMB}, {MEAN}, {distance(2)}, s AS (SELECT quantile_disc(d, 0.5) AS s FROM d) SELECT gid_a, gid_b, round(exp(-d / (s + 1e-5)), 5) AS k FROM d, s",
    "kernel_sum": f"WITH {N}, {wl(1)}, g AS ({gram()}), o AS ({gram(term='least(a.cnt, b.cnt)')}) "
    "SELECT gid_a, gid_b, CAST(sum(k) AS BIGINT) AS k FROM (SELECT * FROM g UNION ALL SELECT * FROM o) GROUP BY gid_a, gid_b",
    "knn3_predict": f"{KNN} SELECT gid, pred FROM knn",
    "acc_f1_metrics": f"{KNN}, s AS (SELECT pt.y, pred FROM knn JOIN pt ON pt.gid = knn.gid), "
    "c AS (SELECT y AS c FROM s UNION SELECT pred FROM s), "
    "f AS (SELECT c, (SELECT count(*) FROM s WHERE y = c) AS t, (SELECT count(*) FROM s WHERE pred = c) AS p, (SELECT count(*) FROM s WHERE y = c AND pred = c) AS hit FROM c), "
    "g AS (SELECT *, 2.0 * hit / CAST(t + p AS DOUBLE) AS f1 FROM f) SELECT round(CAST(sum(hit) AS DOUBLE) / sum(t), 9) AS accuracy, round(CAST(sum(hit) AS DOUBLE) / sum(t), 9) AS f1_micro, "
    "round(avg(f1), 9) AS f1_macro, round(CAST(sum(f1 * t) AS DOUBLE) / sum(t), 9) AS f1_weighted FROM g",
    "hamming_loss": "SELECT round(avg(CAST(quality <> toxic AS DOUBLE)), 9) AS loss FROM labels",
    "adjusted_rand": f"{KNN}, p AS (SELECT pt.y AS a, pred AS b FROM knn JOIN pt ON pt.gid = knn.gid), "
    "cell AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY a, b), ij AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM cell), "
    "i AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM cell GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM cell GROUP BY b)) "
    "SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 9) AS ari FROM ij, i, j",
    "kfold_assign": f"WITH c AS ({RANKED}), r AS (SELECT gid, row_number() OVER (ORDER BY md5(CAST(gid AS VARCHAR)), gid) - 1 AS r, count(*) OVER () AS n FROM c) "
    "SELECT gid, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r",
    "cv_mean_var": "SELECT doc_id % 5 AS fold, round(avg(CAST(quality AS DOUBLE)), 9) AS mean, round(var_pop(CAST(quality AS DOUBLE)), 9) AS var FROM labels GROUP BY 1",
    "gen_flower": f"SELECT eid, eid * 3 + j AS vid FROM {grid(20, 3)} UNION ALL SELECT eid, 60 + j FROM {grid(20, 4)}",
    "gen_cycle": f"SELECT DISTINCT eid, (eid * 5 + j) % 100 AS vid FROM {grid(20, 7)}",
    "gen_wheel": f"SELECT DISTINCT eid, (eid * 5 + j) % 100 AS vid FROM {grid(20, 7)} UNION ALL SELECT eid, 100 + j FROM {grid(20, 3)}",
    "gen_chain": f"SELECT eid, eid * 5 + j AS vid FROM {grid(20, 7)}",
    "gen_lattice": f"SELECT eid, eid * 9 + j AS vid FROM {grid(9, 9)} UNION ALL SELECT eid + 9, j * 9 + eid FROM {grid(9, 9)}",
}



def sums(rounds: int) -> str:
    """CTEs of the numeric refinement: labels get ids in the order of first sight, vertices of a round after its edges."""
    parts = [
        DV,
        DE,
        "dv0 AS (SELECT deg, row_number() OVER (ORDER BY min(ROW(gid, vid))) - 1 AS id FROM dv GROUP BY deg)",
        "v0 AS (SELECT gid, vid, id FROM dv JOIN dv0 USING (deg))",
        "de0 AS (SELECT deg, (SELECT count(*) FROM dv0) + row_number() OVER (ORDER BY min(ROW(gid, eid))) - 1 AS id FROM de GROUP BY deg)",
        "e0 AS (SELECT gid, eid, id FROM de JOIN de0 USING (deg))",
    ]
    before = ["dv0", "de0"]
    for r in range(1, rounds + 1):
        for kind, other, key in (("e", "v", "eid"), ("v", "e", "vid")):
            inner, near = ("vid", f"v{r - 1}") if kind == "e" else ("eid", f"e{r}")
            size = " + ".join(f"(SELECT count(*) FROM {x})" for x in before)
            parts += [
                f"s{kind}{r} AS (SELECT i.gid, i.{key}, sum(x.id) AS s FROM inc i JOIN {near} x ON x.gid = i.gid AND x.{inner} = i.{inner} GROUP BY i.gid, i.{key})",
                f"l{kind}{r} AS (SELECT o.gid, o.{key}, o.id AS own, s FROM {kind}{r - 1} o JOIN s{kind}{r} n ON n.gid = o.gid AND n.{key} = o.{key})",
                f"d{kind}{r} AS (SELECT own, s, {size} + row_number() OVER (ORDER BY min(ROW(gid, {key}))) - 1 AS id FROM l{kind}{r} GROUP BY own, s)",
                f"{kind}{r} AS (SELECT l.gid, l.{key}, d.id FROM l{kind}{r} l JOIN d{kind}{r} d ON d.own = l.own AND d.s = l.s)",
            ]
            before.append(f"d{kind}{r}")
    union = " UNION ALL ".join(f"SELECT gid, CAST(id AS VARCHAR) AS fid, count(*) AS cnt FROM v{r} GROUP BY gid, id" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


def early(rounds: int, threshold: int) -> str:
    """Rare labels are copied from round 2 on; a round counts only if every round before it brought a common label."""
    parts = wl(rounds).rsplit(", feat AS", 1)[0]
    for r in range(2, rounds + 1):
        for kind, key in (("e", "eid"), ("v", "vid")):
            near = f"m{r} m" if kind == "e" else f"a{r} a"
            fresh = f"md5('{kind}|' || {kind}.lbl || '|' || {near[-1]}.near)"
            parts = parts.replace(
                f"{kind}{r} AS (SELECT {kind}.gid, {kind}.{key}, {fresh} AS lbl FROM {kind}{r - 1} {kind} ",
                f"{kind}{r} AS (SELECT {kind}.gid, {kind}.{key}, CASE WHEN {kind}.lbl IN (SELECT lbl FROM {kind}{r - 1} GROUP BY lbl HAVING count(*) >= {threshold}) "
                f"THEN {fresh} ELSE md5('f|' || {kind}.lbl) END AS lbl FROM {kind}{r - 1} {kind} ",
            )
    common = lambda r: f"EXISTS (SELECT 1 FROM v{r} GROUP BY lbl HAVING count(*) >= {threshold})"
    union = []
    for r in range(rounds + 1):
        goes_on = [f"({common(0)} OR {common(1)})"] * (r >= 2) + [common(k) for k in range(2, r)]
        union.append(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM v{r} WHERE {' AND '.join(goes_on) or 'TRUE'} GROUP BY gid, lbl")
    return f"{parts}, feat AS ({' UNION ALL '.join(union)})"


def pairs(rounds: int) -> str:
    parts = [
        ADJ,
        "l AS (SELECT gid, u AS vid, md5('v|' || count(*)) AS lbl FROM sym GROUP BY gid, u)",
        "p0 AS (SELECT a.gid, a.vid AS u, b.vid AS v, md5('p|' || least(a.lbl, b.lbl) || '|' || greatest(a.lbl, b.lbl)) AS lbl FROM l a JOIN l b ON a.gid = b.gid)",
    ]
    for r in range(1, rounds + 1):
        parts += [
            f"q{r} AS (SELECT a.gid, a.u, b.u AS v, p.lbl || ':' || count(*) AS c FROM sym a JOIN p{r - 1} p ON p.gid = a.gid AND p.u = a.v JOIN sym b ON b.gid = p.gid AND b.v = p.v GROUP BY a.gid, a.u, b.u, p.lbl)",
            f"n{r} AS (SELECT gid, u, v, string_agg(c, ',' ORDER BY c) AS near FROM q{r} GROUP BY gid, u, v)",
            f"p{r} AS (SELECT p.gid, p.u, p.v, md5('p|' || lbl || '|' || near) AS lbl FROM p{r - 1} p JOIN n{r} n ON n.gid = p.gid AND n.u = p.u AND n.v = p.v)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM p{r} WHERE {r} = 0 OR u <= v GROUP BY gid, lbl" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


def lines(rounds: int) -> str:
    parts = [DE, "l AS (SELECT a.gid, a.eid, a.vid AS a, b.vid AS b, md5('l|' || md5('e|' || de.deg)) AS lbl FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid AND a.vid < b.vid JOIN de ON de.gid = a.gid AND de.eid = a.eid)"]
    union = []
    for side, sends, gets in (("in", "b", "a"), ("out", "a", "b")):
        parts.append(f"{side}0 AS (SELECT * FROM l)")
        for r in range(1, rounds + 1):
            parts += [
                f"{side}n{r} AS (SELECT gid, {sends} AS at, string_agg(lbl, ',' ORDER BY lbl) AS near FROM {side}{r - 1} GROUP BY gid, {sends})",
                f"{side}{r} AS (SELECT x.gid, x.eid, x.a, x.b, md5('{side}|' || lbl || '|' || coalesce(near, '')) AS lbl FROM {side}{r - 1} x LEFT JOIN {side}n{r} n ON n.gid = x.gid AND n.at = x.{gets})",
            ]
        union += [f"SELECT gid, '{side}:' || lbl AS fid, count(*) AS cnt FROM {side}{r} GROUP BY gid, lbl" for r in range(rounds + 1)]
    return ", ".join([*parts, f"feat AS ({' UNION ALL '.join(union)})"])


ORACLES |= {
    "sum_wl_features": f"WITH {A}, {sums(2)} {FEATURES}",
    "ewl_features": f"WITH {A}, {early(3, 3)} {FEATURES}",
    "two_wl_features": f"WITH {T}, {pairs(2)} {FEATURES}",
    "directed_line_features": f"WITH {A}, {lines(2)} {FEATURES}",
    "soft_edge_weights": f"WITH {A}, {DV}, {DE}, o AS (SELECT DISTINCT a.gid, a.eid AS e1, b.eid AS e2 FROM inc a JOIN inc b ON a.gid = b.gid AND a.vid = b.vid AND a.eid <= b.eid), "
    "h AS (SELECT i.gid, i.eid, deg, count(*) AS n FROM inc i JOIN dv ON dv.gid = i.gid AND dv.vid = i.vid GROUP BY i.gid, i.eid, deg), "
    "z AS (SELECT o.*, deg, n FROM o JOIN h ON h.gid = o.gid AND h.eid = o.e1 UNION ALL SELECT o.*, deg, -n FROM o JOIN h ON h.gid = o.gid AND h.eid = o.e2), "
    "y AS (SELECT gid, e1, e2, deg, abs(sum(n)) AS n FROM z GROUP BY gid, e1, e2, deg) "
    "SELECT y.gid, e1, e2, CAST(1 + CAST(any_value(a.deg) <> any_value(b.deg) AS INTEGER) + sum(n) AS BIGINT) AS w FROM y JOIN de a ON a.gid = y.gid AND a.eid = e1 JOIN de b ON b.gid = y.gid AND b.eid = e2 GROUP BY y.gid, e1, e2",
}

L1 = "d AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum(abs(a.x - b.x)) AS d FROM f a JOIN f b ON a.dim = b.dim GROUP BY a.gid, b.gid)"
MEDIAN = "s AS (SELECT quantile_disc(d, 0.5) AS s FROM d) SELECT gid_a, gid_b, round(exp(-d / (s + 1e-5)), 6) AS k FROM d, s"
ORACLES |= {
    "normalized_mutual_info": f"{KNN}, p AS (SELECT pt.y AS a, pred AS b FROM knn JOIN pt ON pt.gid = knn.gid), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM p), "
    "ab AS (SELECT a, b, count(*) / any_value(t) AS q FROM p, t GROUP BY a, b), qa AS (SELECT a, sum(q) AS q FROM ab GROUP BY a), qb AS (SELECT b, sum(q) AS q FROM ab GROUP BY b), "
    "i AS (SELECT sum(ab.q * ln(ab.q / (qa.q * qb.q))) AS i FROM ab JOIN qa USING (a) JOIN qb USING (b)), "
    "ha AS (SELECT -sum(q * ln(q)) AS ha FROM qa), hb AS (SELECT -sum(q * ln(q)) AS hb FROM qb) SELECT round(i / ((ha + hb) / 2), 6) AS nmi FROM i, ha, hb",
}

ORACLES["gen_fern"] = (
    f"SELECT eid, (eid // 2 + (eid % 2) * 5) * 3 + j AS vid FROM {grid(10, 3)} UNION ALL "
    "SELECT i, i // 2 + 30 FROM range(10) e(i) UNION ALL SELECT 10, i + 30 FROM range(5) v(i)"
)


# -- labels that are given, isolated vertices -----------------------------------------------------------

GIVEN = "verts AS (SELECT g.gid, p.vid, substr(p.vid, 1, 7) AS lbl FROM (SELECT DISTINCT gid FROM inc) g, (SELECT DISTINCT p_brand AS vid FROM part) p)"


def given(rounds: int) -> str:
    parts = [GIVEN, DE, "v0 AS (SELECT gid, vid, md5('v|' || lbl) AS lbl FROM verts)", "e0 AS (SELECT gid, eid, md5('e|' || deg) AS lbl FROM de)"]
    for r in range(1, rounds + 1):
        parts += [
            f"m{r} AS ({near(f'v{r - 1}', 'i.vid = x.vid', 'x.lbl', 'i.eid')})",
            f"e{r} AS (SELECT e.gid, e.eid, md5('e|' || e.lbl || '|' || m.near) AS lbl FROM e{r - 1} e JOIN m{r} m ON e.gid = m.gid AND e.eid = m.eid)",
            f"a{r} AS ({near(f'e{r}', 'i.eid = x.eid', 'x.lbl', 'i.vid')})",
            f"v{r} AS (SELECT v.gid, v.vid, md5('v|' || v.lbl || '|' || coalesce(a.near, '')) AS lbl FROM v{r - 1} v LEFT JOIN a{r} a ON v.gid = a.gid AND v.vid = a.vid)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, lbl AS fid, count(*) AS cnt FROM v{r} GROUP BY gid, lbl" for r in range(rounds + 1))
    return ", ".join([*parts, f"feat AS ({union})"])


# -- trees and other patterns ---------------------------------------------------------------------------


def tree_counts(trees: dict[str, tuple[int, ...]], adj: str = ADJ) -> str:
    """CTE homs(gid, pattern, hom): for each tree, sums over neighbours from the leaves up, each vertex of the tree a table."""
    parts, finals = [adj, "verts AS (SELECT DISTINCT gid, u AS vid FROM sym)"], []
    for name, parents in trees.items():
        for x in range(len(parents), -1, -1):
            below = [k for k, parent in enumerate(parents, 1) if parent == x]
            value = " * ".join(["CAST(1 AS HUGEINT)", *(f"s{y}.s" for y in below)])
            joins = "".join(
                f" JOIN (SELECT s.gid, s.u AS vid, sum(h.h) AS s FROM sym s JOIN {name}_{y} h ON h.gid = s.gid AND h.vid = s.v GROUP BY s.gid, s.u) s{y} ON s{y}.gid = t.gid AND s{y}.vid = t.vid"
                for y in below
            )
            parts.append(f"{name}_{x} AS (SELECT t.gid, t.vid, {value} AS h FROM verts t{joins})")
        finals.append(f"SELECT gid, '{name}' AS pattern, CAST(sum(h) AS BIGINT) AS hom FROM {name}_0 GROUP BY gid")
    return ", ".join([*parts, f"homs AS ({' UNION ALL '.join(finals)})"])


TREES6, PATHS6 = all_trees(6), paths(6)
STAR = "adj AS (SELECT gid, 'v:' || vid AS u, 'e:' || eid AS v FROM inc), sym AS (SELECT gid, u, v FROM adj UNION ALL SELECT gid, v AS u, u AS v FROM adj)"
#: A distance of sparse vectors f(gid, dim, x), absent entries being zero.
SPARSE = (
    "ids AS (SELECT DISTINCT gid FROM inc), dims AS (SELECT DISTINCT dim FROM f), full_f AS (SELECT ids.gid, dims.dim, coalesce(f.x, 0) AS x FROM ids CROSS JOIN dims LEFT JOIN f ON f.gid = ids.gid AND f.dim = dims.dim)"
)


def exponential(p: int, extra: float, places: int = 6) -> str:
    power = "sum(abs(a.x - b.x))" if p == 1 else "sqrt(sum((a.x - b.x) * (a.x - b.x)))"
    return (
        f"{SPARSE}, d AS (SELECT a.gid AS gid_a, b.gid AS gid_b, round({power}, 9) AS d FROM full_f a JOIN full_f b ON a.dim = b.dim GROUP BY a.gid, b.gid), "
        f"sigma AS (SELECT quantile_disc(d, 0.5) AS s FROM d), ex AS (SELECT gid_a, gid_b, CASE WHEN s + {extra} > 0 THEN exp(-d / (s + {extra})) ELSE CAST(d = 0 AS DOUBLE) END AS k FROM d, sigma)"
    )


LOGS = "f AS (SELECT gid, pattern AS dim, ln(hom) AS x FROM homs)"
#: Distances by a recursive query that keeps a row for each pair and goes on from the pairs that were new.
REACH = (
    "reached(gid, u, v, d) USING KEY (gid, u, v) AS (SELECT gid, u, v, 1 AS d FROM sym UNION SELECT w.gid, w.u, s.v, w.d + 1 FROM reached w JOIN sym s ON s.gid = w.gid AND s.u = w.v AND s.v <> w.u "
    "LEFT JOIN recurring.reached r ON r.gid = w.gid AND r.u = w.u AND r.v = s.v WHERE r.d IS NULL), "
    "verts AS (SELECT DISTINCT gid, u AS vid FROM sym), "
    "every AS (SELECT a.gid, CASE WHEN a.vid = b.vid THEN 2 ELSE least(coalesce(r.d, 39), 39) END AS d FROM verts a JOIN verts b ON a.gid = b.gid LEFT JOIN reached r ON r.gid = a.gid AND r.u = a.vid AND r.v = b.vid), "
    "hist AS (SELECT gid, d, count(*) AS n FROM every GROUP BY gid, d)"
)
BINNED = (
    "ends AS (SELECT gid, min(d) AS lo, max(d) AS hi FROM hist GROUP BY gid), lim AS (SELECT gid, CASE WHEN lo = hi THEN lo - 1 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 1 ELSE hi END AS hi FROM ends), "
    "f AS (SELECT hist.gid, least(39, CAST(floor((d - lo) * 40 / CAST(hi - lo AS DOUBLE)) AS INTEGER)) AS dim, CAST(sum(n) AS DOUBLE) AS x FROM hist JOIN lim ON lim.gid = hist.gid GROUP BY hist.gid, dim)"
)
NT = incidence("nation", "l_suppkey")
WEIGHTS = (
    "h AS (SELECT i.gid, i.eid, deg, count(*) AS n FROM inc i JOIN dv ON dv.gid = i.gid AND dv.vid = i.vid GROUP BY i.gid, i.eid, deg), "
    "o AS (SELECT DISTINCT a.gid, a.eid AS e1, b.eid AS e2 FROM inc a JOIN inc b ON a.gid = b.gid AND a.vid = b.vid), "
    "z AS (SELECT o.*, deg, n FROM o JOIN h ON h.gid = o.gid AND h.eid = o.e1 UNION ALL SELECT o.*, deg, -n FROM o JOIN h ON h.gid = o.gid AND h.eid = o.e2), "
    "y AS (SELECT gid, e1, e2, sum(n) AS n FROM (SELECT gid, e1, e2, deg, abs(sum(n)) AS n FROM z GROUP BY gid, e1, e2, deg) GROUP BY gid, e1, e2), "
    "m AS (SELECT y.gid, e1, e2, 0.2 * (1 + CAST(a.deg <> b.deg AS INTEGER) + n) + CASE WHEN e1 = e2 THEN 0.8 / a.deg ELSE 0 END AS m "
    "FROM y JOIN de a ON a.gid = y.gid AND a.eid = e1 JOIN de b ON b.gid = y.gid AND b.eid = e2)"
)
SOFT_P = "SELECT a.gid, a.vid AS u, b.vid AS v, sum(CAST(m AS DOUBLE)) / any_value(CAST(dv.deg AS DOUBLE)) AS w FROM inc a JOIN m ON m.gid = a.gid AND m.e1 = a.eid JOIN inc b ON b.gid = a.gid AND b.eid = m.e2 JOIN dv ON dv.gid = a.gid AND dv.vid = a.vid GROUP BY a.gid, a.vid, b.vid"
SYMMETRIC_P = (
    "SELECT a.gid, a.vid AS u, b.vid AS v, sum(1.0 / CAST(de.deg AS DOUBLE)) / sqrt(CAST(any_value(x.deg) * any_value(y.deg) AS DOUBLE)) AS w FROM inc a JOIN inc b ON a.gid = b.gid AND a.eid = b.eid "
    "JOIN de ON de.gid = a.gid AND de.eid = a.eid JOIN dv x ON x.gid = a.gid AND x.vid = a.vid JOIN dv y ON y.gid = b.gid AND y.vid = b.vid GROUP BY a.gid, a.vid, b.vid"
)


def rooted(lengths: int) -> str:
    parts = [
        DV,
        DE,
        "m AS (SELECT gid, count(*) AS m FROM de GROUP BY gid)",
        "r1 AS (SELECT de.gid, eid, CAST(deg AS VARCHAR) AS seq, 1.0 / CAST(m AS DOUBLE) AS p FROM de JOIN m ON m.gid = de.gid)",
    ]
    for k in range(2, lengths + 1):
        parts += [
            f"h{k} AS (SELECT r.gid, i.vid, seq, sum(p / deg) AS p FROM r{k - 1} r JOIN inc i ON i.gid = r.gid AND i.eid = r.eid JOIN de ON de.gid = r.gid AND de.eid = r.eid GROUP BY r.gid, i.vid, seq)",
            f"r{k} AS (SELECT h.gid, i.eid, h.seq || ',' || any_value(de.deg) AS seq, sum(p / dv.deg) AS p FROM h{k} h JOIN inc i ON i.gid = h.gid AND i.vid = h.vid JOIN dv ON dv.gid = h.gid AND dv.vid = h.vid "
            "JOIN de ON de.gid = i.gid AND de.eid = i.eid GROUP BY h.gid, i.eid, h.seq)",
        ]
    union = " UNION ALL ".join(f"SELECT gid, {k} AS length, seq, sum(p) AS p FROM r{k} GROUP BY gid, seq" for k in range(1, lengths + 1))
    return ", ".join([*parts, f"seqs AS ({union})"])


def four_cycles() -> str:
    return (
        "SELECT a.gid, count(*) // 8 AS cycles FROM sym a JOIN sym b ON b.gid = a.gid AND b.u = a.v JOIN sym c ON c.gid = a.gid AND c.u = b.v JOIN sym d ON d.gid = a.gid AND d.u = c.v AND d.v = a.u "
        "WHERE a.u <> b.v AND a.v <> c.v GROUP BY a.gid"
    )


GRAPHLET4 = (
    "q AS (SELECT a.gid, a.vid AS a, b.vid AS b, c.vid AS c, d.vid AS d FROM verts a JOIN verts b ON b.gid = a.gid AND b.vid > a.vid JOIN verts c ON c.gid = a.gid AND c.vid > b.vid JOIN verts d ON d.gid = a.gid AND d.vid > c.vid), "
    "bits AS (SELECT q.*, (x1.u IS NOT NULL)::INT ab, (x2.u IS NOT NULL)::INT ac, (x3.u IS NOT NULL)::INT ad, (x4.u IS NOT NULL)::INT bc, (x5.u IS NOT NULL)::INT bd, (x6.u IS NOT NULL)::INT cd FROM q "
    "LEFT JOIN adj x1 ON x1.gid = q.gid AND x1.u = a AND x1.v = b LEFT JOIN adj x2 ON x2.gid = q.gid AND x2.u = a AND x2.v = c LEFT JOIN adj x3 ON x3.gid = q.gid AND x3.u = a AND x3.v = d "
    "LEFT JOIN adj x4 ON x4.gid = q.gid AND x4.u = b AND x4.v = c LEFT JOIN adj x5 ON x5.gid = q.gid AND x5.u = b AND x5.v = d LEFT JOIN adj x6 ON x6.gid = q.gid AND x6.u = c AND x6.v = d), "
    # the sorted degrees tell connected graphs on four vertices apart
    "deg AS (SELECT gid, array_to_string(list_sort([ab + ac + ad, ab + bc + bd, ac + bc + cd, ad + bd + cd]), '') AS s FROM bits), "
    "kinds AS (SELECT * FROM (VALUES ('1122', '{path}'), ('1113', '{star}'), ('2222', '{ring}'), ('1223', '{paw}'), ('2233', '{diamond}'), ('3333', '{all}')) k(s, fid))"
)


def graphlet4() -> str:
    ab, ac, ad, bc, bd, cd = (1 << k for k in range(6))
    shapes = {"path": ab + bc + cd, "star": ab + ac + ad, "ring": ab + bc + cd + ad, "paw": ab + ac + bc + ad, "diamond": ab + bc + cd + ad + ac, "all": 63}
    codes = canonical_codes(4)
    text = GRAPHLET4
    for name, bits in shapes.items():
        text = text.replace("{" + name + "}", f"4:{codes[bits]}")
    return f"WITH {T}, {ADJ}, verts AS (SELECT DISTINCT gid, u AS vid FROM sym), {text} SELECT gid, fid, count(*) AS cnt FROM deg JOIN kinds USING (s) GROUP BY gid, fid"


POINTS = "pt AS (SELECT vec_id AS gid, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
LONG = "lg AS (SELECT gid, c, unnest(range(64)) AS dim, unnest(x) AS x FROM pt), mid AS (SELECT c, dim, avg(x) AS m FROM lg GROUP BY c, dim)"
ORACLES |= {
    "wl_features_given": f"WITH {A}, {given(2)} {FEATURES}",
    "rooted_expected_sequences": f"WITH {A}, {rooted(4)} SELECT gid, length, seq, round(p + 1e-12, 6) AS p FROM seqs",
    "rooted_kernel_fuse": f"WITH {N}, {rooted(4)}, w AS (SELECT gid, length, seq, 20 * pow(2, length) / 30 * p AS c FROM seqs) "
    "SELECT a.gid AS gid_a, b.gid AS gid_b, round(sum(a.c * b.c * pow(0.5, a.length)) + 1e-12, 5) AS k FROM w a JOIN w b ON a.seq = b.seq GROUP BY a.gid, b.gid",
    "automatic_walks": f"WITH {A}, {DV}, {DE}, e AS (SELECT gid, count(*) AS n, avg(deg) AS de FROM de GROUP BY gid), v AS (SELECT gid, avg(deg) AS dv FROM dv GROUP BY gid) "
    "SELECT e.gid, CAST(floor(n * pow(de * dv, 4) / 200 + 1e-9) AS BIGINT) AS walks FROM e JOIN v ON v.gid = e.gid",
    "soft_walk": f"WITH {A}, {DV}, {DE}, {WEIGHTS}, {diagonals(SOFT_P, 2)} {diagonal_rows(2, 'round(w + 1e-12, 5)')}",
    "symmetric_walk": f"WITH {N}, {DV}, {DE}, {diagonals(SYMMETRIC_P, 2)} {diagonal_rows(2, 'round(w + 1e-12, 6)')}",
    "lazy_walk": f"WITH {T}, {ADJ} SELECT gid, u, v, round(0.7 / CAST(count(*) OVER (PARTITION BY gid, u) AS DOUBLE) + 1e-12, 9) AS w FROM sym UNION ALL SELECT DISTINCT gid, u, u, 0.3 FROM sym",
    "hom_tree_profile": f"WITH {T}, {tree_counts(TREES6)} SELECT * FROM homs",
    "ghc_features": f"WITH {T}, {tree_counts(TREES6)} SELECT gid, pattern, round(ln(hom), 9) AS x FROM homs",
    "ghc_paths": f"WITH {T}, {tree_counts(PATHS6)} SELECT gid, pattern, round(ln(hom), 9) AS x FROM homs",
    "hom_diamond": f"WITH {T}, {ADJ} SELECT a.gid, count(*) AS hom FROM sym a JOIN sym b ON b.gid = a.gid AND b.u = a.v JOIN sym c ON c.gid = a.gid AND c.u = b.v JOIN sym d ON d.gid = a.gid AND d.u = c.v AND d.v = a.u "
    "JOIN sym e ON e.gid = a.gid AND e.u = a.u AND e.v = b.v GROUP BY a.gid",
    "injective_path_count": f"WITH {T}, {ADJ} SELECT a.gid, count(*) AS hom FROM sym a JOIN sym b ON b.gid = a.gid AND b.u = a.v JOIN sym c ON c.gid = a.gid AND c.u = b.v WHERE a.u <> b.v AND a.u <> c.v AND a.v <> c.v GROUP BY a.gid",
    "k_cycle_count": f"WITH {T}, {ADJ} {four_cycles()}",
    "graphlet4_counts": graphlet4(),
    "shortest_path_hist": f"WITH RECURSIVE {T}, {ADJ}, {REACH} SELECT gid, d, n FROM hist",
    "average_degree": f"WITH {A}, {GIVEN} SELECT round((SELECT count(*) FROM inc) / CAST(count(*) AS DOUBLE), 9) AS average FROM verts",
    "isolated_degrees": f"WITH {A}, {GIVEN}, {DV} SELECT verts.gid, verts.vid, coalesce(deg, 0) AS deg FROM verts LEFT JOIN dv ON dv.gid = verts.gid AND dv.vid = verts.vid",
    "distinct_label_counts": f"WITH {A}, {DV} SELECT count(DISTINCT deg) AS deg, count(DISTINCT vid) AS vid FROM dv",
    "one_hot_features": f"WITH {A}, {DV} SELECT gid, vid, CAST(dense_rank() OVER (ORDER BY deg) - 1 AS INTEGER) AS dim, CAST(1 AS DOUBLE) AS x FROM dv",
    "graph_components": f"WITH RECURSIVE {T}, {ADJ}, walk AS (SELECT gid, u AS vid, u AS seen FROM sym UNION SELECT w.gid, w.vid, s.v FROM walk w JOIN sym s ON s.gid = w.gid AND s.u = w.seen) "
    "SELECT gid, vid, min(seen) AS component FROM walk GROUP BY gid, vid",
    "tree_test": f"WITH RECURSIVE {T}, {ADJ}, walk AS (SELECT gid, u AS vid, u AS seen FROM sym UNION SELECT w.gid, w.vid, s.v FROM walk w JOIN sym s ON s.gid = w.gid AND s.u = w.seen), "
    "c AS (SELECT gid, vid, min(seen) AS c FROM walk GROUP BY gid, vid), n AS (SELECT gid, count(*) AS n, count(DISTINCT c) AS p FROM c GROUP BY gid), m AS (SELECT gid, count(*) AS m FROM adj GROUP BY gid) "
    "SELECT n.gid, p = 1 AND m = n.n - 1 AS tree FROM n JOIN m ON m.gid = n.gid",
    "induced_edges": f"WITH {T}, {ADJ} SELECT gid, u, v FROM adj WHERE u LIKE '%A%' AND v LIKE '%A%'",
    "multilabel_metrics": "SELECT round(avg(CAST(quality = 1 AND toxic = 0 AS DOUBLE)), 9) AS exact_match, round(avg(CASE WHEN quality = 1 THEN 1.0 / (1 + toxic) ELSE 0.0 END), 9) AS accuracy, "
    "round(avg(CAST(quality = 1 AS DOUBLE)), 9) AS precision FROM labels",
    "class_accuracies": f"{KNN} SELECT pt.y, CAST(sum(CAST(pt.y = pred AS INTEGER)) AS BIGINT) AS hits, count(*) AS total, round(avg(CAST(pt.y = pred AS DOUBLE)), 9) AS accuracy FROM knn JOIN pt ON pt.gid = knn.gid GROUP BY pt.y",
    "train_test_split": f"WITH c AS ({RANKED}), r AS (SELECT gid, row_number() OVER (ORDER BY md5('2:' || gid), gid) - 1 AS r, count(*) OVER () AS n FROM c) SELECT gid, r < ceil(n * 0.1 - 1e-9) AS test FROM r",
    "kfold_seeded": f"WITH c AS ({RANKED}), r AS (SELECT gid, row_number() OVER (ORDER BY md5('2023:' || gid), gid) - 1 AS r, count(*) OVER () AS n FROM c) "
    "SELECT gid, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r",
    "silhouette": f"WITH {POINTS}, m AS (SELECT a.gid, a.c AS ca, b.c AS cb, avg(list_distance(a.x, b.x)) AS m FROM pt a JOIN pt b ON a.gid <> b.gid GROUP BY a.gid, a.c, b.c), "
    "ab AS (SELECT gid, max(CASE WHEN ca = cb THEN m END) AS a, min(CASE WHEN ca <> cb THEN m END) AS b FROM m GROUP BY gid) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab",
    "davies_bouldin": f"WITH {POINTS}, {LONG}, s AS (SELECT c, avg(d) AS s FROM (SELECT lg.c, gid, sqrt(sum((x - m) * (x - m))) AS d FROM lg JOIN mid ON mid.c = lg.c AND mid.dim = lg.dim GROUP BY lg.c, gid) GROUP BY c), "
    "b AS (SELECT p.c AS ca, q.c AS cb, sqrt(sum((p.m - q.m) * (p.m - q.m))) AS d FROM mid p JOIN mid q ON p.dim = q.dim AND p.c <> q.c GROUP BY p.c, q.c), "
    "r AS (SELECT ca, max((x.s + y.s) / d) AS r FROM b JOIN s x ON x.c = ca JOIN s y ON y.c = cb GROUP BY ca) SELECT round(avg(r), 6) AS davies_bouldin FROM r",
    "calinski_harabasz": f"WITH {POINTS}, {LONG}, g AS (SELECT dim, avg(x) AS g FROM lg GROUP BY dim), n AS (SELECT c, count(*) AS n FROM pt GROUP BY c), t AS (SELECT sum(n) AS t, count(*) AS k FROM n), "
    "b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM mid JOIN g ON g.dim = mid.dim JOIN n ON n.c = mid.c), w AS (SELECT sum((x - m) * (x - m)) AS w FROM lg JOIN mid ON mid.c = lg.c AND mid.dim = lg.dim) "
    "SELECT round(b * (t - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, w, t",
    "event_sessions": "SELECT DISTINCT user_id AS gid, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS eid, event_type AS vid FROM events",
}


# -- kernels by their names -----------------------------------------------------------------------------


def named(head: str, how: str = "product") -> str:
    square, term = ("cnt * cnt", "a.cnt * b.cnt") if how == "product" else ("cnt", "least(a.cnt, b.cnt)")
    return (
        f"WITH {head}, tot AS (SELECT gid, fid, sum(cnt) AS cnt FROM feat GROUP BY gid, fid), g AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum({term}) AS k FROM tot a JOIN tot b ON a.fid = b.fid GROUP BY a.gid, b.gid), "
        f"own AS (SELECT gid, sum({square}) AS own FROM tot GROUP BY gid) SELECT gid_a, gid_b, round(k / sqrt(CAST(a.own AS DOUBLE) * CAST(b.own AS DOUBLE)), 9) AS k FROM g JOIN own a ON a.gid = gid_a JOIN own b ON b.gid = gid_b"
    )


MOTIFS = (
    f"WITH {N}, f AS (SELECT vec_id AS gid, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT gid FROM inc)), o AS (SELECT gid, list_dot_product(x, x) AS o FROM f) "
    "SELECT a.gid AS gid_a, b.gid AS gid_b, round(list_dot_product(a.x, b.x) / sqrt(p.o * q.o), 6) AS k FROM f a, f b, o p, o q WHERE p.gid = a.gid AND q.gid = b.gid"
)
ORACLES |= {
    "ghc_kernel": f"WITH {N}, {tree_counts(TREES6)}, {LOGS}, {exponential(1, 0)} SELECT gid_a, gid_b, round(k, 6) AS k FROM ex",
    "kernel_graph_subtree": named(f"{N}, {graph_wl(4)}"),
    "kernel_graph_2wl": named(f"{N}, {pairs(2)}"),
    "kernel_hypergraph_subtree": named(f"{N}, {wl(4)}", "least"),
    "kernel_hypergraph_oa": named(f"{N}, {wl(4)}", "least"),
    "kernel_hypergraph_hyedge": named(f"{N}, {hyperedge_feat(4)}"),
    "kernel_hypergraph_ewl": named(f"{N}, {early(2, 2)}"),
    "kernel_hypergraph_sum_wl": named(f"{N}, {sums(2)}"),
    "kernel_hypergraph_directed_line": named(f"{N}, {lines(4)}"),
    "kernel_hypergraph_v_e": named(f"{N}, {wl(0)}"),
    "kernel_hypergraph_ve": named(f"{N}, {wl(0)}"),
    "kernel_graph_homo": f"WITH {NT}, {tree_counts(TREES6)}, {LOGS}, {exponential(1, 0)} SELECT gid_a, gid_b, round(k, 6) AS k FROM ex",
    "kernel_graph_shortestpath": f"WITH RECURSIVE {NT}, {ADJ}, {REACH}, {BINNED}, {exponential(2, 0)} SELECT gid_a, gid_b, round(k, 6) AS k FROM ex",
    "kernel_hypergraph_sck": f"WITH {N}, {wl(2)}, tot AS (SELECT gid, fid, sum(cnt) AS cnt FROM feat GROUP BY gid, fid), g AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum(a.cnt * b.cnt) AS k FROM tot a JOIN tot b ON a.fid = b.fid GROUP BY a.gid, b.gid), "
    f"own AS (SELECT gid, sum(cnt * cnt) AS own FROM tot GROUP BY gid), {tree_counts(PATHS6, STAR)}, {LOGS}, {exponential(1, 0)} "
    "SELECT ex.gid_a, ex.gid_b, round(ex.k + coalesce(g.k / sqrt(CAST(a.own AS DOUBLE) * CAST(b.own AS DOUBLE)), 0), 6) AS k FROM ex LEFT JOIN g ON g.gid_a = ex.gid_a AND g.gid_b = ex.gid_b "
    "JOIN own a ON a.gid = ex.gid_a JOIN own b ON b.gid = ex.gid_b",
    "kernel_hypergraph_motifs": MOTIFS,
    "kernel_hypergraph_mochy": MOTIFS,
}
#: The largest of: logarithm of a class's share, less half the sum of log(2 pi v) + (x - m)^2 / v, v slightly widened.
ORACLES["nb_predict"] = (
    f"WITH {POINTS}, lg AS (SELECT gid, c, unnest(range(64)) AS dim, unnest(x) AS x FROM pt), tr AS (SELECT * FROM lg WHERE gid % 5 <> 0), "
    "eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM tr GROUP BY dim)), st AS (SELECT c, dim, avg(x) AS m, var_pop(x) + any_value(e) AS v FROM tr, eps GROUP BY c, dim), "
    "n AS (SELECT c, count(DISTINCT gid) AS n FROM tr GROUP BY c), s AS (SELECT lg.gid, st.c, any_value(ln(n.n)) - 0.5 * sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) AS s "
    "FROM lg JOIN st ON st.dim = lg.dim JOIN n ON n.c = st.c WHERE lg.gid % 5 = 0 GROUP BY lg.gid, st.c) SELECT gid, CAST(arg_max(c, s) AS INTEGER) AS pred FROM s GROUP BY gid"
)
