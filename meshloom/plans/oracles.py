"""DuckDB SQL that states each query's result independently of the Spark code."""

from __future__ import annotations

POINTS = "pts as (select vec_id v, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings)"
BOX = "box as (select min(least(x, y, z)) low, max(greatest(x, y, z)) high from pts)"


def _cell(c: str, levels: int = 20, offset: int = 0) -> str:
    return f"(case when high > low then cast(trunc(({c} - low) / ((high - low) / {float(1 << levels)})) as bigint) else 0 end + {offset})"


def _bits(v: str, stride: int, at: int, bits: int) -> str:
    """Interleaving by an explicit sum over bits."""
    return f"list_sum(list_transform(range({bits}), lambda b: (({v} >> b) & 1) << (b * {stride} + {at})))::bigint"


def _morton3(x: str, y: str, z: str) -> str:
    return f"({_bits(x, 3, 0, 21)} + {_bits(y, 3, 1, 21)} + {_bits(z, 3, 2, 21)})"


CELLS = f"{BOX}, cells as (select v, x, y, z, {_cell('x')} cx, {_cell('y')} cy, {_cell('z')} cz from pts, box), keyed as (select v, x, y, z, {_morton3('cx', 'cy', 'cz')} morton from cells)"
KEYED = f"{POINTS}, {CELLS}"
SFC = f"{KEYED}, sfc as (select *, ntile(8) over (order by morton, v) - 1 as label from keyed)"

LATTICE = (
    "wide as (select min(k) w from range(1, 1000) t(k) where k * k * k >= (select count(*) from orders)), ids as (select o_orderkey e, w from orders, wide), "
    "cell as (select e, w, e // (w * w) i, (e // w) % w j, e % w k from ids)"
)
EDGES = (
    "edges as (select a.e u, b.e v from cell a join cell b on b.e = a.e + 1 and a.k < a.w - 1 union all select a.e, b.e from cell a join cell b on b.e = a.e + a.w and a.j < a.w - 1 "
    "union all select a.e, b.e from cell a join cell b on b.e = a.e + a.w * a.w and a.i < a.w - 1), arcs as (select u src, v dst from edges union all select v, u from edges)"
)
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
FACES = ((0, 3, 2, 1), (0, 1, 5, 4), (0, 4, 7, 3), (1, 2, 6, 5), (2, 3, 7, 6), (4, 5, 6, 7))


def _node(c: int) -> str:
    a, b, d = CORNERS[c]
    return f"((i + {a}) * (w + 1) * (w + 1) + (j + {b}) * (w + 1) + k + {d})"


NODES = f"nodes as (select e, unnest([{', '.join(_node(c) for c in range(8))}]) node from cell)"
FACED = "faced as (select e, unnest([" + ", ".join("list_sort([" + ", ".join(_node(c) for c in f) + "])" for f in FACES) + "]) face from cell)"
LABELS = "labels as (select e v, ntile(8) over (order by e) - 1 as label from ids)"
GRAPH = f"{LATTICE}, {EDGES}, {LABELS}"
CUT = "cut as (select e.u, e.v, a.label lu, b.label lv from edges e join labels a on a.v = e.u join labels b on b.v = e.v)"
ARCL = "arcl as (select src, dst, a.label ls, b.label ld from arcs join labels a on a.v = src join labels b on b.v = dst)"
SEEDS = "seeds as (select v, label from (select v, label, row_number() over (partition by label order by v) - 1 p, count(*) over (partition by label) n from labels) where p = n // 2)"
BFS = (
    "bfs(v, label, dist) using key (v) as (select v, label, 0 from seeds union select a.dst, min(b.label), min(b.dist) + 1 from bfs b join arcs a on a.src = b.v "
    "left join recurring.bfs r on r.v = a.dst where r.v is null group by a.dst)"
)
GROWN = f"with recursive {GRAPH}, {SEEDS}, {BFS}"
CO = (
    "co as (select distinct least(a.l_partkey, b.l_partkey) u, greatest(a.l_partkey, b.l_partkey) v from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 "
    "where a.l_partkey <> b.l_partkey), ca as (select u src, v dst from co union all select v, u from co), cd as (select src v, count(*) degree from ca group by 1)"
)
RUNS = "runs as (select l_suppkey % 10 mesh_idx, cast(pow(2, l_partkey % 5) as bigint) np, l_orderkey * 10 + l_linenumber run_idx, cast(round(l_extendedprice) as bigint) as time from lineitem)"
BEST = f"{RUNS}, best as (select mesh_idx, np, min(time) as time from runs group by all)"


def _pagerank() -> str:
    steps = ["r0 as (select v, 1000.0::double r from cd)"]
    for k in range(1, 16):
        steps.append(f"r{k} as (select a.dst v, sum(p.r / d.degree) r from r{k - 1} p join cd d on d.v = p.v join ca a on a.src = p.v group by 1)")
    return f"with {CO}, " + ", ".join(steps) + " select v, round(r, 4) as rank from r15"


def _hilbert() -> str:
    """Bit by bit, most significant first."""
    steps = ["h5 as (select p_partkey, (p_partkey % 64)::bigint x, (p_size % 64)::bigint y, 0::bigint d from part)"]
    for k in range(5, -1, -1):
        s, at = 1 << k, f"h{k}"
        steps.append(
            f"g{k} as (select *, case when x & {s} > 0 then 1 else 0 end rx, case when y & {s} > 0 then 1 else 0 end ry from {at}), "
            f"f{k} as (select p_partkey, d + {s * s} * xor(3 * rx, ry) d, ry, case when ry = 0 and rx = 1 then 63 - x else x end x, case when ry = 0 and rx = 1 then 63 - y else y end y from g{k}), "
            f"h{k - 1 if k else 'z'} as (select p_partkey, case when ry = 0 then y else x end x, case when ry = 0 then x else y end y, d from f{k})"
        )
    return "with " + ", ".join(steps) + " select p_partkey, d::bigint d from hz"


# Size bands over the ideal size and the adjustment of distances in each.  Fixed values.
HEAVY = ((3.2, 6), (2.5, 5), (2.0, 4), (1.7, 3), (1.5, 2), (1.2, 1))
LIGHT = ((0.2, -4), (0.4, -3), (0.6, -2), (0.8, -1))
ADJUST = "case " + " ".join(f"when n >= cast(trunc({f} * ideal) as bigint) then {k}" for f, k in HEAVY) + " " + " ".join(f"when n <= cast(trunc({f} * ideal) as bigint) then {k}" for f, k in LIGHT) + " else 0 end"
REFINED = (
    f"{GROWN}, sized as (select label, count(*) n, (select count(*) from bfs) // 8 ideal from bfs group by label), start as (select v, label, greatest(0, dist + {ADJUST}) dist from bfs join sized using (label)), "
    "fix(v, dist, label) using key (v) as (select v, dist, label from start union select v, m[1], m[2] from (select a.dst v, min([b.dist + 1, b.label]) m from fix b join arcs a on a.src = b.v group by a.dst) c "
    "where exists (select 1 from recurring.fix r where r.v = c.v and c.m < [r.dist, r.label])) select v, label::bigint as label, dist::bigint dist from fix"
)



def _rounds(start: str, best: str, take: str, columns: str, tables: str = "") -> str:
    """A recursive table r(it, v, label, dist, visit, changed) of whole states, a round a step, until one changes nothing.

    ``best`` gives (w, ...) from the state r; ``take`` tells which rows change and ``columns`` what to."""
    return (
        f"with recursive {GRAPH}, {SEEDS}{tables}, r(it, v, label, dist, visit, changed) as (select 0, i.e, s.label::bigint, {start}, 1::bigint, true from ids i left join seeds s on s.v = i.e union all "
        f"select it + 1, v, {columns}, take from (select p.it, p.v, p.label, p.dist, p.visit, b.*, coalesce(b.w is not null and ({take}), false) take from r p left join ({best}) b on b.w = p.v) where exists (select 1 from r where changed)), "
        "last as (select * from r where it = (select max(it) from r)) "
    )


def _ranked(weight: float, threshold: float, after: int | None) -> str:
    """Sums are taken in ascending order of their terms."""
    got = "select a.dst w, p.label other, list_reduce(list_sort(list(p.dist / d.k)), lambda x, y: x + y) got from r p join arcs a on a.src = p.v join deg d on d.v = p.v where p.label is not null group by 1, 2"
    best = f"select w, max(got) got, arg_max(other, [got, -other]) other from ({got}) group by w"
    text = _rounds(f"case when s.v is null then 0.0::double else {weight}::double end", best, f"p.label is null or b.got > {threshold} * p.dist", "case when take then other else label end, case when take then got else dist end, visit", ", deg as (select src v, count(*) k from arcs group by 1)")
    if after is None:
        return text + "select v, label from last"
    covered = f"(select min(it) + {after} from (select it from r group by it having count(label) = count(*)))"
    return text + f"select v, label from r where it = least({covered}, (select max(it) from r))"


def _stretched(sizes: str, tables: str = "") -> str:
    best = f"select a.dst w, min([p.dist + z.step, p.label]) m from r p join ({sizes}) z on z.label = p.label join arcs a on a.src = p.v where p.changed and p.label is not null group by 1"
    return _rounds("0.0::double", best, "p.label is null or b.m[1] < p.dist", "case when take then m[2]::bigint else label end, case when take then m[1] else dist end, visit", tables) + "select v, label from last"


BY_SIZE = "select label, round(log2(count(*)) + 1, 6) step from r where label is not null group by 1"
BY_CUT = (
    "select x.label, (coalesce(y.cut, 0) + x.front)::double step from (select label, count(*) filter (changed) front from r where label is not null group by 1) x left join "
    "(select f.label, count(*) cut from r f join arcs a on a.src = f.v join r g on g.v = a.dst where f.label is not null and (g.label is null or g.label <> f.label) group by 1) y on y.label = x.label"
)


def _stolen(ordered: bool) -> str:
    """A vertex's claim is (visit times) distance; a theft must lower it."""
    mine, theirs = ("p.visit * p.dist", "visit * dist") if ordered else ("p.dist", "dist")
    best = f"select a.dst w, min([{theirs}, label, dist]) m from r join arcs a on a.src = r.v where changed and label is not null group by 1"
    wanted = f"select p.*, m[2]::bigint part, m[3] + case when p.label is null then 1 else {1.0 if ordered else 0.5} end new from r p join ({best}) b on b.w = p.v where p.label is null or (m[2] <> p.label and {mine} > m[1])"
    placed = "select n.v w, n.part, n.new, l.last + row_number() over (partition by n.part order by n.v) place" if ordered else "select n.v w, n.part, n.new, n.visit place"
    final = f"{placed} from ({wanted}) n join (select label, max(visit) last from r where label is not null group by 1) l on l.label = n.part"
    lower = "b.place * b.new < p.visit * p.dist" if ordered else "b.new < p.dist"
    return _rounds("0.0::double", final, f"p.label is null or {lower}", "case when take then part else label end, case when take then new else dist end, case when take then place else visit end") + "select v, label from last"


REACH = (
    "reach(v, label, dist) using key (v, label) as (select v, label, 0 from seeds union select a.dst, b.label, min(b.dist) + 1 from reach b join arcs a on a.src = b.v "
    "left join recurring.reach r on r.v = a.dst and r.label = b.label where r.v is null group by a.dst, b.label)"
)


def _filled(first: str) -> str:
    """Vertices that ``first`` (v, label) lacks join the label with most of their neighbours, round by round."""
    votes = "select a.dst v, r.label, count(*) k from recurring.fl r join arcs a on a.src = r.v where not exists (select 1 from recurring.fl o where o.v = a.dst) and a.dst in (select b.dst from fl f join arcs b on b.src = f.v) group by 1, 2"
    return f"fl(v, label) using key (v) as ({first} union select v, arg_max(label, [k, -label]) from ({votes}) group by v) select v, label::bigint as label from fl"


def _proxy(factor: int, cap: str) -> str:
    """Growth ends with the first round in which every seed has enough vertices."""
    return (
        f"with recursive {GRAPH}, {SEEDS}, {REACH}, lay as (select label, dist, sum(count(*)) over (partition by label order by dist)::bigint total from reach group by label, dist), size as (select count(*) n from ids), "
        f"stop as (select max(d) d from (select label, min(case when total >= {factor} * (n // 8) then dist else 1000000 end) d from lay, size group by label)), "
        f"sp as (select r.v, arg_min(r.label, [l.total, r.label]) as label from reach r join lay l using (label, dist), stop, size where r.dist <= stop.d and {cap} group by r.v), {_filled('select v, label from sp')}"
    )


IDEAL = (
    f"with recursive {GRAPH}, {SEEDS}, cap(v, label) using key (v) as (select v, label from seeds union select a.dst, min(b.label) from cap b join arcs a on a.src = b.v "
    "where b.label in (select label from recurring.cap group by label having count(*) < 0.9 * (select count(*) from ids) / 8) and not exists (select 1 from recurring.cap o where o.v = a.dst) group by a.dst), "
    + _filled("select v, label from cap")
)
TWO_PASS = (
    f"{GROWN}, cost as (select label, round(pow(count(*) / ((select count(*) from bfs) / 8.0::double), 1.0::double / 3), 6) step from bfs group by label), "
    "fix(v, dist, label) using key (v) as (select v, 0.0::double, label from seeds union select v, m[1], m[2]::bigint from (select a.dst v, min([b.dist + c.step, b.label]) m from fix b join cost c on c.label = b.label join arcs a on a.src = b.v group by a.dst) n "
    "where not exists (select 1 from recurring.fix r where r.v = n.v and [r.dist, r.label] <= n.m)) select v, label::bigint as label from fix"
)

RUN = (
    f"with recursive {LATTICE}, {EDGES}, pts as (select e v, i + 0.5::double x, j + 0.5::double y, k + 0.5::double z from cell), {CELLS}, "
    f"labels as (select v, ntile(8) over (order by morton, v) - 1 as label, row_number() over (order by morton, v) g from keyed), seeds as (select v, label from (select v, label, row_number() over (partition by label order by g) - 1 p, count(*) over (partition by label) n from labels) where p = n // 2), {BFS}, "
    "pair as (select l.v, l.label a, b.label b from labels l join bfs b on b.v = l.v), far as (select x.v, any_value(x.a) a, any_value(x.b) b, bool_or(x.a <> y.a) fa, bool_or(x.b <> y.b) fb from arcs join pair x on x.v = src join pair y on y.v = dst group by x.v) "
    "select r.k::bigint as label, (select count(*) from pair where a = r.k) sfc_size, (select count(*) from far where a = r.k and fa) sfc_boundary, (select count(*) from pair where b = r.k) bfs_size, (select count(*) from far where b = r.k and fb) bfs_boundary from range(8) r(k)"
)
_CORNER = [f"[{a} * o_totalprice, {b}.0::double, {c}.0::double]" for a, b, c in CORNERS]


def _tet(t: tuple[int, ...]) -> str:
    def d(i: int, k: int) -> str:
        return f"({_CORNER[t[i]]}[{k}] - {_CORNER[t[0]]}[{k}])"

    return (
        f"abs({d(1, 1)} * ({d(2, 2)} * {d(3, 3)} - {d(2, 3)} * {d(3, 2)}) - {d(1, 2)} * ({d(2, 1)} * {d(3, 3)} - {d(2, 3)} * {d(3, 1)}) + {d(1, 3)} * ({d(2, 1)} * {d(3, 2)} - {d(2, 2)} * {d(3, 1)})) / 6"
    )


TETS = ((0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6))

ORACLES: dict[str, str] = {
    "morton_key_points": f"with {KEYED} select v, morton from keyed",
    "sfc_order_points": f"with {KEYED} select v, (row_number() over (order by morton, v) - 1)::bigint global_idx from keyed",
    "sfc_block_labels": f"with {SFC} select v, label::bigint as label from sfc",
    "sfc_floor_labels": f"with {KEYED} select v, least((row_number() over (order by morton, v) - 1) // greatest(1, (select count(*) from keyed) // 7), 6)::bigint as label from keyed",
    "part_mid_seeds": f"with {SFC} select label::bigint as label, v from (select v, label, row_number() over (partition by label order by morton, v) - 1 p, count(*) over (partition by label) n from sfc) where p = n // 2",
    "part_centroid_seeds": f"with {SFC}, m as (select label, avg(x) mx, avg(y) my, avg(z) mz from sfc group by label), d as (select s.label, v, round((x - mx) * (x - mx) + ((y - my) * (y - my) + (z - mz) * (z - mz)), 6) d2 from sfc s join m on m.label = s.label) select label::bigint as label, v from (select *, row_number() over (partition by label order by d2, v) rn from d) where rn = 1",
    "stride_samples": f"with {KEYED}, p as (select v, row_number() over (order by morton, v) - 1 position, count(*) over () n from keyed) select position::bigint as position, v from p where position % (n // 16) = 0 and position // (n // 16) < 16",
    "rank_compressed_morton": f"with {POINTS}, l as (select v, 0 axis, x val from pts union all select v, 1, y from pts union all select v, 2, z from pts), r as (select v, axis, row_number() over (order by val, v, axis) - 1 r from l), w as (select v, max(r) filter (axis = 0) r0, max(r) filter (axis = 1) r1, max(r) filter (axis = 2) r2 from r group by v) select v, {_morton3('r2', 'r1', 'r0')} morton from w",
    "min_gap_lattice": f"with {POINTS}, l as (select distinct * from (select 'x' axis, x val from pts union all select 'y', y from pts union all select 'z', z from pts)), g as (select axis, val - lag(val) over (partition by axis order by val) gap from l) select axis, min(gap) spacing from g group by axis",
    "hilbert2d_index": _hilbert(),
    "morton2d_index": f"select p_partkey, ({_bits('(p_partkey % 65536)', 2, 0, 17)} + {_bits('p_size::bigint', 2, 1, 17)})::bigint morton from part",
    "quantize_variants": f"with {POINTS}, {BOX} select v, {_cell('x', 19, 1)}::bigint qx, {_cell('y', 19, 1)}::bigint qy, {_cell('z', 19, 1)}::bigint qz from pts, box",
    "weighted_blocks": "with o as (select o_orderkey v, o_custkey w, sum(o_custkey) over (order by o_orderkey) - o_custkey b, sum(o_custkey) over () t from orders) select v, (least(b * 8 // t, 7))::bigint as label from o",
    "x_slices": f"with {POINTS}, b as (select min(x) low, max(x) high from pts) select v, least(floor((x - low) / (high - low) * 6), 5)::bigint as label from pts, b",
    "redistribute_index": f"with {KEYED} select v, v % 5 as label, (row_number() over (order by v % 5, morton, v) - 1)::bigint new_idx from keyed",
    "approximate_splitters": "select k::bigint k, round(q[k + 1], 4) as value from (select quantile_cont(o_totalprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) q from orders), range(7) t(k)",
    "face_edges": f"with {LATTICE}, {FACED} select min(e) u, max(e) v from faced group by face having count(*) = 2",
    "boundary_faces": f"with {LATTICE}, {FACED} select min(e) e, array_to_string(face, ',') face from faced group by face having count(*) = 1",
    "node_edges": f"with {LATTICE}, {NODES} select distinct a.e u, b.e v from nodes a join nodes b on a.node = b.node and a.e < b.e",
    "octree_edges": f"with {LATTICE}, {EDGES} select u, v from edges",
    "element_centroids": f"with {LATTICE} select e, i + 0.5::double x, j + 0.5::double y, k + 0.5::double z from cell",
    "vertex_degree": f"with {CO} select v, degree from cd",
    "csr_offsets": f"with {CO} select v, degree, (sum(degree) over (order by v) - degree)::bigint as offset from cd",
    "adjacency_list": f"with {CO} select src v, string_agg(dst::varchar, ',' order by dst) neighbors from ca group by 1",
    "ghost_counts": f"with {GRAPH}, {ARCL} select ls::bigint part, ld::bigint owner, count(distinct dst) ghosts from arcl where ls <> ld group by 1, 2",
    "scatter_map": f"with {GRAPH}, {ARCL} select distinct ld::bigint part, ls::bigint target, dst v from arcl where ls <> ld",
    "node_owner_index": f"with {LATTICE}, {NODES}, {LABELS}, o as (select node, min(label) owner from nodes join labels on v = e group by node) select node, owner::bigint as owner, (row_number() over (order by owner, node) - 1)::bigint node_idx from o",
    "distinct_nodes": f"with {LATTICE}, {NODES} select count(distinct node) nodes from nodes",
    "element_volume_tet5": f"select o_orderkey e, round({' + '.join(_tet(t) for t in TETS)}, 4) volume from orders",
    "partition_sizes": f"with {LATTICE}, {LABELS} select r.k::bigint as label, count(v) size from range(9) r(k) left join labels l on l.label = r.k group by 1",
    "partition_boundaries": f"with {GRAPH}, {ARCL} select r.k::bigint as label, count(distinct src) boundary from range(8) r(k) left join (select * from arcl where ls <> ld) a on a.ls = r.k group by 1",
    "partition_quality": f"with {GRAPH}, {ARCL}, s as (select label, count(*) n from labels group by 1), t as (select sum(n)::bigint n, max(n) mx, min(n) mn from s), b as (select count(distinct src) b from arcl where ls <> ld) select n, round(b / n, 9) as lambda, round(mx / (n // 8), 9) rho_max, round(mn / (n // 8), 9) rho_min, round(mx * 8 / n, 9) rho_max_real, round(mn * 8 / n, 9) rho_min_real from t, b",
    "edge_cut_lambda": f"with {GRAPH}, {CUT} select count(*) edges, sum((lu <> lv)::int)::bigint cut, round(sum((lu <> lv)::int) / count(*), 9) as lambda from cut",
    "face_entry_lambda": f"with {GRAPH}, {CUT} select round(sum((lu <> lv)::int) / (24 * (select count(*) from orders)), 9) as lambda from cut",
    "part_loads_sends": f"with {GRAPH}, {ARCL}, s as (select label, count(*) load from labels group by 1), c as (select ls, count(*) sends from arcl where ls <> ld group by 1) select label::bigint as label, load, coalesce(sends, 0) sends from s left join c on ls = label",
    "pair_boundaries": f"with {GRAPH}, {CUT} select least(lu, lv)::bigint a, greatest(lu, lv)::bigint b, count(*) cut from cut where lu <> lv group by 1, 2",
    "inside_edges": f"with {GRAPH}, {CUT} select lu::bigint as label, count(*) inside from cut where lu = lv group by 1",
    "bfs_distances": f"{GROWN} select v, dist::bigint dist from bfs",
    "bfs_labels": f"{GROWN} select v, label::bigint as label from bfs",
    "bfs_refined_labels": REFINED,
    "bfs_layer_cumulative": f"{GROWN}, l as (select label, dist, count(*) n from bfs group by 1, 2) select label::bigint as label, dist::bigint dist, n, (sum(n) over (partition by label order by dist))::bigint total from l",
    "seed_pair_distance": f"{GROWN} select least(a.label, b.label)::bigint a, greatest(a.label, b.label)::bigint b, min(a.dist + b.dist)::bigint distance from edges e join bfs a on a.v = e.u join bfs b on b.v = e.v where a.label <> b.label group by 1, 2",
    "connected_components": "with recursive e as (select a.c_custkey u, b.c_custkey v from customer a join customer b on b.c_custkey = a.c_custkey + 7 and a.c_nationkey % 5 = b.c_nationkey % 5), a as (select u src, v dst from e union all select v, u from e), cc(v, component) using key (v) as (select c_custkey, c_custkey from customer union select v, m from (select dst v, min(component) m from cc join a on src = cc.v group by 1) n where exists (select 1 from recurring.cc r where r.v = n.v and n.m < r.component)) select v, component from cc",
    "seed_reach_rows": f"with recursive {LATTICE}, {EDGES}, l3 as (select e v, ntile(3) over (order by e) - 1 as label from ids), s3 as (select v, label from (select v, label, row_number() over (partition by label order by v) - 1 p, count(*) over (partition by label) n from l3) where p = n // 2), r(v, label, dist) using key (v, label) as (select v, label, 0 from s3 union select a.dst, b.label, min(b.dist) + 1 from r b join arcs a on a.src = b.v left join recurring.r o on o.v = a.dst and o.label = b.label where o.v is null group by a.dst, b.label) select v, label::bigint as label, dist::bigint dist from r",
    "pagerank_15": _pagerank(),
    "pagerank_labels": _ranked(10000.0, 1.05, None),
    "pagerank_covered_labels": _ranked(1e8, 1.2, 5),
    "two_pass_weighted_labels": TWO_PASS,
    "size_proxy_labels": _proxy(3, "true"),
    "capped_fill_labels": _proxy(5, "l.total <= n // 8"),
    "stop_when_ideal_labels": IDEAL,
    "stretch_labels": _stretched(BY_SIZE),
    "stretch_cut_labels": _stretched(BY_CUT),
    "ordered_growth_labels": _stolen(True),
    "noised_growth_labels": _stolen(False),
    "graph_connected": f"with {LATTICE} select 1::bigint components, count(*) vertices from ids",
    "run_part_figures": RUN,
    "best_by_value": f"with {RUNS} select mesh_idx, min(time) as time from runs group by 1",
    "runs_before_cutoff": f"with {RUNS} select * from runs where mesh_idx < 4",
    "coo_assembly": f"with {LATTICE}, {NODES} select a.node i, b.node j, round(count(*) * sin((a.node + b.node + 1)::double), 6) a from nodes a join nodes b on a.e = b.e group by 1, 2",
    "spmv_once": f"with {LATTICE}, {NODES}, m as (select a.node i, b.node j, count(*) * sin((a.node + b.node + 1)::double) a from nodes a join nodes b on a.e = b.e group by 1, 2), x as (select node j, count(*) * cos(node::double) x from nodes group by 1) select i, round(sum(a * x), 5) y from m join x using (j) group by i",
    "spmv_tiled": f"with {LATTICE}, {NODES}, m as (select a.node i, b.node j, count(*) * sin((a.node + b.node + 1)::double) a from nodes a join nodes b on a.e = b.e group by 1, 2), x as (select node j, count(*) * cos(node::double) x from nodes group by 1) select i, round(sum(a * x), 5) y from m join x using (j) group by i",
    "best_of_runs": f"with {RUNS} select * from runs qualify time = min(time) over (partition by mesh_idx, np)",
    "best_per_mesh_first": f"with {RUNS} select * from runs qualify row_number() over (partition by mesh_idx order by time, np, run_idx) = 1",
    "ideal_scaling": f"with {BEST} select mesh_idx, np, time, round(first_value(time) over w * first_value(np) over w / np, 6) ideal from best window w as (partition by mesh_idx order by np)",
    "relative_speedup": f"with {BEST} select a.np, round(a.time / b.time, 9) speedup from best a join best b on a.np = b.np where a.mesh_idx = 0 and b.mesh_idx = 1",
    "zscore_filter": f"with {RUNS} select mesh_idx, np, run_idx, time from (select *, avg(time) over (partition by np) m, stddev_pop(time) over (partition by np) s from runs) where s = 0 or time - m <= 1.5 * s",
    "standardise_sample": "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) z from customer",
    "rank_max_ties": "select p_partkey, (count(*) over (order by p_size range between unbounded preceding and current row) - 1)::bigint as rank from part",
    "array_max_min_ratio": "select l_suppkey, round(max(l_quantity) / count(*), 9) top, round(min(l_quantity) / count(*), 9) low from lineitem group by 1",
    "distribution_summary": f"with {RUNS} select np, min(time)::double least, round(quantile_cont(time, 0.25), 4)::double q1, round(quantile_cont(time, 0.5), 4)::double median, round(quantile_cont(time, 0.75), 4)::double q3, max(time)::double greatest from runs group by np",
    "scaling_series": f"with {BEST} select mesh_idx, string_agg(np || ':' || time, ',' order by np, time) series from best group by 1",
    "min_over_files": f"with {RUNS} select min(m) cutoff from (select max(run_idx) - 1 m from runs group by mesh_idx)",
    "derived_totals": "select l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_extendedprice + l_tax, 4) total from lineitem",
    "grain_process_count": "select count(*) // 800 processes from orders",
    "scientific_notation": "select o_orderkey, split_part(printf('%.1e', floor(o_totalprice) + 0.3::double), 'e', 1) || ' \\times 10^{' || split_part(printf('%.1e', floor(o_totalprice) + 0.3::double), 'e', 2)::int || '}' as text from orders",
    "trailing_numbers": "select p_partkey, case when p_partkey % 2 = 0 then p_partkey end count from part",
    "bit_helpers": "select p_partkey, case when p_partkey > 0 then floor(log2(p_partkey))::bigint end log2, p_partkey > 0 and bit_count(p_partkey) = 1 as power, case when p_partkey <= 1 then 1 else (1 << ceil(log2(p_partkey))::bigint) end::bigint as next, case when p_partkey > 0 then (1 << floor(log2(p_partkey))::bigint)::bigint end previous, right(bin(p_partkey + 16777216), 24) bits, p_partkey back, p_partkey unscrambled from part",
    "stretch_increment": "select p_partkey, round(log2(p_size) + 1, 9) step from part",
    "remaining_labels": "with k as (select n_nationkey::bigint as label from nation except all select (r_regionkey * 3)::bigint from region) select label, (dense_rank() over (order by label) - 1)::bigint as new from k",
    "expression_ratios": f"with {GRAPH}, {ARCL} select r.k::bigint as label, count(distinct src) || '/1000' as expr from range(8) r(k) left join (select * from arcl where ls <> ld) a on a.ls = r.k group by 1",
    "square_grid_degrees": "with n as (select floor(sqrt((select count(*) from orders)))::bigint n), g as (select i, j, n from n, lateral (select unnest(range(n)) i) a, lateral (select unnest(range(n)) j) b), d as (select (case when i in (0, n - 1) then 2 else 3 end) * (case when j in (0, n - 1) then 2 else 3 end) - 1 degree from g) select degree::bigint degree, count(*) n from d group by 1",
    "sketched_splitters": "select k::bigint k, (select count(*) from orders) n, true as within from range(7) r(k)",
    "block_grown_labels": f"{GROWN} select v, label::bigint as label, dist::bigint dist from bfs",
    "mesh_scan_elements": f"with {LATTICE} " + " union all ".join(f"select e element_tag, 5::bigint etype, {c}::bigint as at, {_node(c)}::bigint node_tag from cell" for c in range(8)),
    "mesh_scan_nodes": f"with {LATTICE}, {NODES}, t as (select distinct node, w + 1 q from nodes, wide) select node::bigint node_tag, (node // (q * q))::double x, ((node // q) % q)::double y, (node % q)::double z from t",
    "mesh_read_order_labels": f"with {LATTICE}, pts as (select e v, i + 0.5::double x, j + 0.5::double y, k + 0.5::double z from cell), {CELLS} select v, (ntile(8) over (order by morton, v) - 1)::bigint as label from keyed",
    "vtk_elements": (
        f"with {LATTICE}, {NODES}, {LABELS}, t as (select distinct node, w + 1 q from nodes, wide), p as (select node, q, row_number() over (order by node) - 1 idx from t), n as (select count(*) n, (select count(*) from cell) m from p), "
        f"corner as ({' union all '.join(f'select e, {c} c, {_node(c)} node from cell' for c in range(8))}), ends as (select e, string_agg(idx::varchar, ' ' order by c) l from corner join p using (node) group by e), "
        "o as (select e, row_number() over (order by e) - 1 k from cell), "
        "line as (select 0 s, unnest([0, 1, 2, 3]) k, unnest(['# vtk DataFile Version 3.0', 'parts', 'ASCII', 'DATASET UNSTRUCTURED_GRID']) value union all select 1, 0, 'POINTS ' || n || ' double' from n "
        "union all select 2, idx, (node // (q * q))::double || ' ' || ((node // q) % q)::double || ' ' || (node % q)::double from p union all select 3, 0, 'CELLS ' || m || ' ' || 9 * m from n union all select 4, k, '8 ' || l from ends join o using (e) "
        "union all select 5, 0, 'CELL_TYPES ' || m from n union all select 6, k, '12' from o union all select 7, 0, 'CELL_DATA ' || m from n union all select 8, unnest([0, 1]), unnest(['SCALARS label long 1', 'LOOKUP_TABLE default']) "
        "union all select 9, k, label::varchar from o join labels on v = e) select row_number() over (order by s, k) - 1 as at, value from line"
    ),
    "matrix_market_entries": f"with {CO} select v i, u j, 1.0::double a from co union all select u, v, 1.0::double from co",
}
