"""SQL twins of the network queries for DuckDB."""

from __future__ import annotations

from lanternway.functions import rules as R

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _t(key: str) -> str:
    return f"coalesce(tags['{key}'], '')"


def _low(key: str) -> str:
    return f"lower(regexp_replace({_t(key)}, '^\\s+|\\s+$', '', 'g'))"


def _access(keys, blocked) -> str:
    whens = " ".join(f"when {_low(k)} in {_in(blocked)} then false when {_low(k)} in {_in(R.ALLOWED)} then true" for k in keys)
    return f"case {whens} else true end"


FOOT = f"({_t('foot:conditional')} = '' and {_t('access:conditional')} = '' and {_t('opening_hours')} in ('', '24/7') and {_access(('foot', 'access'), (*R.BLOCKED, 'destination'))})"
WALKABLE = (
    f"(lower({_t('temporary')}) not in ('yes', 'true', '1') and lower({_t('seasonal')}) in ('', 'no', 'false', '0') and lower({_t('bridge')}) not in ('pontoon', 'floating') "
    f"and lower({_t('ford')}) in ('', 'no', 'false', '0') and ({_t('highway')} in {_in(R.WALKING)} or ({_t('highway')} in {_in(R.NEEDS_FOOT)} and {_low('foot')} in {_in(R.ALLOWED)})) and {FOOT})"
)
MOTOR = f"({_t('highway')} in {_in(R.HIGHWAY_SPEEDS)} and {_access(('motor_vehicle', 'vehicle', 'access'), R.BLOCKED)})"
_V = "translate(lower(regexp_replace(tags['maxspeed'], '^\\s+|\\s+$', '', 'g')), '０１２３４５６７８９', '0123456789')"
_PARTS = f"string_split_regex({_V}, '\\s+')"
_NUMBER = f"(case when regexp_full_match({_PARTS}[1], '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') then try_cast({_PARTS}[1] as double) end)"
POSTED = (
    f"case when {_V} = 'walk' then 5.0 when {_NUMBER} > 0 and len({_PARTS}) <= 2 and ({_PARTS}[2] is null or {_PARTS}[2] in ('mph', 'km/h', 'kph')) "
    f"then least(case when {_PARTS}[2] = 'mph' then {_NUMBER} * 1.609344 else {_NUMBER} end, 120.0) end"
)
_BASE = "case " + " ".join(f"when {_t('highway')} = '{k}' then {v}" for k, v in R.HIGHWAY_SPEEDS.items()) + " else 25.0 end"
MOTOR_KPH = (
    f"cast(coalesce({POSTED}, case when {_t('surface')} in {_in(R.SLOW_SURFACES)} then least({_BASE}, 20.0) when {_t('surface')} in {_in(R.ROUGH_SURFACES)} then least({_BASE}, 25.0) else {_BASE} end) as double)"
)
WALK_KPH = f"cast(case when {_t('highway')} = 'steps' then 2.5 when {_t('surface')} in {_in(R.SOFT_SURFACES)} then 3.5 else 4.8 end as double)"
_OW = _low("oneway")
MOTOR_F = f"({_OW} not in {_in(R.ONEWAY_BACK)})"
MOTOR_B = f"(not ({_OW} not in {_in(R.ONEWAY_BACK)} and ({_OW} in {_in(R.ONEWAY_FORWARD)} or ({_OW} not in {_in(R.ONEWAY_BOTH)} and (lower({_t('junction')}) in ('roundabout', 'circular') or {_t('highway')} = 'motorway')))))"
WALK_F = f"({_low('oneway:foot')} not in {_in(R.ONEWAY_BACK)})"
WALK_B = f"({_low('oneway:foot')} not in {_in(R.ONEWAY_FORWARD)})"

BASE = """
ways as (
  select id as way_id, nodes, tags, region_id from osm_ways where id is not null
  qualify row_number() over (partition by id order by version desc, loaded_at desc) = 1
), nodes as (
  select * from (
    select id, lat, lon, tags, visible from osm_nodes where id is not null
    qualify row_number() over (partition by id order by version desc, loaded_at desc) = 1
  ) where visible and lat is not null and lon is not null and isfinite(lat) and isfinite(lon) and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)
)"""


def refs(profile: str) -> str:
    ok, kph, f, b = (MOTOR, MOTOR_KPH, MOTOR_F, MOTOR_B) if profile == "motor" else (WALKABLE, WALK_KPH, WALK_F, WALK_B)
    open_ = "true" if profile == "motor" else f"{FOOT} and {_t('barrier')} not in {_in(R.BARRIERS)}"
    return f"""{BASE}, used as (
  select way_id, nodes, {kph} as kph, {f} as fwd, {b} as bwd from ways where {ok} and len(nodes) >= 2
), each as (
  select way_id, kph, fwd, bwd, unnest(nodes) as ref, unnest(range(len(nodes))) as pos from used where fwd or bwd
), refs as (
  select e.*, n.lat, n.lon from each e left join (select id, cast(cast(lat as float) as double) as lat, cast(cast(lon as float) as double) as lon from nodes where {open_}) n on n.id = e.ref
)"""


HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
WEIGHT = "greatest(1, cast(ceil(metres / (kph / 3.6) * 100) as bigint))"


def segments(profile: str) -> str:
    return f"""{refs(profile)}, pairs as (
  select *, lag(ref) over w as p_ref, lag(lat) over w as p_lat, lag(lon) over w as p_lon from refs window w as (partition by way_id order by pos)
), steps as (
  select *, {HAVERSINE.format(a='p_', b='')} as metres from pairs where lat is not null and p_lat is not null and p_ref <> ref
), seg as (
  select way_id || ':' || (pos * 2) as edge_id, way_id, pos, p_ref as source, ref as target, {WEIGHT} as weight, metres from steps where fwd
  union all
  select way_id || ':' || (pos * 2 + 1), way_id, pos, ref, p_ref, {WEIGHT}, metres from steps where bwd
)"""


def segment_query(profile: str) -> str:
    return f"with {segments(profile)} select edge_id, way_id, source, target, weight, round(metres, 3) as metres from seg"


OCC = "occ as (select ref as node_id, count(*) as way_count from refs where lat is not null group by 1)"
NODE_OCCURRENCE = f"""with {segments('motor')}, {OCC}, deg as (
  select node_id, count(*) as degree from (select source as node_id from seg union all select target from seg) group by 1
) select node_id, way_count, coalesce(degree, 0) as degree from occ left join deg using (node_id)"""
GRAPH_STATS = f"""with {segments('motor')} select (select count(*) from ways) as ways_seen, (select count(distinct way_id) from refs) as ways_used,
  (select count(distinct ref) from refs where lat is not null) as nodes, (select count(*) from seg) as edges"""
SIMPLE_WALKING = f"""with {refs('walking')}, {OCC}, pieces as (
  select *, sum(case when lat is null then 1 else 0 end) over (partition by way_id order by pos rows unbounded preceding) as fragment from refs
), near as (
  select p.*, o.way_count, lag(ref) over w as before, lead(ref) over w as after, lead(lat) over w as a_lat, lead(lon) over w as a_lon
  from (select * from pieces where lat is not null) p join occ o on o.node_id = p.ref window w as (partition by way_id, fragment order by pos)
), marked as (select *, (way_count > 1 or before is null or after is null or before = after) as keep from near
), islands as (select *, sum(keep::int) over (partition by way_id, fragment order by pos rows unbounded preceding) as island from marked
), steps as (select *, {HAVERSINE.format(a='', b='a_')} as metres from islands where after is not null and after <> ref
), chains as (
  select way_id, fragment, island, arg_min(ref, pos) as a, arg_max(after, pos) as b, sum({WEIGHT}) as weight, sum(metres) as metres, count(*) filter (where not keep) as n_shape, any_value(fwd) as fwd, any_value(bwd) as bwd
  from steps group by 1, 2, 3
)
select way_id, a as source, b as target, cast(weight as bigint) as weight, round(metres, 3) as metres, cast(n_shape as int) as n_shape from chains where fwd
union all select way_id, b, a, cast(weight as bigint), round(metres, 3), cast(n_shape as int) from chains where bwd"""
SIMPLE_MOTOR = f"""with recursive {segments('motor')}, ends as (
  select source as node_id, target as other, 1 as out from seg union all select target, source, 0 from seg
), kept as (
  select node_id, count(*) filter (where out = 1) as n_out, count(*) filter (where out = 0) as n_in,
    list_sort(list_distinct(coalesce(list(other) filter (where out = 1), []))) as o, list_sort(list_distinct(coalesce(list(other) filter (where out = 0), []))) as i from ends group by 1
), through as (
  select node_id from kept where n_out > 0 and n_in > 0 and ((n_out = 1 and n_in = 1 and o <> i) or (n_out = 2 and n_in = 2 and o = i and len(o) = 2))
), walk as (
  select edge_id as head, edge_id, source as first, source as u, target as v, weight, metres, 0 as n_shape from seg where source not in (select node_id from through)
  union all
  select w.head, s.edge_id, w.first, s.source, s.target, w.weight + s.weight, w.metres + s.metres, w.n_shape + 1
  from walk w join through t on t.node_id = w.v join seg s on s.source = w.v and s.target <> w.u
)
select first as source, v as target, weight, round(metres, 3) as metres, n_shape from (select *, row_number() over (partition by head order by n_shape desc) as k from walk) where k = 1
union all
select source, target, weight, round(metres, 3), 0 from seg where edge_id not in (select edge_id from walk)"""
REGIONS = """reg as (select region_no, bounds[1] as w, bounds[2] as s, bounds[3] as e, bounds[4] as n from catalog_regions where len(bounds) = 4 and isfinite(bounds[1]) and isfinite(bounds[2]) and isfinite(bounds[3]) and isfinite(bounds[4]) and bounds[1] >= -180 and bounds[3] <= 180 and bounds[2] >= -90 and bounds[4] <= 90 and bounds[1] < bounds[3] and bounds[2] < bounds[4]
)"""
BBOX = f"""with {BASE}, {REGIONS}, used as (select way_id, nodes from ways where {MOTOR} and len(nodes) >= 2),
each as (select way_id, unnest(nodes) as ref from used),
hit as (select distinct region_no, way_id from each join nodes x on x.id = ref join reg on x.lon between w and e and x.lat between s and n)
select region_no, 'way' as kind, way_id as id from hit
union all select distinct region_no, 'node', x.id from hit join each using (way_id) join nodes x on x.id = each.ref"""

EDGES = """ge as (
  select * from graph_edges where edge_id is not null and source is not null and target is not null qualify row_number() over (partition by edge_id) = 1
)"""
COMPONENTS = f"""{EDGES}, e as (
  select distinct source as a, target as b from ge union select distinct target, source from ge
), cc(node_id, root) using key (node_id) as (
  select distinct a, a from e
  union
  select e.b, min(c.root) from cc c join e on e.a = c.node_id join recurring.cc r on r.node_id = e.b where c.root < r.root group by e.b
), sizes as (select root, count(*) as n from cc group by 1)"""


def encode(lat: str, lon: str, precision: int) -> str:
    """The bits of both indices, interleaved, as text."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    x = f"greatest(0, least(cast(ceil(({lon} + 180) * ({float(1 << lon_bits)} / 360.0)) as bigint) - 1, {(1 << lon_bits) - 1}))"
    y = f"greatest(0, least(cast(ceil(({lat} + 90) * ({float(1 << lat_bits)} / 180.0)) as bigint) - 1, {(1 << lat_bits) - 1}))"
    chars = []
    for c in range(precision):
        bits = []
        for b in range(5):
            p = 5 * c + b
            of, n = (x, lon_bits) if p % 2 == 0 else (y, lat_bits)
            bits.append(f"(({of} >> {n - 1 - p // 2}) & 1) * {1 << (4 - b)}")
        chars.append(f"substr('{ALPHABET}', cast({' + '.join(bits)} + 1 as int), 1)")
    return " || ".join(chars)


OWNED = f"""{BASE}, owned as (
  select *, {encode('lat', 'lon', 6)} as cell from (select id as node_id, cast(cast(lat as float) as double) as lat, cast(cast(lon as float) as double) as lon from nodes)
)"""
PLACED = f"""{OWNED}, {EDGES}, pe as (
  select ge.*, a.cell as source_cell, b.cell as target_cell from ge join owned a on a.node_id = ge.source join owned b on b.node_id = ge.target
)"""
TILE_EDGES = f"""{PLACED}, te as (
  select distinct cell, edge_id, source, target, weight, source_cell = cell as forward, target_cell = cell as reverse
  from (select *, source_cell as cell from pe union all select *, target_cell as cell from pe)
)"""
TILE_NODES = """, tn as (
  select cell, node_id, false as halo from owned
  union all select distinct source_cell, target, true from pe where source_cell <> target_cell
  union all select distinct target_cell, source, true from pe where source_cell <> target_cell
)""".replace("union all select distinct target_cell, source, true", "union select target_cell, source, true").replace("union all select distinct source_cell", "union select source_cell")
# union also removes repeats among owned nodes, which have none
TILE_STATS = f"""with {TILE_EDGES}{TILE_NODES} select n.cell, nodes, halo_nodes, coalesce(f, 0) as forward_edges, coalesce(r, 0) as reverse_edges from
  (select cell, count(*) as nodes, count(*) filter (where halo) as halo_nodes from tn group by 1) n
  left join (select cell, count(*) filter (where forward) as f, count(*) filter (where reverse) as r from te group by 1) e on e.cell = n.cell"""
CSR = f"""with {TILE_EDGES}{TILE_NODES}, o as (select cell, source as node_id, count(*) as n from te where forward group by 1, 2)
select tn.cell, cast(row_number() over w - 1 as int) as slot, tn.node_id, cast(coalesce(sum(coalesce(n, 0)) over (partition by tn.cell order by tn.node_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", coalesce(n, 0) as n
from tn left join o on o.cell = tn.cell and o.node_id = tn.node_id window w as (partition by tn.cell order by tn.node_id)"""
GEOMETRY = f"""with {EDGES}, c as (
  select edge_id, least(source, target) as lo, greatest(source, target) as hi, source <= target as sf, case when source <= target then coalesce(shape, []) else list_reverse(coalesce(shape, [])) end as g from ge
) select edge_id, min(edge_id) over (partition by lo, hi, g) as geometry_id, cast(len(g) as int) as n_points, not sf as reversed from c"""
QUALITY = f"""with {OWNED}, {EDGES}, j as (
  select ge.edge_id, ge.weight, ge.shape, a.lat as s_lat, a.lon as s_lon, b.lat as t_lat, b.lon as t_lon from ge left join owned a on a.node_id = ge.source left join owned b on b.node_id = ge.target
), m as (select *, cast(floor({HAVERSINE.format(a='s_', b='t_')} / 33.34 * 100) as bigint) as bound from j)
select edge_id, 'source has no place' as violation from m where s_lat is null
union all select edge_id, 'target has no place' from m where t_lat is null
union all select edge_id, 'weight out of range' from m where weight is null or weight < 1 or weight > 4294967295
union all select edge_id, 'weight below bound' from m where weight < bound
union all select edge_id, 'shape not finite' from m where len(list_filter(coalesce(shape, []), lambda p: p.lat is null or p.lon is null or isnan(p.lat) or isnan(p.lon))) > 0"""
_POS = f"strpos('{ALPHABET}', substr(cell, k + 1, 1)) - 1"
BOUNDS = f"""with recursive {OWNED}, cells as (select distinct cell from owned), dec as (
  select cell, 0 as k, -90.0::double as s, -180.0::double as w, 180.0::double as dy, 360.0::double as dx from cells
  union all
  select cell, k + 1,
    s + dy / (case when k % 2 = 0 then 4 else 8 end) * (case when k % 2 = 0 then ((v >> 3) & 1) * 2 + ((v >> 1) & 1) else ((v >> 4) & 1) * 4 + ((v >> 2) & 1) * 2 + (v & 1) end),
    w + dx / (case when k % 2 = 0 then 8 else 4 end) * (case when k % 2 = 0 then ((v >> 4) & 1) * 4 + ((v >> 2) & 1) * 2 + (v & 1) else ((v >> 3) & 1) * 2 + ((v >> 1) & 1) end),
    dy / (case when k % 2 = 0 then 4 else 8 end), dx / (case when k % 2 = 0 then 8 else 4 end)
  from (select *, {_POS} as v from dec where k < 6)
), box as (select cell, s, w, s + dy as n, w + dx as e, dy, dx from dec where k = 6)"""
_OFFSETS = ((1, -1), (1, 0), (1, 1), (0, -1), (0, 1), (-1, -1), (-1, 0), (-1, 1))
NEIGHBOURS = f"""{BOUNDS}, o(place, i, j) as (values {', '.join(f'({k}, {i}, {j})' for k, (i, j) in enumerate(_OFFSETS))}), spot as (
  select cell, place, greatest(-90.0, least(90.0, s + dy / 2 + dy * i)) as y, w + dx / 2 + dx * j as x0 from box, o
), wrapped as (select cell, place, y, case when x0 > 180 then x0 - 360 when x0 < -180 then x0 + 360 else x0 end as x from spot)
select cell, cast(place as int) as place, {encode('y', 'x', 6)} as neighbour from wrapped"""
IN_BOX = f"""with r as (
  select region_no, bounds[1] as w, bounds[2] as s, bounds[3] as e, bounds[4] as n from catalog_regions where len(bounds) = 4 and isfinite(bounds[1]) and isfinite(bounds[2]) and isfinite(bounds[3]) and isfinite(bounds[4])
    and bounds[1] >= -180 and bounds[3] <= 180 and bounds[2] >= -90 and bounds[4] <= 90 and bounds[1] < bounds[3] and bounds[2] < bounds[4]
), g as (
  select region_no, unnest(range(greatest(cast(ceil((w + 180) / {180.0 / 4096}) as bigint) - 1, 0), greatest(cast(ceil((e + 180) / {180.0 / 4096}) as bigint) - 1, 0) + 1)) as x, s, n from r
), h as (
  select region_no, x, unnest(range(greatest(cast(ceil((s + 90) / {180.0 / 4096}) as bigint) - 1, 0), greatest(cast(ceil((n + 90) / {180.0 / 4096}) as bigint) - 1, 0) + 1)) as y from g
) select distinct region_no, {encode(f'(y * {180.0 / 4096} - 90 + {90.0 / 4096})', f'(x * {180.0 / 4096} - 180 + {90.0 / 4096})', 5)} as cell from h"""
MISSING = f"""with {PLACED}, {REGIONS}, loaded as (
  select distinct region_no, cell from owned join reg on lon between w and (w + e) / 2 and lat between s and n
), seen as (
  select region_no, target as far, target_cell as cell from pe join loaded on loaded.cell = source_cell
  union select region_no, source, source_cell from pe join loaded on loaded.cell = target_cell
) select region_no, cell, count(*) as n_unresolved from seen where (region_no, cell) not in (select (region_no, cell) from loaded) group by 1, 2"""
TOTALS = f"""select count(*) as tiles, cast(sum(nodes - halo_nodes) as bigint) as nodes, cast(sum(halo_nodes) as bigint) as halo_nodes, cast(sum(forward_edges) as bigint) as edges,
  round(avg(nodes), 3) as nodes_a_tile, md5(string_agg(cell, ',' order by cell)) as cells_digest from ({TILE_STATS})"""
REDUCTION = f"""select before, after, round(100 * (1 - after / greatest(before, 1)), 3) as saved_percent from
  (select count(distinct x) as before from (select unnest([source, target]) as x from ({segment_query('motor')}))),
  (select count(distinct x) as after from (select unnest([source, target]) as x from ({SIMPLE_MOTOR})))"""
CONFLICTS = f"""select node_id, count(distinct cell) as n_owners from (
  select id as node_id, {encode('f_lat', 'f_lon', 6)} as cell from (
    select id, cast(cast(lat as float) as double) as f_lat, cast(cast(lon as float) as double) as f_lon from osm_nodes
    where id is not null and visible and lat is not null and lon is not null and isfinite(lat) and isfinite(lon) and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0))
) group by 1 having count(distinct cell) > 1"""

ORACLES = {
    "segments_walking": segment_query("walking"), "segments_motor": segment_query("motor"), "node_occurrence": NODE_OCCURRENCE, "graph_stats": GRAPH_STATS,
    "simplify_walking": SIMPLE_WALKING, "simplify_motor": SIMPLE_MOTOR, "bbox_crop": BBOX,
    "components_ranked": f"with recursive {COMPONENTS}, seen as (select root, n, row_number() over (order by n desc, root) - 1 as component from sizes) select node_id, cast(component as int) as component from cc join seen using (root)",
    "component_stats": f"with recursive {COMPONENTS} select count(*) as n_components, cast(sum(n) as bigint) as n_nodes, max(n) as largest, round(max(n) / sum(n), 6) as largest_share from sizes",
    "dense_ids": f"with {BASE} select id as osm_id, row_number() over (order by id) - 1 as node_id from nodes",
    "tile_edges": f"with {TILE_EDGES} select * from te", "tile_nodes": f"with {PLACED}{TILE_NODES} select * from tn", "tile_stats": TILE_STATS, "csr_offsets": CSR,
    "geometry_interning": GEOMETRY, "tile_totals": TOTALS, "node_reduction": REDUCTION, "owner_conflicts": CONFLICTS, "tile_quality": QUALITY,
    "cell_encode": f"with {OWNED} select node_id, cell, {encode('lat', 'lon', 4)} as cell4, {encode('lat', 'lon', 9)} as cell9 from owned",
    "cell_bounds": f"{BOUNDS} select cell, s as south, w as west, n as north, e as east from box", "cell_neighbours": NEIGHBOURS, "cells_in_box": IN_BOX, "missing_cells": MISSING,
}
