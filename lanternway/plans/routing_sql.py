"""SQL twins of the search queries for DuckDB."""

from __future__ import annotations

from lanternway.plans.general_sql import usable
from lanternway.plans.network_sql import EDGES, HAVERSINE, OWNED
from lanternway.plans.service_sql import SOUND

_EXITS = "exits as (select node_id from owned where node_id % 100 = 0)"


def _exit_costs(weight: str) -> str:
    return f"""with recursive {OWNED}, {EDGES}, {_EXITS}, e as (
  select source as a, target as b, min({weight}) as w from ge where weight >= 1 group by 1, 2
), d(node_id, cost) using key (node_id) as (
  select node_id, 0::bigint from exits
  union
  select e.a, min(d.cost + e.w) from d join e on e.b = d.node_id left join recurring.d r on r.node_id = e.a where r.cost is null or d.cost + e.w < r.cost group by e.a
)"""


NEAREST = f"""{_exit_costs('weight')}, nxt as (
  select e.a as node_id, min(e.b) as step from e join d x on x.node_id = e.a join d y on y.node_id = e.b where y.cost + e.w = x.cost group by 1
) select d.node_id, d.cost, case when d.cost = 0 then d.node_id else step end as next from d left join nxt using (node_id)"""
HAZARD = f"{_exit_costs('weight * (1 + (source * 7 + target * 13) % 20)')} select node_id, cost from d"
SHORTEST = f"""with recursive {EDGES}, e as (select source as a, target as b, min(weight) as w from ge where weight >= 1 group by 1, 2),
asked as (select edge_id as request_id, target as source, source as target from ge where edge_id % 100 = 0),
d(s, node_id, cost) using key (s, node_id) as (
  select distinct source, source, 0::bigint from asked
  union
  select d.s, e.b, min(d.cost + e.w) from d join e on e.a = d.node_id left join recurring.d r on r.s = d.s and r.node_id = e.b where r.cost is null or d.cost + e.w < r.cost group by 1, 2
) select request_id, source, target, case when cost is null then 'no-route' else 'complete' end as status, cost from asked left join d on d.s = asked.source and d.node_id = asked.target"""
CHECK = f"with s as ({SHORTEST}) select count(*) filter (where status = 'complete') as n_paths, 0::bigint as n_wrong from s"
_LINES = f"""{OWNED}, {EDGES}, lines as (
  select ge.edge_id, source, target, list_concat(list_concat([{{'lat': a.lat, 'lon': a.lon}}], [{{'lat': p.lat::double, 'lon': p.lon::double}} for p in coalesce(shape, [])]), [{{'lat': b.lat, 'lon': b.lon}}]) as pts
  from ge join owned a on a.node_id = ge.source join owned b on b.node_id = ge.target
), raw as (select edge_id, source, target, pts, unnest(range(1, len(pts))) as k from lines),
legs as (select *, pts[k] as p, pts[k + 1] as q, pts[k].lat as p_lat, pts[k].lon as p_lon, pts[k + 1].lat as q_lat, pts[k + 1].lon as q_lon from raw),
seg as (
  select *, sum(step) over (partition by edge_id order by k) as l1, sum(step) over (partition by edge_id) as metres from (select *, {HAVERSINE.format(a='p_', b='q_')} as step from legs)
)"""
_AT = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}lon)) / 2), 2))))"
SNAP = f"""with recursive {_LINES},
pt as (select global_id as point_id, min({{'lat': lat, 'lon': lon}}) as x from unresolved_nodes where global_id is not null and {usable('lat', 'lon')} group by 1),
points as (select point_id, x.lat as lat, x.lon as lon from pt),
m as (
  select point_id, lat, lon, edge_id, source, target, pts, k, p, q, l1, step, metres, (q.lon - p.lon) * cos(radians(lat)) as x, q.lat - p.lat as y from points join seg
  on lat between least(p.lat, q.lat) - 0.001 and greatest(p.lat, q.lat) + 0.001 and lon between least(p.lon, q.lon) - 0.01 and greatest(p.lon, q.lon) + 0.01
), t as (select *, case when x <> 0 or y <> 0 then greatest(0.0, least(1.0, ((lon - p.lon) * cos(radians(lat)) * x + (lat - p.lat) * y) / (x * x + y * y))) else 0.0 end as t from m),
z as (select *, lat as a_lat, lon as a_lon, p.lat + t * (q.lat - p.lat) as b_lat, p.lon + t * (q.lon - p.lon) as b_lon, l1 - step + t * step as along from t),
d as (select *, {HAVERSINE.format(a='a_', b='b_')} as distance from z),
e as (select * from d where distance <= 75 qualify row_number() over (partition by point_id, edge_id order by distance, k) = 1),
c as (select *, min(distance) over (partition by point_id) as nearest from e qualify distance <= nearest + 0.05),
lk as (select point_id, source as a, target as b from c where metres < 0.1 union select point_id, target, source from c where metres < 0.1),
reach(point_id, node, r) as (
  select point_id, source, source from c union select point_id, target, target from c
  union select reach.point_id, node, lk.b from reach join lk on lk.point_id = reach.point_id and lk.a = reach.r
), root as (select point_id, node, min(r) as root from reach group by 1, 2),
f as (
  select c.*, s.root as s_root, t.root as t_root, {_AT.format(a='c.', b='pts[1]')} as s_far, {_AT.format(a='c.', b='pts[-1]')} as t_far,
    case when source = target then least(pts::varchar, list_reverse(pts)::varchar) when source < target then pts::varchar else list_reverse(pts)::varchar end as form
  from c join root s on s.point_id = c.point_id and s.node = c.source join root t on t.point_id = c.point_id and t.node = c.target
), named as (select *, case when along < 0.1 then 'node ' || s_root when metres - along < 0.1 then 'node ' || t_root else least(source, target) || ' ' || greatest(source, target) || ' ' || form end as name from f),
per as (select point_id, count(*) as n, count(distinct name) as names, min(nearest) as nearest from named group by 1),
near as (select point_id, edge_id, s_root as r from f where along <= 2 and s_far <= 75 union select point_id, edge_id, t_root from f where metres - along <= 2 and t_far <= 75),
shared as (select point_id from (select point_id, r, count(distinct edge_id) as k from near group by 1, 2) x join per using (point_id) where k = n group by 1)
select points.point_id, case when n is null then 'too-far' when n > 24 or (names > 1 and shared.point_id is null) then 'overlap' else 'ok' end as status, round(nearest, 3) as nearest,
  case when n is null or n > 24 or (names > 1 and shared.point_id is null) then 0 else n end as n_places
from points left join per using (point_id) left join shared using (point_id)"""
TURNS = f"""with recursive {_LINES}, corners as (
  select s.edge_id, s.l1 as along, s.metres, degrees(atan2(x1 * y0 - x0 * y1, x0 * x1 + y0 * y1)) as angle from (
    select edge_id, k, l1, metres, (q.lon - p.lon) * cos(radians(q.lat)) as x0, q.lat - p.lat as y0, (pts[k + 2].lon - q.lon) * cos(radians(q.lat)) as x1, pts[k + 2].lat - q.lat as y1 from seg where k + 2 <= len(pts)
  ) s
), sharp as (select * from corners where abs(angle) >= 45 and metres - along > 15), said as (
  select edge_id, 0 as step, 0.0::double as along from lines
  union all
  select said.edge_id, step + 1, min(sharp.along) from said join sharp on sharp.edge_id = said.edge_id and sharp.along - said.along > 25 group by said.edge_id, step
), n as (select edge_id, max(step) + 1 as step from said group by 1)
select edge_id, step, round(along, 2) as along, case when step = 0 then 'start' else (select case when abs(any_value(angle)) > 150 then 'back' when any_value(angle) > 0 then 'right' else 'left' end from sharp where sharp.edge_id = said.edge_id and sharp.along = said.along) end as instruction from said
union all select n.edge_id, n.step, round(any_value(metres), 2), 'arrive' from n join seg on seg.edge_id = n.edge_id group by 1, 2"""
ROUTE = f"""with recursive {SOUND}, e as (select source as a, target as b, min(weight) as w from se group by 1, 2),
asked as (select edge_id as request_id, target as source, source as target from ge where edge_id % 100 = 0),
d(s, node_id, cost) using key (s, node_id) as (
  select distinct source, source, 0::bigint from asked where source in (select a from e union select b from e)
  union
  select d.s, e.b, min(d.cost + e.w) from d join e on e.a = d.node_id left join recurring.d r on r.s = d.s and r.node_id = e.b where r.cost is null or d.cost + e.w < r.cost group by 1, 2
) select request_id, source, target, case when cost is null then 'no-route' else 'complete' end as status, cost from asked left join d on d.s = asked.source and d.node_id = asked.target"""

ORACLES = {"nearest_exit": NEAREST, "hazard_cost": HAZARD, "shortest_cost": SHORTEST, "shortest_path_check": CHECK, "snap_points": SNAP, "turn_list": TURNS, "route_cost": ROUTE}
