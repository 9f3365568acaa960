"""The same results in plain SQL for DuckDB, written the straightforward way."""

P1 = """
with refs as (
  select 'osm_ways' as ref_table, id as record_id, unnest(nodes) as node_id, loaded_at as t from osm_ways
  union all select 'graph_edges', edge_id, source, loaded_at from graph_edges
  union all select 'graph_edges', edge_id, target, loaded_at from graph_edges
), r as (select distinct * from refs where node_id is not null),
n as (select distinct id, version, visible, loaded_at from osm_nodes where id is not null),
j as (
  select r.ref_table, r.record_id, r.node_id, r.t, count(n.id) as known,
         count(n.id) filter (where n.loaded_at <= r.t) as loaded,
         max(n.version * 2 + n.visible::int) filter (where n.loaded_at <= r.t) as state
  from r left join n on n.id = r.node_id group by all
)
select distinct ref_table, strftime(t, '%Y-%m') as period, record_id, node_id,
       case when known = 0 then 'missing' when loaded = 0 then 'late' else 'deleted' end as reason
from j where known = 0 or loaded = 0 or state % 2 = 0
"""

P3 = """
with usable as (
  select dataset_id, min(region_id) as region_id from osm_snapshots where dataset_id is not null
  group by 1 having count(*) filter (where trim(coalesce(remark, '')) <> '') = 0
), dated as (
  select datasetId as dataset_id, max(cast(source.timestamp as timestamptz)) as at from pack_manifests group by 1
), ordered as (
  select u.region_id, u.dataset_id, lead(u.dataset_id) over w as next_dataset, row_number() over w as seq
  from usable u join dated d using (dataset_id) window w as (partition by u.region_id order by d.at, u.dataset_id)
), el as (
  select dataset_id, delivered_at, unnest(elements) as e from osm_snapshots
), flat as (
  select dataset_id, e.type as element_type, e.id as element_id,
         arg_max(concat_ws('|', coalesce(cast(round(e.lat * 1e7) as bigint)::varchar, '-'), coalesce(cast(round(e.lon * 1e7) as bigint)::varchar, '-'),
             coalesce(e.nodes::varchar, '-'), coalesce(list_sort(map_entries(e.tags))::varchar, '[]')), delivered_at) as body
  from el where e.type is not null and e.id is not null group by dataset_id, e.type, e.id
), a as (select o.region_id, f.* from flat f join ordered o using (dataset_id) where o.seq > 1),
b as (select o.region_id, o.next_dataset as dataset_id, f.element_type, f.element_id, f.body from flat f join ordered o using (dataset_id) where o.next_dataset is not null)
select coalesce(a.region_id, b.region_id) as region_id, coalesce(a.dataset_id, b.dataset_id) as dataset_id,
       coalesce(a.element_type, b.element_type) as element_type, coalesce(a.element_id, b.element_id) as element_id,
       case when b.element_id is null then 'added' when a.element_id is null then 'removed' else 'changed' end as change
from a full outer join b on a.dataset_id = b.dataset_id and a.element_type = b.element_type and a.element_id = b.element_id
where a.body is distinct from b.body
"""

_USABLE = "({lat} is not null and {lon} is not null and isfinite({lat}) and isfinite({lon}) and {lat} between -90 and 90 and {lon} between -180 and 180 and not ({lat} = 0 and {lon} = 0))"


def usable(lat: str, lon: str) -> str:
    return _USABLE.format(lat=lat, lon=lon)


P5 = f"""
with recursive cur as (
  select id, arg_max(lat, version) as lat, arg_max(lon, version) as lon, arg_max(visible, version) as visible from
  (select id, version, visible, coalesce(lat, 'nan') as lat, coalesce(lon, 'nan') as lon from osm_nodes where id is not null) group by id
), p as (
  select id, lat, lon, cast(floor(lat / 0.0001) as bigint) as gy from cur where visible and {usable('lat', 'lon')}
), near as (
  select least(a.id, b.id) as left_id, greatest(a.id, b.id) as right_id
  from p a join (select p.*, gy + d as ky from p, (values (-1), (0), (1)) as v(d)) b on a.gy = b.ky and a.id < b.id
  where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 4.0
), un as (
  select distinct global_id, lat, lon, lower(regexp_replace(geohash, '^\\s+|\\s+$', '', 'g')) as g from unresolved_nodes where global_id is not null
), dec as (
  select global_id, g, 0 as k, -90.0::double as s, -180.0::double as w, 180.0::double as dy, 360.0::double as dx
  from un where not coalesce({usable('lat', 'lon')}, false) and regexp_full_match(g, '[0-9b-hjkmnp-z]+')
  union all
  select global_id, g, k + 1,
    s + dy / (case when k % 2 = 0 then 4 else 8 end) * (case when k % 2 = 0 then ((v >> 3) & 1) * 2 + ((v >> 1) & 1) else ((v >> 4) & 1) * 4 + ((v >> 2) & 1) * 2 + (v & 1) end),
    w + dx / (case when k % 2 = 0 then 8 else 4 end) * (case when k % 2 = 0 then ((v >> 4) & 1) * 4 + ((v >> 2) & 1) * 2 + (v & 1) else ((v >> 3) & 1) * 2 + ((v >> 1) & 1) end),
    dy / (case when k % 2 = 0 then 4 else 8 end), dx / (case when k % 2 = 0 then 8 else 4 end)
  from (select *, strpos('0123456789bcdefghjkmnpqrstuvwxyz', substr(g, k + 1, 1)) - 1 as v from dec where k < length(g))
), pos as (
  select global_id, lat, lon from un where {usable('lat', 'lon')}
  union all select global_id, s + dy / 2, w + dx / 2 from dec where k = length(g)
), reg as (
  select region_no, bounds[1] as w, bounds[2] as s, bounds[3] as e, bounds[4] as n from catalog_regions
  where len(bounds) = 4 and isfinite(bounds[1]) and isfinite(bounds[2]) and isfinite(bounds[3]) and isfinite(bounds[4])
    and bounds[1] >= -180 and bounds[3] <= 180 and bounds[2] >= -90 and bounds[4] <= 90 and bounds[1] < bounds[3] and bounds[2] < bounds[4]
)
select distinct 'near' as relation, left_id, right_id from near
union all
select distinct 'inside', global_id, region_no from pos join reg on lon between w and e and lat between s and n
"""

ORACLES = {"p1_found": P1, "p3_found": P3, "p5_found": P5}
ORACLES["p1_report"] = f"select ref_table, period, reason, count(*) as n_references, count(distinct record_id) as n_records, count(distinct node_id) as n_keys from ({P1}) group by all"
ORACLES["p3_report"] = f"select region_id, dataset_id, element_type, change, count(*) as n_elements from ({P3}) group by all"
