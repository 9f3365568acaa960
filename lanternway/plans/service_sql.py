"""SQL twins of the catalogue, manifest and guidance queries for DuckDB."""

from __future__ import annotations

from lanternway.plans.general_sql import P5
from lanternway.plans.network_sql import BASE, EDGES, HAVERSINE, OWNED, refs

VALID = """len(bounds) = 4 and isfinite(bounds[1]) and isfinite(bounds[2]) and isfinite(bounds[3]) and isfinite(bounds[4]) and bounds[1] >= -180 and bounds[3] <= 180
  and bounds[2] >= -90 and bounds[4] <= 90 and bounds[1] < bounds[3] and bounds[2] < bounds[4]"""
LABELS = f"""{BASE}, cand as (
  select 0 as kind, id as seq, coalesce(nullif(tags['name:en'], ''), nullif(tags['name'], '')) as name, lat, lon from nodes
  where coalesce(tags['place'], '') <> '' or tags['railway'] = 'station' or tags['amenity'] in ('hospital', 'clinic', 'police', 'fire_station')
  union all
  select 1, w.way_id, w.name, round(n.lat, 7), round(n.lon, 7) from (
    select way_id, coalesce(nullif(tags['name:en'], ''), nullif(tags['name'], '')) as name, nodes[len(nodes) // 2 + 1] as mid from ways where len(nodes) >= 2 and tags['highway'] in ('primary', 'secondary', 'tertiary', 'pedestrian', 'residential')
  ) w join nodes n on n.id = w.mid
), reg as (
  select region_no, bounds[1] as w, bounds[2] as s, bounds[3] as e, bounds[4] as n, least(5000, coalesce(maxLabels, 24)) as cap from catalog_regions where {VALID}
), firsts as (
  select * from cand join reg on cand.lon > w and cand.lon < e and cand.lat > s and cand.lat < n where name is not null
  qualify row_number() over (partition by region_no, name order by kind, seq) = 1
), lab as (
  select region_no, cast(row_number() over (partition by region_no order by kind, seq) as int) as place, name[:100] as text, lat, lon, cap from firsts
), labels as (select * from lab where place <= cap)"""
_HASH = "regexp_full_match({}, '[a-f0-9]{{64}}')"
MANIFESTS = f"""with m as (
  select p.*, r.bounds as catalogue, coalesce(assets, []) as a from pack_manifests p left join catalog_regions r on r.id = p.regionId
), t as (select *, coalesce(list_sum([x.bytes for x in a]), 0) as total, len([x for x in a if x.path = 'map.json']) as maps from m), v as (
  select regionId, totalBytes, datasetId as dataset_id, unnest([
    case when coalesce(schemaVersion = 1, false) then null else 'schema' end,
    case when coalesce({_HASH.format('datasetId')}, false) then null else 'generation' end,
    case when coalesce(profile = 'walking-v1' and tileVersion = 2, false) then null else 'profile' end,
    case when coalesce({VALID} and bounds = catalogue, false) then null else 'bounds' end,
    case when coalesce(source.name = 'OpenStreetMap contributors' and source.license = 'ODbL-1.0', false) then null else 'origin' end,
    case when coalesce(starts_with(source.url, 'https://'), false) then null else 'origin-url' end,
    case when coalesce({_HASH.format('source.sha256')}, false) then null else 'origin-hash' end,
    case when try_cast(source.timestamp as timestamptz) is not null then null else 'origin-time' end,
    case when len(a) not between 2 and 20000 then 'count' end,
    case when len([x for x in a if not coalesce(regexp_full_match(x.path, 'map\\.json|tiles/[0123456789bcdefghjkmnpqrstuvwxyz]{{6}}\\.bin'), false)]) > 0 then 'paths' end,
    case when len(list_distinct([x.path for x in a])) <> len(a) then 'paths-twice' end,
    case when len([x for x in a if not coalesce(x.bytes between 1 and 33554432, false)]) > 0 then 'sizes' end,
    case when len([x for x in a if not coalesce({_HASH.format('x.sha256')}, false)]) > 0 then 'hashes' end,
    case when len([x for x in a if not coalesce(x.kind = case when x.path = 'map.json' then 'basemap' else 'routing-tile' end, false)]) > 0 then 'kinds' end,
    case when maps <> 1 then 'drawings' end,
    case when total > 1073741824 or not coalesce(total = totalBytes, false) then 'total' end
  ]) as violation from t
)"""
VERIFY = f"{MANIFESTS} select distinct dataset_id, violation from v where violation is not null"
SAVED = f"""{MANIFESTS}, good as (select distinct regionId, datasetId, totalBytes from pack_manifests where datasetId not in (select dataset_id from v where violation is not null and dataset_id is not null)),
  s as (select regionId as region_id, count(distinct datasetId) as n_packs, cast(sum(totalBytes) as bigint) as saved_bytes from good group by 1)
select *, case when saved_bytes >= 1048576 then format('{{:.1f}} MB', saved_bytes / 1048576) else cast(ceil(saved_bytes / 1024) as bigint) || ' KB' end as size_text from s"""
STALE = """with g as (select regionId, datasetId, max(cast(source.timestamp as timestamptz)) as ts from pack_manifests where datasetId is not null group by 1, 2),
  newest as (select regionId, arg_max(datasetId, row(ts, datasetId)) as datasetId from g group by 1)
select regionId as region_id, datasetId as dataset_id, strftime(ts at time zone 'UTC', '%-d %b %Y') as date_text from g anti join newest using (regionId, datasetId)"""
PREVIEW = f"""with {refs('walking')}, placed as (select * from refs where lat is not null), steps as (
  select *, lag(lat) over w as p_lat, lag(lon) over w as p_lon from placed window w as (partition by way_id order by pos)
), lines as (
  select way_id, count(*) as n, coalesce(sum({HAVERSINE.format(a='p_', b='')}) filter (where p_lat is not null), 0.0) as metres, min(lat) as s, max(lat) as n_, min(lon) as w, max(lon) as e from steps group by 1 having count(*) >= 2
), first as (
  select l.*, x.region_id, cast(ceil(n / greatest(1, n // 10)::double) as int) as few from lines l join ways x using (way_id) where coalesce(x.tags['highway'], '') not in ('steps', 'service')
  qualify row_number() over (partition by x.region_id order by way_id) <= 400
), boxed as (
  select *, (s + n_) / 2 as cy, (w + e) / 2 as cx, greatest((n_ - s) / 2, 75.0 / 111195.0) as hy, greatest((e - w) / 2, 75.0 / 111195.0 / greatest(cos(radians((s + n_) / 2)), 0.01)) as hx from first where few >= 2
)
select way_id, region_id, cast(n as int) as n_points, few as n_preview, round(metres, 2) as metres,
  case when metres >= 1000 then format('{{:.1f}} km', metres / 1000) else cast(cast(floor(metres / 5 + 0.5) as bigint) * 5 as varchar) || ' m' end as length_text,
  greatest(1, cast(ceil(metres / (4.8 / 3.6) / 60) as bigint)) as minutes, round(cx - hx, 6) as west, round(cy - hy, 6) as south, round(cx + hx, 6) as east, round(cy + hy, 6) as north from boxed"""
SOUND = f"""{OWNED}, {EDGES}, pe as (
  select ge.*, a.cell as source_cell, b.cell as target_cell, a.lat as s_lat, a.lon as s_lon, b.lat as t_lat, b.lon as t_lon from ge join owned a on a.node_id = ge.source join owned b on b.node_id = ge.target
), se as (
  select * from pe where weight >= greatest(1, cast(floor({HAVERSINE.format(a='s_', b='t_')} / 33.34 * 100) as bigint)) and weight <= 4294967295
    and len(list_filter(coalesce(shape, []), lambda p: p.lat is null or p.lon is null or isnan(p.lat) or isnan(p.lon))) = 0
)"""
EXCHANGE = f"""with recursive {SOUND}, d as (select id, row_number() over (order by id) - 1 as k from nodes), l as (
  select source as a, target as b from se union select target, source from se
), cc(node_id, root) using key (node_id) as (
  select distinct a, a from l
  union
  select l.b, min(c.root) from cc c join l on l.a = c.node_id join recurring.cc r on r.node_id = l.b where c.root < r.root group by l.b
), parts as (select root, row_number() over (order by count(*) desc, root) - 1 as part from cc group by 1), of as (select node_id, cast(part as int) as part from cc join parts using (root)),
two as (select source_cell as cell, false as reverse, * from se union all select target_cell, true, * from se)
select cell, reverse, x.k as source, y.k as target, weight, cast(coalesce(len(shape), 0) as int) as n_shape,
  round(coalesce(list_sum([p.lat::double * i for p, i in shape]), 0.0), 3) as lat_sum, round(coalesce(list_sum([p.lon::double * i for p, i in shape]), 0.0), 3) as lon_sum,
  p.part as source_component, q.part as target_component
from two join d x on x.id = source join d y on y.id = target join of p on p.node_id = source join of q on q.node_id = target"""
_MAJOR, _LOCAL, _WALKING = "('trunk', 'primary', 'secondary', 'tertiary')", "('residential', 'unclassified', 'service', 'living_street', 'track', 'road', 'motorway')", "('footway', 'path', 'steps', 'pedestrian')"
_LAYER = f"when tags['highway'] in {_MAJOR} then 'major' when tags['highway'] in {_LOCAL} then 'local' when tags['highway'] in {_WALKING} then 'walking'"
_ZOOM = "when layer = 'major' then 0.0 when layer = 'local' then 11.5 when layer = 'walking' then 13.5"
ORACLES = {
    "labels": f"with {LABELS} select region_no, place, text, round(lat, 6) as lat, round(lon, 6) as lon from labels",
    "place_search": f"with {LABELS}, hit as (select region_no, text, row_number() over (partition by region_no order by place) as k from labels where contains(lower(text), 'street')) select region_no, cast(k as int) as rank, text from hit where k <= 12",
    "region_search": "select region_no, id from catalog_regions where contains(lower(coalesce(name, '') || ' ' || coalesce(subtitle, '') || ' ' || coalesce(coverageLabel, '')), 'and surroundings')",
    "region_lookup": f"select left_id as point_id, min(right_id) as region_no from ({P5}) where relation = 'inside' group by 1",
    "region_status": f"""with m as (select distinct regionId as id, datasetId, cast(source.timestamp as timestamptz) as ts from pack_manifests),
      per as (select id, count(distinct datasetId) as n, arg_max(datasetId, row(ts, datasetId)) as newest from m group by 1)
      select region_no, case when {VALID} then round((bounds[4] - bounds[2]) * 111.195 * ((bounds[3] - bounds[1]) * 111.195 * cos(radians((bounds[4] + bounds[2]) / 2))), 2) end as area_km2, coalesce(n, 0) as n_generations, newest
      from catalog_regions r left join per on per.id = r.id""",
    "manifest_assets": """with m as (select distinct datasetId, totalBytes, assets from pack_manifests), a as (select datasetId, totalBytes, unnest(assets) as x from m)
      select datasetId as dataset_id, totalBytes as total_bytes, count(*) as n_assets, cast(sum(x.bytes) as bigint) as asset_bytes, count(*) filter (where x.kind = 'basemap') as n_basemaps from a group by 1, 2""",
    "manifest_verify": VERIFY,
    "saved_bytes": SAVED,
    "stale_generations": STALE,
    "preview": PREVIEW,
    "roads_by_layer": f"with {BASE}, l as (select case {_LAYER} end as layer, len(nodes) as n from ways where len(nodes) >= 2) select layer, cast(case {_ZOOM} end as double) as min_zoom, count(*) as n_roads, cast(sum(n) as bigint) as n_points from l where layer is not null group by 1, 2",
    "tile_exchange": EXCHANGE,
    "fix_admission": "select event_type, count(*) as n_events, count(*) filter (where value is not null and isfinite(value) and value >= 0 and event_id % 31 - 8 between -5 and 20) as n_admitted, count(*) filter (where value is not null and isfinite(value) and value >= 0 and value <= 50 and event_id % 31 - 8 between -5 and 20) as n_starts from events group by 1",
}
