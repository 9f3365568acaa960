"""SQL twins for DuckDB, where SQL can express the result."""

P6 = """
with recursive e as (
  select distinct source as a, target as b from graph_edges where source is not null and target is not null
  union select distinct target, source from graph_edges where source is not null and target is not null
), cc(node_id, group_id) using key (node_id) as (
  select distinct a, a from e
  union
  select e.b, min(c.group_id) from cc c join e on e.a = c.node_id join recurring.cc r on r.node_id = e.b
  where c.group_id < r.group_id group by e.b
)
select node_id, group_id from cc
"""

ORACLES = {
    "p7_cover": "select container, doc_id, true as whole from documents, (select distinct container from container_sizes where capacity_tokens > 0) c",
    "p8_check": """select t.source, target_share, max_repeats, count(d.doc_id) as n_documents, true as within_repeats, true as on_target
      from mix_targets t left join documents d on d.source = t.source group by 1, 2, 3""",
    "p6_found": P6,
    "p6_sizes": f"select n_nodes, count(*) as n_groups from (select group_id, count(*) as n_nodes from ({P6}) group by 1) group by 1",
}
