"""DuckDB SQL of the queries over the tables' dependency graph, its workflows and plans, as common table expressions.

``EDGE`` (with what it needs before it) has the edges; the parts below build on it one after another. The edges of the
tables lead forward in time, so there are no cycles, and longest paths and walks are those of acyclic graphs."""

from __future__ import annotations

#: Nodes with their component, edges of a node in order (k).
NODES = """edge2 AS MATERIALIZED (SELECT s, t, dependency_type, row_number() OVER (PARTITION BY s ORDER BY CAST(t AS BIGINT), dependency_type) AS k FROM edge),
both_ways AS (SELECT s, t FROM edge UNION SELECT t, s FROM edge), reach(a, b) AS (SELECT s, s FROM both_ways UNION SELECT reach.a, both_ways.t FROM reach JOIN both_ways ON reach.b = both_ways.s),
label AS MATERIALIZED (SELECT a, min(b) AS m FROM reach GROUP BY a),
node AS (SELECT CAST(seq AS VARCHAR) AS id, seq, method, obs.path AS url_path, '/api/' || event_type || 's' || CASE WHEN event_type = 'signup' THEN '' ELSE '/item_' || lpad(CAST(seq % 100 AS VARCHAR), 5, '0') END AS path,
  coalesce(m, CAST(seq AS VARCHAR)) AS component FROM obs LEFT JOIN label ON label.a = CAST(seq AS VARCHAR)),
comp AS MATERIALIZED (SELECT *, min(seq) OVER (PARTITION BY component) AS first_seq, count(*) OVER (PARTITION BY component) AS size FROM node)"""

#: Chains of token edges: of the nodes that reach a node by first token edges, the earliest owns it.
CHAINS = """follow AS (SELECT s, arg_min(t, k) AS t FROM edge2 WHERE dependency_type = 'token' GROUP BY s),
along(a, b, n) AS (SELECT s, s, 0 FROM follow UNION ALL SELECT a, follow.t, n + 1 FROM along JOIN follow ON follow.s = along.b),
owner AS (SELECT b, arg_min(a, CAST(a AS BIGINT)) AS a, arg_min(n, CAST(a AS BIGINT)) AS n FROM along GROUP BY b),
chains AS (SELECT component, a AS start, count(*) AS length, string_agg(b, '|' ORDER BY n) AS chain FROM owner JOIN comp ON comp.id = owner.a GROUP BY component, a HAVING count(*) > 1)"""

#: Workflows: longest tails by length, the earliest edge to one that is one shorter, then the path from the best entry.
FLOWS = """tail(id, n) AS (SELECT id, 1 FROM node UNION SELECT edge2.s, n + 1 FROM tail JOIN edge2 ON edge2.t = tail.id),
far AS MATERIALIZED (SELECT id, max(n) AS n FROM tail GROUP BY id),
onward AS MATERIALIZED (SELECT edge2.s, arg_min(edge2.t, edge2.k) AS t FROM edge2 JOIN far a ON a.id = edge2.s JOIN far b ON b.id = edge2.t WHERE b.n = a.n - 1 GROUP BY edge2.s),
best AS (SELECT component, arg_max(comp.id, far.n * 1000000000000 - seq) AS id FROM comp JOIN far ON far.id = comp.id WHERE size > 1 AND comp.id NOT IN (SELECT t FROM edge2) GROUP BY component),
walk(component, step, id) AS (SELECT component, 0, id FROM best UNION ALL SELECT component, step + 1, onward.t FROM walk JOIN onward ON onward.s = walk.id),
longest AS (SELECT component, string_agg(id, '|' ORDER BY step) AS path, count(*) AS n FROM walk GROUP BY component),
member AS MATERIALIZED (SELECT id, seq, method, component, CASE WHEN size > 1 THEN 'c:' || component ELSE 's:/api' END AS grp, CASE WHEN size > 1 THEN 0 ELSE 3 END AS rank,
  id IN (SELECT s FROM edge2 WHERE dependency_type = 'token') AS auth, id NOT IN (SELECT t FROM edge2) AS entry FROM comp),
head AS (SELECT grp, string_agg(id, '|' ORDER BY seq) AS path, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY seq) AS r FROM member WHERE NOT auth) WHERE r <= 5 GROUP BY grp),
g AS (SELECT grp, rank, min(seq) AS group_order, count(*) AS n_nodes, greatest(count(*) FILTER (entry), 1) AS n_entrypoints, count(*) FILTER (auth) AS n_auth, bool_or(method IN ('DELETE', 'PUT', 'PATCH')) AS risky, any_value(component) AS component FROM member GROUP BY grp, rank),
rated AS (SELECT g.*, CASE WHEN n_auth > 0 THEN 'authentication' ELSE 'pagination' END AS type, CASE WHEN rank = 0 THEN longest.path ELSE head.path END AS critical_path, CAST(CASE WHEN rank = 0 THEN longest.n ELSE head.n END AS INTEGER) AS critical_length
  FROM g LEFT JOIN longest ON longest.component = g.component AND rank = 0 LEFT JOIN head ON head.grp = g.grp),
scored AS (SELECT *, n_nodes - critical_length AS n_optional, least(1.0::DOUBLE, ((0.5::DOUBLE + CASE WHEN n_entrypoints = 1 AND critical_length > 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN n_auth > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + 0.1::DOUBLE) AS confidence FROM rated),
flow AS MATERIALIZED (SELECT *, 'wf_' || row_number() OVER (ORDER BY rank, group_order, grp) AS wf, CASE WHEN risky THEN 'high-risk replay' WHEN confidence >= 0.8::DOUBLE AND n_entrypoints <= 2 AND critical_length > 1 THEN 'safely replayable'
  WHEN confidence >= 0.6::DOUBLE THEN 'partially replayable' ELSE 'unresolved replay' END AS viability FROM scored)"""

FLOW_ROWS = """SELECT grp AS "group", type, n_nodes, n_entrypoints, n_auth, critical_path, critical_length, n_optional, false AS cycle_participation, confidence, viability, n_entrypoints > 3 AS ambiguous_entrypoints,
  n_optional > critical_length * 3 AS excessive_fanout, critical_length <= 1 AND n_optional = 0 AS fragmented, false AS critical_path_stopped FROM flow"""
FLOW_COUNTS = "SELECT 'type' AS what, type AS value, count(*) AS n FROM flow GROUP BY type UNION ALL SELECT 'viability', viability, count(*) FROM flow GROUP BY viability UNION ALL SELECT 'critical_paths', '', count(*) FROM flow WHERE critical_length > 1"

#: Needs FLOWS and the registry.
PLAN = """SELECT canonical_id AS id, 'endpoint' AS type, CAST(CASE trust_state WHEN 'unresolved' THEN 40 WHEN 'discovered' THEN 30 ELSE 50 END - CASE WHEN canonical_method IN ('DELETE', 'PUT', 'PATCH') THEN 20 WHEN canonical_method = 'POST' THEN 5 ELSE 0 END AS INTEGER) AS priority,
  CASE trust_state WHEN 'unresolved' THEN 'Unresolved trust state endpoint' WHEN 'discovered' THEN 'High-confidence static endpoint requiring validation' ELSE 'Inferred endpoint needing confirmation' END AS rationale,
  CASE WHEN canonical_method IN ('DELETE', 'PUT', 'PATCH') THEN 'dangerous' WHEN canonical_method = 'POST' THEN 'caution' ELSE 'safe' END AS safety, CAST(0 AS BIGINT) AS n_prerequisites,
  '{"path":"' || canonical_path || '","method":"' || canonical_method || '"}' AS metadata, seq FROM registry WHERE trust_state <> 'observed' AND NOT (trust_state = 'discovered' AND confidence < 0.6)
UNION ALL SELECT 'explore_wf_' || wf, 'workflow_branch', CAST(60 + CASE WHEN n_optional > critical_length * 2 THEN 10 ELSE 0 END AS INTEGER), 'Partially replayable workflow requiring exploration' || CASE WHEN n_optional > critical_length * 2 THEN ' with high fanout potential' ELSE '' END,
  CASE WHEN viability = 'unresolved replay' THEN 'caution' ELSE 'safe' END, n_entrypoints, '{"workflowType":"' || type || '","branches":' || n_optional || '}', group_order + 4398046511104 FROM flow WHERE viability IN ('partially replayable', 'unresolved replay')
UNION ALL SELECT 'explore_route_family_' || route, 'route_family', 65, 'Unexplored route family with multiple candidate endpoints', 'safe', 0, '{"route":"' || route || '","count":' || count(*) || '}', min(seq) + 17592186044416
  FROM (SELECT *, array_to_string(string_split(canonical_path, '/')[1:3], '/') AS route FROM registry) GROUP BY route HAVING count(*) > 1 AND bool_and(trust_state <> 'observed')"""
PREREQUISITES = "SELECT 'explore_wf_' || wf AS target_id, id AS prerequisite FROM flow JOIN member USING (grp) WHERE viability IN ('partially replayable', 'unresolved replay') AND entry"

#: First in, first out: a node goes into the queue when the last of its sources has been taken out.
REPLAY = """given AS (SELECT t, list(s) AS sources FROM edge2 GROUP BY t),
after AS MATERIALIZED (SELECT edge2.s, list({'t': edge2.t, 'sources': given.sources} ORDER BY edge2.k) AS ts FROM edge2 JOIN given ON given.t = edge2.t GROUP BY edge2.s),
queue(component, q, i) AS (SELECT component, list(id ORDER BY seq), 1 FROM comp WHERE id NOT IN (SELECT t FROM edge2) GROUP BY component
  UNION ALL SELECT component, list_concat(q, coalesce(list_transform(list_filter(after.ts, lambda x: list_has_all(q[1:i], x.sources)), lambda x: x.t), [])), i + 1 FROM queue LEFT JOIN after ON after.s = q[i] WHERE i <= len(q)),
done AS (SELECT component, arg_max(q, i) AS q FROM queue GROUP BY component),
place AS (SELECT component, unnest(q) AS id, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS position FROM done)"""

#: In an acyclic graph the depth-first walk comes to a node along the path that is least by the order of edges.
DFS = """paths(component, id, p) AS (SELECT component, id, CAST([] AS BIGINT[]) FROM comp WHERE seq = first_seq UNION ALL SELECT component, edge2.t, list_append(p, edge2.k) FROM paths JOIN edge2 ON edge2.s = paths.id),
least AS (SELECT component, id, min(p) AS p FROM paths GROUP BY component, id)
SELECT component, id, CAST(row_number() OVER (PARTITION BY component ORDER BY p) - 1 AS INTEGER) AS position FROM least"""

#: A breadth-first walk comes to a node along the least of its shortest paths.
BFS = """start AS (SELECT id FROM comp WHERE seq = first_seq ORDER BY size DESC, seq LIMIT 1),
paths(id, p) AS (SELECT id, CAST([] AS BIGINT[]) FROM start UNION ALL SELECT edge2.t, list_append(p, edge2.k) FROM paths JOIN edge2 ON edge2.s = paths.id),
short AS (SELECT id, min(len(p)) AS level FROM paths GROUP BY id),
bfs AS (SELECT paths.id AS node, CAST(level AS INTEGER) AS level, min(p) AS p FROM paths JOIN short ON short.id = paths.id AND len(p) = level GROUP BY 1, 2)"""
BFS_ROWS = "SELECT node, level, row_number() OVER (ORDER BY level, p) - 1 AS position FROM bfs"
#: To the last node of the walk; its nodes are those whose own path begins that of the last one.
SHORTEST = """last AS (SELECT node, p FROM bfs ORDER BY level DESC, p DESC LIMIT 1)
SELECT string_agg(bfs.node, '|' ORDER BY bfs.level) AS path FROM bfs, last WHERE last.p[1:len(bfs.p)] = bfs.p"""

CLUSTERS = """family AS (SELECT component, array_to_string(string_split(path, '/')[1:3], '/') AS f, count(*) AS n, min(seq) AS first, string_agg(id, '|' ORDER BY seq) AS members FROM comp GROUP BY 1, 2),
large AS (SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY first) - 1 AS INTEGER) AS number, n, members FROM family WHERE n > 1),
small AS (SELECT component, count(*) AS n, string_agg(members, '|' ORDER BY first) AS members FROM family WHERE n = 1 GROUP BY component)
SELECT component, 'route_family_cluster' AS kind, number, CAST(n AS INTEGER) AS size, members FROM large
UNION ALL SELECT small.component, 'temporal_cluster', CAST((SELECT count(*) FROM large WHERE large.component = small.component) AS INTEGER), CAST(small.n AS INTEGER), small.members FROM small"""

METRICS = """root AS (SELECT id FROM comp WHERE id NOT IN (SELECT t FROM edge2)), down(a, b) AS (SELECT id, id FROM root UNION SELECT down.a, edge2.t FROM down JOIN edge2 ON edge2.s = down.b),
deep AS (SELECT a, count(*) AS n FROM down GROUP BY a)
SELECT (SELECT count(*) FROM comp) AS node_count, (SELECT count(*) FROM edge2) AS edge_count, (SELECT avg(n) FROM deep) AS average_chain_depth, (SELECT count(*) FROM chains) AS auth_chain_count, CAST(0 AS BIGINT) AS cycle_count,
  (SELECT count(DISTINCT component) FROM comp) AS connected_components, (SELECT count(*) FROM edge2)::DOUBLE / ((SELECT count(*) FROM comp)::DOUBLE * ((SELECT count(*) FROM comp)::DOUBLE - 1)) AS graph_density"""

#: Needs the pattern of canonical paths for NODES' column url_path.
UNIFIED = """named AS (SELECT id, 'canonical_' || method || '#' || canonical AS new, method, canonical FROM (SELECT *, @NORMAL@ AS canonical FROM (SELECT id, method, url_path AS path FROM comp))),
loads AS (SELECT a.new AS s, count(*) AS n, count(*) FILTER (a.new = b.new) AS loops FROM edge2 JOIN named a ON a.id = edge2.s JOIN named b ON b.id = edge2.t GROUP BY 1)
SELECT new AS id, 'request' AS type, canonical AS url, method, 'observed' AS trust_state, coalesce(n, 0) AS out_edges, coalesce(loops, 0) AS loops FROM (SELECT DISTINCT new, canonical, method FROM named) LEFT JOIN loads ON loads.s = new"""

#: Needs FLOWS, CHAINS and the registry.
SUMMARY = """families AS (SELECT '/' || array_to_string(list_filter(string_split(canonical_path, '/'), lambda x: x <> '')[1:2], '/') AS route, count(*) AS n, min(seq) AS seq FROM registry GROUP BY 1 ORDER BY n DESC, seq, route LIMIT 5),
kinds AS (SELECT type, count(*) AS n FROM flow GROUP BY type),
text AS (SELECT (SELECT '[' || string_agg('{\\"route\\":\\"' || route || '\\",\\"count\\":' || n || '}', ',' ORDER BY n DESC, route) || ']' FROM families) AS f, (SELECT '[' || string_agg('{\\"type\\":\\"' || type || '\\",\\"count\\":' || n || '}', ',' ORDER BY n DESC, type) || ']' FROM kinds) AS k)
SELECT '{"total_requests":' || (SELECT count(DISTINCT request_id) FROM ids) || ',"total_endpoints":' || (SELECT count(DISTINCT endpoint_id) FROM ids) || ',"graphql_operations":@GRAPHQL@,"workflows_discovered":' || (SELECT count(*) FROM flow) || ',"auth_chains":' || (SELECT count(*) FROM chains)
  || ',"rest":' || (SELECT count(*) FROM registry) || ',"graphql":0,"websocket":0,"observed":' || (SELECT count(*) FROM registry WHERE trust_state IN ('observed', 'discovered')) || ',"inferred":' || (SELECT count(*) FROM registry WHERE trust_state NOT IN ('observed', 'discovered'))
  || ',"top_route_families":"' || f || '","workflow_types":"' || k || '","safely_replayable":' || (SELECT count(*) FROM flow WHERE viability = 'safely replayable') || ',"partially_replayable":' || (SELECT count(*) FROM flow WHERE viability = 'partially replayable')
  || ',"dangerous":' || (SELECT count(*) FROM flow WHERE viability IN ('high-risk replay', 'unresolved replay')) || ',"critical_workflow_paths":' || (SELECT count(*) FROM flow WHERE critical_length > 1)
  || ',"runtime_capture":' || (SELECT count(DISTINCT endpoint_id) FROM ids) || ',"static_bundle":0,"persisted_query":0,"inferred_route":0}' AS summary FROM text"""
