"""Common table expressions that say in SQL what the star adapters and the preparation say in DataFrames."""

from __future__ import annotations

from weftgraph.functions.lexicon import ACTIONS, escaped, grammar
from weftgraph.sources.star import WORLDS

ACTION = """CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'results in increased expression of' WHEN 'NF' THEN 'results in decreased activity of'
  WHEN 'NO' THEN 'affects the localization of' WHEN 'RF' THEN 'co-treated with' ELSE 'binds to' END"""


def graph(worlds: bool = False) -> str:
    """rx (reactions), vx (vertices), ex (edges)."""
    world = f"CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey % {WORLDS - 1} END || '_' || " if worlds else ""
    return f"""rx AS MATERIALIZED (
  SELECT 'n_reaction_0_' || sha256(agent || '||' || action || '||' || target) AS reaction_id, * FROM (
    SELECT DISTINCT 'chemical_' || {world}l_partkey AS agent, {ACTION} AS action, 'protein_' || {world}l_suppkey AS target, l_partkey AS chem_key, l_suppkey AS gene_key
    FROM lineitem)
), vx AS MATERIALIZED (
  SELECT agent AS id, coalesce(p_name, '?') AS name, 'chemical' AS type, 'C' || chem_key AS chem_ID, CAST(NULL AS VARCHAR) AS gene_ID, CAST(NULL AS VARCHAR) AS action
  FROM (SELECT DISTINCT agent, chem_key FROM rx) LEFT JOIN part ON p_partkey = chem_key
  UNION ALL SELECT target, coalesce(s_name, '?') || ' protein', 'protein', NULL, 'G' || gene_key, NULL
  FROM (SELECT DISTINCT target, gene_key FROM rx) LEFT JOIN supplier ON s_suppkey = gene_key
  UNION ALL SELECT reaction_id, reaction_id, 'reaction', NULL, NULL, action FROM rx
), ex AS MATERIALIZED (
  SELECT agent AS source_id, target AS target_id, replace(upper(action), ' ', '_') AS relationship, reaction_id, 'functional' AS type FROM rx
  UNION ALL SELECT agent, reaction_id, 'AGENT_OF', reaction_id, 'ontological' FROM rx
  UNION ALL SELECT target, reaction_id, 'TARGET_OF', reaction_id, 'ontological' FROM rx
  UNION ALL SELECT reaction_id, agent, 'HAS_AGENT', reaction_id, 'ontological' FROM rx
  UNION ALL SELECT reaction_id, target, 'HAS_TARGET', reaction_id, 'ontological' FROM rx
)"""


OBSERVATIONS = f"""ob AS (
  SELECT chemical AS ChemicalName, 'C' || l_partkey AS ChemicalID, symbol AS GeneSymbol, 'G' || l_suppkey AS GeneID,
    CASE WHEN l_linestatus = 'F' THEN 'protein' ELSE 'mRNA' END AS GeneForms,
    CASE l_returnflag WHEN 'A' THEN 'Homo sapiens' WHEN 'N' THEN 'Mus musculus' ELSE 'Rattus norvegicus' END AS Organism,
    CASE l_linenumber WHEN 1 THEN chemical || ' ' || act || ' ' || gene
      WHEN 2 THEN other || ' inhibits the reaction [' || chemical || ' ' || act || ' ' || gene || ']'
      WHEN 3 THEN '[' || chemical || ' co-treated with ' || gene || '] ' || act || ' ' || gene2
      WHEN 4 THEN other || ' inhibits the reaction [[' || chemical || ' co-treated with ' || gene || '] results in increased expression of ' || gene2 || ']'
      WHEN 5 THEN chemical || ' ' || act || ' ' || symbol || ' protein modified form'
      WHEN 6 THEN chemical || ' resembles ' || gene ELSE chemical || ' ' || act || ' some other thing' END AS Interaction,
    CASE l_returnflag WHEN 'A' THEN 'increases^expression|affects^binding' WHEN 'N' THEN 'decreases^activity'
      ELSE 'affects^cotreatment|affects^binding|increases^chemical synthesis' END AS InteractionActions
  FROM (SELECT *, 'part ' || l_partkey AS chemical, 'S' || l_suppkey AS symbol, 'part ' || (l_partkey * 7) % 90 AS other,
          'S' || l_suppkey || ' protein' AS gene, 'S' || (l_suppkey % 9 + 1) || ' protein' AS gene2, {ACTION} AS act FROM lineitem)
), dz AS (
  SELECT 'part ' || o_orderkey % 97 AS ChemicalName, 'C' || o_orderkey % 97 AS ChemicalID, c_mktsegment AS DiseaseName FROM orders JOIN customer ON o_custkey = c_custkey
), cv AS (SELECT 'C' || p_partkey AS chem_ID, 'part ' || p_partkey AS chem_name FROM part WHERE p_partkey % 10 <> 0
), gv AS (SELECT 'G' || s_suppkey AS gene_ID, s_name AS gene_name, 'S' || s_suppkey AS gene_symbol FROM supplier WHERE s_suppkey % 11 <> 0
)"""

_SHAPES = grammar()
_ABC = "['a', 'b', 'c']"

#: st (statements), re (one row for each reaction of a statement), tr (triples), for statements of up to three reactions.
TRIPLES = f"""{OBSERVATIONS}, st AS (
  SELECT substr(sha256(ChemicalName || chr(31) || GeneSymbol || chr(31) || Interaction), 1, 32) AS index, *
  FROM (SELECT DISTINCT ChemicalName, GeneSymbol, Interaction FROM ob {{where}})
), lv AS (
  SELECT index, Interaction, regexp_matches(Interaction, '{_SHAPES["inverse"]}') AS inv, regexp_matches(Interaction, '{_SHAPES["nested"]}') AS nest,
    regexp_extract(Interaction, '{_SHAPES["inverse"]}', {_ABC}) AS i, regexp_extract(Interaction, '{_SHAPES["nested"]}', {_ABC}) AS n,
    regexp_extract(Interaction, '{_SHAPES["simple"]}', {_ABC}) AS s, 'main-action_' || index AS m FROM st
), lw AS (
  SELECT *, regexp_matches(n.c, '{_SHAPES["inverse"]}') AS inv2, regexp_extract(n.c, '{_SHAPES["inverse"]}', {_ABC}) AS i2, regexp_extract(n.c, '{_SHAPES["simple"]}', {_ABC}) AS s2 FROM lv
), re AS (
  SELECT index, Interaction, m AS subject, regexp_extract(i.a, '{_SHAPES["inner"]}', {_ABC}) AS t, 0 AS pos FROM lw WHERE inv AND regexp_matches(i.a, '{_SHAPES["inner"]}')
  UNION ALL SELECT index, Interaction, 'reaction_' || index || '_0', {{{{'a': m, 'b': i.b, 'c': i.c}}}}, CASE WHEN regexp_matches(i.a, '{_SHAPES["inner"]}') THEN 3 ELSE 0 END FROM lw WHERE inv
  UNION ALL SELECT index, Interaction, m, {{{{'a': n.a, 'b': n.b, 'c': 'reaction_' || index || CASE WHEN inv2 THEN '_1' ELSE '_0' END}}}}, 0 FROM lw WHERE NOT inv AND nest
  UNION ALL SELECT index, Interaction, 'reaction_' || index || '_0', regexp_extract(i2.a, '{_SHAPES["inner"]}', {_ABC}), 3 FROM lw WHERE NOT inv AND nest AND inv2
  UNION ALL SELECT index, Interaction, 'reaction_' || index || '_1', {{{{'a': 'reaction_' || index || '_0', 'b': i2.b, 'c': i2.c}}}}, 6 FROM lw WHERE NOT inv AND nest AND inv2
  UNION ALL SELECT index, Interaction, 'reaction_' || index || '_0', s2, 3 FROM lw WHERE NOT inv AND nest AND NOT inv2 AND s2.b <> ''
  UNION ALL SELECT index, Interaction, m, s, 0 FROM lw WHERE NOT inv AND NOT nest AND s.b <> ''
), t0 AS (
  SELECT index, Interaction, subject, 'has_agent' AS predicate, t.a AS object, 0 AS pred_numb, pos FROM re
  UNION ALL SELECT index, Interaction, subject, 'has_action', t.b, 1, pos + 1 FROM re
  UNION ALL SELECT index, Interaction, subject, 'has_target', t.c, 2, pos + 2 FROM re
), t1 AS (
  SELECT t0.*, ChemicalName, GeneSymbol, CASE WHEN predicate = 'has_action' THEN 'action' WHEN contains(object, 'reaction_') OR contains(object, 'main-action_') THEN 'reaction'
    WHEN object = ChemicalName THEN 'chemical' WHEN replace(object, ' protein', '') = GeneSymbol THEN 'protein' ELSE 'other' END AS triple_object_type
  FROM t0 JOIN st USING (index, Interaction)
), tr AS (
  SELECT index, Interaction, subject, predicate, object, ChemicalName, GeneSymbol, triple_object_type, pred_numb,
    CASE WHEN triple_object_type <> 'reaction' THEN triple_object_type || '_' || index || '_' || pos
      WHEN predicate = 'has_agent' THEN 'reaction_' || index || '_' || CASE WHEN starts_with(subject, 'main-action_') THEN CASE WHEN contains(Interaction, '[[') THEN 1 ELSE 0 END
        ELSE CAST(split_part(subject, '_', 3) AS INTEGER) + 1 END
      ELSE object END AS id FROM t1
)"""

#: From tr on: rc (recovered), mp (mapped), wh (whole statements), sg (reaction ids), cn (canonical triples).
RESOLVED = """, rc AS (
  SELECT index, Interaction, subject, predicate, object, ChemicalName, GeneSymbol, pred_numb, coalesce(new, triple_object_type) AS triple_object_type,
    CASE WHEN new IS NOT NULL THEN regexp_replace(id, 'other_', new || '_') ELSE id END AS id
  FROM (SELECT *, CASE WHEN triple_object_type = 'other' AND object IN (SELECT chem_name FROM cv) THEN 'chemical'
          WHEN triple_object_type = 'other' AND lower(trim(object)) LIKE '% protein' THEN 'protein' END AS new FROM tr)
), mp AS (
  SELECT index, Interaction, subject, predicate, object, pred_numb, id, chem_ID, chem_name, gene_ID, gene_name, gene_symbol,
    CASE WHEN triple_object_type = 'protein' AND gene_ID IS NULL THEN 'other' ELSE triple_object_type END AS triple_object_type
  FROM rc LEFT JOIN cv ON object = chem_name LEFT JOIN gv ON replace(object, ' protein', '') = gene_symbol
  WHERE NOT (triple_object_type = 'chemical' AND chem_ID IS NULL)
), wh AS (
  SELECT * FROM mp WHERE index NOT IN (SELECT index FROM mp GROUP BY index HAVING count(*) % 3 <> 0 OR max(CASE WHEN triple_object_type = 'other' THEN 1 ELSE 0 END) = 1)
), rr AS (
  SELECT index, subject, min(CASE WHEN predicate = 'has_agent' THEN object END) AS a, min(CASE WHEN predicate = 'has_action' THEN object END) AS b,
    min(CASE WHEN predicate = 'has_target' THEN object END) AS c FROM wh GROUP BY index, subject
), s0 AS (
  SELECT *, 'n_reaction_0_' || sha256(a || '||' || b || '||' || c) AS h FROM rr
  WHERE NOT (contains(a, 'reaction_') OR contains(a, 'main-action_') OR contains(c, 'reaction_') OR contains(c, 'main-action_'))
), s1 AS (
  SELECT rr.*, 'n_reaction_0_' || sha256(CASE WHEN s0.subject = rr.a THEN s0.h ELSE rr.a END || '||' || rr.b || '||' || CASE WHEN s0.subject = rr.c THEN s0.h ELSE rr.c END) AS h
  FROM rr JOIN s0 ON rr.index = s0.index AND s0.subject IN (rr.a, rr.c)
), s2 AS (
  SELECT rr.*, 'n_reaction_0_' || sha256(CASE WHEN s1.subject = rr.a THEN s1.h ELSE rr.a END || '||' || rr.b || '||' || CASE WHEN s1.subject = rr.c THEN s1.h ELSE rr.c END) AS h
  FROM rr JOIN s1 ON rr.index = s1.index AND s1.subject IN (rr.a, rr.c)
), sg AS (
  SELECT index, subject, h AS reaction_id FROM s0 UNION ALL SELECT index, subject, h FROM s1 UNION ALL SELECT index, subject, h FROM s2
), c0 AS (
  SELECT coalesce(x.reaction_id, wh.subject) AS subject, predicate, coalesce(y.reaction_id, object) AS object, triple_object_type, pred_numb,
    CASE WHEN triple_object_type = 'reaction' AND y.reaction_id IS NOT NULL THEN y.reaction_id ELSE id END AS id, chem_ID, chem_name, gene_ID, gene_name, gene_symbol
  FROM wh LEFT JOIN sg x ON wh.index = x.index AND wh.subject = x.subject LEFT JOIN sg y ON wh.index = y.index AND wh.object = y.subject
), cn AS (
  SELECT DISTINCT subject, predicate, object, triple_object_type, pred_numb,
    CASE WHEN triple_object_type IN ('chemical', 'protein') THEN min(id) OVER (PARTITION BY triple_object_type, object) ELSE id END AS id,
    chem_ID, chem_name, gene_ID, gene_name, gene_symbol FROM c0
)"""

_OWN = "CASE WHEN starts_with(subject, 'main-action_') THEN subject ELSE h END"
#: RESOLVED in parity mode: main actions that hold another reaction keep their own ids, and of those with one Interaction
#: and equal triples one stays (cp).
RESOLVED_COMPAT = RESOLVED.replace("SELECT index, subject, h FROM s1", f"SELECT index, subject, {_OWN} FROM s1").replace("SELECT index, subject, h FROM s2", f"SELECT index, subject, {_OWN} FROM s2").replace(
    "SELECT coalesce(x.reaction_id, wh.subject) AS subject", "SELECT wh.Interaction, coalesce(x.reaction_id, wh.subject) AS subject").replace("SELECT DISTINCT subject, predicate", "SELECT DISTINCT Interaction, subject, predicate") + """, mg AS (
  SELECT Interaction, subject, string_agg(DISTINCT predicate || chr(31) || object, chr(30) ORDER BY predicate || chr(31) || object) AS sig FROM cn WHERE starts_with(subject, 'main-action_') GROUP BY Interaction, subject
), cp AS (
  SELECT * FROM cn WHERE NOT starts_with(subject, 'main-action_') OR subject IN (SELECT min(subject) FROM mg GROUP BY Interaction, sig)
)"""

#: From cn on: nd (nodes), nm (name to id), ed (edges).
GRAPH_OF_TRIPLES = """, nd AS (
  SELECT DISTINCT id, object AS name, triple_object_type AS type, chem_ID, gene_ID, CAST(NULL AS VARCHAR) AS action FROM cn WHERE triple_object_type IN ('chemical', 'protein')
  UNION SELECT DISTINCT subject, subject, 'reaction', NULL, NULL, object FROM cn WHERE predicate = 'has_action' AND contains(subject, 'reaction_')
), nm AS (SELECT name, min(id) AS node_id FROM nd GROUP BY name
), rw AS (
  SELECT subject AS reaction_id, min(CASE WHEN predicate = 'has_agent' THEN coalesce(node_id, object) END) AS agent, min(CASE WHEN predicate = 'has_action' THEN object END) AS action,
    min(CASE WHEN predicate = 'has_target' THEN coalesce(node_id, object) END) AS target FROM cn LEFT JOIN nm ON object = name AND predicate <> 'has_action' GROUP BY subject
), ed AS (
  SELECT agent AS source_id, target AS target_id, replace(upper(action), ' ', '_') AS relationship, reaction_id, 'functional' AS type FROM rw
  UNION ALL SELECT agent, reaction_id, 'AGENT_OF', reaction_id, 'ontological' FROM rw
  UNION ALL SELECT target, reaction_id, 'TARGET_OF', reaction_id, 'ontological' FROM rw
  UNION ALL SELECT reaction_id, agent, 'HAS_AGENT', reaction_id, 'ontological' FROM rw
  UNION ALL SELECT reaction_id, target, 'HAS_TARGET', reaction_id, 'ontological' FROM rw
)"""


def triples(where: str = "") -> str:
    return TRIPLES.format(where=where)


#: cs: every vertex with the smallest id of its component, spread along edges until nothing changes.
COMPONENTS = """un AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM ex UNION SELECT target_id, source_id FROM ex
), cc(id, component_id) USING KEY (id) AS (
  SELECT id, id FROM vx UNION
  SELECT un.b, min(cc.component_id) FROM cc JOIN un ON un.a = cc.id JOIN recurring.cc AS old ON old.id = un.b WHERE cc.component_id < old.component_id GROUP BY un.b
), cs AS MATERIALIZED (SELECT vx.id, type, name, component_id, count(*) OVER (PARTITION BY component_id) AS component_count FROM vx JOIN cc USING (id))"""


def labels(rounds: int) -> str:
    """l0 to l<rounds>: (id, label) by synchronous rounds over functional edges."""
    out = """fu AS MATERIALIZED (SELECT source_id AS a, target_id AS b FROM ex WHERE type = 'functional' UNION SELECT target_id, source_id FROM ex WHERE type = 'functional'), l0 AS (SELECT id, id AS label FROM vx)"""
    for k in range(rounds):
        out += f""", l{k + 1} AS MATERIALIZED (SELECT l{k}.id, coalesce(best, label) AS label FROM l{k} LEFT JOIN (
  SELECT a, label AS best FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS r FROM fu JOIN l{k} ON b = l{k}.id GROUP BY a, label) WHERE r = 1) ON id = a)"""
    return out


def paths(target: str, rounds: int) -> str:
    """p0 to p<rounds>: (id, dist, path, rels) of the cheapest path to ``target``."""
    out = f"""pe AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, relationship, reaction_id, CASE WHEN type = 'ontological' THEN 2.0 ELSE 1.0 END AS weight FROM ex
  WHERE type <> 'ontological' OR reaction_id IN (SELECT reaction_id FROM ex WHERE relationship = 'TARGET_OF' AND source_id = {target})
), p0 AS MATERIALIZED (SELECT id, CAST(0.0 AS DOUBLE) AS dist, [id] AS path, CAST([] AS VARCHAR[]) AS rels, CAST([] AS VARCHAR[]) AS rids FROM vx WHERE id = {target})"""
    for k in range(rounds):
        out += f""", m{k} AS MATERIALIZED (SELECT src, d, path, relationship, rels, rids || [reaction_id] AS rids, row_number() OVER (PARTITION BY src ORDER BY d, path, relationship, rels, reaction_id) AS r
    FROM (SELECT src, dist + weight AS d, path, relationship, rels, rids, reaction_id FROM pe JOIN p{k} ON dst = id)
), p{k + 1} AS MATERIALIZED (SELECT coalesce(p{k}.id, src) AS id, CASE WHEN src IS NOT NULL AND (p{k}.id IS NULL OR d < dist) THEN d ELSE dist END AS dist,
    CASE WHEN src IS NOT NULL AND (p{k}.id IS NULL OR d < dist) THEN [src] || m.path ELSE p{k}.path END AS path,
    CASE WHEN src IS NOT NULL AND (p{k}.id IS NULL OR d < dist) THEN [m.relationship] || m.rels ELSE p{k}.rels END AS rels,
    CASE WHEN src IS NOT NULL AND (p{k}.id IS NULL OR d < dist) THEN m.rids ELSE p{k}.rids END AS rids
  FROM p{k} FULL JOIN (SELECT * FROM m{k} WHERE r = 1) m ON p{k}.id = m.src)"""
    return out


COVERAGE = "|".join(escaped(a) for a in ACTIONS)
