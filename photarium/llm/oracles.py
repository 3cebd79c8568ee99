"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from photarium.llm import clustering, fill_middle
from photarium.llm.mixing import LEAST_QUALITY, MOST_EPOCHS, SEED, SOURCE_WEIGHTS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, length(coalesce(text, '')) AS chars,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {2**52}::DOUBLE)
         / (CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 3 AND 11 THEN 1.0 ELSE {LEAST_QUALITY} END)::DOUBLE AS key
  FROM sized),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
listed AS (
  SELECT *, {MOST_EPOCHS} * source_size AS cap,
         {list(SOURCE_WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SOURCE_WEIGHTS)} + 1] AS weight
  FROM named),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS turn FROM listed),
rated AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS rate
  FROM ordered WINDOW w AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT arg_min(rate, turn) FROM rated WHERE rate * weight <= cap) * weight), cap::DOUBLE) AS target
  FROM rated),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS epochs FROM planned),
running AS (
  SELECT k.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source),
cuts AS (
  SELECT source AS s, min(struct_pack(off := abs(upto::DOUBLE - rest), key := key)) AS near, any_value(rest) AS rest FROM running GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN near.off < cuts.rest AND key <= near.key THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM running JOIN cuts ON source IS NOT DISTINCT FROM s"""

NEAR_DEDUP = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ids AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ids ON x = doc_id"""

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
spots AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM spots),
docs AS (SELECT doc_id, {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
places AS (
  SELECT doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda p: struct_pack(p := p, gram := array_to_string(w[p:p + n - 1], ' ')))) AS place
  FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows)),
found AS (SELECT doc_id, place.p AS p, places.n AS n, item FROM places JOIN windows ON windows.n = places.n AND gram = place.gram),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

FILL_MIDDLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
         list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(h, p, 8) AS BIGINT)) AS draw FROM docs),
cuts AS (
  SELECT *, len(u) AS n, least(draw[1] % (len(u) + 1), draw[2] % (len(u) + 1)) AS low, greatest(draw[1] % (len(u) + 1), draw[2] % (len(u) + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= {fill_middle.RATE}
              THEN 'plain' WHEN draw[4] % 100 < {fill_middle.SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


def _clustering(dimensions: int, scale: int, k: int, rounds: int, seed: int) -> str:
    """All rounds, one after the other: the nearest centroid of each vector, then the centroids' floor means."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {dimensions}),
drawn AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c FROM kept),
centers0 AS MATERIALIZED (SELECT c, x FROM drawn WHERE c < {k})"""]
    for t in range(rounds + 1):
        parts.append(f"""
near{t} AS MATERIALIZED (
  SELECT rid, min(struct_pack(d := list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))), c := c)) AS best
  FROM kept a CROSS JOIN centers{t} b GROUP BY rid)""")
        if t < rounds:
            parts.append(f"""
sums{t} AS (
  SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM near{t} JOIN kept USING (rid) CROSS JOIN range(1, {dimensions + 1}) AS dims(i) GROUP BY best.c, i),
means{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{t} GROUP BY c),
centers{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM centers{t} o LEFT JOIN means{t} m ON o.c = m.c)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (rid) JOIN centers{rounds} f ON f.c = best.c"""


CLUSTERING = _clustering(clustering.DIMENSIONS, clustering.SCALE, clustering.CLUSTERS, clustering.ROUNDS, clustering.SEED)

ORACLES = {
    "op1_mixing": MIXING, "op9_near_dedup": NEAR_DEDUP, "op10_decontamination": DECONTAMINATION, "op12_fill_middle": FILL_MIDDLE,
    "op13_clustering": CLUSTERING,
}
