"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import secrets, urlgraph

WORD = r"[^\x20\x09-\x0D]+"

_COMPONENTS = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN edges e ON e.a = reach.b),
comps AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

OP2 = f"""WITH RECURSIVE good AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM good),
edges AS (SELECT p.id AS a, q.id AS b FROM normed p JOIN normed q ON p.label = q.label AND p.id <> q.id WHERE list_inner_product(p.v, q.v) / (p.norm * q.norm) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings WHERE vec_id IS NOT NULL), {_COMPONENTS},
links AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings LEFT JOIN comps ON comps.id = vec_id LEFT JOIN links ON links.id = vec_id"""

OP6 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
one AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM one p JOIN one q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comps ON id = doc_id"""

OP7 = rf"""WITH facts AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce(length(translate(text, '#$%&*|<>{{}}[]~^=+\@_0123456789!', ''))::DOUBLE / nullif(length(text), 0), 0.0) + 0.05 AS quality,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0) AS e FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM facts GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM sizes),
levels AS (SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM weighed
    WINDOW before AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels WHERE level * w <= cap)) AS target FROM levels),
ranked AS (SELECT f.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY f.source ORDER BY e / quality, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM facts f JOIN targets t ON f.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN epochs < 3 THEN greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - upto + size)) ELSE 0 END)::BIGINT AS taken FROM ranked"""

OP8 = rf"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) r(k)),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""


def _op10(steps: int = 60) -> str:
    """Rules by length; else the sums of trust and distrust after so many steps, each a table of its own."""
    from .queries import RULES

    rules = sorted((urlgraph.parse_rule(r) for r in RULES), key=lambda r: -len(r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in rules]
    rule = " ".join(f"{f} '{h + p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    link = urlgraph.LINK.replace("'", "''")
    walk = ", ".join(f"s{k + 1} AS MATERIALIZED (SELECT kind, b AS host, {urlgraph.DAMPING} * sum(step * share) AS step FROM s{k} JOIN flow USING (kind, host) GROUP BY ALL)" for k in range(steps))
    every = " UNION ALL ".join(f"FROM s{k}" for k in range(steps + 1))
    return rf"""WITH parsed AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM parsed),
seeds AS MATERIALIZED (SELECT host, avg(coalesce(ruled = 'allow', false)::INT) AS trust, avg(coalesce(ruled = 'block', false)::INT) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM parsed WHERE host <> ''),
parts AS (SELECT host, string_split(host, '.') AS p FROM seeds),
above AS (SELECT host AS src, unnest(range(2, len(p) + 1)) AS level, p FROM parts),
parent AS (SELECT src, arg_min(up.host, level) AS dst FROM above JOIN seeds up ON up.host = array_to_string(p[level:], '.') GROUP BY src),
edges AS MATERIALIZED (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, count(*)::DOUBLE AS n FROM links WHERE src <> dst GROUP BY ALL
    UNION ALL SELECT src, dst, 1.0 FROM parent UNION ALL SELECT dst, src, 1.0 FROM parent) GROUP BY ALL),
flow AS MATERIALIZED (SELECT 0 AS kind, src AS host, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
s0 AS MATERIALIZED (SELECT * FROM (SELECT 0 AS kind, host, {1 - urlgraph.DAMPING:.2f} * trust AS step FROM seeds UNION ALL SELECT 1, host, {1 - urlgraph.DAMPING:.2f} * distrust FROM seeds) WHERE step > 0),
{walk},
scores AS (SELECT host, coalesce(sum(step) FILTER (kind = 0), 0) AS trust, coalesce(sum(step) FILTER (kind = 1), 0) AS distrust FROM ({every}) GROUP BY host)
SELECT page_id, ruled.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {urlgraph.THRESHOLD} * {1 - urlgraph.DAMPING:.2f} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores ON scores.host = ruled.host"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op4() -> str:
    """Spans by the lengths of what is between the matches and of the matches; weak ones joined by intervals."""
    kinds = [("assign", secrets.ASSIGN, f"length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 2)) >= 8"), ("access", secrets.ACCESS, "true"), ("hex", secrets.HEX, "true")]
    extra = {"phrase": f"length(regexp_extract(m, {_quoted(secrets.WEAK['phrase'][0])}, 1)) BETWEEN 4 AND 7", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"}
    kinds += [(k, p, extra.get(k, "true")) for k, (p, _) in secrets.WEAK.items()]
    parts = []
    for i, (kind, pattern, keep) in enumerate(kinds):
        q = _quoted(pattern)
        parts.append(
            f"""SELECT doc_id, {i} AS k, '{kind}' AS kind, '{secrets.ROLE[kind]}' AS role, s, s + length(m) AS e FROM (
  SELECT doc_id, hits[i] AS m, list_sum(list_transform(gaps[1 : i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda g: length(g))), 0)::BIGINT AS s FROM (
    SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {q}, 0) AS hits, regexp_split_to_array(text, {q}) AS gaps FROM documents WHERE text IS NOT NULL))) WHERE {keep}"""
        )
    return f"""WITH every AS ({" UNION ALL ".join(parts)}),
base AS (SELECT * FROM every WHERE k < 3),
free AS (SELECT * FROM every w WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND w.s < b.e AND b.s < w.e)),
linked AS (SELECT * FROM free w WHERE EXISTS (SELECT 1 FROM every o WHERE o.doc_id = w.doc_id AND (o.role = 'secret') <> (w.role = 'secret') AND o.e >= w.s - {secrets.SCOPE} AND o.s <= w.e + {secrets.SCOPE})),
texts AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS t FROM base GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS t FROM (FROM base UNION ALL FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(texts.t, '')) AS base_sha256, coalesce(whole.t, '') AS spans
FROM documents d LEFT JOIN texts USING (doc_id) LEFT JOIN whole USING (doc_id)"""


SQL: dict[str, str] = {
    "op2_embedding_near_dedup": OP2,
    "op4_secret_scan": _op4(),
    "op6_minhash_near_dedup": OP6,
    "op7_source_mixing": OP7,
    "op8_phrase_dedup": OP8,
    "op10_url_filter": _op10(),
}
