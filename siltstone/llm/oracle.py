"""DuckDB SQL for the training-data queries that SQL can express on whole tables.

Tokens, Markov models, fitted classifiers and byte-level removal (op2 to op5, op10, pipeline) have none: tests compare
them with brute-force versions, round trips or held-out accuracy.
"""

from __future__ import annotations

from siltstone.llm.mixing import Mix
from siltstone.llm.preference import Template
from siltstone.llm.quality_rules import CLASSES, COMMON_WORDS, QualityRules
from siltstone.llm.source_audit import Audit
from siltstone.llm.url_filters import BLANK, HINT, LOWER, REFRESH_URL, RULES, TAG, UNREAD, UPPER, attribute

WORDS = r"[^\x20\x09-\x0D]+"


def _part(x: str, y: str) -> str:
    """A bucket's part of twice the divergence."""
    return f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END + CASE WHEN {y} > 0 THEN {y} * log2(2 * {y} / ({x} + {y})) ELSE 0 END)"


def op1(r: QualityRules = QualityRules()) -> str:
    listed = ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON_WORDS))
    n = lambda kept: f"length(regexp_replace(t, '[^{kept}]', '', 'g'))"
    distance = " + ".join(_part(f"(b.{c} / greatest(b.n_chars, 1))", f"r.{c}") for c in CLASSES)
    whole = f"NOT base_failed AND lang IS NOT NULL AND n_words >= {r.min_words_for_histogram}"

    def far(i: int, limit: str) -> str:
        return (
            f"(coalesce(n_chars >= {r.min_chars} AND class_distance{i} > {limit}, FALSE) OR coalesce(n_words >= {r.min_words_for_histogram} "
            f"AND word_distance{i} > {r.max_word_distance} + sqrt({r.word_noise} / greatest(n_words, 1)), FALSE))"
        )

    def level(i: int, fine: str) -> str:
        """References from some documents, and all documents' distances from them."""
        return f"""
fine{i} AS ({fine}),
ref{i} AS (SELECT lang, count(*) AS n_docs, {", ".join(f"avg({c} / n_chars) AS {c}" for c in CLASSES)} FROM fine{i} GROUP BY lang HAVING count(*) >= {r.min_reference_documents}),
refw{i} AS (SELECT lang, word, sum(n / n_words) / any_value(n_docs) AS q FROM fine{i} JOIN common USING (doc_id) JOIN (SELECT lang, n_docs FROM ref{i}) USING (lang) GROUP BY lang, word),
rq{i} AS (SELECT lang, sum(q) AS rq FROM refw{i} GROUP BY lang),
cd{i} AS (SELECT b.doc_id, sqrt(({distance}) / 2) AS class_distance{i} FROM b JOIN ref{i} r USING (lang)),
hit{i} AS (SELECT b.doc_id, sum({_part("(c.n / b.n_words)", "coalesce(q, 0)")}) AS part, sum(c.n / b.n_words) AS p, sum(coalesce(q, 0)) AS q FROM b JOIN common c USING (doc_id) JOIN ref{i} USING (lang)
  LEFT JOIN refw{i} w ON w.lang = b.lang AND w.word = c.word GROUP BY b.doc_id),
wd{i} AS (SELECT doc_id, sqrt(greatest((coalesce(part, 0) + greatest(rq - coalesce(q, 0), 0) + {_part("greatest(1 - coalesce(p, 0), 0)", "greatest(1 - rq, 0)")}) / 2, 0)) AS word_distance{i}
  FROM (SELECT b.doc_id, part, p, q, coalesce(rq, 0) AS rq FROM b JOIN ref{i} USING (lang) LEFT JOIN rq{i} USING (lang) LEFT JOIN hit{i} USING (doc_id)))"""

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORDS}') AS w FROM d),
c AS (SELECT doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, length(t) AS n_chars, {n("a-z")} AS lower, {n("A-Z")} AS upper, {n("0-9")} AS digit, {n(chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D")} AS space,
  {n("#*$%&|<>")} AS symbol, length(regexp_replace(regexp_replace(t, '[^!-~]', '', 'g'), '[A-Za-z0-9#*$%&|<>]', '', 'g')) AS mark,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM w),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
b AS (SELECT c.*, n_chars - lower - upper - digit - space - symbol - mark AS other, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  n_words < {r.min_words} OR 100 * coalesce(n_repeat_words, 0) > {r.max_repeat_percent} * n_words AS base_failed FROM c LEFT JOIN rep USING (doc_id)),
common AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM w) WHERE word IN ({listed}) GROUP BY ALL),
{level(0, f"SELECT * FROM b WHERE {whole}")},
{level(1, f"SELECT b.* FROM b LEFT JOIN cd0 USING (doc_id) WHERE {whole} AND NOT coalesce(n_chars >= {r.min_chars} AND class_distance0 > {r.trim_class_distance}, FALSE)")}
SELECT b.doc_id, n_words, CAST(n_chars - space AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT {far(1, f"{r.max_class_distance} + sqrt({r.class_noise} / greatest(n_chars, 1))")} AS kept
FROM b LEFT JOIN cd1 USING (doc_id) LEFT JOIN wd1 USING (doc_id)"""


def op6(k: int = 3, percent: int = 85) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: {gram}) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)"""


OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def op8(m: Mix = Mix()) -> str:
    weights = ", ".join(f"{float(x)}::DOUBLE" for x in m.weights)
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size, md5(concat_ws(':', '{m.seed}', CAST(doc_id AS VARCHAR), md5(text))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{weights}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(m.weights)} + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, CAST({m.max_repeats} * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, ({m.budget_factor}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM c WINDOW f AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, max(level) FILTER (level * weight <= cap) OVER () * weight), cap) AS target FROM l),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) AS cumulative FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (CAST(round AS BIGINT) * source_size + cumulative) / target AS finish FROM q, range({m.max_repeats}) r(round) WHERE size > 0 AND target > 0),
taken AS (SELECT doc_id, source, size FROM copies QUALIFY sum(size) OVER (ORDER BY finish, source IS NULL, source, round, place, doc_id) <= {m.budget_factor} * (SELECT sum(size) FROM d)),
n AS (SELECT doc_id, source, sum(size) AS taken FROM taken GROUP BY ALL)
SELECT q.doc_id, q.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN n ON n.doc_id = q.doc_id AND n.source IS NOT DISTINCT FROM q.source"""


def op9(t: Template = Template()) -> str:
    loss = ", ".join(f"'{r}'" for r in t.loss_roles)
    return rf"""
WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
a AS (SELECT conv_id, max(pos) AS pos FROM c WHERE role IN ({loss}) GROUP BY 1),
l AS (SELECT conv_id, pos, text FROM a JOIN c USING (conv_id, pos)),
s AS (SELECT x.conv_id, x.pos AS swapped, y.text AS instead, y.conv_id AS rejected_id FROM l x JOIN l y ON y.conv_id = xor(x.conv_id, 1)),
b AS (SELECT conv_id AS pair_id, conv_id AS chosen_id, rejected_id, side, pos, coalesce(role, '') AS role, coalesce(CASE WHEN side = 'rejected' AND pos = swapped THEN instead ELSE text END, '') AS text
  FROM c JOIN s USING (conv_id), (VALUES ('chosen'), ('rejected')) v(side)),
e AS (SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM b GROUP BY ALL),
n AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same), max(pos) + 1) - 1 AS n_common FROM e GROUP BY 1)
SELECT CAST(pair_id AS BIGINT) AS pair_id, chosen_id, rejected_id, CASE WHEN pos <= n_common THEN 'prompt' ELSE side END AS part, pos, role, '{t.start}' || role || chr(10) || text || '{t.end.strip()}' || chr(10) AS rendered,
  pos > n_common AND role IN ({loss}) AS loss, n_common FROM b JOIN n USING (pair_id) WHERE pos > n_common OR side = 'chosen'"""


def op11() -> str:
    """Edges, aliases and verdicts of whole pages; components by reaching outwards from each end of an edge."""
    q = lambda x: x.replace("'", "''")
    value = lambda name: f"trim(regexp_replace(regexp_extract(tag, '{q(attribute(name))}', 1), '^[\"'']|[\"'']$', '', 'g'), chr(32) || chr(9) || chr(10) || chr(12) || chr(13))"
    after = lambda u: f"CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract({after(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1)"
    scheme = lambda u: f"translate(split_part({u}, '://', 1), '{UPPER}', '{LOWER}')"
    rest = lambda u: f"regexp_extract({after(u)}, '^[^/?#]*([^#]*)', 1)"
    vertex = lambda u: f"CASE WHEN contains({u}, '://') THEN {scheme(u)} || '://' || {host(u)} || CASE WHEN starts_with({rest(u)}, '/') THEN '' ELSE '/' END || {rest(u)} END"
    dots, last_dots = r"/\.\.?(/|$)", r"/\.\.?$"
    plain = lambda x: f"CASE WHEN regexp_matches({x}, '{dots}') THEN list_reduce(string_split({x}, '/'), lambda a, s: CASE s WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || s END) || CASE WHEN regexp_matches({x}, '{last_dots}') THEN '/' ELSE '' END ELSE {x} END"
    fits = " UNION ALL ".join(f"SELECT {len(r.text)}, {r.action == 'allow'}, '{r.text}', '{r.action}', '{r.host}', '{r.path}'" for r in RULES)
    ruled = lambda h, p: f"(SELECT max({{'length': f.length, 'allows': f.allows, 'rule': f.rule, 'action': f.action}}) FROM fits f WHERE ({h} = f.host OR ends_with({h}, '.' || f.host)) AND starts_with({p}, f.path))"
    return rf"""
WITH RECURSIVE fits(length, allows, rule, action, host, path) AS ({fits}),
t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{q(UNREAD)}', ' ', 'g'), '{q(TAG)}')) AS tag FROM pages WHERE contains(url, '://') AND regexp_matches(html, '{HINT}')),
r AS (SELECT url, replace(CASE WHEN lower(tag[2]) = 'l' THEN CASE WHEN contains(' ' || regexp_replace(lower({value('rel')}), '[{BLANK}]+', ' ', 'g') || ' ', ' canonical ') THEN {value('href')} END
  WHEN lower({value('http-equiv')}) = 'refresh' THEN trim(regexp_extract({value('content')}, '{q(REFRESH_URL)}', 1)) END, '&amp;', '&') AS ref FROM t),
b AS (SELECT url, ref, {scheme('url')} || '://' || {host('url')} AS site, CASE WHEN {path('url')} = '' THEN '/' ELSE {path('url')} END AS path, regexp_extract(ref, '^[^?#]*') AS own, regexp_extract(ref, '^[^?#]*([?#].*)?$', 1) AS beyond FROM r WHERE ref IS NOT NULL),
n AS (SELECT url, CASE WHEN ref = '' OR starts_with(ref, '#') THEN NULL WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(ref, '://') THEN ref END WHEN starts_with(ref, '//') THEN split_part(site, '//', 1) || ref
  WHEN starts_with(ref, '?') THEN site || path || ref WHEN starts_with(ref, '/') THEN site || {plain('own')} || beyond ELSE site || {plain("(regexp_extract(path, '^.*/') || own)")} || beyond END AS target FROM b),
e AS (SELECT DISTINCT {vertex('url')} AS a, {vertex('target')} AS b FROM n WHERE a <> b),
ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM ends UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b),
said AS (SELECT a, CASE WHEN coalesce(bool_or(action = 'allow'), FALSE) THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM (SELECT a, {ruled(host('b'), path('b'))}.action AS action FROM reach) GROUP BY a),
p AS (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({path('url')}, '') AS path, {vertex('url')} AS v FROM pages),
j AS (SELECT p.*, {ruled('p.host', 'p.path')} AS r FROM p)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, verdict, 'allow') AS verdict FROM j LEFT JOIN said ON said.a = j.v"""


def op12(p: Audit = Audit()) -> str:
    share = lambda n, total: f"(1 + ({p.scale}::HUGEINT * ({n} + {p.prior})) // ({total} + {p.prior} * v))"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {p.min_documents}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM c),
s AS (SELECT lang, source, term, n, {share("n", "total")} AS p, {share("lang_n", "lang_total")} AS q FROM t),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= {p.top_terms}"""


OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_distribution_divergence": op1(), "op6_minhash_near_dedup": op6(), "op7_mtree_top_k": OP7, "op8_weighted_fair_mix": op8(), "op9_preference_format": op9(),
        "op11_redirect_equivalence": op11(), "op12_source_divergence": op12(), "op13_hard_negatives": OP13,
    }
