"""SQL for DuckDB that gives the same rows as the queries that SQL can express.

Extraction from HTML and pieces of a vocabulary are out of its reach; tests hold those to plain Python and to the library.
"""

from __future__ import annotations

import re

from . import quality, secrets, urlfilter

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.format(fold("coalesce(text, '')"))} w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a.doc_id a, b.doc_id b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id a, doc_id b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(c.c, d.doc_id) component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) c FROM r GROUP BY 1) c USING (doc_id)"""

_RULES = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in urlfilter.RULES)


def _level(rows: str) -> str:
    """The fitted strength of a level's priors."""
    c = urlfilter.ReputationConfig()
    return f"""(SELECT greatest({c.least}, least({c.most}, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {c.most} END, {c.most}))) FROM
(SELECT (sum(n * pow(b / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(greatest(0, sum(prior * (1 - prior) * (n - 1))), 0) rho FROM {rows} WHERE n > 0))"""


_C = urlfilter.ReputationConfig()
_TWO = ", ".join(f"'{x}'" for x in _C.second_level)
OP2 = rf"""WITH p AS MATERIALIZED (SELECT page_id, {fold("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
u AS (SELECT p.page_id, arg_max(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) x FROM p JOIN (VALUES {_RULES}) r(rule, h, start, verdict) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY 1),
l AS (SELECT doc_id, count(*) n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) b FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY 1),
h0 AS MATERIALIZED (SELECT host, coalesce(sum(n), 0)::DOUBLE n, coalesce(sum(b), 0)::DOUBLE b, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
h1 AS MATERIALIZED (SELECT host, n, b, CASE WHEN ip THEN name WHEN two THEN array_to_string(t[-3:], '.') ELSE array_to_string(t[-2:], '.') END dom, CASE WHEN ip THEN '{urlfilter.ADDRESS}' WHEN two THEN array_to_string(t[-2:], '.') ELSE t[-1] END suf FROM
(SELECT *, regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$|^\[') ip, coalesce(regexp_full_match(t[-1], '[a-z]{{2}}') AND t[-2] IN ({_TWO}), false) two FROM (SELECT *, string_split(name, '.') t FROM h0))),
d1 AS MATERIALIZED (SELECT dom, suf, sum(n) n, sum(b) b FROM h1 GROUP BY 1, 2), s1 AS MATERIALIZED (SELECT suf, sum(n) n, sum(b) b FROM d1 GROUP BY 1),
s2 AS MATERIALIZED (SELECT suf, n, b, (tb - b + 0.5) / (tn - n + 1) prior, tn - n + 1 behind FROM s1, (SELECT sum(n) tn, sum(b) tb FROM s1)), s3 AS MATERIALIZED (SELECT suf, n, b, prior, least(k, behind) k FROM (SELECT *, {_level("s2")} k FROM s2)),
d2 AS MATERIALIZED (SELECT dom, d1.n, d1.b, (s3.b - d1.b + k * prior) / (s3.n - d1.n + k) prior, s3.n - d1.n + k behind FROM d1 JOIN s3 USING (suf)), d3 AS MATERIALIZED (SELECT dom, n, b, prior, least(k, behind) k FROM (SELECT *, {_level("d2")} k FROM d2)),
h2 AS MATERIALIZED (SELECT host, h1.n, h1.b, (d3.b - h1.b + k * prior) / (d3.n - h1.n + k) prior, d3.n - h1.n + k behind FROM h1 JOIN d3 USING (dom)), h3 AS MATERIALIZED (SELECT host, b + k * prior al, n - b + k * (1 - prior) be FROM (SELECT host, n, b, prior, least(k, behind) k FROM (SELECT *, {_level("h2")} k FROM h2))),
h4 AS (SELECT host, al / (al + be) - {_C.z} * sqrt(al * be / pow(al + be, 2) / (al + be + 1)) bound FROM h3)
SELECT p.page_id, p.host, p.path, u.x.rule AS rule, coalesce(u.x.verdict, CASE WHEN bound > {_C.limit} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN u USING (page_id) JOIN h4 USING (host)"""

OP4 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} w FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d WHERE len(w) >= 13)),
f AS MATERIALIZED (SELECT x, min(doc_id) m FROM s GROUP BY 1), g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) i FROM s JOIN f USING (x) WHERE m < doc_id),
k AS (SELECT t.doc_id, string_agg(t.v, ' ' ORDER BY t.i) kept, count(*) n FROM (SELECT doc_id, unnest(w) v, unnest(range(1, len(w) + 1)) i FROM d) t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""



def _rule(rank: int, rule: secrets.Rule) -> str:
    """kind, start, end of a rule's matches: what lies between matches and the matches take turns.

    This engine's expressions fold more letters than A-Z and cannot look behind. Instead of looking behind, one character more is matched, in
    a text that begins with a space; a scheme's leftmost match begins at the start of its letters anyway.
    """
    either = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")"
    pattern = re.sub(r"\(\?i:([^)]*)\)", either, rule.pattern)
    before = re.match(r"\(\?<!\[(.*?)\]\)", pattern)
    shift = int(before is not None and rule.kind != "url_password")
    if before:
        pattern = f"[^{before[1]}]" * shift + pattern[before.end() :]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' kind, b + g + {shift} - 1 AS a, b + g + n - 1 AS z, o FROM
(SELECT doc_id, i, length(s[i]) g, length(m[i]) n, length(k[i]) o, coalesce(sum(length(s[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM
(SELECT doc_id, s, m, k, unnest(range(1, len(m) + 1)) i FROM (SELECT doc_id, string_split_regex(x, {p}) s, regexp_extract_all(x, {p}, 0) m, regexp_extract_all(x, {p}, {rule.group}) k FROM t WHERE regexp_matches(x, {p})))) WHERE o >= {rule.least + (shift if not rule.group else 0)}"""


_SPAN = "kind || ':' || a::BIGINT || ':' || z::BIGINT"
OP5 = f"""WITH t AS MATERIALIZED (SELECT doc_id, ' ' || coalesce(text, '') x FROM documents), f AS MATERIALIZED ({" UNION ALL ".join(_rule(k, r) for k, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') n_{r.kind}" for r in secrets.BASE)}, string_agg({_SPAN}, ',' ORDER BY a, rank) FILTER (rank < {len(secrets.BASE)}) base, string_agg({_SPAN}, ',' ORDER BY a, rank) spans FROM f GROUP BY 1)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM t LEFT JOIN g USING (doc_id)"""

_LEN = r"length({0}) + length(regexp_replace({0}, '[^\\<#{1}]', '', 'g'))"
OP6 = rf"""WITH c AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
n AS MATERIALIZED (SELECT *, row_number() OVER w i, count(*) OVER (PARTITION BY conv_id) k, 14 + {_LEN.format("role", ":")} + {_LEN.format("text", "")} size FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, count(*) FILTER (role = 'assistant' OR i = k) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) times FROM n)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) loss_sha256, sum(size * times)::BIGINT formatted_chars FROM e GROUP BY 1"""

OP8 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT size, md5(coalesce(doc_id::VARCHAR, 'null') || ':7') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 p FROM d GROUP BY source),
w AS MATERIALIZED (SELECT source, source_size, list_value(5e0, 2e0, 1e0)[p % 3 + 1] w, 2e0 * source_size cap, 1.5e0 * sum(source_size) OVER () total FROM s),
v AS MATERIALIZED (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) level FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM v WHERE level <= cap / w), 'infinity'::DOUBLE) * w) target FROM v),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END whole, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT taken FROM r"""

OP9 = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) k FROM s) WHERE k <= 10"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    a, b = f"list_transform({p}, lambda x: x / list_sum({p}))", f"list_transform({q}, lambda x: x / list_sum({q}))"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({a}, {b}), lambda z: {term('z[1]')} + {term('z[2]')})) / 2))"


_Q = quality.QualityConfig()
_CASCADE = []
for _k, (_, _p) in enumerate(quality.CLASSES):
    _CASCADE.append(f"regexp_replace(r{_k}, '{_p.replace(chr(39), chr(39) * 2).replace(chr(92) + chr(34), chr(34))}', '', 'g') AS r{_k + 1}")
_NEST = "(SELECT doc_id, lang, text, w, array_to_string(w, '') AS r0 FROM d)"
for _c in _CASCADE:
    _NEST = f"(SELECT *, {_c} FROM {_NEST})"
_N = len(quality.CLASSES)
_CLASS = "list_value(" + ", ".join(f"(length(r{k}) - length(r{k + 1}))::DOUBLE" for k in range(_N)) + f", length(r{_N})::DOUBLE)"
_WORD = "list_value(" + ", ".join(f"len(list_filter(w, lambda x: x = '{x}'))::DOUBLE" for x in quality.COMMON_WORDS)
_WORD += ", len(list_filter(w, lambda x: x NOT IN (" + ", ".join(f"'{x}'" for x in quality.COMMON_WORDS) + ")))::DOUBLE)"
_SUM = lambda c, size: "list_value(" + ", ".join(f"sum({c}[{i + 1}])" for i in range(size)) + ")"
_share = lambda c: f"list_value(list_sum(list_slice({c}, 1, {len(quality.COMMON_WORDS)})), ({c})[{len(quality.COMMON_WORDS) + 1}])"
_SIZES = (_N + 1, len(quality.COMMON_WORDS) + 1)
OP10 = rf"""WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} w FROM documents),
t AS (SELECT doc_id, i, list_slice(w, i, i + 2) x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3)),
g AS (SELECT doc_id, count(DISTINCT i + j) n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) k FROM t), range(3) r(j) WHERE k > 1 GROUP BY 1),
f AS MATERIALIZED (SELECT doc_id, lang, len(w)::BIGINT n_words, length(r0)::BIGINT word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {_CLASS} ch, {_WORD} wh FROM {_NEST}),
b AS MATERIALIZED (SELECT f.*, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(g.n, 0) n_repeat_words, n_words < 50 OR 100 * coalesce(g.n, 0) > 50 * n_words base_failed FROM f LEFT JOIN g USING (doc_id)),
o AS MATERIALIZED (SELECT lang, {_SUM('ch', _SIZES[0])} rc, {_SUM('wh', _SIZES[1])} rw FROM b WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1 HAVING sum(n_words) >= {_Q.min_reference}),
a AS MATERIALIZED (SELECT {_SUM('ch', _SIZES[0])} ac, {_SUM('wh', _SIZES[1])} aw FROM b WHERE NOT base_failed),
j AS (SELECT b.*, coalesce(rc, ac) rc, coalesce(rw, aw) rw, ac, aw FROM b LEFT JOIN o ON b.lang = o.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words, base_failed,
NOT base_failed AND (word_chars < {_Q.min_chars} OR least({_js('ch', 'rc')}, {_js('ch', 'ac')}) <= {_Q.max_class}) AND (n_words < {_Q.min_words} OR least({_js('wh', 'rw')}, {_js('wh', 'aw')}) <= {_Q.max_words} OR {_js(_share('wh'), _share('coalesce(rw, aw)'))} <= {_Q.max_share}) kept FROM j"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1, "op2_url_filter": OP2, "op4_substring_dedup": OP4, "op5_secret_scan": OP5, "op6_chat_format": OP6, "op8_source_mix": OP8, "op9_topk": OP9, "op10_quality_rules": OP10,
}
