"""SQL for the independent engine, of the operators that SQL can express: written from the contracts, not from the Spark plans."""

from __future__ import annotations

from hushframe.llm import fingerprints, url_filter

CHAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(role || chr(1) || text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) - 1 AS escaped
  FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(12 + 10 + 10 + escaped) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: Without the added conversation, and with the layout that each one's record has.
MIXED = CHAT.replace("""
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')""", "").replace("SELECT conv_id, count(*) AS n_turns", "SELECT conv_id, ['messages', 'conversations', 'turns', 'message texts'][conv_id % 4 + 1] AS layout, count(*) AS n_turns")


def url_sql() -> str:
    """The rules and the two character models over pages."""
    order = url_filter.ORDER
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0], r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    levels = [f"l{order + 1} AS (SELECT gram AS g, sum(CASE WHEN ruled = 'allow' AND NOT held THEN 1 ELSE 0 END) AS a, sum(CASE WHEN ruled = 'block' AND NOT held THEN 1 ELSE 0 END) AS b FROM each_gram GROUP BY gram)"]
    levels += [f"l{m} AS (SELECT substr(g, 2, {m}) AS g, sum(a) AS a, sum(b) AS b FROM l{m + 1} GROUP BY 1)" for m in range(order, 0, -1)]
    for m in range(1, order + 2):
        less = f"1 / {url_filter.ALPHABET} AS sa, 1 / {url_filter.ALPHABET} AS sb FROM l1 x" if m == 1 else f"s.pa AS sa, s.pb AS sb FROM l{m} x JOIN p{m - 1} s ON s.g = substr(x.g, 2, {m - 1})"
        levels.append(f"c{m} AS (SELECT substr(g, 1, {m - 1}) AS c, sum(a) AS na, sum(b) AS nb, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS qa, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS qb FROM l{m} GROUP BY 1)")
        levels.append(f"p{m} AS (SELECT y.g, CASE WHEN na + qa > 0 THEN (y.a + qa * sa) / cast(na + qa AS DOUBLE) ELSE sa END AS pa, CASE WHEN nb + qb > 0 THEN (y.b + qb * sb) / cast(nb + qb AS DOUBLE) ELSE sb END AS pb FROM (SELECT x.g, x.a, x.b, {less}) y JOIN c{m} ON c = substr(y.g, 1, {m - 1}))")
    return f"""
WITH cut_url AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut_url),
site AS (SELECT host, path, {ruled} AS ruled, substr(md5(host || chr(10) || path), 1, 1) < '3' AS held FROM (SELECT DISTINCT host, path FROM parts)),
each_gram AS (
  SELECT host, path, ruled, held, substr(repeat(chr(2), {order}) || host || path || chr(3), cast(i AS BIGINT), {order + 1}) AS gram
  FROM (SELECT *, unnest(range(1, length(host || path) + 2)) AS i FROM site)),
{", ".join(levels)},
scored AS (
  SELECT host, path, any_value(ruled) AS ruled, any_value(held) AS held, avg(ln(pa) - ln(pb)) AS x
  FROM each_gram JOIN p{order + 1} ON g = gram GROUP BY host, path),
fit AS (
  SELECT avg(x) FILTER (WHERE ruled = 'allow') AS a, avg(x) FILTER (WHERE ruled = 'block') AS b FROM scored WHERE held AND ruled IS NOT NULL),
judged AS (
  SELECT host, path, coalesce(ruled, CASE WHEN x >= coalesce((a + b) / 2, 0) THEN 'allow' ELSE 'block' END) AS verdict
  FROM scored, fit)
SELECT page_id, host, path, {rule} AS rule, verdict FROM parts JOIN judged USING (host, path)
"""


def fingerprint_sql() -> str:
    """I-Match over documents and their edited texts."""
    f = fingerprints
    members = ["true", *(f"h & {bits << 6 * k} = 0" for k in range(f.SETS) for bits in (0b11, 0b1111, 0b111111))]
    parts = " || ".join(f"CASE WHEN count(*) FILTER (WHERE {m}) = 0 THEN '{f.NONE}' ELSE substr(md5('[' || string_agg(cast(h AS VARCHAR), ', ' ORDER BY h) FILTER (WHERE {m}) || ']'), 1, {f.DIGITS}) END" for m in members)
    terms = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> ''))"
    like = """CASE WHEN {0} = {1} THEN 1.0 WHEN starts_with({0}, 'x') OR starts_with({1}, 'x') THEN 0.0 ELSE
      len(list_filter(range({n}), lambda k: substr({0}, k * {d} + 1, {d}) = substr({1}, k * {d} + 1, {d}) AND substr({0}, k * {d} + 1, {d}) <> '{none}')) / cast(greatest(1,
      len(list_filter(range({n}), lambda k: substr({0}, k * {d} + 1, {d}) <> '{none}' OR substr({1}, k * {d} + 1, {d}) <> '{none}'))) AS DOUBLE) END"""
    near = lambda a, b: like.format(a, b, n=f.COMPONENTS, d=f.DIGITS, none=f.NONE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS place FROM documents),
n AS (SELECT count(*) AS n FROM d),
follow AS (SELECT d.*, e.text AS next_text, e.place AS next_place FROM d, n, d e WHERE e.place = CASE WHEN d.place = n.n THEN 1 ELSE d.place + 1 END),
texts AS (
  SELECT place, 0 AS side, text AS own FROM follow UNION ALL
  SELECT place, 1, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) FROM follow),
words AS (SELECT place, side, unnest({terms.format('own')}) AS term FROM texts),
known AS (SELECT term, cast('0x' || substr(md5(term), 1, {f.TERM_DIGITS}) AS BIGINT) AS h, df >= 2 AND df * {f.RAREST} >= n.n AND df * {f.COMMONEST} <= n.n AS band
  FROM (SELECT term, count(*) FILTER (WHERE side = 0) AS df FROM words GROUP BY term), n),
own AS (SELECT *, bool_or(band) OVER (PARTITION BY place, side) AS has FROM words JOIN known USING (term)),
made AS (SELECT place, side, {parts} AS print FROM own WHERE band OR NOT has GROUP BY place, side),
prints AS (SELECT t.place, t.side, t.own, coalesce(print, 'x' || md5(own)) AS print FROM texts t LEFT JOIN made USING (place, side)),
joined AS (
  SELECT f.doc_id, length(f.text) AS n_chars, sha256(e.own) AS edited_sha256, a.print AS fingerprint, e.print AS edited_fingerprint, b.print AS after
  FROM follow f JOIN prints a ON a.place = f.place AND a.side = 0 JOIN prints e ON e.place = f.place AND e.side = 1 JOIN prints b ON b.place = f.next_place AND b.side = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {near("fingerprint", "edited_fingerprint")} AS near_edited, {near("fingerprint", "after")} AS near_next FROM joined
"""


#: Classes of near copies by all pairs of texts that share a run of words, and all that links lead to.
NEAR = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, min(r) AS node FROM d GROUP BY text),
w AS (SELECT node, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT node, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM w),
c AS (SELECT node, run, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT node, sum(n) AS size FROM c GROUP BY node),
p AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.run = b.run AND a.node < b.node GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE common >= 0.8 * (x.size + y.size - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT node AS a, node AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
label AS (SELECT a AS node, min(b) AS label FROM reach GROUP BY a),
o AS (SELECT doc_id, label FROM d JOIN t USING (text) JOIN label USING (node))
SELECT doc_id, min(doc_id) OVER (PARTITION BY label) AS class_id, count(*) OVER (PARTITION BY label) AS class_docs, row_number() OVER (PARTITION BY label ORDER BY doc_id NULLS LAST) = 1 AS kept FROM o
"""

#: Leaked items by all places at which a document and an item have a word in common.
LEAKS = r"""
WITH dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents)),
it AS (SELECT item_id, w, len(w) AS n, least(15, len(w)) AS win, least(15, len(w)) - CASE WHEN len(w) >= 15 THEN 3 WHEN len(w) >= 12 THEN 2 WHEN len(w) >= 9 THEN 1 ELSE 0 END AS need
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS ip FROM it),
g AS (SELECT doc_id, item_id, pos - ip AS shift, list(ip) AS ips FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= 1),
x AS (SELECT doc_id, item_id, shift, ips, win, need, unnest(range(0, n - win + 1)) AS p FROM g JOIN it USING (item_id) WHERE len(ips) >= need),
y AS (SELECT doc_id, item_id, win, need, len(list_filter(ips, lambda i: i >= p AND i < p + win)) AS same, shift + p AS word FROM x)
SELECT doc_id, item_id, cast(max(same) AS INT) AS n_equal, cast(any_value(win) AS INT) AS n_window, first(word ORDER BY same DESC, word) AS word FROM y WHERE same >= need GROUP BY doc_id, item_id
"""


ORACLE_SQL = {"op4_near_duplicates": NEAR, "op8_decontamination": LEAKS, "op3_url_filter": url_sql(), "op5_document_fingerprints": fingerprint_sql(), "op7_chat_formatting": CHAT, "chat_mixed_layouts": MIXED}
