"""DuckDB SQL for the operators that SQL can express, on the whole documents table."""

from __future__ import annotations

from ledgerloom.llm.licenses import PHRASES, TEMPLATES, longest

_SPACE = r"[ \t\n\x0B\f\r]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
#: A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op2() -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
    windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
    found AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1),
    repeated AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM found) GROUP BY r),
    f AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(all_lines, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) - len(list_distinct(list_filter(all_lines, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
      len(regexp_extract_all(coalesce(text, ''), '!!')) AS shouts, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS digits, list_filter(all_lines, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d LEFT JOIN repeated ON repeated.r = d.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols * 10 > n_words * 3 OR shouts * 5 > n_words OR word_chars > 20 * n_words OR digits * 4 > word_chars * 3
        OR n_dup_lines * 2 > len(lines) + 2 OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) * 2 > len(lines) + 4 OR len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•][ \t]'))) * 10 > len(lines) * 9 + 40) AS kept FROM f"""


def op3(span: int = 4, percent: int = 85) -> str:
    words = f"list_filter(string_split_regex({_LOWER}, '{_SPACE}'), lambda x: x <> '')"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
    grams AS (SELECT doc_id, array_to_string(w[i:i + {span - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {span - 2}, 2))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * o >= {percent} * (s.n + t.n - o)),
    both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON b.x = r.y)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, coalesce(k.links, 0) AS n_links FROM d LEFT JOIN (SELECT x, count(*) AS links FROM both_ways GROUP BY x) k ON k.x = d.doc_id LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reached GROUP BY x) r ON r.x = d.doc_id"""


def op4(far: int = 8, far_common: int = 32) -> str:
    marks = "'^[ \\t]{0,3}((?:>[ \\t]?)+)'"
    space = r"[ \t\n\x0B\f\r]"
    normal = f"lower(trim(regexp_replace(x, '{space}+', ' ', 'g')))"
    blank = r"\n(?:[ \t\x0B\f\r]*\n)+"
    return rf"""WITH RECURSIVE m AS MATERIALIZED (SELECT conv_id, turn, min(struct_pack(role := role, text := coalesce(text, ''))) AS m FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
    parts AS (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT conv_id, turn, string_split_regex(m.text, '\r?\n') AS l FROM m)),
    lines AS MATERIALIZED (SELECT conv_id, turn, i, len(regexp_extract(line, {marks}, 1)) - len(replace(regexp_extract(line, {marks}, 1), '>', '')) AS level, regexp_replace(line, {marks}, '') AS line FROM parts),
    runs AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM lines)),
    whole AS MATERIALIZED (SELECT conv_id, turn, run, level, string_agg(line, chr(10) ORDER BY i) AS x FROM runs GROUP BY conv_id, turn, run, level),
    pieces AS MATERIALIZED (SELECT DISTINCT conv_id, turn, level, part, {normal} AS body FROM (SELECT conv_id, turn, level, 0 AS part, x FROM whole UNION ALL SELECT conv_id, turn, level, 1, x FROM whole
      UNION ALL SELECT conv_id, turn, level, 1, unnest(string_split_regex(x, '{blank}')) FROM whole UNION ALL SELECT conv_id, turn, level, 1, unnest(string_split(x, chr(10))) FROM whole) WHERE {normal} <> ''),
    clean AS (SELECT conv_id, turn, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^{space}+|{space}+$', '', 'g') AS text FROM lines WHERE level = 0 GROUP BY conv_id, turn),
    here AS (SELECT conv_id, part, body, min(turn) AS own_turn FROM pieces WHERE level = 0 GROUP BY ALL),
    anywhere AS (SELECT part, body, min(struct_pack(conv_id := conv_id, turn := turn)) AS first FROM pieces WHERE level = 0 GROUP BY part, body
      HAVING length(body) >= {far_common} OR length(body) >= {far} AND min(struct_pack(conv_id := conv_id, turn := turn)) = max(struct_pack(conv_id := conv_id, turn := turn))),
    found AS (SELECT q.conv_id, q.turn, q.level, q.part, length(q.body) AS size, CASE WHEN own_turn < q.turn THEN struct_pack(conv_id := q.conv_id, turn := own_turn) END AS inside, CASE WHEN first < struct_pack(conv_id := q.conv_id, turn := q.turn) THEN first END AS outside
      FROM (SELECT conv_id, turn, part, body, min(level) AS level FROM pieces WHERE level > 0 GROUP BY ALL) q LEFT JOIN here h ON h.conv_id = q.conv_id AND h.part = q.part AND h.body = q.body LEFT JOIN anywhere a ON a.part = q.part AND a.body = q.body),
    quoted AS (SELECT conv_id, turn, arg_min(coalesce(inside, outside), struct_pack(l := level, p := part, s := -part * size, o := inside IS NULL, t := -coalesce(inside.turn, outside.turn))) AS parent FROM found WHERE inside IS NOT NULL OR outside IS NOT NULL GROUP BY ALL),
    links AS MATERIALIZED (SELECT b.conv_id, b.turn, coalesce(q.parent, CASE WHEN before IS NOT NULL THEN struct_pack(conv_id := b.conv_id, turn := before) END) AS parent, CASE WHEN q.parent IS NOT NULL THEN 'quote' WHEN before IS NOT NULL THEN 'turn' ELSE 'root' END AS linked
      FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m) b LEFT JOIN quoted q ON q.conv_id = b.conv_id AND q.turn = b.turn),
    tree AS (SELECT conv_id, turn, conv_id AS thread_conv, turn AS thread_turn, 0 AS depth FROM links WHERE parent IS NULL UNION ALL SELECT l.conv_id, l.turn, t.thread_conv, t.thread_turn, t.depth + 1 FROM tree t JOIN links l ON l.parent.conv_id = t.conv_id AND l.parent.turn = t.turn)
    SELECT m.conv_id, m.turn, m.m.role AS role, l.parent.conv_id AS parent_conv, l.parent.turn AS parent_turn, linked, thread_conv, thread_turn, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY thread_conv, thread_turn ORDER BY depth, m.conv_id, m.turn) - 1 AS position, coalesce(c.text, '') AS text
    FROM m JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn JOIN tree t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN clean c ON c.conv_id = m.conv_id AND c.turn = m.turn"""


def op7(threshold: float = 0.8) -> str:
    split = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    templates = ", ".join(f"({_quoted(k)}, {split.format(f'lower({_quoted(v)})')})" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"({_quoted(label)}, {p.split()})" for p, label in PHRASES.items())
    return rf"""WITH t AS (SELECT label, list_distinct(w) AS w FROM (VALUES {templates}) v(label, w)), p AS (SELECT * FROM (VALUES {phrases}) v(label, w)),
    d AS (SELECT doc_id, {_LOWER} AS text, {split.format(_LOWER)} AS w FROM documents),
    base AS (SELECT doc_id, p.label, i - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN p ON x.w[i] = p.w[1] AND x.w[i:i + len(p.w) - 1] = p.w),
    lines AS (SELECT doc_id, i, {split.format('line')} AS w FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d))),
    placed AS MATERIALIZED (SELECT doc_id, i, w, sum(CASE WHEN len(w) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS till FROM lines),
    runs AS (SELECT a.doc_id, a.i, list_distinct(flatten(list(b.w))) AS w FROM (SELECT * FROM placed WHERE len(w) > 0) a JOIN (SELECT * FROM placed WHERE len(w) > 0) b ON a.doc_id = b.doc_id AND a.para = b.para AND b.i >= a.i AND (b.i = a.i OR b.till - len(b.w) - a.till < {longest(TEMPLATES)}) GROUP BY a.doc_id, a.i),
    blocks AS (SELECT doc_id, i, t.label, len(list_intersect(runs.w, t.w))::DOUBLE / len(t.w)::DOUBLE AS c FROM runs JOIN t ON len(runs.w) >= ceil({threshold} * len(t.w) - 1e-9) AND len(list_intersect(runs.w, t.w)) >= ceil({threshold} * len(t.w) - 1e-9)),
    b AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM base GROUP BY doc_id),
    m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM blocks) GROUP BY doc_id),
    s AS (SELECT doc_id, max(c) AS c, string_agg(i || ':' || label, ',' ORDER BY i, label) AS names FROM blocks GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(b.names, '') AS base_labels, coalesce(m.names, '') AS labels,
      CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.c, 0.0::DOUBLE) END AS score, coalesce(s.names, '') AS blocks FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)"""


def op11(group: int = 5, heads: int = 9) -> str:
    # CRC-32 of a short text: its table of 256 by the reflected polynomial, then one step a character.
    table = "(SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, x::BIGINT) ORDER BY x) FROM range(256) t(x))"
    return rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    crc AS MATERIALIZED (SELECT {table} AS k),
    c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {group} AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(crc.k[xor(a & 255, x) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % {heads} AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
    l AS MATERIALIZED (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
    r AS MATERIALIZED (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(l.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h LEFT JOIN l ON l.conv_id = c.base),
    keyed AS (SELECT conv_id, pos + 1 AS depth, text, sha256(length(role) || ':' || role || text) AS own FROM r),
    p AS MATERIALIZED (SELECT conv_id, 0::BIGINT AS depth, '' AS key, '' AS text FROM c UNION ALL SELECT p.conv_id, k.depth, sha256(p.key || k.own), k.text FROM p JOIN keyed k ON k.conv_id = p.conv_id AND k.depth = p.depth + 1),
    n AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS size FROM p GROUP BY depth, key),
    named AS MATERIALIZED (SELECT p.conv_id AS member, n.* FROM p JOIN n ON n.depth = p.depth AND n.key = p.key),
    up AS MATERIALIZED (SELECT n.depth, n.conv_id, a.conv_id AS parent FROM n JOIN named a ON a.member = n.conv_id AND a.depth = n.depth - 1),
    kids AS (SELECT depth - 1 AS depth, parent AS conv_id, count(*) AS k FROM up GROUP BY ALL),
    below AS (SELECT a.depth, a.conv_id, count(*) FILTER (kids.k IS NULL) AS leaves, sum((u.n_convs - 1) * u.size) AS saved FROM n u JOIN named a ON a.member = u.conv_id AND a.depth <= u.depth LEFT JOIN kids ON kids.depth = u.depth AND kids.conv_id = u.conv_id GROUP BY ALL),
    ends AS (SELECT depth, conv_id, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids FROM (SELECT named.*, max(depth) OVER (PARTITION BY member) AS last FROM named) WHERE depth = last GROUP BY ALL)
    SELECT n.conv_id, n.depth, up.parent AS parent_conv_id, n.n_convs, coalesce(kids.k, 0) AS n_children, below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
    FROM n LEFT JOIN up ON up.depth = n.depth AND up.conv_id = n.conv_id LEFT JOIN kids ON kids.depth = n.depth AND kids.conv_id = n.conv_id JOIN below ON below.depth = n.depth AND below.conv_id = n.conv_id LEFT JOIN ends ON ends.depth = n.depth AND ends.conv_id = n.conv_id"""


def op12() -> str:
    words = f"list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '')"
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    orders = " UNION ALL ".join(f"SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, {k} AS step, {x}.bit AS bit, {' + '.join(f'{y}.bit' for y in 'abcde'[: k - 1]) or 0} AS before FROM s" for k, x in enumerate("abcde", 1))
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, part, t, {words} AS w FROM d),
    m AS MATERIALIZED (SELECT r, doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(min(doc_id) OVER (PARTITION BY sha256(t)) < doc_id OR doc_id IS NULL AND min(doc_id) OVER (PARTITION BY sha256(t)) IS NOT NULL, false)::INT AS mask FROM w),
    l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
    cells AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY ALL),
    f AS (SELECT * FROM {letters} v(f, bit)),
    s AS MATERIALIZED (SELECT a, b, c, d, e FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
    steps AS MATERIALIZED ({orders}),
    x AS MATERIALIZED (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM cells CROSS JOIN steps GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""


def op13() -> str:
    return rf"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": op2(), "op3_ngram_join": op3(), "op4_chat": op4(), "op7_licenses": op7(), "op11_prefix_trie": op11(), "op12_filter_audit": op12(), "op13_exact_dedup": op13()}
