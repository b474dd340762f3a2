"""SQL that gives the rows of the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from . import collocations, decontamination, license_scan, quality_rules, spelling
from .queries import SLIP_EVERY

SPACES, BROKEN = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def quality_sql() -> str:
    gone = lambda c: f"length(t) - length(replace(t, '{c}', ''))"
    stop = f"len(list_filter(ws, lambda x: list_contains({list(quality_rules.STOP_WORDS)}, lower(x))))"

    def fails(r: quality_rules.Rule) -> str:
        return f"(n_words >= {r.from_words} AND 100 * {r.metric} {'<' if r.least else '>'} {r.percent} * {r.of})"

    base, own = (" OR ".join(map(fails, x)) for x in (quality_rules.BASE, quality_rules.RULES))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACES}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, i, ws[i + 1 : i + 5] AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 0))) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, ({" + ".join(gone(c) for c in "#*$%&|<>")})::BIGINT AS n_symbols,
        ({gone("!")})::BIGINT AS n_exclaim, ({stop})::BIGINT AS n_stop, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, 1 AS one FROM w LEFT JOIN r USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({base} OR {own}) AS kept, n_exclaim, n_stop, n_lines FROM m"""


def license_sql() -> str:
    tokens: dict[int, list[str]] = {}
    labels: dict[int, str] = {}
    for k, label, token in license_scan.template_tokens():
        tokens.setdefault(k, []).append(token)
        labels[k] = label
    templates = ", ".join(f"({k}, '{labels[k]}', {v!r}, {license_scan.needed(k, len(v), license_scan.CONTAINMENT)}, {license_scan.run_length(k, license_scan.CONTAINMENT)})" for k, v in tokens.items())
    parts = []
    for phrase, label in license_scan.PHRASES:
        stands = " AND ".join(f"ws[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        parts.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w) WHERE {stands}")
    return f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '{BROKEN}'), lambda x: x <> '') AS ws FROM d),
    p AS ({" UNION ALL ".join(parts)}),
    pb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
    tpl(k, label, tk, needed, run) AS (VALUES {templates}),
    b AS (SELECT doc_id, list_filter(regexp_split_to_array(part, '{BROKEN}'), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{license_scan.EMPTY_LINE}')) AS part FROM d)),
    m AS (SELECT doc_id, label, tk, needed, list_max(list_transform(range(1, len(ws) + 1), lambda i: len(list_intersect(ws[i : i + run - 1], tk)))) AS n FROM b, tpl WHERE len(list_intersect(ws, tk)) >= needed),
    h AS (SELECT doc_id, label, n / len(tk) AS share FROM m WHERE n >= needed),
    l AS (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM p),
    al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY doc_id),
    s AS (SELECT doc_id, max(share) AS share FROM h GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
    FROM w LEFT JOIN pb USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN s USING (doc_id)"""


def decontamination_sql() -> str:
    cut = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BROKEN}'), lambda x: x <> '')"
    width = decontamination.WIDTH
    return f"""
    WITH w AS (SELECT doc_id, {cut("text")} AS ws FROM documents),
    b AS (SELECT item_id, ws, least({width}, len(ws)) AS k FROM (SELECT item_id, {cut("text")} AS ws FROM benchmark) WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i + 1 : i + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - k + 1)) AS i FROM b)),
    dw AS (SELECT doc_id, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(0, greatest(len(ws) - k + 1, 0))) AS i FROM w, (SELECT DISTINCT k FROM bw))),
    h AS (SELECT DISTINCT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


def collocations_sql() -> str:
    least, top, longest = collocations.LEAST, collocations.TOP, collocations.LONGEST
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
    n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
    i AS (SELECT lang, ws, k, unnest(range(0, greatest(len(ws) - k + 1, 0))) AS i FROM w, (SELECT unnest(range(1, {longest + 1})) AS k)),
    f AS (SELECT lang, k, array_to_string(ws[i + 1 : i + k], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= {least}),
    c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    own AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS x WHERE x.lang = c.lang AND x.k > c.k AND x.f >= c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
    j AS (SELECT *, unnest(range(1, k)) AS j FROM own),
    s AS (SELECT j.lang, j.phrase, j.f AS a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * j.f * n.n) // (l.f::HUGEINT * r.f) AS score
        FROM j JOIN f AS l ON l.lang = j.lang AND l.phrase = array_to_string(j.ws[1 : j], ' ') JOIN f AS r ON r.lang = j.lang AND r.phrase = array_to_string(j.ws[j + 1 :], ' ') JOIN n ON n.lang = j.lang
        QUALIFY row_number() OVER (PARTITION BY j.lang, j.phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""


def spelling_sql() -> str:
    table = f"[{', '.join(map(str, spelling.crc_table().tolist()))}]"
    return f"""
    WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    g AS (SELECT doc_id, run, count(*) AS many, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r WHERE length(run) >= {spelling.LENGTH} GROUP BY doc_id, run),
    h AS (SELECT run, many, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
        lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h FROM g),
    s AS (SELECT CASE WHEN h % {SLIP_EVERY} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, many FROM h),
    w AS (SELECT word, sum(many)::BIGINT AS n FROM s WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(many) >= {spelling.LEAST}),
    d AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS cut FROM (SELECT *, unnest(range(0, length(word))) AS k FROM w)),
    pairs AS (SELECT a.word, b.word AS near FROM d AS a JOIN d AS b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word
        UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.cut UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.cut),
    m AS (SELECT p.word, count(*) AS n_near, arg_min(b.word, (-b.n, b.word)) AS near, max(b.n) AS near_n FROM pairs AS p JOIN w AS b ON b.word = p.near GROUP BY p.word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {spelling.RATIO} * w.n THEN near_n END::BIGINT AS form_n FROM w LEFT JOIN m USING (word)),
    up AS (WITH RECURSIVE u AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT u.word, f.form, steps + 1 FROM u JOIN f ON f.word = u.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, steps) AS root FROM u GROUP BY word)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN up USING (word)"""


ORACLES = {"op4_license_scan": license_sql(), "op9_quality_rules": quality_sql(), "op11_decontamination": decontamination_sql(), "op12_collocations": collocations_sql(), "op13_spelling_variants": spelling_sql()}
