"""SQL for the operators that SQL can express."""

from tabulant.llm import codes, decontaminate, infill, licenses, urls
from tabulant.llm.text import LOWER, UPPER

WORDS = rf"regexp_extract_all(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DOCUMENTS = f"""
    d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("text")} AS w FROM documents),
    dw AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM d)"""


def quoted(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def license_scan() -> str:
    rows = []
    for i, (label, notice, phrase, base) in enumerate(licenses.TEMPLATES):
        notice, phrase = notice.split(), phrase.split()
        rows.append(f"({i}, '{label}', {base}, {licenses.place(notice, phrase)}, {quoted(phrase)}, {quoted(notice)})")
    labels = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label){}, '')"
    return f"""
    WITH {DOCUMENTS},
    p AS (SELECT * FROM (VALUES {", ".join(rows)}) p(piece, label, base, place, phrase, notice)),
    pn AS (SELECT piece, unnest(notice) AS t, generate_subscripts(notice, 1) - 1 AS j FROM p),
    df AS (SELECT t, count(DISTINCT r) AS n FROM dw WHERE t IN (SELECT t FROM pn) GROUP BY t),
    idf AS (SELECT t, 1 + ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)::DOUBLE) AS x
            FROM (SELECT DISTINCT t FROM pn) LEFT JOIN df USING (t)),
    hits AS (SELECT r, piece, label, base, pos - place AS origin, pos AS start
             FROM p JOIN dw ON dw.t = p.phrase[1] JOIN d USING (r)
             WHERE d.w[pos + 1 : pos + len(phrase)] = phrase),
    covered AS (
      SELECT r, piece, label, base, start,
             round(sum(CASE WHEN origin + j >= 0 AND d.w[origin + j + 1] = pn.t THEN x ELSE 0 END) / sum(x), 6) AS score
      FROM hits JOIN pn USING (piece) JOIN idf USING (t) JOIN d USING (r) GROUP BY r, piece, label, base, start),
    found AS (
      SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
             max(start) FILTER (base) AS last_word, {labels.format(" FILTER (base)")} AS base_labels,
             {labels.format("")} AS labels, max(score) AS score
      FROM covered GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN found USING (r)"""


def url_filter() -> str:
    rest = "coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '')"
    cases = {"rule": "", "verdict": ""}
    for verdict, host, prefix in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{prefix}')"
        cases["rule"] += f" WHEN {fits} THEN '{host}{prefix}'"
        cases["verdict"] += f" WHEN {fits} THEN '{verdict}'"
    seeded = " OR ".join(f"contains(host, '{t}')" for t in urls.SEED_TERMS)
    levels = ""
    for i in range(urls.DEPTH):
        levels += f"""
    seen{i} AS (SELECT host, template[1:{i}] AS node, template[{i + 1}] AS child, sum(n) AS child_n
                FROM t{i} WHERE len(template) > {i} GROUP BY ALL),
    rare{i} AS (SELECT host, node, child FROM seen{i}
                QUALIFY count(*) OVER (PARTITION BY host, node) > {urls.WILD_CHILDREN} AND child_n < {urls.WILD_SUPPORT}),
    t{i + 1} AS (SELECT t.* REPLACE (CASE WHEN q.child IS NULL THEN t.template
                                     ELSE t.template[1:{i}] || ['*'] || t.template[{i + 2}:] END AS template)
                 FROM t{i} t LEFT JOIN rare{i} q
                 ON t.host = q.host AND t.template[1:{i}] = q.node AND t.template[{i + 1}] = q.child),"""
    return f"""
    WITH cut AS (SELECT page_id, {rest} AS rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["verdict"]} END AS by_rule,
                     list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
                                    lambda x: regexp_replace(x, '[0-9]+', '{{n}}', 'g')) AS parts FROM split),
    judged AS (SELECT *, CASE WHEN len(parts) > {urls.DEPTH} THEN parts[1:{urls.DEPTH}] || ['**'] ELSE parts END AS shape,
                      coalesce(by_rule, CASE WHEN {seeded} THEN 'block' END) AS label FROM ruled),
    t0 AS (SELECT host, shape, count(*) AS n, count(label) AS labelled, count(*) FILTER (label = 'block') AS blocked,
                  shape AS template FROM judged GROUP BY host, shape),{levels}
    tree AS (SELECT host, shape, labelled, blocked, array_to_string(template, '/') AS template,
                    array_to_string(template[1:greatest(len(template) - 1, 0)], '/') AS parent FROM t{urls.DEPTH}),
    leaves AS (SELECT host, parent, template, sum(labelled) AS n, sum(blocked) AS b FROM tree GROUP BY ALL),
    pooled AS (SELECT *, sum(b) OVER w / nullif(sum(n) OVER w, 0)::DOUBLE AS s FROM leaves
               WINDOW w AS (PARTITION BY host, parent)),
    branched AS (SELECT *, CASE WHEN n > 0 AND abs(b / nullif(n, 0)::DOUBLE - s) <= {urls.Z} * sqrt(s * (1 - s) / nullif(n, 0)::DOUBLE)
                                THEN '' ELSE template END AS branch FROM pooled),
    prior AS (SELECT (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2)::DOUBLE AS x FROM tree),
    pure AS (SELECT host, parent, template,
                    (sum(b) OVER v + {urls.PRIOR_WEIGHT} * x) / (sum(n) OVER v + {urls.PRIOR_WEIGHT}) AS purity
             FROM branched CROSS JOIN prior WINDOW v AS (PARTITION BY host, parent, branch))
    SELECT page_id, host, path, rule,
           coalesce(by_rule, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
           template, round(purity, 6) AS purity
    FROM judged JOIN tree USING (host, shape) JOIN pure USING (host, parent, template)"""


def decontamination() -> str:
    size = decontaminate.WINDOW
    return f"""
    WITH {DOCUMENTS},
    b AS (SELECT * FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
    s AS (SELECT row_number() OVER () AS q, w FROM (SELECT DISTINCT w FROM b)),
    sw AS (SELECT q, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM s),
    f AS (SELECT t, count(*) AS n FROM dw WHERE t IN (SELECT t FROM sw) GROUP BY t),
    win AS (SELECT q, pos AS first, s.w[pos + 1 : pos + {size}] AS words
            FROM sw JOIN s USING (q) WHERE pos <= greatest(len(s.w) - {size}, 0)),
    hits AS (SELECT r, q, dw.pos AS pos, len(words) AS n FROM win JOIN dw ON dw.t = win.words[1] JOIN d USING (r)
             WHERE d.w[dw.pos + 1 : dw.pos + len(words)] = words),
    hit_words AS (SELECT r, count(DISTINCT place) AS n_hit
                  FROM (SELECT r, unnest(range(pos, pos + n)) AS place FROM hits) GROUP BY r),
    hit_items AS (SELECT r, string_agg(i, ',' ORDER BY i) AS items, count(*) AS n_items
                  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits JOIN s USING (q) JOIN b ON b.w = s.w) GROUP BY r),
    bags AS (SELECT q, list_distinct(words) AS bag, ceil(len(list_distinct(words)) * {decontaminate.NEAR_SHARE} - 1e-9) AS need
             FROM win GROUP BY ALL),
    ranked AS (SELECT q, bag, need, t, row_number() OVER (PARTITION BY q, bag ORDER BY n, t) AS place,
                      count(*) OVER (PARTITION BY q, bag) AS present
               FROM (SELECT q, bag, need, unnest(bag) AS t FROM bags) JOIN f USING (t)),
    sought AS (SELECT q, bag, need, t FROM ranked WHERE place <= present - need + 1),
    -- any 13 words with enough of a window's words hold one of these terms; shifts try all spans around it
    near AS (SELECT DISTINCT r, q FROM sought JOIN dw USING (t) JOIN d USING (r)
             WHERE len(list_filter(range(greatest(dw.pos - {size - 1}, 0), dw.pos + 1), lambda i:
                   len(list_intersect(bag, d.w[i + 1 : i + {size}])) >= need)) > 0),
    nears AS (SELECT r, count(*) AS n_near FROM near ANTI JOIN hits USING (r, q) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
           coalesce(n_near, 0)::BIGINT AS n_near
    FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r) LEFT JOIN nears USING (r)"""


def vector_codes() -> str:
    rounds = ""
    for i in range(codes.ROUNDS + 1):
        rounds += f""",
    near{i} AS MATERIALIZED (SELECT v, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry
              FROM (SELECT v, part, entry, (pp - 2 * list_dot_product(p, c) + cc)::BIGINT AS d
                    FROM parts JOIN (SELECT *, list_dot_product(c, c) AS cc FROM book{i}) USING (part))
              GROUP BY v, part)"""
        if i == codes.ROUNDS:
            break
        rounds += f""",
    cells{i} AS (SELECT part, entry, j, floor(sum(x) / count(*)) AS x
              FROM (SELECT part, entry, unnest(p) AS x, generate_subscripts(p, 1) AS j
                    FROM near{i} JOIN parts USING (v, part))
              GROUP BY part, entry, j),
    moved{i} AS (SELECT part, entry, list(x ORDER BY j) AS c FROM cells{i} GROUP BY part, entry),
    book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c
              FROM book{i} b LEFT JOIN moved{i} m USING (part, entry))"""
    last = codes.ROUNDS
    return f"""
    WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS v, vec_id, label,
             list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)) AS cell
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (
      SELECT *, list_dot_product(p, p) AS pp FROM (
        SELECT v, part, cell[part * len(cell) // {codes.PARTS} + 1 : (part + 1) * len(cell) // {codes.PARTS}] AS p
        FROM kept, range({codes.PARTS}) r(part))),
    book0 AS MATERIALIZED (SELECT part, v AS entry, p AS c FROM parts WHERE v < {codes.ENTRIES}){rounds},
    digest AS (
      SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM book{last})),
    coded AS (
      SELECT vec_id, label, code, error FROM kept JOIN (
        SELECT v, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM near{last} GROUP BY v) USING (v))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded, digest"""


def fill_in_middle() -> str:
    h = ", ".join(f"('0x' || d[{8 * i + 1}:{8 * i + 8}])::BIGINT AS h{i + 1}" for i in range(4))
    marks = " OR ".join(f"contains(t, '{m}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    p, s, m = infill.PREFIX, infill.SUFFIX, infill.MIDDLE
    return f"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('{infill.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
    drawn AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, {h} FROM docs),
    counted AS (SELECT *, len(u) AS n FROM drawn),
    formed AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR {marks} OR h3 % 100 >= {infill.RATE} THEN 'plain'
                  WHEN h4 % 100 < {infill.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
      FROM counted),
    cut AS (
      SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle,
             array_to_string(u[b + 1 :], '') AS suffix
      FROM formed)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                  ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
    FROM cut"""


def statements() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan(),
        "op5_url_filter": url_filter(),
        "op6_decontamination": decontamination(),
        "op11_vector_codes": vector_codes(),
        "op13_fill_in_middle": fill_in_middle(),
    }
