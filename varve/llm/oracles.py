"""The queries of this package in DuckDB's SQL, where it can say them."""

from __future__ import annotations


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Fixed patterns.
ASSIGN = f"""({either_case("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
BARE = "[A-Za-z0-9+/_-]{16,}={0,2}"
VARIED = 0.47


def _found(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    """Matches with their offsets: the pieces between the matches tell how far on each begins."""
    return f"""
        SELECT r, '{kind}' AS kind, {rank} AS rank, value,
            ended - length(hit) AS start, ended AS stop
        FROM (
            SELECT r, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS ended
            FROM (
                SELECT r, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS value,
                    unnest(gaps[:len(hits)]) AS gap
                FROM (
                    SELECT r, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals,
                        string_split_regex(t, '{pattern}') AS gaps
                    FROM docs)))
        WHERE {keep}"""


def secret_scan(max_owners: int, max_repositories: int, least_bits: float) -> str:
    entropy = (
        "-list_sum(list_transform(map_values(histogram), "
        "lambda n: n / length(value)::DOUBLE * log2(n / length(value)::DOUBLE)))"
    )
    return f"""
        WITH docs AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source,
                concat_ws('/', source, lang) AS repository
            FROM documents),
        base AS MATERIALIZED (
            {_found("assign", 1, ASSIGN, 2, "length(value) >= 6")}
            UNION ALL {_found("access", 2, ACCESS, 0, "length(value) >= 20")}
            UNION ALL {_found("hex", 3, HEX, 0, "length(value) >= 24")}),
        bare AS MATERIALIZED (
            SELECT r, value, stop - length(value) AS start, stop, true AS known FROM base
            UNION ALL SELECT r, value, start, stop, false AS known FROM (
            {_found("bare", 0, BARE, 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")})),
        owned AS (
            SELECT value, bool_or(known) AS known, bool_or(NOT known) AS bare, count(DISTINCT coalesce('+' || source, '-')) AS owners,
                count(DISTINCT coalesce('+' || source, '-') || chr(10) || repository) AS repositories
            FROM bare JOIN docs USING (r) GROUP BY value),
        letters AS (
            SELECT value, histogram(letter) AS histogram
            FROM (SELECT value, unnest(string_split(value, '')) AS letter FROM owned) GROUP BY value),
        judged AS (
            SELECT value, CASE
                WHEN owners > {max_owners} OR repositories > {max_repositories} THEN 'example'
                WHEN NOT regexp_matches(value, '(?i)example|sample|placeholder|changeme|xxxx')
                    AND ((bare AND {entropy} >= {least_bits}) OR (known AND {entropy} >= {VARIED} * log2(length(value)))) THEN 'live' END AS verdict
            FROM owned JOIN letters USING (value)),
        added AS (
            SELECT DISTINCT r, verdict AS kind, CASE verdict WHEN 'example' THEN 4 ELSE 5 END AS rank, start, stop
            FROM bare JOIN judged USING (value) WHERE verdict IS NOT NULL),
        every AS (SELECT r, kind, rank, start, stop FROM base UNION ALL SELECT r, kind, rank, start, stop FROM added),
        joined AS (
            SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex", "live", "example"))},
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank <= 3) AS base,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
            FROM every GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex", "live", "example"))},
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN joined USING (r)"""


BLANKS = r"[ \t\n\x0B\f\r]+"
PLAIN = f"nullif(trim(regexp_replace(lower({{0}}), '{BLANKS}', ' ', 'g')), '')"

# Messages as the query makes them: each quotes the one before it, and that one's quote.
QUOTED = r"""
    said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY conv_id, turn),
    mail AS MATERIALIZED (
        SELECT row_number() OVER () AS r, g.conv_id, g.turn, g.role,
            coalesce('> > ' || replace(b.said, chr(10), chr(10) || '> > ') || chr(10), '')
            || coalesce('> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(g.text, '') AS text
        FROM conversations g
        LEFT JOIN said a ON a.conv_id = g.conv_id AND a.turn + 1 = g.turn
        LEFT JOIN said b ON b.conv_id = g.conv_id AND b.turn + 2 = g.turn)"""

QUOTE_LINKS = f"""
    WITH RECURSIVE {QUOTED},
    lines AS (
        SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line
        FROM (SELECT r, string_split_regex(text, '\\r?\\n') AS l FROM mail)),
    marked AS (SELECT r, i, line, regexp_extract(line, '^[>\\x20\\t]*') AS prefix FROM lines),
    levels AS (
        SELECT r, i, length(prefix) - length(replace(prefix, '>', '')) AS level,
            CASE WHEN contains(prefix, '>') THEN substr(line, length(prefix) + 1) ELSE line END AS content
        FROM marked),
    steps AS (
        SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS new FROM levels),
    placed AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS place FROM steps),
    runs AS MATERIALIZED (
        SELECT r, place, level, string_agg(content, chr(10) ORDER BY i) AS content FROM placed GROUP BY r, place, level),
    bodies AS MATERIALIZED (
        SELECT r, coalesce(string_agg(content, chr(10) ORDER BY place) FILTER (level = 0), '') AS body,
            count(*) FILTER (level > 0) AS n_quoted
        FROM runs GROUP BY r),
    passages AS MATERIALIZED (
        SELECT r, 0 AS level, -1 AS place, body AS content FROM bodies
        UNION ALL SELECT r, level, place, content FROM runs),
    units AS MATERIALIZED (
        SELECT r, level, place, 0 AS rank, {PLAIN.format("content")} AS plain FROM passages
        UNION ALL
        SELECT r, level, place, 1 AS rank, {PLAIN.format("line")} AS plain
        FROM (SELECT r, level, place, unnest(string_split(content, chr(10))) AS line FROM passages)),
    origins AS (
        SELECT conv_id, plain, min(turn) AS origin FROM units JOIN mail USING (r)
        WHERE level = 0 AND plain IS NOT NULL GROUP BY conv_id, plain),
    found AS (
        SELECT r, level, place, rank, origin
        FROM units JOIN mail USING (r) JOIN origins USING (conv_id, plain) WHERE level > 0 AND origin < turn),
    best AS (
        SELECT r, level, row_number() OVER (PARTITION BY r, place ORDER BY rank, origin DESC) AS nth, origin FROM found),
    links AS (
        SELECT r, count(*) AS n_linked, arg_min(origin, (level, -origin)) AS parent_turn FROM best WHERE nth = 1 GROUP BY r),
    nodes AS MATERIALIZED (
        SELECT conv_id, turn, max(parent_turn) AS up FROM links JOIN mail USING (r) GROUP BY conv_id, turn),
    walk AS (
        SELECT conv_id, turn, up AS root, 1 AS depth FROM nodes
        UNION ALL
        SELECT w.conv_id, w.turn, n.up, w.depth + 1 FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.root),
    roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn)
    SELECT conv_id, turn, role, md5(body) AS body_md5, n_quoted, coalesce(n_linked, 0) AS n_linked, parent_turn,
        coalesce(root_turn, turn) AS root_turn, coalesce(depth, 0) AS depth
    FROM mail JOIN bodies USING (r) LEFT JOIN links USING (r) LEFT JOIN roots USING (conv_id, turn)"""


def nearest(step: int, k: int) -> str:
    """Whole numbers below 2 ** 53 in all sums, so the product of doubles is exact."""
    return f"""
        WITH usable AS MATERIALIZED (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % {step} = 0),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def mixture(weights: dict[str, float], seed: int = 42) -> str:
    listed = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in weights.items())
    return f"""
        WITH weights(mix, weight) AS (VALUES {listed}, (NULL, 1.0)),
        named AS (SELECT *, CASE WHEN source IN (SELECT mix FROM weights) THEN source END AS mix FROM documents),
        counts AS (SELECT mix, count(*) AS n FROM named GROUP BY mix),
        rates AS (
            SELECT c.mix, weight / sum(weight) OVER () * (sum(n) OVER () * 1.0::DOUBLE) / n AS rate
            FROM counts c JOIN weights w ON c.mix IS NOT DISTINCT FROM w.mix),
        terms AS (
            SELECT mix, rate, k::INT AS k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
            FROM rates, range(0, (ceil(rate + 12 * sqrt(rate) + 30) + 1)::BIGINT) r(k)),
        steps AS (SELECT mix, rate, k, sum(p) OVER (PARTITION BY mix ORDER BY k) AS reached FROM terms),
        points AS (
            SELECT *, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
                / 4503599627370496.0 AS point FROM named),
        copies AS (
            SELECT doc_id, source, rate, k + 1 AS copy FROM points p JOIN steps s
            ON p.mix IS NOT DISTINCT FROM s.mix AND s.reached < p.point)
        SELECT doc_id, source, rate, copy,
            md5('{seed}/shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
        FROM copies"""


EXACT_DEDUP = r"""
    WITH plain AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM plain WINDOW same AS (PARTITION BY t)"""


def centroids(dims: int, clusters: int, rounds: int, scale: int) -> str:
    """Each round assigns all vectors, then takes the floor of the mean of each dimension."""
    first = f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, x FROM (
                SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
                FROM embeddings
                WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: isfinite(c))) = {dims})),
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY code, x) - 1 AS INTEGER) AS cluster, x AS c
            FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS code, x FROM kept ORDER BY code, x LIMIT {clusters}))"""
    far = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(i: int) -> str:
        return f"""
        a{i} AS MATERIALIZED (
            SELECT r, min(CAST({far} AS BIGINT)) AS distance, arg_min(cluster, ({far}, cluster)) AS cluster
            FROM kept CROSS JOIN c{i} GROUP BY r)"""

    def moved(i: int) -> str:
        return f"""
        m{i} AS (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS c
            FROM (
                SELECT cluster, d, sum(v)::BIGINT AS s, count(*) AS n
                FROM (
                    SELECT cluster, unnest(x) AS v, unnest(range(1, {dims} + 1)) AS d
                    FROM kept JOIN a{i} USING (r)) GROUP BY cluster, d)
            GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""

    steps = [part(i) for i in range(rounds) for part in (assigned, moved)]
    return f"""
        WITH {",".join([first, *steps, assigned(rounds)])}
        SELECT vec_id, cluster, distance,
            CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} USING (cluster)"""
