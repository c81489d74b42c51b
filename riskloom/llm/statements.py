"""DuckDB statements of the queries that SQL can express."""

STATEMENTS = {
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY normal ORDER BY size DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY normal) AS group_size,
               row_number() OVER (PARTITION BY normal ORDER BY size DESC, doc_id) = 1 AS kept,
               sha256(normal) AS text_sha256
        FROM d
    """,
    "op9_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, source_size * 2.0::DOUBLE AS most,
                   [3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
            FROM sources
        ), levels AS (
            SELECT *, row_number() OVER rising AS nth,
                   (sum(source_size) OVER () * 1.5::DOUBLE
                    - coalesce(sum(most) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (rising ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed WINDOW rising AS (ORDER BY most / weight, encode(source) NULLS LAST)
        ), chosen AS (
            SELECT arg_min(level, nth) AS level FROM levels WHERE level * weight <= most
        ), targets AS (
            SELECT l.source, l.source_size, least(l.most, coalesce(c.level * l.weight, l.most)) AS target
            FROM levels l CROSS JOIN chosen c
        ), rated AS (
            SELECT s.doc_id, s.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   CAST('0x' || substr(md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM rated
    """,
    "op6_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), usable AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.n, a.vec_id, b.n AS m, b.vec_id AS other FROM usable a JOIN usable b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT n, vec_id AS root FROM v UNION SELECT l.m, r.root FROM reach r JOIN links l ON l.n = r.n
        ), least AS (
            SELECT n, min(root) AS component_id FROM reach GROUP BY n
        ), counted AS (
            SELECT n, count(*) AS n_links FROM links GROUP BY n
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN least USING (n) LEFT JOIN counted USING (n)
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
        FROM g
    """,
    "op11_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce('+' || lang, '') AS tree, source, lang, n_chars, text,
                   CASE WHEN xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 3 = 0
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown
            FROM documents
        ), leaves AS (
            SELECT doc_id, tree, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(shown)::VARCHAR || ':' || shown, '-')) AS found
            FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'),
                coalesce(strlen(lang)::VARCHAR || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-')) AS head FROM d)
        ), seated AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS seat, count(*) OVER (PARTITION BY tree) AS size FROM leaves
        ), nodes AS (
            SELECT tree, 0 AS level, seat AS pos, leaf AS digest, size FROM seated
            UNION ALL
            SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8 FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 8, size
        ), tops AS (
            SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS seat, count(*) OVER () AS size FROM nodes WHERE size = 1
        ), crown AS (
            SELECT 0 AS level, seat AS pos, subroot AS digest, size FROM tops
            UNION ALL
            SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (size + 7) // 8 FROM crown WHERE size > 1 GROUP BY level, pos // 8, size
        ), beside AS (
            SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.size > 1 GROUP BY 1, 2, 3
        ), above AS (
            SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
            FROM crown a JOIN crown b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.size > 1 GROUP BY 1, 2
        ), steps AS (
            SELECT s.tree, s.seat, b.level, b.before, b.behind FROM seated s JOIN beside b ON s.tree = b.tree AND b.pos = s.seat // CAST(8 ** b.level AS BIGINT)
            UNION ALL
            SELECT s.tree, s.seat, 100 + a.level, a.before, a.behind FROM seated s JOIN tops t USING (tree) JOIN above a ON a.pos = t.seat // CAST(8 ** a.level AS BIGINT)
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY tree, seat ORDER BY level) AS step FROM steps
        ), folding AS (
            SELECT tree, seat, 0::BIGINT AS step, found AS node FROM seated
            UNION ALL
            SELECT f.tree, f.seat, n.step, sha256(n.before || f.node || n.behind) FROM folding f JOIN numbered n ON n.tree = f.tree AND n.seat = f.seat AND n.step = f.step + 1
        ), folded AS (
            SELECT tree, seat, arg_max(node, step) AS folded_root FROM folding GROUP BY 1, 2
        ), proofs AS (
            SELECT tree, seat, string_agg(before || behind, '' ORDER BY step) AS proof FROM numbered GROUP BY 1, 2
        )
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM seated JOIN tops USING (tree) JOIN folded ON folded.tree = seated.tree AND folded.seat = seated.seat
            LEFT JOIN proofs ON proofs.tree = seated.tree AND proofs.seat = seated.seat, (SELECT digest AS root FROM crown WHERE size = 1)
    """,
    "op13_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), worded AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, unnest(w) AS phrase, 1 AS words FROM worded
            UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), 2 FROM worded
            UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]), 3 FROM worded
        ), f AS (
            SELECT lang, phrase, words, count(*) AS a FROM grams GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY 1
        ), c AS (
            SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10
        ), inner_ones AS (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3
        ), gone AS (
            SELECT c.lang, c.phrase FROM c JOIN (SELECT lang, phrase, max(a) AS longer FROM inner_ones GROUP BY 1, 2) USING (lang, phrase) WHERE 100 * longer >= 50 * a
        ), cuts AS (
            SELECT lang, phrase, a, 1 AS k, w[1] AS one, array_to_string(w[2:], ' ') AS other FROM c
            UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3
        ), scored AS (
            SELECT cuts.*, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.one JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.other
        ), lowest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM lowest JOIN totals USING (lang) ANTI JOIN gone USING (lang, phrase) WHERE nth = 1 QUALIFY rank <= 2000
    """,
}
