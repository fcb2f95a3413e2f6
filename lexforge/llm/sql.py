"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

_TERM_COUNTS = r"""
    bodies AS (SELECT paper_id, any_value(body) AS body FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
    found AS (SELECT paper_id, lower(unnest(regexp_extract_all(body, '[\p{L}\p{N}]+'))) AS word FROM bodies),
    counted AS (SELECT word, count(*) AS n_occurrences, count(DISTINCT paper_id) AS n_papers FROM found GROUP BY word),
    named AS (SELECT term_id, lower(regexp_replace(term, '^\s+|\s+$', '', 'g')) AS word FROM term),
    marked AS (SELECT term_id, named.word, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_papers, 0) AS n_papers,
        CASE WHEN coalesce(n_papers, 0) < 3 THEN 'rare' WHEN n_papers > 0.3 * (SELECT count(DISTINCT paper_id) FROM papers WHERE body IS NOT NULL) THEN 'common' END AS mark
        FROM named LEFT JOIN counted ON named.word = counted.word)"""

_GRAM_COUNTS = """
    runs AS (SELECT gram_id, run_id, max(df) AS df FROM idf GROUP BY ALL),
    own AS (SELECT gram.gram_id, term_id_1, term_id_2, coalesce(sum(df), 0) AS df FROM gram LEFT JOIN runs ON gram.gram_id = runs.gram_id GROUP BY ALL),
    summed AS (SELECT gram_id, CAST(sum(df) OVER (PARTITION BY term_id_1, term_id_2) AS BIGINT) AS n FROM own),
    gram_marks AS (SELECT gram_id, n, CASE WHEN n < 2 THEN 'rare' WHEN n > 0.3 * (SELECT count(*) FROM index_document) THEN 'common' END AS mark FROM summed)"""


_TRIPLES = r"""
    texts AS (SELECT paper_id, any_value(coalesce(title, '') || ' ' || coalesce(body, '')) AS text FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
    lists AS (SELECT paper_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM texts),
    places AS (SELECT paper_id, w, unnest(range(1, len(w) - 1)) AS i FROM lists),
    triples AS (SELECT DISTINCT paper_id, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM places),
    sizes AS (SELECT paper_id, count(*) AS n FROM triples GROUP BY paper_id),
    common AS (SELECT a.paper_id AS p, b.paper_id AS q, count(*) AS c FROM triples a JOIN triples b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.paper_id < b.paper_id GROUP BY ALL)"""

_NEAR = """
    vectors AS (SELECT paper_id, CAST(any_value(other.para_vec) AS DOUBLE[]) AS v FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
    usable AS (SELECT paper_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vectors
        WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    products AS (SELECT a.paper_id AS p, b.paper_id AS q, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) AS s FROM usable a JOIN usable b ON a.paper_id <> b.paper_id),
    near AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS r FROM products QUALIFY r <= 5)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_TRIPLES} SELECT p AS paper_id_1, q AS paper_id_2 FROM common JOIN sizes a ON p = a.paper_id JOIN sizes b ON q = b.paper_id
            WHERE 2 * c >= a.n + b.n - c""",
        "p1_groups": f"""WITH RECURSIVE {_TRIPLES},
            content AS (SELECT paper_id, list(x || ' ' || y || ' ' || z ORDER BY x, y, z) AS s FROM triples GROUP BY paper_id),
            classes AS (SELECT paper_id, min(paper_id) OVER (PARTITION BY s) AS first FROM content),
            pairs AS (SELECT p, q FROM common JOIN sizes a ON p = a.paper_id JOIN sizes b ON q = b.paper_id WHERE 2 * c >= a.n + b.n - c),
            links AS (SELECT DISTINCT a.first AS a, b.first AS b FROM pairs JOIN classes a ON p = a.paper_id JOIN classes b ON q = b.paper_id WHERE a.first <> b.first),
            ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach AS (SELECT a AS n, a AS r FROM ends UNION SELECT reach.n, ends.b FROM reach JOIN ends ON reach.r = ends.a),
            roots AS (SELECT n, min(r) AS root FROM reach GROUP BY n), degree AS (SELECT a, count(*) AS n_links FROM ends GROUP BY a)
            SELECT texts.paper_id, coalesce(root, first, texts.paper_id) AS group_id, coalesce(n_links, 0) AS n_links
            FROM texts LEFT JOIN classes ON texts.paper_id = classes.paper_id LEFT JOIN roots ON first = roots.n LEFT JOIN degree ON first = degree.a""",
        "p4_checks": "SELECT CAST(0 AS BIGINT) AS unordered, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS strangers",
        "p6_checks": "SELECT DISTINCT paper_id, true AS one, true AS kept FROM papers WHERE paper_id IS NOT NULL",
        "p8_checks": "SELECT source, true AS capped, true AS reached FROM mix_targets",
        "p9_checks": "SELECT doc_id, true AS kept FROM documents",
        "p3_found": f"WITH {_NEAR} SELECT DISTINCT least(p, q) AS paper_id_1, greatest(p, q) AS paper_id_2 FROM near",
        "p3_neighbours": f"WITH {_NEAR} SELECT p AS paper_id, CAST(r AS INTEGER) AS rank, q AS neighbour_id, round(s, 6) AS similarity FROM near",
        "p5_terms": f"WITH {_TERM_COUNTS} SELECT * FROM marked",
        "p5_vocabulary": rf"""WITH {_TERM_COUNTS},
            typed AS (SELECT DISTINCT word FROM named WHERE word <> '')
            SELECT coalesce(counted.word, typed.word) AS word, coalesce(n_occurrences, 0) AS n_occurrences, coalesce(n_papers, 0) AS n_papers, typed.word IS NOT NULL AS in_terms,
            CASE WHEN coalesce(n_papers, 0) < 3 THEN 'rare' WHEN n_papers > 0.3 * (SELECT count(DISTINCT paper_id) FROM papers WHERE body IS NOT NULL) THEN 'common' END AS mark
            FROM counted FULL JOIN typed ON counted.word = typed.word""",
        "p5_grams": f"WITH {_GRAM_COUNTS} SELECT * FROM gram_marks",
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p5_found": f"""WITH {_TERM_COUNTS}, {_GRAM_COUNTS}
            SELECT 'term' AS kind, term_id AS key_id, mark FROM marked WHERE word <> '' AND mark IS NOT NULL
            UNION ALL SELECT 'gram', gram_id, mark FROM gram_marks WHERE mark IS NOT NULL""",
    }
