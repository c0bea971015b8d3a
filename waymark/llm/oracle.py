"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from waymark.llm.licenses import PHRASES, TEMPLATES

_OP3 = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, line, pos, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""



def _op5() -> str:
    """Templates against the words around each of their first words."""
    listed = [(label, sorted(set(text.split())), len(text.split())) for label, texts in TEMPLATES.items() for text in texts]
    rows = ", ".join(
        f"({n}, '{label}', [{', '.join(repr(w) for w in words)}], {math.ceil(0.8 * len(words) - 1e-9)}, {reach})"
        for n, (label, words, reach) in enumerate(listed)
    )
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, pos FROM numbered WHERE "
        + " AND ".join(f"w[pos + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), numbered AS (
  SELECT doc_id, w, unnest(range(len(w))) AS pos FROM docs
), base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS low, max(pos) AS high, list(label) AS labels FROM ({places}) GROUP BY doc_id
), templates AS (
  SELECT * FROM (VALUES {rows}) t(template, label, words, need, reach)
), used AS (
  SELECT DISTINCT unnest(words) AS word FROM templates
), held AS (
  SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, w[pos + 1] AS word FROM numbered) JOIN used USING (word) GROUP BY word
), ordered AS (
  SELECT word, row_number() OVER (ORDER BY coalesce(n, 0), word) AS place FROM used LEFT JOIN held USING (word)
), prefixes AS (
  SELECT t.*, word FROM (SELECT *, unnest(words) AS word FROM templates) t JOIN ordered USING (word)
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY place) <= len(words) - need + 1
), around AS (
  SELECT doc_id, p.label, words, need, len(list_intersect(words, w[greatest(pos + 1 - reach, 1):pos + 1 + reach])) AS common
  FROM numbered n JOIN prefixes p ON p.word = n.w[n.pos + 1]
), found AS (
  SELECT doc_id, list(label) AS labels, max(common / len(words)) AS most FROM around WHERE common >= need GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, low AS first_word, high AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  greatest(CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(most, 0)::DOUBLE) AS score
FROM docs LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def _op12(rounds: int = 10) -> str:
    """All rounds as one chain of tables; a centroid is a list of integers."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    chain = [
        """kept AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(v::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x AS c FROM kept
  ORDER BY sha256('3:' || vec_id) LIMIT 8
)""",
    ]
    for turn in range(rounds + 1):
        chain.append(
            f"""a{turn} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, (d, k)) AS k
  FROM (SELECT vec_id, x, k, {distance} AS d FROM kept, c{turn}) GROUP BY vec_id
)"""
        )
        chain.append(
            f"""c{turn + 1} AS MATERIALIZED (
  SELECT k, coalesce(any_value(m), any_value(c)) AS c FROM c{turn} LEFT JOIN (
    SELECT k, list(m ORDER BY i) AS m FROM (
      SELECT k, i, floor_div AS m FROM (
        SELECT k, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
        FROM (SELECT k, unnest(x) AS v, unnest(range(64)) AS i FROM a{turn}) GROUP BY k, i)
    ) GROUP BY k
  ) USING (k) GROUP BY k
)"""
        )
    return f"""WITH {", ".join(chain)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


def _op13() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS words, list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {n - 2})) AS i FROM pieces WHERE len(w) >= {n})"
        for n in range(1, 6)
    )
    return rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?

]')) AS piece
    FROM documents)
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= 100
), spaced AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE words > 1
), outer_ones AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:words - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase
    FROM spaced WHERE words > 2) GROUP BY ALL
), grams AS (
  SELECT s.* FROM spaced s LEFT JOIN outer_ones o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.f IS NULL OR o.f < s.f
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM grams)
), scored AS (
  SELECT c.lang, c.phrase, a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
  JOIN sizes z ON z.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


ORACLES: dict[str, str] = {"op3_line_dedup": _OP3, "op5_license_scan": _op5(), "op12_centroids": _op12(), "op13_collocations": _op13()}
