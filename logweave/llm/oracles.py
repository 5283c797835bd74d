"""What SQL can say of the corpus operators: the same rows by plain statements, one string for each query."""

from __future__ import annotations

#: Words of op12 and op13: A-Z in lower case, everything else of ASCII but a-z and 0-9 parts words.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT {WORDS} AS w FROM benchmark),
f AS (SELECT feature, sum(s) AS s, sum(t) AS t FROM (SELECT unnest(w) AS feature, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY feature),
x AS (SELECT *, hex(encode(feature)) AS hex FROM f),
-- crc32 bit by bit: a byte is mixed in, then eight steps
c AS (SELECT feature, s, t, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(0, length(hex) // 2), lambda i: [('0x' || substr(hex, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 10000 AS bucket FROM x),
g AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c GROUP BY bucket),
r AS (SELECT doc_id, w, row_number() OVER () AS row FROM d),
u AS (SELECT row, unnest(w) AS feature FROM r),
m AS (SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN c USING (feature) JOIN g USING (bucket) GROUP BY row),
e AS (SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r LEFT JOIN m USING (row)),
k AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM e LEFT JOIN k USING (row)"""


def _words(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def op12(templates: list, slack: int, least: float) -> str:
    """The scan by joins of words and templates, without an index."""
    notices = ", ".join(f"({k}, '{t.label}', {str(t.base).upper()}, {_words(t.words)})" for k, t in enumerate(templates))
    phrases = ", ".join(f"({k}, {n}, {at}, {_words(ws)})" for k, t in enumerate(templates) for n, (at, ws) in enumerate(t.phrases))
    return f"""
WITH t(k, label, base, notice) AS (VALUES {notices}), ph(k, n, spot, phrase) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
u AS (SELECT row, w, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
v AS (SELECT DISTINCT unnest(notice) AS word FROM t),
i AS (SELECT v.word, floor(1000 * ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (count(DISTINCT row) + 1)))::BIGINT + 1 AS weight FROM v LEFT JOIN u USING (word) GROUP BY v.word),
lead AS (SELECT row, w, k, p, p - spot AS start FROM u JOIN ph ON n = 0 AND word = phrase[1] AND w[p + 1:p + len(phrase)] = phrase),
part AS (SELECT k, unnest(notice) AS word, unnest(range(0, len(notice))) AS j FROM t),
share AS (SELECT row, k, p, any_value(w) AS w, any_value(start) AS start, sum(CASE WHEN start + j + {slack} >= 0 AND list_contains(w[greatest(start + j - {slack}, 0) + 1:start + j + {slack} + 1], word) THEN weight ELSE 0 END)::DOUBLE / sum(weight)::DOUBLE AS share
  FROM lead JOIN part USING (k) JOIN i USING (word) GROUP BY row, k, p),
missed AS (SELECT DISTINCT s.row, s.k, s.p FROM share s JOIN ph ON ph.k = s.k AND n > 0
  WHERE len(list_filter(range(-{slack}, {slack + 1}), lambda o: start + spot + o >= 0 AND w[start + spot + o + 1:start + spot + o + len(phrase)] = phrase)) = 0),
f AS (SELECT s.row, s.p, s.share, t.label, t.base, t.base OR (s.share >= {least} AND m.row IS NULL) AS holds FROM share s JOIN t USING (k) LEFT JOIN missed m ON m.row = s.row AND m.k = s.k AND m.p = s.p),
g AS (SELECT row, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word, max(share) AS score,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds) AS labels FROM f GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN g USING (row)"""


def op11(rounds: int, clusters: int, seed: int) -> str:
    """All distances in every round; sums and floors in integers."""
    said = [
        f"""WITH k AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM k QUALIFY cluster < {clusters})"""
    ]
    for i in range(rounds + 1):
        said.append(
            f"""a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': cluster}}) AS best
  FROM (SELECT k.*, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, c{i}) GROUP BY row)"""
        )
        if i < rounds:
            said.append(
                f"""m{i} AS (SELECT cluster, place, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT best.c AS cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place),
c{i + 1} AS (SELECT cluster, coalesce(any_value(new), any_value(c)) AS c FROM c{i} LEFT JOIN
  (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS new FROM m{i} GROUP BY cluster) USING (cluster) GROUP BY cluster)"""
            )
    return ",\n".join(said) + f"""
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON cluster = best.c"""
