"""DuckDB SQL of the corpus queries whose results a contract fixes; stated plainly, for tables of the correctness check's size."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: crc32 of the decimal id: eight shifts a digit, bit by bit.
_CRC = """crc_step(doc_id, digits, i, crc) AS (
    SELECT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, digits, i + 1, CASE WHEN shifted % 2 = 1 THEN xor(shifted // 2, CAST(3988292384 AS BIGINT)) ELSE shifted // 2 END
    FROM (SELECT doc_id, digits, i, CASE WHEN i % 8 = 0 THEN xor(crc, CAST(ascii(substr(digits, CAST(i // 8 + 1 AS INTEGER), 1)) AS BIGINT)) ELSE crc END AS shifted
          FROM crc_step WHERE i < 8 * length(digits))),
crc AS (SELECT doc_id, xor(crc, CAST(4294967295 AS BIGINT)) AS h FROM crc_step WHERE i = 8 * length(digits))"""

OP1 = f"""
WITH doc AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS i, w FROM doc),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM word WHERE i + 12 <= len(w)),
first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT doc_id, i FROM win JOIN first USING (s) WHERE least < doc_id),
mark AS (SELECT word.doc_id, word.i, word, max(CASE WHEN gone.i IS NULL THEN 0 ELSE 1 END)
             OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS out
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i),
kept AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(out) AS BIGINT) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (WHERE out = 0) AS text FROM mark GROUP BY doc_id)
SELECT doc.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)"""

OP2 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN size m ON m.doc_id = a JOIN size n ON n.doc_id = b WHERE 100 * c >= 85 * (m.n + n.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, min(reach.other) AS component_id
FROM doc JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY doc.doc_id, size.n"""

OP11 = """
WITH part AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT vec_id FROM part WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM part WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
         FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pair) WHERE r <= 10"""

OP12 = f"""
WITH RECURSIVE {_CRC},
doc AS (SELECT d.doc_id, {_WORDS.format("coalesce(text, '')")} AS w, h, h // 10 AS g FROM documents d LEFT JOIN crc USING (doc_id)),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM doc),
rule AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM cut),
word AS (SELECT doc_id, len(w) AS n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
         FROM (SELECT *, unnest(range(0, len(w))) AS i FROM rule)),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM word x JOIN word y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i
         WHERE 3 * (y.i - x.i) <= x.n),
streak AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS base FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM streak GROUP BY doc_id, q, base HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, s, n, min(q) AS q FROM stretch GROUP BY doc_id, s, n),
best AS (SELECT doc_id, s, n, q FROM run x WHERE NOT EXISTS (
             SELECT 1 FROM run y WHERE y.doc_id = x.doc_id AND (y.n * x.q > x.n * y.q OR y.n * x.q = x.n * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word
         WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.doc_id = word.doc_id AND word.i >= run.s + run.q AND word.i < run.s + run.n) GROUP BY doc_id)
SELECT doc.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _merkle(levels: int = 8) -> str:
    """``levels`` of each tree are written out, enough for 8 ** levels rows of one language."""
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = f"CASE WHEN h % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    leaf = lambda text: "sha256(" + " || ".join([*fields, _field(text)]) + ")"
    parts = [_CRC, f"""raw AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(f'({lowered})')} AS claimed FROM documents LEFT JOIN crc USING (doc_id)),
tree AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) AS n FROM raw GROUP BY lang),
l0 AS (SELECT j, n, row_number() OVER (PARTITION BY j ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, doc_id, leaf AS d, claimed
       FROM raw JOIN tree ON raw.lang IS NOT DISTINCT FROM tree.lang)"""]
    up = """{up} AS (SELECT j, (max(n) + 7) // 8 AS n, pos // 8 AS pos, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
    FROM {now} GROUP BY j, pos // 8)"""
    step = """{out} AS (SELECT c.doc_id, c.j, c.pos // 8 AS pos, c.leaf,
        CASE WHEN max(s.n) = 1 THEN max(c.f) ELSE sha256(string_agg(CASE WHEN s.pos = c.pos THEN c.f ELSE s.d END, '' ORDER BY s.pos)) END AS f,
        c.proof || coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (WHERE s.pos <> c.pos), '') AS proof
    FROM {climb} c JOIN {now} s ON s.j = c.j AND s.pos // 8 = c.pos // 8 GROUP BY c.doc_id, c.j, c.pos, c.leaf, c.proof)"""
    parts.append("c0 AS (SELECT doc_id, j, pos, d AS leaf, claimed AS f, '' AS proof FROM l0)")
    for i in range(levels):
        parts += [up.format(up=f"l{i + 1}", now=f"l{i}"), step.format(out=f"c{i + 1}", climb=f"c{i}", now=f"l{i}")]
    parts.append(f"""t0 AS (SELECT 0 AS j, count(*) OVER () AS n, j AS pos, d FROM l{levels}),
k0 AS (SELECT doc_id, 0 AS j, j AS pos, leaf, f, proof FROM c{levels})""")
    for i in range(levels):
        parts += [up.format(up=f"t{i + 1}", now=f"t{i}"), step.format(out=f"k{i + 1}", climb=f"k{i}", now=f"t{i}")]
    return f"""WITH RECURSIVE {', '.join(parts)}
SELECT k.doc_id, k.leaf, s.d AS subroot, t.d AS root, sha256(k.proof) AS proof_sha256, k.f AS folded_root, k.f = t.d AS verified
FROM k{levels} k JOIN l0 ON l0.doc_id IS NOT DISTINCT FROM k.doc_id AND l0.d = k.leaf JOIN l{levels} s ON s.j = l0.j, t{levels} t"""


OP13 = _merkle()
