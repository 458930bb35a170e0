"""SQL for DuckDB that gives the rows of the registered queries 11 to 13."""

from __future__ import annotations

from .merkle import FANOUT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 (polynomial 0xEDB88320) of a list of bytes.
_CRC_MACROS = """
crc_bytes AS (
    SELECT list(list_reduce(list_prepend(b, range(0, 8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) AS t
    FROM range(0, 256) AS r(b)
)"""


def _crc(codes: str) -> str:
    """CRC-32 of the list of byte values ``codes``, with ``crc_bytes`` in scope as ``t``."""
    step = "xor(t[(xor(c, x) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {step}), 4294967295)"


def _bytes(text: str) -> str:
    """UTF-8 byte values of a string of characters below U+0800."""
    return (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] "
        "ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] END))"
    )


def merkle_sql(levels: int = 8) -> str:
    """Trees of up to FANOUT ** levels leaves, and as many languages."""
    fields = ["doc_id", "source", "lang", "n_chars"]

    def leaf(text: str) -> str:
        framed = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in [*fields, text]]
        return f"sha256({' || '.join(framed)})"

    parts = [
        _CRC_MACROS.strip(),
        f"""d AS (
    SELECT doc_id, lang, {leaf("text")} AS leaf,
           CASE WHEN {_crc(_bytes("doc_id::VARCHAR"))} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")}
                ELSE {leaf("text")} END AS audited
    FROM documents, crc_bytes
)""",
        """a0 AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d
)""",
        "la0 AS (SELECT lang AS g, place AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM a0)",
    ]

    def tree(name: str) -> None:
        for s in range(levels):
            parts.append(
                f"""{name}{s + 1} AS (
    SELECT g, i // {FANOUT} AS i, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
           (n + {FANOUT - 1}) // {FANOUT} AS n
    FROM {name}{s} GROUP BY g, i // {FANOUT}, n
)"""
            )

    def climb(level: str, below: str, above: str, size: int) -> None:
        """Adds to each row its siblings on a level, and folds them."""
        parts.append(
            f"""{above} AS (
    SELECT r.doc_id, r.lang, r.leaf, r.audited, r.place, r.top, r.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof,
           CASE WHEN s.n > 1 THEN sha256(coalesce(s.l, '') || r.folded || coalesce(s.r, '')) ELSE r.folded END AS folded
    FROM {below} r JOIN (
        SELECT x.g, x.i, x.n, string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i) AS l,
               string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i) AS r
        FROM {level} x JOIN {level} y ON x.g IS NOT DISTINCT FROM y.g AND x.i // {FANOUT} = y.i // {FANOUT}
        GROUP BY x.g, x.i, x.n
    ) s ON {"r.lang IS NOT DISTINCT FROM s.g AND " if level.startswith("la") else ""}s.i = {"r.place" if level.startswith("la") else "r.top"} // {size}
)"""
        )

    tree("la")
    parts.append(
        f"""lb0 AS (
    SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, g AS lang FROM la{levels}
)"""
    )
    tree("lb")
    parts.append(
        """p0 AS (
    SELECT a0.doc_id, a0.lang, leaf, audited, place, lb0.i AS top, '' AS proof, audited AS folded
    FROM a0 JOIN lb0 ON a0.lang IS NOT DISTINCT FROM lb0.lang
)"""
    )
    for s in range(levels):
        climb(f"la{s}", f"p{s}", f"p{s + 1}", FANOUT**s)
    for s in range(levels):
        climb(f"lb{s}", f"p{levels + s}", f"p{levels + s + 1}", FANOUT**s)
    # From here on each row is joined with its language's root and the root of all.
    return f"""WITH {", ".join(f"{p.split(' AS ', 1)[0]} AS MATERIALIZED {p.split(' AS ', 1)[1]}" for p in parts)}
SELECT p.doc_id, p.leaf, b.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root,
       p.folded = r.h AS verified
FROM p{2 * levels} p JOIN lb0 b ON p.top = b.i, lb{levels} r"""


TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e, len(embedding) AS size
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.size = c.size WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

VARIANTS = rf"""
WITH RECURSIVE {_CRC_MACROS.strip()}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w
    FROM documents WHERE text IS NOT NULL
), once AS (
    SELECT doc_id, w, count(*) AS n FROM runs GROUP BY doc_id, w
), hashed AS (
    SELECT w, n, {_crc(_bytes("doc_id::VARCHAR || ':' || w"))} AS h FROM once, crc_bytes
), slipped AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
    FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), near AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM pairs GROUP BY word
), forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * w.n THEN other END AS form,
           CASE WHEN most >= 2 * w.n THEN most END AS form_n
    FROM words w LEFT JOIN near ON w.word = near.word
), steps AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s ON f.word = s.word JOIN forms e ON s.root = e.word WHERE e.form IS NULL
"""
