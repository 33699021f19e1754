"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import CLASS_SHARES, COMMON_WORDS, LISTED, SLOTS

#: Words of a text (fixed: the contract's white space).
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST(floor(CAST(('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS BIGINT), 5)) AS BIGINT) / pow(32, 3 - i % 4)) AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM g"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS v FROM documents),
     s AS (SELECT DISTINCT doc_id, CASE WHEN len(v) = 1 THEN v[1] ELSE v[i] || ' ' || v[i + 1] END AS g
           FROM (SELECT doc_id, v, unnest(generate_series(1, greatest(1, len(v) - 1))) AS i FROM w WHERE len(v) > 0) q),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
     u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
     r(doc, root) AS (SELECT x, x FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.doc WHERE r.root < u.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc, min(root) AS root FROM r GROUP BY doc) c ON c.doc = w.doc_id"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS v FROM documents),
     g AS (SELECT doc_id, i, array_to_string(v[i:i + 12], ' ') AS k FROM (SELECT doc_id, v, unnest(generate_series(1, len(v) - 12)) AS i FROM w WHERE len(v) >= 13) q),
     h AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM g) q WHERE least < doc_id),
     gone AS (SELECT DISTINCT doc_id, i + j AS i FROM h JOIN (SELECT unnest(generate_series(0, 12)) AS j) z ON true),
     t AS (SELECT doc_id, v[i] AS word, i FROM (SELECT doc_id, v, unnest(generate_series(1, len(v))) AS i FROM w) q),
     k AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i WHERE gone.i IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(v) AS BIGINT) AS n_words, CAST(len(v) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def count_of(pattern: str, text: str = "t") -> str:
    return f"CAST(length(regexp_replace({text}, '{pattern}', '', 'g')) AS BIGINT)"


def tongue_of(values: dict, other: object) -> str:
    return "(CASE tongue " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END)"


def hits() -> str:
    """The numbers of words that are each of the tongue's common words."""
    lists = tongue_of({k: str([*v]) for k, v in COMMON_WORDS.items()}, "[]")
    return f"list_transform({lists}, lambda c: len(list_filter(v, lambda x: x = c))) AS hits"


def js(pairs: list[tuple[str, str]]) -> str:
    parts = []
    for p, q in pairs:
        m = f"(({p} + {q}) / 2)"
        parts += [f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END)", f"(CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"]
    return f"sqrt(greatest(0, ({' + '.join(parts)}) / 2))"


def class_pairs() -> list[tuple[str, str]]:
    held = {k: k for k in SLOTS} | {k: f"(CASE WHEN tongue = 'other' THEN 0 ELSE {k} END)" for k in ("upper", "wide")}
    held["lower"] = "(CASE WHEN tongue = 'other' THEN lower + upper + wide ELSE lower END)"
    return [(f"(CAST({held[k]} AS DOUBLE) / word_chars)", f"CAST({tongue_of({t: v[k] / 10_000 for t, v in CLASS_SHARES.items()}, 0)} AS DOUBLE)") for k in SLOTS]


def word_pairs() -> list[tuple[str, str]]:
    pairs = [(f"(CAST(hits[{i + 1}] AS DOUBLE) / n_words)", f"CAST({tongue_of({t: [*v.values()][i] / 10_000 for t, v in COMMON_WORDS.items()}, 0)} AS DOUBLE)") for i in range(LISTED)]
    left = tongue_of({t: (10_000 - sum(v.values())) / 10_000 for t, v in COMMON_WORDS.items()}, 1)
    return [*pairs, ("(CAST(n_words - list_sum(hits) AS DOUBLE) / n_words)", f"CAST({left} AS DOUBLE)")]


QUALITY = rf"""
WITH b AS (SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS tongue, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS v FROM documents),
     o AS (SELECT *, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS odd_text, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM b),
     d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, array_to_string(v[i:i + 4], ' ') AS k FROM (SELECT doc_id, v, unnest(generate_series(1, len(v) - 4)) AS i FROM b WHERE len(v) >= 5) q) z),
     c AS (SELECT doc_id, CAST(count(DISTINCT i + j) AS BIGINT) AS n FROM d JOIN (SELECT unnest(generate_series(0, 4)) AS j) z ON d.n > 1 GROUP BY doc_id),
     f AS (SELECT o.doc_id, tongue, CAST(len(v) AS BIGINT) AS n_words, {count_of(r"[\x20\x09-\x0D]+")} AS word_chars, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                  length(odd_text) AS odd, {count_of("[^A-Z]+", "odd_text")} AS upper, {count_of("[^0-9]+", "odd_text")} AS digit, {count_of("[^#*$%&|<>]+", "odd_text")} AS symbol, {count_of(r"[\x00-\x7F]+", "odd_text")} AS wide, {hits()}
           FROM o LEFT JOIN c ON c.doc_id = o.doc_id),
     s AS (SELECT *, word_chars - odd AS lower, odd - upper - digit - symbol - wide AS mark, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
     j AS (SELECT *, CASE WHEN word_chars >= 300 THEN {js(class_pairs())} END AS class_js, CASE WHEN n_words >= 100 AND tongue <> 'other' THEN {js(word_pairs())} END AS word_js FROM s)
SELECT doc_id, n_words, word_chars, symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(class_js, 0) <= 0.25 AND coalesce(word_js, 0) <= 0.31 AS kept,
       round(class_js, 6) AS class_js, round(word_js, 6) AS word_js
FROM j"""

MIXING = f"""
WITH s AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
     t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
     p AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM t),
     o AS (SELECT *, 2.0 * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM p),
     c AS (SELECT *, coalesce(sum(2.0 * source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
           FROM o WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f AS (SELECT *, CAST(1.5 * whole - capped AS DOUBLE) AS rest FROM c),
     x AS (SELECT min(ratio) AS ratio FROM f WHERE rest / open_weight <= ratio),
     y AS (SELECT rest, open_weight FROM f WHERE ratio = (SELECT ratio FROM x) ORDER BY capped LIMIT 1),
     g AS (SELECT p.source, p.source_size, CASE WHEN 2.0 * p.source_size / p.weight < (SELECT ratio FROM x) THEN CAST(2.0 * p.source_size AS DOUBLE) ELSE p.weight * (SELECT rest FROM y) / (SELECT open_weight FROM y) END AS target FROM p),
     z AS (SELECT s.doc_id, s.size, g.source_size, g.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before,
                  CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS epochs
           FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM z"""

#: CRC-32 as a fold over bytes, with the table of the reflected polynomial made by its rule.
SHARDING = """
WITH y AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_of FROM (SELECT unnest(generate_series(0, 255)) AS i) q),
     e AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS octets FROM documents),
     s AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                  xor(list_reduce(list_concat([4294967295], octets), lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32 FROM e, y),
     f AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM s),
     p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, k, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM f),
     q AS (SELECT *, CAST(floor(n / 16) AS BIGINT) AS small, n % 16 AS large FROM p),
     d AS (SELECT *, CASE WHEN place < large * (small + 1) THEN CAST(floor(place / (small + 1)) AS BIGINT) ELSE large + CAST(floor((place - large * (small + 1)) / greatest(1, small)) AS BIGINT) END AS shard_ FROM q)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard_ AS INTEGER) AS shard, CASE WHEN shard_ < large THEN place - shard_ * (small + 1) ELSE place - large * (small + 1) - (shard_ - large) * small END AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d"""

ORACLES = {"op2_warc": WARC, "op3_near_duplicates": NEAR, "op4_substring_dedup": SUBSTRING, "op5_quality_rules": QUALITY, "op9_mixing": MIXING, "op10_sharding": SHARDING}
