"""Virtual slides: the relations of the tile engine, derived from the star-schema tables by portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Read alike by Spark and DuckDB; a view may name those before it.
VIEWS = {
    "v_slides": """
SELECT p_partkey AS slide_id,
       512 + (p_partkey * 7919) % 60000 AS width,
       512 + (p_partkey * 104729) % 60000 AS height,
       CAST(CASE p_size % 4 WHEN 0 THEN 240 WHEN 1 THEN 256 WHEN 2 THEN 512 ELSE 1024 END AS BIGINT) AS tile,
       CAST(CASE p_partkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 0 END AS DOUBLE) AS magnification,
       CAST(CASE p_partkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS mpp,
       CASE p_partkey % 8 WHEN 0 THEN 'jpeg2000' WHEN 1 THEN 'lzw' WHEN 2 THEN 'avif' WHEN 3 THEN 'webp'
            WHEN 4 THEN 'htj2k' ELSE 'jpeg' END AS compression,
       CASE p_size % 6 WHEN 0 THEN 'svs' WHEN 1 THEN 'generic-tiff' WHEN 2 THEN 'ome-tiff' WHEN 3 THEN 'cog-wsi'
            WHEN 4 THEN 'ndpi' ELSE 'dicom' END AS format,
       p_brand AS make, p_type AS model
FROM part""",
    "v_levels": """
SELECT slide_id, level,
       CASE WHEN slide_id % 10 = 9 THEN CAST(floor(w / pow(3, level)) AS BIGINT)
            WHEN slide_id % 2 = 0 THEN CAST(ceil(w / pow(2, octave)) AS BIGINT)
            ELSE CAST(floor(w / pow(2, octave)) AS BIGINT) END AS width,
       CASE WHEN slide_id % 10 = 9 THEN CAST(floor(h / pow(3, level)) AS BIGINT)
            WHEN slide_id % 2 = 0 THEN CAST(ceil(h / pow(2, octave)) AS BIGINT)
            ELSE CAST(floor(h / pow(2, octave)) AS BIGINT) END AS height,
       tile AS tile_w, tile AS tile_h, compression
FROM (SELECT s.slide_id, CAST(k.i AS BIGINT) AS level, s.width AS w, s.height AS h, s.tile, s.compression,
             CASE s.slide_id % 3 WHEN 0 THEN k.i WHEN 1 THEN 2 * k.i ELSE (CASE WHEN k.i = 0 THEN 0 ELSE k.i + 1 END) END AS octave
      FROM v_slides s JOIN (VALUES (0), (1), (2), (3)) AS k(i) ON k.i <= s.slide_id % 4) x""",
    "v_tile_events": """
SELECT l_suppkey % 16 AS slide_id, CAST(l_linenumber - 1 AS BIGINT) AS level,
       l_orderkey % CAST(pow(2, 7 - l_linenumber) AS BIGINT) AS col,
       l_partkey % CAST(pow(2, 7 - l_linenumber) AS BIGINT) AS row_,
       CAST(floor(l_extendedprice) AS BIGINT) % 60000 + 1 AS nbytes,
       CAST(pow(2, 7 - l_linenumber) AS BIGINT) AS grid
FROM lineitem""",
    "v_tiles": """
SELECT slide_id, level, col, row_, min(nbytes) AS nbytes, max(grid) AS grid
FROM v_tile_events GROUP BY slide_id, level, col, row_""",
    "v_rects": """
SELECT c_custkey AS rect_id, c_custkey % 16 AS slide_id, (c_custkey * 37) % 3000 AS x, (c_custkey * 91) % 3000 AS y,
       1 + (c_custkey * 53) % 900 AS w, 1 + (c_custkey * 29) % 900 AS h
FROM customer""",
    "v_associated": """
SELECT s.slide_id, a.type, CAST(a.w + s.slide_id % 50 AS BIGINT) AS width, CAST(a.h + s.slide_id % 40 AS BIGINT) AS height,
       a.comp AS compression, CAST(1000000 + a.ord * 1000 AS BIGINT) AS ifd_offset
FROM v_slides s JOIN (VALUES ('label', 387, 463, 'lzw', 1), ('macro', 1280, 431, 'jpeg', 2), ('thumbnail', 574, 768, 'jpeg', 3),
       ('map', 100, 100, 'none', 4)) AS a(type, w, h, comp, ord) ON (s.slide_id + a.ord) % 3 <> 0""",
    "v_ifds": """
SELECT slide_id, level AS ifd_index, width, height, compression, 8 + level * 1000 AS ifd_offset FROM v_levels
UNION ALL
SELECT slide_id, 100 + CAST(floor((ifd_offset - 1000000) / 1000) AS BIGINT) AS ifd_index,
       CASE WHEN slide_id % 7 = 0 THEN width + 1 ELSE width END AS width, height, compression, ifd_offset FROM v_associated""",
    "v_ranges": """
SELECT o_custkey % 50 AS file_id, o_orderkey AS range_id, (o_orderkey * 131) % 1000003 AS start_,
       (o_orderkey * 131) % 1000003 + 1 + CAST(floor(o_totalprice) AS BIGINT) % 900 AS end_, o_orderkey % 7 AS owner
FROM orders""",
    "v_octaves": """
SELECT l.slide_id, l.level, l.width, l.height, l.tile_w, z.width AS w0, z.height AS h0,
       CAST(floor(ln(CAST(z.width AS DOUBLE) / l.width) / ln(2.0) + 0.5) AS BIGINT) AS kw,
       CAST(floor(ln(CAST(z.height AS DOUBLE) / l.height) / ln(2.0) + 0.5) AS BIGINT) AS kh
FROM v_levels l JOIN v_levels z ON l.slide_id = z.slide_id AND z.level = 0""",
    # Rasters of 101 vectors each, the last of what is left; every second one lies on its side, so both sides may be odd.
    "v_rasters": """
SELECT CAST(floor(y / 101) AS BIGINT) AS slide_id,
       CASE WHEN CAST(floor(y / 101) AS BIGINT) % 2 = 1 THEN y % 101 ELSE x END AS x,
       CASE WHEN CAST(floor(y / 101) AS BIGINT) % 2 = 1 THEN x ELSE y % 101 END AS y, r, g, b
FROM v_pixels""",
    "v_raster_sizes": """
SELECT slide_id, max(x) + 1 AS width, max(y) + 1 AS height FROM v_rasters GROUP BY slide_id""",
}
PIXELS = {
    "spark": """
SELECT CAST(x AS BIGINT) AS x, vec_id AS y,
       CAST(pmod(floor(CAST(v AS DOUBLE) * 1000), 256) AS INT) AS r, CAST(pmod(floor(CAST(v AS DOUBLE) * 3000), 256) AS INT) AS g,
       CAST(pmod(floor(CAST(v AS DOUBLE) * 7000), 256) AS INT) AS b
FROM embeddings LATERAL VIEW posexplode(embedding) e AS x, v""",
    "duckdb": """
SELECT CAST(i - 1 AS BIGINT) AS x, vec_id AS y,
       CAST(((CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS r,
       CAST(((CAST(floor(CAST(v AS DOUBLE) * 3000) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS g,
       CAST(((CAST(floor(CAST(v AS DOUBLE) * 7000) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS b
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
}
TABLES = ("part", "lineitem", "embeddings", "documents", "events", "customer", "orders", "pages")
#: Side of a tile of v_tiles in pixels.
TILE = 64


def with_views(sql: str) -> str:
    """A query as DuckDB SQL: the views that it names come before it."""
    every = VIEWS | {"v_pixels": PIXELS["duckdb"]}
    need: list[str] = []

    def add(text: str) -> None:
        for name in every:
            if name not in need and name in text.replace(",", " ").replace("(", " ").replace(")", " ").split():
                add(every[name])
                need.append(name)

    add(sql)
    body = sql.strip()
    head = ",\n".join(f"{n} AS ({every[n].strip()})" for n in need)
    if not need:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


class Slides:
    """The relations of one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in TABLES:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = PIXELS["spark"] if name == "v_pixels" else VIEWS[name]
                words = text.replace(",", " ").split()
                used = [n for n in (*TABLES, *VIEWS, "v_pixels") if n in words and n != name]
                for n in sorted(used, key=len, reverse=True):
                    text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
                self.made[name] = self.spark.sql(text, **{n: self[n] for n in used if f"{{{n}}}" in text})
        return self.made[name]
