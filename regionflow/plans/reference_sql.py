"""SQL restatement of the derived tables, shared by the checking queries."""

from __future__ import annotations

from regionflow.plans import fixtures as X

BIG = X.BIG
CTES = {
    "det": f"SELECT {', '.join(X.DET)} FROM lineitem",
    "page_dim": "SELECT DISTINCT doc_id, page_idx, CAST(900 AS BIGINT) AS width, "
                "CAST(1280 AS BIGINT) AS height FROM det",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, label
        ORDER BY floor(y1 / 100.0), x1 DESC, det_idx) - 1 AS bubble_idx
        FROM det WHERE score > 0.5 AND label IN (1, 2)""",
    "regions": """SELECT doc_id, page_idx, label AS level, bubble_idx, det_idx, score, x1, y1, x2, y2,
        least(5, x1) AS pad_l, least(5, y1) AS pad_t,
        least(900, x2 + 5) - (x1 - least(5, x1)) AS crop_w,
        least(1280, y2 + 5) - (y1 - least(5, y1)) AS crop_h FROM numbered""",
    "cells": f"""SELECT *, gx1 + crop_w AS gx2, gy1 + crop_h AS gy2 FROM (
        SELECT doc_id, page_idx AS batch_idx, page_idx * {BIG} + bubble_idx AS cell_idx,
        page_idx, bubble_idx, 30 + (bubble_idx % 3) * 260 AS gx1,
        30 + CAST(floor(bubble_idx / 3) AS BIGINT) * 260 AS gy1, crop_w, crop_h,
        x1 AS bx1, y1 AS by1, pad_l, pad_t FROM regions WHERE level = 1)""",
    "lines": f"SELECT {', '.join(X.LINES)} FROM lineitem",
    "screened": """SELECT * REPLACE (t AS text), CASE
        WHEN t = '' OR t IN ('ノ', 'ー', '一', '|') THEN 'skipped_empty'
        WHEN NOT regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}\\x{ff65}-\\x{ff9f}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}]')
        THEN 'skipped_no_script' END AS skipped
        FROM (SELECT *, trim(text, ' 　') AS t FROM lines)""",
    "direct": """SELECT s.*, c.cell_idx AS hit, c.page_idx, c.bubble_idx, c.gx1, c.gy1, c.gx2, c.gy2,
        c.bx1, c.by1, c.pad_l, c.pad_t,
        CASE WHEN skipped IS NOT NULL THEN skipped WHEN c.cell_idx IS NOT NULL THEN 'matched_cell_idx'
        WHEN x IS NULL THEN 'skipped_no_bbox' END AS outcome
        FROM screened s LEFT JOIN cells c ON s.doc_id = c.doc_id AND s.cell_idx = c.cell_idx
        AND s.skipped IS NULL""",
    "open_lines": """SELECT doc_id, src_page, line_no, batch_idx, text, x, y, width, height,
        x + width AS x2, y + height AS y2, (x + (x + width)) / 2 AS cx, (y + (y + height)) / 2 AS cy
        FROM direct WHERE outcome IS NULL""",
    "pairs": """SELECT l.*, c.cell_idx, c.page_idx, c.bubble_idx, c.gx1, c.gy1, c.gx2, c.gy2, c.bx1, c.by1,
        c.pad_l, c.pad_t,
        greatest(0, least(l.x2, c.gx2) - greatest(l.x, c.gx1))
        * greatest(0, least(l.y2, c.gy2) - greatest(l.y, c.gy1)) AS overlap,
        cx BETWEEN gx1 - 15 AND gx2 + 15 AND cy BETWEEN gy1 - 15 AND gy2 + 15 AS centre_in,
        x BETWEEN gx1 - 15 AND gx2 + 15 AND y BETWEEN gy1 - 15 AND gy2 + 15 AS corner_in
        FROM open_lines l JOIN cells c ON l.doc_id = c.doc_id
        AND (l.batch_idx IS NULL OR l.batch_idx = c.batch_idx)""",
    "spatial": """SELECT * FROM (SELECT *, CASE WHEN centre_in THEN 1 WHEN corner_in THEN 2 ELSE 3 END AS rule
        FROM pairs WHERE centre_in OR corner_in OR overlap > 0)
        QUALIFY row_number() OVER (PARTITION BY doc_id, src_page, line_no
        ORDER BY rule, CASE WHEN rule = 3 THEN -overlap ELSE 0 END, cell_idx) = 1""",
    "mapped": """SELECT doc_id, src_page, line_no, text, outcome, page_idx, bubble_idx,
        CASE WHEN outcome = 'matched_cell_idx' THEN bx1 END AS px1,
        CASE WHEN outcome = 'matched_cell_idx' THEN by1 END AS py1,
        CASE WHEN outcome = 'matched_cell_idx' THEN bx1 + gx2 - gx1 END AS px2,
        CASE WHEN outcome = 'matched_cell_idx' THEN by1 + gy2 - gy1 END AS py2
        FROM direct WHERE outcome IS NOT NULL
        UNION ALL
        SELECT l.doc_id, l.src_page, l.line_no, l.text,
        CASE WHEN s.cell_idx IS NULL THEN 'unmatched' ELSE 'matched_bbox' END,
        s.page_idx, s.bubble_idx,
        CAST(trunc(s.x - gx1 + bx1 - pad_l) AS BIGINT), CAST(trunc(s.y - gy1 + by1 - pad_t) AS BIGINT),
        CAST(trunc(s.x - gx1 + bx1 - pad_l + s.width) AS BIGINT),
        CAST(trunc(s.y - gy1 + by1 - pad_t + s.height) AS BIGINT)
        FROM open_lines l LEFT JOIN spatial s USING (doc_id, src_page, line_no)""",
    "texts": f"SELECT {', '.join(X.TEXTS)} FROM lineitem",
    "collected": """SELECT doc_id, page_idx, level, bubble_idx,
        string_agg(text, '' ORDER BY line_no) AS original_text, count(*) AS n,
        string_agg(text || '@' || x1 || ',' || y1 || ',' || x2 || ',' || y2, ';' ORDER BY line_no) AS parts,
        CAST(sum(CASE WHEN x2 > x1 AND y2 > y1 THEN (x2 - x1) * (y2 - y1) ELSE 0 END) AS BIGINT) AS text_area,
        string_agg(trim(text, ' 　'), '' ORDER BY line_no) AS joined,
        string_agg(CASE WHEN trim(text, ' 　') <> '' THEN trim(text, ' 　') END, chr(10) ORDER BY line_no) AS listed
        FROM texts GROUP BY ALL""",
    "ratio": """SELECT *, length(regexp_replace(original_text, '[^\\x{4e00}-\\x{9fff}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{ff66}-\\x{ff9f}]', '', 'g')) AS cjk,
        length(regexp_replace(original_text, '[^A-Za-z0-9\\x{80}-\\x{10ffff}]', '', 'g')) AS meaning
        FROM collected""",
    "merged": """SELECT c.*, r.x1, r.y1, r.x2, r.y2, coalesce(CASE
        WHEN text_area < (r.x2 - r.x1) * (r.y2 - r.y1) * 0.7 AND (r.x2 - r.x1) * (r.y2 - r.y1) > 0
        THEN listed ELSE joined END, '') AS merged
        FROM ratio c JOIN regions r USING (doc_id, page_idx, level, bubble_idx)
        WHERE meaning > 0 AND CAST(cjk AS DOUBLE) / meaning >= 0.2""",
    "jobs": f"SELECT {', '.join(X.JOBS)} FROM conversations",
    "ordered_jobs": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY is_l2, page_idx, bubble_idx) - 1 AS seq
        FROM jobs WHERE text <> ''""",
    "stubbed": """SELECT *, CASE WHEN (page_idx * 7 + bubble_idx) % 10 = 0 THEN '[TRANSLATION FAILED]'
        WHEN (page_idx * 7 + bubble_idx) % 10 = 1 THEN '[NO TEXT]'
        WHEN (page_idx * 7 + bubble_idx) % 10 = 2 THEN '' ELSE 'T:' || text END AS translated FROM ordered_jobs""",
    "turns": """SELECT conv_id, CAST(floor(place / 4) AS BIGINT) AS block, place % 4 AS idx, turn, text, (conv_id + place) % 5 <> 0 AS told FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations)""",
    "blocks": """SELECT conv_id, block, max(idx) + 1 AS expected, count(*) FILTER (told) AS n_told
        FROM turns GROUP BY conv_id, block""",
    "infos": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1 AS global_idx
        FROM (SELECT {', '.join(X.REGION_INFOS)} FROM events)""",
    "cut": """SELECT *, CAST(floor(before / 25) AS BIGINT) AS batch_idx, before % 25 AS text_idx FROM (
        SELECT *, CAST(coalesce(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY global_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM infos)""",
    "raster": f"""SELECT CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id, page_id % 10 AS page_idx,
        CAST(floor(i / 64.0) AS BIGINT) AS y, i % 64 AS x, {', '.join(X.PIXEL)} FROM (
        SELECT page_id, i, CAST(unicode(ch) AS BIGINT) AS code FROM (
        SELECT page_id, unnest(l) AS ch, unnest(range(len(l))) AS i FROM (
        SELECT page_id, regexp_extract_all(html, '(?s).') AS l FROM pages)))""",
    "px_regions": f"""SELECT CAST(floor(page_id / 10.0) AS BIGINT) AS doc_id, page_id % 10 AS page_idx,
        k AS region_id, {', '.join(X.PIXEL_REGION)}, CAST(64 AS BIGINT) AS width, height FROM (
        SELECT page_id, CAST(ceil(length(html) / 64.0) AS BIGINT) AS height,
        unnest(range(CAST(floor(length(html) / 512.0) AS BIGINT) + 1)) AS k FROM pages)""",
    "clipped": """SELECT doc_id, page_idx, region_id, greatest(0, x1) AS x1, greatest(0, y1) AS y1,
        least(width, x2) AS x2, least(height, y2) AS y2 FROM px_regions""",
    "inside": """SELECT c.*, p.y, p.x, p.r, p.g, p.b, p.m,
        (p.y = c.y1)::INT + (p.y = c.y2 - 1)::INT + (p.x = c.x1)::INT + (p.x = c.x2 - 1)::INT AS edge
        FROM clipped c JOIN raster p ON p.doc_id = c.doc_id AND p.page_idx = c.page_idx
        AND p.x >= c.x1 AND p.x < c.x2 AND p.y >= c.y1 AND p.y < c.y2""",
    "doc_lines": """SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN translate(line, 'aeiou', 'アエイオウ')
        WHEN doc_id % 3 = 1 THEN concat(translate(substring(line, 1, CAST(floor(length(line) / 2) AS INT)), 'aeiou', 'アエイオウ'),
        substring(line, CAST(floor(length(line) / 2) AS INT) + 1)) ELSE line END AS text FROM (
        SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM (
        SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
}

_NEEDS = {
    "page_dim": ["det"], "numbered": ["det"], "regions": ["numbered"], "cells": ["regions"],
    "screened": ["lines"], "direct": ["screened", "cells"], "open_lines": ["direct"],
    "pairs": ["open_lines", "cells"], "spatial": ["pairs"], "mapped": ["direct", "open_lines", "spatial"],
    "collected": ["texts"], "ratio": ["collected"], "merged": ["ratio", "regions"],
    "ordered_jobs": ["jobs"], "stubbed": ["ordered_jobs"], "blocks": ["turns"], "cut": ["infos"],
    "clipped": ["px_regions"], "inside": ["clipped", "raster"],
    "line_texts": ["mapped"], "line_collected": ["line_texts"], "line_ratio": ["line_collected"],
    "line_merged": ["line_ratio", "regions"],
}


def sql(body: str, *ctes: str) -> str:
    """``body`` preceded by the named derived tables and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in ctes:
        need(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head} {body}" if order else body
