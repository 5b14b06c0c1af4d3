"""The queries of this subpackage and the SQL which checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .encoding import op6_bpe
from .fingerprints import op1_fingerprints
from .langid import op4_langid
from .language_model import op2_lm
from .lines import op13_lines
from .media import op7_media
from .neardup import op8_neardup
from .packing import op9_packing
from .pages import op3_pages
from .quality import op5_quality
from .repeats import op10_repeats
from .turns import op11_turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_lm": op2_lm,
    "op3_pages": op3_pages,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_neardup": op8_neardup,
    "op9_packing": op9_packing,
    "op10_repeats": op10_repeats,
    "op11_turns": op11_turns,
    "op12_alignment": op12_alignment,
    "op13_lines": op13_lines,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"
# What a row may become, by the state before it: (letter, cost, state after, text put in).
_STEP = ", ".join(
    f"list_min(list_filter([{', '.join(ways)}], lambda z: z IS NOT NULL)) AS w{q}"
    for q, ways in {
        q: [
            f"{{'k': lpad((v{q}.k[:9]::BIGINT + 3)::VARCHAR, 9, '0') || 'D' || v{q}.k[10:], 'r': v{q}.r}}",
            *[
                f"CASE WHEN must = 0 AND {when} THEN {{'k': lpad((v{to}.k[:9]::BIGINT + {cost} + late)::VARCHAR, 9, '0') || '{letter}' || v{to}.k[10:], 'r': list_prepend({put}, v{to}.r)}} END"
                for letter, when, cost, to, put in [("K", f"i = '{name}'", 0, to, "role || ':' || text") for name, to in kept] + [("R", "true", 2, forced, f"'{role}:' || text")]
            ],
        ]
        for q, kept, forced, role in [(0, [("s", 1), ("u", 2)], 2, "user"), (1, [("u", 2)], 2, "user"), (2, [("a", 3)], 3, "assistant"), (3, [("u", 2)], 2, "user")]
    }.items()
)
_PUT = "{{'k': lpad((w{to}.k[:9]::BIGINT + 2)::VARCHAR, 9, '0') || 'I' || w{to}.k[10:], 'r': list_prepend('{role}:', w{to}.r)}}"
_U, _A = _PUT.format(to=2, role="user"), _PUT.format(to=3, role="assistant")
_TURNS = f"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS what FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM g WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
c AS (SELECT *, role[1] AS i, CASE WHEN blank OR again THEN 1 ELSE 0 END AS must, CASE WHEN NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late FROM f),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate, sum(late) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id),
r AS (SELECT conv_id, n, {{'k': '000000000', 'r': []::VARCHAR[]}} AS v0, {{'k': '000000004II', 'r': ['user:', 'assistant:']}} AS v1, {{'k': '000000002I', 'r': ['assistant:']}} AS v2, {{'k': '000000000', 'r': []::VARCHAR[]}} AS v3 FROM s
UNION ALL SELECT conv_id, n, list_min([w0, {_U}, {_PUT.format(to=2, role="user").replace("w2", "x2")}]), list_min([w1, {_U}, {_PUT.format(to=2, role="user").replace("w2", "x2")}]), x2, list_min([w3, {_U}])
FROM (SELECT *, list_min([w2, {_A}]) AS x2 FROM (SELECT r.conv_id, r.n - 1 AS n, {_STEP} FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.n = r.n)))
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.k[:9]::BIGINT, 0) AS cost, coalesce(v0.k[10:], '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.n = 0"""

ORACLE_SQL: dict[str, str] = {
    "op8_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM w, range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * both_ >= 75 * (nx.k + ny.k - both_)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n.k, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
    "op10_repeats": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, range(1, len(ws) - 48) t(i)),
f AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY 1),
gone AS (SELECT DISTINCT win.doc_id, win.i + k.k AS i FROM win JOIN f ON win.h = f.h, range(0, 50) k(k) WHERE f.first_id < win.doc_id),
u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(u.x, ' ' ORDER BY u.i) AS t FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op11_turns": _TURNS,
    "op13_lines": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> k.doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id""",
}
