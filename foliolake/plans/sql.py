"""The bindings in SQL, for the equivalents of registered queries."""

from __future__ import annotations

import re

from foliolake.sources.bindings import CATALOG

_VALUES = ", ".join(f"('{s}', '{t}', '{c}', {str(r).lower()})" for s, t, c, r in CATALOG)

VIEWS = {
    "package": "SELECT doc_id AS package_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS source_sha256, lang, source FROM documents",
    "paragraph": """SELECT package_id, 'document' AS part, idx, concat('P', idx) AS paragraph_id, text FROM (SELECT package_id,
        unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM package)""",
    "leaf": """SELECT *, start + length(text) AS "end" FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY package_id, idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT package_id, idx, paragraph_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM paragraph))""",
    "segment": r"""SELECT *, CASE WHEN kind IS NOT NULL THEN concat_ws('|', 'document', kind, w_id, left(sha256(text), 12)) END AS revision, NOT coalesce(kind IN ('insert', 'move_to'), false) AS in_original, NOT coalesce(kind IN ('delete', 'move_from'), false) AS in_final
        FROM (SELECT *, concat('s_', left(sha256(CASE WHEN regexp_matches(text, '^\p{Lu}') THEN 'upper' WHEN regexp_matches(text, '^\p{Ll}') THEN 'lower' WHEN regexp_matches(text, '^[0-9]') THEN 'digit' ELSE 'other' END), 16)) AS style_id,
        CASE WHEN kind IS NOT NULL THEN CAST(idx * 1000 + k AS VARCHAR) END AS w_id FROM (SELECT *, CASE WHEN k % 11 = 3 THEN 'insert' WHEN k % 11 = 7 THEN 'delete' WHEN k % 29 = 5 THEN 'move_from' WHEN k % 29 = 9 THEN 'move_to' END AS kind FROM leaf))""",
    "revision_row": """SELECT package_id, idx, paragraph_id, k, start, "end", kind, w_id, revision, source AS author, segment.text FROM segment JOIN package USING (package_id) WHERE revision IS NOT NULL""",
    "nested": """SELECT package_id, idx, k AS first, k + CASE WHEN k % 17 = 2 THEN 5 ELSE 3 END AS last, CASE WHEN k % 17 = 2 THEN 'insert' ELSE 'delete' END AS kind,
        concat(CASE WHEN k % 17 = 2 THEN 'insert' ELSE 'delete' END, '|', k) AS key FROM leaf WHERE k % 17 = 2 OR k % 19 = 4""",
    "markup": """SELECT page_id AS package_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g') AS html FROM pages""",
    "tag": """SELECT package_id, idx, raw, name, starts_with(raw, '</') AS closing, name IN ('meta', 'br', 'link', 'img', 'input', 'hr') AS void FROM (SELECT *, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM
        (SELECT package_id, unnest(t) AS raw, generate_subscripts(t, 1) - 1 AS idx FROM (SELECT package_id, regexp_extract_all(html, '</?[a-zA-Z](?:[^>"'']+|"[^"]*"|''[^'']*'')*>') AS t FROM markup)))""",
    "opaque": """SELECT package_id, unnest(o) AS interior, generate_subscripts(o, 1) - 1 AS ordinal FROM (SELECT page_id AS package_id,
        regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>') AS o FROM pages)""",
    "relationship": """SELECT *, concat('rId', ordinal + 1) AS rel_id FROM (SELECT package_id, unnest(t) AS target, generate_subscripts(t, 1) - 1 AS ordinal FROM (SELECT page_id AS package_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS t FROM pages))""",
    "cell_row": """SELECT l_orderkey AS table_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS row_index,
        [CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR)] AS cells FROM lineitem""",
    "cell": "SELECT table_index, row_index, generate_subscripts(cells, 1) - 1 AS col_index, unnest(cells) AS text FROM cell_row",
    "comment_def": "SELECT CAST(conv_id AS VARCHAR) AS id, role AS author, text FROM conversations WHERE turn = 0 AND conv_id % 7 <> 3",
    "comment_anchor": """SELECT CAST(conv_id AS VARCHAR) AS id, 'word/document.xml' AS part, concat('P', turn) AS paragraph_id,
        CASE turn % 3 WHEN 1 THEN 'comment-start' WHEN 2 THEN 'comment-end' ELSE 'comment-reference' END AS kind, turn AS ordinal FROM conversations WHERE turn > 0""",
    "review_event": """SELECT event_id, user_id AS client_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'draft' WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'acknowledged' ELSE 'queued' END AS status,
        CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'defer' END AS review_decision,
        CASE event_type WHEN 'click' THEN 'staged' WHEN 'purchase' THEN 'in_progress' WHEN 'error' THEN 'applied' WHEN 'signup' THEN 'acknowledged' END AS delivery_state,
        concat('P', json_extract_string(props, '$.k')) AS paragraph_id, event_type AS type, value FROM events""",
    "decision": """SELECT doc_id AS package_id, CASE WHEN toxic = 1 THEN 'defer' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN doc_id % 3 = 0 THEN 'looked at' END AS rationale FROM labels""",
    "generation_row": """SELECT o_custkey AS workdir, o_orderkey AS generation, lag(o_orderkey) OVER w AS parent, row_number() OVER w AS ordinal, o_orderstatus AS status, o_orderpriority AS operation, o_orderdate AS at
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "catalog": f"SELECT * FROM (VALUES {_VALUES}) v(source, target, classification, reversible)",
}



def escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _run(text: str, tag: str = "t", properties: str = "") -> str:
    return f"""concat('<w:r>{properties}<w:{tag} xml:space="preserve">', {escaped(text)}, '</w:{tag}></w:r>')"""


_BY = """concat('w:id="', {0}, '" w:author="', source, '" w:date="2020-01-01T00:00:00Z"')"""
_OWN, _MARK = _BY.format("idx"), _BY.format("1000000 + idx")
#: The XML of each kind of line.
CASES = {
    0: f"concat('<w:p>', {_run('text')}, '</w:p>')",
    1: f"concat('<w:tbl><w:tr><w:tc><w:p>', {_run('w1')}, '</w:p></w:tc><w:tc><w:p>', {_run('rest')}, '</w:p></w:tc></w:tr></w:tbl>')",
    2: f"concat('<w:p><w:r><w:drawing><w:txbxContent><w:p>', {_run('text')}, '</w:p></w:txbxContent></w:drawing></w:r></w:p>')",
    3: f"concat('<w:sdt><w:sdtContent><w:p>', {_run('text')}, '</w:p></w:sdtContent></w:sdt>')",
    4: f"""concat('<w:p><w:pPr><w:rPr><w:ins ', {_MARK}, '/></w:rPr></w:pPr>', {_run("w1", properties="<w:rPr><w:b/></w:rPr>")}, '<w:ins ', {_OWN}, '>', {_run("w2")}, '</w:ins><w:del ', {_OWN}, '><w:bookmarkStart w:id="', idx, '"/>', {_run("w3", "delText")}, '<w:bookmarkEnd w:id="', idx, '"/></w:del></w:p>')""",
    5: f"""concat('<w:p><w:commentRangeStart w:id="', idx, '"/>', {_run("text")}, '<w:commentRangeEnd w:id="', idx, '"/><w:r><w:commentReference w:id="', idx, '"/></w:r></w:p>')""",
}


def document(changed: dict[int, str] | None = None) -> str:
    """The main part of a package, with other XML for some kinds of lines."""
    lines = " ".join(f"WHEN {c} THEN {xml}" for c, xml in (CASES | (changed or {})).items())
    return f"""concat('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><!-- <w:p> -->', string_agg(CASE c {lines} END, '' ORDER BY idx), '</w:body></w:document>')"""


def notes(where: str = "c = 5") -> tuple[str, str]:
    """The comments part and the extended one, with the entries of some lines."""
    return tuple(f"concat('<{part}>', coalesce(string_agg({xml}, '' ORDER BY idx) FILTER ({where}), ''), '</{part}>')" for part, xml in (("w:comments", _NOTE), ("w15:commentsEx", _EXTRA)))


_NOTE = f"""concat('<w:comment w:id="', idx, '" w:author="', source, '" w:date="2020-01-01T00:00:00Z"><w:p w14:paraId="', printf('%08X', idx), '">', {_run("concat('note ', idx)")}, '</w:p></w:comment>')"""
_EXTRA = """concat('<w15:commentEx w15:paraId="', printf('%08X', idx), '" w15:done="', idx % 2, '"/>')"""
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
_RELS = f'<Relationships><Relationship Id="rId1" Type="{_TYPES}image" Target="media/image1.png"/><Relationship Id="rId2" Type="{_TYPES}hyperlink" Target="https://example.org/" TargetMode="External"/></Relationships>'

#: The packages that ``docx.packages_from_texts`` makes of documents: lines with their words and ordinals, items in order, members.
VIEWS |= {
    "pline": """SELECT *, split_part(rest, ' ', 1) AS w2, CASE WHEN contains(rest, ' ') THEN substring(rest, strpos(rest, ' ') + 1) ELSE '' END AS w3,
        count(*) FILTER (c IN (0, 2, 4, 5)) OVER w AS np, count(*) FILTER (c = 1) OVER w AS nt, count(*) FILTER (c = 2) OVER w AS nb, count(*) FILTER (c = 3) OVER w AS ns
        FROM (SELECT p.package_id, idx, p.text, idx % 6 AS c, source, split_part(p.text, ' ', 1) AS w1, CASE WHEN contains(p.text, ' ') THEN substring(p.text, strpos(p.text, ' ') + 1) ELSE '' END AS rest
        FROM paragraph p JOIN package k ON p.package_id = k.package_id) WINDOW w AS (PARTITION BY package_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "pitem": """SELECT package_id, 'document' AS part, idx, n, CASE c WHEN 1 THEN concat('T', nt, '.R0.C', n, '.P0') WHEN 3 THEN concat('S', ns, '.P0') ELSE CASE WHEN c = 2 AND n = 1 THEN concat('B', nb, '.P0') ELSE concat('P', np) END END AS paragraph_id,
        i.item, i.text, i.style, i.ref, i.kind, i.w_id FROM (SELECT *, unnest(items) AS i, generate_subscripts(items, 1) - 1 AS n FROM (SELECT *, CASE c
        WHEN 1 THEN [{'item': 'text', 'text': w1, 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL}, {'item': 'text', 'text': rest, 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL}]
        WHEN 2 THEN [{'item': 'opaque', 'text': '', 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL}, {'item': 'text', 'text': text, 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL}]
        WHEN 4 THEN [{'item': 'mark', 'text': '', 'style': '', 'ref': NULL, 'kind': 'insert', 'w_id': CAST(1000000 + idx AS VARCHAR)}, {'item': 'text', 'text': w1, 'style': 'b/', 'ref': NULL, 'kind': NULL, 'w_id': NULL},
            {'item': 'text', 'text': w2, 'style': '', 'ref': NULL, 'kind': 'insert', 'w_id': CAST(idx AS VARCHAR)}, {'item': 'bookmark-start', 'text': '', 'style': '', 'ref': CAST(idx AS VARCHAR), 'kind': 'delete', 'w_id': CAST(idx AS VARCHAR)},
            {'item': 'text', 'text': w3, 'style': '', 'ref': NULL, 'kind': 'delete', 'w_id': CAST(idx AS VARCHAR)}, {'item': 'bookmark-end', 'text': '', 'style': '', 'ref': CAST(idx AS VARCHAR), 'kind': 'delete', 'w_id': CAST(idx AS VARCHAR)}]
        WHEN 5 THEN [{'item': 'comment-start', 'text': '', 'style': '', 'ref': CAST(idx AS VARCHAR), 'kind': NULL, 'w_id': NULL}, {'item': 'text', 'text': text, 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL},
            {'item': 'comment-end', 'text': '', 'style': '', 'ref': CAST(idx AS VARCHAR), 'kind': NULL, 'w_id': NULL}, {'item': 'comment-reference', 'text': '', 'style': '', 'ref': CAST(idx AS VARCHAR), 'kind': NULL, 'w_id': NULL}]
        ELSE [{'item': 'text', 'text': text, 'style': '', 'ref': NULL, 'kind': NULL, 'w_id': NULL}] END AS items FROM pline))
        UNION ALL SELECT package_id, 'header1', 0, 0, 'header1.P0', 'text', source, '', NULL, NULL, NULL FROM package""",
    "pmember": f"""SELECT package_id, unnest(['[Content_Types].xml', 'word/document.xml', 'word/header1.xml', 'word/comments.xml', 'word/commentsExtended.xml', 'word/_rels/document.xml.rels', 'word/media/image1.png']) AS part_path,
        unnest(['<Types/>', {document()},
        concat('<w:hdr><w:p>', any_value({_run("source")}), '</w:p></w:hdr>'), {", ".join(notes())}, '{_RELS}', string_agg(text, chr(10) ORDER BY idx)]) AS content FROM pline GROUP BY package_id""",
    "pcheck": """SELECT package_id, source, lang, unnest(['open', 'well-formed', 'anchors']) AS "check", unnest([CASE WHEN d = 3 THEN 'fail' ELSE 'pass' END, CASE d WHEN 3 THEN 'not-run' WHEN 6 THEN 'fail' ELSE 'pass' END,
        CASE WHEN d IN (3, 6) THEN 'not-run' WHEN d = 4 AND noted THEN 'fail' ELSE 'pass' END]) AS result FROM (SELECT package_id, source, lang, package_id % 10 AS d, len(string_split(text, chr(10))) >= 6 AS noted FROM package)""",
    "pstat": f"""SELECT package_id, x.xml, x.most, x.depth, t.longest FROM (SELECT package_id, CAST(sum(strlen(content)) FILTER (part_path LIKE 'word/%.xml') AS BIGINT) AS xml, CAST(max(strlen(content)) AS BIGINT) AS most,
        (SELECT CAST(max(CASE c WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 3 THEN 7 WHEN 4 THEN 6 ELSE 5 END) AS BIGINT) FROM pline WHERE pline.package_id = m.package_id) AS depth FROM pmember m GROUP BY package_id) x
        JOIN (SELECT package_id, CAST(max(strlen({escaped("text")})) AS BIGINT) AS longest FROM pitem WHERE part = 'document' AND item = 'text' AND kind IS DISTINCT FROM 'delete' GROUP BY package_id) t USING (package_id)""",
}

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def _needs(text: str, seen: list[str]) -> list[str]:
    for name in _NAMES.findall(text):
        if name not in seen and re.search(rf"(FROM|JOIN|,)\s+\(?{name}\b", text):
            _needs(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(body: str) -> str:
    """The query with the views that it names before it."""
    names = _needs(body, [])
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    rest = body.strip()
    if not own:
        return rest
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {own}, {rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {own}, {rest[5:]}"
    return f"WITH {own} {rest}"
