"""Reports in plain SQL: what the XML queries are held against.

The SQL shares nothing with the shredder: a body is taken apart into tags and texts by one regular expression, the depth is a running sum
of tags that open and close, the parent of an element is the last one a level higher (an as-of join), ancestors follow by recursion.
"""

from __future__ import annotations

_FORBIDDEN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
_TOKEN = r"""<!--(?s:.)*?-->|<!\[CDATA\[(?s:.)*?\]\]>|<(?:[^<>"'']|"[^"]*"|''[^'']*'')*>|[^<]+"""

#: The reports of the table, each once by its last delivery, as (doc, body).
REPORTS = (
    "SELECT CAST(report_id AS VARCHAR) AS doc, body, received_at, report_id AS ord FROM reports WHERE report_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC NULLS LAST, length(body) DESC NULLS LAST) = 1"
)


def plain(x: str) -> str:
    """Text or an attribute's value without its escapes."""
    for a, b in (("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&#10;", "\n"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def attr(name: str, tag: str = "t") -> str:
    """The value of an attribute in a tag; null where it has none."""
    return f"""CASE WHEN regexp_matches({tag}, '\\s{name}\\s*=\\s*["'']') THEN {plain(f"regexp_extract({tag}, '\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''[^'']*'')', 1)")} END"""


def nodes(source: str = REPORTS, texts: bool = True) -> str:
    """Common table expressions that end in ``n`` (doc, pre, parent, depth, tag, t, path, pres, text): every element of every well-formed report, t its
    tag as written, path and pres the names and numbers of its ancestors from the root, text what stands before its first child."""
    text = f"""
xt AS (SELECT doc, i, d - 1 AS up, CASE WHEN starts_with(x, '<![CDATA[') THEN x[10:-4] ELSE {plain("x")} END AS x FROM td WHERE k = 'x'),
xo AS (SELECT xt.doc, e.pre, xt.i, xt.x FROM xt ASOF JOIN el e ON xt.doc = e.doc AND xt.up = e.depth AND xt.i > e.i),
xf AS (SELECT xo.doc, xo.pre, string_agg(xo.x, '' ORDER BY xo.i) AS text FROM xo LEFT JOIN (SELECT doc, parent, min(i) AS i FROM ep GROUP BY ALL) c ON c.doc = xo.doc AND c.parent = xo.pre WHERE c.i IS NULL OR xo.i < c.i GROUP BY ALL),
n AS (SELECT an.*, xf.text FROM an LEFT JOIN xf ON xf.doc = an.doc AND xf.pre = an.pre)""" if texts else "\nn AS (SELECT * FROM an)"  # fmt: skip
    return f"""src AS ({source}),
cl AS (SELECT doc, replace(replace(ltrim(regexp_replace(body, '{_FORBIDDEN}', '', 'g'), chr(65279) || ' ' || chr(9) || chr(13) || chr(10) || chr(133) || chr(160) || chr(12288)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS b FROM src WHERE body <> ''),
tk AS (SELECT doc, b, regexp_extract_all(b, '{_TOKEN}') AS l FROM cl),
un AS (SELECT doc, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM tk WHERE array_to_string(l, '') = b),
ki AS (SELECT doc, i, x, CASE WHEN starts_with(x, '<![CDATA[') OR x[1] <> '<' THEN 'x' WHEN x[2] IN ('?', '!') THEN 's' WHEN x[2] = '/' THEN 'c' WHEN x[-2] = '/' THEN 'e' ELSE 'o' END AS k FROM un),
td AS (SELECT *, coalesce(sum(CASE k WHEN 'o' THEN 1 WHEN 'c' THEN -1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM ki),
el0 AS (SELECT doc, i, x AS t, k, CAST(d AS INT) AS depth, regexp_extract(x, '^<([^\\s/>]+)', 1) AS tag, CAST(row_number() OVER (PARTITION BY doc ORDER BY i) AS INT) AS pre FROM td WHERE k IN ('o', 'e')),
cm AS (SELECT c.doc, c.x, e.tag FROM td c ASOF LEFT JOIN el0 e ON c.doc = e.doc AND CAST(c.d AS INT) - 1 = e.depth AND c.i > e.i WHERE c.k = 'c'),
bad AS (SELECT doc FROM cm WHERE tag IS NULL OR trim(x[3:-2]) <> tag
  UNION SELECT doc FROM td GROUP BY doc HAVING sum(CASE k WHEN 'o' THEN 1 WHEN 'c' THEN -1 ELSE 0 END) <> 0 OR count(*) FILTER (WHERE d = 0 AND k IN ('o', 'e')) <> 1
  UNION SELECT doc FROM td WHERE k = 'x' AND d = 0 AND trim(x, chr(10) || ' ' || chr(9)) <> ''
  UNION SELECT doc FROM td WHERE NOT starts_with(x, '<![CDATA[') AND regexp_matches(regexp_replace(x, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);', '', 'g'), '&')),
el AS (SELECT * FROM el0 WHERE doc NOT IN (SELECT doc FROM bad)),
ep AS (SELECT e.*, p.pre AS parent FROM el e ASOF LEFT JOIN el p ON e.doc = p.doc AND e.depth - 1 = p.depth AND e.i > p.i),
an AS (SELECT doc, pre, coalesce(parent, 0) AS parent, depth, tag, t, []::VARCHAR[] AS path, []::INT[] AS pres FROM ep WHERE depth = 0
  UNION ALL SELECT e.doc, e.pre, e.parent, e.depth, e.tag, e.t, list_append(a.path, a.tag), list_append(a.pres, a.pre) FROM an a JOIN ep e ON e.doc = a.doc AND e.parent = a.pre),{text}"""


#: The elements of delivered files, with ``file``, further common table expressions after those of :func:`nodes`.
FILES = f"""fa AS (SELECT n.doc, n.pre, coalesce({attr("name")}, '') AS file, src.received_at, src.ord FROM n JOIN src ON src.doc = n.doc WHERE n.depth = 1 AND n.tag = 'File'),
fl AS (SELECT doc, pre, file FROM fa QUALIFY row_number() OVER (PARTITION BY file ORDER BY received_at DESC NULLS LAST, ord DESC, pre DESC) = 1),
m AS (SELECT n.*, fl.file FROM n JOIN fl ON fl.doc = n.doc AND fl.pre = coalesce(n.pres[2], n.pre) AND n.depth > 0)"""


def delivered(select: str, source: str = REPORTS, more: str = "") -> str:
    """``select`` over the delivered elements; its own common table expressions continue the list."""
    for head in ("WITH RECURSIVE ", "WITH "):
        if select.startswith(head):
            more, select = f"{more},\n{select.removeprefix(head)}", ""
    return f"WITH RECURSIVE {nodes(source)},\n{FILES}{more}\n{select}"


def query(select: str, source: str = REPORTS, texts: bool = True) -> str:
    return f"WITH RECURSIVE {nodes(source, texts)}\n{select}"


#: Whether an element is a record of a report (:mod:`shalework.operators.nested`).
_IN_GROUPS = "list_filter(path, lambda g: g <> 'Group')[-1]"
RECORD = f"""CASE tag WHEN 'BaseTable' THEN path[-1] = 'BaseTableCatalog' WHEN 'Table' THEN path[-1] = 'TableList' WHEN 'Relationship' THEN path[-1] = 'RelationshipList'
  WHEN 'JoinPredicate' THEN path[-1] = 'JoinPredicateList' WHEN 'Object' THEN true WHEN 'Step' THEN true
  WHEN 'Field' THEN path[-2:] = ['BaseTableCatalog', 'BaseTable'] OR path[-3:] = ['BaseTableCatalog', 'BaseTable', 'FieldCatalog']
  WHEN 'Layout' THEN {_IN_GROUPS} = 'LayoutCatalog' AND coalesce({attr("name")}, '') <> '-' WHEN 'Script' THEN {_IN_GROUPS} = 'ScriptCatalog' AND coalesce({attr("name")}, '') <> '-' ELSE false END"""

#: Records with the link to their parents, as further common table expressions: ``rc`` (doc, pre, tag, t, rec_no, parent_no).
RECORDS = f"""rec AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY pre) AS INT) AS rec_no FROM n WHERE coalesce({RECORD}, false)),
up AS (SELECT r.doc, r.pre, max(p.rec_no) AS parent_no FROM (SELECT doc, pre, unnest(pres) AS a FROM rec) r JOIN rec p ON p.doc = r.doc AND p.pre = r.a GROUP BY ALL),
rc AS (SELECT rec.*, coalesce(parent_no, 0) AS parent_no FROM rec LEFT JOIN up ON up.doc = rec.doc AND up.pre = rec.pre)"""


def records(select: str, texts: bool = False) -> str:
    return f"WITH RECURSIVE {nodes(texts=texts)},\n{RECORDS}\n{select}"


def leaf(leaf: str, entity: str) -> str:
    """The first value of a leaf of a record: an attribute, or the text or an attribute of the first element at a path below it, outside of other records."""
    at, _, name = leaf.partition("@")
    if not at:
        return attr(name, "rc.t")
    value = attr(name, "x.t") if name else "trim(x.text, chr(10) || chr(9) || ' ')"
    steps = at.split("/")
    inner = "[" + ", ".join(f"'{s}'" for s in (entity, *steps[:-1])) + "]"
    return f"(SELECT arg_min(v, p) FROM (SELECT {value} AS v, x.pre AS p FROM n x WHERE x.doc = rc.doc AND x.tag = '{steps[-1]}' AND x.path[-{len(steps)}:] = {inner} AND x.pres[-{len(steps)}] = rc.pre) WHERE v IS NOT NULL{'' if name else ' AND v <> ' + chr(39) * 2})"


def entity_table(entity: str, leaves: dict[str, str]) -> str:
    """The SQL of :func:`shalework.operators.nested.entity_table`."""
    columns = ", ".join(f"{leaf(x, entity)} AS {name}" for x, name in leaves.items())
    return records(f"SELECT CAST(doc AS BIGINT) AS report_id, rec_no, parent_no, {columns} FROM rc WHERE tag = '{entity}'", texts=True)
