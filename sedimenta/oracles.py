"""SQL for DuckDB that answers the registered queries on the same tables.

Written from the meaning of the operators and, where it can, along another way
than the Spark plans: joins for windows, windows for text functions, recursion for
the file assignment.
"""

from __future__ import annotations

# The whitespace of Python's str.strip, for DuckDB's regular expressions.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _lcs(a: str, b: str) -> str:
    """Bit-parallel LCS length for texts of at most 125 characters."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    mask = (
        f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN ({a})[i + 1] = c "
        f"THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    )
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    return (
        f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), "
        f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"
    )


def _ratio(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE "
        f"ELSE 2::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END)"
    )


# -- catalogue ---------------------------------------------------------------

_PAGES = """repos AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, 'example.', 'github.')
    WHEN 1 THEN replace(url, 'example.', 'gitlab.') ELSE url || '/' END AS repository
  FROM pages)"""

_CATALOG = r"""cat AS (
  SELECT 'https://github.com/forge/cust-' || o_custkey AS repository,
    CASE o_orderkey % 8
      WHEN 0 THEN 'refs/tags/v1.' || (o_orderkey % 5)
      WHEN 1 THEN 'refs/tags/v1.' || (o_orderkey % 5) || '-rc1'
      WHEN 2 THEN 'refs/heads/release/1.' || (o_orderkey % 5)
      WHEN 3 THEN 'refs/heads/main'
      WHEN 4 THEN 'refs/pull/' || (o_orderkey % 5) || '/head'
      WHEN 5 THEN 'refs/heads/dependabot/pip/x-1.' || (o_orderkey % 5)
      WHEN 6 THEN 'None' END AS branch,
    CASE WHEN o_orderkey % 8 < 6 THEN 'https://archive.example/' || o_orderkey END AS download_link,
    CASE WHEN o_orderkey % 8 < 6 THEN o_orderpriority END AS name,
    CASE WHEN o_orderkey % 8 < 6 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date,
    o_orderkey AS release_seq
  FROM orders),
versioned AS (
  SELECT *, list_filter(string_split(branch, '/'), lambda p: regexp_matches(p, '\d+\.\d+'))[1] AS version
  FROM cat),
clean AS (
  SELECT * FROM cat WHERE release_seq % 8 < 4)"""

_HISTORY_RELEASES = """rel AS (
  SELECT DISTINCT 'https://github.com/forge/supp-' || l_suppkey AS repository, 'supp-' || l_suppkey AS repository_name,
    'refs-tags-v' || year(l_shipdate) AS branch, year(l_shipdate) || '-06-30 12:00:00' AS date,
    l_suppkey * 10000 + year(l_shipdate) AS release_seq
  FROM lineitem),
pairs AS (
  SELECT repository, repository_name, prev_branch, branch, date, release_idx FROM (
    SELECT repository, repository_name, branch AS prev_branch,
      lead(branch) OVER w AS branch, lead(date) OVER w AS date, row_number() OVER w - 1 AS release_idx
    FROM rel WINDOW w AS (PARTITION BY repository_name ORDER BY release_seq))
  WHERE branch IS NOT NULL)"""

_SNAPSHOT = """snap AS (
  SELECT repository, branch || '/' || release_seq AS branch, release_seq AS k, name, date,
    release_seq % 2 = 0 AND regexp_matches(branch || '/' || release_seq, '\\d+\\.\\d+') AS via
  FROM cat WHERE branch IS NOT NULL AND NOT contains(branch, 'pull')
    AND repository IN (SELECT 'https://github.com/forge/cust-' || c_custkey FROM customer))"""

# -- code units --------------------------------------------------------------

_METHODS = """li AS (
  SELECT 'supp-' || l_suppkey AS repository_name, 'refs-tags-v' || year(l_shipdate) AS branch,
    replace(p_name, ' ', '_') || '.py' AS path, nullif(l_returnflag, 'N') AS class,
    'm' || (l_partkey % 7) AS name, lower(l_linestatus) AS arg,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE 'self ' END || lower(l_linestatus) AS params,
    CAST(l_quantity AS BIGINT) AS qty, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS MATERIALIZED (
  SELECT *, head || mid || 'return ' || outer_call AS content,
    length(head) + length(mid) + 7 AS outer_at, length(head) + length(mid) + 7 + 6 AS inner_at,
    CASE WHEN qty > 25 THEN 1 ELSE 0 END AS checks
  FROM (
    SELECT repository_name, branch, path, class, name, params, arg, qty, l_linenumber,
      row_number() OVER (PARTITION BY repository_name, branch, path
        ORDER BY class NULLS FIRST, l_orderkey, l_linenumber, l_partkey) - 1 AS method_ord,
      'def ' || name || '(' || replace(params, ' ', ', ') || '):' || chr(10) || '    ' AS head,
      CASE WHEN qty > 25 THEN 'check(' || arg || ')' || chr(10) || '    ' ELSE '' END AS mid,
      'np.f' || l_linenumber || '(g(' || arg || '), ' || (qty % 3) || ')' AS outer_call
    FROM li)),
c AS MATERIALIZED (
  SELECT repository_name, branch, path, method_ord, 0 AS call_ord, 'check' AS name, NULL AS context,
    'check(' || arg || ')' AS expression, length(head) AS start_offset, 1 AS lineno FROM m WHERE checks = 1
  UNION ALL
  SELECT repository_name, branch, path, method_ord, checks, 'f' || l_linenumber, 'np', outer_call, outer_at, 1 + checks FROM m
  UNION ALL
  SELECT repository_name, branch, path, method_ord, checks + 1, 'g', NULL, 'g(' || arg || ')', inner_at, 1 + checks FROM m),
files AS MATERIALIZED (
  SELECT repository_name, branch, path, list(name ORDER BY method_ord) AS names, count(*) AS n
  FROM m GROUP BY ALL)"""

# -- files -------------------------------------------------------------------


def _share(tie_self: bool) -> str:
    least = "least(len(o.names), len(n.names))"
    ratio = f"len(list_intersect(list_distinct(o.names), list_distinct(n.names)))::DOUBLE / {least}"
    if not tie_self:
        return ratio
    own = "len(list_distinct(o.names))::DOUBLE / len(o.names)"
    return f"CASE WHEN len(o.names) = len(n.names) THEN {own} ELSE {ratio} END"


_FILES = """oldf AS MATERIALIZED (
  SELECT p.repository_name, p.prev_branch, p.branch, f.path, f.names
  FROM pairs p JOIN files f ON f.repository_name = p.repository_name AND f.branch = p.prev_branch),
newf AS MATERIALIZED (
  SELECT p.repository_name, p.prev_branch, p.branch, f.path, f.names
  FROM pairs p JOIN files f ON f.repository_name = p.repository_name AND f.branch = p.branch),
exact AS MATERIALIZED (
  SELECT repository_name, prev_branch, branch, path, oldf.names AS old_names, newf.names AS new_names
  FROM oldf JOIN newf USING (repository_name, prev_branch, branch, path)),
lo AS MATERIALIZED (SELECT * FROM oldf ANTI JOIN exact USING (repository_name, prev_branch, branch, path)),
ln AS MATERIALIZED (SELECT * FROM newf ANTI JOIN exact USING (repository_name, prev_branch, branch, path))"""


def _renames(interleaved: bool = False) -> str:
    """Sequential assignment: one old file of every release pair per step."""
    offered = "ln"
    open_later = ""
    if interleaved:
        offered = (
            "(SELECT *, false AS claimed FROM ln UNION ALL "
            "SELECT repository_name, prev_branch, branch, path, new_names, true FROM exact)"
        )
        open_later = "AND (NOT n.claimed OR n.path > o.path)"
    return f"""name_ratio AS MATERIALIZED (
  SELECT a, b, {_ratio("a", "b")} AS r
  FROM (SELECT DISTINCT path AS a FROM lo) x, (SELECT DISTINCT path AS b FROM {offered} q) y),
cand AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY repository_name, prev_branch, branch ORDER BY prev_path) AS k
  FROM (
    SELECT o.repository_name, o.prev_branch, o.branch, o.path AS prev_path, list(n.path ORDER BY n.path) AS cands
    FROM lo o JOIN {offered} n USING (repository_name, prev_branch, branch)
      JOIN name_ratio ON a = o.path AND b = n.path
    WHERE r > 0.75 {open_later}
      AND (len(o.names) = 0 OR len(n.names) = 0 OR {_share(interleaved)} > 0.5)
    GROUP BY ALL)),
steps AS (
  SELECT DISTINCT repository_name, prev_branch, branch, 0::BIGINT AS k, []::VARCHAR[] AS taken,
    NULL::VARCHAR AS prev_path, NULL::VARCHAR AS path FROM cand
  UNION ALL
  SELECT repository_name, prev_branch, branch, k,
    CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, prev_path, pick
  FROM (
    SELECT s.repository_name, s.prev_branch, s.branch, c.k, s.taken, c.prev_path,
      list_filter(c.cands, lambda x: NOT list_contains(s.taken, x))[1] AS pick
    FROM steps s JOIN cand c ON c.repository_name = s.repository_name AND c.prev_branch = s.prev_branch
      AND c.branch = s.branch AND c.k = s.k + 1)),
renamed AS MATERIALIZED (
  SELECT repository_name, prev_branch, branch, prev_path, path FROM steps WHERE path IS NOT NULL)"""


_MAPPED_FILES = """mapped AS MATERIALIZED (
  SELECT repository_name, prev_branch, branch, path AS prev_path, path FROM exact
  UNION ALL SELECT repository_name, prev_branch, branch, prev_path, path FROM renamed)"""

_SAME_PATH_ONLY = """mapped AS MATERIALIZED (
  SELECT repository_name, prev_branch, branch, path AS prev_path, path FROM exact)"""

_FP = "repository_name, prev_branch, branch, path"

# -- methods and calls inside mapped files -----------------------------------

_ALIGN = f"""om AS MATERIALIZED (
  SELECT p.repository_name, p.prev_branch, p.branch, p.path, m.class, m.name, m.params, m.method_ord, m.content
  FROM mapped p JOIN m ON m.repository_name = p.repository_name AND m.branch = p.prev_branch AND m.path = p.prev_path),
nm AS MATERIALIZED (
  SELECT p.repository_name, p.prev_branch, p.branch, p.path, m.class, m.name, m.params, m.method_ord, m.content
  FROM mapped p JOIN m ON m.repository_name = p.repository_name AND m.branch = p.branch AND m.path = p.path),
oi AS (SELECT {_FP}, coalesce(class, '') AS cls, name, params, min(method_ord) AS old_ord FROM om GROUP BY ALL),
ni AS MATERIALIZED (SELECT {_FP}, coalesce(class, '') AS cls, name, params, min(method_ord) AS new_ord FROM nm GROUP BY ALL),
ex AS MATERIALIZED (SELECT * FROM oi JOIN ni USING ({_FP}, cls, name, params)),
lone_old AS MATERIALIZED (
  SELECT *, coalesce(class, '') AS cls FROM om ANTI JOIN ex ON om.repository_name = ex.repository_name
    AND om.prev_branch = ex.prev_branch AND om.branch = ex.branch AND om.path = ex.path
    AND coalesce(om.class, '') = ex.cls AND om.name = ex.name AND om.params = ex.params),
lone_new AS MATERIALIZED (
  SELECT *, coalesce(class, '') AS cls FROM nm ANTI JOIN ex ON nm.repository_name = ex.repository_name
    AND nm.prev_branch = ex.prev_branch AND nm.branch = ex.branch AND nm.path = ex.path
    AND coalesce(nm.class, '') = ex.cls AND nm.name = ex.name AND nm.params = ex.params),
sig AS MATERIALIZED (
  SELECT o.repository_name, o.prev_branch, o.branch, o.path, o.method_ord AS old_ord, min(n.new_ord) AS new_ord
  FROM lone_old o JOIN ni n USING ({_FP}, cls, name)
    LEFT JOIN ex USING ({_FP}, cls, name, new_ord)
  WHERE ex.old_ord IS NULL OR ex.old_ord > o.method_ord
  GROUP BY ALL),
mm AS MATERIALIZED (
  SELECT {_FP}, old_ord, new_ord, 'exact' AS match FROM ex
  UNION ALL SELECT {_FP}, old_ord, new_ord, 'signature' FROM sig),
lone AS MATERIALIZED (
  SELECT {_FP}, 'removed' AS status, method_ord AS old_ord, NULL::BIGINT AS new_ord,
    EXISTS (SELECT 1 FROM sig s WHERE s.repository_name = x.repository_name AND s.prev_branch = x.prev_branch
      AND s.branch = x.branch AND s.path = x.path AND s.old_ord = x.method_ord) AS in_sig
  FROM lone_old x
  UNION ALL
  SELECT {_FP}, 'added', NULL, method_ord,
    EXISTS (SELECT 1 FROM sig s WHERE s.repository_name = x.repository_name AND s.prev_branch = x.prev_branch
      AND s.branch = x.branch AND s.path = x.path AND s.new_ord = x.method_ord)
  FROM lone_new x)"""

_SCORED = f"""texts AS MATERIALIZED (
  SELECT mm.*, a.content AS old_text, b.content AS new_text
  FROM mm JOIN om a ON a.repository_name = mm.repository_name AND a.prev_branch = mm.prev_branch
      AND a.branch = mm.branch AND a.path = mm.path AND a.method_ord = mm.old_ord
    JOIN nm b ON b.repository_name = mm.repository_name AND b.prev_branch = mm.prev_branch
      AND b.branch = mm.branch AND b.path = mm.path AND b.method_ord = mm.new_ord),
text_score AS MATERIALIZED (
  SELECT old_text, new_text, {_ratio("old_text", "new_text")} AS ratio, levenshtein(old_text, new_text) AS dist
  FROM (SELECT DISTINCT old_text, new_text FROM texts)),
ms AS MATERIALIZED (SELECT * FROM texts JOIN text_score USING (old_text, new_text))"""

_CALLS = f"""oc AS (
  SELECT mm.repository_name, mm.prev_branch, mm.branch, mm.path, old_ord, new_ord, c.call_ord, coalesce(context, '') AS context,
    name, expression, start_offset,
    row_number() OVER (PARTITION BY mm.repository_name, mm.prev_branch, mm.branch, mm.path, old_ord, new_ord, context, name
      ORDER BY start_offset) AS k
  FROM mm JOIN mapped p USING ({_FP})
    JOIN c ON c.repository_name = mm.repository_name AND c.branch = mm.prev_branch AND c.path = p.prev_path
      AND c.method_ord = mm.old_ord),
nc AS (
  SELECT mm.repository_name, mm.prev_branch, mm.branch, mm.path, old_ord, new_ord, c.call_ord, coalesce(context, '') AS context,
    name, expression, start_offset,
    row_number() OVER (PARTITION BY mm.repository_name, mm.prev_branch, mm.branch, mm.path, old_ord, new_ord, context, name
      ORDER BY start_offset) AS k
  FROM mm JOIN c ON c.repository_name = mm.repository_name AND c.branch = mm.branch AND c.path = mm.path
      AND c.method_ord = mm.new_ord),
cc AS MATERIALIZED (
  SELECT {_FP}, old_ord, new_ord, oc.call_ord AS old_call, nc.call_ord AS new_call,
    oc.expression AS old_expression, nc.expression AS new_expression,
    coalesce(nc.start_offset, oc.start_offset) AS start_offset,
    CASE WHEN nc.k IS NULL THEN 'removed' WHEN oc.k IS NULL THEN 'added' ELSE 'mapped' END AS status
  FROM oc FULL JOIN nc USING ({_FP}, old_ord, new_ord, context, name, k)),
call_score AS MATERIALIZED (
  SELECT old_expression, new_expression, {_ratio("old_expression", "new_expression")} AS ratio,
    levenshtein(old_expression, new_expression) AS dist
  FROM (SELECT DISTINCT old_expression, new_expression FROM cc WHERE status = 'mapped'))"""

# -- change records ----------------------------------------------------------

_IMPORTS = "'import numpy as np;from lib import part' || n || ' as p'"


def _records(exclusive: bool) -> str:
    keep = "WHERE NOT in_sig" if exclusive else ""
    return f"""mr AS MATERIALIZED (
  SELECT {_FP}, 'mapped' AS status, old_ord, new_ord, dist, ratio FROM ms
  UNION ALL SELECT {_FP}, status, old_ord, new_ord, NULL, NULL FROM lone {keep}),
listed_calls AS MATERIALIZED (
  SELECT repository_name, branch, path, method_ord,
    string_agg('-:' || expression || ':' || start_offset || ':-', ';' ORDER BY call_ord) AS calls
  FROM c GROUP BY ALL),
listed AS MATERIALIZED (
  SELECT repository_name, branch, path, method_ord,
    coalesce(class, '-') || '|' || name || '|' || params || '|' || content AS head, calls
  FROM m JOIN listed_calls USING (repository_name, branch, path, method_ord)),
mapped_calls AS (
  SELECT {_FP}, old_ord, new_ord,
    string_agg(status || ':' || coalesce(new_expression, old_expression) || ':' || start_offset || ':'
      || coalesce(dist::VARCHAR, '-'), ';' ORDER BY coalesce(old_call, 1000), coalesce(new_call, 1000)) AS calls
  FROM cc LEFT JOIN call_score USING (old_expression, new_expression) GROUP BY ALL),
method_text AS MATERIALIZED (
  SELECT mr.repository_name, mr.prev_branch, mr.branch, mr.path, mr.old_ord, mr.new_ord, mr.status,
    mr.status || '|' || l.head || '|' || coalesce(mr.dist::VARCHAR, '-') || '|'
      || coalesce((round(mr.ratio * 1000000)::BIGINT)::VARCHAR, '-') || '|'
      || CASE WHEN mr.status = 'mapped' THEN k.calls ELSE l.calls END AS t
  FROM mr JOIN mapped p USING ({_FP})
    JOIN listed l ON l.repository_name = mr.repository_name
      AND l.branch = CASE WHEN mr.status = 'removed' THEN mr.prev_branch ELSE mr.branch END
      AND l.path = CASE WHEN mr.status = 'removed' THEN p.prev_path ELSE mr.path END
      AND l.method_ord = CASE WHEN mr.status = 'removed' THEN mr.old_ord ELSE mr.new_ord END
    LEFT JOIN mapped_calls k ON k.repository_name = mr.repository_name AND k.prev_branch = mr.prev_branch
      AND k.branch = mr.branch AND k.path = mr.path AND k.old_ord = mr.old_ord AND k.new_ord = mr.new_ord),
mapped_text AS (
  SELECT {_FP}, string_agg(t, chr(10) ORDER BY coalesce(old_ord, 100000), coalesce(new_ord, 100000), status) AS methods
  FROM method_text GROUP BY ALL),
listed_text AS MATERIALIZED (
  SELECT repository_name, branch, path,
    string_agg('-|' || head || '|-|-|' || calls, chr(10) ORDER BY method_ord) AS methods
  FROM listed GROUP BY ALL),
shown AS (
  SELECT {_FP}, prev_path, 'mapped' AS status, 'own' AS mapping, branch AS at FROM mapped
  UNION ALL SELECT {_FP}, NULL, 'removed', 'removed', prev_branch FROM lo
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.repository_name = lo.repository_name
      AND r.prev_branch = lo.prev_branch AND r.branch = lo.branch AND r.prev_path = lo.path)
  UNION ALL SELECT {_FP}, NULL, 'added', 'added', branch FROM ln ANTI JOIN renamed USING ({_FP})
  UNION ALL SELECT f.repository_name, NULL, f.branch, f.path, NULL, 'initial', NULL, f.branch
    FROM pairs p JOIN files f ON p.release_idx = 0 AND f.repository_name = p.repository_name AND f.branch = p.prev_branch)"""


_RECORD_ROWS = f"""
SELECT 'https://github.com/forge/' || s.repository_name AS repository, s.repository_name, s.branch, s.prev_branch,
  right(s.branch, 4) || '-06-30 12:00:00Z' AS date, s.path, s.prev_path, s.status, s.mapping,
  {_IMPORTS} AS imports, CASE WHEN s.status = 'mapped' THEN t.methods ELSE l.methods END AS methods
FROM shown s
  JOIN files f ON f.repository_name = s.repository_name AND f.branch = s.at AND f.path = s.path
  LEFT JOIN mapped_text t ON t.repository_name = s.repository_name AND t.prev_branch = s.prev_branch
    AND t.branch = s.branch AND t.path = s.path
  LEFT JOIN listed_text l ON l.repository_name = s.repository_name AND l.branch = s.at AND l.path = s.path"""

_FILE_STATUS = """fs AS MATERIALIZED (
  SELECT repository_name, branch, path, 'mapped' AS status FROM mapped
  UNION ALL SELECT repository_name, branch, path, 'removed' FROM lo
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.repository_name = lo.repository_name
      AND r.prev_branch = lo.prev_branch AND r.branch = lo.branch AND r.prev_path = lo.path)
  UNION ALL SELECT repository_name, branch, path, 'added' FROM ln ANTI JOIN renamed
    USING (repository_name, prev_branch, branch, path))"""

_STATS = """per_file AS (
  SELECT repository_name, branch, path, count(*) FILTER (ratio < 1) AS chg, count(*) FILTER (ratio = 1) AS unc,
    sum(ratio) FILTER (ratio < 1) AS rs, sum(dist) FILTER (ratio < 1) AS ds FROM ms GROUP BY ALL),
st AS MATERIALIZED (
  SELECT repository_name, branch,
    count(*) FILTER (status = 'added') AS files_added, count(*) FILTER (status = 'removed') AS files_removed,
    count(*) FILTER (status = 'mapped') AS files_mapped,
    count(*) FILTER (status = 'mapped' AND coalesce(chg, 0) > 0) AS n_files_changed,
    count(*) FILTER (status = 'mapped' AND coalesce(chg, 0) = 0) AS n_files_unchanged,
    coalesce(sum(chg) FILTER (status = 'mapped'), 0)::BIGINT AS n_methods_changed,
    coalesce(sum(unc) FILTER (status = 'mapped'), 0)::BIGINT AS n_methods_unchanged,
    round(coalesce(sum(rs) FILTER (status = 'mapped') / sum(chg) FILTER (status = 'mapped'), 1), 6)::DOUBLE AS methods_avg_ratio,
    round(coalesce(sum(ds) FILTER (status = 'mapped')::DOUBLE / sum(chg) FILTER (status = 'mapped'), 0), 6)::DOUBLE AS methods_avg_dist
  FROM fs LEFT JOIN per_file USING (repository_name, branch, path) GROUP BY ALL),
stat AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY repository_name ORDER BY branch) AS release_no FROM st)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


_QUOTES, _APOSTROPHES = "repeat(chr(34), 3)", "repeat(chr(39), 3)"

_DOCUMENTS = f"""d AS (
  SELECT doc_id, replace(replace(replace(text, '. ', chr(10) || '  '), ', ', chr(10) || chr(9) || '# '), 'que', {_QUOTES}) AS content
  FROM documents)"""

_LINES = f"""lines AS (
  SELECT doc_id, i - 1 AS line_number, l[i] AS line, {_strip("l[i]")} AS text
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(content, chr(10)) AS l FROM d)))"""

_TREE = r"""tree AS (
  SELECT 'docs-' || regexp_replace(source, '[^A-Za-z0-9]', '-', 'g') AS repository_name, 'v' || (doc_id // 10) AS branch,
    'pkg' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/__init__.py' ELSE '/mod.py' END AS path,
    CASE WHEN doc_id % 7 > 0 THEN regexp_replace(text, '\r\n?', chr(10), 'g') END AS content
  FROM documents)"""

_NAMES = """np AS (
  SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"""


def _histogram(source: str, width: int) -> str:
    return f"""
SELECT bin, (lo_all + bin * {width})::DOUBLE AS lo, (lo_all + (bin + 1) * {width})::DOUBLE AS hi, count(*) AS n
FROM (
  SELECT b.lo_all, least((n - b.lo_all) // {width}, greatest(ceil((b.hi_all - b.lo_all) / {width}.0)::BIGINT, 1) - 1) AS bin
  FROM ({source}) s, (SELECT min(n) AS lo_all, max(n) AS hi_all FROM ({source})) b)
GROUP BY ALL"""


def build() -> dict[str, str]:
    history = [_HISTORY_RELEASES, _METHODS]
    with_files = [*history, _FILES]
    with_renames = [*with_files, _renames()]
    same_path = [*with_files, _SAME_PATH_ONLY, _ALIGN]
    whole = [*with_renames, _MAPPED_FILES, _ALIGN, _SCORED]
    stats = _with(*whole, _FILE_STATUS, _STATS, recursive=True)
    sql: dict[str, str] = {}

    # sources and sinks
    sql["scan_repositories"] = _with(_PAGES) + "SELECT repository FROM repos"
    sql["scan_catalog"] = _with(_CATALOG) + (
        "SELECT repository, nullif(branch, 'None') AS branch, download_link, name, date, release_seq FROM cat"
    )
    sql["scan_catalog_parts"] = _with(_CATALOG) + (
        "SELECT repository, nullif(branch, 'None') AS branch, download_link, name, date, "
        "row_number() OVER (ORDER BY release_seq) - 1 AS release_seq FROM cat"
    )
    sql["catalog_with_missing"] = _with(_CATALOG) + (
        "SELECT c.repository, coalesce(branch, 'None') AS branch, coalesce(download_link, 'None') AS download_link, "
        "coalesce(name, 'None') AS name, coalesce(date, 'None') AS date "
        "FROM (SELECT 'https://github.com/forge/cust-' || c_custkey AS repository FROM customer) c "
        "LEFT JOIN clean USING (repository)"
    )
    sql["scan_source_tree"] = _with(_TREE) + "SELECT * FROM tree"
    sql["expand_archives"] = _with(_TREE) + (
        "SELECT * FROM tree UNION ALL SELECT DISTINCT repository_name, branch, 'docs/requirements-dev.txt', "
        "'kept==1' || chr(10) FROM tree"
    )
    sql["write_changes"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, 'initial' AS status, right(branch, 4) || '-06-30 12:00:00Z' AS date, "
        "'import numpy as np' AS imports, method_ord AS place, class, name, params, content, (2 + checks)::BIGINT AS n_calls FROM m"
    )
    sql["scan_changes"] = _with(_METHODS) + (
        "SELECT repository_name, branch, count(*) AS n_files, sum(n)::BIGINT AS n_methods FROM files GROUP BY ALL"
    )
    sql["requirements"] = """
WITH r AS (
  SELECT 'supp-' || l_suppkey AS repository_name, 'refs-tags-v' || year(l_shipdate) AS branch, l_partkey AS p,
    l_linenumber AS v, l_orderkey % 8 AS kind,
    row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS line_no
  FROM lineitem),
named AS (
  SELECT repository_name, branch, line_no,
    CASE WHEN kind < 3 THEN 'lib' || p WHEN kind = 5 THEN 'git+https://host.example/' || p ELSE './local/' || p END AS name,
    CASE kind WHEN 1 THEN '==1.' || v WHEN 2 THEN '>=1.' || v || ',<2' ELSE '' END AS specs
  FROM r WHERE kind IN (0, 1, 2, 5, 6))
SELECT repository_name, branch, name, specs, line_no FROM named
QUALIFY row_number() OVER (PARTITION BY repository_name, branch, name ORDER BY line_no DESC) = 1"""

    sql["requirement_maps"] = """
WITH r AS (
  SELECT 'v' || p_partkey % 10 AS branch, 'lib' || p_partkey AS name,
    CASE p_partkey % 4 WHEN 2 THEN '~=1.0' WHEN 3 THEN '>=1,!=1.5' ELSE '' END AS specs
  FROM part)
SELECT branch, count(*) AS n, string_agg(name || specs, ';' ORDER BY name) AS requirements FROM r GROUP BY branch"""

    # scalar functions
    last, before_last = "string_split(repository, '/')[-1]", "string_split(repository, '/')[-2]"
    sql["repo_name"] = _with(_PAGES) + (
        f"SELECT page_id, CASE WHEN contains(repository, 'github') OR contains(repository, 'gitlab') THEN {last} "
        f"ELSE {before_last} END AS repository_name, "
        f"CASE WHEN contains(repository, 'github') THEN {last} ELSE {before_last} END AS narrow_name FROM repos"
    )
    sql["branch_slug"] = _with(_CATALOG) + "SELECT release_seq, replace(branch, '/', '-') AS branch FROM cat"
    sql["release_date"] = _with(_CATALOG) + "SELECT release_seq, date || 'Z' AS date FROM cat"
    sql["version_token"] = _with(_CATALOG) + "SELECT release_seq, version FROM versioned"
    sql["version_filter"] = _with(_CATALOG) + (
        r"SELECT release_seq, branch FROM cat WHERE regexp_matches(branch, 'v?\d+\.\d+')"
    )
    sql["relative_path"] = _with(_TREE) + "SELECT repository_name, branch, path FROM tree"
    sql["basename"] = _with(_TREE) + (
        "SELECT repository_name, branch, path, regexp_extract(path, '[^/]*$') AS name FROM tree"
    )
    sql["unit_ids"] = _with(_METHODS) + (
        "SELECT class, name, params, 1::BIGINT AS n_ids, count(DISTINCT path) AS n_file_ids, count(*) AS n_methods "
        "FROM m GROUP BY ALL"
    )
    counts = "count(DISTINCT unit) AS n_units, count(DISTINCT unit) AS n_ids, count(DISTINCT unit) AS n_pairs"
    sql["unit_ids_apart"] = _with(_METHODS) + f"""
SELECT 'method' AS kind, {counts} FROM (SELECT {{'c': coalesce(class, '-'), 'n': name, 'p': params}} AS unit FROM m)
UNION ALL SELECT 'file', {counts} FROM (SELECT path AS unit FROM m)
UNION ALL SELECT 'call', {counts} FROM (SELECT {{'e': expression, 's': start_offset}} AS unit FROM c)"""
    sql["method_lines"] = _with(_DOCUMENTS, _LINES) + "SELECT doc_id, line_number, text FROM lines"
    quoted = f"contains(line, {_QUOTES}) OR contains(line, {_APOSTROPHES})"
    sql["strip_comments"] = _with(_DOCUMENTS, _LINES) + f"""
SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY line_number)
  FILTER (NOT quoted AND seen % 2 = 0 AND text != '' AND NOT starts_with(text, '#')), '') AS source
FROM (
  SELECT *, {quoted} AS quoted,
    sum(({quoted})::INT) OVER (PARTITION BY doc_id ORDER BY line_number) AS seen
  FROM lines)
GROUP BY doc_id"""
    sql["line_count"] = _with(_DOCUMENTS) + (
        "SELECT doc_id, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines FROM d"
    )
    sql["edit_distance"] = _with(_NAMES) + "SELECT p_partkey, levenshtein(a, b) AS distance FROM np"
    sql["similarity_ratio"] = _with(_NAMES) + f"SELECT p_partkey, {_ratio('a', 'b')} AS ratio FROM np"
    sql["shared_method_ratio"] = _with(*with_files) + f"""
SELECT {_FP}, {_share(False)} AS ratio, {_share(True)} AS ratio_tie_self
FROM oldf o JOIN newf n USING ({_FP})"""

    # code units
    sql["parse_status"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, n % 5 != 4 AS parse_ok, CASE WHEN n % 5 = 4 THEN 'SyntaxError' END AS parse_error, "
        "CASE WHEN n % 5 = 4 THEN 0 ELSE n END AS n_methods, CASE WHEN n % 5 = 4 THEN 0::BIGINT ELSE 2 END AS n_imports FROM files"
    )
    sql["extract_functions"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, method_ord, name, content FROM m WHERE class IS NULL"
    )
    sql["extract_methods"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, method_ord, class, name, content FROM m WHERE class IS NOT NULL"
    )
    sql["method_params"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, method_ord, params, "
        "row_number() OVER (PARTITION BY repository_name, branch, path, class, name, params ORDER BY method_ord) > 1 AS repeated FROM m"
    )
    sql["extract_imports"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, 0::BIGINT AS import_ord, 'import' AS kind, NULL::VARCHAR AS module, "
        "0::BIGINT AS level, 'numpy' AS name, 'np' AS alias FROM files UNION ALL "
        "SELECT repository_name, branch, path, 1, 'from', 'lib', 0, 'part' || n, 'p' FROM files"
    )
    sql["import_kinds"] = """
WITH r AS (SELECT 'p' || p_partkey || '.py' AS path, p_partkey::VARCHAR AS p FROM part),
i AS (
  SELECT path, 0 AS o, 'import' AS kind, NULL AS module, 0 AS level, 'os' AS name, NULL AS alias, 'import os' AS statement FROM r
  UNION ALL SELECT path, 1, 'import', NULL, 0, 'part' || p || '.mod', 'alias', 'import part' || p || '.mod as alias' FROM r
  UNION ALL SELECT path, 2, 'import', NULL, 0, 'sys', NULL, 'import sys' FROM r
  UNION ALL SELECT path, 3, 'from', NULL, 1, 'here' || p, NULL, 'from None import here' || p FROM r
  UNION ALL SELECT path, 4, 'from', 'up', 2, 'a', 'b', 'from up import a as b' FROM r
  UNION ALL SELECT path, 5, 'from', 'up', 2, 'c', NULL, 'from up import c' FROM r
  UNION ALL SELECT path, 6, 'from', 'pkg' || p || '.sub', 0, '*', NULL, 'from pkg' || p || '.sub import *' FROM r)
SELECT path, o::BIGINT AS import_ord, kind, module, level::BIGINT AS level, name, alias, statement FROM i"""
    sql["call_offsets_behind_text"] = """
WITH r AS (
  SELECT 'p' || p_partkey || '.py' AS path, length('def f' || p_partkey || '(x):') + 12 AS place,
    repeat('é', (p_partkey % 4)::BIGINT) || repeat('日', (p_partkey % 3)::BIGINT) || 'a' AS t
  FROM part),
b AS (SELECT *, unnest([false, true]) AS in_bytes FROM r),
w AS (SELECT *, CASE WHEN in_bytes THEN strlen(t) ELSE length(t) END AS width FROM b)
SELECT path, 0::BIGINT AS call_ord, 'h(''' || t || ''', g(x))' AS expression, place::BIGINT AS start_offset,
  (place + 11 + length(t))::BIGINT AS end_offset, in_bytes FROM w
UNION ALL SELECT path, 1, 'g(x)', place + 6 + width, place + 10 + width, in_bytes FROM w"""
    sql["render_imports"] = _with(_METHODS) + (
        "SELECT repository_name, branch, 'import numpy as np' AS statement, count(*) AS n FROM files GROUP BY ALL UNION ALL "
        "SELECT repository_name, branch, 'from lib import part' || n || ' as p', count(*) FROM files GROUP BY ALL"
    )
    sql["extract_calls"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, method_ord, call_ord::BIGINT AS call_ord, name, context, expression FROM c"
    )
    sql["call_offsets"] = _with(_METHODS) + (
        "SELECT repository_name, branch, path, method_ord, call_ord::BIGINT AS call_ord, start_offset::BIGINT AS start_offset, "
        "(start_offset + length(expression))::BIGINT AS end_offset, lineno::BIGINT AS lineno FROM c"
    )

    # catalogue
    columns = "repository, branch, download_link, name, date, release_seq"
    sql["catalog_clean"] = _with(_CATALOG) + f"SELECT {columns} FROM clean"
    first = "QUALIFY row_number() OVER (PARTITION BY repository, version ORDER BY release_seq) = 1"
    sql["dedup_versions"] = _with(_CATALOG) + f"SELECT {columns}, version FROM versioned {first}"
    sql["cleaned_release_catalog"] = _with(_CATALOG) + (
        f"SELECT {columns}, version FROM versioned WHERE release_seq % 8 < 3 {first}"
    )
    sql["duplicated_versions"] = _with(_CATALOG) + (
        "SELECT release_seq, version, count(*) OVER (PARTITION BY repository, version) > 1 AS duplicated FROM versioned"
    )
    sql["distinct_repos"] = "SELECT DISTINCT 'https://github.com/forge/cust-' || o_custkey AS repository FROM orders"
    sql["empty_snapshots"] = _with(_CATALOG) + (
        "SELECT 'https://github.com/forge/cust-' || c_custkey AS repository FROM customer "
        "WHERE 'https://github.com/forge/cust-' || c_custkey NOT IN (SELECT repository FROM cat WHERE branch LIKE 'refs/tags/%')"
    )
    sql["resolve_targets"] = _with(_CATALOG, _SNAPSHOT) + """
SELECT repository, branch,
  CASE WHEN via THEN 'r' || k WHEN k % 3 > 0 THEN 't' || k WHEN k % 4 > 0 THEN 'd' || k END AS root,
  CASE WHEN via OR k % 5 > 0 THEN coalesce(name, 'None') ELSE 'None' END AS name, coalesce(date, 'None') AS date
FROM snap WHERE via OR (k % 11 != 0 AND (k % 3 > 0 OR k % 4 > 0))"""
    sql["pending_downloads"] = _with(_HISTORY_RELEASES) + (
        "SELECT repository_name, branch, release_seq FROM rel WHERE (release_seq % 10000 + release_seq // 10000) % 2 = 1"
    )
    sql["release_pairs"] = _with(_HISTORY_RELEASES) + (
        "SELECT repository, repository_name, prev_branch, branch, release_idx, date || 'Z' AS date FROM pairs"
    )
    sql["release_pairs_by_date"] = _with(_HISTORY_RELEASES) + """,
moved AS (
  SELECT repository_name, branch, release_seq,
    CASE WHEN release_seq % 10000 % 4 > 0 THEN (2000 + release_seq % 10000 * 3 % 5) || '-01-31 12:00:00' END AS day
  FROM rel)
SELECT repository_name, prev_branch, branch, release_idx, day || 'Z' AS date FROM (
  SELECT repository_name, branch AS prev_branch, lead(branch) OVER w AS branch, lead(day) OVER w AS day,
    row_number() OVER w - 1 AS release_idx
  FROM moved WINDOW w AS (PARTITION BY repository_name ORDER BY day NULLS FIRST, release_seq))
WHERE branch IS NOT NULL"""
    sql["initial_releases_single"] = _with(_HISTORY_RELEASES) + """,
chosen AS (
  SELECT *, release_seq % 10000 AS y, release_seq // 10000 AS s FROM rel
  WHERE release_seq // 10000 % 3 > 0 OR release_seq % 10000 = 1992 + release_seq // 10000 % 4),
firsts AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY repository_name ORDER BY release_seq) = 1)
SELECT repository, repository_name, branch FROM firsts WHERE (y + s) % 5 > 0"""
    sql["present_releases"] = _with(*history) + """,
big AS (SELECT repository_name, branch FROM m GROUP BY ALL HAVING count(*) > 70)
SELECT p.repository_name, prev_branch, p.branch, 'both' AS rule FROM pairs p
  JOIN big a ON a.repository_name = p.repository_name AND a.branch = p.prev_branch
  JOIN big b ON b.repository_name = p.repository_name AND b.branch = p.branch
UNION ALL
SELECT p.repository_name, prev_branch, p.branch, 'previous' FROM pairs p
  JOIN big a ON a.repository_name = p.repository_name AND a.branch = p.prev_branch"""

    # alignment
    sql["file_match_exact"] = _with(*with_files) + f"SELECT {_FP} FROM exact"
    sql["file_match_renamed"] = _with(*with_renames, recursive=True) + "SELECT * FROM renamed"
    sql["file_match_interleaved"] = _with(*with_files, _renames(interleaved=True), recursive=True) + "SELECT * FROM renamed"
    sql["files_added_removed"] = _with(*with_renames, recursive=True) + f"""
SELECT {_FP}, 'removed' AS status FROM lo WHERE NOT EXISTS (SELECT 1 FROM renamed r
  WHERE r.repository_name = lo.repository_name AND r.prev_branch = lo.prev_branch AND r.branch = lo.branch AND r.prev_path = lo.path)
UNION ALL SELECT {_FP}, 'added' FROM ln ANTI JOIN renamed USING ({_FP})"""
    for match in ("exact", "signature"):
        sql[f"method_match_{match}"] = _with(*same_path) + (
            f"SELECT {_FP}, old_ord, new_ord FROM mm WHERE match = '{match}'"
        )
    sql["methods_added_removed"] = _with(*same_path) + (
        f"SELECT {_FP}, status, old_ord, new_ord, true AS exclusive FROM lone WHERE NOT in_sig UNION ALL "
        f"SELECT {_FP}, status, old_ord, new_ord, false FROM lone"
    )
    sql["method_diff"] = _with(*same_path, _SCORED) + (
        f"SELECT {_FP}, old_ord, new_ord, match, ratio, dist FROM ms"
    )
    sql["call_alignment"] = _with(*same_path, _CALLS) + (
        f"SELECT {_FP}, old_ord, new_ord, status, old_call::BIGINT AS old_call, new_call::BIGINT AS new_call FROM cc"
    )
    sql["call_diff"] = _with(*same_path, _CALLS) + (
        f"SELECT {_FP}, old_ord, new_ord, old_expression, new_expression, ratio, dist "
        "FROM cc JOIN call_score USING (old_expression, new_expression) WHERE status = 'mapped'"
    )
    content = "list(m.method_ord || coalesce(m.class, '') || m.content ORDER BY m.method_ord)"
    sql["file_diff"] = _with(*with_renames, _MAPPED_FILES, recursive=True) + f""",
whole AS MATERIALIZED (SELECT repository_name, branch, path, {content} AS w FROM m GROUP BY ALL)
SELECT p.repository_name, p.prev_branch, p.branch, p.path, p.prev_path, 'mapped' AS status, a.w = b.w AS same_content
FROM mapped p JOIN whole a ON a.repository_name = p.repository_name AND a.branch = p.prev_branch AND a.path = p.prev_path
  JOIN whole b ON b.repository_name = p.repository_name AND b.branch = p.branch AND b.path = p.path
UNION ALL
SELECT {_FP}, NULL, 'removed', false FROM lo WHERE NOT EXISTS (SELECT 1 FROM renamed r
  WHERE r.repository_name = lo.repository_name AND r.prev_branch = lo.prev_branch AND r.branch = lo.branch AND r.prev_path = lo.path)
UNION ALL SELECT {_FP}, NULL, 'added', false FROM ln ANTI JOIN renamed USING ({_FP})"""

    # change records and statistics
    sql["change_records"] = _with(*whole, _CALLS, _records(True), recursive=True) + _RECORD_ROWS
    sql["change_records_incremental"] = sql["change_records"]
    gone = "(year(l_shipdate) + l_suppkey) % 3 = 0"
    thinned = _METHODS.replace("ON l_partkey = p_partkey)", f"ON l_partkey = p_partkey WHERE NOT ({gone}))", 1)
    there = _HISTORY_RELEASES.replace("pairs AS (", "all_pairs AS (", 1) + """,
pairs AS (
  SELECT * FROM all_pairs
  WHERE (right(prev_branch, 4)::INT + split_part(repository_name, '-', 2)::INT) % 3 != 0)"""
    for name, releases in (("missing_next", there), ("empty_release", _HISTORY_RELEASES)):
        parts = [releases, thinned, _FILES, _renames(), _MAPPED_FILES, _ALIGN, _SCORED, _CALLS, _records(True)]
        sql[f"change_records_{name}"] = _with(*parts, recursive=True) + _RECORD_ROWS
    sql["change_records_three_rows"] = _with(*whole, _CALLS, _records(False), recursive=True) + _RECORD_ROWS
    sql["change_status"] = _with(*with_renames, _MAPPED_FILES, _FILE_STATUS, recursive=True) + (
        "SELECT repository_name, branch, path, status AS file_status FROM fs"
    )
    release = "repository_name, branch"
    sql["branch_file_status"] = stats + f"SELECT {release}, files_added, files_removed, files_mapped FROM stat"
    sql["branch_files_changed"] = stats + f"SELECT {release}, n_files_changed, n_files_unchanged FROM stat"
    sql["branch_methods_changed"] = stats + f"SELECT {release}, n_methods_changed, n_methods_unchanged FROM stat"
    sql["branch_change_averages"] = stats + f"SELECT {release}, methods_avg_ratio, methods_avg_dist FROM stat"
    sql["branch_statistics"] = stats + "SELECT * FROM stat"
    sql["branch_status_stack"] = stats + """
SELECT repository_name, branch, release_no, 'files_added' AS series, files_added AS height, 0::BIGINT AS base FROM stat
UNION ALL SELECT repository_name, branch, release_no, 'files_removed', files_removed, files_added FROM stat
UNION ALL SELECT repository_name, branch, release_no, 'n_files_changed', n_files_changed, files_added + files_removed FROM stat
UNION ALL SELECT repository_name, branch, release_no, 'n_files_unchanged', n_files_unchanged,
  files_added + files_removed + n_files_changed FROM stat"""
    sql["change_regression"] = stats + (
        "SELECT repository_name, round(regr_slope(n_methods_changed, n_files_changed), 6) AS slope, "
        "round(regr_intercept(n_methods_changed, n_files_changed), 6) AS intercept FROM stat GROUP BY ALL"
    )
    per_repo = "SELECT 'https://github.com/forge/cust-' || o_custkey AS repository, count(*) AS n FROM orders GROUP BY ALL"
    sql["releases_per_repo"] = per_repo
    sql["files_per_release"] = _with(_METHODS) + "SELECT repository_name, branch, count(*) AS n FROM files GROUP BY ALL"
    sql["hist_releases_per_repo"] = _histogram(per_repo, 4)
    per_release = "SELECT count(*) AS n FROM files GROUP BY repository_name, branch"
    sql["hist_files_per_release"] = _with(_METHODS) + _histogram(per_release, 4)
    sql["hist_files_shown"] = _with(_METHODS) + f"SELECT * FROM ({_histogram(per_release, 4)}) WHERE hi > 40 AND lo <= 50"
    # the six queries over files of one path, over renamed files as well
    for name in ("method_match_exact", "method_match_signature", "methods_added_removed", "method_diff", "call_alignment", "call_diff"):
        whole = sql[name].replace(_SAME_PATH_ONLY, f"{_renames()},\n{_MAPPED_FILES}").removeprefix("WITH ").removeprefix("RECURSIVE ")
        sql[f"{name}_all_files"] = "WITH RECURSIVE " + whole
    return sql
